"""Files in archives: few files however many statements, each there once, read like files of their own."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daybook.plans import file_plans
from daybook.sources import pdf, workbook
from daybook.sources.workbook import BookWriter, cells_of
from daybook.storage import save_archives


def named(spark, n):
    return spark.range(n).repartition(3).select(F.format_string("s-%d.pdf", "id").alias("name"), "id")


def _made():
    return lambda row: pdf.document_of([[f"{row['id']} page {k}"] for k in (1, 2, 3)])


pages_for = _made()  # a lambda, so that tasks need not find this module


def read(spark, folder, **options):
    pdf.register(spark)
    return spark.read.format("statement_pages").options(path=str(folder), **options).load()


def test_statements_make_few_files(spark, sf_dir):
    """A file a statement would be millions to list; archives hold all of them, once each."""
    made = list(Path(file_plans.printed_files(spark, sf_dir)).iterdir())
    held = [n for p in made for n in zipfile.ZipFile(p).namelist()]
    statements = file_plans.relation(spark, sf_dir, "tx").select("stmt_id").distinct().count()
    assert len(held) == len(set(held)) == statements > 8 * len(made)


def test_archives_are_read_in_shares(spark, tmp_path):
    save_archives(named(spark, 500), str(tmp_path), pages_for, most_bytes=40_000)
    (tmp_path / "alone.pdf").write_bytes(pages_for({"id": 500}))
    sizes = [p.stat().st_size for p in tmp_path.glob("*.zip")]
    assert len(sizes) > 8 and max(sizes) < 80_000 and not [p for p in tmp_path.iterdir() if p.name.startswith(".")]
    want = sorted((k, n) for k in range(501) for n in (1, 2, 3))
    for task_bytes in (10_000, 1 << 24):
        rows = read(spark, tmp_path, task_bytes=task_bytes).collect()
        assert sorted((int(r["lines"][0].split(" ")[0]), r["page_number"]) for r in rows) == want
    path = next(r["path"] for r in rows if r["lines"][0].startswith("77 "))
    assert path.endswith(".zip/s-77.pdf")
    assert [r["lines"] for r in read(spark, tmp_path).where((F.col("path") == path) & (F.col("page_number") == 2)).collect()] == [["77 page 2"]]
    assert read(spark, tmp_path, header_pages=1).count() == 501


def test_odd_archives(spark, tmp_path):
    (tmp_path / "no.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as book:
        book.writestr("empty.pdf", b"")
        book.writestr("large.pdf", b"%PDF-" + b"x" * 5000)
        book.writestr("fine.pdf", pages_for({"id": 1}))
    got = sorted((r["path"].rpartition("/")[2], r["status"]) for r in read(spark, tmp_path, most_bytes=4000).collect())
    assert got == [("empty.pdf", "EMPTY"), ("fine.pdf", "OK"), ("fine.pdf", "OK"), ("fine.pdf", "OK"), ("large.pdf", "TOO_LARGE"), ("no.zip", "BROKEN")]


def test_workbooks_in_archives(spark, tmp_path):
    sheet = spark.range(300).selectExpr("id DIV 3 AS stmt_id", "CAST(id % 3 + 1 AS INT) AS no", "concat('n', id) AS name")
    workbook.save_workbooks(spark, workbook.in_workbooks(sheet, "s", "stmt_id", "no"), str(tmp_path), archive_bytes=50_000)
    made = list(tmp_path.iterdir())
    held = {n: zipfile.ZipFile(p).read(n) for p in made for n in zipfile.ZipFile(p).namelist()}
    assert len(made) < 20 and len(held) == sum(len(zipfile.ZipFile(p).namelist()) for p in made) == 100
    assert list(cells_of(held["s-7.xlsx"]))[0] == (1, ["no", "name"])
    back = sorted((r["file"], r["row"], tuple(r["cells"])) for r in workbook.read_workbooks(spark, str(tmp_path)).where("row > 1").collect())
    assert back == sorted((f"s-{k // 3}.xlsx", k % 3 + 2, (str(k % 3 + 1), f"n{k}")) for k in range(300))


def test_rows_that_lie_apart_are_refused_in_archives(tmp_path):
    writer = BookWriter(str(tmp_path), ["file", "no"], 1000)
    with pytest.raises(ValueError, match="together"):
        writer.write(iter([("a", 1), ("b", 1), ("a", 2)]))
    one, two = (writer.write(iter([("a", k)])) for k in (1, 2))
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([one, two, None])
    assert list(tmp_path.iterdir()) == []


def test_many_files_in_a_task(tmp_path):
    """Whether a name was there is looked up, not searched for: 20,000 files took 200 million comparisons."""

    class Name(str):
        compared = 0

        def __eq__(self, other):
            Name.compared += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    writer = BookWriter(str(tmp_path), ["file", "no"], 1 << 20)
    writer.write((Name(f"f{k}"), 1) for k in range(500))
    assert Name.compared < 5000

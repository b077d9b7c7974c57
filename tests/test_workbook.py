"""Workbooks: cells, files that are whole or not there, parts of long statements; documents in parts."""

import datetime
import decimal
import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from daybook.operators import vouchers
from daybook.plans import voucher_plans
from daybook.sources import workbook
from daybook.sources.workbook import BookWriter, Sheet, cells_of, letters

SCHEMA = "file string, no int, name string, on_day date, amount decimal(15,2)"


def test_column_names():
    assert [letters(k) for k in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_a_sheet():
    sheet = Sheet(["NO.", "NAME", "DAY", "AMOUNT"])
    sheet.add((1, ' <a> & "b"\x00 é ', datetime.date(2024, 3, 1), decimal.Decimal("1234.50")))
    sheet.add((2, None, None, None))
    sheet.add((3, "000123", datetime.date(1900, 3, 1), decimal.Decimal("-0.05")))
    sheet.write(out := io.BytesIO())
    assert list(cells_of(out.getvalue())) == [(1, ["NO.", "NAME", "DAY", "AMOUNT"]), (2, ["1", ' <a> & "b" é ', "45352", "1234.50"]), (3, ["2"]), (4, ["3", "000123", "61", "-0.05"])]
    book = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    assert book.testzip() is None
    for name in book.namelist():
        ElementTree.fromstring(book.read(name))
    xml = book.read("xl/worksheets/sheet1.xml").decode()
    assert 'autoFilter ref="A1:D4"' in xml and 'state="frozen"' in xml and 's="2"><v>45352' in xml and 's="3"><v>1234.50' in xml


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_files_are_whole_or_not_there(spark, tmp_path):
    rows = [("a.xlsx", i, f"n{i}", datetime.date(2024, 1, 1), decimal.Decimal(i)) for i in range(1, 2001)] + [("b.xlsx", 1, "one", None, None)]
    dealt = frame(spark, rows).repartition("file").sortWithinPartitions("file", "no")
    workbook.save_workbooks(spark, dealt, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.xlsx", "b.xlsx"]
    back = sorted((r["file"], r["row"], r["cells"][0]) for r in workbook.read_workbooks(spark, str(tmp_path / "out")).collect())
    assert back == [("a.xlsx", i + 1, str(i) if i else "no") for i in range(2001)] + [("b.xlsx", 1, "no"), ("b.xlsx", 2, "1")]
    bad = dealt.withColumn("name", F.when(F.col("file") == "b.xlsx", F.raise_error(F.lit("stop"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="stop"):
        workbook.save_workbooks(spark, bad, str(tmp_path / "failed"))
    assert not (tmp_path / "failed").exists() or list((tmp_path / "failed").iterdir()) == []


def test_rows_that_lie_apart_are_refused(tmp_path):
    writer = BookWriter(str(tmp_path), ["file", "no"])
    with pytest.raises(ValueError, match="together"):
        writer.write(iter([("a", 1), ("b", 1), ("a", 2)]))
    one, two = (writer.write(iter([("a", k)])) for k in (1, 2))
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([one, two, None])
    assert list(tmp_path.iterdir()) == []
    writer.commit([writer.write(iter([("a", 1)])), writer.write(iter([]))])
    assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_long_statements_take_several_files(spark, tmp_path):
    sheet = spark.range(1, 26).select(F.lit(7).alias("stmt_id"), F.col("id").cast("int").alias("VOUCHER NO."), F.lit("x").alias("NARRATION"))
    workbook.save_workbooks(spark, workbook.in_workbooks(sheet, "s", "stmt_id", "VOUCHER NO.", 10), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["s-7-2.xlsx", "s-7-3.xlsx", "s-7.xlsx"]
    assert [r[1][0] for r in cells_of((tmp_path / "s-7-3.xlsx").read_bytes())] == ["VOUCHER NO.", "21", "22", "23", "24", "25"]


def test_parts_make_the_document(spark, sf_dir):
    fragments = vouchers.voucher_xml(voucher_plans.vouched(spark, sf_dir)).cache()
    whole = {r["stmt_id"]: r["document"] for r in vouchers.voucher_documents(fragments).collect()}
    parts = vouchers.document_parts(fragments, 3).collect()
    assert max(r["part"] for r in parts) > 2
    for stmt, document in whole.items():
        own = sorted((r for r in parts if r["stmt_id"] == stmt), key=lambda r: r["part"])
        assert [r["part"] for r in own] == list(range(1, own[0]["n_parts"] + 1))
        assert "".join(r["text"] for r in own) == document
        ElementTree.fromstring(document.encode())

"""Statement files: lines by position, pages by range, files that can't be read."""

import re
import zlib

import pytest

from daybook.sources import pdf
from daybook.sources.pdf import Share, Wanted, document_of, pages_of
from daybook.sources.pdf_objects import Broken, Document, Locked, Parser, pieces, unpredicted


def lines_of(data, n=1):
    d = Document(data)
    return [d.lines(page) for _, page in d.pages(1, n)]


def made(objects, trailer=b"/Root 1 0 R"):
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for number, body in objects.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in places.items())
    return bytes(out + b"trailer <<%s>>\nstartxref\n%d\n%%%%EOF" % (trailer, table))


def stream(raw, about=b""):
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(raw), about, raw)


def one_page(content, font=b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>", more=None):
    return made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Count 1/Kids[3 0 R]/Resources<</Font<</F1 5 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 4 0 R>>", 4: stream(content), 5: font} | (more or {}))


def test_objects():
    p = Parser(rb"<</A 1/B[2 0 R (a\(b\)\\c\101\n) <4142> -1.5 true null]/C#20D /x>> Tj % note" + b"\n 7")
    first = p.next()
    assert first["A"] == 1 and first["B"][0].number == 2 and bytes(first["B"][1]) == b"a(b)\\cA\n" and bytes(first["B"][2]) == b"AB"
    assert first["B"][3:] == [-1.5, True, None] and first["C D"] == "x"
    assert p.next() == b"Tj" and p.next() == 7
    with pytest.raises(Broken):
        Parser(b"[" * 300).next()


def test_pages_and_their_lines():
    pages = [[f"{n}/{i} 01/04/2026 UPI/ABC (X) \\ 5,000.00 ₹" for i in range(n % 5)] for n in range(1, 41)]
    data = document_of(pages)
    want = [[x.replace("₹", "?") for x in p] for p in pages]
    assert Document(data).n_pages == 40 and lines_of(data, 40) == want
    assert [n for n, _ in Document(data).pages(17, 19)] == [17, 18, 19]
    assert [Document(data).lines(p) for _, p in Document(data).pages(33, 34)] == want[32:34]


def test_a_slice_does_not_touch_other_pages():
    data = document_of([[f"page {n} " + "x" * n] for n in range(1, 31)])
    inflated = [m.span(1) for m in re.finditer(rb"FlateDecode>>stream\n(.*?)\nendstream", data, re.S)]
    broken = bytearray(data)
    for k, (a, b) in enumerate(inflated, 1):
        if k != 17:
            broken[a:b] = b"\0" * (b - a)
    rows = list(pages_of(bytes(broken), Share("p", 0, 1), Wanted(17, 17, pages_only=True), 2500))
    assert rows == [("p", 17, 30, ["page 17 " + "x" * 17], 25, "OK")]
    assert [r[5] for r in pages_of(bytes(broken), Share("p", 0, 1), Wanted(16, 18), 2500)] == ["BROKEN_PAGE", "OK", "BROKEN_PAGE"]


def test_positions_make_lines():
    content = b"""q 1 0 0 1 10 0 cm BT /F1 10 Tf 100 700 Td (Balance) Tj ET Q
BT /F1 10 Tf 20 700 Td (Date) Tj 0 -20 Td [(01/04) -50 (/26) -900 (PAY)] TJ 1 0 0 1 200 680.5 Tm (5.00) Tj ET
BT /F1 10 Tf 15 TL 20 650 Td (a) Tj (b) ' 3 1 (c d) " T* <65> Tj ET BI /W 1 ID \x00(\xff EI
BT /F1 10 Tf 300 650 Td (   ) Tj 0 -200 Td ( ) Tj ET"""
    assert lines_of(one_page(content)) == [["Date Balance", "01/04/26 PAY 5.00", "a", "b", "c d", "e"]]


def test_codes_of_composite_fonts():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <20B9> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0061> <0062>] endbfrange"
    more = {6: stream(zlib.compress(cmap), b"/Filter/FlateDecode")}
    data = one_page(b"BT /F1 9 Tf 20 700 Td <0001000200100011001200200021> Tj ET", b"<</Subtype/Type0/Encoding/Identity-H/ToUnicode 6 0 R>>", more)
    assert lines_of(data) == [["₹fiABCab"]]
    named = one_page(b"BT /F1 9 Tf 20 700 Td (\x01\x02\x03Z) Tj ET", b"<</Subtype/Type1/Encoding<</Differences[1/A/comma/uni20B9]>>>>")
    assert lines_of(named) == [["A,₹Z"]]


def test_widths_decide_about_spaces():
    font = b"<</Subtype/TrueType/BaseFont/X/FirstChar 65/Widths[1000 200]>>"
    assert lines_of(one_page(b"BT /F1 10 Tf 20 700 Td (AA) Tj 1 0 0 1 40.5 700 Tm (B) Tj 1 0 0 1 60 700 Tm (B) Tj ET", font)) == [["AAB B"]]


def with_table_stream(predictor):
    """Objects 1 to 3 in an object stream, and the table as a stream of differences."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Count 1/Kids[3 0 R]>>", b"<</Type/Page/Contents 4 0 R/Resources<</Font<<>>>>>>"]
    offsets = [sum(len(x) + 1 for x in inner[:i]) for i in range(3)]
    head = b" ".join(b"%d %d" % (i + 1, o) for i, o in enumerate(offsets)) + b" "
    holder = zlib.compress(head + b" ".join(inner))
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for number, body in {4: stream(zlib.compress(b"BT /F1 9 Tf 9 9 Td (held) Tj ET"), b"/Filter/FlateDecode"), 5: stream(holder, b"/Type/ObjStm/N 3/First %d/Filter/FlateDecode" % len(head))}.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    places[6] = len(out)
    rows = [bytes([0, 0, 0, 0])] + [bytes([2, 0, 5, i]) for i in range(3)] + [bytes([1]) + places[k].to_bytes(2, "big") + b"\0" for k in (4, 5, 6)]
    if predictor:
        rows = [bytes([2]) + bytes((a - b) & 255 for a, b in zip(row, above, strict=True)) for row, above in zip(rows, [bytes(4), *rows], strict=False)]
    parms = b"/DecodeParms<</Predictor 12/Columns 4>>" if predictor else b""
    body = stream(zlib.compress(b"".join(rows)), b"/Type/XRef/Root 1 0 R/Size 7/W[1 2 1]/Filter/FlateDecode" + parms)
    return bytes(out + b"6 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (body, places[6]))


@pytest.mark.parametrize("predictor", [False, True])
def test_tables_and_objects_in_streams(predictor):
    data = with_table_stream(predictor)
    assert lines_of(data) == [["held"]]
    assert lines_of(data.replace(b"startxref", b"startxxxx")) == [["held"]]  # found by its words


def test_predictors():
    rows = bytes([0, 5, 6, 7]) + bytes([1, 1, 1, 1]) + bytes([2, 1, 1, 1]) + bytes([3, 1, 1, 1]) + bytes([4, 1, 1, 1])
    assert unpredicted(rows, 3) == bytes([5, 6, 7, 1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])


def test_a_later_part_of_the_file_counts():
    data = one_page(b"BT /F1 9 Tf 9 9 Td (old) Tj ET")
    table = data.rindex(b"xref\n0 1")
    place = len(data) + 1
    after = data + b"\n4 0 obj\n" + stream(b"BT /F1 9 Tf 9 9 Td (new) Tj ET") + b"\nendobj\n"
    after += b"xref\n4 1\n%010d 00000 n \ntrailer<</Root 1 0 R/Prev %d>>\nstartxref\n%d\n" % (place, table, len(after))
    assert lines_of(after) == [["new"]]
    assert lines_of(data[: data.rindex(b"xref\n0 1")]) == [["old"]]  # cut off before its table


def test_what_can_not_be_read():
    with pytest.raises(Locked):
        Document(made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Count 0/Kids[]>>", 3: b"<</Filter/Standard>>"}, b"/Root 1 0 R/Encrypt 3 0 R"))
    for junk in (b"", b"plain text named .pdf", b"%PDF-1.4 nothing", b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 1 0 R>> endobj", b"%PDF-1.4\n1 0 obj\n<</Length 1 0 R>>\nstream\n"):
        rows = list(pages_of(junk, Share("p", 0, 1), Wanted(), 9))
        assert rows and rows[0][5] in ("BROKEN", "EMPTY", "NO_PAGES", "BROKEN_PAGE", "TOO_MANY_PAGES")
    ring = made({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[2 0 R]>>"})
    assert [r[5] for r in pages_of(ring, Share("p", 0, 1), Wanted(), 9)] == ["BROKEN"]
    assert [r[5] for r in pages_of(document_of([["x"]] * 11), Share("p", 0, 1), Wanted(), 9)] == ["TOO_MANY_PAGES"]
    assert list(pieces(b"(no font) Tj /F9 9 Tf (x) Tj Q Q", {}))[0].text == "no font"


def test_shares_of_a_file_make_all_its_pages():
    data = document_of([[str(n)] for n in range(1, 24)])
    for parts in (1, 2, 5, 40):
        rows = [r for k in range(parts) for r in pages_of(data, Share("p", k, parts), Wanted(), 99)]
        assert [r[1] for r in rows] == list(range(1, 24)) and [r[3] for r in rows] == [[str(n)] for n in range(1, 24)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("files")
    for k in range(12):
        (place / f"s{k:02}.pdf").write_bytes(document_of([[f"file {k} page {n}", "second"] for n in range(1, k + 2)]))
    (place / "empty.pdf").write_bytes(b"")
    (place / "fake.pdf").write_bytes(b"not one")
    (place / "large.pdf").write_bytes(b"%PDF-" + bytes(60_000))
    pdf.register(spark)
    return place


def load(spark, folder, **options):
    return spark.read.format("statement_pages").options(path=str(folder), **options).load()


def test_the_source(spark, folder):
    rows = load(spark, folder, most_bytes=50_000, task_bytes=40_000).collect()
    told = {r["path"].rpartition("/")[2]: r["status"] for r in rows if r["page_number"] is None}
    assert told == {"empty.pdf": "EMPTY", "fake.pdf": "BROKEN", "large.pdf": "TOO_LARGE"}
    pages = sorted((r["path"][-7:-4], r["page_number"], tuple(r["lines"])) for r in rows if r["page_number"])
    assert pages == [(f"s{k:02}", n, (f"file {k} page {n}", "second")) for k in range(12) for n in range(1, k + 2)]
    assert load(spark, folder, task_bytes=30_000).rdd.getNumPartitions() > 3
    assert load(spark, folder, task_bytes=500).where("path LIKE '%s09.pdf'").count() == 10  # one file over several tasks
    assert load(spark, f"file://{folder}/s03.pdf,file://{folder}/s04.pdf").count() == 9
    assert load(spark, folder, header_pages=3).where("page_number > 0").count() == 1 + 2 + 3 * 10
    assert load(spark, folder, most_pages=4).where("status = 'TOO_MANY_PAGES'").count() == 8


def test_filters_reach_the_source(spark, folder):
    one = load(spark, folder).where(f"page_number BETWEEN 3 AND 4 AND path IN ('{folder}/s05.pdf', '{folder}/s02.pdf')").select("page_number", "lines")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)
    assert sorted(r["lines"][0] for r in one.collect()) == ["file 2 page 3", "file 5 page 3", "file 5 page 4"]
    assert load(spark, folder).where("page_number = 12").count() == 1
    assert load(spark, folder).where("page_number > 10 AND page_number <> 11").count() == 1
    assert load(spark, folder).where("page_number IS NULL AND status = 'EMPTY'").count() == 1

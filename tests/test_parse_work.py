"""Work of the parse queries: lines without repeated windows, tokens and headers as before."""

from decimal import Decimal

from pyspark.sql import functions as F

from daybook.functions.scalars import normalize_amount
from daybook.operators import segment
from daybook.plans import parse_plans
from daybook.sources.fixtures import relation
from daybook.storage import written_paths


def test_lines_are_made_without_windows(spark, sf_dir):
    """The six parts of the lines share one table of narrated rows; each numbered and summed all orders again."""
    plan = relation(spark, sf_dir, "lines")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_tokens(spark):
    texts = ["a 1,234.50Cr -5.00 .5 1.2.3 12 1,2 Cr. x,y 7.Dr", "", "  ", None, "9.99"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", segment.amount_tokens(F.col("t")))
    got = {r["i"]: (r["s"]["amounts"], r["s"]["words"]) if r["s"] else None for r in df.collect()}
    d = lambda *x: [Decimal(v) for v in x]
    assert got == {0: (d("1234.50", "-5.00", "0.50", "12.00", "7.00"), "a 1.2.3 12 Cr. x,y"), 1: ([], ""), 2: ([], ""), 3: (None, None), 4: (d("9.99"), "")}


def test_amounts_are_read_once(spark):
    texts = ["1,234.50", "(5.00)", "Rs. 7 Cr", "(8 Dr)", "INR 9.999", "x", "", None, "()", "-3 dr."]
    plan = spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize_amount(F.col("t")).alias("v"))
    assert [str(r["v"]) for r in plan.collect()] == ["1234.50", "-5.00", "7.00", "-8.00", "10.00", "0.00", "0.00", "0.00", "0.00", "-3.00"]
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("regexp_replace") == 4  # as many as the rule has


def test_headers_are_looked_at_for_dates_first(spark):
    rows = [(1, ["Txn Date", "Details", "DR", "Cr", "Balance"]), (2, ["UPDATE", "5", None]), (3, ["VALUE DATE", "DEBIT"]), (4, ["date", "Amount"]), (5, ["1/2/2024", "DEBIT"]), (6, [])]
    df = spark.createDataFrame(rows, "i int, cells array<string>").select("i", segment.header_roles(F.col("cells")).alias("r"))
    got = {r["i"]: r["r"] for r in df.collect()}
    assert got == {1: {"date": 0, "narration": 1, "debit": 2, "credit": 3, "balance": 4}, 2: None, 3: None, 4: {"date": 0, "amount": 1}, 5: None, 6: None}


def test_page_diagnostics_reads_the_lines_once(spark, sf_dir):
    """Each page's lines were joined with all records' lines, and the narrated rows were written twice."""
    before = len(written_paths())
    plan = parse_plans.r15(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    labels = [p.rpartition("/")[2].rpartition("-")[0] for p in written_paths()[before:]]
    assert sorted(labels) == ["narrated", "page-counts"] and "Join" not in plan


def test_page_diagnostics_of_pages_with_loose_lines(spark):
    lines = [(1, 1, k, f"0{k}/01/2024 x{k} ") for k in range(1, 9)] + [(1, 2, 1, "text"), (2, 1, 1, "01/02/2024 a"), (None, 1, 1, "01/02/2024 b"), (3, 1, 1, None), (4, 1, 1, "1/2/2024 same"), (4, 1, 2, "1/2/2024 same")]
    found = [(1, 1, ["01/01/2024 x1", " 08/01/2024 x8"]), (2, 1, ["01/02/2024 a"]), (4, 1, ["1/2/2024 same"]), (None, 1, ["01/02/2024 b"]), (9, 9, ["no page"])]
    got = segment.page_diagnostics(
        spark.createDataFrame(lines, "doc_id int, page_number int, line_no int, line string"), spark.createDataFrame(found, "doc_id int, page_number int, source_lines array<string>")
    ).collect()
    assert {(r["doc_id"], r["page_number"]): (r["detected"], r["extracted"], r["unparsed"]) for r in got} == {
        (1, 1): (8, 1, "|".join(f"0{k}/01/2024 x{k}" for k in range(2, 7))), (1, 2): (0, 0, ""), (2, 1): (1, 1, ""),
        (None, 1): (1, 0, "01/02/2024 b"), (3, 1): (0, 0, ""), (4, 1): (2, 1, ""),
    }

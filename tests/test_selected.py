"""Filtered reads: what reaches the reader, order and limit."""

from daybook.operators.usage import selected


def test_filters_reach_the_reader(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = selected(rows, {"o_orderstatus": "F"}, [{"o_custkey": 3}, {"o_custkey": 5, "o_orderpriority": "1-URGENT"}], (("o_orderdate", True),), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "EqualTo(o_orderstatus,F)" in pushed and "Or(EqualTo(o_custkey,3)" in pushed and "TakeOrderedAndProject" in plan
    want = sorted((r for r in rows.collect() if r["o_orderstatus"] == "F" and (r["o_custkey"] == 3 or (r["o_custkey"] == 5 and r["o_orderpriority"] == "1-URGENT"))), key=lambda r: r["o_orderdate"], reverse=True)[:4]
    assert [r["o_orderdate"] for r in found.collect()] == [r["o_orderdate"] for r in want]


def test_no_conditions(spark):
    assert selected(spark.range(5)).count() == 5 and [r[0] for r in selected(spark.range(5), order=(("id", True),), limit=2).collect()] == [4, 3]

"""The conversion chain as a whole, pages that arrive as files, and admission against a plain fold."""

import random

from pyspark.sql import functions as F

from daybook.operators import usage, vouchers
from daybook.plans.statement_plans import convert
from daybook.sources.fixtures import relation
from daybook.streaming.pages import append_pages


def test_conversion_keeps_every_row_and_balances(spark, sf_dir):
    made = convert(spark, sf_dir).cache()
    tx = relation(spark, sf_dir, "narrated")
    per_statement = {r["stmt_id"]: r["n"] for r in tx.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["stmt_id"]: (r["n"], r["last"]) for r in made.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last")).collect()}
    for stmt, n in per_statement.items():
        if stmt % 10:  # the others have a quota of pages
            assert got[stmt] == (n, n)
    assert sum(n for n, _ in got.values()) <= sum(per_statement.values())
    legs = vouchers.entries(made.withColumn("bank_ledger_name", F.lit("Bank")).withColumn("instrument_number", F.lit("1")))
    assert vouchers.unbalanced(legs).count() == 0
    given = tx.where("stmt_id % 2 = 0 AND stmt_id % 10 <> 0").select("stmt_id", F.greatest("debit", "credit").alias("amount"))
    out = made.where("stmt_id % 2 = 0 AND stmt_id % 10 <> 0").select("stmt_id", F.greatest("debit", "credit").alias("amount"))
    assert given.exceptAll(out).count() == out.exceptAll(given).count() == 0
    banks = made.where("stmt_id % 7 <> 0").select("bank_name").distinct().count()
    assert banks > 30


def test_pages_are_appended_once(spark, tmp_path):
    schema = "doc_id long, page_number int, line string"
    page = lambda doc, n: spark.createDataFrame([(doc, n, f"line of {doc}/{n}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    allowed = spark.createDataFrame([(1, 2)], "doc_id long, pages int")
    run = lambda: append_pages(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", allowed)
    rows = lambda: sorted((r["doc_id"], r["page_number"]) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
    page(1, 1)
    page(2, 1)
    run()
    run()
    assert rows() == [(1, 1), (2, 1)]
    page(1, 2)
    page(1, 3)
    run()
    assert rows() == [(1, 1), (1, 2), (2, 1)]


def test_admission_is_a_fold(spark):
    rng = random.Random(4)
    events, at = [], {u: 0 for u in range(5)}
    for i in range(600):
        user = rng.randrange(5) if rng.random() < 0.5 else 0
        at[user] += rng.choice((0, 5, 40, 70, 200, 599, 600, 900))
        events.append((user, i, at[user]))
    df = spark.createDataFrame(events, "user_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["event_id"]: r["is_admitted"] for r in usage.admitted(df).collect()}
    history: dict[int, list[int]] = {}
    for user, i, s in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        times = [t for t in history.get(user, []) if s - t < 600]
        yes = len(times) < 3 and not (times and s - times[-1] < 60)
        history[user] = [*history.get(user, []), s] if yes else history.get(user, [])
        assert got[i] == yes


def test_admission_and_its_sql_drop_fractions_of_seconds(spark, tmp_path):
    import duckdb

    from daybook.plans.statement_plans import ORACLES

    at = [0.6, 60.2, 130.5, 190.4, 700.7, 760.5]
    spark.createDataFrame([(1, i, s) for i, s in enumerate(at)], "user_id long, event_id long, s double").select("user_id", "event_id", F.expr("timestamp_micros(cast(s * 1000000 as long))").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events")
    con = duckdb.connect()
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW events AS SELECT user_id, event_id, ts::TIMESTAMP AS ts FROM read_parquet('{tmp_path}/events/*.parquet')")
    want = dict((i, yes) for _, i, yes in con.execute(ORACLES["T4_admission"]).fetchall())
    assert {r["event_id"]: r["is_admitted"] for r in usage.admitted(spark.read.parquet(f"{tmp_path}/events")).collect()} == want
    assert want[1]  # seconds 0 and 60; rounded, 1 and 60

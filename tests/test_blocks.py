"""The scan over blocks: equal to the windows over statements and to a plain fold, whatever the blocks' size, and no task holds a long statement."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daybook.operators import balance, statements

SCHEMA = "stmt_id long, row_index int, tx_date date, debit decimal(15,2), credit decimal(15,2), balance decimal(15,2), opening decimal(15,2), validation_status string, narration string"


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for stmt in (0, 1, 2, 3, None):
        at = rng.choice([-40, 0, 3])
        opening = rng.choice([None, Decimal(rng.randrange(1000))])
        true = opening or Decimal(50)
        for _ in range(n if stmt == 0 else n // 5):
            at += rng.choice([1, 1, 1, 4, 30])
            d, c = rng.choice([(Decimal(rng.randrange(1, 900)) / 4, Decimal(0)), (Decimal(0), Decimal(rng.randrange(1, 900)) / 4), (Decimal(0), Decimal(0))])
            true += c - d
            printed = rng.choice([true, true, None, None, true + Decimal("0.5"), true - 2 * (c - d), true + 40])
            rows.append((stmt, at, None, d, c, printed, opening, rng.choice(["ERROR", "VALID", "WARNING", "WARNING"]), "n"))
    rng.shuffle(rows)
    return rows


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def reviewed(rows):
    """(stmt, index, balance, status), row by row."""
    out = []
    for stmt in {r[0] for r in rows}:
        now = None
        for k, r in enumerate(sorted((r for r in rows if r[0] == stmt), key=lambda r: r[1])):
            _, i, _, d, c, b, opening, status, _ = r
            now = opening if k == 0 else now
            if status == "ERROR":
                now = b if b is not None else now
            elif now is not None:
                want = now + c - d
                if b is None:
                    b, status = want, "VALID"
                else:
                    status = "VALID" if abs(want - b) <= Decimal("0.01") else "WARNING" if abs(want - b) <= 1 else "ERROR"
                now = b
            else:
                now = None
            out.append((stmt, i, b, status))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [1, 3, 16, 100_000])
def test_blocks_of_any_size_give_what_windows_give(spark, block_rows):
    df = spark.createDataFrame(made(120, block_rows), SCHEMA).cache()
    assert of(balance.with_previous(df, block_rows)) == of(balance.with_previous(df).select(*balance.with_previous(df, block_rows).columns))
    assert of(balance.audit(df, block_rows=block_rows)) == of(balance.audit(df))
    assert of(balance.strict_audit(df, block_rows)) == of(balance.strict_audit(df))
    assert of(balance.review_audit(df, block_rows=block_rows)) == of(balance.review_audit(df))
    assert of(statements.filled_balances(df, block_rows)) == of(statements.filled_balances(df))


@pytest.mark.parametrize("seed", range(4))
def test_review_is_a_fold(spark, seed):
    rows = made(60, seed)
    got = of(balance.review_audit(spark.createDataFrame(rows, SCHEMA), block_rows=5))
    assert got == reviewed(rows)


def test_no_rows(spark):
    assert balance.audit(spark.createDataFrame([], SCHEMA), block_rows=3).count() == 0


def long_statement(spark, n):
    """One statement whose balance after row i is i % 1000 with some left out."""
    value = F.col("id") % 1000
    net = value - F.when(F.col("id") == 0, 0).otherwise((F.col("id") - 1) % 1000)
    zero = F.lit(0)
    return spark.range(n).select(
        (F.col("id") * 0 + 7).alias("stmt_id"), F.col("id").cast("int").alias("row_index"), F.lit(None).cast("date").alias("tx_date"), F.greatest(-net, zero).cast("decimal(15,2)").alias("debit"),
        F.greatest(net, zero).cast("decimal(15,2)").alias("credit"), F.when(F.col("id") % 3 == 0, value).cast("decimal(15,2)").alias("balance"), F.lit(0).cast("decimal(15,2)").alias("opening"),
    )


def test_a_long_statement_is_spread_over_the_tasks(spark):
    n = 3_000_000
    audited = balance.audit(long_statement(spark, n), block_rows=20_000).select("outcome", F.spark_partition_id().alias("task"))
    by_task = audited.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "MISMATCH").alias("bad"), F.count_if(F.col("outcome") == "MATCH").alias("good")).collect()
    assert sum(r["n"] for r in by_task) == n and sum(r["bad"] for r in by_task) == 0 and sum(r["good"] for r in by_task) > 300_000
    assert len(by_task) > 3 and max(r["n"] for r in by_task) < n / 2


def test_rows_are_exchanged_by_statement_and_block(spark):
    plan = balance.with_previous(long_statement(spark, 1000), 100)._jdf.queryExecution().executedPlan().toString().split("\n")
    exchanges = [(i, line) for i, line in enumerate(plan) if "Exchange hashpartitioning(" in line or "Exchange SinglePartition" in line]
    # what is dealt by the statement alone is one row a block, made by an aggregate below
    alone = [i for i, line in exchanges if "_block" not in line and "_of" not in line]
    assert len(alone) == 1 and len(exchanges) >= 3
    assert "Aggregate" in plan[alone[0] + 1]

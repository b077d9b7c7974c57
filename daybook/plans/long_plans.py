"""Registered queries on statements of any length, by the scan over blocks, with the SQL of the plain windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import balance, statements
from daybook.plans import audit_plans
from daybook.sources.fixtures import relation, with_ctes

#: Small enough that the longest statement has several blocks on every size of the tables.
BLOCK_ROWS = 500


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "long_tx")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.audit(_long(spark, sf_dir), block_rows=BLOCK_ROWS)


def w1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.statement_summary(_audited(spark, sf_dir))


def w1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("stmt_id", "row_index", "outcome", "validation_status", "confidence", "expected_balance")


def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir).where(F.col("outcome") == "SWAPPED")
    return rows.select("stmt_id", "row_index", "debit", "credit", F.when(F.col("debit") > 0, "Payment").otherwise("Receipt").alias("voucher_type"))


def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.with_previous(_long(spark, sf_dir), BLOCK_ROWS).select("stmt_id", "row_index", "opening_known", "previous_balance")


def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.filled_balances(_long(spark, sf_dir), BLOCK_ROWS).select("stmt_id", "row_index", "balance", "fill_status")


def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first error of the longest statement comes late, so its first blocks are unknown
    error = (F.col("k") % 19 == 0) & ((F.col("stmt_id") > 0) | (F.col("k") > 1500))
    return balance.review_audit(_long(spark, sf_dir).withColumn("validation_status", F.when(error, "ERROR").otherwise("WARNING")), block_rows=BLOCK_ROWS)


def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.strict_audit(_long(spark, sf_dir), BLOCK_ROWS)


QUERIES = {
    "W1_long_statement_summary": w1_summary,
    "W1_long_statement_rows": w1_rows,
    "W2_long_inverted_rows": w2,
    "W3_long_previous_balance": w3,
    "W13_long_filled_balances": w13,
    "W16_long_review_audit": w16,
    "W17_long_strict_audit": w17,
}


def _of_long(name: str) -> str:
    """The SQL of a query on statements, on the long ones."""
    return with_ctes("long_tx", audit_plans.BODIES[name].replace("FROM narrated", "FROM long_tx"))


ORACLES = {
    "W1_long_statement_summary": _of_long("W1_balance_audit_summary"),
    "W1_long_statement_rows": _of_long("W1_balance_audit_rows"),
    "W2_long_inverted_rows": _of_long("W2_inverted_rows"),
    "W3_long_previous_balance": _of_long("W3_previous_balance").replace("row_index, previous_balance FROM previous", "row_index, opening_known, previous_balance FROM previous"),
    "W13_long_filled_balances": with_ctes("long_tx", """
, m AS (SELECT *, sum(credit - debit) OVER (PARTITION BY stmt_id ORDER BY row_index) AS moved, first_value(opening) OVER (PARTITION BY stmt_id ORDER BY row_index) AS start FROM long_tx),
p AS (SELECT *, moved + coalesce(last_value(balance - moved IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) AS expected FROM m)
SELECT stmt_id, row_index, CAST(coalesce(balance, expected) AS DECIMAL(15,2)) AS balance, CASE WHEN balance <> expected THEN 'WARNING' ELSE 'VALID' END AS fill_status FROM p"""),
    "W16_long_review_audit": _of_long("W16_review_audit").replace("k % 19 = 0 AS err", "k % 19 = 0 AND (stmt_id > 0 OR k > 1500) AS err"),
    "W17_long_strict_audit": _of_long("W17_strict_audit"),
}

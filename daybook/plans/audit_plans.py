"""Registered queries on running balances, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import balance
from daybook.sources.fixtures import relation, with_ctes

_PREVIOUS = """
, opened AS (
  SELECT *, CAST(coalesce(first_value(opening) OVER w, CASE WHEN first_value(credit) OVER w > 0 THEN first_value(balance) OVER w - first_value(credit) OVER w
    WHEN first_value(debit) OVER w > 0 THEN first_value(balance) OVER w + first_value(debit) OVER w ELSE first_value(balance) OVER w END) AS DECIMAL(15,2)) AS opening_known,
    sum(credit - debit) OVER w AS moved
  FROM narrated WINDOW w AS (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
previous AS (
  SELECT *, CAST(moved - (credit - debit) + coalesce(last_value(balance - moved IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), opening_known) AS DECIMAL(15,2)) AS previous_balance
  FROM opened)"""
_AUDIT = (
    _PREVIOUS
    + """
, judged AS (
  SELECT *, CASE WHEN debit = 0 AND credit = 0 THEN 'ZERO' WHEN balance IS NULL OR previous_balance IS NULL THEN 'UNKNOWN'
    WHEN abs(previous_balance + credit - debit - balance) <= 0.01 THEN 'MATCH' WHEN abs(previous_balance + credit - debit - balance) <= 1.00 THEN 'MINOR'
    WHEN abs(previous_balance - credit + debit - balance) <= 1.00 THEN 'SWAPPED' ELSE 'MISMATCH' END AS outcome FROM previous),
audited AS (
  SELECT *, CASE WHEN outcome IN ('ZERO', 'MINOR') THEN 'WARNING' WHEN outcome = 'MISMATCH' THEN 'ERROR' ELSE 'VALID' END AS validation_status FROM judged)"""
)
_SUMMARY = (
    _AUDIT
    + """
, summed AS (
  SELECT stmt_id, count(*) AS n_rows, CAST(sum(debit) AS DECIMAL(25,2)) AS total_debit, CAST(sum(credit) AS DECIMAL(25,2)) AS total_credit, min(tx_date) AS statement_from, max(tx_date) AS statement_to,
    max(opening_known) AS opening_balance, last(balance ORDER BY row_index) AS closing_balance, count(*) FILTER (WHERE validation_status <> 'VALID') AS n_discrepancies, count(*) FILTER (WHERE validation_status = 'ERROR') AS n_errors
  FROM audited GROUP BY stmt_id)"""
)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.audit(relation(spark, sf_dir, "narrated"))


def w1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.statement_summary(_audited(spark, sf_dir))


def w1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir).select("stmt_id", "row_index", "outcome", "validation_status", "confidence", "expected_balance")


def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir).where(F.col("outcome") == "SWAPPED")
    return rows.select("stmt_id", "row_index", "debit", "credit", F.when(F.col("debit") > 0, "Payment").otherwise("Receipt").alias("voucher_type"))


def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.with_previous(relation(spark, sf_dir, "narrated")).select("stmt_id", "row_index", "previous_balance")


def _shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second statement newest first, every fifth on one day."""
    tx = relation(spark, sf_dir, "narrated")
    turned = tx.withColumn("row_index", F.when(F.col("stmt_id") % 2 == 0, 100000 - F.col("row_index")).otherwise(F.col("row_index")))
    return turned.withColumn("tx_date", F.when(F.col("stmt_id") % 5 == 0, F.lit("2024-01-01").cast("date")).otherwise(F.col("tx_date")))


_SHUFFLED = """
, shuffled AS (SELECT stmt_id, CAST(CASE WHEN stmt_id % 2 = 0 THEN 100000 - row_index ELSE row_index END AS INT) AS row_index, CASE WHEN stmt_id % 5 = 0 THEN DATE '2024-01-01' ELSE tx_date END AS tx_date, debit, credit, balance, opening FROM narrated),
neighbours AS (SELECT *, row_number() OVER w AS place, lead(tx_date) OVER w AS d1, lead(balance) OVER w AS b1, lead(debit) OVER w AS dr1, lead(credit) OVER w AS cr1 FROM shuffled WINDOW w AS (PARTITION BY stmt_id ORDER BY row_index)),
counted AS (SELECT stmt_id, count(*) FILTER (WHERE tx_date > d1) AS falling, count(*) FILTER (WHERE tx_date < d1) AS rising,
  count(*) FILTER (WHERE place <= 25 AND abs(balance + cr1 - dr1 - b1) <= 0.05) AS fwd, count(*) FILTER (WHERE place <= 25 AND abs(b1 + credit - debit - balance) <= 0.05) AS bwd FROM neighbours GROUP BY stmt_id),
chrono AS (SELECT stmt_id, falling, rising, (falling > rising AND falling >= 2) OR (falling = 0 AND rising = 0 AND bwd > fwd AND bwd >= 2) AS is_reversed FROM counted)"""


def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.reversed_statements(_shuffled(spark, sf_dir))


def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.in_chronology(_shuffled(spark, sf_dir)).select("stmt_id", "row_index", "new_index", "new_opening", "last_balance")


def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.with_previous(relation(spark, sf_dir, "narrated")).where("row_index = 1").select("stmt_id", "opening_known")


def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = relation(spark, sf_dir, "narrated")
    again = tx.where("k % 9 = 0").withColumn("row_index", F.col("row_index") + 50000).withColumn("narration", F.concat(F.lit(" "), F.lower("narration")))
    return balance.duplicates(tx.unionByName(again)).select("stmt_id", "row_index", "is_duplicate_suspect", "duplicate_of")


def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = relation(spark, sf_dir, "narrated")
    return balance.coarse_duplicate_counts(tx.unionByName(tx.where("k % 9 = 0")))


def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = relation(spark, sf_dir, "narrated").withColumn("validation_status", F.when(F.col("k") % 19 == 0, "ERROR").otherwise("WARNING"))
    return balance.review_audit(tx)


def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.strict_audit(relation(spark, sf_dir, "narrated"))


def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("validation_status")
    return _audited(spark, sf_dir).groupBy("stmt_id").agg(F.count_if(by == "WARNING").alias("warning_count"), F.count_if(by == "ERROR").alias("error_count"), F.count_if(by == "VALID").alias("valid_count"))


def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.job_status(w1_summary(spark, sf_dir), F.col("stmt_id") % 4 == 0)


def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.closing_check(w1_summary(spark, sf_dir))


QUERIES = {
    "W1_balance_audit_summary": w1_summary,
    "W1_balance_audit_rows": w1_rows,
    "W2_inverted_rows": w2,
    "W3_previous_balance": w3,
    "W4_chronology": w4,
    "W5_turned_statements": w5,
    "W6_opening_inference": w6,
    "W14_duplicate_suspects": w14,
    "W15_coarse_duplicates": w15,
    "W16_review_audit": w16,
    "W17_strict_audit": w17,
    "A2_status_counts": a2,
    "A3_job_status": a3,
    "A17_closing_check": a17,
}

#: The SQL of each query after the relation ``narrated``.
BODIES = {
    "W1_balance_audit_summary": (_SUMMARY + """
SELECT *, round(greatest(0.0, (n_rows - n_discrepancies) / n_rows::DOUBLE * 100.0 - n_errors / n_rows::DOUBLE * 20.0), 2) AS confidence_score FROM summed"""),
    "W1_balance_audit_rows": (_AUDIT + """
SELECT stmt_id, row_index, outcome, validation_status, CASE outcome WHEN 'MATCH' THEN 100.0 WHEN 'MINOR' THEN 80.0 WHEN 'MISMATCH' THEN 40.0 ELSE 90.0 END::DOUBLE AS confidence,
  CAST(previous_balance + credit - debit AS DECIMAL(15,2)) AS expected_balance FROM audited"""),
    "W2_inverted_rows": (_AUDIT + """
SELECT stmt_id, row_index, credit AS debit, debit AS credit, CASE WHEN credit > 0 THEN 'Payment' ELSE 'Receipt' END AS voucher_type FROM audited WHERE outcome = 'SWAPPED'"""),
    "W3_previous_balance": (_PREVIOUS + " SELECT stmt_id, row_index, previous_balance FROM previous"),
    "W4_chronology": (_SHUFFLED + " SELECT * FROM chrono"),
    "W5_turned_statements": (_SHUFFLED + """
, told AS (SELECT s.*, is_reversed FROM shuffled s JOIN chrono USING (stmt_id)),
ends AS (SELECT stmt_id, is_reversed, arg_min({'b': balance, 'd': debit, 'c': credit}, CASE WHEN is_reversed THEN -row_index ELSE row_index END) AS f, arg_max({'b': balance}, CASE WHEN is_reversed THEN -row_index ELSE row_index END) AS l FROM told GROUP BY ALL)
SELECT t.stmt_id, row_index, CAST(row_number() OVER (PARTITION BY t.stmt_id ORDER BY CASE WHEN t.is_reversed THEN -row_index ELSE row_index END) AS INT) AS new_index,
  CAST(CASE WHEN t.is_reversed AND f.b IS NOT NULL THEN CASE WHEN f.c > 0 THEN f.b - f.c WHEN f.d > 0 THEN f.b + f.d ELSE f.b END ELSE opening END AS DECIMAL(15,2)) AS new_opening, l.b AS last_balance
FROM told t JOIN ends e ON t.stmt_id = e.stmt_id"""),
    "W6_opening_inference": (_PREVIOUS + " SELECT stmt_id, opening_known FROM previous WHERE row_index = 1"),
    "W14_duplicate_suspects": (r"""
, doubled AS (SELECT stmt_id, row_index, tx_date, debit, credit, narration, reference FROM narrated UNION ALL SELECT stmt_id, row_index + 50000, tx_date, debit, credit, concat(' ', lower(narration)), reference FROM narrated WHERE k % 9 = 0),
keyed AS (SELECT *, upper(trim(regexp_replace(narration, '\s+', ' ', 'g'))) AS kn, upper(trim(coalesce(reference, ''))) AS kr FROM doubled),
placed AS (SELECT *, row_number() OVER w AS n, first_value(row_index) OVER w AS f FROM keyed WINDOW w AS (PARTITION BY stmt_id, tx_date, debit, credit, kn, kr ORDER BY row_index))
SELECT stmt_id, CAST(row_index AS INT) AS row_index, n > 1 AS is_duplicate_suspect, CAST(CASE WHEN n > 1 THEN f END AS INT) AS duplicate_of FROM placed"""),
    "W15_coarse_duplicates": ("""
, doubled AS (SELECT * FROM narrated UNION ALL SELECT * FROM narrated WHERE k % 9 = 0)
SELECT stmt_id, count(*) - count(DISTINCT (tx_date, debit, credit, substring(narration, 1, 30))) AS duplicate_count FROM doubled GROUP BY stmt_id"""),
    "W16_review_audit": ("""
, rows0 AS (SELECT *, k % 19 = 0 AS err FROM narrated),
rows1 AS (SELECT *, CASE WHEN err THEN 0 ELSE credit - debit END AS net, first_value(opening) OVER w AS start,
  coalesce(bool_or(err AND balance IS NOT NULL) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen
  FROM rows0 WINDOW w AS (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rows2 AS (SELECT *, start IS NOT NULL OR seen AS known, sum(net) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS moved FROM rows1),
rows3 AS (SELECT *, CASE WHEN known THEN moved - net + coalesce(last_value(CASE WHEN balance IS NOT NULL AND (err OR known) THEN balance - moved END IGNORE NULLS) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start) END AS before FROM rows2)
SELECT stmt_id, row_index, CAST(CASE WHEN NOT err AND balance IS NULL AND before IS NOT NULL THEN before + credit - debit ELSE balance END AS DECIMAL(15,2)) AS balance,
  CASE WHEN err THEN 'ERROR' WHEN before IS NULL THEN 'WARNING' WHEN balance IS NULL THEN 'VALID' WHEN abs(before + credit - debit - balance) <= 0.01 THEN 'VALID'
    WHEN abs(before + credit - debit - balance) <= 1.00 THEN 'WARNING' ELSE 'ERROR' END AS validation_status FROM rows3"""),
    "W17_strict_audit": (_PREVIOUS + """
SELECT stmt_id, row_index, CASE WHEN previous_balance + credit - debit <> balance THEN 'WARNING' ELSE 'VALID' END AS validation_status FROM previous"""),
    "A2_status_counts": (_AUDIT + """
SELECT stmt_id, count(*) FILTER (WHERE validation_status = 'WARNING') AS warning_count, count(*) FILTER (WHERE validation_status = 'ERROR') AS error_count, count(*) FILTER (WHERE validation_status = 'VALID') AS valid_count FROM audited GROUP BY stmt_id"""),
    "A3_job_status": (_SUMMARY + """
, flagged AS (SELECT *, n_errors > 0 OR (stmt_id % 4 <> 0 AND coalesce(opening_balance + total_credit - total_debit <> closing_balance, false)) AS mismatch FROM summed)
SELECT stmt_id, CASE WHEN mismatch THEN 'MISMATCH' ELSE 'VALID' END AS balance_status, CASE WHEN stmt_id % 4 = 0 THEN 'PARTIALLY_COMPLETED' WHEN mismatch THEN 'NEEDS_REVIEW' ELSE 'COMPLETED' END AS job_status, n_errors = 0 AS ready_for_export FROM flagged"""),
    "A17_closing_check": (_SUMMARY + """
SELECT stmt_id, CAST(opening_balance + total_credit - total_debit AS DECIMAL(25,2)) AS expected_closing, closing_balance, opening_balance + total_credit - total_debit <> closing_balance AS differs FROM summed"""),
}
ORACLES = {name: with_ctes("narrated", body) for name, body in BODIES.items()}

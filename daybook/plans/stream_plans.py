"""Registered queries that run as streams with state: what arrives in several deliveries, and what all verdicts are in the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.plans.audit_plans import ORACLES as AUDITS
from daybook.sources.fixtures import relation
from daybook.streaming import codes, continued, state


def delivered(spark: SparkSession, label: str, deliveries: list[DataFrame], schema: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each delivery is written, then the stream is started again from its checkpoint and runs to the end of it."""
    place = state.folders(spark, label)
    for rows in deliveries:
        rows.write.mode("append").parquet(place("in"))
        state.run_to_table(spark, make(spark.readStream.schema(schema).parquet(place("in"))), place("out"), place("state"))
    return spark.read.parquet(place("out"))


def by_time(events: DataFrame, parts: int = 3) -> list[DataFrame]:
    """The events in deliveries that follow one another in time."""
    second = F.unix_seconds("at")
    cuts = events.select(second.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], 0.01)
    edges = [None, *cuts, None]
    return [events.where((F.lit(a is None) | (second > F.lit(a))) & (F.lit(b is None) | (second <= F.lit(b)))) for a, b in zip(edges, edges[1:], strict=False)]


def code_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request for a code or an entry, in a hundredth of its time, so that a user's events lie within minutes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "REQUEST").otherwise("VERIFY")
    at = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 100))
    return e.select(
        F.concat(F.lit(" User"), F.col("user_id")).alias("destination"), at.alias("at"), "event_id", kind.alias("kind"), F.when((kind == "REQUEST") | (F.col("event_id") % 5 < 2), "123456").otherwise("000000").alias("code"),
        F.when(kind == "REQUEST", F.concat(F.lit("salt"), F.col("event_id"))).alias("salt"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as the beginning, use, refreshing or end of a session; tokens are numbers by which later events may find an earlier one's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    turn = F.col("event_id") % 4
    kind = F.when(turn == 0, "CREATE").when(turn == 1, "REFRESH").when(F.col("event_id") % 8 == 2, "REVOKE").otherwise("ACCESS")
    name = lambda what, n: F.concat_ws("-", F.lit(what), F.col("user_id"), n)
    # of a user's tokens there are three: those given at a number with the same rest
    slot = F.floor(F.col("event_id") / 4) % 3
    gives = kind.isin("CREATE", "REFRESH")
    return e.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("kind"), name("token", slot).alias("token"), name("refresh", slot).alias("refresh"),
        F.when(gives, name("token", slot)).alias("new_token"), F.when(gives, name("refresh", slot)).alias("new_refresh"),
    )


def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, "codes", by_time(code_events(spark, sf_dir)), codes.CODE_EVENTS, codes.code_stream)


def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered(spark, "sessions", by_time(session_events(spark, sf_dir)), codes.SESSION_EVENTS, codes.session_stream)


def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose pages come in three deliveries."""
    tx = relation(spark, sf_dir, "narrated")
    page = F.col("source_page")
    names = [x.split()[0] for x in continued.ROWS.split(", ")]
    pages = [tx.where(cond).select(*names) for cond in (page <= 1, page == 2, page > 2)]
    return delivered(spark, "pages", pages, continued.ROWS, continued.continued_audit).select("stmt_id", "row_index", "outcome", "validation_status", "confidence", "expected_balance")


QUERIES = {"T5_codes": t5, "T6_sessions": t6, "T8_continued_audit": t8}
#: The verdicts on codes and sessions are folds, which tests compare with plain ones; the audit has that of whole statements.
ORACLES = {"T8_continued_audit": AUDITS["W1_balance_audit_rows"]}

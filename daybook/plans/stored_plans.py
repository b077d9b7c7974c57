"""Registered queries on stored tables: written, merged and read again, with the SQL of what must be there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import usage
from daybook.sources.fixtures import relation, with_ctes
from daybook.sources.versioned import VersionedTable
from daybook.storage import run_folder

#: As in a store of conversions: who asked for it and when stays, how far it came is replaced.
CONVERSION_RULES = {"user_id": "keep", "user_email": "keep", "bank_name": "keep", "page_count": "keep", "created_at": "keep", "free_quota_used": "add"}


def _new_table(spark: SparkSession, like: DataFrame, keys: tuple[str, ...], buckets: int = 16) -> VersionedTable:
    return VersionedTable.create(spark, f"{run_folder(spark)}/stored-{uuid.uuid4().hex}", like.schema, keys, buckets)


def k7_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages a day: those of single conversions stored first, the pages of every job added; the second write is repeated and counts once."""
    jobs = relation(spark, sf_dir, "jobs")
    daily = usage.daily_usage(jobs)
    first = daily.where("conversions = 1").select("user_id", "day", F.col("pages_used").cast("long").alias("pages"))
    changes = jobs.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum("page_count").cast("long").alias("pages"))
    table = _new_table(spark, first, ("user_id", "day"))
    table.upsert(first)
    for _ in range(2):
        table.upsert(changes, {"pages": "add"}, txn=("jobs", 1))
    return table.read()


def k7_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions stored when they begin, and again when they are done, with some fields kept; those of later users come with the second write."""
    jobs = relation(spark, sf_dir, "jobs").drop("is_ambiguous")
    begun = jobs.where("id % 3 <> 0").withColumn("status", F.lit("PROCESSING")).withColumn("pages_processed", F.lit(0))
    done = jobs.where("id % 4 <> 0").withColumn("user_id", F.lit("nobody")).withColumn("bank_name", F.lit("?"))
    table = _new_table(spark, begun, ("id",))
    table.upsert(begun)
    table.upsert(done, CONVERSION_RULES)
    return table.read()


def k7_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier version is read after a later one was written."""
    users = relation(spark, sf_dir, "users").select("id", "full_name", "registered")
    table = _new_table(spark, users, ("id",))
    first = table.upsert(users)
    table.upsert(users.where("registered % 2 = 0").withColumn("full_name", F.lit("renamed")))
    now = table.read().select("id", F.col("full_name").alias("name_now"))
    return table.read(first).join(now, "id").select("id", "full_name", "name_now")


QUERIES = {"K7_stored_usage": k7_usage, "K7_stored_conversions": k7_conversions, "K7_stored_as_of": k7_as_of}

_BEGUN = "id % 3 <> 0"
ORACLES = {
    "K7_stored_usage": with_ctes("jobs", """
, daily AS (SELECT user_id, CAST(created_at + INTERVAL 330 MINUTE AS DATE) AS day, sum(CASE WHEN status NOT IN ('FAILED', 'QUOTA_EXHAUSTED') THEN coalesce(free_quota_used, pages_processed, page_count, 0) ELSE 0 END) AS pages, count(*) AS n FROM jobs GROUP BY 1, 2),
b AS (SELECT user_id, day, pages FROM daily WHERE n = 1 UNION ALL SELECT user_id, CAST(created_at AS DATE), page_count FROM jobs) SELECT user_id, day, CAST(sum(pages) AS BIGINT) AS pages FROM b GROUP BY 1, 2"""),
    "K7_stored_conversions": with_ctes("jobs", f"""
, e AS (SELECT *, {_BEGUN} AS a, id % 4 <> 0 AS b FROM jobs)
SELECT id, CASE WHEN a THEN user_id ELSE 'nobody' END AS user_id, user_email, CASE WHEN a THEN bank_name ELSE '?' END AS bank_name, CASE WHEN b THEN status ELSE 'PROCESSING' END AS status, page_count, CAST(CASE WHEN b THEN pages_processed ELSE 0 END AS INT) AS pages_processed,
  CAST(CASE WHEN a AND b THEN 2 * coalesce(free_quota_used, 0) ELSE free_quota_used END AS INT) AS free_quota_used, created_at FROM e WHERE a OR b"""),
    "K7_stored_as_of": with_ctes("users", " SELECT id, full_name, CASE WHEN registered % 2 = 0 THEN 'renamed' ELSE full_name END AS name_now FROM users"),
}

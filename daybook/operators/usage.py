"""Quotas, usage, admin summaries and merged listings over conversion jobs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.scalars import business_day

DONE = ("COMPLETED", "PARTIALLY_COMPLETED")
ACTIVE = ("COMPLETED", "NEEDS_REVIEW", "PARTIALLY_COMPLETED")
UNCOUNTED = ("FAILED", "QUOTA_EXHAUSTED")


def user_stats(jobs: DataFrame) -> DataFrame:
    """Conversions of each user: all, done, failed, pages, the last one's time."""
    status = F.col("status")
    return jobs.groupBy(F.lower("user_id").alias("user_id")).agg(
        F.count(F.lit(1)).alias("total_conversions"), F.count_if(status.isin(*DONE)).alias("successful_conversions"), F.count_if(status == "FAILED").alias("failed_conversions"),
        F.sum(F.when(status.isin(*ACTIVE), F.coalesce("pages_processed", F.lit(0))).otherwise(0)).alias("total_pages_processed"), F.max("created_at").alias("last_conversion_at"),
    )


def metrics(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """One row of counts over all users and jobs."""
    status = F.col("status")
    j = jobs.agg(
        F.count(F.lit(1)).alias("total_conversions"), F.sum("page_count").alias("total_pages"), F.count_if(status == "COMPLETED").alias("successful"), F.count_if(status == "NEEDS_REVIEW").alias("needs_review"),
        F.count_if(F.col("is_ambiguous") | (status == "AMBIGUOUS_BANK")).alias("ambiguous"), F.count_if(status == "FAILED").alias("failed"),
    )
    state = F.coalesce("account_status", F.lit("ACTIVE"))
    u = users.agg(
        F.count(F.lit(1)).alias("total_users"), F.count_if(F.col("is_unlimited") | F.col("role").isin("ADMIN", "SUPER_ADMIN")).alias("unlimited_users"),
        F.count_if(state == "ACTIVE").alias("active_users"), F.count_if(state.isin("SUSPENDED", "BLOCKED", "DEACTIVATED")).alias("suspended_users"),
    )
    return j.crossJoin(u)  # one row each


def pages_by_bank(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("bank_name").agg(F.sum("page_count").alias("pages"))


def popular_banks(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The banks with most jobs; on equal counts the one seen first."""
    counted = jobs.groupBy("bank_name").agg(F.count(F.lit(1)).alias("jobs"), F.min("id").alias("first_seen"))
    return counted.orderBy(F.desc("jobs"), "first_seen").limit(n).select("bank_name", "jobs")


def success_rate(jobs: DataFrame) -> DataFrame:
    """Percent of done jobs, 100 if there are none."""
    n = F.count(F.lit(1))
    return jobs.agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("status").isin(*DONE)) * 100.0, n), 1), F.lit(100.0)).alias("success_rate"))


def parser_health(parsers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per parser's bank the jobs, the done and the ambiguous ones; parsers without jobs stay."""
    counts = jobs.groupBy("bank_name").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count_if("is_ambiguous").alias("ambiguous"))
    filled = parsers.join(counts, "bank_name", "left")
    return filled.select("bank_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("jobs", "done", "ambiguous")])


def daily_usage(jobs: DataFrame) -> DataFrame:
    """Pages of each user and business day: the free ones used, else processed, else all of the file; by status."""
    pages = F.coalesce("free_quota_used", "pages_processed", "page_count", F.lit(0))
    part = lambda cond: F.sum(F.when(cond, pages).otherwise(0))
    status = F.col("status")
    return jobs.groupBy("user_id", business_day(F.col("created_at")).alias("day")).agg(
        part(~status.isin(*UNCOUNTED)).alias("pages_used"), part(status.isin(*DONE)).alias("completed_pages"), part(status == "NEEDS_REVIEW").alias("needs_review_pages"), F.count(F.lit(1)).alias("conversions")
    )


def reconciled_usage(usage: DataFrame, recorded: DataFrame, limit: Column) -> DataFrame:
    """The larger of counted and recorded pages, and what is left of the limit."""
    both = usage.join(recorded.withColumnRenamed("pages_used", "recorded"), ["user_id", "day"], "full_outer")
    used = F.greatest(F.coalesce("pages_used", F.lit(0)), F.coalesce("recorded", F.lit(0)))
    return both.select("user_id", "day", used.alias("pages_used"), F.greatest(limit - used, F.lit(0)).alias("pages_left"))


def unread_counts(**categories: DataFrame) -> DataFrame:
    """(category, n) of each source's rows."""
    out = None
    for name, rows in categories.items():
        one = rows.agg(F.lit(name).alias("category"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def payment_dashboard(payments: DataFrame) -> DataFrame:
    """Counts by status, pages granted and money taken of approved requests."""
    s = F.col("status")
    return payments.agg(
        F.count_if(s == "PENDING").alias("pending"), F.count_if(s == "APPROVED").alias("approved"), F.count_if(s == "REJECTED").alias("rejected"),
        F.sum(F.when(s == "APPROVED", F.col("amount_paid"))).cast("decimal(25,2)").alias("revenue"), F.coalesce(F.sum(F.when(s == "APPROVED", F.col("granted_pages"))), F.lit(0)).alias("pages_granted"),
    )


def dossier(users: DataFrame, jobs: DataFrame) -> DataFrame:
    """Users with their conversion counts and limits."""
    stats = user_stats(jobs).withColumnRenamed("user_id", "uid")
    return users.join(stats, F.lower("id") == F.col("uid"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_conversions", "successful_conversions", "failed_conversions", "total_pages_processed")], daily_limit().alias("daily_limit"))


def daily_limit(default: int = 50, unlimited: int = 999999) -> Column:
    """Unlimited users and admins, then a quota of one's own, then the common one."""
    return F.when(F.col("is_unlimited") | F.col("role").isin("ADMIN", "SUPER_ADMIN"), unlimited).otherwise(F.coalesce("custom_quota", F.lit(default)))


def allocation(pages: Column, free: Column, bought: Column) -> Column:
    """struct(processed, skipped, free_used, bought_used): free pages first, then bought ones."""
    processed = F.least(pages, free + bought)
    free_used = F.least(processed, free)
    return F.struct(processed.alias("processed"), F.greatest(pages - processed, F.lit(0)).alias("skipped"), free_used.alias("free_used"), F.least(processed - free_used, bought).alias("bought_used"))


def page_states(pages: Column, processed: Column) -> Column:
    """Map from page number to PROCESSED or PENDING."""
    numbers = F.sequence(F.lit(1), F.greatest(pages, F.lit(1)))
    return F.map_from_arrays(F.transform(numbers, lambda i: i.cast("string")), F.transform(numbers, lambda i: F.when(i <= processed, "PROCESSED").otherwise("PENDING")))


def credit_ledger(events: DataFrame) -> DataFrame:
    """Credits in order with the balance before and after each."""
    w = Window.partitionBy("user_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum("pages").over(w)
    return events.select("user_id", "id", "pages", (after - F.col("pages")).alias("previous_balance"), after.alias("new_balance"))


def trailing_counts(events: DataFrame, seconds: int = 600) -> DataFrame:
    """How many events of a user lie in the trailing span before each, itself included."""
    w = Window.partitionBy("user_id").orderBy(F.col("second")).rangeBetween(-seconds, 0)
    return events.withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp"))).select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("in_span"))


def admitted(events: DataFrame, seconds: int = 600, most: int = 3, cooldown: int = 60) -> DataFrame:
    """Whether each request is let through: fewer than ``most`` admitted ones in the ``seconds`` before it, the last of them at least ``cooldown`` ago.

    Times count in whole seconds, fractions dropped, as in ``trailing_counts``.
    Refused requests are not counted, so each verdict depends on those before
    it. A pause of ``seconds`` forgets them all, so a user's requests fall into
    independent sessions: these are spread over tasks, and each is read in order
    holding no more than ``most`` times.
    """
    w = Window.partitionBy("user_id").orderBy("second", "event_id")
    timed = events.select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    begins = (F.col("second") - F.lag("second").over(w) >= seconds).cast("int")
    sessions = timed.withColumn("session", F.sum(F.coalesce(begins, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = sessions.repartition("user_id", "session").sortWithinPartitions("user_id", "session", "second", "event_id")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, []
        for pdf in batches:
            out = []
            for user, session, second in zip(pdf["user_id"], pdf["session"], pdf["second"], strict=True):
                if (user, session) != last:
                    last, times = (user, session), []
                times = [t for t in times if second - t < seconds]
                yes = len(times) < most and not (times and second - times[-1] < cooldown)
                if yes:
                    times.append(second)
                out.append(yes)
            yield pdf[["user_id", "event_id"]].assign(is_admitted=out)

    return dealt.mapInPandas(judge, "user_id long, event_id long, is_admitted boolean")


def transitioned(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Requests after status changes. ``changes``: id, status, granted (null: as before), notes, by, at; of several for one request the last counts.

    An approval notes when it was given; other changes keep the earlier time.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("status", "granted", "notes", "by", "at"), "at").alias("new"))
    new, changed = lambda c: F.col(f"new.{c}"), F.col("new").isNotNull()
    out = {
        "status": F.coalesce(new("status"), F.col("status")),
        "granted": F.coalesce(new("granted"), F.col("granted")),
        "notes": F.when(changed, new("notes")).otherwise(F.col("notes")),
        "approved_by": F.when(changed, new("by")).otherwise(F.col("approved_by")),
        "approved_at": F.when(new("status") == "APPROVED", new("at")).otherwise(F.col("approved_at")),
        "updated_at": F.coalesce(new("at"), F.col("updated_at")),
    }
    return requests.join(last, "id", "left").select(*[out.get(c, F.col(c)).alias(c) for c in requests.columns])


def latest_active(jobs: DataFrame) -> DataFrame:
    """Each user's newest job in an active status; of equal times the one with the larger id."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.where(F.col("status").isin(*ACTIVE)).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def appended(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the first store and those of the second whose key it does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def overridden(stored: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both stores; values of the fresh one count where they are not null."""
    other = fresh.select(*[F.col(c).alias(f"fresh_{c}") for c in fresh.columns])
    both = stored.join(other, F.col(key) == F.col(f"fresh_{key}"), "full_outer")
    return both.select(*[F.coalesce(F.col(f"fresh_{c}"), F.col(c)).alias(c) if c in fresh.columns else F.col(c) for c in stored.columns])


def upserted(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], value: str, add: bool = True) -> DataFrame:
    """The table after a merge of changes: values added up, or replaced."""
    new = changes.groupBy(*keys).agg(F.sum(value).alias("change"))
    both = table.join(new, list(keys), "full_outer")
    merged = F.coalesce(value, F.lit(0)) + F.coalesce("change", F.lit(0)) if add else F.coalesce("change", value)
    return both.select(*keys, merged.alias(value))


def search_users(users: DataFrame, text: str) -> DataFrame:
    """Users with the text in one of five fields."""
    t = text.strip().lower()
    hit = F.lit(False)
    for c in ("email", "full_name", "username", "id", "mobile_number"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(t)
    return users.where(hit)


def search_merged_users(stored: DataFrame, fresh: DataFrame, text: str) -> DataFrame:
    """The text filters stored rows over five fields first, then all rows over six: a hit in the status alone finds only fresh rows."""
    t = text.strip().lower()
    rows = appended(search_users(stored, text), fresh)
    hit = F.lit(False)
    for c in ("email", "full_name", "username", "id", "mobile_number", "account_status"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(t)
    return rows.where(hit)


def filter_jobs(jobs: DataFrame, bank: str = "", status: str = "ALL") -> DataFrame:
    """Jobs whose bank holds the text, of a status; AMBIGUOUS also finds flagged ones."""
    ok = F.lower("bank_name").contains(bank.lower())
    if status == "AMBIGUOUS":
        ok = ok & (F.col("is_ambiguous") | (F.col("status") == "AMBIGUOUS_BANK"))
    elif status != "ALL":
        ok = ok & (F.col("status") == status)
    return jobs.where(ok)


def visible(rows: DataFrame, users: DataFrame, viewer: str) -> DataFrame:
    """Rows of the viewer, or all if the viewer is an admin."""
    who = users.where((F.col("id") == viewer)).select(F.col("id").alias("viewer_id"), F.col("role").isin("ADMIN", "SUPER_ADMIN").alias("sees_all"))
    return rows.join(F.broadcast(who), (F.col("user_id") == F.col("viewer_id")) | F.col("sees_all"), "left_semi")  # one row


def feed(**sources: DataFrame) -> DataFrame:
    """(source, id, at) of all sources, newest first."""
    out = None
    for name, rows in sources.items():
        one = rows.select(F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), F.col("at"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("at"), "source", "id")


def selected(rows: DataFrame, equal: dict | None = None, any_equal: list[dict] | None = None, order: tuple[tuple[str, bool], ...] = (), limit: int | None = None) -> DataFrame:
    """Rows whose fields equal ``equal`` and at least one of ``any_equal``, ordered by (field, descending), the first ``limit`` of them.

    The conditions are plain comparisons, so they reach the reader of the rows;
    with a limit only so many rows a task are kept and merged.
    """
    told = [F.col(c) == v for c, v in (equal or {}).items()]
    if any_equal:
        told.append(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in x.items()]) for x in any_equal]))
    for cond in told:
        rows = rows.where(cond)
    ordered = rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]) if order else rows
    return ordered if limit is None else ordered.limit(limit)


def newest(rows: DataFrame, n: int, by: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def daily_trends(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(business_day(F.col("created_at")).alias("day")).agg(F.count(F.lit(1)).alias("conversions"), F.sum("page_count").alias("pages"))

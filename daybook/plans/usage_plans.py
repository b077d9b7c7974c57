"""Registered queries on quotas, usage and admin listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import usage
from daybook.sources.fixtures import relation, with_ctes


def _jobs(spark, sf_dir):
    return relation(spark, sf_dir, "jobs")


def _users(spark, sf_dir):
    return relation(spark, sf_dir, "users")


def _fresh(users: DataFrame) -> DataFrame:
    """A second store: every fifth user again with a new name, and as many new ones."""
    cols = users.columns
    again = users.where("registered % 5 = 0").withColumn("full_name", F.when(F.col("registered") % 10 == 0, F.concat(F.lit("New "), F.col("full_name"))))
    new = users.where("registered % 5 = 1").withColumn("id", F.concat(F.lit("New-"), F.col("registered")))
    return again.unionByName(new).select(*cols)


_FRESH = """
, fresh AS (SELECT * REPLACE (CASE WHEN registered % 10 = 0 THEN concat('New ', full_name) END AS full_name) FROM users WHERE registered % 5 = 0 UNION ALL SELECT * REPLACE (concat('New-', registered) AS id) FROM users WHERE registered % 5 = 1)"""


def _recorded(jobs: DataFrame) -> DataFrame:
    return usage.daily_usage(jobs).where("conversions % 2 = 0").select("user_id", "day", (F.col("pages_used") + 3).alias("pages_used"))


def t1(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    a = usage.allocation(F.col("page_count"), (F.col("id") % 15).cast("int"), (F.col("id") % 7).cast("int"))
    return j.select("id", a.alias("a")).select("id", "a.*", (F.col("a.skipped") * 2.0).alias("price"))


def t3(spark, sf_dir):
    return _users(spark, sf_dir).select("id", usage.daily_limit().alias("daily_limit"))


def t9(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    states = usage.page_states(F.col("page_count"), F.coalesce("pages_processed", F.lit(0)))
    return j.select("id", F.explode(states).alias("page", "state")).groupBy("id", "state").agg(F.count(F.lit(1)).alias("pages"), F.max(F.col("page").cast("int")).alias("last_page"))


def t10(spark, sf_dir):
    events = _jobs(spark, sf_dir).select("user_id", "id", F.col("page_count").alias("pages"))
    return usage.credit_ledger(events)


def t4_count(spark, sf_dir):
    return usage.trailing_counts(_jobs(spark, sf_dir).select("user_id", F.col("id").alias("event_id"), F.col("created_at").alias("ts")), 86400)


def w19(spark, sf_dir):
    return usage.latest_active(_jobs(spark, sf_dir)).select("user_id", "id", "status")


def a10(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return usage.reconciled_usage(usage.daily_usage(j), _recorded(j), F.lit(50))


def a12(spark, sf_dir):
    t = relation(spark, sf_dir, "tx")
    p = t.select(F.when(F.col("k") % 3 == 0, "PENDING").when(F.col("k") % 3 == 1, "APPROVED").otherwise("REJECTED").alias("status"), (F.col("debit") + F.col("credit")).alias("amount_paid"), F.floor((F.col("debit") + F.col("credit")) / 2).alias("granted_pages"))
    return usage.payment_dashboard(p)


def j14(spark, sf_dir):
    u = _users(spark, sf_dir)
    access = u.where("registered % 3 = 0").select(F.col("email").alias("a_email"), F.col("account_status").alias("access"))
    return u.join(access, F.lower("email") == F.lower("a_email"), "left").select("id", F.coalesce("access", F.lit("NONE")).alias("access"))


def j15(spark, sf_dir):
    t, j = relation(spark, sf_dir, "tx"), _jobs(spark, sf_dir).where("status = 'COMPLETED'")
    return t.join(j, t["k"] == j["id"], "left_semi").select("stmt_id", "row_index")


def j16(spark, sf_dir):
    u = _users(spark, sf_dir)
    return usage.appended(u, _fresh(u)).select("id", F.col("id").startswith("New-").alias("is_new"))


def j17(spark, sf_dir):
    u = _users(spark, sf_dir)
    return usage.overridden(u, _fresh(u)).select("id", "full_name", "account_status")


def j19(spark, sf_dir):
    u = _users(spark, sf_dir)
    appeals = _jobs(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, F.lit("gone")).otherwise(F.col("user_id")).alias("user_id"), "user_email")
    by_id = u.where("account_status <> 'ACTIVE'").select(F.col("id").alias("uid"), F.col("account_status").alias("by_id"))
    by_email = u.where("account_status <> 'ACTIVE'").select(F.col("email").alias("mail"), F.col("account_status").alias("by_email"))
    both = appeals.join(by_id, F.col("user_id") == F.col("uid"), "left").join(by_email, F.lower("user_email") == F.lower("mail"), "left")
    return both.select("id", F.coalesce("by_id", "by_email").alias("suspension"))


def p6(spark, sf_dir):
    return usage.search_users(_users(spark, sf_dir), " 12 ").select("id")


def p7(spark, sf_dir):
    u = _users(spark, sf_dir)
    return usage.search_merged_users(u, _fresh(u), "SUSP").select("id", "account_status")


def p8(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return j.where((F.col("status") == "NEEDS_REVIEW") & F.lower("user_email").contains("user1")).select("id").orderBy(F.desc("id"))


def p9(spark, sf_dir):
    u = _users(spark, sf_dir)
    return u.where((F.lower("id") == "user-7") | (F.lower("email") == "user9@mail.example")).select("id")


def p10(spark, sf_dir):
    return usage.filter_jobs(_jobs(spark, sf_dir), "bank 1", "AMBIGUOUS").select("id")


def p13(spark, sf_dir):
    j, u = _jobs(spark, sf_dir), _users(spark, sf_dir)
    own = usage.visible(j, u, "User-7").select("id", F.lit("own").alias("seen_by"))
    return own.union(usage.visible(j, u, "User-50").select("id", F.lit("admin")))


def p2(spark, sf_dir):
    from daybook.operators.segment import authorized

    t = relation(spark, sf_dir, "tx").withColumn("source_page", F.when(F.col("k") % 10 == 0, F.lit(None)).otherwise(F.col("source_page")))
    return authorized(t, 1).select("stmt_id", "row_index")


def a11(spark, sf_dir):
    j, u = _jobs(spark, sf_dir), _users(spark, sf_dir)
    return usage.unread_counts(payments=j.where("id % 11 = 0"), appeals=u.where("account_status = 'BLOCKED'"), users=u.where("registered % 100 = 0"), conversions=j.where("status = 'NEEDS_REVIEW'"), recovery=u.where("account_status = 'NOBODY'"))


def feed(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    return usage.feed(conversions=j.where("status = 'FAILED'").select("id", F.col("created_at").alias("at")), reviews=j.where("status = 'NEEDS_REVIEW'").select("id", F.col("created_at").alias("at")))


def filtered(spark, sf_dir):
    """A status, one of two customers or priorities, newest first: read from the stored rows."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = usage.selected(rows, {"o_orderstatus": "F"}, [{"o_orderpriority": "1-URGENT"}, {"o_custkey": 7}], (("o_orderdate", True), ("o_orderkey", False)))
    return found.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


def newest(spark, sf_dir):
    return usage.newest(_jobs(spark, sf_dir), 10).select("id", "created_at")


def k7(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    d = usage.daily_usage(j).select("user_id", "day", F.col("pages_used").cast("long").alias("pages"))
    return usage.upserted(d.where("conversions = 1"), j.select("user_id", F.to_date("created_at").alias("day"), F.col("page_count").cast("long").alias("pages")), ("user_id", "day"), "pages")


QUERIES = {
    "T1_quota_allocation": t1, "T3_daily_limit": t3, "T9_page_states": t9, "T10_credit_ledger": t10, "T4_trailing_counts": t4_count, "W19_latest_active": w19,
    "A4_user_stats": lambda s, d: usage.user_stats(_jobs(s, d)), "A5_metrics": lambda s, d: usage.metrics(_jobs(s, d), _users(s, d)), "A6_pages_by_bank": lambda s, d: usage.pages_by_bank(_jobs(s, d)),
    "A7_popular_banks": lambda s, d: usage.popular_banks(_jobs(s, d)), "A8_success_rate": lambda s, d: usage.success_rate(_jobs(s, d)),
    "A9_parser_health": lambda s, d: usage.parser_health(s.range(15).select(F.concat(F.lit("Bank "), F.col("id")).alias("bank_name")), _jobs(s, d)),
    "T2_daily_usage": lambda s, d: usage.daily_usage(_jobs(s, d)), "A10_usage_reconciled": a10, "A11_unread_counts": a11, "A12_payments": a12, "A14_dossier": lambda s, d: usage.dossier(_users(s, d), _jobs(s, d)),
    "A_daily_trends": lambda s, d: usage.daily_trends(_jobs(s, d)), "J14_left_access": j14, "J15_semi": j15, "J16_appended": j16, "J17_overridden": j17, "J19_appeals": j19, "P2_authorized_pages": p2, "P6_user_search": p6,
    "P7_second_filter": p7, "P8_appeals_filter": p8, "P9_lookup": p9, "P10_job_filter": p10, "P13_visibility": p13, "S12_feed": feed, "S12_filtered_rows": filtered, "S11_newest": newest, "K7_upsert": k7,
}

_P = "coalesce(free_quota_used, pages_processed, page_count, 0)"
_DAY = "CAST(created_at + INTERVAL 330 MINUTE AS DATE)"
_DAILY = f"""
, daily AS (SELECT user_id, {_DAY} AS day, CAST(sum(CASE WHEN status NOT IN ('FAILED', 'QUOTA_EXHAUSTED') THEN {_P} ELSE 0 END) AS BIGINT) AS pages_used, CAST(sum(CASE WHEN status IN ('COMPLETED', 'PARTIALLY_COMPLETED') THEN {_P} ELSE 0 END) AS BIGINT) AS completed_pages,
  CAST(sum(CASE WHEN status = 'NEEDS_REVIEW' THEN {_P} ELSE 0 END) AS BIGINT) AS needs_review_pages, count(*) AS conversions FROM jobs GROUP BY 1, 2)"""
_STATS = """
, stats AS (SELECT lower(user_id) AS user_id, count(*) AS total_conversions, count(*) FILTER (WHERE status IN ('COMPLETED', 'PARTIALLY_COMPLETED')) AS successful_conversions, count(*) FILTER (WHERE status = 'FAILED') AS failed_conversions,
  CAST(sum(CASE WHEN status IN ('COMPLETED', 'PARTIALLY_COMPLETED', 'NEEDS_REVIEW') THEN coalesce(pages_processed, 0) ELSE 0 END) AS BIGINT) AS total_pages_processed, max(created_at) AS last_conversion_at FROM jobs GROUP BY 1)"""
_LIMIT = "CAST(CASE WHEN is_unlimited OR role = 'ADMIN' THEN 999999 ELSE coalesce(custom_quota, 50) END AS INT) AS daily_limit"
_JU = ("jobs", "users")

ORACLES = {
    "T1_quota_allocation": with_ctes("jobs", """
, a AS (SELECT id, page_count AS p, CAST(id % 15 AS INT) AS f, CAST(id % 7 AS INT) AS b FROM jobs), c AS (SELECT *, least(p, f + b) AS processed FROM a)
SELECT id, processed, p - processed AS skipped, least(processed, f) AS free_used, least(processed - least(processed, f), b) AS bought_used, (p - processed) * 2.0::DOUBLE AS price FROM c"""),
    "T3_daily_limit": with_ctes("users", f" SELECT id, {_LIMIT} FROM users"),
    "T9_page_states": with_ctes("jobs", """
, n AS (SELECT id, unnest(range(1, page_count + 1)) AS page, coalesce(pages_processed, 0) AS d FROM jobs) SELECT id, CASE WHEN page <= d THEN 'PROCESSED' ELSE 'PENDING' END AS state, count(*) AS pages, CAST(max(page) AS INT) AS last_page FROM n GROUP BY 1, 2"""),
    "T10_credit_ledger": with_ctes("jobs", """
, e AS (SELECT user_id, id, page_count AS pages, CAST(sum(page_count) OVER (PARTITION BY user_id ORDER BY id) AS BIGINT) AS new_balance FROM jobs) SELECT user_id, id, pages, new_balance - pages AS previous_balance, new_balance FROM e"""),
    "T4_trailing_counts": with_ctes("jobs", """
, e AS (SELECT user_id, id, CAST(floor(epoch(created_at)) AS BIGINT) AS s FROM jobs) SELECT user_id, id AS event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_span FROM e"""),
    "W19_latest_active": with_ctes("jobs", """
 SELECT user_id, id, status FROM jobs WHERE status IN ('COMPLETED', 'NEEDS_REVIEW', 'PARTIALLY_COMPLETED') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1"""),
    "A4_user_stats": with_ctes("jobs", _STATS + " SELECT * FROM stats"),
    "A5_metrics": with_ctes(_JU, """
 SELECT * FROM (SELECT count(*) AS total_conversions, CAST(sum(page_count) AS BIGINT) AS total_pages, count(*) FILTER (WHERE status = 'COMPLETED') AS successful, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE is_ambiguous OR status = 'AMBIGUOUS_BANK') AS ambiguous,
  count(*) FILTER (WHERE status = 'FAILED') AS failed FROM jobs), (SELECT count(*) AS total_users, count(*) FILTER (WHERE is_unlimited OR role = 'ADMIN') AS unlimited_users, count(*) FILTER (WHERE account_status = 'ACTIVE') AS active_users, count(*) FILTER (WHERE account_status <> 'ACTIVE') AS suspended_users FROM users)"""),
    "A6_pages_by_bank": with_ctes("jobs", " SELECT bank_name, CAST(sum(page_count) AS BIGINT) AS pages FROM jobs GROUP BY bank_name"),
    "A7_popular_banks": with_ctes("jobs", " SELECT bank_name, count(*) AS jobs FROM jobs GROUP BY bank_name ORDER BY count(*) DESC, min(id) LIMIT 5"),
    "A8_success_rate": with_ctes("jobs", " SELECT coalesce(round(100.0::DOUBLE * count(*) FILTER (WHERE status IN ('COMPLETED', 'PARTIALLY_COMPLETED')) / nullif(count(*), 0), 1), 100.0) AS success_rate FROM jobs"),
    "A9_parser_health": with_ctes("jobs", """
, b AS (SELECT concat('Bank ', r) AS bank_name FROM range(15) AS t(r)) SELECT b.bank_name, count(j.id) AS jobs, count(*) FILTER (WHERE status IN ('COMPLETED', 'PARTIALLY_COMPLETED')) AS done, count(*) FILTER (WHERE is_ambiguous) AS ambiguous FROM b LEFT JOIN jobs j ON b.bank_name = j.bank_name GROUP BY 1"""),
    "T2_daily_usage": with_ctes("jobs", _DAILY + " SELECT * FROM daily"),
    "A10_usage_reconciled": with_ctes("jobs", _DAILY + """
 SELECT user_id, day, pages_used + CASE WHEN conversions % 2 = 0 THEN 3 ELSE 0 END AS pages_used, greatest(50 - pages_used - CASE WHEN conversions % 2 = 0 THEN 3 ELSE 0 END, 0) AS pages_left FROM daily"""),
    "A11_unread_counts": with_ctes(_JU, """
 SELECT 'payments' AS category, count(*) AS n FROM jobs WHERE id % 11 = 0 UNION ALL SELECT 'appeals', count(*) FROM users WHERE account_status = 'BLOCKED' UNION ALL SELECT 'users', count(*) FROM users WHERE registered % 100 = 0 UNION ALL SELECT 'conversions', count(*) FROM jobs WHERE status = 'NEEDS_REVIEW' UNION ALL SELECT 'recovery', 0"""),
    "A12_payments": with_ctes("tx", """
 SELECT count(*) FILTER (WHERE k % 3 = 0) AS pending, count(*) FILTER (WHERE k % 3 = 1) AS approved, count(*) FILTER (WHERE k % 3 = 2) AS rejected, CAST(sum(debit + credit) FILTER (WHERE k % 3 = 1) AS DECIMAL(25,2)) AS revenue, CAST(sum(floor((debit + credit) / 2)) FILTER (WHERE k % 3 = 1) AS BIGINT) AS pages_granted FROM tx"""),
    "A14_dossier": with_ctes(_JU, _STATS + f"""
 SELECT id, coalesce(total_conversions, 0) AS total_conversions, coalesce(successful_conversions, 0) AS successful_conversions, coalesce(failed_conversions, 0) AS failed_conversions, coalesce(total_pages_processed, 0) AS total_pages_processed, {_LIMIT} FROM users LEFT JOIN stats ON lower(id) = user_id"""),
    "A_daily_trends": with_ctes("jobs", f" SELECT {_DAY} AS day, count(*) AS conversions, CAST(sum(page_count) AS BIGINT) AS pages FROM jobs GROUP BY 1"),
    "J14_left_access": with_ctes("users", " SELECT id, CASE WHEN registered % 3 = 0 THEN account_status ELSE 'NONE' END AS access FROM users"),
    "J15_semi": with_ctes(("tx", "jobs"), " SELECT stmt_id, row_index FROM tx WHERE EXISTS (SELECT 1 FROM jobs WHERE id = k AND status = 'COMPLETED')"),
    "J16_appended": with_ctes("users", " SELECT id, false AS is_new FROM users UNION ALL SELECT concat('New-', registered), true FROM users WHERE registered % 5 = 1"),
    "J17_overridden": with_ctes("users", _FRESH + " SELECT coalesce(f.id, u.id) AS id, coalesce(f.full_name, u.full_name) AS full_name, coalesce(f.account_status, u.account_status) AS account_status FROM users u FULL OUTER JOIN fresh f ON u.id = f.id"),
    "J19_appeals": with_ctes(_JU, """
, a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'gone' ELSE user_id END AS user_id, user_email FROM jobs), s AS (SELECT * FROM users WHERE account_status <> 'ACTIVE')
SELECT a.id, coalesce(x.account_status, y.account_status) AS suspension FROM a LEFT JOIN s x ON a.user_id = x.id LEFT JOIN s y ON lower(a.user_email) = lower(y.email)"""),
    "P2_authorized_pages": with_ctes("tx", " SELECT stmt_id, row_index FROM tx WHERE k % 10 = 0 OR source_page <= 1"),
    "P6_user_search": with_ctes("users", " SELECT id FROM users WHERE lower(email) LIKE '%12%' OR lower(coalesce(full_name, '')) LIKE '%12%' OR lower(coalesce(username, '')) LIKE '%12%' OR lower(id) LIKE '%12%' OR lower(coalesce(mobile_number, '')) LIKE '%12%'"),
    "P7_second_filter": with_ctes("users", _FRESH + " SELECT id, account_status FROM fresh WHERE account_status = 'SUSPENDED'"),
    "P8_appeals_filter": with_ctes("jobs", " SELECT id FROM jobs WHERE status = 'NEEDS_REVIEW' AND contains(lower(user_email), 'user1') ORDER BY id DESC"),
    "P9_lookup": with_ctes("users", " SELECT id FROM users WHERE lower(id) = 'user-7' OR lower(email) = 'user9@mail.example'"),
    "P10_job_filter": with_ctes("jobs", " SELECT id FROM jobs WHERE contains(lower(bank_name), 'bank 1') AND (is_ambiguous OR status = 'AMBIGUOUS_BANK')"),
    "P13_visibility": with_ctes("jobs", " SELECT id, 'own' AS seen_by FROM jobs WHERE user_id = 'User-7' UNION ALL SELECT id, 'admin' FROM jobs"),
    "S12_feed": with_ctes("jobs", " SELECT 'conversions' AS source, CAST(id AS STRING) AS id, created_at AS at FROM jobs WHERE status = 'FAILED' UNION ALL SELECT 'reviews', CAST(id AS STRING), created_at FROM jobs WHERE status = 'NEEDS_REVIEW'"),
    "S12_filtered_rows": "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' AND (o_orderpriority = '1-URGENT' OR o_custkey = 7) ORDER BY o_orderdate DESC, o_orderkey",
    "S11_newest": with_ctes("jobs", " SELECT id, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 10"),
    "K7_upsert": with_ctes("jobs", _DAILY + """
, b AS (SELECT user_id, day, pages_used AS pages FROM daily WHERE conversions = 1 UNION ALL SELECT user_id, CAST(created_at AS DATE), page_count FROM jobs) SELECT user_id, day, CAST(sum(pages) AS BIGINT) AS pages FROM b GROUP BY 1, 2"""),
}

"""Registered queries on charts of accounts and matching, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.scalars import normalize_ledger_name
from daybook.operators import ledgers
from daybook.plans.scalar_plans import PARTY_SQL
from daybook.sources.fixtures import relation, with_ctes


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "ledgers").withColumnRenamed("parent_of_nation", "parent")


def p11_p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledgers(spark, sf_dir).select("ord", ledgers.is_bank_ledger().alias("is_bank"), ledgers.is_cash_ledger().alias("is_cash"))


def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.search(_ledgers(spark, sf_dir), "supplier 001").select("ord", "name", "rank")


def j20_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.search(_ledgers(spark, sf_dir), "Supplier Alpha 2", 7).select("ord", "rank")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledgers(spark, sf_dir)
    return rows.where("ord % 2 = 0").select(F.col("grp").alias("name"), "parent").distinct()


def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _groups(spark, sf_dir).groupBy("name").agg(F.min("parent").alias("parent"))
    return ledgers.with_parent_group(_ledgers(spark, sf_dir), parents).select("ord", "grp", "parent_group")


def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledgers(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledgers(spark, sf_dir).where(F.col("name").contains("1")).select("grp").distinct()


def u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledgers(spark, sf_dir)
    again = rows.where("ord % 3 <> 0").select((F.col("ord") + 1000).alias("ord"), "name", F.lit("Other").alias("grp"), "parent", F.concat(F.lit("G"), F.col("ord")).alias("gstin"), F.concat(F.lit("X"), F.col("ord")).alias("alias"), F.lit(5).cast("decimal(18,2)").alias("opening_balance"))
    both = rows.unionByName(again).withColumn("normalized_name", normalize_ledger_name(F.col("name"))).withColumn("aliases", F.array_compact(F.array("alias"))).drop("alias")
    return ledgers.merged(both).select("normalized_name", "ord", "name", "grp", "gstin", "opening_balance", F.array_join("aliases", "|").alias("aliases"))


def s8_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ledgers(spark, sf_dir).select("ord", normalize_ledger_name(F.col("name")).alias("normalized_name"), "grp")
    again = rows.select((F.col("ord") + 1000).alias("ord"), "normalized_name", F.when(F.col("ord") % 2 == 0, "Other").when(F.col("ord") % 3 == 0, "Primary").otherwise(F.col("grp")).alias("grp"))
    return ledgers.group_conflicts(rows.unionByName(again))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.match(relation(spark, sf_dir, "narrated"), _ledgers(spark, sf_dir), relation(spark, sf_dir, "rules"))


def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("stmt_id", "row_index", "party_name", "ledger_name", "mapping_confidence", "mapping_status")


def _tier(status: str, *scores: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hit = (F.col("mapping_status") == status) & F.col("mapping_confidence").isin(*scores)
        return _matched(spark, sf_dir).where(hit).select("stmt_id", "row_index", "ledger_name", "mapping_confidence")

    return run


def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = relation(spark, sf_dir, "narrated").select(F.regexp_extract("narration", "(SUPPLIER [0-9]+)", 1).alias("party_norm")).where("party_norm <> ''").distinct()
    found = ledgers.candidates(parties, _ledgers(spark, sf_dir))
    return found.select("party_norm", "exact", F.array_join(F.transform(F.slice("listed", 1, 5), lambda x: x["ledger"]), "|").alias("best"))


def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("k") % 4 == 0, "Own Ledger").when(F.col("k") % 4 == 1, "Suspense")
    return ledgers.keep_confirmed(_matched(spark, sf_dir).withColumn("given", given), "given").select("stmt_id", "row_index", "ledger_name", "mapping_status")


def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir)
    two = (F.col("ledger_name") == "Suspense") | (F.col("mapping_status") == "Suspense")
    return m.groupBy("stmt_id").agg(F.count_if(two).alias("suspense"), F.count_if(~two).alias("mapped"), F.count_if(two | (F.coalesce("ledger_name", F.lit("")) == "")).alias("suspense_or_empty"))


def p3_p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir)
    hit = F.lit(False)
    for c in ("narration", "party_name", "ledger_name", "reference", "mapping_status", "category"):
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains("supplier 01")
    tab = F.when(F.col("mapping_status") == "Suspense", "SUSPENSE").otherwise("MAPPED")
    return m.where(hit).select("stmt_id", "row_index", tab.alias("tab"))


QUERIES = {
    "P11_P12_bank_cash_ledgers": p11_p12, "J20_ledger_search": j20, "J20_ledger_search_top": j20_top, "J18_parent_group": j18, "A13_ledgers_per_group": a13, "P14_groups": p14,
    "U8_ledger_merge": u8, "S8_group_conflicts": s8_conflicts, "J11_matching": j11, "J3_J4_saved_rules": _tier("Previously Mapped", 100.0, 95.0), "J5_tax_number": _tier("Auto", 99.0),
    "J6_J7_exact_alias": _tier("Auto", 100.0), "J8_J9_close_names": _tier("Auto", 88.0, 92.0), "J10_statutory": _tier("Auto", 95.0, 92.0, 90.0), "J12_candidates": j12, "J13_confirmed": j13,
    "P5_suspense_counts": p5, "P3_P4_review_search": p3_p4,
}

_NORM = lambda c: rf"upper(trim(regexp_replace({c}, '\s+', ' ', 'g')))"
_INDEX = f", idx AS (SELECT {_NORM('name')} AS norm, arg_max(name, ord) AS ledger, min(ord) AS ord FROM ledgers GROUP BY 1)"
_MATCH = PARTY_SQL + _INDEX + rf"""
, base AS (SELECT *, party[1] AS party_name, party[2] AS category, upper(trim(party[1])) AS party_up, {_NORM('party[1]')} AS pn, upper(narration) AS nu, nullif(regexp_extract(upper(narration), '\b([0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[0-9A-Z])\b', 1), '') AS tax FROM chosen),
rl AS (SELECT upper(trim(pattern)) AS p, ledger, ord FROM rules),
r1 AS (SELECT p AS party_up, arg_max(ledger, ord) AS rule_party FROM rl GROUP BY p),
r2 AS (SELECT nu, arg_min(ledger, rl.ord) AS rule_text FROM (SELECT DISTINCT nu FROM base) b JOIN rl ON contains(nu, p) GROUP BY nu),
tx1 AS (SELECT upper(trim(gstin)) AS tax, arg_max(name, ord) AS tax_ledger FROM ledgers WHERE gstin IS NOT NULL GROUP BY 1),
ps AS (SELECT DISTINCT pn FROM base WHERE pn <> ''),
pairs AS (SELECT pn, ledger, ord, CASE WHEN contains(norm, pn) OR contains(pn, norm) THEN 88.0
    WHEN len(list_intersect(string_split(pn, ' '), string_split(norm, ' '))) >= 1 AND len(list_intersect(string_split(pn, ' '), string_split(norm, ' '))) >= least(len(list_distinct(string_split(pn, ' '))), len(list_distinct(string_split(norm, ' ')))) * 0.5
    THEN round(60.0 + len(list_intersect(string_split(pn, ' '), string_split(norm, ' ')))::DOUBLE / greatest(len(list_distinct(string_split(pn, ' '))), len(list_distinct(string_split(norm, ' ')))) * 25.0, 1) END AS score FROM ps JOIN idx ON norm <> pn),
tops AS (SELECT pn, ledger AS top_ledger, score AS top_score FROM pairs WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pn ORDER BY score DESC, ord) = 1),
ex AS (SELECT norm AS pn, ledger AS exact FROM idx),
al AS (SELECT {_NORM('alias')} AS pn, arg_max(name, ord) AS alias_ledger FROM ledgers WHERE alias IS NOT NULL GROUP BY 1),
ns AS (SELECT DISTINCT nu FROM base),
nm AS (SELECT nu, ledger AS n_ledger, CASE WHEN list_contains(list_transform(regexp_split_to_array(nu, '[/_:-]'), lambda x: trim(x)), norm) THEN 92.0 ELSE 88.0 END AS n_score, ord FROM ns JOIN idx ON list_contains(list_transform(regexp_split_to_array(nu, '[/_:-]'), lambda x: trim(x)), norm) OR (length(norm) >= 5 AND contains(nu, norm))),
nb AS (SELECT nu, n_ledger, n_score FROM nm QUALIFY row_number() OVER (PARTITION BY nu ORDER BY n_score DESC, ord) = 1),
wide AS (SELECT base.*, rule_party, rule_text, tax_ledger, exact, alias_ledger, top_ledger, top_score, n_ledger, n_score FROM base LEFT JOIN r1 USING (party_up) LEFT JOIN r2 USING (nu) LEFT JOIN tx1 USING (tax) LEFT JOIN ex USING (pn) LEFT JOIN al USING (pn) LEFT JOIN tops USING (pn) LEFT JOIN nb USING (nu)),
matched AS (SELECT *, CASE WHEN cash IS NOT NULL OR coalesce(party_up, '') = 'CASH' THEN ['Cash', '99', 'Auto'] WHEN rule_party IS NOT NULL THEN [rule_party, '100', 'Previously Mapped'] WHEN rule_text IS NOT NULL THEN [rule_text, '95', 'Previously Mapped']
  WHEN tax_ledger IS NOT NULL THEN [tax_ledger, '99', 'Auto'] WHEN exact IS NOT NULL THEN [exact, '100', 'Auto'] WHEN alias_ledger IS NOT NULL THEN [alias_ledger, '100', 'Auto'] WHEN top_score >= 80 THEN [top_ledger, CAST(top_score AS STRING), 'Auto']
  WHEN n_ledger IS NOT NULL THEN [n_ledger, CAST(n_score AS STRING), 'Auto'] WHEN party_name IN ('Bank Charges', 'Bank Interest Income', 'Bank Interest Expense', 'GST Input Tax Credit', 'APY Contribution', 'Clearing') THEN [party_name, '90', 'Auto'] ELSE ['Suspense', '0', 'Suspense'] END AS m FROM wide),
told AS (SELECT *, m[1] AS ledger_name, CAST(m[2] AS DOUBLE) AS mapping_confidence, m[3] AS mapping_status FROM matched)"""
_R = ("narrated", "ledgers", "rules")


def _tier_sql(status: str, scores: str) -> str:
    return with_ctes(_R, _MATCH + f" SELECT stmt_id, row_index, ledger_name, mapping_confidence FROM told WHERE mapping_status = '{status}' AND mapping_confidence IN ({scores})")


ORACLES = {
    "P11_P12_bank_cash_ledgers": with_ctes("ledgers", """
, u AS (SELECT ord, upper(name) AS n, upper(grp) AS g, upper(parent_of_nation) AS p FROM ledgers)
SELECT ord, contains(g, 'BANK') AND NOT (contains(g, 'EXPENSE') OR contains(g, 'INCOME') OR contains(g, 'DEBTOR') OR contains(g, 'CREDITOR')) AS is_bank, contains(g, 'CASH') OR contains(p, 'CASH') AS is_cash FROM u"""),
    "J20_ledger_search": with_ctes("ledgers", f"""
, u AS (SELECT *, {_NORM('name')} AS n, upper(coalesce(gstin, '')) AS t FROM ledgers), r AS (SELECT ord, name, CASE WHEN n = 'SUPPLIER 001' THEN 0 WHEN coalesce({_NORM('alias')}, '') = 'SUPPLIER 001' THEN 1 WHEN starts_with(n, 'SUPPLIER 001') THEN 2 WHEN contains(n, 'SUPPLIER 001') THEN 3
  WHEN contains(upper(grp), 'SUPPLIER 001') THEN 4 WHEN contains(n, 'SUPPLIER') OR contains(n, '001') THEN 5 END AS rank FROM u) SELECT ord, name, CAST(rank AS INT) AS rank FROM r WHERE rank IS NOT NULL"""),
    "J20_ledger_search_top": with_ctes("ledgers", f"""
, r AS (SELECT ord, CASE WHEN coalesce({_NORM('alias')}, '') = 'SUPPLIER ALPHA 2' THEN 1 ELSE 5 END AS rank FROM ledgers) SELECT ord, CAST(rank AS INT) AS rank FROM r ORDER BY rank, ord LIMIT 7"""),
    "J18_parent_group": with_ctes("ledgers", """
, g AS (SELECT grp AS name, min(parent_of_nation) AS parent FROM ledgers WHERE ord % 2 = 0 GROUP BY grp) SELECT ord, grp, coalesce(parent, grp) AS parent_group FROM ledgers LEFT JOIN g ON grp = g.name"""),
    "A13_ledgers_per_group": with_ctes("ledgers", " SELECT grp, count(*) AS n FROM ledgers GROUP BY grp"),
    "P14_groups": with_ctes("ledgers", " SELECT DISTINCT grp FROM ledgers WHERE contains(name, '1')"),
    "U8_ledger_merge": with_ctes("ledgers", f"""
, b AS (SELECT ord, name, grp, gstin, alias, opening_balance FROM ledgers UNION ALL SELECT ord + 1000, name, 'Other', concat('G', ord), concat('X', ord), 5 FROM ledgers WHERE ord % 3 <> 0), k AS (SELECT *, {_NORM('name')} AS normalized_name FROM b)
SELECT normalized_name, CAST(min(ord) AS INT) AS ord, arg_min(name, ord) AS name, arg_min(grp, ord) AS grp, arg_min(gstin, ord) FILTER (WHERE gstin IS NOT NULL) AS gstin, CAST(arg_min(opening_balance, ord) FILTER (WHERE opening_balance IS NOT NULL) AS DECIMAL(18,2)) AS opening_balance,
  coalesce(string_agg(alias, '|' ORDER BY ord) FILTER (WHERE alias IS NOT NULL), '') AS aliases FROM k GROUP BY normalized_name"""),
    "S8_group_conflicts": with_ctes("ledgers", f"""
, a AS (SELECT ord, {_NORM('name')} AS normalized_name, grp FROM ledgers), b AS (SELECT * FROM a UNION ALL SELECT ord + 1000, normalized_name, CASE WHEN ord % 2 = 0 THEN 'Other' WHEN ord % 3 = 0 THEN 'Primary' ELSE grp END FROM a),
f AS (SELECT normalized_name, arg_min(grp, ord) AS first_grp, min(ord) AS fo FROM b GROUP BY 1) SELECT normalized_name, CAST(ord AS INT) AS ord, first_grp, grp FROM b JOIN f USING (normalized_name) WHERE ord > fo AND grp <> 'Primary' AND first_grp <> 'Primary' AND grp <> first_grp"""),
    "J11_matching": with_ctes(_R, _MATCH + " SELECT stmt_id, row_index, party_name, ledger_name, mapping_confidence, mapping_status FROM told"),
    "J3_J4_saved_rules": _tier_sql("Previously Mapped", "100, 95"),
    "J5_tax_number": _tier_sql("Auto", "99"),
    "J6_J7_exact_alias": _tier_sql("Auto", "100"),
    "J8_J9_close_names": _tier_sql("Auto", "88, 92"),
    "J10_statutory": _tier_sql("Auto", "95, 92, 90"),
    "J12_candidates": with_ctes(("narrated", "ledgers"), f"""
, ix AS (SELECT {_NORM('name')} AS norm, arg_max(name, ord) AS ledger, min(ord) AS ord FROM ledgers GROUP BY 1), ps AS (SELECT DISTINCT regexp_extract(narration, '(SUPPLIER [0-9]+)', 1) AS pn FROM narrated WHERE regexp_extract(narration, '(SUPPLIER [0-9]+)', 1) <> ''),
sc AS (SELECT pn, ledger, ord, CASE WHEN contains(norm, pn) OR contains(pn, norm) THEN 88.0 WHEN len(list_intersect(string_split(pn, ' '), string_split(norm, ' '))) >= least(2, len(list_distinct(string_split(norm, ' ')))) * 0.5
  THEN round(60.0 + len(list_intersect(string_split(pn, ' '), string_split(norm, ' ')))::DOUBLE / greatest(2, len(list_distinct(string_split(norm, ' ')))) * 25.0, 1) END AS score FROM ps JOIN ix ON pn <> norm),
bs AS (SELECT pn, array_to_string(list(ledger ORDER BY score DESC, ord)[1:5], '|') AS best FROM sc WHERE score IS NOT NULL GROUP BY pn)
SELECT ps.pn AS party_norm, ix.ledger AS exact, best FROM ps LEFT JOIN ix ON ps.pn = ix.norm LEFT JOIN bs ON ps.pn = bs.pn"""),
    "J13_confirmed": with_ctes(_R, _MATCH + " SELECT stmt_id, row_index, CASE WHEN k % 4 = 0 THEN 'Own Ledger' ELSE ledger_name END AS ledger_name, CASE WHEN k % 4 = 0 THEN 'User Confirmed' ELSE mapping_status END AS mapping_status FROM told"),
    "P5_suspense_counts": with_ctes(_R, _MATCH + """
SELECT stmt_id, count(*) FILTER (WHERE mapping_status = 'Suspense') AS suspense, count(*) FILTER (WHERE mapping_status <> 'Suspense') AS mapped, count(*) FILTER (WHERE mapping_status = 'Suspense') AS suspense_or_empty FROM told GROUP BY stmt_id"""),
    "P3_P4_review_search": with_ctes(_R, _MATCH + """
SELECT stmt_id, row_index, CASE WHEN mapping_status = 'Suspense' THEN 'SUSPENSE' ELSE 'MAPPED' END AS tab FROM told WHERE contains(lower(concat_ws('~', narration, party_name, ledger_name, reference, mapping_status, category)), 'supplier 01')"""),
}

"""Registered queries on vouchers, edits and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import edits, vouchers
from daybook.plans.scalar_plans import _CASH, PARTY_SQL
from daybook.sources.fixtures import relation, with_ctes


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a voucher type; every tenth has both sides, every fifteenth neither, every twentieth an edited type."""
    t = relation(spark, sf_dir, "narrated")
    t = t.withColumn("credit", F.when(F.col("k") % 10 == 0, F.col("debit") + F.col("k") % 3 - 1).otherwise(F.col("credit")).cast("decimal(15,2)"))
    t = t.withColumn("debit", F.when(F.col("k") % 15 == 0, 0).otherwise(F.col("debit")).cast("decimal(15,2)")).withColumn("credit", F.when(F.col("k") % 15 == 0, 0).otherwise(F.col("credit")).cast("decimal(15,2)"))
    edited = F.when(F.col("k") % 20 == 0, "Journal").otherwise("Payment")
    return t.withColumn("voucher_type", vouchers.voucher_type(F.col("narration"), F.col("debit"), F.col("credit"), edited, F.lit("Payment")))


_SIDES = """
, sided AS (SELECT * REPLACE (CAST(CASE WHEN k % 15 = 0 THEN 0 ELSE debit END AS DECIMAL(15,2)) AS debit, CAST(CASE WHEN k % 15 = 0 THEN 0 WHEN k % 10 = 0 THEN debit + k % 3 - 1 ELSE credit END AS DECIMAL(15,2)) AS credit) FROM narrated)"""
_CLASSIFIED = _SIDES + _CASH.replace("FROM narrated", "FROM sided") + """
, classed AS (SELECT *, CASE WHEN k % 20 = 0 THEN 'Journal' WHEN contains(upper(narration), 'INTERNAL TRANSFER') OR contains(upper(narration), 'OWN ACCOUNT TRANSFER') THEN 'Contra' WHEN cash IS NOT NULL THEN 'Contra'
  WHEN debit > 0 AND credit > 0 THEN CASE WHEN debit > credit THEN 'Payment' ELSE 'Receipt' END WHEN credit > 0 THEN 'Receipt' ELSE 'Payment' END AS voucher_type FROM cashed)"""
_VOUCHERS = _CLASSIFIED + """
, vouched AS (SELECT stmt_id, row_index, voucher_type, tx_date, CASE WHEN k % 31 = 0 THEN '' ELSE narration END AS narration, CASE WHEN k % 4 = 0 THEN 'Cash' WHEN k % 4 = 1 THEN concat('A & B ', k % 9) ELSE 'Suspense' END AS ledger_name, 'Bank Account' AS bank_ledger_name,
  CASE WHEN k % 5 = 0 THEN lpad(CAST(k % 10000 AS STRING), 6, '0') END AS instrument_number, tx_date AS instrument_date, debit, credit, balance,
  coalesce(nullif(reference, ''), CASE WHEN k % 5 = 0 THEN lpad(CAST(k % 10000 AS STRING), 6, '0') END) AS reference, CASE WHEN k % 29 = 0 THEN 'ERROR' ELSE 'VALID' END AS validation_status FROM classed)"""


def vouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = classified(spark, sf_dir)
    return vouchers.snapshot(t.select(
        "stmt_id", "row_index", "tx_date", "debit", "credit", "balance", "reference", "voucher_type", F.when(F.col("k") % 31 == 0, "").otherwise(F.col("narration")).alias("narration"),
        F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, F.concat(F.lit("A & B "), F.col("k") % 9)).alias("ledger_name"), (F.col("k") % 4 == 0).alias("is_cash_transaction"),
        F.when(F.col("k") % 5 == 0, F.lpad((F.col("k") % 10000).cast("string"), 6, "0")).alias("cheque_number"), F.lit("").alias("instrument_number"), F.lit(None).cast("date").alias("instrument_date"),
        F.when(F.col("k") % 29 == 0, "ERROR").alias("validation_status"),
    ))


def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("stmt_id", "row_index", "voucher_type")


def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouched(spark, sf_dir).select("stmt_id", "row_index", "ledger_name", "voucher_type")


def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouchers.entries(vouched(spark, sf_dir))


def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = vouchers.entries(vouched(spark, sf_dir))
    return legs.groupBy("ledger").agg(F.count(F.lit(1)).alias("n_legs"), F.sum("amount").cast("decimal(25,2)").alias("net"))


def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouchers.invariant_breaks(vouched(spark, sf_dir))


def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouchers.broken_documents(vouchers.voucher_documents(vouchers.voucher_xml(vouched(spark, sf_dir))))


def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vouched(spark, sf_dir)
    changed = vouchers.sheet(v).withColumn("LEDGER NAME", F.when(F.col("stmt_id") % 7 == 0, "Other").otherwise(F.col("LEDGER NAME"))).where(~((F.col("stmt_id") % 11 == 0) & (F.col("`VOUCHER NO.`") == 1)))
    return vouchers.parity_differences(v, changed)


def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = vouchers.entries(vouched(spark, sf_dir)).where("NOT (stmt_id % 5 = 0 AND leg = 2)")
    return vouchers.unbalanced(legs)


def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouchers.voucher_xml(vouched(spark, sf_dir))


def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vouchers.sheet(vouched(spark, sf_dir))


_LEGS = _VOUCHERS + """
, amounts AS (SELECT *, CASE WHEN debit > 0 THEN debit ELSE credit END AS amt, voucher_type = 'Receipt' OR (voucher_type = 'Contra' AND credit > 0) AS inward FROM vouched),
used AS (SELECT * FROM amounts WHERE amt <> 0 AND voucher_type <> 'Journal'),
legs AS (SELECT stmt_id, row_index, voucher_type, 1 AS leg, CASE WHEN inward THEN ledger_name ELSE bank_ledger_name END AS ledger, false AS is_deemed_positive, CAST(amt AS DECIMAL(15,2)) AS amount, CASE WHEN NOT inward THEN instrument_number END AS instrument_number FROM used
  UNION ALL SELECT stmt_id, row_index, voucher_type, 2, CASE WHEN inward THEN bank_ledger_name ELSE ledger_name END, true, CAST(-amt AS DECIMAL(15,2)), CASE WHEN inward THEN instrument_number END FROM used)"""
_SHEET = """SELECT stmt_id, row_index AS "VOUCHER NO.", voucher_type AS "VOUCHER TYPE", tx_date AS "VOUCHER DATE", narration AS "VOUCHER NARRATION", ledger_name AS "LEDGER NAME", bank_ledger_name AS "BANK LEDGER", instrument_number AS "INST. NUMBER",
  instrument_date AS "INST. DATE", CASE WHEN debit > 0 THEN debit END AS "DEBIT AMOUNT", CASE WHEN credit > 0 THEN credit END AS "CREDIT AMOUNT", balance AS "BALANCE" FROM vouched"""
_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_XML = _VOUCHERS + rf"""
, printed AS (SELECT *, strftime(tx_date, '%Y%m%d') AS d, CASE WHEN debit > 0 THEN debit ELSE credit END AS amt, voucher_type = 'Receipt' OR (voucher_type = 'Contra' AND credit > 0) AS inward, {_ESC("ledger_name")} AS p FROM vouched),
priced AS (SELECT *, regexp_replace(regexp_replace(CAST(amt AS STRING), '0+$', ''), '\.$', '') AS a FROM printed WHERE amt <> 0),
allocated AS (SELECT *, CASE WHEN instrument_number IS NULL THEN '' ELSE concat('<BANKALLOCATIONS.LIST><DATE>', d, '</DATE><INSTRUMENTDATE>', d, '</INSTRUMENTDATE><TRANSACTIONTYPE>Cheque/DD</TRANSACTIONTYPE><PAYMENTFAVOURING>', p, '</PAYMENTFAVOURING><INSTRUMENTNUMBER>', instrument_number, '</INSTRUMENTNUMBER><STATUS>Cheque</STATUS><AMOUNT>', a, '</AMOUNT></BANKALLOCATIONS.LIST>') END AS al FROM priced),
sides AS (SELECT *, concat('<ALLLEDGERENTRIES.LIST><LEDGERNAME>', CASE WHEN inward THEN p ELSE bank_ledger_name END, '</LEDGERNAME><ISDEEMEDPOSITIVE>No</ISDEEMEDPOSITIVE><AMOUNT>', a, '</AMOUNT>', CASE WHEN inward THEN '' ELSE al END, '</ALLLEDGERENTRIES.LIST><ALLLEDGERENTRIES.LIST><LEDGERNAME>',
  CASE WHEN inward THEN bank_ledger_name ELSE p END, '</LEDGERNAME><ISDEEMEDPOSITIVE>Yes</ISDEEMEDPOSITIVE><AMOUNT>-', a, '</AMOUNT>', CASE WHEN inward THEN al ELSE '' END, '</ALLLEDGERENTRIES.LIST>') AS two FROM allocated)
SELECT stmt_id, row_index, concat('<VOUCHER VCHTYPE="', voucher_type, '" ACTION="Create"><DATE>', d, '</DATE><VOUCHERTYPENAME>', voucher_type, '</VOUCHERTYPENAME><VOUCHERNUMBER>', row_index, '</VOUCHERNUMBER>',
  CASE WHEN reference IS NULL THEN '' ELSE concat('<REFERENCE>', {_ESC("reference")}, '</REFERENCE><REFERENCEDATE>', d, '</REFERENCEDATE>') END, '<NARRATION>', {_ESC("narration")}, '</NARRATION><EFFECTIVEDATE>', d, '</EFFECTIVEDATE>', CASE WHEN voucher_type = 'Journal' THEN '' ELSE two END, '</VOUCHER>') AS fragment FROM sides"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under review: party, ledger, statuses."""
    from daybook.functions import entities

    t = relation(spark, sf_dir, "narrated")
    return t.select(
        "stmt_id", "row_index", "debit", "credit", "narration", entities.party(F.col("narration"), F.col("debit") > 0)["name"].alias("party_name"),
        F.when(F.col("k") % 6 == 0, F.lit(None)).when(F.col("k") % 6 == 1, "Suspense").otherwise("Ledger A").alias("ledger_name"), F.when(F.col("k") % 6 < 2, "Suspense").otherwise("Auto").alias("mapping_status"),
        F.when(F.col("k") % 13 == 0, "ERROR").when(F.col("k") % 7 == 0, "WARNING").otherwise("VALID").alias("validation_status"),
        F.when(F.col("k") % 14 == 0, "Both debit and credit amounts are zero.").alias("validation_notes"), (F.col("k") % 24).isin(5, 6).alias("is_cash_transaction"), F.lit("Payment").alias("voucher_type"),
    )


_REVIEWED = PARTY_SQL + """
, reviewed AS (SELECT stmt_id, k, row_index, debit, credit, narration, party[1] AS party_name, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 'Suspense' ELSE 'Ledger A' END AS ledger_name, CASE WHEN k % 6 < 2 THEN 'Suspense' ELSE 'Auto' END AS mapping_status,
  CASE WHEN k % 13 = 0 THEN 'ERROR' WHEN k % 7 = 0 THEN 'WARNING' ELSE 'VALID' END AS validation_status, CASE WHEN k % 14 = 0 THEN 'Both debit and credit amounts are zero.' END AS validation_notes, k % 24 IN (5, 6) AS is_cash_transaction, 'Payment' AS voucher_type FROM chosen)"""


def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    changes = rows.where("stmt_id % 3 = 0 AND row_index = 2").select("stmt_id", F.lit(2).alias("at"), F.lit(" Rent ").alias("new_ledger"), F.lit(None).cast("string").alias("new_type"), F.lit(None).cast("string").alias("new_narration"))
    changes = changes.union(rows.where("stmt_id % 3 = 1 AND row_index = 1").select("stmt_id", F.lit(0), F.lit(None).cast("string"), F.lit("Contra"), F.lit("edited")))
    return edits.edit_rows(rows, changes).select("stmt_id", "row_index", "ledger_name", "voucher_type", "narration", "mapping_status", "validation_status")


def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    asked = rows.where("row_index <= 2").select("stmt_id", (F.col("row_index") - F.when(F.col("stmt_id") % 2 == 0, 1).otherwise(0)).alias("at"))
    return edits.resolve_targets(rows, asked).select("stmt_id", "row_index")


def u3_u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    targets = rows.where("stmt_id % 4 = 0 AND row_index = 1").select("stmt_id", "row_index")
    return edits.assign(rows, targets, "Chosen Ledger", similar=True).select("stmt_id", "row_index", "ledger_name", "mapping_status", "validation_status")


def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.auto_resolve(_reviewed(spark, sf_dir)).select("stmt_id", "row_index", "voucher_type", "ledger_name", "validation_status")


def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    return edits.ignore_warnings(rows, rows.where("row_index % 2 = 0").select("stmt_id", "row_index")).select("stmt_id", "row_index", "validation_status")


def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, "narrated").select("stmt_id", "row_index", "k", "source_page")
    return edits.append_pages(rows.where("source_page = 1"), rows.where("source_page > 1").withColumn("row_index", F.col("row_index") - 11)).select("stmt_id", "row_index", "k")


QUERIES = {
    "C1_voucher_type": c1, "W18_voucher_numbers": w18, "C2_C3_entries": c2, "C4_ledger_nets": c4, "C5_invariants": c5, "C6_document_structure": c6, "C7_J21_parity": c7, "A15_unbalanced": a15,
    "K1_voucher_xml": k1, "K2_sheet": k2, "U1_edit_rows": u1, "U2_targets": u2, "U3_U4_assign": u3_u4, "U5_auto_resolve": u5, "U6_ignore_warnings": u6, "U7_append_pages": u7,
}

_N = "narrated"
ORACLES = {
    "C1_voucher_type": with_ctes(_N, _CLASSIFIED + " SELECT stmt_id, row_index, voucher_type FROM classed"),
    "W18_voucher_numbers": with_ctes(_N, _VOUCHERS + " SELECT stmt_id, row_index, ledger_name, voucher_type FROM vouched"),
    "C2_C3_entries": with_ctes(_N, _LEGS + " SELECT * FROM legs"),
    "C4_ledger_nets": with_ctes(_N, _LEGS + " SELECT ledger, count(*) AS n_legs, CAST(sum(amount) AS DECIMAL(25,2)) AS net FROM legs GROUP BY ledger"),
    "C5_invariants": with_ctes(_N, _VOUCHERS + """
SELECT stmt_id, row_index, 'MISSING_NARRATION' AS rule FROM vouched WHERE trim(narration) = '' UNION ALL SELECT stmt_id, row_index, 'NEGATIVE_AMOUNT' FROM vouched WHERE debit < 0 OR credit < 0
UNION ALL SELECT stmt_id, row_index, 'ZERO_AMOUNTS' FROM vouched WHERE debit = 0 AND credit = 0 UNION ALL SELECT stmt_id, row_index, 'BALANCE_ERROR' FROM vouched WHERE validation_status = 'ERROR'"""),
    "C6_document_structure": with_ctes(_N, _VOUCHERS + """
, amounts AS (SELECT *, CASE WHEN debit > 0 THEN debit ELSE credit END AS amt FROM vouched)
SELECT stmt_id, CAST(count(*) AS INT) AS n_vouchers, CAST(2 * count(*) FILTER (WHERE voucher_type <> 'Journal') AS INT) AS n_legs, CAST(count(*) FILTER (WHERE voucher_type = 'Journal') AS INT) AS n_broken FROM amounts WHERE amt <> 0 GROUP BY stmt_id"""),
    "C7_J21_parity": with_ctes(_N, _VOUCHERS + """
SELECT stmt_id, row_index, CASE WHEN stmt_id % 11 = 0 AND row_index = 1 THEN 'ONLY IN VOUCHERS' ELSE 'LEDGER NAME' END AS field FROM vouched WHERE (stmt_id % 11 = 0 AND row_index = 1) OR stmt_id % 7 = 0"""),
    "A15_unbalanced": with_ctes(_N, _LEGS + """
SELECT stmt_id, row_index, count(*) AS n_legs, CAST(sum(amount) AS DECIMAL(25,2)) AS net FROM legs WHERE NOT (stmt_id % 5 = 0 AND leg = 2) GROUP BY stmt_id, row_index HAVING count(*) < 2 OR abs(sum(amount)) > 0.01"""),
    "K1_voucher_xml": with_ctes(_N, _XML),
    "K2_sheet": with_ctes(_N, _VOUCHERS + " " + _SHEET),
    "U1_edit_rows": with_ctes(_N, _REVIEWED + """
, e AS (SELECT *, stmt_id % 3 = 0 AND row_index = 2 AS a, stmt_id % 3 = 1 AND row_index = 1 AS b FROM reviewed)
SELECT stmt_id, row_index, CASE WHEN a THEN 'Rent' ELSE ledger_name END AS ledger_name, CASE WHEN b THEN 'Contra' ELSE voucher_type END AS voucher_type, CASE WHEN b THEN 'edited' ELSE narration END AS narration,
  CASE WHEN a THEN 'User Confirmed' ELSE mapping_status END AS mapping_status, CASE WHEN a THEN 'VALID' ELSE validation_status END AS validation_status FROM e"""),
    "U2_targets": with_ctes(_N, _REVIEWED + """
, sizes AS (SELECT stmt_id, count(*) AS n FROM reviewed GROUP BY stmt_id), asked AS (SELECT stmt_id, row_index - CASE WHEN stmt_id % 2 = 0 THEN 1 ELSE 0 END AS place, n FROM reviewed JOIN sizes USING (stmt_id) WHERE row_index <= 2),
based AS (SELECT stmt_id, bool_or(place = 0) OR (bool_and(place >= 0 AND place < n) AND NOT bool_or(place = n)) AS zero FROM asked GROUP BY stmt_id)
SELECT DISTINCT stmt_id, CAST(place + CASE WHEN zero THEN 1 ELSE 0 END AS INT) AS row_index FROM asked JOIN based USING (stmt_id) WHERE place + CASE WHEN zero THEN 1 ELSE 0 END <= n"""),
    "U3_U4_assign": with_ctes(_N, _REVIEWED + """
, picked AS (SELECT stmt_id, upper(party_name) AS p FROM reviewed WHERE stmt_id % 4 = 0 AND row_index = 1),
hit AS (SELECT r.*, (r.stmt_id % 4 = 0 AND row_index = 1) OR EXISTS (SELECT 1 FROM picked q WHERE q.stmt_id = r.stmt_id AND q.p IS NOT NULL AND (upper(r.party_name) = q.p OR contains(upper(r.narration), q.p))) AS h FROM reviewed r)
SELECT stmt_id, row_index, CASE WHEN h THEN 'Chosen Ledger' ELSE ledger_name END AS ledger_name, CASE WHEN h THEN 'User Confirmed' ELSE mapping_status END AS mapping_status, CASE WHEN h THEN 'VALID' ELSE validation_status END AS validation_status FROM hit"""),
    "U5_auto_resolve": with_ctes(_N, _REVIEWED + """
SELECT stmt_id, row_index, CASE WHEN debit > 0 AND credit = 0 THEN 'Payment' WHEN credit > 0 AND debit = 0 THEN 'Receipt' WHEN is_cash_transaction THEN 'Contra' WHEN debit > credit THEN 'Payment' ELSE 'Receipt' END AS voucher_type, coalesce(ledger_name, 'Suspense') AS ledger_name,
  CASE WHEN validation_status = 'WARNING' AND NOT contains(lower(coalesce(validation_notes, '')), 'zero') THEN 'VALID' ELSE validation_status END AS validation_status FROM reviewed"""),
    "U6_ignore_warnings": with_ctes(_N, _REVIEWED + " SELECT stmt_id, row_index, CASE WHEN row_index % 2 = 0 THEN 'VALID' ELSE validation_status END AS validation_status FROM reviewed"),
    "U7_append_pages": with_ctes(_N, " SELECT stmt_id, CAST(row_number() OVER (PARTITION BY stmt_id ORDER BY row_index) AS INT) AS row_index, k FROM narrated"),
}

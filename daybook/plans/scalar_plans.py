"""Registered queries on scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions import entities, scalars
from daybook.sources.fixtures import relation, with_ctes


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed forms of dates and amounts of every transaction."""
    tx = relation(spark, sf_dir, "tx")
    day = lambda f: F.date_format("tx_date", f)
    kind = F.col("k") % 8
    printed = (
        F.when(kind == 0, day("dd/MM/yyyy")).when(kind == 1, day("dd-MM-yyyy")).when(kind == 2, day("dd.MM.yyyy")).when(kind == 3, day("yyyy-MM-dd"))
        .when(kind == 4, day("dd-MMM-yyyy")).when(kind == 5, day("dd MMM yyyy")).when(kind == 6, "31/02/2024").otherwise("no date")
    )
    amount = (F.col("debit") + F.col("credit")).cast("decimal(15,2)").cast("string")
    said = (
        F.when(kind == 0, F.concat(F.lit("₹"), amount)).when(kind == 1, F.concat(F.lit("Rs. "), amount, F.lit(" Cr"))).when(kind == 2, F.concat(F.lit("("), amount, F.lit(")")))
        .when(kind == 3, F.concat(F.lit("INR "), amount, F.lit(" Dr."))).when(kind == 4, "").when(kind == 5, "n/a").when(kind == 6, F.concat(F.lit("-"), amount)).otherwise("1,23,456.75")
    )
    return tx.select("stmt_id", "row_index", printed.alias("printed"), said.alias("said"))


_TEXTS = """
, texts AS (SELECT stmt_id, row_index, CASE CAST(k % 8 AS INT) WHEN 0 THEN strftime(tx_date, '%d/%m/%Y') WHEN 1 THEN strftime(tx_date, '%d-%m-%Y') WHEN 2 THEN strftime(tx_date, '%d.%m.%Y') WHEN 3 THEN strftime(tx_date, '%Y-%m-%d')
    WHEN 4 THEN strftime(tx_date, '%d-%b-%Y') WHEN 5 THEN strftime(tx_date, '%d %b %Y') WHEN 6 THEN '31/02/2024' ELSE 'no date' END AS printed, tx_date, k, debit + credit AS amount FROM tx)"""


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("stmt_id", "row_index", "printed", scalars.normalize_date(F.col("printed")).alias("day"))


def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return t.select("stmt_id", "row_index", scalars.normalize_amount(F.col("said")).alias("amount"))


def _narrated(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    return relation(spark, sf_dir, "narrated").select("stmt_id", "row_index", *[c.alias(k) for k, c in columns.items()])


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.concat(F.lit("  "), F.replace(F.col("narration"), F.lit(" "), F.lit("\n   ")), F.lit("\t"))
    return _narrated(spark, sf_dir, cleaned=scalars.clean_narration(spread))


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrated(spark, sf_dir, found=scalars.extract_reference(F.col("narration")))


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrated(spark, sf_dir, cleaned=entities.without_noise(F.col("narration")))


def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrated(spark, sf_dir, instrument=entities.instrument_number(F.col("narration"), F.col("reference")))


def f7_f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrated(spark, sf_dir, upi=entities.upi_reference(F.col("narration")), utr=entities.utr_reference(F.col("narration")))


def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrated(spark, sf_dir, cash=entities.cash_type(F.col("narration"), F.col("debit") > 0))


def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = entities.party(F.col("narration"), F.col("debit") > 0)
    return _narrated(spark, sf_dir, party=p["name"], category=p["category"])


def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "ledgers").select("ord", scalars.normalize_ledger_name(F.col("name")).alias("normalized"))


def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = relation(spark, sf_dir, "users")
    return u.select("id", scalars.mask_destination(F.col("email")).alias("email"), scalars.mask_destination(F.col("mobile_number")).alias("mobile"), scalars.mask_account(F.col("full_name")).alias("account"))


def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit('login password="pw'), F.col("id"), F.lit('" Authorization: Bearer ab.'), F.col("id"), F.lit(" token="), F.col("email"), F.lit(" done"))
    return relation(spark, sf_dir, "users").select("id", scalars.redact_log(log).alias("line"))


def f15_k6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = relation(spark, sf_dir, "narrated").groupBy("stmt_id").agg(F.min("tx_date").alias("a"), F.max("tx_date").alias("b"))
    from daybook.operators.vouchers import export_filename

    return s.select("stmt_id", export_filename(F.concat(F.lit("S.B/I-"), F.col("stmt_id"), F.lit(" Bank")), F.col("a"), F.col("b"), "xlsx").alias("sheet"), export_filename(F.lit("Axis Bank"), F.col("a"), F.col("b"), "xml").alias("document"))


def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relation(spark, sf_dir, "tx")
    return t.select("stmt_id", "row_index", scalars.page_price(F.col("k") % 500).alias("price"), scalars.pages_for_payment(F.col("debit") + F.col("credit")).alias("pages"))


def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "tx").select("stmt_id", "row_index", scalars.deletion_date(F.col("tx_date")).alias("deletion"), (scalars.deletion_date(F.col("tx_date")) <= F.lit("1997-01-01").cast("date")).alias("eligible"))


def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "jobs").select("id", scalars.business_day(F.col("created_at")).alias("day"))


def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.operators.vouchers import snapshot

    return snapshot(_matched_rows(spark, sf_dir)).select("stmt_id", "row_index", "ledger_name", "instrument_number", "instrument_date", "reference")


def _matched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relation(spark, sf_dir, "narrated")
    return t.select(
        "stmt_id", "row_index", "tx_date", "debit", "credit", "balance", "narration", "reference",
        F.when(F.col("k") % 4 == 0, F.lit("  ")).when(F.col("k") % 4 == 1, F.concat(F.lit(" Ledger "), F.col("k") % 9, F.lit(" "))).otherwise(F.lit(None)).alias("ledger_name"),
        (F.col("k") % 3 == 0).alias("is_cash_transaction"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit(" 00"), F.col("k") % 10000)).alias("instrument_number"),
        F.when(F.col("k") % 5 == 1, F.lpad((F.col("k") % 10000).cast("string"), 6, "0")).alias("cheque_number"),
        F.lit(None).cast("date").alias("instrument_date"),
        F.lit(None).cast("string").alias("voucher_type"),
        F.lit("VALID").alias("validation_status"),
    )


def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k") % 9
    content = (
        F.when(k == 0, ' {"a": 1}').when(k == 1, "[1]").when(k == 2, '<?xml version="1.0"?><x/>').when(k == 3, "text <ledger name='a'/>").when(k == 4, "<table><tr></tr></table>")
        .when(k == 5, "<!doctype html><p>").otherwise("plain")
    )
    name = F.when(k == 6, "A.JSON").when(k == 7, "b.htm").otherwise("c.txt")
    return relation(spark, sf_dir, "tx").select("stmt_id", "row_index", scalars.ledger_format(content, name).alias("format"))


def s13_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit('<!DOCTYPE x><STATE>&#4; Any "'), F.col("narration"), F.lit("'</STATE>&#x1F;&#0;&#65;\x01<NAME>A & B</NAME>"))
    return _narrated(spark, sf_dir, clean=scalars.sanitize_xml(raw), escaped=scalars.xml_escape(raw))


def k4_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = relation(spark, sf_dir, "tx")
    amount = F.when(F.col("k") % 3 == 0, F.floor(F.col("debit") + F.col("credit"))).when(F.col("k") % 3 == 1, F.floor((F.col("debit") + F.col("credit")) * 10) / 10).otherwise(F.col("debit") + F.col("credit"))
    return t.select("stmt_id", "row_index", scalars.compact_date(F.col("tx_date")).alias("day"), scalars.amount_text(amount).alias("amount"))


QUERIES = {
    "F1_normalize_date": f1,
    "F2_normalize_amount": f2,
    "F3_clean_narration": f3,
    "F4_reference_number": f4,
    "F5_narration_noise": f5,
    "F6_instrument_number": f6,
    "F7_F8_upi_utr": f7_f8,
    "F9_cash_type": f9,
    "F10_party": f10,
    "F11_F12_ledger_name": f11,
    "F13_masking": f13,
    "F14_log_redaction": f14,
    "F15_K6_filenames": f15_k6,
    "F16_page_price": f16,
    "F17_deletion_date": f17,
    "F18_business_day": f18,
    "F19_snapshot_defaults": f19,
    "S7_format_sniffing": s7,
    "S13_K3_xml_text": s13_k3,
    "K4_K5_date_amount_text": k4_k5,
}

# The SQL's own values, written out so that it shares no constant with the operators.
_NOISE_WORDS = (r"(?i)\s*-\s*[0-9]+\s*LAT(?:ENCY)?\b", r"(?i)\s*-\s*LAT(?:ENCY)?\b", r"(?i)\bLATENCY\b", r"(?i)\bLAT\b", r"(?i)\bCTO[0-9]+\b", r"(?i)\bDisclaimer:\s*This\s+is\s+an\s+Electronically\s+Generated.*")
_CASH_IN = r"(?i)\b(CASH\s+DEP|CASH\s+DEPED|CASH\s+DEPOSIT|CASH\s+DEPOSITED|CASH\s+DEPOSIT\s+BY\s+SELF|BY\s+CASH|CDM\s+CASH|CDM\s+DEP|CASH\s+RECD|DEPOSIT\s+BY\s+CASH|CASH\s+DEPOSIT\s+AT)\b"
_CASH_OUT = r"(?i)\b(CASH\s+WITHDRAWAL|WITHDRAWAL\s+BY\s+CASH|CASH\s+WDL|ATM\s+CASH|ATM\s+WDL|SELF\s+CASH|SELF\s+WDL|TO\s+CASH)\b"
_CHARGES = r"(?i)\b(A/?C\s+MAINT|A/?C\s+MAINTENANCE|ACC\s+MAINT|ACC\s+MAINTENANCE|ACCOUNT\s+MAINT|ACCOUNT\s+MAINTENANCE|AMC|A/?C\s+KEEPING|ACC\s+KEEPING|ACCOUNT\s+KEEPING|SMS\s+ALERT|ANNUAL\s+FEE|CHARGE|CHARGES|CHG|CHGS|CHRG)\b"
_IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
_NOISE_SQL = "narration"
for _p in _NOISE_WORDS:
    _NOISE_SQL = f"regexp_replace({_NOISE_SQL}, '{_p}', '', 'g')"
_NOISE_SQL = rf"trim(regexp_replace({_NOISE_SQL}, '\s{{2,}}', ' ', 'g'))"

_CASH = f"""
, quiet AS (SELECT *, {_NOISE_SQL} AS t, debit > 0 AS is_debit FROM narrated),
cashed AS (SELECT *, upper(t) AS up, CASE WHEN regexp_matches(t, '{_CASH_IN}') OR (NOT is_debit AND contains(upper(t), 'BY CASH')) THEN 'CASH_DEPOSIT'
  WHEN regexp_matches(t, '{_CASH_OUT}') OR (is_debit AND (contains(upper(t), 'ATM') OR contains(upper(t), 'CASH WDL') OR contains(upper(t), 'SELF WDL'))) THEN 'CASH_WITHDRAWAL'
  WHEN regexp_matches(upper(t), '\\bCASH\\b') THEN CASE WHEN is_debit THEN 'CASH_WITHDRAWAL' ELSE 'CASH_DEPOSIT' END END AS cash FROM quiet)"""


def _last_token(split: str, words: tuple[str, ...], extra: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"list_filter(list_reverse(list_filter(list_transform(regexp_split_to_array(t, '{split}'), lambda x: trim(x)), lambda x: x <> '')), "
        f"lambda x: NOT list_contains([{listed}], upper(x)) AND length(x) > 2 AND {extra})"
    )


_UPI_LIST = _last_token("/", ("UPI", "P2M", "P2V", "P2A", "P2P", "NA", "CR", "DR", "PAY", "BIL", "LAT", "LATENCY"), "NOT regexp_matches(x, '^[0-9]+$')")
_UPI_TOKEN = (
    rf"list_filter(list_transform({_UPI_LIST}, lambda x: trim(regexp_replace(split_part(x, '@', 1), '\b[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}\b', '', 'g'))), "
    "lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$'))[1]"
)
_NO_CODE = "NOT (regexp_matches(upper(x), '^[A-Z0-9]{5,18}$') AND regexp_matches(x, '[0-9]'))"
_NEFT_TOKEN = _last_token("[/:-]", ("NEFT", "RTGS", "TRANSFER", "TO", "BY", "CR", "DR", "CMS", "OUT", "IN"), _NO_CODE + " AND NOT regexp_matches(upper(x), '^[A-Z]{4}0[0-9]{6,14}$')") + "[1]"
_IMPS_TOKEN = _last_token("[/:-]", ("IMPS", "P2A", "P2P", "CR", "DR"), _NO_CODE) + "[1]"
_TAIL = "list_filter(list_transform(string_split(t, '/'), lambda x: trim(x)), lambda x: x <> '')"

PARTY_SQL = (
    _CASH
    + rf"""
, parts AS (SELECT *, trim(regexp_replace(trim(regexp_extract(t, '(?i)\b(?:RTGS|NEFT)\s*(?:OUT|IN)?\s*:\s*[A-Z0-9]+\s*:\s*([^:/-]+)', 1)), '{_IFSC}', '', 'g')) AS p_colon,
  trim(regexp_replace(trim(regexp_extract(t, '(?i)Paid To\s*:\s*(?:TO\s+)?([^:/-]+)', 1)), '\bIZE\s+[0-9]+.*', '', 'g')) AS p_paid,
  trim(regexp_replace(trim(regexp_extract(t, '(?i)\bIZE\s+[0-9]{{5,8}}\s+([^:/-]+)', 1)), '{_IFSC}', '', 'g')) AS p_ize,
  trim(regexp_extract(t, '@[a-zA-Z0-9_.-]+/([^/]+)$', 1)) AS p_vpa, {_UPI_TOKEN} AS p_upi, {_NEFT_TOKEN} AS p_neft, {_IMPS_TOKEN} AS p_imps, {_TAIL} AS slashes FROM cashed),
chosen AS (SELECT *, CASE WHEN cash IS NOT NULL THEN ['Cash', cash] WHEN is_debit AND regexp_matches(t, '{_CHARGES}') THEN ['Bank Charges', 'BANK_CHARGES'] WHEN contains(up, 'GST ON BANK CHARGES') THEN ['Bank Charges', 'BANK_CHARGES']
  WHEN contains(up, 'GST:') OR contains(up, 'GST RECD') THEN ['GST Input Tax Credit', 'TAX'] WHEN contains(up, 'INT.PD') OR contains(up, 'INTEREST PAID') OR contains(up, 'INTEREST DEBIT') THEN ['Bank Interest Expense', 'INTEREST']
  WHEN contains(up, 'INTEREST RECEIVED') OR contains(up, 'INTEREST CREDIT') OR contains(up, 'INT RECD') OR contains(up, 'INT.COLL') THEN ['Bank Interest Income', 'INTEREST'] WHEN contains(up, 'APY CONTRI') THEN ['APY Contribution', 'PENSION']
  WHEN length(p_colon) > 2 AND NOT regexp_matches(p_colon, '^[0-9]+$') THEN [p_colon, CASE WHEN contains(up, 'RTGS') THEN 'RTGS' ELSE 'NEFT' END] WHEN length(p_paid) > 2 THEN [p_paid, 'TRANSFER'] WHEN length(p_ize) > 2 THEN [p_ize, 'CHEQUE']
  WHEN contains(up, 'CLEARING') THEN ['Clearing', 'CHEQUE'] WHEN contains(up, 'UPI') AND length(p_vpa) > 2 AND NOT regexp_matches(p_vpa, '^[0-9]+$') THEN [p_vpa, 'UPI']
  WHEN contains(up, 'UPI') AND len(slashes) >= 2 AND p_upi IS NOT NULL THEN [p_upi, 'UPI'] WHEN (contains(up, 'NEFT') OR contains(up, 'RTGS')) AND p_neft IS NOT NULL THEN [p_neft, 'NEFT'] WHEN contains(up, 'IMPS') AND p_imps IS NOT NULL THEN [p_imps, 'IMPS']
  WHEN len(slashes) >= 2 AND NOT regexp_matches(slashes[-1], '^[0-9]+$') AND length(slashes[-1]) > 2 THEN [slashes[-1], 'TRANSFER'] END AS party FROM parts)"""
)

_REFERENCE = r"""nullif(regexp_extract(narration, '(?i)\bUPI/(?:CR|DR)?/?([0-9]{10,14})\b', 1), ''), nullif(regexp_extract(narration, '(?i)\bIMPS/P2A/([0-9]{10,14})\b', 1), ''), nullif(regexp_extract(narration, '(?i)\bNEFT/([A-Z0-9]{10,18})\b', 1), ''),
  nullif(regexp_extract(narration, '(?i)\bRTGS/([A-Z0-9]{10,18})\b', 1), ''), nullif(regexp_extract(narration, '(?i)\b(?:CHQ|CHEQUE|REF)[\s.:#]+([A-Za-z0-9]+)\b', 1), '')"""
_SPOKEN = "contains(around, 'CHQ') OR contains(around, 'CHEQUE') OR contains(around, 'CLEARING') OR contains(around, 'TRANSFER') OR contains(around, 'INST') OR contains(around, 'IZE') OR contains(around, 'TRADI')"
_RAW_XML = "concat('<!DOCTYPE x><STATE>&#4; Any \"', narration, '''</STATE>&#x1F;&#0;&#65;', chr(1), '<NAME>A & B</NAME>')"

ORACLES = {
    "F1_normalize_date": with_ctes("tx", _TEXTS + " SELECT stmt_id, row_index, printed, CASE WHEN k % 8 < 6 THEN tx_date END AS day FROM texts"),
    "F2_normalize_amount": with_ctes("tx", _TEXTS + """
SELECT stmt_id, row_index, CAST(CASE CAST(k % 8 AS INT) WHEN 2 THEN -amount WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN -amount WHEN 7 THEN 123456.75 ELSE amount END AS DECIMAL(15,2)) AS amount FROM texts"""),
    "F3_clean_narration": with_ctes("narrated", r" SELECT stmt_id, row_index, trim(regexp_replace(narration, '\s+', ' ', 'g')) AS cleaned FROM narrated"),
    "F4_reference_number": with_ctes("narrated", f" SELECT stmt_id, row_index, coalesce({_REFERENCE}, '') AS found FROM narrated"),
    "F5_narration_noise": with_ctes("narrated", f" SELECT stmt_id, row_index, {_NOISE_SQL} AS cleaned FROM narrated"),
    "F6_instrument_number": with_ctes("narrated", rf"""
, looked AS (SELECT *, trim(reference) AS ref, upper(regexp_extract(narration, '((?:.{{0,15}})(?:^|\s|/|-|:)[0-9]{{6}}(?:\s|/|-|$)(?:.{{0,15}}))', 1)) AS around, nullif(regexp_extract(narration, '(?:^|\s|/|-|:)([0-9]{{6}})(?:\s|/|-|$)', 1), '') AS alone FROM narrated)
SELECT stmt_id, row_index, coalesce(CASE WHEN regexp_matches(ref, '^[0-9]{{5,8}}$') THEN ref END, nullif(regexp_extract(ref, '(?i)\b(?:CHQ|CHEQUE|INST|INSTRUMENT)?\s*[:./-]?\s*([0-9]{{5,8}})\b', 1), ''),
  nullif(regexp_extract(narration, '(?i)\b(?:IZE|CHQ|CHEQUE|INST|INSTRUMENT|CLR)\b\s*[:./#-]?\s*([0-9]{{5,8}})\b', 1), ''), nullif(regexp_extract(narration, '(?i)/(?:CHQ/)?([0-9]{{6}})/', 1), ''),
  CASE WHEN NOT starts_with(alone, '19') AND NOT starts_with(alone, '20') AND ({_SPOKEN}) THEN alone END) AS instrument FROM looked"""),
    "F7_F8_upi_utr": with_ctes("narrated", r"""
, codes AS (SELECT *, nullif(regexp_extract(narration, '\b(?:UPI/)?([0-9]{12})\b', 1), '') AS upi, nullif(regexp_extract(upper(narration), '\b([A-Z]{4}[A-Z0-9]{12,18})\b', 1), '') AS u FROM narrated)
SELECT stmt_id, row_index, upi, CASE WHEN NOT starts_with(u, 'HTTP') THEN u END AS utr FROM codes"""),
    "F9_cash_type": with_ctes("narrated", _CASH + " SELECT stmt_id, row_index, cash FROM cashed"),
    "F10_party": with_ctes("narrated", PARTY_SQL + " SELECT stmt_id, row_index, party[1] AS party, party[2] AS category FROM chosen"),
    "F11_F12_ledger_name": with_ctes("ledgers", r" SELECT ord, upper(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS normalized FROM ledgers"),
    "F13_masking": with_ctes("users", """
SELECT id, concat(substring(email, 1, 2), '***@mail.example') AS email, '******' || right(mobile_number, 4) AS mobile, concat('XXXX', right(full_name, 4)) AS account FROM users"""),
    "F14_log_redaction": with_ctes("users", """ SELECT id, 'login password="***" Authorization: Bearer *** token=*** done' AS line FROM users"""),
    "F15_K6_filenames": with_ctes("narrated", """
, ends AS (SELECT stmt_id, min(tx_date) AS a, max(tx_date) AS b FROM narrated GROUP BY stmt_id)
SELECT stmt_id, concat('SBI-', stmt_id, '_Statement_', strftime(a, '%d-%b-%y'), '_to_', strftime(b, '%d-%b-%y'), '.xlsx') AS sheet, concat('Axis_Statement_', strftime(a, '%Y-%m-%d'), '_to_', strftime(b, '%Y-%m-%d'), '.xml') AS document FROM ends"""),
    "F16_page_price": with_ctes("tx", " SELECT stmt_id, row_index, round((k % 500) * 2.0::DOUBLE, 2) AS price, CAST(floor((debit + credit) / 2) AS BIGINT) AS pages FROM tx"),
    "F17_deletion_date": with_ctes("tx", " SELECT stmt_id, row_index, tx_date + 90 AS deletion, tx_date + 90 <= DATE '1997-01-01' AS eligible FROM tx"),
    "F18_business_day": with_ctes("jobs", " SELECT id, CAST(created_at + INTERVAL 330 MINUTE AS DATE) AS day FROM jobs"),
    "F19_snapshot_defaults": with_ctes("narrated", """
, m AS (SELECT *, CASE WHEN k % 4 = 1 THEN concat('Ledger ', k % 9) WHEN k % 3 = 0 THEN 'Cash' ELSE 'Suspense' END AS ledger_name,
  CASE WHEN k % 5 = 0 THEN concat('00', k % 10000) WHEN k % 5 = 1 THEN lpad(CAST(k % 10000 AS STRING), 6, '0') END AS inst FROM narrated)
SELECT stmt_id, row_index, ledger_name, inst AS instrument_number, tx_date AS instrument_date, coalesce(nullif(reference, ''), inst) AS reference FROM m"""),
    "S7_format_sniffing": with_ctes("tx", """
SELECT stmt_id, row_index, CASE CAST(k % 9 AS INT) WHEN 0 THEN 'JSON' WHEN 1 THEN 'JSON' WHEN 2 THEN 'XML' WHEN 3 THEN 'XML' WHEN 4 THEN 'HTML' WHEN 5 THEN 'HTML' WHEN 6 THEN 'JSON' WHEN 7 THEN 'HTML' END AS format FROM tx"""),
    "S13_K3_xml_text": with_ctes("narrated", f"""
, raw AS (SELECT stmt_id, row_index, narration, {_RAW_XML} AS x FROM narrated)
SELECT stmt_id, row_index, concat('<STATE> Any "', narration, '''</STATE>&#65;<NAME>A & B</NAME>') AS clean, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM raw"""),
    "K4_K5_date_amount_text": with_ctes("tx", r"""
, amounts AS (SELECT *, CAST(CASE CAST(k % 3 AS INT) WHEN 0 THEN floor(debit + credit) WHEN 1 THEN floor((debit + credit) * 10) / 10 ELSE debit + credit END AS DECIMAL(15,2)) AS a FROM tx)
SELECT stmt_id, row_index, strftime(tx_date, '%Y%m%d') AS day, regexp_replace(regexp_replace(CAST(a AS STRING), '0+$', ''), '\.$', '') AS amount FROM amounts"""),
}

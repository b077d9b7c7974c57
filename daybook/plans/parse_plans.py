"""Registered queries on statement lines: segmentation, directions and bank detection, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import detect, directions, segment
from daybook.sources.fixtures import relation, with_ctes


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "lines")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.records(_lines(spark, sf_dir))


def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("doc_id", "record", "page_number", "date_text", F.size("source_lines").alias("n_lines"))


def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.parsed_records(_records(spark, sf_dir))
    amounts = F.array_join(F.transform("amounts", lambda x: x.cast("string")), " ")
    return found.select("doc_id", "record", "tx_date", amounts.alias("amounts"), "narration", "reference")


def r8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.zoned(_lines(spark, sf_dir), "^DATE PARTICULARS", "^STATEMENT SUMMARY", carries=True).select("doc_id", "page_number", "line_no")


def r9_r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = relation(spark, sf_dir, "narrated")
    text = F.concat(F.lit("B/F "), F.col("balance").cast("string"))
    head = F.concat(F.lit("Balance as on 1 Apr : INR "), F.col("balance").cast("string"))
    repaired = segment.repaired(F.concat(F.lit("O.OOCr "), F.col("credit").cast("string")))
    return tx.select("stmt_id", "row_index", segment.brought_forward(text).alias("brought"), segment.header_opening(head).alias("opening"), repaired.alias("repaired"))


def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all banks as they are, in other letters, with more words, and the banks of the jobs."""
    banks = relation(spark, sf_dir, "banks")
    said = banks.select(F.explode(F.array("bank_name", F.upper("bank_name"), F.concat("bank_name", F.lit(" Ltd")))).alias("name"))
    jobs = relation(spark, sf_dir, "jobs").select(F.col("bank_name").alias("name"))
    return detect.parser_for(said.union(jobs).distinct(), banks)


def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return segment.page_diagnostics(lines, segment.records(lines))


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.header_sample(_lines(spark, sf_dir)).select("doc_id", "line_no")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements as tables: a row of header cells and one row per transaction."""
    tx = relation(spark, sf_dir, "narrated")
    cells = F.array(F.date_format("tx_date", "dd/MM/yyyy"), "narration", F.col("debit").cast("string"), F.col("credit").cast("string"), F.coalesce(F.col("balance").cast("string"), F.lit("")))
    body = tx.select(F.col("stmt_id").alias("doc_id"), F.col("source_page").alias("page_number"), F.col("row_index").alias("row_no"), cells.alias("cells"))
    head = F.array(*[F.lit(x) for x in ("Date", "Narration", "Debit", "Credit", "Balance")])
    heads = tx.select(F.col("stmt_id").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(0).alias("row_no"), head.alias("cells")).distinct()
    return heads.union(body)


def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.table_rows(table_cells(spark, sf_dir))


def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.scanned_documents(_lines(spark, sf_dir), 200)


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where(~segment.is_noise(F.col("line"))).select("doc_id", "line_no", "page_number")


def _first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first page for every statement: by its number it names a bank, prints its branch code, its site and an account; every seventh names none."""
    docs = relation(spark, sf_dir, "tx").select(F.col("stmt_id").alias("doc_id")).distinct().withColumn("i", (F.col("doc_id") % 41).cast("int"))
    page = F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 0, F.col("bank_name")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("IFSC: "), "code", F.lit("0001234"))), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("www."), "site")),
                       F.when(F.col("doc_id") % 4 == 0, F.lit("Account No: 12345678901")), F.lit("Date Particulars Withdrawal Deposit Balance"), F.lit("01/04/2024 NEFT 5.00 10.00"))
    joined = docs.join(relation(spark, sf_dir, "banks"), F.col("i") == F.col("ord"))
    return joined.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "A statement").otherwise(page).alias("first_page"))


def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scores(_first_pages(spark, sf_dir), detect.signatures_of(relation(spark, sf_dir, "banks")))


def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _first_pages(spark, sf_dir)
    return detect.winners(docs, detect.scores(docs, detect.signatures_of(relation(spark, sf_dir, "banks"))))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = relation(spark, sf_dir, "narrated").where("balance IS NOT NULL")
    return tx.select("stmt_id", "row_index", (F.col("debit") + F.col("credit")).cast("decimal(15,2)").alias("amount"), "balance", F.col("narration").alias("text"))


def _directed(key: str):
    layout = directions.LAYOUTS.get(key, directions.GENERIC)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return directions.with_directions(_printed(spark, sf_dir), layout).select("stmt_id", "row_index", "is_debit")

    return run


#: Words of the two rules that ask for them, written out again: the SQL shares no constant with the operator.
_OUT = "(contains(up, 'ATM') OR contains(up, 'WITHDRAWAL') OR contains(up, 'CASH WDL') OR contains(up, 'CHARGES') OR contains(up, 'PAYMENT'))"
_OUT_SHORT = "(contains(up, 'DEBIT') OR contains(up, 'WDL') OR contains(up, 'ATM') OR contains(up, 'PAYMENT') OR contains(up, 'CHARGES'))"
_IN = "(contains(up, 'CREDIT') OR contains(up, 'DEPOSIT') OR contains(up, 'BY TRANSFER') OR contains(up, 'SALARY') OR contains(up, 'REFUND') OR contains(up, 'INTEREST RECEIVED') OR contains(up, 'INT RECD'))"
_IN_SECTION = "(contains(up, 'INTEREST CREDIT') OR contains(up, 'TRF FR'))"
_FALLS = "balance < prev"


def _directed_sql(first: str, unclear: str) -> str:
    return with_ctes("narrated", f"""
, printed AS (SELECT stmt_id, row_index, debit + credit AS amount, balance, upper(narration) AS up FROM narrated WHERE balance IS NOT NULL),
beside AS (SELECT *, lag(balance) OVER w AS prev, lead(amount) OVER w AS na, lead(balance) OVER w AS nb FROM printed WINDOW w AS (PARTITION BY stmt_id ORDER BY row_index))
SELECT stmt_id, row_index, coalesce(CASE WHEN prev IS NULL THEN {first} WHEN prev - amount = balance THEN true WHEN prev + amount = balance THEN false ELSE {unclear} END, false) AS is_debit FROM beside""")


_DIRECTED = {"W7_directions_pnb": "pnb_standard", "W8_directions_hdfc": "hdfc_standard", "W9_directions_icici": "icici_standard", "W10_directions_uco": "uco_standard", "W11_directions_kccb": "kccb_standard", "W12_directions_generic": "generic_standard"}

QUERIES = {
    "R1_R2_R5_records": r1, "R3_parsed_records": r3, "R8_zones": r8, "R9_R10_R11_printed_balances": r9_r11, "R14_parser_dispatch": r14, "R15_page_diagnostics": r15,
    "S2_header_sample": s2, "S3_R4_R6_table_rows": s3, "S4_scanned_documents": s4, "P1_noise_lines": p1, "J1_bank_scores": j1, "J2_bank_winner": j2,
} | {name: _directed(key) for name, key in _DIRECTED.items()}

_BANK_SCORES = r"""
, pages_of AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'A statement' ELSE concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN bank_name END, CASE WHEN doc_id % 3 = 0 THEN concat('IFSC: ', code, '0001234') END, CASE WHEN doc_id % 5 <> 0 THEN concat('www.', site) END,
    CASE WHEN doc_id % 4 = 0 THEN 'Account No: 12345678901' END) END AS head FROM (SELECT DISTINCT stmt_id AS doc_id FROM tx) AS s JOIN banks ON doc_id % 41 = ord),
met AS (SELECT doc_id, ord, bank_name, parser_key, regexp_matches(head, concat('(?i)\b', replace(bank_name, ' ', '\s+'), '\b')) AS named, code <> '' AND starts_with(regexp_extract(head, 'IFSC: ([A-Z0-9]+)', 1), concat(code, '0')) AS labeled,
    contains(lower(head), site) AS sited, nullif(regexp_extract(head, concat('Account No: ([0-9]{', digits, '})\b'), 1), '') AS account, regexp_extract(head, 'IFSC: ([A-Z0-9]+)', 1) AS code_said FROM pages_of CROSS JOIN banks),
scored AS (SELECT doc_id, ord, bank_name, parser_key, CAST((CASE WHEN named THEN 70 ELSE 0 END) + (CASE WHEN labeled THEN 65 ELSE 0 END) + (CASE WHEN sited THEN 35 ELSE 0 END) + (CASE WHEN account IS NOT NULL THEN 25 ELSE 0 END) AS DOUBLE) AS score,
    account, CASE WHEN labeled THEN code_said END AS ifsc FROM met)"""

ORACLES = {
    "R8_zones": with_ctes("lines", r"""
, marked AS (SELECT *, CASE WHEN starts_with(line, 'STATEMENT SUMMARY') THEN 0 WHEN starts_with(line, 'DATE PARTICULARS') THEN 1 END AS mark FROM lines),
told AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM marked)
SELECT doc_id, page_number, line_no FROM told WHERE state = 1 AND mark IS NULL"""),
    "R9_R10_R11_printed_balances": with_ctes("narrated", r"""
SELECT stmt_id, row_index, CASE WHEN balance IS NOT NULL THEN abs(balance) END AS brought, balance AS opening, concat('0.00Cr ', credit) AS repaired FROM narrated"""),
    "S2_header_sample": with_ctes("lines", " SELECT doc_id, line_no FROM lines WHERE page_number <= 3"),
    "S4_scanned_documents": with_ctes("lines", " SELECT doc_id, CAST(sum(length(trim(line))) AS BIGINT) AS chars, count(DISTINCT page_number) AS pages, sum(length(trim(line))) <= count(DISTINCT page_number) * 200 AS is_scanned FROM lines GROUP BY doc_id"),
    "W7_directions_pnb": _directed_sql(f"CASE WHEN nb IS NULL THEN {_OUT} ELSE balance - na <> nb AND balance + na <> nb END", _OUT),
    "W8_directions_hdfc": _directed_sql("CASE WHEN nb IS NULL THEN true ELSE nb < balance END", _FALLS),
    "W9_directions_icici": _directed_sql(_OUT_SHORT, _FALLS),
    "W10_directions_uco": _directed_sql("nb IS NOT NULL AND balance + na = nb", "true"),
    "W11_directions_kccb": _directed_sql(f"NOT {_IN_SECTION}", _FALLS),
    "W12_directions_generic": _directed_sql(f"NOT {_IN}", f"NOT {_IN}"),
    "P1_noise_lines": with_ctes("lines", r" SELECT doc_id, line_no, page_number FROM lines WHERE NOT regexp_matches(line, '(?i)^(page\s*(no|[0-9])|statement\s*(of\s*)?account|statement\s*summary)')"),
    "R1_R2_R5_records": with_ctes("narrated", """
SELECT stmt_id AS doc_id, CAST(row_index AS INT) AS record, CAST(floor(1 + row_index * 3 / 6) AS INT) AS page_number, strftime(tx_date, '%d/%m/%Y') AS date_text, CAST(1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_lines FROM narrated"""),
    "R3_parsed_records": with_ctes("narrated", r"""
, p AS (SELECT *, concat(narration, ' ', CAST(debit + credit AS STRING), CASE WHEN balance IS NULL THEN '' ELSE concat(' ', CAST(balance AS STRING), ' Cr') END, CASE WHEN k % 3 = 0 THEN concat(' CONTD ', narration) ELSE '' END) AS text,
  concat(narration, CASE WHEN balance IS NULL THEN '' ELSE ' Cr' END, CASE WHEN k % 3 = 0 THEN concat(' CONTD ', narration) ELSE '' END) AS words FROM narrated)
SELECT stmt_id AS doc_id, CAST(row_index AS INT) AS record, tx_date, concat_ws(' ', CAST(CAST(debit + credit AS DECIMAL(15,2)) AS STRING), CAST(balance AS STRING)) AS amounts, trim(regexp_replace(words, '\s+', ' ', 'g')) AS narration,
  coalesce(nullif(regexp_extract(text, '(?i)\bUPI/(?:CR|DR)?/?([0-9]{10,14})\b', 1), ''), nullif(regexp_extract(text, '(?i)\bIMPS/P2A/([0-9]{10,14})\b', 1), ''), nullif(regexp_extract(text, '(?i)\bNEFT/([A-Z0-9]{10,18})\b', 1), ''),
    nullif(regexp_extract(text, '(?i)\bRTGS/([A-Z0-9]{10,18})\b', 1), ''), regexp_extract(text, '(?i)\b(?:CHQ|CHEQUE|REF)[\s.:#]+([A-Za-z0-9]+)\b', 1)) AS reference FROM p"""),
    "R15_page_diagnostics": with_ctes("lines", r"""
, d AS (SELECT doc_id, page_number, count(*) FILTER (WHERE regexp_matches(line, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} ')) AS dated, count(*) FILTER (WHERE regexp_matches(line, '^(S[0-9]+ )?[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} ')) AS extracted FROM lines GROUP BY 1, 2)
SELECT doc_id, page_number, greatest(dated, extracted) AS detected, extracted, '' AS unparsed FROM d"""),
    "S3_R4_R6_table_rows": with_ctes("narrated", r"""
SELECT stmt_id AS doc_id, CAST(row_index AS INT) AS row_index, source_page AS page_number, strftime(tx_date, '%d/%m/%Y') AS date_str, CAST(NULL AS STRING) AS value_date_str, trim(regexp_replace(narration, '\s+', ' ', 'g')) AS narration, CAST(NULL AS STRING) AS reference_str,
  CAST(debit AS STRING) AS debit_str, CAST(credit AS STRING) AS credit_str, CAST(balance AS STRING) AS balance_str,
  [concat_ws(' ', strftime(tx_date, '%d/%m/%Y'), trim(regexp_replace(narration, '\s+', ' ', 'g')), CAST(debit AS STRING), CAST(credit AS STRING), CAST(balance AS STRING))] AS source_lines FROM narrated"""),
    "R14_parser_dispatch": with_ctes(("banks", "jobs"), """
, said AS (SELECT bank_name AS name FROM banks UNION SELECT upper(bank_name) FROM banks UNION SELECT concat(bank_name, ' Ltd') FROM banks UNION SELECT bank_name FROM jobs),
m AS (SELECT name, parser_key, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN lower(name) = lower(bank_name) THEN 0 ELSE 1 END, ord) AS place FROM said JOIN banks ON contains(lower(name), lower(bank_name)) OR contains(lower(bank_name), lower(name)))
SELECT said.name, coalesce(parser_key, 'generic_standard') AS parser_key FROM said LEFT JOIN m ON m.name = said.name AND place = 1"""),
    "J1_bank_scores": with_ctes(("tx", "banks"), _BANK_SCORES + " SELECT doc_id, ord, bank_name, parser_key, score, account, ifsc FROM scored WHERE score > 0"),
    "J2_bank_winner": with_ctes(("tx", "banks"), _BANK_SCORES + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM scored WHERE score > 0),
t AS (SELECT pages.doc_id, a.bank_name, a.parser_key, coalesce(a.score, 0) AS s, coalesce(a.score, 0) - coalesce(b.score, 0) AS m, a.account, a.ifsc, b.bank_name AS runner FROM (SELECT DISTINCT doc_id FROM pages_of) AS pages
  LEFT JOIN ranked a ON a.doc_id = pages.doc_id AND a.place = 1 LEFT JOIN ranked b ON b.doc_id = pages.doc_id AND b.place = 2),
u AS (SELECT *, CASE WHEN s < 40 THEN 'LOW' WHEN s >= 80 AND m >= 25 THEN 'HIGH' WHEN s >= 50 AND m >= 15 THEN 'MEDIUM' WHEN m < 15 THEN 'AMBIGUOUS' ELSE 'LOW' END AS tier FROM t)
SELECT doc_id, CASE WHEN tier IN ('HIGH', 'MEDIUM') THEN bank_name ELSE 'Unable to confidently identify' END AS bank_name, CASE WHEN tier IN ('HIGH', 'MEDIUM') THEN parser_key ELSE 'manual_selection_required' END AS parser_key,
  round(CASE WHEN s < 40 THEN 0 WHEN tier = 'HIGH' THEN least(99.0, greatest(85.0, 75.0 + m / 3.0)) WHEN tier = 'MEDIUM' THEN least(84.0, greatest(60.0, s)) WHEN tier = 'AMBIGUOUS' THEN 45.0 ELSE 30.0 END, 1) AS confidence,
  tier, tier NOT IN ('HIGH', 'MEDIUM') AS is_ambiguous, CASE WHEN s >= 40 AND account IS NOT NULL THEN concat('XXXX', right(account, 4)) END AS account_masked, CASE WHEN s >= 40 THEN ifsc END AS ifsc, CASE WHEN s >= 40 THEN runner END AS runner_up FROM u"""),
}

"""Registered queries on detection by all six kinds of signature, with SQL that tries every pattern on every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import detect
from daybook.sources.fixtures import BANKS, relation, with_ctes

# Two layouts of table heads and one marker that many banks share; the rest follows from a bank's own name, code and site.
COLUMNS = (r"Txn\s+Date.+Description.+Debit.+Credit.+Balance", r"Date.+Particulars.+Chq\s+No.+Withdrawal.+Deposit.+Balance")
HEADS = ("Txn Date Value Date Description Debit Credit Balance", "Date Particulars Chq No Withdrawal Deposit Balance")


def signature_rows() -> list[tuple[int, str, str, str, str]]:
    """(ord, bank_name, parser_key, kind, pattern) by rule for every bank."""
    out = []
    for i, (name, parser, code, site, digits) in enumerate(BANKS):
        rows = [("HEADER_NAME", r"\b" + r"\s+".join(name.split()) + r"\b"), ("DOMAIN", site), ("DOMAIN", f"net.{site.split('.')[0]}.example"), ("HEADER_MARKER", rf"{name.split()[0]}\s+Customer\s+Id\s*:"), ("COLUMN_PATTERN", COLUMNS[i % 2])]
        rows += [("HEADER_NAME", rf"\b{code}\s+ONLINE\b"), ("IFSC_PREFIX", f"{code}0")] if code else []
        rows += [("HEADER_MARKER", r"Drawing\s+Power\s*:")] if i % 2 == 0 else []
        rows += [("ACCOUNT_PATTERN", rf"(?:Account|A/c)\s*(?:No|Number)?\.?\s*:?\s*([0-9]{{{n}}})\b") for n in digits.split(",")]
        out += [(i, name, parser, kind, pattern) for kind, pattern in rows]
    return out


_HEAD = """CASE WHEN doc_id % 7 = 0 THEN 'A statement' ELSE concat_ws(chr(10), CASE WHEN doc_id % 2 = 0 THEN upper(bank_name) END, CASE WHEN doc_id % 3 = 0 THEN concat('IFSC: ', code, '0001234') END, CASE WHEN doc_id % 13 = 0 THEN concat('Branch ', code, '0004321') END,
    CASE WHEN doc_id % 5 = 0 THEN concat('www.', site) END, CASE WHEN doc_id % 5 = 1 THEN concat('net.', split_part(site, '.', 1), '.example') END, CASE WHEN doc_id % 11 = 0 THEN concat(code, ' Online') END, CASE WHEN doc_id % 4 = 1 THEN concat(split_part(bank_name, ' ', 1), '  customer id: 77') END,
    CASE WHEN doc_id % 9 = 0 THEN 'Drawing Power : 0.00' END, CASE WHEN doc_id % 6 < 2 THEN concat('Account No: ', substring('1234567890123456', 1, CAST(9 + doc_id % 8 AS INT))) END) END"""
_PAGES = f"""
, heads AS (SELECT doc_id, {_HEAD} AS head FROM (SELECT DISTINCT stmt_id AS doc_id FROM tx) AS s JOIN banks ON doc_id % 41 = ord),
pages_of AS (SELECT doc_id, head, CASE WHEN doc_id % 7 = 0 THEN head ELSE concat_ws(chr(10), head, CASE WHEN doc_id % 2 = 0 THEN '{HEADS[0]}' ELSE '{HEADS[1]}' END, '01/04/2024 NEFT 5.00 10.00') END AS first_page FROM heads)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages that show signatures of every kind, by their number."""
    tx, banks = relation(spark, sf_dir, "tx"), relation(spark, sf_dir, "banks")
    made = f"WITH {_PAGES.strip().removeprefix(',')} SELECT doc_id, first_page FROM pages_of"
    return spark.sql(made.replace("FROM tx", "FROM {tx}").replace("JOIN banks", "JOIN {banks}"), tx=tx, banks=banks)


def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.scores(pages(spark, sf_dir), detect.signatures_from(signature_rows()))


def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pages(spark, sf_dir)
    return detect.winners(docs, detect.scores(docs, detect.signatures_from(signature_rows()))).select("doc_id", "bank_name", "tier", F.col("confidence"), "runner_up")


QUERIES = {"J1_six_kinds": j1, "J2_six_kinds_winner": j2}

_QUOTED = ", ".join("({}, '{}', '{}', '{}', '{}')".format(*r[:1], *[str(x).replace("'", "''") for x in r[1:]]) for r in signature_rows())
_SCORED = (
    _PAGES
    + rf"""
, kinds(ord, bank_name, parser_key, kind, pattern) AS (VALUES {_QUOTED}),
tried AS (SELECT doc_id, ord, bank_name, parser_key, kind, pattern, CASE kind WHEN 'COLUMN_PATTERN' THEN regexp_matches(first_page, concat('(?i)', pattern)) WHEN 'DOMAIN' THEN contains(lower(head), pattern) WHEN 'IFSC_PREFIX' THEN regexp_matches(head, concat('(?i)\b', pattern, '[0-9A-Z]{{6}}\b'))
  ELSE regexp_matches(head, concat('(?i)', pattern)) END AS hit, CASE kind WHEN 'ACCOUNT_PATTERN' THEN nullif(regexp_extract(head, concat('(?i)', pattern), 1), '') END AS account,
  CASE kind WHEN 'IFSC_PREFIX' THEN nullif(regexp_extract(head, concat('(?i)\b(', pattern, '[0-9A-Z]{{6}})\b'), 1), '') END AS printed, CASE kind WHEN 'IFSC_PREFIX' THEN upper(regexp_extract(head, '(?i)IFSC[\s:-]+([A-Z0-9]+)', 1)) END AS labeled FROM pages_of CROSS JOIN kinds),
told AS (SELECT doc_id, ord, bank_name, parser_key, bool_or(hit) FILTER (WHERE kind = 'HEADER_NAME') AS named, bool_or(hit) FILTER (WHERE kind = 'DOMAIN') AS sited, count(*) FILTER (WHERE kind = 'HEADER_MARKER' AND hit) AS marks, bool_or(hit) FILTER (WHERE kind = 'COLUMN_PATTERN') AS columned,
  max(account) AS account, max(printed) AS printed, max(CASE WHEN starts_with(labeled, pattern) THEN labeled END) AS labeled FROM tried GROUP BY ALL),
scored AS (SELECT doc_id, ord, bank_name, parser_key, CAST((CASE WHEN named THEN 70 ELSE 0 END) + (CASE WHEN labeled IS NOT NULL THEN 65 WHEN printed IS NOT NULL THEN 50 ELSE 0 END) + (CASE WHEN sited THEN 35 ELSE 0 END) + 25 * marks + (CASE WHEN account IS NOT NULL THEN 25 ELSE 0 END)
  + (CASE WHEN columned THEN 30 ELSE 0 END) AS DOUBLE) AS score, account, coalesce(labeled, upper(printed)) AS ifsc FROM told)"""
)
ORACLES = {
    "J1_six_kinds": with_ctes(("tx", "banks"), _SCORED + " SELECT doc_id, ord, bank_name, parser_key, score, account, ifsc FROM scored WHERE score > 0"),
    "J2_six_kinds_winner": with_ctes(("tx", "banks"), _SCORED + """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM scored WHERE score > 0),
t AS (SELECT pages.doc_id, a.bank_name, coalesce(a.score, 0) AS s, coalesce(a.score, 0) - coalesce(b.score, 0) AS m, b.bank_name AS runner FROM (SELECT DISTINCT doc_id FROM pages_of) AS pages LEFT JOIN ranked a ON a.doc_id = pages.doc_id AND a.place = 1 LEFT JOIN ranked b ON b.doc_id = pages.doc_id AND b.place = 2),
u AS (SELECT *, CASE WHEN s < 40 THEN 'LOW' WHEN s >= 80 AND m >= 25 THEN 'HIGH' WHEN s >= 50 AND m >= 15 THEN 'MEDIUM' WHEN m < 15 THEN 'AMBIGUOUS' ELSE 'LOW' END AS tier FROM t)
SELECT doc_id, CASE WHEN tier IN ('HIGH', 'MEDIUM') THEN bank_name ELSE 'Unable to confidently identify' END AS bank_name, tier,
  round(CASE WHEN s < 40 THEN 0 WHEN tier = 'HIGH' THEN least(99.0, greatest(85.0, 75.0 + m / 3.0)) WHEN tier = 'MEDIUM' THEN least(84.0, greatest(60.0, s)) WHEN tier = 'AMBIGUOUS' THEN 45.0 ELSE 30.0 END, 1) AS confidence, CASE WHEN s >= 40 THEN runner END AS runner_up FROM u"""),
}

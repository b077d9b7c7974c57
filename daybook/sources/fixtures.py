"""Domain relations built from the driver's tables.

The tables hold no bank statements, so statements, narrations, charts of accounts
and jobs are derived from them by fixed rules. The rules are SQL that Spark and
DuckDB read alike; the operators under test are not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.storage import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents")

_TX_ROWS = """
SELECT o_custkey AS stmt_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS tx_date,
  CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS row_index,
  CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(15,2)) AS debit,
  CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(15,2)) AS credit
FROM orders
"""

_TX_BALANCED = """
SELECT *, CAST(SUM(credit - debit) OVER (PARTITION BY stmt_id ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(15,2)) AS true_balance
FROM tx_rows
"""

#: Every outcome of the audit occurs: missing, slightly off, inverted and far off balances; a third of the statements have no opening balance.
_TX = """
SELECT stmt_id, k, row_index, tx_date, debit, credit,
  CAST(CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN true_balance + 0.50 WHEN k % 13 = 0 THEN true_balance - 2 * (credit - debit)
       WHEN k % 17 = 0 THEN true_balance + 37 ELSE true_balance END AS DECIMAL(15,2)) AS balance,
  CAST(CASE WHEN stmt_id % 3 = 0 THEN NULL ELSE 0 END AS DECIMAL(15,2)) AS opening,
  CAST(floor(1 + row_index / 12) AS INT) AS source_page
FROM tx_balanced
"""

#: Statements of very different lengths: one holds a third of all rows, the others fifty. Movements are differences of a fixed value of the order, so true balances need no running sum.
_VALUE = "CAST(({k} * 7919 % 100003) * 0.01 AS DECIMAL(15,2))"
_LONG_TX = f"""
SELECT stmt_id, k, CAST(k AS INT) AS row_index, tx_date, CAST(greatest(-net, 0) AS DECIMAL(15,2)) AS debit, CAST(greatest(net, 0) AS DECIMAL(15,2)) AS credit,
  CAST(CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN {_VALUE.format(k="k")} + 0.50 WHEN k % 13 = 0 THEN {_VALUE.format(k="k")} - 2 * net WHEN k % 17 = 0 THEN {_VALUE.format(k="k")} + 37 ELSE {_VALUE.format(k="k")} END AS DECIMAL(15,2)) AS balance,
  CAST(CASE WHEN stmt_id % 3 = 0 THEN NULL ELSE {_VALUE.format(k="(50 * (stmt_id - 1) - 1)")} END AS DECIMAL(15,2)) AS opening
FROM (SELECT CASE WHEN o_orderkey * 3 < (SELECT count(*) FROM orders) THEN 0 ELSE 1 + CAST(floor(o_orderkey / 50) AS BIGINT) END AS stmt_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS tx_date,
  {_VALUE.format(k="o_orderkey")} - {_VALUE.format(k="(o_orderkey - 1)")} AS net FROM orders) AS moved
"""

def _supplier(number: str) -> str:
    """The name of a supplier: its number in four digits or more."""
    return f"concat('SUPPLIER ', lpad(CAST({number} AS STRING), CAST(greatest(4, length(CAST({number} AS STRING))) AS INT), '0'))"


#: Fifty parties more than there are suppliers, so some have no ledger.
_PARTY = _supplier("party_no")
_RRN = "lpad(CAST(k AS STRING), 12, '4')"

_NARRATED = f"""
SELECT stmt_id, k, row_index, tx_date, debit, credit, balance, opening, source_page,
  CASE CAST(k % 24 AS INT)
    WHEN 0 THEN concat('UPI/', {_RRN}, '/P2M/pay@okaxis/', {_PARTY})
    WHEN 1 THEN concat('NEFT/N', {_RRN}, '/', {_PARTY}, ' PVT LTD')
    WHEN 2 THEN concat('IMPS/P2A/', {_RRN}, '/', {_PARTY})
    WHEN 3 THEN concat('RTGS OUT : PUNBR', {_RRN}, ' : ', {_PARTY})
    WHEN 4 THEN concat('IZE ', lpad(CAST(k % 900000 + 100000 AS STRING), 6, '0'), ' Paid To : ', {_PARTY})
    WHEN 5 THEN 'ATM CASH WITHDRAWAL'
    WHEN 6 THEN 'CASH DEPOSIT BY SELF'
    WHEN 7 THEN 'SMS ALERT CHARGES'
    WHEN 8 THEN 'INT.PD ON OD ACCOUNT'
    WHEN 9 THEN 'INT.COLL ON SAVINGS ACCOUNT'
    WHEN 10 THEN concat('UPI -1 LAT/', {_RRN}, '/', {_PARTY}, ' LATENCY CTO610')
    WHEN 11 THEN concat('OWN ACCOUNT TRANSFER   TO ', {_PARTY})
    WHEN 12 THEN concat('CHQ: ', lpad(CAST(k % 900000 + 100000 AS STRING), 6, '0'), ' CLEARING')
    WHEN 13 THEN 'APY CONTRI JUNE'
    WHEN 14 THEN concat('GST: 18 PCT ', {_RRN})
    WHEN 15 THEN concat('/CHQ/', lpad(CAST(k % 900000 + 100000 AS STRING), 6, '0'), '/', {_PARTY})
    WHEN 16 THEN concat('27ABCDE', lpad(CAST(k % 40 AS STRING), 4, '0'), 'F1Z5 INVOICE')
    WHEN 17 THEN concat('PATANJALI ', {_PARTY}, '/', CAST(k AS STRING))
    WHEN 18 THEN concat('TREATMENT ', CAST(k % 9 AS STRING))
    WHEN 19 THEN concat('SBIN', {_RRN}, ' ADVANCE')
    WHEN 20 THEN 'RANDOM OBSCURE UNKNOWN PAYEE'
    WHEN 21 THEN concat('TRADERS - ', {_PARTY}, ' - SALARY')
    WHEN 22 THEN concat('IMPS-', {_RRN}, '-SUPPLIER ALPHA ', CAST(k % 5 AS STRING))
    ELSE concat('TRANSFER 10', lpad(CAST(k % 9000 AS STRING), 4, '0'), ' TO BRANCH')
  END AS narration,
  CASE WHEN k % 5 = 0 THEN lpad(CAST(k % 1000000 AS STRING), 6, '0') WHEN k % 5 = 1 THEN concat('CHQ-', lpad(CAST(k % 1000000 AS STRING), 6, '0')) WHEN k % 5 = 2 THEN '' ELSE NULL END AS reference
FROM (SELECT tx.*, k % (SELECT count(*) + 50 FROM supplier) AS party_no FROM tx) AS numbered
"""

_DIGITS = "lpad(CAST(s_suppkey AS STRING), CAST(greatest(4, length(CAST(s_suppkey AS STRING))) AS INT), '0')"

_LEDGERS = f"""
SELECT CAST(s_suppkey AS INT) AS ord,
  CASE WHEN s_suppkey % 4 = 1 THEN concat('Supplier ', {_DIGITS}, ' Pvt Ltd')
       WHEN s_suppkey % 10 = 6 THEN concat('SUPPLIER  ', {_DIGITS})
       ELSE concat('Supplier ', {_DIGITS}) END AS name,
  CASE WHEN s_suppkey % 9 = 0 THEN 'Bank Accounts' WHEN s_suppkey % 11 = 0 THEN 'Cash-in-Hand' WHEN s_suppkey % 13 = 0 THEN 'Bank Expense' ELSE n_name END AS grp,
  r_name AS parent_of_nation,
  CASE WHEN s_suppkey % 3 = 0 THEN concat('27ABCDE', lpad(CAST(s_suppkey % 40 AS STRING), 4, '0'), 'F1Z5') END AS gstin,
  CASE WHEN s_suppkey % 7 = 2 THEN concat('Supplier Alpha ', CAST(s_suppkey % 5 AS STRING)) END AS alias,
  CAST(CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal END AS DECIMAL(18,2)) AS opening_balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: One rule per part; most patterns stand in no narration, one in a hundred names a supplier.
_RULES = f"""
SELECT CAST(p_partkey AS INT) AS ord, CASE WHEN p_partkey = 3 THEN 'PATANJALI' WHEN p_partkey % 100 = 7 THEN {_supplier("p_partkey * 7 % (SELECT count(*) + 50 FROM supplier)")}
    WHEN p_partkey % 100 = 8 THEN concat({_supplier("p_partkey * 7 % (SELECT count(*) + 50 FROM supplier)")}, ' LATENCY') ELSE concat('PART ', CAST(p_partkey AS STRING), ' STORE') END AS pattern,
  concat(p_brand, ' A/C') AS ledger
FROM part
"""

_JOBS = """
SELECT event_id AS id, concat('User-', CAST(user_id AS STRING)) AS user_id, concat('user', CAST(user_id AS STRING), '@mail.example') AS user_email,
  concat('Bank ', CAST(user_id % 12 AS STRING)) AS bank_name,
  CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'FAILED' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'PARTIALLY_COMPLETED' WHEN 3 THEN 'AMBIGUOUS_BANK' WHEN 4 THEN 'QUOTA_EXHAUSTED' ELSE 'COMPLETED' END AS status,
  CAST(event_id % 40 + 1 AS INT) AS page_count,
  CAST(CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 30 END AS INT) AS pages_processed,
  CAST(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 20 END AS INT) AS free_quota_used,
  event_id % 9 = 3 OR event_id % 50 = 0 AS is_ambiguous,
  ts AS created_at
FROM events
"""

_USERS = """
SELECT concat('User-', CAST(c_custkey AS STRING)) AS id, concat('user', CAST(c_custkey AS STRING), '@mail.example') AS email, c_name AS full_name,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE concat('nick', CAST(c_custkey AS STRING)) END AS username,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('98', lpad(CAST(c_custkey AS STRING), 8, '0')) END AS mobile_number,
  CASE WHEN c_custkey % 17 = 0 THEN 'SUSPENDED' WHEN c_custkey % 23 = 0 THEN 'BLOCKED' ELSE 'ACTIVE' END AS account_status,
  CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, c_custkey % 41 = 0 AS is_unlimited,
  CAST(CASE WHEN c_custkey % 8 = 0 THEN c_custkey % 100 END AS INT) AS custom_quota, c_custkey AS registered
FROM customer
"""

_LINES = """
SELECT k AS doc_id, CAST(line_no AS INT) AS line_no, CAST(floor(1 + line_no / 6) AS INT) AS page_number, line FROM (
  SELECT stmt_id AS k, row_index * 3 AS line_no, concat(CASE WHEN k % 4 = 0 THEN concat('S', CAST(k AS STRING), ' ') ELSE '' END,
    lpad(CAST(EXTRACT(DAY FROM tx_date) AS STRING), 2, '0'), '/', lpad(CAST(EXTRACT(MONTH FROM tx_date) AS STRING), 2, '0'), '/', CAST(EXTRACT(YEAR FROM tx_date) AS STRING), ' ',
    narration, ' ', CAST(debit + credit AS STRING), CASE WHEN balance IS NULL THEN '' ELSE concat(' ', CAST(balance AS STRING), ' Cr') END) AS line FROM narrated
  UNION ALL SELECT stmt_id, row_index * 3 + 1, concat('CONTD ', narration) FROM narrated WHERE k % 3 = 0
  UNION ALL SELECT stmt_id, row_index * 3 + 2, concat('Page No: ', CAST(row_index AS STRING), ' of 9') FROM narrated WHERE k % 10 = 0
  UNION ALL SELECT stmt_id, 1, 'Statement of Account' FROM narrated WHERE row_index = 1
  UNION ALL SELECT stmt_id, 2, 'DATE PARTICULARS WITHDRAWAL DEPOSIT BALANCE' FROM narrated WHERE row_index = 1
  UNION ALL SELECT stmt_id, 100000, 'STATEMENT SUMMARY' FROM narrated WHERE row_index = 1
) AS every_line
"""

# Public names, parser keys, branch code beginnings, sites and lengths of account numbers of the banks that have a parser.
_BANK_ROWS = """
State Bank of India|sbi_standard|SBIN|onlinesbi.sbi|11
Punjab National Bank|pnb_standard|PUNB|pnbindia.in|16
HDFC Bank|hdfc_standard|HDFC|hdfcbank.com|14
ICICI Bank|icici_standard|ICIC|icicibank.com|12
Axis Bank|axis_standard|UTIB|axisbank.com|15
Kotak Mahindra Bank|kotak_standard|KKBK|kotak.com|10,14
Bank of Baroda|bob_standard|BARB|bankofbaroda.in|14
IDFC FIRST Bank|idfc_standard|IDFB|idfcfirstbank.com|10,14
YES Bank|yes_standard|YESB|yesbank.in|15
RBL Bank|rbl_standard|RATN|rblbank.com|10,16
DCB Bank|dcb_standard|DCBL|dcbbank.com|10,16
Union Bank of India|union_standard|UBIN|unionbankofindia.co.in|15
Canara Bank|canara_standard|CNRB|canarabank.com|13
Indian Bank|indian_standard|IDIB|indianbank.in|9,17
Indian Overseas Bank|iob_standard|IOBA|iob.in|15
Bank of India|boi_standard|BKID|bankofindia.co.in|15
Bank of Maharashtra|maharashtra_standard|MAHB|bankofmaharashtra.in|11
Central Bank of India|cbi_standard|CBIN|centralbankofindia.co.in|10
UCO Bank|uco_standard|UCBA|ucobank.com|14
Punjab & Sind Bank|psb_standard|PSIB|punjabandsindbank.co.in|14
IndusInd Bank|indusind_standard|INDB|indusind.com|12,14
IDBI Bank|idbi_standard|IBKL|idbibank.in|16
Federal Bank|federal_standard|FDRL|federalbank.co.in|14
Bandhan Bank|bandhan_standard|BDBL|bandhanbank.com|14
AU Small Finance Bank|au_standard|AUBL|aubank.in|16
City Union Bank|cub_standard|CIUB|cityunionbank.com|15
Karnataka Bank|karnataka_standard|KARB|karnatakabank.com|16
South Indian Bank|sib_standard|SIBL|southindianbank.com|16
Tamilnad Mercantile Bank|tmb_standard|TMBL|tmb.in|15
Jammu & Kashmir Bank|jkb_standard|JAKA|jkbank.com|16
CSB Bank|csb_standard|CSBK|csb.co.in|16
Dhanlaxmi Bank|dhanlaxmi_standard|DLXB|dhanbank.com|15
Nainital Bank|nainital_standard|NTBL|nainitalbank.co.in|16
Equitas Small Finance Bank|equitas_standard|ESFB|equitasbank.com|11,16
HSBC|hsbc_standard|HSBC|hsbc.co.in|9,12
DBS Bank|dbs_standard|DBSS|dbs.com|10,13
Deutsche Bank|deutsche_standard|DEUT|deutschebank.co.in|10,12
Barclays|barclays_standard|BARC|barclays.in|10,12
Kangra Central Co-operative Bank|kccb_standard|KACE|kccb.in|11
The Co-operative Bank|coop_standard||co-operativebank.co.uk|8
PayPal|paypal_standard||paypal.com|12
"""

#: (name, parser key, code, site, lengths of account numbers) of each bank, in order.
BANKS = [tuple(row.split("|")) for row in _BANK_ROWS.strip().split("\n")]

_BANKS = "SELECT * FROM (VALUES " + ", ".join(
    "({}, {})".format(i, ", ".join(f"'{x}'" for x in row.split("|"))) for i, row in enumerate(_BANK_ROWS.strip().split("\n"))
) + ") AS listed(ord, bank_name, parser_key, code, site, digits)"

#: In order: a relation may use those before it.
RELATIONS: dict[str, str] = {
    "tx_rows": _TX_ROWS,
    "tx_balanced": _TX_BALANCED,
    "tx": _TX,
    "long_tx": _LONG_TX,
    "narrated": _NARRATED,
    "ledgers": _LEDGERS,
    "rules": _RULES,
    "jobs": _JOBS,
    "users": _USERS,
    "lines": _LINES,
    "banks": _BANKS,
}
_NEEDS = {"tx_balanced": ("tx_rows",), "tx": ("tx_balanced",), "narrated": ("tx",), "lines": ("narrated",)}


def needed(*names: str) -> list[str]:
    """The named relations and those they use, in order."""
    want: set[str] = set()

    def add(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            add(x)
        want.add(name)

    for name in names:
        add(name)
    return [x for x in RELATIONS if x in want]


def ctes(*names: str) -> str:
    """The named relations as the beginning of a WITH clause."""
    return ", ".join(f"{x} AS ({RELATIONS[x].strip()})" for x in needed(*names))


def with_ctes(names: tuple[str, ...] | str, sql: str) -> str:
    """SQL on the named relations; ``sql`` may begin with further relations as ``, name AS (...)``."""
    names = (names,) if isinstance(names, str) else names
    body = sql.strip()
    return f"WITH {ctes(*names)} {body}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived relation as a DataFrame. Lines are made of six parts of the narrated rows, which are written once for all of them."""
    if name == "lines":
        narrated = relation(spark, sf_dir, "narrated").select("stmt_id", "k", "row_index", "tx_date", "narration", "debit", "credit", "balance")
        return spark.sql(_LINES.replace("FROM narrated", "FROM {narrated}"), narrated=written(narrated, "narrated"))
    sql = f"WITH {ctes(name)} SELECT * FROM {name}"
    used = [t for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql]
    frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{t_{t}}}").replace(f"JOIN {t}", f"JOIN {{t_{t}}}")
    return spark.sql(sql, **frames)

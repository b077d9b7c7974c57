"""Registered queries on whole statements, exported masters, files and status changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.scalars import decode_bytes
from daybook.operators import detect, files, masters, statements, usage
from daybook.plans.parse_plans import table_cells
from daybook.sources.fixtures import relation, with_ctes


def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction printed as one of six layouts, and every ninth as something else."""
    t = relation(spark, sf_dir, "narrated").where("balance IS NOT NULL")
    keys = list(statements.BANK_LINES)
    layout = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("k") % len(keys) + 1).cast("int"))
    dashed, slashed = F.date_format("tx_date", "dd-MM-yyyy"), F.date_format("tx_date", "dd/MM/yyyy")
    amount = F.format_string("%.2f", (F.col("debit") + F.col("credit")).cast("double"))
    bal = F.format_string("%.2f", F.abs("balance").cast("double"))
    line = (
        F.when(layout == "pnb_standard", F.concat_ws(" ", dashed, amount, bal, F.lit("Cr."), "narration"))
        .when(layout == "pnb_five_columns", F.concat_ws(" ", dashed, "narration", amount, F.lit("0.00"), bal))
        .when(layout == "hdfc_standard", F.concat_ws(" ", slashed, "narration", F.lpad(F.col("k").cast("string"), 12, "0"), slashed, amount, bal))
        .when(layout == "kccb_standard", F.concat_ws(" ", slashed, slashed, "narration", amount, F.concat(bal, F.lit("Cr"))))
        .otherwise(F.concat_ws(" ", dashed, "narration", amount, bal))
    )
    printed = t.select("stmt_id", "row_index", layout.alias("layout"), F.when(F.col("k") % 9 == 0, F.concat(F.lit("x"), line)).otherwise(line).alias("line"))
    return printed.select("stmt_id", "row_index", "layout", statements.bank_line(F.col("line"), F.col("layout")).alias("p")).select("stmt_id", "row_index", "layout", "p.*")


def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third statement has a table; all have lines."""
    t = relation(spark, sf_dir, "narrated").withColumnRenamed("stmt_id", "doc_id")
    table = t.where("doc_id % 3 = 0").select("doc_id", "row_index", (F.col("debit") + 1).cast("decimal(15,2)").alias("debit"), "credit")
    return statements.table_first(table, t.select("doc_id", "row_index", "debit", "credit", "source_page"))


def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daybook.operators import segment

    return statements.of_tables(segment.table_rows(table_cells(spark, sf_dir))).select("stmt_id", "row_index", "tx_date", "debit", "credit", "balance")


def w13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.filled_balances(relation(spark, sf_dir, "tx")).select("stmt_id", "row_index", "balance", "fill_status")


def convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: statements by number have tables or only lines, name a bank or none, and every tenth has a quota of two pages."""
    lines = relation(spark, sf_dir, "lines")
    banks = relation(spark, sf_dir, "banks")
    head = banks.select("ord", F.concat_ws(" ", "bank_name", F.concat(F.lit("www."), "site"), F.when(F.col("code") != "", F.concat(F.lit("IFSC: "), "code", F.lit("0001234")))).alias("line"))
    of_bank = lines.select("doc_id").distinct().withColumn("ord", (F.col("doc_id") % 41).cast("int")).join(head, "ord").where("doc_id % 7 <> 0")
    lines = lines.unionByName(of_bank.select("doc_id", F.lit(0).alias("line_no"), F.lit(1).alias("page_number"), "line"))
    tables = table_cells(spark, sf_dir).where("doc_id % 2 = 0")
    quota = lines.select("doc_id").distinct().where("doc_id % 10 = 0").select("doc_id", F.lit(2).alias("pages"))
    told, made = statements.convert(lines, tables, relation(spark, sf_dir, "ledgers").withColumnRenamed("parent_of_nation", "parent"), relation(spark, sf_dir, "rules"), quota, detect.signatures_of(banks))
    return made.join(told.select("stmt_id", "bank_name", "confidence_score"), "stmt_id").select("stmt_id", "row_index", "bank_name", "confidence_score", "voucher_type", "tx_date", "ledger_name", "debit", "credit", "balance", "validation_status")


_ESC = "replace(replace(name, '&', '&amp;'), '<', '&lt;')"


def _per_group(spark: SparkSession, sf_dir: str, element: str, begin: str, end: str, sep: str = "") -> DataFrame:
    """One file per nation's group of ledgers, with an element for each ledger in order."""
    rows = relation(spark, sf_dir, "ledgers").withColumn("element", F.expr(element))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "element"))), lambda x: x["element"]), sep)
    return rows.groupBy(F.col("grp").alias("file")).agg(F.concat(F.lit(begin), listed, F.lit(end)).alias("content"))


def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = """concat('<LEDGER NAME="', name, '"><PARENT>', grp, '</PARENT>', CASE WHEN opening_balance IS NULL THEN '' ELSE concat('<OPENINGBALANCE>', opening_balance, '</OPENINGBALANCE>') END,
      CASE WHEN gstin IS NULL THEN '' ELSE concat('<PARTYGSTIN>', gstin, '</PARTYGSTIN>') END, '<STATE>&#4; Any</STATE><LEDMAILINGDETAILS.LIST><PINCODE>', 100000 + ord, '</PINCODE><STATE>', parent_of_nation, '</STATE></LEDMAILINGDETAILS.LIST>',
      '<LANGUAGENAME.LIST><NAME.LIST><NAME>', name, '</NAME>', CASE WHEN alias IS NULL THEN '' ELSE concat('<NAME>', alias, '</NAME>') END, '</NAME.LIST></LANGUAGENAME.LIST></LEDGER>')"""
    content = _per_group(spark, sf_dir, element, "<ENVELOPE><GROUP NAME=\"Bank Accounts\"><PARENT>Current Assets</PARENT></GROUP>", "</ENVELOPE>")
    found = masters.xml_masters(content)
    return found.select("file", "ord", "name", "grp", "parent_group", "opening_balance", "gstin", "state", "pincode", F.array_join("aliases", "|").alias("aliases"))


def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's ledgers in one of four forms."""
    rows = relation(spark, sf_dir, "ledgers").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("l"))
    form = F.length("grp") % 4
    plain = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.concat(F.lit('"'), x["name"], F.lit('"'))), ","), F.lit("]"))
    objects = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: F.concat(F.lit('{"ledger_name":"'), x["name"], F.lit('","parent":"'), F.col("grp"), F.lit('"}'))), ","), F.lit("]"))
    mapping = F.concat(F.lit("{"), F.array_join(F.transform("l", lambda x: F.concat(F.lit('"'), x["name"], F.lit('":"'), F.col("grp"), F.lit('"'))), ","), F.lit("}"))
    content = F.when(form == 0, plain).when(form == 1, objects).when(form == 2, F.concat(F.lit('{"masters":'), objects, F.lit("}"))).otherwise(mapping)
    return masters.json_ledgers(rows.select(F.col("grp").alias("file"), content.alias("content")))


def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    element = "concat('<tr><td>', ord, '</td><td> <b>', name, '</b> &amp; Co</td><td>', CASE WHEN ord % 3 = 0 THEN '' ELSE grp END, '</td></tr>')"
    return masters.html_ledgers(_per_group(spark, sf_dir, element, "<table><tr><th>Sl No</th><th>Ledger Name</th></tr>", "</table>"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir)
    kind = F.col("doc_id") % 4
    body = F.when(kind == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(kind == 1, F.concat(F.lit("%PDF-1.4 /Encrypt "), "text")).when(kind == 2, F.col("text")).otherwise("")
    table = d.select(F.concat(F.lit("file-"), "doc_id").alias("path"), F.encode(body, "UTF-8").alias("content")).withColumn("length", F.octet_length("content").cast("long"))
    return files.checked(table, 6000)


def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8, UTF-8 with a mark, and UTF-16 of either order with a mark."""
    d = _documents(spark, sf_dir)
    kind = F.col("doc_id") % 4
    mark = lambda x: F.unhex(F.lit(x))
    as_ = lambda c: F.encode("text", c)
    content = F.when(kind == 0, as_("UTF-8")).when(kind == 1, F.concat(mark("EFBBBF"), as_("UTF-8"))).when(kind == 2, F.concat(mark("FFFE"), as_("UTF-16LE"))).otherwise(F.concat(mark("FEFF"), as_("UTF-16BE")))
    return d.select("doc_id", decode_bytes(content).alias("text")).select("doc_id", F.length("text").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def _temp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = relation(spark, sf_dir, "jobs")
    return jobs.select("id", "user_id", F.col("created_at").cast("timestamp").alias("modificationTime"), (F.col("page_count") * 1000).cast("long").alias("length"))


def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _temp_files(spark, sf_dir)
    newest = f.agg(F.max("modificationTime").alias("now"))  # one row
    return files.expired(f.crossJoin(F.broadcast(newest)), F.col("now")).select("id")


def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.storage_totals(_temp_files(spark, sf_dir), "user_id")


def u9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all jobs; every third changes once, every sixth twice."""
    j = relation(spark, sf_dir, "jobs")
    requests = j.select("id", F.lit("PENDING").alias("status"), "page_count", F.lit(None).cast("int").alias("granted"), F.lit("new").alias("notes"), F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("int").alias("approved_at"), F.lit(0).alias("updated_at"))
    change = lambda rows, status, granted, at: rows.select("id", F.lit(status).alias("status"), F.lit(granted).cast("int").alias("granted"), F.concat(F.lit(f"{status} "), "id").alias("notes"), F.lit("admin").alias("by"), F.lit(at).alias("at"))
    changes = change(j.where("id % 3 = 0"), "APPROVED", 40, 1).unionByName(change(j.where("id % 6 = 0"), "REJECTED", None, 2))
    return usage.transitioned(requests, changes)


def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.admitted(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts"))


QUERIES = {
    "R7_bank_lines": r7, "R12_table_transactions": r12, "R13_table_first": r13, "W13_filled_balances": w13, "E2E_conversion": convert, "S8_xml_masters": s8, "S9_json_ledgers": s9, "S10_html_ledgers": s10,
    "S5_file_checks": s5, "S6_decoded_files": s6, "T7_expired_files": t7, "A16_storage_totals": a16, "U9_status_transitions": u9, "T4_admission": t4,
}

_TEXT = ", d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"

ORACLES = {
    "R7_bank_lines": with_ctes("narrated", r"""
, p AS (SELECT *, CAST(k % 6 AS INT) AS kind, strftime(tx_date, '%d-%m-%Y') AS d1, strftime(tx_date, '%d/%m/%Y') AS d2, printf('%.2f', (debit + credit)::DOUBLE) AS a, printf('%.2f', abs(balance)::DOUBLE) AS b, regexp_replace(narration, '^\s+|\s+$', '', 'g') AS n FROM narrated WHERE balance IS NOT NULL),
good AS (SELECT stmt_id, row_index, kind, k % 9 <> 0 AS ok, d1, d2, a, b, n, lpad(CAST(k AS STRING), 12, '0') AS ref FROM p)
SELECT stmt_id, row_index, CASE kind WHEN 0 THEN 'pnb_standard' WHEN 1 THEN 'pnb_five_columns' WHEN 2 THEN 'hdfc_standard' WHEN 3 THEN 'icici_standard' WHEN 4 THEN 'uco_standard' ELSE 'kccb_standard' END AS layout,
  CASE WHEN ok THEN CASE WHEN kind IN (2, 5) THEN d2 ELSE d1 END END AS date, CASE WHEN ok AND kind IN (2, 5) THEN d2 END AS value_date, CASE WHEN ok THEN n END AS narration, CASE WHEN ok AND kind = 2 THEN ref END AS reference,
  CASE WHEN ok AND kind <> 1 THEN a END AS amount, CASE WHEN ok AND kind = 1 THEN a END AS debit, CASE WHEN ok AND kind = 1 THEN '0.00' END AS credit, CASE WHEN ok THEN CASE WHEN kind = 5 THEN concat(b, 'Cr') ELSE b END END AS balance FROM good"""),
    "R12_table_transactions": with_ctes("narrated", " SELECT stmt_id, row_index, tx_date, debit, credit, balance FROM narrated"),
    "R13_table_first": with_ctes("narrated", """
SELECT stmt_id AS doc_id, row_index, CAST(CASE WHEN stmt_id % 3 = 0 THEN debit + 1 ELSE debit END AS DECIMAL(15,2)) AS debit, credit, CASE WHEN stmt_id % 3 = 0 THEN 'table' ELSE 'text' END AS source, CASE WHEN stmt_id % 3 <> 0 THEN source_page END AS source_page FROM narrated"""),
    "W13_filled_balances": with_ctes("tx", """
, m AS (SELECT *, sum(credit - debit) OVER w AS moved FROM tx WINDOW w AS (PARTITION BY stmt_id ORDER BY row_index)),
p AS (SELECT *, (SELECT m2.balance - m2.moved FROM m AS m2 WHERE m2.stmt_id = m.stmt_id AND m2.row_index < m.row_index AND m2.balance IS NOT NULL ORDER BY m2.row_index DESC LIMIT 1) AS anchor FROM m)
SELECT stmt_id, row_index, CAST(coalesce(balance, coalesce(anchor, opening) + moved) AS DECIMAL(15,2)) AS balance, CASE WHEN balance <> coalesce(anchor, opening) + moved THEN 'WARNING' ELSE 'VALID' END AS fill_status FROM p"""),
    "S8_xml_masters": with_ctes("ledgers", r"""
SELECT grp AS file, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS INT) AS ord, regexp_replace(name, '\s+', ' ', 'g') AS name, grp, CASE WHEN grp = 'Bank Accounts' THEN 'Current Assets' ELSE grp END AS parent_group, opening_balance, gstin,
  parent_of_nation AS state, CAST(100000 + ord AS STRING) AS pincode, coalesce(alias, '') AS aliases FROM ledgers"""),
    "S9_json_ledgers": with_ctes("ledgers", r"""
SELECT grp AS file, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) - 1 AS INT) AS ord, regexp_replace(name, '\s+', ' ', 'g') AS name, CASE WHEN length(grp) % 4 = 0 THEN 'Primary' ELSE grp END AS grp FROM ledgers"""),
    "S10_html_ledgers": with_ctes("ledgers", r"""
SELECT grp AS file, CAST(row_number() OVER (PARTITION BY grp ORDER BY ord) AS INT) AS ord, concat(regexp_replace(name, '\s+', ' ', 'g'), ' & Co') AS name, CASE WHEN ord % 3 = 0 THEN 'Primary' ELSE grp END AS grp FROM ledgers"""),
    "S5_file_checks": "WITH" + _TEXT[1:] + """
, b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('%PDF-1.7 ', text) WHEN 1 THEN concat('%PDF-1.4 /Encrypt ', text) WHEN 2 THEN text ELSE '' END AS body FROM d)
SELECT concat('file-', doc_id) AS path, strlen(body) AS length, CASE WHEN body = '' THEN 'EMPTY' WHEN strlen(body) > 6000 THEN 'TOO_LARGE' WHEN NOT starts_with(body, '%PDF-') THEN 'NOT_A_STATEMENT' WHEN contains(body, '/Encrypt') THEN 'LOCKED' ELSE 'OK' END AS status FROM b""",
    "S6_decoded_files": "WITH" + _TEXT[1:] + " SELECT doc_id, CAST(length(text) AS INT) AS chars, md5(text) AS digest FROM d",
    "T7_expired_files": with_ctes("jobs", " SELECT id FROM jobs WHERE created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 60 MINUTE"),
    "A16_storage_totals": with_ctes("jobs", " SELECT user_id, count(*) AS n_files, CAST(sum(page_count) * 1000 AS BIGINT) AS n_bytes FROM jobs GROUP BY user_id"),
    "U9_status_transitions": with_ctes("jobs", """
SELECT id, CASE WHEN id % 6 = 0 THEN 'REJECTED' WHEN id % 3 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS status, page_count, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 40 END AS granted,
  CASE WHEN id % 6 = 0 THEN concat('REJECTED ', id) WHEN id % 3 = 0 THEN concat('APPROVED ', id) ELSE 'new' END AS notes, CASE WHEN id % 3 = 0 THEN 'admin' END AS approved_by, CASE WHEN id % 3 = 0 AND id % 6 <> 0 THEN 1 END AS approved_at,
  CASE WHEN id % 6 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS updated_at FROM jobs"""),
    "T4_admission": """
WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS n FROM events),
w(user_id, event_id, n, is_admitted, times) AS (
  SELECT user_id, event_id, n, true, [s] FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, q.yes, CASE WHEN q.yes THEN list_append(q.kept, e.s) ELSE q.kept END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1,
    LATERAL (SELECT r.kept, len(r.kept) < 3 AND coalesce(e.s - r.kept[-1] >= 60, true) AS yes FROM (SELECT list_filter(w.times, lambda t: e.s - t < 600) AS kept) AS r) AS q)
SELECT user_id, event_id, is_admitted FROM w""",
}

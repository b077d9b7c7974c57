"""Registered queries on statement files: statements are printed as files, and their pages read by the source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import vouchers
from daybook.plans import voucher_plans
from daybook.sources import pdf, workbook
from daybook.sources.fixtures import relation, with_ctes
from daybook.storage import run_folder, save_archives


#: Bytes of an archive of files, and about those of a task that reads them.
ARCHIVE = 4 << 20


def printed_files(spark: SparkSession, sf_dir: str) -> str:
    """Every statement as a file of its pages, in archives; returns the folder."""
    line = relation(spark, sf_dir, "lines")
    in_order = lambda c, of: F.transform(F.array_sort(F.collect_list(F.struct(c, of))), lambda x: x[of])
    pages = line.groupBy("doc_id", "page_number").agg(in_order("line_no", "line").alias("page"))
    whole = pages.groupBy("doc_id").agg(in_order("page_number", "page").alias("pages"))

    folder = f"{run_folder(spark)}/statements-{uuid.uuid4().hex}"
    named = whole.select(F.format_string("statement-%d.pdf", "doc_id").alias("name"), "pages")
    save_archives(named, folder, lambda row: pdf.document_of(row["pages"]), ARCHIVE)
    return folder


def _pages(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    pdf.register(spark)
    read = spark.read.format("statement_pages").options(path=printed_files(spark, sf_dir), task_bytes=ARCHIVE + (1 << 20), **options).load()
    return read.withColumn("doc_id", F.regexp_extract("path", r"statement-([0-9]+)\.pdf$", 1).cast("long"))


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).select("doc_id", "page_number", F.posexplode("lines").alias("place", "line"))
    return rows.select("doc_id", "page_number", (F.col("place") + 1).alias("line_no"), "line")


def s1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 and 3 only: the filter is pushed to the source."""
    return _pages(spark, sf_dir).where("page_number BETWEEN 2 AND 3").select("doc_id", "page_number", "n_pages", "n_chars", F.element_at("lines", 1).alias("first_line"))


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of every file, as bank detection needs them."""
    return _pages(spark, sf_dir, header_pages=3).select("doc_id", "page_number", F.array_join("lines", "\n").alias("text"))


def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on pages: files beyond it are one row without a page."""
    return _pages(spark, sf_dir, most_pages=6, header_pages=1).select("doc_id", "n_pages", "status")


def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement's sheet written as a workbook and read again: the cells as texts."""
    sheet = vouchers.sheet(voucher_plans.vouched(spark, sf_dir))
    folder = f"{run_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    workbook.save_workbooks(spark, workbook.in_workbooks(sheet, "statement", "stmt_id", "VOUCHER NO."), folder, ARCHIVE)
    rows = workbook.read_workbooks(spark, folder).where("row > 1")
    cell = lambda k: F.get("cells", F.lit(k))
    day = lambda k: F.date_add(F.lit("1899-12-30").cast("date"), cell(k).cast("int"))
    money = lambda k: cell(k).cast("decimal(15,2)")
    stmt = F.regexp_extract("file", r"statement-([0-9]+)\.xlsx", 1).cast("long")
    values = (cell(0).cast("int"), cell(1), day(2), cell(3), cell(4), cell(5), cell(6), day(7), money(8), money(9), money(10))
    return rows.select(stmt.alias("stmt_id"), *[v.alias(n) for n, v in zip(vouchers.SHEET_COLUMNS, values, strict=True)])


def k1_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in parts of four vouchers."""
    return vouchers.document_parts(vouchers.voucher_xml(voucher_plans.vouched(spark, sf_dir)), 4)


QUERIES = {"K1_document_parts": k1_parts, "K2_workbooks": k2, "S1_page_lines": s1, "S1_page_range": s1_range, "S2_file_header_sample": s2, "S5_page_cap": s5}

_PAGES = """
, told AS (SELECT doc_id, line_no, line, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY page_number) AS INT) AS page FROM lines),
placed AS (SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS INT) AS line_no, trim(line) AS line FROM told),
paged AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text, CAST(sum(length(line)) AS INT) AS n_chars, first(line ORDER BY line_no) AS first_line FROM placed GROUP BY 1, 2),
counted AS (SELECT doc_id, CAST(count(*) AS INT) AS n_pages FROM paged GROUP BY 1)"""
_PARTS = """
, frags AS ({xml}), blocks AS (SELECT stmt_id, (row_index - 1) // 4 AS block, string_agg(fragment, '' ORDER BY row_index) AS body FROM frags GROUP BY 1, 2),
placed AS (SELECT stmt_id, body, CAST(row_number() OVER (PARTITION BY stmt_id ORDER BY block) AS INT) AS part, CAST(count(*) OVER (PARTITION BY stmt_id) AS INT) AS n_parts FROM blocks)
SELECT stmt_id, part, n_parts, concat(CASE WHEN part = 1 THEN '<?xml version="1.0" encoding="utf-8"?><ENVELOPE><BODY>' ELSE '' END, body, CASE WHEN part = n_parts THEN '</BODY></ENVELOPE>' ELSE '' END) AS text FROM placed"""
ORACLES = {
    # the fragments' SQL ends in one SELECT, which becomes a relation of its own
    "K1_document_parts": (lambda x: x[: x.rindex("SELECT")] + _PARTS.lstrip().format(xml=x[x.rindex("SELECT") :]))(voucher_plans.ORACLES["K1_voucher_xml"]),
    "K2_workbooks": voucher_plans.ORACLES["K2_sheet"],
    "S1_page_lines": with_ctes("lines", _PAGES + " SELECT doc_id, page AS page_number, line_no, line FROM placed"),
    "S1_page_range": with_ctes("lines", _PAGES + " SELECT doc_id, page AS page_number, n_pages, n_chars, first_line FROM paged JOIN counted USING (doc_id) WHERE page BETWEEN 2 AND 3"),
    "S2_file_header_sample": with_ctes("lines", _PAGES + " SELECT doc_id, page AS page_number, text FROM paged WHERE page <= 3"),
    "S5_page_cap": with_ctes("lines", _PAGES + " SELECT doc_id, n_pages, CASE WHEN n_pages > 6 THEN 'TOO_MANY_PAGES' ELSE 'OK' END AS status FROM counted"),
}

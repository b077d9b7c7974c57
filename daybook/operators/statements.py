"""Whole statements: lines as single banks print them, tables first and lines second, balances filled, and the chain from lines to vouchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.entities import cash_type, instrument_number
from daybook.functions.scalars import clean_narration, normalize_amount, normalize_date
from daybook.operators import balance, blocks, detect, directions, ledgers, segment, vouchers
from daybook.operators.directions import MONEY
from daybook.storage import written_sized

# A transaction's line as each bank prints it, and which group holds what.
BANK_LINES = {
    "pnb_standard": (r"(?i)^([0-9]{2}[-/][0-9]{2}[-/][0-9]{4})\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})\s+(?:Cr|Dr)\.?(.*)", {"date": 1, "amount": 2, "balance": 3, "narration": 4}),
    "pnb_five_columns": (r"^([0-9]{2}[-/][0-9]{2}[-/][0-9]{4})\s+(.+?)\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})$", {"date": 1, "narration": 2, "debit": 3, "credit": 4, "balance": 5}),
    "hdfc_standard": (
        r"^([0-9]{2}/[0-9]{2}/[0-9]{2,4})\s+(.+?)\s+(?:([0-9]{10,20}|[A-Za-z0-9]{8,20})\s+)?([0-9]{2}/[0-9]{2}/[0-9]{2,4})\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})$",
        {"date": 1, "narration": 2, "reference": 3, "value_date": 4, "amount": 5, "balance": 6},
    ),
    "icici_standard": (r"^([0-9]{2}-[0-9]{2}-[0-9]{4})\b\s*(.*?)\s*([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})$", {"date": 1, "narration": 2, "amount": 3, "balance": 4}),
    "uco_standard": (r"^([0-9]{2}-[0-9]{2}-[0-9]{4})\s+(.+?)\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2})$", {"date": 1, "narration": 2, "amount": 3, "balance": 4}),
    "kccb_standard": (
        r"^([0-9]{2}/[0-9]{2}/[0-9]{2,4})\s+([0-9]{2}/[0-9]{2}/[0-9]{2,4})\s+(.+?)\s+([0-9,]+\.[0-9]{2})\s+([0-9,]+\.[0-9]{2}(?:Cr|Dr)?)$",
        {"date": 1, "value_date": 2, "narration": 3, "amount": 4, "balance": 5},
    ),
}
PARTS = ("date", "value_date", "narration", "reference", "amount", "debit", "credit", "balance")


def bank_line(line: Column, layout: Column) -> Column:
    """A line's parts by its layout (a parser key), as struct of texts; null if the line is no transaction of that layout."""
    out = F.lit(None).cast("struct<" + ",".join(f"{p}:string" for p in PARTS) + ">")
    for key, (pattern, groups) in BANK_LINES.items():
        parts = [(F.nullif(F.trim(F.regexp_extract(line, pattern, groups[p])), F.lit("")) if p in groups else F.lit(None).cast("string")).alias(p) for p in PARTS]
        out = F.when((layout == key) & line.rlike(pattern), F.struct(*parts)).otherwise(out)
    return out


def table_first(table_rows: DataFrame, text_rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the tables, and for documents whose tables gave none the rows of their lines. ``source`` tells which."""
    without = text_rows.join(table_rows.select(key).distinct(), key, "left_anti")
    return table_rows.withColumn("source", F.lit("table")).unionByName(without.withColumn("source", F.lit("text")), allowMissingColumns=True)


def filled_balances(tx: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Missing balances set to what the rows before give; a printed balance that differs is a WARNING. Rows before the first known balance stay as they are.

    ``opening``: the statement's opening balance, or null. ``block_rows``: as in the audit, for statements that no single task can hold.
    """
    net = (F.col("credit") - F.col("debit")).cast(balance.WIDE)
    if block_rows:
        moved = balance.carried_over_blocks(tx, net, block_rows)
        before = F.coalesce(F.col("local_anchor"), F.col("before_anchor") + F.col("before_moved"), F.col("first.opening") + F.col("before_moved"))
        expected = (before + F.col("local_moved")).cast(MONEY)
    else:
        w = balance.in_order()
        moved = tx.withColumn("moved", F.sum(net).over(blocks.so_far(w)))
        anchor = F.coalesce(blocks.last_known(F.col("balance") - F.col("moved"), w), F.first("opening").over(w))
        expected = (anchor + F.col("moved")).cast(MONEY)
    status = F.when(F.col("balance").isNotNull() & (expected != F.col("balance")), "WARNING").otherwise("VALID")
    return moved.select(*tx.columns, F.coalesce("balance", expected).alias("filled"), status.alias("fill_status")).withColumn("balance", F.col("filled")).drop("filled")


def of_text(lines: DataFrame) -> DataFrame:
    """Transactions of lines: records, their amounts, and sides by the balance before."""
    parsed = directions.previous_printed(segment.parsed_records(segment.records(lines)))
    sided = directions.from_amounts(parsed)
    return sided.select(F.col("doc_id").alias("stmt_id"), F.col("record").alias("row_index"), "tx_date", "narration", "reference", "debit", "credit", "balance", F.col("page_number").alias("source_page"))


def of_tables(rows: DataFrame) -> DataFrame:
    """Transactions of table rows: their texts made dates, amounts and narrations. Rows without a readable date are dropped."""
    amount = lambda c: F.when(F.col(c).isNotNull(), normalize_amount(F.col(c)))
    zero = F.lit(0).cast(MONEY)
    told = rows.select(
        F.col("doc_id").alias("stmt_id"), "row_index", normalize_date(F.col("date_str")).alias("tx_date"), clean_narration(F.col("narration")).alias("narration"), F.coalesce("reference_str", F.lit("")).alias("reference"),
        F.coalesce(amount("debit_str"), zero).alias("debit"), F.coalesce(amount("credit_str"), zero).alias("credit"), amount("balance_str").alias("balance"), F.col("page_number").alias("source_page"),
    )
    return told.where("tx_date IS NOT NULL")


def convert(lines: DataFrame, tables: DataFrame, chart: DataFrame, rules: DataFrame, allowed_pages: DataFrame, signatures: tuple[detect.Signature, ...]) -> tuple[DataFrame, DataFrame]:
    """(statements, vouchers): the whole way from a document's lines and tables to vouchers.

    Pages beyond a document's quota (``allowed_pages``: doc_id, pages) are left
    out; the bank is detected on the first page; transactions come from tables,
    else from lines; statements are put in order of time, audited, matched to
    ledgers and made vouchers. Statements: bank, tier, totals and confidence.
    """
    quota = lambda rows: rows.join(allowed_pages, "doc_id", "left").where(F.coalesce(F.col("page_number") <= F.col("pages"), F.lit(True))).drop("pages")
    lines, tables = quota(lines), quota(tables)
    firsts = lines.where("page_number = 1").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("first_page"))
    banks = detect.winners(firsts, detect.scores(firsts, signatures)).select(F.col("doc_id").alias("stmt_id"), "bank_name", "parser_key", "tier")
    tx = table_first(of_tables(segment.table_rows(tables)), of_text(lines), "stmt_id").withColumn("opening", F.lit(None).cast(MONEY))
    ordered = balance.in_chronology(written_sized(tx, "transactions"))
    tx = ordered.select("stmt_id", F.col("new_index").alias("row_index"), "tx_date", "narration", "reference", "debit", "credit", "balance", "source_page", "source", F.col("new_opening").alias("opening"))
    audited = written_sized(balance.audit(tx), "audited")
    matched = ledgers.match(audited, chart, rules)
    typed = matched.withColumn("voucher_type", vouchers.voucher_type(F.col("narration"), F.col("debit"), F.col("credit")))
    number = instrument_number(F.col("narration"), F.col("reference"))
    ready = typed.withColumns({"cheque_number": number, "instrument_number": number, "instrument_date": F.lit(None).cast("date"), "is_cash_transaction": cash_type(F.col("narration"), F.col("debit") > 0).isNotNull()})
    return balance.statement_summary(audited).join(banks, "stmt_id", "left"), vouchers.snapshot(ready)



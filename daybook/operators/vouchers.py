"""Vouchers: classification, snapshot, invariants, double entry, export forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.entities import cash_type
from daybook.functions.scalars import amount_text, compact_date, filename_part, nothing_if_blank, xml_escape

MONEY = "decimal(15,2)"
VOUCHER_TYPES = ("Payment", "Receipt", "Contra", "Journal")

# The sheet's columns in order.
SHEET_COLUMNS = (
    "VOUCHER NO.", "VOUCHER TYPE", "VOUCHER DATE", "VOUCHER NARRATION", "LEDGER NAME", "BANK LEDGER",
    "INST. NUMBER", "INST. DATE", "DEBIT AMOUNT", "CREDIT AMOUNT", "BALANCE",
)


def voucher_type(narration: Column, debit: Column, credit: Column, edited: Column | None = None, original: Column | None = None) -> Column:
    """A type the user changed stays; own transfers and cash are Contra; else by the net direction (a tie is a Receipt, nothing a Payment)."""
    up = F.upper(narration)
    own = up.contains("INTERNAL TRANSFER") | up.contains("OWN ACCOUNT TRANSFER")
    by_side = F.when((debit > 0) & (credit > 0), F.when(debit > credit, "Payment").otherwise("Receipt")).when(credit > 0, "Receipt").otherwise("Payment")
    ruled = F.when(own, "Contra").when(cash_type(narration, debit > 0).isNotNull(), "Contra").otherwise(by_side)
    if edited is None or original is None:
        return ruled
    return F.when((F.coalesce(original, F.lit("")) != "") & (edited != original), edited).otherwise(ruled)


def snapshot(tx: DataFrame, bank: str = "Bank Account", cash: str = "Cash") -> DataFrame:
    """The vouchers to export: numbered 1..N per statement, defaults filled in.

    A blank ledger is the cash ledger for cash and Suspense otherwise; the
    instrument is the instrument or the cheque number.
    """
    number = F.row_number().over(Window.partitionBy("stmt_id").orderBy("row_index"))
    given = nothing_if_blank(F.col("ledger_name"))
    instrument = nothing_if_blank(F.coalesce(F.nullif(F.col("instrument_number"), F.lit("")), F.col("cheque_number")))
    return tx.select(
        "stmt_id",
        number.alias("row_index"),
        F.coalesce(F.nullif(F.col("voucher_type"), F.lit("")), F.lit("Payment")).alias("voucher_type"),
        "tx_date",
        F.coalesce("narration", F.lit("")).alias("narration"),
        F.coalesce(given, F.when(F.col("is_cash_transaction"), F.lit(cash)), F.lit("Suspense")).alias("ledger_name"),
        F.lit(bank.strip()).alias("bank_ledger_name"),
        instrument.alias("instrument_number"),
        F.coalesce("instrument_date", "tx_date").alias("instrument_date"),
        F.coalesce("debit", F.lit(0)).cast(MONEY).alias("debit"),
        F.coalesce("credit", F.lit(0)).cast(MONEY).alias("credit"),
        "balance",
        "is_cash_transaction",
        F.coalesce(F.nullif(F.col("reference"), F.lit("")), instrument).alias("reference"),
        F.coalesce("validation_status", F.lit("VALID")).alias("validation_status"),
    )


def invariant_breaks(vouchers: DataFrame) -> DataFrame:
    """One row per broken invariant: (stmt_id, row_index, rule)."""
    place = F.row_number().over(Window.partitionBy("stmt_id").orderBy("row_index"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = (
        ("MISSING_BANK_LEDGER", blank("bank_ledger_name")),
        ("NON_SEQUENTIAL_NUMBER", F.col("row_index") != F.col("place")),
        ("INVALID_VOUCHER_TYPE", ~F.col("voucher_type").isin(*VOUCHER_TYPES)),
        ("MISSING_DATE", F.col("tx_date").isNull()),
        ("MISSING_NARRATION", blank("narration")),
        ("MISSING_LEDGER", blank("ledger_name")),
        ("NEGATIVE_AMOUNT", (F.col("debit") < 0) | (F.col("credit") < 0)),
        ("ZERO_AMOUNTS", (F.col("debit") == 0) & (F.col("credit") == 0)),
        ("BALANCE_ERROR", F.col("validation_status") == "ERROR"),
    )
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))
    return vouchers.withColumn("place", place).select("stmt_id", "row_index", F.explode(found).alias("rule"))


def entries(vouchers: DataFrame) -> DataFrame:
    """Two signed legs per voucher with an amount: the credited leg first and positive, the debited one negative.

    The bank leg carries the instrument. Journal vouchers have no legs.
    """
    amount = F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.col("credit"))
    inward = (F.col("voucher_type") == "Receipt") | ((F.col("voucher_type") == "Contra") & (F.col("credit") > 0))
    bank, party = F.col("bank_ledger_name"), F.col("ledger_name")

    def leg(no: int, is_bank: Column) -> Column:
        return F.struct(
            F.lit(no).alias("leg"),
            F.when(is_bank, bank).otherwise(party).alias("ledger"),
            F.lit(no == 2).alias("is_deemed_positive"),
            (amount if no == 1 else -amount).cast(MONEY).alias("amount"),
            F.when(is_bank, F.col("instrument_number")).alias("instrument_number"),
        )

    used = vouchers.where((amount != 0) & F.col("voucher_type").isin("Payment", "Receipt", "Contra"))
    return used.select("stmt_id", "row_index", "voucher_type", F.explode(F.array(leg(1, ~inward), leg(2, inward))).alias("e")).select("stmt_id", "row_index", "voucher_type", "e.*")


def unbalanced(legs: DataFrame) -> DataFrame:
    """Vouchers with fewer than two legs or legs that do not sum to zero (to a cent)."""
    sums = legs.groupBy("stmt_id", "row_index").agg(F.count(F.lit(1)).alias("n_legs"), F.sum("amount").cast("decimal(25,2)").alias("net"))
    return sums.where((F.col("n_legs") < 2) | (F.abs("net") > F.lit("0.01").cast(MONEY)))


def sheet(vouchers: DataFrame) -> DataFrame:
    """The eleven columns of the sheet, amounts that are zero left empty."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c))
    values = (
        F.col("row_index"), F.col("voucher_type"), F.col("tx_date"), F.col("narration"), F.col("ledger_name"), F.col("bank_ledger_name"),
        F.col("instrument_number"), F.col("instrument_date"), some("debit"), some("credit"), F.col("balance"),
    )
    return vouchers.select("stmt_id", *[v.alias(n) for n, v in zip(SHEET_COLUMNS, values, strict=True)])


def parity_differences(vouchers: DataFrame, exported: DataFrame) -> DataFrame:
    """Fields that differ between vouchers and an exported sheet, matched by number; missing rows count as one difference."""
    a = sheet(vouchers)
    fields = [c for c in SHEET_COLUMNS if c != "VOUCHER NO."]
    left = a.select(F.col("stmt_id"), F.col("`VOUCHER NO.`").alias("no"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("x"))
    right = exported.select(F.col("stmt_id"), F.col("`VOUCHER NO.`").alias("no"), F.struct(*[F.col(f"`{c}`") for c in fields]).alias("y"))
    both = left.join(right, ["stmt_id", "no"], "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col("x")[c].eqNullSafe(F.col("y")[c]), F.lit(c)) for c in fields]))
    found = F.when(F.col("x").isNull(), F.array(F.lit("ONLY IN SHEET"))).when(F.col("y").isNull(), F.array(F.lit("ONLY IN VOUCHERS"))).otherwise(differs)
    return both.select("stmt_id", F.col("no").alias("row_index"), F.explode(found).alias("field"))


def voucher_xml(vouchers: DataFrame, namespace: str = "urn:vouchers") -> DataFrame:
    """One XML fragment per voucher with an amount: date, type, number, reference, narration and its two legs."""
    day = compact_date(F.col("tx_date"))
    amount = F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.col("credit"))
    text = amount_text(amount)
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    party, bank = xml_escape(F.col("ledger_name")), xml_escape(F.col("bank_ledger_name"))
    inward = (F.col("voucher_type") == "Receipt") | ((F.col("voucher_type") == "Contra") & (F.col("credit") > 0))
    allocation = F.when(
        F.col("instrument_number").isNotNull(),
        tag("BANKALLOCATIONS.LIST", F.concat(
            tag("DATE", day), tag("INSTRUMENTDATE", compact_date(F.coalesce("instrument_date", "tx_date"))), tag("TRANSACTIONTYPE", F.lit("Cheque/DD")),
            tag("PAYMENTFAVOURING", party), tag("INSTRUMENTNUMBER", xml_escape(F.col("instrument_number"))), tag("STATUS", F.lit("Cheque")), tag("AMOUNT", text))),
    ).otherwise("")
    leg = lambda ledger, positive, value, more: tag("ALLLEDGERENTRIES.LIST", F.concat(tag("LEDGERNAME", ledger), tag("ISDEEMEDPOSITIVE", F.lit(positive)), tag("AMOUNT", value), more))
    nothing = F.lit("")
    minus = F.concat(F.lit("-"), text)
    legs = F.when(inward, F.concat(leg(party, "No", text, nothing), leg(bank, "Yes", minus, allocation))).otherwise(F.concat(leg(bank, "No", text, allocation), leg(party, "Yes", minus, nothing)))
    reference = F.when(F.col("reference").isNotNull(), F.concat(tag("REFERENCE", xml_escape(F.col("reference"))), tag("REFERENCEDATE", day))).otherwise("")
    body = F.concat(
        F.lit('<VOUCHER VCHTYPE="'), F.col("voucher_type"), F.lit('" ACTION="Create">'), tag("DATE", day), tag("VOUCHERTYPENAME", F.col("voucher_type")),
        tag("VOUCHERNUMBER", F.col("row_index").cast("string")), reference, tag("NARRATION", xml_escape(F.col("narration"))), tag("EFFECTIVEDATE", day),
        F.when(F.col("voucher_type") == "Journal", nothing).otherwise(legs), F.lit("</VOUCHER>"),
    )
    return vouchers.where(amount != 0).select("stmt_id", "row_index", body.alias("fragment"))


def voucher_documents(fragments: DataFrame) -> DataFrame:
    """One document per statement: its fragments in order inside an envelope. A statement's vouchers fit in one row, as its file did; longer ones are written in parts."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "fragment"))), lambda x: x["fragment"])
    return fragments.groupBy("stmt_id").agg(F.concat(F.lit(HEAD), F.array_join(ordered, ""), F.lit(TAIL)).alias("document"))


HEAD, TAIL = '<?xml version="1.0" encoding="utf-8"?><ENVELOPE><BODY>', "</BODY></ENVELOPE>"


def document_parts(fragments: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """(stmt_id, part, n_parts, text): documents of any length in parts, from 1, which make the document when they are joined in order.

    Rows are dealt by statement and block of ``row_index``, so a part is bounded
    and a long statement is spread over tasks; which parts hold the envelope's
    beginning and end is known from one row a block.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "fragment"))), lambda x: x["fragment"])
    blocks = fragments.withColumn("block", F.floor((F.col("row_index") - 1) / part_rows)).groupBy("stmt_id", "block").agg(F.array_join(ordered, "").alias("body"))
    numbers = fragments.select("stmt_id", F.floor((F.col("row_index") - 1) / part_rows).alias("block")).distinct()
    w = Window.partitionBy("stmt_id")
    placed = numbers.select(F.col("stmt_id").alias("_stmt"), F.col("block").alias("_block"), F.row_number().over(w.orderBy("block")).alias("part"), F.count(F.lit(1)).over(w).cast("int").alias("n_parts"))
    both = blocks.join(placed, F.col("stmt_id").eqNullSafe(F.col("_stmt")) & (F.col("block") == F.col("_block")))
    text = F.concat(F.when(F.col("part") == 1, F.lit(HEAD)).otherwise(""), "body", F.when(F.col("part") == F.col("n_parts"), F.lit(TAIL)).otherwise(""))
    return both.select("stmt_id", "part", "n_parts", text.alias("text"))


def broken_documents(documents: DataFrame) -> DataFrame:
    """Structure of documents by XPath: vouchers, legs and whether all vouchers have at least two legs."""
    n = lambda path: F.xpath_int("document", F.lit(f"count({path})"))
    return documents.select("stmt_id", n("//VOUCHER").alias("n_vouchers"), n("//ALLLEDGERENTRIES.LIST").alias("n_legs"), n("//VOUCHER[count(ALLLEDGERENTRIES.LIST) < 2]").alias("n_broken"))


def export_filename(bank: Column, first: Column, last: Column, kind: str) -> Column:
    """First word of the bank's name and the span of dates; the sheet's dates are written like 01-Jul-25, the document's like 2025-07-01."""
    form = "dd-MMM-yy" if kind == "xlsx" else "yyyy-MM-dd"
    word = filename_part(F.substring_index(F.trim(bank), " ", 1))
    name = F.when(word == "", "Bank").otherwise(word)
    said = lambda d, other: F.coalesce(F.date_format(d, form), F.lit(other))
    return F.concat(name, F.lit("_Statement_"), said(first, "Statement"), F.lit("_to_"), said(last, "Export"), F.lit(f".{kind}"))

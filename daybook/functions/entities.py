"""Parties, instruments and references in narrations, as Column functions.

All rules are ordered; the first that applies gives the result. Patterns use no
look-around, so that other SQL engines read them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.scalars import collapsed, first_match

# Noise cut from narrations, in order.
NOISE = (
    r"(?i)\s*-\s*[0-9]+\s*LAT(?:ENCY)?\b",
    r"(?i)\s*-\s*LAT(?:ENCY)?\b",
    r"(?i)\bLATENCY\b",
    r"(?i)\bLAT\b",
    r"(?i)\bCTO[0-9]+\b",
    r"(?i)\bDisclaimer:\s*This\s+is\s+an\s+Electronically\s+Generated.*",
)

# Wordings of bank charges. Every wording that ends in a charge word is covered by the bare
# charge words at the end; the others stand on their own.
CHARGES = (
    r"(?i)\b(?:A/?C\s+MAINT(?:ENANCE)?|ACC(?:OUNT)?\s+MAINT(?:ENANCE)?|AMC|A/?C\s+KEEPING|ACC(?:OUNT)?\s+KEEPING|SMS\s+ALERT|FUND\s+TRF\s+CHG|"
    r"CASH\s+HANDLING\s+CHG|CHQ\s+RETURN\s+CHG|CHQ\s+BOUNCE\s+CHG|ANNUAL\s+FEE|CONSOLIDATED\s+CHG|CHARGES?|CHGS?|CHRG)\b"
)
CASH_IN = r"(?i)\b(?:CASH\s+DEP(?:OSIT)?(?:ED)?|CASH\s+DEPOSIT\s+BY\s+SELF|BY\s+CASH|CDM\s+CASH|CDM\s+DEP|CASH\s+RECD|DEPOSIT\s+BY\s+CASH|CASH\s+DEPOSIT\s+AT)\b"
CASH_OUT = r"(?i)\b(?:CASH\s+WITHDRAWAL|WITHDRAWAL\s+BY\s+CASH|CASH\s+WDL|ATM\s+CASH|ATM\s+WDL|SELF\s+CASH|SELF\s+WDL|TO\s+CASH)\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
GSTIN = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"
CHEQUE_CONTEXT = ("CHQ", "CHEQUE", "CLEARING", "TRANSFER", "INST", "IZE", "TRADI")


def without_noise(narration: Column) -> Column:
    """Watermarks and latency marks cut, white space runs as one space."""
    t = F.coalesce(narration, F.lit(""))
    for pattern in NOISE:
        t = F.regexp_replace(t, pattern, "")
    return F.trim(F.regexp_replace(t, r"\s{2,}", " "))


def instrument_number(narration: Column, reference: Column) -> Column:
    """Cheque or instrument number with its leading zeros: from the reference, else from the narration; else null."""
    ref, text = F.trim(reference), F.trim(narration)
    plain = F.when(ref.rlike("^[0-9]{5,8}$"), ref)
    worded = first_match(ref, r"(?i)\b(?:CHQ|CHEQUE|INST|INSTRUMENT)?\s*[:./-]?\s*([0-9]{5,8})\b")
    marked = first_match(text, r"(?i)\b(?:IZE|CHQ|CHEQUE|INST|INSTRUMENT|CLR)\b\s*[:./#-]?\s*([0-9]{5,8})\b")
    slashed = first_match(text, r"(?i)/(?:CHQ/)?([0-9]{6})/")
    # Six digits on their own count with a banking word within 15 characters on either side.
    alone = r"(?:^|\s|/|-|:)([0-9]{6})(?:\s|/|-|$)"
    candidate = first_match(text, alone)
    around = F.upper(F.regexp_extract(text, r"((?:.{0,15})(?:^|\s|/|-|:)[0-9]{6}(?:\s|/|-|$)(?:.{0,15}))", 1))
    spoken = F.greatest(*[around.contains(w).cast("int") for w in CHEQUE_CONTEXT]) == 1
    standing = F.when(~candidate.startswith("19") & ~candidate.startswith("20") & spoken, candidate)
    return F.coalesce(plain, worded, marked, slashed, standing)


def upi_reference(narration: Column) -> Column:
    return first_match(narration, r"\b(?:UPI/)?([0-9]{12})\b")


def utr_reference(narration: Column) -> Column:
    found = first_match(F.upper(narration), r"\b([A-Z]{4}[A-Z0-9]{12,18})\b")
    return F.when(~found.startswith("HTTP"), found)


def cash_type(narration: Column, is_debit: Column) -> Column:
    """CASH_DEPOSIT, CASH_WITHDRAWAL or null. The letters ATM count anywhere in a debit, even inside a word."""
    return bound(without_noise(narration), lambda t: _cash_of(t, is_debit))


def _cash_of(t: Column, is_debit: Column) -> Column:
    up = F.upper(t)
    deposit, withdrawal = F.lit("CASH_DEPOSIT"), F.lit("CASH_WITHDRAWAL")
    return (
        F.when(t.rlike(CASH_IN) | (~is_debit & up.contains("BY CASH")), deposit)
        .when(t.rlike(CASH_OUT), withdrawal)
        .when(is_debit & (up.contains("ATM") | up.contains("CASH WDL") | up.contains("SELF WDL")), withdrawal)
        .when(up.rlike(r"\bCASH\b"), F.when(is_debit, withdrawal).otherwise(deposit))
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _contains_any(text: Column, *words: str) -> Column:
    return F.greatest(*[text.contains(w).cast("int") for w in words], F.lit(0)) == 1


def _digits_only(t: Column) -> Column:
    return t.rlike("^[0-9]+$")


def _tokens(text: Column, split: str) -> Column:
    return F.filter(F.transform(F.split(text, split), lambda x: F.trim(x)), lambda x: x != "")


def party(narration: Column, is_debit: Column) -> Column:
    """struct(name, category) of the counterparty, null if no rule applies."""
    cleaned = without_noise(collapsed(narration))
    known = bound(cleaned, lambda t: F.struct(t.alias("t"), F.upper(t).alias("up"), _cash_of(t, is_debit).alias("cash")))
    return bound(known, lambda k: _party_of(k["t"], k["up"], k["cash"], is_debit))


def _party_of(t: Column, up: Column, cash: Column, is_debit: Column) -> Column:
    said = lambda name, kind: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("category"))
    after_colon = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, r"(?i)\b(?:RTGS|NEFT)\s*(?:OUT|IN)?\s*:\s*[A-Z0-9]+\s*:\s*([^:/-]+)", 1)), IFSC, ""))
    paid_to = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, r"(?i)Paid To\s*:\s*(?:TO\s+)?([^:/-]+)", 1)), r"\bIZE\s+[0-9]+.*", ""))
    after_ize = F.trim(F.regexp_replace(F.trim(F.regexp_extract(t, r"(?i)\bIZE\s+[0-9]{5,8}\s+([^:/-]+)", 1)), IFSC, ""))

    dateless = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b", ""), r"\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b", ""))
    after_address = dateless(F.trim(F.regexp_extract(t, r"@[a-zA-Z0-9_.-]+/([^/]+)$", 1)))
    slashes = _tokens(t, "/")
    # Tokens that name no party.
    upi_words = ("UPI", "P2M", "P2V", "P2A", "P2P", "NA", "CR", "DR", "PAY", "BIL", "LAT", "LATENCY")
    neft_words = ("NEFT", "RTGS", "TRANSFER", "TO", "BY", "CR", "DR", "CMS", "OUT", "IN")
    imps_words = ("IMPS", "P2A", "P2P", "CR", "DR")
    upi_usable = F.filter(F.reverse(slashes), lambda x: ~F.upper(x).isin(*upi_words) & ~_digits_only(x) & (F.length(x) > 2))
    upi_named = F.transform(upi_usable, lambda x: F.trim(F.regexp_replace(F.substring_index(x, "@", 1), r"\b[0-9]{2}-[0-9]{2}-[0-9]{4}\b", "")))
    upi_token = F.get(F.filter(upi_named, lambda x: (F.length(x) > 2) & ~_digits_only(x)), F.lit(0))
    delimited = F.reverse(_tokens(t, "[/:-]"))
    code = lambda x: F.upper(x).rlike("^[A-Z0-9]{5,18}$") & x.rlike("[0-9]")
    neft_token = F.get(F.filter(delimited, lambda x: ~F.upper(x).isin(*neft_words) & (F.length(x) > 2) & ~code(x) & ~F.upper(x).rlike("^[A-Z]{4}0[0-9]{6,14}$")), F.lit(0))
    imps_token = F.get(F.filter(delimited, lambda x: ~F.upper(x).isin(*imps_words) & (F.length(x) > 2) & ~code(x)), F.lit(0))
    tail = F.element_at(slashes, -1)

    return (
        F.when(cash.isNotNull(), said("Cash", cash))
        .when(is_debit & t.rlike(CHARGES), said("Bank Charges", "BANK_CHARGES"))
        .when(up.contains("GST ON BANK CHARGES"), said("Bank Charges", "BANK_CHARGES"))
        .when(_contains_any(up, "GST:", "GST RECD"), said("GST Input Tax Credit", "TAX"))
        .when(_contains_any(up, "INT.PD", "INTEREST PAID", "INTEREST DEBIT"), said("Bank Interest Expense", "INTEREST"))
        .when(_contains_any(up, "INTEREST RECEIVED", "INTEREST CREDIT", "INT RECD", "INT.COLL"), said("Bank Interest Income", "INTEREST"))
        .when(up.contains("APY CONTRI"), said("APY Contribution", "PENSION"))
        .when((F.length(after_colon) > 2) & ~_digits_only(after_colon), said(after_colon, F.when(up.contains("RTGS"), "RTGS").otherwise("NEFT")))
        .when(F.length(paid_to) > 2, said(paid_to, "TRANSFER"))
        .when(F.length(after_ize) > 2, said(after_ize, "CHEQUE"))
        .when(up.contains("CLEARING"), said("Clearing", "CHEQUE"))
        .when(up.contains("UPI") & (F.length(after_address) > 2) & ~_digits_only(after_address), said(after_address, "UPI"))
        .when(up.contains("UPI") & (F.size(slashes) >= 2) & upi_token.isNotNull(), said(upi_token, "UPI"))
        .when(_contains_any(up, "NEFT", "RTGS") & neft_token.isNotNull(), said(neft_token, "NEFT"))
        .when(up.contains("IMPS") & imps_token.isNotNull(), said(imps_token, "IMPS"))
        .when((F.size(slashes) >= 2) & ~_digits_only(tail) & (F.length(tail) > 2), said(tail, "TRANSFER"))
    )


def gstin(narration: Column) -> Column:
    return first_match(F.upper(narration), GSTIN)

"""Dates, amounts and text of statement cells, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"

#: Day-first formats that statements print, tried in order after the ISO form.
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d-MMM-yyyy", "d MMM yyyy", "d/MMM/yyyy", "d/M/yy", "d-M-yy", "d.M.yy")


def nothing_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group where it matches, else null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def normalize_date(text: Column) -> Column:
    """ISO first, then day-first formats; null if none fits. Missing parts are never filled from today."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"), F.try_to_date(F.translate(F.regexp_extract(t, r"^([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})", 1), "/", "-"), "yyyy-M-d"))
    shape = {
        "/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", ".M.yyyy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
        "-MMM-yyyy": r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$", " MMM yyyy": r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", "/MMM/yyyy": r"^[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}$",
        "/M/yy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$", "-M-yy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$", ".M.yy": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2}$",
    }
    named = F.initcap(F.lower(t))  # month names are read as Jan, Feb, ...
    tries = [F.when(t.rlike(shape[f[1:]]), F.try_to_date(named if "MMM" in f else t, f)) for f in DAY_FIRST_FORMATS]
    return F.coalesce(iso, *tries)


def normalize_amount(text: Column) -> Column:
    """Currency signs, words and commas go; parentheses make it negative; Dr/Cr goes without changing the sign; what is no number is 0."""
    t = F.regexp_replace(F.trim(text), "[₹$€£]", "")
    t = F.regexp_replace(t, r"(?i)rs\.?", "")
    t = F.regexp_replace(t, r"(?i)\b(?:INR|Overdraft)\b", "")
    t = F.trim(F.replace(t, F.lit(","), F.lit("")))
    wrapped = lambda t: t.startswith("(") & t.endswith(")")
    inner = lambda t: F.when(wrapped(t), F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
    value = lambda t: F.trim(F.regexp_replace(inner(t), r"(?i)\(?\s*(?:CR|DR)\.?\)?$", "")).try_cast(MONEY)
    # Each step is the variable of the next one, so no pattern is tried once for each use of its result.
    told = F.transform(F.array(t), lambda t: F.struct(wrapped(t).alias("wrapped"), value(t).alias("value")))
    signed = F.transform(told, lambda x: F.when(x["wrapped"], -F.abs(x["value"])).otherwise(x["value"]))[0]
    return F.coalesce(signed, F.lit(0).cast(MONEY)).cast(MONEY)


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_narration(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(text, "[\r\n\t]+", " "), r"\s{2,}", " ")), F.lit(""))


def normalize_ledger_name(text: Column) -> Column:
    return F.upper(collapsed(text))


# Reference patterns in the order they are tried.
REFERENCE_PATTERNS = (
    r"(?i)\bUPI/(?:CR|DR)?/?([0-9]{10,14})\b",
    r"(?i)\bIMPS/P2A/([0-9]{10,14})\b",
    r"(?i)\bNEFT/([A-Z0-9]{10,18})\b",
    r"(?i)\bRTGS/([A-Z0-9]{10,18})\b",
    r"(?i)\b(?:CHQ|CHEQUE|REF)[\s.:#]+([A-Za-z0-9]+)\b",
)


def extract_reference(text: Column) -> Column:
    """The first reference number by kind, else the empty text."""
    return F.coalesce(*[first_match(text, p) for p in REFERENCE_PATTERNS], F.lit(""))


def mask_account(account: Column) -> Column:
    return F.when(F.length(account) >= 4, F.concat(F.lit("XXXX"), F.right(account, F.lit(4)))).otherwise(account)


def mask_destination(to: Column) -> Column:
    """An address keeps its first two characters and its domain; another destination its last four."""
    name = F.substring_index(to, "@", 1)
    address = F.concat(F.substring(name, 1, 2), F.lit("***@"), F.substring_index(to, "@", -1))
    return F.when(to.contains("@"), address).otherwise(F.concat(F.lit("******"), F.right(to, F.lit(4))))


def redact_log(text: Column) -> Column:
    """Values of passwords and tokens, and bearer credentials, as stars."""
    t = F.regexp_replace(text, r"(?i)(password|token|secret)([\"']?\s*[:=]\s*[\"']?)[^\s\"',&]+", "$1$2***")
    return F.regexp_replace(t, r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1***")


def filename_part(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "")


def page_price(pages: Column, each: float = 2.0) -> Column:
    return F.round(pages * F.lit(each), 2)


def pages_for_payment(amount: Column, each: float = 2.0) -> Column:
    return F.floor(amount / F.lit(each)).cast("long")


def deletion_date(day: Column, days: int = 90) -> Column:
    return F.date_add(day, days)


def business_day(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """The calendar day in a zone of a time stamp without zone, read as UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("date")


def xml_escape(text: Column) -> Column:
    """The five characters, the ampersand first; null gives the empty text."""
    out = F.coalesce(text, F.lit(""))
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def compact_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit(""))


def amount_text(amount: Column) -> Column:
    """Two decimals, then trailing zeros and a bare point cut."""
    return F.regexp_replace(F.regexp_replace(amount.cast(MONEY).cast("string"), "0+$", ""), r"\.$", "")


def sanitize_xml(text: Column) -> Column:
    """Document types, entities, character references and control characters that XML 1.0 does not allow are cut."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"(?i)<!DOCTYPE[^>]*>", "")
    t = F.regexp_replace(t, r"(?i)<!ENTITY[^>]*>", "")
    t = F.regexp_replace(t, r"&#(?:0?[0-8]|1[12]|1[4-9]|2[0-9]|3[01]);", "")
    t = F.regexp_replace(t, r"(?i)&#x(?:0?[0-8a-b]|1[12]|1[4-9a-f]);", "")
    return F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def ledger_format(content: Column, filename: Column) -> Column:
    """XML, JSON or HTML by content, then by the file's ending; null if neither tells."""
    t, name = F.trim(content), F.lower(F.coalesce(filename, F.lit("")))
    up = F.upper(t)
    has = lambda *marks: F.greatest(*[up.contains(m).cast("int") for m in marks], F.lit(0)) == 1
    return (
        F.when(t.startswith("{") | t.startswith("["), "JSON")
        .when(t.startswith("<?xml") | has("<ENVELOPE", "<TALLYMESSAGE", "<LEDGER"), "XML")
        .when(has("<!DOCTYPE HTML", "<HTML", "<TABLE", "<TR"), "HTML")
        .when(name.endswith(".json"), "JSON")
        .when(name.endswith(".xml"), "XML")
        .when(name.endswith(".html") | name.endswith(".htm"), "HTML")
    )


def decode_bytes(content: Column) -> Column:
    """Text of a file: by byte-order mark, else UTF-8, UTF-16 if zeros stand in it, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.try_validate_utf8(content.cast("string"))
    zeros = F.hex(F.substring(content, 1, 200)).rlike("^(?:[0-9A-F]{2})*00")
    return (
        F.when(head.startswith("FFFE"), F.decode(F.substr(content, F.lit(3)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substr(content, F.lit(3)), "UTF-16BE"))
        .when(head == "EFBBBF", F.decode(F.substr(content, F.lit(4)), "UTF-8"))
        .when(utf8.isNotNull() & ~zeros, utf8)
        .when(zeros, F.decode(content, "UTF-16LE"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


#: Character references by name that ledgers exported as pages use.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def without_references(text: Column) -> Column:
    """Character references made characters: the named ones above, and numbers in decimal or hexadecimal. Others stay as they are."""

    def one(part: Column) -> Column:
        told = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[a-z]+);", 1)
        rest = F.substr(part, F.length(told) + 2)
        code = F.when(F.lower(told).startswith("#x"), F.conv(F.substr(told, F.lit(3)), 16, 10)).when(told.startswith("#"), F.substr(told, F.lit(2))).cast("long")
        # a place in no plane, or half of a pair, is no character
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        named = F.lit(None).cast("string")
        for name, c in NAMED.items():
            named = F.when(told == name, c).otherwise(named)
        return F.coalesce(F.concat(named, rest), F.when(valid, F.concat(char, rest)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(one(x))), "")

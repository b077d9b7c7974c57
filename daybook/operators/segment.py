"""From page lines and table cells to records.

Lines are (doc_id, page_number, line_no, line). A line that begins with a date
opens a record, the lines after it belong to it; a running count of opening
lines numbers the records, so no row-by-row state is needed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.scalars import clean_narration, collapsed, extract_reference, normalize_date
from daybook.operators.directions import MONEY
from daybook.storage import written

# Beginnings of lines that belong to no record.
NOISE_LINES = (
    r"Page\s*(?:No\.?:?\s*)?[0-9]+(?:\s+of\s+[0-9]+)?",
    r"Statement\s*(?:of\s*)?Account",
    r"Statement\s*for\s*(?:the\s*)?Period",
    r"Statement\s*From\s*.*?\s*To\s*",
    r"(?:Account\s*Branch|AccountBranch)",
    r"Account\s*(?:Branch|Name|Number|Type|Status)\s*:",
    r"Branch\s*(?:Address|Code|Contact|Phone)\s*:",
    r"Customer\s*(?:Name|Address|Care|ID)\s*:",
    r"Cust(?:omer)?\s*ID\s*:",
    r"CIF\s*(?:No\.?)?\s*:",
    r"CKYC\s*No\.?\s*:",
    r"IFSC\s*(?:Code)?\s*:",
    r"MICR\s*(?:Code)?\s*:",
    r"Currency\s*:",
    r"Nomination\s*:",
    r"OD\s*Limit\s*:",
    r"Cleared\s*Balance\s*:",
    r"Uncleared\s*(?:Amount|Funds)\s*:",
    r"Drawing\s*Power\s*:",
    r"Int(?:\.|\s*)Rate\s*:",
    r"This\s*is\s*an\s*Electronically\s*Generated",
    r"\*?Closing\s*balance\s*includes\s*funds",
    r"Contents\s*(?:of\s*)?(?:this\s*)?statement",
    r"State\s*account\s*branch\s*GSTN",
    r"HDFC\s*Bank\s*GSTIN",
    r"Registered\s*Office\s*Address",
    r"Total\s*(?:WITHDRAWAL|DEPOSIT|DEBITS?|CREDITS?|BALANCE)",
    r"(?:CLOSING|OPENING)\s*BALANCE(?:\s*\(?[A-Z]+\)?)?",
    r"STATEMENT\s*SUMMARY",
    r"\*+---?END\s*OF\s*STATEMENT---?\*+",
    r"Did\s*you\s*know\?\s*It's\s*mandatory\s*to\s*be\s*KYC",
    r"Summary\s+of\s+Accounts\s+held\s+under",
    r"ACCOUNT\s+DETAILS\s*-\s*INR",
    r"ACCOUNT\s+TYPE\s+A/c\s+BALANCE",
    r"Visit\s+www\.",
    r"Dial\s+your\s+Bank",
    r"Tel(?:ephone)?\s+Number\s*:",
)
NOISE = "(?i)^(?:" + "|".join(NOISE_LINES) + ")"
ANCHOR = r"^(?:(?:[A-Za-z]*[0-9]+[A-Za-z0-9_-]*|[0-9]+)\s+)?([0-9]{1,2}[/.-](?:[0-9]{1,2}|[A-Za-z]{3})[/.-][0-9]{2,4})\b"
HEADER_WORDS = ("DATE", "PARTICULARS", "NARRATION", "DESCRIPTION", "WITHDRAWAL", "DEPOSIT", "BALANCE", "CHQ")
SUMMARY_WORDS = ("TOTAL WITHDRAWAL", "TOTAL DEPOSIT", "CLOSING BALANCE:", "STATEMENT SUMMARY", "PAGE ")

# Header words of each role, in the order roles are tried.
ROLES = (
    ("date", ("TXN DATE", "TRAN DATE", "POST DATE", "POSTING DATE", "TRANSACTION DATE", "DATE"), ("VAL",)),
    ("value_date", ("VALUE DATE", "VAL DATE", "VALUE DT", "VAL DT"), ()),
    ("reference", ("CHQ/REF", "CHQ./REF.NO.", "CHQ.NO.", "CHQ NO", "CHQNO", "CHEQUE NO/REFERENCE", "REF NO./CHEQUE NO.", "REF NO.", "INSTRUMENT NO", "TRAN ID",
                   "TRANSACTION ID", "CHQ", "CHEQUE", "REF", "REFERENCE", "INSTRUMENT"), ()),
    ("debit", ("WITHDRAWAL AMT.", "WITHDRAWALS", "WITHDRAWAL", "WITHDRAW ALS", "AMOUNT (DR)", "DEBIT (DR)", "MONEY OUT", "DEBIT", "DR"), ()),
    ("credit", ("DEPOSIT AMT.", "DEPOSITS", "DEPOSIT", "AMOUNT (CR)", "CREDIT (CR)", "MONEY IN", "CREDIT", "CR"), ()),
    ("balance", ("CLOSING BALANCE", "CLOSINGBALANCE", "RUNNING BALANCE", "BALANCE (RS.)", "BALANCE", "BAL", "TOTALS"), ("TYPE", "OPENING")),
    ("additional_info", ("ADDITIONAL INFO", "ADDL INFO", "ADDITIONAL INFORMATION"), ()),
    ("amount", ("AMOUNT (RS.)", "AMOUNT(RS.)", "TXN AMOUNT", "TRAN AMOUNT", "AMOUNT"), ("BAL",)),
    ("narration", ("NARRATION", "PARTICULARS", "DESCRIPTION", "REMARKS", "TRANSACTION DETAILS", "DETAILS", "TRANSACTION"), ()),
)


def is_noise(line: Column) -> Column:
    t = F.trim(line)
    return (t == "") | t.rlike(NOISE)


def _count_words(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def records(lines: DataFrame) -> DataFrame:
    """One row per record of a document: page, date text, its lines and the text after the date.

    The table begins at a line with two header words or the first dated line; a
    summary line ends the record before it and is dropped.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    up = F.upper("line")
    dated = F.col("line").rlike(ANCHOR)
    header = _count_words(up, HEADER_WORDS) >= 2
    ends = _count_words(up, SUMMARY_WORDS) > 0
    marked = lines.withColumn("dated", dated).withColumn("header", header).withColumn("ends", ends)
    begun = marked.withColumn("begun", F.max((F.col("dated") | F.col("header")).cast("int")).over(so_far) == 1)
    # The line that begins the table is dropped if it is a header; later headers are lines like any other.
    first_header = F.col("header") & ~F.coalesce(F.max((F.col("dated") | F.col("header")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)) == 1, F.lit(False))
    inside = begun.withColumn("skip", first_header).where("begun AND NOT skip")
    opens = (F.col("dated") & ~F.col("ends")).cast("int")
    numbered = inside.withColumn("record", F.sum(opens).over(so_far)).withColumn("closed", F.sum(F.col("ends").cast("int")).over(so_far))
    at_open = F.max(F.when(opens == 1, F.col("closed"))).over(Window.partitionBy("doc_id", "record"))
    kept = numbered.withColumn("at_open", at_open).where("record > 0 AND closed = at_open AND NOT ends")
    text = F.when(F.col("dated"), F.trim(F.regexp_replace("line", ANCHOR, ""))).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line", text.alias("text"))))
    grouped = kept.groupBy("doc_id", "record").agg(parts.alias("parts"))
    first = F.get("parts", F.lit(0))
    return grouped.select(
        "doc_id", F.col("record").cast("int").alias("record"), first["page_number"].alias("page_number"), F.regexp_extract(first["line"], ANCHOR, 1).alias("date_text"),
        F.transform("parts", lambda x: x["line"]).alias("source_lines"), F.array_join(F.transform("parts", lambda x: x["text"]), " ").alias("text"),
    )


def amount_tokens(text: Column) -> Column:
    """struct(amounts, words): tokens with a digit and a point or comma that are numbers without commas and Cr/Dr; the others."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    bare = lambda t: F.regexp_replace(F.replace(t, F.lit(","), F.lit("")), "Cr|Dr|CR|DR", "")
    told = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.when(t.rlike("[0-9]") & (t.contains(".") | t.contains(",")), bare(t)).alias("b")))
    number = lambda x: F.when(x["b"].rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), x["b"].try_cast(MONEY))
    valued = F.transform(told, lambda x: F.struct(x["t"].alias("t"), number(x).alias("v")))
    # As the variable of a function the values are made once, not once for each use.
    return F.transform(F.array(valued), lambda a: F.struct(F.array_compact(F.transform(a, lambda x: x["v"])).alias("amounts"), F.array_join(F.transform(F.filter(a, lambda x: x["v"].isNull()), lambda x: x["t"]), " ").alias("words")))[0]


def parsed_records(found: DataFrame) -> DataFrame:
    """Records with their date, amounts, narration and reference; records without a readable date are dropped."""
    split = found.withColumn("split", amount_tokens(F.col("text"))).withColumn("tx_date", normalize_date(F.col("date_text")))
    return split.where("tx_date IS NOT NULL").select(
        "doc_id", "record", "page_number", "tx_date", F.col("split.amounts").alias("amounts"), F.coalesce(F.nullif(clean_narration(F.col("split.words")), F.lit("")), F.lit("Transaction")).alias("narration"),
        extract_reference(F.col("text")).alias("reference"), "text", "source_lines",
    )


def header_roles(cells: Column) -> Column:
    """Map from role to place for a row of header cells, null if it is no header.

    Cells take roles from left to right; each takes the first role in order that
    is free and fits. Short words must stand alone.
    """

    def fits(cell: Column, words: tuple[str, ...], without: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for word in words:
            out = out | (cell.rlike(rf"\b{word}\b") if len(word) <= 3 else cell.contains(word))
        for word in without:
            out = out & ~cell.contains(word)
        return out

    def step(acc: Column, x: Column) -> Column:
        role = F.lit(None).cast("string")
        for name, words, without in reversed(ROLES):
            role = F.when(fits(x["cell"], words, without) & ~F.array_contains(F.map_keys(acc), name), F.lit(name)).otherwise(role)
        return F.when((x["cell"] != "") & role.isNotNull(), F.map_concat(acc, F.create_map(F.coalesce(role, F.lit("")), x["place"]))).otherwise(acc)

    numbered = F.transform(cells, lambda c, i: F.struct(F.upper(collapsed(F.coalesce(c, F.lit("")))).alias("cell"), i.alias("place")))
    found = F.aggregate(numbered, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), step)
    has = lambda *names: F.arrays_overlap(F.map_keys(found), F.array(*[F.lit(n) for n in names]))
    return F.when(has("date") & has("debit", "credit", "amount", "narration"), found)


_CELL_DATE = r"([0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}|[0-9]{1,2}[/.-](?:[0-9]{1,2}|[A-Za-z]{3,9})[/.-][0-9]{2,4}|[0-9]{1,2}\s+(?:[0-9]{1,2}|[A-Za-z]{3,9})\s+[0-9]{2,4})"


def table_rows(rows: DataFrame) -> DataFrame:
    """Transaction rows of tables. ``rows``: doc_id, page_number, row_no, cells.

    The last header row so far tells the columns, over tables and pages; a row
    without date and amounts goes on with the row before.
    """
    w = Window.partitionBy("doc_id").orderBy("page_number", "row_no")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    clean = rows.withColumn("cells", F.transform("cells", lambda c: collapsed(F.coalesce(c, F.lit(""))))).withColumn("row_text", F.array_join(F.filter("cells", lambda c: c != ""), " "))
    # Few rows hold a word for the date, which every header has; only these are tried for all roles.
    dates = [w for w in ROLES[0][1] if not any(v != w and v in w for v in ROLES[0][1])]
    may = reduce(or_, [F.upper("row_text").contains(w) for w in dates])
    told = clean.where(~is_noise(F.col("row_text"))).withColumn("own", F.when(may, header_roles(F.col("cells"))))
    mapped = told.withColumn("roles", F.last("own", ignorenulls=True).over(so_far)).where("own IS NULL AND roles IS NOT NULL")
    cell = lambda role: F.coalesce(F.get("cells", F.element_at("roles", F.lit(role))), F.lit(""))
    mapped = mapped.withColumn("date_text", F.regexp_extract(cell("date"), _CELL_DATE, 1)).withColumn("more", (F.col("date_text") == "") & (cell("date") != ""))
    mapped = mapped.where((F.col("date_text") != "") | F.col("more"))
    has_amount = cell("debit").rlike("[0-9]") | cell("credit").rlike("[0-9]") | cell("amount").rlike("[0-9]")
    numbered = mapped.where(~F.col("more") | ~has_amount).withColumn("record", F.sum((~F.col("more")).cast("int")).over(so_far)).where("record > 0")
    joined = lambda *cs: F.array_join(F.filter(F.array(*cs), lambda c: c != ""), " ")
    extra = joined(cell("narration"), cell("reference"), cell("additional_info"))
    text = F.when(F.col("more"), F.when(extra == "", F.col("row_text")).otherwise(extra)).otherwise(joined(cell("narration"), cell("additional_info")))
    amount = cell("amount")
    digits = F.regexp_replace(amount, "[^0-9.,]", "")
    plain = (cell("debit") == "") & (cell("credit") == "") & (amount != "")
    is_credit = ~amount.rlike(r"(?i)\bDr\b|\(Dr\)") & amount.rlike(r"(?i)\bCr\b|\(Cr\)")
    debit = F.when(plain & ~is_credit, digits).otherwise(cell("debit"))
    credit = F.when(plain & is_credit, digits).otherwise(cell("credit"))
    piece = F.struct("page_number", "row_no", "more", text.alias("text"), F.col("date_text").alias("d"), cell("value_date").alias("v"), cell("reference").alias("r"), debit.alias("dr"), credit.alias("cr"), cell("balance").alias("b"), "row_text")
    grouped = numbered.groupBy("doc_id", "record").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    first = F.get("pieces", F.lit(0))
    nothing = lambda c: F.nullif(c, F.lit(""))
    kept = F.filter("pieces", lambda x: ~x["more"] | ~is_noise(x["text"]))
    late = F.get(F.filter(F.transform(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), lambda x: F.regexp_extract(x["text"], r"(?i)\b(?:UPI|IMPS|NEFT|RTGS|CHQ|REF)[/\s.:#]+([A-Za-z0-9]+)\b", 1)), lambda x: x != ""), F.lit(0))
    return grouped.select(
        "doc_id", F.col("record").cast("int").alias("row_index"), first["page_number"].alias("page_number"), first["d"].alias("date_str"), nothing(first["v"]).alias("value_date_str"),
        F.trim(F.array_join(F.transform(kept, lambda x: x["text"]), " ")).alias("narration"), F.coalesce(nothing(first["r"]), late).alias("reference_str"),
        nothing(first["dr"]).alias("debit_str"), nothing(first["cr"]).alias("credit_str"), nothing(first["b"]).alias("balance_str"), F.transform(kept, lambda x: x["row_text"]).alias("source_lines"),
    )


def zoned(lines: DataFrame, starts: str, stops: str, carries: bool = False) -> DataFrame:
    """Lines between a start and a stop pattern: per page, or with ``carries`` over pages until a stop. Start and stop lines are dropped."""
    keys = ["doc_id"] if carries else ["doc_id", "page_number"]
    w = Window.partitionBy(*keys).orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(stops), 0).when(F.col("line").rlike(starts), 1)
    return lines.withColumn("mark", mark).withColumn("state", F.last("mark", ignorenulls=True).over(w)).where("state = 1 AND mark IS NULL").drop("mark", "state")


def brought_forward(text: Column) -> Column:
    """The balance of a brought-forward row: its last amount; null for other rows."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9,]+\.[0-9]{2})"), F.lit(1))
    return F.when(text.rlike(r"(?i)\bB/F\b|\bBROUGHT\s+FORWARD\b") & (F.size(found) > 0), F.replace(F.element_at(found, -1), F.lit(","), F.lit("")).try_cast(MONEY))


def repaired(line: Column) -> Column:
    """Letters O for zeros in amounts, and spaces inside numbers."""
    t = F.regexp_replace(line, "[� ]", "")
    t = F.regexp_replace(t, r"\b[O0]\.[O0]{2}(Cr|Dr)?\b", "0.00$1")
    t = F.regexp_replace(t, r"([0-9]+)\s*,\s*([0-9]+)", "$1,$2")
    return F.regexp_replace(t, r"([0-9]+)\s*\.\s*([0-9]{2})\b", "$1.$2")


def header_opening(text: Column) -> Column:
    """The balance that a statement's head prints, which may be negative."""
    found = F.regexp_extract(text, r"(?i)Balance\s+as\s+on\s+[^\n:]+:\s*(?:(?:\(?cid:9\)?|INR|Rs\.?)\s*)?([0-9,.-]+)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast(MONEY)


def scanned_documents(lines: DataFrame, least_per_page: int = 30) -> DataFrame:
    """(doc_id, chars, pages, is_scanned): documents with too few characters a page hold no text."""
    sums = lines.groupBy("doc_id").agg(F.sum(F.length(F.trim("line"))).alias("chars"), F.count_distinct("page_number").alias("pages"))
    return sums.withColumn("is_scanned", F.col("chars") <= F.col("pages") * least_per_page)


def header_sample(lines: DataFrame, pages: int = 3) -> DataFrame:
    return lines.where(F.col("page_number") <= pages)


def authorized(rows: DataFrame, pages: int, col: str = "source_page") -> DataFrame:
    """Rows of allowed pages, and rows without a page."""
    return rows.where(F.col(col).isNull() | (F.col(col) <= pages))


def page_diagnostics(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Per page: dated lines, extracted records, and up to five dated lines beyond that number that no record holds.

    Pages are counted first. Only those with more dated lines than records can
    have such lines, so only their lines are compared with the records' lines.
    """
    dated = F.trim("line").rlike(r"^\s*[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b")
    marked, page = lines.withColumn("dated", dated), ["doc_id", "page_number"]
    per_page = found.groupBy(*page).agg(F.count(F.lit(1)).alias("got"))
    counts = marked.groupBy(*page).agg(F.count_if("dated").alias("n_dated")).join(per_page, page, "left")
    counts = written(counts.select(*page, "n_dated", F.coalesce("got", F.lit(0)).alias("got")), "page-counts")
    detected, extracted = F.greatest("n_dated", "got").alias("detected"), F.col("got").alias("extracted")
    over = counts.where("n_dated > got").select(F.col("doc_id").alias("o_doc"), F.col("page_number").alias("o_page"), F.col("got").alias("o_got"))
    if over.isEmpty():
        return counts.select(*page, detected, extracted, F.lit("").alias("unparsed"))
    # Lines without a document or page number are a page too, as in the counts.
    on_page = F.col("doc_id").eqNullSafe(F.col("o_doc")) & F.col("page_number").eqNullSafe(F.col("o_page"))
    beyond = marked.where("dated").join(over, on_page).withColumn("n", F.row_number().over(Window.partitionBy("o_doc", "o_page").orderBy("line_no"))).where("n > o_got")
    own = found.join(over.drop("o_got"), (F.col("doc_id") == F.col("o_doc")) & (F.col("page_number") == F.col("o_page")), "left_semi")
    held = own.select(F.col("doc_id").alias("h_doc"), F.col("page_number").alias("h_page"), F.explode("source_lines").alias("held")).withColumn("held", F.trim("held"))
    loose = beyond.join(held, (F.col("o_doc") == F.col("h_doc")) & (F.col("o_page") == F.col("h_page")) & (F.trim("line") == F.col("held")), "left_anti")
    piece = F.struct("line_no", F.substring(F.trim("line"), 1, 120).alias("t"))
    told = loose.groupBy("o_doc", "o_page").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(piece)), 1, 5), lambda x: x["t"]), "|").alias("loose"))
    return counts.join(told, on_page, "left").select(*page, detected, extracted, F.coalesce("loose", F.lit("")).alias("unparsed"))

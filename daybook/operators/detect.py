"""Which bank issued a statement: weighted signatures in its first page's head.

Signatures are a parameter of every call: banks with patterns of six kinds. A
page is not searched once per bank: the first three letters of what each pattern
must begin with are looked up among the page's own groups of three letters, so
only patterns that may be there are tried, each distinct one once, however many
banks share it. The work for a page depends on the page and on what it holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.segment import ANCHOR

# Weights by kind of signature.
WEIGHTS = {"HEADER_NAME": 70.0, "IFSC_LABELED": 65.0, "IFSC_HEADER": 50.0, "DOMAIN": 35.0, "HEADER_MARKER": 25.0, "ACCOUNT_PATTERN": 25.0, "COLUMN_PATTERN": 30.0}
HEAD_WORDS = ("DATE", "PARTICULARS", "DESCRIPTION", "WITHDRAWAL", "DEPOSIT", "BALANCE", "CHQ", "REF NO", "POST DATE", "VAL DATE", "TXN DATE")
META_WORDS = ("ACCOUNT DESCRIPTION", "ACCOUNT TYPE", "PRODUCT :", "SCHEME :", "BRANCH :")
AMOUNT_WORDS = ("WITHDRAWAL", "DEPOSIT", "DEBIT", "CREDIT", "BALANCE")
LABELED_IFSC = r"(?i)(?:IFS\s*Code|IFSC|RTGS/NEFT\s*IFSC)[\s:-]+([A-Z0-9]+)"
UNKNOWN_BANK, MANUAL = "Unable to confidently identify", "manual_selection_required"


@dataclass(frozen=True)
class Signature:
    """One bank: its patterns by kind."""

    bank_name: str
    parser_key: str
    header_names: tuple[str, ...] = ()
    ifsc_prefix: str | None = None
    domains: tuple[str, ...] = ()
    header_markers: tuple[str, ...] = ()
    account_patterns: tuple[str, ...] = ()
    column_patterns: tuple[str, ...] = ()


def signature(name: str, code: str, domain: str, parser_key: str = "generic_standard", account: str | None = None, markers: tuple[str, ...] = ()) -> Signature:
    """A signature by rule: the name's words, the branch code's beginning, the site, and an account number of so many digits."""
    words = r"\b" + r"\s+".join(name.split()) + r"\b"
    numbers = (rf"(?:Account|A/c)\s*(?:No|Number)?\.?\s*:?\s*([0-9]{{{account}}})\b",) if account else ()
    return Signature(name, parser_key, (words,), f"{code}0" if code else None, (domain,), markers, numbers)


def signatures_of(banks: DataFrame) -> tuple[Signature, ...]:
    """Signatures from a list of banks (ord, bank_name, code, site, parser_key, digits): a few dozen rows."""
    return tuple(signature(r["bank_name"], r["code"], r["site"], r["parser_key"], r["digits"]) for r in banks.orderBy("ord").collect())


#: The field of a signature that holds patterns of a kind.
FIELDS = {"HEADER_NAME": "header_names", "DOMAIN": "domains", "HEADER_MARKER": "header_markers", "ACCOUNT_PATTERN": "account_patterns", "COLUMN_PATTERN": "column_patterns"}


def signatures_from(rows: Iterable[tuple[int, str, str, str, str]]) -> tuple[Signature, ...]:
    """Signatures from a list of (ord, bank_name, parser_key, kind, pattern) in any order; kinds are those of FIELDS and IFSC_PREFIX."""
    banks: dict[int, dict] = {}
    for i, name, parser, kind, pattern in sorted(rows, key=lambda r: r[0]):
        of = banks.setdefault(i, {"bank_name": name, "parser_key": parser})
        if kind == "IFSC_PREFIX":
            of["ifsc_prefix"] = pattern
        else:
            of[FIELDS[kind]] = (*of.get(FIELDS[kind], ()), pattern)
    return tuple(Signature(**x) for x in banks.values())


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*[text.contains(w).cast("int") for w in words], F.lit(0)) == 1


def _count(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def header_text(first_page: Column) -> Column:
    """The lines before the transaction table: before a line of three table words, of two with a date and an amount word, or with a date in front."""
    lines = F.filter(F.transform(F.split(first_page, "\n"), lambda x: F.trim(x)), lambda x: x != "")

    def begins(line: Column) -> Column:
        up = F.upper(line)
        n = _count(up, HEAD_WORDS)
        return ~_any(up, META_WORDS) & ((n >= 3) | ((n >= 2) & up.contains("DATE") & _any(up, AMOUNT_WORDS)) | line.rlike(ANCHOR))

    flags = F.transform(lines, lambda x: begins(x).cast("int"))
    at = F.array_position(flags, 1)
    head = F.when(at > 0, F.slice(lines, 1, (at - 1).cast("int"))).otherwise(lines)
    return F.when(F.size(head) > 0, F.array_join(head, "\n")).otherwise(F.array_join(F.slice(lines, 1, 25), "\n"))


def begins_with(pattern: str) -> tuple[str, ...] | None:
    """Texts one of which every match of a pattern begins with (letters in any case); none if that can't be told from its first part."""
    depth, escaped, in_class = 0, False, False
    for c in pattern:
        if escaped or c == "\\":
            escaped = not escaped
            continue
        in_class = c == "[" or (in_class and c != "]")
        depth += 0 if in_class else (c == "(") - (c == ")")
        if c == "|" and depth == 0 and not in_class:
            return None
    rest = pattern.removeprefix(r"\b")
    group = re.match(r"\(\?:([A-Za-z0-9/ |-]+)\)(?![?*{])", rest)
    if group:
        told = tuple(group[1].split("|"))
    else:
        literal = re.match(r"(?:[A-Za-z0-9 -]|\\[.\-])*", rest)[0]
        if re.match(r"[?*{]", rest[len(literal) :]):
            literal = re.sub(r"(?:\\.|.)$", "", literal)  # the last letter may be missing
        told = (literal.replace("\\", ""),)
    return told if all(len(x) >= GRAM for x in told) else None


#: Letters of a group by which patterns are looked up.
GRAM = 3


@dataclass(frozen=True)
class Index:
    """Distinct patterns, which texts they are for, who has them, and by which groups of letters they are found."""

    patterns: list[str]
    in_page: list[bool]
    owners: list[list[int]]
    by_gram: dict[str, list[int]]
    always: list[int]
    by_prefix: dict[str, list[int]]
    of_signature: list[tuple]


def indexed(signatures: tuple[Signature, ...]) -> Index:
    ids: dict[tuple[str, bool], int] = {}
    owners: list[list[int]] = []

    def ids_of(patterns: Iterable[str], owner: int, in_page: bool = False) -> list[int]:
        out = []
        for p in patterns:
            k = ids.setdefault((p, in_page), len(ids))
            owners.extend([] for _ in range(k + 1 - len(owners)))
            owners[k].append(owner)
            out.append(k)
        return out

    rows, by_prefix = [], {}
    for i, s in enumerate(signatures):
        if s.ifsc_prefix:
            by_prefix.setdefault(s.ifsc_prefix, []).append(i)
        printed = [rf"\b{s.ifsc_prefix}[0-9A-Z]{{6}}\b"] if s.ifsc_prefix else []
        accounts = [ids_of([a], i) + ids_of([a], i, True) for a in s.account_patterns]
        rows.append((
            i, s.bank_name, s.parser_key, s.ifsc_prefix, ids_of(s.header_names, i), ids_of(printed, i), ids_of([re.escape(d) for d in s.domains], i), ids_of(s.header_markers, i), [x for pair in accounts for x in pair],
            ids_of(s.column_patterns, i, True), [f"(?i){a}" for a in s.account_patterns],
        ))
    by_gram, always = {}, []
    for (pattern, _), k in ids.items():
        told = begins_with(pattern)
        for gram in {x[:GRAM].lower() for x in told or ()}:
            by_gram.setdefault(gram, []).append(k)
        if told is None:
            always.append(k)
    return Index([f"(?i){p}" for p, _ in ids], [in_page for _, in_page in ids], owners, by_gram, always, by_prefix, rows)


def _grams(text: Column) -> tuple[Column, Column]:
    """The letters of a text, A-Z made small, and of a column ``letters`` the distinct groups."""
    letters = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "")
    places = F.sequence(F.lit(0), F.size("letters") - GRAM)
    one = lambda i: F.concat(*[F.get("letters", i + k) for k in range(GRAM)])
    return letters, F.when(F.size("letters") >= GRAM, F.array_distinct(F.transform(places, one))).otherwise(F.array().cast("array<string>"))


def with_matches(documents: DataFrame, index: Index, page: str = "first_page") -> DataFrame:
    """Documents with ``head``, ``labeled`` (a labelled branch code), ``tried`` and ``matched``: ids of patterns that were tried and that match."""
    one_row = documents.sparkSession.createDataFrame(
        [(list(index.by_gram), index.by_gram, index.always, index.patterns, index.in_page)], "grams array<string>, by_gram map<string,array<int>>, always array<int>, patterns array<string>, in_page array<boolean>"
    )
    letters, grams = _grams(F.col(page))
    docs = documents.withColumn("head", header_text(F.col(page))).withColumn("labeled", F.upper(F.regexp_extract("head", LABELED_IFSC, 1)))
    docs = docs.withColumn("letters", letters).withColumn("own_grams", grams).drop("letters").crossJoin(F.broadcast(one_row))  # one row
    found = F.flatten(F.transform(F.array_intersect("own_grams", "grams"), lambda g: F.element_at("by_gram", g)))
    docs = docs.withColumn("tried", F.array_distinct(F.concat(found, "always")))
    text = lambda i: F.when(F.get("in_page", i), F.col(page)).otherwise(F.col("head"))
    return docs.withColumn("matched", F.filter("tried", lambda i: F.rlike(text(i), F.get("patterns", i)))).drop("own_grams", "grams", "by_gram", "always", "patterns", "in_page")


def scores(documents: DataFrame, signatures: tuple[Signature, ...], page: str = "first_page") -> DataFrame:
    """(doc_id, ord, bank_name, parser_key, score, account, ifsc) of every bank with a score above 0."""
    index = indexed(signatures)
    spark = documents.sparkSession
    kinds = "ord int, bank_name string, parser_key string, prefix string, header array<int>, printed array<int>, domains array<int>, markers array<int>, accounts array<int>, columns array<int>, account_patterns array<string>"
    known = spark.createDataFrame(index.of_signature, kinds)
    owners = spark.createDataFrame([(index.owners, index.by_prefix)], "owners array<array<int>>, by_prefix map<string,array<int>>")
    docs = with_matches(documents, index, page).crossJoin(F.broadcast(owners))  # one row
    labelled = [F.coalesce(F.element_at("by_prefix", F.substring("labeled", 1, n)), F.array().cast("array<int>")) for n in sorted({len(x) for x in index.by_prefix})]
    some = F.array_distinct(F.concat(F.flatten(F.transform("matched", lambda i: F.get("owners", i))), *labelled))
    # the banks are a parameter; Spark broadcasts the list by its size
    both = docs.withColumn("ord", F.explode(some)).drop("owners", "by_prefix").join(known, "ord")
    has = lambda c: F.coalesce(F.arrays_overlap("matched", c), F.lit(False))
    by_label = F.coalesce(F.col("labeled").startswith(F.col("prefix")), F.lit(False))
    printed = F.when(has("printed"), F.upper(F.regexp_substr("head", F.concat(F.lit(r"(?i)\b"), "prefix", F.lit(r"[0-9A-Z]{6}\b")))))
    found = F.expr(f"filter(flatten(transform(account_patterns, p -> array(regexp_extract(head, p, 1), regexp_extract(`{page}`, p, 1)))), x -> x <> '')")
    account = F.when(has("accounts"), F.get(found, F.lit(0)))
    score = (
        F.when(has("header"), WEIGHTS["HEADER_NAME"]).otherwise(0.0)
        + F.when(by_label, WEIGHTS["IFSC_LABELED"]).when(printed.isNotNull(), WEIGHTS["IFSC_HEADER"]).otherwise(0.0)
        + F.when(has("domains"), WEIGHTS["DOMAIN"]).otherwise(0.0)
        + F.size(F.array_intersect("matched", "markers")) * WEIGHTS["HEADER_MARKER"]
        + F.when(account.isNotNull(), WEIGHTS["ACCOUNT_PATTERN"]).otherwise(0.0)
        + F.when(has("columns"), WEIGHTS["COLUMN_PATTERN"]).otherwise(0.0)
    )
    return both.select("doc_id", "ord", "bank_name", "parser_key", score.alias("score"), account.alias("account"), F.when(by_label, F.col("labeled")).otherwise(printed).alias("ifsc")).where("score > 0")


def winners(documents: DataFrame, scored: DataFrame) -> DataFrame:
    """Per document the bank, its confidence and tier, and the runner-up; ties keep the signatures' order."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord")
    top = scored.withColumn("place", F.row_number().over(w)).where("place <= 2")
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    two = top.groupBy("doc_id").agg(*[pick(1, c).alias(c) for c in ("bank_name", "parser_key", "score", "account", "ifsc")], pick(2, "bank_name").alias("runner_up"), pick(2, "score").alias("runner_score"))
    all_docs = documents.select("doc_id").join(two, "doc_id", "left")
    score, margin = F.coalesce("score", F.lit(0.0)), F.coalesce("score", F.lit(0.0)) - F.coalesce("runner_score", F.lit(0.0))
    tier = F.when(score < 40, "LOW").when((score >= 80) & (margin >= 25), "HIGH").when((score >= 50) & (margin >= 15), "MEDIUM").when(margin < 15, "AMBIGUOUS").otherwise("LOW")
    conf = (
        F.when(score < 40, 0.0).when(tier == "HIGH", F.least(F.lit(99.0), F.greatest(F.lit(85.0), 75.0 + margin / 3.0))).when(tier == "MEDIUM", F.least(F.lit(84.0), F.greatest(F.lit(60.0), score)))
        .when(tier == "AMBIGUOUS", 45.0).otherwise(30.0)
    )
    sure = tier.isin("HIGH", "MEDIUM")
    some = score >= 40
    mask = F.when(F.length("account") >= 4, F.concat(F.lit("XXXX"), F.right("account", F.lit(4)))).otherwise(F.col("account"))
    return all_docs.select(
        "doc_id", F.when(sure, F.col("bank_name")).otherwise(UNKNOWN_BANK).alias("bank_name"), F.when(sure, F.col("parser_key")).otherwise(MANUAL).alias("parser_key"),
        F.round(conf, 1).alias("confidence"), tier.alias("tier"), (~sure).alias("is_ambiguous"), F.when(some, mask).alias("account_masked"), F.when(some, F.col("ifsc")).alias("ifsc"),
        F.when(some, F.col("runner_up")).alias("runner_up"),
    )


def parser_for(names: DataFrame, registry: DataFrame) -> DataFrame:
    """The parser of a bank's name: an equal name, else one that holds or is held by it, in the registry's order. (name, parser_key)"""
    a, b = F.lower("name"), F.lower("bank_name")
    # The registry is a list of parsers, a few dozen rows; Spark broadcasts it by its size.
    near = names.join(registry, a.contains(b) | b.contains(a))
    best = near.groupBy("name").agg(F.min(F.struct(F.when(a == b, 0).otherwise(1).alias("t"), "ord", "parser_key")).alias("m"))
    return names.join(best, "name", "left").select("name", F.coalesce("m.parser_key", F.lit("generic_standard")).alias("parser_key"))

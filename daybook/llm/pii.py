"""Personal data by candidate gradient boosting, in SQL expressions throughout.

Method: high-recall generators propose overlapping spans; boosted trees on
features of a span's format and of its context score them; a threshold on the
calibrated score selects spans. The base kinds (email, ip, card, phone) are
exact patterns whose spans always stay; the method adds spans of the kinds
``contact`` (addresses written out), ``number`` (telephone and identity numbers
without a plus) and ``secret`` (keys and tokens). Candidates have no greatest
length. Where chosen candidates overlap, of any of these kinds, the one with the
best score of the overlapping group stays, and of the others those beside it.

The trees are fitted on the driver on ``Model.rows`` generated, labelled strings
(a bounded sample with a fixed seed; no corpus rows are needed) and become CASE
WHEN expressions. Places are code points: pieces between matches and matches
alternate in a text, so their lengths add up to the places. Running sums and
maxima over arrays double their reach in each pass, so the work grows with the
length of a text and the logarithm of its matches.

Repetition is written with single character classes only (after marking the
separators that join), since a repeated group would exhaust the stack of the
expression engine on long texts.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; redaction leaves a null text null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm import boosting
from daybook.llm.common import own_name, whole_text

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("contact", "number", "secret")
#: Order of kinds that start at the same place.
KINDS = BASE_KINDS + MORE_KINDS
JOIN = "\x01"
SPAN = "array<struct<start:bigint,end:bigint,found:string,before:string>>"
PLACED = "array<struct<start:bigint,end:bigint,kind:int,score:double>>"
#: Characters before a candidate that its context features see.
_BEFORE = 24


@dataclass(frozen=True)
class Model:
    """Parameters: how many labelled strings the trees are fitted on, their seed, the least calibrated probability."""

    rows: int = 3000
    seed: int = 11
    probability: float = 0.9


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array, all values up to it joined; each pass doubles how far back a place has seen."""

    def passes(v: Column) -> Column:
        n = F.length(F.bin(F.greatest(F.size(v) - 1, F.lit(1))))
        reach = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        return F.aggregate(reach, v, lambda acc, r: F.transform(acc, lambda x, i: F.when(i >= r, join(F.get(acc, i - r), x)).otherwise(x)))

    return _let(values, passes)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, gate: Callable[[Column], Column]) -> Column:
    """Matches with their places and what stands before them, for texts that pass the ``gate`` (a cheap test that every
    text with a match passes). ``split`` and ``regexp_extract_all`` walk the text alike, so pieces and matches alternate."""

    def placed(found: Column, between: Column) -> Column:
        ends = _running(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long")), _sum)
        before = lambda i: F.right(F.concat(F.coalesce(F.right(F.get(found, i - 1), F.lit(_BEFORE)), F.lit("")), F.get(between, i)), F.lit(_BEFORE))
        each = lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("found"), before(i).alias("before")))
        return _let(ends, each)

    def all_of(t: Column) -> Column:
        none = F.array().cast(SPAN)
        return _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, _let(F.split(t, pattern, -1), lambda between: placed(found, between))).otherwise(none))

    return F.when(gate(text), _let(text, all_of)).otherwise(F.array().cast(SPAN))


def _has(*parts: str) -> Callable[[Column], Column]:
    """A gate: any of the parts stands in the text."""

    def gate(text: Column) -> Column:
        out = F.lit(False)
        for x in parts:
            out = out | text.contains(x)
        return out

    return gate


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def _joined(text: Column, separators: str, between: str) -> Column:
    """``text`` with JOIN for each separator between two characters of a class; as long as before."""
    return F.regexp_replace(F.translate(text, JOIN, "\x02"), f"(?<={between}){separators}(?={between})", JOIN)


def email_spans(text: Column) -> Column:
    label, local = "[A-Za-z0-9-]", "[A-Za-z0-9._%+\x01-]"
    # A match begins where a run of address characters begins, or where the match before ended.
    found = _spans(_joined(text, r"\.", label), rf"(?:(?<!{local})|\G){local}+@{label}+{JOIN}[A-Za-z0-9\x01-]+", _has("@"))
    return F.when(text.contains("@"), found).otherwise(F.array().cast(SPAN))


def ip_spans(text: Column) -> Column:
    found = _spans(text, r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _like(r"[0-9]\.[0-9]"))
    plain = lambda x: F.ltrim(x, F.lit("0"))
    small = lambda x: (F.length(plain(x)) <= 2) | ((F.length(plain(x)) == 3) & (plain(x) <= "255"))
    return F.filter(found, lambda s: F.forall(F.split(s["found"], r"\."), small))


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second doubled and its digits added."""
    each = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def card_spans(text: Column) -> Column:
    enough = r"[0-9](?:[ -]?[0-9]){11}"
    found = F.when(text.rlike(enough), _spans(_joined(text, "[ -]", "[0-9]"), r"[0-9][0-9\x01]*", _like("[0-9]"))).otherwise(F.array().cast(SPAN))
    digits = lambda s: F.translate(s["found"], JOIN, "")
    sized = F.filter(found, lambda s: F.length(digits(s)).between(12, 19))
    return F.filter(sized, lambda s: _luhn(digits(s)))


def phone_spans(text: Column) -> Column:
    found = _spans(text, r"\+[0-9][ ().0-9-]+[0-9]", _has("+"))
    return F.filter(found, lambda s: F.length(F.translate(s["found"], "+ ().-", "")).between(9, 15))


def base_spans(text: Column) -> dict[str, Column]:
    return {"email": email_spans(text), "ip": ip_spans(text), "card": card_spans(text), "phone": phone_spans(text)}


# Generators of further candidates, several a kind, whose spans may overlap. Each unbounded stretch is of one
# class and begins only where its class does (or at a digit), so long texts are walked once.
_GATES = {"contact": _like(r"[\[(](?:at|AT)[\])]"), "number": _like(r"[0-9][0-9 ()./-]{4,}[0-9]"), "secret": _like(r"[A-Za-z0-9_/+-]{16}")}
_CANDIDATES = {
    "contact": (r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]+ ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,}",),
    "number": (
        r"(?<![0-9A-Za-z.+-])(?=[( ]{0,3}[0-9])[0-9(][0-9 ()./-]{6,}[0-9](?![0-9A-Za-z])",  # a run of groups
        r"(?<![0-9A-Za-z.+-])(?=\(?[0-9])[0-9(][0-9()./-]{6,}[0-9](?![0-9A-Za-z])",  # its parts without a space
        r"(?<![0-9A-Za-z.+-])(?:\([0-9]{1,5}\) ?|[0-9]{3}[ .-])[0-9]{2,5}[ .-][0-9]{3,5}(?![0-9A-Za-z])",  # single numbers of three groups
    ),
    "secret": (
        r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}",
        r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}={0,2}",  # the value alone where a name and = stand before it
    ),
}
_SPEAKING = r"(?i)(?:tel|phone|call|mobile|fax|ssn|iban|account|passport|key|token|secret|password|passwd|pwd|api|auth|bearer|contact|mail|id)[a-z]{0,8}[\s:=#\"'.-]{0,6}$"
FEATURES = ("kind", "length", "digits", "capitals", "lower", "separators", "changes", "groups", "speaking", "colon", "inner_equals")


def _features(kind: str, found: Column, before: Column) -> dict[str, Column]:
    """Format (length, kinds of characters, changes between letters and digits, groups) and context (what stands before)."""
    removed = lambda cls: F.length(found) - F.length(F.regexp_replace(found, cls, ""))
    matches = lambda pattern: F.size(F.regexp_extract_all(found, F.lit(pattern), F.lit(0)))
    return {
        "kind": F.lit(float(MORE_KINDS.index(kind))),
        "length": F.length(found).cast("double"),
        "digits": removed("[0-9]").cast("double"),
        "capitals": removed("[A-Z]").cast("double"),
        "lower": removed("[a-z]").cast("double"),
        "separators": removed("[ ()./_+=-]").cast("double"),
        "changes": matches("(?:[A-Za-z][0-9]|[0-9][A-Za-z])").cast("double"),
        "groups": matches("[A-Za-z0-9]+").cast("double"),
        "speaking": before.rlike(_SPEAKING).cast("double"),
        "colon": before.rlike(r"[:=]\s?[\"']?$").cast("double"),
        "inner_equals": matches("=[A-Za-z0-9]").cast("double"),
    }


def _example_features(kind: str, found: str, before: str) -> list[float]:
    """The same features of one labelled string, for fitting."""
    import re

    count = lambda cls: sum(1 for _ in re.finditer(cls, found))
    return [
        float(MORE_KINDS.index(kind)), len(found), count("[0-9]"), count("[A-Z]"), count("[a-z]"), count("[ ()./_+=-]"),
        count("(?:[A-Za-z][0-9]|[0-9][A-Za-z])"), count("[A-Za-z0-9]+"),
        float(bool(re.search(_SPEAKING.replace("$", r"\Z"), before))), float(bool(re.search(r"[:=]\s?[\"']?\Z", before))), count("=[A-Za-z0-9]"),
    ]


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates, half of them personal data, drawn from their own formats and everyday look-alikes."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda x: x[int(rng.integers(len(x)))]
    syllable = ("an", "ber", "co", "del", "ent", "fo", "ing", "ka", "lo", "men", "nor", "pre", "sta", "tion", "ver")
    word = lambda a, b: "".join(pick(syllable) for _ in range(int(rng.integers(a, b))))
    token = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    good = (
        lambda: ("contact", f"{word(1, 3)}.{word(1, 3)} [at] {word(1, 3)} [dot] {pick(('com', 'org', 'net'))}", pick(("contact: ", "mail ", " ", "write to "))),
        lambda: ("number", f"({digits(3)}) {digits(3)}-{digits(4)}", pick(("tel: ", "phone ", "call ", word(1, 3) + " "))),
        lambda: ("number", f"{digits(3)}-{digits(2)}-{digits(4)}", pick(("ssn ", "SSN: ", "id: ", word(1, 3) + " "))),
        lambda: ("number", f"{digits(3)}-{digits(3)}-{digits(4)}", pick(("fax: ", "mobile ", "tel. ", word(1, 3) + " "))),
        lambda: ("secret", token(int(rng.integers(20, 64))), pick(("key=", "token: ", "secret=", "password: ", " "))),
        lambda: ("secret", f"{pick(('sk', 'pk', 'ghp', 'AKIA'))}_{token(int(rng.integers(16, 40)))}", pick(("key: ", "api_key=", " "))),
    )
    bad = (
        lambda: ("number", f"{1900 + int(rng.integers(140))}-{1900 + int(rng.integers(140))}", pick(("in ", "from ", word(1, 3) + " "))),
        lambda: ("number", f"{digits(4)}/{digits(2)}/{digits(2)}", pick(("on ", "dated ", " "))),
        lambda: ("number", " ".join(digits(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 8)))), pick(("row ", "table ", word(1, 3) + " "))),
        lambda: ("number", digits(int(rng.integers(8, 20))), pick(("page ", "sum ", word(1, 3) + " "))),
        lambda: ("number", f"{digits(2)}.{digits(3)}.{digits(3)}", pick(("about ", "total ", word(1, 3) + " "))),
        lambda: ("secret", word(7, 14), pick((word(1, 3) + " ", "the ", "a key "))),
        lambda: ("secret", word(7, 14).upper(), pick((word(1, 3) + " ", "the "))),
        lambda: ("secret", "-".join(word(1, 4) for _ in range(5)), pick((word(1, 3) + " ", "see "))),
        lambda: ("secret", "".join(pick("=-_") for _ in range(int(rng.integers(16, 60)))), pick((" ", "\n"))),
        lambda: ("secret", "_".join(word(1, 4) for _ in range(4)), pick((" ", "call ", "id: "))),
        # A name with its value: the value alone is the candidate wanted.
        lambda: ("secret", f"{pick(('key', 'api_key', 'token', 'secret', 'password', word(1, 4)))}={token(int(rng.integers(16, 64)))}", pick((" ", "set ", "\n"))),
        lambda: ("contact", f"{word(1, 3)} (at) {word(1, 3)} (dot) {word(1, 2)}", word(1, 3) + " ") if rng.random() < 0.02 else ("secret", word(8, 12).capitalize(), " "),
    )
    rows = [(*_draw(pick(good)), 1) if i % 2 else (*_draw(pick(bad)), 0) for i in range(n)]
    return np.array([_example_features(*r[:3]) for r in rows]), np.array([float(r[3]) for r in rows])


def _draw(maker) -> tuple[str, str, str]:
    return maker()


@lru_cache(maxsize=8)
def trained(model: Model) -> boosting.Boosted:
    x, y = examples(model.rows, model.seed)
    held = len(x) // 4
    return boosting.fit(FEATURES, x[held:], y[held:], x[:held], y[:held])


def candidates(text: Column, model: Model = Model()) -> Column:  # noqa: B008
    """All candidates of the further kinds whose calibrated score reaches the threshold, as (start, end, kind, score) by start."""
    trees = trained(model)
    limit = trees.cut_at(model.probability)

    def scored(kind: str, spans: Column) -> Column:
        score = lambda s: trees.raw_column(_features(kind, s["found"], s["before"]))
        each = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), score(s).alias("score")))
        return F.filter(each, lambda c: c["score"] >= limit)

    return F.array_sort(F.concat(*[scored(k, _spans(text, pattern, _GATES[k])) for k in MORE_KINDS for pattern in _CANDIDATES[k]]))


def resolved(found: Column) -> Column:
    """Candidates sorted by start, without those that overlap the best one of their group.

    A group is a run of candidates each of which begins before the end of one
    before it. Best is the highest score, then the longest, then the first.
    """

    def groups(c: Column) -> Column:
        begins = lambda ends: F.transform(c, lambda x, i: F.coalesce(x["start"] >= F.get(ends, i - 1), F.lit(True)))
        return _let(_let(_running(F.transform(c, lambda x: x["end"]), F.greatest), begins), lambda new: numbered(c, new))

    def numbered(c: Column, new: Column) -> Column:
        group = _running(F.transform(new, lambda x: x.cast("int")), _sum)
        heads = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.get(new, i))
        return _let(group, lambda g: _let(heads, lambda h: _let(_running(F.transform(c, lambda x, i: F.struct(F.get(g, i).alias("g"), *rank(x))), F.greatest), lambda best: kept(c, g, h, best))))

    def rank(x: Column) -> list[Column]:
        return [x["score"].alias("score"), (x["end"] - x["start"]).alias("length"), (-x["start"]).alias("minus"), (-x["kind"]).alias("kind")]

    def kept(c: Column, g: Column, h: Column, best: Column) -> Column:
        winner = lambda i: F.get(best, F.coalesce(F.get(h, F.get(g, i)), F.size(c)) - 1)
        apart = lambda x, w: (x["end"] <= -w["minus"]) | (x["start"] >= w["length"] - w["minus"])
        same = lambda x, w: (x["start"] == -w["minus"]) & (x["end"] - x["start"] == w["length"]) & (x["kind"] == -w["kind"])
        return F.array_distinct(F.filter(c, lambda x, i: _let(winner(i), lambda w: apart(x, w) | same(x, w))))

    return _let(found, lambda c: F.when(F.size(c) > 1, groups(c)).otherwise(c))


def more_spans(text: Column, model: Model = Model()) -> Column:  # noqa: B008
    """Spans of the further kinds, as (start, end, kind, score) by start."""
    return resolved(candidates(text, model))


def with_spans(documents: DataFrame, model: Model = Model(), text: str = "text", into: str = "spans") -> DataFrame:  # noqa: B008
    """``documents`` with a struct of span arrays, one per kind, of each whole text."""
    whole = whole_text(text)
    base, more = own_name(documents, "base"), own_name(documents, "more")
    found = base_spans(whole)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    told = documents.withColumns({base: F.struct(*[F.transform(found[k], place).alias(k) for k in BASE_KINDS]), more: more_spans(whole, model)})
    of_kind = lambda k: F.transform(F.filter(F.col(more), lambda s: s["kind"] == KINDS.index(k)), place)
    every = F.struct(*[F.col(f"{base}.{k}").alias(k) for k in BASE_KINDS], *[of_kind(k).alias(k) for k in MORE_KINDS])
    return told.withColumn(into, every).drop(base, more)


def _tagged(spans: str, kind: str) -> Column:
    """The spans of one kind as (start, kind's number, end)."""
    number = F.lit(KINDS.index(kind))
    return F.transform(F.col(f"{spans}.{kind}"), lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))


def _listed(spans: str, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given kinds by start, then kind in the order of KINDS, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.concat(*[_tagged(spans, k) for k in kinds]))
    return F.array_join(F.transform(ordered, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def span_report(documents: DataFrame, id_col: str = "doc_id", model: Model = Model()) -> DataFrame:  # noqa: B008
    """Per row: id, counts of the base kinds, base_sha256, all spans as text, and counts of the further kinds."""
    found = with_spans(documents.select(id_col, "text"), model)
    n = lambda k: F.size(f"spans.{k}").cast("long").alias(f"n_{k}")
    return found.select(
        id_col, *[n(k) for k in BASE_KINDS], F.sha2(_listed("spans", BASE_KINDS), 256).alias("base_sha256"), _listed("spans", KINDS).alias("all_spans"), *[n(k) for k in MORE_KINDS]
    ).withColumnRenamed("all_spans", "spans")


#: Texts are cut into parts of so many code points, so that a piece is found without walking its whole text.
_PART = 4096


def _cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is given as parts."""
    first = F.floor(start / _PART).cast("int")
    n = F.least(F.floor((end - 1) / _PART) + 1, F.size(parts).cast("long")).cast("int") - first

    def inside(part: Column, i: Column) -> Column:
        at = (first + i).cast("long") * _PART
        low = F.greatest(start - at, F.lit(0))
        return F.substring(part, (low + 1).cast("int"), (F.least(end - at, F.lit(_PART)) - low).cast("int"))

    return F.when((end > start) & (n > 0), F.array_join(F.transform(F.slice(parts, first + 1, F.greatest(n, F.lit(0))), inside), "")).otherwise("")


def _united(spans: Column) -> Column:
    """Overlapping spans as one: (start, kind of the first, end), from (start, kind, end) in order."""

    def heads(s: Column, ends: Column) -> Column:
        new = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i)["start"] >= F.get(ends, i - 1), F.lit(True)))
        end = lambda h, i: F.get(ends, F.coalesce(F.get(h, i + 1), F.size(s)) - 1)
        return _let(new, lambda h: F.transform(h, lambda at, i: F.struct(F.get(s, at)["start"].alias("start"), F.get(s, at)["kind"].alias("kind"), end(h, i).alias("end"))))

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return _let(spans, lambda s: F.when(F.size(s) > 0, _let(_running(F.transform(s, lambda x: x["end"]), F.greatest), lambda ends: heads(s, ends))).otherwise(none))


def redact(documents: DataFrame, model: Model = Model(), text: str = "text") -> DataFrame:  # noqa: B008
    """``documents`` with every span replaced by its kind in angle brackets; overlapping spans are one, named by the first.

    The other columns stay; ``n_chars``, where it is there, counts anew.
    """
    spans, groups, parts, new = own_name(documents, "spans"), own_name(documents, "groups"), own_name(documents, "parts"), own_name(documents, "redacted")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    found = with_spans(documents, model, text, spans)
    found = found.withColumn(groups, _united(F.array_sort(F.concat(*[_tagged(spans, k) for k in KINDS]))))
    some = F.size(groups) > 0
    found = found.withColumn(parts, F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0))))
    begin = lambda i: F.coalesce(F.get(F.col(groups), i - 1)["end"], F.lit(0))
    pieces = F.transform(F.col(groups), lambda g, i: F.concat(_cut(F.col(parts), begin(i), g["start"]), F.get(names, g["kind"])))
    rest = _cut(F.col(parts), F.element_at(F.col(groups), -1)["end"], F.lit(1 << 62))
    out = found.withColumn(new, F.when(some, F.concat(F.array_join(pieces, ""), rest)))
    out = out.withColumn(text, F.coalesce(F.col(new), F.col(text)))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])

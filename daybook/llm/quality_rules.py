"""Quality rules with adaptive thresholds.

Method: every text gives a few whole-number measures. Per language and source a
mergeable quantile sketch of each measure is kept: counts per bucket, where a
bucket keeps the six leading binary digits of a value (relative error below
1/32). Sketches merge by adding counts, so partial sketches are summed before
the shuffle and the sketches of a language, or of all rows, are sums of the
finer ones. A group's fence is its median plus a multiple of the distance from
the median to the upper quartile, never below a least width; groups with few
rows take the fence of their language, then of all rows. The fences are joined
back to the rows and a text beyond any fence is rejected.

Defined results: a null or empty text has no words and fails the base rule; a
null language or source is read as the empty name; repeated rows count as often
as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import own_name, whole_text, written

_GAPS = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


@dataclass(frozen=True)
class Rules:
    """Parameters. ``widths``: least distance of a measure's fence from the median, in its own unit."""

    least_words: int = 10
    most_repeated_percent: int = 20
    spread: int = 6
    least_group: int = 50
    widths: tuple[tuple[str, int], ...] = (("symbols", 100), ("capitals", 150), ("dup_lines", 300), ("word_length", 400))


def counts_of(text: str, window: int = 5) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    inner = raw.translate(None, _GAPS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > window:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        mixed = h[: n - window + 1].copy()
        for i in range(1, window):
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed += h[i : n - window + 1 + i]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order[1:]] == mixed[order[:-1]]
        if same.any():
            twice = np.zeros(len(mixed), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[: len(mixed)] += twice
            edge[window : window + len(mixed)] -= twice
            repeated = int(np.count_nonzero(np.cumsum(edge[:n])))
    return n, len(text) - (len(raw) - len(inner)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(raw) - len(raw.translate(None, _CAPITALS))


def with_counts(documents: DataFrame, text: str = "text", into: str = "counts") -> DataFrame:
    """``documents`` with a struct of counts of each whole text."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([counts_of(x) for x in texts], columns=list(COUNTS))

    run = F.pandas_udf(rows, ", ".join(f"{c} long" for c in COUNTS))
    return documents.withColumn(into, run(whole_text(text)))


def measures(counts: str = "counts") -> dict[str, Column]:
    """Whole-number measures: symbols per 1000 words, capitals per 1000 characters, repeated lines per 1000 lines, hundredths of characters per word."""
    c = lambda name: F.col(f"{counts}.{name}")
    per = lambda a, b, unit: F.when(b > 0, F.floor(a * unit / b)).otherwise(0).cast("long")
    return {
        "symbols": per(c("n_symbols"), c("n_words"), 1000),
        "capitals": per(c("n_capitals"), c("word_chars"), 1000),
        "dup_lines": per(c("n_dup_lines"), c("n_lines"), 1000),
        "word_length": per(c("word_chars"), c("n_words"), 100),
    }


def bucket(value: Column) -> Column:
    """The lower end of a value's bucket: its six leading binary digits, the others zero."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    unit = F.pow(F.lit(2.0), drop).cast("long")
    return value - value % unit


def sketch(counted: DataFrame, lang: str = "lang", source: str = "source", counts: str = "counts") -> DataFrame:
    """(lang, source, measure, bucket, n): a sketch of each measure per group; sum n over groups to merge them."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures(counts).items()])
    long = counted.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.explode(pairs).alias("m"))
    return long.groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda share: F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bucket")))
    q = upto.groupBy(*keys, "measure").agg(at(50).alias("q50"), at(75).alias("q75"), F.max("total").alias("rows"))
    width = F.create_map(*[F.lit(x) for pair in rules.widths for x in pair])
    fence = F.col("q50") + F.greatest(width[F.col("measure")], rules.spread * (F.col("q75") - F.col("q50")))
    return q.select(*keys, "measure", fence.cast("long").alias("fence"), "rows")


def fences(sketches: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(lang, source, fences): a map from measure to fence for every group; small groups take a coarser fence."""
    fine = _quantiles(sketches, ["lang", "source"], rules)
    by_lang = _quantiles(sketches, ["lang"], rules).select("lang", "measure", F.col("fence").alias("lang_fence"), F.col("rows").alias("lang_rows"))
    overall = _quantiles(sketches, [], rules).select("measure", F.col("fence").alias("all_fence"))
    chosen = (
        F.when(F.col("rows") >= rules.least_group, F.col("fence")).when(F.col("lang_rows") >= rules.least_group, F.col("lang_fence")).otherwise(F.col("all_fence"))
    )
    joined = fine.join(by_lang, ["lang", "measure"]).join(overall, "measure")
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", chosen.alias("fence")))).alias("fences"))


def base_failed(rules: Rules, counts: str = "counts") -> Column:
    """Too few words, or too large a share of words in repeated windows."""
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < rules.least_words) | (100 * repeated > rules.most_repeated_percent * n)


def judged(counted: DataFrame, limits: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source", counts: str = "counts", into: str = "kept") -> DataFrame:  # noqa: B008
    """``counted`` joined with its group's fences; ``into`` tells whether a row stays."""
    a, b, c = own_name(counted, "fence_lang"), own_name(counted, "fence_source"), own_name(counted, "fences")
    limits = limits.select(F.col("lang").alias(a), F.col("source").alias(b), F.col("fences").alias(c))
    joined = counted.join(limits, (F.coalesce(counted[lang], F.lit("")) == F.col(a)) & (F.coalesce(counted[source], F.lit("")) == F.col(b)), "left")
    beyond = F.lit(False)
    for k, v in measures(counts).items():
        beyond = beyond | F.coalesce(v > F.col(c)[k], F.lit(False))
    return joined.withColumn(into, ~base_failed(rules, counts) & ~beyond).drop(a, b, c)


def judge_documents(documents: DataFrame, id_col: str = "doc_id", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Counts and verdict per row of ``documents``, without the texts."""
    rows = written(with_counts(documents.select(id_col, "text", "lang", "source")).drop("text"), "quality")
    # Written first: Spark then knows its size (a row a group) and broadcasts it only below its limit, without dealing the rows by group.
    limits = written(fences(sketch(rows), rules), "fences")
    return judged(rows, limits, rules).withColumn("base_failed", base_failed(rules))


def filter_documents(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The rows of ``documents`` that stay, with their own columns."""
    counts, kept = own_name(documents, "counts"), own_name(documents, "kept")
    counted = written(with_counts(documents, into=counts), "counted")
    limits = written(fences(sketch(counted.select("lang", "source", counts), counts=counts), rules), "fences")
    return judged(counted, limits, rules, counts=counts, into=kept).where(F.col(kept)).select(*[F.col(f"`{x}`") for x in documents.columns])

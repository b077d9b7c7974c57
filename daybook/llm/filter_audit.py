"""Filter interaction audit: what each filter removes in each order, from counts of failure masks.

Every row has a mask of the filters that it fails. Per part only the rows per
mask are counted (32 numbers for five filters); a subset-zeta transform turns
them into the survivors of every subset of filters: survivors(S) is the sum over
masks within the complement of S. A step of an order goes from one subset to a
neighbouring one, so what it removes is a difference of two survivors, and a
Shapley value is a weighted sum of such differences. The rows are read once, however
many orders there are; the transform runs over arrays of 2^k numbers, one row a part.

The last filter, "identical to a text of a smaller id", needs no join of copies
with one another: of each text the smallest id is found by a combining
aggregate, rows that have it are counted by mask, and the rest of the part's
rows with that mask fail it.

Defined results: a null text is the empty one; a null part is the empty string;
a null id is neither smaller than another nor has a smaller one; rows with the
same id and text are no copies of a smaller id; a document has a label if any
row of the labels gives it. An empty table gives no rows. Further columns are
not read, whatever their names.
"""

from __future__ import annotations

import string
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import WORD_GAP, whole_text, written

COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions that a text alone decides, by letter."""
    words = F.filter(F.split(text, WORD_GAP), lambda x: x != "")
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, good, toxic) of every row, written once; the mask has a bit for each of A to D."""
    told = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])
    texts = documents.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), whole_text("text").alias("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    rows = texts.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask"))
    return written(rows.join(told, "doc_id", "left").fillna(0, ["good", "toxic"]), "judged")


def mask_counts(rows: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) with the bit of E in the mask; masks without rows may be missing."""
    totals = [F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.where("doc_id IS NOT NULL").join(least, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL"))
    firsts = first.groupBy("part", "mask").agg(*totals)
    every = rows.groupBy("part", "mask").agg(*totals)
    minus = firsts.select("part", (F.col("mask") + 16).alias("mask"), *[(-F.col(c)).alias(c) for c in COUNTS])
    both = firsts.unionByName(every.withColumn("mask", F.col("mask") + 16)).unionByName(minus)
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS])


def zeta(counts: Column, filters: int) -> Column:
    """For every mask the sum over its subsets: one pass a bit, adding what lacks that bit."""
    places = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    has = lambda i, b: F.call_function("shiftright", i, b).bitwiseAND(1) == 1
    without = lambda i, b: i.bitwiseXOR(F.call_function("shiftleft", F.lit(1), b))
    one_bit = lambda acc, b: F.transform(places, lambda i: F.get(acc, i) + F.when(has(i, b), F.get(acc, without(i, b))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(filters - 1)), counts, one_bit)


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """Per part, for each count an array that holds at place m how many rows fail filters of m only (the survivors of all others), and ``alone``: rows by exact mask."""
    listed = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), lambda i: F.coalesce(F.element_at("by_mask", i)[c], F.lit(0)).cast("long"))
    arrays = counts.groupBy("part").agg(listed.alias("by_mask")).select("part", *[dense(c).alias(c) for c in COUNTS])
    return arrays.select("part", F.col("n").alias("alone"), *[zeta(F.col(c), filters).alias(c) for c in COUNTS])


def audit(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the counts by mask (bit i: the i-th letter)."""
    k = len(letters)
    full = (1 << k) - 1
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)]))
    steps = survivors(counts, k).withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    taken = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc.bitwiseOR(bit(F.substr("filter_order", i, F.lit(1)))))
    steps = steps.withColumn("own", bit(F.substr("filter_order", "step", F.lit(1)))).withColumn("after", taken)
    steps = steps.withColumn("before", F.col("after").bitwiseXOR(F.col("own")))
    left = lambda c, subset: F.get(F.col(c), F.lit(full).bitwiseXOR(subset))
    lost = lambda c, subset: left(c, subset) - left(c, subset.bitwiseOR(F.col("own")))
    orders_of = F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)])
    weighted = lambda subset: F.get(orders_of, F.bit_count(subset)) * lost("n", subset)
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"), lambda acc, s: acc + F.when(s.bitwiseAND(F.col("own")) == 0, weighted(s)).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", left("n", F.col("after")).alias("kept"), lost("n", F.col("before")).alias("removed"),
        (lost("n", F.lit(0)) - lost("n", F.col("before"))).alias("redundant"), F.get("alone", F.col("own")).alias("unique_fails"),
        lost("good", F.col("before")).alias("good_lost"), lost("toxic", F.col("before")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over all documents, by source."""
    return audit(mask_counts(judged(documents, labels)))

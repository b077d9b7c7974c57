"""Best-fit packing of token sequences.

Method: bulk-synchronous best fit. Lengths go from the longest band to the
shortest. In a round the band's documents and the open gaps are sorted by range
of size; a successor sweep from the largest size down gives each document the
smallest gap that no document before it took (running sums over the sizes, of
which there are at most ``capacity``); conflicts are resolved by rank, the k-th
document that finds a size taking the k-th open gap; the gaps are updated in
Spark, and what is left goes to the next round. Only when no gap holds any
document of the band are sequences opened. A gap that holds several documents of
the band offers as many slots, so a band takes few rounds (some 30 in all,
whatever the number of rows).

Documents and gaps stay in written tables; the driver sees a count per round.
Ranks come from row numbers in (size, salt) groups plus the counts of the salts
before, so a length that a third of all rows share is spread over salts.

Defined results: a null text is the empty text (one piece with only the end
id); repeated rows are packed as often as they occur; an empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from daybook.llm.common import own_name, whole_text, written, written_paths

CAPACITY = 2048
END_ID = 0
#: The byte-level pre-tokenizer's pattern (fixed value of the vocabulary's format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character and the others as 256, 257, ... in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: tiktoken's expression engine runs out of stack on a run of white space several times as long as this.
LONG_GAP = 20_000
_GAP = re.compile(rf"\s{{{LONG_GAP}}}")

_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as ``tokenizers`` gives them with add_special_tokens=False.

    Most texts are run by tiktoken: same vocabulary and merges, same ids, several
    times as fast. Texts that hold an added token of the file, or a long run of
    white space, go to the library itself.
    """
    if path not in _ENCODERS:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab, added = said["model"]["vocab"], [t["content"] for t in said["added_tokens"]]
        letters = byte_alphabet()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token) and not token.startswith("<|endof")}
        fast = tiktoken.Encoding("from_file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        library: list[Tokenizer] = []

        def ids(text: str) -> list[int]:
            if not any(t in text for t in added) and not (len(text) >= LONG_GAP and _GAP.search(text)):
                return fast(text)
            if not library:
                library.append(Tokenizer.from_file(path))
            return library[0].encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = ids
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, before them what is left."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, length, capacity)]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece: piece, start, length, ids_crc32 beside the kept columns."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer)
        for texts in batches:
            out = []
            for t in texts:
                raw = np.array([*encode(t), END_ID], "<u4").tobytes()
                out.append([(i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(raw) // 4, capacity))])
            yield pd.Series(out)

    run = F.pandas_udf(rows, "array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    cols = [F.col(f"`{c}`") for c in keep]
    return documents.select(*cols, F.explode(run(whole_text(text))).alias("the_piece")).select(*cols, "the_piece.*")


def bands(capacity: int, ratio: float = 1.5) -> list[tuple[int, int]]:
    """(lo, hi] of lengths, from the longest: first all that fill more than half, then each ``ratio`` shorter, doubled below a fifteenth."""
    out, hi = [(capacity // 2, capacity)], capacity // 2
    while hi:
        lo = int(hi / (ratio if hi * 15 > capacity else ratio * 2))
        out.append((lo, hi))
        hi = lo
    return out


def _levels(rows: DataFrame) -> DataFrame:
    """``rows`` (kind 0: slot, 1: document; key: its size; of, layer: what it belongs to; salt) with their level.

    A successor sweep from the largest size down: a document takes the smallest
    slot that holds it and that no document before it took. A slot's level is
    the number of slots that are open below it, and a document is on the level
    of the slot it takes, or on none (below 1). Sums and running minima over at
    most two times ``capacity`` sizes tell how many slots are open at each size;
    within a size the rank decides.
    """
    key = ["kind", "key", "salt"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("minus", -F.col("key")).withColumn("change", F.col("n") * (1 - 2 * F.col("kind")))
    down = Window.orderBy("minus")
    upto, ahead, same = down.rangeBetween(Window.unboundedPreceding, 0), down.rangeBetween(Window.unboundedPreceding, -1), down.rangeBetween(0, 0)
    told = counts.select("*", F.sum("change").over(upto).alias("after"), F.coalesce(F.sum("change").over(ahead), F.lit(0)).alias("before"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).over(same).alias("n_slots"))
    depth = F.col("before") - F.least(F.lit(0), F.coalesce(F.min("after").over(ahead), F.lit(0)))
    salts = F.coalesce(F.sum("n").over(Window.partitionBy("kind", "key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = told.select(*key, F.when(F.col("kind") == 0, depth + salts + 1).otherwise(depth + F.col("n_slots") - salts).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("of", "layer")) - 1
    return rows.withColumn("rank", rank).join(first, key).withColumn("level", F.col("first") + F.col("rank") * (1 - 2 * F.col("kind")))


def _round(gaps: DataFrame, left: DataFrame, band: DataFrame, capacity: int) -> DataFrame:
    """(row, length, bin, offset, gap): every row of ``left`` with its place (bin is null where no slot is left), and
    every open gap after the round (row is null). ``band``: one row (lo, hi, salts).

    Conflicts are resolved by rank: documents and slots meet by level, of which
    each holds at most one slot and one document per size.
    """
    none = F.lit(None).cast("long")
    both = gaps.select(F.lit(0).alias("kind"), F.col("gap").alias("size"), F.col("bin").alias("of")).unionByName(left.select(F.lit(1).alias("kind"), F.col("length").alias("size"), F.col("row").alias("of")))
    # A gap of several times `hi` offers as many slots, each of an equal part of it, so whatever takes them fits.
    open_rows = both.crossJoin(F.broadcast(band)).where("kind = 1 OR size > lo").withColumn("per_bin", F.when(F.col("kind") == 0, F.greatest(F.lit(1), F.floor(F.col("size") / F.col("hi")))).otherwise(1))
    layers = F.explode(F.sequence(F.lit(1), F.col("per_bin").cast("int"))).alias("layer")
    offered = open_rows.select("kind", F.floor(F.col("size") / F.col("per_bin")).alias("key"), "of", layers, F.pmod(F.xxhash64("of"), F.col("salts")).alias("salt"))
    slot = F.when(F.col("kind") == 0, F.struct(F.col("of").alias("bin"), "layer"))
    taken = F.lag(slot).over(Window.partitionBy("level").orderBy(F.desc("key"), "kind"))
    met = _levels(offered).withColumn("taken", taken).where("kind = 1").select(F.col("of").alias("row"), F.col("key").alias("length"), "taken.bin", "taken.layer", none.alias("gap"))
    # The gap's own row stands before the documents of its bin; a document without one is alone, as no bin has its number.
    every = gaps.select(none.alias("row"), F.lit(0).cast("long").alias("length"), "bin", F.lit(0).alias("layer"), "gap").unionByName(met)
    of_bin = Window.partitionBy(F.coalesce("bin", "row")).orderBy("layer")
    room = F.sum(F.coalesce("gap", F.lit(0)) - F.col("length"))
    ahead = F.when(F.col("row").isNotNull() & F.col("bin").isNotNull(), capacity - room.over(of_bin.rowsBetween(Window.unboundedPreceding, -1)))
    rest = F.when(F.col("row").isNull(), room.over(of_bin.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return every.select("row", "length", "bin", ahead.alias("offset"), rest.alias("gap")).where("row IS NOT NULL OR gap > 0")


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length", rows_per_salt: int = 2000) -> DataFrame:
    """``parts`` with sequence_id and offset. Lengths must lie between 1 and the capacity."""
    spark = parts.sparkSession
    row = own_name(parts, "row")
    rows = written(parts.withColumn(row, F.monotonically_increasing_id()), "numbered")
    docs = rows.select(F.col(row).alias("row"), F.col(length).cast("long").alias("length"))
    steps = bands(capacity)
    number = F.lit(len(steps))
    for i, (lo, _) in reversed(list(enumerate(steps))):
        number = F.when(F.col("length") > lo, i).otherwise(number)
    totals = {r[0]: (r[1], r[2], r[3]) for r in docs.groupBy(number.alias("band")).agg(F.count(F.lit(1)), F.min("length"), F.max("length")).collect()}  # a row a band
    if any(not 1 <= x <= capacity for _, a, b in totals.values() for x in (a, b)):
        raise ValueError("lengths must lie between 1 and the capacity")

    # What fills more than half has a sequence of its own, numbered as its row; later sequences have negative numbers.
    long = docs.where(F.col("length") > steps[0][0])
    whole = long.select("row", F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"))
    rounds: list[str] = []
    gaps = long.select(F.col("row").alias("bin"), (capacity - F.col("length")).alias("gap")).where("gap > 0")
    widest, opened = capacity - totals[0][1] if 0 in totals else 0, 0
    for i, (lo, hi) in enumerate(steps[1:], 1):
        n, shortest, _ = totals.get(i, (0, 0, 0))
        left = docs.where((F.col("length") > lo) & (F.col("length") <= hi))
        while n:
            if widest < shortest:  # no gap holds any of them: open as many sequences as they need
                fresh = -(-n // (capacity // hi))
                gaps = gaps.unionByName(spark.range(opened, opened + fresh).select((-1 - F.col("id")).alias("bin"), F.lit(capacity).cast("long").alias("gap")))
                opened += fresh
            # As a row and not as literals, so that all rounds run the same compiled plan.
            band = spark.createDataFrame([(lo, hi, min(256, -(-n // rows_per_salt)))], "lo long, hi long, salts long")
            counts = Observation()  # taken while the round is written, so that no second query reads it
            done = _round(gaps, left, band, capacity).observe(
                counts, F.count_if(F.col("row").isNotNull() & F.col("bin").isNull()).alias("n"), F.min(F.when(F.col("bin").isNull(), F.col("length"))).alias("shortest"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest")
            )
            done = written(done, "round")
            rounds.append(written_paths()[-1])
            gaps, left = done.where("row IS NULL").select("bin", "gap"), done.where("bin IS NULL").select("row", "length")
            n, shortest, widest = (counts.get[c] for c in ("n", "shortest", "widest"))
    if rounds:  # one scan of all rounds, so the plan does not grow with their number
        whole = whole.unionByName(spark.read.schema(done.schema).parquet(*rounds).where("row IS NOT NULL AND bin IS NOT NULL").select("row", "bin", "offset"))
    whole = whole.select(F.col("row").alias(row), F.col("bin").alias("sequence_id"), "offset")
    return rows.join(whole, row).drop(row)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of ``documents`` with their places."""
    return pack(pieces(documents, tokenizer, capacity), capacity)

"""Removal of repeated passages by suffix arrays.

Every byte covered by a ``span``-byte string that also starts anywhere else, in
the same text or another, is removed; strings are judged on the input.

Method: per-shard suffix arrays, built by Larsson-Sadakane refinement in numpy
(ranks by the first eight bytes, then doubled, sorting only groups that are not
yet single), common prefixes with the suffix before by Kasai's walk (run in
parallel lanes), and merging across shards by binary search in sorted runs.

What goes to which shard: each window of ``span`` bytes has an anchor, the least
hash of its 32-byte strings. Equal windows have equal anchors, so shards are
dealt by anchor, and anchors that occur once need no shard at all. A stretch of
windows with one anchor travels as one segment; equal segments are sent once
with their number. An anchor with very many different segments (the border of a
passage that many texts share) is split over several shards; those shards also
give sorted runs of their windows' 128-bit digests, cut by digest range, and
each range is merged by binary search, so no task holds a whole anchor.

Equal texts are one text with a count: if it occurs twice, all of it (from
``span`` bytes on) goes, and only one copy is searched.

Defined results: a null text is the empty text; texts shorter than ``span``
keep all their bytes; repeated rows repeat each other; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import join_by_key, own_name, whole_text, written

GRAM = 32


@dataclass(frozen=True)
class Repeats:
    """Parameters: the least repeated length, bytes in a shard, different segments of one anchor in a shard."""

    span: int = 400
    shard_bytes: int = 2_000_000
    shard_segments: int = 2048


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number; the text's end is followed by zeros."""
    w = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(raw)
    w = (w[:-1] << np.uint64(8)) | w[1:]
    w = (w[:-2] << np.uint64(16)) | w[2:]
    return ((w[:-4] << np.uint64(32)) | w[4:])[:n]


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place that has so many."""
    w = _eights(raw)[: len(raw) - 7]
    h = (w[:-8] * np.uint64(0x9E3779B97F4A7C15)) ^ w[8:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h[:-16] ^ (h[:-16] >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + h[16:]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block-wise running minima from both sides."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], span: int) -> list[tuple[np.ndarray, ...]]:
    """Per text (anchor, first window, last window, places) of each stretch of windows with one anchor.

    ``places`` is how often the anchor changes its place inside the stretch, plus
    one: a stretch that holds its anchor twice may repeat itself.
    """
    none = (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    if len(raw) < span:
        return [none] * len(texts)
    grams = _grams(raw)
    least = _sliding_least(grams, span - GRAM + 1)
    owner_end = np.repeat(ends, sizes)[: len(least)]
    valid = np.arange(len(least)) + span <= owner_end
    new = valid.copy()
    other = least[1:] != least[:-1]
    new[1:] &= other | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= other | ~valid[1:]
    last = np.flatnonzero(stop)
    # The anchor is the window's first string and the next window has an equal one.
    leaves = np.concatenate([[0], np.cumsum((grams[: len(least) - 1] == least[:-1]) & ~other)])
    places = leaves[last] - leaves[first] + 1
    # Windows of neighbouring texts never meet: between them lie windows that cross the border.
    at = np.searchsorted(first, np.concatenate([[0], ends]))
    starts = ends - sizes
    return [
        (least[first[a:b]].view(np.int64), (first[a:b] - s).astype(np.int32), (last[a:b] - s).astype(np.int32), places[a:b].astype(np.int32)) if b > a else none
        for a, b, s in zip(at[:-1], at[1:], starts, strict=True)
    ]


def suffix_array(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by Larsson-Sadakane refinement.

    A group of equal ranks has the number of its last place as rank. Each round
    sorts the members of unfinished groups by the rank ``h`` places on and doubles ``h``.
    """
    n = len(raw)
    # Eight bytes at once tell suffixes apart unless zeros stand in the text, as the end is padded with them.
    h, key = (1, raw) if (raw == 0).any() else (8, _eights(raw))
    order = np.argsort(key)
    edge = np.flatnonzero(np.concatenate([key[order[1:]] != key[order[:-1]], [True]]))
    size = np.diff(np.concatenate([[-1], edge]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(edge, size)
    open_places = np.flatnonzero(np.repeat(size > 1, size))
    while len(open_places):
        member = order[open_places]
        group = rank[member]
        ahead = member + h
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.argsort(group * (n + 1) + after + 1)
        member, group, after = member[by], group[by], after[by]
        order[open_places] = member
        last = np.concatenate([(group[1:] != group[:-1]) | (after[1:] != after[:-1]), [True]])
        edge = np.flatnonzero(last)
        size = np.diff(np.concatenate([[-1], edge]))
        rank[member] = np.repeat(open_places[edge], size)
        open_places = open_places[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(raw: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lane: int = 128) -> np.ndarray:
    """For each place of the text, the bytes (``most`` at most) its suffix shares with the suffix before it in order.

    Kasai's walk: going one place on in the text, the common prefix shrinks by
    one at most. The text is cut into lanes of ``lane`` places that walk at the same time.
    """
    n = len(raw)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([raw, np.zeros(most + 16, np.uint8)])
    eights = _eights(padded)
    length = min(lane, n)
    starts = np.arange(0, n, length)
    h = np.zeros(len(starts), np.int64)
    for step in range(length):
        at = starts + step
        if at[-1] >= n:
            at, h = at[:-1], h[:-1]
            starts = starts[: len(at)]
        other = before[at]
        h = np.maximum(h - 1, 0)
        h[other < 0] = 0
        live = np.flatnonzero((other >= 0) & (h < most))
        while len(live):
            a, b = at[live] + h[live], other[live] + h[live]
            differ = eights[a] ^ eights[b]
            same = differ == 0
            more = same.astype(np.int64)
            for bits in range(8, 64, 8):  # leading bytes that are equal
                more += differ < np.uint64(1 << bits)
            h[live] += np.minimum(more, n - np.maximum(a, b))
            live = live[same & (np.maximum(a, b) + 8 < n) & (h[live] < most)]
        out[at] = np.minimum(h, most)
    return out


def repeated_starts(segments: list[bytes], span: int) -> np.ndarray:
    """Flags over the joined segments: windows that start there (and end in their segment) and occur twice in the shard."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    order, rank = suffix_array(raw)
    shared = common_prefixes(raw, order, rank, span)
    sizes = np.array([len(s) for s in segments], np.int64)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))
    inside = room >= span
    # In order: a run of suffixes whose neighbours share `span` bytes is one string; a window repeats if its run has two windows inside segments.
    joined = shared[order] >= span
    run = np.cumsum(~joined) - 1
    many = np.bincount(run, weights=inside[order]) >= 2
    out = np.zeros(len(raw), bool)
    out[order] = many[run]
    return out & inside


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def may_repeat(segments: list[bytes], span: int) -> np.ndarray:
    """Which segments have a window whose hash occurs twice in the shard; only these need the suffix array."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    h, wide = _grams(raw), GRAM
    while wide * 2 <= span:
        h, wide = _mixed(h[:-wide], h[wide:]), wide * 2
    if wide < span:
        h = _mixed(h[: wide - span], h[span - wide :])
    sizes = np.array([len(s) for s in segments], np.int64)
    owner = np.repeat(np.arange(len(segments)), sizes)[: len(h)]
    inside = np.flatnonzero(np.cumsum(sizes)[owner] - np.arange(len(h)) >= span)
    order = inside[np.argsort(h[inside])]
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(segments), bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _anchored(df: DataFrame, span: int) -> DataFrame:
    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found, held, size = [], [], 0
            for t in texts:
                raw = t.encode()
                held.append(raw)
                size += len(raw)
                if size > 1 << 16:  # blocks that stay in the processor's cache
                    found += anchors(held, span)
                    held, size = [], 0
            found += anchors(held, span) if held else []
            yield pd.Series([list(zip(*(x.tolist() for x in stretches), strict=True)) for stretches in found])

    run = F.pandas_udf(rows, "array<struct<anchor:long,first:int,last:int,places:int>>")
    return df.withColumn("anchors", run(F.col("text")))


def repeated_spans(documents: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:  # noqa: B008
    """(rows, spans, texts).

    rows: id, sha, n_bytes of each row, whole_copy (its text occurs in several rows).
    spans: key, starts: intervals of repeated windows of each text that has any.
    texts: key, text of the texts that may have some.
    """
    source = documents.select(F.col(id_col).alias("id"), whole_text(text).alias("text")).withColumn("sha", F.sha2("text", 256))
    rows = written(_anchored(source, p.span).select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes"), "anchors"), "anchors")
    rows_key = rows.withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    counts = rows_key.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"))
    once = rows_key.where(F.size("anchors") > 0).dropDuplicates(["key"]).select("key", "id", F.explode("anchors").alias("x")).select("key", "id", "x.*")
    several = once.groupBy("anchor").agg(F.sum("places").alias("n")).where("n > 1")
    wanted = once.join(several, "anchor").groupBy("key", "id").agg(F.collect_list(F.struct("anchor", "n", "first", "last")).alias("stretches"))
    wanted = wanted.withColumnRenamed("id", "of_id")
    # One row of each text: the one whose id the anchors came from (a repeated row once).
    keyed = source.withColumn("key", F.unhex(F.substring("sha", 1, 32)))
    found = keyed.join(wanted, (keyed["key"] == wanted["key"]) & keyed["id"].eqNullSafe(wanted["of_id"])).select(keyed["key"], "text", "stretches")
    texts = written(found.dropDuplicates(["key"]), "repeat-texts")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, t, stretches in zip(pdf["key"], pdf["text"], pdf["stretches"], strict=True):
                raw = t.encode()
                for s in stretches:
                    piece = raw[s["first"] : s["last"] + p.span]
                    out.append((bytes(key), s["anchor"], s["n"], s["first"], xxhash.xxh3_128_digest(piece), piece))
            yield pd.DataFrame(out, columns=["key", "anchor", "n", "first", "segment", "piece"])

    cuts = texts.mapInPandas(cut, "key binary, anchor long, n long, first int, segment binary, piece binary")
    cuts = written(cuts, "segments")
    places = cuts.select("key", "first", "segment")
    lone = cuts.groupBy("segment").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("anchor", "n", "piece")).alias("s")).select("segment", "times", "s.*")
    # An anchor with many stretches is split into shards by segment.
    parts = F.ceil(F.col("n") / p.shard_segments).cast("int")
    dealt = lone.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("segment"), "parts").cast("int"))
    dealt = dealt.repartition(F.col("anchor"), F.col("part")).sortWithinPartitions("anchor", "part")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def solve() -> pd.DataFrame:
            out = []
            worth = may_repeat([x[4] for x in held], p.span)
            flags = repeated_starts([x[4] for x, yes in zip(held, worth, strict=True) if yes], p.span) if worth.any() else None
            at = 0
            for (segment, times, _, split, piece), yes in zip(held, worth, strict=True):
                windows = len(piece) - p.span + 1
                own = np.ones(windows, bool) if times > 1 else flags[at : at + windows] if yes else np.zeros(windows, bool)
                # Shards of a split anchor meet again: windows not known to repeat ask, the others answer.
                digests = b"".join(xxhash.xxh3_128_digest(piece[i : i + p.span]) for i in range(windows)) if split else None
                out.append((segment, [(a, b) for a, b in _intervals(own)], digests, None if digests is None else own.tobytes()))
                at += len(piece) * bool(yes)
            return pd.DataFrame(out, columns=["segment", "starts", "digests", "known"])

        last = None
        for pdf in batches:
            for segment, times, anchor, n_parts, part, piece in zip(*(pdf[c] for c in ("segment", "times", "anchor", "parts", "part", "piece")), strict=True):
                if (anchor, part) != last and size > p.shard_bytes:
                    yield solve()
                    held, size = [], 0
                last = (anchor, part)
                held.append((bytes(segment), times, anchor, n_parts > 1, bytes(piece)))
                size += len(piece)
        if held:
            yield solve()

    schema = "segment binary, starts array<struct<a:int,b:int>>, digests binary, known binary"
    solved = written(dealt.select("segment", "times", "anchor", "parts", "part", "piece").mapInPandas(shards, schema), "solved")
    starts = solved.select("segment", F.explode("starts").alias("x")).select("segment", "x.a", "x.b")
    starts = starts.union(_merged(solved.where("digests is not null")))
    hits = places.join(starts, "segment").select("key", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    spans = hits.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    # Texts that occur once need no lookup; a text that very many rows share is not gathered in one task.
    several = written(counts.where("copies > 1"), "copies")
    flagged = join_by_key(rows.drop("anchors"), several, "sha", "copies", rows.count(), "left").withColumn("whole_copy", F.col("copies").isNotNull()).drop("copies")
    return flagged, spans, texts.select("key", "text")


def _merged(solved: DataFrame, range_bytes: int = 8_000_000, least_ranges: int = 64, run_windows: int = 1_000_000) -> DataFrame:
    """(segment, a, b) of windows that other shards have too.

    The digests of many segments are sorted together and cut into runs by digest
    range, so a task gives one row for each range however many segments it read;
    a range's runs are joined and every digest is searched among all of them
    (binary search). The number of ranges follows the bytes of all digests.
    """
    total = solved.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    ranges = max(least_ranges, -(-int(total) // range_bytes))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[bytes, np.ndarray, np.ndarray]] = []

        def cut() -> pd.DataFrame:
            d = np.concatenate([x[1] for x in held])
            sizes = [len(x[1]) for x in held]
            names = np.array([x[0] for x in held], "V16")
            owner = np.repeat(np.arange(len(held)), sizes)
            at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            own = np.concatenate([x[2] for x in held])
            order = np.lexsort((d[:, 1], d[:, 0]))
            top = ((d[order, 0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edge = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
            out = []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                part = order[i:j]
                out.append((int(top[i]), names[owner[part]].tobytes(), d[part].tobytes(), at[part].tobytes(), own[part].tobytes()))
            held.clear()
            return pd.DataFrame(out, columns=["range", "segments", "digests", "at", "known"])

        size = 0
        for pdf in batches:
            for segment, digests, known in zip(pdf["segment"], pdf["digests"], pdf["known"], strict=True):
                held.append((bytes(segment), np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64), np.frombuffer(known, bool)))
                size += len(known)
                if size >= run_windows:
                    yield cut()
                    size = 0
        if held:
            yield cut()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
        d = whole("digests", np.uint64).reshape(-1, 2)
        order = np.lexsort((d[:, 1], d[:, 0]))
        every = d[order]
        low, high = np.searchsorted(every[:, 0], d[:, 0], "left"), np.searchsorted(every[:, 0], d[:, 0], "right")
        times = high - low
        for i in np.flatnonzero((times > 1) & ((every[low, 1] != d[:, 1]) | (every[high - 1, 1] != d[:, 1]))):  # first halves alike only
            times[i] = np.count_nonzero(every[low[i] : high[i], 1] == d[i, 1])
        hit = np.flatnonzero((times > 1) & ~whole("known", bool))
        at = whole("at", np.int32)[hit]
        return pd.DataFrame({"segment": [x.tobytes() for x in whole("segments", "V16")[hit]], "a": at, "b": at})

    parts = solved.select("segment", "digests", "known").mapInPandas(runs, "range int, segments binary, digests binary, at binary, known binary")
    return parts.groupBy("range").applyInPandas(search, "segment binary, a int, b int")


def _without(raw: bytes, starts: list, span: int) -> tuple[bytes, int, int]:
    """(kept bytes, removed bytes, maximal removed runs)."""
    kept, at, runs, removed = [], 0, 0, 0
    stop = -1
    for a, b in sorted((x["a"], x["b"] + span) for x in starts):
        if a > stop:
            if stop >= 0:
                removed += stop - begin
            kept.append(raw[at:a] if stop < 0 else raw[stop:a])
            begin, stop, runs = a, b, runs + 1
        else:
            stop = max(stop, b)
    if stop < 0:
        return raw, 0, 0
    removed += stop - begin
    kept.append(raw[stop:])
    return b"".join(kept), removed, runs


def cleaned(documents: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(rows, results): rows as ``repeated_spans`` gives them, results: key, n_removed, n_spans, kept for the texts that lose bytes."""
    rows, spans, texts = repeated_spans(documents, p, id_col, text)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, t, starts in zip(pdf["key"], pdf["text"], pdf["starts"], strict=True):
                kept, removed, runs = _without(t.encode(), list(starts), p.span)
                out.append((bytes(key), removed, runs, kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept", "kept_sha256"])

    results = texts.join(spans, "key").mapInPandas(apply, "key binary, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return rows, results


def removal_report(documents: DataFrame, p: Repeats = Repeats(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, results = cleaned(documents, p, id_col, text)
    found = results.drop("kept").select(F.lower(F.hex("key")).alias("start"), F.col("n_removed").alias("r"), F.col("n_spans").alias("s"), F.col("kept_sha256").alias("k"))
    all_gone = F.col("whole_copy") & (F.col("n_bytes") >= p.span)
    # Copies of one text lose all of it or, if it is short, nothing: they need no lookup and would gather in one task.
    single = rows.where(~F.col("whole_copy")).join(found, F.substring("sha", 1, 32) == F.col("start"), "left")
    copied = rows.where("whole_copy").select("*", *[F.lit(None).cast(t).alias(c) for c, t in found.dtypes])
    return single.unionByName(copied).select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("s", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("k", "sha")).alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, p: Repeats = Repeats(), text: str = "text") -> DataFrame:  # noqa: B008
    """``documents`` with the repeated passages cut out of their texts; a character that is cut in two goes as a whole.

    The other columns stay; ``n_chars``, where it is there, counts anew. A null text stays null.
    """
    one = own_name(documents, "one")
    rows, results = cleaned(documents.withColumn(one, F.lit(0)), p, one, text)
    changed = results.select(F.lower(F.hex("key")).alias("start"), F.try_validate_utf8(F.col("kept").cast("string")).alias("whole"), "kept")

    def characters(kept: pd.Series) -> pd.Series:
        return pd.Series([bytes(x).decode("utf-8", "ignore") for x in kept], dtype=object)

    a, b, c = own_name(documents, "sha_start"), own_name(documents, "copies"), own_name(documents, "new_text")
    changed = changed.select(F.col("start").alias(a), F.coalesce("whole", F.pandas_udf(characters, "string")(F.col("kept"))).alias(c), F.lit(1).cast("long").alias(b))
    several = rows.where("whole_copy").groupBy(F.substring("sha", 1, 32).alias(a)).agg(F.count(F.lit(1)).alias(b)).withColumn(c, F.lit(None).cast("string"))
    # What is known of a text: its new form, or how many copies it has. Texts of very many copies are not gathered in one task.
    known = written(several.unionByName(changed.join(several.select(a), a, "left_anti")), "changed")
    named = documents.withColumn(a, F.substring(F.sha2(whole_text(text), 256), 1, 32))
    gone = (F.col(b) > 1) & (F.octet_length(text) >= p.span)
    joined = join_by_key(named, known, a, b, rows.count(), "left").withColumn(text, F.when(gone, F.lit("")).otherwise(F.coalesce(F.col(c), F.col(text)))).withColumn(c, F.when(gone, F.lit("")).otherwise(F.col(c)))
    if "n_chars" in documents.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(c).isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*[F.col(f"`{x}`") for x in documents.columns])

"""Near duplicates by MinHash.

Method: a text's set of word shingles gives many minima of universal hashes; the
minima are cut into bands, and sets that agree on a band share a bucket. Pairs
from buckets are verified on the signatures, then on the full sets, and the
links are grouped by alternating large-star and small-star steps.

No group emits its pairs. Equal sets are one node (only their smallest id is
compared). In a bucket every node is compared with one hub, the node that has
most company over all its buckets: of copies of one text that is as a rule the
one they were made from, so one round links them all. Buckets whose nodes are
then in different components get further rounds with the hubs of the components.
In the end the sets that are still in buckets of several components are joined
by the rarest shingles that each begins with (a prefix filter). That is exact: no
link between them is lost, and near misses (copies of one text that are not close
enough to each other) mostly do not meet, as each begins with shingles of its own.
The place of a shingle in that order also bounds the size of the sets that may be
met there, so sets meet by shingle and class of size; and the component that is
largest there is not compared with itself (see ``_left_over`` and ``_cells``).
Those that meet go on only if their parity sketches allow a link: each shingle
flips one bit of a sketch, so two sketches differ in no more bits than the sets
differ in shingles. That bound is exact too, and keeps near misses from being
written out as pairs.

A pair goes on to its full sets if its signatures agree on a share of no less
than the threshold less ``slack``; with 96 hashes a link falls below that with a
probability under 2e-9 at 0.85 and 2e-8 at 0.80. A link of similarity s is missed if its sets share no band: with r rows and b
bands that has the probability (1 - s^r)^b, below 3e-8 at 0.85 with 4 and 24.

Defined results: a null or empty text, or one of white space, has no shingles
and is linked with nothing; a text with fewer words than a shingle has its whole
sequence as its one shingle; rows with a null id take part and count after all
other ids; repeated rows are linked with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import join_by_key, own_name, remove_since, whole_text, written, written_paths


@dataclass(frozen=True)
class MinHash:
    """Parameters. A link needs ``percent * union <= 100 * intersection``."""

    words: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 4
    seed: int = 20240
    #: Signatures that agree on a share this far below the threshold are not worth a full comparison (over 6 standard deviations).
    slack: float = 0.25
    hub_rounds: int = 2
    sketch_words: int = 32
    #: Rows with one shingle that meet in one task.
    block: int = 1024
    #: Sets of one class are at most this share apart in size.
    size_step: float = 0.04

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a text, A-Z lower-cased, as sorted 64-bit hashes."""
    found = text.encode().lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)
    wide = min(words, n)
    mixed = h[: n - wide + 1] + np.uint64(wide)
    for i in range(1, wide):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n - wide + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed.sort()
    return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def _coefficients(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 2**32, p.hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, p.hashes, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of a*x + b modulo 2^32 over the set, for every coefficient pair."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):  # blocks that stay in the processor's cache
        block = a[:, None] * x[None, at : at + 2048]
        block += b[:, None]
        np.minimum(best, block.min(axis=1), out=best)
    return best


def parity_sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit words; every shingle flips the bit that its hash names."""
    flips = np.bincount((shingles & np.uint64(words * 64 - 1)).astype(np.int64), minlength=words * 64)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def signed(documents: DataFrame, p: MinHash, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, node, bands, signature): node is a 128-bit digest of the set, null if it is empty."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a, b = _coefficients(p)
        salts = np.random.default_rng(p.seed + 1).integers(1, 2**63, p.rows, dtype=np.uint64) | np.uint64(1)
        for texts in batches:
            out = []
            for t in texts:
                s = shingle_set(t, p.words)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                minima = signature(s, a, b)
                keys = np.arange(1, p.bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                for column, salt in zip(minima.reshape(p.bands, p.rows).T.astype(np.uint64), salts, strict=True):
                    keys = (keys ^ column) * salt
                    keys ^= keys >> np.uint64(31)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys.view(np.int64), minima.tobytes()))
            yield pd.DataFrame(out, columns=["n_shingles", "node", "bands", "signature"])

    run = F.pandas_udf(rows, "n_shingles long, node binary, bands array<long>, signature binary")
    return documents.select(F.col(id_col).alias("id"), run(whole_text(text)).alias("r")).select("id", "r.*")


def _agreement() -> object:
    def share(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([float(np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32))) for x, y in zip(left, right, strict=True)], dtype="float64")

    return F.pandas_udf(share, "double")


def _overlap(p: MinHash) -> object:
    def sizes(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out, last, kept = [], None, None
        for x, y in zip(left, right, strict=True):
            if y is not last:
                last, kept = y, shingle_set(y, p.words)
            s = shingle_set(x, p.words)
            both = len(np.intersect1d(s, kept, assume_unique=True))
            out.append((both, len(s) + len(kept) - both))
        return pd.DataFrame(out, columns=["both", "either"])

    return F.pandas_udf(sizes, "both long, either long")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """(a, b, both, either) of the pairs that pass the size bound and the signatures. The caller decides which are links."""
    x = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    y = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    close = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent) & (_agreement()(F.col("sig_a"), F.col("sig_b")) >= p.percent / 100 - p.slack)
    left = pairs.join(x, "a").join(y, "b").where(close).select("a", "b")
    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    sized = left.join(ta, "a").join(tb, "b").withColumn("size", _overlap(p)(F.col("text_a"), F.col("text_b")))
    return sized.select("a", "b", "size.both", "size.either")


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of ``links`` (a, b), by alternating large-star and small-star.

    Large-star: a node's larger neighbours move to its smallest neighbour (or
    itself). Small-star: its smaller neighbours and itself do. Both keep the
    components; at rest every node points at its component's smallest. Minima are
    aggregated before the shuffle, so a node with many links is not gathered.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-0")
    step = 0
    while True:
        # At rest: no node both points and is pointed at, and none points twice.
        both = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        moving = both.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if moving.isEmpty():
            break
        near = edges.union(edges.select("v", "u"))
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        step += 1
        edges = written(small, f"{label}-{step}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def near_duplicates(documents: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """Per row of ``documents``: id, n_shingles, component_id (smallest id reachable) and kept (it is that id)."""
    rows = written(signed(documents, p, id_col, text), "signed")
    full = rows.where(F.col("node").isNotNull())
    nodes = full.dropDuplicates(["node"]).select("node", F.col("id").alias("of_id"), "n_shingles", "bands", "signature")

    spark, mark = documents.sparkSession, len(written_paths())
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = written(join_by_key(buckets, shared, "bucket", "n", rows.count() * p.bands), "buckets")
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(members.join(company, "node").select("bucket", "node", "n", F.struct("company", "node").alias("rank")), "members")
    total = members.count()
    remove_since(spark, mark, ("members",))
    inside = members.select("node").distinct()
    known = written(nodes.join(inside, "node").select("node", "of_id", "n_shingles", "signature"), "nodes")
    texts = _texts_of(documents.select(F.col(id_col).alias("id"), whole_text(text).alias("text")), known.select("of_id", "node"), p)

    labels = members.select("node", F.col("node").alias("component")).distinct()
    links: DataFrame | None = None
    done: DataFrame | None = None
    for turn in range(p.hub_rounds + 1):
        mark = len(written_paths())
        if turn == 0:
            hubs = written(members.groupBy("bucket").agg(F.max("rank").alias("hub"), F.max("n").alias("n")).select("bucket", "n", F.col("hub.node").alias("b")), "hubs")
            pairs = join_by_key(members.select("bucket", F.col("node").alias("a")), hubs, "bucket", "n", total).where("a <> b").select("a", "b").distinct()
        else:
            # the two nodes of a bucket of two have been compared
            here = written(members.where("n > 2").join(labels, "node"), f"here-{turn}")
            mixed = here.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("n").alias("n")).where("low <> high").select("bucket", "n")
            open_rows = written(join_by_key(here.drop("n"), written(mixed, f"mixed-{turn}"), "bucket", "n", total), f"open-{turn}")
            if open_rows.isEmpty():
                break
            if turn < p.hub_rounds:
                # All nodes against another component's best; what agrees in one band only is hardly a link, and the last turn sees to it.
                best = written(open_rows.groupBy("bucket", "component").agg(F.max("rank").alias("hub"), F.max("n").alias("n")), f"best-{turn}")
                top = best.groupBy("bucket").agg(F.max("hub").alias("first"), F.max("n").alias("n"))
                behind = join_by_key(best.drop("n"), written(top, f"top-{turn}"), "bucket", "n", total).where("hub <> first")
                second = written(behind.groupBy("bucket").agg(F.max(F.struct("hub", "component")).alias("second"), F.max("n").alias("n")), f"second-{turn}")
                pairs = (
                    join_by_key(open_rows.drop("n"), second, "bucket", "n", total).where(F.col("component") != F.col("second.component"))
                    .groupBy(F.col("node").alias("a"), F.col("second.hub.node").alias("b")).agg(F.count(F.lit(1)).alias("agreed")).where("agreed > 1").select("a", "b")
                )
            else:
                pairs = _left_over(open_rows, texts, p)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        sized = written(verified(pairs, known, texts, p), f"sized-{turn}")
        done = sized.select("a", "b") if done is None else done.union(sized.select("a", "b"))
        found = sized.where(F.col("both") * 100 >= F.col("either") * p.percent).select("a", "b")
        links = found if links is None else links.union(found)
        labels = members.select("node").distinct().join(components(links, f"links-{turn}"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        labels = written(labels, f"labels-{turn}")
        remove_since(spark, mark, ("sized", "labels"))  # what led to the links of this turn

    first = full.groupBy("node").agg(F.min("id").alias("least"))
    grouped = first.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = grouped.join(smallest, "component").select("node", "component_id")
    out = rows.select("id", "n_shingles", "node").join(of_node, "node", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _texts_of(texts: DataFrame, ids: DataFrame, p: MinHash) -> DataFrame:
    """(node, text) for the nodes in ``ids``: the text of the row that stands for each, written once."""
    found = texts.join(ids, texts["id"].eqNullSafe(ids["of_id"])).select("node", "text")

    def fits(text: pd.Series, node: pd.Series) -> pd.Series:  # an id may repeat with another text
        return pd.Series([xxhash.xxh3_128_digest(shingle_set(t, p.words).tobytes()) == bytes(n) for t, n in zip(text, node, strict=True)], dtype=bool)

    return written(found.where(F.pandas_udf(fits, "boolean")(F.col("text"), F.col("node"))).dropDuplicates(["node"]), "texts")


def _left_over(open_rows: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """Pairs of different components that may be linked, by the rarest shingles of each open set.

    In any one order of all shingles two sets of similarity t share one of the
    first ``n - t*n + 1`` of each (n: its size), else they have too few in common;
    no link is lost. In the order of use, rarest first, the sets of near misses
    begin with shingles of their own, so they do not meet. The first shingle that
    two sets share also bounds their sizes: what a set has from there on is all
    that they can share, so each place tells the largest set that may be met there
    (``reach``). Near misses of a size mostly reach only smaller sets.
    """
    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingle_set(t, p.words) for t in batch]
            yield pd.DataFrame({"set": [x.view(np.int64) for x in found], "sketch": [parity_sketch(x, p.sketch_words) for x in found]})

    hashed = F.pandas_udf(sets_of, "set array<long>, sketch array<long>")
    nodes = open_rows.select("node", "component").distinct()
    sets = written(nodes.join(texts, "node").select("node", "component", hashed("text").alias("h")).select("node", "component", "h.*", F.size("h.set").alias("size")), "sets")
    held = sets.select("node", F.explode("set").alias("shingle"))
    total = sets.agg(F.sum("size")).first()[0] or 0
    # what one set alone holds comes first in its order and meets nothing
    use = written(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("use")).where("use > 1"), "use")
    shared = join_by_key(held, use, "shingle", "use", total).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("use", "shingle"))).alias("shared"))
    least = F.ceil(F.col("size") * p.percent / 100)
    alone = F.col("size") - F.size("shared")
    first = F.col("size") - least + 1 - alone
    begin = sets.select("node", "component", "size").join(shared, "node").withColumn("alone", alone).withColumn("first", first.cast("int")).where("first > 0")
    begin = begin.select("node", "component", "size", "alone", F.posexplode(F.transform(F.slice("shared", F.lit(1), F.col("first")), lambda x: x["shingle"])).alias("place", "shingle"))
    reach = F.floor((F.col("size") - F.col("alone") - F.col("place")) * (100 + p.percent) / p.percent) - F.col("size")
    rows = written(begin.withColumn("reach", reach).where(F.col("reach") >= least).drop("alone", "place"), "begin")
    per = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("reach") >= F.col("size")).alias("any"))
    rows = join_by_key(rows, written(per.where("low <> high and any").select("shingle", "n"), "mixed-shingles"), "shingle", "n", rows.count())
    x, y = _cells(written(rows.drop("n"), "meeting"), sets.select("node", "sketch"), p)
    apart = F.lit(0)
    for i in range(p.sketch_words):
        apart = apart + F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i))))
    # the lesser is the smaller set, of equal ones the lower node, and each is within the other's reach
    fits = (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("nb") <= F.col("ra")) & (F.col("na") <= F.col("rb")) & (F.col("na") * 100 >= F.col("nb") * p.percent) & (F.col("ca") != F.col("cb"))
    # of sets of S shingles in all, linked ones differ in at most (100 - percent) * S / (100 + percent)
    near = apart * (100 + p.percent) <= (F.col("na") + F.col("nb")) * (100 - p.percent)
    return x.join(y, ["key", "lane", "i", "j"]).where(fits & near).select("a", "b").distinct()


def _cells(rows: DataFrame, sketches: DataFrame, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """The lesser and the greater sets of the pairs to compare, to be joined on key, lane, i and j.

    Of a pair the smaller set (``lesser``) stands with the shingle and the class of
    its size, the other one with all classes that it reaches down to. The
    component with most rows there is not compared with itself: lane 0 has the
    lesser ones of the others against all, lane 1 its own against the others. So
    at most twice as many pairs are looked at as are in different components.
    A lane is dealt in cells of some ``block`` rows a side.
    """
    size_class = lambda n: F.floor(F.log(n) / math.log(1 + p.size_step)).cast("int")
    key = F.xxhash64("shingle", "class").alias("key")
    kept = ["node", "component", "size", "reach"]
    lesser = rows.where("reach >= size").withColumn("class", size_class(F.col("size"))).select(key, *kept)
    classes = F.sequence(size_class(F.ceil(F.col("size") * p.percent / 100)), size_class(F.least("reach", "size")))
    greater = rows.withColumn("class", F.explode(classes)).select(key, *kept)
    both = lesser.select("key", "component", F.lit(1).alias("l"), F.lit(0).alias("g")).unionByName(greater.select("key", "component", F.lit(0).alias("l"), F.lit(1).alias("g")))
    of_component = both.groupBy("key", "component").agg(F.sum("l").alias("l"), F.sum("g").alias("g"))
    top = F.max(F.struct((F.col("l") + F.col("g")).alias("n"), "component", "l", "g")).alias("top")
    met = of_component.groupBy("key").agg(top, F.sum("l").alias("l"), F.sum("g").alias("g")).where("l > 0 and g > 0 and l + g > top.n")
    lane = lambda x, y: F.struct(x.alias("l"), y.alias("g"))
    lanes = F.array(lane(F.col("l") - F.col("top.l"), F.col("g")), lane(F.col("top.l"), F.col("g") - F.col("top.g")))
    met = written(met.select("key", F.col("top.component").alias("top"), (F.col("l") + F.col("g")).alias("n"), lanes.alias("lanes")), "met")

    total = rows.count()
    side = lambda df: join_by_key(df, met, "key", "n", total).withColumn("is_top", F.col("component") == F.col("top"))
    blocks = lambda part: F.ceil(F.col("rows")[part] / p.block).cast("int")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def dealt(df: DataFrame, lanes_of: Column, own: str, other: str, own_at: str, other_at: str, names: dict[str, str]) -> DataFrame:
        out = side(df).withColumn("lane", F.explode(lanes_of)).withColumn("rows", F.get("lanes", F.col("lane"))).where("rows.l > 0 and rows.g > 0")
        out = out.join(sketches, "node").withColumn(own_at, at(blocks(own))).withColumn(other_at, others(blocks(other)))
        return out.select("key", "lane", "i", "j", *[F.col(k).alias(v) for k, v in names.items()])

    x = dealt(lesser, F.array(F.col("is_top").cast("int")), "l", "g", "i", "j", {"node": "a", "component": "ca", "size": "na", "reach": "ra", "sketch": "sa"})
    y = dealt(greater, F.when(F.col("is_top"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))), "g", "l", "j", "i", {"node": "b", "component": "cb", "size": "nb", "reach": "rb", "sketch": "sb"})
    return x, y


def drop_near_duplicates(documents: DataFrame, p: MinHash = MinHash(words=5, percent=80), id_col: str = "doc_id") -> DataFrame:  # noqa: B008
    """The first row of each group, with its own columns: the smallest id (null after all others), then the row read first.

    Rows are told apart by a number in a written table, since ids may be null or repeat.
    """
    row, key = own_name(documents, "row"), own_name(documents, "key")
    numbered = written(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keyed = numbered.withColumn(key, F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row).alias("row")))
    verdict = near_duplicates(keyed, p, key)
    gone = verdict.where(~F.col("kept")).select(F.col(key)["row"].alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])

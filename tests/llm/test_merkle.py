"""Trees, proofs and odd rows of the manifest against a plain version."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from daybook.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, n string, digest string, path string, task long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
    return sha(*told)


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        yield run[: i % 16], run[i % 16 + 1 :]
        i //= 16


def plain(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[1], []).append(r)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        parts[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[s] = grown([leaf_of(r, r[4]) for r in parts[s]])
    top = grown([trees[s][-1][0] for s in order])
    root = top[-1][0] if order else None
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(parts[s]):
            path = [*steps(trees[s], i), *steps(top, k)]
            at = leaf_of(r, r[4])
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                at = leaf_of(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for left, right in path:
                at = sha(*left, at, *right)
            proof = sha(*[x for a, b in path for x in (*a, *b)])
            out.append((r[0], leaf_of(r, r[4]), trees[s][-1][0], root, proof, at, at == root))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(*r[:5], "t", 1, "n", "d", "p", 2) for r in rows], SCHEMA)
    lowered = F.lower(F.col("text"))  # these texts have no other capitals
    tampered = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)), merkle.leaf(text=lowered))
    return sorted((tuple(r) for r in merkle.verified(df, tampered).collect()), key=repr)


def made(n, sources, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Abc", "abc", "", None, "é 😀 X"])) for i in range(n)]


@pytest.mark.parametrize("n, sources", [(300, ["a"]), (700, ["a", "a", "a", "b", None, "", "é"]), (40, [f"s{i}" for i in range(30)])])
def test_equal_to_the_plain_version(spark, n, sources):
    rows = made(n, sources, n)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [*made(20, ["x", None], 5), (None, "x", None, None, "Q"), (None, "x", None, None, None), (3, "x", "en", 1, "R"), (3, "x", "en", 1, "R"), (3, "x", "en", 1, "S")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows[:1]) == plain(rows[:1])
    assert got(spark, []) == []


def test_one_row_is_its_own_root(spark):
    (_, leaf, subroot, root, proof, folded, ok) = got(spark, [(1, "s", "en", 1, "a")])[0]
    assert leaf == subroot == root == folded and ok and proof == sha("")


def test_places_are_gapless_however_parts_lie_over_tasks(spark):
    from daybook.llm.common import written

    rows = [(i * 7 % 1000, f"p{min(i % 40, 9)}", "d") for i in range(1000)]
    df = written(spark.createDataFrame(rows, "doc_id long, part string, digest string"), "rows")
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for tasks in ("1", "3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            out = merkle.numbered(df, "part", ["doc_id"]).collect()
            for t in range(10):
                of = sorted((r["idx"], r["doc_id"]) for r in out if r["tree"] == t)
                assert [i for i, _ in of] == list(range(len(of))) and [d for _, d in of] == sorted(d for _, d in of)
                assert {(r["part"], r["n"]) for r in out if r["tree"] == t} == {(f"p{t}", len(of))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        spark.conf.set("spark.sql.adaptive.enabled", kept[1])

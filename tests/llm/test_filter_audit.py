"""Counts of every order and step against a plain run of the filters, one order after another."""

import random
import re
from itertools import permutations

from daybook.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, part string, mask string, good string, digest string, n long"


def fails(rows):
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""] = min(ids.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORDS.findall(t)
        bad = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        out.append((i, s or "", bad + "E" * (i is not None and ids[t] < i)))
    return out


def plain(rows, labels):
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    judged = fails(rows)
    out, removed_by = [], {}
    for part in sorted({s for _, s, _ in judged}):
        own = [(i, bad) for i, s, bad in judged if s == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                failing = sum(f in bad for _, bad in own)
                out.append([part, order, step, len(left), len(gone), failing - len(gone), sum(bad == f for _, bad in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted((*x, removed_by[x[0], x[1][x[2] - 1]]) for x in out)


def got(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "p", "m", "g", "d", 1) for i, t, s in rows], SCHEMA)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.filter_audit(docs, told).collect())


def made(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "d$x", "e", "é", "😀"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([4, 7, 67])]) for _ in range(rng.choice([5, 49, 50, 90]))) for _ in range(n // 2)] + [None, "", " \n", "x " * 60]
    return [(i, rng.choice(texts), rng.choice(["a", "a", "b", "", None])) for i in range(n)], [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(n) if rng.random() < 0.5]


def test_equal_to_the_plain_version(spark):
    rows, labels = made(150, 4)
    assert got(spark, rows, labels) == plain(rows, labels)


def test_odd_rows(spark):
    rows, labels = made(12, 9)
    rows += [(None, "copy", "a"), (None, "copy", "a"), (3, "copy", "b"), (3, "copy", "b"), (2, "copy", "a"), (4, None, None), (5, "", None)]
    assert got(spark, rows, [*labels, (3, 1, 0), (3, 0, 1), (None, 1, 1)]) == plain(rows, [*labels, (3, 1, 0), (3, 0, 1)])
    assert got(spark, [], labels) == []
    out = got(spark, [(1, "x", None)], [])
    assert len(out) == 600 and {x[0] for x in out} == {""}


def test_other_filters(spark):
    """The transform takes any number of filters."""
    counts = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 2, 0), ("p", 4, 7, 0, 3)], "part string, mask int, n long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(counts, "XYZ").collect()}
    assert len(rows) == 18
    r = rows["YXZ", 2]
    assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["shapley"]) == (12, 0, 2, 0, 0, 6)
    assert (rows["YXZ", 3]["removed"], rows["YXZ", 3]["unique_fails"], rows["YXZ", 3]["toxic_lost"], rows["YXZ", 3]["shapley"]) == (7, 7, 3, 42)

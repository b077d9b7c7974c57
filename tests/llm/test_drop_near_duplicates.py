"""The pipeline's second stage on null ids, ids that repeat and repeated rows, against brute force."""

import random

import brute
import pytest

import corpus_pipeline


def rows():
    rng = random.Random(5)
    fresh = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    copied, near, alone = fresh(), fresh(), [fresh() for _ in range(6)]
    return [
        (None, alone[0]), (None, alone[1]), (None, copied), (4, copied), (4, alone[2]), (2, copied),  # copies beside unique rows of the same id
        (7, near), (7, near + " one more"), (7, alone[3]), (9, near + " and another"),  # one id, several texts of one group
        (8, alone[4]), (8, alone[4]), (8, alone[4]), (None, alone[5]), (None, alone[5]),  # repeated rows and copies without ids
        (None, None), (None, ""), (1, " "), (1, " "),  # nothing to compare: all stay
    ]


@pytest.mark.parametrize("turned", [False, True])
def test_one_row_of_each_group_stays(spark, turned):
    given = rows()[::-1] if turned else rows()
    group = {i: c for i, (_, c) in brute.near([(i, t or "") for i, (_, t) in enumerate(given)], 5, 80).items()}
    first = {}
    for i, (doc_id, _) in enumerate(given):
        first[group[i]] = min(first.get(group[i], (True, 0, len(given))), (doc_id is None, doc_id or 0, i))
    want = sorted((given[i] for _, _, i in first.values()), key=repr)
    docs = spark.createDataFrame([(*r, "s", "k") for r in given], "doc_id long, text string, row string, key string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == want


def test_near_misses_are_not_compared_with_one_another(spark, monkeypatch):
    """Variants of one text, most of them too far from each other: links as by brute force, and few pairs."""
    from daybook.llm import near_dedup

    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]

    def variant(i, share):
        return " ".join(f"v{i}x{k}" if rng.random() < share else w for k, w in enumerate(base))

    docs = [(i, variant(i, 0.06)) for i in range(400)]  # three-word shingles: about 0.7 of the sets is shared
    docs += [(1000 + i, docs[i * 7][1] + " tail") for i in range(20)]  # and some real links
    pairs = []
    real = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute.near(docs, 3, 85)
    assert len(pairs) == 3 and sum(pairs) < 10 * len(docs)


def test_near_misses_do_not_meet_a_large_group(spark, monkeypatch):
    """Close copies of one text and as many near misses: links as by brute force, and what meets does not grow with the square of them."""
    from daybook.llm import near_dedup

    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]

    def copy(i, changed):
        at = set(rng.sample(range(300), changed))
        return " ".join(f"v{i}x{k}" if k in at else w for k, w in enumerate(base))

    def compared(table):  # pairs that are looked at: by lanes of a shingle and a size, else all of a shingle
        if "lanes" in table.columns:
            return sum(x["l"] * x["g"] for r in table.collect() for x in r["lanes"])
        return sum(r["n"] ** 2 for r in table.collect())

    docs = [(i, copy(i, 2)) for i in range(250)] + [(1000 + i, copy(1000 + i, 12)) for i in range(250)]
    docs += [(2000 + i, docs[250 + 9 * i][1] + " tail") for i in range(20)]  # links among the near misses
    looked, real = [], near_dedup.written

    def spied(df, label):
        out = real(df, label)
        if label == "met":
            looked.append(compared(out))
        return out

    monkeypatch.setattr(near_dedup, "written", spied)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute.near(docs, 3, 85)
    assert len(looked) == 1 and looked[0] < 20 * len(docs)

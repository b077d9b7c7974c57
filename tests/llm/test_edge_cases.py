"""Nulls, empty texts, repeated rows, clashing column names and empty tables."""

import random

import brute
import pytest

from daybook import keys
from daybook.llm import common, near_dedup, pii, quality_rules, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, kept string, spans string, one string"


@pytest.fixture(scope="module")
def odd(spark):
    random.seed(3)
    shared = "".join(random.choice("abcdefgh ") for _ in range(900))
    texts = [None, "", " \n ", "a@b.example", "copy " * 120, "copy " * 120, *(f"{random.random()} " + shared[i * 7 :] for i in range(20))]
    rows = [(i, t, None if i % 3 == 0 else "en", None, len(t or ""), "c", "k", "s", "o") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), [(r[0], r[1] or "") for r in rows]


def test_split_shards_agree_with_brute_force(odd):
    df, rows = odd
    got = sorted(tuple(r) for r in suffix_dedup.removal_report(df, suffix_dedup.Repeats(shard_segments=3)).collect())
    assert got == sorted(brute.repeats(rows))


def test_blocks_agree_with_brute_force(odd):
    df, rows = odd
    p = near_dedup.MinHash(hub_rounds=1, block=2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, p).collect()}
    assert got == brute.near(rows, 3, 85)


@pytest.mark.parametrize("stage", [quality_rules.filter_documents, suffix_dedup.remove_repeats, pii.redact])
def test_columns_stay(odd, stage):
    df, rows = odd
    out = stage(df)
    assert out.columns == df.columns
    assert out.count() <= len(rows)
    assert stage(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 1, 3])
def test_large_keys_take_another_way_to_the_same_rows(spark, odd, monkeypatch, most):
    monkeypatch.setattr(keys, "HOT_ROWS", most)
    left = spark.createDataFrame([(i % 5, i) for i in range(12)] + [(9, 99)], "k int, v int")
    right = common.written(left.where("k < 9").groupBy("k").count(), "sizes")
    for how in ("inner", "left"):
        got, want = common.join_by_key(left, right, "k", "count", 13, how), left.join(right, "k", how)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    if most == 1:
        df, rows = odd
        assert sorted(tuple(r) for r in suffix_dedup.removal_report(df).collect()) == sorted(brute.repeats(rows))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}
        assert got == brute.near(rows, 3, 85)
        cut = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(df).collect()}
        assert cut[0] is None and cut[4] == cut[5] == "" and cut[3] == "a@b.example"

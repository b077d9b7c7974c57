"""Packing against best fit decreasing, and odd tables."""

import brute
import numpy as np
import pytest

from daybook.llm import packing
from daybook.llm.queries import tokenizer


def _packed(spark, sizes, capacity):
    parts = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    return packing.pack(parts, capacity).collect()


def _whole(rows, sizes, capacity):
    """Every row once with its length, sequences without gaps and within the capacity; how many there are."""
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(sizes))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed, capacity, most", [(1, 40, 40), (3, 2048, 2048)])
def test_as_few_sequences_as_best_fit(spark, seed, capacity, most):
    rng = np.random.default_rng(seed)
    sizes = np.minimum(rng.geometric(4 / most, 700), most).tolist()
    opened = _whole(_packed(spark, sizes, capacity), sizes, capacity)
    want = brute.best_fit_decreasing({s: sizes.count(s) for s in set(sizes)}, capacity)
    assert opened <= want * 1.01 + 2


def test_one_length_for_nearly_all(spark):
    """Ties: half of all rows have one length, which is dealt over salts."""
    sizes = [7] * 300 + [3] * 300 + [20]
    rows = packing.pack(spark.createDataFrame([(i, 0, n) for i, n in enumerate(sizes)], "doc_id long, piece int, length long"), 20, rows_per_salt=50).collect()
    assert _whole(rows, sizes, 20) <= brute.best_fit_decreasing({7: 300, 3: 300, 20: 1}, 20) + 2


def test_odd_tables(spark):
    """Null and empty texts are one piece of the end id; repeated rows count as often as they occur; an empty table gives none; other columns may clash."""
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "some words", 5), (2, "some words", 5)], "doc_id long, text string, row int")
    rows = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (1, 1), (2, 3), (2, 3)]
    assert sorted(r["offset"] for r in rows) == [0, 3, 6, 7]
    assert packing.pack_documents(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    clash = spark.createDataFrame([(1, 0, 4, "x", 0.5)], "doc_id long, piece int, length long, row string, bin double")
    assert packing.pack(clash, 8).drop("sequence_id").first().asDict() == {"doc_id": 1, "piece": 0, "length": 4, "row": "x", "bin": 0.5, "offset": 0}
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 9)], "doc_id long, piece int, length long"), 8)


def test_the_plan_does_not_grow_with_the_rounds(spark, capsys):
    """All rounds are read by one scan, and a round is one query: its counts are taken while it is written."""
    sizes = np.minimum(np.random.default_rng(5).geometric(0.02, 400), 128).tolist()
    parts = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(sizes)], "doc_id long, piece int, length long")
    before = len(packing.written_paths())
    packed = packing.pack(parts, 128)
    assert sum("/round-" in p for p in packing.written_paths()[before:]) > 5
    packed.explain()
    assert capsys.readouterr().out.count("FileScan parquet") == 3
    _whole(packed.collect(), sizes, 128)

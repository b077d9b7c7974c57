"""Stored tables: merges, versions, writers at the same time, writers that die, replayed batches."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from daybook.sources.versioned import Conflict, Stopped, VersionedTable

SCHEMA = "k long, part string, n long, note string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, tmp_path, buckets=4):
    return VersionedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ("k", "part"), buckets)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges_equal_a_dictionary(spark, tmp_path):
    t, rng, want = table(spark, tmp_path), random.Random(5), {}
    rules = {"n": "add", "note": "fill"}
    for _ in range(4):
        keys = rng.sample([(k, p) for k in (*range(9), None) for p in ("a", "b", None)], 9)
        changes = [(k, p, rng.choice([1, 5, None]), rng.choice([None, f"x{rng.random()}"])) for k, p in keys]
        t.upsert(frame(spark, changes), rules)
        for k, p, n, note in changes:
            if (k, p) in want:
                old = want[k, p]
                want[k, p] = ((old[0] or 0) + (n or 0), note or old[1])
            else:
                want[k, p] = (n, note)
    assert rows(t.read()) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_rules(spark, tmp_path):
    t = VersionedTable.create(spark, f"file://{tmp_path}/t", "k int, a int, b int, c int, d int, e int", ("k",), 2)
    t.upsert(spark.createDataFrame([(1, 1, 1, 1, 1, 1), (2, 7, 7, 7, 7, 7)], t.schema))
    t.upsert(spark.createDataFrame([(1, None, 5, None, 9, None), (3, 1, 2, 3, 4, None)], t.schema), {"a": "keep", "b": "add", "c": "fill", "d": "most"})
    assert rows(t.read()) == [(1, 1, 6, 1, 9, None), (2, 7, 7, 7, 7, 7), (3, 1, 2, 3, 4, None)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path, 8)
    t.upsert(frame(spark, [(k, "a", 1, None) for k in range(200)]))
    before = t.version()
    one = frame(spark, [(3, "a", 2, "new")])
    own = str(one.select(t.bucket()).first()[0])
    t.upsert(one)
    after = t.version()
    assert {b for b in after.buckets if after.buckets[b] != before.buckets[b]} == {own}
    assert t.read().count() == 200 and t.read().where("k = 3").first()["note"] == "new"


def test_versions_stay_readable(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.version().number == 0
    first = t.upsert(frame(spark, [(1, "a", 1, "old")]))
    kept = t.read(first)
    t.upsert(frame(spark, [(1, "a", 9, "new"), (2, "b", 1, None)]))
    assert rows(kept) == [(1, "a", 1, "old")] and rows(t.read(0)) == []
    assert t.numbers() == [0, 1, 2]


def test_writers_at_the_same_time_all_land(spark, tmp_path):
    t = table(spark, tmp_path, 3)
    t.upsert(frame(spark, [(k, "a", 0, None) for k in range(20)]))
    failed = []

    def write(i):
        try:
            own = VersionedTable(spark, f"file://{tmp_path}/t")
            own.upsert(frame(spark, [(k, "a", 1, f"w{i}") for k in range(20)] + [(100 + i, "b", i, None)]), {"n": "add"})
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and t.version().number == 5
    assert t.read().where("part = 'a'").agg(F.min("n"), F.max("n"), F.count("n")).first() == (4, 4, 20)
    assert sorted(r["k"] for r in t.read().where("part = 'b'").collect()) == [100, 101, 102, 103]


def test_a_conflict_elsewhere_needs_no_second_merge(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path, 16)
    one, two = frame(spark, [(1, "a", 1, None)]), frame(spark, [(k, "z", 1, None) for k in range(40)])
    own = one.select(t.bucket()).first()[0]
    other = two.where(t.bucket() != own)
    merges, commit, state = [], VersionedTable._commit, {"late": True}

    def late(self, version):
        if state.pop("late", False):
            VersionedTable(spark, f"file://{tmp_path}/t").upsert(other)
        return commit(self, version)

    merged = VersionedTable._merged
    monkeypatch.setattr(VersionedTable, "_commit", late)
    monkeypatch.setattr(VersionedTable, "_merged", lambda self, now, c, b, *a: merges.append(b) or merged(self, now, c, b, *a))
    t.upsert(one)
    assert t.version().number == 2 and t.read().count() == 1 + other.count()
    assert [b for b in merges if b == [str(own)]] == [[str(own)]]  # merged once, published as the second version


def test_a_writer_that_dies_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(frame(spark, [(1, "a", 1, "old")]))
    with pytest.raises(Stopped):
        t.upsert(frame(spark, [(1, "a", 2, "half")]), stop_before_commit=True)
    assert rows(t.read()) == [(1, "a", 1, "old")] and t.version().number == 1
    t.upsert(frame(spark, [(1, "a", 3, "next")]))
    assert t.vacuum(keep=1) == []  # a running writer may still name young folders
    assert len(t.vacuum(keep=1, older_than_s=-60)) == 2 and t.numbers() == [2]
    assert rows(t.read()) == [(1, "a", 3, "next")]


def test_replayed_batches_count_once(spark, tmp_path):
    t = table(spark, tmp_path)
    for batch in (0, 0, 1, 0, 1):
        t.upsert(frame(spark, [(1, "a", 1, None)]), {"n": "add"}, txn=("stream", batch))
    t.upsert(frame(spark, [(1, "a", 1, None)]), {"n": "add"}, txn=("other", 0))
    assert rows(t.read()) == [(1, "a", 3, None)]


def test_what_is_refused(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError, match="twice"):
        t.upsert(frame(spark, [(1, "a", 1, None), (1, "a", 2, None)]))
    with pytest.raises(ValueError, match="lack"):
        t.upsert(spark.range(3).withColumnRenamed("id", "k"))
    with pytest.raises(ValueError, match="another table"):
        VersionedTable.create(spark, f"file://{tmp_path}/t", "k long", ("k",), 4)
    assert table(spark, tmp_path).version().number == 0  # made alike: the same table
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, version: False)
    with pytest.raises(Conflict):
        VersionedTable(spark, f"file://{tmp_path}/t", attempts=2).upsert(frame(spark, [(1, "a", 1, None)]))

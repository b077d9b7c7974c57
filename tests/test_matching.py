"""Matching by names against every pair, and the number of pairs it looks at."""

import random

import pytest
from pyspark.sql import functions as F

from daybook.operators import ledgers


def _score(a, b):
    if a in b or b in a:
        return 88.0
    x, y = set(a.split(" ")), set(b.split(" "))
    common = len(x & y)
    if not common or common < min(len(x), len(y)) * 0.5:
        return None
    return round(60 + common / max(len(x), len(y)) * 25, 1)


def _brute(parties, names):
    out = {}
    for p in parties:
        scored = [(-s, i, n) for i, n in enumerate(names) if n != p and (s := _score(p, n)) is not None]
        out[p] = [n for _, _, n in sorted(scored)[:5]]
    return out


@pytest.mark.parametrize("common, sets_of", [(2, 6), (2, 1), (1000, 6)])
def test_candidates_are_those_of_all_pairs(spark, monkeypatch, common, sets_of):
    monkeypatch.setattr(ledgers, "COMMON", common)
    monkeypatch.setattr(ledgers, "SETS_OF", sets_of)
    rng = random.Random(3)
    words = "ACME TRADERS PVT LTD AND SONS STEEL ROAD X Y Z 12 123 CO".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    names = list(dict.fromkeys(make() for _ in range(150)))
    parties = list(dict.fromkeys([make() for _ in range(60)] + names[:20]))
    chart = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    rows = ledgers.candidates(spark.createDataFrame([(p,) for p in parties], "party_norm string"), chart).collect()
    got = {r["party_norm"]: [x["ledger"] for x in (r["listed"] or [])][:5] for r in rows}
    assert got == _brute(parties, names)
    assert {r["party_norm"] for r in rows if r["exact"]} == set(parties) & set(names)


def test_a_word_that_all_names_share_pairs_few(spark):
    def pairs(n):
        names = spark.range(n).selectExpr("cast(id as int) as ord", "concat('SUPPLIER ', lpad(id, 6, '0')) as norm", "concat('Supplier ', id) as ledger")
        parties = spark.range(n).selectExpr("concat('SUPPLIER ', lpad(id + 7, 6, '0')) as party_norm")
        return ledgers._sharing(parties, names).count()

    few, many = pairs(500), pairs(2000)
    assert few <= 500 * ledgers.LISTED and many <= 4.5 * few


def test_containing_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("AB1 ") for _ in range(n))
    needles = sorted({make(rng.randint(1, 10)) for _ in range(80)})
    texts = sorted({make(rng.randint(0, 30)) for _ in range(60)} | {""})
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    got = {(r["needle"], r["text"]) for r in ledgers.containing(n, "needle", t, "text", 4).collect()}
    assert got == {(a, b) for a in needles for b in texts if a in b}
    assert ledgers.containing(n.limit(0), "needle", t, "text").count() == 0


def _statement(spark):
    narrations = ["ATM CASH WITHDRAWAL"] * 40 + ["UPI/446295445740/P2M/pay@okaxis/ABC TRADERS"] * 9 + ["NEFT/N123456/XYZ STEEL", "RANDOM OBSCURE PAYEE", None, "27ABCDE0003F1Z5 INVOICE", "SMS ALERT CHARGES", "PATANJALI STORE/1"] * 3
    rows = [(1, i, n, 5 * (i % 2), 5 * (1 - i % 2)) for i, n in enumerate(narrations)]
    tx = spark.createDataFrame(rows, "stmt_id int, row_index int, narration string, debit int, credit int")
    chart = spark.createDataFrame([(1, "Abc Traders", None, None, "G"), (2, "Xyz Steel Pvt Ltd", None, None, "G"), (3, "Other", "27ABCDE0003F1Z5", "alias", "G"), (4, "Bank Charges", None, None, "G")], "ord int, name string, gstin string, alias string, grp string")
    return tx, chart, spark.createDataFrame([(1, "patanjali", "Patanjali A/C")], "ord int, pattern string, ledger string")


@pytest.mark.parametrize("most", [0, 5])
def test_large_keys_take_another_way_to_the_same_ledgers(spark, monkeypatch, most):
    """Narrations and parties with many rows are joined by a broadcast; every row keeps its place and its ledger."""
    from daybook import keys

    tx, chart, rules = _statement(spark)
    plain = {r["row_index"]: r for r in ledgers.match(tx, chart, rules).collect()}
    assert len(plain) == tx.count()
    assert {plain[i]["ledger_name"] for i in range(40)} == {"Cash"}
    by_text = {r["narration"]: r["ledger_name"] for r in plain.values()}
    assert by_text["27ABCDE0003F1Z5 INVOICE"] == "Other" and by_text["PATANJALI STORE/1"] == "Patanjali A/C" and by_text[None] == "Suspense"
    monkeypatch.setattr(keys, "HOT_ROWS", most)
    again = {r["row_index"]: r for r in ledgers.match(tx, chart, rules).collect()}
    assert again == plain


def test_keys_of_any_size_are_joined(spark, monkeypatch):
    from daybook import keys
    from daybook.storage import written

    left = spark.createDataFrame([(i % 5, i) for i in range(12)] + [(9, 99)], "k int, v int")
    right = written(left.where("k < 9").groupBy("k").count(), "sizes")
    for most in (0, 1, 3, 100):
        monkeypatch.setattr(keys, "HOT_ROWS", most)
        for how in ("inner", "left"):
            got, want = keys.join_by_key(left, right, "k", "count", 13, how), left.join(right, "k", how)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """A file of few bytes may hold many rows; what is made of it on the way is joined by sorting, unless it is small."""
    from daybook import storage

    rows = spark.range(storage.BROADCAST_ROWS + 1).selectExpr("id", "'the same text again and again' AS text")
    joins = lambda side: spark.range(10).join(side, "id")._jdf.queryExecution().sparkPlan().toString()
    few, many = storage.written_sized(rows.limit(9), "few"), storage.written_sized(rows, "many")
    assert "Broadcast" in joins(few) and "Broadcast" not in joins(many.where("id > 5").groupBy("id").count())
    assert "Broadcast" in spark.range(10**6).join(F.broadcast(many.where("id < 5")), "id")._jdf.queryExecution().sparkPlan().toString()
    plain = {r["row_index"]: r for r in ledgers.match(*_statement(spark)).collect()}
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert {r["row_index"]: r for r in ledgers.match(*_statement(spark)).collect()} == plain

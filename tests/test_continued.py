"""Pages that come in batches are audited as if the statement were whole; and the registered streams against plain folds."""

import random
from decimal import Decimal

import pytest
from test_codes import code_fold, session_fold

from daybook.operators import balance
from daybook.plans import stream_plans
from daybook.streaming import continued, state
from daybook.streaming.codes import CodeRules, SessionRules


def made(seed):
    rng, rows = random.Random(seed), []
    for stmt in range(6):
        true = Decimal(rng.randrange(1000))
        opening = rng.choice([None, true])
        for i in range(1, rng.randrange(20, 60)):
            d, c = rng.choice([(Decimal(rng.randrange(1, 90_000)) / 100, Decimal(0)), (Decimal(0), Decimal(rng.randrange(1, 90_000)) / 100), (Decimal(0), Decimal(0))])
            true += c - d
            printed = rng.choice([true, None, None, true + Decimal("0.5"), true - 2 * (c - d), true + 40]) if i > 1 or stmt % 2 else None
            rows.append((stmt, i * 2, None, d, c, printed, opening))
    return rows


COLUMNS = ["stmt_id", "row_index", "outcome", "validation_status", "opening_known", "previous_balance", "expected_balance", "debit", "credit", "balance", "confidence"]


@pytest.mark.parametrize("batches", [1, 4])
def test_batches_give_the_audit_of_the_whole(spark, tmp_path, batches):
    rows = made(batches)
    make = lambda: continued.continued_audit(spark.readStream.schema(continued.ROWS).parquet(f"{tmp_path}/in"))
    for k in range(batches):
        part = [r for r in rows if (r[1] - 1) * batches // 120 == k]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, continued.ROWS).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a run with nothing new changes nothing
            state.run_to_table(spark, make(), f"{tmp_path}/out", f"{tmp_path}/state")
    want = balance.audit(spark.createDataFrame(rows, continued.ROWS)).select(*COLUMNS).collect()
    got = spark.read.parquet(f"{tmp_path}/out").where("NOT is_late").select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    spark.createDataFrame([(0, 1, None, Decimal(1), Decimal(0), None, None), (0, 5000, None, Decimal(0), Decimal(3), None, None)], continued.ROWS).write.mode("append").parquet(f"{tmp_path}/in")
    state.run_to_table(spark, make(), f"{tmp_path}/out", f"{tmp_path}/state")
    late = {r["row_index"]: r for r in spark.read.parquet(f"{tmp_path}/out").where("stmt_id = 0 AND row_index IN (1, 5000)").collect()}
    assert (late[1]["outcome"], late[1]["validation_status"], late[1]["previous_balance"]) == ("LATE", "PENDING", None) and late[5000]["outcome"] == "UNKNOWN"
    last = max((r for r in want if r["stmt_id"] == 0), key=lambda r: r["row_index"])
    assert late[5000]["previous_balance"] == (last["balance"] if last["balance"] is not None else last["expected_balance"])


def plain(df, names):
    return [tuple(r[c] for c in names) for r in sorted(df.collect(), key=lambda r: (r["at"], r["event_id"]))]


def test_registered_codes(spark, sf_dir):
    events = plain(stream_plans.code_events(spark, sf_dir), ("destination", "at", "event_id", "kind", "code", "salt"))
    assert sorted(map(tuple, stream_plans.t5(spark, sf_dir).collect()), key=lambda r: r[1]) == code_fold(events, CodeRules())


def test_registered_sessions(spark, sf_dir):
    events = plain(stream_plans.session_events(spark, sf_dir), ("user_id", "at", "event_id", "kind", "token", "refresh", "new_token", "new_refresh"))
    assert sorted(map(tuple, stream_plans.t6(spark, sf_dir).collect()), key=lambda r: r[1]) == session_fold(events, SessionRules())

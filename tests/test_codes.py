"""Streams of codes and sessions against a plain fold; state that goes when it is over; restarts."""

import datetime
import random

import pytest

from daybook.streaming import codes, state
from daybook.streaming.codes import CODE_EVENTS, SESSION_EVENTS, CodeRules, SessionRules

START = 1_700_000_000


def at(s):
    return datetime.datetime.fromtimestamp(START + s, datetime.UTC).replace(tzinfo=None)


def code_events(n, seed):
    rng = random.Random(seed)
    out, now = [], 0
    for i in range(n):
        now += rng.choice([1, 5, 20, 61, 200, 590, 700, 3000])
        who = rng.choice(["A@x ", "b@y", "98"])
        kind = rng.choice(["REQUEST", "REQUEST", "VERIFY", "VERIFY", "VERIFY"])
        out.append((who, at(now), i, kind, rng.choice(["1", "1", "2", " 1 "]) if kind == "VERIFY" else "1", f"s{i}" if kind == "REQUEST" else None))
    return out


def code_fold(events, p):
    held, out = {}, []
    for who, t, i, kind, code, salt in events:
        key = who.strip().lower()
        s = (t - at(0)).total_seconds()
        times, c = held.get(key, ([], None))
        times = [x for x in times if s - x < p.span_s]
        if c and s > c["end"] + p.forget_s:
            c = None
        if kind == "REQUEST":
            if len(times) >= p.most:
                told = ("RATE_LIMITED", None, int(p.span_s - (s - times[0])))
            elif times and s - times[-1] < p.cooldown_s:
                told = ("COOLDOWN", None, int(p.cooldown_s - (s - times[-1])))
            else:
                times, c, told = [*times, s], {"end": s + p.lives_s, "left": p.attempts, "code": code}, ("SENT", p.attempts, p.cooldown_s)
        elif c is None:
            told = ("NO_CODE", None, None)
        elif s > c["end"]:
            c, told = None, ("EXPIRED", None, None)
        elif code.strip() == c["code"]:
            c, told = None, ("VERIFIED", c["left"], None)
        else:
            c["left"] -= 1
            told = ("WRONG", c["left"], None) if c["left"] else ("LOCKED", 0, None)
            c = c if c["left"] else None
        held[key] = (times, c)
        out.append((key, i, *told))
    return sorted(out, key=lambda r: r[1])


def session_events(n, seed):
    rng = random.Random(seed)
    out, now, given = [], 0, []
    for i in range(n):
        now += rng.choice([60, 3600, 86_400, 4 * 86_400, 8 * 86_400])
        user = rng.choice(["u1", "u2"])
        kind = rng.choice(["CREATE", "ACCESS", "ACCESS", "REFRESH", "REVOKE"])
        token, refresh = rng.choice([g for g in given[-4:] if g[0].startswith(user)] or [("none", "none")])
        new = (f"{user}-t{i}", f"{user}-r{i}") if kind in ("CREATE", "REFRESH") else (None, None)
        out.append((user, at(now), i, kind, token, refresh, *new))
        if new[0]:
            given.append(new)
    return out


def session_fold(events, p):
    sessions, out = [], []
    for user, t, i, kind, token, refresh, new_token, new_refresh in events:
        s = (t - at(0)).total_seconds()
        sessions = [x for x in sessions if not (x["user"] == user and s > x["end"] + p.forget_s)]
        own = [x for x in sessions if x["user"] == user]
        hit = next((x for x in own if (x["refresh"] == refresh if kind == "REFRESH" else x["token"] == token)), None)
        fresh = {"user": user, "token": new_token, "refresh": new_refresh, "end": s + p.lives_s}
        if kind == "CREATE":
            sessions = [x for x in sessions if x["token"] != new_token] + [fresh]  # a token stands for one session
            told = ("CREATED", fresh["end"])
        elif hit is None:
            told = ("UNKNOWN", None)
        elif kind == "REFRESH":
            sessions = [x for x in sessions if x is not hit and x["token"] != new_token] + [fresh]
            told = ("REFRESHED", fresh["end"])
        elif kind == "REVOKE" or s > hit["end"]:
            sessions = [x for x in sessions if x is not hit]
            told = ("REVOKED" if kind == "REVOKE" else "EXPIRED", None)
        else:
            told = ("VALID", hit["end"])
        out.append((user, i, told[0], None if told[1] is None else at(told[1])))
    return sorted(out, key=lambda r: r[1])


class Place:
    """Events arrive file by file; the stream runs to the end of what is there and can be started again."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.base, self.schema, self.make = spark, str(tmp_path), schema, make

    def arrive(self, events):
        self.spark.createDataFrame(events, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self):
        stream = self.make(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in"))
        state.run_to_table(self.spark, stream, f"{self.base}/out", f"{self.base}/state")

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.base}/out").collect()), key=lambda r: r[1])

    def held(self, name, **options):
        reader = self.spark.read.format("statestore").options(path=f"{self.base}/state", stateVarName=name, **options)
        before = self.spark.conf.get(state.PROVIDER, None)
        self.spark.conf.set(state.PROVIDER, state.ROCKS)
        try:
            return reader.load().collect()
        finally:
            self.spark.conf.unset(state.PROVIDER) if before is None else self.spark.conf.set(state.PROVIDER, before)


@pytest.mark.parametrize("forget_s", [86_400, 500])
def test_codes_are_a_fold(spark, tmp_path, forget_s):
    p = CodeRules(forget_s=forget_s)
    events = code_events(150, forget_s)
    place = Place(spark, tmp_path, CODE_EVENTS, lambda df: codes.code_stream(df, p))
    for k in range(0, 150, 50):
        place.arrive(events[k : k + 50])
        place.run()
        place.run()  # started again with nothing new
    want = code_fold(events, p)
    assert place.rows() == want
    assert {r[2] for r in want} >= {"SENT", "COOLDOWN", "VERIFIED", "WRONG", "EXPIRED", "NO_CODE"}


def test_attempts_and_limits(spark, tmp_path):
    p = CodeRules()
    events = [("a", at(0), 0, "REQUEST", "7", "s")] + [("a", at(1 + i), 1 + i, "VERIFY", "8", None) for i in range(6)]
    events += [("a", at(100 * k), 10 + k, "REQUEST", "7", "s") for k in range(1, 5)] + [("a", at(600), 20, "REQUEST", "7", "s"), ("a", at(1200), 21, "VERIFY", "7", None), ("a", at(1201), 22, "VERIFY", "7", None)]
    place = Place(spark, tmp_path, CODE_EVENTS, lambda df: codes.code_stream(df, p))
    place.arrive(events)
    place.run()
    got = place.rows()
    assert got == code_fold(events, p)
    assert [r[2] for r in got] == ["SENT", "WRONG", "WRONG", "WRONG", "WRONG", "LOCKED", "NO_CODE", "SENT", "SENT", "RATE_LIMITED", "RATE_LIMITED", "SENT", "VERIFIED", "NO_CODE"]


def test_state_goes_when_it_is_over(spark, tmp_path):
    p = CodeRules(forget_s=100)
    place = Place(spark, tmp_path, CODE_EVENTS, lambda df: codes.code_stream(df, p))
    place.arrive([("a", at(0), 0, "REQUEST", "7", "s"), ("b", at(0), 1, "REQUEST", "7", "s")])
    place.run()
    assert len(place.held("codes")) == 2
    place.arrive([("c", at(5000), 2, "REQUEST", "7", "s")])
    place.run()
    place.arrive([("c", at(5001), 3, "VERIFY", "7", None)])
    place.run()
    held = place.held("codes")
    assert [r["key"]["destination"] for r in held] == ["c"] and held[0]["value"]["told"] is None
    assert [r[2] for r in place.rows()] == ["SENT", "SENT", "SENT", "VERIFIED"]


@pytest.mark.parametrize("forget_s", [20 * 86_400, 3600])
def test_sessions_are_a_fold(spark, tmp_path, forget_s):
    p = SessionRules(forget_s=forget_s)
    events = session_events(160, forget_s)
    place = Place(spark, tmp_path, SESSION_EVENTS, lambda df: codes.session_stream(df, p))
    for k in range(0, 160, 40):
        place.arrive(events[k : k + 40])
        place.run()
    want = session_fold(events, p)
    assert place.rows() == want
    assert {r[2] for r in want} >= {"CREATED", "VALID", "REFRESHED", "REVOKED", "UNKNOWN"} | ({"EXPIRED"} if forget_s > 86_400 else set())

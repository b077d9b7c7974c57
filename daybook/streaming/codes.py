"""One-time codes and sessions as streams with state per user and timers that drop it.

Both follow the clock of the events. A code lives ten minutes and five wrong
entries; requests are limited to three in ten minutes and one in a minute. A
session lives seven days and gets new tokens when it is refreshed. What is over
is told as over for ``forget_s`` more; then a timer drops it and it is unknown
like anything that never was. A timer fires when the watermark passes, and rows
behind the watermark are not taken, so verdicts do not depend on how rows were
cut into batches, provided that each user's rows arrive in order.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daybook.streaming.state import in_order

CODE_EVENTS = "destination string, at timestamp, event_id long, kind string, code string, salt string"
CODE_VERDICTS = "destination string, event_id long, verdict string, attempts_left int, wait_s int"
SESSION_EVENTS = "user_id string, at timestamp, event_id long, kind string, token string, refresh string, new_token string, new_refresh string"
SESSION_VERDICTS = "user_id string, event_id long, verdict string, micros long"

CodeTold = Row("destination", "event_id", "verdict", "attempts_left", "wait_s")
SessionTold = Row("user_id", "event_id", "verdict", "micros")


@dataclass(frozen=True)
class CodeRules:
    lives_s: int = 600
    attempts: int = 5
    span_s: int = 600
    most: int = 3
    cooldown_s: int = 60
    forget_s: int = 86_400


@dataclass(frozen=True)
class SessionRules:
    lives_s: int = 7 * 86_400
    forget_s: int = 86_400


def hashed(code: str, salt: str) -> str:
    return hashlib.sha256(f"{salt}:{code}".encode()).hexdigest()


def code_verdict(state: tuple[list[float], tuple | None], event: tuple, p: CodeRules) -> tuple[tuple[list[float], tuple | None], tuple]:
    """State (times of sent codes; hash, salt, end and attempts of the last) and event (seconds, kind, code, salt) to the next state and (verdict, attempts left, seconds to wait)."""
    times, open_code = state
    now, kind, code, salt = event
    if open_code and now > open_code[2] + p.forget_s:
        open_code = None
    if kind == "REQUEST":
        times = [t for t in times if now - t < p.span_s]
        if len(times) >= p.most:
            return (times, open_code), ("RATE_LIMITED", None, int(p.span_s - (now - times[0])))
        if times and now - times[-1] < p.cooldown_s:
            return (times, open_code), ("COOLDOWN", None, int(p.cooldown_s - (now - times[-1])))
        return ([*times, now], (hashed(code, salt), salt, now + p.lives_s, p.attempts)), ("SENT", p.attempts, p.cooldown_s)
    if not open_code:
        return (times, None), ("NO_CODE", None, None)
    told, own_salt, end, left = open_code
    if now > end:
        return (times, None), ("EXPIRED", None, None)
    if hmac.compare_digest(hashed((code or "").strip().replace(" ", ""), own_salt), told):
        return (times, None), ("VERIFIED", left, None)
    if left <= 1:
        return (times, None), ("LOCKED", 0, None)
    return (times, (told, own_salt, end, left - 1)), ("WRONG", left - 1, None)


class Codes(StatefulProcessor):
    def __init__(self, p: CodeRules) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("codes", "times array<double>, told string, salt string, ends double, attempts int")

    def _until(self, times: list[float], open_code: tuple | None) -> float | None:
        """When nothing of the state counts any more."""
        ends = [t + self.p.span_s for t in times[-1:]] + ([open_code[2] + self.p.forget_s] if open_code else [])
        return max(ends, default=None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        state = (list(held[0] or []), tuple(held[1:5]) if held[1] is not None else None) if held else ([], None)
        for r in in_order(rows, ["micros", "event_id"]):
            state, told = code_verdict(state, (r.micros / 1e6, r.kind, r.code, r.salt), self.p)
            yield CodeTold(key[0], r.event_id, *told)
        self._keep(state)

    def _keep(self, state: tuple[list[float], tuple | None]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        until = self._until(*state)
        if until is None:
            self.state.clear()
        else:
            self.state.update((state[0], *(state[1] or (None, None, None, None))))
            self.handle.registerTimer(int(until * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.state.clear()
        return iter(())


def session_verdict(state: dict[str, tuple[str, float]], event: tuple, p: SessionRules) -> tuple[str, float | None]:
    """State (token to its refresh token and end; changed in place) and event (seconds, kind, token, refresh, new token, new refresh) to (verdict, end)."""
    now, kind, token, refresh, new_token, new_refresh = event
    for t in [t for t, (_, end) in state.items() if now > end + p.forget_s]:
        del state[t]
    if kind == "CREATE":
        state[new_token] = (new_refresh, now + p.lives_s)
        return "CREATED", now + p.lives_s
    if kind == "REFRESH":
        old = next((t for t, (r, _) in state.items() if r == refresh and refresh), None)
        if old is None:
            return "UNKNOWN", None
        del state[old]
        state[new_token] = (new_refresh, now + p.lives_s)
        return "REFRESHED", now + p.lives_s
    if token not in state:
        return "UNKNOWN", None
    end = state[token][1]
    if kind == "REVOKE":
        del state[token]
        return "REVOKED", None
    if now > end:
        del state[token]
        return "EXPIRED", None
    return "VALID", end


class Sessions(StatefulProcessor):
    def __init__(self, p: SessionRules) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("sessions", "token string", "refresh string, ends double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = {t[0]: (v[0], v[1]) for t, v in self.state.iterator()} if self.state.exists() else {}
        state = dict(before)
        for r in in_order(rows, ["micros", "event_id"]):
            verdict, end = session_verdict(state, (r.micros / 1e6, r.kind, r.token, r.refresh, r.new_token, r.new_refresh), self.p)
            yield SessionTold(key[0], r.event_id, verdict, None if end is None else round(end * 1_000_000))
        for t in before.keys() - state.keys():
            self.state.removeKey((t,))
        for t, v in state.items():
            if before.get(t) != v:
                self.state.updateValue((t,), v)
                self.handle.registerTimer(int((v[1] + self.p.forget_s) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.state.exists():
            over = expiredTimerInfo.getExpiryTimeInMs()
            for t in [t[0] for t, v in self.state.iterator() if int((v[1] + self.p.forget_s) * 1000) + 1 <= over]:
                self.state.removeKey((t,))
        return iter(())


def code_stream(events: DataFrame, p: CodeRules = CodeRules(), late: str = "0 seconds") -> DataFrame:
    """Verdicts on a stream of ``CODE_EVENTS``: requests sent or refused, entries verified, wrong, locked, expired or without a code."""
    keyed = events.withColumn("destination", F.lower(F.trim("destination"))).withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    return keyed.groupBy("destination").transformWithState(Codes(p), CODE_VERDICTS, "Append", "EventTime")


def session_stream(events: DataFrame, p: SessionRules = SessionRules(), late: str = "0 seconds") -> DataFrame:
    """Verdicts on a stream of ``SESSION_EVENTS``: CREATE, ACCESS, REFRESH and REVOKE."""
    told = events.withColumn("micros", F.unix_micros("at")).withWatermark("at", late).groupBy("user_id").transformWithState(Sessions(p), SESSION_VERDICTS, "Append", "EventTime")
    return told.select("user_id", "event_id", "verdict", F.timestamp_micros("micros").alias("expires_at"))

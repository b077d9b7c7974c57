"""An audit that goes on: appended pages get the verdicts of an audit of the whole statement, without its earlier pages being read.

Per statement three numbers are kept: the opening balance, the balance after
the last row (printed, or the last printed one and the movement since), and the
last row's number. Amounts are whole hundredths in the state. Rows must come in
the order of their numbers; a row that comes after a later one is told as late
and moves nothing, as it would take an audit of the whole statement.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from daybook.operators import balance
from daybook.streaming.state import in_order

ROWS = "stmt_id long, row_index int, tx_date date, debit decimal(15,2), credit decimal(15,2), balance decimal(15,2), opening decimal(15,2)"
_AMOUNTS = ("debit", "credit", "balance", "opening")
_MADE = ("opening_known", "previous_balance")
_OUT = "stmt_id long, row_index int, tx_date date, debit long, credit long, balance long, opening long, opening_known long, previous_balance long, is_late boolean"

#: A row of ``_OUT``.
Told = Row(*[x.split()[0] for x in _OUT.split(", ")])


class Balances(StatefulProcessor):
    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("balance", "opening long, now long, last long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get()
        known, now, last = held if held else (None, None, None)
        moved, anchor, due = 0, None, False  # movement in this batch; the last printed balance less the movement up to it
        for r in in_order(rows, ["row_index"]):
            told = (*key, r.row_index, r.tx_date, r.debit, r.credit, r.balance, r.opening)
            if held and r.row_index <= held[2]:
                yield Told(*told, None, None, True)
                continue
            if held is None and not due:
                known = now = r.opening if r.opening is not None else _opening_of(r)
            due, last = True, r.row_index
            before = now if anchor is None else anchor
            previous = _plus(moved, before)
            moved = _plus(moved, None if r.debit is None or r.credit is None else r.credit - r.debit)
            yield Told(*told, known, None if moved is None else previous, False)
            if moved is not None and r.balance is not None:
                anchor = r.balance - moved
        if due:
            self.state.update((known, _plus(moved, now if anchor is None else anchor), last))


def _plus(a: int | None, b: int | None) -> int | None:
    return None if a is None or b is None else a + b


def _opening_of(first: Row) -> int | None:
    """The balance before the first row, from the balance printed after it."""
    if first.credit is not None and first.credit > 0:
        return _plus(first.balance, -first.credit)
    return _plus(first.balance, first.debit)


def continued_audit(rows: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The audit of a stream of ``ROWS``, appended batch by batch. ``is_late`` rows have no verdict. ``forget_ms``: a statement without new rows for so long is forgotten."""
    cents = lambda c: (F.col(c) * 100).cast("long").alias(c)
    stream = rows.select("stmt_id", "row_index", "tx_date", *[cents(c) for c in _AMOUNTS])
    carried = stream.groupBy("stmt_id").transformWithState(Balances(forget_ms), _OUT, "Append", "ProcessingTime" if forget_ms else "None")
    money = lambda c: (F.col(c).cast("decimal(18,0)") / 100).cast(balance.MONEY).alias(c)
    told = carried.select("stmt_id", "row_index", "tx_date", "is_late", *[money(c) for c in (*_AMOUNTS, *_MADE)])
    columns = ["stmt_id", "row_index", "tx_date", "is_late", *_AMOUNTS]
    audited = balance.judged(told, columns)
    unknown = F.col("is_late")
    return audited.withColumns({"outcome": F.when(unknown, "LATE").otherwise(F.col("outcome")), "validation_status": F.when(unknown, "PENDING").otherwise(F.col("validation_status"))})

"""Debit or credit of rows that print only an amount and a balance.

Rows are one statement's in order of ``row_index`` with ``amount``, ``balance``
and ``text``. The balance before decides; each layout has its own rule for the
first row and for balances that fit neither way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
# Words that tell a direction when balances do not.
OUT_WORDS = ("ATM", "WITHDRAWAL", "CASH WDL", "CHARGES", "PAYMENT")
OUT_WORDS_SHORT = ("DEBIT", "WDL", "ATM", "PAYMENT", "CHARGES")
IN_WORDS = ("CREDIT", "DEPOSIT", "BY TRANSFER", "SALARY", "REFUND", "INTEREST RECEIVED", "INT RECD")
IN_WORDS_SECTION = ("INTEREST CREDIT", "TRF FR")


def says(text: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*[F.upper(text).contains(w).cast("int") for w in words], F.lit(0)) == 1


@dataclass(frozen=True)
class Layout:
    """How a layout tells directions. ``first`` and ``unclear`` name the rules used there."""

    first: str  # "second_fits", "falls_next", "words_out", "debit_if_next_adds", "words_in"
    unclear: str  # "words_out", "falls", "debit", "words_in"


#: By parser key; every other key uses GENERIC.
LAYOUTS = {
    "pnb_standard": Layout("second_fits", "words_out"),
    "hdfc_standard": Layout("falls_next", "falls"),
    "icici_standard": Layout("words_out", "falls"),
    "uco_standard": Layout("debit_if_next_adds", "debit"),
    "kccb_standard": Layout("words_in_section", "falls"),
}
GENERIC = Layout("words_in", "words_in")


def with_directions(rows: DataFrame, layout: Layout, seed: str | None = None) -> DataFrame:
    """``rows`` with ``is_debit``. ``seed``: a column with the balance before a row where the statement prints one (section openings)."""
    w = Window.partitionBy("stmt_id").orderBy("row_index")
    amount, bal = F.col("amount"), F.col("balance")
    prev = F.lag("balance").over(w)
    if seed:
        prev = F.coalesce(F.col(seed), prev)
    next_amount, next_bal = F.lead("amount").over(w), F.lead("balance").over(w)
    alone = next_bal.isNull()
    first = {
        "second_fits": F.when(alone, says(F.col("text"), OUT_WORDS)).otherwise((bal - next_amount != next_bal) & (bal + next_amount != next_bal)),
        "falls_next": F.when(alone, F.lit(True)).otherwise(next_bal < bal),
        "words_out": says(F.col("text"), OUT_WORDS_SHORT),
        "debit_if_next_adds": ~alone & (bal + next_amount == next_bal),
        "words_in": ~says(F.col("text"), IN_WORDS),
        "words_in_section": ~says(F.col("text"), IN_WORDS_SECTION),
    }[layout.first]
    unclear = {"words_out": says(F.col("text"), OUT_WORDS), "falls": bal < prev, "debit": F.lit(True), "words_in": ~says(F.col("text"), IN_WORDS)}[layout.unclear]
    told = F.when(prev.isNull(), first).when(prev - amount == bal, True).when(prev + amount == bal, False).otherwise(unclear)
    return rows.withColumn("is_debit", F.coalesce(told, F.lit(False)))


def net_known(rows: DataFrame) -> DataFrame:
    """Rows in reversed print order (newest first) put in order of time."""
    return rows.withColumn("row_index", F.row_number().over(Window.partitionBy("stmt_id").orderBy(F.desc("row_index"))))


def from_amounts(rows: DataFrame, exact_sides: bool = True) -> DataFrame:
    """Debit, credit and balance of records from their list of ``amounts``.

    Three or more: debit, credit, balance; if both sides are there the balance
    before decides, else the larger stays. Two: amount and balance, by a (DR) or
    (CR) mark, then by the balance before, then by words. One: a debit without
    balance. ``previous`` must hold the balance before (null if unknown).
    """
    n = F.size("amounts")
    at = lambda i: F.get("amounts", F.lit(i)).cast(MONEY)
    last = F.element_at("amounts", -1).cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    prev, up = F.col("previous"), F.upper("text")
    d, c = at(0), at(1)
    both = (d > 0) & (c > 0)
    larger = F.when(d >= c, F.struct(d.alias("d"), zero.alias("c"))).otherwise(F.struct(zero.alias("d"), c.alias("c")))
    pair = lambda x, y: F.struct(x.cast(MONEY).alias("d"), y.cast(MONEY).alias("c"))
    net = c - d
    three = (
        F.when(~both, pair(d, c))
        .when(prev + c == last, pair(zero, c))
        .when(prev - d == last, pair(d, zero))
        .when((prev + net == last) & F.lit(exact_sides), F.when(net > 0, pair(zero, net)).otherwise(pair(F.abs(net), zero)))
        .otherwise(larger)
    )
    as_debit, as_credit = pair(d, zero), pair(zero, d)
    marked_dr, marked_cr = up.rlike(r"\(\s*DR\s*\)"), up.rlike(r"\(\s*CR\s*\)")
    two = (
        F.when(marked_dr, as_debit).when(marked_cr, as_credit).when(prev - d == at(1), as_debit).when(prev + d == at(1), as_credit)
        .when(says(F.col("text"), IN_WORDS), as_credit).otherwise(as_debit)
    )
    side = F.when(n >= 3, three).when(n == 2, two).when(n == 1, as_debit).otherwise(pair(zero, zero))
    return rows.withColumn("side", side).withColumn("debit", F.col("side.d")).withColumn("credit", F.col("side.c")).withColumn("balance", F.when(n >= 2, last)).drop("side")


def previous_printed(records: DataFrame) -> DataFrame:
    """Records with ``previous``: the balance before each.

    A record with two or more amounts prints its balance. One with a single
    amount is a debit without balance, so the balance before moves down by it:
    what lies between two printed balances is known before any direction is told.
    """
    w = Window.partitionBy("doc_id").orderBy("record")
    so_far, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("amounts")
    printed = F.when(n >= 2, F.element_at("amounts", -1)).cast("decimal(25,2)")
    silent = F.when(n == 1, -F.get("amounts", F.lit(0))).otherwise(0).cast("decimal(25,2)")
    moved = records.withColumn("printed", printed).withColumn("silent", silent).withColumn("moved", F.sum("silent").over(so_far))
    anchor = F.last(F.col("printed") - F.col("moved"), ignorenulls=True).over(ahead)
    return moved.withColumn("previous", (anchor + F.col("moved") - F.col("silent")).cast(MONEY)).drop("printed", "silent", "moved")

"""Running balances: audit, chronology, duplicates, re-audits, totals.

Rows are one statement's by ``stmt_id`` in the order of ``row_index``. The audit
reads like a fold but is not recursive: the balance before a row is the last
printed balance plus the net movement since, which two windows over the same
partitioning and order give, so a statement is exchanged and sorted once.

Those windows hold a statement in one task. With ``block_rows`` the same values
come from a scan in two levels (``blocks``), for statements of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from daybook.operators.blocks import ahead, last_known, so_far, two_level

MONEY = "decimal(15,2)"
WIDE = "decimal(25,2)"
EXACT, MINOR = 0.01, 1.00


def in_order(stmt: str = "stmt_id", row: str = "row_index"):
    return Window.partitionBy(stmt).orderBy(row)


def money(x: float | str) -> Column:
    return F.lit(str(x)).cast(MONEY)


def opening_from(balance: Column, debit: Column, credit: Column) -> Column:
    """A balance without the row's own movement; a row with credit counts as a credit."""
    return F.when(credit > 0, balance - credit).when(debit > 0, balance + debit).otherwise(balance).cast(MONEY)


FIRST = ("balance", "debit", "credit", "opening")


def opening_of(first: Column) -> Column:
    """The opening balance given with a statement's first row, else what its balance tells."""
    return F.coalesce(first["opening"], opening_from(first["balance"], first["debit"], first["credit"])).cast(MONEY)


def carried_over_blocks(tx: DataFrame, net: Column, block_rows: int) -> DataFrame:
    """``local_moved`` and ``local_anchor`` (the last balance before a row less the movement up to it) within blocks, and of the blocks before: ``first`` row, ``before_moved`` and ``before_anchor``."""

    def local(rows: DataFrame, w: WindowSpec) -> DataFrame:
        moved = rows.withColumn("local_moved", F.sum(net).over(so_far(w)).cast(WIDE))
        return moved.withColumn("local_anchor", last_known(F.col("balance") - F.col("local_moved"), w))

    place = F.when(F.col("balance").isNotNull(), F.struct("row_index", (F.col("balance") - F.col("local_moved")).alias("anchor")))
    reduced = {"net": F.sum(net).cast(WIDE), "first": F.min_by(F.struct(*FIRST), "row_index"), "anchor": F.max(place)["anchor"]}

    def scan(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        blocks = blocks.withColumn("first", F.first("first").over(so_far(w))).withColumn("before_moved", F.coalesce(F.sum("net").over(ahead(w)), F.lit(0)).cast(WIDE))
        return blocks.withColumn("before_anchor", last_known(F.col("anchor") - F.col("before_moved"), w))

    return two_level(tx, local, reduced, scan, ("first", "before_moved", "before_anchor"), block_rows)


def with_previous(tx: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``opening_known`` (given, else from the first row's balance) and ``previous_balance`` of every row."""
    w = in_order()
    net = (F.col("credit") - F.col("debit")).cast(WIDE)
    if block_rows:
        rows = carried_over_blocks(tx, net, block_rows).withColumn("opening_known", opening_of(F.col("first")))
        # an anchor of the own block counts the own block's movement only
        before = F.coalesce(F.col("local_anchor"), F.col("before_anchor") + F.col("before_moved"), F.col("opening_known") + F.col("before_moved"))
        return rows.withColumn("previous_balance", (F.col("local_moved") - net + before).cast(MONEY)).drop("local_moved", "local_anchor", "first", "before_moved", "before_anchor")
    first = F.first(F.struct(*FIRST)).over(so_far(w))
    moved = tx.withColumn("moved", F.sum(net).over(so_far(w)).cast(WIDE)).withColumn("opening_known", opening_of(first))
    anchor = last_known(F.col("balance") - F.col("moved"), w)
    return moved.withColumn("previous_balance", (F.col("moved") - net + F.coalesce(anchor, F.col("opening_known"))).cast(MONEY)).drop("moved")


def audit(tx: DataFrame, confidence: str | None = None, block_rows: int | None = None) -> DataFrame:
    """Status of every row, with debit and credit swapped where only that explains the balance.

    ``expected_balance`` uses the sides as given; ``raw_debit`` and ``raw_credit``
    keep them, since totals are taken before the swap.
    """
    return judged(with_previous(tx, block_rows), tx.columns, confidence)


def judged(rows: DataFrame, columns: list[str], confidence: str | None = None) -> DataFrame:
    """The audit of rows whose previous balance is known; keeps ``columns``."""
    d, c, b, p = F.col("debit"), F.col("credit"), F.col("balance"), F.col("previous_balance")
    off, inverted = F.abs(p + c - d - b), F.abs(p - c + d - b)
    known = b.isNotNull() & p.isNotNull()
    case = (
        F.when((d == 0) & (c == 0), "ZERO")
        .when(known & (off <= money(EXACT)), "MATCH")
        .when(known & (off <= money(MINOR)), "MINOR")
        .when(known & (inverted <= money(MINOR)), "SWAPPED")
        .when(known, "MISMATCH")
        .otherwise("UNKNOWN")
    )
    start = F.col(confidence) if confidence else F.lit(90.0)
    rows = rows.withColumn("outcome", case).withColumn("expected_balance", (p + c - d).cast(MONEY))
    swapped = F.col("outcome") == "SWAPPED"
    return rows.select(
        *[x for x in columns if x not in ("debit", "credit")],
        "opening_known", "previous_balance", "expected_balance", "outcome",
        F.col("debit").alias("raw_debit"), F.col("credit").alias("raw_credit"),
        F.when(swapped, F.col("credit")).otherwise(F.col("debit")).alias("debit"),
        F.when(swapped, F.col("debit")).otherwise(F.col("credit")).alias("credit"),
        F.when(F.col("outcome").isin("ZERO", "MINOR"), "WARNING").when(F.col("outcome") == "MISMATCH", "ERROR").otherwise("VALID").alias("validation_status"),
        F.when(F.col("outcome") == "MATCH", F.least(F.lit(100.0), start + 10)).when(F.col("outcome") == "MINOR", F.greatest(F.lit(70.0), start - 10))
        .when(F.col("outcome") == "MISMATCH", F.greatest(F.lit(30.0), start - 50)).otherwise(start).alias("confidence"),
    )


def statement_summary(audited: DataFrame) -> DataFrame:
    """Totals, span of dates, counts and confidence of each statement."""
    bad = F.count_if(F.col("validation_status") != "VALID")
    errors = F.count_if(F.col("validation_status") == "ERROR")
    n = F.count(F.lit(1))
    sums = audited.groupBy("stmt_id").agg(
        n.alias("n_rows"),
        F.sum("raw_debit").cast(WIDE).alias("total_debit"),
        F.sum("raw_credit").cast(WIDE).alias("total_credit"),
        F.min("tx_date").alias("statement_from"),
        F.max("tx_date").alias("statement_to"),
        F.max(F.col("opening_known")).alias("opening_balance"),
        F.max_by("balance", "row_index").alias("closing_balance"),
        bad.alias("n_discrepancies"),
        errors.alias("n_errors"),
    )
    share = (F.col("n_rows") - F.col("n_discrepancies")) / F.col("n_rows") * 100.0 - F.col("n_errors") / F.col("n_rows") * 20.0
    return sums.withColumn("confidence_score", F.round(F.greatest(F.lit(0.0), share), 2))


def reversed_statements(tx: DataFrame) -> DataFrame:
    """(stmt_id, is_reversed): more falling than rising neighbouring dates (two at least); with no change of date, balances that only fit backwards."""
    w = in_order()
    nxt = lambda c: F.lead(c).over(w)
    pairs = tx.select("stmt_id", "row_index", "tx_date", "debit", "credit", "balance", F.row_number().over(w).alias("place"),
                      nxt("tx_date").alias("d1"), nxt("balance").alias("b1"), nxt("debit").alias("dr1"), nxt("credit").alias("cr1"))
    near = lambda x: F.count_if((F.col("place") <= 25) & (F.abs(x) <= money(0.05)))
    counts = pairs.groupBy("stmt_id").agg(
        F.count_if(F.col("tx_date") > F.col("d1")).alias("falling"),
        F.count_if(F.col("tx_date") < F.col("d1")).alias("rising"),
        near(F.col("balance") + F.col("cr1") - F.col("dr1") - F.col("b1")).alias("forward"),
        near(F.col("b1") + F.col("credit") - F.col("debit") - F.col("balance")).alias("backward"),
    )
    by_date = (F.col("falling") > F.col("rising")) & (F.col("falling") >= 2)
    tied = (F.col("falling") == 0) & (F.col("rising") == 0) & (F.col("backward") > F.col("forward")) & (F.col("backward") >= 2)
    return counts.select("stmt_id", "falling", "rising", (by_date | tied).alias("is_reversed"))


def in_chronology(tx: DataFrame) -> DataFrame:
    """Reversed statements turned round and numbered anew, their opening and closing balances set from their new ends."""
    told = tx.join(reversed_statements(tx).select("stmt_id", "is_reversed"), "stmt_id")
    w = Window.partitionBy("stmt_id").orderBy(F.when(F.col("is_reversed"), -F.col("row_index")).otherwise(F.col("row_index")))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.struct("balance", "debit", "credit")).over(whole)
    opening = F.when(F.col("is_reversed") & first["balance"].isNotNull(), opening_from(first["balance"], first["debit"], first["credit"])).otherwise(F.col("opening"))
    return told.withColumn("new_index", F.row_number().over(w)).withColumn("new_opening", opening).withColumn("last_balance", F.last("balance").over(whole))


def duplicates(tx: DataFrame) -> DataFrame:
    """Rows alike in date, amounts, narration and reference: all but the first are suspects and name the first."""
    shape = lambda c: F.upper(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    keyed = tx.withColumn("key_narration", shape("narration")).withColumn("key_reference", F.upper(F.trim(F.coalesce(F.col("reference"), F.lit("")))))
    w = Window.partitionBy("stmt_id", "tx_date", "debit", "credit", "key_narration", "key_reference").orderBy("row_index")
    first = F.first("row_index").over(w)
    suspect = F.row_number().over(w) > 1
    return keyed.select(*tx.columns, suspect.alias("is_duplicate_suspect"), F.when(suspect, first).alias("duplicate_of"))


def coarse_duplicate_counts(tx: DataFrame) -> DataFrame:
    """Per statement how many rows repeat a (date, amounts, first 30 characters of narration)."""
    keys = F.struct("tx_date", "debit", "credit", F.substring("narration", 1, 30).alias("start"))
    return tx.groupBy("stmt_id").agg((F.count(F.lit(1)) - F.count_distinct(keys)).alias("duplicate_count"))


def _reviewed(tx: DataFrame, error: Column, net: Column) -> DataFrame:
    """``before``: the balance before each row, null where it is unknown."""
    w = in_order()
    opening = F.first("opening").over(so_far(w))
    known = opening.isNotNull() | F.coalesce(F.max((error & F.col("balance").isNotNull()).cast("int")).over(ahead(w)) == 1, F.lit(False))
    rows = tx.withColumn("known", known).withColumn("moved", F.sum(net).over(so_far(w)).cast(WIDE)).withColumn("start", opening)
    anchors = F.when(F.col("balance").isNotNull() & (error | F.col("known")), F.col("balance") - F.col("moved"))
    before = F.when(F.col("known"), F.col("moved") - net + F.coalesce(F.last(anchors, ignorenulls=True).over(ahead(w)), F.col("start")))
    return rows.withColumn("before", before.cast(MONEY))


def _reviewed_in_blocks(tx: DataFrame, error: Column, net: Column, block_rows: int) -> DataFrame:
    """The same by a scan over blocks. Which balances count depends on whether the statement is known when a block begins, so a block hands on the last balance of either case."""
    printed = F.col("balance").isNotNull()

    def local(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("local_moved", F.sum(net).over(so_far(w)).cast(WIDE)).withColumn("told", F.coalesce(F.max((error & printed).cast("int")).over(ahead(w)) == 1, F.lit(False)))
        rows = rows.withColumn("anchor", F.when(printed, F.col("balance") - F.col("local_moved")))
        return rows.withColumn("if_known", last_known(F.col("anchor"), w)).withColumn("if_not", last_known(F.when(error | F.col("told"), F.col("anchor")), w))

    last = lambda counts: F.max(F.when(counts & printed, F.struct("row_index", "anchor")))["anchor"]
    reduced = {"net": F.sum(net).cast(WIDE), "first": F.min_by(F.struct("opening"), "row_index"), "tells": F.max((error & printed).cast("int")), "last_if_known": last(F.lit(True)), "last_if_not": last(error | F.col("told"))}

    def scan(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        known = F.col("start").isNotNull() | F.coalesce(F.max("tells").over(ahead(w)) == 1, F.lit(False))
        blocks = blocks.withColumn("start", F.first("first").over(so_far(w))["opening"]).withColumn("known_before", known)
        blocks = blocks.withColumn("before_moved", F.coalesce(F.sum("net").over(ahead(w)), F.lit(0)).cast(WIDE))
        anchor = F.when(F.col("known_before"), F.col("last_if_known")).otherwise(F.col("last_if_not")) - F.col("before_moved")
        return blocks.withColumn("before_anchor", last_known(anchor, w))

    rows = two_level(tx, local, reduced, scan, ("start", "known_before", "before_moved", "before_anchor"), block_rows)
    rows = rows.withColumn("known", F.col("known_before") | F.col("told"))
    anchor = F.when(F.col("known_before"), F.col("if_known")).otherwise(F.col("if_not"))
    before = F.coalesce(anchor, F.col("before_anchor") + F.col("before_moved"), F.col("start") + F.col("before_moved"))
    return rows.withColumn("before", F.when(F.col("known"), F.col("local_moved") - net + before).cast(MONEY))


def review_audit(tx: DataFrame, status: str = "validation_status", block_rows: int | None = None) -> DataFrame:
    """Audit after a reviewer's edits: rows already in error stay so and move nothing; missing balances are filled.

    A statement without an opening balance is unknown until an error row prints one.
    """
    error = F.col(status) == "ERROR"
    net = F.when(error, F.lit(0)).otherwise(F.col("credit") - F.col("debit")).cast(WIDE)
    rows = _reviewed_in_blocks(tx, error, net, block_rows) if block_rows else _reviewed(tx, error, net)
    expected = (F.col("before") + F.col("credit") - F.col("debit")).cast(MONEY)
    off = F.abs(expected - F.col("balance"))
    both = F.col("before").isNotNull() & F.col("balance").isNotNull()
    verdict = (
        F.when(error, "ERROR").when(both & (off <= money(EXACT)), "VALID").when(both & (off <= money(MINOR)), "WARNING").when(both, "ERROR")
        .when(F.col("before").isNotNull(), "VALID").otherwise(F.col(status))
    )
    filled = F.when(~error & F.col("balance").isNull() & F.col("before").isNotNull(), expected).otherwise(F.col("balance"))
    return rows.select("stmt_id", "row_index", filled.alias("balance"), verdict.alias("validation_status"))


def strict_audit(tx: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Audit that allows no difference: any is a warning."""
    rows = with_previous(tx, block_rows)
    differs = F.col("balance").isNotNull() & F.col("previous_balance").isNotNull() & (F.col("previous_balance") + F.col("credit") - F.col("debit") != F.col("balance"))
    return rows.select("stmt_id", "row_index", F.when(differs, "WARNING").otherwise("VALID").alias("validation_status"))


def closing_check(summary: DataFrame) -> DataFrame:
    """Opening plus credits minus debits against the closing balance."""
    expected = (F.col("opening_balance") + F.col("total_credit") - F.col("total_debit")).cast(WIDE)
    return summary.select("stmt_id", expected.alias("expected_closing"), "closing_balance", (expected != F.col("closing_balance")).alias("differs"))


def job_status(summary: DataFrame, is_partial: Column) -> DataFrame:
    """Mismatch flag and status of a conversion; partial ones skip the closing check."""
    differs = (F.col("opening_balance") + F.col("total_credit") - F.col("total_debit")) != F.col("closing_balance")
    mismatch = (F.col("n_errors") > 0) | (~is_partial & F.coalesce(differs, F.lit(False)))
    return summary.select(
        "stmt_id",
        F.when(mismatch, "MISMATCH").otherwise("VALID").alias("balance_status"),
        F.when(is_partial, "PARTIALLY_COMPLETED").when(mismatch, "NEEDS_REVIEW").otherwise("COMPLETED").alias("job_status"),
        (F.col("n_errors") == 0).alias("ready_for_export"),
    )

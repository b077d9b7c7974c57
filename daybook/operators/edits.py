"""A reviewer's edits as overlays that are joined to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edit_rows(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Single-row edits. ``changes``: stmt_id, at, new_ledger, new_type, new_narration (null: leave).

    ``at`` is a row number; where the statement has no such row it is a place from 0.
    """
    w = Window.partitionBy("stmt_id").orderBy("row_index")
    placed = rows.select("stmt_id", "row_index", (F.row_number().over(w) - 1).alias("place"))
    direct = changes.join(placed, (changes["stmt_id"] == placed["stmt_id"]) & (changes["at"] == placed["row_index"]), "left_semi").withColumn("target", F.col("at"))
    other = changes.join(placed, (changes["stmt_id"] == placed["stmt_id"]) & (changes["at"] == placed["row_index"]), "left_anti")
    by_place = other.join(placed.withColumnRenamed("row_index", "target"), (other["stmt_id"] == placed["stmt_id"]) & (other["at"] == F.col("place"))).select(*[other[c] for c in other.columns], "target")
    overlay = direct.unionByName(by_place).select("stmt_id", F.col("target").cast("int").alias("row_index"), "new_ledger", "new_type", "new_narration")
    both = rows.join(overlay, ["stmt_id", "row_index"], "left")
    confirmed = F.col("new_ledger").isNotNull()
    out = {
        "ledger_name": F.coalesce(F.trim("new_ledger"), F.col("ledger_name")),
        "voucher_type": F.coalesce("new_type", "voucher_type"),
        "narration": F.coalesce("new_narration", "narration"),
        "mapping_status": F.when(confirmed, "User Confirmed").otherwise(F.col("mapping_status")),
        "validation_status": F.when(confirmed, "VALID").otherwise(F.col("validation_status")),
        "validation_notes": F.when(~confirmed, F.col("validation_notes")),
    }
    return both.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])


def resolve_targets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows meant by numbers from 0 or from 1: from 0 if a 0 is among them, or if all are below the number of rows."""
    w = Window.partitionBy("stmt_id").orderBy("row_index")
    placed = rows.select("stmt_id", "row_index", (F.row_number().over(w) - 1).alias("place"))
    sizes = rows.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n"))
    zero = asked.join(sizes, "stmt_id").groupBy("stmt_id").agg((F.bool_or(F.col("at") == 0) | F.bool_and((F.col("at") >= 0) & (F.col("at") < F.col("n")))).alias("from_zero"))
    told = asked.join(zero, "stmt_id")
    meant = F.when(F.col("from_zero"), F.col("place")).otherwise(F.col("row_index"))
    return placed.join(told.withColumnRenamed("stmt_id", "s"), (F.col("stmt_id") == F.col("s")) & (meant == F.col("at"))).select("stmt_id", "row_index").distinct()


def _confirm(rows: DataFrame, hit, ledger: str, voucher: str | None) -> DataFrame:
    out = {
        "ledger_name": F.when(hit, F.lit(ledger)).otherwise(F.col("ledger_name")),
        "mapping_status": F.when(hit, "User Confirmed").otherwise(F.col("mapping_status")),
        "validation_status": F.when(hit, "VALID").otherwise(F.col("validation_status")),
        "validation_notes": F.when(~hit, F.col("validation_notes")),
    }
    if voucher:
        out["voucher_type"] = F.when(hit, F.lit(voucher)).otherwise(F.col("voucher_type"))
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])


def assign(rows: DataFrame, targets: DataFrame, ledger: str, voucher: str | None = None, similar: bool = False) -> DataFrame:
    """Give the target rows a ledger; with ``similar`` also rows of their statement with a target's party, or naming it in the narration."""
    marked = rows.join(targets.select("stmt_id", "row_index", F.lit(True).alias("is_target")), ["stmt_id", "row_index"], "left")
    hit = F.coalesce(F.col("is_target"), F.lit(False))
    if similar:
        named = targets.join(rows, ["stmt_id", "row_index"]).where(F.coalesce("party_name", F.lit("")) != "")
        parties = named.groupBy("stmt_id").agg(F.collect_set(F.upper("party_name")).alias("parties"))
        marked = marked.join(parties, "stmt_id", "left")
        alike = F.exists(F.coalesce("parties", F.array().cast("array<string>")), lambda p: (F.coalesce(F.upper("party_name"), F.lit("")) == p) | F.upper("narration").contains(p))
        hit = hit | alike
    return _confirm(marked.withColumn("hit", hit), F.col("hit"), ledger, voucher).select(*rows.columns)


def saved_rules(rows: DataFrame, targets: DataFrame, ledger: str) -> DataFrame:
    """Rules (pattern, ledger) that an assignment to similar rows leaves behind."""
    named = targets.join(rows, ["stmt_id", "row_index"]).where(F.coalesce("party_name", F.lit("")) != "")
    return named.select(F.upper("party_name").alias("pattern"), F.lit(ledger).alias("ledger")).distinct()


def auto_resolve(rows: DataFrame, cash: str = "Cash") -> DataFrame:
    """Voucher type by direction, empty ledgers to Suspense, warnings cleared unless they tell of zero amounts."""
    d, c = F.col("debit"), F.col("credit")
    one_sided = ((d > 0) & (c == 0)) | ((c > 0) & (d == 0))
    to_cash = ~one_sided & F.col("is_cash_transaction")
    kind = F.when((d > 0) & (c == 0), "Payment").when((c > 0) & (d == 0), "Receipt").when(F.col("is_cash_transaction"), "Contra").when(d > c, "Payment").otherwise("Receipt")
    cleared = (F.col("validation_status") == "WARNING") & ~F.lower(F.coalesce("validation_notes", F.lit(""))).contains("zero")
    out = {
        "voucher_type": kind,
        "ledger_name": F.coalesce(F.when(to_cash, F.lit(cash)).otherwise(F.nullif(F.col("ledger_name"), F.lit(""))), F.lit("Suspense")),
        "validation_status": F.when(cleared, "VALID").otherwise(F.col("validation_status")),
        "validation_notes": F.when(~cleared, F.col("validation_notes")),
    }
    return rows.select(*[out.get(x, F.col(x)).alias(x) for x in rows.columns])


def ignore_warnings(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Target rows become valid, errors too."""
    marked = rows.join(targets.select("stmt_id", "row_index", F.lit(True).alias("is_target")), ["stmt_id", "row_index"], "left")
    hit = F.coalesce(F.col("is_target"), F.lit(False))
    out = {"validation_status": F.when(hit, "VALID").otherwise(F.col("validation_status")), "validation_notes": F.when(~hit, F.col("validation_notes"))}
    return marked.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])


def append_pages(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of pages processed later, numbered on from the statement's last row."""
    last = rows.groupBy("stmt_id").agg(F.max("row_index").alias("last"))
    number = F.row_number().over(Window.partitionBy("stmt_id").orderBy("row_index"))
    moved = more.withColumn("row_index", number).join(last, "stmt_id", "left").withColumn("row_index", (F.col("row_index") + F.coalesce("last", F.lit(0))).cast("int")).drop("last")
    return rows.unionByName(moved)

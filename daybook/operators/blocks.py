"""Running values over statements of any length: a scan in two levels.

A window over a statement is one task, however long the statement is. Here a
statement is cut into blocks of rows (by ``row_index``, so blocks follow one
another), each block is reduced to one row of what it hands on, these rows are
scanned per statement, and every row of a block gets what its block is handed.
Rows are exchanged once, by statement and block; what is scanned per statement
is one row a block. ``row_index`` must be a whole number; blocks with few rows
(gaps in the numbering) cost nothing but their summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a block: large enough that a year of any account is one block, small enough for a task.
BLOCK_ROWS = 100_000


def two_level(rows: DataFrame, local: Callable[[DataFrame, WindowSpec], DataFrame], reduced: dict[str, Column], scan: Callable[[DataFrame, WindowSpec], DataFrame], handed: tuple[str, ...], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with what ``local`` adds from the rows' own blocks, and the columns ``handed`` from the blocks before.

    ``local`` adds columns by windows over the ordered block; ``reduced`` has one
    aggregate each over a block's rows, local columns included; ``scan`` makes the
    columns ``handed`` of these by windows over a statement's ordered blocks.
    """
    cut = rows.withColumn("_block", F.floor(F.col("row_index") / block_rows))
    here = local(cut, Window.partitionBy("stmt_id", "_block").orderBy("row_index"))
    blocks = here.groupBy("stmt_id", "_block").agg(*[c.alias(name) for name, c in reduced.items()])
    scanned = scan(blocks, Window.partitionBy("stmt_id").orderBy("_block")).select(F.col("stmt_id").alias("_stmt"), F.col("_block").alias("_of"), *handed)
    same = F.col("stmt_id").eqNullSafe(F.col("_stmt")) & F.col("_block").eqNullSafe(F.col("_of"))
    return here.join(scanned, same).drop("_block", "_stmt", "_of")


def ahead(w: WindowSpec) -> WindowSpec:
    """All that comes before, the row itself left out."""
    return w.rowsBetween(Window.unboundedPreceding, -1)


def so_far(w: WindowSpec) -> WindowSpec:
    """All that comes before, the row itself included."""
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_known(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(ahead(w))

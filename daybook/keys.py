"""Joins on keys of which some may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is large if it holds more rows than this and more than this share of all rows.
HOT_ROWS, HOT_SHARE = 1000, 10_000


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_key`` (one row a key, ``size`` of which tells how many of ``rows`` it has).

    Keys that hold more than a ten-thousandth of ``total`` rows (and over 1000)
    are joined by a broadcast: there are at most 10,000 of them, whatever the
    data. The others are shuffled, so no task gets a large group. ``rows`` is
    read twice if there are such keys; ``per_key`` must be a written table.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, rest = per_key.where(F.col(size) > limit), per_key.where(F.col(size) <= limit)
    if hot.isEmpty():
        return rows.join(per_key, key, how)
    calm = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(calm.join(rest, key, how))

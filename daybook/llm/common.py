"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.keys import join_by_key
from daybook.storage import remove_paths, run_folder, written, written_paths

__all__ = ["WORD_GAP", "join_by_key", "own_name", "remove_since", "run_folder", "table", "whole_text", "written", "written_paths"]

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def remove_since(spark: SparkSession, mark: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables written after the first ``mark`` ones, but for those whose label begins with one of ``keep``.

    For tables that only led to others, which are written by now.
    """
    remove_paths(spark, [p for p in written_paths()[mark:] if not (keep and p.rpartition("/")[2].startswith(keep))])

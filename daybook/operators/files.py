"""Checks on files, from the columns of Spark's ``binaryFile`` source: path, modificationTime, length, content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 25 * 1024 * 1024
MAGIC = "255044462D"  # fixed value: the bytes %PDF- in hexadecimal
TEMP_MINUTES = 60


def file_status(length: Column, content: Column, most_bytes: int = MOST_BYTES) -> Column:
    """EMPTY, TOO_LARGE, NOT_A_STATEMENT (the first bytes tell another kind of file), LOCKED (encrypted) or OK."""
    head = F.hex(F.substring(content, 1, 5))
    # A content search without copying the file into text: the mark of an encrypted file stands in its trailer.
    locked = F.contains(content, F.lit(b"/Encrypt"))
    return F.when(length == 0, "EMPTY").when(length > most_bytes, "TOO_LARGE").when(head != MAGIC, "NOT_A_STATEMENT").when(locked, "LOCKED").otherwise("OK")


def checked(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, status) of every file."""
    return files.select("path", "length", file_status(F.col("length"), F.col("content"), most_bytes).alias("status"))


def expired(files: DataFrame, now: Column, minutes: int = TEMP_MINUTES) -> DataFrame:
    """Temporary files older than they may be."""
    return files.where(F.col("modificationTime") < now - F.make_dt_interval(mins=F.lit(minutes)))


def storage_totals(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Files and bytes per folder."""
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))

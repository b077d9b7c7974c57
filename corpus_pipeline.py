"""The corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of ``documents``. Since a stage's result is written
before the next one is called, the next call removes the tables that the stage
wrote on its way.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import near_dedup, packing, pii, quality_rules, suffix_dedup
from daybook.llm.common import run_folder, table
from daybook.llm.queries import tokenizer
from daybook.storage import remove_paths, written_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class _Last(threading.local):
    """Tables on the way of this thread's last stage."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_OF_LAST = _Last()


def tidy(stage: Stage) -> Stage:
    """The stage, with the tables on the way of the stage before removed first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_paths(spark, _OF_LAST.paths)
        before = len(written_paths())
        out = stage(spark, docs, sf_dir)
        _OF_LAST.paths = written_paths()[before:]
        return out

    return run_stage


#: Least length of a repeated passage. Passages of over 50 words have some 300 bytes (99 of 100 have 293 or more), so this lies just below.
PASSAGE = 280


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return quality_rules.filter_documents(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, one row stays: that of the smallest id, the first of equal ids."""
    return near_dedup.drop_near_duplicates(docs, near_dedup.MinHash(words=5, percent=80))


@tidy
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that occur elsewhere are cut out."""
    return suffix_dedup.remove_repeats(docs, suffix_dedup.Repeats(span=PASSAGE))


@tidy
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens. Its tables stay, as its result is read from them."""
    remove_paths(spark, _OF_LAST.paths)
    _OF_LAST.paths = []
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("pack", pack),
]

#: SQL can't express the sketches, the links and the packing; tests hold the operators, not run() as a whole, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again, and removed when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/stages-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{name}")
        docs = spark.read.parquet(path)
        if before:
            remove_paths(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

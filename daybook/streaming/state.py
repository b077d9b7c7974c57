"""What the stateful streams share: the state store, and rows of a key in their order."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from daybook.storage import run_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[Row], by: list[str]) -> list[Row]:
    """A key's rows of one batch, sorted; nulls last."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c] or 0) for c in by])


def run_to_table(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str) -> None:
    """Run a stream over what has arrived and append its rows to ``target``; state is kept in RocksDB, below the checkpoint."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def folders(spark: SparkSession, label: str) -> Callable[[str], str]:
    """Places of one run below the shared folder."""
    base = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    return lambda name: f"{base}/{name}"

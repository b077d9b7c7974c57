"""Pages that arrive as files, taken up once each: a file stream that runs until all files that are there are done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_pages(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str, allowed: DataFrame | None = None, files_per_batch: int = 1000) -> None:
    """Append the rows of new files below ``source`` to the table at ``target``.

    The checkpoint remembers which files were read, so a run after new pages came
    reads only those, and a run that is repeated or was cut off adds nothing
    twice (the file sink commits whole batches). ``allowed`` (doc_id, pages):
    rows beyond a document's pages are left out.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if allowed is not None:
        rows = rows.join(allowed, "doc_id", "left").where(F.coalesce(F.col("page_number") <= F.col("pages"), F.lit(True))).drop("pages")
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

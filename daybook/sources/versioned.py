"""Stored tables with versions: upserts that several writers may make at once, readers that never see half a write.

Rows lie in buckets by a hash of their key. A write makes new folders for the
buckets that it touches and leaves all others as they are; a version is a small
JSON file that names each bucket's folder. It is written under a name of its own
and then given its number, which fails if the number is taken. A writer that
comes second reads the newer version: if that changed none of its buckets, its
folders are still right and only the version file is written anew, else the
touched buckets are merged again. So

- a reader keeps the version that it began with, whatever is written meanwhile;
- a writer that dies leaves folders that no version names, which ``vacuum`` removes;
- a write with ``txn`` (a writer's name and a growing number) counts once, however
  often it is repeated, so a stream's batches may be replayed.

The driver handles names only: the buckets of a write are found by Spark and
there are as many as the table was made with.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from daybook.storage import remove_paths, written

#: What becomes of a column when a key is already there. New keys take the new values.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "replace": lambda old, new: new,
    "keep": lambda old, new: old,
    "add": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "fill": lambda old, new: F.coalesce(new, old),
    "most": lambda old, new: F.greatest(old, new),
}
_DIGITS = 20
_BUCKET = "stored_bucket"


class Conflict(RuntimeError):
    """Other writers came first too often."""


class Stopped(RuntimeError):
    """For tests: a writer that dies between its data and its version."""


@dataclass
class Version:
    number: int
    buckets: dict[str, str] = field(default_factory=dict)
    txns: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    """A table at ``path`` with unique ``keys``."""

    def __init__(self, spark: SparkSession, path: str, attempts: int = 20) -> None:
        self.spark, self.path, self.attempts = spark, path.rstrip("/"), attempts
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm
        self._about: dict | None = None

    # Small files ---------------------------------------------------------

    def _write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.path}/{name}"), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, part: str, name: str) -> bool:
        """Give a written file its name, unless that is taken. One of several writers wins."""
        source, target = self._path(f"{self.path}/{part}"), self._path(f"{self.path}/{name}")
        if self._fs.getScheme() == "file":  # a local rename would overwrite; a link does not
            try:
                os.link(source.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                won = False
            else:
                won = True
            self._fs.delete(source, False)
            return won
        if not self._fs.exists(target) and self._fs.rename(source, target):
            return True
        self._fs.delete(source, False)
        return False

    # Versions ------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: tuple[str, ...], buckets: int = 64) -> VersionedTable:
        """A new empty table, or the one that is there if it was made alike."""
        made = cls(spark, path)
        schema = spark.createDataFrame([], schema).schema
        about = {"schema": schema.json(), "keys": list(keys), "buckets": buckets}
        made._fs.mkdirs(made._path(f"{made.path}/versions"))
        made._write_text(part := f"versions/.{uuid.uuid4().hex}", json.dumps(about))
        if not made._publish(part, "about.json") and made.about() != about:
            raise ValueError(f"another table is at {path}")
        made._write_text(part := f"versions/.{uuid.uuid4().hex}", json.dumps({"buckets": {}, "txns": {}}))
        made._publish(part, made._name(0))
        return made

    def about(self) -> dict:
        if self._about is None:
            self._about = json.loads(self._read_text("about.json"))
        return self._about

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.about()["schema"]))

    @staticmethod
    def _name(number: int) -> str:
        return f"versions/{number:0{_DIGITS}d}.json"

    def numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/versions"))]
        return sorted(int(n[:_DIGITS]) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        number = self.numbers()[-1] if number is None else number
        told = json.loads(self._read_text(self._name(number)))
        return Version(number, told["buckets"], told["txns"])

    def _commit(self, version: Version) -> bool:
        self._write_text(part := f"versions/.{uuid.uuid4().hex}", json.dumps({"buckets": version.buckets, "txns": version.txns}))
        return self._publish(part, self._name(version.number))

    # Rows ----------------------------------------------------------------

    def _of(self, version: Version, buckets: list[str] | None = None) -> DataFrame:
        named = [f"{self.path}/{version.buckets[b]}" for b in sorted(version.buckets if buckets is None else buckets) if b in version.buckets]
        if not named:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*named)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given."""
        return self._of(self.version(version))

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.about()["keys"]), F.lit(self.about()["buckets"]))

    def upsert(self, changes: DataFrame, rules: Mapping[str, str] | None = None, txn: tuple[str, int] | None = None, stop_before_commit: bool = False) -> int:
        """Merge ``changes`` (one row a key, all columns) and return the version that holds them.

        ``rules`` tells per column what becomes of a stored value (``RULES``); others are replaced.
        """
        keys = self.about()["keys"]
        if txn and self.version().txns.get(txn[0], -1) >= txn[1]:
            return self.version().number
        changes = written(self._typed(changes), "changes")  # the same rows in every attempt
        try:
            return self._upsert(changes, keys, dict(rules or {}), txn, stop_before_commit)
        finally:
            remove_paths(self.spark, [x.rpartition("/")[0] for x in changes.inputFiles()[:1]])

    def _upsert(self, changes: DataFrame, keys: list[str], rules: dict[str, str], txn: tuple[str, int] | None, stop_before_commit: bool) -> int:
        again = changes.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"a key occurs twice in the changes: {again[0].asDict()}")
        touched = sorted(str(r[0]) for r in changes.select(self.bucket()).distinct().collect())
        folders: dict[str, str] = {}
        base: Version | None = None
        for attempt in range(self.attempts):
            now = self.version()
            if txn and now.txns.get(txn[0], -1) >= txn[1]:
                return now.number
            stale = [b for b in touched if base is None or now.buckets.get(b) != base.buckets.get(b)]
            if stale:
                folders |= self._merged(now, changes, stale, keys, rules)
            base = now
            if stop_before_commit:
                raise Stopped
            after = Version(now.number + 1, now.buckets | folders, now.txns | ({txn[0]: txn[1]} if txn else {}))
            if self._commit(after):
                return after.number
            time.sleep(min(0.05 * 2**attempt, 2.0))
        raise Conflict(f"{self.attempts} other writes came first")

    def _typed(self, changes: DataFrame) -> DataFrame:
        missing = [c for c in self.schema.names if c not in changes.columns]
        if missing:
            raise ValueError(f"the changes lack {missing}")
        return changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def _merged(self, now: Version, changes: DataFrame, buckets: list[str], keys: list[str], rules: dict[str, str]) -> dict[str, str]:
        """Write the given buckets with the changes in them, and return their folders."""
        folder = f"data/{uuid.uuid4().hex}"
        old = self._of(now, buckets).withColumn("_stored", F.lit(True)).alias("old")
        new = changes.where(self.bucket().isin(*map(int, buckets))).withColumn("_fresh", F.lit(True)).alias("new")
        same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
        both = old.join(new, same, "full_outer")
        stored, fresh = F.col("_stored").isNotNull(), F.col("_fresh").isNotNull()

        def value(c: str) -> Column:
            before, after = F.col(f"old.{c}"), F.col(f"new.{c}")
            merged = RULES[rules.get(c, "replace")](before, after)
            return F.when(~stored, after).when(~fresh, before).otherwise(merged)

        key = lambda k: F.when(stored, F.col(f"old.{k}")).otherwise(F.col(f"new.{k}"))
        rows = both.select(*[(key(f.name) if f.name in keys else value(f.name)).cast(f.dataType).alias(f.name) for f in self.schema])
        dealt = rows.withColumn(_BUCKET, self.bucket()).hint("rebalance", _BUCKET)  # Spark splits a bucket that is large and joins small ones
        dealt.write.partitionBy(_BUCKET).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return {b: f"{folder}/{_BUCKET}={b}" for b in buckets}

    def vacuum(self, keep: int = 10, older_than_s: float = 24 * 3600) -> list[str]:
        """Remove all but the last ``keep`` versions, and folders that no version left names and no running writer can still name. Returns the folders."""
        kept = self.numbers()[-keep:]
        for number in self.numbers():
            if number not in kept:
                self._fs.delete(self._path(f"{self.path}/{self._name(number)}"), False)
        used = {x.split("/")[1] for n in kept for x in self.version(n).buckets.values()}
        gone = []
        data = self._path(f"{self.path}/data")
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = status.getPath().getName()
            if name not in used and status.getModificationTime() / 1000 <= time.time() - older_than_s:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone

"""Tables that a plan writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local master, whose tasks run on the driver's machine, may leave it
    unset: then a fresh temporary folder is chosen and set. On a cluster that
    would spread a table over the machines' own disks, so there it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-daybook-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The place of this application's tables below the shared folder."""
    return f"{shared_folder(spark)}/daybook-{spark.sparkContext.applicationId}"


class _Written(threading.local):
    """The tables that this thread has written on its way: what runs in other threads is none of its business."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_HERE = _Written()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back: what follows several times does not run again, and lost executors cost no earlier work."""
    path = f"{run_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _HERE.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table of more rows than this is joined by sorting, however few bytes its file has.
BROADCAST_ROWS = 20_000


def written_sized(df: DataFrame, label: str) -> DataFrame:
    """``written``, and never broadcast if it has many rows.

    Spark takes a table's size from its compressed file, and texts that repeat
    shrink there a hundredfold: a file of a few MB may fill the driver's memory
    when it is broadcast. The mark also holds for what is selected, filtered or
    grouped from the table; ``F.broadcast`` on such a part overrides it.
    """
    back = written(df, label)
    return back.hint("merge") if back.count() > BROADCAST_ROWS else back


def save_files(files: DataFrame, folder: str) -> None:
    """Each row (name, content) as a file below ``folder``, any place that pyarrow can write. A file gets its name when it is whole, so a task may run twice."""

    def put(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for row in rows:
            with store.open_output_stream(part := f"{base}/.{row['name']}-{uuid.uuid4().hex}", compression=None) as out:
                out.write(row["content"])
            store.move(part, f"{base}/{row['name']}")

    files.select("name", "content").foreachPartition(put)


class Archives:
    """Many small files put into zip archives of some ``most_bytes`` each, below ``base`` of a pyarrow store. ``paths``: the archives so far."""

    def __init__(self, store, base: str, most_bytes: int) -> None:
        self.store, self.base, self.most_bytes = store, base, most_bytes
        self.paths: list[str] = []
        self.book = self.stream = None

    def add(self, name: str, content: bytes) -> None:
        if self.book is None:
            self.paths.append(f"{self.base}/.{uuid.uuid4().hex}.zip")
            self.stream = self.store.open_output_stream(self.paths[-1], compression=None)
            self.book, self.held = zipfile.ZipFile(self.stream, "w"), 0
        self.book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content)
        self.held += len(content)
        if self.held >= self.most_bytes:
            self.close()

    def close(self) -> None:
        if self.book is not None:
            self.book.close()
            self.stream.close()
            self.book = None


def archived(members: zipfile.ZipFile) -> Iterator[zipfile.ZipInfo]:
    """The files of an archive, in its order."""
    return (x for x in members.infolist() if not x.is_dir())


def save_archives(files: DataFrame, folder: str, content: Callable, most_bytes: int = 16 << 20) -> None:
    """A file (``name``, and ``content`` of the row) for each row, in archives below ``folder``.

    A driver can't list millions of small files. An archive is seen (has no point
    before its name) when the whole job is done, and then only if the attempt of
    its task counts, so no file is there twice. The driver gets the archives' names.
    """

    def put(rows) -> Iterator[str]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        out = Archives(store, base, most_bytes)
        for row in rows:
            out.add(row["name"], content(row))
        out.close()
        yield from out.paths

    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    for path in files.rdd.mapPartitions(put).collect():
        store.move(path, f"{base}/{path.rpartition('/.')[2]}")


def written_paths() -> list[str]:
    """All tables that this thread has written on its way so far, in order."""
    return list(_HERE.paths)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that were written on the way. No DataFrame built on them may be in use any more."""
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _HERE.paths:
            _HERE.paths.remove(path)


def remove_written(spark: SparkSession) -> None:
    """Delete all tables that this thread wrote on its way. No DataFrame built on them may be in use any more."""
    remove_paths(spark, written_paths())

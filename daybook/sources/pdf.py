"""Statement files as a Spark source: ``spark.read.format("statement_pages").option("path", ...).load()``.

One row a page: its number, lines and status. Files are dealt to tasks by size:
small files are put together, a large one is split into ranges of pages, which
each task cuts from the page count that it finds in the file, so the driver lists
names and sizes and opens no file. A zip archive of files is one file to list,
and is split by its members. Filters on ``page_number`` and ``path`` are
pushed down: pages beyond them are not read. A file that can't be read is one
row with a status and no page, not an error.

Options: ``path`` (a file, a folder or several, comma-separated, in any store
that pyarrow can open), ``task_bytes`` (16 MiB), ``most_bytes`` (25 MiB),
``most_pages`` (2500), ``header_pages`` (read only so many first pages).
"""

from __future__ import annotations

import math
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from daybook.sources.pdf_objects import Broken, Document, Locked
from daybook.storage import archived

SCHEMA = "path string, page_number int, n_pages int, lines array<string>, n_chars int, status string"
NO_END = 1 << 31


@dataclass(frozen=True)
class Wanted:
    """A range of pages, paths (none: all), and whether rows about whole files are left out."""

    first: int = 1
    last: int = NO_END
    paths: frozenset[str] | None = None
    pages_only: bool = False

    def narrowed(self, f: Filter) -> Wanted | None:
        """With one more filter; none if Spark has to evaluate it."""
        column = getattr(f, "attribute", None)
        if isinstance(f, IsNotNull) and column in (("page_number",), ("path",)):
            return replace(self, pages_only=self.pages_only or column == ("page_number",))
        bounds = {
            EqualTo: lambda v: (v, v), GreaterThan: lambda v: (v + 1, NO_END), GreaterThanOrEqual: lambda v: (v, NO_END), LessThan: lambda v: (1, v - 1), LessThanOrEqual: lambda v: (1, v),
        }.get(type(f))
        if column == ("page_number",) and bounds:
            low, high = bounds(f.value)
            return replace(self, first=max(self.first, low), last=min(self.last, high), pages_only=True)
        if column == ("path",) and isinstance(f, (EqualTo, In)):
            told = frozenset(f.value if isinstance(f, In) else [f.value])
            return replace(self, paths=told if self.paths is None else self.paths & told)
        return None


@dataclass(frozen=True)
class Share:
    path: str
    part: int
    parts: int


class Task(InputPartition):
    def __init__(self, shares: tuple[Share, ...]) -> None:
        self.shares = shares


def pages_of(data: bytes, share: Share, wanted: Wanted, most_pages: int, header_pages: int = NO_END) -> Iterator[tuple]:
    """The rows of one file's share. What is wrong with a whole file is told by its first share only."""
    path, first_share = share.path, share.part == 0 and not wanted.pages_only
    told = lambda status, n=None: (path, None, n, [], 0, status)
    try:
        if not data:
            raise Broken
        document = Document(data)
        n = document.n_pages
    except Locked:
        yield from [told("LOCKED")] * first_share
        return
    except (Broken, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError):
        yield from [told("EMPTY" if not data else "BROKEN")] * first_share
        return
    if n == 0 or n > most_pages:
        yield from [told("NO_PAGES" if n == 0 else "TOO_MANY_PAGES", n)] * first_share
        return
    begin, end = n * share.part // share.parts + 1, n * (share.part + 1) // share.parts
    low, high = max(begin, wanted.first), min(end, wanted.last, header_pages)
    if low > high:
        return
    try:
        for number, page in document.pages(low, high):
            try:
                lines = document.lines(page)
                yield path, number, n, lines, sum(map(len, lines)), "OK"
            except (Broken, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError):
                yield path, number, n, [], 0, "BROKEN_PAGE"
    except (Broken, ValueError, IndexError, TypeError, KeyError, AttributeError, RecursionError):
        yield from [told("BROKEN", n)] * first_share


class PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda key, usual: int(options.get(key, usual))
        self.places = [p for p in options["path"].split(",") if p]
        self.task_bytes, self.most_bytes, self.most_pages = number("task_bytes", 16 << 20), number("most_bytes", 25 << 20), number("most_pages", 2500)
        self.header_pages, self.wanted = number("header_pages", NO_END), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            narrowed = self.wanted.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed

    def _files(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        for place in self.places:
            store, base = fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)
            prefix = place[: len(place) - len(base)] if place.endswith(base) else ""
            about = store.get_file_info(base)
            found = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
            for x in sorted(found, key=lambda x: x.path):
                if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")):
                    yield prefix + x.path, x.size

    def partitions(self) -> list[Task]:
        tasks, held, size = [], [], 0
        for path, n in self._files():
            archive = path.endswith(".zip")
            if self.wanted.paths is not None and path not in self.wanted.paths and not (archive and any(p.startswith(f"{path}/") for p in self.wanted.paths)):
                continue
            parts = 1 if not archive and (self.header_pages < NO_END or n > self.most_bytes) else max(1, math.ceil(n / self.task_bytes))
            if parts > 1:
                tasks += [Task((Share(path, k, parts),)) for k in range(parts)]
                continue
            if held and size + n > self.task_bytes:
                tasks.append(Task(tuple(held)))
                held, size = [], 0
            held.append(Share(path, 0, 1))
            size += max(n, 1 << 14)  # opening a file costs as much as some of its bytes
        return [*tasks, *([Task(tuple(held))] if held else [])] or [Task(())]

    def read(self, partition: Task) -> Iterator[tuple]:
        from pyarrow import fs

        for share in partition.shares:
            store, base = fs.FileSystem.from_uri(share.path) if "://" in share.path or share.path.startswith("file:") else (fs.LocalFileSystem(), share.path)
            if share.path.endswith(".zip"):
                yield from self._members(store, base, share)
                continue
            if store.get_file_info(base).size > self.most_bytes:
                if not self.wanted.pages_only:
                    yield share.path, None, None, [], 0, "TOO_LARGE"
                continue
            with store.open_input_stream(base, compression=None) as stream:
                data = stream.read()
            yield from pages_of(data, share, self.wanted, self.most_pages, self.header_pages)


    def _members(self, store, base: str, share: Share) -> Iterator[tuple]:
        """The rows of an archive's share of files, whose paths go on from the archive's."""
        with store.open_input_file(base) as stream:
            try:
                book = zipfile.ZipFile(stream)
                held = list(archived(book))
            except (zipfile.BadZipFile, ValueError):  # pyarrow tells a file too short to seek in as a wrong value
                if share.part == 0 and not self.wanted.pages_only:
                    yield share.path, None, None, [], 0, "BROKEN"
                return
            for x in held[len(held) * share.part // share.parts : len(held) * (share.part + 1) // share.parts]:
                path = f"{share.path}/{x.filename}"
                if self.wanted.paths is not None and path not in self.wanted.paths:
                    continue
                try:
                    data = None if x.file_size > self.most_bytes else book.read(x)
                except (zipfile.BadZipFile, zlib.error, EOFError):
                    data = b"?"  # told as broken
                if data is not None:
                    yield from pages_of(data, Share(path, 0, 1), self.wanted, self.most_pages, self.header_pages)
                elif not self.wanted.pages_only:
                    yield path, None, None, [], 0, "TOO_LARGE"


class StatementPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "statement_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, with filters pushed down."""
    spark.dataSource.register(StatementPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _escaped(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def document_of(pages: list[list[str]], fan: int = 8) -> bytes:
    """A plain file of the given pages' lines, in a balanced page tree: the form in which statements are handed on and tested."""
    objects: list[bytes] = [b"", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"]

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    level = []
    for lines in pages:
        content = zlib.compress(b"BT /F1 9 Tf 11 TL 40 800 Td\n" + b"\n".join(_escaped(x) + b" Tj T*" for x in lines) + b"\nET")
        stream = add(b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(content), content))
        level.append((add(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % stream), 1))
    while len(level) > fan:
        level = [(add(b"<</Type/Pages/Parent 2 0 R/Count %d/Kids[%s]>>" % (sum(n for _, n in run), b" ".join(b"%d 0 R" % k for k, _ in run))), sum(n for _, n in run)) for run in (level[i : i + fan] for i in range(0, len(level), fan))]
    objects[0] = b"<</Type/Catalog/Pages 2 0 R>>"
    objects[1] = b"<</Type/Pages/Count %d/Kids[%s]>>" % (sum(n for _, n in level), b" ".join(b"%d 0 R" % k for k, _ in level))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))

"""WARC archives: a writer that replaces equal payloads by revisits, and a reader that salvages.

Writer: of pages with equal payloads of ``Warc.least`` bytes or more, the one
with the smallest page id is a response, the others are revisits that name it;
their HTTP headers keep the length of the payload and their WARC headers its
digest. Each record is a gzip member of its own. Archives are rows of at most
about ``Warc.archive_bytes`` (a longer record makes a longer one), so neither
writer nor reader holds more than one of them; ``save`` writes them as files.

Reader: record by record, gzipped or plain. A record counts if its checks hold:
the member's CRC, version line, headers, length, closing line and the digests
of block and payload. Where one fails, the reader looks for the next place at
which a valid record begins (a gzip member or a version line), goes on there, and logs the bytes between as a gap with the reason.
A plain record that stands whole inside the payload of a damaged one can't be
told from a later record and is read.

Defined results: a null html is the empty payload; a null page id or url leaves
its header out and is null when read. Null ids come after all others when the
smallest id is sought; of rows with the same id and payload one is the response.
An empty table gives no archives and no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import join_by_key, whole_text, written
from daybook.storage import save_files

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
LINES = b"\r\n\r\n"
#: Headers longer than this are damage: real ones have some hundred bytes.
MOST_HEADERS = 1 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Warc:
    """``least``: bytes from which equal payloads are stored once; ``archive_bytes``: when an archive is closed; ``date``: of all records; ``level``: of compression."""

    least: int = 100
    archive_bytes: int = 8 << 20
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


class Damaged(ValueError):
    """A check that failed."""


# Records -------------------------------------------------------------------


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One plain record: version, headers, length, digest of the block, block, closing lines."""
    told = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in told).encode() + b"\r\n" + block + LINES


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member, the same bytes whenever it is made."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None, date: str) -> bytes:
    """A page as a response, or without its payload as a revisit."""
    revisit = payload is None
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", REVISIT)] + ([("WARC-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else [])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record(headers, http + (payload or b""))


def parsed(raw: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the plain record at a place; raises Damaged."""
    head = bytes(raw[at : at + MOST_HEADERS])
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damaged("no version line")
    closed = head.find(LINES)
    if closed < 0:
        raise Damaged("headers do not end")
    if re.search(rb"WARC/1\.[01]\r\n", head[8:closed]):
        raise Damaged("another version line among the headers")  # the rest was cut off, and a later record begins here
    headers = {}
    for line in head[:closed].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", length):
        raise Damaged("no length")
    begin = at + closed + len(LINES)
    end = begin + int(length)
    if bytes(raw[end : end + len(LINES)]) != LINES:
        raise Damaged("the block does not end where its length says")
    block = bytes(raw[begin:end])
    told = headers.get("warc-block-digest", "")
    if told.startswith("sha256:") and hashlib.sha256(block).hexdigest() != told[7:].lower():
        raise Damaged("digest of the block")
    return headers, block, end + len(LINES)


def inflated(data: memoryview, at: int) -> tuple[bytes, int]:
    """The member at a place and its end; pieces grow, so a short member costs little. Raises Damaged."""
    squeezed, out, place, step = zlib.decompressobj(31), [], at, 4096
    try:
        while not squeezed.eof:
            piece = data[place : place + step]
            if not len(piece):
                raise Damaged("the member is cut off")
            out.append(squeezed.decompress(piece))
            if place == at and out[0] and not out[0].startswith(VERSION[: len(out[0])]):
                raise Damaged("no version line")
            place, step = place + len(piece), min(step * 2, 1 << 20)
    except zlib.error as e:
        raise Damaged("gzip: " + str(e).rpartition(": ")[2]) from None
    return b"".join(out), place - len(squeezed.unused_data)


def record_at(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at a place, gzipped or plain; raises Damaged."""
    if data[at : at + 3] == GZIP:
        raw, end = inflated(data, at)
        headers, block, closed = parsed(raw)
        if closed != len(raw):
            raise Damaged("the member holds more than its record")
        return headers, block, end
    return parsed(data, at)


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, str, int]:
    """Payload (None for a revisit), its digest and length; raises Damaged."""
    told = headers.get("warc-payload-digest", "").removeprefix("sha256:").lower()
    http, gap, payload = block.partition(LINES) if headers.get("content-type", "").startswith("application/http") else (b"", LINES, block)
    if not gap:
        raise Damaged("no HTTP headers")
    if headers.get("warc-type") == "revisit":
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)\r?$", http)
        return None, told, int(length[1]) if length else 0
    digest = hashlib.sha256(payload).hexdigest()
    if told and told != digest:
        raise Damaged("digest of the payload")
    return payload, digest, len(payload)


# A version line may follow the middle of a line that was cut off.
_NEXT = re.compile(re.escape(GZIP) + rb"|WARC/1\.[01]\r\n")


def salvaged(content: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, tuple | str]]:
    """(begin, end, headers, payload with digest and length) of every valid record, and (begin, end, None, reason) of every gap."""
    data, at, lost, why = memoryview(content), 0, None, ""
    while at < len(content):
        try:
            headers, block, end = record_at(data, at)
            payload = payload_of(headers, block)
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            found = _NEXT.search(content, at + 1)
            at = found.start() if found else len(content)
            continue
        if lost is not None:
            yield lost, at, None, why
            lost = None
        yield at, end, headers, payload
        at = end
    if lost is not None:
        yield lost, len(content), None, why


# Tables --------------------------------------------------------------------


def with_revisits(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """(page_id, url, payload: null for a revisit, digest, n_bytes, refers_to) of every page."""
    html = whole_text("html")
    own = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    rows = written(own.withColumn("tie", F.monotonically_increasing_id()), "payloads")
    order = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "tie")
    groups = rows.where(F.col("n_bytes") >= p.least).groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("first")).where("size > 1")
    told = join_by_key(rows, written(groups, "groups"), "digest", "size", rows.count(), "left")
    revisit = F.coalesce(F.col("first.tie") != F.col("tie"), F.lit(False))
    return told.select(
        "page_id", "url", F.when(~revisit, F.encode("html", "UTF-8")).alias("payload"), "digest", "n_bytes", F.when(revisit, F.col("first.page_id")).alias("refers_to")
    )


def archives(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """(archive, content) with a record for every page, as a written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        info = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", p.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), p.level)
        parts = [info]
        size = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{task:06d}-{made:06d}.warc.gz"], "content": [b"".join(parts)]}, schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to")]
            for i in range(batch.num_rows):
                parts.append(member(page_record(*[c[i].as_py() for c in columns], p.date), p.level))
                size += len(parts[-1])
                if size >= p.archive_bytes:
                    yield closed()
                    parts, size, made = [info], 0, made + 1
        if size:
            yield closed()

    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])
    return written(with_revisits(pages, p).mapInArrow(pack, "archive string, content binary"), "archives")


RECORD = "archive string, begin long, end long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, damage string"


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every valid record of (archive, content) rows, and every gap: a row without a record type whose ``damage`` tells the first failed check. ``payloads`` adds the payload as bytes."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")] + [("payload", pa.binary())] * payloads)
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?[0-9]{1,18}", x) else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive"), batch.column("content"), strict=True):
                out, held = [], 0
                for begin, end, headers, told in salvaged(content.as_py() or b""):
                    if headers is None:
                        row = (name.as_py(), begin, end, None, None, None, None, None, None, told)
                    else:
                        payload, digest, length = told
                        row = (name.as_py(), begin, end, headers.get("warc-type"), number(headers.get("warc-page-id")), headers.get("warc-target-uri"), length, digest, number(headers.get("warc-refers-to-page-id")), None)
                    body = told[0] if payloads and headers is not None else None
                    out.append((*row, body) if payloads else row)
                    held += len(body or b"")
                    if len(out) == 4096 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive", "content").mapInArrow(rows, RECORD + (", payload binary" if payloads else ""))


def records(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The valid records of pages."""
    return read(archives, payloads).where(F.col("record_type").isin("response", "revisit")).drop("damage")


def quarantined(archives: DataFrame) -> DataFrame:
    """(archive, begin, end, damage): the bytes that belong to no valid record."""
    return read(archives).where(F.col("record_type").isNull() & F.col("damage").isNotNull()).select("archive", "begin", "end", "damage")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives of any origin, a file a row (up to 2 GB each, by Spark's reader of binary files)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def save(archives: DataFrame, folder: str) -> None:
    """Each archive as a file of its name below ``folder``, any place that pyarrow can write."""
    save_files(archives.select(F.col("archive").alias("name"), "content"), folder)


def page_records(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """All pages written as archives and read back: id, length and digest of the full payload, type, and the page that a revisit refers to."""
    return records(archives(pages, p)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "archive", "begin", "end")

"""Sheets as workbook files: ``df.write.format("voucher_workbook").mode("append").save(folder)`` and a reader.

The first column names the file, the others are the sheet's, in order; a file's
rows lie together and in order in one task (``in_workbooks`` deals them so, in
files of at most ``sheet_rows`` rows, so no file outgrows a sheet or a task).
Tasks write whole files into a folder of the write's own; they get their names
when all tasks are done, and the folder is dropped if one fails for good, so a
reader never finds part of a file. A task holds one sheet's rows, deflated.
With ``.option("archive_bytes", n)`` the files are put into zip archives of some
``n`` bytes, as no driver can name or list millions of small files.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import io
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from daybook.storage import Archives, archived

#: Rows below the header that a sheet can hold.
SHEET_ROWS = 1_048_575
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_TYPES = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_DAY_ZERO = datetime.date(1899, 12, 30)
_LETTERS = tuple(chr(65 + k) for k in range(26))
_NO_TEXT = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
#: Styles by number: plain, header, date, amount, text.
PLAIN, HEADER, DATE, AMOUNT, TEXT = range(5)
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts count="2"><numFmt numFmtId="164" formatCode="DD\\-mmm\\-YY"/><numFmt numFmtId="165" formatCode="#,##0.00"/></numFmts>'
    '<fonts count="2"><font><sz val="10"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5">'
    '<xf fontId="0"/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/><xf numFmtId="49" applyNumberFormat="1"/></cellXfs></styleSheet>'
)
_FIXED = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_TYPES}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_TYPES}"><sheets><sheet name="Vouchers" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_TYPES}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_TYPES}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": _STYLES,
}


def letters(k: int) -> str:
    """The name of the k-th column, from 0."""
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


@dataclass
class Sheet:
    """One file's rows as they come, deflated; widths follow the longest value."""

    columns: list[str]
    n: int = 1
    parts: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.squeeze = zlib.compressobj(1)
        self.widths = [len(c) for c in self.columns]
        self._row(self.columns, HEADER)

    def _row(self, values, style: int | None = None) -> None:
        cells = []
        for k, v in enumerate(values):
            if v is None:
                continue
            at = f"{_LETTERS[k] if k < 26 else letters(k)}{self.n}"
            if isinstance(v, datetime.date):
                cell, shown = f'<c r="{at}" s="{DATE}"><v>{(v - _DAY_ZERO).days}</v></c>', 9
            elif isinstance(v, (decimal.Decimal, float)):
                cell, shown = f'<c r="{at}" s="{AMOUNT}"><v>{v}</v></c>', len(f"{v:,.2f}")
            elif isinstance(v, int) and not isinstance(v, bool):
                cell, shown = f'<c r="{at}" s="{PLAIN}"><v>{v}</v></c>', len(str(v))
            else:
                cell, shown = f'<c r="{at}" s="{TEXT if style is None else style}" t="inlineStr"><is><t xml:space="preserve">{escape(_NO_TEXT.sub("", str(v)))}</t></is></c>', len(str(v))
            cells.append(cell)
            self.widths[k] = max(self.widths[k], shown)
        self.parts.append(self.squeeze.compress(f'<row r="{self.n}">{"".join(cells)}</row>'.encode()))

    def add(self, values) -> None:
        self.n += 1
        self._row(values)

    def write(self, stream) -> None:
        last = letters(len(self.columns) - 1)
        widths = "".join(f'<col min="{k}" max="{k}" width="{min(max(w + 4, 12), 65)}" customWidth="1"/>' for k, w in enumerate(self.widths, 1))
        self.parts.append(self.squeeze.flush())
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as book:
            entry = lambda name: zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            for name, text in _FIXED.items():
                book.writestr(entry(name), _HEAD + text, zipfile.ZIP_DEFLATED)
            info = entry("xl/worksheets/sheet1.xml")
            info.compress_type = zipfile.ZIP_DEFLATED
            with book.open(info, "w") as out:
                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>'.encode())
                open_up = zlib.decompressobj()
                for part in self.parts:
                    out.write(open_up.decompress(part))
                out.write(f'</sheetData><autoFilter ref="A1:{last}{self.n}"/></worksheet>'.encode())


@dataclass
class Made(WriterCommitMessage):
    """Files with the names that they get; of files in archives eight bytes a name, which tell whether one lies in several tasks."""

    files: list[tuple[str, str]]
    archived: bytes = b""


class BookWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], archive_bytes: int = 0) -> None:
        self.folder, self.columns, self.archive_bytes, self.run = folder, columns, archive_bytes, uuid.uuid4().hex

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        return store, base, f"{base}/_temporary-{self.run}"

    def write(self, iterator: Iterator) -> Made:
        store, _, temporary = self._store()
        store.create_dir(temporary)
        made, name, sheet, seen = [], None, None, set()
        archives = Archives(store, temporary, self.archive_bytes) if self.archive_bytes else None

        def close() -> None:
            seen.add(name)
            if archives:
                sheet.write(out := io.BytesIO())
                archives.add(name, out.getvalue())
                return
            part = f"{temporary}/{uuid.uuid4().hex}"
            with store.open_output_stream(part, compression=None) as out:
                sheet.write(out)
            made.append((part, name))

        for row in iterator:
            if row[0] != name:
                if sheet is not None:
                    close()
                if row[0] in seen:
                    raise ValueError(f"the rows of {row[0]} do not lie together")
                name, sheet = row[0], Sheet(self.columns[1:])
            sheet.add(row[1:])
            if sheet.n > SHEET_ROWS + 1:
                raise ValueError(f"{name} has more rows than a sheet can hold")
        if sheet is not None:
            close()
        if archives:
            archives.close()
            marks = b"".join(hashlib.blake2b(n.encode(), digest_size=8).digest() for n in seen)
            return Made([(path, path.rpartition("/.")[2]) for path in archives.paths], marks)
        return Made(made)

    def commit(self, messages: list[Made | None]) -> None:
        store, base, temporary = self._store()
        files = [f for m in messages if m for f in m.files]
        marks = np.frombuffer(b"".join(m.archived for m in messages if m), "u8")
        if len({n for _, n in files}) < len(files) or len(np.unique(marks)) < len(marks):
            self.abort(messages)
            raise ValueError("the rows of a file lie in several tasks")
        for part, name in files:
            store.move(part, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Made | None]) -> None:
        from pyarrow import fs

        store, _, temporary = self._store()
        if store.get_file_info(temporary).type == fs.FileType.Directory:
            store.delete_dir(temporary)


class VoucherWorkbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voucher_workbook"

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(self.options["path"], schema.names, int(self.options.get("archive_bytes", 0)))


def in_workbooks(sheet: DataFrame, stem: str, group: str, order: str, sheet_rows: int = 1_000_000) -> DataFrame:
    """``sheet`` dealt for the writer: a file for each ``group``, further ones (``-2``, ``-3``) beyond ``sheet_rows``. ``order`` counts from 1 in each group."""
    part = F.floor((F.col(f"`{order}`") - 1) / sheet_rows)
    name = F.concat(F.lit(f"{stem}-"), F.col(group).cast("string"), F.when(part > 0, F.concat(F.lit("-"), (part + 1).cast("string"))).otherwise(""), F.lit(".xlsx"))
    named = sheet.select(name.alias("file"), *[F.col(f"`{c}`") for c in sheet.columns if c != group])
    return named.repartition("file").sortWithinPartitions("file", F.col(f"`{order}`"))


def save_workbooks(spark: SparkSession, dealt: DataFrame, folder: str, archive_bytes: int = 0) -> None:
    spark.dataSource.register(VoucherWorkbook)
    dealt.write.format("voucher_workbook").option("archive_bytes", archive_bytes).mode("append").save(folder)


_ROW, _VALUE, _TEXT = (f"{{{_MAIN}}}{tag}" for tag in ("row", "v", "t"))


def cells_of(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, texts of its cells) of a workbook's first sheet, numbers as they are stored."""
    with zipfile.ZipFile(io.BytesIO(content)) as book, book.open("xl/worksheets/sheet1.xml") as stream:
        for _, row in ElementTree.iterparse(stream):
            if row.tag != _ROW:
                continue
            out: list[str | None] = []
            for c in row:
                at = 0
                for x in c.get("r").rstrip("0123456789"):
                    at = at * 26 + ord(x) - 64
                out += [None] * (at - len(out))
                found = c.find(_VALUE)
                out[at - 1] = found.text if found is not None else "".join(t.text or "" for t in c.iter(_TEXT))
            yield int(row.get("r")), out
            row.clear()


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(file, row, cells) of every workbook in a folder, in archives or by itself."""
    form = pa.schema([("file", pa.string()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])

    def books(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            if not path.endswith(".zip"):
                yield path.rpartition("/")[2], content.as_py()
                continue
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as held:
                for x in archived(held):
                    yield x.filename, held.read(x)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for name, content in books(batch):
                for n, cells in cells_of(content):
                    found.append((name, n, cells))
                    if len(found) == 10_000:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), form.types, strict=True)], form)
                        found = []
            if found:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), form.types, strict=True)], form)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{xlsx,zip}").load(folder).select("path", "content")
    return files.mapInArrow(rows, "file string, row int, cells array<string>")

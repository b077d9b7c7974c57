"""The parts of a PDF file that hold a statement's text: objects found by the cross-reference table, pages by number, lines by position.

Only what a page needs is read: the table of objects, the page tree up to it
(branches before it are passed over by their counts), its fonts and its content,
not the other pages' content. A file whose table is damaged is searched for its objects once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field


class Broken(ValueError):
    """The file can't be read as a document."""


class Locked(ValueError):
    """The file is encrypted."""


class Name(str):
    """A name object, without its slash."""


@dataclass(slots=True)
class Ref:
    number: int


@dataclass
class Stream:
    about: dict
    raw: bytes


_SPACE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|[\[\]{}()<>]|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_MARK = re.compile(rb"[\\()]")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+([nf])(?=[\x00\t\n\x0c\r ])")
_HEADED = re.compile(rb"[\x00\t\n\x0c\r ]*\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_NAMES: dict[bytes, Name] = {}
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_END = object()
_DEEP = 100


class Parser:
    """Objects one after another in a piece of bytes; words that are no object (operators) come as bytes."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True) -> None:
        self.data, self.at, self.refs = data, at, refs

    def next(self, depth: int = 0):
        m = _TOKEN.match(self.data, self.at)
        if not m:
            return _END
        if depth > _DEEP:
            raise Broken("objects lie too deep")
        token, self.at = m[1], m.end()
        c = token[0]
        if c == 0x2F:  # a slash
            if (name := _NAMES.get(token)) is None:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:])
                name = Name(raw.decode("latin-1"))
                if len(_NAMES) < 10_000 and len(token) < 100:
                    _NAMES[token] = name
            return name
        if 0x30 <= c <= 0x39 or c in b"+-.":
            try:
                number = float(token) if b"." in token else int(token)
            except ValueError:
                return token
            if self.refs and isinstance(number, int) and number >= 0 and (r := _REF.match(self.data, self.at)):
                self.at = r.end()
                return Ref(number)
            return number
        if c == 0x28:  # an opening bracket
            return self._text()
        if token == b"<<":
            return self._dict(depth)
        if token == b"[":
            out = []
            while (x := self.next(depth + 1)) != b"]":
                if x is _END:
                    raise Broken("a list does not end")
                out.append(x)
            return out
        if token == b"<":
            end = self.data.find(b">", self.at)
            if end < 0:
                raise Broken("a text does not end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytearray(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        return _WORDS.get(token, token)

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while True:
            key = self.next(depth + 1)
            if key == b">>":
                return out
            if not isinstance(key, Name):
                raise Broken("a key is no name")
            out[key] = self.next(depth + 1)

    def _text(self) -> bytearray:
        out, depth, data = bytearray(), 1, self.data
        while m := _MARK.search(data, self.at):
            out += data[self.at : m.start()]
            self.at, c = m.end(), m[0]
            if c == b"\\":
                c = data[self.at : self.at + 1]
                self.at += 1
                if c in b"01234567" and c:
                    octal = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)[0]
                    self.at += len(octal) - 1
                    out.append(int(octal, 8) & 255)
                elif c == b"\r":
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif c != b"\n":
                    out += _ESCAPES.get(c, c)
                continue
            depth += 1 if c == b"(" else -1
            if not depth:
                return out
            out += c
        raise Broken("a text does not end")


def unfiltered(stream: Stream, resolve) -> bytes:
    """A stream's bytes after its filters."""
    kinds, parms = resolve(stream.about.get("Filter")), resolve(stream.about.get("DecodeParms"))
    kinds, parms = ([x] if not isinstance(x, list) else x for x in (kinds, parms))
    raw = stream.raw
    for i, kind in enumerate(k for k in map(resolve, kinds) if k is not None):
        if kind in ("FlateDecode", "Fl"):
            try:
                raw = (z := zlib.decompressobj()).decompress(raw) + z.flush()
            except zlib.error as e:
                raise Broken("a stream can't be inflated") from e
        elif kind in ("ASCIIHexDecode", "AHx"):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raise Broken(f"filter {kind}")
        about = resolve(parms[i]) if i < len(parms) else None
        if about and resolve(about.get("Predictor", 1)) >= 10:
            raw = unpredicted(raw, resolve(about.get("Columns", 1)) * resolve(about.get("Colors", 1)) * resolve(about.get("BitsPerComponent", 8)) // 8)
    return raw


def unpredicted(raw: bytes, width: int) -> bytes:
    """Rows of a table stored as differences: from the left (1), from above (2), from their mean (3) or the nearest of three (4)."""
    out, above = bytearray(), bytearray(width)
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 1:
                row[i] = (row[i] + left) & 255
            elif kind == 2:
                row[i] = (row[i] + up) & 255
            elif kind == 3:
                row[i] = (row[i] + (left + up) // 2) & 255
            elif kind == 4:
                near = min((left, up, corner), key=lambda x: abs(left + up - corner - x))
                row[i] = (row[i] + near) & 255
        out += row
        above = row
    return bytes(out)


class Document:
    """Lazy access to a file's objects and pages."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.places: dict[int, int | tuple[int, int]] = {}
        self.known: dict[int, object] = {}
        self.trailer: dict = {}
        if not data[:1024].lstrip().startswith(b"%PDF-"):
            raise Broken("no PDF")
        try:
            self._tables()
            self._root()
        except (Broken, ValueError, IndexError, TypeError, AttributeError, RecursionError):
            self._search()
        if "Encrypt" in self.trailer:
            raise Locked
        self._root()

    def _root(self) -> dict:
        pages = self.get(self.get(self.trailer.get("Root"))["Pages"]) if isinstance(self.get(self.trailer.get("Root")), dict) else None
        if not isinstance(pages, dict) or "Kids" not in pages:
            raise Broken("no pages")
        return pages

    def _tables(self) -> None:
        found = self.data.rfind(b"startxref")
        place = Parser(self.data, found + 9).next() if found >= 0 else None
        seen: set[int] = set()
        while isinstance(place, int) and place not in seen:
            seen.add(place)
            if re.compile(rb"\s*xref").match(self.data, place):
                trailer = self._table(place)
                if isinstance(trailer.get("XRefStm"), int):
                    self._table_stream(trailer["XRefStm"])
            else:
                trailer = self._table_stream(place)
            self.trailer = trailer | self.trailer
            place = trailer.get("Prev")
        if not self.places:
            raise Broken("no table of objects")

    def _table(self, place: int) -> dict:
        p = Parser(self.data, place, refs=False)
        p.next()
        while isinstance(first := p.next(), int):
            for k in range(p.next()):
                if m := _ENTRY.match(self.data, p.at):  # an entry as the format has it; others are read as objects
                    p.at, offset, kind = m.end(), int(m[1]), m[2]
                else:
                    offset, _, kind = p.next(), p.next(), p.next()
                if kind == b"n":
                    self.places.setdefault(first + k, offset)
        if first != b"trailer":
            raise Broken("no trailer")
        return Parser(self.data, p.at).next()

    def _table_stream(self, place: int) -> dict:
        stream = self._object_at(place)
        if not isinstance(stream, Stream):
            raise Broken("no table of objects")
        raw, w = unfiltered(stream, self.get), stream.about["W"]
        index = stream.about.get("Index", [0, stream.about["Size"]])
        at = 0
        for first, n in zip(index[::2], index[1::2], strict=True):
            for k in range(n):
                kind, a, b = (int.from_bytes(raw[at + sum(w[:j]) : at + sum(w[: j + 1])], "big") if w[j] else int(j == 0) for j in range(3))
                at += sum(w)
                if kind == 1:
                    self.places.setdefault(first + k, a)
                elif kind == 2:
                    self.places.setdefault(first + k, (a, b))
        return stream.about

    def _search(self) -> None:
        """Objects and trailers by their words, the last of each number, as in a file whose table is damaged."""
        self.places, self.known, self.trailer = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,9})[ \t\r\n]+\d{1,5}[ \t\r\n]+obj\b", self.data):
            self.places[int(m[1])] = m.start()
        for m in re.finditer(rb"\btrailer\b", self.data):
            try:
                told = Parser(self.data, m.end()).next()
            except Broken:
                continue
            self.trailer |= told if isinstance(told, dict) else {}
        for number in list(self.places):
            try:
                x = self.get(Ref(number))
            except Broken:
                continue
            if isinstance(x, Stream) and x.about.get("Type") == "ObjStm":
                for k, inner in enumerate(self._numbers(x)):
                    self.places.setdefault(inner, (number, k))
            if isinstance(x, Stream) and x.about.get("Type") == "XRef":
                self.trailer |= {k: v for k, v in x.about.items() if k in ("Root", "Encrypt")}
            if isinstance(x, dict) and x.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(number))

    def _object_at(self, place: int):
        p = Parser(self.data, place, refs=False)
        if m := _HEADED.match(self.data, place):
            p.at = m.end()
        elif not (isinstance(p.next(), int) and isinstance(p.next(), int) and p.next() == b"obj"):
            raise Broken("no object where the table says")
        p.refs = True
        value = p.next()
        if isinstance(value, dict) and (m := re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)").match(self.data, p.at)):
            length = self.get(value.get("Length"))
            end = m.end() + length if isinstance(length, int) else -1
            if end < 0 or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, end):
                end = self.data.find(b"endstream", m.end())
                if end < 0:
                    raise Broken("a stream does not end")
            return Stream(value, self.data[m.end() : end])
        return value

    def _numbers(self, holder: Stream) -> list[int]:
        p = Parser(unfiltered(holder, self.get), refs=False)
        return [(p.next(), p.next())[0] for _ in range(self.get(holder.about["N"]))]

    def get(self, x):
        """What a reference stands for; other values as they are."""
        for _ in range(_DEEP):
            if not isinstance(x, Ref):
                return x
            if x.number not in self.known:
                place = self.places.get(x.number)
                self.known[x.number] = None  # a stream whose length refers to itself
                if isinstance(place, tuple):
                    holder = self.get(Ref(place[0]))
                    if not isinstance(holder, Stream):
                        raise Broken("no holder of objects")
                    raw = unfiltered(holder, self.get)
                    p = Parser(raw, refs=False)
                    offsets = [(p.next(), p.next())[1] for _ in range(self.get(holder.about["N"]))]
                    self.known[x.number] = Parser(raw, self.get(holder.about["First"]) + offsets[place[1]]).next()
                elif place is not None:
                    self.known[x.number] = self._object_at(place)
            x = self.known[x.number]
        raise Broken("references in a ring")

    @property
    def n_pages(self) -> int:
        n = self.get(self._root().get("Count"))
        return n if isinstance(n, int) and n >= 0 else sum(1 for _ in self.pages(1, 1 << 31))

    def pages(self, first: int, last: int) -> Iterator[tuple[int, dict]]:
        """(number, page) of a range of pages; branches beyond it are passed over unread."""
        stack, number = [(self._root(), {}, 0)], 0
        while stack and number < last:
            node, above, depth = stack.pop()
            node = self.get(node)
            if depth > _DEEP:
                raise Broken("pages in a ring")
            if not isinstance(node, dict):
                continue
            own = above | {k: node[k] for k in ("Resources",) if k in node}
            count = self.get(node.get("Count"))
            if "Kids" not in node:
                number += 1
                if number >= first:
                    yield number, own | node
            elif isinstance(count, int) and count > 0 and number + count < first:
                number += count
            else:
                stack += [(k, own, depth + 1) for k in reversed(self.get(node["Kids"]) or [])]

    # Text ------------------------------------------------------------------

    def lines(self, page: dict) -> list[str]:
        """The page's lines from top to bottom, without those that hold white space only."""
        contents = self.get(page.get("Contents"))
        parts = [self.get(x) for x in (contents if isinstance(contents, list) else [contents])]
        raw = b"\n".join(unfiltered(x, self.get) for x in parts if isinstance(x, Stream))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        return laid_out(pieces(raw, {k: Font(self, self.get(v)) for k, v in fonts.items()}))


# Glyph names of the marks that statements print; letters and figures are named by rule.
MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "period": ".", "slash": "/", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "bar": "|",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}


def glyph(name: str) -> str:
    if len(name) == 1:
        return name
    if re.fullmatch(r"uni[0-9A-F]{4}", name):
        return chr(int(name[3:], 16))
    return MARKS.get(name, "")


class Font:
    """Codes to text and widths, in thousandths of the font's size."""

    def __init__(self, document: Document, about: dict | None) -> None:
        about = about or {}
        get = document.get
        self.wide = about.get("Subtype") == "Type0"
        self.mapped: dict[int, str] = {}
        told = get(about.get("ToUnicode"))
        if isinstance(told, Stream):
            self.mapped = code_map(unfiltered(told, get))
        encoding = get(about.get("Encoding"))
        if isinstance(encoding, dict):
            code = 0
            for x in get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                else:
                    self.mapped.setdefault(code, glyph(x))
                    code += 1
        first, widths = get(about.get("FirstChar")), get(about.get("Widths"))
        self.widths = {first + i: w for i, w in enumerate(map(get, widths))} if isinstance(first, int) and isinstance(widths, list) else {}
        self.usual = 600 if "Courier" in str(about.get("BaseFont", "")) else 500
        self.plain = not (self.wide or self.mapped or self.widths)

    def read(self, raw: bytes) -> tuple[str, float]:
        if self.plain:  # every byte is a character, all of one width
            return raw.decode("cp1252", "replace"), len(raw) * self.usual / 1000
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if self.wide else list(raw)
        text = "".join(self.mapped[c] if c in self.mapped else (chr(c) if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)
        return text, sum(self.widths.get(c, self.usual) for c in codes) / 1000


def code_map(raw: bytes) -> dict[int, str]:
    """The codes of a ToUnicode map."""
    out: dict[int, str] = {}
    held: list = []
    p = Parser(raw, refs=False)
    text = lambda b: bytes(b).decode("utf-16-be", "replace")
    number = lambda b: int.from_bytes(b, "big")
    while (x := p.next()) is not _END:
        if x in (b"beginbfchar", b"beginbfrange"):
            held = []
        elif x == b"endbfchar":
            out |= {number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False)}
        elif x == b"endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                for k, code in enumerate(range(number(low), min(number(high), number(low) + 0xFFFF) + 1)):
                    out[code] = text(to[k]) if isinstance(to, list) else (text(to)[:-1] + chr(ord(text(to)[-1]) + k) if to else "")
        else:
            held.append(x)
    return out


@dataclass(slots=True)
class Piece:
    x: float
    y: float
    end: float
    size: float
    text: str


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


_UNIT = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


@dataclass
class _State:
    space: list[float] = field(default_factory=lambda: list(_UNIT))
    font: Font | None = None
    size: float = 1.0
    leading: float = 0.0
    char: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    rise: float = 0.0


def pieces(raw: bytes, fonts: dict[str, Font]) -> Iterator[Piece]:
    """Every shown text with its place on the page."""
    p = Parser(raw, refs=False)
    held: list = []
    s, saved = _State(), []
    at, line = list(_UNIT), list(_UNIT)

    def shown(text: bytes) -> Piece | None:
        nonlocal at
        words, width = s.font.read(bytes(text)) if s.font else (bytes(text).decode("cp1252", "replace"), 0.5 * len(text))
        step = (width * s.size + s.char * len(words) + s.word * words.count(" ")) * s.stretch
        here = at if s.space == _UNIT else _times(at, s.space)
        x, y = s.rise * here[2] + here[4], s.rise * here[3] + here[5]
        at = [*at[:4], step * at[0] + at[4], step * at[1] + at[5]]
        size = abs(s.size * (here[3] or here[1]))
        return Piece(x, y, step * here[0] + here[4], size or 1.0, words) if words else None

    def moved(dx: float, dy: float) -> None:
        nonlocal at, line
        line = [*line[:4], dx * line[0] + dy * line[2] + line[4], dx * line[1] + dy * line[3] + line[5]]
        at = list(line)

    while (x := p.next()) is not _END:
        if not isinstance(x, bytes) or isinstance(x, bytearray):
            held.append(x)
            continue
        n = [v for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)] if held and x != b"Tj" else []
        if x == b"q":
            saved.append(_State(**vars(s)))
        elif x == b"Q" and saved:
            s = saved.pop()
        elif x == b"cm" and len(n) == 6:
            s.space = _times(n, s.space)
        elif x == b"BT":
            at, line = list(_UNIT), list(_UNIT)
        elif x == b"Tf" and len(held) == 2:
            s.font, s.size = fonts.get(held[0]), float(held[1])
        elif x == b"Td" and len(n) == 2:
            moved(*n)
        elif x == b"TD" and len(n) == 2:
            s.leading = -n[1]
            moved(*n)
        elif x == b"Tm" and len(n) == 6:
            at, line = list(map(float, n)), list(map(float, n))
        elif x == b"T*":
            moved(0, -s.leading)
        elif x in (b"TL", b"Tc", b"Tw", b"Tz", b"Ts") and n:
            name = {b"TL": "leading", b"Tc": "char", b"Tw": "word", b"Tz": "stretch", b"Ts": "rise"}[x]
            setattr(s, name, n[0] / 100 if x == b"Tz" else n[0])
        elif x in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytearray):
            if x == b'"' and len(n) == 2:
                s.word, s.char = n
            if x != b"Tj":
                moved(0, -s.leading)
            if (piece := shown(held[-1])) is not None:
                yield piece
        elif x == b"TJ" and held and isinstance(held[-1], list):
            for part in held[-1]:
                if isinstance(part, bytearray):
                    if (piece := shown(part)) is not None:
                        yield piece
                elif isinstance(part, (int, float)):
                    at = _times([1, 0, 0, 1, -part / 1000 * s.size * s.stretch, 0], at)
        elif x == b"BI":  # an inline image has bytes that are no objects
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(raw, p.at)
            p.at = end.end() if end else len(raw)
        held = []


def laid_out(found: Iterator[Piece]) -> list[str]:
    """Lines of pieces: those at one height, left to right, with a space where a gap is wider than a fifth of the type's size."""
    rows: list[list[Piece]] = []
    for piece in sorted(found, key=lambda p: -p.y):
        if rows and abs(rows[-1][0].y - piece.y) <= 0.3 * piece.size:
            rows[-1].append(piece)
        else:
            rows.append([piece])
    out = []
    for row in rows:
        row.sort(key=lambda p: p.x)
        text, end = "", None
        for piece in row:
            if end is not None and piece.x - end > 0.2 * piece.size and not text.endswith(" ") and not piece.text.startswith(" "):
                text += " "
            text += piece.text
            end = max(end or piece.end, piece.end)
        if text.strip():
            out.append(text.strip())
    return out

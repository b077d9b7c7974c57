"""Ogg media columns: pages, packets, logical streams and time stamps.

``mux`` stores packets of several logical streams as Ogg pages; ``demux`` reads
them back: it verifies each page's checksum, reassembles packets from lacing
values (also over page borders), separates the streams by serial number and
derives time stamps from granule positions. The layout is RFC 3533's.

Defined results: a null text is the empty text, whose payload is one padded
packet; equal texts give equal bytes. A page with a bad checksum, a gap in page
numbers or an unfinished packet raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 576
PAD = b"\xff"
_HEAD = struct.Struct("<4sBBqIIIB")
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, not reflected, from 0, no final inversion.

    On bytes with their bits turned round this is zlib's reflected register, so
    the C routine does the work and the result is turned round again.
    """
    register = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    """One logical stream as read: packets and the granule position at the end of each."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream; the first packet (its header) has a page of its own.

    Lacing: a packet takes len // 255 values of 255 and one below 255. A page has
    at most 255 values; a packet that goes on carries over and its page's granule
    position is that of the last packet ended there, -1 if none ended.
    """
    pages: list[bytes] = []
    lacing, body, granule, goes_on = bytearray(), [], -1, False

    def flush(more: bool, last: bool) -> None:
        nonlocal lacing, body, granule, goes_on
        flags = goes_on | (2 if not pages else 0) | (4 if last else 0)
        pages.append(_page(serial, len(pages), flags, granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, goes_on = bytearray(), [], -1, more

    for at, (packet, end) in enumerate(zip(packets, granules, strict=True)):
        values, done, taken = len(packet) // 255 + 1, 0, 0
        while done < values:
            room = min(255 - len(lacing), values - done)
            closes = done + room == values
            lacing += b"\xff" * (room - closes) + (bytes([len(packet) % 255]) if closes else b"")
            size = room * 255 if not closes else len(packet) - taken
            body.append(packet[taken : taken + size])
            taken, done = taken + size, done + room
            if closes:
                granule = end
            if len(lacing) == 255 and not (closes and at == len(packets) - 1):
                flush(not closes, False)
        if at == 0 and len(packets) > 1 and lacing:
            flush(False, False)
    flush(False, True)
    return pages


def mux(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """Pages of all streams: first each stream's beginning, then the rest in turn."""
    queues = [pages_of(*s) for s in streams]
    out = [q[0] for q in queues]
    rest = [q[1:] for q in queues]
    longest = max(map(len, rest), default=0)
    for i in range(longest):
        out += [q[i] for q in rest if i < len(q)]
    return b"".join(out)


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams of a physical stream, every page verified."""
    streams: dict[int, Stream] = {}
    begun: dict[int, list[bytes]] = {}
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"OggS" or at + 27 > len(media):
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"page at byte {at} is cut short")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"page at byte {at} has a bad checksum")
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or bool(flags & 2) != (number == 0) or s.ended or bool(flags & 1) != bool(begun.get(serial)):
            raise ValueError(f"page at byte {at} is out of order")
        s.pages, s.ended = s.pages + 1, bool(flags & 4)
        parts, place, fresh = begun.pop(serial, []), at + 27 + n, 0
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                parts.append(media[place : place + size])
                s.packets.append(b"".join(parts))
                parts, place, size, fresh = [], place + size, 0, fresh + 1
        if size or (lacing and lacing[-1] == 255):
            parts.append(media[place : place + size])
        if parts:
            begun[serial] = parts
        # Packets that end on this page: the last has the page's granule position.
        s.granules += [-1] * (fresh - 1) + [granule] * bool(fresh)
        at = end
    if begun or any(not s.ended for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


def seconds(stream: Stream, rate: int, per_packet: int) -> list[float]:
    """End time of each packet after the header: granules where pages tell them, the packets' own length between."""
    out: list[float] = []
    known = 0
    marks = stream.granules[1:]
    upto = len(marks)
    for i in range(len(marks) - 1, -1, -1):  # back from each page's last packet
        if marks[i] >= 0:
            known, upto = marks[i], i
        out.append((known - (upto - i) * per_packet) / rate)
    return out[::-1]


RATE = 8000
AUDIO, NOTES = 0x41, 0x4E


def store(payload: bytes, note: str) -> bytes:
    """8-bit mono samples in packets of 576 beside a stream with one comment."""
    packets = [b"PCM8" + struct.pack("<II", RATE, PACKET)] + [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    granules = [0] + [min(i + PACKET, len(payload)) for i in range(0, len(payload), PACKET)]
    said = note.encode()
    return mux([(AUDIO, packets, granules), (NOTES, [b"NOTE", said], [0, len(payload)])])


def load(media: bytes) -> tuple[bytes, str]:
    """The stored samples and their features: streams, pages, packets, milliseconds, mean and spread, crossings of the mid line, sharpest packet."""
    streams = demux(media)
    audio = streams[AUDIO]
    if audio.packets[0][:4] != b"PCM8":
        raise ValueError("not 8-bit samples")
    rate, unit = struct.unpack("<II", audio.packets[0][4:])
    payload = b"".join(audio.packets[1:])
    times = seconds(audio, rate, unit)
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int32) ** 2).sum(dtype=np.int64))
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    loud = np.add.reduceat(x, np.arange(0, len(x), unit), dtype=np.int64)
    at = int(loud.argmax())
    feature = (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(audio.packets) - 1};ms={round(times[-1] * 1000)};"
        f"mean_milli={1000 * total // len(x)};power_milli={1000 * squares // len(x)};crossings={crossings};loudest={at};loudest_ms={round(times[at] * 1000)};"
        f"note={streams[NOTES].packets[1].decode()}"
    )
    return payload, feature


def payload_of(text: bytes, unit: int = PACKET) -> bytes:
    """The bytes padded with 255 up to a positive multiple of the unit."""
    return text + PAD * (unit * max(1, -(-len(text) // unit)) - len(text))


def media_features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as Ogg and read back: sizes, digests and the features of the stored samples."""

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts:
                raw = text.encode()
                media = store(payload_of(raw), f"bytes={len(raw)}")
                back, feature = load(media)
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(out, columns=names)

    run = F.pandas_udf(rows, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return documents.select(F.col(id_col), run(F.coalesce(F.col(text_col), F.lit(""))).alias("media_row")).select(id_col, "media_row.*")

"""The Ogg container against a checksum bit by bit, plain features, and broken streams."""

import struct

import numpy as np
import pytest

from daybook.llm import ogg


def _crc(page):
    """RFC 3533's checksum, one bit at a time."""
    r = 0
    for byte in page:
        r ^= byte << 24
        for _ in range(8):
            r = (r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1
        r &= 0xFFFFFFFF
    return r


def _pages(media):
    out, at = [], 0
    while at < len(media):
        n = media[at + 26]
        end = at + 27 + n + sum(media[at + 27 : at + 27 + n])
        out.append(media[at:end])
        at = end
    return out


def _resealed(page):
    return page[:22] + struct.pack("<I", _crc(page[:22] + bytes(4) + page[26:])) + page[26:]


PAYLOAD = bytes(np.random.default_rng(2).integers(0, 256, 576 * 400, dtype=np.uint8))
SIZES = [0, 1, 254, 255, 256, 510, 576, 65025, 65026, 200_000]


def test_pages_and_packets():
    media = ogg.store(PAYLOAD, "note")
    pages = _pages(media)
    assert b"".join(pages) == media and len(pages) > 6
    for page in pages:
        assert page[:4] == b"OggS" and struct.unpack("<I", page[22:26])[0] == _crc(page[:22] + bytes(4) + page[26:])
    back, feature = ogg.load(media)
    assert back == PAYLOAD
    x = np.frombuffer(PAYLOAD, np.uint8).astype(int)
    told = dict(f.split("=") for f in feature.split(";"))
    loud = x.reshape(-1, 576).sum(1)
    assert told["packets"] == "400" and told["streams"] == "2" and told["note"] == "note" and int(told["pages"]) == len(pages)
    assert int(told["ms"]) == round(len(x) / 8) and int(told["mean_milli"]) == 1000 * x.sum() // len(x) and int(told["power_milli"]) == 1000 * (x**2).sum() // len(x)
    assert int(told["crossings"]) == sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
    assert int(told["loudest"]) == loud.argmax() and int(told["loudest_ms"]) == round((loud.argmax() + 1) * 576 / 8)


def test_packets_of_all_sizes_in_three_streams():
    packets = [bytes([i % 256]) * n for i, n in enumerate(SIZES)]
    granules = list(range(len(packets)))
    media = ogg.mux([(7, packets, granules), (8, packets[::-1], granules), (9, [b"x"], [0])])
    got = ogg.demux(media)
    assert got[7].packets == packets and got[8].packets == packets[::-1] and got[9].packets == [b"x"]
    assert all(g in (-1, i) for i, g in enumerate(got[7].granules)) and got[7].granules[-1] == len(packets) - 1


def test_broken_streams_are_refused():
    pages = _pages(ogg.store(PAYLOAD, "note"))
    flipped = bytearray(b"".join(pages))
    flipped[len(pages[0]) + 40] ^= 1
    middle = len(pages) // 2
    cut = pages[-1][:-3]
    open_end = _resealed(pages[-1][:5] + bytes([pages[-1][5] & ~4]) + pages[-1][6:])
    for media in (bytes(flipped), b"".join(pages[:middle] + pages[middle + 1 :]), b"".join(pages[:-1] + [cut]), b"".join(pages[:-1] + [open_end]), b"".join(pages[:-1]), b"junk" + pages[0], b"".join(pages + pages[:1])):
        with pytest.raises(ValueError):
            ogg.load(media)

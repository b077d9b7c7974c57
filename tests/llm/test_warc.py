"""Archives: revisits, round trips, files, and what the reader saves from damaged bytes."""

import hashlib
import random
import zlib

import pytest

from daybook.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, tie long, first string, size long, content string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "f", 2, "c") for i, u, h in rows], SCHEMA)


def plain(rows):
    """Sorted (id, bytes, digest, type, refers to); ids of equal payloads must differ."""
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h, i) != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(n, seed=1):
    rng = random.Random(seed)
    texts = ["x" * 99, "y" * 100, "é" * 50, None, "", "WARC/1.1\r\nno record\r\n\r\n" * 9, "\x1f\x8b" * 80, *(" ".join(str(rng.random()) for _ in range(rng.randint(1, 60))) for _ in range(n // 2))]
    return [(i * 3, rng.choice(["http://a.example/x y\n", None, f"http://b.example/{i}"]), rng.choice(texts)) for i in rng.sample(range(n), n)]


def test_round_trip(spark):
    rows = made(200)
    assert of(warc.page_records(pages(spark, rows))) == plain(rows)
    assert warc.page_records(pages(spark, [])).count() == 0


def test_small_archives_and_payloads(spark):
    rows = made(150, 2)
    made_of = warc.archives(pages(spark, rows), warc.Warc(archive_bytes=2000))
    assert made_of.count() > 10 and made_of.select("archive").distinct().count() == made_of.count()
    back = warc.records(made_of, payloads=True).collect()
    want = {i: (u, (h or "").encode()) for i, u, h in rows}
    for r in back:
        url, raw = want[r["page_id"]]
        assert r["url"] == (None if url is None else url.replace(" ", "%20").replace("\n", "%0A"))
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    assert warc.quarantined(made_of).count() == 0


def test_odd_rows(spark):
    long = "z" * 3_000_000
    rows = [(None, None, "q" * 200), (7, "u", "q" * 200), (7, "u", "q" * 200), (9, None, "q" * 200), (None, "v", None), (1, None, long), (2, None, long)]
    out = of(warc.page_records(pages(spark, rows)))
    q = [x for x in out if x[1] == 200]
    assert sorted(x[3] for x in q) == ["response", "revisit", "revisit", "revisit"] and {x[4] for x in q if x[3] == "revisit"} == {7} and [x[0] for x in q if x[3] == "response"] == [7]
    assert [x for x in out if x[1] == 3_000_000] == [(1, 3_000_000, hashlib.sha256(long.encode()).hexdigest(), "response", None), (2, 3_000_000, hashlib.sha256(long.encode()).hexdigest(), "revisit", 1)]


def test_large_keys_take_another_way(spark, monkeypatch):
    from daybook import keys

    monkeypatch.setattr(keys, "HOT_ROWS", 1)
    rows = made(60, 3)
    assert of(warc.page_records(pages(spark, rows))) == plain(rows)


def test_files(spark, tmp_path):
    rows = made(80, 4)
    stored = warc.archives(pages(spark, rows), warc.Warc(archive_bytes=3000))
    warc.save(stored, f"file://{tmp_path}/out")
    warc.save(stored, f"file://{tmp_path}/out")  # a second time changes nothing
    files = warc.from_files(spark, f"file://{tmp_path}/out/*.warc.gz")
    assert files.count() == stored.count() == len(list((tmp_path / "out").iterdir()))
    assert of(warc.records(files)) == plain(rows)


def listed(n, gz):
    rng = random.Random(n)
    out = []
    for i in range(n):
        body = " ".join(str(rng.random()) for _ in range(rng.randint(1, 200))).encode()
        raw = warc.page_record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None, "2020-01-01T00:00:00Z")
        out.append(warc.member(raw) if gz else raw)
    return out


def read_of(content):
    found = list(warc.salvaged(content))
    assert [a for a, *_ in found] == [0, *(b for _, b, *_ in found)][: len(found)] and (not found or found[-1][1] == len(content))  # no byte is in two or in none
    return [int(h["warc-page-id"]) for _, _, h, _ in found if h], [(a, b, why) for a, b, h, why in found if h is None]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("seed", range(12))
def test_records_beside_damage_are_saved(gz, seed):
    parts = listed(30, gz)
    starts = [sum(map(len, parts[:i])) for i in range(31)]
    rng = random.Random(seed)
    hit = sorted(rng.sample(range(30), 4))
    broken = [bytearray(p) for p in parts]
    for i in hit:
        p = broken[i]
        kind = rng.randrange(4)
        if kind == 0:  # a byte within the block or the compressed bytes
            at = rng.randrange(len(p) // 2, len(p) - 12)
            p[at] ^= 0x55
        elif kind == 1:
            del p[len(p) // 2 : len(p) // 2 + rng.randint(1, 40)]
        elif kind == 2:
            p[:8] = bytes(8)
        else:
            del p[rng.randrange(20, len(p)) :]
    ids, gaps = read_of(b"".join(map(bytes, broken)))
    assert ids == [i for i in range(30) if i not in hit]
    assert len(gaps) == sum(1 for k, i in enumerate(hit) if k == 0 or hit[k - 1] != i - 1) and all(why for *_, why in gaps)
    assert starts[-1] == sum(map(len, parts))


def test_cut_garbage_and_mixed_archives():
    gz, raw = listed(6, True), listed(6, False)
    assert read_of(b"".join(gz)[:-5])[0] == [0, 1, 2, 3, 4]
    ids, gaps = read_of(b"rubbish WARC/1.1\r\nmore\n" + gz[0] + raw[1] + b"\x1f\x8b\x08tail" + gz[2] + b"end")
    assert ids == [0, 1, 2] and len(gaps) == 3
    assert read_of(b"") == ([], []) and read_of(b"nothing")[0] == []
    two = warc.member(raw[0] + raw[1])
    assert read_of(two + gz[3]) == ([3], [(0, len(two), "the member holds more than its record")])


def test_checks_have_names():
    body = b"payload"
    good = warc.page_record(1, None, body, hashlib.sha256(body).hexdigest(), 7, None, "d")
    wrong = warc.page_record(1, None, body, hashlib.sha256(b"other").hexdigest(), 7, None, "d")
    assert read_of(wrong) == ([], [(0, len(wrong), "digest of the payload")])
    assert read_of(good.replace(b"payload\r\n\r\n", b"paxload\r\n\r\n"))[1][0][2] == "digest of the block"
    assert read_of(good.replace(b"Content-Length", b"Content-Lengte", 1))[0] == []
    assert read_of(good[:-4])[1][0][2] == "the block does not end where its length says"


def test_a_foreign_archive_without_own_headers():
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>hi</p>"
    raw = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (_, _, headers, told) = next(warc.salvaged(zlib.compress(raw, wbits=31)))
    assert headers["warc-type"] == "response" and told == (b"<p>hi</p>", hashlib.sha256(b"<p>hi</p>").hexdigest(), 9)


def test_a_damaged_archive_as_a_table(spark):
    rows = made(60, 6)
    stored = warc.archives(pages(spark, rows)).orderBy("archive").collect()
    broken = [(r["archive"], bytes(r["content"][:40]) + b"!" + bytes(r["content"][41:])) for r in stored]
    df = spark.createDataFrame(broken, "archive string, content binary")
    gaps = warc.quarantined(df).collect()
    assert len(gaps) == len(broken) and all(g["begin"] == 0 for g in gaps)
    assert of(warc.records(df)) == plain(rows)  # the first member tells about the archive only

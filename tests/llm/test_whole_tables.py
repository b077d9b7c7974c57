"""The registered queries on the whole smallest tables against plain versions."""

import hashlib
import re
import zlib

import brute
import numpy as np
import pytest

from daybook.llm import near_dedup, packing
from daybook.llm.queries import QUERIES, tokenizer


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "coalesce(text, '')").collect()]


def result(spark, sf_dir, name):
    return [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]


def test_op1(spark, sf_dir):
    got = {r["page_id"]: r for r in result(spark, sf_dir, "op1_html_extraction")}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    import html

    for p in pages:
        article = p["html"].split("<article>")[1].split("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", article)
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks) if x)
        assert got[p["page_id"]]["text"] == want
        assert got[p["page_id"]]["n_chars"] == len(want)


def test_op2(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op2_pii")}
    for i, t in docs:
        spans = brute.base_spans(t)
        r = got[i]
        assert [r[f"n_{k}"] for k in spans] == [len(v) for v in spans.values()]
        base = brute.listed(spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(r["spans"].split(","))


def test_op3(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op3_ogg")}
    for i, t in docs:
        raw = t.encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_op4(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op4_quality_rules")}
    for i, t in docs:
        r = got[i]
        want = brute.quality_counts(t)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_op5(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = result(spark, sf_dir, "op5_best_fit_packing")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for i, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert all(p["length"] == 2048 for p in parts[1:]) and sum(p["length"] for p in parts) == len(ids)
        at = 0
        for p in parts:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) * 1.02 + 1


def test_op6(spark, sf_dir):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    got = {r["page_id"]: r for r in result(spark, sf_dir, "op6_url_filters")}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((h + q, v) for v, h, q in rules if (host == h or host.endswith("." + h)) and path.startswith(q)), key=lambda x: len(x[0]), default=(None, None))
        r = got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, fit[0])
        assert r["verdict"] == fit[1] if fit[0] else r["verdict"] in ("allow", "block")


def test_op7(spark, sf_dir, docs):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op7_sentence_pieces")}
    for i, t in docs:
        ids = s.encode(t)
        r = got[i]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(s.decode(ids).encode()).hexdigest()


def test_op8(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op8_license_scan")}
    assert len(got) == len(docs)
    for i, t in docs:
        assert (got[i]["license"] == "MIT") == ("Released under the MIT License." in t)
        assert (got[i]["n_licenses"] > 0) == bool(re.search("licensed? under|MIT License", t, re.I))


def test_op9(spark, sf_dir, docs):
    want = brute.near(docs, 3, 85)
    got = {r["doc_id"]: r for r in result(spark, sf_dir, "op9_minhash_near_dedup")}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_dedup_five_words(spark, sf_dir, docs):
    want = brute.near(docs, 5, 80)
    rows = near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), near_dedup.MinHash(words=5, percent=80)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want


def test_op10(spark, sf_dir, docs):
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in result(spark, sf_dir, "op10_suffix_array_dedup"))
    assert got == sorted(brute.repeats(docs))

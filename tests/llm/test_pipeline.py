"""The corpus pipeline, stage by stage against plain versions, and as a whole."""

import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from daybook.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents of random words: clean ones, copies, near copies, shared passages of 51 words, personal data, junk, nulls, repeated rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(51)
    texts = [text(rng.randint(40, 160)) for _ in range(60)]
    texts += [texts[3]] * 3 + [texts[5] + " tail end", texts[7].capitalize(), texts[8].upper()]
    texts += [f"{text(60)} {passage} {text(50)}" for _ in range(6)]
    texts += [f"{text(30)} mail me at ann.lee@corp.example or 10.20.30.40 please {text(20)}", f"{text(30)} card 4111 1111 1111 1111 call +49 30 1234567 {text(20)}"]
    texts += [None, "", "too short", ("same words again " * 40).strip(), "## ** || " * 60]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], (None, text(70), "en", "web", 1), (None, text(70), None, None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return f"{folder}", rows, passage


def _reread(spark, df, folder):
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_against_plain_versions(spark, made, tmp_path):
    sf_dir, rows, passage = made
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "personal_data", "pack"]

    kept = _reread(spark, stages["quality"](spark, docs, sf_dir), f"{tmp_path}/1")
    assert kept.columns == docs.columns
    shouted = lambda t: sum("A" <= x <= "Z" for x in t) * 1000 > 150 * len("".join(t.split()))
    fine = lambda t: (c := brute.quality_counts(t or ""))[0] >= 10 and 100 * c[4] <= 20 * c[0] and c[2] * 1000 // c[0] <= 100 and not shouted(t)
    assert _rows(kept) == sorted((r for r in rows if fine(r[1])), key=repr)

    given = [tuple(r) for r in kept.collect()]
    unique = _reread(spark, stages["near_duplicates"](spark, kept, sf_dir), f"{tmp_path}/2")
    ordered = sorted(given, key=lambda r: (r[0] is None, r[0] or 0))
    component = brute.near([(n, r[1]) for n, r in enumerate(ordered)], 5, 80)
    assert _rows(unique) == sorted((r for n, r in enumerate(ordered) if component[n][1] == n), key=repr)

    given = [tuple(r) for r in unique.collect()]
    cut = _reread(spark, stages["repeated_passages"](spark, unique, sf_dir), f"{tmp_path}/3")
    want = brute.repeats([(n, r[1]) for n, r in enumerate(given)], corpus_pipeline.PASSAGE)
    digests = sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in cut.collect())
    assert digests == sorted(w[4] for w in want) and cut.columns == docs.columns
    assert not any(passage in r["text"] for r in cut.collect()) and all(r["n_chars"] in (None, 1, len(r["text"])) for r in cut.collect())

    safe = _reread(spark, stages["personal_data"](spark, cut, sf_dir), f"{tmp_path}/4")
    texts = [r["text"] for r in safe.collect()]
    assert safe.count() == cut.count() and safe.columns == docs.columns
    assert not any(v in t for t in texts for v in ("ann.lee@", "10.20.30.40", "4111", "1234567")) and sum("<email>" in t for t in texts) == 1
    clean = [r["text"] for r in cut.collect() if not re.search("[0-9@]", r["text"])]
    assert len(set(clean) & set(texts)) == len(set(clean))

    packed = stages["pack"](spark, safe, sf_dir).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = [np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for x in texts]
    assert sorted((r["length"], r["ids_crc32"]) for r in packed) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(map(len, ids)) // 2048) + 1


def test_run_and_an_empty_table(spark, made, tmp_path):
    sf_dir, _, passage = made
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(range(100)) | {None}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0

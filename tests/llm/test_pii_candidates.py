"""Long secrets, secrets behind a name, lists of numbers and long runs of one class."""

import base64
import random
import re

import pytest

from daybook.llm import pii

NUMBERS = ["(212) 555-1234", "(646) 555-9876", "(917) 555-4321"]


def token(n, letters="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    rng = random.Random(n)
    return "".join(rng.choice(letters) for _ in range(n))


TEXTS = {
    "long": (f"token: {token(129)} end", "secret", [token(129)]),
    "longer": (f"the key is {token(700)}\n", "secret", [token(700)]),
    "base64": (f"secret={base64.b64encode(random.Random(1).randbytes(301)).decode()} x", "secret", [base64.b64encode(random.Random(1).randbytes(301)).decode()]),
    "named": (f"set api_key={token(32, '0123456789abcdef')} now", "secret", [token(32, "0123456789abcdef")]),
    "list": (f"call {' '.join(NUMBERS)} today", "number", NUMBERS),
    "spaces": ("call 212 555 1234 646 555 9876 917-555-4321 or 123-45-6789/987-65-4321", "number", ["212 555 1234", "646 555 9876", "917-555-4321", "123-45-6789", "987-65-4321"]),
    "contact": (f"contact: {'a.' * 30}b [at] {'x' * 50} [dot] com", "contact", [f"{'a.' * 30}b [at] {'x' * 50} [dot] com"]),
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in TEXTS.items()], "doc_id string, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.with_spans(df).collect()}
    return spans, {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}


@pytest.mark.parametrize("name", list(TEXTS))
def test_whole_values_are_found(found, name):
    text, kind, values = TEXTS[name]
    spans, redacted = found
    assert set(values) <= {text[s["start"] : s["end"]] for s in spans[name][kind]}
    assert not any(v in redacted[name] for v in values)
    assert not re.search(r"[0-9]{3,}|[A-Za-z0-9/+]{30,}", redacted[name])


def test_long_runs_of_one_class(spark):
    texts = ["(" * 300_000, "1 " * 150_000 + "x", "a." * 150_000, "-" * 300_000, "1" + "-" * 300_000, "=" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.span_report(df).count() == len(pii.redact(df).collect()) == len(texts)

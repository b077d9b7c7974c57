"""Ids as the tokenizers library gives them by default: added tokens in the text and huge runs of white space."""

import zlib

import numpy as np

from daybook.llm import packing
from daybook.llm.queries import tokenizer

TEXTS = [
    "a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|> <|endoftext|>\n", "<|endoftext", "", None, " ", "It's 12 o'clock\u00a0\u3000 now",
    " " * 1_000_000, "a" + " " * 1_000_000 + "b", "x" + "\n" * 400_001, "\u3000" * 300_000 + "<|endoftext|>z", " " * 20_000, " " * 19_999 + "q", "a" * 1_000_000,
]


def test_pieces_hold_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {}
    for r in packing.pieces(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), tokenizer("byte_bpe_50k.json")).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert sorted(got[i]) == [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY))]

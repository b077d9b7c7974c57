"""Texts without a space: equal to the library, in time that grows with their length."""

import random
import time

import sentencepiece

from daybook.llm.queries import tokenizer
from daybook.llm.sentence_pieces import PieceModel


def test_four_million_characters_without_a_space():
    path = tokenizer("piece_bpe_32k.model")
    rng = random.Random(2)
    syllables = ["".join(rng.choice("aeiou") if i % 2 else rng.choice("bcdfglmnprst") for i in range(rng.randint(2, 6))) for _ in range(400)]
    run = "".join(rng.choice(syllables) for _ in range(1_000_000))[:4_000_000]
    merges = PieceModel(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert merges.encode(run[:200_000]) == library.encode(run[:200_000])
    took = []
    for n in (1_000_000, 4_000_000):
        began = time.perf_counter()
        merges.encode(run[:n])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2

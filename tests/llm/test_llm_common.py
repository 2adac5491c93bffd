"""What the tests of this folder share, and tests of the shared helpers."""

import random

import numpy as np

SMALL = "/root/testdata/sf0.001"

ODD = [
    "a", "B", "é", "É", "ß", "ÿ", "×", "µ", "ª", "½", "²", "1", "9", "'s", "'S", "'t", "'", "<|endoftext|>",
    "<|startoftext|>", "<|", "|>", " ", "\n", " ", "\x1c", "\x85", "́", "é", "İ", "Σ", "ς", "ΑΣ", " Σ",
    "日本", "👍🏽", "​", "﻿", "ﬁ", "ⅷ", "가", "_", "-", "...", "\x00", "\x07", "ŉ", "ǅ", "K", "Å",
]


def by_library(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(count, seed=3, most=14):
    chance = random.Random(seed)
    return ["".join(chance.choice(ODD) for _ in range(chance.randint(0, most))) for _ in range(count)]


def test_encoder_agrees_with_the_library(tokenizer, library):
    from shelfsift.llm.encoding import Encoder

    with open(tokenizer) as file:
        fast = Encoder(file.read())
    assert fast.fast
    for text in odd_texts(4000):
        ids = by_library(library, text)
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == ids


def test_encoder_memory_turns_over(tokenizer, library, monkeypatch):
    from shelfsift.llm import encoding

    monkeypatch.setattr(encoding, "MEMORY", 8)
    with open(tokenizer) as file:
        fast = encoding.Encoder(file.read())
    text = " ".join(f"wo{'rd' * (i % 7)}{'xyz'[i % 3]}" for i in range(300))
    assert np.frombuffer(fast.encode(text), "<u4").tolist() == by_library(library, text)
    assert len(fast._pieces) <= 8

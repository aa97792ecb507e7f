"""Random texts through the remembering encoder and through the library's plain call."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from glossa.llm.encoding import Encoder

PARTS = [
    "the", "The", "THE", "don't", "I'll", "'s", "'S", "o'clock", "naïve", "Straße", "ÉCOLE", "ñ", "ª", "x2", "2024", "3.14", "e-mail", "a_b", "well,", "well...", "(so)", "$5", "100%", "###", "&&|", "C:\\x",
    "word" * 20, "0" * 60, "-" * 70, "ABCdef", "'", "''", '"q"', "!?", ".", "…", "日本", "🙂", "İx", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\x01", "\u00a0", "\u2003", "\x1c",
]
GAPS = [" "] * 12 + ["\n"] * 3 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", ""]


def random_text(rng):
    return "".join(rng.choice(PARTS if rng.random() < 0.2 else PARTS[:33]) + rng.choice(GAPS) for _ in range(rng.randrange(0, 30)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_plain_call(name):
    rng = random.Random(11)
    texts = ["", " ", "\n", *(random_text(rng) for _ in range(6000))]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array(x.ids, "<u4").tobytes() for x in plain.encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(public_tokenizers.path(name))
    enc.bases.limit = enc.tokens.limit = 40  # so that generations turn
    got = [x for at in range(0, len(texts), 100) for x in enc.encode_batch(texts[at : at + 100])]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []
    assert len(enc.bases) + len(enc.bases.old) < 4000


def test_long_keys_are_not_remembered():
    enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    enc.encode_batch(["x" * 1000 + " " + "ab" * 500 + "\n" + "1a" * 300])
    assert max(map(len, [*enc.bases, *enc.tokens]), default=0) <= 48

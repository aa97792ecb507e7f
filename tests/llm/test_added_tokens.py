"""Texts with an added token's string have the ids of the plain library call."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glossa.llm.encoding import Encoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens(name):
    path = public_tokenizers.path(name)
    plain, texts = Tokenizer.from_file(path), ["x <|endoftext|> y", "X<|ENDOFTEXT|>y z", "<|startoftext|> a b", "x y"]
    assert Encoder(path).encode_batch(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

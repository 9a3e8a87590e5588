"""Texts that hold an added token have the ids of the tokenizer's own defaults."""

import random

import pyarrow as pa
from tokenizers import Tokenizer

from catalogcheck.llm import packing


def test_added_tokens_are_one_id():
    plain = Tokenizer.from_file(packing.tokenizer_path())
    random.seed(11)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "|>", "word", "Others, more.", " ", "\n", "é!"]
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|endof", "text|> next row", None, "", "plain words here"]
    texts += ["".join(random.choice(bits) for _ in range(random.randint(1, 12))) for _ in range(300)]
    ids, edges = packing.WordEncoder(packing.tokenizer_path()).ids(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 1], t
    assert ids[: edges[1]].tolist() == [320, 49407, 321, 1]

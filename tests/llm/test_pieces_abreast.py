"""Short stretches pass side by side: the ids of the plain recursion, at a fraction of the time of one after the other."""

import random
import time

import numpy as np
import pytest
from test_brute_force import whole_viterbi

from catalogcheck.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(pieces.model_path())


def made_words(n, letters="aeinrstthlodcu"):
    random.seed(7)
    return list({"".join(random.choices(letters, k=random.randint(3, 16))) for _ in range(n)})


def ids(encoded):
    return np.frombuffer(encoded, "<u4").tolist()


def test_equals_the_plain_recursion(vocabulary):
    random.seed(3)
    odd = {"".join(random.choices("aeinrstth é漢\n.xqЖ\U0001d4b3\x00" + pieces.HELD, k=random.randint(1, pieces.SHORT))).replace(" ", pieces.SPACE) for _ in range(2000)}
    ordered = sorted(odd | {"x", pieces.SPACE, pieces.HELD, "漢" * pieces.SHORT}, key=len, reverse=True)
    for s, got in zip(ordered, pieces.side_by_side(ordered, vocabulary), strict=True):
        stream = pieces.StreamingViterbi(vocabulary)
        assert ids(got) == stream.feed(s) + stream.finish()
        if pieces.HELD not in s:
            assert ids(got) == whole_viterbi(s, vocabulary)


def test_many_texts_in_slices(vocabulary, monkeypatch):
    """Slices, a full memory, long stretches and held characters in one call: each text as if it were alone."""
    words = made_words(300)
    texts = ["", " ".join(words), "y" * 200 + " a", "  b", "\ufffe ▁ \ufffe", *(" ".join(words[i : i + 5]) for i in range(0, 300 - 5, 5))]
    alone = [pieces.Encoder(vocabulary).encode(t) for t in texts]
    monkeypatch.setattr(pieces, "SLICE", 7)
    monkeypatch.setattr(pieces, "ABREAST", 3)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    assert pieces.Encoder(vocabulary).encode_all(texts) == alone
    assert [pieces.decode(x, vocabulary) for x in alone] == texts


def test_short_stretches_are_not_streamed(vocabulary, monkeypatch):
    text = " ".join(made_words(2000))
    want = pieces.Encoder(vocabulary).encode(text)

    def streamed(v):
        raise AssertionError("one after the other")

    monkeypatch.setattr(pieces, "StreamingViterbi", streamed)
    assert pieces.Encoder(vocabulary).encode(text) == want


def test_new_words_cost_less_than_half_of_streaming(vocabulary):
    words = made_words(8000)
    start = time.process_time()
    pieces.Encoder(vocabulary).encode(" ".join(words))
    abreast = time.process_time() - start
    start = time.process_time()
    for w in words:
        stream = pieces.StreamingViterbi(vocabulary)
        stream.feed(pieces.SPACE + w)
        stream.finish()
    assert 2 * abreast < time.process_time() - start

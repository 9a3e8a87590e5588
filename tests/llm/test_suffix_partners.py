"""What op5 sorts: only stretches that agree with another one beyond their anchor; and that nothing repeated is lost by it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from catalogcheck.llm import repeats


def letters(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def removed(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_removed, r.n_spans) for r in repeats.dedup(docs, ["doc_id"], True).collect()}


def test_a_common_phrase_alone_is_not_sorted(spark, monkeypatch):
    """Every text holds the same 90 bytes and nothing else that is repeated: anchors repeat, no 200-byte string does."""
    rng, sent, old = random.Random(5), [], repeats.sorted_marks
    monkeypatch.setattr(repeats, "sorted_marks", lambda stretch, classes, *more: (sent.append(classes.count()), old(stretch, classes, *more))[1])
    phrase = letters(rng, 90)
    got = removed(spark, [letters(rng, 300) + phrase + letters(rng, 300) for _ in range(40)])
    assert set(got.values()) == {(0, 0)}
    assert sent == [0]


@pytest.mark.parametrize("few", [False, True])
def test_strings_of_exactly_200_bytes(spark, monkeypatch, few):
    """Two texts share 200 bytes somewhere, or 199; with few copies allowed, the shared ones are sent to all tasks."""
    if few:
        monkeypatch.setattr(repeats, "HOT", 1)
    rng, texts, want = random.Random(7), [], {}
    for i in range(120):
        n = 200 - i % 2
        shared = letters(rng, n)
        for side in "01":  # what stands beside the shared bytes differs
            want[len(texts)] = (200, 1) if n == 200 else (0, 0)
            texts.append(letters(rng, rng.choice([0, 3, 90, 300])) + side + shared + side + letters(rng, rng.choice([0, 5, 90, 300])))
    assert removed(spark, texts) == want


@pytest.mark.parametrize("hot", [3, 20_000])
def test_a_passage_of_very_many_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(9)
    line = letters(rng, 1000)
    texts = [letters(rng, 250) + "".join(str(i % 10) + line for _ in range(1 + i % 3)) for i in range(30)] + [letters(rng, 700), "", "x" * 450]
    seen = {}
    for t in texts:
        for j in range(len(t) - 199):
            seen[t[j : j + 200]] = seen.get(t[j : j + 200], 0) + 1
    want = {}
    for i, t in enumerate(texts):
        cover = np.zeros(len(t) + 2, np.int8)
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                cover[j + 1 : j + 201] = 1
        want[i] = (int(cover.sum()), int((np.diff(cover) == 1).sum()))
    assert removed(spark, texts) == want
    assert want[0][0] >= 1000 and want[31] == (0, 0) and want[32] == (450, 1)


def test_runs_of_neighbouring_texts_stay_apart():
    """Starts at the end of one text and at the beginning of the next; a slice of a larger batch; an empty and a null list."""
    kind = pa.list_(pa.struct([("start", pa.int32()), *[(f"mask{w}", pa.int64()) for w in range(repeats.MASKS)]]))
    one = {"start": 0, "mask0": 1, "mask1": 0, "mask2": 0}
    last = {"start": 90, "mask0": 1 << 10 | 1 << 5, "mask1": 0, "mask2": 1 << 59}
    runs = pa.array([[one], [last, one], [one], None, []], kind).slice(1)
    offsets = np.array([0, 469, 769, 769, 969])
    row, start, end = repeats.covered(offsets, runs)
    assert list(zip(row.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 0, 469), (1, 469, 669)]

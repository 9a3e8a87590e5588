"""Partial matching held against a plain trie in dictionaries, its probabilities' sums, and texts of odd kinds."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from catalogcheck.llm import ppm

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % ppm.FOLDS != ppm.HELD_FOLD


def stream(text):
    return b"".join(w + b" " for w in tokens(text)) + b"\n"


def plain_trie(rows):
    trie = defaultdict(Counter)
    for doc_id, text in rows:
        if training(doc_id):
            whole = b"\0" * ppm.ORDER + stream(text)
            for t in range(ppm.ORDER, len(whole)):
                for k in range(ppm.ORDER + 1):
                    trie[whole[t - k : t]][whole[t]] += 1
    return trie


def probability(trie, context, symbol):
    p, excluded = 1.0, set()
    for k in range(ppm.ORDER, -1, -1):
        node = trie.get(context[ppm.ORDER - k :])
        if not node:
            continue
        left = {s: c for s, c in node.items() if s not in excluded}
        total = sum(left.values())
        if symbol in left:
            return p * (left[symbol] - 0.5) / total
        if left:
            p *= len(left) / (2 * total)
        excluded |= set(node)
    return p / (ppm.ALPHABET - len(excluded))


def brute(rows):
    trie = plain_trie(rows)
    words, ends = Counter(), 0
    for doc_id, text in rows:
        if training(doc_id):
            words.update(tokens(text))
            ends += 1
    total, kinds = sum(words.values()) + ends, len(words) + (ends > 0)
    out = []
    for doc_id, text in rows:
        counts = [*(words[w] for w in tokens(text)), ends]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in counts)
        whole = b"\0" * ppm.ORDER + stream(text)
        score = sum(math.log10(probability(trie, whole[t - ppm.ORDER : t], whole[t])) for t in range(ppm.ORDER, len(whole)))
        out.append((doc_id, not training(doc_id), len(counts), sum(c > 0 for c in counts), total, base, score))
    return out


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, ppm.scores(docs).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6])), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-7, abs=1e-9)
    return got


def test_scores_equal_the_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ppm, "STEP", 700)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1][:600] if r[1] else r[1]) for r in docs.limit(150).collect()]
    check(spark, rows)


def test_odd_texts(spark):
    rows = [
        (1, "The cat sat"), (2, None), (3, ""), (4, " \t\n "), (5, "the cat sat on the mat " * 50), (5, "the cat sat on the mat " * 50), (None, "the CAT"),
        (None, None), (6, "a\x00b été \U0001f600"), (7, "x" * 5000), (8, "the cat sat"), (9, "\nend\n"), (10, "zz qq")]
    check(spark, rows)
    check(spark, [(i, "never seen in training") for i in range(200) if not training(i)][:3])
    assert ppm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_extra_columns_are_not_read(spark):
    rows = [(1, "a b c"), (2, "a b")]
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in rows], "doc_id long, text string, block long, shard string, data binary")
    assert sorted(map(tuple, ppm.scores(docs).collect())) == sorted(map(tuple, ppm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()))


def test_probabilities_of_a_context_sum_to_one_at_most():
    trie = plain_trie([(1, "abra cadabra abracadabra"), (3, "a bra a cad")])
    every = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert len(every) == ppm.ALPHABET
    for context in (b"\0\0\0\0\0", b"abrac", b" abra", b"zzzzz", b"zzzza"):
        assert sum(probability(trie, context, s) for s in every) == pytest.approx(1.0)


def test_held_out_texts_are_better_predicted_than_by_words_alone(spark):
    got = ppm.op12_partial_matching(spark, "/root/testdata/sf0.1").toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.8
    assert (got.score < 0).all()

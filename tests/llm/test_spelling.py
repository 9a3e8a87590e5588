"""Near words, forms and roots held against plain comparison of all words, and texts of odd kinds."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from catalogcheck.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    n = vocabulary(rows)
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def check(spark, rows):
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows)
    return got


def test_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert any(r.form for r in check(spark, [tuple(r) for r in docs]))


def test_crowded_words_in_many_shards_and_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_ENTRIES", 50)
    monkeypatch.setattr(spelling, "MOST_WORDS", 20)
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("aé") for _ in range(rng.randint(6, 9))) for _ in range(40))) for i in range(60)]
    rows += [(900 + i, "abababab " * (10 * 11**i)) for i in range(3)] + [(990, "ababababa " * 1500), (991, "ababababab " * 20000)]
    got = check(spark, rows)
    assert max(r.n_near for r in got) > 5


def test_chains_of_forms(spark):
    # each word one letter from the next, ten times as frequent, with ids that delete nothing
    words, rows = ["colourfully", "colourfullx", "colourfulyx", "colourfulzyx"], []
    for i, w in enumerate(words):
        doc_id = next(d for d in range(i * 1000, 10**6) if zlib.crc32(f"{d}:{w}".encode()) % 31)
        rows.append((doc_id, f"{w} " * 2 * 10**i))
    got = {r.word: r for r in check(spark, rows)}
    assert got[words[0]].root == words[3]


def test_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, "1234 ... \n"), (None, "Apparent APPARENT apparent"), (4, "apparent apparant apparant"), (4, "apparent apparant apparant"),
        (5, "cafÉtérias cafÉtérias ×÷×÷×÷× ×÷×÷×÷×"), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999),
        (7, "náivety中longer longerone longerone"), (8, "abcdefg abcdefg abcdefgh abcdefgh abcdef abcdef bcdefg")]
    check(spark, rows)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    extra = spark.createDataFrame([(1, "apparent apparent", "w", 3, 4)], "doc_id long, text string, word string, n long, key long")
    assert [r.word for r in spelling.variants(extra).collect()] == ["apparent"]


def test_checksums_by_parts():
    words = [b"a", b"abc", "été".encode(), b"z" * 64, b"y" * 65, b"q" * 300]
    data = np.frombuffer(b"".join(words), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    row = np.arange(len(words)) % 2
    prefix = np.array([zlib.crc32(b"12:"), zlib.crc32(b":")], np.uint32)
    hashes = spelling.tk.span_hashes(data, edges[:-1], edges[1:])
    got = spelling.checksums(data, edges[:-1], edges[1:], hashes, row, prefix)
    assert got.tolist() == [zlib.crc32(p + w) for p, w in zip([b"12:", b":"] * 3, words, strict=True)]

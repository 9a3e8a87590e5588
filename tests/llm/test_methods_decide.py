"""The methods change results where they should: hosts, chunks, runs of spaces, altered repeats, look-alike strings."""

import random

import numpy as np
import pyarrow as pa
import pytest

from catalogcheck.llm import packing, pieces, pii, quality, urls
from catalogcheck.llm import textkit as tk


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_complementary_strings_are_told_apart():
    one = thue_morse(8192)
    two = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = tk.span_hashes(data, np.array([0, len(one)]), np.array([len(one), len(data)]))
    assert a != b
    assert quality.measure(pa.array([f"{one}\n{two}\n{one}"]))[3].to_pylist() == [1]
    both, edges = packing.WordEncoder(packing.tokenizer_path()).ids(pa.array([one, two, f"{one} {two}"]))
    x, y, z = (both[edges[i] : edges[i + 1]].tolist() for i in range(3))
    assert z == x[:-1] + y


def test_equal_spans_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    for n in (0, 1, 7, 8, 9, 255, 256, 257, 5000):
        twice = np.concatenate([data[:3], data[100 : 100 + n], data[:5], data[100 : 100 + n]])
        h = tk.span_hashes(twice, np.array([3, 8 + n]), np.array([3 + n, 8 + 2 * n]))
        assert h[0] == h[1]


def test_the_end_of_a_text_is_judged_too():
    random.seed(4)
    prose = " ".join("".join(random.choice(("an", "the", "er", "ou", "st", "li", "re", "on")) for _ in range(random.randint(1, 4))) for _ in range(3000)).encode()[:2048].decode()
    noise = "".join(chr(random.randint(33, 126)) for _ in range(500))
    shares = quality.measure(pa.array([prose + prose[::-1][:500], prose + " " + noise]))[7].to_pylist()
    assert shares[0] == 0.0
    whole = quality.measure(pa.array([prose + "x" * 2047]))[7].to_pylist()
    assert whole[0] == 0.5 and shares[1] in (0.0, 0.5)


def test_runs_of_spaces_are_single_pieces():
    v = pieces.Vocabulary.read(pieces.model_path())
    e = pieces.Encoder(v)
    for n in (2, 3, 4, 8, 16):
        ids = np.frombuffer(e.encode("a" + " " * n + "b"), "<u4").tolist()
        assert len(ids) <= 4 and pieces.decode(e.encode("a" + " " * n + "b"), v) == "a" + " " * n + "b"
    random.seed(6)
    for _ in range(200):
        t = "".join(random.choice(("  ", " ", "a", "the", "\n", "▁", "￾", "é")) for _ in range(random.randint(1, 30)))
        assert pieces.decode(e.encode(t), v) == t


def test_an_altered_number_is_linked_with_its_like():
    prose = "word " * 30
    docs = [f"{prose}call +1213555{i:04d} now {prose}or 1213555{(i + 1) % 1000:04d} again. {prose}ref 98765{i:03d} and ref 98765{i:03d}" for i in range(0, 600, 10)]
    plain = [f"order {1000 + i * 37} of item {5000 + i * 91} again" for i in range(60)]
    w = pii.Words()
    w.add(0, docs[0], pii.patterns(docs[0]))
    assert len(w.skip) == 2 and len(w.open) == 1
    found = pii.find_all(docs, pii.fit(docs + plain))
    assert [[text[a:b] for a, _, b in added] for text, (_, added) in zip(docs, found, strict=True)] == [[f"1213555{(i + 1) % 1000:04d}"] for i in range(0, 600, 10)]


@pytest.mark.parametrize("twice", [False, True])
def test_a_bad_host_is_blocked(spark, twice):
    """200 hosts with one bad page of ten, one with ten of ten: it is blocked, and so is none of the others."""
    rows, labels = [], []
    for h in range(200):
        for i in range(10):
            rows.append((h * 10 + i, f"http://h{h}.example.info/x"))
            labels.append((h * 10 + i, int(i != 0), 0))
    for i in range(40):
        rows.append((5000 + i, "http://bad.spam.biz:8080/x"))
        labels.append((5000 + i, 0, 1))
    rows.append((6000, "http://new.spam.biz/x"))
    rows.append((6001, "http://10.0.0.1/x"))
    pages = spark.createDataFrame(rows * (1 + twice), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert {got[5000 + i] for i in range(40)} == {"block"}
    assert {got[i] for i in range(2000)} == {"allow"} and got[6001] == "allow"


def test_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "x.com", "www.x.com:8080", "10.0.0.1", "10.0.0.1:80", "", "localhost"]
    d = spark.createDataFrame([(h,) for h in hosts], "host string")
    from pyspark.sql import functions as F

    got = {r["host"]: (r["d"], r["s"]) for r in d.select("host", urls.domain_of(F.col("host")).alias("d"), urls.suffix_of(F.col("host")).alias("s")).collect()}
    assert got == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com": ("x.com", "com"), "www.x.com:8080": ("x.com", "com"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "localhost": ("localhost", "localhost"),
    }

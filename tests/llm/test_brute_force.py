"""Every corpus operator against a plain version of itself, on the smallest tables or on texts made for the purpose."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from catalogcheck.llm import chat, ngram_join, packing, pieces, pii, quality, repeats, suffixes, toxicity, urls, weighted
from catalogcheck.llm import textkit as tk

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_quality_counts(texts):
    def plain(t):
        ws = WORD.findall(t)
        seen = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
        covered = {j for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)

    all_ = [*texts.values(), "", "a\na\n\n \na", "x " * 40, "é# ü|\r\nb"]
    got = list(zip(*[c.to_pylist() for c in quality.measure(pa.array(all_))[:5]], strict=True))
    assert got == [plain(t) for t in all_]


def test_quality_bands():
    random.seed(1)
    noise = "".join(chr(random.randint(33, 0x2FF)) for _ in range(3000))
    prose = " ".join("".join(random.choice(("an", "the", "er", "ou", "st", "li", "re", "on")) for _ in range(random.randint(1, 4))) for _ in range(400))
    out = quality.measure(pa.array([" ".join(noise[i : i + 6] for i in range(0, 3000, 6)), prose, "The same line again and again, with nothing new.\n" * 200]))
    assert out[-1].to_pylist() == [False, True, False]


def test_toxicity_holds_out(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    model, curve = toxicity.train(pa.array(rows.text[~held]), rows.toxic[~held].to_numpy())
    score = toxicity.score_texts(pa.array(rows.text[held]), model, curve)
    assert ((score >= 0.5) == (rows.toxic[held] == 1)).mean() > 0.93


def test_chain_marginals_are_exact():
    rng = np.random.default_rng(0)
    size = 1 << toxicity.HASH_BITS
    model = toxicity.Chain(rng.normal(size=size), -0.3, -0.7, rng.normal(size=(2, 2)))
    feats, lengths = rng.integers(0, size, (11, 3)), (1, 4, 6)
    first = np.zeros(11, bool)
    first[[0, 1, 5]] = True
    got, at = model.marginals(feats, first), 0
    for n in lengths:
        f = feats[at : at + n]
        weight, on = 0.0, np.zeros(n)
        for labels in np.ndindex(*(2,) * n):
            s = sum(lab * (model.weights[x].sum() + model.bias) for lab, x in zip(labels, f, strict=True)) + labels[0] * model.start
            s += sum(model.trans[a, b] for a, b in zip(labels, labels[1:], strict=False))
            weight += np.exp(s)
            on += np.exp(s) * np.array(labels)
        assert np.allclose(got[at : at + n], on / weight)
        at += n


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        ws = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("frequent", [False, True])
def test_ngram_join(spark, texts, monkeypatch, frequent):
    if frequent:  # nearly every shared shingle is of a frequent class, buckets are dealt to many blocks
        monkeypatch.setattr(ngram_join, "LEAST", (3, 5))
        monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.op3_ngram_jaccard_join(spark, SMALL).collect()}
    assert got == plain_components(texts)


def test_similar_sets_share_a_combination():
    """The prefix rule itself: any two sets of 80 % similarity meet in a combination, whatever their classes."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 220))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = rng.integers(0, len(a) + 1)
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 62, rng.integers(0, drop + 1)).astype(np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        share = int(rng.integers(1, 4))
        kinds = [(1 + (x % np.uint64(share)) % np.uint64(3)).astype(np.uint8) for x in (a, b)]
        both = np.intersect1d(a, b)

        def found(s, k, alone=0):
            """The combinations that a partner of this similarity needs."""
            return {x for x, level in zip(*map(np.ndarray.tolist, ngram_join.signatures(s, k, alone)), strict=True) if level <= len(s) + alone - len(both)}

        assert found(a, kinds[0]) & found(b, kinds[1])
        # shingles of one set alone come first; the others keep their order
        x, y = (found(s[np.isin(s, both)], k[np.isin(s, both)], len(s) - len(both)) for s, k in zip((a, b), kinds, strict=True))
        assert x & y


def test_weighted_fingerprints(spark, texts):
    got = {r["doc_id"]: r for r in weighted.op4_weighted_fingerprint(spark, SMALL).collect()}
    ids, off = sorted(texts), []
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        e = weighted.edited(texts[a], texts[b])
        assert got[a]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[a]["n_chars"] == len(texts[a])
        x, y = (collections.Counter(t.encode().translate(LOWER).split()) for t in (texts[a], e))
        off.append(got[a]["near_edited"] - sum((x & y).values()) / max(1, sum((x | y).values())))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.1


def test_suffix_array():
    random.seed(3)
    for _ in range(150):
        n, k = random.randint(1, 300), random.choice([1, 2, 3, 26])
        raw = bytes(random.randint(97, 96 + k) for _ in range(n))
        raw = raw[: n // 3] * 3 + raw if random.random() < 0.4 else raw
        data = np.frombuffer(raw, np.uint8)
        order = suffixes.suffix_array(data, 200)
        assert sorted(order.tolist()) == list(range(len(raw)))
        cut = [raw[i : i + 200] for i in order]
        assert cut == sorted(cut)
        lcp = suffixes.common_prefix(data, order[:-1], order[1:], 200)
        for x, y, m in zip(cut, cut[1:], lcp, strict=False):
            assert x[:m] == y[:m] and (m == min(len(x), len(y)) or x[m] != y[m])


@pytest.mark.parametrize("small_chunks", [False, True])
def test_suffix_dedup(spark, texts, monkeypatch, small_chunks):
    if small_chunks:  # anchors are dealt apart and chunks cut, so strings meet by their hash
        monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
        monkeypatch.setattr(repeats, "HOT", 3)
        monkeypatch.setattr(repeats, "SLICE", 701)  # texts are worked on slice by slice
    raw = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(b[j : j + 200] for b in raw.values() for j in range(len(b) - 199))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.op5_suffix_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    for i, b in raw.items():
        cover = bytearray(len(b))
        for j in range(len(b) - 199):
            if seen[b[j : j + 200]] > 1:
                cover[j : j + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(c and not (j and cover[j - 1]) for j, c in enumerate(cover))
        assert got[i] == (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(pieces.model_path())


def whole_viterbi(s, v):
    best = [(0, None, None)] + [None] * len(s)
    for i, c in enumerate(s):
        offers = [(i + 1, v.byte_score * len(c.encode()), tuple(v.byte_id[b] for b in c.encode()))] if c not in v.score else []
        offers += [(i + n, got[1], got[2]) for n in range(1, min(v.longest, len(s) - i) + 1) if (got := v.score.get(s[i : i + n]))]
        for to, gain, ids in offers:
            if best[to] is None or best[i][0] + gain > best[to][0]:
                best[to] = (best[i][0] + gain, i, ids)
    out, at = [], len(s)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return [i for ids in reversed(out) for i in ids]


def test_streaming_viterbi(vocabulary):
    random.seed(2)
    for _ in range(80):
        s = "".join(random.choice("aeinrstth é漢\n.xq") for _ in range(random.randint(1, 200))).replace(" ", pieces.SPACE)
        stream, out, at = pieces.StreamingViterbi(vocabulary), [], 0
        while at < len(s):
            n = random.randint(1, 30)
            out += stream.feed(s[at : at + n])
            at += n
        assert out + stream.finish() == whole_viterbi(s, vocabulary)


def test_viterbi_window_is_bounded(vocabulary):
    stream, most = pieces.StreamingViterbi(vocabulary), 0
    for _ in range(300):
        stream.feed("abcdefghij" * 3)
        most = max(most, len(stream.text))
    assert most < 200


def test_pieces_round_trip(vocabulary, texts):
    e = pieces.Encoder(vocabulary)
    for t in [*texts.values(), "", "  a", "▁x ▁", "\ufffe ▁\ufffe", "a\x00b", "漢字" * 3000]:
        assert pieces.decode(e.encode(t), vocabulary) == t


def plain_patterns(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_personal_data_patterns(texts):
    random.seed(1)
    made = ["".join(random.choice("0012345679..@@+- ()aé,:-") for _ in range(random.randint(1, 60))) for _ in range(4000)]
    for t in [*texts.values(), *made]:
        assert pii.patterns(t) == plain_patterns(t)


def test_skip_links_carry_a_label():
    """A number that a pattern finds once is labelled where it stands again without its plus sign."""
    prose = "word " * 30
    docs = [f"{prose}call +1 (213) 555-{i:04d} now {prose}or call 1 (213) 555-{i:04d} again" for i in range(60)]
    found = pii.find_all(docs, pii.fit(docs + ["only words here"] * 5))
    assert all(base for base, _ in found)
    assert not pii.find_all(["nothing personal 12 of 30"], pii.fit(docs))[0][1]


def test_loopy_propagation_on_a_tree_is_exact():
    w = pii.Words()
    w.doc, w.feats, w.seen = [0, 0, 0], [[0], [1], [2]], [0, 0, 0]
    w.near, w.skip = [(0, 1)], [(1, 2)]
    rng = np.random.default_rng(4)
    f = pii.Field(rng.normal(size=(3, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    joint = np.exp(f.weights[0][:, None, None] + f.weights[1][None, :, None] + f.weights[2][None, None, :] + f.near[:, :, None] + f.skip[None])
    joint /= joint.sum()
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(f.marginals(w), want, atol=1e-3)


@pytest.mark.parametrize("module", [chat, urls])
def test_sql_oracles(same, module):
    for name, query in module.QUERIES.items():
        same(query, module.ORACLES[name])


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for i, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = packing.op9_best_fit_packing(spark, SMALL).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(w[1] for w in want.values()) // 4096) + 1


def test_fullest_combination():
    random.seed(7)
    for _ in range(100):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(4)}
        room = random.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            for _ in range(n):
                sums |= {s + length for s in sums if s + length <= room}
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == max(sums)
        assert all(n <= counts[k] for k, n in got.items())


def test_filters_hold_what_they_were_built_from(spark):
    values = spark.range(1000).selectExpr("xxhash64(id) AS h")
    bits = tk.membership_filter(values)
    h = np.array([r["h"] for r in values.collect()], np.int64).view(np.uint64)
    assert tk.may_hold(bits, h).all()
    assert tk.may_hold(bits, h + np.uint64(12345)).mean() < 0.05

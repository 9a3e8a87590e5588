"""Toxicity: a two-label linear-chain conditional random field over the words of a text.

Training takes a bounded sample of labelled documents (``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS``
characters, chosen by a hash of the id). Only document labels exist, so tokens are labelled first: a feature
(word or word beginning) that occurs almost only in toxic documents of the sample marks its tokens in toxic
documents. The random field is then trained on those tokens, and scores every document: forward-backward
marginals give each word's chance of being toxic, their sum over the text gives the document's score through a
logistic curve fitted on the sample, and words over one half give the offending offsets.

All documents of a batch form one chain: at a document's first word the transition forgets the state before it,
so messages never pass between documents. The chain is cut into blocks whose 2 x 2 products are computed side by
side, which makes the recursion exact and fast.

Defined results: null and empty texts have no words and get the score of an expected toxic count of zero; without
any usable label (no toxic or no clean row) every score is 0. Repeated label rows of a document count once (the
largest label). Other columns, also those with clashing names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_DOCS = 4000, 8000, 1200
HASH_BITS, EPOCHS, RATE, DECAY = 18, 40, 0.5, 1e-3
#: A feature marks toxic tokens from this log-likelihood ratio, precision and share of the toxic documents on.
LEAST_G2, LEAST_PRECISION, LEAST_SHARE = 22.0, 0.9, 0.01
PREFIXES = (4, 5)
#: Marginals under this don't add to a document's expected number of toxic words.
SURE = 0.2

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the accented capitals of Latin-1, byte for byte."""
    out = tk.lower(data)
    if len(out) > 1:
        capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Start, end and row of runs of letters and digits."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _WORD[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        cut = inner[_WORD[data[inner]] & _WORD[data[inner - 1]]]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashed feature indices of each token, one column for the word and one for each beginning."""
    spans = [(start, end)] + [(start, np.minimum(end, start + n)) for n in PREFIXES]
    mask = np.uint64((1 << HASH_BITS) - 1)
    return np.stack([(tk.mix(tk.span_hashes(data, a, b) + np.uint64(977 * i)) & mask).astype(np.int32) for i, (a, b) in enumerate(spans)], 1)


class Chain:
    """Weights of the field: one number per feature (for toxic against clean), a bias, and transitions."""

    def __init__(self, weights: np.ndarray, bias: float, start: float, trans: np.ndarray):
        self.weights, self.bias, self.start, self.trans = weights, bias, start, trans

    def marginals(self, feats: np.ndarray, first: np.ndarray, pairs: bool = False):
        """Chance of toxic for every token; ``first`` marks the tokens that begin a document.

        With ``pairs``, also the expected transition counts and the expected toxic first tokens.
        """
        n = len(feats)
        if not n:
            return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
        score = np.clip(self.weights[feats].sum(1) + self.bias, -30, 30)
        width = max(1, int(np.sqrt(n)))
        blocks = -(-n // width)
        emit = np.ones(blocks * width)
        emit[:n] = np.exp(score)
        reset = np.ones(blocks * width, bool)  # what fills the last block is a chain of its own
        reset[:n] = first
        emit, reset = (np.ascontiguousarray(x.reshape(blocks, width).T) for x in (emit, reset))
        a = np.exp(self.trans)
        s = np.exp(self.start)
        m00, m01 = np.where(reset, 1.0, a[0, 0]), np.where(reset, s, a[0, 1]) * emit
        m10, m11 = np.where(reset, 1.0, a[1, 0]), np.where(reset, s, a[1, 1]) * emit
        p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for t in range(width):
            p00, p01 = p00 * m00[t] + p01 * m10[t], p00 * m01[t] + p01 * m11[t]
            p10, p11 = p10 * m00[t] + p11 * m10[t], p10 * m01[t] + p11 * m11[t]
            z = 1 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * z, p01 * z, p10 * z, p11 * z
        ahead, behind = np.empty(blocks), np.empty(blocks)
        x = 0.5
        for b in range(blocks):
            ahead[b] = x
            u, v = (1 - x) * p00[b] + x * p10[b], (1 - x) * p01[b] + x * p11[b]
            x = v / (u + v)
        y = 0.5
        for b in range(blocks - 1, -1, -1):
            behind[b] = y
            u, v = p00[b] * (1 - y) + p01[b] * y, p10[b] * (1 - y) + p11[b] * y
            y = v / (u + v)
        fore, x = np.empty((width, blocks)), ahead
        for t in range(width):
            u, v = (1 - x) * m00[t] + x * m10[t], (1 - x) * m01[t] + x * m11[t]
            fore[t] = x = v / (u + v)
        back, y = np.empty((width, blocks)), behind
        for t in range(width - 1, -1, -1):
            back[t] = y
            u, v = m00[t] * (1 - y) + m01[t] * y, m10[t] * (1 - y) + m11[t] * y
            y = v / (u + v)
        on, off = fore * back, (1 - fore) * (1 - back)
        chance = (on / (on + off)).T.reshape(-1)[:n]
        if not pairs:
            return chance
        fore, back = fore.T.reshape(-1)[:n], back.T.reshape(-1)[:n]
        inner = np.flatnonzero(~np.asarray(first))
        inner = inner[inner > 0]
        before, e, after = fore[inner - 1], np.exp(score[inner]), back[inner]
        joint = np.stack([(1 - before) * a[0, 0] * (1 - after), (1 - before) * a[0, 1] * e * after, before * a[1, 0] * (1 - after), before * a[1, 1] * e * after])
        joint = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        return chance, joint, float(chance[np.asarray(first)].sum())


def fit_chain(feats: np.ndarray, first: np.ndarray, gold: np.ndarray) -> Chain:
    """Maximum likelihood with a small quadratic penalty, by adaptive gradient steps over the whole sample."""
    size = 1 << HASH_BITS
    model = Chain(np.zeros(size), -4.0, -4.0, np.zeros((2, 2)))
    inner = np.flatnonzero(~first)
    inner = inner[inner > 0]
    seen = np.bincount(gold[inner - 1] * 2 + gold[inner], minlength=4).reshape(2, 2)
    want = np.bincount(feats.reshape(-1), weights=np.repeat(gold, feats.shape[1]), minlength=size)
    past = [np.full(size, 1e-6), 1e-6, 1e-6, np.full((2, 2), 1e-6)]
    scale = max(1, int(gold.sum()))
    for _ in range(EPOCHS):
        chance, joint, begun = model.marginals(feats, first, pairs=True)
        have = np.bincount(feats.reshape(-1), weights=np.repeat(chance, feats.shape[1]), minlength=size)
        grads = [(want - have) / scale - DECAY * model.weights / 10, (gold.sum() - chance.sum()) / scale, (gold[first].sum() - begun) / scale, (seen - joint) / scale - DECAY * model.trans]
        past = [p + g * g for p, g in zip(past, grads, strict=True)]
        move = [RATE * g / np.sqrt(p) for g, p in zip(grads, past, strict=True)]
        model = Chain(model.weights + move[0], model.bias + move[1], model.start + move[2], model.trans + move[3])
    return model


def token_labels(feats: np.ndarray, row: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents that have a feature found almost only in toxic documents."""
    marked = np.zeros(len(feats), bool)
    docs, bad = len(toxic), int(toxic.sum())
    for c in range(feats.shape[1]):
        pair = np.unique(row.astype(np.int64) << HASH_BITS | feats[:, c])
        doc, feat = pair >> HASH_BITS, pair & (1 << HASH_BITS) - 1
        k1 = np.bincount(feat, weights=toxic[doc], minlength=1 << HASH_BITS)
        n1 = np.bincount(feat, minlength=1 << HASH_BITS)
        p, q = k1 / np.maximum(n1, 1), bad / docs
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (np.where(k1 > 0, k1 * np.log(p / q), 0) + np.where(n1 > k1, (n1 - k1) * np.log((1 - p) / (1 - q)), 0))
        marked |= ((g2 >= LEAST_G2) & (p >= LEAST_PRECISION) & (k1 >= LEAST_SHARE * bad))[feats[:, c]]
    return (marked & (toxic[row] == 1)).astype(np.int64)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of log(1 + expected toxic words), by Newton steps with a small penalty."""
    w = np.zeros(2)
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - p) - 0.05 * w * [1, 0]
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.05, 1e-6])
        w = w + np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def distinct_texts(texts: pa.Array) -> np.ndarray:
    """Indices of one text of each group of near copies, which would count one word many times.

    Texts that share the least hash of their five-word shingles under any of four orders count as copies.
    """
    data, offsets = tk.text_bytes(texts)
    start, end, row = tk.words(data, offsets)
    keep = np.arange(len(texts))
    if not len(start):
        return keep[:1]
    h, at = tk.shingle_hashes(tk.span_hashes(data, start, end), row, len(texts))
    for salt in (1, 2, 3, 4):
        least = np.zeros(len(texts), np.uint64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        least[at[first]] = np.minimum.reduceat(tk.mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), first)
        keep = keep[np.sort(np.unique(least[keep], return_index=True)[1])]
    return keep


def train(texts: pa.Array, toxic: np.ndarray):
    """The field and the curve from a sample of texts and their labels; None without both labels."""
    keep = distinct_texts(texts) if len(texts) else np.zeros(0, np.int64)
    texts, toxic = texts.take(pa.array(keep, pa.int64())), np.asarray(toxic)[keep]
    if not 0 < toxic.sum() < len(toxic):
        return None
    data, offsets = tk.text_bytes(texts)
    data = folded(data)
    start, end, row = tokens(data, offsets)
    if not len(start):
        return None
    feats = features(data, start, end)
    gold = token_labels(feats, row, toxic)
    first = np.append(True, row[1:] != row[:-1])
    bad, good = np.flatnonzero(toxic == 1)[: TRAIN_DOCS // 2], np.flatnonzero(toxic == 0)[: TRAIN_DOCS // 2]
    use = np.isin(row, np.concatenate([bad, good]))
    model = fit_chain(feats[use], first[use], gold[use])
    count = np.zeros(len(toxic))
    edges = [*range(0, len(toxic), 500), len(toxic)]
    for low, high in zip(edges, edges[1:], strict=False):  # whole documents at a time, for the driver's memory
        part = slice(*np.searchsorted(row, [low, high]))
        count[low:high] = toxic_words(model.marginals(feats[part], first[part]), row[part] - low, high - low)
    return model, fit_curve(np.log1p(count), toxic)


def toxic_words(chance: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the expected number of toxic words, without the many words of very small chance in long texts."""
    return np.bincount(row, weights=np.where(chance >= SURE, chance, 0.0), minlength=rows)


def score_texts(column, model, curve, offsets_wanted: bool = False):
    """Scores of a text column; with ``offsets_wanted`` also the (start, end) code points of words over one half."""
    data, offsets = tk.text_bytes(column)
    data = folded(data)
    start, end, row = tokens(data, offsets)
    first = np.append(True, row[1:] != row[:-1])[: len(row)]
    chance = model.marginals(features(data, start, end), first) if len(start) else np.zeros(0)
    count = toxic_words(chance, row, len(offsets) - 1)
    score = 1 / (1 + np.exp(-np.clip(curve[0] * np.log1p(count) + curve[1], -30, 30)))
    if not offsets_wanted:
        return score
    points = np.concatenate([[0], np.cumsum(tk.code_point_starts(data))])
    spans: list[list] = [[] for _ in range(len(offsets) - 1)]
    for i in np.flatnonzero(chance > 0.5):
        base = points[offsets[row[i]]]
        spans[row[i]].append((int(points[start[i]] - base), int(points[end[i]] - base)))
    return score, spans


def sample_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded training sample: the label rows of least hash, joined to their documents."""
    picked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter("crc32(cast(doc_id AS string)) % 5 <> 0")
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text")
    return short.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")


def toxicity(docs: DataFrame, model, curve, held_out=None) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans for every document, in one pass without a shuffle."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)) if held_out is None else held_out
    source = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in tk.steps(batches):
            if model is None:
                score, spans = np.zeros(batch.num_rows), [[]] * batch.num_rows
            else:
                score, spans = score_texts(batch.column(2), model, curve, True)
            shown = pa.array([",".join(f"{a}:{b}" for a, b in s) for s in spans], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), shown], ["doc_id", "held_out", "score", "predicted", "toxic_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, toxic_spans string")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = sample_rows(docs, labels).toArrow().sort_by("doc_id")
    got = train(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy())
    model, curve = got if got else (None, None)
    return toxicity(docs, model, curve)


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}

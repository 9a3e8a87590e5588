"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its lower-cased words with their counts. For each of ``SAMPLES`` sampling functions,
every term draws r, c from gamma(2, 1) and b uniform from a hash of the term alone; with the term's weight w,
t = floor(log w / r + b) and log a = log c - r (t - b + 1), and the term of least a is the sample. Two texts
agree on a sample with a chance equal to their generalised Jaccard similarity (sum of least over sum of largest
weights). The sample (term, t) fixes a, so the signature keeps the least a's 32-bit pattern.

The next document in id order is found without a global sort in one task: ids are cut into ranges at approximate
quantiles, every range is sorted by itself, and the first document of each range is also given to the range before.

Defined results: null and empty texts have no terms and the fingerprint of a signature of infinities, and are 1.0
alike among themselves; rows with equal or null ids are ordered by text (null ids first, null as empty text);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

SAMPLES = 48
#: Terms that a worker keeps draws of while it works through one batch.
_DRAW_STEP = 20_000

_SALT = tk.mix(np.arange(1, 5 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(5, SAMPLES)


def _uniform(term: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return ((tk.mix(term[:, None] ^ salt[None, :]) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def least_values(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log a of each (term, weight) for all sampling functions."""
    out = np.empty((len(term), SAMPLES), np.float32)
    for i in range(0, len(term), _DRAW_STEP):
        x = term[i : i + _DRAW_STEP]
        u = [_uniform(x, s) for s in _SALT]
        r = -np.log(u[0] * u[1])
        log_c = np.log(-np.log(u[2] * u[3]))
        t = np.floor(np.log(weight[i : i + _DRAW_STEP].astype(np.float32))[:, None] / r + u[4])
        out[i : i + _DRAW_STEP] = log_c - r * (t - u[4] + 1)
    return out


def signatures(texts: list[bytes]) -> np.ndarray:
    """One signature (SAMPLES 32-bit patterns) for each text."""
    data = tk.lower(np.frombuffer(b"".join(texts), np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, row = tk.words(data, offsets)
    out = np.full((len(texts), SAMPLES), np.inf, np.float32)
    if not len(start):
        return out.view(np.uint32)
    word, at = np.unique(tk.span_hashes(data, start, end), return_inverse=True)
    pair, count = np.unique(row.astype(np.int64) * len(word) + at, return_counts=True)
    doc, term = pair // len(word), pair % len(word)
    kinds, which = np.unique(term * (1 << 32) + count, return_inverse=True)
    values = least_values(word[kinds >> 32], kinds & (1 << 32) - 1)
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    for low in range(0, len(first), 256):
        high = min(low + 256, len(first))
        a, b = first[low], first[high] if high < len(first) else len(doc)
        out[doc[first[low:high]]] = np.minimum.reduceat(values[which[a:b]], first[low:high] - a, axis=0)
    return out.view(np.uint32)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _results(rows: list[tuple]) -> list[tuple]:
    """Result rows for (id, text, next text) triples."""
    texts = [r[1] for r in rows]
    changed = [edited(r[1], r[2]) for r in rows]
    sig = signatures([t.encode() for t in [*texts, *changed, *(r[2] for r in rows)]])
    n = len(rows)
    own, new, following = sig[:n], sig[n : 2 * n], sig[2 * n :]
    near_edited, near_next = (own == new).mean(1), (own == following).mean(1)
    return [
        (r[0], len(r[1]), hashlib.sha256(c.encode()).hexdigest(), as_text(own[i]), as_text(new[i]), float(near_edited[i]), float(near_next[i]))
        for i, (r, c) in enumerate(zip(rows, changed, strict=True))
    ]


def id_ranges(docs: DataFrame, count: int) -> list[int]:
    """At most ``count`` ascending cut points of doc_id."""
    cuts = docs.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    return sorted({int(c) for c in cuts})


def range_of(doc_id: Column, cuts: list[int]) -> Column:
    """The number of cut points at or below the id: first among every ``wide``-th cut, then within that stretch."""
    if not cuts:
        return F.lit(0)
    wide = max(1, int(len(cuts) ** 0.5))
    coarse = F.size(F.filter(F.lit(cuts[wide - 1 :: wide]).cast("array<bigint>"), lambda c: c <= doc_id)) * wide
    fine = F.size(F.filter(F.slice(F.lit(cuts).cast("array<bigint>"), coarse + 1, wide), lambda c: c <= doc_id))
    return F.when(doc_id.isNull(), 0).otherwise(coarse + fine)


def neighbour_rows(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt by id range, each range's first row also to the range before; the last range is followed by the first.

    Columns: part (range), place (0 own rows, 1 the row that follows the range), doc_id, text.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = id_ranges(source, partitions)
    source = source.withColumn("part", range_of(F.col("doc_id"), cuts))
    heads = source.groupBy("part").agg(F.min(F.struct("doc_id", F.sha2("text", 256).alias("key"))).alias("head")).orderBy("part").collect()
    ids, keys, before = ([None] * (len(cuts) + 1) for _ in range(3))
    for i, h in enumerate(heads):
        ids[h["part"]], keys[h["part"]], before[h["part"]] = h["head"]["doc_id"], h["head"]["key"], heads[i - 1]["part"]

    def of_part(values, kind):
        return F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("part") + 1)

    is_head = F.col("doc_id").eqNullSafe(of_part(ids, "bigint")) & (F.sha2("text", 256) == of_part(keys, "string"))
    lead = F.when(is_head, of_part(before, "int"))
    own = F.struct(F.col("part"), F.lit(0).alias("place"))
    copy = F.struct(lead.alias("part"), F.lit(1).alias("place"))
    both = source.select("doc_id", "text", F.explode(F.array_compact(F.array(own, F.when(lead.isNotNull(), copy)))).alias("to"))
    return both.select("to.part", "to.place", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    spark = docs.sparkSession
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = neighbour_rows(docs, count).repartitionById(count, "part").sortWithinPartitions("part", "place", "doc_id", F.sha2("text", 256))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        held, waiting, size = None, [], 0

        def flush():
            out = list(zip(*_results(waiting), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            part, place, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            for p, own, i, text in zip(part, place, ids, texts, strict=True):
                if held is not None and held[0] == p:
                    waiting.append((held[1], held[2], text))
                    size += 2 * len(held[2]) + len(text)
                held = (p, i, text) if own == 0 else None
                if size >= tk.STEP_BYTES:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op4_weighted_fingerprint(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_weighted_fingerprint": op4_weighted_fingerprint}
ORACLES: dict[str, str] = {}

"""Quality rules: word and line counts, then zstandard compression bands.

A text's compression ratio (compressed / raw UTF-8 bytes) says how repetitive it is. Short texts compress badly
whatever they hold, so each length band has its own limits; fixed chunks find a repetitive or random stretch in
a text whose whole ratio looks ordinary. A text of one chunk or less is its own chunk; under CHUNK_LEAST bytes its length
band alone judges it.

Defined results: a null or empty text has no words, ratio null and is not kept (fewer than 20 words); a very long text is
measured whole; rows are judged one by one, so ties and repeated rows don't matter; an empty table gives no rows; other columns pass through unread, and an input
column named like a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: (bytes up to, lowest ratio, highest ratio) of whole texts; the last band has no upper length.
WHOLE_BANDS = (
    (128, 0.35, 1.30),
    (256, 0.30, 1.10),
    (512, 0.28, 0.95),
    (1024, 0.26, 0.88),
    (2048, 0.24, 0.82),
    (4096, 0.22, 0.78),
    (16384, 0.20, 0.75),
    (float("inf"), 0.18, 0.72),
)
CHUNK_BYTES, CHUNK_LEAST, CHUNK_BAND, CHUNK_SHARE, LEVEL = 2048, 512, (0.15, 0.88), 0.34, 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, bad_chunk_share double, kept boolean"
)


def repeated_words(word_hash: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the number of words inside windows of 8 words that occur twice or more in that row."""
    m = len(word_hash) - WINDOW + 1
    if m <= 0:
        return np.zeros(rows, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        h += word_hash[i : i + m] * np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 + 2 * i & (1 << 64) - 1 | 1)
    inside = row[:m] == row[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    h = tk.mix(h[at] + row[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    cover = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + WINDOW, -1)
    return np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=rows)


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, word_start: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the lines that have a word and equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(rows, np.int64)
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end = start[has_word], end[has_word]
    row = np.searchsorted(offsets, start, "right") - 1
    h = tk.mix(tk.span_hashes(data, start, end) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(h, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


def verdict(size: int, ratio: float, bad_share: float) -> bool:
    low, high = next((lo, hi) for most, lo, hi in WHOLE_BANDS if size <= most)
    return low <= ratio <= high and bad_share < CHUNK_SHARE


def measure(column) -> list[pa.Array]:
    """The result columns of FIELDS for one Arrow column of texts."""
    data, offsets = tk.text_bytes(column)
    rows = len(offsets) - 1
    start, end, row = tk.words(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    points = np.concatenate([[0], np.cumsum(tk.code_point_starts(data))])
    word_chars = tk.segment_sums(points[end] - points[start], row, rows)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    running = np.concatenate([[0], np.cumsum(symbol[data])])
    n_symbols = running[offsets[1:]] - running[offsets[:-1]]
    repeats = repeated_words(tk.span_hashes(data, start, end), row, rows)
    dup_lines = duplicate_lines(data, offsets, start, rows)
    failed = (n_words < 20) | (100 * repeats > 30 * n_words)
    press = zstandard.ZstdCompressor(level=LEVEL)
    ratio, share, kept = [None] * rows, [None] * rows, np.zeros(rows, bool)
    raw = data.tobytes()
    for i in np.flatnonzero(np.diff(offsets) > 0):
        text = raw[offsets[i] : offsets[i + 1]]
        ratio[i] = len(press.compress(text)) / len(text)
        if len(text) <= CHUNK_BYTES:
            bad = [not CHUNK_BAND[0] <= ratio[i] <= CHUNK_BAND[1]] if len(text) >= CHUNK_LEAST else []
        else:  # the last chunk reaches back into the one before, so that every byte is in a whole chunk
            starts = [*range(0, len(text) - CHUNK_BYTES, CHUNK_BYTES), len(text) - CHUNK_BYTES]
            bad = [not CHUNK_BAND[0] <= len(press.compress(text[j : j + CHUNK_BYTES])) / CHUNK_BYTES <= CHUNK_BAND[1] for j in starts]
        share[i] = sum(bad) / len(bad) if bad else 0.0
        kept[i] = not failed[i] and verdict(len(text), ratio[i], share[i])
    counts = [pa.array(x.astype(np.int64)) for x in (n_words, word_chars, n_symbols, dup_lines, repeats)]
    return [*counts, pa.array(failed), pa.array(ratio, pa.float64()), pa.array(share, pa.float64()), pa.array(kept)]


def quality_rules(docs: DataFrame, text: str = "text", passing: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (all columns, or those of ``passing``) with the columns of FIELDS, in one pass without a shuffle."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    keep = [c for c in (docs.columns if passing is None else passing) if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in tk.steps(batches, "__text"):
            k = batch.schema.get_field_index("__text")
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(k)] + measure(batch.column(k)), [*keep, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"] + [FIELDS])
    return source.mapInArrow(run, schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, passing=("doc_id",))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, columns unchanged."""
    tk.bounded_arrow(spark)
    k = docs.columns.index("text")

    def run(batches):
        for batch in tk.steps(batches):
            yield batch.filter(measure(batch.column(k))[-1])

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES: dict[str, str] = {}

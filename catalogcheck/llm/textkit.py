"""Vectorised helpers over Arrow text columns, shared by the corpus operators.

Python code of these operators runs inside ``mapInArrow``: Spark partitions and shuffles the rows, and each
task works through its record batches a bounded number of bytes at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one vectorised step handles; a longer single text is handled alone.
STEP_BYTES = 1 << 19

_MULT = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: ASCII white space of the word rule: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def bounded_arrow(spark) -> None:
    """Keep Arrow batches small, so that Python workers hold a few MB of text whatever the documents' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the offsets of its rows; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece has at most ``size`` text bytes, or one row."""
    k = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.schema.get_field_index(column)
        at = text_bytes(batch.column(k))[1]
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high
    trim()


def trim() -> None:
    """Gives the memory that a finished task's arrays have left to the system: workers serve many tasks, of many operators."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(n: int, mult: int) -> np.ndarray:
    out = np.full(n + 1, mult, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(n: int, mult: int) -> np.ndarray:
    """mult ** 0 .. mult ** n modulo 2 ** 64."""
    got = _CACHE.get(mult)
    if got is None or len(got) <= n:
        got = _CACHE[mult] = _powers(max(n, 5 << 18), mult)
    return got[: n + 1]


_INVERSE = pow(_MULT, -1, 1 << 64)
#: Longer spans are hashed in pieces of this many bytes, and then the pieces' hashes as a span of their own.
_PIECE = 256
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal byte strings have equal hashes wherever they stand.

    Blocks of eight bytes go through the finaliser one after the other, so no sum of them decides.
    """
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    far = np.flatnonzero(size > _PIECE)
    at, left, active = start, size, np.arange(len(size))
    if len(far):
        pieces = -(-size[far] // _PIECE)
        edges = np.concatenate([[0], np.cumsum(pieces)])
        low = np.repeat(start[far], pieces) + (np.arange(edges[-1]) - np.repeat(edges[:-1], pieces)) * _PIECE
        inner = span_hashes(data, low, np.minimum(low + _PIECE, np.repeat(end[far], pieces))).view(np.uint8)
        h[far] = mix(h[far] ^ span_hashes(inner, edges[:-1] * 8, edges[1:] * 8))
        active = np.flatnonzero(size <= _PIECE)
        at, left = start[active], size[active]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    while len(active := active[go := left > 0]):
        at, left = at[go], left[go]
        block = blocks[at]
        short = left < 8
        block[short] &= _LOW_BYTES[left[short]]
        h[active] = mix(h[active] ^ block)
        at, left = at + 8, left - 8
    return h


def running_hash(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data), _MULT)[: len(data)], out=total[1:])
    return total


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` bytes from every place that has as many."""
    total = running_hash(data)
    h = total[width:] - total[:-width]
    h *= powers(len(data), _INVERSE)[: len(h)]
    h += np.full(1, width, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run without ASCII white space) and the row that it stands in."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a word may run over the end of a row: cut it there
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        cut = inner[(~_SPACE[data[inner]]) & (~_SPACE[data[inner - 1]])]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def code_point_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def shingle_hashes(word_hash: np.ndarray, row: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; a row with fewer words but at least one has all its words as one.

    The order of words matters: each place has its own odd factor.
    """
    n = len(word_hash)
    factor = [np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1) for i in range(k)]
    m = max(0, n - k + 1)
    whole = row[:m] == row[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h += word_hash[i : i + m] * factor[i]
    h, at = mix(h[whole]), row[:m][whole]
    count = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            on = count[few] > i
            extra[on] += word_hash[first[few[on]] + i] * factor[i]
        extra = mix(extra + count[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        h, at = np.concatenate([h, extra]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def segment_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)


def as_strings(items: list) -> pa.Array:
    return pa.array(items, pa.string())

def shared_folder(spark) -> str:
    """The folder that driver and executors share, from the cluster's settings; a local run has one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or "/tmp/checkpoints"


#: Bits of a membership filter; fixed, so that what is sent to the tasks doesn't grow with the data. In a larger
#: corpus the filter passes more rows that the following join or sort drops: it saves work, it decides nothing.
FILTER_BITS = 26


def filter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(h.astype(np.uint64))
    shift = np.uint64(64 - FILTER_BITS)
    return h >> shift, mix(h + np.uint64(1)) >> shift


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each value; never False for a value it was built from."""
    a, b = filter_places(h)

    def on(p):
        return (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)

    return (on(a) & on(b)).astype(bool)


def first_long(batch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def membership_filter(values, hashed=first_long) -> np.ndarray:
    """A fixed-size bit filter of a DataFrame's rows, by default of its single long column, built on the executors.

    Tasks turn values into (word, bits); bit_or merges them, at most 2 ** (FILTER_BITS - 6) rows in all.
    """
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            h = hashed(batch)
            p = np.concatenate(filter_places(h))
            word, bit = p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63))
            kinds, at = np.unique(word, return_inverse=True)
            out = np.zeros(len(kinds), np.uint64)
            np.bitwise_or.at(out, at, bit)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int32)), pa.array(out.view(np.int64))], ["word", "bits"])

    merged = values.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[merged.column("word").to_numpy()] = merged.column("bits").to_numpy().view(np.uint64)
    return out


def new_folder(spark, name: str) -> str:
    """A fresh folder for a written table, in the shared place."""
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df, name: str):
    """The frame written as Parquet in the shared folder and read again: its lineage ends there."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written_by_key(df, name: str, key: str):
    """Like ``written``, as a table bucketed by a column: later joins on it don't shuffle this side."""
    import uuid

    spark = df.sparkSession
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = f"{name}_{uuid.uuid4().hex}"
    out = df.repartition(count, key).write.format("parquet").bucketBy(count, key).sortBy(key)
    out.option("path", new_folder(spark, name)).saveAsTable(table)
    return spark.table(table)

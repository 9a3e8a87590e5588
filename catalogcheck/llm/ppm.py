"""Language-model scores by prediction by partial matching over bytes, trained on one part of the corpus.

A text is scored as its token stream: A-Z in lower case, every word followed by one space, then one end symbol. The
model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of what followed them in training texts. A
symbol's probability comes from its longest known context; where that context never saw it, the escape probability is
paid and the next shorter context decides, without the symbols that the longer one has ruled out (symbol exclusion).
Escapes are estimated by method D: of a context with T occurrences of q different symbols, a symbol seen c times has
(c - 1/2) / T, escape has q / (2 T). Below the empty context all symbols left over are equally likely.

What a longer context saw, its shorter ones saw too. So the exclusions at a context are the symbols of the next longer
one alone, and the probability of a symbol after escape is a property of (context, symbol), found order by order:

    R(c, s) = the rest of s after c escapes = (count in c' - 1/2) / T'  or  q' / (2 T') R(c', s),

c' being c without its first byte, T' and q' its counts without the symbols of c. Trie levels are tables of packed
strings (context and symbol in one long), and one join with the level below and one window over the context's symbols
give each level its R and its probabilities.

The trie isn't broadcast. Each task cuts its texts into blocks and lists each block's different strings; the lists are
merged by shards of the string space into the trie's lowest level, scored strings go back to the shards, answer
the lists, and each block meets its answers and adds them up by document. Rows are packed lists, so the number of rows
follows the text, and what a task holds is a block or the different strings of one shard.

Defined results: null and empty texts, and texts of white space alone, are one end token; rows with null ids count as
training rows (crc32 of no text is 0), and repeated rows and ids are rows of their own; without training rows every
symbol has 1 / ``ALPHABET`` and the base is log10(1/1) a token; an empty table gives no rows; a very long text
is a block of its own and is scored whole; columns other than doc_id and text are not read. Words of the base
score are told apart by 64-bit hashes. Log probabilities travel as 32-bit floats and are summed as doubles: a score's relative
error is below 1e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

#: Bytes of the longest context.
ORDER = 5
#: Symbols that can follow a context: bytes that aren't white space, the space between words, the end.
ALPHABET = 252
END = 10
#: Stream bytes of a block, text bytes of a step within it, entries that wait to be merged.
BLOCK_BYTES, STEP, PENDING = 16 << 20, 1 << 20, 3 << 20
#: Shards of the string space; more of them make the lists' rows smaller, not their sum.
MOST_SHARDS = 1023
FOLDS, HELD_FOLD = 7, 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def streams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token streams of a text column laid end to end, each after ORDER zero bytes; their offsets; word hashes and their rows."""
    raw, offsets = tk.text_bytes(column)
    data, rows = tk.lower(raw), len(offsets) - 1
    start, end, row = tk.words(data, offsets)
    per_row = np.bincount(row, minlength=rows)
    held_bytes = np.bincount(row, weights=end - start, minlength=rows).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(held_bytes + per_row + ORDER + 1)]).astype(np.int64)
    out = np.full(bounds[-1], 32, np.uint8)
    out[(bounds[:-1, None] + np.arange(ORDER)).ravel()] = 0
    out[bounds[1:] - 1] = END
    size = end - start
    first = np.cumsum(size) - size
    place = first + np.arange(len(size)) + row * (ORDER + 1) + ORDER
    solid = ~tk.is_space(data)
    out[np.repeat(place - first, size) + np.arange(int(size.sum()))] = data[solid]
    return out, bounds, tk.span_hashes(data, start, end), row


def strings(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with the ORDER bytes before it, packed in a long, and the first string of each row."""
    n = len(stream) - ORDER
    g = np.zeros(max(n, 0), np.uint64)
    for i in range(ORDER + 1):
        g <<= np.uint64(8)
        g |= stream[i : i + n]
    real = np.ones(len(g), bool)
    for i in range(1, ORDER + 1):  # strings that end on the zero bytes before a later row
        at = bounds[1:-1] - i
        real[at[at >= 0]] = False
    return g[real], bounds[:-1] - np.arange(len(bounds) - 1) * ORDER


def merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different keys with their summed counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


class Tally:
    """Different keys and their counts, merged whenever enough of them wait."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > PENDING:
            self.result()

    def count(self, keys: np.ndarray, training: np.ndarray) -> None:
        """Keys of training rows count once each, the others only become known."""
        self.add(*np.unique(keys[training], return_counts=True))
        rest = np.unique(keys[~training])
        self.add(rest, np.zeros(len(rest), np.int64))

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merged(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [k], [c], 0
        return k, c


class Lookup:
    """Values of ascending keys, by a table of hash slots; where two keys share one, by search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[(keys * _ODD) >> self.shift] = np.arange(len(keys))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        if not len(wanted):
            return self.values[:0]
        at = self.slot[(wanted * _ODD) >> self.shift]
        other = np.flatnonzero(self.keys[at] != wanted)
        at[other] = np.searchsorted(self.keys, wanted[other])
        return self.values[at]


def packed(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first bytes, then all second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


_BLOCKS = "block long, shard int, ids array<long>, training array<boolean>, data binary, counts binary"
_TYPES = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
_NAMES = ["block", "shard", "ids", "training", "data", "counts"]


def _row(*fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f], t) for f, t in zip(fields, _TYPES, strict=True)], _NAMES)


def text_blocks(docs: DataFrame, shards: int) -> DataFrame:
    """Written rows of two sorts: a step's ids and streams (shard null), and a block's different strings of one shard (data,
    counts in training). Shards from ``shards`` on hold words, as hashes."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~held).alias("training"))

    def run(batches):
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 24, 0
        grams, words = Tally(), Tally()

        def lists():
            for tally, base in ((grams, 0), (words, shards)):
                keys, counts = tally.result()
                of = (keys % np.uint64(shards)).astype(np.int32)
                order = np.argsort(of, kind="stable")
                edges = np.searchsorted(of[order], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(edges)):
                    part = order[edges[s] : edges[s + 1]]
                    yield _row(block, base + s, None, None, packed_keys(keys[part]), packed(counts[part]))

        for step in tk.steps(batches, size=STEP):
            stream, bounds, word, row = streams(step.column(1))
            training = step.column(2).to_numpy(zero_copy_only=False).astype(bool)
            g, first = strings(stream, bounds)
            grams.count(g, np.repeat(training, np.diff(np.append(first, len(g)))))
            words.count(word, training[row])
            yield _row(block, None, step.column(0).to_pylist(), training.tolist(), zstandard.ZstdCompressor(level=3).compress(stream.tobytes()), None)
            size += len(stream)
            if size >= BLOCK_BYTES:
                yield from lists()
                block, size, grams, words = block + 1, 0, Tally(), Tally()
        if size:
            yield from lists()

    return tk.written(rows.mapInArrow(run, _BLOCKS), "ppm-blocks")


def counted(blocks: DataFrame) -> DataFrame:
    """shard, key, n of every different string and word: the shards' lists merged as they stream by."""
    lists = blocks.where("shard IS NOT NULL").select("shard", "data", "counts").repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        at, tally = None, Tally()

        def out():
            keys, counts = tally.result()
            for low in range(0, len(keys), 100_000):
                k = keys[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), at, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[low : low + 100_000])], ["shard", "key", "n"])

        for batch in batches:
            for shard, data, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != at:
                    if at is not None:
                        yield from out()
                    at, tally = shard, Tally()
                tally.add(unpacked_keys(data), unpacked(counts, np.int64))
        if at is not None:
            yield from out()
        tk.trim()

    return lists.mapInArrow(run, "shard int, key long, n long")


def probabilities(grams: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """key, p of every string of ``order`` bytes and a symbol, from their counts ``n``: one join and one window a level."""

    def level(k: int) -> DataFrame:
        keep = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        rows = grams.select("key", "n") if k == order else grams.groupBy(keep.alias("key")).agg(F.sum("n").alias("n"))
        context = Window.partitionBy(F.shiftright("key", 8))
        return rows.withColumns({"t": F.sum("n").over(context), "q": F.count(F.when(F.col("n") > 0, 1)).over(context)})

    seen = F.col("n") > 0

    def finished(rows: DataFrame) -> DataFrame:
        p = F.when(F.col("t") == 0, F.col("below_p")).when(seen, (F.col("n") - 0.5) / F.col("t")).otherwise(F.col("q") / (2 * F.col("t")) * F.col("r"))
        return rows.select("key", "n", "t", "q", "r", p.alias("p"))

    rest = F.lit(1.0) / F.greatest(F.lit(alphabet) - F.col("q"), F.lit(1))
    done = finished(level(0).withColumns({"r": rest, "below_p": F.lit(1.0 / alphabet)}))
    for k in range(1, order + 1):
        own = level(k).withColumn("lower", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        below = done.select(F.col("key").alias("lower"), *(F.col(c).alias(f"below_{c}") for c in "ntqrp"))
        both = own.join(below, "lower")
        used = F.sum(F.when(seen, F.col("below_n"))).over(Window.partitionBy(F.shiftright("key", 8)))
        both = both.withColumns({"t_left": F.col("below_t") - F.coalesce(used, F.lit(0)), "q_left": F.col("below_q") - F.col("q")})
        r = (
            F.when(F.col("q_left") <= 0, F.col("below_r"))
            .when(F.col("below_n") > 0, (F.col("below_n") - 0.5) / F.col("t_left"))
            .otherwise(F.col("q_left") / (2 * F.col("t_left")) * F.col("below_r"))
        )
        done = finished(both.withColumn("r", r))
    return done.select("key", "p")


def answered(blocks: DataFrame, values: DataFrame, shards: int) -> DataFrame:
    """block, shard, data, counts: every list again, with its keys' values in place of its counts: 32-bit log probabilities
    of strings, counts of words as doubles."""
    lists = blocks.where("shard IS NOT NULL").select("shard", "block", "data")
    known = values.select("shard", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("data"), "key", "value")
    both = lists.withColumns({"key": F.lit(None).cast("long"), "value": F.lit(None).cast("double")}).unionByName(known)
    dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first())

    def run(batches):
        at, keys, numbers, table = None, [], [], None
        for batch in batches:
            shard = batch.column(0).to_numpy()
            is_list = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (is_list[1:] != is_list[:-1]) | is_list[1:])) if len(shard) else []
            for low, high in zip(edges, [*edges[1:], len(shard)], strict=True):
                if shard[low] != at:
                    at, keys, numbers, table = shard[low], [], [], None
                if not is_list[low]:
                    keys.append(batch.column(3).slice(low, high - low).to_numpy().view(np.uint64))
                    numbers.append(batch.column(4).slice(low, high - low).to_numpy())
                    continue
                if table is None:
                    k, v = np.concatenate(keys), np.concatenate(numbers)
                    order = np.argsort(k)
                    table, keys, numbers = Lookup(k[order], v[order]), [], []
                data = batch.column(2)[low].as_py()
                found = table(unpacked_keys(data)).astype(np.float32 if at < shards else np.float64)
                yield _row(batch.column(1)[low].as_py(), int(at), None, None, data, packed(found))
        tk.trim()

    return dealt.mapInArrow(run, _BLOCKS)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    tk.bounded_arrow(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = min(MOST_SHARDS, size // BLOCK_BYTES | 1)
    blocks = text_blocks(docs, shards)
    counts = tk.written(counted(blocks), "ppm-counts")
    words = counts.where(F.col("shard") >= shards)
    grams = counts.where(F.col("shard") < shards)
    ends = blocks.where("shard IS NULL").select(F.size(F.filter("training", lambda t: t)).alias("m")).agg(F.sum("m")).first()[0] or 0
    total, kinds = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total, kinds = (total or 0) + ends, kinds + (ends > 0)
    logs = probabilities(grams).select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", F.log10("p").alias("value"))
    values = logs.unionByName(words.select("shard", "key", F.col("n").cast("double").alias("value")))
    both = blocks.where("shard IS NULL").unionByName(answered(blocks, values, shards))
    dealt = both.repartition("block").sortWithinPartitions("block", F.col("shard").asc_nulls_last())
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        at, held, tables = None, ([], [], [], []), None

        def table(keys, values):
            k, v = (np.concatenate(keys), np.concatenate(values)) if keys else (np.zeros(1, np.uint64), np.zeros(1))
            order = np.argsort(k)
            return Lookup(k[order], v[order])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    at, held, tables = row["block"], ([], [], [], []), None
                if row["shard"] is not None:
                    base = 2 * (row["shard"] >= shards)
                    held[base].append(unpacked_keys(row["data"]))
                    held[base + 1].append(unpacked(row["counts"], np.float64 if base else np.float32))
                    continue
                if tables is None:
                    tables, held = (table(*held[:2]), table(*held[2:])), ([], [], [], [])
                stream = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
                # a stream ends with its only end byte and begins with zeros
                bounds = np.append(0, np.flatnonzero(stream == END) + 1)
                g, first = strings(stream, bounds)
                score = np.add.reduceat(tables[0](g).astype(np.float64), first)
                at_word = bounds[:-1] + ORDER
                solid = (stream != 32) & (stream != END)
                for i in range(ORDER):
                    solid[bounds[:-1] + i] = False
                edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                of = np.searchsorted(at_word, start, "right") - 1
                c = tables[1](tk.span_hashes(stream, start, end))
                n = len(bounds) - 1
                base = np.bincount(of, weights=np.log10((c + 1) / (total + kinds + 1)), minlength=n) + np.log10((ends + 1) / (total + kinds + 1))
                known = np.bincount(of, weights=c > 0, minlength=n).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(~np.array(row["training"], bool)), pa.array(np.bincount(of, minlength=n) + 1),
                        pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(score),
                    ],
                    names,
                )
        tk.trim()

    return dealt.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op12_partial_matching(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_partial_matching": op12_partial_matching}
ORACLES: dict[str, str] = {}

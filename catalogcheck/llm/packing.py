"""Best-fit packing of token sequences by minimum bin slack.

Documents become token ids once; only pieces' lengths matter for packing, and there are at most ``CAPACITY`` of
them, so the plan is made from the histogram of lengths: its size doesn't depend on the corpus. Per bin, the largest
remaining length is put in, and a subset-sum table over the remaining lengths (one bit per reachable sum, in
one integer) finds the fullest combination that fits; equal bins are taken as often as the counts allow.

Pieces get a rank among those of their length (counted per length and hash bucket, so that a length shared by a third
of all pieces is ranked by many tasks) and the plan maps length and rank to a sequence and an offset.

Defined results: ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, so an added token that stands in a
text is its one id; a null or empty text is the closing id alone; equal texts and repeated rows are packed each; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

CAPACITY, CLOSING_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Bytes of remembered words' ids that a worker keeps, with OVERHEAD for each word; words that go to the tokenizer at once.
REMEMBERED, OVERHEAD, AT_ONCE = 48 << 20, 160, 4096
#: Stands between words that are encoded together; a character of the private use area.
BETWEEN = "\ue000"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?)]}%$&*#|\"")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def apart(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray):
    """Words with closing punctuation after an ASCII letter or digit or a Latin-1 letter as words of their own.

    The tokenizer splits there too, and fewer distinct words are left.
    """
    if not len(start):
        return start, end, row
    closing = _CLOSING[data]
    place = np.arange(len(data))
    last = np.maximum.accumulate(np.where(closing, -1, place))  # the last byte at or before each that doesn't close
    body = np.maximum(last[end - 1], start - 1) + 1
    before = np.maximum(body - 1, 0)
    lead = data[np.maximum(body - 2, 0)]
    letter = _LETTER[data[before]] | ((lead == 0xC3) & (data[before] >= 0x80) & (data[before] != 0x97) & (data[before] != 0xB7))
    cut = np.flatnonzero((body > start) & (body < end) & letter)
    order = np.argsort(np.concatenate([start, body[cut]]), kind="stable")
    ends = end.copy()
    ends[cut] = body[cut]
    return np.concatenate([start, body[cut]])[order], np.concatenate([ends, end[cut]])[order], np.concatenate([row, row[cut]])[order]


class WordEncoder:
    """Ids of texts through a tokenizer that splits at white space, asking it once for each distinct word. Texts that
    hold one of its added tokens, which have ids of their own, go to it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # two generations: words of the older one that come again move to the newer, the others go with it
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        self.held = 0
        self.between = np.array(self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids, "<u4")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes. Words go to the tokenizer as one text with a mark after each."""
        text = f" {BETWEEN} ".join([*words, ""])
        if text.count(BETWEEN) != len(words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        wide = len(self.between)
        hit = np.ones(len(ids) - wide + 1, bool)
        for i, x in enumerate(self.between):
            hit &= ids[i : len(hit) + i] == x
        mark = np.flatnonzero(hit)
        if len(mark) != len(words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        start = np.concatenate([[0], mark[:-1] + wide])
        return [ids[a:b].tobytes() for a, b in zip(start, mark, strict=True)]

    def with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose lower-case bytes hold an added token in lower case, so every row that may hold one."""
        raw, rows = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                inside = at + len(token) <= offsets[row + 1]
                if inside:
                    rows.add(row)
                at = raw.find(token, int(offsets[row + 1]) if inside else at + 1)
        return np.array(sorted(rows), np.int64)

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column laid end to end, each row closed by CLOSING_ID, and the rows' offsets in them."""
        data, offsets = tk.text_bytes(column)
        rows = len(offsets) - 1
        data = tk.lower(data)  # the tokenizer does so too
        start, end, row = tk.words(data, offsets)
        held = self.with_added(data, offsets)
        if len(held):
            own = ~np.isin(row, held)
            start, end, row = start[own], end[own], row[own]
        start, end, row = apart(data, start, end, row)
        kinds, first, which = np.unique(tk.span_hashes(data, start, end), return_index=True, return_inverse=True) if len(start) else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
        if self.held > REMEMBERED // 2:
            self.known, self.older, self.held = {}, self.known, 0
        keys = kinds.tolist()
        fresh = []
        for i in [i for i, k in enumerate(keys) if k not in self.known]:
            if (ids := self.older.get(keys[i])) is None:
                fresh.append(i)
            else:
                self.known[keys[i]] = ids
                self.held += len(ids) + OVERHEAD
        if fresh:
            raw = data.tobytes()
            for low in range(0, len(fresh), AT_ONCE):
                part = fresh[low : low + AT_ONCE]
                words = [raw[start[first[i]] : end[first[i]]].decode("utf-8", "replace") for i in part]
                for i, ids in zip(part, self.encode_words(words), strict=True):
                    self.known[keys[i]] = ids
                    self.held += len(ids) + OVERHEAD
        coded = [self.known[k] for k in keys]
        flat = np.frombuffer(b"".join(coded), "<u4")
        size = np.array([len(c) // 4 for c in coded], np.int64)
        place = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else size
        each = size[which] if len(which) else np.zeros(0, np.int64)
        whole = [np.array(self.tokenizer.encode(column[int(r)].as_py(), add_special_tokens=False).ids, "<u4") for r in held]
        extra = np.zeros(rows, np.int64)
        extra[held] = [len(x) for x in whole]
        total = np.bincount(row, weights=each, minlength=rows).astype(np.int64) + extra + 1
        edges = np.concatenate([[0], np.cumsum(total)])
        out = np.full(edges[-1], CLOSING_ID, "<u4")
        if len(each):
            before = np.cumsum(each) - each
            source = np.arange(each.sum()) + np.repeat(place[which] - before, each)
            out[np.arange(each.sum()) + np.repeat(row + (np.cumsum(extra) - extra)[row], each)] = flat[source]
        for r, x in zip(held, whole, strict=True):
            out[edges[r] : edges[r] + len(x)] = x
        return out, edges


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder of this tokenizer, with the words of the tasks before."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids cut into pieces of CAPACITY."""
    path = path or tokenizer_path()
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        encoder = encoder_of(path)
        for batch in tk.steps(batches):
            ids, edges = encoder.ids(batch.column(1))
            count = np.maximum(1, -(-np.diff(edges) // CAPACITY))
            row = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * CAPACITY
            length = np.minimum(CAPACITY, np.diff(edges)[row] - start)
            raw, low = ids.tobytes(), (edges[:-1][row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low, low + length * 4, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long".replace("piece int", "piece long")).withColumn("piece", F.col("piece").cast("int"))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths with the largest sum up to ``room``: subset sums as the bits of one integer."""
    sums, taken, mask = 1, [], (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length) if length <= room else 0
        copies = 1
        while most > 0 and not sums >> room & 1:
            k = min(copies, most)
            taken.append((length, k, sums))
            sums |= sums << length * k & mask
            most, copies = most - k, copies * 2
        if sums >> room & 1:
            break
    left, out = sums.bit_length() - 1, {}
    for length, k, before in reversed(taken):
        if not before >> left & 1:
            out[length] = out.get(length, 0) + k
            left -= length * k
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination of lengths, number of such bins), until every piece is placed."""
    counts, plan = {k: n for k, n in counts.items() if n > 0}, []
    while counts:
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        if not rest[largest]:
            del rest[largest]
        combination = fullest(rest, capacity - largest)
        combination[largest] = combination.get(largest, 0) + 1
        times = min(counts[k] // m for k, m in combination.items())
        plan.append((combination, times))
        for k, m in combination.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
    return plan


def plan_table(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a bin, offset in the bin), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for combination, times in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            copies = combination[length]
            rows.append((length, used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(length: np.ndarray, rank: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece of each length and rank (from 0)."""
    row = table[np.searchsorted((table[:, 0] << 48) + table[:, 1], (length << 48) + rank, "right") - 1]
    bin_, copy = np.divmod(rank - row[:, 1], row[:, 3])
    return row[:, 2] + bin_, row[:, 4] + copy * length


def pack(cut: DataFrame) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32; read more than once) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most CAPACITY rows
    table = plan_table(plan_bins(counts))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    ahead = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    ahead = ahead.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(ahead, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("own") - 1).alias("rank"))

    def run(batches):
        for batch in batches:
            sequence, offset = place(batch.column(3).to_numpy(), batch.column(5).to_numpy(), table)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents to pieces (written once to the shared folder, since the plan reads them too) to sequences."""
    spark = docs.sparkSession
    folder = f"{tk.shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    pieces(docs, path).write.parquet(folder)
    return pack(spark.read.parquet(folder))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the kept documents' pieces, placed in sequences."""
    tk.bounded_arrow(spark)
    return packed(docs)


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}

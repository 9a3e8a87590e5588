"""Suffix-array dedup: removes every byte covered by a 200-byte string that starts anywhere else too.

A distributed suffix array needs suffixes that may match in one place. Every 200-byte string is filed under its
anchor, the leftmost 24-byte substring of least hash in it: equal strings have equal anchors. Strings that follow one
another mostly share their anchor, so what is filed is a stretch: the run of starts with one anchor, and the bytes
they span (about 280 for 85 starts).

1. Count anchors over all documents (pre-aggregated in the tasks). An anchor that occurs once has no repeated string.
2. Write the stretches of repeated anchors (place and hashes, no bytes), and collapse equal stretches to one
   representative with its number of copies. One with copies is settled: all its starts are repeated.
3. A 200-byte string holds its anchor and 176 other bytes, so at least 88 before it or 88 behind it. Two representatives
   can share a string only if they agree in one such side (anchor and 88 bytes). Only those whose side occurs in
   another one, and in one without copies, go on; the others have copies or nothing.
4. Gather their bytes by anchor. Each task lays them end to end in chunks of bounded size, sorts their
   suffixes in two stages (``suffixes``) and compares neighbours: a common prefix of 200 bytes, or a stretch that
   has copies, makes a start repeated.
5. An anchor with very many different stretches is dealt to several tasks, and a stretch list longer than a chunk is
   cut. What such chunks keep apart meets by the hash of the whole 200-byte string, one row per string and chunk.
6. Repeated starts go back to all copies of their stretch, become byte runs per document, and are cut out. Stretches with
   very many copies are sent to all tasks, so that their copies needn't meet in one.

Membership filters of fixed size keep most rows out of the shuffles; they only drop rows that can't matter.

Defined results: a null text is empty; texts under 200 bytes lose nothing; a very long text is worked on slice
by slice; overlapping strings count; rows that are
repeated whole (same id and text) are copies of each other; documents are told apart by a hash of id and text, so
a null or repeated id is no trouble; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from . import textkit as tk

LENGTH, ANCHOR = 200, 24
CHUNK_BYTES, STEP = 1 << 19, 1 << 19
#: Bytes before or behind the anchor of which every string has one side whole.
SIDE = -(-(LENGTH - ANCHOR) // 2)
#: An anchor is dealt to SALTS tasks from this many occurrences on, and a stretch to all; at most MOST_HOT of them can pass.
HOT, MOST_HOT, SALTS = 20_000, 100_000, 32
_PLACE_BITS = np.uint64(28)
#: Bytes that are worked on at once, of however long a text.
SLICE = 1 << 24
#: Longs of 60 bits for the starts of a stretch, of which there are at most LENGTH - ANCHOR + 1.
MASKS = -(-(LENGTH - ANCHOR + 1) // 60)


def window_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window, from those of windows of half the width and more."""
    if len(v) < width:
        return np.zeros(0, v.dtype)
    reach = 1
    while 2 * reach <= width:
        v = np.minimum(v[:-reach], v[reach:])
        reach *= 2
    return np.minimum(v[: len(v) - width + reach], v[width - reach :])


def stretches(data: np.ndarray, offsets: np.ndarray):
    """(row, first start in the text, number of starts, start in data, the anchor's place in data, anchor hash) of all stretches."""
    none = (np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.uint64),)
    size = np.diff(offsets)
    if not (size >= LENGTH).any():
        return none
    if len(data) > SLICE + LENGTH - 1:  # slice by slice, each with the bytes that its last strings need
        parts = []
        for low in range(0, len(data), SLICE):
            edges = np.clip(offsets, low, min(len(data), low + SLICE + LENGTH - 1)) - low
            row, start, count, first, at, key = stretches(data[low : low + edges[-1]], edges)
            parts.append((row, start + edges[row] + low - offsets[row], count, first + low, at + low, key))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    h = tk.window_hashes(data, ANCHOR)
    packed = h >> _PLACE_BITS << _PLACE_BITS
    packed |= np.arange(len(h), dtype=np.uint64)
    anchor = (window_least(packed, LENGTH - ANCHOR + 1) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    ends = np.repeat(offsets[1:], size)[: len(anchor)]
    inside = np.flatnonzero(np.arange(LENGTH, LENGTH + len(anchor)) <= ends)
    held, ends = anchor[inside], ends[inside]
    begins = np.append(True, (held[1:] != held[:-1]) | (ends[1:] != ends[:-1]))
    first = inside[begins]
    count = np.diff(np.append(np.flatnonzero(begins), len(inside)))
    at = anchor[first]
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], count, first, at, h[at]


def whole_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of each stretch: its bytes and where in them the anchor stands."""
    out = np.zeros(len(first), np.uint64)
    for low, some in sliced(data, first):
        h = tk.span_hashes(data[low : low + SLICE + 2 * LENGTH], first[some] - low, first[some] + count[some] - 1 + LENGTH - low)
        out[some] = tk.mix(h + (at[some] - first[some]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def side_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each stretch's anchor with the SIDE bytes before it, and with those behind it; 0 where there are fewer."""
    before, behind = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    width = SIDE + ANCHOR
    for low, some in sliced(data, first):
        part, a = data[low : low + SLICE + 2 * LENGTH], at[some] - low
        has = np.flatnonzero(at[some] - first[some] >= SIDE)
        before[some][has] = tk.span_hashes(part, a[has] - SIDE, a[has] - SIDE + width) | np.uint64(1)
        has = np.flatnonzero(first[some] + count[some] - 1 + LENGTH - at[some] >= width)
        behind[some][has] = tk.mix(tk.span_hashes(part, a[has], a[has] + width)) | np.uint64(1)
    return before, behind


def sliced(data: np.ndarray, first: np.ndarray):
    """(start of a slice of data, the part of the ascending places ``first`` in it)."""
    for low in range(0, len(data), SLICE):
        a, b = np.searchsorted(first, [low, low + SLICE])
        if a < b:
            yield low, slice(a, b)


def longs(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def place_hash(rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    return tk.mix(rid.view(np.uint64) + start.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def with_row_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rid"), text)


def anchor_counts(docs: DataFrame) -> DataFrame:
    """key, n: how often each anchor occurs."""

    def run(batches):
        for batch in tk.steps(batches, size=STEP):
            *_, key = stretches(*tk.text_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([longs(key)], ["key"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))


def occurrences(docs: DataFrame, repeated) -> DataFrame:
    """key, whole, rid, start, count, before, behind of all stretches whose anchor may be repeated."""
    names = ["key", "whole", "rid", "start", "count", "before", "behind"]

    def run(batches):
        for batch in tk.steps(batches, size=STEP):
            data, offsets = tk.text_bytes(batch.column(1))
            found = stretches(data, offsets)
            k = tk.may_hold(repeated.value, found[-1])
            row, start, count, first, at, key = (x[k] for x in found)
            hashes = [longs(h) for h in (whole_hashes(data, first, count, at), *side_hashes(data, first, count, at))]
            place = [pa.array(batch.column(0).to_numpy()[row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int16))]
            yield pa.RecordBatch.from_arrays([longs(key), hashes[0], *place, *hashes[1:]], names)

    return with_row_id(docs).mapInArrow(run, "key long, whole long, rid long, start int, count smallint, before long, behind long")


def with_partners(classes: DataFrame) -> DataFrame:
    """The representatives that may share a string with another one, where at least one of the two has no copies."""
    sides = classes.select(F.explode(F.array("before", "behind")).alias("side"), "copies").filter("side != 0")
    shared = sides.groupBy("side").agg(F.count("*").alias("n"), F.min("copies").alias("least")).filter("n > 1 and least = 1")
    bits = classes.sparkSession.sparkContext.broadcast(tk.membership_filter(shared.select("side")))  # fixed size
    at = [classes.columns.index(c) for c in ("before", "behind")]

    def run(batches):
        for batch in batches:
            before, behind = (batch.column(i).to_numpy().view(np.uint64) for i in at)
            yield batch.filter(pa.array((before != 0) & tk.may_hold(bits.value, before) | (behind != 0) & tk.may_hold(bits.value, behind)))

    return classes.mapInArrow(run, classes.schema).drop("before", "behind")


def stretch_bytes(docs: DataFrame, chosen, holders) -> DataFrame:
    """key, whole, rid, start, count, bytes of the stretches that may be representatives, from the documents that may hold any."""

    def run(batches):
        for batch in tk.steps(batches, size=STEP):
            batch = batch.filter(pa.array(tk.may_hold(holders.value, batch.column(0).to_numpy().view(np.uint64))))
            data, offsets = tk.text_bytes(batch.column(1))
            found = stretches(data, offsets)
            rid = batch.column(0).to_numpy()
            k = tk.may_hold(chosen.value, place_hash(rid[found[0]], found[1]))
            row, start, count, first, at, key = (x[k] for x in found)
            whole = whole_hashes(data, first, count, at)
            cut = [data[a : a + n].tobytes() for a, n in zip(first.tolist(), (count - 1 + LENGTH).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([longs(key), longs(whole), pa.array(rid[row]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int16)), pa.array(cut, pa.binary())], ["key", "whole", "rid", "start", "count", "bytes"])

    return with_row_id(docs).mapInArrow(run, "key long, whole long, rid long, start int, count smallint, bytes binary")


class Chunk:
    """Stretches waiting to be sorted together."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, key, whole, copies, data, split):
        self.rows.append((key, whole, copies, data, split))
        self.size += len(data)

    def repeated(self):
        """Arrays (key, whole, low, high, hash, kind): runs of repeated starts of stretches without copies, of kind 0; for
        split anchors, strings to compare elsewhere, of kind 1, or 2 where the stretch has copies and is settled."""
        rows, self.rows, self.size = self.rows, [], 0
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        size = np.array([len(r[3]) for r in rows])
        begin = np.cumsum(size) - size
        starts = size - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), starts)
        inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        valid = np.zeros(len(data), bool)
        valid[begin[owner] + inner] = True
        order = suffixes.suffix_array(data, LENGTH)
        order = order[valid[order]]
        same = suffixes.common_prefix(data, order[:-1], order[1:], LENGTH) >= LENGTH
        marked = np.zeros(len(data), bool)
        marked[order[1:][same]] = True
        marked[order[:-1][same]] = True
        settled = np.array([r[2] for r in rows]) > 1
        hit = marked[begin[owner] + inner] & ~settled[owner]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8)) != 0)
        # runs don't cross stretches
        bounds = np.union1d(edge, (np.cumsum(starts) - starts)[1:])
        low = bounds[:-1][hit[bounds[:-1]]] if len(bounds) > 1 else np.zeros(0, np.int64)
        high = bounds[1:][hit[bounds[:-1]]] if len(bounds) > 1 else np.zeros(0, np.int64)
        key, whole = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        out = [(key[owner[low]], whole[owner[low]], inner[low], inner[high - 1] + 1, np.zeros(len(low), np.int64), np.zeros(len(low), np.int32))]
        split = np.array([r[4] for r in rows])
        if split.any():
            look = np.flatnonzero(split[owner])
            h = tk.span_hashes(data, begin[owner[look]] + inner[look], begin[owner[look]] + inner[look] + LENGTH)
            _, one = np.unique(h, return_index=True)  # one row for each string of the chunk
            pick = look[one]
            out.append((key[owner[pick]], whole[owner[pick]], inner[pick], inner[pick] + 1, h[one].view(np.int64), 1 + settled[owner[pick]].astype(np.int32)))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def sorted_marks(stretch: DataFrame, classes: DataFrame, hot: list[int], partitions: int) -> DataFrame:
    """key, whole, low, high, hash, kind: kind 0 repeated starts low..high-1, kinds 1 and 2 strings that may match in another chunk."""
    none = {"copies": F.lit(None).cast("long"), "bytes": F.lit(None).cast("binary"), "count": F.lit(None).cast("smallint")}
    both = classes.select("key", "whole", F.lit(0).alias("kind"), "rid", "start", "copies", none["bytes"].alias("bytes"))
    both = both.unionByName(stretch.select("key", "whole", F.lit(1).alias("kind"), "rid", "start", none["copies"].alias("copies"), "bytes"))
    salt = F.when(F.col("key").isin(hot), F.pmod(F.col("whole"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    dealt = both.withColumn("salt", salt.cast("int")).repartition(partitions, "key", "salt").sortWithinPartitions("key", "whole", "kind")
    dealt = dealt.select("key", "whole", "kind", "rid", "start", "copies", "bytes")
    salted = frozenset(hot)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    names = ["key", "whole", "low", "high", "hash", "kind"]

    def run(batches):
        chunk, last, cut, head, taken, own = Chunk(), None, False, None, False, 0

        def flush():
            if chunk.rows:
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(chunk.repeated(), kinds, strict=True)], names)

        for batch in batches:
            for key, whole, kind, rid, start, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    head, taken = (key, whole, rid, start, copies), False
                    continue
                if taken or head is None or (key, whole, rid, start) != head[:4]:
                    continue
                taken = True
                if key != last:
                    if chunk.size >= CHUNK_BYTES:
                        yield from flush()
                    last, cut, own = key, key in salted, 0
                elif own >= 3 * CHUNK_BYTES:  # one anchor alone is longer than a chunk
                    chunk.rows = [(*r[:4], r[4] or r[0] == key) for r in chunk.rows]
                    yield from flush()
                    cut, own = True, 0
                own += len(data)
                chunk.add(key, whole, head[4], data, cut)
        yield from flush()

    return dealt.mapInArrow(run, "key long, whole long, low int, high int, hash long, kind int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """rid, runs (array of start, end in bytes, not merged) of every document with a repeated string."""
    spark = docs.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = tk.written(anchor_counts(docs).filter("n > 1"), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    repeated = spark.sparkContext.broadcast(tk.membership_filter(counts.select("key")))  # fixed size
    limit = max(HOT, total // MOST_HOT)
    hot = [r["key"] for r in counts.filter(F.col("n") > limit).select("key").collect()]
    found = tk.written(occurrences(docs, repeated), "stretches")
    classes = found.groupBy("key", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start", "count", "before", "behind")).alias("at"))
    classes = tk.written(classes.select("key", "whole", "copies", "at.*"), "classes")
    settled = classes.filter("copies > 1").select("key", "whole", "copies", F.lit(0).alias("low"), F.col("count").cast("int").alias("high"))
    rest = tk.written(with_partners(classes), "partners")

    def places(batch):
        return place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    chosen = spark.sparkContext.broadcast(tk.membership_filter(rest.select("rid", "start"), places))  # fixed size
    holders = spark.sparkContext.broadcast(tk.membership_filter(rest.select("rid").distinct()))  # fixed size
    marks = tk.written(sorted_marks(stretch_bytes(docs, chosen, holders), rest, hot, partitions), "marks")
    apart = marks.filter("kind > 0")
    met = apart.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    elsewhere = apart.filter("kind = 1").join(met, "hash", "left_semi")
    # a string stands for all its equals of the chunk only if they were marked there; others stand for themselves
    both = marks.filter("kind = 0").unionByName(elsewhere).select("key", "whole", "low", "high")
    both = both.unionByName(settled.filter(F.col("copies") <= limit).drop("copies"))
    # one row for each stretch, so that a copy of it meets one row however many of its strings are repeated
    masks = [starts_mask(w).alias(f"mask{w}") for w in range(MASKS)]
    both = both.select("key", "whole", *masks).groupBy("key", "whole").agg(*[F.bit_or(f"mask{w}").alias(f"mask{w}") for w in range(MASKS)])
    places = found.select("key", "whole", "rid", "start")
    crowded = settled.filter(F.col("copies") > limit).select("key", "whole", *masks)
    if crowded.take(1):
        crowded = F.broadcast(crowded)
        joined = places.join(crowded, ["key", "whole"]).unionByName(places.join(crowded, ["key", "whole"], "left_anti").join(both, ["key", "whole"]))
    else:
        joined = places.join(both, ["key", "whole"])
    return joined.groupBy("rid").agg(F.collect_list(F.struct("start", *[f"mask{w}" for w in range(MASKS)])).alias("runs"))


def starts_mask(w: int):
    """Bits of the starts low..high-1 of a stretch that lie in its w-th sixty, as a long."""
    low = F.least(F.greatest(F.col("low") - 60 * w, F.lit(0)), F.lit(60))
    high = F.least(F.greatest(F.col("high") - 60 * w, F.lit(0)), F.lit(60))
    return power_of_two(high) - power_of_two(low)


def power_of_two(n):
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def covered(offsets: np.ndarray, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal byte runs, by place in the rows' bytes, that the repeated starts in ``runs`` cover."""
    owner = np.repeat(np.arange(len(runs)), runs.value_lengths().fill_null(0).to_numpy())
    start, *masks = (c.to_numpy() for c in runs.flatten().flatten())
    flag = np.zeros(offsets[-1], bool)
    for low in range(0, len(owner), 4096):  # 64 bytes for each mask
        for w, mask in enumerate(masks):
            part = np.ascontiguousarray(mask[low : low + 4096]).astype("<i8").view(np.uint8).reshape(-1, 8)
            which, bit = np.nonzero(np.unpackbits(part, axis=1, bitorder="little"))
            which += low
            flag[offsets[owner[which]] + start[which] + 60 * w + bit] = True
    at = np.flatnonzero(flag)
    row = np.searchsorted(offsets, at, "right") - 1
    apart = (at[1:] > at[:-1] + LENGTH) | (row[1:] != row[:-1])
    first, last = np.append(True, apart)[: len(at)], np.append(apart, True)[: len(at)]
    return row[first], at[first], at[last] + LENGTH


def dedup(docs: DataFrame, passing: list[str], digest: bool) -> DataFrame:
    """``passing`` columns of every row and n_bytes, n_removed, n_spans with kept_sha256 (digest) or kept_text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`") for c in passing], text.alias("__text"), F.xxhash64("doc_id", text).alias("__rid"))
    joined = source.join(repeated_runs(docs).withColumnRenamed("rid", "__rid").withColumnRenamed("runs", "__runs"), "__rid", "left").drop("__rid")
    joined = joined.select(*[F.col(f"`{c}`") for c in passing], "__text", "__runs")
    width = len(passing)
    last = "kept_sha256" if digest else "kept_text"

    def run(batches):
        for batch in tk.steps(batches, "__text", STEP):
            data, offsets = tk.text_bytes(batch.column(width))
            row, start, end = covered(offsets, batch.column(width + 1))
            gone = tk.segment_sums(end - start, row, batch.num_rows)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[start] += 1
            edge[end] -= 1
            kept = memoryview(data[np.cumsum(edge[:-1], dtype=np.int8) == 0])
            size = np.diff(offsets)
            cuts = np.concatenate([[0], np.cumsum(size - gone)]).tolist()
            pieces = (kept[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            shown = [hashlib.sha256(x).hexdigest() if digest else str(x, "utf-8", "ignore") for x in pieces]
            arrays = [pa.array(size), pa.array(gone), pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *arrays], [*passing, "n_bytes", "n_removed", "n_spans", last])

    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in passing]).schema]
    return joined.mapInArrow(run, ", ".join([*head, "n_bytes long", "n_removed long", "n_spans long", f"{last} string"]))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], True)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated bytes (a code point cut in two goes too); it reads doc_id and text, and
    n_chars, where there is one, follows the text."""
    tk.bounded_arrow(spark)
    out = dedup(docs, [c for c in docs.columns if c != "text"], False)
    shown = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[shown.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}

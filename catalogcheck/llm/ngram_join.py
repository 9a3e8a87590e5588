"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets collapse to one before anything is compared, and every pair is verified on the full sets of 64-bit shingle
hashes before it counts as a link.

1. Open sets. In one order of all shingles (by hash), two similar sets share the first shingles that they have in
   common, so a similar set shares some of the first ``may_miss(n) + extension(n)`` shingles of each: at least
   ``extension`` of the smallest size that a partner can have. These prefixes, a quarter of all shingles, are counted
   over the corpus; a set with too few shared ones has no partner. What is left is open, and its shingles are written once.
2. Token-combination prefixes. The shingles of the open sets are counted exactly and ordered by frequency, those of one set
   alone first. A set's prefix is extended until a similar set must share a combination inside it: shingles of fewer than
   LEAST[0] sets are indexed singly, more frequent ones in combinations of two, very frequent ones of three. With x
   shingles of a group that is indexed in combinations of k, a set that shares none of them misses x - (k - 1) of
   that group, so once these add up to more than the 20 % it may miss, some combination is shared. Frequent classes are
   cut into groups by hash (more groups for longer sets, the same number for all sets of a length band; a set near a
   band's edge is indexed in both bands), which keeps the number of combinations near the number of shingles.
3. Buckets. A bucket is cut into narrow bands of lengths, where a combination counts only as far down the prefix as partners
   of these lengths need. Buckets with the same sets collapse to one; a bucket of two is a pair. Larger ones are compared inside
   tasks, in blocks of at most 2 * BLOCK sets, on bitmaps that can only rule pairs out. No pairs leave the task but a spanning forest: the likeliest pairs that join the block's sets. They are verified, which settles
   the components but for pairs that failed.
4. What is left. Buckets whose sets are still of different components are compared once more: pairs of different components that
   no bitmap rules out are verified too. A forest can hide only
   pairs inside one component, so no link between components is lost.

In a group of very many texts that are nearly but not quite similar, step 4 still verifies each pair that the bitmaps leave
(similarities from about 0.78): exact results need some proof for every such pair.

Defined results: without words or text a document has no shingles and is its own component; with fewer than five
words the whole sequence is the one shingle; different texts of one id are nodes of their own; rows repeated whole
give equal rows; a null id is carried through like any other; an empty table gives no rows; very long texts are sets like
any other, read whole; the query doesn't read other columns.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Class k + 1 of a shingle begins at LEAST[k] open sets that hold it.
LEAST = (128, 4096)
#: Length bands (from, groups of each frequent class); a set of 1.25 times a band's end is in both bands. Groups are at most a
#: quarter of the shingles, so that a set never runs out of combinations: n - groups - 2 * groups is more than it may miss.
BANDS = tuple((8 * 2**i, 2 * 2**i) for i in range(24))
#: Factor of the finer length bands that buckets are cut by.
FINE = 1.1
#: Sets of one side of a block.
BLOCK = 512
#: Sets that a task remembers, to send each once.
REMEMBERED = 1 << 18


def document_sets(column):
    """Distinct shingle hashes of each row, sorted: (hashes, row of each, offsets)."""
    data, offsets = tk.text_bytes(column)
    data = tk.lower(data)
    rows = len(offsets) - 1
    start, end, row = tk.words(data, offsets)
    h, at = tk.shingle_hashes(tk.span_hashes(data, start, end), row, rows, SHINGLE) if len(start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))[: len(h)]
    h, at = h[keep], at[keep]
    return h, at, np.searchsorted(at, np.arange(rows + 1))


def set_hashes(h: np.ndarray, at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One hash of each whole set (sets without members: 0)."""
    size = np.diff(edges)
    total = np.zeros(len(size), np.uint64)
    np.add.at(total, at, tk.mix(h + np.uint64(0x51ED270B)))
    return np.where(size > 0, tk.mix(total + size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), np.uint64(0))


def may_miss(n: int) -> int:
    """How many members of a set of n a similar set may lack: the overlap is at least 80 % of the union, so of n."""
    return n - (PERCENT * n + 99) // 100


def extension(n: int) -> int:
    """How many shingles the prefix of an n-shingle set has beyond those that a similar set may lack."""
    return 1 + n // 20


def bands_of(n: int) -> list[tuple[int, int]]:
    """(number, groups) of the bands that a set of n shingles is indexed in; band 0 has single shingles only."""
    out = [(0, 0)] if n < BANDS[0][0] * 1.25 else []
    for i, (low, groups) in enumerate(BANDS):
        high = BANDS[i + 1][0] if i + 1 < len(BANDS) else float("inf")
        if low <= n < high * 1.25:
            out.append((i + 1, groups))
    return out


def counted(docs: DataFrame, row=None) -> DataFrame:
    """doc_id, row, n_shingles, set, prefix for every document (``row``: the column given, a long).

    ``prefix`` holds the first hashes of the set, 8 bytes each; it is null where the task has sent the set before.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in tk.steps(batches):
            h, at, edges = document_sets(batch.column(1))
            size, whole = np.diff(edges), set_hashes(h, at, edges)
            prefix: list = [None] * batch.num_rows
            for i in np.flatnonzero(size):
                if (key := int(whole[i])) not in seen:
                    seen.add(key)
                    n = int(size[i])
                    prefix[i] = h[edges[i] : edges[i] + min(n, may_miss(n) + extension(n))].tobytes()
            if len(seen) > REMEMBERED:
                seen = set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size), pa.array(whole.view(np.int64)), pa.array(prefix, pa.binary())], ["doc_id", "row", "n_shingles", "set", "prefix"])

    row = F.lit(0).cast("long") if row is None else row
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))
    return source.mapInArrow(run, "doc_id long, row long, n_shingles long, set long, prefix binary")


def joined_tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of binary sets end to end, and the row of each."""
    raw = [x.as_buffer() for x in column]
    size = np.array([len(x) // 8 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(len(raw)), size)


def prefix_tokens(held: DataFrame) -> DataFrame:
    """token: the prefix hashes of every different set of ``held`` (set, prefix).

    Only sets that several tasks have sent need an exchange to be counted once; a filter of their hashes tells nearly all others.
    """
    copied = held.groupBy("set").agg(F.count("*").alias("times")).filter("times > 1").select("set")
    bits = held.sparkSession.sparkContext.broadcast(tk.membership_filter(copied))  # fixed size

    def tokens_of(column):
        return pa.RecordBatch.from_arrays([pa.array(joined_tokens(column)[0].view(np.int64))], ["token"])

    def single(batches):
        for batch in batches:
            k = tk.may_hold(bits.value, batch.column(0).to_numpy().view(np.uint64))
            yield tokens_of(batch.filter(pa.array(~k)).column(1))

    def doubtful(batches):
        for batch in batches:
            yield batch.filter(pa.array(tk.may_hold(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    def tokens(batches):
        for batch in batches:
            yield tokens_of(batch.column(1))

    once = held.mapInArrow(doubtful, held.schema).dropDuplicates(["set"])
    return held.mapInArrow(single, "token long").union(once.mapInArrow(tokens, "token long"))


def open_sets(sets: DataFrame) -> DataFrame:
    """set: those with as many shared hashes in their prefix as a similar set would share (and perhaps some others)."""
    held = sets.filter("prefix IS NOT NULL").select("set", "n_shingles", "prefix")
    counted_ = prefix_tokens(held.select("set", "prefix")).groupBy("token").agg(F.count("*").alias("times"))
    shared = tk.written(counted_.filter("times > 1").select("token"), "shared")
    bits = held.sparkSession.sparkContext.broadcast(tk.membership_filter(shared))  # fixed size

    def maybe(batches):
        for batch in batches:
            token, at = joined_tokens(batch.column(2))
            k = tk.may_hold(bits.value, token)
            least = np.array([extension(-(-PERCENT * n // 100)) for n in batch.column(1).to_pylist()], np.int32)
            # sets that can't reach their number even with the filter's mistakes stay here
            k &= (np.bincount(at[k], minlength=batch.num_rows) >= least)[at]
            at = at[k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(token[k].view(np.int64)), pa.array(least[at])], ["set", "token", "least"])

    found = held.mapInArrow(maybe, "set long, token long, least int")
    # a set that several tasks have sent is counted as often, which may only leave it open
    return found.join(shared, "token", "left_semi").groupBy("set").agg(F.count("*").alias("n"), F.max("least").alias("least")).filter("n >= least").select("set")


def set_members(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, n, members (ascending hashes, 8 bytes each) of the wanted sets, as a table bucketed by set."""
    bits = docs.sparkSession.sparkContext.broadcast(tk.membership_filter(wanted))  # fixed size

    def run(batches):
        seen: set[int] = set()
        for batch in tk.steps(batches):
            h, at, edges = document_sets(batch.column(0))
            whole = set_hashes(h, at, edges)
            out = []
            for i in np.flatnonzero((np.diff(edges) > 0) & tk.may_hold(bits.value, whole)):
                if (key := int(whole[i])) not in seen:
                    seen.add(key)
                    out.append((int(whole[i : i + 1].view(np.int64)[0]), int(edges[i + 1] - edges[i]), h[edges[i] : edges[i + 1]].tobytes()))
            if len(seen) > REMEMBERED:
                seen = set()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["set", "n", "members"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "set long, n int, members binary")
    return tk.written_by_key(found.join(wanted, "set", "left_semi").dropDuplicates(["set"]), "members", "set")


def least_common(total):
    """How many members two sets of ``total`` members together must have in common to be similar."""
    return -(-PERCENT * total // (100 + PERCENT))


def signatures(h: np.ndarray, kind: np.ndarray, alone: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, level) of every combination in the extended prefix of one set, in all its bands.

    ``h`` are the set's hashes in the order of all shingles, ``kind`` their classes; ``alone`` more come before them, which
    no other set holds. A combination of level x is in the prefix that a partner needs who lets the set miss x members
    or more, so two similar sets share one whose levels are at most what each of them misses of the other.
    """
    n = len(h) + alone
    need = may_miss(n) + 1 - alone
    if need <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out_h, out_l = [], []
    for band, groups in bands_of(n):
        salt = np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        k = kind if groups else np.ones(len(h), np.uint8)
        single = h[np.flatnonzero(k == 1)[:need]]
        out_h.append(tk.mix(single ^ salt))
        out_l.append(alone + np.arange(len(single)))
        missing = need - len(single)
        for size in (2, 3):
            if missing <= 0:
                break
            member = h[k == size]
            group = tk.mix(member + np.uint64(size)) % np.uint64(max(1, groups))
            # take members in order until the groups' sums reach what is missing
            order = np.argsort(group, kind="stable")
            rank = np.empty(len(member), np.int64)
            sorted_group = group[order]
            rank[order] = np.arange(len(member)) - np.searchsorted(sorted_group, sorted_group)
            gain = np.cumsum(rank >= size - 1)
            take = int(np.searchsorted(gain, missing)) + 1
            member, group, gain = member[:take], group[:take], gain[:take]
            level = need + alone - missing + np.append(0, gain)[: len(gain)]
            missing -= int(gain[-1]) if len(gain) else 0
            order = np.argsort(group, kind="stable")
            member, group, level = member[order], group[order], level[order]
            for at in np.split(np.arange(len(member)), np.flatnonzero(group[1:] != group[:-1]) + 1) if len(member) else []:
                if len(at) >= size:
                    pick = at[np.array(list(itertools.combinations(range(len(at)), size)))]
                    mixed = np.zeros(len(pick), np.uint64)
                    for j in range(size):
                        mixed = tk.mix(mixed * np.uint64(0x9E3779B97F4A7C15) + member[pick[:, j]])
                    out_h.append(tk.mix(mixed ^ salt + np.uint64(size)))
                    out_l.append(level[pick[:, -1]])  # that of its last member
    return np.concatenate(out_h), np.concatenate(out_l)


def indexed(members: DataFrame) -> DataFrame:
    """bucket, set, n, level: the sets filed under every combination of their prefixes."""

    def tokens(batches):
        for batch in batches:
            token, at = joined_tokens(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(token.view(np.int64))], ["set", "token"])

    each = members.select("set", "members").mapInArrow(tokens, "set long, token long")
    counts = each.groupBy("token").agg(F.count("*").cast("int").alias("times")).filter("times > 1")
    shared = each.join(counts, "token").groupBy("set").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("tokens"))  # at most the set's own shingles
    both = shared.join(members.select("set", "n"), "set").select("set", "n", F.col("tokens.times").alias("times"), F.col("tokens.token").alias("token"))

    def run(batches):
        for batch in batches:
            sig, level, owner = [], [], []
            for i, (n, times, token) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                t = times.values.to_numpy()
                kind = (1 + (t >= LEAST[0]) + (t >= LEAST[1])).astype(np.uint8)
                x, y = signatures(token.values.to_numpy().view(np.uint64), kind, n - len(t))
                sig.append(x)
                level.append(y)
                owner.append(np.full(len(x), i))
            if sig:
                at = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(level).astype(np.int32))], ["bucket", "set", "n", "level"])

    return both.mapInArrow(run, "bucket long, set long, n int, level int")


def by_length(filed: DataFrame) -> DataFrame:
    """bucket, set, n, level, own: buckets cut by length, each set in its own band and, as the smaller partner, in the bands
    above it that reach up to 1.25 times its length; there only with levels that such a partner allows."""
    band = F.floor(F.log("n") / F.log(F.lit(FINE))).cast("int")
    last = int(np.ceil(np.log(100 / PERCENT) / np.log(FINE)))
    both = filed.select("bucket", "set", "n", "level", band.alias("band"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("up"))
    least = F.pow(F.lit(FINE), F.col("band") + F.col("up")) * (1 - 1e-9)  # the partner's length
    allowed = F.col("n") - F.lit(PERCENT / (100 + PERCENT)) * (F.col("n") + least) + 1e-6
    kept = both.filter((F.col("up") == 0) | (F.col("level") <= allowed))
    return kept.select(F.xxhash64("bucket", F.col("band") + F.col("up")).alias("bucket"), "set", "n", "level", (F.col("up") == 0).alias("own"))


def different(filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets (bucket, set, n, level, own) with the same sets, one: the pairs (a, b) that are all of a bucket, and the larger
    buckets, with their size; a set's level is the least that it has in one of those that became one."""
    marks = {"mark": F.bit_xor(F.xxhash64("set", "own")), "mark2": F.sum(F.expr("xxhash64(set, own, 1) div 1048576"))}
    about = filed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("set").alias("least"), F.max("set").alias("most"), F.max("own").alias("owned"), *[c.alias(k) for k, c in marks.items()])
    about = tk.written(about.filter("size > 1 AND owned"), "about")
    twos = about.filter("size = 2").select(F.col("least").alias("a"), F.col("most").alias("b")).distinct()
    larger = about.filter("size > 2")
    one = larger.groupBy("size", "least", "most", *marks).agg(F.min("bucket").alias("one"))
    named = larger.join(one, ["size", "least", "most", *marks]).select("bucket", "one", "size")
    return twos, filed.join(named, "bucket").groupBy(F.col("one").alias("bucket"), "size", "set", "n", "own").agg(F.min("level").alias("level"))


def bitmap(h: np.ndarray) -> bytes:
    """The set's hashes as bits, at most half a member a bit (a power of two, 512 at least)."""
    width = 1 << max(9, int(2 * len(h) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(h & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def with_bitmaps(members: DataFrame) -> DataFrame:
    """set, bits, as a table bucketed by set."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bitmap(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(1)], pa.binary())], ["set", "bits"])

    return tk.written_by_key(members.select("set", "members").mapInArrow(run, "set long, bits binary"), "bitmaps", "set")


def folded(bits: list) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all as narrow as the narrowest of them."""
    raw = [np.frombuffer(b, np.uint64) for b in bits]
    width = min(map(len, raw))
    return np.stack([np.bitwise_or.reduce(r.reshape(-1, width), 0) for r in raw])


def overlaps(bits: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How many members the sets of each pair, of ``total`` members together, have in common at most: bits that differ are
    members that differ, at least one each."""
    out = np.empty(len(a), np.int64)
    step = max(1, (1 << 19) // bits.shape[1])
    for i in range(0, len(a), step):
        out[i : i + step] = np.bitwise_count(bits[a[i : i + step]] ^ bits[b[i : i + step]]).sum(1, dtype=np.int64)
    return (total - out) // 2


class Block:
    """The sets of one block of one bucket; only pairs of the two sides, or of the one side, are its own."""

    def __init__(self, rows: list[tuple]):
        sets, n, level, own, side, bits, root = zip(*rows, strict=True)
        self.sets, n, level, own, side, root = (np.array(x) for x in (sets, n, level, own, side, root))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = not len(right)
        right = left if one else right
        most = least_common(n[left][:, None] + n[right][None])
        fit = (n[left] - level[left])[:, None] >= most
        fit &= (n[right] - level[right])[None] >= most
        fit &= own[left][:, None] | own[right][None]
        fit &= root[left][:, None] != root[right][None]
        a, b = np.nonzero(np.triu(fit, 1) if one else fit)
        a, b = left[a], right[b]
        total = n[a] + n[b]
        most = overlaps(folded(bits), a, b, total) if len(a) else total
        k = np.flatnonzero(most >= least_common(total))
        self.a, self.b, self.likeness = a[k], b[k], most[k] / (total - most)[k]

    def forest(self) -> list[tuple[int, int]]:
        """The likeliest pairs that join the sets which no bitmap keeps apart."""
        root = list(range(len(self.sets)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        order = np.argsort(-self.likeness, kind="stable")
        for i, j in zip(self.a[order].tolist(), self.b[order].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                out.append((i, j))
                if len(out) + 1 == len(root):
                    break
        return out

    def pairs(self) -> list[tuple[int, int]]:
        return list(zip(self.a.tolist(), self.b.tolist(), strict=True))


def compared(filed: DataFrame, bitmaps: DataFrame, forest: bool) -> DataFrame:
    """a, b (a < b): the pairs that the blocks of ``filed`` (bucket, size, set, n, level, own, root) offer, of
    sets with different ``root``."""
    spark = filed.sparkSession
    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a bucket of more than 2 * BLOCK sets is dealt to parts; every two parts meet in a block of their own
    parts = F.when(F.col("size") > 2 * BLOCK, F.ceil(F.col("size") / BLOCK)).otherwise(1).cast("int")
    dealt = filed.join(bitmaps, "set").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = dealt.select("bucket", "set", "n", "level", "own", "bits", "root", "part", other)
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other"), "side": F.when(F.col("part") > F.col("other"), 1).otherwise(0)})
    dealt = dealt.repartition(count, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "set")
    dealt = dealt.select("bucket", "low", "high", "set", "n", "level", "own", "side", "bits", "root")

    def run(batches):
        key, rows = None, []

        def flush():
            if len(rows) < 2:
                return
            block = Block(rows)
            pairs = block.forest() if forest else block.pairs()
            if pairs:
                a, b = (block.sets[[p[i] for p in pairs]] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for bucket, low, high, *row in zip(*cols, strict=True):
                if (bucket, low, high) != key:
                    yield from flush()
                    key, rows = (bucket, low, high), []
                rows.append(row)
        yield from flush()

    return dealt.mapInArrow(run, "a long, b long")


def similar(a, b) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets, and whether they are similar."""
    sized = pairs.join(members.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("members").alias("x")), "a")
    both = sized.join(members.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("members").alias("y")), "b")
    both = both.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], ["a", "b", "similar"])

    return both.mapInArrow(run, "a long, b long, similar boolean")


def set_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, root: the component of every set that is similar to another one."""
    members = set_members(docs, tk.written(open_sets(sets), "open"))
    twos, crowd = different(tk.written(by_length(indexed(members)), "buckets"))
    crowd = tk.written(crowd, "crowd")
    bitmaps = with_bitmaps(members)
    offered = compared(crowd.withColumn("root", F.col("set")), bitmaps, True)
    first = tk.written(verified(tk.written(twos.union(offered).distinct(), "pairs"), members), "verified")
    links = first.filter("similar").select("a", "b")
    label = components(links)
    rooted = crowd.join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("bucket")
    offered = compared(rooted.join(mixed, "bucket", "left_semi"), bitmaps, False).distinct().join(first, ["a", "b"], "left_anti")
    found = tk.written(verified(tk.written(offered, "pairs"), members).filter("similar").select("a", "b"), "verified")
    return label if found.isEmpty() else components(links.union(found))


def linked(docs: DataFrame, row=None) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, row, n_shingles, set), and set, root of the sets that are similar to another one."""
    both = tk.written(counted(docs, row), "sets")
    return both.drop("prefix"), set_links(docs, both).withColumnRenamed("node", "set")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    own, label = linked(docs)
    firsts = own.filter("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    rooted = firsts.join(label, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("set", "component_id")
    return own.join(named, "set", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, the row of least id (null ids last), then of least hash; of rows repeated
    whole, one. A row's key is its id, whether that is null, and a hash of all its columns."""
    tk.bounded_arrow(spark)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    own, label = linked(docs, row)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row")
    # the least key of each set first: a set with very many copies is one row of each task
    firsts = own.filter("n_shingles > 0").groupBy("set").agg(F.min(key).alias("key"))
    least = firsts.join(label, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("key").alias("key")).select("key")
    kept = least.union(own.filter("n_shingles = 0").select(key.alias("key")).distinct()).select(F.col("key.none").alias("__none"), F.col("key.id").alias("__id"), F.col("key.row").alias("__row"))
    number = F.col("doc_id").cast("long")
    keyed = docs.withColumns({"__none": number.isNull(), "__id": F.coalesce(number, F.lit(0)), "__row": row}).dropDuplicates(["__none", "__id", "__row"])
    return keyed.join(kept, ["__none", "__id", "__row"], "left_semi").select(*docs.columns)


QUERIES = {"op3_ngram_jaccard_join": op3_ngram_jaccard_join}
ORACLES: dict[str, str] = {}

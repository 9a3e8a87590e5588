"""Spelling variants: near words of the corpus vocabulary, by search schemes over a bidirectional FM-index.

Two words are near when one insertion, deletion or replacement of a code point turns one into the other. Such an error
leaves one half of a word of m code points intact: its first m // 2 code points or the others. So every word is filed
under (m, first half) and (m, second half), and asks under the halves that it would share with words of one code point
less, as many, and one more: a key holds all words that can answer, and keys are dealt to shards by hash.

A shard is one FM-index: its words, each after a delimiter, as one cyclic text, with the Burrows-Wheeler transforms of
the text and of its reverse. A range of suffix ranks stands for a string: on the text's index it grows to the left, on
the reversed text's to the right. A scheme matches the delimiter and the exact half, goes on over the other half with one
error at each place in turn, and ends on the delimiter, where a range is one word. A step for many ranges at once is one
search in the sorted (symbol, place) pairs of the transform.

A pair is taken from its first half where that is intact, else from its second, so once. The form of a word (its most
frequent near word, if ten times as frequent) makes counts grow tenfold a step, so roots are found by a few doublings.

Defined results: null, empty and letterless texts have no words; a null doc_id is hashed as an empty one; repeated rows
count again; an empty table, or one without words, gives no rows; a very long text
is read whole, and a very long word is one word. Columns other than doc_id and text are not read. Ties between forms
go to the smallest word in code-point order. A key with more than ``MOST_WORDS`` words is filed in several parts, each
of which gets all of its questions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: One run in so many loses a code point.
ONE_IN = 31
#: Entries of an index, and the words of one key from which it is filed in parts.
SHARD_ENTRIES, MOST_WORDS = 40_000, 200_000
STEP = 1 << 20
#: Symbols of questions that are searched at once.
TABLE_CELLS = 1 << 22


def _zero_tables(most: int) -> np.ndarray:
    """For each length: what so many zero bytes make of the four bytes of a checksum register (linear in them)."""
    byte = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        byte[i] = c
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        x = out[n - 1]
        out[n] = byte[x & np.uint32(255)] ^ (x >> np.uint32(8))
    return out


#: Words of up to so many bytes are hashed together, longer ones one by one.
_TABLED = 64
_ZEROS = _zero_tables(_TABLED)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of [A-Za-z] and U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    low = data | 32
    lead = data == 0xC3
    letter = ((low >= 97) & (low <= 122)) | lead
    letter[1:] |= lead[:-1]
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = letter
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(inner):
        cut = inner[letter[inner] & letter[inner - 1]]
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, row: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """crc32 of each row's prefix (given as its crc32) followed by the run: crc(AB) = zeros(crc(A), |B|) ^ crc(B)."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    short = np.flatnonzero(size <= _TABLED)
    _, at, which = np.unique(hashes[short], return_index=True, return_inverse=True)
    own = np.array([zlib.crc32(data[start[i] : end[i]]) for i in short[at]], np.uint32)
    before, n = prefix[row[short]], size[short]
    moved = np.zeros(len(short), np.uint32)
    for k in range(4):
        moved ^= _ZEROS[n, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    out[short] = moved ^ own[which]
    for i in np.flatnonzero(size > _TABLED):
        out[i] = zlib.crc32(data[start[i] : end[i]], int(prefix[row[i]]))
    return out


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur often enough, after the deletions."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for step in tk.steps(batches, size=STEP):
            raw, offsets = tk.text_bytes(step.column(1))
            data = tk.lower(raw)
            start, end, row = runs(data, offsets)
            if not len(start):
                continue
            prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in step.column(0).to_pylist()], np.uint32)
            points = np.concatenate([[0], np.cumsum(tk.code_point_starts(data))])
            length = points[end] - points[start]
            hashes = tk.span_hashes(data, start, end)
            h = checksums(data, start, end, hashes, row, prefix)
            hit = h % ONE_IN == 0
            long = ~hit & (length >= LEAST_LENGTH)
            _, first, counts = np.unique(hashes[long], return_index=True, return_counts=True)
            low, high = start[long][first], end[long][first]
            words, n = [data[a:b].tobytes().decode() for a, b in zip(low, high, strict=True)], counts.tolist()
            for i in np.flatnonzero(hit & (length > LEAST_LENGTH)):
                word, k = data[start[i] : end[i]].tobytes().decode(), int(h[i]) % int(length[i])
                words.append(word[:k] + word[k + 1 :])
                n.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """FM-index of a cyclic text of symbols: the text is 0, word, 0, word, ... for distinct words."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.n, self.symbols = len(text), symbols
        # ranks of rotations, by doubling the compared length until all differ
        rank, width = text.astype(np.int64), 1
        while True:
            pair = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
            order = np.argsort(pair, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
            rank = np.empty(self.n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == self.n - 1:
                break
        #: the text's place of each rank, and the symbol before it
        self.place = order
        self.before = text[order - 1].astype(np.int64)
        self.pairs = np.sort(self.before * self.n + np.arange(self.n))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of strings that have one more symbol in front."""
        return np.searchsorted(self.pairs, symbol * self.n + low), np.searchsorted(self.pairs, symbol * self.n + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which symbols but the delimiter stand before each range: numbers of the ranges, and the symbols."""
        wide = np.flatnonzero(high - low > self.symbols)
        few = np.flatnonzero((high - low <= self.symbols) & (high > low))
        size = (high - low)[few]
        of = np.repeat(few, size)
        at = np.repeat(low[few] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair = np.unique(of * (self.symbols + 1) + self.before[at])
        of, symbol = pair // (self.symbols + 1), pair % (self.symbols + 1)
        of = np.concatenate([of, np.repeat(wide, self.symbols)])
        symbol = np.concatenate([symbol, np.tile(np.arange(1, self.symbols + 1), len(wide))])
        return of[symbol > 0], symbol[symbol > 0]


def search(index: Index, asked: np.ndarray, size: np.ndarray, exact: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, place of the delimiter that ends its match) for words with exactly one error.

    ``asked``: a row of symbols for each question, in the order in which the index grows. Its first ``exact`` symbols
    match, then one error follows: the answer has ``change`` symbols more (1, 0 or -1).
    """
    n = len(asked)
    low, high = index.step(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.n))
    q = np.arange(n)
    wrong = [np.zeros(0, np.int64)] * 3
    found_q, found_at = [], []

    def more(a, b):
        return [np.concatenate(x) for x in zip(a, b, strict=True)]

    for j in range(int(size.max(initial=0)) + 1):
        ahead = [np.zeros(0, np.int64)] * 3
        ready = np.flatnonzero(exact[q] <= j)
        inside = ready[size[q[ready]] > j]
        # one symbol of the question has no match
        skip = inside[change[q[inside]] < 0]
        ahead = more(ahead, (q[skip], low[skip], high[skip]))
        # a symbol in place of another, or one more
        for kind, at in ((0, inside), (1, ready)):
            at = at[change[q[at]] == kind]
            of, symbol = index.branches(low[at], high[at])
            if kind == 0:
                other = symbol != asked[q[at[of]], j]
                of, symbol = of[other], symbol[other]
            l, h = index.step(symbol, low[at[of]], high[at[of]])
            keep = h > l
            new = (q[at[of]][keep], l[keep], h[keep])
            if kind == 0:
                ahead = more(ahead, new)
            else:
                wrong = more(wrong, new)
        # after the error: to the end of the question, then its delimiter; errors at several places can lead to one range
        wq, wl, wh = wrong
        if len(wq) > 4 * n:
            order = np.lexsort((wh, wl, wq))
            wq, wl, wh = wq[order], wl[order], wh[order]
            one = np.append(True, (np.diff(wq) != 0) | (np.diff(wl) != 0) | (np.diff(wh) != 0))
            wq, wl, wh = wq[one], wl[one], wh[one]
        over = size[wq] == j
        l, h = index.step(np.zeros(int(over.sum()), np.int64), wl[over], wh[over])
        found_q.append(wq[over][h > l])
        found_at.append(index.place[l[h > l]])
        go = ~over
        l, h = index.step(asked[wq[go], j].astype(np.int64), wl[go], wh[go])
        wrong = more(ahead, (wq[go][h > l], l[h > l], h[h > l]))
        # without an error so far
        go = size[q] > j
        l, h = index.step(asked[q[go], j].astype(np.int64), low[go], high[go])
        q, low, high = q[go][h > l], l[h > l], h[h > l]
    return np.concatenate(found_q), np.concatenate(found_at)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words laid end to end, and the words' offsets."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def near_pairs(words: list[str], asked: list[str], length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(question, word) numbers of near pairs: question i wants words of ``length[i]`` code points that share their
    first half (``first[i]``), or their second half and not their first."""
    points, at = coded(words)
    ask, ask_at = coded(asked)
    known = np.unique(np.concatenate([points, ask]))
    points, ask = np.searchsorted(known, points) + 1, np.searchsorted(known, ask) + 1
    size = np.diff(ask_at)
    # the delimiter of word i stands at its offset plus i
    text = np.zeros(len(points) + len(words), np.int64)
    own = np.repeat(np.arange(len(words)), np.diff(at))
    text[np.arange(len(points)) + own + 1] = points
    delimiter = at[:-1] + np.arange(len(words))
    half = length // 2
    out_q, out_w = [], []
    for forward in (True, False):
        turn = np.flatnonzero(first == forward)
        turn = turn[np.argsort(size[turn], kind="stable")]
        index = Index(text[::-1] if forward else text, len(known)) if len(turn) else None
        while len(turn):  # so many questions that their table stays small, or one
            cells = size[turn] * np.arange(1, len(turn) + 1)
            mine, turn = np.split(turn, [max(1, int(np.searchsorted(cells, TABLE_CELLS, "right")))])
            place = np.arange(int(size[mine].max()) + 1)
            inside = place < size[mine][:, None]
            from_ = ask_at[mine][:, None] + (place if forward else size[mine][:, None] - 1 - place)
            table = np.where(inside, ask[np.where(inside, from_, 0)], 0)
            exact = half[mine] if forward else length[mine] - half[mine]
            q, found = search(index, table, size[mine], exact, length[mine] - size[mine])
            if forward:  # the delimiter after the word, in the reversed text
                w = (np.searchsorted(delimiter, index.n - 1 - found) - 1) % len(words)
            else:
                w = np.searchsorted(delimiter, found)
            pair = np.unique(mine[q] * len(words) + w)
            q, w = pair // len(words), pair % len(words)
            if not forward:  # what shares its first half too is found there
                keep = np.array([words[b][: half[a]] != asked[a][: half[a]] for a, b in zip(q, w, strict=True)], bool)
                q, w = q[keep], w[keep]
            out_q.append(q)
            out_w.append(w)
    return np.concatenate(out_q), np.concatenate(out_w)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best (count and text of the most frequent near word) for the words of (word, n) that have any."""
    spark = vocabulary.sparkSession
    shards = max(1, -(-2 * vocabulary.count() // SHARD_ENTRIES))
    size = F.length("word")

    def keys(m):
        """The two keys of the halves that a word of this row shares with words of m code points."""
        half = F.floor(m / 2).cast("int")
        rest = m - half
        return [
            F.struct(m.alias("m"), F.lit(True).alias("first"), F.substring(F.col("word"), F.lit(1), half).alias("part")),
            F.struct(m.alias("m"), F.lit(False).alias("first"), F.substring(F.col("word"), size - rest + 1, rest).alias("part")),
        ]

    filed = vocabulary.select("word", "n", F.lit(True).alias("own"), F.explode(F.array(*keys(size))).alias("key"))
    asks = F.array(*(k for change in (-1, 0, 1) for k in keys(size + change)))
    asked = vocabulary.select("word", "n", F.lit(False).alias("own"), F.explode(asks).alias("key"))
    crowded = filed.groupBy("key").count().where(F.col("count") > MOST_WORDS).select("key", F.ceil(F.col("count") / MOST_WORDS).cast("int").alias("parts"))
    many = F.coalesce(F.col("parts"), F.lit(1))
    part = F.when(F.col("own"), F.array(F.pmod(F.xxhash64("word"), many).cast("int"))).otherwise(F.sequence(F.lit(0), many - 1))
    both = filed.unionByName(asked).join(crowded, "key", "left").select("word", "n", "own", "key", F.explode(part).alias("part"))
    dealt = both.select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int").alias("shard"), "word", "n", "own", "key.m", "key.first")

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy().astype(bool)
        counts = dict(zip(*(table.column(c).filter(pa.array(own)).to_pylist() for c in ("word", "n")), strict=True))
        asks = table.filter(pa.array(~own))
        if not counts or not len(asks):
            return schema.empty_table()
        words, asked = sorted(counts), asks.column("word").to_pylist()
        count = np.array([counts[w] for w in words], np.int64)
        q, w = near_pairs(words, asked, asks.column("m").to_numpy().astype(np.int64), asks.column("first").to_numpy().astype(bool))
        # of each question word: how many, and the best by count, then by text (words ascend)
        number: dict[str, int] = {}
        of = np.array([number.setdefault(asked[i], len(number)) for i in q], np.int64)
        order = np.lexsort((w, -count[w], of))
        lead = order[np.flatnonzero(np.append(True, np.diff(of[order]) != 0))] if len(order) else order
        return pa.Table.from_pydict({"word": list(number), "n_near": np.bincount(of, minlength=len(number)), "best_n": count[w[lead]], "best": [words[i] for i in w[lead]]}, schema)

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    parts = dealt.groupBy("shard").applyInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("form"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    spark = docs.sparkSession
    tk.bounded_arrow(spark)
    vocabulary = tk.written(counted_words(docs), "vocabulary")
    near = near_words(vocabulary)
    taken = F.col("form_n") >= FORM_TIMES * F.col("n")
    columns = ["word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")]
    forms = tk.written(vocabulary.join(near, "word", "left").select(*columns), "forms")
    # counts grow tenfold a step: after k doublings a chain of 2 ** k forms has been followed
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        joined = tk.written(joined, "roots")
        links = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES: dict[str, str] = {}

"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary file is a SentencePiece model with byte fallback. Its scores are merge ranks, so a piece of rank r gets
the log-probability of Zipf's law, -log(r + 2.7) (single characters and runs of spaces, which have no rank: that of the last); a byte piece costs ``BYTE_COST`` more than the rarest piece. The
encoding is the segmentation of the largest sum (ties: the longer last piece), which is not the merge order of the
model's own encoder. White space follows the model: a space is U+2581, one is put before a text that isn't empty.

The Viterbi pass keeps the scores of as many positions as the longest piece has characters. Whenever the backpointer
paths of all these positions meet in one boundary, the ids up to it are final and are handed on, so memory doesn't
grow with the text. No piece holds U+2581 behind any other character, so every path has a boundary before each run of them: a
text is fed stretch by stretch (a run of spaces and the word behind it), and short stretches' ids are remembered. Short
stretches that aren't known yet are passed side by side, one position of all of them at a time, by the same recursion in
whole numbers; their window is the stretch. Longer ones are streamed one by one.

Defined results: a null or empty text has no ids; U+2581 in a text and characters without a piece become byte pieces, so
decoding gives every text back exactly; ties and repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MODEL = "piece_bpe_32k.model"
SPACE, BYTE_COST, UNUSED = "▁", 10.0, -1e8
#: A non-character that stands for U+2581 of the text itself until it becomes byte pieces.
HELD = "\ufffe"
REMEMBERED, SHORT = 1_000_000, 48
#: Stretches that are passed side by side, and stretches looked up between two looks at how many are remembered.
ABREAST, SLICE = 1 << 14, 1 << 17
#: Sums that no path has: of a boundary not reached yet, and (less, so that it never wins) of a beginning that is no piece.
OPEN, NO_PIECE = -(1 << 61), -(1 << 62)
#: A run of spaces and the word behind it.
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(MODEL))


class Vocabulary:
    """Pieces with log-probabilities, byte pieces, and the bytes that each id stands for."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: (text, score, kind) by id; kind is "piece", "byte" or "other"."""
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "piece" and (s > UNUSED or len(p) == 1 or not p.strip(SPACE))]
        best, least = max((s for *_, s in usable), default=0.0), min((s for *_, s in usable if s > UNUSED), default=0.0)
        # whole numbers, so that sums and ties don't depend on where a text was cut
        self.score = {p: (i, round(-math.log(best - max(s, least) + 2.7) * 2**20), (i,)) for i, p, s in usable}
        floor = min((v for _, v, _ in self.score.values()), default=0)
        self.byte_score = floor - round(BYTE_COST * 2**20)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.longest = max(map(len, self.score), default=1)
        # every beginning of a piece: its entry if it is one itself, else None
        self.beginnings = {p[:n]: None for p in self.score for n in range(1, len(p) + 1)} | self.score
        # the beginnings as a trie in order of length and characters, the root first: numbers of parents and code points ascend
        nodes = sorted(self.beginnings, key=lambda p: (len(p), p))
        at = {p: i for i, p in enumerate(["", *nodes])}
        self.edges = np.array([at[p[:-1]] << 21 | ord(p[-1]) for p in nodes] + [2**63 - 1], np.int64)
        self.node_score = np.array([NO_PIECE] + [self.score[p][1] if p in self.score else NO_PIECE for p in nodes], np.int64)
        self.node_id = np.array([0] + [self.score[p][0] if p in self.score else 0 for p in nodes], np.int64)
        self.bytes_of = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            self.bytes_of[i] = bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "piece" else b""

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "piece" for i in range(m.vocab_size())]
        return cls([(m.id_to_piece(i), m.get_score(i), kinds[i]) for i in range(m.vocab_size())])

    def raw_ids(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character."""
        return tuple(map(self.byte_id.__getitem__, (SPACE if char == HELD else char).encode()))


@functools.lru_cache(1)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker, which serves many tasks."""
    return Vocabulary.read(path)


class StreamingViterbi:
    """Feed text in any parts; ids come out as soon as they are certain. ``finish`` gives the rest."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._start()

    def _start(self) -> None:
        self.text = ""  # the characters after the last certain boundary
        self.seen = 0  # how many of them have been extended by pieces
        self.best: list = [0]  # by boundary: the best sum of a path to it, None if none
        self.back: list = [None]  # (start of the last piece, its ids)

    def feed(self, text: str) -> list[int]:
        self.text += text
        return self._extend(len(self.text) - self.v.longest + 1)

    def finish(self) -> list[int]:
        out = self._extend(len(self.text))
        out += self._path(len(self.text))
        self._start()
        return out

    def _extend(self, stop: int) -> list[int]:
        """Extends the paths at every boundary before ``stop`` by the pieces that start there."""
        v, out = self.v, []
        score, beginnings, longest = v.score, v.beginnings, v.longest
        while self.seen < stop:
            text, best, back = self.text, self.best, self.back
            size = len(text)
            grow = size + 1 - len(best)
            best += [None] * grow
            back += [None] * grow
            end = min(stop, self.seen + 2 * longest)
            for i in range(self.seen, end):
                at = best[i]
                for n in range(i + 1, min(i + longest, size) + 1):
                    got = beginnings.get(text[i:n], 0)
                    if got:
                        total = at + got[1]
                        if best[n] is None or total > best[n]:
                            best[n], back[n] = total, (i, got[2])
                    elif got == 0:
                        break
                n = i + 1
                if text[i] not in score:
                    raw = v.raw_ids(text[i])
                    total = at + v.byte_score * len(raw)
                    if best[n] is None or total > best[n]:
                        best[n], back[n] = total, (i, raw)
            self.seen = end
            if end < size:
                out += self._commit()
                stop -= size - len(self.text)
        return out

    def _commit(self) -> list[int]:
        """Hands on the ids up to the last boundary that the paths to all open boundaries share."""
        ends = [n for n in range(self.seen, len(self.best)) if self.back[n] is not None]
        if not ends:
            return []
        meet = ends[0]
        for n in ends[1:]:
            while n != meet:  # the later of the two steps back
                if n > meet:
                    n = self.back[n][0]
                else:
                    meet = self.back[meet][0]
        out = self._path(meet)
        if meet:
            self.text, self.seen = self.text[meet:], self.seen - meet
            self.best, self.back = self.best[meet:], [b and (b[0] - meet, b[1]) for b in self.back[meet:]]
        return out

    def _path(self, boundary: int) -> list[int]:
        steps = []
        while boundary:
            boundary, ids = self.back[boundary]
            steps.append(ids)
        return [i for ids in reversed(steps) for i in ids]


def side_by_side(stretches: list[str], v: Vocabulary) -> list[bytes]:
    """Ids (as little-endian 32-bit bytes) of stretches that aren't empty, the longest first: StreamingViterbi's, all at once."""
    size = np.fromiter(map(len, stretches), np.int64, len(stretches))
    code = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.cumsum(size) - size
    most = int(size[0])
    longer = np.searchsorted(-size, -np.arange(most + 1))  # by n: how many have more than n characters
    best = np.full((most + 1, len(size)), OPEN)
    best[0] = 0
    node = np.zeros(best.shape, np.int32)  # of the last piece; of byte pieces the complement of the code point
    step = np.zeros(best.shape, np.int8)  # the last piece's characters

    def offer(end, who, total, last, width):
        better = total > best[end, who]
        who = who[better]
        best[end, who], node[end, who], step[end, who] = total[better], last[better], width

    for i in range(most):
        who = np.arange(longer[i])
        last = np.zeros(len(who), np.int64)
        for k in range(i, min(i + v.longest, most)):
            who = who[: np.searchsorted(who, longer[k])]
            char = code[first[who] + k]
            edge = last[: len(who)] << 21 | char
            at = np.searchsorted(v.edges, edge)
            found = v.edges[at] == edge
            if k == i:
                bare = ~found | (v.node_score[np.where(found, at + 1, 0)] == NO_PIECE)
                if bare.any():
                    c = char[bare]
                    n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                    offer(i + 1, who[bare], best[i, who[bare]] + v.byte_score * n_bytes, ~c, 1)
            who, last = who[found], at[found] + 1
            if not len(who):
                break
            offer(k + 1, who, best[i, who] + v.node_score[last], last, k + 1 - i)

    who, end, found = np.arange(len(size)), size, []
    while len(who):
        found.append((who, node[end, who]))
        end = end - step[end, who]
        who, end = who[end > 0], end[end > 0]
    who, last = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
    order = np.argsort(who, kind="stable")
    who, last = who[order], last[order].astype(np.int64)
    # a node's id, or a character's byte pieces, out of one table
    chars, which = np.unique(last[last < 0], return_inverse=True)
    raw = [v.raw_ids(chr(~c)) for c in chars.tolist()]
    width = np.fromiter(map(len, raw), np.int64, len(raw))
    table = np.concatenate([v.node_id, np.array([i for ids in raw for i in ids], np.int64)])
    many = np.ones(len(last), np.int64)
    many[last < 0] = width[which]
    last[last < 0] = (len(v.node_id) + np.cumsum(width) - width)[which]
    ends = np.cumsum(many)
    ids = table[np.repeat(last - ends + many, many) + np.arange(ends[-1])].astype("<u4").tobytes()
    cuts = [0, *(4 * ends[np.searchsorted(who, np.arange(len(size)), "right") - 1]).tolist()]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Encoder(dict):
    """Ids (as little-endian 32-bit bytes) of stretches; short ones are learnt together and remembered, long ones streamed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary

    def __missing__(self, stretch: str) -> bytes:
        if not stretch:  # U+FFFE itself
            return np.array([self.v.byte_id[b] for b in HELD.encode()], "<u4").tobytes()
        viterbi = StreamingViterbi(self.v)
        ids = []
        for i in range(0, len(stretch), 4096):
            ids += viterbi.feed(stretch[i : i + 4096])
        ids = np.array(ids + viterbi.finish(), "<u4").tobytes()
        if len(stretch) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[stretch] = ids
        return ids

    def learn(self, stretches: list[str]) -> None:
        """Remembers the ids of those short stretches that aren't known."""
        new = sorted((x for x in set(stretches) if x not in self and 0 < len(x) <= SHORT), key=len, reverse=True)
        for i in range(0, len(new), ABREAST):
            self.update(zip(new[i : i + ABREAST], side_by_side(new[i : i + ABREAST], self.v), strict=True))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self._stretches(t) if HELD not in t else self._with_held(t) for t in texts]
        flat = list(itertools.chain.from_iterable(cut))
        ids = []
        for i in range(0, len(flat), SLICE):
            if len(self) >= REMEMBERED:
                self.clear()
            self.learn(flat[i : i + SLICE])
            ids += map(self.__getitem__, flat[i : i + SLICE])
        ends = [0, *itertools.accumulate(map(len, cut))]
        return [b"".join(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    @staticmethod
    def _stretches(text: str) -> list[str]:
        if not text:
            return []
        words = text.replace(SPACE, HELD).split(" ")
        if "" not in words:  # no run of spaces
            return [SPACE + p for p in words]
        return STRETCH.findall(SPACE + SPACE.join(words))

    @staticmethod
    def _with_held(text: str) -> list[str]:
        """A text with the non-character U+FFFE: the stretches between, and an empty one for each of it."""
        out = []
        for i, part in enumerate((" " + text).split(HELD)):
            shown = part.replace(SPACE, HELD).replace(" ", SPACE)
            head = re.match(f"[^{SPACE}]*", shown).group()
            out += [""] * (i > 0) + [x for x in (head, *STRETCH.findall(shown)) if x]
        return out


def decode(ids: bytes, vocabulary: Vocabulary) -> str:
    raw = b"".join(map(vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return raw[1:].decode("utf-8", "replace")  # without the space that encoding put first


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array), decoded, for every row, in one pass without a shuffle."""
    path = path or model_path()

    def run(batches):
        v = vocabulary(path)
        encoder = Encoder(v)
        for batch in tk.steps(batches):
            ids = encoder.encode_all([t or "" for t in batch.column(1).to_pylist()])
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            edges = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, flat), pa.array([decode(x, v) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, decoded_sha256, round_trip: encoding and decoding of every row, digested in place."""
    path = path or model_path()

    def run(batches):
        v = vocabulary(path)
        encoder = Encoder(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()]
        for batch in tk.steps(batches):
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for t, ids in zip(texts, encoder.encode_all(texts), strict=True):
                back = decode(ids, v)
                out.append((len(t), len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == t))
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_chars", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op6_piece_encoding(spark, sf_dir: str) -> DataFrame:
    tk.bounded_arrow(spark)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_piece_encoding": op6_piece_encoding}
ORACLES: dict[str, str] = {}

"""Two-stage suffix sorting of a byte string, to a bounded depth, with numpy.

A suffix is ascending if it is smaller than its successor. Only ascending suffixes are compared directly; all others
are put in place by scanning the buckets of first bytes from low to high: when a sorted suffix is met, the one
that starts a byte earlier, if it isn't ascending, takes the next free place of its own bucket.
"""

from __future__ import annotations

import numpy as np

from . import textkit as tk

#: Bytes that a group of suffixes skips at once where all of them go on alike.
STRIDE = 48


def ascending(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end of the string is smaller than any byte."""
    n = len(data)
    change = np.empty(n, bool)
    change[:-1] = data[:-1] != data[1:]
    change[-1] = True
    up = np.zeros(n, bool)
    up[:-1] = data[:-1] < data[1:]
    # a run of one byte has the type that its last place has
    last = np.where(change, np.arange(n), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    return up[last]


def _words(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each place of the data and ``more`` zero bytes, as one number that orders like them."""
    padded = np.zeros(len(data) + more + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + more + 1,), ">u8", padded, strides=(1,))


def _by_key(key: np.ndarray, group: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The order by group, in which the rows stand already, and by key in each; most groups are pairs."""
    out = np.arange(len(key))
    pair = first[size == 2]
    pair = pair[key[pair] > key[pair + 1]]
    out[pair], out[pair + 1] = pair + 1, pair
    more = np.flatnonzero(np.repeat(size > 2, size))
    out[more] = more[np.lexsort((key[more], group[more]))]
    return out


def sort_directly(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the strings of ``depth`` bytes that start there (the end counts as zero bytes, before all)."""
    if not len(at):
        return at
    words = _words(data, depth + STRIDE + 8)
    total = tk.running_hash(np.append(data, np.zeros(depth + STRIDE, np.uint8)))
    back = tk.powers(len(total), tk._INVERSE)

    def hashed(place, width):
        return (total[place + width] - total[place]) * back[place]

    key = words[at].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.append(True, key[1:] != key[:-1])
    slot, group, done = np.arange(len(at)), np.cumsum(edge), np.full(len(at), 8)
    whole = hashed(at, depth)  # groups of one string to the full depth need no more sorting
    while len(slot):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        h = whole[order[slot]]
        mixed = np.minimum.reduceat(h, first) != np.maximum.reduceat(h, first)
        live = np.repeat(mixed, size)
        slot, group, done = slot[live], group[live], done[live]
        if not len(slot):
            break
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, len(group)))
        sub = order[slot]
        # where all of a group go on alike for a stride, skip it
        h = hashed(at[sub] + done, STRIDE)
        skip = np.repeat(np.minimum.reduceat(h, first) == np.maximum.reduceat(h, first), size)
        done[skip] += STRIDE
        key = words[at[sub] + done].astype(np.uint64)
        again = _by_key(key, group, first, size)
        order[slot] = sub[again]
        key = key[again]
        done += 8
        group = np.cumsum(np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
    return at[order]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """All places, ordered by the first ``depth`` bytes of their suffixes at least."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    up = ascending(data)
    direct = sort_directly(data, np.flatnonzero(up), depth)
    by_byte = np.split(direct, np.searchsorted(data[direct], np.arange(1, 256)))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[n - 1]].append(np.array([n - 1]))  # the last suffix comes first in its bucket
    out = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Deals the places before ``found`` to their buckets; returns those of this very bucket."""
        before = found[found > 0] - 1
        before = before[~up[before]]
        b = data[before]
        order = np.argsort(b, kind="stable")
        before, b = before[order], b[order]
        own = np.zeros(0, np.int64)
        cuts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        for i, j in zip(cuts, np.append(cuts[1:], len(b)), strict=False):
            if b[i] == byte:
                own = before[i:j]
            else:
                waiting[b[i]].append(before[i:j])
        return own

    for byte in range(256):
        here = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        while len(here):
            out.append(here)
            here = induce(here, byte)
        if len(by_byte[byte]):
            out.append(by_byte[byte])
            induce(by_byte[byte], byte)
    return np.concatenate(out)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b, up to ``most``."""
    words = _words(data, most + 8)
    out, live = np.full(len(a), most, np.int64), np.arange(len(a))
    for i in range(0, most, 8):
        x = words[a[live] + i].astype(np.uint64) ^ words[b[live] + i].astype(np.uint64)
        differ = np.flatnonzero(x)
        if len(differ):
            bits = np.floor(np.log2(x[differ].astype(np.float64))).astype(np.int64)  # the byte is all that matters
            top = x[differ] >> np.minimum(np.uint64(63), (bits // 8 * 8).astype(np.uint64))
            bits = np.where(top == 0, bits - 8, np.where(top >= 256, bits + 8, bits))
            out[live[differ]] = np.minimum(most, i + 7 - bits // 8)
            live = live[x == 0]
        if not len(live):
            break
    return np.minimum(out, np.minimum(len(data) - a, len(data) - b))

"""Vectorised text primitives over the UTF-8 bytes of an Arrow column.

Every operator that has to look at each word of each document works on whole
Arrow batches: the column's own byte buffer is viewed as a numpy array, word
boundaries come from a 256-entry table, and word hashes from one prefix sum.
Those hashes only find things: what they find is compared byte by byte
(``SpanTable``), and what stands for a word's content elsewhere is a keyed
BLAKE2b hash of it. There is a Python object for each word a worker has not met
before, not for each word.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most_bytes: int = 1 << 19):
    """Row ranges of a column that hold about ``most_bytes`` of text each.

    What is worked out about a slice takes a few hundred bytes for each of its own
    at most. A single longer text forms a range of its own, so memory is bounded by the
    longest text rather than by the batch.
    """
    _, at = byte_view(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1
        last = min(len(column), max(last, first + 1))
        yield first, last
        first = last


@functools.cache
def separators(kind: str) -> np.ndarray:
    """Byte table: True where a byte separates words."""
    table = np.zeros(256, bool)
    if kind == "space":  # words are [^\x20\x09-\x0D]+
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":  # words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
        table[:0x80] = True
        table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
    else:
        raise ValueError(f"unknown kind of words {kind!r}: use 'space' or 'alnum'")
    return table


@functools.cache
def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


@functools.cache
def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.uint64)


_powers: dict[bool, np.ndarray] = {}


def _power(n: int, inverse: bool) -> np.ndarray:
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        size = max(1 << 16, n + (n >> 3))
        steps = np.full(size, _M_INV if inverse else _M, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_spans(data: np.ndarray, at: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words, and the index of each text's first word."""
    sep = separators(kind)[data]
    n = len(data)
    edge = at[(at > 0) & (at < n)]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0] = after[-1] = True
        before[1:], after[:-1] = sep[:-1], sep[1:]
        before[edge] = True
        after[edge - 1] = True
    starts = np.flatnonzero(before & ~sep)
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, by one prefix sum over the bytes.

    Different spans can be made to share one (any polynomial modulo a power of
    two has such pairs), so equal hashes never pass for equal content.
    """
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_codes(seed)[data] * _power(n, True), out=total[1:])
    span = total[ends] - total[starts]
    return mix(span * _power(n + 1, False)[starts] + (ends - starts).astype(np.uint64))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes and eight more, so that a word of eight can be read at each place."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _eights(data: np.ndarray) -> np.ndarray:
    """Every eight consecutive bytes of padded bytes as one number."""
    return np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))


def equal_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Are the spans of two padded byte arrays equal? Eight bytes at a time, what is long by whole rests."""
    out = np.ones(len(sizes), bool)
    words_a, words_b = _eights(a), _eights(b)
    going, done = np.flatnonzero(sizes > 0), 0
    while len(going) and done < 64:
        left = np.minimum(sizes[going] - done, 8)
        same = ((words_a[at_a[going] + done] ^ words_b[at_b[going] + done]) & _MASK[left]) == 0
        out[going[~same]] = False
        done += 8
        going = going[same & (sizes[going] > done)]
    for i in going.tolist():
        n = int(sizes[i])
        out[i] = np.array_equal(a[at_a[i] + done : at_a[i] + n], b[at_b[i] + done : at_b[i] + n])
    return out


class SpanTable:
    """Byte spans numbered as they come: looked up by hash, told apart by content.

    Open addressing; spans are looked up and added by whole arrays. A span whose
    hash belongs to another one is never taken for it.
    """

    UNKNOWN, STRANGE = -1, -2

    def __init__(self, room: int):
        self.bits = max(10, (2 * room - 1).bit_length())
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.size = self.filled = 0
        self.keys = np.zeros(1024, np.uint64)
        self.begin = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int32)
        self.bytes = np.zeros(4096, np.uint8)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Number of each span of padded ``data``; ``UNKNOWN``, or ``STRANGE`` if another span has its hash."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[at]
        going = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[going]
        while len(going):
            at = (at + 1) & (len(self.slots) - 1)
            here = self.slots[at]
            found[going] = here
            on = (here >= 0) & (self.keys[here] != keys[going])
            going, at = going[on], at[on]
        met = np.flatnonzero(found >= 0)
        there, sizes = found[met], (ends - starts)[met]
        alike = self.length[there] == sizes
        alike[alike] = equal_spans(data, starts[met[alike]], self.bytes, self.begin[there[alike]], sizes[alike])
        found[met[~alike]] = self.STRANGE
        return found

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of new spans, whose keys are distinct and unknown."""
        n, size = len(keys), self.size
        lengths = ends - starts
        total = int(lengths.sum())
        self.keys, self.begin, self.length = (_room(x, size + n) for x in (self.keys, self.begin, self.length))
        self.bytes = _room(self.bytes, self.filled + total + 8)
        before = np.cumsum(lengths) - lengths
        self.keys[size : size + n] = keys
        self.begin[size : size + n] = self.filled + before
        self.length[size : size + n] = lengths
        self.bytes[self.filled : self.filled + total] = data[np.repeat(starts - before, lengths) + np.arange(total)]
        self.size, self.filled = size + n, self.filled + total
        out = np.arange(size, size + n, dtype=np.int32)
        own, at = out, (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(own):
            free = self.slots[at] < 0
            self.slots[at[free]] = own[free]
            lost = self.slots[at] != own
            own, at = own[lost], (at[lost] + 1) & (len(self.slots) - 1)
        return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, at least so long; grown by doubling."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def content_hash(word: bytes) -> int:
    """64-bit keyed BLAKE2b: nobody finds two words that share it but by trying about 2**32 of them."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"spanloom words").digest(), "little")


class WordHashes:
    """Content hashes of words; each distinct one is hashed once while a worker remembers it."""

    def __init__(self, room: int = 400_000):
        self.table = SpanTable(room)
        self.values = np.zeros(1024, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        key, wide = hash_spans(data, starts, ends), padded(data)
        index = self.table.find(wide, starts, ends, key)
        unknown = np.flatnonzero(index == SpanTable.UNKNOWN)
        if len(unknown):
            new, where = np.unique(key[unknown], return_index=True)
            where = unknown[where]
            if self.table.size + len(new) > self.table.room:
                self.table.clear()
                unknown = np.arange(len(key))
                new, where = np.unique(key, return_index=True)
            if len(new) > self.table.room:
                raw = data.tobytes()
                return np.array([content_hash(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
            number = self.table.add(wide, starts[where], ends[where], new)
            self.values = _room(self.values, self.table.size)
            raw = data.tobytes()
            spans = zip(starts[where].tolist(), ends[where].tolist(), strict=True)
            self.values[number] = np.fromiter((content_hash(raw[s:e]) for s, e in spans), np.uint64, len(where))
            index[unknown] = self.table.find(wide, starts[unknown], ends[unknown], key[unknown])
        out = self.values[index]
        for i in np.flatnonzero(index == SpanTable.STRANGE).tolist():
            out[i] = content_hash(data[starts[i] : ends[i]].tobytes())
        return out


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``width``-word shingles, and where each text's begin.

    A text with fewer words, but not none, has its whole sequence as its one
    shingle. Words are lower-cased (A-Z only) and separated by ASCII space. A
    shingle's hash is a mixed sum of its words' content hashes, each times a
    multiplier of its place, so different shingles share one by chance alone
    (about 1 in 2**60 for two of them).
    """
    low = ascii_lower()[data]
    starts, ends, first = word_spans(low, at, "space")
    words = hashes(low, starts, ends)
    counts = np.diff(first)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * np.uint64(2 * k * 0x632BE59BD9B4E019 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    rolled = mix(rolled)
    own = np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_counts = own.copy()
    out_counts[short] = 1
    out_at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=out_at[1:])
    out = np.empty(out_at[-1], np.uint64)
    if len(rolled):
        # A start is inside if the last word of its shingle belongs to the same text.
        text_of = np.repeat(np.arange(len(counts)), counts)
        inside = text_of[: len(rolled)] == text_of[width - 1 :]
        target = np.ones(len(out), bool)
        target[out_at[short]] = False
        out[target] = rolled[inside]
    for i in short:
        value = np.uint64(counts[i])
        for w in words[first[i] : first[i + 1]]:
            value = mix(np.array([value * _M + w], np.uint64))[0]
        out[out_at[i]] = value
    return out, out_at

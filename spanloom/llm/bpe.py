"""Byte-level BPE ids through the tokenizers library, with shared work remembered.

A byte-level BPE pre-tokeniser never joins text across a single space that has
non-space on both sides (the space opens the next token), nor across a single
newline between non-spaces, nor between two of ASCII letters, digits and marks
(the apostrophe, which may begin a contraction, is none of them). Texts are cut
into pieces at those places only, all texts of a slice at once over their bytes.
A piece is looked up in a table that the Python worker keeps, by hash and then by
its bytes; unknown ones are encoded by the library, those that are one pre-token
by thousands in one call past its regular expression. Texts with any other
arrangement of white space are encoded whole, and so are those that hold one of
the tokenizer's added tokens, which has an id of its own there, or a piece whose
hash belongs to another one. The ids equal those of encoding the whole text,
which the tests check.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held
from .textbytes import SpanTable, _room, byte_view, hash_spans, padded, slices

#: Pieces that are remembered before a worker starts afresh: about 50 bytes each.
REMEMBERED = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Letters, then marks without an apostrophe.
WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@[-`{-~]+)").fullmatch


def _byte_chars() -> dict[int, int]:
    """Byte to printable character, as byte-level BPE vocabularies are written."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_CHARS = _byte_chars()
SPACE, NEWLINE = chr(BYTE_CHARS[0x20]), chr(BYTE_CHARS[0x0A])
#: For texts of many pre-tokens, between which newlines stand.
IN_LINES = {b: c for b, c in BYTE_CHARS.items() if b != 0x0A}


@functools.cache
def _kinds() -> np.ndarray:
    """Byte table: 1 ASCII letter, 2 digit, 3 mark, 4 space or newline, 5 another control, 0 the rest."""
    table = np.zeros(256, np.uint8)
    table[0x21:0x7F] = 3
    table[0x30:0x3A] = 2
    table[0x41:0x5B] = table[0x61:0x7B] = 1
    table[0x27] = 0
    table[:0x20] = table[0x7F] = 5
    table[[0x20, 0x0A]] = 4
    return table


def encoder_of(path: str) -> Encoder:
    """A Python worker's encoder, so that what it knows outlives a task."""
    return held("encoder", path, lambda: Encoder(path))


class PieceTable(SpanTable):
    """Pieces and their runs of ids."""

    def clear(self) -> None:
        super().clear()
        self.used = 0
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)  # -1: the piece must not be cut out of its text
        self.ids = np.zeros(4096, np.uint32)

    def learn(self, data, starts, ends, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct unknown pieces with the lengths of their runs in ``ids``."""
        at = self.add(data, starts, ends, keys)
        many = np.maximum(counts, 0)
        self.first, self.count = _room(self.first, self.size), _room(self.count, self.size)
        self.ids = _room(self.ids, self.used + len(ids))
        self.count[at] = counts
        self.first[at] = self.used + np.cumsum(many) - many
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)  # the same vocabulary in memory
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.known = PieceTable(remembered)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty texts have none."""
        column = pa.array(texts, pa.large_string())
        return [ids for first, last in slices(column) for ids in self.encode_column(column[first:last])]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        data, at = byte_view(column)
        if not len(data):
            return [b""] * len(column)
        starts, ends, spaced, first, odd = _pieces(data, at)
        key = hash_spans(data, starts, ends, seed=7)
        key ^= spaced.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        wide = padded(data)
        index = self.known.find(wide, starts, ends, key)
        unknown = np.flatnonzero(index == SpanTable.UNKNOWN)
        if len(unknown):
            new, where = np.unique(key[unknown], return_index=True)
            if self.known.size + len(new) > self.known.room:
                self.known.clear()
                unknown = np.arange(len(key))
                new, where = np.unique(key, return_index=True)
            if len(new) > self.known.room:
                return [self.whole(t) if t else b"" for t in column.to_pylist()]
            where = unknown[where]
            self._learn(new, wide, starts[where], ends[where], spaced[where])
            index[unknown] = self.known.find(wide, starts[unknown], ends[unknown], key[unknown])
        for token in self.added:
            odd |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        counts = np.where(index < 0, -1, self.known.count[index])
        bad = np.concatenate(([0], np.cumsum(counts < 0)))
        odd |= bad[first[1:]] > bad[first[:-1]]
        counts = np.maximum(counts, 0)
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        ids = self.known.ids[np.repeat(self.known.first[index] - bounds[:-1], counts) + np.arange(bounds[-1])].astype("<u4", copy=False)
        out = [ids[s:e].tobytes() for s, e in zip(bounds[first[:-1]].tolist(), bounds[first[1:]].tolist(), strict=True)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(column[i].as_py())
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, spaced: np.ndarray) -> None:
        """Encode unknown pieces of padded ``data`` and remember them."""
        raw = data.tobytes()
        rest = np.concatenate(([0], np.cumsum(_kinds()[data] == 0)))
        simple = rest[ends] == rest[starts]
        quick = np.flatnonzero(simple)
        spans = zip(starts[quick].tolist(), ends[quick].tolist(), spaced[quick].tolist(), strict=True)
        runs = [(SPACE if f else "") + raw[s:e].decode("ascii") for s, e, f in spans]
        remember = lambda which, counts, ids: self.known.learn(data, starts[which], ends[which], keys[which], counts, ids)
        if runs:
            remember(quick, *self._ids([NEWLINE if r == "\n" else r for r in runs], np.ones(len(runs), np.int64)))
        words, parts, of, others = [], [], [], []
        for i in np.flatnonzero(~simple).tolist():
            p, space = raw[starts[i] : ends[i]].decode(), " " if spaced[i] else ""
            if p.isalpha():
                words.append(space + p)
                parts.append(1)
                of.append(i)
            elif m := WORD_AND_MARKS(p):
                words += [space + m[1], m[2]]
                parts.append(2)
                of.append(i)
            else:
                others.append((i, None if any(map(str.isspace, p)) else self.whole(space + p)))
        if words:
            text = "\n".join(words).encode().decode("latin-1").translate(IN_LINES)
            remember(of, *self._ids(text.split("\n"), np.array(parts, np.int64)))
        if others:
            counts = np.array([-1 if x is None else len(x) // 4 for _, x in others], np.int32)
            remember([i for i, _ in others], counts, np.frombuffer(b"".join(x for _, x in others if x), "<u4"))

    def _ids(self, runs: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each, ids) of pieces of ``parts`` pre-tokens each, written in the vocabulary's characters."""
        ids, sizes = [], []
        for s in range(0, len(runs), 1000):
            encoding = self.model.encode("\n".join(runs[s : s + 1000]), add_special_tokens=False)
            ids.append(np.array(encoding.ids, np.uint32))
            sizes.append(np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(runs[s : s + 1000])))
        counts = np.add.reduceat(np.concatenate(sizes), np.cumsum(parts) - parts)
        return counts.astype(np.int32), np.concatenate(ids)


def _pieces(data: np.ndarray, at: np.ndarray):
    """Starts, ends, whether a space belongs to it, of each piece; each text's first piece; is the text to be encoded whole."""
    kind = _kinds()[data]
    n = len(data)
    gap = kind == 4
    edge = np.zeros(n + 1, bool)
    edge[at] = True  # where a text begins, and the end of all
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[edge[:n]] = 4
    after[edge[1:]] = 4
    newline = data == 0x0A
    # White space at a text's edge or next to other white space, or a control character.
    strange = gap & ((before == 4) | (after == 4)) | (kind == 5)
    total = np.concatenate(([0], np.cumsum(strange)))
    odd = total[at[1:]] > total[at[:-1]]
    start = ~gap & ((before == 4) | (kind != before) & (kind > 0) & (before > 0)) | newline
    end = ~gap & ((after == 4) | (kind != after) & (kind > 0) & (after > 0)) | newline
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    spaced = (data[starts - 1] == 0x20) & ~edge[starts] & ~newline[starts]
    return starts, ends, spaced, np.searchsorted(starts, at), odd


def encoded(encoder: Encoder, batch, end: bytes):
    """Lists of (id, ids + end), a row each of a batch of (id, text), for a slice of the text at a time."""
    docs, column = batch.column(0), batch.column(1)
    for first, last in slices(column):
        yield [(doc, ids + end) for doc, ids in zip(docs[first:last].to_pylist(), encoder.encode_column(column[first:last]), strict=True)]

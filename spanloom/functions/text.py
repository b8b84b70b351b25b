"""Native text expressions: white space, punctuation tests, retrieval tokens, hashed vectors."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..batches import small_batches
from ..charsets import RULE_CLAUSE, RULE_SENTENCE, WS, char_class


def stripped_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS))


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WS))


def ends_on(text: Column, members: str, strip: bool = True) -> Column:
    """Is the last character (of the right-stripped text) one of ``members``?"""
    return F.coalesce(F.right(stripped_right(text) if strip else text, F.lit(1)).rlike(char_class(members)), F.lit(False))


def end_rule_column(text: Column, end: Column) -> Column:
    """Why a boundary lies at ``end`` of the whole ``text``, natively."""
    # The last 64 characters tell, unless they are white space throughout.
    near = F.substring(text, F.greatest(F.lit(1), end - 63), F.least(end, F.lit(64)))
    head = F.when(F.length(stripped_right(near)) > 0, near).otherwise(F.substring(text, F.lit(1), end))
    at = F.length(stripped_right(head))
    space = F.substring(head, at + 1, F.length(head))
    breaks = F.length(space) - F.length(F.translate(space, "\r\n", ""))
    last = F.when(at > 0, F.substring(head, at, F.lit(1))).otherwise("")
    sentence, clause = last.rlike(char_class(RULE_SENTENCE)), last.rlike(char_class(RULE_CLAUSE))
    return (
        F.when(end >= F.length(text), "text_end").when(end <= 0, "start")
        .when((breaks > 1) | ((breaks == 1) & sentence), "paragraph").when(breaks == 1, "newline")
        .when(sentence, "sentence").when(clause, "clause").otherwise("budget")
    )


def retrieval_tokens(text: Column) -> Column:
    """Latin and digit runs longer than one, single Han characters, and their pairs, in text order per kind."""
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1)
    han = F.regexp_extract_all(low, F.lit(r"[\x{4E00}-\x{9FFF}]"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(low, F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0)), lambda r: F.length(r) > 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(latin, han, pairs)


_LATIN = re.compile("[a-z0-9]{2,}")
_HAN = re.compile("[\u4e00-\u9fff]+")


def token_list(text: str) -> list[str]:
    """:func:`retrieval_tokens` of one text."""
    low = text.lower()
    out = _LATIN.findall(low)
    if not low.isascii():
        runs = _HAN.findall(low)
        out += [c for r in runs for c in r]
        out += [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays; 0 where one has no length."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def hashed_vector(text: Column, dim: int = 96) -> Column:
    """L2-normalised counts of character trigrams by crc32 modulo ``dim``, newlines removed; null for null.

    Whole batches go through :func:`hashed_vectors`: as expressions, counting looked at
    all trigrams of a text once for each cell.
    """
    if dim < 8:
        raise ValueError("dim must be 8 or more")
    small_batches(SparkSession.getActiveSession())

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        vectors = hashed_vectors([t or "" for t in texts.to_pylist()], dim)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(vectors.ravel()), mask=texts.is_null())

    return run(text)


@functools.lru_cache(1 << 18)
def _checksum(trigram: int) -> int:
    """crc32 of three characters, whose code points are 21 bits each of the number."""
    return zlib.crc32("".join(chr(trigram >> k & 0x1FFFFF) for k in (42, 21, 0)).encode())


#: crc32 of single bytes, from which that of three bytes follows.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
#: Characters of texts whose trigrams are worked out together.
_TOGETHER = 1 << 18


def hashed_vectors(texts: list[str], dim: int = 96) -> np.ndarray:
    """:func:`hashed_vector` for a list of texts, as a chunking strategy's embedder: one row a text.

    The texts' trigrams are numbered all at once, as far as memory for them is bounded.
    """
    out = np.zeros((len(texts), dim))
    flat = [t.replace("\n", "") for t in texts]
    first = held = 0
    for i, t in enumerate(flat):
        if held and held + len(t) > _TOGETHER:
            _count_trigrams(flat[first:i], out[first:i], dim)
            first, held = i, 0
        held += len(t)
    _count_trigrams(flat[first:], out[first:], dim)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))
    return np.divide(out, norm[:, None], out=out, where=norm[:, None] > 0)


def _count_trigrams(flat: list[str], counts: np.ndarray, dim: int) -> None:
    joined = "".join(flat)
    if len(joined) < 3:
        return
    owner = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    inner = owner[:-2] == owner[2:]
    if joined.isascii():
        points = np.frombuffer(joined.encode(), np.uint8)
        bucket = _ascii_checksums(points) % np.uint32(dim)
    else:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bucket = np.zeros(len(points) - 2, np.uint32)
        wide = points > 0x7F
        wide = wide[:-2] | wide[1:-1] | wide[2:]
        bucket[:] = _ascii_checksums((points & 0x7F).astype(np.uint8)) % np.uint32(dim)
        some = np.flatnonzero(wide & inner)
        p = points.astype(np.int64)
        distinct, which = np.unique(p[some] << 42 | p[some + 1] << 21 | p[some + 2], return_inverse=True)
        bucket[some] = (np.fromiter(map(_checksum, distinct.tolist()), np.int64, len(distinct)) % dim)[which]
    whole = np.flatnonzero(inner)
    counts += np.bincount(owner[whole] * dim + bucket[whole], minlength=len(flat) * dim).reshape(-1, dim)


def _ascii_checksums(points: np.ndarray) -> np.ndarray:
    """crc32 of every three consecutive bytes."""
    crc = np.full(len(points) - 2, 0xFFFFFFFF, np.uint32)
    for k in range(3):
        crc = _CRC[(crc & np.uint32(0xFF)) ^ points[k : len(points) - 2 + k]] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


Embedder = Callable[[list[str]], list[list[float]]]

"""Language identification by prediction by partial matching.

Each language has a byte context tree up to ``order``, grown from a bounded
sample of its training texts and then frozen. A byte costs, in its longest known
context, -log2 of its share (count c of n, q distinct followers: c / (n + q)),
or there the escape -log2(q / (n + q)) and then its cost one context shorter,
down to one of 256 bytes at 8 bits. A context the language has never seen costs
nothing to leave. A text's code length is the sum over all its bytes as they
are, the first ones after ``order`` zero bytes; the language with the shortest
code wins.

The trees of all languages are held side by side, only what has been seen: for
each length the known byte strings, with every language's cost of the last byte,
and the known contexts, with every language's cost of leaving. A batch of texts
is scored by looking its bytes' strings up, the longest first.

Defined results: ``und`` with score 0 for a null text or one without a letter,
and for every text if no training row has a language; equal code lengths go to
the language that comes first in order; rows with null language are predicted
but teach nothing; equal training texts of a language are one; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need_columns, remainder, tidy
from .textbytes import byte_view, slices

ORDER, MOST_ORDER = 4, 7
UNIFORM = 8.0


class KeyTable:
    """Distinct 64-bit keys -> their places, by open addressing; looked up by whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        own, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(own):
            free = self.slots[at] < 0
            self.slots[at[free]] = own[free]
            lost = self.slots[at] != own
            own, at = own[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slot(keys)
        found = self.slots[at]
        going = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[going]
        while len(going):
            at = (at + 1) & (len(self.slots) - 1)
            here = self.slots[at]
            found[going] = here
            on = (here >= 0) & (self.keys[here] != keys[going])
            going, at = going[on], at[on]
        return found


@dataclass(frozen=True)
class LanguageModel:
    """For n from 1: the known strings of n bytes and each language's cost of the last byte after
    the others; the known contexts of n - 1 bytes and each language's cost of leaving them."""

    languages: tuple[str, ...]
    order: int
    grams: tuple[np.ndarray, ...] = ()
    costs: tuple[np.ndarray, ...] = ()
    contexts: tuple[np.ndarray, ...] = ()
    leaves: tuple[np.ndarray, ...] = ()


def _padded(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``order`` zeros before each text, and where each text begins and ends."""
    data, at = byte_view(column)
    n = len(at) - 1
    shift = order * np.arange(1, n + 1)
    lengths = np.diff(at)
    out = np.zeros(len(data) + order * n, np.uint8)
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    return out, at[:-1] + shift, at[1:] + shift


def _strings(data: np.ndarray, n: int, order: int) -> np.ndarray:
    """The n bytes that end at each place, as numbers, from place ``order`` on."""
    out = np.zeros(max(0, len(data) - order), np.uint64)
    for k in range(n - 1, -1, -1):
        out = (out << np.uint64(8)) | data[order - k : len(data) - k]
    return out


def _bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.log2(part / whole)


def train(samples: dict[str, list[str]], order: int = ORDER) -> LanguageModel:
    """A model from texts by language."""
    if not 0 <= order <= MOST_ORDER:
        raise ValueError(f"order must be from 0 to {MOST_ORDER}, not {order}")
    languages = tuple(sorted(samples))
    if not languages:
        return LanguageModel((), order)
    inside = []
    for x in languages:
        data, begin, end = _padded(pa.array(samples[x], pa.large_string()), order)
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, begin, 1)
        np.add.at(edge, end, -1)
        inside.append((data, np.flatnonzero(np.cumsum(edge)[order:-1] > 0)))
    grams, costs, contexts, leaves = [], [], [], []
    for n in range(1, order + 2):
        own = [np.unique(_strings(data, n, order)[at], return_counts=True) for data, at in inside]
        keys = np.unique(np.concatenate([k for k, _ in own]))
        heads = np.unique(keys >> np.uint64(8))
        context = np.searchsorted(heads, keys >> np.uint64(8))
        shorter = np.searchsorted(grams[-1], keys & np.uint64((1 << 8 * (n - 1)) - 1)) if n > 1 else None
        cost, leave = np.empty((len(keys), len(languages)), np.float32), np.empty((len(heads), len(languages)), np.float32)
        for k, (known, counts) in enumerate(own):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, known)] = counts
            total = np.bincount(context, count, len(heads))
            kinds = np.bincount(context, count > 0, len(heads))
            leave[:, k] = np.where(total > 0, _bits(kinds, total + kinds), 0.0)
            below = costs[-1][shorter, k] if n > 1 else UNIFORM
            cost[:, k] = np.where(count > 0, _bits(count, (total + kinds)[context]), leave[context, k] + below)
        grams.append(keys)
        costs.append(cost)
        contexts.append(heads)
        leaves.append(leave)
    return LanguageModel(languages, order, tuple(grams), tuple(costs), tuple(contexts), tuple(leaves))


class Scorer:
    def __init__(self, model: LanguageModel):
        self.model = model
        self.grams = [KeyTable(k) for k in model.grams]
        self.contexts = [KeyTable(k) for k in model.contexts]

    def bits(self, column: pa.Array) -> np.ndarray:
        """Code length of each text in each language."""
        m = self.model
        data, begin, end = _padded(column, m.order)
        keys = _strings(data, m.order + 1, m.order)
        cost = np.zeros((len(keys), len(m.languages)), np.float32)
        rest = np.arange(len(keys))
        for n in range(m.order + 1, 0, -1):
            key = keys[rest] & np.uint64((1 << 8 * n) - 1)
            row = self.grams[n - 1].find(key)
            known = row >= 0
            cost[rest[known]] += m.costs[n - 1][row[known]]
            rest, key = rest[~known], key[~known]
            context = self.contexts[n - 1].find(key >> np.uint64(8))
            met = context >= 0
            cost[rest[met]] += m.leaves[n - 1][context[met]]
        cost[rest] += UNIFORM
        sums = np.zeros((len(keys) + 1, len(m.languages)))
        np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:])
        return sums[np.maximum(end - m.order, 0)] - sums[np.maximum(begin - m.order, 0)]


def has_letter(column: pa.Array) -> np.ndarray:
    data, at = byte_view(column)
    ascii_letter = np.concatenate(([0], np.cumsum((data | 0x20) - np.uint8(0x61) < 26)))
    found = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~found & (np.diff(at) > 0)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def fit_languages(
    docs: DataFrame, bound: int = 400, modulus: int = 4, left_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER
) -> LanguageModel:
    """A model from at most about ``bound`` distinct whole texts of each language, chosen by a hash of
    the text among rows whose id's remainder is not ``left_out``."""
    need_columns(docs, id_col, text_col, lang_col)
    rows = docs.where(remainder(id_col, modulus) != left_out).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where("l IS NOT NULL AND t IS NOT NULL")
    counts = rows.groupBy("l").agg(F.count("*").alias("n")).collect()
    cells = 1 << 30
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("l") == r["l"], int(cells * min(1.0, bound / r["n"]))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("t", F.lit("language sample")), F.lit(cells)) < share).distinct()
    samples: dict[str, list[str]] = {r["l"]: [] for r in counts}
    for r in chosen.toLocalIterator():
        samples[r["l"]].append(r["t"])
    return train({k: sorted(v) for k, v in samples.items() if v}, order)


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (posterior of the winner under equal priors)."""

    def run(batches):
        scorer = Scorer(model) if model.languages else None
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            for first, last in slices(batch.column(1), 1 << 19):
                column = batch.column(1)[first:last]
                letters = has_letter(column) if scorer else np.zeros(last - first, bool)
                if scorer:
                    bits = scorer.bits(column)
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                else:
                    best, score = np.zeros(last - first, int), np.zeros(last - first)
                label = names[np.where(letters, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(label, pa.string()), pa.array(np.where(letters, score, 0.0))], names=["id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "id bigint, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict_language(docs, fit_languages(docs))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")

"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its hashed words, pairs of words (all
pairs of a word and itself are one) and character n-grams (of single words, a
space at each end); a softmax over two classes on top is
trained together with the vectors by stochastic gradient descent in numpy.

For scoring, average and softmax commute: each bucket's vector times the
difference of the two output rows is one number, so a text's logit is the mean
of one number per feature. That is the same model, with one table look-up per
feature instead of ``dim``.

Defined results: a null or empty text has no features, and so the bias' score;
without labels every score is 0.5, with labels of one class only it is that
class's smoothed share; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, need_columns, remainder, tidy
from .textbytes import byte_view, hash_spans, mix, separators, slices, word_spans


@dataclass(frozen=True)
class QualityParams:
    bits: int = 15
    dim: int = 16
    grams: tuple[int, ...] = (3, 5)  # each 3 or more
    pairs: bool = True
    epochs: int = 8
    rate: float = 0.6
    bound: int = 4000
    seed: int = 11


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    table: np.ndarray  # one number per word bucket, then per bucket of each gram length
    bias: float


def _characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, white space as a space, a space before each text and after
    the last; and the place of each text's space before it."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    n = len(at) - 1
    out = np.full(len(points) + n + 1, 32, np.uint32)
    out[np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(first))] = points
    small = out < 256
    small[small] = separators("space")[out[small]]
    out[small] = 32
    return out, first + np.arange(n + 1)


def features(data: np.ndarray, at: np.ndarray, p: QualityParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and each gram length: bucket of every feature, and where each text's begin."""
    starts, ends, first = word_spans(data, at, "space")
    size = 1 << p.bits
    words = hash_spans(data, starts, ends)
    out = [((words >> np.uint64(64 - p.bits)).astype(np.int32), first)]
    if p.pairs:
        # The last word of a text begins no pair.
        own = np.ones(len(words), bool)
        own[first[1:][first[1:] > first[:-1]] - 1] = False
        after = np.flatnonzero(own)
        pair = mix(words[after] * np.uint64(0x9E3779B97F4A7C15) + words[after + 1])
        pair[words[after] == words[after + 1]] = 0  # whatever word it is that comes twice
        out.append(((pair >> np.uint64(64 - p.bits)).astype(np.int32) + size, np.searchsorted(after, first)))
    codes, begin = _characters(data, at)
    spaces = np.concatenate(([0], np.cumsum(codes == 32)))
    for number, n in enumerate(p.grams, 1 + p.pairs):
        count = max(0, len(codes) - n + 1)
        # What lies between a gram's ends is inside one word.
        inside = np.flatnonzero(spaces[n - 1 : n - 1 + count] == spaces[1 : 1 + count])
        h = np.zeros(len(inside), np.uint32)
        for k in range(n):
            h = (h ^ codes[inside + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append(((h >> np.uint32(32 - p.bits)).astype(np.int32) + number * size, np.searchsorted(inside, begin)))
    return out


def text_features(text: str, p: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares of the average."""
    data, at = byte_view(pa.array([text], pa.large_string()))
    buckets = np.concatenate([b for b, _ in features(data, at, p)])
    unique, counts = np.unique(buckets, return_counts=True)
    return unique, counts / max(1, len(buckets))


def train(rows: list[tuple[int, str, int]], p: QualityParams) -> QualityModel:
    """Stochastic gradient descent over (id, text, label) rows."""
    size = (1 << p.bits) * (1 + p.pairs + len(p.grams))
    n1 = sum(y for _, _, y in rows)
    if not rows or n1 in (0, len(rows)):
        share = (n1 + 1) / (len(rows) + 2)
        return QualityModel(p, np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (size, p.dim)).astype(np.float32)
    out = np.zeros((2, p.dim), np.float32)
    bias = np.zeros(2, np.float32)
    bags = [text_features(t, p) for _, t, _ in rows]
    labels = [y for _, _, y in rows]
    total, done = p.epochs * len(rows), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(rows)):
            rate = p.rate * (1 - done / total)
            done += 1
            index, share = bags[i]
            share = share.astype(np.float32)
            own = vectors[index]
            mean = share @ own
            logit = out @ mean + bias
            e = np.exp(logit - logit.max())
            slope = e / e.sum()
            slope[labels[i]] -= 1
            back = slope @ out
            out -= rate * np.outer(slope, mean)
            bias -= 0.1 * rate * slope
            # Each vector moves by its share; scaled so that a text moves its mean by about the rate.
            vectors[index] = own - rate / max(float(share @ share), 1e-3) * share[:, None] * back
    direction = out[1] - out[0]
    return QualityModel(p, (vectors @ direction).astype(np.float32), float(bias[1] - bias[0]))


def score_column(column: pa.Array, model: QualityModel) -> np.ndarray:
    p = model.params
    scores = []
    for first, last in slices(column):
        data, at = byte_view(column[first:last])
        total, count = np.zeros(last - first), np.zeros(last - first)
        for bucket, begin in features(data, at, p):
            sums = np.concatenate(([0.0], np.cumsum(model.table[bucket], dtype=np.float64)))
            total += sums[begin[1:]] - sums[begin[:-1]]
            count += np.diff(begin)
        logit = total / np.maximum(count, 1) + model.bias
        scores.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
    return np.concatenate(scores) if scores else np.zeros(0)


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """A model from about ``params.bound`` labelled rows whose id's remainder is not 0."""
    p = params or QualityParams()
    need_columns(labels, id_col, label_col)
    return train(labelled_sample(docs, labels, label_col, p.bound, modulus, 0, id_col, text_col), p)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, quality_score of every row."""

    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_column(batch.column(1), model), pa.float64())], names=["id", "quality_score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "id bigint, quality_score double").withColumnRenamed("id", id_col)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = F.col("quality_score")
    return score_quality(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.3, 1).otherwise(0).alias("predicted"))

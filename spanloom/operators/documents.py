"""Retrieval evaluated document by document, where the text is.

A document's chunks are the scope of its index, so its chunks, their index, the
ranks and the gold answers follow from its row alone: one narrow Arrow map in
which neither a text nor a term is shuffled, only what is counted in the end.
The results are those of the table forms in ``retrieval`` and ``reports``, which
take chunks of any origin.

``asked`` tables are documents with a column ``asked`` of their questions, an
array of {q_idx, q, gold}; :func:`with_questions` makes one from two tables. Each
row is a document of its own, whatever its id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..batches import lean, small_batches, text_slices
from ..charsets import REPORT_PUNCT, WS
from ..functions.text import hashed_vectors, token_list
from . import spans as sp
from .strategies import Families, Piece, Splitter, splitter

Plans = dict[str, tuple[str, dict]]


def with_questions(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with their ``asked``; null where nothing is asked."""
    asked = questions.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col("q_idx").cast("int").alias("q_idx"), "q", "gold"))).alias("asked"))
    return docs.join(asked, id_col, "left")


def windows_of(text: str, max_chars: int, overlap_chars: int = 0) -> list[sp.Span]:
    """Fixed windows, the last of which is the first that reaches the end."""
    step, n = max(1, max_chars - overlap_chars), len(text)
    return [(s, min(s + max_chars, n)) for s in range(0, max(0, -(-(n - max_chars) // step)) * step + 1, step)] if n else []


def _split(strategy: str, params: dict) -> Splitter:
    if strategy != "fixed-window":
        return splitter(strategy, **params)
    size, overlap = params.get("max_chars", 500), params.get("overlap_chars", 0)
    return lambda text: [Piece(s, e) for s, e in windows_of(text, size, overlap)]


def bm25_ranks(chunks: list[str], asked: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> list[list[tuple[int, float]]]:
    """For each question the (seq, score) of the best ``k`` chunks with a positive score, by score to 9 places, then seq."""
    terms = [Counter(token_list(q)) for q in asked]
    wanted = {t for q in terms for t in q}
    lengths, postings = [], {t: [] for t in wanted}
    for seq, chunk in enumerate(chunks):
        tokens = token_list(chunk)
        lengths.append(len(tokens))
        for t, f in Counter(filter(wanted.__contains__, tokens)).items():
            postings[t].append((seq, f))
    n = len(chunks)
    mean = max(1.0, sum(lengths) / n) if n else 1.0
    damp = [k1 * (1 - b + b * dl / mean) for dl in lengths]
    out = []
    for q in terms:
        scores: dict[int, float] = {}
        for t, times in q.items():
            df = len(postings[t])
            weight = times * math.log((n - df + 0.5) / (df + 0.5) + 1) * (k1 + 1)
            for seq, f in postings[t]:
                scores[seq] = scores.get(seq, 0.0) + weight * f / (f + damp[seq])
        best = nsmallest(k, ((-round(s, 9), seq) for seq, s in scores.items() if s > 0))
        out.append([(seq, scores[seq]) for _, seq in best])
    return out


def vector_ranks(chunks: list[str], asked: list[str], k: int, dim: int = 96) -> list[list[tuple[int, float]]]:
    """As :func:`bm25_ranks`, by cosine of hashed vectors."""
    v = hashed_vectors([*chunks, *asked], dim)
    out = []
    for row in v[len(chunks) :] @ v[: len(chunks)].T:
        best = np.lexsort((np.arange(len(row)), -np.round(row, 9)))[:k]
        out.append([(int(i), float(row[i])) for i in best if row[i] > 0])
    return out


RETRIEVERS: dict[str, Callable] = {"bm25": bm25_ranks, "vector": vector_ranks}


def _credit(text: str, pieces: list[Piece], gold: str | None, best: list[int]) -> tuple[int, bool, bool]:
    """(relevant, strict, union) of a question whose best chunks are ``best``."""
    at = text.find(gold) if gold is not None else -1
    if at < 0:
        return 0, False, False
    to, among = at + len(gold), [pieces[i] for i in best]
    relevant = sum(bool(gold) and gold in text[p.start : p.end] for p in among)
    starts, ends = any(p.start <= at < p.end for p in among), any(p.start < to <= p.end for p in among)
    return relevant, relevant > 0, not relevant and starts and ends


def _by_document(df: DataFrame, columns: list[str], work: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema``, after the id, that ``work`` gives for each row of ``columns`` (id, text, more)."""
    source = df.select(*columns)
    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                keep: list[int] = []
                rows: list[tuple] = []
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)):
                    found = work(*values)
                    rows += found
                    keep += [i] * len(found)
                cells = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, t in zip(cells, kinds, strict=True))], names=[columns[0], *(f.name for f in fields)])

    return source.mapInArrow(lean(run), StructType([source.schema[columns[0]], *fields]))


def document_topk(asked: DataFrame, strategy: str, k: int, id_col: str = "doc_id", text_col: str = "text", retriever: str = "bm25", **params) -> DataFrame:
    """strategy, id, q_idx, seq, score, rank of the best ``k`` chunks with a positive score."""
    split, ranks = _split(strategy, params), RETRIEVERS[retriever]

    def work(text, questions):
        if not text or not questions:
            return []
        best = ranks([text[p.start : p.end] for p in split(text)], [q["q"] or "" for q in questions], k)
        return [(strategy, q["q_idx"], seq, score, n) for q, of_q in zip(questions, best, strict=True) for n, (seq, score) in enumerate(of_q, 1)]

    return _by_document(asked, [id_col, text_col, "asked"], work, "strategy string, q_idx int, seq int, score double, rank int")


def document_facts(asked: DataFrame, plans: Plans, k: int, id_col: str = "doc_id", text_col: str = "text", retrievers: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """strategy, retriever, id, q_idx, q, relevant, strict, union of every question, for each of the strategies (name to strategy and parameters)."""
    splits = {name: _split(strategy, params) for name, (strategy, params) in plans.items()}

    def work(text, questions):
        out = []
        for name, split in splits.items() if questions else ():
            pieces = split(text) if text else []
            chunks, words = [text[p.start : p.end] for p in pieces], [q["q"] or "" for q in questions]
            for how in retrievers:
                for q, best in zip(questions, RETRIEVERS[how](chunks, words, k), strict=True):
                    out.append((name, how, q["q_idx"], q["q"], *_credit(text or "", pieces, q["gold"], [i for i, _ in best])))
        return out

    return _by_document(asked, [id_col, text_col, "asked"], work, "strategy string, retriever string, q_idx int, q string, relevant bigint, strict boolean, union boolean")


def document_shapes(asked: DataFrame, plans: Plans, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each strategy and document: id, strategy, total, strict_hits, union_hits, relevant and misses of its questions; chunks, their least, most and covered characters, ends_punct."""
    splits = {name: _split(strategy, params) for name, (strategy, params) in plans.items()}

    def work(text, questions):
        out, asked_for = [], questions or []
        for name, split in splits.items():
            pieces = split(text) if text else []
            chunks = [text[p.start : p.end] for p in pieces]
            best = bm25_ranks(chunks, [q["q"] or "" for q in asked_for], k) if asked_for else []
            facts = [_credit(text or "", pieces, q["gold"], [i for i, _ in of_q]) for q, of_q in zip(asked_for, best, strict=True)]
            sizes = [len(c) for c in chunks]
            missed = [q["q"] for q, (_, strict, union) in zip(asked_for, facts, strict=True) if not strict and not union]
            out.append((
                name, len(facts), sum(s for _, s, _ in facts), sum(u for _, _, u in facts), sum(r for r, _, _ in facts), missed,
                len(chunks), min(sizes, default=None), max(sizes, default=None), sum(sizes), sum((c.rstrip(WS)[-1:] or "a") in REPORT_PUNCT for c in chunks),
            ))
        return out

    return _by_document(
        asked, [id_col, text_col, "asked"], work,
        "strategy string, total bigint, strict_hits bigint, union_hits bigint, relevant bigint, misses array<string>, chunks bigint, least int, most int, covered bigint, ends_punct bigint",
    )


def family_facts(asked: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """id, total, hits, parents, children of every document: its questions, and those whose gold starts in the parent of one of the best ``k`` children."""
    families = Families(**params)

    def work(text, questions):
        parents, children = families.split(text) if text else ([], [])
        hits = 0
        if questions:
            best = bm25_ranks([text[p.start : p.end] for p in children] if text else [], [q["q"] or "" for q in questions], k)
            for q, of_q in zip(questions, best, strict=True):
                at = text.find(q["gold"]) if text and q["gold"] is not None else -1
                over = {children[i].meta["parent_seq"] for i, _ in of_q}
                hits += at >= 0 and any(parents[n].start <= at < parents[n].end for n in over)
        return [(len(questions or ()), int(hits), len(parents), len(children))]

    return _by_document(asked, [id_col, text_col, "asked"], work, "total bigint, hits bigint, parents bigint, children bigint")


def parent_recall_of(families: DataFrame, k: int) -> DataFrame:
    """k, total, hits, recall of :func:`family_facts`."""
    total, hits = (F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "hits"))
    return families.agg(F.lit(k).alias("k"), total.alias("total"), hits.alias("hits"), (hits / F.greatest(F.lit(1), total)).alias("recall"))


def _gathered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id: its first text, and a list of those that repeat the id, which is empty but for odd tables."""
    texts = F.collect_list(text_col)
    return docs.groupBy(id_col).agg(texts.alias("_texts")).select(id_col, F.get("_texts", F.lit(0)).alias("_first"), F.when(F.size("_texts") > 1, F.slice("_texts", 2, F.size("_texts"))).alias("_more"))


def _window_terms(first, more, max_chars: int) -> list[tuple[int, list[str]]]:
    return [(seq, token_list(t[s:e])) for t in (first, *(more or ())) if t for seq, (s, e) in enumerate(windows_of(t, max_chars))]


def window_terms(docs: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq, terms, tokens: distinct and all retrieval tokens of every window that has any."""

    def work(first, more):
        held: dict[int, list[str]] = {}
        for seq, tokens in _window_terms(first, more, max_chars):
            if tokens:
                held.setdefault(seq, []).extend(tokens)
        return [(seq, len(set(tokens)), len(tokens)) for seq, tokens in held.items()]

    return _by_document(_gathered(docs, id_col, text_col), [id_col, "_first", "_more"], work, "seq int, terms bigint, tokens bigint")


def document_idf(docs: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, terms, n_chunks, avg_len, idf_sum: the index of every document that has terms, in windows."""

    def work(first, more):
        chunks = _window_terms(first, more, max_chars)
        df = Counter(t for _, t in {(seq, t) for seq, tokens in chunks for t in tokens})
        if not df:
            return []
        n = len(chunks)
        # Terms of equal frequency have equal weights.
        idf = math.fsum(many * math.log((n - k + 0.5) / (k + 0.5) + 1) for k, many in Counter(df.values()).items())
        return [(len(df), n, sum(len(tokens) for _, tokens in chunks) / n, idf)]

    return _by_document(_gathered(docs, id_col, text_col), [id_col, "_first", "_more"], work, "terms bigint, n_chunks bigint, avg_len double, idf_sum double")


def window_rules(docs: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq, end_rule of every fixed window: why its end lies where it does, without a copy of the text."""

    def work(text):
        ends = [e for _, e in windows_of(text, max_chars)] if text else []
        return list(enumerate(sp.end_rules(text, ends)))

    return _by_document(docs, [id_col, text_col], work, "seq int, end_rule string")

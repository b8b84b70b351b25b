"""Chunking strategies: a table of documents in, a table of chunks with exact offsets out.

``chunk_documents`` plans one narrow step (no shuffle): fixed windows as native
expressions, all others as an Arrow map whose per-document work is linear. Rows:

    <id>, seq, start, end, text, strategy,
    meta {overlap_chars, headings, parent_seq, child_seqs, end_rule, start_rule}

``text`` always equals the source's slice [start, end) in code points. Null and
empty texts have no chunks; meta fields that a strategy does not produce are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..batches import lean, small_batches, text_slices
from ..functions.counters import chars_for_tokens, get_counter
from ..functions.text import hashed_vectors
from . import spans as sp

META = StructType([
    StructField("overlap_chars", IntegerType()),
    StructField("headings", ArrayType(StringType())),
    StructField("parent_seq", IntegerType()),
    StructField("child_seqs", ArrayType(IntegerType())),
    StructField("end_rule", StringType()),
    StructField("start_rule", StringType()),
])
CHUNK_FIELDS = [
    StructField("seq", IntegerType()),
    StructField("start", IntegerType()),
    StructField("end", IntegerType()),
    StructField("text", StringType()),
    StructField("strategy", StringType()),
    StructField("meta", META),
]
_ARROW_META = pa.struct([
    ("overlap_chars", pa.int32()), ("headings", pa.list_(pa.string())), ("parent_seq", pa.int32()),
    ("child_seqs", pa.list_(pa.int32())), ("end_rule", pa.string()), ("start_rule", pa.string()),
])


@dataclass(slots=True)
class Piece:
    """All pieces that a splitter gives for one text have the same fields in ``meta``."""

    start: int
    end: int
    meta: dict[str, Any] = field(default_factory=dict)


Splitter = Callable[[str], list[Piece]]


def _check_sizes(most: int, overlap: int, unit: str = "chars") -> None:
    if most < 1:
        raise ValueError(f"max_{unit} must be >= 1, not {most}")
    if not 0 <= overlap < most:
        raise ValueError(f"overlap_{unit} must be in [0, max_{unit}), not {overlap}")


def _explained(text: str, pieces: list[Piece], overrides: list[str] | None = None) -> list[Piece]:
    before = "text_start"
    for i, p in enumerate(pieces):
        p.meta["start_rule"] = before
        before = p.meta["end_rule"] = overrides[i] if overrides and overrides[i] else sp.end_rule(text, p.end)
    return pieces


def _pieces(text: str, spans, overlap: int, limit: int | None, explain: bool, overrides=None) -> list[Piece]:
    out = [Piece(s, e, {"overlap_chars": n}) for s, e, n in sp.overlapped(text, spans, overlap, limit)]
    return _explained(text, out, overrides) if explain else out


def recursive(max_chars: int = 500, overlap_chars: int = 50, explain: bool = False) -> Splitter:
    """Paragraphs, lines, sentences, clauses, characters: only as deep as needed."""
    _check_sizes(max_chars, overlap_chars)

    def split(text: str) -> list[Piece]:
        atoms = [(s, e, e - s) for s, e in sp.recursive_atoms(text, max_chars)]
        return _pieces(text, sp.packed(atoms, max_chars), overlap_chars, max_chars, explain)

    return split


def sentence(max_chars: int = 500, overlap_chars: int = 0, explain: bool = False) -> Splitter:
    """Whole sentences together; one longer than the budget stays whole."""
    _check_sizes(max_chars, overlap_chars)

    def split(text: str) -> list[Piece]:
        atoms = [(s, e, e - s) for s, e in sp.sentence_spans(text)]
        return _pieces(text, sp.packed(atoms, max_chars), overlap_chars, max_chars, explain)

    return split


def token(max_tokens: int = 512, overlap_tokens: int = 0, counter: str | Callable[[str], int] = "char", explain: bool = False) -> Splitter:
    """Sentences together up to a token budget."""
    _check_sizes(max_tokens, overlap_tokens, "tokens")
    if isinstance(counter, str):
        get_counter(counter)  # an unknown name fails where the plan is made

    def split(text: str) -> list[Piece]:
        count = get_counter(counter)
        spans = sp.packed(sp.token_atoms(text, count, max_tokens), max_tokens)
        overlap = chars_for_tokens(text, overlap_tokens, count) if overlap_tokens else 0
        return _pieces(text, spans, overlap, None, explain)

    return split


def markdown(max_chars: int = 500, overlap_chars: int = 50, explain: bool = False) -> Splitter:
    """One chunk per section, larger sections recursively; nothing crosses a heading."""
    inner = recursive(max_chars, overlap_chars, explain)

    def split(text: str) -> list[Piece]:
        out: list[Piece] = []
        for path, s, e in sp.sections(text):
            part = [Piece(0, e - s, {"overlap_chars": 0})] if e - s <= max_chars else inner(text[s:e])
            for p in part:
                out.append(Piece(p.start + s, p.end + s, {"overlap_chars": p.meta["overlap_chars"], "headings": list(path)}))
        if explain:
            last_of_section = {e for _, _, e in sp.sections(text)} - {len(text)}
            _explained(text, out, ["heading" if p.end in last_of_section else "" for p in out])
        return out

    return split


def semantic(
    embed_fn: Callable[[list[str]], list[list[float]]] = hashed_vectors,
    similarity_threshold: float = 0.55,
    max_chars: int = 500,
    min_chars: int = 50,
    overlap_chars: int = 0,
    explain: bool = True,
) -> Splitter:
    """Cuts where adjacent sentences' vectors differ, within a size budget."""
    _check_sizes(max_chars, overlap_chars)
    if not 0 <= min_chars <= max_chars:
        raise ValueError(f"min_chars must be in [0, max_chars], not {min_chars}")

    def split(text: str) -> list[Piece]:
        atoms = sp.sentence_spans(text)
        vectors = embed_fn([text[s:e] for s, e in atoms])
        if len(vectors) != len(atoms):
            raise ValueError(f"embed_fn gave {len(vectors)} vectors for {len(atoms)} texts")
        v = np.asarray(vectors, float).reshape(len(atoms), -1)
        long = np.sqrt(np.einsum("ij,ij->i", v, v))
        both = long[1:] * long[:-1]
        similar = [1.0, *np.divide(np.einsum("ij,ij->i", v[1:], v[:-1]), both, out=np.zeros(len(both)), where=both > 0).tolist()]
        groups, why = sp.fold_semantic(text, atoms, similar, similarity_threshold, min_chars, max_chars)
        return _pieces(text, groups, overlap_chars, max_chars, explain, why)

    return split


@dataclass(frozen=True)
class Families:
    """Parents and, inside each, children; both recursive."""

    parent_max: int = 600
    child_max: int = 150
    child_overlap: int = 30
    parent_overlap: int = 0
    explain: bool = False

    def __post_init__(self):
        if not 1 <= self.child_max < self.parent_max:
            raise ValueError(f"child_max must be in [1, parent_max), not {self.child_max}")
        if not 0 <= self.child_overlap < self.child_max:
            raise ValueError(f"child_overlap must be in [0, child_max), not {self.child_overlap}")
        if not 0 <= self.parent_overlap < self.parent_max:
            raise ValueError(f"parent_overlap must be in [0, parent_max), not {self.parent_overlap}")

    def split(self, text: str) -> tuple[list[Piece], list[Piece]]:
        outer, inner = recursive(self.parent_max, self.parent_overlap), recursive(self.child_max, self.child_overlap, self.explain)
        parents, children = outer(text), []
        for n, parent in enumerate(parents):
            own = []
            for p in inner(text[parent.start : parent.end]):
                own.append(len(children))
                children.append(Piece(p.start + parent.start, p.end + parent.start, {**p.meta, "parent_seq": n}))
            parent.meta["child_seqs"] = own
        return parents, children


def parent_child(**params) -> Splitter:
    families = Families(**params)
    return lambda text: families.split(text)[1]


STRATEGIES: dict[str, Callable[..., Splitter]] = {
    "recursive": recursive, "sentence": sentence, "token": token, "markdown": markdown, "semantic": semantic, "parent-child": parent_child,
}


def splitter(strategy: str = "recursive", **params) -> Splitter:
    """The strategy's function text -> pieces. ``max_chars`` means ``max_tokens`` for token, ``child_max`` for parent-child."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose one of {', '.join([*STRATEGIES, 'fixed-window'])}")
    renamed = {"token": {"max_chars": "max_tokens", "overlap_chars": "overlap_tokens"}, "parent-child": {"max_chars": "child_max", "overlap_chars": "child_overlap"}}
    names = renamed.get(strategy, {})
    return STRATEGIES[strategy](**{names.get(k, k): v for k, v in params.items()})


def fixed_window_spans(text: Column, max_chars: int, overlap_chars: int = 0) -> Column:
    """Array of {start, end} windows of a text, native; stops at the first that reaches the end."""
    step = max(1, max_chars - overlap_chars)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - max_chars) / step)).cast("int") * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(s + max_chars, n).cast("int").alias("end")))


def windows_with(df: DataFrame, keep: tuple[str, ...], max_chars: int, overlap_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fixed windows as ``chunk_documents`` gives them, with columns of the document to ``keep``."""
    if max_chars < 1:
        raise ValueError(f"max_chars must be >= 1, not {max_chars}")
    text, step = F.col(text_col), max(1, max_chars - overlap_chars)
    # One pass over the text: at every step, what a window sees ahead. Windows beyond the first that reaches the end go.
    ahead = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{max_chars}}})).{{1,{step}}}"), F.lit(1))
    many = F.greatest(F.lit(0), F.ceil((F.length(text) - max_chars) / step)).cast("int") + 1
    cut = df.select(F.col(id_col), *keep, F.posexplode(F.when(F.length(text) > 0, F.slice(ahead, 1, many))).alias("seq", "_window"))
    null = lambda kind: F.lit(None).cast(kind)
    meta = F.struct(
        F.when(F.col("seq") > 0, overlap_chars).otherwise(0).cast("int").alias("overlap_chars"), null("array<string>").alias("headings"), null("int").alias("parent_seq"),
        null("array<int>").alias("child_seqs"), null("string").alias("end_rule"), null("string").alias("start_rule"),
    )
    start = F.col("seq") * step
    return cut.select(id_col, "seq", start.alias("start"), (start + F.length("_window")).alias("end"), F.col("_window").alias("text"), F.lit("fixed-window").alias("strategy"), meta.alias("meta"), *keep)


def _meta_column(name: str, kind: pa.DataType, rows: list[tuple[int, str, Piece]]) -> pa.Array:
    """One field of all pieces' meta; fields that a strategy does not produce are null throughout."""
    return pa.array([p.meta.get(name) for _, _, p in rows], kind) if name in rows[0][2].meta else pa.nulls(len(rows), kind)


def _emit(batch: pa.RecordBatch, keep: list[int], rows: list[tuple[int, str, Piece]], name: str, ids: str) -> pa.RecordBatch:
    take = batch.column(0).take(pa.array(keep, pa.int64()))
    meta = [_meta_column(f.name, f.type, rows) for f in _ARROW_META] if rows else [pa.nulls(0, f.type) for f in _ARROW_META]
    columns = [
        take,
        pa.array([n for n, _, _ in rows], pa.int32()),
        pa.array([p.start for _, _, p in rows], pa.int32()),
        pa.array([p.end for _, _, p in rows], pa.int32()),
        pa.array([t[p.start : p.end] for _, t, p in rows], pa.string()),
        pa.repeat(pa.scalar(name), len(rows)),
        pa.StructArray.from_arrays(meta, fields=list(_ARROW_META)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[ids, *(f.name for f in CHUNK_FIELDS)])


def _mapped(df: DataFrame, id_col: str, text_col: str, name: str, split: Splitter) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch.column(1)):
                part = batch.slice(first, last - first)
                keep: list[int] = []
                rows: list[tuple[int, str, Piece]] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for n, piece in enumerate(split(text) if text else ()):
                        keep.append(i)
                        rows.append((n, text, piece))
                yield _emit(part, keep, rows, name, id_col)

    source = df.select(id_col, text_col)
    return source.mapInArrow(lean(run), StructType([source.schema[id_col], *CHUNK_FIELDS]))


def chunk_documents(df: DataFrame, strategy: str = "recursive", id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """Chunks of every document of ``df``; works on batch and streaming tables alike."""
    if strategy == "fixed-window":
        return windows_with(df, (), params.get("max_chars", 500), params.get("overlap_chars", 0), id_col, text_col)
    return _mapped(df, id_col, text_col, strategy, splitter(strategy, **params))


def family_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of every document; parents list their child_seqs."""
    families = Families(**params)
    return (
        _mapped(df, id_col, text_col, "parent-child", lambda text: families.split(text)[0]),
        _mapped(df, id_col, text_col, "parent-child", lambda text: families.split(text)[1]),
    )


def split_text(text: Column, strategy: str = "recursive", **params) -> Column:
    """Chunk texts of a column as an array, for pipelines that want nothing else."""
    split = splitter(strategy, **params)
    small_batches(SparkSession.getActiveSession())

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        # A slice's parts are Python objects, the batch's are bytes.
        parts = [pa.array([[t[p.start : p.end] for p in split(t)] if t else [] for t in texts[a:b].to_pylist()], pa.list_(pa.string())) for a, b in text_slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(text)


def sentence_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every sentence tile of every document, as chunks of strategy ``sentence-tile``."""
    return _mapped(df, id_col, text_col, "sentence-tile", lambda text: [Piece(s, e) for s, e in sp.sentence_spans(text)])


def section_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every Markdown section with its heading path, as chunks of strategy ``section``."""
    return _mapped(df, id_col, text_col, "section", lambda text: [Piece(s, e, {"headings": list(path)}) for path, s, e in sp.sections(text)])

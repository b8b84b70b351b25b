"""The SQL surface: table functions over one text, and scalar functions.

    SELECT c.* FROM documents, LATERAL chunks(text, 'recursive', 400, 50) AS c
    SELECT token_count(text), end_rule(text, 120) FROM documents
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..charsets import OTHER_CLASS, RULE_CLAUSE, RULE_SENTENCE, WS, char_class
from ..operators.spans import sections, sentence_spans
from ..operators.strategies import splitter

CHUNK = "seq int, start int, end int, text string, overlap_chars int, headings array<string>, parent_seq int, start_rule string, end_rule string"


class Chunks:
    """(text, strategy, max_chars, overlap_chars) to chunks with their rules."""

    def eval(self, text: str, strategy: str = "recursive", max_chars: int = 500, overlap_chars: int = 50) -> Iterator[tuple]:
        if not text:
            return
        size = "child_max" if strategy == "parent-child" else "max_chars"
        lap = "child_overlap" if strategy == "parent-child" else "overlap_chars"
        for n, p in enumerate(splitter(strategy, explain=True, **{size: max_chars, lap: overlap_chars})(text)):
            m = p.meta
            yield n, p.start, p.end, text[p.start : p.end], m.get("overlap_chars"), m.get("headings"), m.get("parent_seq"), m.get("start_rule"), m.get("end_rule")


class Sentences:
    def eval(self, text: str) -> Iterator[tuple]:
        for n, (s, e) in enumerate(sentence_spans(text) if text else ()):
            yield n, s, e, text[s:e]


class Sections:
    def eval(self, text: str) -> Iterator[tuple]:
        for n, (path, s, e) in enumerate(sections(text) if text else ()):
            yield n, s, e, list(path), text[s:e]


def register(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql``."""
    spark.udtf.register("chunks", F.udtf(Chunks, returnType=CHUNK))
    spark.udtf.register("sentences", F.udtf(Sentences, returnType="seq int, start int, end int, text string"))
    spark.udtf.register("sections", F.udtf(Sections, returnType="seq int, start int, end int, headings array<string>, text string"))
    for name, (parameters, kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")


def _literal(text: str) -> str:
    """A string literal; other than letters, digits and plain marks go by number."""
    return "'" + "".join(c if c.isascii() and c.isalnum() or c in " .,:*+[]{}()^-" else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in text) + "'"


_RUN = _literal(OTHER_CLASS + "+")
_NEAR = f"""CASE WHEN length(trim(TRAILING {_literal(WS)} FROM substring(t, greatest(1, e - 63), least(e, 64)))) > 0 THEN substring(t, greatest(1, e - 63), least(e, 64)) ELSE substring(t, 1, e) END"""
#: name -> parameters, type, body: expressions that Spark compiles, no Python.
SCALAR = {
    "token_count": ("t STRING", "INT", f"CAST(length(regexp_replace(t, {_RUN}, '')) + aggregate(regexp_extract_all(t, {_RUN}, 0), 0, (n, r) -> n + CAST(ceil(length(r) / 4) AS INT) + 1) AS INT)"),
    # Of what stands before the end: its last character but white space, and the line breaks after that.
    "end_rule": ("t STRING, e INT", "STRING", f"""transform(transform(array({_NEAR}), h -> named_struct(
        'last', right(trim(TRAILING {_literal(WS)} FROM h), 1), 'breaks', length(h) - length(trim(TRAILING {_literal(WS)} FROM h)) - length(translate(substring(h, length(trim(TRAILING {_literal(WS)} FROM h)) + 1), '\\r\\n', '')))),
        x -> CASE WHEN t IS NULL OR e IS NULL THEN NULL WHEN e >= length(t) THEN 'text_end' WHEN e <= 0 THEN 'start'
          WHEN x.breaks > 1 OR (x.breaks = 1 AND x.last RLIKE {_literal(char_class(RULE_SENTENCE))}) THEN 'paragraph' WHEN x.breaks = 1 THEN 'newline'
          WHEN x.last RLIKE {_literal(char_class(RULE_SENTENCE))} THEN 'sentence' WHEN x.last RLIKE {_literal(char_class(RULE_CLAUSE))} THEN 'clause' ELSE 'budget' END)[0]"""),
}

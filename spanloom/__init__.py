"""Span analytics on Spark: chunk tables with exact offsets, retrieval evaluation, resumable jobs.

Names are loaded as they are first used, so a Python worker imports no more than its operator needs.
"""

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "functions.counters": ["count_chars", "get_counter", "token_count"],
    "functions.sql": ["register"],
    "functions.text": ["hashed_vector", "hashed_vectors"],
    "operators.strategies": ["STRATEGIES", "chunk_documents", "family_documents", "section_documents", "sentence_documents", "split_text", "splitter"],
    "sources.clients": ["ChatClient", "EmbeddingClient", "ServiceError"],
    "sources.files": ["chunk_file", "chunk_files", "load_docs_dir", "read_chunks", "write_jsonl", "write_jsonl_file"],
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}

__all__ = ["chunk", *_MODULE]  # noqa: PLE0604


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_MODULE[name]}", __name__), name)


def chunk(text: str, strategy: str = "recursive", **params) -> list[dict]:
    """Chunks of one text, without Spark: seq, start, end, text, strategy and meta."""
    from .operators.strategies import splitter

    pieces = splitter(strategy, **params)(text) if text else []
    return [{"seq": n, "start": p.start, "end": p.end, "text": text[p.start : p.end], "strategy": strategy, "meta": p.meta} for n, p in enumerate(pieces)]

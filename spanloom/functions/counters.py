"""Token counters: the character heuristic as Python and as a Column, and plug-ins."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..charsets import CJK, OTHER_CLASS, WS

def count_chars(text: str) -> int:
    """A CJK character or white space is one token, another run of n is ceil(n / 4) + 1."""
    cjk_or_space = _SINGLE.findall(text)
    runs = _OTHER.findall(text)
    return len(cjk_or_space) + sum(-(-len(r) // 4) + 1 for r in runs)


@functools.cache
def _singles() -> np.ndarray:
    """For every code point: is it a token by itself? The rest, in runs, cost a quarter and one."""
    return np.array([bool(_SINGLE.match(chr(i))) for i in range(0x10000)] + [False] * 0x100000)


def count_spans(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """:func:`count_chars` of consecutive, non-empty spans of a text."""
    if len(text) < 200:
        return [count_chars(text[s:e]) for s, e in spans]
    single = _singles()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    edge = np.zeros(len(text) + 1, bool)
    edge[starts] = edge[ends] = True
    run = ~single
    begins = np.flatnonzero(run & (edge[:-1] | np.concatenate(([True], single[:-1]))))
    stops = np.flatnonzero(run & (edge[1:] | np.concatenate((single[1:], [True])))) + 1
    total = np.concatenate(([0], np.cumsum(single)))
    cost = np.concatenate(([0], np.cumsum(-(-(stops - begins) // 4) + 1)))
    return (total[ends] - total[starts] + cost[np.searchsorted(begins, ends)] - cost[np.searchsorted(begins, starts)]).tolist()


_SINGLE = re.compile(f"[{CJK}{re.escape(WS)}]")
_OTHER = re.compile(f"[^{CJK}{re.escape(WS)}]+")


def token_count(text: Column) -> Column:
    """:func:`count_chars` as a native expression; null for null."""
    runs = F.regexp_extract_all(text, F.lit(OTHER_CLASS + "+"), F.lit(0))
    singles = F.length(F.regexp_replace(text, OTHER_CLASS + "+", ""))
    return (singles + F.aggregate(runs, F.lit(0), lambda n, r: n + F.ceil(F.length(r) / 4).cast("int") + 1)).cast("int")


def _jieba() -> Callable[[str], int]:
    import jieba

    return lambda text: len([w for w in jieba.cut(text) if w.strip()])


def _tiktoken() -> Callable[[str], int]:
    import tiktoken

    encoding = tiktoken.get_encoding("cl100k_base")
    return lambda text: len(encoding.encode(text))


COUNTERS: dict[str, Callable[[], Callable[[str], int]]] = {"char": lambda: count_chars, "jieba": _jieba, "tiktoken": _tiktoken}


def get_counter(name: str | Callable[[str], int]) -> Callable[[str], int]:
    """A counter by name (any case), or the given callable itself."""
    if callable(name):
        return name
    if name.lower() not in COUNTERS:
        raise ValueError(f"unknown counter {name!r}; choose one of {', '.join(sorted(COUNTERS))}")
    try:
        return COUNTERS[name.lower()]()
    except ImportError as error:
        raise ValueError(f"counter {name!r} needs a library that is not installed: {error.name}") from error


def chars_for_tokens(text: str, tokens: int, count: Callable[[str], int]) -> int:
    """About how many characters hold ``tokens`` tokens of a text."""
    if not text:
        return 0
    n = count_spans(text, [(0, len(text))])[0] if count is count_chars else count(text)
    return max(1, round(tokens * len(text) / n)) if n else len(text)


def chars_for_tokens_column(text: Column, tokens: int) -> Column:
    n = token_count(text)
    return F.when(F.length(text) == 0, 0).when(n == 0, F.length(text)).otherwise(F.greatest(F.lit(1), F.bround(tokens * F.length(text) / n, 0).cast("int")))

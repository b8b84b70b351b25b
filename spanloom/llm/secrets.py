"""Secret scans with grammar inference.

Base rules find credentials by their surroundings or shape. What they find are
labelled credentials. For each kind of them a prefix tree is grown over their
characters, and its statistically compatible states (Hoeffding bound on ending
and transition frequencies, red-blue order) are merged into a probabilistic
automaton; another one is inferred from the other long tokens of the corpus.
Every candidate token of every text is scored by the difference of its code
lengths per character, and one that looks like a credential is added as a
``format`` span. Base spans stay whatever their score.

Candidates are all runs of 12 or more of ``CANDIDATE``'s characters, letters
alone or not, marked or not. One that base spans cover whole adds nothing, as it
is found already.

The automata are fitted to the tokens of a bounded sample of texts (``sample``
texts chosen by a hash of the text, of them ``bound`` distinct tokens of each
kind); every text is scanned and scored in one pass.

Defined results: a null or empty text has no spans; rows that repeat are scanned
each; a sample without any labelled credential adds nothing; offsets count code
points, the end is exclusive; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_fraction, map_whole, need_columns, tidy
from .textbytes import slices

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# Maximal runs of one class: asking for the length in the pattern finds the same matches as filtering by it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def base_values(text: str):
    """(kind, credential) of what the base rules find."""
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield 0, m[2]
    for kind, rule in ((1, ACCESS), (2, HEX)):
        for m in rule.finditer(text):
            yield kind, m[0]


def _class(c: str) -> str:
    """Digit, lower or upper case (up to f or beyond), or symbol."""
    if c.isdigit():
        return "d"
    return ("h" if c <= "f" else "l") if c.islower() else ("H" if c <= "F" else "U") if c.isupper() else "s"


#: Characters that a state has not seen share its escape evenly: as many as are printable in ASCII, and the end.
PRINTABLE = 95


class FormatAutomaton:
    """Deterministic and probabilistic over characters.

    A state with n departures of q kinds gives a kind seen c times the share
    c / (n + q + 1); the rest is its escape. A character it has not seen goes
    where most of its class go, else where most go.
    """

    def __init__(self, moves: list[dict[str, int]], taken: list[Counter], ends: list[int]):
        self.moves: list[dict[str, tuple[int, float]]] = []
        self.others: list[tuple[dict[str, int], int, float]] = []
        self.stop: list[float] = []
        for to, count, ended in zip(moves, taken, ends, strict=True):
            count = {c: n for c, n in count.items() if n}
            total = sum(count.values()) + ended
            kinds = len(count) + (ended > 0)
            whole = total + kinds + 1
            escape = math.log2(whole * PRINTABLE / (kinds + 1))
            self.moves.append({c: (to[c], math.log2(whole / n)) for c, n in count.items()})
            by_class: dict[str, Counter] = {}
            every: Counter = Counter()
            for c, n in count.items():
                by_class.setdefault(_class(c), Counter())[to[c]] += n
                every[to[c]] += n
            most = lambda x: min(x, key=lambda k: (-x[k], k)) if x else 0
            self.others.append(({k: most(x) for k, x in by_class.items()}, most(every), escape))
            self.stop.append(math.log2(whole / ended) if ended else escape)

    def __len__(self) -> int:
        return len(self.stop)

    def bits(self, token: str) -> float:
        """Code length of the token and its end."""
        total, state = 0.0, 0
        for c in token:
            step = self.moves[state].get(c)
            if step is None:
                by_class, most, cost = self.others[state]
                state = by_class.get(_class(c), most)
            else:
                state, cost = step
            total += cost
        return total + self.stop[state]


class _PrefixTree:
    """States with how often they ended and how often each character left them."""

    def __init__(self, strings: list[str]):
        self.ended, self.flow, self.child = [0], [Counter()], [{}]
        for s in strings:
            state = 0
            for c in s:
                self.flow[state][c] += 1
                nxt = self.child[state].get(c)
                if nxt is None:
                    nxt = self.child[state][c] = len(self.child)
                    self.ended.append(0)
                    self.flow.append(Counter())
                    self.child.append({})
                state = nxt
            self.ended[state] += 1
        self._shares: dict[int, tuple[int, dict[str, float]]] = {}

    def shares(self, s: int) -> tuple[int, dict[str, float]]:
        """Visits, and the share of each class of characters and of ending (the empty class)."""
        if s not in self._shares:
            held: Counter = Counter({"": self.ended[s]})
            for c, n in self.flow[s].items():
                held[_class(c)] += n
            total = sum(held.values())
            self._shares[s] = total, {k: n / total for k, n in held.items() if n}
        return self._shares[s]

    def compatible(self, a: int, b: int, bound: float) -> bool:
        """No class or character of the two, or of what follows on both, differs by more than chance."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            (n, of_a), (m, of_b) = self.shares(a), self.shares(b)
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(of_a.get(k, 0) - of_b.get(k, 0)) > most for k in {*of_a, *of_b}):
                return False
            if any(abs(self.flow[a][c] / n - self.flow[b][c] / m) > most for c in {*self.flow[a], *self.flow[b]}):
                return False
            todo += [(x, self.child[b][c]) for c, x in self.child[a].items() if c in self.child[b] and x != self.child[b][c]]
        return True

    def apart(self, a: int, b: int) -> float:
        of_a, of_b = self.shares(a)[1], self.shares(b)[1]
        return sum(abs(of_a.get(k, 0) - of_b.get(k, 0)) for k in {*of_a, *of_b})

    def fold(self, a: int, b: int) -> None:
        """Add all of b's subtree to a's."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self._shares.pop(a, None)
            self.ended[a] += self.ended[b]
            self.flow[a].update(self.flow[b])
            for c, y in self.child[b].items():
                if c in self.child[a]:
                    todo.append((self.child[a][c], y))
                else:
                    self.child[a][c] = y


def infer(strings: list[str], alpha: float = 0.05) -> FormatAutomaton:
    """Merge compatible prefix-tree states of the strings into a probabilistic automaton.

    States are compared by the frequencies of their characters and of classes of
    characters, as single ones of a large alphabet are all rare. Of the kept
    states a new one is compatible with, it is merged with the one whose classes
    are most alike (its parent first, then the last kept); with none, it is kept.
    """
    tree = _PrefixTree(strings)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, open_from = [0], [0]
    kept = {0}
    while open_from:
        parent = open_from[-1]
        c = min((c for c, x in tree.child[parent].items() if x not in kept), default=None)
        if c is None:
            open_from.pop()
            continue
        state = tree.child[parent][c]
        order = sorted((tree.apart(r, state), r != parent, -i, r) for i, r in enumerate(red))
        into = next((r for *_, r in order if tree.compatible(r, state, bound)), None)
        if into is None:
            kept.add(state)
            red.append(state)
            open_from.append(state)
        else:
            tree.child[parent][c] = into
            tree.fold(into, state)
            # Folding may have given any state new children.
            open_from = list(red)
    name = {s: i for i, s in enumerate(red)}
    return FormatAutomaton([{c: name[x] for c, x in tree.child[s].items()} for s in red], [tree.flow[s] for s in red], [tree.ended[s] for s in red])


@dataclass(frozen=True)
class SecretModel:
    """``credentials``: an automaton for each kind that has been seen."""

    credentials: tuple[FormatAutomaton, ...] = ()
    ordinary: FormatAutomaton | None = None
    margin: float = 1.0
    known: dict = field(default_factory=dict, compare=False)

    def likely(self, token: str) -> float:
        """Bits per character by which a token is likelier a credential than an ordinary token."""
        if not self.credentials or self.ordinary is None:
            return -math.inf
        best = min(a.bits(token) for a in self.credentials) + math.log2(len(self.credentials))
        return (self.ordinary.bits(token) - best) / len(token)

    def tells(self, token: str) -> bool:
        """Is it a credential? Short tokens, many of which repeat, are remembered."""
        if len(token) > 64:
            return self.likely(token) >= self.margin
        answer = self.known.get(token)
        if answer is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            answer = self.known[token] = self.likely(token) >= self.margin
        return answer


def all_spans(text: str, model: SecretModel) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base spans and of candidates that the automata tell to be credentials, in order."""
    base = base_spans(text)
    starts, ends = _joined(base)
    out = list(base)
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if model.tells(m[0]) and not covered(starts, ends, s, e):
            out.append((s, 3, e))
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans (in order) cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def covered(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Does one of the stretches hold all of start..end?"""
    i = bisect_right(starts, start) - 1
    return i >= 0 and end <= ends[i]


def touched(starts: list[int], ends: list[int], start: int, end: int) -> bool:
    """Does one of the stretches hold a part of start..end?"""
    i = bisect_left(starts, end) - 1
    return i >= 0 and start < ends[i]


def _sampler(batches):
    """(kind, token) of labelled credentials, and with kind 3 of other candidates."""
    for batch in batches:
        for first, last in slices(batch.column(0)):
            kinds, tokens = [], []
            for text in batch.column(0)[first:last].to_pylist():
                found = [*base_values(text or "")]
                starts, ends = _joined(base_spans(text) if found else [])
                found += [(3, m[0]) for m in CANDIDATE.finditer(text or "") if not touched(starts, ends, *m.span())]
                kinds += [k for k, _ in found]
                tokens += [t for _, t in found]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(tokens, pa.string())], names=["kind", "token"])


#: Of a token, the automata see at most this much when they are fitted; scores see all of it.
TOKEN_CHARS = 64


def learn_formats(docs: DataFrame, text_col: str = "text", sample: int = 20_000, bound: int = 800, margin: float = 1.0, rounds: int = 3) -> SecretModel:
    """Automata from about ``bound`` distinct tokens of each kind, found in about ``sample`` texts."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    texts = hash_fraction(texts, F.xxhash64("text"), sample)
    found = scratch.put(texts.mapInArrow(tidy(_sampler), "kind int, token string").distinct())
    tokens = []
    for kind in range(4):
        few = hash_fraction(found.where(F.col("kind") == kind), F.col("token"), bound if kind < 3 else 4 * bound)
        tokens.append(sorted({r["token"][:TOKEN_CHARS] for r in few.limit(8 * bound).collect()}))
    scratch.drop(found)
    return model_of(tokens[:3], tokens[3], margin, rounds)


def model_of(credentials: list[list[str]], other: list[str], margin: float = 1.0, rounds: int = 3) -> SecretModel:
    """A model from the credentials of each kind and other tokens."""
    automata = tuple(infer(c) for c in credentials if c)
    model = SecretModel(automata, infer(other), margin)
    # Among the other tokens there are credentials that no base rule found: what looks like one,
    # though it taught the other automaton itself, teaches nothing about ordinary tokens.
    for _ in range(rounds if automata else 0):
        rest = [t for t in other if model.likely(t) < margin / 2]
        if len(rest) == len(other):
            break
        other = rest
        model = SecretModel(automata, infer(other), margin)
    return model


SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SecretModel | None = None, **how) -> DataFrame:
    """One row per document: id and its spans; kinds are indexes of ``KINDS``."""
    need_columns(docs, id_col, text_col)
    model = model or learn_formats(docs, text_col, **how)

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1)):
                spans = [[{"start": s, "kind": k, "end": e} for s, k, e in all_spans(t or "", model)] for t in batch.column(1)[first:last].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], pa.array(spans, _SPANS)], names=["id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), f"id bigint, spans {SPANS}").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: SecretModel, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``all_spans`` in ``text_col`` replaced by ``mark``; all rows stay."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(at)):
                some = batch.slice(first, last - first)
                texts = [t and redacted(t, model, mark) for t in some.column(at).to_pylist()]
                columns = list(some.columns)
                columns[at] = pa.array(texts, batch.schema.types[at])
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_whole(docs, run)


def redacted(text: str, model: SecretModel, mark: str) -> str:
    """Spans that overlap become one mark."""
    out, at, last = [], 0, 0
    for s, _, e in all_spans(text, model):
        if s >= last:
            out.append(text[at:s] + mark)
        at = last = max(last, e)
    return "".join(out) + text[at:]


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    # The lambda takes the element alone: a second parameter, default or not, would be its index.
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

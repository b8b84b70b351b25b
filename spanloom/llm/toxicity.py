"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labels: words, and word beginnings with several
different endings, that stand in labelled toxic documents so much oftener than
in clean ones that chance is ruled out (one-sided binomial tail). Its trie is
intersected with the Levenshtein automata of all terms: a state is the set of
(trie node, edits spent) still possible. States are made as they are first
needed and stepped for all words of a batch at once, so most words die within
three characters and only hits reach Python objects.

A hit counts by how close it is, and by its context window: between quotation
marks or near a verb of saying it is quotation (``QUOTED``), beside a
second-person word it is abuse (``AIMED``). A misspelling that clean training
documents use themselves is no hit; for beginnings, that is any word with the
same misspelled beginning. Terms of five or more letters allow an edit, those of
twelve or more two. Where letters and digits stand together, the whole run is a
word besides its letters, so a digit in place of a letter is an edit. A logistic regression over the summed
weights of exact, misspelled and beginning hits gives the score.

Defined results: a null or empty text has no hits and the score of no hits; a
row without label is scored like any other; without toxic labels the lexicon is
empty and every score is the share of toxic labels (0 without labels); repeated
rows are scored each; extra columns are kept, but an earlier ``toxicity_score`` is
replaced.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .common import fit_logistic, labelled_sample, map_whole, need_columns, remainder, tidy
from .textbytes import slices

QUOTED, AIMED, WINDOW = 0.35, 1.25, 6
#: What a misspelled hit is worth at least, of an exact one.
MISSPELLED = 0.8
# Verbs and nouns of saying, and second-person words, of four languages.
SAYING = frozenset(
    "said says wrote writes called quote quoted quotes term word slur sagte schrieb nannte zitat wort dit écrit appelé mot citation dijo escribió llamó palabra cita".split()
)
SECOND = frozenset("you your yours youre du dich dir dein tu te toi ton vous votre usted vosotros ustedes".split())
MARKS = frozenset('"“”„«»‹›‘’')
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """``terms``: (term, is a beginning, edits allowed); ``innocent``: clean words near a term, and with a star the near forms of a beginning."""

    terms: tuple[tuple[str, bool, int], ...]
    innocent: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, -30.0)
    known: dict = field(default_factory=dict, compare=False)


class LexiconAutomaton:
    """The deterministic automaton of the trie's and the Levenshtein automata's product."""

    DEAD = 0

    def __init__(self, terms: tuple[tuple[str, bool, int], ...]):
        self.terms = terms
        letters = sorted({c for t, _, _ in terms for c in t})
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 1
        self.next: list[dict[int, int]] = [{}]
        self.word: list[int | None] = [None]
        self.start: list[int | None] = [None]
        self.most = [0]
        for number, (term, beginning, edits) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in term:
                child = self.next[node].get(self.code[c])
                if child is None:
                    child = len(self.next)
                    self.next[node][self.code[c]] = child
                    self.next.append({})
                    self.word.append(None)
                    self.start.append(None)
                    self.most.append(0)
                node = child
                self.most[node] = max(self.most[node], edits)
            (self.start if beginning else self.word)[node] = number
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((64, self.width), -1, np.int32)
        self.accept: list[tuple[int, int]] = []
        self._state(frozenset())
        self.first = self._state(self._closed({(0, -1): 0}))

    def _closed(self, reached: dict) -> frozenset:
        """With letters of a term left out in the text, while edits remain."""
        todo = list(reached.items())
        while todo:
            (node, begun), edits = todo.pop()
            if begun >= 0:
                continue
            for child in self.next[node].values():
                if edits + 1 <= self.most[child] and reached.get((child, -1), 99) > edits + 1:
                    reached[child, -1] = edits + 1
                    todo.append(((child, -1), edits + 1))
        for (node, begun), edits in list(reached.items()):
            if begun < 0 and (number := self.start[node]) is not None and edits <= self.terms[number][2]:
                reached[0, number] = min(edits, reached.get((0, number), 99))
        return frozenset((node, begun, edits) for (node, begun), edits in reached.items())

    def _state(self, members: frozenset) -> int:
        number = self.states.get(members)
        if number is None:
            number = self.states[members] = len(self.sets)
            self.sets.append(members)
            if number == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            if not members:
                self.table[number] = self.DEAD
            best = (-1, 99)
            for node, begun, edits in members:
                term = begun if begun >= 0 else self.word[node]
                if term is not None and edits <= self.terms[term][2] and (edits, term) < (best[1], best[0]):
                    best = (term, edits)
            self.accept.append(best)
        return number

    def step(self, state: int, letter: int) -> int:
        reached: dict = {}

        def add(node, begun, edits):
            if reached.get((node, begun), 99) > edits:
                reached[node, begun] = edits

        for node, begun, edits in self.sets[state]:
            if begun >= 0:
                add(0, begun, edits)
                continue
            for c, child in self.next[node].items():
                if c == letter:
                    add(child, -1, edits)
                elif edits + 1 <= self.most[child]:
                    add(child, -1, edits + 1)
            if edits + 1 <= self.most[node]:
                add(node, -1, edits + 1)
        out = self.table[state, letter] = self._state(self._closed(reached))
        return int(out)

    def match(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the word, term, edits) of every accepted word."""
        live = np.arange(len(starts))
        state = np.full(len(starts), self.first, np.int32)
        words, terms, edits = [], [], []
        at = 0
        while len(live):
            letters = codes[starts[live] + at]
            new = self.table[state, letters]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                pair = state[missing].astype(np.int64) * self.width + letters[missing]
                for p in np.unique(pair).tolist():
                    self.step(*divmod(p, self.width))
                new = self.table[state, letters]
            at += 1
            alive = new != self.DEAD
            live, new = live[alive], new[alive]
            ended = lengths[live] == at
            if ended.any():
                for w, s in zip(live[ended].tolist(), new[ended].tolist(), strict=True):
                    term, distance = self.accept[s]
                    if term >= 0:
                        words.append(w)
                        terms.append(term)
                        edits.append(distance)
                live, new = live[~ended], new[~ended]
            state = new
        return np.array(words, np.int64), np.array(terms, np.int64), np.array(edits, np.int64)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter; is it a digit; its lower case, if that is one code point."""
    letter, digit = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif c.isdecimal():
            digit[i] = True
    return letter, digit, lower


def _runs_of(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], member.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def distance(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited_form(word: str, term: str, begins: bool, edits: int) -> str:
    """What a misspelled hit is known by: the word, or the shortest form of the beginning in it."""
    if not begins:
        return word
    return next((word[:k] for k in range(len(term) - edits, len(term) + edits) if distance(word[:k], term) <= edits), word[: len(term) + edits]) + "*"


class Scanner:
    """Finds the hits of a model in many texts at once."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = LexiconAutomaton(model.terms) if model.terms else None
        self.table = np.zeros(0x110000, np.uint8)
        if self.automaton:
            if self.automaton.width > 255:
                self.table = self.table.astype(np.uint16)
            for c, k in self.automaton.code.items():
                self.table[ord(c)] = k

    def scan(self, texts: list[str]):
        """(text, start, end, term, edits, weight) of every hit, in order."""
        if self.automaton is None or not texts:
            return []
        letter, digit, lower = _letters()
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        is_letter, is_digit = letter[points], digit[points]
        starts, ends = _runs_of(is_letter)
        codes = self.table[lower[points]]
        hit, terms, edits = self.automaton.match(codes, starts, ends - starts)
        # A hit's place, and the first and last of the words it covers.
        place, until, low, high = starts[hit], ends[hit], hit, hit
        if is_digit.any():
            first, last = _runs_of(is_letter | is_digit)
            left, right = np.searchsorted(starts, first), np.searchsorted(starts, last) - 1
            mixed = np.flatnonzero(right >= left)
            mixed = mixed[ends[left[mixed]] - starts[left[mixed]] < last[mixed] - first[mixed]]
            # Runs of which a word hits by itself are done.
            words = np.zeros(len(starts) + 1, np.int64)
            np.add.at(words, hit + 1, 1)
            words = np.cumsum(words)
            mixed = mixed[words[right[mixed] + 1] == words[left[mixed]]]
            more, more_terms, more_edits = self.automaton.match(codes, first[mixed], last[mixed] - first[mixed])
            of = mixed[more]
            place, until, low, high = (np.concatenate(x) for x in ((place, first[of]), (until, last[of]), (low, left[of]), (high, right[of])))
            terms, edits = np.concatenate([terms, more_terms]), np.concatenate([edits, more_edits])
        out = []
        owner = np.searchsorted(bounds, place, "right") - 1
        for k in np.argsort(place, kind="stable").tolist():
            lo, hi, t = int(low[k]), int(high[k]), int(owner[k])
            text, base = texts[t], int(bounds[t])
            s, e = int(place[k]) - base, int(until[k]) - base
            if edits[k] and edited_form(text[s:e].lower(), *self.model.terms[int(terms[k])]) in self.model.innocent:
                continue
            first, last = max(0, lo - WINDOW), min(len(starts) - 1, hi + WINDOW)
            near = [text[int(starts[i]) - base : int(ends[i]) - base].lower() for i in range(first, last + 1) if not lo <= i <= hi and starts[i] >= base and ends[i] < bounds[t + 1]]
            window_start = max(0, int(starts[first]) - base)
            window_end = min(len(text), int(ends[last]) - base + 1)
            weight = 1.0
            if MARKS & set(text[window_start:s]) and MARKS & set(text[e:window_end]) or SAYING & set(near):
                weight = QUOTED
            elif SECOND & set(near):
                weight = AIMED
            out.append((t, s, e, int(terms[k]), int(edits[k]), weight))
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        """Summed weights of exact, misspelled and beginning hits of each text."""
        out, first = np.zeros((len(texts), 3)), 0
        for run in _runs(texts):
            for t, _, _, term, edits, weight in self.scan(run):
                begins = self.model.terms[term][1]
                out[first + t, 2 if begins else 1 if edits else 0] += weight * (MISSPELLED if begins and edits else 1)
            first += len(run)
        return np.log1p(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))


def _chance(hits: int, misses: int, share: float) -> float:
    """P(at least ``hits`` of hits + misses), each with probability ``share``."""
    n, total = hits + misses, 0.0
    for k in range(hits, n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
        if k - hits > 60:
            break
    return total


def _witnesses(texts, words, begun):
    """Contexts of each word and beginning (of those asked for), and the words of each beginning."""
    seen, starts, endings = defaultdict(set), defaultdict(set), defaultdict(Counter)
    for text in texts:
        run = [w.lower() for w in WORD.findall(text)]
        first: dict[str, int] = {}
        for i, w in enumerate(run):
            first.setdefault(w, i)
        for w, i in first.items():
            context = zlib.crc32(" ".join(run[max(0, i - 1) : i + 2]).encode())
            if words is None or w in words:
                seen[w].add(context)
            for k in range(4, min(9, len(w))):
                if begun is None or w[:k] in begun:
                    starts[w[:k]].add(context)
                    if begun is None:
                        endings[w[:k]][w] += 1
    return seen, starts, endings


def _runs(texts: list[str], most: int = 1 << 19):
    """Consecutive texts of about ``most`` characters together."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def learn(rows: list[tuple[int, str, int]], chance: float = 1e-5, least: int = 3, edit_from: tuple[int, ...] = (5, 12)) -> ToxicityModel:
    """Lexicon, innocent words and weights from (id, text, toxic) rows."""
    toxic_n = sum(y for _, _, y in rows)
    if not rows or not toxic_n or toxic_n == len(rows):
        share = toxic_n / len(rows) if rows else 0.0
        return ToxicityModel((), weights=(0.0, 0.0, 0.0, math.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    share = toxic_n / len(rows)
    # Distinct contexts are counted, not documents: copies of one document are one witness.
    # Toxic documents propose; clean ones are only asked about what passed there.
    toxic_words, toxic_starts, endings = _witnesses((t for _, t, y in rows if y), None, None)
    toxic_words = {w: c for w, c in toxic_words.items() if len(c) >= least}
    toxic_starts = {b: c for b, c in toxic_starts.items() if len(c) >= least and len(endings[b]) >= 4}
    clean_words, clean_starts, _ = _witnesses((t for _, t, y in rows if not y), toxic_words, toxic_starts)
    seen, starts = (clean_words, toxic_words), (clean_starts, toxic_starts)

    def telling(t: int, c: int, bar: float) -> bool:
        return t >= least and t / (t + c) >= 0.9 and _chance(t, c, share) < bar

    beginnings: list[str] = []
    for b in sorted(starts[1], key=lambda x: (len(x), x)):
        t = len(starts[1][b])
        if any(b.startswith(x) for x in beginnings) or not telling(t, len(starts[0].get(b, ())), chance / 100):
            continue
        if max(endings[b].values()) > 0.6 * t:
            continue
        # As long as nearly all of its words go on alike, the beginning is longer.
        while len(b) < 8 and (c := max((x for x in starts[1] if len(x) == len(b) + 1 and x.startswith(b)), key=lambda x: len(starts[1][x]), default="")):
            if len(starts[1][c]) < 0.97 * t or len(endings[c]) < 4:
                break
            b = c
        if b not in beginnings:
            beginnings.append(b)
    # A word whose beginning allows edits is found by it, misspelled too; one with a shorter beginning stays for its own edits.
    edits = lambda term: sum(len(term) >= n for n in edit_from)
    covering = tuple(b for b in beginnings if edits(b)) or "\x00"
    words = [w for w, t in seen[1].items() if len(w) > 2 and telling(len(t), len(seen[0].get(w, ())), chance) and not w.startswith(covering)]
    terms = [(b, True, edits(b)) for b in sorted(beginnings)] + [(w, False, edits(w)) for w in sorted(words)]
    innocent: set[str] = set()
    if terms:
        scanner = Scanner(ToxicityModel(tuple(terms)))
        for texts in _runs([t for _, t, y in rows if not y]):
            for t, s, e, term, spent, _ in scanner.scan(texts):
                if spent:
                    innocent.add(edited_form(texts[t][s:e].lower(), *terms[term]))
    model = ToxicityModel(tuple(terms), frozenset(innocent))
    x = Scanner(model).features([t for _, t, _ in rows])
    weights = fit_logistic(x, [y for _, _, y in rows])
    # A misspelling may be absent from the sample: it is worth most of an exact hit.
    weights[1] = max(weights[1], MISSPELLED * weights[0])
    return ToxicityModel(tuple(terms), frozenset(innocent), tuple(weights.tolist()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 4000, modulus: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from about ``bound`` labelled rows whose id's remainder is not 0."""
    need_columns(labels, id_col, label_col)
    return learn(labelled_sample(docs, labels, label_col, bound, modulus, 0, id_col, text_col))


def _texts(column: pa.Array):
    for first, last in slices(column):
        yield first, last, [t or "" for t in column[first:last].to_pylist()]


def _scored(docs: DataFrame, model: ToxicityModel, text_col: str, finish, *more: StructField) -> DataFrame:
    """``finish(part of a batch, its scores)`` of all of ``docs``."""
    at = docs.columns.index(text_col)

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            for first, last, texts in _texts(batch.column(at)):
                yield finish(batch.slice(first, last - first), scanner.scores(texts))

    return map_whole(docs, run, more)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then toxicity_score."""
    docs = docs.drop("toxicity_score")

    def finish(part: pa.RecordBatch, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "toxicity_score"])

    return _scored(docs, model, text_col, finish, StructField("toxicity_score", DoubleType()))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``."""
    return _scored(docs, model, text_col, lambda part, scores: part.filter(pa.array(scores < threshold)))


def toxic_spans(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per hit: id, start, end (code points), term, edits, weight."""

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, texts in _texts(batch.column(1)):
                hits = scanner.scan(texts)
                columns = [[ids[first + h[0]] for h in hits], [h[1] for h in hits], [h[2] for h in hits], [model.terms[h[3]][0] for h in hits], [h[4] for h in hits], [h[5] for h in hits]]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "start", "end", "term", "edits", "weight"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return source.mapInArrow(tidy(run), "id bigint, start int, end int, term string, edits int, weight double").withColumnRenamed("id", id_col)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity_score")
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))

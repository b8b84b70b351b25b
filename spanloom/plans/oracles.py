"""The same results in DuckDB SQL: set operations, windows and recursive CTEs of their own.

``chunk_sql`` has the chunking strategies; here they are put together with BM25,
gold answers, reports, pairs and questions.
"""

from __future__ import annotations

from ..charsets import CLOSERS, OPENERS, REPORT_PUNCT, RULE_CLAUSE, RULE_SENTENCE, WS_CLASS, char_class
from ..sources.corpus import corpus_rows
from . import chunk_sql as cs
from .chunk_sql import SENTENCE as _SENTENCE
from .chunk_sql import tokens as _tokens

CJK_VIEW = "(SELECT doc_id, translate(text, '.,!?', '。，！？') AS text FROM documents)"
PLAIN_VIEW = "(SELECT doc_id, translate(text, '.,!?;:''', '．') AS text FROM documents)"


def _windows(size: int, overlap: int = 0) -> str:
    step = size - overlap
    return f"""(SELECT doc_id, CAST(i AS INT) AS seq, CAST(i * {step} AS INT) AS s, CAST(least(i * {step} + {size}, length(text)) AS INT) AS e,
      substring(text, i * {step} + 1, {size}) AS t, text AS whole
      FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - {size}) / {step}.0) AS BIGINT)))) AS i FROM documents WHERE length(text) > 0))"""


_QUESTIONS = """(SELECT doc_id, q_idx, substring(text, q_idx * (length(text) // 3) + 21, 40) AS gold, substring(text, q_idx * (length(text) // 3) + 21, 40) AS q, q_idx * (length(text) // 3) AS guess, text AS whole
  FROM documents, (SELECT unnest([0, 1, 2]) AS q_idx) WHERE length(text) >= 200)"""


def _terms(text: str) -> str:
    low = f"lower({text})"
    return f"""list_concat(list_filter(regexp_extract_all({low}, '[a-z0-9]+'), lambda x: length(x) > 1), list_concat(regexp_extract_all({low}, '[一-鿿]'),
      flatten(list_transform(list_filter(regexp_extract_all({low}, '[一-鿿]+'), lambda x: length(x) > 1), lambda x: list_transform(range(1, length(x)), lambda i: x[i : i + 1])))))"""


_RULE = f"""CASE WHEN e >= length(whole) THEN 'text_end' WHEN nl > 1 OR (nl = 1 AND regexp_matches(last, '{char_class(RULE_SENTENCE)}')) THEN 'paragraph' WHEN nl = 1 THEN 'newline'
  WHEN regexp_matches(last, '{char_class(RULE_SENTENCE)}') THEN 'sentence' WHEN regexp_matches(last, '{char_class(RULE_CLAUSE)}') THEN 'clause' ELSE 'budget' END"""
_RULES = f"""SELECT doc_id, seq, {_RULE} AS end_rule FROM (
  SELECT *, length(sp) - length(regexp_replace(sp, '[\\r\\n]', '', 'g')) AS nl, right(substring(whole, 1, e - length(sp)), 1) AS last
  FROM (SELECT *, regexp_extract(substring(whole, 1, e), '({WS_CLASS}*)\\z', 1) AS sp FROM {_windows(200)}))"""

def _index(chunks: str, tag: str = "") -> list[str]:
    """w, tf, shape, idf, scored and ranked, with ``tag`` in their names, of chunks (doc_id, seq, s, e, t) and the questions."""
    return [
        f"w{tag} AS MATERIALIZED (SELECT doc_id, seq, s, e, t, {_terms('t')} AS terms FROM {chunks})",
        f"tf{tag} AS MATERIALIZED (SELECT doc_id, seq, term, count(*) AS tf FROM (SELECT doc_id, seq, unnest(terms) AS term FROM w{tag}) GROUP BY ALL)",
        f"shape{tag} AS (SELECT doc_id, count(*) AS n, avg(len(terms)) AS avg_len FROM w{tag} GROUP BY doc_id)",
        f"idf{tag} AS MATERIALIZED (SELECT doc_id, term, n, avg_len, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf{tag} JOIN shape{tag} USING (doc_id) GROUP BY doc_id, term, n, avg_len)",
        f"""scored{tag} AS (SELECT doc_id, q_idx, seq, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms) / greatest(avg_len, 1)))) AS score
          FROM qt JOIN tf{tag} USING (doc_id, term) JOIN idf{tag} USING (doc_id, term) JOIN w{tag} USING (doc_id, seq) GROUP BY doc_id, q_idx, seq)""",
        f"ranked{tag} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, q_idx ORDER BY round(score, 9) DESC, seq) AS rank FROM scored{tag} WHERE score > 0)",
    ]


def _asked(questions: str) -> list[str]:
    return [
        f"qn AS MATERIALIZED (SELECT *, strpos(whole, gold) - 1 AS pos FROM {questions})",
        f"qt AS (SELECT doc_id, q_idx, unnest({_terms('q')}) AS term FROM qn)",
    ]


def _bm25(chunks: str) -> list[str]:
    return [*_asked(_QUESTIONS), *_index(chunks)]


def _facts(k: int, ranked: str = "ranked", w: str = "w") -> str:
    """doc_id, q_idx, relevant (gold chunks among the best k), a and b (do they hold the gold's start and end)."""
    return f"""(SELECT qn.doc_id, qn.q_idx, count(w.seq) FILTER (contains(w.t, qn.gold)) AS relevant,
      coalesce(bool_or(pos >= 0 AND w.s <= pos AND pos < w.e), false) AS a, coalesce(bool_or(pos >= 0 AND w.s < pos + length(gold) AND pos + length(gold) <= w.e), false) AS b
      FROM qn LEFT JOIN {ranked} r ON r.doc_id = qn.doc_id AND r.q_idx = qn.q_idx AND r.rank <= {k} LEFT JOIN {w} w ON w.doc_id = r.doc_id AND w.seq = r.seq GROUP BY qn.doc_id, qn.q_idx)"""


_BM25 = ", ".join(_bm25(_windows(400)))


def _question_facts(k: int) -> str:
    return f"WITH {_BM25}, facts AS {_facts(k)}"


def _recall(k: int) -> str:
    return f"""{_question_facts(k)}
  SELECT 'fixed-window' AS strategy, count(*) AS total, count(*) FILTER (relevant > 0) AS strict_hits, count(*) FILTER (relevant = 0 AND a AND b) AS union_hits,
    round(count(*) FILTER (relevant > 0) / count(*), 6) AS recall, round(sum(relevant) / (count(*) * {k}), 6) AS precision,
    round(count(*) FILTER (relevant > 0 OR (a AND b)) / count(*), 6) AS union_recall FROM facts"""


_DOCS = "src AS (SELECT doc_id, text FROM documents)"
_PLAIN_DOCS = f"src AS (SELECT doc_id, text FROM {PLAIN_VIEW} v)"
_CJK_DOCS = f"src AS (SELECT doc_id, text FROM {CJK_VIEW} v)"


def _tile_digest(source: str) -> str:
    return cs.query([source, cs.tiles("tile", "src")], "SELECT doc_id, CAST(i - 1 AS INT) AS seq, CAST(s AS INT) AS start_pos, CAST(s + length(t) AS INT) AS end_pos, md5(t) AS text_md5 FROM tile")


def _with_rules(name: str, src: str = "src") -> str:
    return f"SELECT doc_id, seq, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, CAST(ov AS INT) AS overlap_chars, start_rule, end_rule, '' AS headings FROM {cs.rules(name, src)}"


_SECTIONS = """part AS (
      SELECT conv_id, turn, role, '## ' || coalesce(role, '') || ' ' || coalesce(CAST(turn AS VARCHAR), '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS p FROM conversations),
    piece AS (
      SELECT DISTINCT conv_id, -1 AS o, '# conv ' || conv_id || chr(10) AS p, 'conv ' || conv_id AS headings FROM part
      UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p), p, 'conv ' || conv_id || ' > ' || role || ' ' || turn FROM part),
    section AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY conv_id, o) AS doc_id, conv_id, headings, p AS text, CAST(sum(length(p)) OVER w - length(p) AS BIGINT) AS base, row_number() OVER w - 1 AS n
      FROM piece WINDOW w AS (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_MARKDOWN = cs.query(
    [
        _SECTIONS,
        *cs.recursive("m", "section", 400, 40),
        "src AS (SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY n) AS text FROM section GROUP BY conv_id)",
        """whole AS MATERIALIZED (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY base + s, e) - 1 AS INT) AS seq, base + s AS s, base + e AS e, ov, headings, e = length(text) AS closes
          FROM m JOIN section USING (doc_id))""",
        f"""told AS (SELECT r.doc_id, r.seq, r.s, r.e, r.ov, w.headings, CASE WHEN w.closes AND end_rule <> 'text_end' THEN 'heading' ELSE end_rule END AS end_rule
          FROM {cs.rules("whole", "src")} r JOIN whole w ON w.doc_id = r.doc_id AND w.seq = r.seq)""",
    ],
    """SELECT doc_id, seq, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, CAST(ov AS INT) AS overlap_chars,
      coalesce(lag(end_rule) OVER (PARTITION BY doc_id ORDER BY seq), 'text_start') AS start_rule, end_rule, headings FROM told""",
)

_FAMILIES = [
    _DOCS,
    *cs.recursive("p", "src", 600),
    f"inner_src AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, seq) AS doc_id, doc_id AS own, seq AS parent_seq, s AS base, t AS text FROM {cs.texts('p', 'src')})",
    *cs.recursive("c", "inner_src", 150, 30),
    f"""child AS MATERIALIZED (SELECT own AS doc_id, CAST(row_number() OVER (PARTITION BY own ORDER BY parent_seq, c.seq) - 1 AS INT) AS seq, parent_seq, base + s AS s, base + e AS e, t
      FROM {cs.texts("c", "inner_src")} c JOIN inner_src i ON i.doc_id = c.doc_id)""",
]
_PARENT_HITS = """SELECT count(*) FROM (SELECT DISTINCT qn.doc_id, qn.q_idx FROM qn JOIN ranked r ON r.doc_id = qn.doc_id AND r.q_idx = qn.q_idx AND r.rank <= 3
      JOIN child c ON c.doc_id = r.doc_id AND c.seq = r.seq JOIN p ON p.doc_id = c.doc_id AND p.seq = c.parent_seq WHERE pos >= 0 AND p.s <= pos AND pos < p.e)"""


def _shape(chunks: str, docs: str = "documents") -> str:
    """strategy, chunks, avg_chars, min_chars, max_chars, ends_punct, coverage of chunks (strategy, s, e, t)."""
    return f"""SELECT strategy, count(*) AS chunks, round(avg(e - s), 1) AS avg_chars, CAST(min(e - s) AS INT) AS min_chars, CAST(max(e - s) AS INT) AS max_chars,
      count(*) FILTER (regexp_matches(right(regexp_replace(t, '{WS_CLASS}+\\z', ''), 1), '{char_class(REPORT_PUNCT)}')) AS ends_punct,
      round(count(*) FILTER (regexp_matches(right(regexp_replace(t, '{WS_CLASS}+\\z', ''), 1), '{char_class(REPORT_PUNCT)}')) / count(*), 3) AS punct_share,
      round(sum(e - s) / (SELECT greatest(1, sum(length(text))) FROM {docs}), 3) AS coverage FROM {chunks} GROUP BY strategy"""


def _together(names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS strategy, * FROM {cs.texts(name, 'src')}" for name, label in names.items())


def _report(parts: list[str], names: dict[str, str], questions: str, k: int) -> list[str]:
    """reports, of strategies over src: recall at k, shape, and a digest of the misses."""
    return [
        *parts,
        # The strategies' documents are told apart by a number of their own, as an index is one strategy's of one document.
        f"mixed AS MATERIALIZED (SELECT dense_rank() OVER (ORDER BY strategy, doc_id) AS key, * FROM ({_together(names)}))",
        "named AS MATERIALIZED (SELECT DISTINCT key, strategy, doc_id FROM mixed)",
        *_asked(f"(SELECT n.key AS doc_id, q.* EXCLUDE (doc_id) FROM {questions} q JOIN named n ON n.doc_id = q.doc_id)"),
        *_index("(SELECT key AS doc_id, seq, s, e, t FROM mixed)"),
        f"shapes AS ({_shape('mixed', 'src')})",
        *_at(k),
    ]


def _at(k: int) -> list[str]:
    return [
        f"facts{k} AS MATERIALIZED (SELECT strategy, x.* FROM {_facts(k)} x JOIN named ON named.key = x.doc_id)",
        f"""recalls{k} AS (SELECT strategy, count(*) AS total, count(*) FILTER (relevant > 0) AS strict_hits, count(*) FILTER (relevant = 0 AND a AND b) AS union_hits,
          count(*) FILTER (relevant > 0) / count(*) AS recall, sum(relevant) / (count(*) * {k}) AS precision, count(*) FILTER (relevant > 0 OR (a AND b)) / count(*) AS union_recall FROM facts{k} GROUP BY strategy)""",
        f"""missed{k} AS (SELECT strategy, md5(string_agg(m, ',' ORDER BY m)) AS misses_md5 FROM (
          SELECT f.strategy, CAST(n.doc_id AS VARCHAR) || '|' || q AS m FROM facts{k} f JOIN qn ON qn.doc_id = f.doc_id AND qn.q_idx = f.q_idx JOIN named n ON n.key = f.doc_id WHERE relevant = 0 AND NOT (a AND b)) GROUP BY strategy)""",
    ]


_RATES = "strategy, total, strict_hits, union_hits, round(recall, 6) AS recall, round(precision, 6) AS precision, round(union_recall, 6) AS union_recall, chunks, avg_chars, min_chars, max_chars, ends_punct, punct_share, coverage"
_REPORT = cs.query(
    _report([_DOCS, *cs.fixed("f", "src", 150), *cs.sentence("s", "src", 150, 30), *cs.recursive("r", "src", 150, 30)], {"f": "fixed-window", "s": "sentence", "r": "recursive"}, _QUESTIONS, 3),
    f"SELECT {_RATES}, misses_md5, 3 AS k FROM recalls3 JOIN shapes USING (strategy) LEFT JOIN missed3 USING (strategy)",
)


def _values(rows: list[tuple]) -> str:
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


_MINI_QUESTIONS = "(SELECT a.doc_id, q_idx, q, gold, text AS whole FROM mini_asked a JOIN src USING (doc_id))"
_MINI = cs.query(
    _report(
        [
            f"src(doc_id, text) AS ({_values([(d, t) for d, _, t, _ in corpus_rows()])})",
            f"mini_asked(doc_id, q_idx, q, gold) AS ({_values([(d, k, q, g) for d, _, _, pairs in corpus_rows() for k, (q, g) in enumerate(pairs)])})",
            *cs.fixed("f", "src", 150), *cs.sentence("s", "src", 150, 30), *cs.token("t", "src", 150, 30), *cs.recursive("r", "src", 150, 30), *cs.semantic("m", "src", 150, 50, overlap=30),
        ],
        {"f": "fixed-window", "s": "sentence", "t": "token", "r": "recursive", "m": "semantic-hash-toy"}, _MINI_QUESTIONS, 1,
    )
    + _at(3),
    " UNION ALL ".join(f"SELECT {_RATES}, {k} AS k FROM recalls{k} JOIN shapes USING (strategy)" for k in (1, 3)),
)

_VECTOR_RANKED = [
    "asked AS (SELECT doc_id, q_idx, gold AS t FROM qn)",
    *cs.vectors("cv", "w", "doc_id, seq"),
    *cs.vectors("qv", "asked", "doc_id, q_idx"),
    """near AS (SELECT q.doc_id, q_idx, seq, sum(q.x * c.x) AS score FROM qv q JOIN cv c ON c.doc_id = q.doc_id AND c.bucket = q.bucket GROUP BY ALL)""",
    "nearest AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, q_idx ORDER BY round(score, 9) DESC, seq) AS rank FROM near WHERE score > 0)",
]

_PAIRS = f"""(SELECT 'fixed-window|' || c.doc_id || '|' || q_idx || '|' || seq AS key, c.doc_id, q_idx, seq, t, gold FROM {_windows(1500)} c JOIN {_QUESTIONS} q ON c.doc_id = q.doc_id)"""
_SHARE = f"len(list_intersect(list_distinct({_terms('gold')}), list_distinct({_terms('t')})))"
_SCORE = f"CASE WHEN {_SHARE} = 0 THEN 1 WHEN {_SHARE} / greatest(1, len(list_distinct({_terms('gold')}))) >= 0.5 THEN 4 ELSE 3 END"
_COST = "round((CASE WHEN length(t) = 0 THEN 0 ELSE ceil(length(t) / 4.0) + 1 END + 100) / 1000 * 0.001 + 50.0 / 1000 * 0.002, 4)"

_STRIP = f"regexp_replace(regexp_replace(x, '{WS_CLASS}+\\z', ''), '\\A{WS_CLASS}+', '')"
_QA = f"""SELECT doc_id, CAST(j AS INT) AS pos, fit[1 + j * step] AS gold FROM (
  SELECT doc_id, fit, step, unnest(range(0, least(3, (len(fit) - 1) // step + 1))) AS j FROM (
    SELECT doc_id, fit, greatest(1, len(fit) // 3) AS step FROM (
      SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '{_SENTENCE}'), lambda x: {_STRIP}),
        lambda x: length(x) >= 12 AND regexp_matches(right(x, 1), '[。！？；]') AND regexp_matches(x, '[0-9０-９]|标准|费用|时间|流程|要求|周期|限制|方法')) AS fit
      FROM {CJK_VIEW} v) WHERE len(fit) > 0))"""

ORACLES = {
    "chunks_jsonl": f"SELECT doc_id, seq, s AS start_pos, e AS end_pos, md5(t) AS text_md5 FROM {_windows(200, 20)}",
    "judge_state": f"SELECT 'fixed-window' AS strategy, count(*) AS n, CAST(0 AS BIGINT) AS errors, round(avg({_SCORE}), 3) AS mean_score FROM {_PAIRS}",
    "qa_state": f"""SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CAST(count(gold) AS INT) AS raw, CAST(count(DISTINCT substring(gold, 1, 10)) AS INT) AS kept, CAST(0 AS INT) AS dropped_bad_gold,
      CAST(count(gold) - count(DISTINCT substring(gold, 1, 10)) AS INT) AS dropped_dupe, CAST(count(DISTINCT substring(gold, 1, 10)) AS INT) AS pairs FROM documents d LEFT JOIN ({_QA}) q ON q.doc_id = d.doc_id GROUP BY d.doc_id""",
    "split_text_adapter": cs.query([_DOCS, *cs.recursive("c", "src", 400)], f"SELECT doc_id, CAST(count(*) AS INT) AS parts, md5(string_agg(t, chr(1) ORDER BY seq)) AS parts_md5 FROM {cs.texts('c', 'src')} GROUP BY doc_id"),
    "sql_chunks": cs.query(
        [_DOCS, *cs.sentence("c", "src", 120)],
        f"SELECT doc_id, seq, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, md5(t) AS text_md5, {_tokens('t')} AS tokens, end_rule FROM {cs.texts('c', 'src')} x JOIN {cs.rules('c', 'src')} r USING (doc_id, seq, s, e)",
    ),
    "stream_chunks": cs.query([_DOCS, *cs.recursive("c", "src", 400, 50)], cs.digest("c", "src")),
    "fixed_window_chunks": f"SELECT doc_id, seq, s AS start_pos, e AS end_pos, md5(t) AS text_md5 FROM {_windows(200, 20)}",
    "sentence_spans": _tile_digest(_DOCS),
    "sentence_spans_cjk": _tile_digest(_CJK_DOCS),
    "sentence_chunks": cs.query([_CJK_DOCS, *cs.sentence("c", "src", 120)], cs.digest("c", "src")),
    "sentence_chunks_plain": cs.query([_PLAIN_DOCS, *cs.sentence("c", "src", 120)], cs.digest("c", "src")),
    "recursive_chunks": cs.query([_DOCS, *cs.recursive("c", "src", 400, 50)], cs.digest("c", "src")),
    "recursive_chunks_cjk": cs.query([_CJK_DOCS, *cs.recursive("c", "src", 200, 30)], _with_rules("c")),
    "recursive_chunks_plain": cs.query([_PLAIN_DOCS, *cs.recursive("c", "src", 200)], cs.digest("c", "src")),
    "token_chunks": cs.query([_CJK_DOCS, *cs.token("c", "src", 60, 8)], _with_rules("c")),
    "token_chunks_plain": cs.query([_PLAIN_DOCS, *cs.token("c", "src", 60)], cs.digest("c", "src")),
    "markdown_chunks": _MARKDOWN,
    "semantic_chunks": cs.query(
        [_DOCS, *cs.semantic("c", "src", 400, 50)],
        """SELECT c.doc_id, c.seq, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, CAST(ov AS INT) AS overlap_chars,
          coalesce(lag(why) OVER (PARTITION BY c.doc_id ORDER BY c.seq), 'text_start') AS start_rule, why AS end_rule, '' AS headings FROM c JOIN c_why USING (doc_id, seq)""",
    ),
    "parent_child_families": cs.query(_FAMILIES, "SELECT doc_id, parent_seq, count(*) AS children, min(seq) AS first_seq, CAST(min(s) AS INT) AS start_pos, CAST(max(e) AS INT) AS end_pos FROM child GROUP BY doc_id, parent_seq"),
    "hash_embedding_norms": f"""WITH w AS (SELECT doc_id, seq, t FROM {_windows(400)}), {", ".join(cs.vectors("v", "w", "doc_id, seq"))}
      SELECT doc_id, seq, CAST(96 AS INT) AS dim, round(coalesce(sum(x * x), 0), 6) AS squared_norm, round(coalesce(max(x), 0), 6) AS largest FROM w LEFT JOIN v USING (doc_id, seq) GROUP BY doc_id, seq""",
    "rule_distribution_recursive": cs.query([_CJK_DOCS, *cs.recursive("c", "src", 200)], f"SELECT 'recursive' AS strategy, end_rule, count(*) AS n FROM {cs.rules('c', 'src')} GROUP BY end_rule"),
    "hygiene_recursive": cs.query(
        [_CJK_DOCS, *cs.recursive("c", "src", 200)],
        f"""SELECT 'recursive' AS strategy, count(*) FILTER (regexp_matches(right(regexp_replace(t, '{WS_CLASS}+\\z', ''), 1), '{char_class(OPENERS)}')) AS end_opener,
          count(*) FILTER (seq > 0 AND regexp_matches(t, '\\A{WS_CLASS}*{char_class(CLOSERS)}')) AS start_closer FROM {cs.texts("c", "src")}""",
    ),
    "parent_recall": cs.query([*_FAMILIES, *_bm25("child")], f"SELECT 3 AS k, count(*) AS total, ({_PARENT_HITS}) AS hits, ({_PARENT_HITS}) / greatest(1, count(*)) AS recall FROM qn"),
    "strategy_compare": cs.query(
        [_DOCS, *cs.fixed("f", "src", 300, 50), *cs.sentence("s", "src", 300, 50), *cs.token("t", "src", 300, 50), *cs.recursive("r", "src", 300, 50), *cs.semantic("m", "src", 300, 100, overlap=50)],
        _shape(f"({_together({'f': 'fixed-window', 's': 'sentence', 't': 'token', 'r': 'recursive', 'm': 'semantic-hash-toy'})})"),
    ),
    "run_report": _REPORT,
    "zh_mini_report": _MINI,
    "retrieval_interaction": f"""WITH {_BM25}, {", ".join(_VECTOR_RANKED)}
      SELECT 'fixed-window' AS strategy, (SELECT count(*) FILTER (relevant > 0) / count(*) FROM {_facts(1)}) AS bm25, (SELECT count(*) FILTER (relevant > 0) / count(*) FROM {_facts(1, "nearest")}) AS vector""",
    "parent_child_report": cs.query(
        [*_FAMILIES, *_bm25("child"), *cs.recursive("flat", "src", 150, 30), *_index(cs.texts("flat", "src"), "_flat")],
        f"""SELECT 3 AS k, ({_PARENT_HITS}) / greatest(1, count(*)) AS parent_recall, (SELECT count(*) FILTER (relevant > 0) / count(*) FROM {_facts(3, "ranked_flat", "w_flat")}) AS flat_recall,
          (SELECT count(*) FROM p) AS parents, (SELECT count(*) FROM child) AS children FROM qn""",
    ),
    "token_counts": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "markdown_sections": """WITH part AS (
      SELECT conv_id, turn, role, '## ' || coalesce(role, '') || ' ' || coalesce(CAST(turn AS VARCHAR), '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS p FROM conversations),
    piece AS (
      SELECT DISTINCT conv_id, -1 AS o, '# conv ' || conv_id || chr(10) AS p, 'conv ' || conv_id AS headings FROM part
      UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p), p, 'conv ' || conv_id || ' > ' || role || ' ' || turn FROM part)
    SELECT conv_id AS doc_id, CAST(row_number() OVER w - 1 AS INT) AS seq, CAST(sum(length(p)) OVER w - length(p) AS INT) AS start_pos, CAST(sum(length(p)) OVER w AS INT) AS end_pos, headings
    FROM piece WINDOW w AS (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "vector_topk": """SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 5""",
    "explain_rules": _RULES,
    "rule_distribution": f"SELECT end_rule, count(*) AS n FROM ({_RULES}) GROUP BY end_rule",
    "hygiene_violations": f"""SELECT 'fixed-window' AS strategy, count(*) FILTER (regexp_matches(right(regexp_replace(t, '{WS_CLASS}+\\z', ''), 1), '{char_class(OPENERS)}')) AS end_opener,
      count(*) FILTER (seq > 0 AND regexp_matches(t, '\\A{WS_CLASS}*{char_class(CLOSERS)}')) AS start_closer FROM {_windows(200)}""",
    "tokens_tf": f"SELECT doc_id, seq, count(DISTINCT term) AS terms, count(*) AS tokens FROM (SELECT doc_id, seq, unnest({_terms('t')}) AS term FROM {_windows(400)}) GROUP BY doc_id, seq",
    "bm25_idf": f"WITH {_BM25} SELECT doc_id, count(*) AS terms, max(n) AS n_chunks, round(max(avg_len), 6) AS avg_len, round(sum(idf), 4) AS idf_sum FROM idf GROUP BY doc_id",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, q_idx, seq, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM ranked WHERE rank <= 3",
    "gold_chunks": f"SELECT c.doc_id, q_idx, seq FROM {_windows(400)} c JOIN {_QUESTIONS} q ON c.doc_id = q.doc_id WHERE contains(t, gold)",
    "recall_at_1": _recall(1),
    "recall_at_3": _recall(3),
    "failure_list": f"""{_question_facts(1)} SELECT 'fixed-window' AS strategy, doc_id, q_idx FROM (SELECT *, row_number() OVER (ORDER BY doc_id, q_idx) AS n FROM facts WHERE relevant = 0 AND NOT (a AND b)) WHERE n <= 8""",
    "fixed_window_compare": cs.query([_DOCS, *cs.fixed("f", "src", 300, 50)], _shape(f"({_together({'f': 'fixed-window'})})")),
    "chunk_stats": f"""SELECT 'fixed-window' AS strategy, count(*) AS n, min(e - s) AS min_chars, list_sort(list(e - s))[count(*) // 2 + 1] AS median_chars, max(e - s) AS max_chars,
      CAST(sum(e - s) AS BIGINT) AS total_chars FROM {_windows(300)}""",
    "starts_mid_sentence": f"SELECT 'fixed-window' AS strategy, count(*) AS chunks, count(*) FILTER (s > 0 AND NOT regexp_matches(substring(whole, s, 1), '{char_class(REPORT_PUNCT + chr(10))}')) AS mid FROM {_windows(200)}",
    "answer_integrity": f"""SELECT 'fixed-window' AS strategy, count(*) AS golds, count(*) FILTER (held) AS intact FROM (
      SELECT c.doc_id, q_idx, bool_or(contains(t, gold)) AS held FROM {_windows(200)} c JOIN {_QUESTIONS} q ON c.doc_id = q.doc_id GROUP BY c.doc_id, q_idx)""",
    "counter_calibration": f"""SELECT count(*) AS n, round(avg(x), 6) AS mean_error, max(x) AS max_error FROM (
      SELECT round_even(abs({_tokens('text')} - len(string_split(text, ' '))) / len(string_split(text, ' ')), 4) AS x FROM documents WHERE text IS NOT NULL)""",
    "judge_pairs": f"SELECT key, doc_id, q_idx, seq AS chunk_seq, md5(t) AS chunk_md5 FROM {_PAIRS}",
    "judge_dry_run": f"""SELECT key, score, CASE score WHEN 1 THEN 'empty chunk' WHEN 4 THEN 'high lexical overlap with question' ELSE 'moderate lexical overlap' END AS reason, 'dry-run-bm25' AS method
      FROM (SELECT key, {_SCORE} AS score FROM {_PAIRS})""",
    "judge_resume": f"SELECT key FROM {_PAIRS} p ANTI JOIN (SELECT key FROM {_PAIRS} WHERE doc_id % 3 = 0) d USING (key)",
    "judge_cost_cap": f"SELECT key, est_cost FROM (SELECT key, est_cost, sum(est_cost) OVER (ORDER BY key) AS upto FROM (SELECT key, {_COST} AS est_cost FROM {_PAIRS})) WHERE round(upto, 9) <= 0.5",
    "judge_summary": f"SELECT 'fixed-window' AS strategy, count(*) AS n, CAST(0 AS BIGINT) AS errors, round(avg({_SCORE}), 3) AS mean_score FROM {_PAIRS}",
    "qa_dry_run": _QA,
    "qa_validate": f"SELECT doc_id, 3 * count(*) AS raw, count(*) FILTER (f) AS kept, count(*) AS dropped_bad_gold, count(*) + count(*) FILTER (NOT f) AS dropped_dupe FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, substring(gold, 1, 10) ORDER BY pos) = 1 AS f FROM ({_QA})) GROUP BY doc_id",
}

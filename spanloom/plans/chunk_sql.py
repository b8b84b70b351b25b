"""Chunking in DuckDB SQL: tiles, greedy groups, boundary hygiene, overlap, rules and vectors.

A strategy is a run of CTEs of one ``WITH RECURSIVE``. Tiles and windows are set
operations; what depends on the step before (greedy groups, the left neighbour of
a moved boundary, semantic groups) walks along each document. Sources are views of
(doc_id, text), one row a document.
"""

from __future__ import annotations

from ..charsets import CLOSERS, OPENERS, RULE_CLAUSE, RULE_SENTENCE, SENTENCE_CLOSERS, SENTENCE_END, SNAP_CLOSERS, WS, WS_CLASS, ZH_CLAUSE, ZH_SENTENCE, char_class

_E, _C = char_class(SENTENCE_END), char_class(SENTENCE_CLOSERS)
_REST = char_class(SENTENCE_END + "\n", negated=True)
SENTENCE = f"\\n|{_REST}*{_E}{_C}*|{_REST}+"
_CJK = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}"
_RUN = f"[^{_CJK}{WS_CLASS[1:-1]}]+"


def tokens(text: str) -> str:
    """Tokens of an expression, counted as the character heuristic does."""
    return f"CAST(length(regexp_replace({text}, '{_RUN}', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{_RUN}'), lambda r: CAST(ceil(length(r) / 4.0) AS INT) + 1)), 0) AS INT)"


def cut(spans: str, src: str, tiles: str, most: int) -> str:
    """doc_id, s, e of ``spans``; those longer than ``most`` are cut into their ``tiles`` (of ``t``)."""
    return f"""SELECT doc_id, s, e FROM {spans} WHERE e - s <= {most} UNION ALL
      SELECT doc_id, base + upto - length(t) AS s, base + upto AS e FROM (
        SELECT doc_id, base, t, CAST(sum(length(t)) OVER (PARTITION BY doc_id, base ORDER BY k) AS BIGINT) AS upto FROM (
          SELECT doc_id, base, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM (
            SELECT doc_id, s AS base, {tiles} AS x FROM (SELECT doc_id, s, substring(text, s + 1, e - s) AS t FROM {spans} JOIN {src} USING (doc_id) WHERE e - s > {most}))))"""


def _cutting(separators: str) -> str:
    return f"regexp_extract_all(t, '{char_class(separators)}|{char_class(separators, negated=True)}+')"


_BLANK_LINES = f"list_filter(string_split(regexp_replace(t, '(\\n{WS_CLASS}*\\n)', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def recursive_atoms(name: str, src: str, most: int) -> list[str]:
    """{name}_atom: doc_id, i, s, e, size of paragraphs, lines, sentences, clauses, windows, as deep as needed."""
    out = [f"{name}_l0 AS (SELECT doc_id, CAST(0 AS BIGINT) AS s, CAST(length(text) AS BIGINT) AS e FROM {src} WHERE length(text) > 0)"]
    levels = [_BLANK_LINES, _cutting("\n"), _cutting(ZH_SENTENCE), _cutting(ZH_CLAUSE), f"list_transform(range(0, length(t), {most}), lambda j: substring(t, j + 1, {most}))"]
    for i, tiles in enumerate(levels):
        out.append(f"{name}_l{i + 1} AS MATERIALIZED ({cut(f'{name}_l{i}', src, tiles, most)})")
    return [*out, f"{name}_atom AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i, s, e, e - s AS size FROM {name}_l{len(levels)})"]


def tiles(name: str, src: str) -> str:
    """{name}: doc_id, i, s, t of sentence tiles."""
    return f"""{name} AS MATERIALIZED (SELECT doc_id, i, t, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS BIGINT) AS s
      FROM (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS x FROM {src} WHERE length(text) > 0)))"""


def sentence_atoms(name: str, src: str) -> list[str]:
    return [tiles(f"{name}_tile", src), f"{name}_atom AS (SELECT doc_id, i, s, s + length(t) AS e, length(t) AS size FROM {name}_tile)"]


def token_atoms(name: str, src: str, most: int) -> list[str]:
    """Sentences with their token counts; one beyond ``most`` is cut into windows of about it."""
    wide = f"CASE WHEN n <= {most} THEN greatest(1, length(t)) ELSE CAST(greatest(1, round_even(length(t) / n, 0)) AS BIGINT) * {most} END"
    return [
        tiles(f"{name}_tile", src),
        f"""{name}_atom AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS i, s, s + length(t) AS e, {tokens("t")} AS size FROM (
          SELECT doc_id, s + j AS s, substring(t, j + 1, win) AS t FROM (
            SELECT doc_id, s, t, win, unnest(range(0, length(t), win)) AS j FROM (SELECT doc_id, s, t, {wide} AS win FROM (SELECT *, {tokens("t")} AS n FROM {name}_tile)))))""",
    ]


def grouped(name: str, budget: int) -> list[str]:
    """{name}_grp: doc_id, n (from 0), s, e of greedy groups of atoms."""
    fits = f"w.held + a.size <= {budget}"
    return [
        f"""{name}_walk(doc_id, i, first, held) AS (
          SELECT doc_id, i, s, size FROM {name}_atom WHERE i = 1
          UNION ALL
          SELECT a.doc_id, a.i, CASE WHEN {fits} THEN w.first ELSE a.s END, CASE WHEN {fits} THEN w.held + a.size ELSE a.size END
          FROM {name}_walk w JOIN {name}_atom a ON a.doc_id = w.doc_id AND a.i = w.i + 1)""",
        f"""{name}_grp AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS n, first AS s, max(e) AS e
          FROM {name}_walk JOIN {name}_atom USING (doc_id, i) GROUP BY doc_id, first)""",
    ]


def finished(name: str, src: str, overlap: str | int = 0, most: int | None = None) -> list[str]:
    """{name}: doc_id, seq, s, e, ov of {name}_grp after hygiene and overlap."""
    opener, closer = char_class(OPENERS), char_class(CLOSERS)
    head = "substring(text, w.s + 1, g.s - w.s)"
    tail = f"regexp_extract({head}, '{char_class(WS + OPENERS)}*\\z')"
    free = f"(CASE WHEN length({tail}) = length({head}) THEN substring({tail}, 2) ELSE {tail} END)"
    moved = f"length(regexp_extract({free}, '(?:{opener}{char_class(OPENERS, negated=True)}*){{1,8}}\\z'))"
    taken = f"length(regexp_extract(substring(text, g.s + 1, greatest(0, g.e - 1 - g.s)), '\\A(?:{closer}{{1,2}}|{WS_CLASS}{closer})'))"
    place = f"CASE WHEN g.s - w.s < 2 THEN g.s WHEN regexp_matches({tail}, '{opener}') THEN g.s - {moved} ELSE g.s + {taken} END"
    out = [
        f"""{name}_clean(doc_id, n, s) AS (
          SELECT doc_id, n, s FROM {name}_grp WHERE n = 0
          UNION ALL
          SELECT g.doc_id, g.n, {place} FROM {name}_clean w JOIN {name}_grp g ON g.doc_id = w.doc_id AND g.n = w.n + 1 JOIN {src} d ON d.doc_id = g.doc_id)""",
        f"""{name}_span AS MATERIALIZED (SELECT c.doc_id, n, c.s, coalesce(lead(c.s) OVER o, g.e) AS e, lag(c.s) OVER o AS before
          FROM {name}_clean c JOIN {name}_grp g USING (doc_id, n) WINDOW o AS (PARTITION BY c.doc_id ORDER BY n))""",
    ]
    if overlap == 0:
        return [*out, f"{name} AS MATERIALIZED (SELECT doc_id, CAST(n AS INT) AS seq, s, e, CAST(0 AS BIGINT) AS ov FROM {name}_span)"]
    sentence = f"length(regexp_extract(substring(text, 1, s - 1), '(?s)\\A.*{_E}{char_class(SNAP_CLOSERS)}*'))"
    least = f"greatest(CASE WHEN sentence > earliest THEN sentence ELSE earliest END, before + 1{f', e - {most}' if most is not None else ''})"
    closers = f"length(regexp_extract(substring(text, begun + 1, greatest(0, s - begun)), '\\A{closer}*'))"
    return [
        *out,
        f"""{name} AS MATERIALIZED (
          SELECT doc_id, CAST(n AS INT) AS seq, moved AS s, e, s - moved AS ov FROM (
            SELECT doc_id, n, s, e, CASE WHEN before IS NULL THEN s WHEN begun < s THEN begun + {closers} ELSE s END AS moved FROM (
              SELECT *, {least} AS begun FROM (
                SELECT *, {sentence} AS sentence, greatest(0, s - ({overlap})) AS earliest FROM {name}_span JOIN {src} USING (doc_id)))))""",
    ]


def recursive(name: str, src: str, most: int, overlap: int = 0) -> list[str]:
    return [*recursive_atoms(name, src, most), *grouped(name, most), *finished(name, src, overlap, most)]


def sentence(name: str, src: str, most: int, overlap: int = 0) -> list[str]:
    return [*sentence_atoms(name, src), *grouped(name, most), *finished(name, src, overlap, most)]


def token(name: str, src: str, most: int, overlap: int = 0) -> list[str]:
    about = f"CASE WHEN {tokens('text')} = 0 THEN length(text) ELSE greatest(1, CAST(round_even({overlap} * length(text) / {tokens('text')}, 0) AS BIGINT)) END"
    return [*token_atoms(name, src, most), *grouped(name, most), *finished(name, src, about if overlap else 0)]


def _crc32(text: str) -> str:
    """The checksum of a text's UTF-8 bytes, bit by bit."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substring(hex(encode({text})), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, length(hex(encode({text}))), 2), lambda p: CAST({digit('p')} * 16 + {digit('p + 1')} AS BIGINT))"
    turn = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda h, q: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {turn}), 4294967295)"


def vectors(name: str, texts: str, key: str, dim: int = 96) -> list[str]:
    """{name}: key, bucket, x of the normalised trigram counts of ``texts`` (key columns, t)."""
    return [
        f"""{name}_tri AS MATERIALIZED (SELECT {key}, tri, count(*) AS n FROM (
          SELECT {key}, unnest(list_transform(range(1, length(flat) - 1), lambda j: substring(flat, j, 3))) AS tri FROM (SELECT {key}, replace(t, chr(10), '') AS flat FROM {texts})) GROUP BY ALL)""",
        f"{name}_bucket AS MATERIALIZED (SELECT tri, {_crc32('tri')} % {dim} AS bucket FROM (SELECT DISTINCT tri FROM {name}_tri))",
        f"{name}_count AS MATERIALIZED (SELECT {key}, bucket, sum(n) AS n FROM {name}_tri JOIN {name}_bucket USING (tri) GROUP BY ALL)",
        f"{name} AS MATERIALIZED (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM {name}_count)",
    ]


def semantic(name: str, src: str, most: int, least: int, threshold: float = 0.55, overlap: int = 0) -> list[str]:
    """As the others, and {name}_why: why each group ends."""
    apart = f"coalesce(like_before, 0) < {threshold}"
    ends = f"(({apart}) AND w.until - w.first >= {least}) OR a.s + length(a.t) - w.first > {most}"
    return [
        tiles(f"{name}_tile", src),
        *vectors(f"{name}_vec", f"{name}_tile", "doc_id, i"),
        f"""{name}_like AS MATERIALIZED (SELECT t.doc_id, t.i, t.s, t.t, v.like_before FROM {name}_tile t LEFT JOIN (
          SELECT a.doc_id, a.i, sum(a.x * b.x) AS like_before FROM {name}_vec a JOIN {name}_vec b ON a.doc_id = b.doc_id AND a.i = b.i + 1 AND a.bucket = b.bucket GROUP BY ALL) v ON v.doc_id = t.doc_id AND v.i = t.i)""",
        f"""{name}_walk(doc_id, i, first, until, why) AS (
          SELECT doc_id, i, s, s + length(t), CAST(NULL AS VARCHAR) FROM {name}_tile WHERE i = 1
          UNION ALL
          SELECT a.doc_id, a.i, CASE WHEN {ends} THEN a.s ELSE w.first END, a.s + length(a.t), CASE WHEN {ends} THEN CASE WHEN {apart} THEN 'semantic_drop' ELSE 'budget' END END
          FROM {name}_walk w JOIN {name}_like a ON a.doc_id = w.doc_id AND a.i = w.i + 1)""",
        # A group's reason stands with the tile that begins the next one.
        f"""{name}_whole AS (SELECT doc_id, s, e, coalesce(lead(began) OVER (PARTITION BY doc_id ORDER BY s), 'text_end') AS why FROM (
          SELECT doc_id, first AS s, max(until) AS e, max(why) FILTER (why IS NOT NULL) AS began FROM {name}_walk GROUP BY doc_id, first))""",
        f"""{name}_part AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s + j) - 1 AS n, s + j AS s, least(s + j + {most}, e) AS e, CASE WHEN s + j + {most} < e THEN 'budget' ELSE why END AS why
          FROM (SELECT doc_id, s, e, why, unnest(range(0, e - s, {most})) AS j FROM {name}_whole))""",
        f"{name}_grp AS (SELECT doc_id, n, s, e FROM {name}_part)",
        f"{name}_why AS (SELECT doc_id, CAST(n AS INT) AS seq, why FROM {name}_part)",
        *finished(name, src, overlap, most),
    ]


def fixed(name: str, src: str, most: int, overlap: int = 0) -> list[str]:
    step = most - overlap
    return [f"""{name} AS MATERIALIZED (SELECT doc_id, CAST(k AS INT) AS seq, k * {step} AS s, least(k * {step} + {most}, length(text)) AS e, CAST(CASE WHEN k > 0 THEN {overlap} ELSE 0 END AS BIGINT) AS ov
      FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - {most}) / {step}.0) AS BIGINT)))) AS k FROM {src} WHERE length(text) > 0))"""]


def texts(name: str, src: str) -> str:
    """Chunks with their text ``t`` and their source's, ``whole``."""
    return f"(SELECT c.doc_id, seq, s, e, ov, substring(text, s + 1, e - s) AS t, text AS whole FROM {name} c JOIN {src} d ON c.doc_id = d.doc_id)"


def rules(name: str, src: str) -> str:
    """doc_id, seq, s, e, ov, start_rule, end_rule of chunks."""
    sentence_end, clause_end = char_class(RULE_SENTENCE), char_class(RULE_CLAUSE)
    why = f"""CASE WHEN e >= length(whole) THEN 'text_end' WHEN e <= 0 THEN 'start' WHEN nl > 1 OR (nl = 1 AND regexp_matches(last, '{sentence_end}')) THEN 'paragraph' WHEN nl = 1 THEN 'newline'
      WHEN regexp_matches(last, '{sentence_end}') THEN 'sentence' WHEN regexp_matches(last, '{clause_end}') THEN 'clause' ELSE 'budget' END"""
    return f"""(SELECT *, coalesce(lag(end_rule) OVER (PARTITION BY doc_id ORDER BY seq), 'text_start') AS start_rule FROM (SELECT doc_id, seq, s, e, ov, {why} AS end_rule FROM (
      SELECT *, length(sp) - length(regexp_replace(sp, '[\\r\\n]', '', 'g')) AS nl, right(substring(whole, 1, e - length(sp)), 1) AS last
      FROM (SELECT *, regexp_extract(substring(whole, 1, e), '({WS_CLASS}*)\\z', 1) AS sp FROM {texts(name, src)}))))"""


def query(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def digest(name: str, src: str) -> str:
    return f"SELECT doc_id, seq, CAST(s AS INT) AS start_pos, CAST(e AS INT) AS end_pos, md5(t) AS text_md5 FROM {texts(name, src)}"

"""DataFrame operators against plain Python restatements of their rules."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import spanloom
from spanloom.charsets import WS
from spanloom.functions import text as ft
from spanloom.functions.counters import chars_for_tokens, chars_for_tokens_column, count_chars, token_count
from spanloom.functions.sql import register
from spanloom.operators import judging as jd
from spanloom.operators import reports as rp
from spanloom.operators import retrieval as rt
from spanloom.operators import spans as sp
from spanloom.operators import strategies as st
from spanloom.sources.corpus import zh_mini

DOCS = [
    ("a", "山路很长。清晨有雾，费用是40元。\n\n山顶风大；云在脚下。", [("费用多少", "费用是40元"), ("哪里有风", "山顶风大")]),
    ("b", "The river runs north. It is 320 km long!\nBoats leave at 9am; tickets cost 15.", [("how long is the river", "320 km"), ("tickets cost", "cost 15")]),
    ("c", "重复的话。重复的话。重复的话。结尾没有标点", [("结尾", "结尾没有标点"), ("不存在", "不在文中")]),
    ("d", "", []), ("e", None, []), ("f", " \n\t　", []),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t, _ in DOCS], "doc_id string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, n, q, g) for i, _, qs in DOCS for n, (q, g) in enumerate(qs)], "doc_id string, q_idx int, q string, gold string")


def tokens(text):
    low = text.lower()
    runs = re.findall("[一-鿿]+", low)
    return [t for t in re.findall("[a-z0-9]+", low) if len(t) > 1] + re.findall("[一-鿿]", low) + [r[i : i + 2] for r in runs for i in range(len(r) - 1)]


def test_native_expressions_equal_python(spark, random_text):
    texts = [t for _, t, _ in DOCS] + [random_text(s, 300) for s in range(5)] + ["a😀b c", "x" * 90, "a\r\n b", " 　trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", token_count(t).alias("n"), ft.retrieval_tokens(t).alias("k"), ft.hashed_vector(t).alias("v"), ft.stripped(t).alias("s"), jd.sentences(t).alias("tiles"), chars_for_tokens_column(t, 7).alias("c")).collect()
    for r in rows:
        text = texts[r["i"]]
        if text is None:
            assert r["n"] is None and r["k"] == [] and r["v"] is None
            continue
        assert r["n"] == count_chars(text) and r["k"] == tokens(text) and r["s"] == text.strip(WS)
        assert r["tiles"] == [text[s:e] for s, e in sp.sentence_spans(text)] and r["c"] == chars_for_tokens(text, 7, count_chars)
        flat = text.replace("\n", "")
        buckets = Counter(zlib.crc32(flat[i : i + 3].encode()) % 96 for i in range(len(flat) - 2))
        norm = math.sqrt(sum(n * n for n in buckets.values())) or 1.0
        assert r["v"] == pytest.approx([buckets[d] / norm for d in range(96)]) == ft.hashed_vectors([text])[0]


def test_native_end_rules_equal_the_scan(spark, random_text):
    texts = [random_text(s, 260) + " " * 80 + "末" for s in range(3)] + ["。" + "\n" * 70 + "x", " " * 70 + "x"]
    ends = [(t, e) for t in texts for e in range(0, len(t) + 1, 3)]
    rows = spark.createDataFrame(ends, "t string, e int").select("t", "e", ft.end_rule_column(F.col("t"), F.col("e")).alias("r")).collect()
    assert all(r["r"] == sp.end_rule(r["t"], r["e"]) for r in rows)


def test_a_vector_has_eight_cells_or_more():
    with pytest.raises(ValueError, match="8"):
        ft.hashed_vector(F.col("t"), 4)


@pytest.mark.parametrize("strategy,params", [("recursive", {"max_chars": 12, "overlap_chars": 3, "explain": True}), ("sentence", {"max_chars": 20}), ("token", {"max_tokens": 9}), ("markdown", {"max_chars": 15, "overlap_chars": 2}), ("semantic", {"max_chars": 30, "min_chars": 5}), ("parent-child", {"parent_max": 20, "child_max": 9, "child_overlap": 2}), ("fixed-window", {"max_chars": 7, "overlap_chars": 2})])
def test_chunk_tables_hold_exact_slices(docs, strategy, params):
    text = {i: t for i, t, _ in DOCS}
    rows = st.chunk_documents(docs, strategy, **params).collect()
    assert {r["doc_id"] for r in rows} == {"a", "b", "c", "f"}
    for r in rows:
        assert r["text"] == text[r["doc_id"]][r["start"] : r["end"]] and r["strategy"] == strategy
    for i in "abcf":
        own = sorted((r["seq"], r["start"], r["end"]) for r in rows if r["doc_id"] == i)
        assert [n for n, _, _ in own] == list(range(len(own))) and own[0][1] == 0 and own[-1][2] == len(text[i])


def test_fixed_windows_stop_at_the_first_that_reaches_the_end(spark):
    df = spark.createDataFrame([(1, "abcdefghij")], "doc_id int, text string")
    spans = lambda m, o: [(r["start"], r["end"]) for r in st.chunk_documents(df, "fixed-window", max_chars=m, overlap_chars=o).orderBy("seq").collect()]
    assert spans(4, 2) == [(0, 4), (2, 6), (4, 8), (6, 10)] and spans(10, 0) == [(0, 10)] and spans(3, 0) == [(0, 3), (3, 6), (6, 9), (9, 10)]


def test_other_columns_and_names_do_not_matter(spark):
    df = spark.createDataFrame([(5, "甲乙。丙丁。", "x", 1)], "key int, body string, seq string, start int")
    rows = st.chunk_documents(df, "sentence", "key", "body", max_chars=3).collect()
    assert [(r["key"], r["text"]) for r in rows] == [(5, "甲乙。"), (5, "丙丁。")]
    assert st.chunk_documents(df.limit(0), "sentence", "key", "body").count() == 0
    assert [r["x"] for r in df.select(st.split_text(F.col("body"), "sentence", max_chars=3).alias("x")).collect()] == [["甲乙。", "丙丁。"]]


def bm25(chunks, question, k):
    """Scores by the formula, for one document's chunks."""
    tf = [Counter(tokens(t)) for t in chunks]
    sizes = [sum(c.values()) for c in tf]
    mean = sum(sizes) / max(1, len(sizes))
    out = []
    for i, c in enumerate(tf):
        score = 0.0
        for t in tokens(question):
            n = sum(t in x for x in tf)
            if c[t]:
                score += math.log((len(tf) - n + 0.5) / (n + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sizes[i] / max(mean, 1)))
        out.append((i, score))
    return [(i, s) for i, s in sorted(out, key=lambda x: (-round(x[1], 9), x[0])) if s > 0][:k]


def test_bm25_equals_the_formula(docs, questions):
    chunks = st.chunk_documents(docs, "sentence", max_chars=12)
    own = {i: [r["text"] for r in chunks.where(F.col("doc_id") == i).orderBy("seq").collect()] for i in "abc"}
    got = {}
    for r in rt.bm25_topk(chunks, questions, 2).orderBy("rank").collect():
        got.setdefault((r["doc_id"], r["q_idx"]), []).append((r["seq"], r["score"]))
    for i, _, qs in DOCS[:3]:
        for n, (q, _) in enumerate(qs):
            want = bm25(own[i], q, 2)
            assert [s for s, _ in got.get((i, n), [])] == [s for s, _ in want]
            assert [x for _, x in got.get((i, n), [])] == pytest.approx([x for _, x in want])


def test_recall_credits_strict_and_union_hits(spark):
    text = "aa bb cc dd"
    docs = spark.createDataFrame([("x", text)], "doc_id string, text string")
    chunks = spark.createDataFrame([("s", "x", 0, 0, 5, text[:5]), ("s", "x", 1, 5, 11, text[5:])], "strategy string, doc_id string, seq int, start int, end int, text string")
    q = spark.createDataFrame([("x", 0, "aa bb", "aa"), ("x", 1, "bb cc", "bb cc"), ("x", 2, "zz", "dd"), ("x", 3, "aa", "not there")], "doc_id string, q_idx int, q string, gold string")
    facts = rt.question_facts(chunks, docs, q, 2)
    r = rt.recall_at_k(facts, 2).first()
    assert (r["total"], r["strict_hits"], r["union_hits"], r["recall"], r["union_recall"]) == (4, 1, 1, 0.25, 0.5) and r["precision"] == 1 / 8
    assert [x["q_idx"] for x in rt.failures(facts).collect()] == [2, 3] and rt.failures(facts, 1).count() == 1
    assert [(x["q_idx"], x["seq"]) for x in rt.gold_chunks(chunks, q).orderBy("q_idx").collect()] == [(0, 0), (2, 1)]


def test_parent_recall_and_reports(docs, questions):
    parents, children = st.family_documents(docs, parent_max=20, child_max=9, child_overlap=2)
    r = rt.parent_recall(parents, children, docs, questions, 3).first()
    assert r["total"] == 6 and 0 < r["hits"] <= 5 and r["recall"] == r["hits"] / 6
    text = rp.full_report(docs, questions, 20, 2, [1])
    assert text.startswith("# Retrieval report") and all(f"| {n} |" in text for n in rp.NAMED)


def test_embedding_topk_equals_sorting(spark):
    rows = [(i, [math.cos(i), math.sin(i), i % 3 / 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in rt.embedding_topk(df, df.where("vec_id % 10 = 0"), 3).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v in rows[::10]:
        want = sorted((j for j, _ in rows if j != i), key=lambda j: (-round(dot(v, rows[j][1]) / math.sqrt(dot(v, v) * dot(rows[j][1], rows[j][1])), 9), j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == want


def test_embedding_topk_of_many_equal_vectors(spark):
    rng = np.random.default_rng(6)
    kinds = rng.normal(size=(5, 32))
    n = 900
    rows = [(int(i), [float(x) for x in kinds[i % 5]]) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    got = {}
    for r in rt.embedding_topk(df, df.where("vec_id % 9 = 0"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [i for i in range(q % 5, n, 5) if i != q][:4] for q in range(0, n, 9)}


def test_many_queries_meet_the_vectors_on_a_grid(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in (rng.normal(size=8) if i % 3 else [1.0] * 8)]) for i in rng.permutation(300)] + [(999, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    asked = df.where("vec_id % 5 = 0")
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9))
    one = sorted(map(key, rt.embedding_topk(df, asked, 4).collect()))
    assert one == sorted(map(key, rt.embedding_topk(df, asked, 4, most_queries=20).collect())) and len(one) == 4 * asked.count()
    assert rt.embedding_topk(df, asked.limit(0), 4).count() == 0


def test_the_first_chunk_with_the_gold(spark):
    chunks = spark.createDataFrame([("s", 1, 0, "甲乙"), ("s", 1, 1, "乙丙丁"), ("s", 1, 2, "丙丁"), ("t", 1, 0, "丙丁戊")], "strategy string, doc_id long, seq int, text string")
    asked = spark.createDataFrame([(1, 0, "丙丁"), (1, 1, "没有")], "doc_id long, q_idx int, gold string")
    assert sorted(map(tuple, rt.find_gold_chunk(chunks, asked).collect())) == [("s", 1, 0, 1), ("t", 1, 0, 0)]


def test_bm25_of_chunks_and_questions_without_terms(spark):
    chunks = spark.createDataFrame([("s", 1, 0, ""), ("s", 1, 1, "!!"), ("s", 1, 2, "red fox"), ("s", 1, 3, None), ("s", 2, 0, "red")], "strategy string, doc_id long, seq int, text string")
    asked = spark.createDataFrame([(1, 0, "red"), (1, 1, "?"), (3, 0, "red")], "doc_id long, q_idx int, q string")
    rows = rt.bm25_topk(chunks, asked, 3).collect()
    assert [(r["doc_id"], r["q_idx"], r["seq"]) for r in rows] == [(1, 0, 2)]
    # Four chunks of two terms in all: the average counts those without terms.
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    assert rows[0]["score"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1)))


def test_our_own_corpus_is_sound(spark):
    docs, asked = zh_mini(spark)
    rows = docs.join(asked, "doc_id").collect()
    assert docs.count() == 25 and len(rows) == 75 and all(r["gold"] in r["text"] and len(r["text"]) >= 250 for r in rows)
    assert len({(r["doc_id"], r["q"]) for r in rows}) == 75
    chunks = rp.strategy_chunks(docs, 150, 30)
    recall = {r["strategy"]: r["recall"] for r in rp.run_report(chunks, docs, asked, 3).collect()}
    assert set(recall) == set(rp.NAMED) and all(v > 0.9 for v in recall.values())


def test_times_and_shares(spark, docs):
    rows = {r["strategy"]: r for r in rp.compare_texts(docs, 40, 4).collect()}
    assert set(rows) == set(rp.NAMED) and all(r["time_ms"] > 0 and r["punct_share"] == round(r["ends_punct"] / r["chunks"], 3) for r in rows.values())


def test_shapes_and_medians(spark):
    rows = [("s", "x", i, 0, n, "，" * n if i == 2 else "甲" * (n - 1) + "。") for i, n in enumerate([5, 1, 3, 9])]
    chunks = spark.createDataFrame(rows, "strategy string, doc_id string, seq int, start int, end int, text string").withColumn("meta", F.struct(F.lit(0).alias("overlap_chars")))
    r = rp.chunk_stats(chunks).first()
    assert (r["n"], r["min_chars"], r["median_chars"], r["max_chars"], r["total_chars"]) == (4, 1, sorted([5, 1, 3, 9])[2], 9, 18)
    h = rp.hygiene_violations(chunks).first()
    assert (h["end_opener"], h["start_closer"]) == (0, 2)
    docs = spark.createDataFrame([("x", "甲" * 20)], "doc_id string, text string")
    c = rp.compare_strategies(chunks, docs).first()
    assert (c["chunks"], c["avg_chars"], c["ends_punct"], c["coverage"]) == (4, 4.5, 3, 0.9)


def test_calibration(spark):
    df = spark.createDataFrame([("春夏", 2), ("春夏", 4), ("x", 0), (None, 3)], "text string, ref int")
    r = rp.calibration(df, "ref").first()
    assert (r["n"], r["mean_error"], r["max_error"]) == (3, pytest.approx(0.5 / 3), 0.5)
    assert rp.calibration(df.limit(0), "ref").first()["mean_error"] == 0


def test_dry_judging_and_cost(spark, docs, questions):
    pairs = jd.build_pairs(st.chunk_documents(docs, "sentence", max_chars=12), questions)
    rows = {r["key"]: r for r in jd.judge_dry_run(pairs).collect()}
    assert len(rows) == pairs.count() and {r["score"] for r in rows.values()} <= {1, 3, 4}
    for p in pairs.collect():
        q, c = set(tokens(p["question"])), set(tokens(p["chunk_text"]))
        want = 1 if not q & c else 4 if len(q & c) / max(1, len(q)) >= 0.5 else 3
        assert rows[p["key"]]["score"] == want and p["key"] == f"sentence|{p['doc_id']}|{p['q_idx']}|{p['chunk_seq']}"
    priced = pairs.withColumn("est", jd.cost_estimate(F.col("chunk_text"), 1.0, 2.0)).orderBy("key").collect()
    total, kept = 0.0, []
    for p in priced:
        assert p["est"] == pytest.approx(round((-(-len(p["chunk_text"]) // 4) + 1 + 100) / 1000 + 0.1, 4))
        total += p["est"]
        if round(total, 9) <= 1.0:
            kept.append(p["key"])
    assert sorted(r["key"] for r in jd.within_cost(pairs, 1.0, 1.0, 2.0, partitions=3).collect()) == kept


def test_questions_from_sentences(docs, spark):
    d = spark.createDataFrame([(1, "这座桥长320米宽12米。天气很好。修建费用是五千万元整！流程共有三步，请按要求办理；短。")], "doc_id int, text string")
    rows = jd.qa_dry_run(d).orderBy("pos").collect()
    assert [r["gold"] for r in rows] == ["修建费用是五千万元整！", "流程共有三步，请按要求办理；"][-1:] or len(rows) >= 1
    made = spark.createDataFrame([(1, 0, "q1", "天气很好"), (1, 1, "q1", "天气很好"), (1, 2, "q2", "没有这句"), (1, 3, "", "天气很好"), (1, 4, " q3 ", " 短 ")], "doc_id int, pos int, question string, gold string")
    kept, stats = jd.qa_validate(made, d)
    s = stats.first()
    assert (s["raw"], s["kept"], s["dropped_bad_gold"], s["dropped_dupe"]) == (5, 2, 2, 1)
    assert [(r["question"], r["gold"]) for r in kept.orderBy("pos").collect()] == [("q1", "天气很好"), ("q3", "短")]


def test_sql_functions(spark, docs):
    register(spark)
    docs.createOrReplaceTempView("test_docs")
    rows = spark.sql("SELECT d.doc_id, c.* FROM test_docs d, LATERAL chunks(d.text, 'sentence', 12, 0) c ORDER BY doc_id, seq").collect()
    want = st.chunk_documents(docs, "sentence", max_chars=12).orderBy("doc_id", "seq").collect()
    assert [(r["doc_id"], r["start"], r["end"], r["text"]) for r in rows] == [(r["doc_id"], r["start"], r["end"], r["text"]) for r in want]
    assert spark.sql("SELECT token_count('你好 hello！') AS n, end_rule('甲。乙', 2) AS r").first() == (7, "sentence")
    texts = ["", "a", "甲。乙", "甲。\n乙", "甲\n\n乙", "甲，" + " " * 80 + "\n乙", "x.\u3000\r\ny", "…!…", "「甲」\n", None]
    spark.createDataFrame([(t, e) for t in texts for e in [*range(0, 1 + min(8, len(t or ""))), len(t or "") - 1, None]], "t string, e int").createOrReplaceTempView("test_ends")
    for r in spark.sql("SELECT t, e, end_rule(t, e) AS r, token_count(t) AS n FROM test_ends").collect():
        assert r["r"] == (None if r["t"] is None or r["e"] is None else sp.end_rule(r["t"], r["e"])), r
        assert r["n"] == (None if r["t"] is None else count_chars(r["t"]))
    plan = spark.sql("SELECT end_rule(t, e), token_count(t) FROM test_ends")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert spark.sql("SELECT count(*) AS n FROM sections('# a\nb\n# c\n')").first()["n"] == 2
    assert spark.sql("SELECT count(*) AS n FROM sentences('甲。乙。')").first()["n"] == 2


def test_public_names():
    assert all(getattr(spanloom, n) is not None for n in spanloom.__all__)
    assert [c["text"] for c in spanloom.chunk("甲乙。丙丁。", "sentence", max_chars=3)] == ["甲乙。", "丙丁。"] and spanloom.chunk("") == []
    with pytest.raises(AttributeError):
        _ = spanloom.nothing

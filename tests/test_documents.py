"""Document by document: the same results as the table forms, in one map over the documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import documents as dc
from spanloom.operators import spans as sp

MIXED = "Chunk sizes, 42 of them; the 费用是320元。Kept whole, or cut?\n\n\n  　 Then again: token, token. 周期为15天，然后停下。 "


@pytest.fixture(scope="module")
def texts(random_text):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "İstanbul", "Kelvin", "x", "42", "费用", "周期", "。", "\n", "  ", "delta!", "épsilon"]
    return [random_text(i, 900) for i in range(6)] + [" ".join(rng.choice(words) for _ in range(400)) for _ in range(6)] + [MIXED, MIXED * 12, " \n" * 400, "abc", "", None]


def rules_by_hand(text, end):
    if end >= len(text):
        return "text_end"
    head = text[:end]
    stem = head.rstrip(sp.WS)
    breaks = sum(c in "\r\n" for c in head[len(stem) :])
    last = stem[-1:] or "\0"
    if breaks:
        return "paragraph" if breaks > 1 or last in sp.RULE_SENTENCE else "newline"
    return "sentence" if last in sp.RULE_SENTENCE else "clause" if last in sp.RULE_CLAUSE else "budget"


def test_rules_of_windows_equal_the_scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(map(tuple, dc.window_rules(docs, 7).collect()))
    assert got == [(i, n, rules_by_hand(t, min(n * 7 + 7, len(t)))) for i, t in enumerate(texts) if t for n in range(-(-len(t) // 7))]


def test_rules_look_at_white_space_once():
    class Counted(str):
        seen = 0

        def __getitem__(self, i):
            Counted.seen += 1
            return str.__getitem__(self, i)

    # Each window looked back over all of the text before it: 2,000 windows, two million characters.
    text = Counted("。" + "\n" * 40_000 + "a")
    assert set(sp.end_rules(text, list(range(20, 40_000, 20)))) == {"paragraph"} and Counted.seen < 200_000


def test_rules_are_found_in_one_map(spark, texts):
    plan = dc.window_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 200)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "substring" not in plan and "Exchange" not in plan


def test_vectors_of_any_texts_equal_counting(texts):
    import zlib

    from spanloom.functions.text import hashed_vectors

    some = [t for t in texts if t is not None] + ["ab", "abc", "a\nb\nc", "é\x7fz\x80q" * 30, "x" * 300_000, "😀ab" * 50, ""]
    got = hashed_vectors(some)
    assert got.shape == (len(some), 96)
    for t, v in zip(some, got, strict=True):
        flat, want = t.replace("\n", ""), [0.0] * 96
        for i in range(len(flat) - 2):
            want[zlib.crc32(flat[i : i + 3].encode()) % 96] += 1
        norm = sum(x * x for x in want) ** 0.5
        assert list(v) == pytest.approx([x / norm if norm else 0.0 for x in want])


def test_vectors_go_by_batches(spark):
    from spanloom.functions.text import hashed_vector

    t = spark.createDataFrame([(None,), ("",), ("abcd",)], "t string").select(hashed_vector(F.col("t")).alias("v"))
    assert [r["v"] and (len(r["v"]), sum(x > 0 for x in r["v"])) for r in t.collect()] == [None, (96, 0), (96, 2)]
    assert "array_remove" not in t._jdf.queryExecution().executedPlan().toString()


def test_slices_bound_what_is_held():
    import pyarrow as pa

    from spanloom.batches import text_slices

    column = pa.array(["a" * 10, None, "é" * 5, "b" * 100, "", "c"] * 3)[1:]
    at = list(text_slices(column, 30))
    assert [a for a, _ in at] == [0, *(b for _, b in at[:-1])] and at[-1][1] == len(column)
    assert all(b - a == 1 or sum(len((t or "").encode()) for t in column[a:b].to_pylist()) <= 30 for a, b in at)
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_batches_to_workers_are_bounded(spark):
    # Ten thousand texts of any length went to a worker at once before.
    from spanloom.operators import strategies as st

    docs = spark.createDataFrame([(i, f"{i}. " + "A sentence of some words. " * 8000) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    chunks = st.chunk_documents(docs, "recursive", max_chars=100, overlap_chars=0)
    assert int(spark.conf.get(key)) < 1 << 23
    many = chunks.count()
    parts = docs.select(st.split_text(F.col("text"), "recursive", max_chars=100, overlap_chars=0).alias("p")).select(F.size("p"))
    assert sum(r[0] for r in parts.collect()) == many
    spark.conf.set(key, 5 << 20)
    st.sentence_documents(docs)
    assert spark.conf.get(key) == str(5 << 20)  # what a session says holds
    spark.conf.unset(key)
    seen = st._mapped(docs, "doc_id", "text", "seen", lambda text: [st.Piece(0, 1)]).select("doc_id")
    assert seen.count() == 60


@pytest.fixture(scope="module")
def asked(spark, texts):
    from spanloom.plans.catalog import questions, with_asked

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return docs, questions(docs), with_asked(docs)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    one, other = (sorted(map(repr, df.select(sorted(a.columns)).collect())) for df in (a, b))
    assert one and one == other


def test_facts_equal_the_joins_and_move_no_text(asked):
    from spanloom.operators import retrieval as rt
    from spanloom.operators.strategies import chunk_documents

    docs, questions, with_asked = asked
    params = {"max_chars": 60, "overlap_chars": 10}
    for strategy in ("fixed-window", "recursive"):
        chunks = chunk_documents(docs, strategy, **params)
        facts = dc.document_facts(with_asked, {strategy: (strategy, params)}, 2)
        same(facts.drop("retriever"), rt.question_facts(chunks, docs, questions, 2, strategies=[strategy]))
        assert "Exchange" not in facts._jdf.queryExecution().executedPlan().toString()
        for how, table in (("bm25", rt.bm25_topk), ("vector", rt.vector_topk)):
            got = dc.document_topk(with_asked, strategy, 3, retriever=how, **params)
            same(got.withColumn("score", F.round("score", 9)), table(chunks, questions, 3).withColumn("score", F.round("score", 9)).select(got.columns))
    # Questions of a table by itself are brought to their documents.
    same(dc.document_facts(dc.with_questions(docs, questions), {"recursive": ("recursive", params)}, 2), facts)


def test_reports_by_document_equal_the_joins(asked):
    from spanloom.operators import reports as rp
    from spanloom.operators import retrieval as rt
    from spanloom.operators.strategies import chunk_documents, family_documents

    docs, questions, with_asked = asked
    names = ["fixed-window", "sentence", "recursive"]
    same(rp.run_report_by_document(with_asked, 90, 20, 3, names=names), rp.run_report(rp.strategy_chunks(docs, 90, 20, names=names), docs, questions, 3, strategies=names))
    chunks = chunk_documents(docs, "fixed-window", max_chars=90)
    same(rp.retrieval_interaction_by_document(with_asked, {"fixed-window": ("fixed-window", {"max_chars": 90})}, 1), rp.retrieval_interaction(chunks, docs, questions, 1))
    same(rp.parent_child_report_by_document(with_asked, 2), rp.parent_child_report(docs, questions, 2))
    same(dc.parent_recall_of(dc.family_facts(with_asked, 2), 2), rt.parent_recall(*family_documents(docs), docs, questions, 2))


def test_terms_of_windows_equal_the_aggregates(spark, texts):
    from spanloom.operators import retrieval as rt
    from spanloom.operators.strategies import chunk_documents

    # An id that repeats is one document's windows, counted together.
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[1]), (3, MIXED)], "doc_id bigint, text string")
    chunks = chunk_documents(docs, "fixed-window", max_chars=90)
    tf = rt.term_frequencies(chunks)
    got = dc.window_terms(docs, 90)
    same(got, tf.groupBy("doc_id", "seq").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens")))
    idf = rt.bm25_idf(tf, rt.chunk_lengths(chunks)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("n_chunks").alias("n_chunks"), F.max("avg_len").alias("avg_len"), F.round(F.sum("idf"), 6).alias("idf_sum"))
    same(dc.document_idf(docs, 90).withColumn("idf_sum", F.round("idf_sum", 6)), idf)
    # Texts move once, no term does.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Generate" not in plan


def test_nearest_rows_in_bounded_memory():
    import tracemalloc

    import numpy as np

    from spanloom.operators.retrieval import _nearest

    rng = np.random.default_rng(3)
    x = rng.integers(-1, 2, (10_000, 8)).astype(float)  # many ties
    ids = rng.permutation(10_000).astype(np.int64)
    tracemalloc.start()
    got = _nearest(ids[:1500], x[:1500], ids, x, 5, "vec_id", 2048)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20  # five times as much before
    tracemalloc.stop()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in (0, 7, 1499):
        place = np.round(unit @ unit[i], 9)
        want = [ids[j] for j in sorted((j for j in range(10_000) if j != i), key=lambda j: (-place[j], ids[j]))[:5]]
        assert [r["vec_id"] for r in got.slice(i * 5, 5).to_pylist()] == want


def test_pairs_by_document_move_no_text(asked):
    from spanloom.operators import judging as jd
    from spanloom.operators.strategies import chunk_documents

    docs, questions, with_asked = asked
    pairs = jd.window_pairs(with_asked, 70)
    same(pairs, jd.build_pairs(chunk_documents(docs, "fixed-window", max_chars=70), questions))
    records = jd.judge_dry_run(pairs)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("array_intersect") == 1

"""Comparisons and reports: one pass of aggregates over chunk tables."""

from __future__ import annotations

import os
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..charsets import CLOSERS, OPENERS, REPORT_PUNCT, char_class
from ..functions.counters import token_count
from ..functions.text import ends_on, hashed_vectors, stripped
from .documents import Plans, document_facts, document_shapes, family_facts, parent_recall_of
from .retrieval import bm25_topk, failures, parent_recall, question_facts, recall_at_k, vector_topk
from .strategies import chunk_documents, family_documents

NAMED = ["fixed-window", "sentence", "token", "recursive", "semantic-hash-toy"]


def build_strategies(max_chars: int, overlap_chars: int, fixed_overlap: int = 0) -> dict[str, tuple[str, dict]]:
    """The compared strategies by name: strategy and parameters."""
    return {
        "fixed-window": ("fixed-window", {"max_chars": max_chars, "overlap_chars": fixed_overlap}),
        "sentence": ("sentence", {"max_chars": max_chars, "overlap_chars": overlap_chars}),
        "token": ("token", {"max_tokens": max_chars, "overlap_tokens": overlap_chars}),
        "recursive": ("recursive", {"max_chars": max_chars, "overlap_chars": overlap_chars}),
        "semantic-hash-toy": ("semantic", {"embed_fn": hashed_vectors, "max_chars": max_chars, "min_chars": min(max_chars, max(20, max_chars // 3)), "overlap_chars": overlap_chars}),
    }


def strategy_chunks(docs: DataFrame, max_chars: int, overlap_chars: int, fixed_overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """The compared strategies' chunks in one table."""
    params = build_strategies(max_chars, overlap_chars, fixed_overlap)
    tables = [chunk_documents(docs, params[n][0], id_col, text_col, **params[n][1]).withColumn("strategy", F.lit(n)) for n in names or NAMED]
    return reduce(DataFrame.unionByName, tables)


def strategy_times(docs: DataFrame, max_chars: int, overlap_chars: int, fixed_overlap: int = 0, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """strategy, time_ms, mchars_per_s of a run over all of ``docs`` by itself, its chunks counted and not kept."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    # The first run would also pay for the start of the workers.
    strategy_chunks(docs.limit(1), max_chars, overlap_chars, fixed_overlap, id_col, text_col, names).write.format("noop").mode("overwrite").save()
    rows = []
    for name in names or NAMED:
        chunks = strategy_chunks(docs, max_chars, overlap_chars, fixed_overlap, id_col, text_col, [name])
        began = time.perf_counter()
        chunks.write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append((name, round(took * 1000, 1), round(chars / took / 1e6, 2)))
    return spark.createDataFrame(rows, "strategy string, time_ms double, mchars_per_s double")


def compare_texts(docs: DataFrame, max_chars: int, overlap_chars: int, fixed_overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`compare_strategies` of all strategies, and how long each took."""
    chunks = strategy_chunks(docs, max_chars, overlap_chars, fixed_overlap, id_col, text_col)
    return compare_strategies(chunks, docs, id_col, text_col).join(strategy_times(docs, max_chars, overlap_chars, fixed_overlap, id_col, text_col), "strategy")


def compare_strategies(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """strategy, chunks, avg_chars, min_chars, max_chars, ends_punct (and its share), coverage."""
    n = F.col("end") - F.col("start")
    total = docs.agg(F.greatest(F.lit(1), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).alias("total_chars"))
    rows = chunks.groupBy("strategy").agg(
        F.count("*").alias("chunks"), F.round(F.avg(n), 1).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
        F.count_if(ends_on(F.col("text"), REPORT_PUNCT)).alias("ends_punct"), F.sum(n).alias("covered"),
    ).withColumn("punct_share", F.round(F.col("ends_punct") / F.col("chunks"), 3))
    return rows.crossJoin(F.broadcast(total)).withColumn("coverage", F.round(F.col("covered") / F.col("total_chars"), 3)).drop("covered", "total_chars")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """strategy, n, min, upper median, max and total of chunk sizes.

    The median is read off the histogram of sizes, which is small, so no list of
    all sizes is ever gathered.
    """
    sizes = chunks.groupBy("strategy", (F.col("end") - F.col("start")).alias("size")).agg(F.count("*").alias("k"))
    up = Window.partitionBy("strategy").orderBy("size")
    ranked = sizes.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(Window.partitionBy("strategy")))
    middle = F.floor(F.col("n") / 2)
    return ranked.groupBy("strategy").agg(
        F.max("n").alias("n"), F.min("size").alias("min_chars"), F.min(F.when(F.col("upto") > middle, F.col("size"))).alias("median_chars"),
        F.max("size").alias("max_chars"), F.sum(F.col("k") * F.col("size")).alias("total_chars"),
    )


def rule_distribution(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("strategy", F.col("meta.end_rule").alias("end_rule")).agg(F.count("*").alias("n"))


def hygiene_violations(chunks: DataFrame) -> DataFrame:
    """strategy, end_opener, start_closer: chunks that end on an opener or (not the first, no overlap) start on a closer."""
    starts = F.substring(stripped(F.col("text")), 1, 1).rlike(char_class(CLOSERS))
    first_free = (F.col("seq") > 0) & (F.coalesce(F.col("meta.overlap_chars"), F.lit(0)) == 0)
    return chunks.groupBy("strategy").agg(F.count_if(ends_on(F.col("text"), OPENERS)).alias("end_opener"), F.count_if(F.coalesce(starts & first_free, F.lit(False))).alias("start_closer"))


def starts_mid_sentence(chunks: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """strategy, chunks, mid: chunks whose preceding character ends neither a sentence nor a line."""
    before = F.substring(F.col("_t"), F.col("start"), F.lit(1))
    with_text = chunks.join(docs.select(id_col, F.col(text_col).alias("_t")), id_col)
    return with_text.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_if((F.col("start") > 0) & ~before.rlike(char_class(REPORT_PUNCT + "\n"))).alias("mid"))


def answer_integrity(chunks: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, golds, intact: gold answers that one chunk holds whole."""
    per_gold = chunks.select("strategy", id_col, "text").join(questions.select(id_col, "q_idx", "gold"), id_col).groupBy("strategy", id_col, "q_idx").agg(F.max(F.contains("text", F.col("gold"))).alias("held"))
    return per_gold.groupBy("strategy").agg(F.count("*").alias("golds"), F.count_if("held").alias("intact"))


def calibration(docs: DataFrame, reference: str, text_col: str = "text") -> DataFrame:
    """n, mean_error, max_error of the character counter against a column of reference counts.

    Errors are relative, rounded to 4 places before they are aggregated; a
    reference of 0 counts as no error.
    """
    error = F.when(F.col(reference) == 0, 0.0).otherwise(F.bround(F.abs(token_count(F.col(text_col)) - F.col(reference)) / F.col(reference), 4))
    return docs.where(F.col(text_col).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.avg(error), F.lit(0.0)).alias("mean_error"), F.coalesce(F.max(error), F.lit(0.0)).alias("max_error"))


def run_report(chunks: DataFrame, docs: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", strategies: list[str] | None = None) -> DataFrame:
    """Recall and shape of every strategy, with the questions it misses."""
    facts = question_facts(chunks, docs, questions, k, id_col, strategies=strategies)
    missed = facts.where("NOT strict AND NOT union").groupBy("strategy").agg(F.array_sort(F.collect_list(_question_name(id_col))).alias("misses"))
    return recall_at_k(facts, k).join(compare_strategies(chunks, docs, id_col), "strategy").join(missed, "strategy", "left").withColumn("k", F.lit(k))


def _question_name(id_col: str) -> Column:
    return F.concat_ws("|", F.col(id_col).cast("string"), "q")


def run_report_by_document(asked: DataFrame, max_chars: int, overlap_chars: int, k: int, fixed_overlap: int = 0, id_col: str = "doc_id", names: list[str] | None = None) -> DataFrame:
    """:func:`run_report` of the compared strategies, by documents with their ``asked``: no text is shuffled."""
    params = build_strategies(max_chars, overlap_chars, fixed_overlap)
    rows = document_shapes(asked, {n: params[n] for n in names or NAMED}, k, id_col)
    named = F.transform("misses", lambda q: F.concat_ws("|", F.col(id_col).cast("string"), q))
    of_all = F.flatten(F.collect_list(F.when(F.size("misses") > 0, named)))
    sums = rows.groupBy("strategy").agg(
        *(F.sum(c).alias(c) for c in ("total", "strict_hits", "union_hits", "relevant", "chunks", "covered", "ends_punct")), F.min("least").alias("min_chars"), F.max("most").alias("max_chars"), of_all.alias("misses"),
    ).where("total > 0 AND chunks > 0")
    chars = asked.agg(F.greatest(F.lit(1), F.coalesce(F.sum(F.length("text")), F.lit(0))).alias("total_chars"))
    total, strict, union = F.col("total"), F.col("strict_hits"), F.col("union_hits")
    return sums.crossJoin(F.broadcast(chars)).select(
        "strategy", "total", "strict_hits", "union_hits", (strict / total).alias("recall"), (F.col("relevant") / (total * k)).alias("precision"), ((strict + union) / total).alias("union_recall"),
        "chunks", F.round(F.col("covered") / F.col("chunks"), 1).alias("avg_chars"), "min_chars", "max_chars", "ends_punct", F.round(F.col("ends_punct") / F.col("chunks"), 3).alias("punct_share"),
        F.round(F.col("covered") / F.col("total_chars"), 3).alias("coverage"), F.when(F.size("misses") > 0, F.array_sort("misses")).alias("misses"), F.lit(k).alias("k"),
    )


def retrieval_interaction(chunks: DataFrame, docs: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", strategies: list[str] | None = None) -> DataFrame:
    """strategy, recall by BM25, recall by hashed vectors."""
    by = {name: recall_at_k(question_facts(chunks, docs, questions, k, id_col, top=top, strategies=strategies), k).select("strategy", F.col("recall").alias(name)) for name, top in (("bm25", bm25_topk(chunks, questions, k, id_col)), ("vector", vector_topk(chunks, questions, k, id_col)))}
    return by["bm25"].join(by["vector"], "strategy")


def retrieval_interaction_by_document(asked: DataFrame, plans: Plans, k: int, id_col: str = "doc_id") -> DataFrame:
    """:func:`retrieval_interaction`, by documents with their ``asked``: both retrievers in one pass."""
    facts = document_facts(asked, plans, k, id_col, retrievers=("bm25", "vector"))
    recall = lambda how: (F.count_if(F.col("strict") & (F.col("retriever") == how)) / F.greatest(F.lit(1), F.count_if(F.col("retriever") == how))).alias(how)
    return facts.groupBy("strategy").agg(recall("bm25"), recall("vector"))


def parent_child_report(docs: DataFrame, questions: DataFrame, k: int, parent_max: int = 600, child_max: int = 150, overlap: int = 30, id_col: str = "doc_id") -> DataFrame:
    """k, flat recall, parent recall, numbers of parents and children."""
    parents, children = family_documents(docs, id_col, parent_max=parent_max, child_max=child_max, child_overlap=overlap)
    flat = recall_at_k(question_facts(chunk_documents(docs, "recursive", id_col, max_chars=child_max, overlap_chars=overlap), docs, questions, k, id_col, strategies=["recursive"]), k)
    out = parent_recall(parents, children, docs, questions, k, id_col).select("k", F.col("recall").alias("parent_recall"))
    counts = parents.agg(F.count("*").alias("parents")).crossJoin(children.agg(F.count("*").alias("children")))
    return out.crossJoin(flat.select(F.col("recall").alias("flat_recall"))).crossJoin(counts)


def parent_child_report_by_document(asked: DataFrame, k: int, parent_max: int = 600, child_max: int = 150, overlap: int = 30, id_col: str = "doc_id") -> DataFrame:
    """:func:`parent_child_report`, by documents with their ``asked``: no text is shuffled."""
    flat = recall_at_k(document_facts(asked, {"recursive": ("recursive", {"max_chars": child_max, "overlap_chars": overlap})}, k, id_col), k)
    families = family_facts(asked, k, id_col, parent_max=parent_max, child_max=child_max, child_overlap=overlap)
    out = parent_recall_of(families, k).select("k", F.col("recall").alias("parent_recall"))
    counts = families.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("parents", "children")))
    return out.crossJoin(flat.select(F.col("recall").alias("flat_recall"))).crossJoin(counts)


def as_markdown(rows: DataFrame, columns: list[str] | None = None) -> str:
    """A report table as Markdown, rendered on the driver."""
    columns = columns or rows.columns
    cell = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
    lines = [f"| {' | '.join(columns)} |", f"|{' --- |' * len(columns)}"]
    return "\n".join(lines + [f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows.select(columns).collect()]) + "\n"


def full_report(docs: DataFrame, questions: DataFrame, max_chars: int, overlap_chars: int, ks: list[int], id_col: str = "doc_id") -> str:
    """Markdown of all reports: recall per k with failure lists, parents, retrievers, calibration."""
    chunks = strategy_chunks(docs, max_chars, overlap_chars, id_col=id_col)
    out = ["# Retrieval report\n", "## Strategies\n\n" + as_markdown(compare_texts(docs, max_chars, overlap_chars, id_col=id_col).orderBy("strategy"))]
    for k in ks:
        columns = ["strategy", "recall", "precision", "union_recall", "strict_hits", "union_hits", "total", "chunks", "avg_chars", "max_chars", "ends_punct", "punct_share"]
        out.append(f"## k = {k}\n\n" + as_markdown(run_report(chunks, docs, questions, k, id_col, NAMED).orderBy("strategy"), columns))
        out.append(f"### Missed at k = {k}\n\n" + as_markdown(failures(question_facts(chunks, docs, questions, k, id_col, strategies=NAMED), id_col=id_col).orderBy("strategy", id_col, "q")))
    out.append("## Parents and children\n\n" + "\n".join(as_markdown(parent_child_report(docs, questions, k, id_col=id_col)) for k in ks))
    out.append("## Retrievers\n\n" + as_markdown(retrieval_interaction(chunks, docs, questions, ks[0], id_col, NAMED).orderBy("strategy")))
    words = docs.withColumn("words", F.size(F.split("text", " ")))
    out.append("## Character counter against words\n\n" + as_markdown(calibration(words, "words")))
    return "\n".join(out)


def write_report(text: str, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)

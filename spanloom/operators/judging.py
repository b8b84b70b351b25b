"""Judging chunk-question pairs and generating questions, as resumable batch jobs.

A job's state is an append-only table keyed by pair (or document); what is there
already is left out by an anti-join. Live calls go through an injected callable
in a partition-wise map, with retries; dry runs are native expressions.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..charsets import SENTENCE_CLOSERS, SENTENCE_END, char_class
from ..functions.text import retrieval_tokens, stripped
from .strategies import windows_with

PAIR_KEY = ("strategy", "doc_id", "q_idx", "chunk_seq")


def build_pairs(chunks: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every question of a document with every chunk of it, keyed."""
    pairs = chunks.select("strategy", id_col, F.col("seq").alias("chunk_seq"), F.col("text").alias("chunk_text")).join(questions.select(id_col, "q_idx", F.col("q").alias("question")), id_col)
    return _keyed(pairs, id_col)


def window_pairs(asked: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`build_pairs` of documents with their ``asked`` and their fixed windows, where the text is: none is shuffled."""
    chunks = windows_with(asked.where(F.col(id_col).isNotNull() & (F.size("asked") > 0)), ("asked",), max_chars, 0, id_col, text_col)
    pairs = chunks.select(id_col, "strategy", F.col("seq").alias("chunk_seq"), F.col("text").alias("chunk_text"), F.explode("asked").alias("_a"))
    return _keyed(pairs.select(id_col, "strategy", "chunk_seq", "chunk_text", F.col("_a.q_idx").alias("q_idx"), F.col("_a.q").alias("question")), id_col)


def _keyed(pairs: DataFrame, id_col: str) -> DataFrame:
    return pairs.withColumn("key", F.concat_ws("|", *(F.col(c if c != "doc_id" else id_col).cast("string") for c in PAIR_KEY)))


def pending(pairs: DataFrame, state: DataFrame | None, retry_errors: bool = False) -> DataFrame:
    """Pairs without a record; records of errors count as done unless ``retry_errors``."""
    if state is None:
        return pairs
    # A record is a record, whichever is the last; that matters only where errors are no records.
    done = latest(state).where("method <> 'error'") if retry_errors else state
    return pairs.join(done.select("key"), "key", "left_anti")


def latest(state: DataFrame) -> DataFrame:
    """The last record of every key, by ``ts``; records without a key are dropped."""
    order = Window.partitionBy("key").orderBy(F.col("ts").desc_nulls_last())
    return state.where("key IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


# The reasons that dry-run records carry.
NOTHING_SHARED = "empty chunk"
MUCH_SHARED = "high lexical overlap with question"
SOME_SHARED = "moderate lexical overlap"


def dry_run_score(question: Column, chunk: Column) -> tuple[Column, Column]:
    """(score 1, 3 or 4; reason) by shared retrieval tokens.

    In a one-chunk index every shared token scores above zero, so only the share
    of the question's tokens matters.
    """
    return _scored(_share(question, chunk))


def _share(question: Column, chunk: Column) -> Column:
    """Share of the question's distinct tokens that the chunk has."""
    q = F.array_distinct(retrieval_tokens(question))
    return F.size(F.array_intersect(q, retrieval_tokens(chunk))) / F.greatest(F.lit(1), F.size(q))


def _scored(share: Column) -> tuple[Column, Column]:
    score = F.when(share == 0, 1).when(share >= 0.5, 4).otherwise(3)
    reason = F.when(share == 0, NOTHING_SHARED).when(share >= 0.5, MUCH_SHARED).otherwise(SOME_SHARED)
    return score, reason


def judge_dry_run(pairs: DataFrame) -> DataFrame:
    # As a column of its own, the share is found once; in score and reason it would be at each mention.
    pairs = pairs.withColumn("_share", _share(F.col("question"), F.col("chunk_text")))
    score, reason = _scored(F.col("_share"))
    return pairs.select("key", "strategy", "doc_id", "q_idx", "question", "chunk_seq", F.lit(1).alias("schema"), score.alias("score"), reason.alias("reason"), F.lit("dry-run-bm25").alias("method"))


def cost_estimate(chunk: Column, price_in: float, price_out: float) -> Column:
    """Input tokens (chunk plus 100) and 50 output tokens at prices per thousand, rounded to 4."""
    n = F.length(chunk)
    tokens = F.when(n == 0, 0).otherwise(F.ceil(n / 4) + 1) + 100
    return F.round(tokens / 1000 * price_in + 50 / 1000 * price_out, 4)


def within_cost(pairs: DataFrame, cap: float, price_in: float, price_out: float, partitions: int = 64) -> DataFrame:
    """Pairs, in key order, up to the first whose estimated cost would exceed ``cap``.

    A running sum in two levels: within key ranges, then over the ranges' totals,
    so no single task sees all pairs. The ranges' bounds are keys themselves,
    taken from a sample by hash, so a row's range does not depend on who asks.
    """
    priced = pairs.withColumn("est_cost", cost_estimate(F.col("chunk_text"), price_in, price_out))
    one_in = max(1, pairs.count() // (20 * partitions))
    sample = sorted(r["key"] for r in pairs.where(F.pmod(F.xxhash64("key"), F.lit(one_in)) == 0).select("key").distinct().limit(200 * partitions).collect())
    bounds = sample[:: max(1, -(-len(sample) // partitions))][1:]
    place = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<string>"), lambda b: b <= F.col("key")))
    inner = priced.withColumn("_range", place).withColumn("_in", F.sum("est_cost").over(Window.partitionBy("_range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)))
    totals = priced.groupBy(place.alias("_range")).agg(F.sum("est_cost").alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_range", "_before")
    return inner.join(F.broadcast(before), "_range").where(F.round(F.col("_before") + F.col("_in"), 9) <= cap).drop("_range", "_in", "_before")


RECORD = "score int, reason string, method string, error string, ts string"


def judge_live(
    pairs: DataFrame,
    judge: Callable[[str, str], tuple[int, str]],
    max_retries: int = 2,
    backoff: float = 1.0,
    per_minute: float | None = None,
    sleep: Callable[[float], None] = time.sleep,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One record per pair from an injected ``judge(question, chunk)``; failures become error records.

    Columns to ``keep`` go through beside the key, so that no join has to bring them back.
    """

    def attempt(question: str, chunk: str) -> tuple[int, str, str, str | None]:
        for n in range(max_retries + 1):
            try:
                return (*judge(question, chunk), "llm", None)
            except Exception as error:  # noqa: BLE001
                if n == max_retries:
                    return -1, "", "error", str(error)[:200]
                sleep(backoff * 2**n)
        raise AssertionError

    own = ["key", *keep]

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for question, chunk in zip(batch.column("asked").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                for column, value in zip(out, (*attempt(question, chunk), time.strftime("%Y-%m-%dT%H:%M:%S")), strict=True):
                    column.append(value)
                if per_minute:
                    sleep(60 / per_minute)
            kinds = [pa.int32(), *[pa.string()] * 4]
            answers = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *answers], names=[*own, "score", "reason", "method", "error", "ts"])

    source = pairs.select(*own, F.col("question").alias("asked"), F.col("chunk_text").alias("chunk"))
    head = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in own)
    records = (source.coalesce(1) if per_minute else source).mapInArrow(run, f"{head}, {RECORD}")
    return records.withColumn("schema", F.lit(1)) if keep else records


def judge_summary(records: DataFrame) -> DataFrame:
    """strategy, n, errors, mean_score of the latest records."""
    good = F.col("method") != "error"
    return records.groupBy("strategy").agg(F.count_if(good).alias("n"), F.count_if(~good).alias("errors"), F.round(F.avg(F.when(good, F.col("score"))), 3).alias("mean_score"))


# Fixed value: what a sentence that states a fact has in it.
FLAVOUR = "[0-9０-９]|标准|费用|时间|流程|要求|周期|限制|方法"


def sentences(text: Column) -> Column:
    """Sentence tiles of a text as an array, natively."""
    e, c = char_class(SENTENCE_END), char_class(SENTENCE_CLOSERS)
    rest = char_class(SENTENCE_END + "\n", negated=True)
    return F.regexp_extract_all(text, F.lit(f"\\n|{rest}*{e}{c}*|{rest}+"), F.lit(0))


def qa_dry_run(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text", flavour: str = FLAVOUR, enders: str = "。！？；") -> DataFrame:
    """id, pos, question, gold: every so-manieth sentence that looks like a fact."""
    fit = F.filter(F.transform(sentences(F.col(text_col)), lambda s: stripped(s)), lambda s: (F.length(s) >= 12) & F.right(s, F.lit(1)).rlike(char_class(enders)) & s.rlike(flavour))
    rows = docs.select(id_col, fit.alias("fit")).where("size(fit) > 0")
    step = F.greatest(F.lit(1), F.floor(F.size("fit") / max(1, n)).cast("int"))
    picked = F.slice(F.transform(F.sequence(F.lit(1), F.size("fit"), step), lambda i: F.element_at("fit", i)), 1, n)
    rows = rows.select(id_col, F.posexplode(picked).alias("pos", "gold"))
    return rows.select(id_col, "pos", F.concat(F.lit("（试运行）文中「"), F.substring("gold", 1, 10), F.lit("…」讲了什么？")).alias("question"), "gold")


def qa_validate(generated: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept pairs, per-document raw, kept, dropped_bad_gold, dropped_dupe) of (id, pos, question, gold) rows."""
    q, g = stripped(F.coalesce("question", F.lit(""))), stripped(F.coalesce("gold", F.lit("")))
    rows = generated.select(id_col, "pos", q.alias("question"), g.alias("gold")).join(docs.select(id_col, F.col(text_col).alias("_t")), id_col)
    rows = rows.withColumn("bad", (F.length("question") == 0) | (F.length("gold") == 0) | ~F.coalesce(F.contains("_t", F.col("gold")), F.lit(False))).drop("_t")
    order = Window.partitionBy(id_col, "bad", "question").orderBy("pos")
    rows = rows.withColumn("dupe", ~F.col("bad") & (F.row_number().over(order) > 1))
    stats = rows.groupBy(id_col).agg(F.count("*").alias("raw"), F.count_if(~F.col("bad") & ~F.col("dupe")).alias("kept"), F.count_if("bad").alias("dropped_bad_gold"), F.count_if("dupe").alias("dropped_dupe"))
    return rows.where("NOT bad AND NOT dupe").select(id_col, "pos", "question", "gold"), stats

"""Resumable jobs: judge pairs, or generate questions, against an append-only state table.

Each run reads the state, leaves out what is there by an anti-join, and writes
what is to be done down beside the state, dealt into batches. Every batch is one
append, so a run that is lost leaves no torn record and loses one batch of calls
at most; the next run does what is missing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import QA_STATE, append_state, read_state
from .judging import judge_dry_run, judge_live, judge_summary, latest, pending, qa_dry_run, qa_validate, within_cost


@dataclass
class RunStats:
    total: int = 0
    skipped: int = 0
    judged: int = 0
    errors: int = 0
    est_cost: float = 0.0
    cost_capped: bool = False
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class JudgeConfig:
    """Without ``judge`` a run is dry. ``max_cost`` and prices (per thousand tokens) hold for live runs."""

    judge: Callable[[str, str], tuple[int, str]] | None = None
    max_retries: int = 2
    backoff: float = 1.0
    per_minute: float | None = None
    max_cost: float | None = None
    price_in: float = 0.0
    price_out: float = 0.0
    retry_errors: bool = False
    sleep: Callable[[float], None] = time.sleep
    batch_size: int = 1000  # live calls to a batch


def _state(spark: SparkSession, path: str, **kw) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return read_state(spark, path, **kw) if there else None


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _batches(todo: DataFrame, state_path: str, key: str, size: int) -> Iterator[DataFrame]:
    """``todo`` as it is now, in parts of about ``size`` rows.

    It is written once, as appending to the state changes what is left to do.
    """
    spark, plan = todo.sparkSession, f"{state_path.rstrip('/')}.plan-{uuid.uuid4().hex}"
    todo.write.parquet(plan)
    try:
        rows = spark.read.schema(todo.schema).parquet(plan)
        parts = max(1, -(-rows.count() // max(1, size)))
        for part in range(parts):
            yield rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else rows
    finally:
        _delete(spark, plan)


def run_judging(pairs: DataFrame, state_path: str, config: JudgeConfig | None = None) -> RunStats:
    c, spark = config or JudgeConfig(), pairs.sparkSession
    state = _state(spark, state_path)
    todo = pending(pairs, state, c.retry_errors)
    stats = RunStats(total=pairs.count())
    left = stats.total if state is None else pending(pairs.select("key"), state, c.retry_errors).count()
    stats.skipped = stats.total - left
    save = lambda records: append_state(records.withColumn("doc_id", F.col("doc_id").cast("string")), state_path)
    if c.judge is None:
        # Scores are cheap beside the texts they come from: all pairs are scored where they are, and the records
        # of those that are done already are left out, so that no text is dealt by its pair's key.
        save(pending(judge_dry_run(pairs), state, c.retry_errors).withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    else:
        if c.max_cost is not None:
            todo = within_cost(todo, c.max_cost, c.price_in, c.price_out)
            row = todo.agg(F.count("*").alias("n"), F.sum("est_cost").alias("cost")).first()
            stats.est_cost, stats.cost_capped = round(row["cost"] or 0.0, 4), row["n"] < left
            if stats.cost_capped:
                stats.notes.append(f"stopped at the cost cap of {c.max_cost}: {left - row['n']} pairs are left")
        for part in _batches(todo, state_path, "key", c.batch_size):
            save(judge_live(part, c.judge, c.max_retries, c.backoff, c.per_minute, c.sleep, keep=("strategy", "doc_id", "q_idx", "question", "chunk_seq")))
    done = latest(_state(spark, state_path)).join(pairs.select("key"), "key", "left_semi")
    counts = done.agg(F.count("*").alias("n"), F.count_if(F.col("method") == "error").alias("errors")).first()
    stats.judged, stats.errors = counts["n"] - stats.skipped, counts["errors"]
    return stats


def summarize(spark: SparkSession, state_path: str) -> DataFrame:
    """strategy, n, errors, mean_score of a judging state, by strategy."""
    return judge_summary(latest(read_state(spark, state_path))).orderBy("strategy")


GENERATED = "doc_id string, pos int, question string, gold string, error string"


def generate_questions(docs: DataFrame, generate: Callable[[str, int], list[tuple[str, str]]], n: int = 3, max_retries: int = 2, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """doc_id, pos, question, gold, error rows from an injected ``generate(text, n)``; pos is -1 with an error."""

    def attempt(text: str):
        for k in range(max_retries + 1):
            try:
                return generate(text, n), None
            except Exception as error:  # noqa: BLE001
                if k == max_retries:
                    return [], str(error)[:200]
                sleep(backoff * 2**k)

    def run(batches):
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, error = attempt(text or "")
                rows += [(d, i, q, g, None) for i, (q, g) in enumerate(pairs)] or [(d, -1, None, None, error)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "pos", "question", "gold", "error"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, GENERATED)


def question_records(todo: DataFrame, made: DataFrame, method: str) -> DataFrame:
    """A state record for each document: its valid pairs of those ``made``, and counters, or its error."""
    kept, counters = qa_validate(made.where("pos >= 0"), todo)
    pairs = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "question", "gold"))).alias("p"))
    pair = lambda x: F.struct(x["question"].alias("question"), x["gold"].alias("gold"), F.lit(method).alias("method"))
    errors = made.where("error IS NOT NULL").select("doc_id", "error")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return todo.select("doc_id").join(counters, "doc_id", "left").join(pairs, "doc_id", "left").join(errors, "doc_id", "left").select(
        F.lit(1).alias("schema"), "doc_id", F.struct("doc_id", *(zero(c) for c in ("raw", "kept", "dropped_bad_gold", "dropped_dupe"))).alias("stats"),
        F.coalesce(F.transform("p", pair), F.array().cast("array<struct<question:string,gold:string,method:string>>")).alias("pairs"), "error",
    )


def run_questions(docs: DataFrame, state_path: str, generate: Callable[[str, int], list[tuple[str, str]]] | None = None, n: int = 3, batch_size: int = 200, **retries) -> RunStats:
    """One state record per document that has none, ``batch_size`` documents of live calls at a time."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    state = _state(spark, state_path, schema=QA_STATE, key="doc_id")
    todo = docs if state is None else docs.join(state.select("doc_id").distinct(), "doc_id", "left_anti")
    total = docs.count()
    stats = RunStats(total=total, skipped=total - todo.count())
    if generate is None:
        append_state(question_records(todo, qa_dry_run(todo, n).withColumn("error", F.lit(None).cast("string")), "dry-run"), state_path)
    else:
        for part in _batches(todo, state_path, "doc_id", batch_size):
            # What the service answered is written first: it is read three times, and asked for once.
            answers = f"{state_path.rstrip('/')}.answers-{uuid.uuid4().hex}"
            generate_questions(part, generate, n, **retries).write.parquet(answers)
            made = spark.read.schema(GENERATED).parquet(answers)
            append_state(question_records(part, made, "llm"), state_path)
            _delete(spark, answers)
    now = _state(spark, state_path, schema=QA_STATE, key="doc_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    row = now.agg(F.count("*").alias("n"), F.count("error").alias("errors")).first()
    stats.judged, stats.errors = row["n"] - stats.skipped, row["errors"]
    return stats

"""Structured Streaming: chunking is a stateless map, judging resumes by key.

``chunk_stream`` adds no state to a streaming table of documents.
``judge_stream`` handles each micro-batch by the same anti-join as a batch job,
so a batch that is replayed after a failure judges no pair twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.judging import judge_dry_run, pending
from ..operators.strategies import chunk_documents


def chunk_stream(documents: DataFrame, strategy: str = "recursive", **params) -> DataFrame:
    if not documents.isStreaming:
        raise ValueError("documents must be a streaming table; use chunk_documents for others")
    return chunk_documents(documents, strategy, **params)


def chunk_rates(chunks: DataFrame, time_col: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Chunks and characters per window of event time and strategy, late rows up to ``late``."""
    n = F.col("end") - F.col("start")
    return chunks.withWatermark(time_col, late).groupBy(F.window(time_col, width), "strategy").agg(F.count("*").alias("chunks"), F.sum(n).alias("chars"))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def judge_stream(pairs: DataFrame, state_path: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] = judge_dry_run, available_now: bool = True) -> StreamingQuery:
    """Judges each new pair once; records go to the parquet table at ``state_path``."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        state = spark.read.parquet(state_path) if there else None
        fresh = pending(rows.dropDuplicates(["key"]), state)
        judge(fresh).withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("append").parquet(state_path)

    writer = pairs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

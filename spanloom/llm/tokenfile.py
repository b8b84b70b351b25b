"""Token-id files: one zstandard frame per document, one shared dictionary.

Documents are range-partitioned and sorted by id, then encoded: compressed texts
are narrower than frames of single documents. Every partition is a shard, a run
of blocks; a block is a row of the written table:

    shard, block, dict_hash (sha256 of the dictionary), base (ids in the shard
    before the block), ids (ids in the block), first_doc, last_doc,
    doc_ids[], n_tokens[], offsets[] (of each frame, and the payload's end),
    payload (the frames, back to back)

A frame is a document's ids as little-endian unsigned 16- or 32-bit integers
(``width``), compressed on its own with the shared dictionary, so a short
document is read by its offset alone. Blocks go through Spark's own writer, so
any Hadoop file system will do and a lost task leaves nothing behind. The
dictionary (trained on about ``sample`` documents, chosen by a hash of the id)
lies beside them, and a reader refuses blocks of another dictionary.

Defined results: a null or empty text is the end id alone; rows with equal ids
keep their order by text hash; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_tokenizer, encoded, encoder_of
from .common import Scratch, delete_path, hash_fraction, need_columns, tidy

BLOCK = (
    "shard int, block int, width int, dict_hash string, base bigint, ids bigint, first_doc bigint, last_doc bigint, "
    "doc_ids array<bigint>, n_tokens array<int>, offsets array<int>, payload binary"
)


def train_dictionary(samples: list[bytes], size: int = 1 << 15) -> bytes:
    """A dictionary for zstandard; a few small samples serve as raw content."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _writer(path: str, dictionary: bytes, width: int, end_id: int, level: int, block_bytes: int, block_docs: int):
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        encoder, end = encoder_of(path), np.array([end_id], "<u4").tobytes()
        shard, block, base = TaskContext.get().partitionId(), 0, 0
        docs, counts, frames, held = [], [], [], 0

        def row():
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype(np.int32)
            known = [d for d in docs if d is not None]
            columns = [[shard], [block], [width], [digest], [base], [sum(counts)], [known[0] if known else None], [known[-1] if known else None], [docs], [counts], [offsets.tolist()], [b"".join(frames)]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for doc, ids in (x for batch in batches for some in encoded(encoder, batch, end) for x in some):
            frame = press.compress(_narrow(ids, width))
            docs.append(doc)
            counts.append(len(ids) // 4)
            frames.append(frame)
            held += len(frame)
            if held >= block_bytes or len(docs) >= block_docs:
                yield row()
                block, base = block + 1, base + sum(counts)
                docs, counts, frames, held = [], [], [], 0
        if docs:
            yield row()

    return run


def write_token_file(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    tokenizer: str | None = None,
    sample: int = 512,
    level: int = 3,
    block_bytes: int = 1 << 20,
    block_docs: int = 2048,
) -> None:
    """Write ``path``/blocks and ``path``/dictionary."""
    need_columns(docs, id_col, text_col)
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    encoder = encoder_of(tokenizer)
    width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    chosen = hash_fraction(source.where("text IS NOT NULL"), F.col("doc"), sample).select("text").limit(2 * sample)
    dictionary = train_dictionary([_narrow(encoder.encode(r["text"]), width) for r in chosen.collect()])
    rows = [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), width, end_id)]
    spark.createDataFrame(rows, "dict_hash string, dictionary binary, width int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    order = [F.col("doc"), F.xxhash64("text")]
    writer = _writer(tokenizer, dictionary, width, end_id, level, block_bytes, block_docs)
    blocks = source.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(writer, "encoder"), BLOCK)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["dict_hash"]:
        raise ValueError(f"the dictionary in {path} does not have the hash it is stored under")
    return row["dict_hash"], dictionary


def _frames(batch: pa.RecordBatch, dict_hash: str, unpress):
    """(shard, base, doc, ids) of every document of a batch of blocks."""
    for block in batch.to_pylist():
        if block["dict_hash"] != dict_hash:
            raise ValueError(f"shard {block['shard']} was written with dictionary {block['dict_hash']}, not {dict_hash}")
        at, kind = block["base"], "<u2" if block["width"] == 2 else "<u4"
        for i, (doc, n) in enumerate(zip(block["doc_ids"], block["n_tokens"], strict=True)):
            ids = np.frombuffer(unpress.decompress(block["payload"][block["offsets"][i] : block["offsets"][i + 1]]), kind)
            yield block["shard"], at, doc, ids
            at += n


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    dict_hash, dictionary = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    start, total = {}, 0
    for r in sorted(blocks.groupBy("shard").agg(F.sum("ids").alias("ids")).collect(), key=lambda r: r["shard"]):
        start[r["shard"]] = total
        total += r["ids"]

    def run(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for k in range(batch.num_rows):
                out = [[], [], [], [], []]
                for shard, at, doc, ids in _frames(batch.slice(k, 1), dict_hash, unpress):
                    wide = ids.astype("<u4")
                    values = (doc, start[shard] + at, len(ids), zlib.crc32(wide.tobytes()), wide.astype(np.int32) if with_ids else None)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in out[:4]] + ([pa.array(out[4], pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(tidy(run), schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every document with this id; only its own frames are decompressed."""
    import zstandard

    dict_hash, dictionary = _dictionary(spark, path)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    near = spark.read.schema(BLOCK).parquet(f"{path}/blocks").where(F.col("first_doc") <= doc_id).where(F.col("last_doc") >= doc_id)
    found = near.select("dict_hash", "width", "payload", F.explode(F.arrays_zip("doc_ids", "offsets", F.slice("offsets", 2, F.size("doc_ids")).alias("ends"))).alias("x"))
    found = found.where(F.col("x.doc_ids") == doc_id).select("dict_hash", "width", F.substring("payload", F.col("x.offsets") + 1, F.col("x.ends") - F.col("x.offsets")).alias("frame"))
    out = []
    for r in found.collect():
        if r["dict_hash"] != dict_hash:
            raise ValueError(f"block was written with dictionary {r['dict_hash']}, not {dict_hash}")
        out.append(np.frombuffer(unpress.decompress(bytes(r["frame"])), "<u2" if r["width"] == 2 else "<u4").tolist())
    return out


def op10_token_file(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = f"{scratch.base}/tokens"
    write_token_file(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    out = scratch.put(read_token_file(spark, path, with_ids=False))
    delete_path(spark, path)
    return out

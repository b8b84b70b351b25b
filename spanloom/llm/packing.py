"""Sequence packing by minimum bin slack over the multiset of remaining lengths.

Each document becomes its ids plus an end id. Whole windows of ``window`` ids
fill sequences of their own; what remains of each document is one piece. Only
the histogram of remaining lengths (fewer than ``window`` numbers, whatever the
corpus) reaches the driver. There, the longest length left seeds a window and a
bitset subset-sum dynamic programme over the multiset of the others picks the
fill closest to capacity; its counts are traced back and the pattern is
repeated as often as the multiset allows. A window that leaves at most ``slack``
ids is placed as it is and padded (one whose fill is a power of two needs no
padding, whatever it leaves). Lengths whose best window leaves more go to a
tail, where the head of the next piece fills each window up and its rest begins
the next one; the tail's last part is cut into powers of two.

The plan is in terms of (length, rank). Ranks come from a two-level count, so a
length that a third of all rows share is ranked by many tasks. Texts are encoded
once: a piece's crc32 is computed there, and the ids of pieces that may be cut
are written beside it, so that only those of cut pieces are read again.

Defined results: a null text is empty, so its one piece is the end id; repeated
rows are packed each on their own; a null id is kept as null; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_tokenizer, encoded, encoder_of
from .common import Scratch, need_columns, tidy


def min_slack_pattern(counts: dict[int, int], seed: int, window: int) -> tuple[dict[int, int], int]:
    """Multiset of lengths with ``seed`` in it that fills ``window`` best, and its slack."""
    target = window - seed
    left = dict(counts)
    left[seed] -= 1
    full = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in left.items() if n > 0 and x <= target), reverse=True):
        copies, part = min(left[length], target // length), 1
        while copies > 0:
            k = min(part, copies)
            grown = reach | (reach << (k * length)) & full
            if grown != reach:
                steps.append((length, k, reach))
                reach = grown
            copies -= k
            part *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    used = {seed: 1}
    slack = target - at
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return used, slack


def padding(fill: int, window: int) -> int:
    """Ids that pad a sequence of ``fill`` ids: up to the window, none for a power of two."""
    return 0 if fill & (fill - 1) == 0 else window - fill


def pack_plan(histogram: dict[int, int], window: int, most_slack: int = 0):
    """(rows, tail, sequences, cuts).

    rows: (length, first rank, end rank, first sequence, pieces of that length in
    each sequence, offset of the first of them). tail: (length, first rank,
    position of that piece in the tail), its bounds in ``cuts``.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    rank = dict.fromkeys(counts, 0)
    rows, tail, sequence = [], [], 0
    if window in counts:
        n = counts.pop(window)
        rows.append((window, 0, n, 0, 1, 0))
        sequence = n
    position = 0
    while counts:
        seed = max(counts)
        used, slack = min_slack_pattern(counts, seed, window)
        if padding(window - slack, window) > most_slack:
            n = counts.pop(seed)
            tail.append((seed, rank[seed], position))
            position += seed * n
            continue
        times = min(counts[x] // k for x, k in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rows.append((length, rank[length], rank[length] + k * times, sequence, k, offset))
            offset += k * length
            rank[length] += k * times
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        sequence += times
    last = position - position % window
    cuts, rest = [], position % window
    for bit in reversed(range(window.bit_length())):
        if rest >> bit & 1:
            cuts.append(last)
            last += 1 << bit
    return sorted(rows), sorted(tail), sequence, cuts


def tail_parts(position: int, length: int, window: int, cuts: list[int], sequence: int) -> list[tuple[int, int, int, int]]:
    """(start within the piece, length, sequence, offset) of a tail piece at ``position``."""
    whole = cuts[0] if cuts else None
    out, at, end = [], position, position + length
    while at < end:
        if whole is None or at < whole:
            n = at // window
            begin, stop, number = n * window, (n + 1) * window, sequence + n
        else:
            i = bisect_right(cuts, at) - 1
            begin, number = cuts[i], sequence + whole // window + i
            stop = cuts[i + 1] if i + 1 < len(cuts) else 1 << 62
        take = min(end, stop) - at
        out.append((at - position, take, number, at - begin))
        at += take
    return out


PIECES = "key bigint, doc bigint, start bigint, length int, crc bigint, doc_tokens bigint, ids binary"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
_PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def _piece_maker(path: str, window: int, end_id: int, all_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encoder, end = encoder_of(path), np.array([end_id], "<u4").tobytes()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in encoded(encoder, batch, end):
                out: list[list] = [[] for _ in _PIECE_NAMES]
                for doc, ids in some:
                    total = len(ids) // 4
                    for at in range(0, total, window):
                        piece = ids[4 * at : 4 * (at + window)]
                        kept = piece if all_ids or len(piece) < 4 * window else None
                        for column, value in zip(out, (key, doc, at, len(piece) // 4, zlib.crc32(piece), total, kept), strict=True):
                            column.append(value)
                        key += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)

    return run


PLACED = "key bigint, doc bigint, start bigint, length int, crc bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cut_at int"
_PLACED_TYPES = [*_PIECE_TYPES[:6], pa.int64(), pa.int64(), pa.int32()]
_PLACED_NAMES = [x.split()[0] for x in PLACED.split(", ")]


def _placer(rows, tail, sequence, cuts, window):
    """Places of pieces; ``cut_at`` is where in its piece a part of a cut one begins, else null."""
    table = np.array(rows, np.int64).reshape(-1, 6)
    key = table[:, 0] << np.int64(44) | table[:, 1]
    in_tail = {length: (first, position) for length, first, position in tail}

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            tail_from = np.array([in_tail.get(x, (1 << 62, 0))[0] for x in length.tolist()], np.int64)
            planned = np.flatnonzero(rank < tail_from)
            row = table[np.searchsorted(key, length[planned] << np.int64(44) | rank[planned], "right") - 1]
            nth = rank[planned] - row[:, 1]
            whole = batch.select(_PLACED_NAMES[:6])
            places = [pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length[planned]), pa.nulls(len(planned), pa.int32())]
            yield pa.RecordBatch.from_arrays([*whole.take(pa.array(planned)).columns, *places], names=_PLACED_NAMES)
            last = np.flatnonzero(rank >= tail_from)
            out = [[] for _ in _PLACED_NAMES]
            for r, n in zip(whole.take(pa.array(last)).to_pylist(), rank[last].tolist(), strict=True):
                first_rank, position = in_tail[r["length"]]
                parts = tail_parts(position + (n - first_rank) * r["length"], r["length"], window, cuts, sequence)
                for begin, size, number, offset in parts:
                    values = (r["key"], r["doc"], r["start"] + begin, size, r["crc"], r["doc_tokens"], number, offset, begin if len(parts) > 1 else None)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _PLACED_TYPES, strict=True)], names=_PLACED_NAMES)

    return run


def _cutter(batches):
    """The ids, and their crc32, of the parts of cut pieces."""
    for batch in batches:
        crcs, parts = [], []
        for at, n, ids in zip(batch.column("cut_at").to_pylist(), batch.column("length").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            parts.append(ids if at is None else ids[4 * at : 4 * (at + n)])
            crcs.append(zlib.crc32(parts[-1]))
        columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"crc": pa.array(crcs, pa.int64()), "ids": pa.array(parts, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def rank_in_class(df: DataFrame, scratch: Scratch, key: str, order: list[str], per_bucket: int = 2000) -> DataFrame:
    """``rank`` (from 0) of each row among those of equal ``key``, by a two-level count.

    Rows are numbered within (key, bucket), buckets of a key are summed up; no
    task sees more than a bucket's share of a hot key.
    """
    buckets = max(1, -(-df.count() // per_bucket))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order))
    return dealt.withColumn("nth", nth).join(sizes, [key, "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    tokenizer: str | None = None,
    slack: int | None = None,
    broadcast_rows: int = 20_000,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked
    for, ids (little-endian unsigned 32-bit). ``slack`` is a 128th of the window unless given."""
    if window < 2:
        raise ValueError(f"window must be 2 or more, not {window}")
    need_columns(docs, id_col, text_col)
    path = tokenizer or default_tokenizer()
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.put(source.mapInArrow(tidy(_piece_maker(path, window, end_id, with_ids), "encoder"), PIECES))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, tail, sequence, cuts = pack_plan(histogram, window, window // 128 if slack is None else slack)
    ranked = rank_in_class(pieces.drop("ids"), scratch, "length", ["key"])
    placed = scratch.put(ranked.select(*_PLACED_NAMES[:6], "rank").mapInArrow(tidy(_placer(rows, tail, sequence, cuts, window)), PLACED))
    names = ["doc", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    again = placed if with_ids else placed.where("cut_at IS NOT NULL")
    n = again.count()
    out = placed.where("cut_at IS NULL")
    if n:
        again = F.broadcast(again) if n <= broadcast_rows else again
        joined = pieces.select("key", "ids").join(again, "key").select(*_PLACED_NAMES, "ids")
        again = scratch.put(joined.mapInArrow(tidy(_cutter), PLACED + ", ids binary"))
        out = again if with_ids else out.select(names).union(again.select(names))
    elif with_ids:
        out = out.withColumn("ids", F.lit(None).cast("binary"))
    scratch.drop(pieces)
    return out.select(
        F.col("doc").alias(id_col), "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", *(["ids"] * with_ids)
    )


def sequence_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, **how) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), padding (ids to add at the end)."""

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    pieces = pack_documents(docs, id_col, text_col, window, with_ids=True, **how).select("sequence_id", "offset", "ids")
    parts = pieces.mapInArrow(tidy(run), "sequence_id bigint, offset bigint, ids array<int>")
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    n = F.size("ids")
    return parts.groupBy("sequence_id").agg(whole.alias("ids")).withColumn("padding", F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

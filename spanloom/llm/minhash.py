"""MinHash near-dedup with sequential Bayesian verification.

1. One pass over the texts gives each document the size and a 128-bit
   fingerprint of its set of word shingles, and its MinHash signature.
2. Documents with equal sets form one class; only class representatives go on.
3. Signatures are banded. Inside a band's bucket, signature batches are compared
   one after another; a pair leaves as soon as the posterior probability that
   its similarity reaches the threshold falls below ``miss``. A bucket passes on
   the spanning forest of the surviving pairs, never all pairs, so what leaves
   it is no more than what entered.
4. The survivors' components are *candidate clusters*. Their members' full
   shingle sets are built again from the texts, and the links between them are
   confirmed exactly; a cluster passes on the spanning forest of its links.
5. The components of the confirmed links are the result.

Hot buckets and hot clusters are dealt out in pairs of blocks of about
``block`` members. No member, pair or bucket is capped.

Defined results: one row per input row. A null or empty text, or one without
words, has an empty set and links with nothing. Rows that repeat an id are one
node of the link graph. A row with a null id takes part in no link, but shares
the component of documents whose set equals its own; else its component is null
and it is kept. Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, held, need_columns, tidy
from .textbytes import WordHashes, byte_view, mix, shingle_hashes, slices


@dataclass(frozen=True)
class MinHashParams:
    """``percent``: link if 100 * intersection >= percent * union."""

    percent: int = 85
    width: int = 5
    bands: int = 20
    rows: int = 6
    batch: int = 20
    miss: float = 1e-4
    block: int = 512
    seed: int = 20240229

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def coefficients(p: MinHashParams) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return (
        rng.integers(1, 1 << 32, p.hashes, np.uint64).astype(np.uint32) | np.uint32(1),
        rng.integers(0, 1 << 32, p.hashes, np.uint64).astype(np.uint32),
    )


def least_matches(p: MinHashParams) -> list[tuple[int, int]]:
    """(hashes compared, matches needed) for every batch.

    With a uniform prior the similarity after m of n matches is Beta(m+1, n-m+1).
    A pair stays while P(similarity >= percent/100 | m of n) >= miss.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    high = grid >= p.percent / 100
    out = []
    for n in range(p.batch, p.hashes + p.batch, p.batch):
        n = min(n, p.hashes)
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[high].sum() / weight.sum() >= p.miss:
                out.append((n, m))
                break
        if n == p.hashes:
            break
    return out


def word_hashes() -> WordHashes:
    return held("words", None, WordHashes)


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, last in slices(column):
        data, at = byte_view(column[first:last])
        hashes, where = shingle_hashes(data, at, width, word_hashes())
        for i in range(last - first):
            one = hashes[where[i] : where[i + 1]]
            one.sort()
            yield one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one


def signatures(sets: list[np.ndarray], mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32) of non-empty sets, in cache-sized runs."""
    out = np.empty((len(sets), len(mul)), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (last == first or held + len(sets[last]) <= 1 << 15):
            held += len(sets[last])
            last += 1
        flat = (mix(np.concatenate(sets[first:last])) >> np.uint64(32)).astype(np.uint32)
        at = np.zeros(last - first, np.int64)
        np.cumsum([len(s) for s in sets[first : last - 1]], out=at[1:])
        room = np.empty_like(flat)
        for k in range(len(mul)):
            np.multiply(flat, mul[k], out=room)
            np.add(room, add[k], out=room)
            out[first:last, k] = np.minimum.reduceat(room, at)
        first = last
    return out


SKETCH = "doc bigint, n_shingles bigint, fp binary, sig binary"


def _sketcher(p: MinHashParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        mul, add = coefficients(p)
        for batch in batches:
            for first, last in slices(batch.column(1)):
                sets = list(text_sets(batch.column(1)[first:last], p.width))
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = signatures([sets[i] for i in full], mul, add)
                fp: list[bytes | None] = [None] * len(sets)
                sig: list[bytes | None] = [None] * len(sets)
                for row, i in zip(sigs, full, strict=True):
                    other = mix(sets[i] + np.uint64(0x51ED270B35AE8F2D))
                    fp[i] = np.array([sets[i].sum(), other.sum()], np.uint64).tobytes() + len(sets[i]).to_bytes(4, "little")
                    sig[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())],
                    names=["doc", "n_shingles", "fp", "sig"],
                )

    return run


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of each of n items' component, given links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    while (label != label[label]).any():
        label = label[label]
    return label


def surviving(sig: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, p: MinHashParams, needed) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows that survive the size bound and every signature batch."""
    fits = 100 * np.minimum(sizes[a], sizes[b]) >= p.percent * np.maximum(sizes[a], sizes[b])
    a, b = a[fits], b[fits]
    matched, done = np.zeros(len(a), np.int64), 0
    for n, m in needed:
        matched += (sig[a, done:n] == sig[b, done:n]).sum(1)
        stay = matched >= m
        a, b, matched, done = a[stay], b[stay], matched[stay], n
        if not len(a):
            break
    return a, b


def group_pairs(starts: np.ndarray, sizes: np.ndarray, splits: np.ndarray, most: int = 1 << 18):
    """All index pairs within each group, in runs of about ``most`` pairs.

    ``splits`` is 0 for a group that is one block; otherwise the number of rows
    of its first block, which are paired with those of the second only.
    """
    plain = splits == 0
    for size in np.unique(sizes[plain & (sizes > 1) & (sizes <= 64)]):
        i, j = np.triu_indices(size, 1)
        at = starts[plain & (sizes == size)]
        step = max(1, most // len(i))
        for s in range(0, len(at), step):
            base = at[s : s + step, None]
            yield (base + i).ravel(), (base + j).ravel()
    for g in np.flatnonzero((sizes > 64) | ~plain):
        first, size, split = int(starts[g]), int(sizes[g]), int(splits[g])
        rows = split or size
        step = max(1, most // size)
        for s in range(0, rows, step):
            i = np.arange(s, min(rows, s + step))
            j = np.arange(split, size)
            a, b = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = slice(None) if split else b > a
            yield a[keep] + first, b[keep] + first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the row at which each group starts, from
    batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        held = table.to_batches()
        starts = group_starts(table, keys)
        if len(starts) > 1:
            last = int(starts[-1])
            yield table.slice(0, last), starts[:-1]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


EDGES = "a bigint, b bigint"


def _edge_batch(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _group_shape(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, rows of the first block or 0) of groups with columns key, bi, bj, side, ..."""
    sizes = np.diff(np.append(starts, table.num_rows))
    two = (table.column("bi").to_numpy() != table.column("bj").to_numpy())[starts]
    firsts = np.add.reduceat((table.column("side").to_numpy() == 0).astype(np.int64), starts)
    lone = two & ((firsts == 0) | (firsts == sizes))
    return np.where(lone, 0, sizes), np.where(two & ~lone, firsts, 0)


def _bucket_pruner(p: MinHashParams):
    def run(batches):
        needed = least_matches(p)
        for table, starts in whole_groups(batches, 3):
            sizes, splits = _group_shape(table, starts)
            ids, n = table.column("doc").to_numpy(), table.column("n_shingles").to_numpy()
            raw = table.column("sig").combine_chunks().cast(pa.large_binary())
            sig = np.frombuffer(raw.buffers()[2], np.uint32, len(ids) * p.hashes, int(np.frombuffer(raw.buffers()[1], np.int64, 1, raw.offset * 8)[0])).reshape(-1, p.hashes)
            found = [surviving(sig, n, a, b, p, needed) for a, b in group_pairs(starts, sizes, splits)]
            a = np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)])
            b = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
            root = forest(a, b, len(ids))
            linked = np.flatnonzero(root != np.arange(len(ids)))
            yield _edge_batch(ids[linked], ids[root[linked]])

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def exact_links(sets: list[np.ndarray], split: int, p: MinHashParams) -> Iterator[tuple[int, int]]:
    """A spanning forest of the exact links among (or between two blocks of) sets.

    Intersections are counted through an inverted index of the block, one
    posting list per shingle, so members that share nothing cost nothing.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    key, owner = flat[order], owner[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.append(np.flatnonzero(new), len(key))
    # Posting list of each occurrence, back in the order of the sets.
    group = np.empty(len(flat), np.int64)
    group[order] = np.cumsum(new) - 1
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    union = _Union(n)
    for i in range(split if split else n):
        lists = group[bounds[i] : bounds[i + 1]]
        lo, hi = start[lists], start[lists + 1]
        span = hi - lo
        if int(span.sum()) == len(lists):
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(int(span.sum()))
        shared = np.bincount(owner[at], minlength=n)
        total = sizes + sizes[i] - shared
        ok = 100 * shared >= p.percent * total
        ok[: split if split else i + 1] = False
        for j in np.flatnonzero(ok):
            if union.join(i, int(j)):
                yield i, int(j)


def _cluster_linker(p: MinHashParams):
    def run(batches):
        for table, starts in whole_groups(batches, 3):
            sizes, splits = _group_shape(table, starts)
            ids, members = table.column("doc").to_numpy(), table.column("members").to_pylist()
            out_a, out_b = [], []
            for start, size, split in zip(starts.tolist(), sizes.tolist(), splits.tolist(), strict=True):
                if size > 1:
                    for i, j in exact_links([np.frombuffer(x, np.uint64) for x in members[start : start + size]], split, p):
                        out_a.append(ids[start + i])
                        out_b.append(ids[start + j])
            yield _edge_batch(out_a, out_b)

    return run


def _set_builder(width: int):
    def run(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for first, last in slices(batch.column(1)):
                sets = list(text_sets(batch.column(1)[first:last], width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "members"]
                )

    return run


def deal(df: DataFrame, p: MinHashParams) -> DataFrame:
    """Deal each group's members (``members_n`` of them) out to pairs of blocks.

    A member's block is a hash of its id; it goes to every pair of blocks that
    its own block is part of, so each two members meet at least once.
    """
    parts = F.ceil(F.col("members_n") / p.block).cast("int")
    block = F.when(parts <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc", F.lit("block")), parts).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda x: F.struct(
            F.least(x, F.col("block")).alias("bi"),
            F.greatest(x, F.col("block")).alias("bj"),
            F.when(F.col("block") <= x, 0).otherwise(1).alias("side"),
        ),
    )
    df = df.withColumn("parts", parts).withColumn("block", block).withColumn("pair", F.explode(pairs))
    return df.select("*", "pair.bi", "pair.bj", "pair.side").drop("pair", "block", "parts", "members_n")


def minhash_links(docs: DataFrame, p: MinHashParams, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sketches, fp and component of each class of equal sets)."""
    sketch = scratch.put(docs.mapInArrow(tidy(_sketcher(p), "words"), SKETCH))
    reps = scratch.put(
        sketch.where("n_shingles > 0 AND doc IS NOT NULL")
        .groupBy("fp")
        .agg(F.min("doc").alias("doc"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    )
    step = 4 * p.rows
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * step + 1, step)) for i in range(p.bands)])
    banded = reps.select("doc", F.explode(bands).alias("bucket"))
    counts = banded.groupBy("bucket").agg(F.count("*").alias("members_n")).where("members_n > 1")
    member = scratch.put(banded.join(counts, "bucket"))
    near = (
        deal(member.join(reps.drop("fp"), "doc"), p)
        .select("bucket", "bi", "bj", "side", "doc", "n_shingles", "sig")
        .repartition("bucket", "bi", "bj")
        .sortWithinPartitions("bucket", "bi", "bj", "side")
        .mapInArrow(tidy(_bucket_pruner(p)), EDGES)
    )
    clusters = components(near, scratch)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members_n"))
    wanted = scratch.put(
        clusters.join(sizes, "component").select(F.col("node").alias("doc"), F.col("component").alias("cluster"), "members_n")
    )
    scratch.drop(member, clusters)
    sets = scratch.put(docs.join(wanted.select("doc"), "doc").select("doc", "text").mapInArrow(tidy(_set_builder(p.width), "words"), "doc bigint, members binary"))
    links = (
        deal(wanted.join(sets, "doc"), p)
        .select("cluster", "bi", "bj", "side", "doc", "members")
        .repartition("cluster", "bi", "bj")
        .sortWithinPartitions("cluster", "bi", "bj", "side")
        .mapInArrow(tidy(_cluster_linker(p)), EDGES)
    )
    found = components(links, scratch)
    scratch.drop(sets, wanted)
    # Written, so that the join by fp has two shuffled sides and a class of very many copies is dealt to many tasks.
    root = scratch.put(reps.select("fp", "doc").join(found.withColumnRenamed("node", "doc"), "doc", "left").select("fp", F.coalesce("component", "doc").alias("component_id")))
    scratch.drop(reps, found)
    return sketch, root


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHashParams | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept (component_id = id)."""
    p = params or MinHashParams()
    need_columns(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sketch, root = minhash_links(source, p, scratch)
    rows = sketch.select("doc", "n_shingles", "fp")
    # Rows without a set would all meet in one task of the join.
    alone = rows.where("fp IS NULL").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    linked = rows.where("fp IS NOT NULL").join(root, "fp", "left").select("doc", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("doc").alias(id_col), "n_shingles", "component_id")
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
one AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
size AS (SELECT doc_id, len(s) AS n FROM sets),
met AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM one p JOIN one q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
half AS MATERIALIZED (
  SELECT a, b FROM met JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * met.n >= 85 * (p.n + q.n - met.n)),
link AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
small AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(small.b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(small.b, doc_id)) AS kept
FROM sets LEFT JOIN small ON small.a = doc_id
"""

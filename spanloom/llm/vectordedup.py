"""Embedding near-dedup by PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are scaled to length 1 and rotated onto principal axes, so the leading
coordinates carry as much as they can. Tiles of two blocks are compared leading
coordinates first: for unit vectors a, b split after k coordinates,

    cos(a, b) <= a[:k].b[:k] + |a[k:]| |b[k:]|

The first product is one over a tile; to the sums of pairs whose bound reaches
the threshold the next coordinates' products are added, and so on; those left at
the last are decided by the cosine of the original vectors in double precision.
Pairs leave a tile in runs of at most ``PAIRS``. The bound is exact for any
orthogonal axes, so these may be fitted to a bounded sample (``axes_sample``).

Equal vectors form one class with a weight, so copies never meet each other.
Blocks are ranges of the first principal coordinate (or parts of one that many
vectors share); two blocks meet only if their ranges are near enough
(|a1 - b1| <= sqrt(2 - 2 threshold)), and a task holds two blocks at a time. Vectors that point everywhere alike are within reach of every
block, so each is copied once for every ``BLOCK_ROWS`` vectors there are.
A task passes on, for each vector, the summed weight of its links, and the
spanning forest of the links: no pair list leaves it.

Defined results: one row per input row; null, zero, or ragged vectors and those
with null or non-finite components link with nothing; vectors of another length
than the first sampled one are compared among vectors of their own length only;
rows that repeat an id count as separate vectors and share its component; a row
with a null id links with nothing; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, hash_fraction, need_columns, tidy
from .minhash import EDGES, _edge_batch, forest, whole_groups

BLOCK_ROWS, TILE, PAIRS = 16384, 1024, 1 << 16
#: Small tables are cut into up to SPREAD blocks of LEAST_ROWS or more, so that all cores have work.
SPREAD, LEAST_ROWS = 8, 2048


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes (columns) of a sample, widest first; the identity for too few rows."""
    d = sample.shape[1]
    if len(sample) < 2:
        return np.eye(d)
    values, vectors = np.linalg.eigh(sample.T @ sample / len(sample))
    return vectors[:, np.argsort(-values, kind="stable")]


def prefixes(d: int) -> list[int]:
    """Lengths of the prefixes compared before the whole vectors."""
    return sorted({k for k in (d // 4, d // 2, 3 * d // 4) if 0 < k < d})


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """Index pairs of unit rows (rotated) whose bound reaches the threshold after every prefix."""
    margin = threshold - 1e-4  # single-precision products are off by far less
    d = a.shape[1]
    steps = prefixes(d) or [d]
    left, right = a.astype(np.float32), b.astype(np.float32)
    norms = lambda x: [np.sqrt(np.einsum("ij,ij->i", x[:, k:], x[:, k:])).astype(np.float32) for k in steps]
    rest_a, rest_b = norms(a), norms(b)
    first = steps[0]
    for s in range(0, len(a), TILE):
        for t in range(s if same else 0, len(b), TILE):
            product = left[s : s + TILE, :first] @ right[t : t + TILE, :first].T
            near = product + np.multiply.outer(rest_a[0][s : s + TILE], rest_b[0][t : t + TILE]) >= margin
            if same and s == t:
                near &= np.tri(*near.shape, -1, dtype=bool).T
            found = np.flatnonzero(near)
            for p in range(0, len(found), PAIRS):
                at = found[p : p + PAIRS]
                i, j = np.divmod(at, near.shape[1])
                total = product[i, j]
                i, j = i + s, j + t
                for n, (begin, end) in enumerate(zip(steps, steps[1:], strict=False), 1):
                    total = total + np.einsum("ij,ij->i", left[i, begin:end], right[j, begin:end])
                    keep = total + rest_a[n][i] * rest_b[n][j] >= margin
                    i, j, total = i[keep], j[keep], total[keep]
                    if not len(i):
                        break
                if len(i):
                    yield i, j


def _linker(threshold: float, axes: np.ndarray):
    def run(batches):
        for table, starts in whole_groups(batches, 2):
            for s, e in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                yield from block_links(table.slice(s, e - s).combine_chunks())

    def block_links(g: pa.Table):
        ids, weight, side = g.column("vec").to_numpy(), g.column("weight").to_numpy(), g.column("side").to_numpy()
        flat = g.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float64)
        x = flat.reshape(len(ids), -1)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        z = x / norm[:, None]
        if z.shape[1] == axes.shape[0]:
            z = z @ axes
        same = g.column("bi")[0].as_py() == g.column("bj")[0].as_py()
        split = 0 if same else int((side == 0).sum())
        if not same and split in (0, len(ids)):
            return
        la, lb = (z, z) if same else (z[:split], z[split:])
        links = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for i, j in tile_pairs(la, lb, threshold, same):
            j = j + split
            ok = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            new = forest(label[i], label[j], len(ids))
            label = new[label]
        hit = np.flatnonzero(links)
        root = _edge_batch(ids[hit], ids[label[hit]])
        yield pa.RecordBatch.from_arrays([*root.columns, pa.array(links[hit])], names=["a", "b", "links"])

    return run


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, axes_sample: int = 8192
) -> DataFrame:
    """One row per vector: id, n_links, component_id (smallest id reachable), kept."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1, not {threshold}")
    need_columns(vectors, id_col, vector_col)
    scratch = Scratch(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("embedding"))
    sound = F.coalesce(
        F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)
    )
    # -0.0 and 0.0 are the same component.
    clean = F.transform("embedding", lambda v: v + F.lit(0.0))
    good = source.where(sound & F.col("vec").isNotNull()).select("vec", clean.alias("embedding"))
    classes = scratch.put(good.groupBy("embedding").agg(F.min("vec").alias("rep"), F.count("*").alias("weight")))
    n = classes.count()
    sample = [r["embedding"] for r in hash_fraction(classes, F.col("rep"), axes_sample).select("embedding").limit(2 * axes_sample).collect()]
    widths = [len(v) for v in sample]
    width = max(set(widths), key=widths.count) if widths else 0
    unit = np.array([v for v in sample if len(v) == width]).reshape(-1, max(1, width))
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    axes = principal_axes(unit)
    blocks = max(1, -(-n // BLOCK_ROWS), min(SPREAD, -(-n // LEAST_ROWS)))
    lead = np.sort(unit @ axes[:, 0]) if len(unit) else np.zeros(1)
    edges = np.quantile(lead, np.arange(1, blocks) / blocks).tolist()
    axis = F.array(*[F.lit(float(v)) for v in axes[:, 0]])
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, p: s + p)
    first = dot(F.col("embedding"), axis) / F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    marks = F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>")
    below = lambda x: F.size(F.filter(marks, lambda m: m <= x))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    placed = classes.withColumn("first", F.when(F.size("embedding") == width, first).otherwise(F.lit(0.0)))
    placed = placed.withColumn("range", below(F.col("first")))
    # A range of one coordinate may hold far more than its share, if many vectors have the same: it becomes several blocks.
    held = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}
    most = min(BLOCK_ROWS, max(LEAST_ROWS, 2 * -(-n // blocks)))
    begin = [0, *accumulate(max(1, -(-held.get(b, 0) // most)) for b in range(blocks))]
    block_of = lambda r: F.element_at(F.array(*map(F.lit, begin)), r + 1)
    own = block_of(F.col("range"))
    placed = placed.withColumn("block", (own + F.pmod(F.xxhash64("rep"), block_of(F.col("range") + 1) - own)).cast("int"))
    # A vector meets the blocks of all ranges from its reach down to its reach up.
    near = F.transform(
        F.sequence(block_of(below(F.col("first") - reach)), block_of(below(F.col("first") + reach) + 1) - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("bi"), F.greatest(x, F.col("block")).alias("bj"), F.when(F.col("block") <= x, 0).otherwise(1).alias("side")),
    )
    blocks = begin[-1]
    narrow = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # as they came, half as wide
    carried = F.col("embedding").cast("array<float>") if narrow else F.col("embedding")
    dealt = placed.select("rep", "weight", carried.alias("embedding"), F.size("embedding").alias("d"), F.explode(near).alias("p"))
    dealt = dealt.select(
        (F.col("d") * F.lit(1 << 20) + F.col("p.bi")).alias("bi"), (F.col("d") * F.lit(1 << 20) + F.col("p.bj")).alias("bj"), F.col("p.side").alias("side"), F.col("rep").alias("vec"), "weight", "embedding"
    )
    tasks = max(1, blocks * (blocks + 1) // 2)
    found = scratch.put(
        dealt.repartition(min(tasks, 20_000), "bi", "bj").sortWithinPartitions("bi", "bj", "side").mapInArrow(tidy(_linker(threshold, axes)), EDGES + ", links bigint")
    )
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    same_id = good.groupBy("vec").agg(F.count("*").alias("n")).where("n > 1").select("vec")
    alike = good.join(same_id, "vec").join(classes, "embedding").select(F.col("vec").alias("a"), F.col("rep").alias("b"))
    labels = components(found.select("a", "b").union(alike), scratch)
    per_class = (
        classes.join(counts, "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    keyed = source.select("vec", F.when(sound & F.col("vec").isNotNull(), clean).alias("key"))
    out = keyed.join(per_class.withColumnRenamed("embedding", "key"), "key", "left")
    component = F.coalesce("component_id", "vec")
    return out.select(
        F.col("vec").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec")).alias("kept")
    )


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
small AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(small.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(small.b, vec_id)) AS kept
FROM embeddings LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN small ON small.a = vec_id
"""

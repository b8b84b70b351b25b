"""What the training-data operators share: the shared work folder, hold-out
remainders, bounded label samples and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..batches import give_back, small_batches
from ..workspace import delete_path, fresh_path

class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no rerun.

    Those that nothing reads any more are dropped; the rest, which a result still
    reads, go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = fresh_path(spark)
        self._n = 0
        small_batches(spark)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.base}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if table is not None and getattr(table, "_scratch_path", None):
                delete_path(self.spark, table._scratch_path)


_held: dict = {}


def held(kind: str, key, make: Callable):
    """What a Python worker keeps from task to task: one thing at a time, so that what
    one operator needs does not stay in memory beside what the next one needs."""
    if _held.get("key") != (kind, key):
        _held.clear()
        _held.update(value=make(), key=(kind, key))
    return _held["value"]


def tidy(run: Callable[[Iterator], Iterator], keeps: str | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, which first lets go of what a worker holds for other
    operators (all but ``keeps``) and in the end gives free memory back."""

    def tidied(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # what it frees, give_back can return
        if _held.get("key", (None,))[0] != keeps:
            _held.clear()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one, ``row``, beside which other names are free."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def map_whole(df: DataFrame, run: Callable[[Iterator], Iterator], more: tuple[StructField, ...] = ()) -> DataFrame:
    """``run`` over whole rows of ``df``, whatever its columns are called: there they are c0, c1, ..."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = [StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(df.schema.fields)]
    return plain.mapInArrow(tidy(run), StructType([*fields, *more])).toDF(*df.columns, *(f.name for f in more))


def hash_fraction(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of ``df`` (all, if it has fewer), chosen by a hash of ``key``.

    The choice depends on nothing but the keys and the row count, so a rerun
    after a lost executor finds the same rows.
    """
    n = df.count()
    if n <= bound:
        return df
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit("bounded sample")), F.lit(cells)) < int(cells * bound / n))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node
    of an edge, ``component`` being the smallest node of its component.

    Every round each node takes its smallest neighbour as parent (its own if none
    is smaller), pointer doubling goes on until every node points to its tree's
    root, which takes the logarithm of the longest chain, and the edges are
    rewritten between roots and made distinct, until none is left. All steps are
    joins and min-aggregates (which combine before the shuffle); neither an edge
    list nor a component is ever gathered in one task or on the driver.
    """
    work = scratch.put(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    both = work.select(F.col("a").alias("node")).union(work.select(F.col("b").alias("node")))
    labels = scratch.put(both.distinct().withColumn("component", F.col("node")))
    for _ in range(most_rounds):
        if work.isEmpty():
            break
        ends = work.select(F.col("a").alias("node"), F.col("b").alias("near")).union(
            work.select(F.col("b").alias("node"), F.col("b").alias("near"))
        )
        table = scratch.put(ends.groupBy("node").agg(F.min("near").alias("parent")))
        while True:
            parent = table.select("node", "parent")
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            shorter = scratch.put(parent.join(up, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")))
            scratch.drop(table)
            table = shorter
            if table.where("moved").isEmpty():
                break
        parent = table.select("node", "parent")
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        smaller = scratch.put(
            work.join(pa, "a")
            .join(pb, "b")
            .where("pa <> pb")
            .select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b"))
            .distinct()
        )
        relabelled = scratch.put(
            labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        )
        scratch.drop(work, labels, table)
        work, labels = smaller, relabelled
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    scratch.drop(work)
    return labels


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, bound: int, modulus: int, left_out: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[int, str, int]]:
    """(id, text, label) of about ``bound`` labelled training rows, sorted.

    The sample is drawn from the labels by a hash of the id, before any text is
    read, so its size is known and its ids may be broadcast; the corpus is
    scanned once and only chosen rows are shuffled. Rows with the held-out
    remainder, a null id or label, or (by maximum) repeated labels are settled
    here. Of rows that repeat a chosen id, one text is the sample, that of the
    least hash, however many they are.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.where(remainder("i", modulus) != left_out)
    chosen = hash_fraction(known, F.col("i"), bound).groupBy("i").agg(F.max("y").alias("y")).limit(2 * bound).collect()
    if not chosen:
        return []
    few = spark.createDataFrame([(r["i"], r["y"]) for r in chosen], "i bigint, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    one = texts.join(F.broadcast(few), "i").groupBy("i").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t", "y")).alias("s"))
    return sorted((r["i"], r["s"]["t"], r["s"]["y"]) for r in one.toLocalIterator())


def fit_logistic(x, y, ridge: float = 1e-2, steps: int = 50):
    """Weights (the last is the bias) of a ridge logistic regression, by Newton steps."""
    import numpy as np

    x = np.column_stack([np.asarray(x, float).reshape(len(y), -1), np.ones(len(y))])
    y = np.asarray(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w

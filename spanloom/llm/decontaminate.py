"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ``width`` consecutive words of a benchmark item (a shorter item is
one window). A document contains a window only if it contains its rarest word,
so with words ordered by their corpus frequency a prefix of one word is enough:

1. The distinct words of the benchmark are counted over all documents.
2. Each window is keyed by its rarest word and that word's place in it.
3. Each document word equal to a key proposes one start per place; starts whose
   window would not lie inside the document (length bound) or whose first and
   last words differ (positional bounds) are dropped.
4. What is left is verified word by word.

Candidates are proposed with full lower-casing (a superset, which neither makes
nor breaks words) and verified with A-Z lower-casing alone, as defined. Texts
are cut into blocks of words that overlap by a window, so that a candidate is
verified from the block it is found in and a long text costs no more a word than
a short one. Keys are broadcast only while their number is below
``broadcast_rows``; beyond it they are joined by shuffle and verified in a
second join by block.

A row is known by its id and the SHA-256 of its text: rows that share both have
the same hits, rows that share an id alone (or have none) have their own.

Defined results: a null text, or one without words, has no words and no hits; a
null or empty item has no windows; equal items count each by its own id; rows
that repeat, or whose id is null or repeated, are judged each by its own text;
extra columns are ignored (``drop_contaminated`` keeps them); an empty benchmark
hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need_columns, whole_row

#: Words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the A-Z lower-cased text; upper case is kept here and lowered later.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(joined: Column) -> Column:
    return F.translate(joined, UPPER, LOWER)


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """item, text of each window (words joined by a space), its number of words."""
    words = items.select("item", words_of(F.col("item_text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("w")).select(
        "item", lowered(F.array_join("w", " ")).alias("window"), F.size("w").alias("n")
    )


def window_keys(docs: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """window, n, key (its rarest word over all documents, fully lower-cased), place (from 0)."""
    distinct = windows.select("window", "n").distinct()
    placed = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("place", "word")).withColumn("word", F.lower("word"))
    vocabulary = placed.select("word").distinct()
    if vocabulary.count() <= broadcast_rows:
        vocabulary = F.broadcast(vocabulary)
    seen = docs.select(F.explode(words_of(F.lower("text"))).alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("seen"))
    ranked = placed.join(seen, "word", "left").groupBy("window", "n")
    rarest = ranked.agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "place")).alias("r"))
    return rarest.where("r.seen > 0").select("window", "n", F.col("r.word").alias("key"), F.col("r.place").alias("place"))


def text_blocks(docs: DataFrame, width: int, core: int = 64) -> DataFrame:
    """doc, digest, base, block: the words base - width + 1 .. base + core + width - 1 of each text, as far as it has them,
    joined by spaces; ``lead`` of them come before word ``base``."""
    around = width - 1
    words = docs.select("doc", "digest", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    block = lambda base: F.struct(
        base.alias("base"),
        F.least(base, F.lit(around)).alias("lead"),
        F.array_join(F.slice("words", F.greatest(base - around, F.lit(0)) + 1, F.least(base, F.lit(around)) + core + around), " ").alias("block"),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(core)), block)
    return words.select("doc", "digest", F.explode(blocks).alias("b")).select("doc", "digest", "b.base", "b.lead", "b.block")


def window_hits(docs: DataFrame, windows: DataFrame, scratch: Scratch, broadcast_rows: int, width: int, core: int = 64) -> DataFrame:
    """doc, digest, start (from 0), n, window: every occurrence of a window in a document."""
    keys = scratch.put(window_keys(docs, windows, broadcast_rows))
    starts = keys.groupBy("key").agg(F.collect_list(F.struct("place", "n", "window")).alias("ways"))
    few = keys.count() <= broadcast_rows
    blocks = text_blocks(docs, width, core)
    rows = ["doc", "digest", "base", "lead"] + ["block"] * few
    at = blocks.select(*rows, F.posexplode(F.split(F.lower("block"), " ")).alias("pos", "key"))
    # Of a block's words, those of its core are its own; the rest are those of the blocks beside it.
    at = at.where(f"pos >= lead AND pos < lead + {core}").join(F.broadcast(starts) if few else starts, "key")
    if not few:
        own = blocks.select(F.col("doc").alias("own"), F.col("digest").alias("own_digest"), F.col("base").alias("own_base"), "block")
        own = own.dropDuplicates(["own", "own_digest", "own_base"])
        at = at.join(own, F.col("doc").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")) & (F.col("base") == F.col("own_base")))
    at = at.select("doc", "digest", "base", "lead", "pos", "ways", F.split(lowered(F.col("block")), " ").alias("words"))
    fits = F.filter(
        "ways",
        lambda w: (F.col("pos") >= w["place"])
        & (F.col("pos") - w["place"] + w["n"] <= F.size("words"))
        & (F.array_join(F.slice("words", F.col("pos") - w["place"] + 1, w["n"]), " ") == w["window"]),
    )
    found = at.select("doc", "digest", "base", "lead", "pos", F.explode(fits).alias("w"))
    start = F.col("base") - F.col("lead") + F.col("pos") - F.col("w.place")
    return found.select("doc", "digest", start.alias("start"), F.col("w.n").alias("n"), F.col("w.window").alias("window"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"), *more)


def _windows(benchmark: DataFrame, item_col: str, item_text_col: str, width: int) -> DataFrame:
    need_columns(benchmark, item_col, item_text_col)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("item_text"))
    return windows_of(items, width).distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    need_columns(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    source = _keyed(docs, id_col, text_col)
    windows = scratch.put(_windows(benchmark, item_col, item_text_col, width))
    hits = scratch.put(window_hits(source, windows, scratch, broadcast_rows, width).distinct())
    spans = hits.groupBy("doc", "digest").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")),
        lambda acc: acc["n"].cast("long"),
    )
    per_item = hits.select("doc", "digest", "window").distinct().join(windows.select("window", "item"), "window").where("item IS NOT NULL")
    per_item = per_item.groupBy("doc", "digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_item = per_item.select(F.col("doc").alias("item_doc"), F.col("digest").alias("item_digest"), "items")
    sums = spans.select(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest"), covered.alias("n_hit"))
    sums = scratch.put(sums.join(per_item, F.col("hit_doc").eqNullSafe(F.col("item_doc")) & (F.col("hit_digest") == F.col("item_digest")), "left").drop("item_doc", "item_digest"))
    scratch.drop(hits, windows)
    out = source.select("doc", "digest", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = out.join(sums, F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("digest") == F.col("hit_digest")), "left")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 10,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """The rows of ``docs`` that hold no window."""
    need_columns(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    windows = scratch.put(_windows(benchmark, item_col, item_text_col, width))
    hits = window_hits(_keyed(docs, id_col, text_col), windows, scratch, broadcast_rows, width).select("doc", "digest").distinct()
    hits = scratch.put(hits.select(F.col("doc").alias("hit_doc"), F.col("digest").alias("hit_digest")))
    scratch.drop(windows)
    rows = _keyed(docs, id_col, text_col, whole_row(docs)).drop("text")
    few = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    return rows.join(few, F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("digest") == F.col("hit_digest")), "left_anti").select("row.*")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win ON p.win = win.win AND p.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

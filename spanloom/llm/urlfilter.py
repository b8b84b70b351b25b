"""URL filtering by rules and, where no rule fits, by mined token combinations.

Hand-written rules (host suffix, path prefix, verdict) label the pages they fit.
Of those URLs' token combinations, the ones that go with one verdict often and
surely enough (support, confidence) are rules for the rest. Single tokens are
counted; combinations of tokens that are no rule alone are mined by Spark's
FP-growth. Tokens that stand in the same labelled URLs throughout are one item
there, so a long URL, however often it comes, is a few items and not the set of
all its tokens' subsets; any of an item's tokens then stands for it in a rule.

Rules match through an inverted index: they are exploded by token and joined
with each distinct token set, and a rule applies where all its items were met.
DataFrame and Spark ML operations only.

Support is a share of the labelled pages and at least ``least`` of them: what
fewer pages show is no rule, so fewer than ``least`` labelled pages teach nothing.

Defined results: a null URL, or one without ``://``, has an empty host and path,
no rule and no tokens, and is allowed unless ``default`` says otherwise; repeated
rows are judged each; a token set that no mined rule matches gets ``default``; of
several the most confident counts, then the better supported, then block before
allow; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, need_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lowered, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(rules: tuple[UrlRule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Sorted distinct tokens: the host's labels, the path's segments that are not numbers."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.filter(F.split(path, r"[/.]"), lambda x: ~x.rlike(r"^[0-9]*$")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments), lambda x: F.length(x) > 2)))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, least: int, scratch: Scratch) -> DataFrame:
    """rule, n (its items), verdict, confidence, support, items (arrays of tokens that stand for each) of
    what the labelled pages (tokens, verdict) show."""
    baskets = scratch.put(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("w")).withColumn("basket", F.monotonically_increasing_id()))
    total = baskets.agg(F.sum("w")).first()[0] or 0
    needed = max(least, math.ceil(min_support * total))
    marks = lambda seed: F.bit_xor(F.xxhash64("basket", F.lit(seed)))
    split = baskets.select("basket", "verdict", "w", F.explode("tokens").alias("token"))
    by_verdict = split.groupBy("token", "verdict").agg(F.sum("w").alias("both"), marks(1).alias("m1"), marks(2).alias("m2"))
    every = Window.partitionBy("token")
    counted = scratch.put(by_verdict.withColumn("n", F.sum("both").over(every)).where(F.col("n") >= needed))
    confidence, support = F.col("both") / F.col("n"), F.col("both") / F.lit(float(max(total, 1)))
    telling = counted.where((F.col("both") >= needed) & (confidence >= min_confidence))
    alone = telling.select(F.array(F.array("token")).alias("items"), "verdict", confidence.alias("confidence"), support.alias("support"))
    # Tokens that are no rule alone, and which of them stand in the same baskets.
    unsure = counted.join(telling.select("token").distinct(), "token", "left_anti").groupBy("token").agg(F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2"), F.max("n").alias("n"))
    items = scratch.put(unsure.groupBy("m1", "m2", "n").agg(F.array_sort(F.collect_set("token")).alias("same")).select(F.col("same")[0].alias("item"), "same"))
    of_token = items.select("item", F.explode("same").alias("token"))
    several = split.join(of_token, "token").groupBy("basket", "verdict", "w").agg(F.collect_set("item").alias("items")).where("size(items) > 1")
    several = scratch.put(several.select(F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))), F.concat("items", F.array(F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items")).select("items"))
    n = several.count()
    if n < needed:
        return alone.withColumn("n", F.size("items")).withColumn("rule", F.xxhash64("items", "verdict"))
    model = FPGrowth(itemsCol="items", minSupport=(needed - 0.5) / n, minConfidence=min_confidence).fit(several)
    mined = model.associationRules.select("antecedent", F.col("consequent")[0].alias("to"), "confidence", F.round(F.col("support") * n).alias("both"))
    mined = mined.where(F.col("to").startswith("verdict:") & (F.size("antecedent") > 1) & ~F.exists("antecedent", lambda x: x.startswith("verdict:")))
    mined = mined.withColumn("number", F.monotonically_increasing_id())
    mined = scratch.put(mined.select("number", F.array_sort("antecedent").alias("antecedent"), F.substring("to", 9, 100).alias("verdict"), "confidence", (F.col("both") / F.lit(float(total))).alias("support")))
    together = (
        mined.withColumn("item", F.explode("antecedent"))
        .join(items, "item")
        .groupBy("number", "verdict", "confidence", "support")
        .agg(F.sort_array(F.collect_list("same")).alias("items"))
        .select("items", "verdict", "confidence", "support")
    )
    return alone.unionByName(together).withColumn("n", F.size("items")).withColumn("rule", F.xxhash64("items", "verdict"))


def match_rules(token_sets: DataFrame, rules: DataFrame, broadcast_rows: int) -> DataFrame:
    """tokens, verdict: the best rule of every token set that has one."""
    index = rules.select("rule", "verdict", "confidence", "support", "n", F.posexplode("items").alias("item", "same"))
    index = index.select("rule", "verdict", "confidence", "support", "n", "item", F.explode("same").alias("token"))
    if index.count() <= broadcast_rows:
        index = F.broadcast(index)
    met = token_sets.withColumn("token", F.explode("tokens")).join(index, "token")
    met = met.groupBy("tokens", "rule", "verdict", "confidence", "support", "n").agg(F.size(F.collect_set("item")).alias("met"))
    best = F.max(F.struct("confidence", "support", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), "verdict")).alias("best")
    return met.where("met = n").groupBy("tokens").agg(best).select("tokens", F.col("best.verdict").alias("mined"))


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[UrlRule, ...] = RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.9,
    least: int = 5,
    default: str = "allow",
    broadcast_rows: int = 50_000,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    need_columns(pages, id_col, url_col)
    scratch = Scratch(pages.sparkSession)
    host, path = url_parts(F.col(url_col).cast("string"))
    split = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    judged = scratch.put(split.select("page", "host", "path", rule.alias("rule"), verdict.alias("verdict"), url_tokens(F.col("host"), F.col("path")).alias("tokens")))
    mined = mine_rules(judged.where("verdict IS NOT NULL AND size(tokens) > 0").select("tokens", "verdict"), min_support, min_confidence, least, scratch)
    answers = scratch.put(match_rules(judged.where("verdict IS NULL").select("tokens").distinct(), scratch.put(mined), broadcast_rows))
    # One row a token set; sent along while few, so that pages of one token set need not meet in a task.
    answers = F.broadcast(answers) if answers.count() <= broadcast_rows else answers
    return judged.join(answers, "tokens", "left").select(
        F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(default)).alias("verdict")
    )


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Every combination of a page's unsure tokens is listed and counted, which its dozen tokens allow.
OP6_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_sort(list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x),
      list_transform(list_filter(regexp_split_to_array(path, '[/.]'), lambda x: NOT regexp_matches(x, '^[0-9]*$')), lambda x: 'p:' || x)), lambda x: length(x) > 2))) AS tokens FROM split),
judged AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM ruled),
labelled AS MATERIALIZED (SELECT row_number() OVER () AS id, tokens, verdict, count(*) AS w FROM judged WHERE verdict IS NOT NULL AND len(tokens) > 0 GROUP BY tokens, verdict),
size AS (SELECT sum(w) AS total, greatest(5, ceil(0.002 * sum(w))) AS needed FROM labelled),
token AS (SELECT t, verdict, sum(w) AS hits, sum(sum(w)) OVER (PARTITION BY t) AS n FROM (SELECT unnest(tokens) AS t, verdict, w FROM labelled) GROUP BY t, verdict),
telling AS MATERIALIZED (SELECT [t] AS items, verdict, hits / n AS confidence, hits / total AS support FROM token, size WHERE hits >= needed AND hits / n >= 0.9),
unsure AS (SELECT list(DISTINCT t) AS ts FROM token, size WHERE n >= needed AND t NOT IN (SELECT items[1] FROM telling)),
basket AS MATERIALIZED (SELECT id, verdict, w, list_filter(tokens, lambda x: list_contains(ts, x)) AS items FROM labelled, unsure),
part(id, last, items) AS (
  SELECT id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM basket
  UNION ALL
  SELECT id, j, list_append(items, b_items[j]) FROM (SELECT p.id, p.items, b.items AS b_items, unnest(range(p.last + 1, len(b.items) + 1)) AS j FROM part p JOIN basket b USING (id))),
several AS (SELECT p.items, b.verdict, sum(b.w) AS hits, sum(sum(b.w)) OVER (PARTITION BY p.items) AS n FROM part p JOIN basket b USING (id) WHERE len(p.items) > 1 GROUP BY p.items, b.verdict),
rules AS MATERIALIZED (SELECT * FROM telling UNION ALL SELECT items, verdict, hits / n, hits / total FROM several, size WHERE hits >= needed AND hits / n >= 0.9),
open AS (SELECT DISTINCT tokens FROM judged WHERE verdict IS NULL),
best AS (SELECT tokens, max(struct_pack(c := confidence, s := support, b := CAST(r.verdict = 'block' AS INT), v := r.verdict)).v AS mined FROM open JOIN rules r ON list_has_all(tokens, items) GROUP BY tokens)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, mined, 'allow') AS verdict FROM judged LEFT JOIN best USING (tokens)
"""

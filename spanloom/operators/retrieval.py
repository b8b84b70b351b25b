"""Retrieval over chunk tables as joins and aggregates: BM25, vectors, gold and recall.

A document's chunks are the scope of an index, as in the evaluation it serves:
every statistic is keyed by (strategy, id), so all joins and aggregates share
that partitioning. Ranks are by score rounded to 9 places, then by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import lean, small_batches
from ..functions.text import cosine, hashed_vector, retrieval_tokens


def term_frequencies(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, id, seq, term, tf."""
    terms = chunks.select("strategy", id_col, "seq", F.explode(retrieval_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("strategy", id_col, "seq", "term").agg(F.count("*").alias("tf"))


def chunk_lengths(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, id, seq, dl (tokens)."""
    return chunks.select("strategy", id_col, "seq", F.size(retrieval_tokens(F.col("text"))).alias("dl"))


def bm25_idf(tf: DataFrame, lengths: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, id, term, df, n_chunks, avg_len, idf."""
    shape = lengths.groupBy("strategy", id_col).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avg_len"))
    df = tf.groupBy("strategy", id_col, "term").agg(F.count("*").alias("df"))
    n, k = F.col("n_chunks"), F.col("df")
    return df.join(shape, ["strategy", id_col]).withColumn("idf", F.log((n - k + 0.5) / (k + 0.5) + 1))


def _top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy("strategy", id_col, "q_idx").orderBy(F.round("score", 9).desc(), "seq")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(chunks: DataFrame, questions: DataFrame, k: int = 3, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """strategy, id, q_idx, seq, score, rank of the best ``k`` chunks with a positive score."""
    asked = questions.select(id_col, "q_idx", F.explode(retrieval_tokens(F.col("q"))).alias("term"))
    asked = asked.groupBy(id_col, "q_idx", "term").agg(F.count("*").alias("times"))
    # A chunk is tokenised once. Its length goes with each of its terms that the document is asked about, and
    # with an empty one that every chunk has, so that counts over a document see all of its chunks.
    wanted = asked.select(id_col, "term").distinct().unionByName(asked.select(id_col).distinct().withColumn("term", F.lit("")))
    tokens = chunks.select("strategy", id_col, "seq", retrieval_tokens(F.col("text")).alias("tokens"))
    terms = tokens.select("strategy", id_col, "seq", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    tf = terms.join(wanted, [id_col, "term"], "left_semi").groupBy("strategy", id_col, "seq", "dl", "term").agg(F.count("*").alias("tf"))
    of_doc, of_term = Window.partitionBy("strategy", id_col), Window.partitionBy("strategy", id_col, "term")
    is_chunk = F.col("term") == ""
    tf = tf.withColumns({"n_chunks": F.count_if(is_chunk).over(of_doc), "avg_len": F.avg(F.when(is_chunk, F.col("dl"))).over(of_doc), "df": F.count("*").over(of_term)})
    hit = tf.where(~is_chunk).join(asked, [id_col, "term"])
    f, n, df = F.col("tf"), F.col("n_chunks"), F.col("df")
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
    part = F.col("times") * idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    scored = hit.groupBy("strategy", id_col, "q_idx", "seq").agg(F.sum(part).alias("score")).where("score > 0")
    return _top(scored, id_col, k)


def vector_topk(chunks: DataFrame, questions: DataFrame, k: int = 3, id_col: str = "doc_id", embed: Column | None = None, dim: int = 96) -> DataFrame:
    """As :func:`bm25_topk`, by cosine of hashed (or given) vectors of chunk and question."""
    vectors = chunks.select("strategy", id_col, "seq", hashed_vector(F.col("text"), dim).alias("v"))
    asked = questions.select(id_col, "q_idx", hashed_vector(F.col("q"), dim).alias("qv"))
    scored = asked.join(vectors, id_col).select("strategy", id_col, "q_idx", "seq", cosine(F.col("v"), F.col("qv")).alias("score"))
    return _top(scored.where("score > 0"), id_col, k)


#: Scores that are held at a time.
BLOCK_CELLS = 1 << 20


def _nearest(q_ids, q, ids, x, k: int, id_col: str, block_rows: int):
    """Record batch of the best ``k`` rows ``ids`` of each query, in the final order (score to 9 places, then id)."""
    import numpy as np
    import pyarrow as pa

    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny)
    q, x = unit(q), unit(x)
    out: list[list] = [[], [], [], []]
    # Several arrays of a block's scores stand at a time, so a block has few of them however many rows it meets.
    block_rows = max(1, min(block_rows, BLOCK_CELLS // max(1, len(ids))))
    for s in range(0, len(q_ids), block_rows):
        score = q[s : s + block_rows] @ x.T
        place = np.round(score, 9)
        place[q_ids[s : s + block_rows, None] == ids] = -np.inf
        # No row below the k-th greatest place is among the best; of those that tie with it the first are.
        least = np.partition(place, -k, axis=1)[:, -k] if k < place.shape[1] else np.full(len(place), -np.inf)
        for i in range(len(place)):
            row = np.flatnonzero(place[i] >= least[i])
            row = row[np.argsort(-place[i, row], kind="stable")][:k]
            row = row[place[i, row] > -np.inf]
            out[0] += [int(q_ids[s + i])] * len(row)
            out[1] += ids[row].tolist()
            out[2] += score[i, row].tolist()
            out[3] += place[i, row].tolist()
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["query_id", id_col, "score", "place"])


def _matrix(column):
    """Rows of a column of lists of one length."""
    import numpy as np

    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def embedding_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 2048, most_queries: int = 20_000) -> DataFrame:
    """query_id, id, score, rank: the ``k`` nearest rows of each query vector by cosine.

    Up to ``most_queries`` queries go to every task, and each Arrow batch of vectors
    meets them in blocks. More are dealt, as the vectors are, to the cells of a grid,
    so that a task holds one block of either. A batch or cell passes on its own best
    ``k`` per query in the final order (score to 9 places, then id), so what is
    shuffled is k rows per query and batch, and no smaller id of equal scores is lost.
    """
    import numpy as np

    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v"))
    schema = f"query_id bigint, {id_col} bigint, score double, place double"
    small_batches(vectors.sparkSession)
    n = q.count()
    if n <= most_queries:
        asked = q.collect()
        q_ids = np.array([r["query_id"] for r in asked], np.int64)
        q_rows = np.array([r["v"] for r in asked], float).reshape(len(asked), -1 if asked else 1)

        def run(batches):
            for batch in batches:
                if batch.num_rows and len(q_ids):
                    yield _nearest(q_ids, q_rows, batch.column(0).to_numpy(), _matrix(batch.column(1)), k, id_col, block_rows)

        near = v.mapInArrow(lean(run), schema)
    else:
        rows, columns = -(-n // most_queries), max(1, -(-v.count() // 50_000))
        cell = lambda df, key, own, other, a, b: df.withColumn(a, F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn(b, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        left = cell(q, "query_id", rows, columns, "_r", "_c").groupBy("_r", "_c")
        right = cell(v, id_col, columns, rows, "_c", "_r").groupBy("_r", "_c")

        def meet(a, b):
            import pyarrow as pa

            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), id_col: pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "place": pa.array([], pa.float64())})
            return pa.Table.from_batches([_nearest(a["query_id"].to_numpy(), _matrix(a["v"]), b[id_col].to_numpy(), _matrix(b["v"]), k, id_col, block_rows)])

        near = left.cogroup(right).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("place").desc(), id_col)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("place")


def gold_chunks(chunks: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, id, q_idx, seq of every chunk that holds the question's gold whole.

    A chunk is an exact slice, so it holds an occurrence iff its text does: an
    equi-join with a filter instead of a range join over occurrences.
    """
    pairs = questions.select(id_col, "q_idx", "gold").join(chunks.select("strategy", id_col, "seq", "text"), id_col)
    return pairs.where(F.contains("text", F.col("gold")) & (F.length("gold") > 0)).select("strategy", id_col, "q_idx", "seq")


def find_gold_chunk(chunks: DataFrame, questions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """strategy, id, q_idx, seq of the first chunk that holds the question's gold whole."""
    return gold_chunks(chunks, questions, id_col).groupBy("strategy", id_col, "q_idx").agg(F.min("seq").alias("seq"))


def question_facts(
    chunks: DataFrame, docs: DataFrame, questions: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", top: DataFrame | None = None, strategies: list[str] | None = None
) -> DataFrame:
    """Per strategy and question: strict, union, relevant (gold chunks among the top), q.

    A strategy none of whose chunks is found counts too; ``strategies`` names them,
    else a pass over the chunks finds out.
    """
    top = bm25_topk(chunks, questions, k, id_col) if top is None else top
    placed = questions.join(docs.select(id_col, F.col(text_col).alias("_t")), id_col).select(id_col, "q_idx", "q", "gold", (F.instr("_t", F.col("gold")) - 1).alias("pos"))
    # Whether a chunk holds the gold is asked of the best ones only.
    spans = top.select("strategy", id_col, "q_idx", "seq").join(chunks.select("strategy", id_col, "seq", "start", "end", F.col("text").alias("_chunk")), ["strategy", id_col, "seq"])
    if strategies is None:
        strategies = sorted(r["strategy"] for r in chunks.select("strategy").distinct().collect())
    asked = placed.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies)).cast("array<string>")))
    facts = asked.join(spans, ["strategy", id_col, "q_idx"], "left")
    g_end = F.col("pos") + F.length("gold")
    found = F.col("pos") >= 0
    return (
        facts.groupBy("strategy", id_col, "q_idx", "q")
        .agg(
            F.count_if(found & (F.length("gold") > 0) & F.contains("_chunk", F.col("gold"))).alias("relevant"),
            F.max(F.coalesce(found & (F.col("start") <= F.col("pos")) & (F.col("pos") < F.col("end")), F.lit(False))).alias("starts"),
            F.max(F.coalesce(found & (F.col("start") < g_end) & (g_end <= F.col("end")), F.lit(False))).alias("ends"),
        )
        .withColumn("strict", F.col("relevant") > 0)
        .withColumn("union", ~F.col("strict") & F.col("starts") & F.col("ends"))
        .drop("starts", "ends")
    )


def recall_at_k(facts: DataFrame, k: int) -> DataFrame:
    """strategy, total, strict_hits, union_hits, recall, precision, union_recall."""
    return facts.groupBy("strategy").agg(*recall_rates(k))


def recall_rates(k: int) -> list[Column]:
    """The aggregates of :func:`recall_at_k`."""
    total = F.greatest(F.lit(1), F.count("*"))
    strict, union = F.count_if("strict"), F.count_if("union")
    return [
        F.count("*").alias("total"), strict.alias("strict_hits"), union.alias("union_hits"), (strict / total).alias("recall"),
        (F.sum("relevant") / (total * k)).alias("precision"), ((strict + union) / total).alias("union_recall"),
    ]


def failures(facts: DataFrame, most: int = 8, id_col: str = "doc_id") -> DataFrame:
    """Up to ``most`` missed questions of each strategy, in order."""
    order = Window.partitionBy("strategy").orderBy(id_col, "q_idx")
    return facts.where("NOT strict AND NOT union").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("strategy", id_col, "q_idx", "q")


def parent_recall(parents: DataFrame, children: DataFrame, docs: DataFrame, questions: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, total, hits, recall: the first gold start lies in the parent of a top-k child."""
    top = bm25_topk(children, questions, k, id_col).select(id_col, "q_idx", "seq")
    linked = top.join(children.select(id_col, "seq", F.col("meta.parent_seq").alias("parent_seq")), [id_col, "seq"]).select(id_col, "q_idx", "parent_seq").distinct()
    spans = linked.join(parents.select(id_col, F.col("seq").alias("parent_seq"), "start", "end"), [id_col, "parent_seq"])
    placed = questions.join(docs.select(id_col, F.col(text_col).alias("_t")), id_col).select(id_col, "q_idx", (F.instr("_t", F.col("gold")) - 1).alias("pos"))
    hit = placed.join(spans, [id_col, "q_idx"]).where("pos >= 0 AND start <= pos AND pos < end").select(id_col, "q_idx").distinct()
    facts = placed.join(hit.withColumn("hit", F.lit(1)), [id_col, "q_idx"], "left")
    return facts.agg(F.lit(k).alias("k"), F.count("*").alias("total"), F.count("hit").alias("hits"), (F.count("hit") / F.greatest(F.lit(1), F.count("*"))).alias("recall"))

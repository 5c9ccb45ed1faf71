"""Reranking of kept hits by a pair scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rankforge.session import broadcast_if_small

# Hits scored and hits kept.
TOP_N = 20
TOP_K = 5
# ids of documents that a task is sent
NAMED = 1_000_000


def pair_table(hits: DataFrame, texts: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """``(qid, doc_id, score)``, each distinct pair scored once.

    ``texts`` has ``(qid, query)``, ``docs`` has ``(doc_id, text)``; only
    documents some hit names take part in the join; where these are few, the
    others are left out where they are read.
    """
    pairs = hits.select("qid", "doc_id").distinct()
    named = broadcast_if_small(pairs.select("doc_id").distinct(), NAMED)
    return (
        pairs.join(texts.select("qid", "query"), "qid")
        .join(docs.select("doc_id", "text").join(named, "doc_id", "left_semi"), "doc_id")
        .select("qid", "doc_id", F.round(scorer(F.col("query"), F.col("text")), 9).alias("score"))
    )


def rerank(hits: DataFrame, scores: DataFrame, k: int = TOP_K, keys=("config", "qid")) -> DataFrame:
    """Best ``k`` by new score; equals keep their old order, unscored come last."""
    joined = hits.select(*keys, "doc_id", F.col("rank").alias("old_rank")).join(scores, ["qid", "doc_id"], "left")
    w = W.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), "old_rank")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def no_rerank(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def scored_pairs(pairs: DataFrame, make_model: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 32) -> DataFrame:
    """``(qid, doc_id, score, error)`` of ``(qid, doc_id, query, text)`` pairs by a model made once per task.

    Pairs of a block go to the model in batches of like length, longest last,
    so little is padded. A batch that fails is tried pair by pair; a pair that
    fails is a row with its error and no score.
    """
    kinds = [pairs.schema[c] for c in ("qid", "doc_id")]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])

    def one(model, query, text):
        try:
            return float(model([query], [text])[0]), None
        except Exception as error:  # whatever a model raises is a row, not the job's end
            return None, f"{type(error).__name__}: {error}"

    def run(blocks):
        model = make_model()
        for block in blocks:
            block = block.iloc[block["text"].str.len().fillna(0).argsort(kind="stable")]
            scored = []
            for lo in range(0, len(block), batch):
                queries, texts = (block[c].iloc[lo : lo + batch].fillna("").tolist() for c in ("query", "text"))
                try:
                    scored += [(float(v), None) for v in model(queries, texts)]
                except Exception:
                    scored += [one(model, q, t) for q, t in zip(queries, texts)]
            out = block[["qid", "doc_id"]].assign(score=[v for v, _ in scored], error=[e for _, e in scored])
            yield out.astype({"score": "float64"})

    return pairs.select("qid", "doc_id", "query", "text").mapInPandas(run, schema)


def rerank_or_keep(hits: DataFrame, scores: DataFrame, k: int = TOP_K, keys=("qid",)) -> DataFrame:
    """Best ``k`` by new score; a question with a failed pair keeps its old order."""
    joined = hits.select(*keys, "doc_id", F.col("rank").alias("old_rank")).join(scores, ["qid", "doc_id"], "left")
    failed = F.max(F.col("score").isNull().cast("int")).over(W.partitionBy(*keys)) > 0
    joined = joined.withColumn("kept", failed).withColumn("value", F.when(~F.col("kept"), F.round("score", 9)))
    w = W.partitionBy(*keys).orderBy(F.col("value").desc_nulls_last(), "old_rank")
    return joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mmr(hits: DataFrame, vectors: DataFrame, k: int = TOP_K, lam: float = 0.5, keys=("qid",)) -> DataFrame:
    """``(*keys, doc_id, rank)``: maximal marginal relevance among the kept hits.

    ``hits`` has ``(*keys, doc_id, rank, score)``, few per key; ``vectors`` has
    ``(doc_id, vector)``. Each step takes the hit with the best
    ``lam * score - (1 - lam) * nearness to those taken`` (9 places, equals by
    prior rank). A key's hits are one array, so the choice is one fold in its
    row; a hit without a vector is near to none.
    """
    with_vector = hits.join(vectors.select("doc_id", "vector"), "doc_id", "left")
    hit = F.struct("rank", "doc_id", F.col("score").cast("double").alias("score"), "vector")
    lists = with_vector.groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("h"))

    def pick(s, _):
        value = lambda i: F.round(lam * F.get("h", i)["score"] - (1 - lam) * F.get(s["near"], i), 9)
        left = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: ~F.array_contains(s["taken"], i))
        best = F.array_min(F.transform(left, lambda i: F.struct((-value(i)).alias("v"), i.alias("i"))))["i"]
        return F.transform(
            F.array(best),
            lambda b: F.struct(
                F.concat(s["taken"], F.array(b)).alias("taken"),
                F.transform(
                    "h",
                    lambda x, i: F.when(F.size(s["taken"]) == 0, _cosine(x["vector"], F.get("h", b)["vector"])).otherwise(
                        F.greatest(F.get(s["near"], i), _cosine(x["vector"], F.get("h", b)["vector"]))
                    ),
                ).alias("near"),
            ),
        )[0]

    start = F.struct(
        F.array().cast("array<int>").alias("taken"), F.transform("h", lambda x: F.lit(0.0)).alias("near")
    )
    taken = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.size("h"))), start, pick, lambda s: s["taken"])
    chosen = lists.select(*keys, F.transform(taken, lambda i: F.get("h", i)["doc_id"]).alias("t"))
    return chosen.select(*keys, F.posexplode("t").alias("rank", "doc_id")).select(*keys, "doc_id", F.col("rank") + 1).toDF(
        *keys, "doc_id", "rank"
    )


def fuse_rerankers(hits: DataFrame, scores: dict[str, DataFrame], k: int = TOP_K, c: int = 60, keys=("config", "qid")) -> DataFrame:
    """Best ``k`` by reciprocal rank fusion of several rerankings of the same hits."""
    lists = None
    for name, table in scores.items():
        ranked = rerank(hits, table, TOP_N, keys).select(*keys, "doc_id", "old_rank", "rank")
        lists = ranked if lists is None else lists.unionByName(ranked)
    fused = lists.groupBy(*keys, "doc_id", "old_rank").agg(F.round(F.sum(1 / (c + F.col("rank"))), 12).alias("score"))
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), "old_rank")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

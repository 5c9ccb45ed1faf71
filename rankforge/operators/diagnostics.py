"""Diagnostics over retrieval runs of several systems.

Hits are long rows ``(system, qid, rank, file, page)``; questions are
``(qid, target_file, target_page, ...)``. A question meets at most one list
per system, so per-question work grows with the number of systems only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def judged(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits of known questions with ``match`` and ``file_match``."""
    same_file = F.col("file") == F.col("target_file")
    return hits.join(questions, "qid").select(
        "*",
        F.coalesce(same_file & (F.col("page") == F.col("target_page")), F.lit(False)).alias("match"),
        F.coalesce(same_file, F.lit(False)).alias("file_match"),
    )


def firsts(rows: DataFrame, keep=("domain", "context_type")) -> DataFrame:
    return rows.groupBy("system", "qid", *keep).agg(
        F.min(F.when(F.col("match"), F.col("rank"))).alias("first_page"),
        F.min(F.when(F.col("file_match"), F.col("rank"))).alias("first_file"),
    )


def failure_modes(rows: DataFrame, depth=5) -> DataFrame:
    """ok, page_miss, file_miss or rank_low per list, counted per system."""
    near = F.col("rank") <= depth
    flags = rows.groupBy("system", "qid").agg(
        F.bool_or(F.col("match") & near).alias("hit"),
        F.bool_or(F.col("file_match") & near).alias("near_file"),
        F.bool_or("file_match").alias("any_file"),
    )
    mode = (
        F.when(F.col("hit"), "ok")
        .when(F.col("near_file"), "page_miss")
        .when(~F.col("any_file"), "file_miss")
        .otherwise("rank_low")
    )
    counted = flags.groupBy("system", mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("system").agg(F.sum("n").alias("total"))
    return counted.join(total, "system").withColumn("pct", F.round(F.col("n") * 100 / F.col("total"), 1))


def consensus(rows: DataFrame) -> DataFrame:
    """Most frequent top-1 per question; a tie goes to the first system by name."""
    votes = (
        rows.where("rank = 1")
        .groupBy("qid", "domain", "context_type", "file", "page", "match")
        .agg(F.count(F.lit(1)).alias("vote"), F.min("system").alias("first_system"))
    )
    order = W.partitionBy("qid").orderBy(F.col("vote").desc(), "first_system")
    total = F.sum("vote").over(W.partitionBy("qid"))
    return votes.withColumn("n_systems", total).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "first_system")


def consensus_bins(best: DataFrame, strong: int, medium: int) -> DataFrame:
    """Share of right answers by how many systems agree."""
    size = F.when(F.col("vote") >= strong, "strong").when(F.col("vote") >= medium, "medium").otherwise("weak")
    return best.groupBy(size.alias("strength")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if("match") / F.count(F.lit(1))).alias("match_share")
    )


def difficulty(rows: DataFrame, systems: int, depth=5) -> DataFrame:
    """universal, hard or divergent by how many systems hit within ``depth``."""
    hits = (
        rows.groupBy("qid", "domain", "context_type", "system")
        .agg(F.bool_or(F.col("match") & (F.col("rank") <= depth)).alias("hit"))
        .groupBy("qid", "domain", "context_type")
        .agg(F.count_if("hit").alias("hit_count"))
    )
    cluster = (
        F.when(F.col("hit_count") >= systems - 3, "universal").when(F.col("hit_count") <= 2, "hard").otherwise("divergent")
    )
    return hits.withColumn("cluster", cluster)


def chunk_frequency(hits: DataFrame, n=30, depth=5) -> DataFrame:
    """Most retrieved (file, page) over all lists."""
    return (
        hits.where(F.col("rank") <= depth)
        .groupBy("file", "page")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "file", "page")
        .limit(n)
    )


def jaccard(hits: DataFrame, keys=("file", "page")) -> DataFrame:
    """Mean overlap of the result sets of every pair of systems.

    Both sets hold at most one list, so the pair join on ``qid`` makes
    systems x systems small rows per question.
    """
    sets = hits.groupBy("system", "qid").agg(F.collect_set(F.struct(*keys)).alias("s"))
    a = sets.select("qid", F.col("system").alias("system_a"), F.col("s").alias("sa"))
    b = sets.select("qid", F.col("system").alias("system_b"), F.col("s").alias("sb"))
    same = F.size(F.array_intersect("sa", "sb"))
    return (
        a.join(b, "qid")
        .where("system_a < system_b")
        .groupBy("system_a", "system_b")
        .agg(F.round(F.avg(same / F.size(F.array_union("sa", "sb"))), 9).alias("jaccard"), F.count(F.lit(1)).alias("n"))
    )


def jaccard_matrix(pairs: DataFrame, systems: list[str]) -> DataFrame:
    """Square symmetric form with ones on the diagonal."""
    spark = pairs.sparkSession
    both = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("system_a").alias("system"), F.col("system_b").alias("other"), "jaccard"),
                F.struct(F.col("system_b").alias("system"), F.col("system_a").alias("other"), "jaccard"),
            )
        ).alias("r")
    ).select("r.*")
    ones = spark.createDataFrame([(s, s, 1.0) for s in systems], "system string, other string, jaccard double")
    return both.unionByName(ones).groupBy("system").pivot("other", systems).agg(F.max("jaccard"))


def divergence(rows: DataFrame) -> DataFrame:
    """Per question: lists seen, distinct top-1 results, right top-1 results."""
    return (
        rows.where("rank = 1")
        .groupBy("qid", "domain", "context_type")
        .agg(
            F.count(F.lit(1)).alias("n_systems"),
            F.count_distinct(F.struct("file", "page")).alias("unique_top1"),
            F.count_if("match").alias("hit_count"),
        )
    )

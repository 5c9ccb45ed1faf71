"""Experiment grid: rewriting x retrieval x reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators.query_variants import GRID_STRATEGIES

# Axis levels.
RETRIEVERS = ["dense", "bm25_kiwi", "hybrid_7_3", "hybrid_5_5", "hybrid_3_7", "hybrid_ws_5_5"]
RERANKERS = [
    "no_rerank", "bge-reranker-v2-m3", "bge-reranker-v2-m3-ko", "ko-reranker",
    "bge-reranker-large", "qwen3-reranker-0.6b", "mxbai-rerank-base-v2", "jina-reranker-m0",
]
AXES = {"prer": GRID_STRATEGIES, "r": RETRIEVERS, "postr": RERANKERS}
BASELINE = {"prer": "baseline", "r": "hybrid_3_7", "postr": "bge-reranker-v2-m3-ko"}


def with_configs(df: DataFrame, axes=AXES) -> DataFrame:
    """Every row once per configuration, keyed ``prer__r__postr``."""
    for name, levels in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))
    return df.withColumn("config", F.concat_ws("__", *axes))


def axis_sweep(df: DataFrame, axes=AXES, base=BASELINE) -> DataFrame:
    """Configurations that differ from the base on one axis at most."""
    same = [F.when(F.col(a) == base[a], 1).otherwise(0) for a in axes]
    return df.where(sum(same[1:], same[0]) >= len(axes) - 1)


def influence(scores: DataFrame, value: str, axes=tuple(AXES)) -> DataFrame:
    """Per axis: mean of its best level less mean of its worst level."""
    levels = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("level")) for a in axes])
    means = (
        scores.select(F.explode(levels).alias("l"), value)
        .groupBy("l.axis", "l.level")
        .agg(F.avg(value).alias("m"))
    )
    return means.groupBy("axis").agg(
        F.count(F.lit(1)).alias("levels"),
        F.round(F.max("m"), 9).alias("best"),
        F.round(F.min("m"), 9).alias("worst"),
        F.round(F.max("m") - F.min("m"), 9).alias("influence"),
    )


def winners(scores: DataFrame, value: str, axis: str) -> DataFrame:
    """Best configuration per level of an axis; ties go by name."""
    order = F.struct((-F.col(value)).alias("v"), "config")
    return scores.groupBy(axis).agg(F.min_by(F.struct("config", value), order).alias("b")).select(axis, "b.*")


def with_accuracy(summary: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Accuracy joined to configurations, 0.0 where none was judged."""
    return summary.join(accuracy, "config", "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))

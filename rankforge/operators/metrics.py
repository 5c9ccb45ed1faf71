"""Ranking metrics over hits ``(system, qid, rank, ...)`` in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.text import target_page

CUTOFFS = (1, 3, 5, 10)


def strict_match(file="file", page="page", target_file="target_file", target_page_raw="target_page_raw") -> Column:
    """Same file and same page text; ``"12,13"`` matches neither 12 nor 13."""
    return (F.col(file) == F.col(target_file)) & (F.col(page).cast("string") == F.col(target_page_raw))


def lenient_match(file="file", page="page", target_file="target_file", target_page_raw="target_page_raw") -> Column:
    """Same file and leading page number; any page counts when there is none."""
    wanted = target_page(F.col(target_page_raw))
    return (F.col(file) == F.col(target_file)) & (wanted.isNull() | (F.col(page) == wanted))


def first_hits(hits: DataFrame, questions: DataFrame, match: Column, file_match: Column, keys=("system", "qid"), keep=()) -> DataFrame:
    """Rank of the first match per question; questions without any keep NULL.

    ``hits`` meet ``questions`` on ``qid``; hits of unknown questions drop out.
    """
    carried = [c for c in keep if c not in keys]
    return (
        hits.join(questions, "qid")
        .groupBy(*keys, *carried)
        .agg(
            F.min(F.when(match, F.col("rank"))).alias("first_page"),
            F.min(F.when(file_match, F.col("rank"))).alias("first_file"),
        )
    )


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def share(condition: Column) -> Column:
    """Mean of a condition, NULL counted as false."""
    return F.count_if(condition) / F.count(F.lit(1))


def metric_columns(cutoffs=CUTOFFS, page="first_page", file="first_file", extended=False) -> list[Column]:
    p, f = F.col(page), F.col(file)
    cols = [F.count(F.lit(1)).alias("total"), F.round(F.avg(reciprocal(p)), 9).alias("mrr")]
    cols += [share(p <= k).alias(f"page_hit_{k}") for k in cutoffs]
    cols += [share(f <= k).alias(f"file_hit_{k}") for k in cutoffs]
    if extended:
        gain = F.when(p <= 5, F.lit(1.0) / F.log2(p + 1)).otherwise(0.0)
        cols += [F.round(F.avg(gain), 9).alias("ndcg_5"), share(p.isNull()).alias("fail_rate")]
    return cols


def by_grouping_sets(firsts: DataFrame, system: str, groups: list[str], metrics: list[Column]) -> DataFrame:
    """Overall and per-group metrics of every system in one aggregation."""
    sets = [[F.col(system)]] + [[F.col(system), F.col(g)] for g in groups]
    return firsts.groupingSets(sets, F.col(system), *[F.col(g) for g in groups]).agg(
        F.grouping_id().cast("bigint").alias("level"), *metrics
    )

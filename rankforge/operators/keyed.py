"""One row per key, resume and merge joins.

Picks are ``max_by``/``min_by`` aggregates: tasks combine their rows first, so
a key with most of the rows shuffles one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys, choose) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(choose(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def keep_longest(df: DataFrame, keys, text: str, seq: str) -> DataFrame:
    """Longest text per key; of equals the earliest."""
    return _pick(df, keys, lambda r: F.max_by(r, F.struct(F.coalesce(F.length(text), F.lit(0)), -F.col(seq))))


def last_wins(df: DataFrame, keys, *seq: str) -> DataFrame:
    return _pick(df, keys, lambda r: F.max_by(r, F.struct(*seq)))


def first_wins(df: DataFrame, keys, *seq: str) -> DataFrame:
    return _pick(df, keys, lambda r: F.min_by(r, F.struct(*seq)))


def todo(items: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Items without a finished row."""
    return items.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fill_if_empty(first: DataFrame, second: DataFrame, keys, value: str) -> DataFrame:
    """Values of ``first``; blank or missing ones come from ``second``."""
    a = first.select(*keys, F.nullif(F.col(value), F.lit("")).alias("a"))
    b = second.select(*keys, F.nullif(F.col(value), F.lit("")).alias("b"))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("a", "b").alias(value))


def lookup_last(items: DataFrame, chunks: DataFrame, keys, order: str, value: str, default="") -> DataFrame:
    """Left lookup in which the last row of a key wins."""
    last = last_wins(chunks.select(*keys, order, value), keys, order).drop(order)
    return items.join(last, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def with_default(df: DataFrame, other: DataFrame, keys, value: str, default) -> DataFrame:
    return df.join(other.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of unlike tables; a missing column is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def mostly_done(answers: DataFrame, by, answer: Column, at_least: int) -> DataFrame:
    """Groups with enough non-empty answers to count as done."""
    return (
        answers.groupBy(*by)
        .agg(F.count_if(answer != "").alias("answered"))
        .withColumn("done", F.col("answered") >= at_least)
    )

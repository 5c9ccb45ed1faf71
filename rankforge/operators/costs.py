"""Tokens, money and latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Characters per token of the three estimates, prices per million
# tokens (input, output) and the price of an unlisted model.
CHARS_PER_TOKEN = 3.2
PRICES = {
    "openai/gpt-5.4-pro": (30.0, 180.0),
    "openai/gpt-5.4": (2.5, 15.0),
    "openai/gpt-5.4-mini": (0.75, 4.5),
    "openai/gpt-5.4-nano": (0.2, 1.25),
    "openai/gpt-5.3-chat": (1.75, 14.0),
    "anthropic/claude-opus-4.6": (5.0, 25.0),
    "anthropic/claude-sonnet-4.6": (3.0, 15.0),
    "google/gemini-3.1-pro-preview": (2.0, 12.0),
    "google/gemini-3.1-flash-lite-preview": (0.25, 1.5),
    "x-ai/grok-4.20": (2.0, 6.0),
    "cohere/command-a": (2.0, 10.0),
    "perplexity/sonar-reasoning-pro": (3.0, 15.0),
    "qwen/qwen3.6-plus": (0.33, 1.95),
    "qwen/qwen3.5-flash": (0.065, 0.26),
    "qwen/qwen3-max-thinking": (0.78, 3.9),
    "z-ai/glm-5.1": (0.95, 3.15),
    "z-ai/glm-4.7": (0.39, 1.75),
    "minimax/minimax-m2.7": (0.3, 1.2),
    "moonshotai/kimi-k2.5": (0.38, 1.72),
    "nex-agi/deepseek-v3.1-nex-n1": (0.14, 0.5),
    "mistralai/mistral-small-2603": (0.15, 0.6),
    "nvidia/nemotron-3-super-120b-a12b": (0.1, 0.5),
    "upstage/solar-pro-3": (0.15, 0.6),
    "LGAI-EXAONE/K-EXAONE-236B-A23B": (0.2, 0.8),
    "Qwen/Qwen3-235B-A22B-Instruct-2507": (0.2, 0.8),
    "deepseek-ai/DeepSeek-V3.2": (0.5, 1.5),
    "meta-llama/Llama-3.3-70B-Instruct": (0.6, 0.6),
    "meta-llama/Llama-3.1-8B-Instruct": (0.1, 0.1),
}
DEFAULT_PRICE = (1.0, 5.0)


def tokens_average(text: Column) -> Column:
    return F.length(text) / F.lit(CHARS_PER_TOKEN)


def tokens_upper(text: Column) -> Column:
    """Whole tokens at 3.3 characters each, one added; none for no text."""
    return F.when(F.length(text) > 0, F.floor(F.length(text) / F.lit(3.3)) + 1).otherwise(0)


def tokens_quarter(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def priced(usage: DataFrame, prices: DataFrame, default=DEFAULT_PRICE) -> DataFrame:
    """``usage (model, tokens_in, tokens_out)`` with ``cost_usd``; unlisted models at the default."""
    known = usage.join(prices, "model", "left")
    cost = F.col("tokens_in") / 1e6 * F.coalesce("usd_in", F.lit(default[0])) + F.col("tokens_out") / 1e6 * F.coalesce(
        "usd_out", F.lit(default[1])
    )
    return known.withColumn("cost_usd", F.round(cost, 9)).drop("usd_in", "usd_out")


def usage_totals(rows: DataFrame, by) -> DataFrame:
    """Token sums, answered rows, and mean latency with and without zeros."""
    latency = F.col("latency_sec")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("answer"), F.lit("")) != "").alias("answered"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).cast("bigint").alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).cast("bigint").alias("tokens_out"),
        F.round(F.avg(F.nullif(latency, F.lit(0.0))), 9).alias("avg_latency_nonzero"),
        F.round(F.avg(F.coalesce(latency, F.lit(0.0))), 9).alias("avg_latency_all"),
    )


BINS = 4096


def exact_percentile(rows: DataFrame, value: str, by, share: float) -> DataFrame:
    """``(*by, percentile)``: interpolated, exact, no task holding a group's values.

    Values are counted in bins between the group's ends; only the one or two
    bins that hold the wanted places are counted by value.
    """
    x = F.col(value).cast("double").alias("x")
    x = rows.select(*by, x).where("x IS NOT NULL")
    ends = x.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    place = F.lit(share) * (F.col("n") - 1)
    ends = ends.withColumns({"first": F.floor(place), "last": F.ceil(place), "part": place - F.floor(place)})
    part = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    binned = x.join(ends, list(by)).withColumn("bin", F.floor(part * BINS).cast("int"))

    def reached(counted, order):
        upto = F.sum("m").over(W.partitionBy(*by).orderBy(order))
        return counted.withColumn("after", upto).withColumn("before", F.col("after") - F.col("m"))

    bins = reached(binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("m"), *[F.first(c).alias(c) for c in ("first", "last")]), "bin")
    wanted = bins.where((F.col("before") <= F.col("last")) & (F.col("after") > F.col("first"))).select(*by, "bin", F.col("before").alias("skip"))
    values = (
        binned.join(wanted, [*by, "bin"])
        .groupBy(*by, "x")
        .agg(F.count(F.lit(1)).alias("m"), F.min("skip").alias("skip"), *[F.first(c).alias(c) for c in ("first", "last", "part")])
    )
    least = F.min("skip").over(W.partitionBy(*by))
    placed = reached(values, "x").withColumn("skip", least)
    at = lambda c: F.min(F.when((F.col("skip") + F.col("before") <= F.col(c)) & (F.col("skip") + F.col("after") > F.col(c)), F.col("x")))
    return placed.groupBy(*by).agg((at("first") + (at("last") - at("first")) * F.first("part")).alias("percentile"))


def latency_stats(rows: DataFrame, ms: str, by) -> DataFrame:
    """Mean, exact 95th percentile and queries per second of summed time."""
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(ms), 9).alias("mean_ms"),
        F.round(F.try_divide(F.count(F.lit(1)), F.sum(ms) / 1000), 6).alias("qps"),
    )
    p95 = exact_percentile(rows, ms, by, 0.95).select(*by, F.round("percentile", 9).alias("p95_ms"))
    return sums.join(p95, list(by), "left").select(*by, "n", "mean_ms", "p95_ms", "qps")

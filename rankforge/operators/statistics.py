"""Statistics over accuracies and cells of candidates and judges.

Tables of candidates and judges are as long as the model list, so their
windows may sit in one task; everything per question is aggregated before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankforge.functions.names import candidate_family, judge_family, parameter_billions
from rankforge.functions.stats import binomial_quantile, overlap, uniform, wilson

# Resamples and seed.
RESAMPLES = 10_000
SEED = 20260519


def cell_accuracy(cells: DataFrame, by) -> DataFrame:
    """Share of O over all cells, an unjudged cell counted as not O."""
    return cells.groupBy(*by).agg(
        F.count_if(F.col("ox") == "O").alias("o"), F.count(F.lit(1)).alias("n")
    ).withColumn("acc", F.col("o") / F.col("n"))


def ranked(acc: DataFrame, name="rank", by=("acc",)) -> DataFrame:
    """1-based rank by accuracy, ties by candidate name."""
    order = [F.col(c).desc() for c in by] + [F.col("cand")]
    return acc.withColumn(name, F.row_number().over(W.orderBy(*order)))


def with_interval(acc: DataFrame) -> DataFrame:
    lo, hi = wilson(F.col("o"), F.col("n"))
    return acc.withColumn("ci_low", F.round(lo, 9)).withColumn("ci_high", F.round(hi, 9))


def against_benchmark(acc: DataFrame, benchmark: str) -> DataFrame:
    """Gap to one candidate in points and whether the intervals overlap."""
    table = with_interval(acc)
    mark = table.where(F.col("cand") == benchmark).agg(
        F.first(F.struct("acc", "ci_low", "ci_high"))
    ).scalar()
    return table.withColumn("gap_pp", F.round((F.col("acc") - mark["acc"]) * 100, 9)).withColumn(
        "ci_overlap", overlap(F.col("ci_low"), F.col("ci_high"), mark["ci_low"], mark["ci_high"])
    )


def loo_rank_change(loo: DataFrame, base: DataFrame) -> DataFrame:
    """Rank without each judge minus the dense rank with all of them."""
    w = W.partitionBy("removed_judge").orderBy(F.col("acc").desc(), F.col("cand"))
    start = base.select("cand", F.dense_rank().over(W.orderBy("rank")).alias("base_rank"))
    return (
        loo.join(start, "cand")
        .withColumn("rank_removed", F.row_number().over(w))
        .withColumn("rank_change", F.col("rank_removed") - F.col("base_rank"))
    )


def leniency(cells: DataFrame) -> DataFrame:
    return cell_accuracy(cells, ["judge"]).withColumn("family", judge_family(F.col("judge")))


def family_leniency(judges: DataFrame) -> DataFrame:
    return judges.groupBy("family").agg(
        F.round(F.avg("acc"), 9).alias("mean_acc"), F.count(F.lit(1)).alias("n_judges")
    )


def spread(acc: DataFrame, by: str) -> DataFrame:
    """Mean, sample deviation, least and most accuracy per ``by``."""
    return acc.groupBy(by).agg(
        F.round(F.avg("acc"), 9).alias("mean_acc"),
        F.round(F.stddev_samp("acc"), 9).alias("std_acc"),
        F.min("acc").alias("min_acc"),
        F.max("acc").alias("max_acc"),
    )


def family_stats(acc: DataFrame, group: str) -> DataFrame:
    return (
        acc.withColumn("family", candidate_family(F.col("cand")))
        .groupBy(group, "family")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg("acc"), 9).alias("mean_acc"),
            F.max("acc").alias("max_acc"),
            F.round(F.stddev_samp("acc"), 9).alias("std_acc"),
        )
    )


def top_domain_rank(cells: DataFrame, questions: DataFrame, n=3) -> DataFrame:
    """Accuracy and rank within the ``n`` domains with most questions."""
    top = questions.groupBy("domain").count().orderBy(F.col("count").desc(), "domain").limit(n).select("domain")
    acc = cell_accuracy(cells.join(F.broadcast(top), "domain", "left_semi"), ["cand"])
    return ranked(acc, "top_domain_rank")


def correlation(x, y):
    """Pearson correlation, NULL where a side is constant."""
    return F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 9)


def trend(points: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and Pearson correlation."""
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.regr_slope(y, x), 9).alias("slope"),
        F.round(F.regr_intercept(y, x), 9).alias("intercept"),
        correlation(x, y).alias("pearson"),
    )


def spearman(acc: DataFrame) -> DataFrame:
    """Rank correlation of every judge pair over the candidates both judged."""
    a = acc.select("cand", F.col("judge").alias("judge_a"), F.col("acc").alias("a"))
    b = acc.select("cand", F.col("judge").alias("judge_b"), F.col("acc").alias("b"))
    pairs = a.join(b, "cand")
    key = ["judge_a", "judge_b"]

    def mean_rank(c):
        ties = F.count(F.lit(1)).over(W.partitionBy(*key, c))
        return F.rank().over(W.partitionBy(*key).orderBy(c)) + (ties - 1) / F.lit(2.0)

    ranks = pairs.select(*key, mean_rank("a").alias("ra"), mean_rank("b").alias("rb"))
    return ranks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), correlation("ra", "rb").alias("rho"))


def off_diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.where("judge_a < judge_b").agg(
        F.round(F.percentile("rho", F.lit(0.5)), 9).alias("median_rho"),
        F.min("rho").alias("min_rho"),
        F.max("rho").alias("max_rho"),
    )


def pareto(acc: DataFrame) -> DataFrame:
    """Candidates better than every smaller one."""
    sized = acc.withColumn("params_b", parameter_billions(F.col("cand"))).where("params_b IS NOT NULL")
    before = W.orderBy("params_b", "cand").rowsBetween(W.unboundedPreceding, -1)
    return (
        sized.withColumn("best_before", F.max("acc").over(before))
        .withColumn("on_frontier", F.col("best_before").isNull() | (F.col("acc") > F.col("best_before")))
        .withColumn("acc_per_b", F.round(F.col("acc") / F.col("params_b"), 9))
    )


def self_bias(acc: DataFrame) -> DataFrame:
    """Per judge family: its own candidates' mean rank by own and by other judges.

    ``acc`` has ``(cand, judge, acc)``. Also gives the accuracy own judges
    assign to their family less what the others assign.
    """
    scored = acc.withColumn("cf", candidate_family(F.col("cand"))).withColumn("jf", judge_family(F.col("judge")))
    families = scored.select(F.col("cf").alias("family")).distinct().join(
        scored.select(F.col("jf").alias("family")).distinct(), "family"
    )
    families = families.agg(F.collect_set("family")).scalar()
    own = F.col("jf") == F.col("family")
    per_cand = (
        scored.withColumn("family", F.explode(families))
        .groupBy("family", "cand", "cf")
        .agg(
            F.round(F.avg(F.when(own, F.col("acc"))), 9).alias("own"),
            F.round(F.avg(F.when(~own, F.col("acc"))), 9).alias("other"),
            F.count_distinct(F.when(own, F.col("judge"))).alias("n_own"),
        )
        .where("own IS NOT NULL AND other IS NOT NULL")
    )
    place = lambda c: F.rank().over(W.partitionBy("family").orderBy(F.col(c).desc()))
    return (
        per_cand.withColumn("own_rank", place("own"))
        .withColumn("other_rank", place("other"))
        .withColumn("n_family_judges", F.max("n_own").over(W.partitionBy("family")))
        .where("cf = family")
        .groupBy("family", "n_family_judges")
        .agg(
            F.count(F.lit(1)).alias("n_family_candidates"),
            F.round(F.avg("own_rank"), 9).alias("own_judge_mean_rank"),
            F.round(F.avg("other_rank"), 9).alias("other_judge_mean_rank"),
            F.round(F.avg("other_rank") - F.avg("own_rank"), 9).alias("rank_delta"),
            F.round(F.avg("own") - F.avg("other"), 9).alias("acc_delta"),
        )
    )


def judge_agreement(cells: DataFrame) -> DataFrame:
    """Share of equal verdicts per judge pair over cells both have judged.

    Per question and candidate only the set of O-judges and X-judges matters;
    the few distinct sets are counted before any pair is formed.
    """
    sets = (
        cells.where("ox IS NOT NULL")
        .groupBy("qid", "cand")
        .agg(F.array_sort(F.collect_set(F.struct("judge", "ox"))).alias("votes"))
        .groupBy("votes")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = sets.select("votes", "n", F.explode("votes").alias("a")).select(
        F.col("a.judge").alias("judge_a"), F.col("a.ox").alias("ox_a"), "n", F.explode("votes").alias("b")
    )
    return (
        pairs.where("judge_a < b.judge")
        .groupBy("judge_a", F.col("b.judge").alias("judge_b"))
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.when(F.col("ox_a") == F.col("b.ox"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"),
        )
    )


def paired_gap(majority: DataFrame, a: str, b: str) -> DataFrame:
    """How often ``b`` wins, ties or loses against ``a`` question by question."""
    both = majority.where(F.col("cand").isin(a, b)).groupBy("qid").agg(
        F.max(F.when(F.col("cand") == a, (F.col("ox") == "O").cast("int"))).alias("a"),
        F.max(F.when(F.col("cand") == b, (F.col("ox") == "O").cast("int"))).alias("b"),
    )
    return both.where("a IS NOT NULL AND b IS NOT NULL").agg(
        F.count_if(F.col("b") > F.col("a")).alias("wins"),
        F.count_if(F.col("b") == F.col("a")).alias("ties"),
        F.count_if(F.col("b") < F.col("a")).alias("losses"),
    )


def bootstrap_gap(gap: DataFrame, resamples=RESAMPLES, seed=SEED) -> DataFrame:
    """Paired bootstrap of the accuracy gap from win, tie and loss counts.

    Drawing ``n`` questions with replacement makes the three counts
    multinomial: first how many draws are no tie, then how many of those are
    wins, each a binomial quantile at a number hashed from (seed, resample,
    draw). Any engine gets the same draws, and a resample costs steps like the
    root of the number of questions.
    """
    spark = gap.sparkSession
    counts = gap.agg(F.first(F.struct("wins", "ties", "losses"))).scalar()
    draws = spark.range(resamples).select(F.col("id").alias("b"), counts.alias("c")).select("b", "c.*")
    n, apart = F.col("wins") + F.col("ties") + F.col("losses"), F.col("wins") + F.col("losses")
    draw = lambda i: uniform(F.lit(seed), F.col("b"), F.lit(i))
    d = (
        draws.where("wins + ties + losses > 0")
        .withColumn("apart", binomial_quantile(draw(0), n, apart / n))
        .withColumn("won", binomial_quantile(draw(1), F.col("apart"), F.coalesce(F.try_divide(F.col("wins"), apart), F.lit(0.0))))
        .select(((2 * F.col("won") - F.col("apart")) / n).alias("diff"))
    )
    one_side = lambda cond: (F.count_if(cond) + 1) / F.lit(resamples + 1.0)
    observed = gap.agg(F.first((F.col("wins") - F.col("losses")) / (F.col("wins") + F.col("ties") + F.col("losses")))).scalar()
    out = d.agg(
        F.percentile("diff", F.lit(0.025)).alias("ci_low"),
        F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(one_side(F.col("diff") <= 0), one_side(F.col("diff") >= 0))).alias("p_value"),
    )
    return out.select(
        observed.alias("gap"), "ci_low", "ci_high", "p_value",
        ((F.col("p_value") < 0.05) & ~((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0))).alias("significant_95"),
        F.lit(resamples).cast("bigint").alias("resamples"),
    )

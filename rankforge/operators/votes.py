"""Vote algebra: metric scores to O/X cells, accuracies, boards, majorities.

Scores are long rows ``(qid, cand, judge, metric, score)``; cells are
``(qid, cand, judge, ox)``. Every step is an aggregate with map-side combine,
so a candidate or judge that owns most rows only adds to one counter per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankforge.functions.stats import wilson
from rankforge.session import materialize

# The judged metrics and the voting rule.
METRICS = ("similarity", "correctness", "completeness", "faithfulness")
THRESHOLD = 4
NEEDED = 2


def ox_cells(scores: DataFrame, threshold=THRESHOLD, needed=NEEDED, metrics=None, cell=("qid", "cand", "judge")) -> DataFrame:
    """O when at least ``needed`` metrics reach ``threshold``."""
    if metrics is not None:
        scores = scores.where(F.col("metric").isin(*metrics))
    return (
        scores.groupBy(*cell)
        .agg(F.count_if(F.col("score") >= threshold).alias("o_count"), F.count(F.lit(1)).alias("n_metrics"))
        .withColumn("ox", F.when(F.col("o_count") >= needed, "O").otherwise("X"))
    )


def with_missing_policy(cells: DataFrame, policy: str, n_metrics=len(METRICS)) -> DataFrame:
    """``complete`` leaves cells that lack a metric unjudged; ``zero`` keeps the vote."""
    if policy == "zero":
        return cells
    return cells.withColumn("ox", F.when(F.col("n_metrics") == n_metrics, F.col("ox")))


def empty_answer_votes(answers: DataFrame, scores: DataFrame) -> DataFrame:
    """Lowest score on every metric for empty answers, whatever the judge said."""
    return scores.join(answers, ["qid", "cand"]).withColumn(
        "score", F.when(F.col("answer") == "", F.lit(1)).otherwise(F.col("score"))
    )


def accuracy(cells: DataFrame, by=("cand", "judge"), total=None) -> DataFrame:
    """Accuracy over scored cells and over all questions, per group.

    ``acc_scored`` is NULL where nothing was scored; ``acc_total`` counts a
    missing question as wrong; ``total`` is the number of questions.
    """
    out = cells.groupBy(*by).agg(
        F.count_if(F.col("ox") == "O").alias("o"),
        F.count("ox").alias("scored"),
    )
    out = out.withColumn("acc_scored", F.col("o") / F.when(F.col("scored") > 0, F.col("scored")))
    return out if total is None else out.withColumn("acc_total", F.col("o") / total)


def broken_judges(acc: DataFrame, share=0.5) -> DataFrame:
    """Judges with zero accuracy on at least ``share`` of their candidates."""
    return (
        acc.groupBy("judge")
        .agg((F.count_if(F.col("acc_scored") == 0) / F.count(F.lit(1))).alias("zero_share"))
        .where(F.col("zero_share") >= share)
    )


def judged_by_all(acc: DataFrame) -> DataFrame:
    """Adds how many judges there are and how many judged each candidate."""
    everyone = acc.agg(F.count_distinct("judge")).scalar()
    mine = acc.groupBy("cand").agg(F.count_distinct("judge").alias("n_judges"))
    return acc.join(mine, "cand").withColumn("all_judges", everyone)


def leaderboard(acc: DataFrame) -> DataFrame:
    """Complete candidates by mean accuracy over all judges."""
    full = judged_by_all(acc).where(F.col("n_judges") == F.col("all_judges"))
    mean = full.groupBy("cand", "n_judges").agg(F.round(F.avg("acc_scored"), 9).alias("avg_acc"))
    return mean.withColumn("rank", F.row_number().over(W.orderBy(F.col("avg_acc").desc(), F.col("cand"))))


def partial_board(acc: DataFrame) -> DataFrame:
    """Accuracies of candidates that some judge has not finished."""
    return judged_by_all(acc).where(F.col("n_judges") < F.col("all_judges"))


def majority(cells: DataFrame, keys=("qid", "cand")) -> DataFrame:
    """O when more than half of the evaluated judges say O; a tie is X."""
    return (
        cells.groupBy(*keys)
        .agg(F.count_if(F.col("ox") == "O").alias("o"), F.count("ox").alias("evaluated"))
        .withColumn("ox", F.when(F.col("o") * 2 > F.col("evaluated"), "O").otherwise("X"))
    )


def leave_one_out(cells: DataFrame) -> DataFrame:
    """Majority accuracy ``(cand, removed_judge, acc)`` without each judge.

    A question's total minus the judge's own vote gives the rest, so cells are
    not copied once per removed judge: questions are counted by total and own
    vote, and the rule is applied to those few counts. Of the judges that saw
    the candidate all remaining ones count, an unjudged cell as not O.
    """
    own = cells.groupBy("qid", "cand", "judge").agg(F.count_if(F.col("ox") == "O").alias("own"))
    questions = own.groupBy("qid", "cand").agg(
        F.sum("own").alias("o"), F.collect_list(F.struct("judge", "own")).alias("votes")
    )
    # the entry without a judge counts the question itself
    whole = F.array(F.struct(F.lit(None).cast("string").alias("judge"), F.lit(0).cast("bigint").alias("own")))
    # candidates x judges x totals rows, written once and read several times
    counts = materialize(
        questions.select("cand", "o", F.explode(F.concat(whole, "votes")).alias("v"))
        .groupBy("cand", F.col("v.judge").alias("judge"), F.col("v.own").alias("own"), "o")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = counts.groupBy("cand").agg(F.count_distinct("judge").alias("seen"))
    counts = counts.join(seen, "cand")
    wins = lambda votes, voters: F.coalesce(F.sum(F.when(votes * 2 > voters, F.col("n"))), F.lit(0))
    o, fewer = F.col("o"), F.col("seen") - 1
    base = (
        counts.where("judge IS NULL")
        .groupBy("cand")
        .agg(wins(o, F.col("seen")).alias("all_wins"), wins(o, fewer).alias("kept_wins"), F.sum("n").alias("n"))
    )
    # questions where the judge has no cell keep their whole total
    swing = (
        counts.where("judge IS NOT NULL")
        .groupBy("cand", "judge")
        .agg((wins(o - F.col("own"), fewer) - wins(o, fewer)).alias("change"))
    )
    judges = counts.agg(F.collect_set("judge")).scalar()
    return (
        base.withColumn("judge", F.explode(judges))
        .join(swing, ["cand", "judge"], "left")
        .select(
            "cand",
            F.col("judge").alias("removed_judge"),
            (F.coalesce(F.col("kept_wins") + F.col("change"), F.col("all_wins")) / F.col("n")).alias("acc"),
        )
    )


def pool_accuracy(cells: DataFrame, pool="pool") -> DataFrame:
    """Mean of per-judge means and Wilson bounds over all cells of a pool."""
    per_judge = cells.groupBy(pool, "cand", "judge").agg(
        F.count_if(F.col("ox") == "O").alias("o"), F.count(F.lit(1)).alias("n")
    )
    merged = per_judge.groupBy(pool, "cand").agg(
        F.round(F.avg(F.col("o") / F.col("n")), 9).alias("macro_acc"),
        F.sum("o").alias("o"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_judges"),
    )
    lo, hi = wilson(F.col("o"), F.col("n"))
    return merged.withColumn("ci_low", F.round(lo, 9)).withColumn("ci_high", F.round(hi, 9))


def missing_pairs(cells: DataFrame, cands: list[str], judges: list[str]) -> DataFrame:
    """Expected ``(cand, judge)`` pairs without any cell."""
    one = cells.sparkSession.range(1)
    names = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    expected = one.select(names(cands).alias("cand")).withColumn("judge", names(judges))
    return expected.join(cells.select("cand", "judge").distinct(), ["cand", "judge"], "left_anti")


def judged_items(scores: DataFrame, questions: DataFrame, metrics=METRICS, threshold=THRESHOLD, needed=NEEDED) -> DataFrame:
    """Every question of every judged pair, votes as a map.

    A missing metric is 0; a question without any vote is X with all zeros.
    """
    pairs = scores.agg(F.collect_set(F.struct("cand", "judge"))).scalar()
    given = scores.groupBy("qid", "cand", "judge").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("given")
    )
    every = questions.select("qid", F.explode(pairs).alias("p")).select("qid", "p.cand", "p.judge")
    names = F.array(*[F.lit(m) for m in metrics])
    votes = F.map_from_arrays(names, F.transform(names, lambda m: F.coalesce(F.col("given")[m], F.lit(0))))
    o = F.size(F.map_filter("votes", lambda _, s: s >= threshold))
    return (
        every.join(given, ["qid", "cand", "judge"], "left")
        .select("qid", "cand", "judge", votes.alias("votes"), F.col("given").isNull().alias("missing"))
        .withColumn("o_count", o)
        .withColumn("result", F.when(o >= needed, "O").otherwise("X"))
    )


def judge_file_summary(items: DataFrame) -> DataFrame:
    """Header of a judge file: totals, scored questions, O and X, accuracy over all."""
    return items.groupBy("cand", "judge").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("missing")).alias("scored"),
        F.count_if(F.col("result") == "O").alias("o_count"),
        F.count_if(F.col("result") == "X").alias("x_count"),
        (F.count_if(F.col("result") == "O") / F.count(F.lit(1))).alias("accuracy"),
    )


def work_order(jobs: DataFrame, *prefix: str) -> DataFrame:
    """Jobs with an equal prompt prefix side by side, so its cache is hit.

    Ranges over all columns split a frequent prefix over several tasks.
    """
    parts = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return jobs.repartitionByRange(parts, *prefix, *[c for c in jobs.columns if c not in prefix]).sortWithinPartitions(*prefix)


def placed(ordered: DataFrame) -> DataFrame:
    """Adds each row's place in a range-partitioned, sorted table; only counts per part meet."""
    part = F.spark_partition_id()
    rows = materialize(ordered.withColumn("part", part).withColumn("nth", F.monotonically_increasing_id()))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("least"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", (before - F.col("least") + 1).alias("offset"))
    return rows.join(F.broadcast(offsets), "part").select(*ordered.columns, (F.col("nth") + F.col("offset")).alias("place"))


def subset(scores: DataFrame, **chosen: list[str] | None) -> DataFrame:
    """Rows of the chosen ``cands``, ``judges`` or ``metrics``; None keeps all."""
    for name, values in chosen.items():
        if values is not None:
            scores = scores.where(F.col(name.removesuffix("s")).isin(*values))
    return scores

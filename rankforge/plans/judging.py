"""O/X votes, accuracies, leaderboards and majorities."""

from pyspark.sql import functions as F

from rankforge.functions.names import open_by_list
from rankforge.operators import votes as V
from rankforge.plans.common import CANDIDATES, JUDGES, OPEN_CANDIDATES, VOTES_SQL, _list_sql, documents, question_attributes, votes
from rankforge.plans.registry import query
from rankforge.session import materialize

CELL = ("qid", "domain", "context_type", "cand", "judge")


def cells(spark, sf_dir, policy="complete"):
    return V.with_missing_policy(V.ox_cells(votes(spark, sf_dir), cell=CELL), policy)


def judge_accuracy(spark, sf_dir):
    return V.accuracy(cells(spark, sf_dir))


def consolidated(spark, sf_dir):
    return V.majority(cells(spark, sf_dir), ("qid", "domain", "context_type", "cand"))


def group_of(cand):
    return F.when(open_by_list(cand, OPEN_CANDIDATES), "Open").otherwise("Closed")


@query("ox_votes", f"WITH {VOTES_SQL} SELECT qid, cand, judge, o_count, n_metrics, ox FROM cells")
def ox_votes(spark, sf_dir):
    return cells(spark, sf_dir).select("qid", "cand", "judge", "o_count", "n_metrics", "ox")


@query(
    "ox_two_metric",
    f"""WITH {VOTES_SQL} SELECT cand, judge, count(*) FILTER (WHERE k >= 1) AS o, count(*) AS n
    FROM (SELECT qid, cand, judge, count(*) FILTER (WHERE score >= 4) AS k FROM votes
          WHERE metric IN ('similarity', 'correctness') GROUP BY ALL) GROUP BY ALL""",
)
def ox_two_metric(spark, sf_dir):
    return _counted(V.ox_cells(votes(spark, sf_dir), needed=1, metrics=("similarity", "correctness")))


@query(
    "ox_single",
    f"""WITH {VOTES_SQL} SELECT cand, judge, count(*) FILTER (WHERE score >= 4) AS o, count(*) AS n
    FROM votes WHERE metric = 'correctness' GROUP BY ALL""",
)
def ox_single(spark, sf_dir):
    return _counted(V.ox_cells(votes(spark, sf_dir), needed=1, metrics=("correctness",)))


def _counted(cell_rows):
    return cell_rows.groupBy("cand", "judge").agg(
        F.count_if(F.col("ox") == "O").alias("o"), F.count(F.lit(1)).alias("n")
    )


@query(
    "accuracy_scored",
    f"""WITH {VOTES_SQL} SELECT cand, judge, count(*) FILTER (WHERE o_count >= 2) AS o, count(*) AS scored,
    count(*) FILTER (WHERE o_count >= 2)::DOUBLE / count(*) AS acc_scored FROM cells GROUP BY ALL""",
)
def accuracy_scored(spark, sf_dir):
    """Missing metrics count as no vote; every cell is scored."""
    return V.accuracy(cells(spark, sf_dir, "zero"))


@query(
    "accuracy_total",
    f"""WITH {VOTES_SQL} SELECT cand, judge, o, scored, acc_scored,
    o::DOUBLE / (SELECT count(*) FROM documents) AS acc_total FROM acc""",
)
def accuracy_total(spark, sf_dir):
    """Over all questions, a missing one counted wrong."""
    total = documents(spark, sf_dir, "doc_id").agg(F.count(F.lit(1))).scalar()
    return V.accuracy(cells(spark, sf_dir), total=total)


@query("accuracy_complete", f"WITH {VOTES_SQL} SELECT cand, judge, o, scored, acc_scored FROM acc")
def accuracy_complete(spark, sf_dir):
    """Only cells with all four metrics are scored."""
    return judge_accuracy(spark, sf_dir)


@query(
    "judge_means",
    f"""WITH {VOTES_SQL}, z AS (SELECT cand, metric, CASE WHEN (ix + cand_ix + metric_ix) % 17 = 0 THEN 0 ELSE score END AS score FROM votes),
    per AS (SELECT cand, metric, round(avg(nullif(score, 0)), 9) AS mean_valid, round(avg(score), 9) AS mean_all,
      count(*) FILTER (WHERE score >= 4)::DOUBLE / count(*) AS high_share FROM z GROUP BY ALL)
    SELECT cand, metric, mean_valid, mean_all, high_share,
      round(avg(mean_all) OVER (PARTITION BY cand), 9) AS overall_mean FROM per""",
)
def judge_means(spark, sf_dir):
    """Metric means with and without unparsed zeros, their mean, and the share of 4s and 5s."""
    score = F.when((F.col("ix") + F.col("cand_ix") + F.col("metric_ix")) % 17 == 0, 0).otherwise(F.col("score"))
    per = (
        votes(spark, sf_dir)
        .withColumn("score", score)
        .groupBy("cand", "metric")
        .agg(
            F.round(F.avg(F.nullif(F.col("score"), F.lit(0))), 9).alias("mean_valid"),
            F.round(F.avg("score"), 9).alias("mean_all"),
            (F.count_if(F.col("score") >= 4) / F.count(F.lit(1))).alias("high_share"),
        )
    )
    # added as decimals: a mean half-way between two ninth places does not hang on the order of adding
    mean = F.avg(F.col("mean_all").cast("decimal(20,9)"))
    overall = per.groupBy("cand").agg(F.round(mean, 9).cast("double").alias("overall_mean"))
    return per.join(overall, "cand")


@query(
    "accuracy_by_group",
    f"""WITH {VOTES_SQL} SELECT cand, domain, context_type, count(*) FILTER (WHERE ox = 'O') AS o, count(*) AS total,
    count(*) FILTER (WHERE ox = 'O')::DOUBLE / count(*) AS accuracy
    FROM maj GROUP BY GROUPING SETS ((cand), (cand, domain), (cand, context_type))""",
)
def accuracy_by_group(spark, sf_dir):
    """Overall, by domain and by context type in one aggregation."""
    c, d, t = F.col("cand"), F.col("domain"), F.col("context_type")
    return (
        consolidated(spark, sf_dir)
        .groupingSets([[c], [c, d], [c, t]], c, d, t)
        .agg(F.count_if(F.col("ox") == "O").alias("o"), F.count(F.lit(1)).alias("total"))
        .withColumn("accuracy", F.col("o") / F.col("total"))
    )


BOARD_SQL = f"""{VOTES_SQL},
broken AS (SELECT judge, count(*) FILTER (WHERE acc_scored = 0)::DOUBLE / count(*) AS zero_share FROM acc
  GROUP BY judge HAVING zero_share >= 0.5),
kept AS (SELECT cand, judge, acc_scored FROM acc WHERE judge NOT IN (SELECT judge FROM broken)),
mine AS (SELECT cand, count(DISTINCT judge) AS n_judges, avg(acc_scored) AS m FROM kept GROUP BY cand),
alls AS (SELECT count(DISTINCT judge) AS all_judges FROM kept)"""


def kept_accuracy(spark, sf_dir):
    # a row per candidate and judge, written once: the boards read it several times
    acc = materialize(judge_accuracy(spark, sf_dir))
    return acc.join(F.broadcast(V.broken_judges(acc).select("judge")), "judge", "left_anti")


@query("broken_judges", f"WITH {BOARD_SQL} SELECT * FROM broken")
def broken_judges(spark, sf_dir):
    return V.broken_judges(judge_accuracy(spark, sf_dir))


@query(
    "leaderboard",
    f"""WITH {BOARD_SQL} SELECT cand, n_judges, round(m, 9) AS avg_acc,
    row_number() OVER (ORDER BY round(m, 9) DESC, cand) AS rank FROM mine, alls WHERE n_judges = all_judges""",
)
def leaderboard(spark, sf_dir):
    board = V.leaderboard(kept_accuracy(spark, sf_dir))
    return board.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "leaderboard_partial",
    f"""WITH {BOARD_SQL} SELECT cand, judge, acc_scored, n_judges, all_judges
    FROM kept JOIN mine USING (cand), alls WHERE n_judges < all_judges""",
)
def leaderboard_partial(spark, sf_dir):
    return V.partial_board(kept_accuracy(spark, sf_dir)).select("cand", "judge", "acc_scored", "n_judges", "all_judges")


@query("majority_consolidated", f"WITH {VOTES_SQL} SELECT qid, cand, o, evaluated, ox FROM maj")
def majority_consolidated(spark, sf_dir):
    return consolidated(spark, sf_dir).select("qid", "cand", "o", "evaluated", "ox")


@query(
    "judge_coverage",
    f"""WITH {VOTES_SQL} SELECT judge, count(*) AS cells, count(ox) AS evaluated,
    count(ox)::DOUBLE / count(*) AS coverage, count(*) FILTER (WHERE ox = 'O')::DOUBLE / nullif(count(ox), 0) AS accuracy
    FROM cells GROUP BY judge""",
)
def judge_coverage(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("judge").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("ox").alias("evaluated"),
        (F.count("ox") / F.count(F.lit(1))).alias("coverage"),
        F.try_divide(F.count_if(F.col("ox") == "O"), F.count("ox")).alias("accuracy"),
    )


@query(
    "empty_answer_votes",
    f"""WITH {VOTES_SQL} SELECT cand, count(*) AS n, sum(CASE WHEN ix % 11 = cand_ix THEN 1 ELSE score END)::BIGINT AS total_score
    FROM votes GROUP BY cand""",
)
def empty_answer_votes(spark, sf_dir):
    """Empty answers get the lowest score on every metric."""
    rows = votes(spark, sf_dir)
    answers = (
        rows.select("qid", "cand", "ix", "cand_ix")
        .distinct()
        .select("qid", "cand", F.when(F.col("ix") % 11 == F.col("cand_ix"), "").otherwise("text").alias("answer"))
    )
    return (
        V.empty_answer_votes(answers, rows)
        .groupBy("cand")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total_score"))
    )


@query(
    "missing_judges",
    f"""WITH {VOTES_SQL} SELECT cand, judge FROM (SELECT unnest({_list_sql(CANDIDATES)}) AS cand), (SELECT unnest({_list_sql(JUDGES)}) AS judge)
    WHERE (cand, judge) NOT IN (SELECT (cand, judge) FROM acc)""",
)
def missing_judges(spark, sf_dir):
    """Pairs of candidate and judge that no cell covers."""
    return V.missing_pairs(cells(spark, sf_dir), CANDIDATES, JUDGES)


# every 31st cell has no vote at all
GAPPY_SQL = f"""{VOTES_SQL},
kept AS (SELECT qid, cand, judge, metric, score FROM votes WHERE (ix + cand_ix) % 31 <> 0),
grid AS (SELECT q.qid, cand, judge FROM (SELECT printf('q%04d', doc_id) AS qid FROM documents) q, (SELECT DISTINCT cand, judge FROM kept)),
given AS (SELECT qid, cand, judge, count(*) FILTER (WHERE score >= 4) AS o, """ + ", ".join(
    f"max(score) FILTER (WHERE metric = '{m}') AS m{i}" for i, m in enumerate(V.METRICS)
) + """ FROM kept GROUP BY ALL),
items AS (SELECT g.*, coalesce(o, 0) AS o_count, CASE WHEN coalesce(o, 0) >= 2 THEN 'O' ELSE 'X' END AS result, o IS NULL AS missing,
  """ + " || ',' || ".join(f"'{m}=' || coalesce(m{i}, 0)" for i, m in enumerate(V.METRICS)) + """ AS votes
  FROM grid g LEFT JOIN given USING (qid, cand, judge))"""


def gappy_items(spark, sf_dir):
    kept = votes(spark, sf_dir).where((F.col("ix") + F.col("cand_ix")) % 31 != 0)
    return V.judged_items(kept, question_attributes(spark, sf_dir))


@query("judged_items", f"WITH {GAPPY_SQL} SELECT qid, cand, judge, votes, o_count::INT AS o_count, result, missing FROM items")
def judged_items(spark, sf_dir):
    """Vote maps of all questions, gaps filled with zeros."""
    shown = F.array_join(F.transform(F.map_entries("votes"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return gappy_items(spark, sf_dir).withColumn("votes", shown)


@query(
    "judge_file_summary",
    f"""WITH {GAPPY_SQL} SELECT cand, judge, count(*) AS total, count(*) FILTER (WHERE NOT missing) AS scored, count(*) FILTER (WHERE result = 'O') AS o_count,
    count(*) FILTER (WHERE result = 'X') AS x_count, count(*) FILTER (WHERE result = 'O')::DOUBLE / count(*) AS accuracy FROM items GROUP BY cand, judge""",
)
def judge_file_summary(spark, sf_dir):
    return V.judge_file_summary(gappy_items(spark, sf_dir))


@query(
    "judge_work_order",
    """SELECT printf('q%04d', doc_id) AS qid, m AS metric FROM documents, (SELECT unnest(['similarity', 'correctness', 'completeness', 'faithfulness']) AS m)""",
)
def judge_work_order(spark, sf_dir):
    """Judge calls laid out so that calls with the same prompt head follow each other."""
    calls = question_attributes(spark, sf_dir).select("qid", F.explode(F.array(*[F.lit(m) for m in V.METRICS])).alias("metric"))
    return V.work_order(calls, "qid", "metric")

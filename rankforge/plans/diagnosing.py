"""Metrics and diagnostics of the retrieval runs."""

from pyspark.sql import functions as F

from rankforge.operators import diagnostics as D
from rankforge.operators import metrics as M
from rankforge.plans.dense_search import metrics_sql
from rankforge.plans.registry import query
from rankforge.plans.runs import GOLD_SQL, JUDGED_SQL, RUNS_SQL, SYSTEMS, gold, qrels, runs

N = len(SYSTEMS)


def rows(spark, sf_dir):
    return D.judged(runs(spark, sf_dir), gold(spark, sf_dir))


def firsts(spark, sf_dir):
    return D.firsts(rows(spark, sf_dir))


@query("qrels", f"WITH {GOLD_SQL} SELECT qid, doc_id FROM qrels")
def qrels_query(spark, sf_dir):
    return qrels(spark, sf_dir)


@query("retrieval_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def retrieval_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query(
    "retrieval_metrics_strict",
    f"""WITH {JUDGED_SQL}, f AS (SELECT system, qid,
      min(rank) FILTER (WHERE file = target_file AND page::VARCHAR = target_page_raw) AS p,
      min(rank) FILTER (WHERE file = target_file) AS f FROM judged GROUP BY ALL)
    SELECT system, {metrics_sql('p', 'f')} FROM f GROUP BY system""",
)
def retrieval_metrics_strict(spark, sf_dir):
    """Pages compared as text, to depth 10."""
    first = M.first_hits(runs(spark, sf_dir), gold(spark, sf_dir), M.strict_match(), F.col("file") == F.col("target_file"))
    return first.groupBy("system").agg(*M.metric_columns())


@query(
    "retrieval_metrics_lenient",
    f"""WITH {JUDGED_SQL}, t AS (SELECT *, try_cast(trim(split_part(target_page_raw, ',', 1)) AS INT) AS tp FROM judged WHERE rank <= 5),
    f AS (SELECT system, qid, min(rank) FILTER (WHERE file = target_file AND (tp IS NULL OR page = tp)) AS p,
      min(rank) FILTER (WHERE file = target_file) AS f FROM t GROUP BY ALL)
    SELECT system, {metrics_sql('p', 'f', cutoffs=(1, 5))} FROM f GROUP BY system""",
)
def retrieval_metrics_lenient(spark, sf_dir):
    """Leading page number, any page of the file where there is none, to depth 5."""
    hits = runs(spark, sf_dir).where("rank <= 5")
    first = M.first_hits(hits, gold(spark, sf_dir), M.lenient_match(), F.col("file") == F.col("target_file"))
    return first.groupBy("system").agg(*M.metric_columns((1, 5)))


@query(
    "metrics_by_group",
    f"""WITH {JUDGED_SQL} SELECT system, domain, context_type, grouping(domain, context_type)::BIGINT AS level,
    {metrics_sql('first_page', 'first_file', extended=True)}
    FROM firsts GROUP BY GROUPING SETS ((system), (system, domain), (system, context_type))""",
)
def metrics_by_group(spark, sf_dir):
    return M.by_grouping_sets(firsts(spark, sf_dir), "system", ["domain", "context_type"], M.metric_columns(extended=True))


@query(
    "best_system",
    f"""WITH {JUDGED_SQL}, m AS (SELECT system, round(avg(coalesce(1.0::DOUBLE / first_page, 0)), 9) AS mrr FROM firsts GROUP BY system)
    SELECT system, mrr FROM m ORDER BY mrr DESC, system LIMIT 1""",
)
def best_system(spark, sf_dir):
    means = firsts(spark, sf_dir).groupBy("system").agg(*M.metric_columns(()))
    return means.select("system", "mrr").orderBy(F.col("mrr").desc(), "system").limit(1)


@query(
    "heatmap_mrr",
    f"""WITH {JUDGED_SQL} SELECT domain, """
    + ", ".join(
        f"round(avg(coalesce(1.0::DOUBLE / first_page, 0)) FILTER (WHERE system = '{s}'), 9) AS {s}" for s in SYSTEMS
    )
    + " FROM firsts GROUP BY domain",
)
def heatmap_mrr(spark, sf_dir):
    cell = F.round(F.avg(M.reciprocal(F.col("first_page"))), 9)
    return firsts(spark, sf_dir).groupBy("domain").pivot("system", SYSTEMS).agg(cell)


@query(
    "failure_modes",
    f"""WITH {JUDGED_SQL}, fl AS (SELECT system, qid, bool_or(match AND rank <= 5) AS hit, bool_or(file_match AND rank <= 5) AS nf,
      bool_or(file_match) AS af FROM judged GROUP BY ALL),
    c AS (SELECT system, CASE WHEN hit THEN 'ok' WHEN nf THEN 'page_miss' WHEN NOT af THEN 'file_miss' ELSE 'rank_low' END AS mode,
      count(*) AS n FROM fl GROUP BY ALL)
    SELECT system, mode, n, (sum(n) OVER (PARTITION BY system))::BIGINT AS total,
      round(n * 100::DOUBLE / sum(n) OVER (PARTITION BY system), 1) AS pct FROM c""",
)
def failure_modes(spark, sf_dir):
    return D.failure_modes(rows(spark, sf_dir))


CONSENSUS_SQL = f"""{JUDGED_SQL},
top1 AS (SELECT qid, domain, context_type, file, page, match, count(*) AS vote, min(system) AS fs FROM judged WHERE rank = 1 GROUP BY ALL),
best AS (SELECT *, (sum(vote) OVER (PARTITION BY qid))::BIGINT AS n_systems FROM top1
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY vote DESC, fs) = 1)"""


@query(
    "consensus_top1",
    f"WITH {CONSENSUS_SQL} SELECT qid, domain, context_type, file, page, match, vote, n_systems FROM best",
)
def consensus_top1(spark, sf_dir):
    return D.consensus(rows(spark, sf_dir))


@query(
    "consensus_agree_rate",
    f"WITH {CONSENSUS_SQL} SELECT count(*) FILTER (WHERE match)::DOUBLE / (SELECT count(*) FROM benchmark) AS agree_rate FROM best",
)
def consensus_agree_rate(spark, sf_dir):
    """Right consensus answers over all questions."""
    total = gold(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return D.consensus(rows(spark, sf_dir)).agg((F.count_if("match") / F.first(total)).alias("agree_rate"))


@query(
    "consensus_bins",
    f"""WITH {CONSENSUS_SQL} SELECT CASE WHEN vote >= 4 THEN 'strong' WHEN vote >= 3 THEN 'medium' ELSE 'weak' END AS strength,
    count(*) AS n, count(*) FILTER (WHERE match)::DOUBLE / count(*) AS match_share FROM best GROUP BY ALL""",
)
def consensus_bins(spark, sf_dir):
    return D.consensus_bins(D.consensus(rows(spark, sf_dir)), 4, 3)


DIFFICULTY_SQL = f"""{JUDGED_SQL},
hc AS (SELECT qid, domain, context_type, count(*) FILTER (WHERE hit) AS hit_count FROM (
  SELECT qid, domain, context_type, system, bool_or(match AND rank <= 5) AS hit FROM judged GROUP BY ALL) GROUP BY ALL),
dc AS (SELECT *, CASE WHEN hit_count >= {N} - 3 THEN 'universal' WHEN hit_count <= 2 THEN 'hard' ELSE 'divergent' END AS cluster FROM hc)"""


@query("difficulty_clusters", f"WITH {DIFFICULTY_SQL} SELECT * FROM dc")
def difficulty_clusters(spark, sf_dir):
    return D.difficulty(rows(spark, sf_dir), N)


@query(
    "hard_by_group",
    f"WITH {DIFFICULTY_SQL} SELECT domain, context_type, count(*) AS n FROM dc WHERE cluster = 'hard' GROUP BY ALL",
)
def hard_by_group(spark, sf_dir):
    hard = D.difficulty(rows(spark, sf_dir), N).where("cluster = 'hard'")
    return hard.groupBy("domain", "context_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "domain", "context_type")


@query(
    "chunk_frequency_top30",
    f"WITH {RUNS_SQL} SELECT file, page, count(*) AS n FROM runs WHERE rank <= 5 GROUP BY ALL ORDER BY n DESC, file, page LIMIT 30",
)
def chunk_frequency_top30(spark, sf_dir):
    return D.chunk_frequency(runs(spark, sf_dir))


JACCARD_SQL = f"""{RUNS_SQL},
sets AS (SELECT system, qid, list(DISTINCT page) AS s FROM runs GROUP BY ALL),
jac AS (SELECT a.system AS system_a, b.system AS system_b,
  round(avg(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s))), 9) AS jaccard, count(*) AS n
  FROM sets a JOIN sets b USING (qid) WHERE a.system < b.system GROUP BY ALL)"""


@query("jaccard_pairs", f"WITH {JACCARD_SQL} SELECT * FROM jac")
def jaccard_pairs(spark, sf_dir):
    return D.jaccard(runs(spark, sf_dir))


@query(
    "jaccard_extremes",
    f"""WITH {JACCARD_SQL} (SELECT 'high' AS side, system_a, system_b, jaccard FROM jac ORDER BY jaccard DESC, system_a, system_b LIMIT 10)
    UNION ALL (SELECT 'low', system_a, system_b, jaccard FROM jac ORDER BY jaccard, system_a, system_b LIMIT 10)""",
)
def jaccard_extremes(spark, sf_dir):
    """Most and least similar pairs of systems."""
    pairs = D.jaccard(runs(spark, sf_dir)).select("system_a", "system_b", "jaccard")
    side = lambda name, order: pairs.orderBy(order, "system_a", "system_b").limit(10).withColumn("side", F.lit(name))
    return side("high", F.col("jaccard").desc()).unionByName(side("low", F.col("jaccard").asc()))


@query(
    "jaccard_matrix",
    f"""WITH {JACCARD_SQL}, sq AS (SELECT system_a AS system, system_b AS other, jaccard FROM jac
      UNION ALL SELECT system_b, system_a, jaccard FROM jac UNION ALL SELECT DISTINCT system, system, 1.0::DOUBLE FROM runs)
    SELECT system, """
    + ", ".join(f"max(jaccard) FILTER (WHERE other = '{s}') AS {s}" for s in SYSTEMS)
    + " FROM sq GROUP BY system",
)
def jaccard_matrix(spark, sf_dir):
    return D.jaccard_matrix(D.jaccard(runs(spark, sf_dir)), SYSTEMS)


DIVERGENCE_SQL = f"""{JUDGED_SQL}, dv AS (SELECT qid, domain, context_type, count(*) AS n_systems,
  count(DISTINCT (file, page)) AS unique_top1, count(*) FILTER (WHERE match) AS hit_count FROM judged WHERE rank = 1 GROUP BY ALL)"""


@query("top1_divergence", f"WITH {DIVERGENCE_SQL} SELECT * FROM dv")
def top1_divergence(spark, sf_dir):
    return D.divergence(rows(spark, sf_dir))


@query(
    "divergence_hist",
    f"WITH {DIVERGENCE_SQL} SELECT unique_top1, hit_count, count(*) AS n FROM dv GROUP BY ALL",
)
def divergence_hist(spark, sf_dir):
    return D.divergence(rows(spark, sf_dir)).groupBy("unique_top1", "hit_count").agg(F.count(F.lit(1)).alias("n"))


@query(
    "divergence_by_group",
    f"""WITH {DIVERGENCE_SQL} SELECT domain, context_type, round(avg(unique_top1), 9) AS mean_unique, count(*) AS n
    FROM dv GROUP BY GROUPING SETS ((domain), (context_type))""",
)
def divergence_by_group(spark, sf_dir):
    d, c = F.col("domain"), F.col("context_type")
    return D.divergence(rows(spark, sf_dir)).groupingSets([[d], [c]], d, c).agg(
        F.round(F.avg("unique_top1"), 9).alias("mean_unique"), F.count(F.lit(1)).alias("n")
    )

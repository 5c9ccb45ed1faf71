"""Intervals, correlations, frontiers and bias over the vote table."""

from pyspark.sql import functions as F

from rankforge.functions.names import parameter_billions
from rankforge.operators import statistics as S
from rankforge.operators import votes as V
from rankforge.plans.common import OPEN_CANDIDATES, OPEN_JUDGES, VOTES_SQL, _in_sql, question_attributes
from rankforge.plans.judging import cells, consolidated, group_of
from rankforge.plans.registry import query

Z = S.wilson.__defaults__[0]
OPEN_SQL = _in_sql(OPEN_CANDIDATES)

CAND_FAMILY_SQL = """CASE WHEN {0} LIKE '%qwen%' THEN 'qwen' WHEN {0} LIKE '%gpt-oss%' OR {0} LIKE 'gpt-%' THEN 'gpt'
  WHEN {0} LIKE '%gemini%' THEN 'gemini' WHEN {0} LIKE '%mistral%' THEN 'mistral' WHEN {0} LIKE '%kimi%' THEN 'kimi'
  WHEN {0} LIKE '%deepseek%' THEN 'deepseek' WHEN {0} LIKE '%exaone%' THEN 'exaone' WHEN {0} LIKE '%phi%' THEN 'phi'
  WHEN {0} LIKE '%lfm%' THEN 'lfm' ELSE 'other' END"""
JUDGE_FAMILY_SQL = """CASE WHEN {0} LIKE '%qwen%' THEN 'qwen' WHEN {0} LIKE '%gpt%' THEN 'gpt'
  WHEN {0} LIKE '%gemini%' THEN 'gemini' WHEN {0} LIKE '%gemma%' THEN 'gemma'
  WHEN {0} LIKE '%nemotron%' THEN 'nemotron' ELSE 'other' END"""


def wilson_sql(k, n):
    p, z = f"({k}::DOUBLE / {n})", f"{Z}::DOUBLE"
    mid = f"({p} + {z} * {z} / (2 * {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n}::DOUBLE * {n})))"
    scale = f"(1 + {z} * {z} / {n})"
    return (
        f"round(greatest(({mid} - {half}) / {scale}, 0), 9) AS ci_low, "
        f"round(least(({mid} + {half}) / {scale}, 1), 9) AS ci_high"
    )


def cand_accuracy(spark, sf_dir):
    """Majority accuracy of every candidate with its group."""
    acc = S.cell_accuracy(consolidated(spark, sf_dir), ["cand"])
    return acc.withColumn("group", group_of(F.col("cand")))


def big(df, *names):
    for n in names:
        df = df.withColumn(n, F.col(n).cast("bigint"))
    return df


@query(
    "wilson_ci",
    f"""WITH {VOTES_SQL} SELECT cand, "group", o, n, acc, {wilson_sql('o', 'n')},
    row_number() OVER (ORDER BY acc DESC, cand) AS rank FROM cons""",
)
def wilson_ci(spark, sf_dir):
    return big(S.ranked(S.with_interval(cand_accuracy(spark, sf_dir))), "rank").select(
        "cand", "group", "o", "n", "acc", "ci_low", "ci_high", "rank"
    )


@query(
    "ci_overlap_vs_reference",
    f"""WITH {VOTES_SQL}, ci AS (SELECT cand, acc, {wilson_sql('o', 'n')} FROM cons)
    SELECT a.cand, a.acc, a.ci_low, a.ci_high, round((a.acc - b.acc) * 100, 9) AS gap_pp,
      greatest(a.ci_low, b.ci_low) <= least(a.ci_high, b.ci_high) AS ci_overlap
    FROM ci a, ci b WHERE b.cand = 'gpt-5.4'""",
)
def ci_overlap_vs_reference(spark, sf_dir):
    table = S.against_benchmark(cand_accuracy(spark, sf_dir), "gpt-5.4")
    return table.select("cand", "acc", "ci_low", "ci_high", "gap_pp", "ci_overlap")


def pool_of(judge):
    return F.when(judge.isin(*OPEN_JUDGES), "open").otherwise("closed")


POOLS_SQL = f"""{VOTES_SQL}, per AS (
  SELECT CASE WHEN judge IN {_in_sql(OPEN_JUDGES)} THEN 'open' ELSE 'closed' END AS pool, cand, judge, o, n FROM acc),
pools AS (SELECT pool, cand, round(avg(o::DOUBLE / n), 9) AS macro_acc, sum(o)::BIGINT AS o, sum(n)::BIGINT AS n,
  count(*) AS n_judges FROM per GROUP BY pool, cand)"""


@query("judge_pool_accuracy", f"WITH {POOLS_SQL} SELECT *, {wilson_sql('o', 'n')} FROM pools")
def judge_pool_accuracy(spark, sf_dir):
    return V.pool_accuracy(cells(spark, sf_dir).withColumn("pool", pool_of(F.col("judge"))))


@query(
    "trend_ols_pearson",
    f"""WITH {POOLS_SQL}, pts AS (
      SELECT cand, max(macro_acc) FILTER (WHERE pool = 'open') AS x, max(macro_acc) FILTER (WHERE pool = 'closed') AS y
      FROM pools GROUP BY cand)
    SELECT count(*) AS n, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept,
      round(corr(x, y), 9) AS pearson FROM pts""",
)
def trend_ols_pearson(spark, sf_dir):
    """Closed-pool accuracy against open-pool accuracy."""
    pick = lambda p: F.max(F.when(F.col("pool") == p, F.col("macro_acc")))
    points = judge_pool_accuracy(spark, sf_dir).groupBy("cand").agg(pick("open").alias("x"), pick("closed").alias("y"))
    return S.trend(points, "x", "y")


def open_cells(spark, sf_dir):
    return cells(spark, sf_dir).where(F.col("cand").isin(*OPEN_CANDIDATES))


LOO_SQL = f"""{VOTES_SQL},
oc AS (SELECT * FROM cells WHERE cand IN {OPEN_SQL}),
js AS (SELECT DISTINCT judge AS removed_judge FROM oc),
loo AS (SELECT cand, removed_judge, avg(CASE WHEN m > 0.5 THEN 1.0::DOUBLE ELSE 0 END) AS acc
  FROM (SELECT qid, cand, removed_judge, avg(CASE WHEN ox = 'O' THEN 1 ELSE 0 END) AS m
        FROM oc, js WHERE judge <> removed_judge GROUP BY ALL) GROUP BY ALL),
base AS (SELECT cand, dense_rank() OVER (ORDER BY rank) AS base_rank
  FROM (SELECT cand, "group", row_number() OVER (ORDER BY acc DESC, cand) AS rank FROM cons) WHERE "group" = 'Open')"""


@query(
    "leave_one_out_rank_change",
    f"""WITH {LOO_SQL}, r AS (
      SELECT cand, removed_judge, acc, base_rank,
        row_number() OVER (PARTITION BY removed_judge ORDER BY acc DESC, cand) AS rank_removed FROM loo JOIN base USING (cand))
    SELECT *, rank_removed - base_rank AS rank_change FROM r""",
)
def leave_one_out_rank_change(spark, sf_dir):
    base = S.ranked(cand_accuracy(spark, sf_dir)).where(F.col("group") == "Open")
    change = S.loo_rank_change(V.leave_one_out(open_cells(spark, sf_dir)), base)
    return big(change, "base_rank", "rank_removed", "rank_change").select(
        "cand", "removed_judge", "acc", "base_rank", "rank_removed", "rank_change"
    )


LENIENCY_SQL = f"""{VOTES_SQL}, len AS (
  SELECT judge, count(*) FILTER (WHERE ox = 'O') AS o, count(*) AS n,
    count(*) FILTER (WHERE ox = 'O')::DOUBLE / count(*) AS acc, {JUDGE_FAMILY_SQL.format('judge')} AS family
  FROM cells GROUP BY judge)"""


@query("judge_leniency", f"WITH {LENIENCY_SQL} SELECT * FROM len")
def judge_leniency(spark, sf_dir):
    return S.leniency(cells(spark, sf_dir))


@query(
    "family_leniency",
    f"WITH {LENIENCY_SQL} SELECT family, round(avg(acc), 9) AS mean_acc, count(*) AS n_judges FROM len GROUP BY family",
)
def family_leniency(spark, sf_dir):
    return S.family_leniency(S.leniency(cells(spark, sf_dir)))


DOMAIN_SQL = f"""{VOTES_SQL}, dom AS (
  SELECT cand, domain, count(*) FILTER (WHERE ox = 'O')::DOUBLE / count(*) AS acc FROM maj GROUP BY cand, domain)"""


def domain_accuracy(spark, sf_dir):
    return S.cell_accuracy(consolidated(spark, sf_dir), ["cand", "domain"])


@query(
    "domain_accuracy_matrix",
    f"""WITH {DOMAIN_SQL} SELECT domain, """
    + ", ".join(f"max(acc) FILTER (WHERE cand = '{c}') AS \"{c.replace('.', '_')}\"" for c in OPEN_CANDIDATES)
    + " FROM dom GROUP BY domain",
)
def domain_accuracy_matrix(spark, sf_dir):
    """Domains by candidates, pivoted on the fixed candidate list."""
    wide = domain_accuracy(spark, sf_dir).groupBy("domain").pivot("cand", OPEN_CANDIDATES).agg(F.max("acc"))
    return wide.select("domain", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in OPEN_CANDIDATES])


@query("hardest_domains", f"WITH {DOMAIN_SQL} SELECT domain, round(avg(acc), 9) AS mean_acc FROM dom GROUP BY domain")
def hardest_domains(spark, sf_dir):
    mean = domain_accuracy(spark, sf_dir).groupBy("domain").agg(F.round(F.avg("acc"), 9).alias("mean_acc"))
    return mean.orderBy("mean_acc", "domain")


SPREAD_SQL = """round(avg(acc), 9) AS mean_acc, round(stddev_samp(acc), 9) AS std_acc,
  min(acc) AS min_acc, max(acc) AS max_acc"""


@query("domain_variance", f"WITH {DOMAIN_SQL} SELECT cand, {SPREAD_SQL} FROM dom GROUP BY cand")
def domain_variance(spark, sf_dir):
    return S.spread(domain_accuracy(spark, sf_dir), "cand")


@query("judge_variance", f"WITH {VOTES_SQL} SELECT cand, {SPREAD_SQL} FROM acc GROUP BY cand")
def judge_variance(spark, sf_dir):
    return S.spread(S.cell_accuracy(cells(spark, sf_dir), ["cand", "judge"]), "cand")


@query(
    "family_stats",
    f"""WITH {VOTES_SQL} SELECT "group", family, count(*) AS n, round(avg(acc), 9) AS mean_acc, max(acc) AS max_acc,
    round(stddev_samp(acc), 9) AS std_acc FROM (SELECT *, {CAND_FAMILY_SQL.format('cand')} AS family FROM cons)
    GROUP BY ALL""",
)
def family_stats(spark, sf_dir):
    return S.family_stats(cand_accuracy(spark, sf_dir), "group")


@query(
    "top3_domain_rank",
    f"""WITH {VOTES_SQL}, top AS (SELECT source AS domain FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)
    SELECT cand, o, n, o::DOUBLE / n AS acc, row_number() OVER (ORDER BY o::DOUBLE / n DESC, cand) AS top_domain_rank
    FROM (SELECT cand, count(*) FILTER (WHERE ox = 'O') AS o, count(*) AS n FROM maj
          WHERE domain IN (SELECT domain FROM top) GROUP BY cand)""",
)
def top3_domain_rank(spark, sf_dir):
    return big(S.top_domain_rank(consolidated(spark, sf_dir), question_attributes(spark, sf_dir)), "top_domain_rank")


SPEARMAN_SQL = f"""{VOTES_SQL}, p AS (
  SELECT a.judge AS judge_a, b.judge AS judge_b, a.acc AS a, b.acc AS b FROM acc a JOIN acc b USING (cand)
  WHERE a.cand IN {OPEN_SQL}),
r AS (SELECT judge_a, judge_b,
  rank() OVER (PARTITION BY judge_a, judge_b ORDER BY a) + (count(*) OVER (PARTITION BY judge_a, judge_b, a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY judge_a, judge_b ORDER BY b) + (count(*) OVER (PARTITION BY judge_a, judge_b, b) - 1) / 2.0::DOUBLE AS rb
  FROM p),
rho AS (SELECT judge_a, judge_b, count(*) AS n,
  CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 9) END AS rho FROM r GROUP BY ALL)"""


def spearman_pairs(spark, sf_dir):
    return S.spearman(S.cell_accuracy(open_cells(spark, sf_dir), ["cand", "judge"]))


@query("spearman_matrix", f"WITH {SPEARMAN_SQL} SELECT * FROM rho")
def spearman_matrix(spark, sf_dir):
    return spearman_pairs(spark, sf_dir)


@query(
    "spearman_summary",
    f"""WITH {SPEARMAN_SQL} SELECT round(quantile_cont(rho, 0.5), 9) AS median_rho, min(rho) AS min_rho, max(rho) AS max_rho
    FROM rho WHERE judge_a < judge_b""",
)
def spearman_summary(spark, sf_dir):
    return S.off_diagonal(spearman_pairs(spark, sf_dir))


PARETO_SQL = f"""{VOTES_SQL}, s AS (
  SELECT cand, acc, CASE WHEN cand = 'moonshotai_kimi-k2.5' THEN 1000.0
    ELSE try_cast(regexp_extract(cand, '(?i)(\\d+(?:\\.\\d+)?)b', 1) AS DOUBLE) END::DOUBLE AS params_b FROM cons),
pf AS (SELECT cand, acc, params_b, max(acc) OVER (ORDER BY params_b, cand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before,
  round(acc / params_b, 9) AS acc_per_b FROM s WHERE params_b IS NOT NULL)"""


@query("pareto_frontier", f"WITH {PARETO_SQL} SELECT cand, acc, params_b FROM pf WHERE best_before IS NULL OR acc > best_before")
def pareto_frontier(spark, sf_dir):
    return S.pareto(cand_accuracy(spark, sf_dir)).where("on_frontier").select("cand", "acc", "params_b")


@query("acc_per_param", f"WITH {PARETO_SQL} SELECT cand, params_b, acc, acc_per_b FROM pf")
def acc_per_param(spark, sf_dir):
    return S.pareto(cand_accuracy(spark, sf_dir)).select("cand", "params_b", "acc", "acc_per_b")


BIAS_SQL = f"""{VOTES_SQL},
s AS (SELECT cand, judge, acc, {CAND_FAMILY_SQL.format('cand')} AS cf, {JUDGE_FAMILY_SQL.format('judge')} AS jf FROM acc),
f AS (SELECT DISTINCT cf AS family FROM s WHERE cf IN (SELECT jf FROM s)),
pc AS (SELECT family, cand, cf, round(avg(acc) FILTER (WHERE jf = family), 9) AS own,
    round(avg(acc) FILTER (WHERE jf <> family), 9) AS other, count(DISTINCT judge) FILTER (WHERE jf = family) AS n_own
  FROM s, f GROUP BY ALL HAVING own IS NOT NULL AND other IS NOT NULL),
pr AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY own DESC) AS own_rank,
    rank() OVER (PARTITION BY family ORDER BY other DESC) AS other_rank,
    max(n_own) OVER (PARTITION BY family) AS n_family_judges FROM pc)"""


def family_bias(spark, sf_dir):
    return S.self_bias(S.cell_accuracy(cells(spark, sf_dir), ["cand", "judge"]))


@query(
    "self_bias_rank_delta",
    f"""WITH {BIAS_SQL} SELECT family, n_family_judges, count(*) AS n_family_candidates,
    round(avg(own_rank), 9) AS own_judge_mean_rank, round(avg(other_rank), 9) AS other_judge_mean_rank,
    round(avg(other_rank) - avg(own_rank), 9) AS rank_delta FROM pr WHERE cf = family GROUP BY ALL""",
)
def self_bias_rank_delta(spark, sf_dir):
    return family_bias(spark, sf_dir).drop("acc_delta")


@query(
    "self_bias_acc",
    f"WITH {BIAS_SQL} SELECT family, round(avg(own) - avg(other), 9) AS acc_delta FROM pr WHERE cf = family GROUP BY family",
)
def self_bias_acc(spark, sf_dir):
    return family_bias(spark, sf_dir).select("family", "acc_delta")


@query(
    "judge_agreement",
    f"""WITH {VOTES_SQL} SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS n,
    count(*) FILTER (WHERE a.ox = b.ox)::DOUBLE / count(*) AS agreement
    FROM cells a JOIN cells b USING (qid, cand) WHERE a.judge < b.judge AND a.ox IS NOT NULL AND b.ox IS NOT NULL
    GROUP BY ALL""",
)
def judge_agreement(spark, sf_dir):
    return S.judge_agreement(cells(spark, sf_dir))


# binomial tables by log gamma; a draw is the first count whose running sum exceeds its number
BINOMIAL_SQL = """{name} AS (SELECT n, k, sum(term) OVER (PARTITION BY n ORDER BY k) AS total FROM (
    SELECT n, k, CASE WHEN {p} >= 1 THEN (k = n)::INT::DOUBLE WHEN {p} <= 0 THEN (k = 0)::INT::DOUBLE
      ELSE exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})) END AS term
    FROM (SELECT n, unnest(range(n + 1)) AS k FROM {sizes}), counts))"""
DRAWN_SQL = "(('0x' || substr(md5({seed} || ':' || b || ':' || {i}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
BOOTSTRAP_SQL = f"""WITH {VOTES_SQL},
top AS (SELECT "group", arg_min(cand, (-acc, cand)) AS cand FROM cons GROUP BY "group"),
paired AS (SELECT qid, max((ox = 'O')::INT) FILTER (WHERE cand = (SELECT cand FROM top WHERE "group" = 'Open')) AS a,
    max((ox = 'O')::INT) FILTER (WHERE cand = (SELECT cand FROM top WHERE "group" = 'Closed')) AS b FROM maj GROUP BY qid),
counts AS (SELECT count(*) AS questions, count(*) FILTER (WHERE b > a) AS wins, count(*) FILTER (WHERE b < a) AS losses
  FROM paired WHERE a IS NOT NULL AND b IS NOT NULL),
draws AS (SELECT b, questions AS n, {DRAWN_SQL.format(seed=S.SEED, i=0)} AS u0, {DRAWN_SQL.format(seed=S.SEED, i=1)} AS u1
  FROM range({S.RESAMPLES}) t(b), counts),
{BINOMIAL_SQL.format(name="apart", p="((wins + losses)::DOUBLE / questions)", sizes="(SELECT questions AS n FROM counts)")},
first AS (SELECT b, u1, min(k) AS n FROM draws JOIN apart USING (n) WHERE total > u0 GROUP BY b, u1),
{BINOMIAL_SQL.format(name="won", p="(wins::DOUBLE / (wins + losses))", sizes="(SELECT DISTINCT n FROM first)")},
diffs AS (SELECT b, (2 * min(k) - n) / questions::DOUBLE AS diff FROM first JOIN won USING (n), counts WHERE total > u1 GROUP BY b, n, questions),
sides AS (SELECT quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high,
    least(1.0::DOUBLE, 2 * least((count(*) FILTER (WHERE diff <= 0) + 1) / {S.RESAMPLES + 1.0}::DOUBLE,
      (count(*) FILTER (WHERE diff >= 0) + 1) / {S.RESAMPLES + 1.0}::DOUBLE)) AS p_value FROM diffs)
SELECT (wins - losses) / questions::DOUBLE AS gap, ci_low, ci_high, p_value,
  p_value < 0.05::DOUBLE AND NOT (ci_low <= 0 AND ci_high >= 0) AS significant_95, {S.RESAMPLES}::BIGINT AS resamples FROM sides, counts"""


@query("bootstrap_gap", BOOTSTRAP_SQL)
def bootstrap_gap(spark, sf_dir):
    """Best closed against best open candidate, 10 000 paired resamples."""
    best = cand_accuracy(spark, sf_dir).groupBy("group").agg(
        F.min_by("cand", F.struct((-F.col("acc")).alias("a"), "cand")).alias("cand")
    )
    top = {r["group"]: r["cand"] for r in best.collect()}
    return S.bootstrap_gap(S.paired_gap(consolidated(spark, sf_dir), top["Open"], top["Closed"]))

"""Query rewriting, the retrieval grid and reranking over the benchmark."""

from pyspark.sql import functions as F

from rankforge.functions import text as X
from rankforge.functions.ids import qid as make_qid
from rankforge.models import overlap_scorer
from rankforge.operators import fusion, grid, metrics, query_variants, rerank
from rankforge.plans.common import TOKENS, documents, questions, tokens_sql
from rankforge.plans.lexical_search import LISTS_SQL, fused_sql, plan_of, rankers
from rankforge.plans.registry import query
from rankforge.plans.runs import GOLD_SQL, gold, once
from rankforge.session import materialize, together

BIG = "bigint"
# Fixed value: strategies of the registered grid, one per shape of variant list.
SHAPES = query_variants.GRID_STRATEGIES
GRID_WEIGHTS = fusion.HYBRID_WEIGHTS
# retrievers with one list add negated ranks over the variants
GRID_SINGLE = {"dense": {"dense": 1.0}, "bm25_bigrams": {"sparse": 1.0}}


def generated(spark, sf_dir):
    """Stand-in generator replies from all words of the passage or a half or third; every seventh question lacks some."""
    w = X.tokenize_words(F.col("text"))
    n = F.size("w")
    cut = lambda a, b: F.array_join(F.slice("w", a, F.greatest(b, F.lit(0))), " ")
    third = F.floor(n / 3).cast("int")
    listed = lambda sep: F.concat(
        F.lit("1. "), cut(F.lit(1), third), F.lit(sep + "2) "), cut(third + 1, third), F.lit(sep + "- "), cut(2 * third + 1, n - 2 * third)
    )
    half = F.floor(n / 2).cast("int")
    distinct = F.array_sort(F.array_distinct("w"))
    replies = F.array(
        F.struct(F.lit("hyde").alias("kind"), cut(half + 1, n - half).alias("output")),
        F.struct(F.lit("query2doc").alias("kind"), cut(F.lit(1), half).alias("output")),
        F.struct(F.lit("multiq_para").alias("kind"), listed("\n").alias("output")),
        F.struct(F.lit("multiq_angle").alias("kind"), listed("\n\n").alias("output")),
        F.struct(F.lit("stepback").alias("kind"), cut(third + 1, n - third).alias("output")),
        F.struct(F.lit("decompose").alias("kind"), F.concat(F.lit("* "), cut(F.lit(1), half)).alias("output")),
        F.struct(F.lit("expand").alias("kind"), F.array_join(distinct, ", ").alias("output")),
        F.struct(F.lit("rewrite").alias("kind"), F.concat(F.array_join(distinct, " "), F.lit("\nnote")).alias("output")),
    )
    return (
        questions(spark, sf_dir)
        .withColumn("w", w)
        .select("qid", F.explode(replies).alias("r"))
        .select("qid", "r.*")
        .where(~((F.col("qid") % 7 == 3) & F.col("kind").isin("hyde", "multiq_para", "expand")))
    )


VARIANTS_SQL = rf"""
w AS (SELECT item_id AS qid, text, {tokens_sql('text')} AS w FROM benchmark),
h AS (SELECT *, len(w) // 2 AS hf, len(w) // 3 AS th, qid % 7 = 3 AS gone FROM w),
said AS (SELECT qid, text,
  CASE WHEN NOT gone THEN array_to_string(w[hf + 1 :], ' ') END AS hyde, array_to_string(w[1 : hf], ' ') AS q2d,
  CASE WHEN NOT gone THEN [array_to_string(w[1 : th], ' '), array_to_string(w[th + 1 : 2 * th], ' '), array_to_string(w[2 * th + 1 :], ' ')] END AS mq,
  array_to_string(w[1 : hf], ' ') AS dec, CASE WHEN NOT gone THEN list_sort(list_distinct(w)) END AS ex, array_to_string(list_sort(list_distinct(w)), ' ') AS rw FROM h),
lists AS (SELECT qid, text, hyde, q2d, rw,
  CASE WHEN mq IS NULL THEN [text, text, text] ELSE list_filter(list_transform(mq, lambda x: trim(regexp_replace(x, '^[\-\*\d\.\)\s]+', ''))), lambda x: length(x) > 2) END AS mq,
  list_filter([trim(regexp_replace(dec, '^[\-\*\d\.\)\s]+', ''))], lambda x: length(x) > 2) AS dec,
  list_filter(list_transform(coalesce(ex, []), lambda x: trim(regexp_replace(x, '^[\-\*\d\.\)\s]+', ''))), lambda x: length(x) > 1 AND length(x) < 30)[1:5] AS ex FROM said),
angles AS (SELECT qid, text, coalesce(nullif(array_to_string(w[th + 1 :], ' '), ''), text) AS back,
  list_filter(list_transform([array_to_string(w[1 : th], ' '), array_to_string(w[th + 1 : 2 * th], ' '), array_to_string(w[2 * th + 1 :], ' ')],
    lambda x: trim(regexp_replace(x, '^[\-\*\d\.\)\s]+', ''))), lambda x: length(x) > 2) AS ma FROM h),
vr AS (
  SELECT 'baseline' AS prer, qid, 0 AS variant, text AS dense_q, text AS sparse_q FROM lists
  UNION ALL SELECT 'hyde', qid, 0, coalesce(hyde, text), text FROM lists
  UNION ALL SELECT 'hyde_rrf', qid, 0, text, text FROM lists
  UNION ALL SELECT 'hyde_rrf', qid, 1, coalesce(hyde, text), text FROM lists
  UNION ALL SELECT 'query2doc', qid, 0, text || ' ' || q2d, text || ' ' || q2d FROM lists
  UNION ALL SELECT 'multi_query_para', qid, i, CASE WHEN i = 0 THEN text ELSE coalesce(mq[i], text) END, CASE WHEN i = 0 THEN text ELSE coalesce(mq[i], text) END FROM lists, range(4) t(i)
  UNION ALL SELECT 'decompose', qid, i, CASE WHEN i = 0 THEN text ELSE coalesce(dec[i], text) END, CASE WHEN i = 0 THEN text ELSE coalesce(dec[i], text) END FROM lists, range(4) t(i)
  UNION ALL SELECT 'query_expansion', qid, 0, CASE WHEN len(ex) > 0 THEN text || ' ' || array_to_string(ex, ' ') ELSE text END,
    CASE WHEN len(ex) > 0 THEN text || ' ' || array_to_string(ex, ' ') ELSE text END FROM lists
  UNION ALL SELECT 'query_rewrite', qid, 0, rw, rw FROM lists)"""


@query(
    "query_variants",
    f"""WITH {VARIANTS_SQL} SELECT prer, qid, variant::INT AS variant, dense_q, sparse_q FROM vr
    UNION ALL SELECT 'multi_query_angle', qid, i::INT, CASE WHEN i = 0 THEN text ELSE coalesce(ma[i], text) END, CASE WHEN i = 0 THEN text ELSE coalesce(ma[i], text) END FROM angles, range(4) t(i)
    UNION ALL SELECT 'step_back', qid, i::INT, CASE WHEN i = 0 THEN text ELSE back END, CASE WHEN i = 0 THEN text ELSE back END FROM angles, range(2) t(i)""",
)
def query_variants_query(spark, sf_dir):
    """Texts each rewriting strategy searches with."""
    return query_variants.variants(questions(spark, sf_dir), generated(spark, sf_dir), list(query_variants.STRATEGIES))


@query(
    "missing_generator_calls",
    """SELECT item_id AS qid, kind FROM benchmark, (VALUES ('hyde'), ('multiq_para'), ('expand')) k(kind) WHERE item_id % 7 = 3""",
)
def missing_generator_calls(spark, sf_dir):
    return query_variants.missing_calls(questions(spark, sf_dir), generated(spark, sf_dir)).select("qid", "kind")


def text_key(text):
    return F.md5(text)


def grid_hits(spark, sf_dir):
    """Top 20 of every rewriting x hybrid; each distinct text is ranked once."""

    def build():
        v = materialize(query_variants.variants(questions(spark, sf_dir), generated(spark, sf_dir)))
        side = lambda c: v.select("prer", "qid", F.col(c).alias("text"), text_key(F.col(c)).alias("text_id"))
        dense_use, sparse_use = side("dense_q"), side("sparse_q")
        texts = dense_use.select("text_id", "text").union(sparse_use.select("text_id", "text")).distinct()

        def lines(retrievers):
            found = None
            for use, names in ((dense_use, ("dense",)), (sparse_use, ("sparse", "words"))):
                weights = {r: {n: w for n, w in by.items() if n in names} for r, by in retrievers.items()}
                part = plan_of(use.select(F.struct("prer", "qid").alias("qid"), "text_id"), {r: by for r, by in weights.items() if by})
                found = part if found is None else found.unionByName(part)
            # the same text used twice by one question counts twice
            return (
                found.select(F.concat_ws("__", "qid.prer", "config").alias("config"), F.col("qid.qid").alias("qid"), "ranker", "text_id", "weight")
                .groupBy("config", "qid", "ranker", "text_id")
                .agg(F.sum("weight").alias("weight"))
            )

        made = rankers(spark, sf_dir, materialize(texts), ("dense", "sparse", "words"))
        fused, summed = together(
            lambda: fusion.fuse_rrf(lines(GRID_WEIGHTS), made, rerank.TOP_N), lambda: fusion.fuse_borda(lines(GRID_SINGLE), made, rerank.TOP_N)
        )
        return fused.unionByName(summed).select("config", "qid", "doc_id", "score", F.col("rank").cast(BIG).alias("rank"))

    return once(spark, sf_dir, "grid_hits", build)


GRID_SQL = f"""{VARIANTS_SQL},
texts AS (SELECT DISTINCT md5(t) AS text_id, t AS text FROM (SELECT dense_q AS t FROM vr UNION ALL SELECT sparse_q FROM vr)),
{LISTS_SQL},
gw(r, ranker, weight) AS (VALUES {", ".join(f"('{r}', '{n}', {w}::DOUBLE)" for r, by in {**GRID_WEIGHTS, **GRID_SINGLE}.items() for n, w in by.items())}),
gl AS (SELECT 'dense' AS ranker, text_id, doc_id, rank FROM hranked UNION ALL SELECT 'sparse', text_id, doc_id, rank FROM branked
  UNION ALL SELECT 'words', text_id, doc_id, rank FROM wranked),
gp AS (SELECT prer || '__' || r AS config, qid, ranker, text_id, sum(weight) AS weight FROM (
  SELECT prer, r, qid, ranker, weight, md5(CASE WHEN ranker = 'dense' THEN dense_q ELSE sparse_q END) AS text_id FROM vr, gw) GROUP BY ALL),
gf AS (SELECT config, qid, doc_id, round(sum(CASE WHEN split_part(config, '__', 2) IN ('dense', 'bm25_bigrams') THEN -weight * (rank - 1)
    ELSE weight / (60.0::DOUBLE + rank) END), 12) AS score FROM gp JOIN gl USING (ranker, text_id) GROUP BY ALL),
ghits AS (SELECT config, qid, doc_id, score, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, doc_id) AS rank
  FROM gf QUALIFY rank <= 20)"""


@query("grid_retrieval_top20", f"WITH {GRID_SQL} SELECT * FROM ghits")
def grid_retrieval_top20(spark, sf_dir):
    return grid_hits(spark, sf_dir)


def reranked(spark, sf_dir):
    """Five hits per configuration, plain and reranked by the stand-in scorer."""
    hits = grid_hits(spark, sf_dir)
    asked = questions(spark, sf_dir).select("qid", F.col("text").alias("query"))
    scores = rerank.pair_table(hits, asked, documents(spark, sf_dir), overlap_scorer)
    cols = [F.col("config"), F.col("qid"), F.col("doc_id"), F.col("rank").cast(BIG).alias("rank")]
    plain = rerank.no_rerank(hits).select(*cols, F.lit("no_rerank").alias("postr"))
    return plain.unionByName(rerank.rerank(hits, scores).select(*cols, F.lit("overlap").alias("postr")))


# overlap of token lists on distinct (question, document) pairs
RERANK_SQL = f"""{GRID_SQL},
pq AS (SELECT item_id AS qid, list_distinct({tokens_sql('text')}) AS qw FROM benchmark),
pd AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS dw FROM documents),
ps AS (SELECT qid, doc_id, round(len(list_intersect(qw, dw))::DOUBLE / nullif(len(qw), 0), 9) AS s
  FROM (SELECT DISTINCT qid, doc_id FROM ghits) JOIN pq USING (qid) JOIN pd USING (doc_id)),
rr AS (SELECT config, qid, doc_id, row_number() OVER (PARTITION BY config, qid ORDER BY s DESC, rank) AS rank
  FROM ghits JOIN ps USING (qid, doc_id) QUALIFY rank() OVER (PARTITION BY config, qid ORDER BY s DESC, ghits.rank) <= 5),
hits5 AS (SELECT config, qid, doc_id, rank, 'no_rerank' AS postr FROM ghits WHERE rank <= 5
  UNION ALL SELECT config, qid, doc_id, rank, 'overlap' FROM rr)"""


@query("rerank_overlap_top5", f"WITH {RERANK_SQL} SELECT config, qid, doc_id, rank FROM hits5 WHERE postr = 'overlap'")
def rerank_overlap_top5(spark, sf_dir):
    return reranked(spark, sf_dir).where("postr = 'overlap'").drop("postr")


@query("no_rerank_top5", f"WITH {GRID_SQL} SELECT config, qid, doc_id, rank FROM ghits WHERE rank <= 5")
def no_rerank_top5(spark, sf_dir):
    return rerank.no_rerank(grid_hits(spark, sf_dir)).select("config", "qid", "doc_id", "rank")


def grid_scores(spark, sf_dir):
    """MRR of every configuration over questions with a gold page, to depth 5."""
    target = gold(spark, sf_dir).where("target_page IS NOT NULL").select("qid", "target_page")
    first = (
        reranked(spark, sf_dir)
        .join(target, "qid")
        .groupBy("config", "postr", "qid")
        .agg(F.min(F.when(F.col("doc_id") == F.col("target_page"), F.col("rank"))).alias("first_page"))
    )
    return (
        first.groupBy("config", "postr")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(metrics.reciprocal(F.col("first_page"))), 9).alias("mrr"))
        .select(
            F.concat_ws("__", "config", "postr").alias("config"),
            F.split("config", "__")[0].alias("prer"), F.split("config", "__")[1].alias("r"), "postr", "n", "mrr",
        )
    )


SCORES_SQL = f"""{RERANK_SQL}, {GOLD_SQL},
gs AS (SELECT config || '__' || postr AS config, split_part(config, '__', 1) AS prer, split_part(config, '__', 2) AS r, postr, count(*) AS n,
    round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr FROM (
  SELECT config, postr, qid, min(rank) FILTER (WHERE doc_id = target_page) AS f FROM hits5 JOIN gold USING (qid)
  WHERE target_page IS NOT NULL GROUP BY ALL) GROUP BY config, postr)"""


@query("grid_metrics", f"WITH {SCORES_SQL} SELECT * FROM gs")
def grid_metrics(spark, sf_dir):
    return grid_scores(spark, sf_dir)


@query(
    "component_influence",
    f"""WITH {SCORES_SQL}, m AS (SELECT 'prer' AS axis, prer AS level, avg(mrr) AS m FROM gs GROUP BY ALL
      UNION ALL SELECT 'r', r, avg(mrr) FROM gs GROUP BY ALL UNION ALL SELECT 'postr', postr, avg(mrr) FROM gs GROUP BY ALL)
    SELECT axis, count(*) AS levels, round(max(m), 9) AS best, round(min(m), 9) AS worst, round(max(m) - min(m), 9) AS influence
    FROM m GROUP BY axis""",
)
def component_influence(spark, sf_dir):
    return grid.influence(grid_scores(spark, sf_dir), "mrr")


@query(
    "grid_winners",
    f"""WITH {SCORES_SQL} SELECT postr, config, mrr FROM gs
    QUALIFY row_number() OVER (PARTITION BY postr ORDER BY mrr DESC, config) = 1""",
)
def grid_winners(spark, sf_dir):
    return grid.winners(grid_scores(spark, sf_dir), "mrr", "postr")


def _levels(names):
    return "(SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]))"


JOBS_SQL = f"""jobs AS (SELECT printf('q%04d', item_id) AS qid, prer, r, postr, prer || '__' || r || '__' || postr AS config
  FROM benchmark, {_levels(grid.AXES['prer'])} a(prer), {_levels(grid.AXES['r'])} b(r), {_levels(grid.AXES['postr'])} c(postr))"""


def jobs(spark, sf_dir):
    asked = questions(spark, sf_dir).select("qid", make_qid(F.col("qid")).alias("name"))
    return grid.with_configs(asked.select(F.col("name").alias("qid")))


@query("config_grid_384", f"WITH {JOBS_SQL} SELECT qid, config FROM jobs")
def config_grid_384(spark, sf_dir):
    """Work list: every configuration of every question."""
    return jobs(spark, sf_dir).select("qid", "config")


@query(
    "axis_sweep",
    f"""WITH {JOBS_SQL} SELECT qid, config FROM jobs
    WHERE (prer = 'baseline')::INT + (r = 'hybrid_3_7')::INT + (postr = 'bge-reranker-v2-m3-ko')::INT >= 2""",
)
def axis_sweep(spark, sf_dir):
    return grid.axis_sweep(jobs(spark, sf_dir)).select("qid", "config")

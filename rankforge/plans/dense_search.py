"""Exact vector search and its metrics over ``embeddings``."""

from pyspark.sql import functions as F

from rankforge.operators import metrics as M
from rankforge.operators.dense import dense_topk, usable
from rankforge.plans.common import DENSE_SQL, SLICES, vectors
from rankforge.plans.registry import query


def self_hits(spark, sf_dir, k=10, **options):
    corpus = vectors(spark, sf_dir)
    return dense_topk(corpus.withColumnRenamed("doc_id", "qid"), corpus, k, exclude_self=True, **options)


@query(
    "dense_topk",
    f"WITH {DENSE_SQL} SELECT qid, doc_id, score, rank FROM hits",
)
def dense_topk_query(spark, sf_dir):
    return self_hits(spark, sf_dir).select("qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def label_firsts(spark, sf_dir):
    """First rank with the query's own label, per query."""
    labels = vectors(spark, sf_dir).select("doc_id", "label")
    hits = (
        self_hits(spark, sf_dir)
        .join(labels.withColumnRenamed("label", "file"), "doc_id")
        .join(labels.select(F.col("doc_id").alias("qid"), F.col("label").alias("target")), "qid")
    )
    same = F.col("file") == F.col("target")
    return hits.groupBy("system", "qid", F.col("target").alias("label")).agg(
        F.min(F.when(same, F.col("rank"))).alias("first_page"),
        F.min(F.when(same, F.col("rank"))).alias("first_file"),
    )


FIRSTS_SQL = (
    DENSE_SQL
    + """, firsts AS (
  SELECT qid, q_label AS label, min(rank) FILTER (WHERE d_label = q_label) AS f FROM hits GROUP BY ALL
)"""
)


def metrics_sql(page="f", file="f", extended=False, cutoffs=(1, 3, 5, 10)):
    cols = ["count(*) AS total", f"round(avg(coalesce(1.0::DOUBLE / {page}, 0)), 9) AS mrr"]
    cols += [f"count(*) FILTER (WHERE {page} <= {k})::DOUBLE / count(*) AS page_hit_{k}" for k in cutoffs]
    cols += [f"count(*) FILTER (WHERE {file} <= {k})::DOUBLE / count(*) AS file_hit_{k}" for k in cutoffs]
    if extended:
        cols += [
            f"round(avg(CASE WHEN {page} <= 5 THEN 1.0::DOUBLE / log2({page} + 1) ELSE 0 END), 9) AS ndcg_5",
            f"count(*) FILTER (WHERE {page} IS NULL)::DOUBLE / count(*) AS fail_rate",
        ]
    return ", ".join(cols)


@query("dense_metrics_global", f"WITH {FIRSTS_SQL} SELECT {metrics_sql()} FROM firsts")
def dense_metrics_global(spark, sf_dir):
    return label_firsts(spark, sf_dir).agg(*M.metric_columns())


@query("dense_metrics_by_label", f"WITH {FIRSTS_SQL} SELECT label, {metrics_sql()} FROM firsts GROUP BY label")
def dense_metrics_by_label(spark, sf_dir):
    return label_firsts(spark, sf_dir).groupBy("label").agg(*M.metric_columns())


@query(
    "dense_metrics_grouping_sets",
    f"""WITH {FIRSTS_SQL} SELECT 'all' AS system, label, grouping(label)::BIGINT AS level, {metrics_sql()}
    FROM firsts GROUP BY GROUPING SETS ((), (label))""",
)
def dense_metrics_grouping_sets(spark, sf_dir):
    return M.by_grouping_sets(label_firsts(spark, sf_dir), "system", ["label"], M.metric_columns())


@query("ndcg5_failrate", f"WITH {FIRSTS_SQL} SELECT {metrics_sql(extended=True)} FROM firsts")
def ndcg5_failrate(spark, sf_dir):
    return label_firsts(spark, sf_dir).agg(*M.metric_columns(extended=True))


@query(
    "restricted_topk",
    f"""WITH {DENSE_SQL} SELECT qid, doc_id, score, rank FROM (
      SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
      FROM scored WHERE q_label = d_label) WHERE rank <= 6""",
)
def restricted_topk(spark, sf_dir):
    """Six nearest inside the query's own group, as a per-file index gives."""
    return self_hits(spark, sf_dir, 6, within="label").select(
        "qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "usable_query_metrics",
    f"""WITH {FIRSTS_SQL} SELECT {metrics_sql()} FROM firsts
    WHERE qid % 13 <> 0 AND qid % 17 <> 0 AND qid % 19 <> 0""",
)
def usable_query_metrics(spark, sf_dir):
    """Queries whose embedding failed leave the search and the denominator."""
    corpus = vectors(spark, sf_dir)
    i, v = F.col("doc_id"), F.col("vector")
    failed = (
        F.when(i % 13 == 0, F.transform(v, lambda x: (x * 0).cast("float")))
        .when(i % 19 == 0, F.transform(v, lambda x, n: F.when(n < 5, F.lit(0.0)).otherwise(x).cast("float")))
        .when(i % 17 != 0, v)
    )
    asked = usable(corpus.select(i.alias("qid"), failed.alias("vector"), F.col("label").alias("target")))
    hits = dense_topk(asked, corpus, 10, exclude_self=True)
    labelled = hits.join(corpus.select("doc_id", "label"), "doc_id").join(asked.select("qid", "target"), "qid")
    rank = F.min(F.when(F.col("label") == F.col("target"), F.col("rank")))
    return labelled.groupBy("qid").agg(rank.alias("first_page"), rank.alias("first_file")).agg(*M.metric_columns())


SLICE_VALUES = ", ".join(f"('{s}', {a}, {b})" for s, (a, b) in SLICES.items())


@query(
    "dense_systems_top5",
    f"""WITH systems(system, lo, hi) AS (VALUES {SLICE_VALUES}),
    vec AS (SELECT system, vec_id, list_transform(embedding[lo + 1 : hi], lambda x: x::DOUBLE) AS v
            FROM embeddings, systems),
    unit AS (SELECT system, vec_id,
               list_transform(v, lambda x: x / coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1)) AS v FROM vec),
    scored AS (SELECT a.system, a.vec_id AS qid, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 9) AS score
               FROM unit a JOIN unit b ON a.system = b.system AND a.vec_id <> b.vec_id)
    SELECT system, qid, doc_id, score, row_number() OVER (PARTITION BY system, qid ORDER BY score DESC, doc_id) AS rank
    FROM scored QUALIFY rank <= 5""",
)
def dense_systems_top5(spark, sf_dir):
    """The same vectors cut to dimension ranges: several embedding systems in one pass."""
    return self_hits(spark, sf_dir, 5, slices=SLICES).select(
        "system", "qid", "doc_id", "score", F.col("rank").cast("bigint").alias("rank")
    )

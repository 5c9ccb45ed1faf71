"""Runs of five retrieval systems over the benchmark passages, with gold pages.

A question's file is the source of its document and its page the document id;
the gold document is the first one that holds the passage.
"""

from pyspark.sql import functions as F

from rankforge.operators import fusion
from rankforge.operators.containment import containing
from rankforge.plans.common import documents, questions
from rankforge.plans.lexical_search import LISTS_SQL, PASSAGES_SQL, TOP_FUSED, fused_sql, passages, plan_of, rankers
from rankforge.session import table

# five systems that differ by method, each over the whole passage
LEXICAL = {"bm25_bigrams": "sparse", "bm25_words": "words"}
DENSE = "dense_hash"
FUSED = {name: fusion.HYBRID_WEIGHTS[name] for name in ("hybrid_5_5", "hybrid_ws_5_5")}
SYSTEMS = sorted([*LEXICAL, DENSE, *FUSED])
DEPTH = 10
_kept = {}


def _stamp(spark, sf_dir):
    """Names, sizes and times of the input files: a changed table is another key."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def once(spark, sf_dir, name, build):
    """Result tables of a session, kept like the result files they stand for.

    They hold at most systems x questions x depth rows, never corpus rows, and
    are dropped by ``forget`` or when the input files change.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    stamp = _stamp(spark, sf_dir)
    if key not in _kept or _kept[key][0] != stamp:
        if key in _kept:
            _kept[key][1].unpersist()
        _kept[key] = (stamp, build().persist())
    return _kept[key][1]


def forget():
    """Release every kept result table."""
    while _kept:
        _kept.popitem()[1][1].unpersist()


def _runs(spark, sf_dir):
    texts = passages(spark, sf_dir)
    made = rankers(spark, sf_dir, texts, ("dense", "sparse", "words"))
    plan = plan_of(texts.select(F.col("text_id").alias("qid"), "text_id"), FUSED)
    hits = fusion.fuse_rrf(plan, made, DEPTH).select(F.col("config").alias("system"), "qid", "doc_id", "score", "rank")
    single = {**{s: made[r] for s, r in LEXICAL.items()}, DENSE: made["dense"]}
    for system, ranker in single.items():
        top = ranker.top(DEPTH).select(F.lit(system).alias("system"), F.col("text_id").alias("qid"), "doc_id", "score", "rank")
        hits = hits.unionByName(top)
    files = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"))
    return hits.join(files, "doc_id").select(
        "system", "qid", F.col("rank").cast("bigint").alias("rank"), "file", F.col("doc_id").alias("page"), "score"
    )


def runs(spark, sf_dir):
    return once(spark, sf_dir, "runs", lambda: _runs(spark, sf_dir))


def qrels(spark, sf_dir):
    return containing(documents(spark, sf_dir, "doc_id", "text"), questions(spark, sf_dir))


def _gold(spark, sf_dir):
    first = qrels(spark, sf_dir).groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    named = first.join(docs, "doc_id").select(
        "qid",
        F.col("source").alias("target_file"),
        F.col("doc_id").alias("target_page"),
        F.col("source").alias("domain"),
        F.col("lang").alias("context_type"),
    )
    page = F.col("target_page").cast("string")
    # every fourth page is a list, every fourth is unreadable
    raw = (
        F.when(F.col("qid") % 4 == 0, F.concat_ws(",", page, (F.col("target_page") + 1).cast("string")))
        .when(F.col("qid") % 4 == 1, "n/a")
        .otherwise(page)
    )
    return (
        questions(spark, sf_dir)
        .select("qid")
        .join(named, "qid", "left")
        .withColumn("target_page_raw", F.when(F.col("target_page").isNotNull(), raw))
        .na.fill("unknown", ["domain", "context_type"])
    )


def gold(spark, sf_dir):
    """All questions; those without a holding document have no target."""
    return once(spark, sf_dir, "gold", lambda: _gold(spark, sf_dir))


GOLD_SQL = """
qrels AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
gold AS (
  SELECT item_id AS qid, d.source AS target_file, g.doc_id AS target_page,
    coalesce(d.source, 'unknown') AS domain, coalesce(d.lang, 'unknown') AS context_type,
    CASE WHEN g.doc_id IS NULL THEN NULL WHEN item_id % 4 = 0 THEN g.doc_id || ',' || (g.doc_id + 1)
      WHEN item_id % 4 = 1 THEN 'n/a' ELSE g.doc_id::VARCHAR END AS target_page_raw
  FROM benchmark LEFT JOIN (SELECT qid, min(doc_id) AS doc_id FROM qrels GROUP BY qid) g ON g.qid = item_id
  LEFT JOIN documents d ON d.doc_id = g.doc_id)"""
_LISTED = " UNION ALL ".join(
    f"SELECT '{s}' AS system, text_id AS qid, doc_id, score, rank FROM {t}"
    for s, t in (("bm25_bigrams", "branked"), ("bm25_words", "wranked"), (DENSE, "hranked"))
)
RUNS_SQL = f"""
{PASSAGES_SQL}, {LISTS_SQL}, uses AS (SELECT text_id AS qid, text_id FROM texts), {fused_sql('uses', FUSED)},
runs AS (
  SELECT system, qid, rank, source AS file, doc_id AS page, score FROM (
    {_LISTED}
    UNION ALL SELECT config, qid, doc_id, score, rank FROM ({TOP_FUSED.format(DEPTH)})) r JOIN documents d USING (doc_id)
  WHERE rank <= {DEPTH})"""
JUDGED_SQL = f"""{GOLD_SQL}, {RUNS_SQL},
judged AS (SELECT *, coalesce(file = target_file AND page = target_page, false) AS match,
    coalesce(file = target_file, false) AS file_match FROM runs JOIN gold USING (qid)),
firsts AS (SELECT system, qid, domain, context_type, min(rank) FILTER (WHERE match) AS first_page,
    min(rank) FILTER (WHERE file_match) AS first_file FROM judged GROUP BY ALL)"""

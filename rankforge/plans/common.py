"""Inputs shared by the registered queries, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.session import spread, table

# The dimension ranges searched as separate systems.
SLICES = {"d01_16": (0, 16), "d17_32": (16, 32), "d33_48": (32, 48), "d49_64": (48, 64), "full": (0, 64)}


def vectors(spark, sf_dir, id_name="doc_id"):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(id_name), F.col("embedding").alias("vector"), "label"
    )


DENSE_SQL = """
vec AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
unit AS (
  SELECT vec_id, label,
    list_transform(v, lambda x: x / coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1)) AS v
  FROM vec
),
scored AS (
  SELECT a.vec_id AS qid, a.label AS q_label, b.vec_id AS doc_id, b.label AS d_label,
    round(list_dot_product(a.v, b.v), 9) AS score
  FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
  FROM scored QUALIFY rank <= 10
)
"""

def documents(spark, sf_dir, *cols):
    docs = table(spark, sf_dir, "documents")
    docs = docs.select(*cols) if cols else docs
    # texts are read to be tokenised, embedded or cut: not by one core
    return spread(docs, "doc_id") if {"doc_id", "text"} <= set(cols) else docs


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid")


TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+'), lambda x: x <> '')"


def tokens_sql(col):
    return TOKENS.format(col)


def bm25_sql(texts="texts", prefix="", tokens=tokens_sql):
    """CTEs from ``texts(text_id, text)`` to ``{prefix}ranked(text_id, doc_id, score, rank)`` over all documents."""
    p = prefix
    return f"""
{p}dt AS (SELECT doc_id, {tokens('text')} AS toks FROM documents),
{p}stat AS (SELECT count(*) AS n, sum(len(toks))::BIGINT / count(*) AS avgdl FROM {p}dt),
{p}tf AS (SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}dt) GROUP BY ALL),
{p}voc AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw
  FROM (SELECT term, count(*) AS df FROM {p}tf GROUP BY term), {p}stat),
{p}flo AS (SELECT sum(c * raw) / sum(c) * 0.25::DOUBLE AS flo
  FROM (SELECT df, raw, count(*) AS c FROM {p}voc GROUP BY df, raw)),
{p}qt AS (SELECT text_id, term, count(*) AS qtf
  FROM (SELECT text_id, unnest({tokens('text')}) AS term FROM {texts}) GROUP BY ALL),
{p}matched AS (SELECT text_id, doc_id,
    round(sum(qtf * CASE WHEN raw < 0 THEN flo ELSE raw END * tf * 2.5::DOUBLE
      / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM {p}qt JOIN {p}voc USING (term) JOIN {p}tf USING (term), {p}stat, {p}flo GROUP BY ALL),
{p}ranked AS (SELECT text_id, doc_id, coalesce(score, 0) AS score,
    row_number() OVER (PARTITION BY text_id ORDER BY coalesce(score, 0) DESC, doc_id) AS rank
  FROM (SELECT text_id, doc_id FROM {texts}, documents) LEFT JOIN {p}matched USING (text_id, doc_id))"""


def hash_dense_sql(texts="texts", prefix="h"):
    p = prefix
    bucket = "('0x' || substr(md5(term), 1, 8))::BIGINT % 64"
    return f"""
{p}d AS (SELECT doc_id, {bucket} AS b, count(*)::DOUBLE AS c
  FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL),
{p}q AS (SELECT text_id, {bucket} AS b, count(*)::DOUBLE AS c
  FROM (SELECT text_id, unnest({tokens_sql('text')}) AS term FROM {texts}) GROUP BY ALL),
{p}dn AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM {p}d GROUP BY doc_id),
{p}qn AS (SELECT text_id, sqrt(sum(c * c)) AS norm FROM {p}q GROUP BY text_id),
{p}matched AS (SELECT text_id, doc_id, round(sum({p}q.c * {p}d.c) / any_value({p}qn.norm * {p}dn.norm), 9) AS score
  FROM {p}q JOIN {p}d USING (b) JOIN {p}dn USING (doc_id) JOIN {p}qn USING (text_id) GROUP BY ALL),
{p}ranked AS (SELECT text_id, doc_id, coalesce(score, 0) AS score,
    row_number() OVER (PARTITION BY text_id ORDER BY coalesce(score, 0) DESC, doc_id) AS rank
  FROM (SELECT text_id, doc_id FROM {texts}, documents) LEFT JOIN {p}matched USING (text_id, doc_id))"""

# Candidate and judge names of the vote table, by index.
CANDIDATES = [
    "gpt-oss_20b", "gpt-oss_120b", "phi4_14b", "exaone3.5_32b", "lfm2_24b", "mistral-small_24b",
    "qwen3.5_9b-q8_0_nothink", "deepseek-r1_70b_nothink", "moonshotai_kimi-k2.5",
    "gpt-5.4", "gemini-3.1-pro-preview", "gpt-5.4-mini",
]
JUDGES = [
    "gemma4_31b", "nemotron-3-super-120b", "qwen3.5_35b-a3b-q4_K_M",
    "gemini-3-flash-preview", "qwen3-next-80b", "gpt-5.4",
]
# Candidates and judges with open weights.
OPEN_SET = [
    "deepseek-r1_70b_nothink", "exaone3.5_32b", "gpt-oss_20b", "gpt-oss_120b", "lfm2_24b", "mistral-small_24b", "phi4_14b",
    "qwen3.5_9b-q4_K_M_nothink", "qwen3.5_9b-q8_0_nothink", "qwen3.5_27b-q8_0_nothink", "qwen3.5_122b-a10b-q4_K_M_nothink",
    "qwen3.5_122b-a10b-q4_K_M_think", "deepseek_deepseek-v3.2", "deepseek_deepseek-v4-flash", "deepseek_deepseek-v4-pro",
    "moonshotai_kimi-k2.5", "moonshotai_kimi-k2.6", "minimax_minimax-m2.5", "minimax_minimax-m2.7",
    "mistralai_mistral-small-2603", "nvidia_nemotron-3-nano-30b-a3b", "xiaomi_mimo-v2.5", "xiaomi_mimo-v2.5-pro",
    "z-ai_glm-4.7", "z-ai_glm-4.7-flash", "z-ai_glm-5", "z-ai_glm-5.1",
]
OPEN_JUDGE_SET = [
    "gemma4_31b", "nemotron-3-super-120b", "qwen3-next-80b", "qwen3.5-27b-claude-distill", "qwen3.5_122b-a10b-q4_K_M",
    "qwen3.5_35b-a3b-q4_K_M", "qwen3.6_35b-a3b-q4_K_M", "solar-open-100b", "supergemma4-26b",
]
# those of them in the vote table
OPEN_CANDIDATES = [c for c in CANDIDATES if c in OPEN_SET]
OPEN_JUDGES = [j for j in JUDGES if j in OPEN_JUDGE_SET]
METRIC_NAMES = ["similarity", "correctness", "completeness", "faithfulness"]


def question_attributes(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "source", "lang").select(
        F.col("doc_id").alias("ix"),
        F.format_string("q%04d", "doc_id").alias("qid"),
        F.col("source").alias("domain"),
        F.col("lang").alias("context_type"),
    )


def _named(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def votes(spark, sf_dir):
    """Metric scores of every document by every candidate and judge.

    A fixed integer formula stands in for the judges: judge 4 always gives 1,
    judge 5 never saw candidate 11, and some cells lack their last metric.
    """
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    i, c, j, m = F.col("ix"), F.col("c").cast("bigint"), F.col("j").cast("bigint"), F.col("m").cast("bigint")
    mixed = i * 7919 + c * 104729 + j * 1299709 + m * 15485863 + (i + 1) * (c + 3) * (j + 5) * (m + 7) * 31
    return (
        question_attributes(spark, sf_dir)
        .withColumn("c", span(len(CANDIDATES)))
        .withColumn("j", span(len(JUDGES)))
        .withColumn("m", span(len(METRIC_NAMES)))
        .where(~((F.col("c") == 11) & (F.col("j") == 5)) & ~(((i * c + j) % 29 == 0) & (F.col("m") == 3)))
        .select(
            "ix", "qid", "domain", "context_type",
            _named(CANDIDATES, F.col("c")).alias("cand"),
            _named(JUDGES, F.col("j")).alias("judge"),
            _named(METRIC_NAMES, F.col("m")).alias("metric"),
            F.when(F.col("j") == 4, 1).otherwise(1 + (mixed % 1000003) % 5).cast("int").alias("score"),
            F.col("c").alias("cand_ix"),
            F.col("m").alias("metric_ix"),
        )
    )


def _list_sql(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in_sql(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


VOTES_SQL = f"""
votes AS (
  SELECT d.doc_id AS ix, printf('q%04d', d.doc_id) AS qid, d.source AS domain, d.lang AS context_type,
    ({_list_sql(CANDIDATES)})[c + 1] AS cand, ({_list_sql(JUDGES)})[j + 1] AS judge,
    ({_list_sql(METRIC_NAMES)})[m + 1] AS metric,
    (CASE WHEN j = 4 THEN 1 ELSE 1 + ((d.doc_id * 7919 + c * 104729 + j * 1299709 + m * 15485863
      + (d.doc_id + 1) * (c + 3) * (j + 5) * (m + 7) * 31) % 1000003) % 5 END)::INT AS score,
    c AS cand_ix, m AS metric_ix
  FROM documents d, range(12) tc(c), range(6) tj(j), range(4) tm(m)
  WHERE NOT (c = 11 AND j = 5) AND NOT ((d.doc_id * c + j) % 29 = 0 AND m = 3)),
raw_cells AS (
  SELECT qid, domain, context_type, cand, judge, count(*) FILTER (WHERE score >= 4) AS o_count, count(*) AS n_metrics
  FROM votes GROUP BY ALL),
cells AS (SELECT * , CASE WHEN n_metrics = 4 THEN CASE WHEN o_count >= 2 THEN 'O' ELSE 'X' END END AS ox FROM raw_cells),
acc AS (
  SELECT cand, judge, count(*) FILTER (WHERE ox = 'O') AS o, count(ox) AS scored,
    count(*) FILTER (WHERE ox = 'O')::DOUBLE / nullif(count(ox), 0) AS acc_scored, count(*) AS n,
    count(*) FILTER (WHERE ox = 'O')::DOUBLE / count(*) AS acc
  FROM cells GROUP BY cand, judge),
maj AS (
  SELECT qid, domain, context_type, cand, count(*) FILTER (WHERE ox = 'O') AS o, count(ox) AS evaluated,
    CASE WHEN count(*) FILTER (WHERE ox = 'O') * 2 > count(ox) THEN 'O' ELSE 'X' END AS ox
  FROM cells GROUP BY ALL),
cons AS (
  SELECT cand, CASE WHEN cand IN {_in_sql(OPEN_CANDIDATES)} THEN 'Open' ELSE 'Closed' END AS "group",
    count(*) FILTER (WHERE ox = 'O') AS o, count(*) AS n, count(*) FILTER (WHERE ox = 'O')::DOUBLE / count(*) AS acc
  FROM maj GROUP BY cand)
"""

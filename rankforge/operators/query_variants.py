"""Query rewriting strategies: a question to the texts that are searched.

``replies`` holds generator output by question and prompt kind; a missing or
empty reply falls back to the question itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.text import first_line, parse_keywords, parse_lines

# Strategies, and the prompt kind each one reads.
STRATEGIES = {
    "baseline": None,
    "hyde": "hyde",
    "hyde_rrf": "hyde",
    "query2doc": "query2doc",
    "multi_query_para": "multiq_para",
    "multi_query_angle": "multiq_angle",
    "step_back": "stepback",
    "decompose": "decompose",
    "query_expansion": "expand",
    "query_rewrite": "rewrite",
}
GRID_STRATEGIES = [s for s in STRATEGIES if s not in ("multi_query_angle", "step_back")]
VARIANTS = 3


def _same(text: Column) -> Column:
    return F.struct(text.alias("dense_q"), text.alias("sparse_q"))


def _pairs(strategy: str, q: Column, reply: Column) -> Column:
    said = F.coalesce(F.nullif(reply, F.lit("")), q)
    if strategy == "baseline":
        return F.array(_same(q))
    if strategy in ("hyde", "hyde_rrf"):
        answer = F.struct(said.alias("dense_q"), q.alias("sparse_q"))
        return F.array(answer) if strategy == "hyde" else F.array(_same(q), answer)
    if strategy == "query2doc":
        return F.array(_same(F.concat_ws(" ", q, said)))
    if strategy == "step_back":
        return F.array(_same(q), _same(said))
    if strategy == "query_expansion":
        words = parse_keywords(F.coalesce(reply, F.lit("")))
        return F.array(_same(F.when(F.size(words) > 0, F.concat_ws(" ", q, F.array_join(words, " "))).otherwise(q)))
    if strategy == "query_rewrite":
        return F.array(_same(F.coalesce(F.nullif(first_line(said), F.lit("")), q)))
    listed = F.when(F.coalesce(reply, F.lit("")) == "", F.array_repeat(q, VARIANTS)).otherwise(parse_lines(reply, VARIANTS, q))
    return F.transform(F.concat(F.array(q), listed), _same)


def variants(questions: DataFrame, replies: DataFrame, strategies=GRID_STRATEGIES) -> DataFrame:
    """``(prer, qid, variant, dense_q, sparse_q)`` for every strategy.

    ``questions`` has ``(qid, text)``, ``replies`` has ``(qid, kind, output)``.
    Replies become one map per question, so strategies share one join.
    """
    by_kind = replies.groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "output"))).alias("said")
    )
    joined = questions.select("qid", "text").join(by_kind, "qid", "left")
    q, reply = F.col("text"), lambda kind: F.col("said")[kind] if kind else F.lit(None).cast("string")
    lists = F.array(
        *[F.struct(F.lit(s).alias("prer"), _pairs(s, q, reply(STRATEGIES[s])).alias("pairs")) for s in strategies]
    )
    return (
        joined.select("qid", F.explode(lists).alias("l"))
        .select("qid", "l.prer", F.posexplode("l.pairs").alias("variant", "p"))
        .select("prer", "qid", "variant", "p.dense_q", "p.sparse_q")
    )


def missing_calls(questions: DataFrame, replies: DataFrame, strategies=GRID_STRATEGIES) -> DataFrame:
    """Generator calls still to make; strategies that share a prompt share the call."""
    kinds = sorted({STRATEGIES[s] for s in strategies if STRATEGIES[s]})
    wanted = questions.select("qid", "text").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return wanted.join(replies.select("qid", "kind"), ["qid", "kind"], "left_anti")

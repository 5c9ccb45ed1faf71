"""Records: duplicates, resume, merges, unions, costs, wide tables, files."""

from pyspark.sql import functions as F

from rankforge.functions import envelopes as E
from rankforge.functions import names as N
from rankforge.functions import text as X
from rankforge.operators import costs, keyed
from rankforge.plans.common import CANDIDATES, JUDGES, VOTES_SQL, _list_sql
from rankforge.plans.judging import cells, judge_accuracy
from rankforge.plans.parsing import replies
from rankforge.plans.registry import query
from rankforge.plans.runs import RUNS_SQL, runs
from rankforge.session import scratch_path, table
from rankforge.sources import loaders, readers, writers


def event_votes(spark, sf_dir):
    """Sparse scores with repeats, one per event."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        (e % 60).alias("q"),
        (F.col("user_id") % 12).alias("cand"),
        F.col("event_type").alias("judge"),
        (F.floor(e / 60) % 4).alias("metric"),
        (1 + (e * 7) % 5).alias("score"),
        F.repeat(F.lit("x"), (e * 13 % 17).cast("int")).alias("answer"),
    )


EVENTS_SQL = """ev AS (SELECT event_id, event_id % 60 AS q, user_id % 12 AS cand, event_type AS judge, event_id // 60 % 4 AS metric,
  1 + (event_id * 7) % 5 AS score, repeat('x', (event_id * 13 % 17)::INT) AS answer FROM events)"""


@query(
    "dedupe_longest",
    f"""WITH {EVENTS_SQL} SELECT q, cand, event_id, answer FROM ev
    QUALIFY row_number() OVER (PARTITION BY q, cand ORDER BY length(answer) DESC, event_id) = 1""",
)
def dedupe_longest(spark, sf_dir):
    rows = event_votes(spark, sf_dir).select("q", "cand", "event_id", "answer")
    return keyed.keep_longest(rows, ["q", "cand"], "answer", "event_id")


@query(
    "last_write_wins",
    f"""WITH {EVENTS_SQL} SELECT q, cand, judge, metric, event_id, score FROM ev
    QUALIFY row_number() OVER (PARTITION BY q, cand, judge, metric ORDER BY event_id DESC) = 1""",
)
def last_write_wins(spark, sf_dir):
    rows = event_votes(spark, sf_dir).drop("answer")
    return keyed.last_wins(rows, ["q", "cand", "judge", "metric"], "event_id")


@query(
    "first_wins",
    f"""WITH {EVENTS_SQL} SELECT q, cand, judge, metric, event_id, score FROM ev
    QUALIFY row_number() OVER (PARTITION BY q, cand, judge, metric ORDER BY event_id) = 1""",
)
def first_wins(spark, sf_dir):
    rows = event_votes(spark, sf_dir).drop("answer")
    return keyed.first_wins(rows, ["q", "cand", "judge", "metric"], "event_id")


@query(
    "valid_scores",
    f"WITH {EVENTS_SQL} SELECT judge, count(*) AS n FROM ev WHERE score + metric - 2 BETWEEN 1 AND 5 GROUP BY judge",
)
def valid_scores(spark, sf_dir):
    """Only whole scores from 1 to 5 count."""
    rows = event_votes(spark, sf_dir).where((F.col("score") + F.col("metric") - 2).between(1, 5))
    return rows.groupBy("judge").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resume_anti_join",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def resume_anti_join(spark, sf_dir):
    """Documents no label row has finished."""
    return keyed.todo(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "keep_known",
    "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
)
def keep_known(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    kept = table(spark, sf_dir, "documents").select("doc_id", "lang").join(good, "doc_id", "left_semi")
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fill_if_empty",
    """SELECT doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END, CASE WHEN l.quality = 1 THEN 'good' END) AS value
    FROM documents d FULL JOIN labels l USING (doc_id)""",
)
def fill_if_empty(spark, sf_dir):
    """Blank values of one table come from the other."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("value"))
    second = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("value"))
    return keyed.fill_if_empty(first, second, ["doc_id"], "value")


@query(
    "last_chunk_lookup",
    """WITH c AS (SELECT conv_id, role, max_by(text, turn) AS text FROM conversations GROUP BY ALL)
    SELECT doc_id, md5(coalesce(c.text, '')) AS digest FROM documents d LEFT JOIN c ON c.conv_id = d.doc_id AND c.role = 'user'""",
)
def last_chunk_lookup(spark, sf_dir):
    """Last of several texts per key, the empty text where there is none."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit("user").alias("role"))
    found = keyed.lookup_last(items, table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")
    return found.select(F.col("conv_id").alias("doc_id"), F.md5("text").alias("digest"))


@query(
    "left_join_default",
    "SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality FROM documents LEFT JOIN labels USING (doc_id)",
)
def left_join_default(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    return keyed.with_default(table(spark, sf_dir, "documents").select("doc_id"), marks, ["doc_id"], "quality", 0.0)


@query(
    "mostly_done",
    f"WITH {EVENTS_SQL} SELECT cand, count(*) FILTER (WHERE answer <> '') AS answered, count(*) FILTER (WHERE answer <> '') >= 290 AS done FROM ev GROUP BY cand",
)
def mostly_done(spark, sf_dir):
    """Candidates with at least 290 answers count as done."""
    return keyed.mostly_done(event_votes(spark, sf_dir), ["cand"], F.col("answer"), 290)


@query(
    "all_stages_union",
    f"""WITH {VOTES_SQL}
    SELECT 'retrieval' AS stage, source AS config, count(*)::BIGINT AS n, round(avg(n_chars), 9) AS mean_chars, NULL::DOUBLE AS accuracy, NULL::VARCHAR AS judge FROM documents GROUP BY source
    UNION ALL SELECT 'generation', cand, o, NULL, acc, NULL FROM cons
    UNION ALL SELECT 'judging', cand, o, NULL, acc_scored, judge FROM acc""",
)
def all_stages_union(spark, sf_dir):
    """Result rows of unlike stages in one table."""
    from rankforge.plans.statistics import cand_accuracy

    retrieval = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("config")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 9).alias("mean_chars")
    )
    generation = cand_accuracy(spark, sf_dir).select(F.col("cand").alias("config"), F.col("o").alias("n"), F.col("acc").alias("accuracy"))
    judging = judge_accuracy(spark, sf_dir).select(
        F.col("cand").alias("config"), "judge", F.col("o").alias("n"), F.col("acc_scored").alias("accuracy")
    )
    stage = lambda df, name: df.withColumn("stage", F.lit(name))
    return keyed.union_by_name([stage(retrieval, "retrieval"), stage(generation, "generation"), stage(judging, "judging")])


@query("stage_counts", "SELECT role AS stage, count(*) AS n FROM conversations GROUP BY role")
def stage_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


# --- costs ------------------------------------------------------------------

PRICE_SQL = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in costs.PRICES.items()) + ") p(model, usd_in, usd_out)"
MODELS = ["openai/gpt-5.4", "openai/gpt-5.4-mini", "google/gemini-3.1-pro-preview", "unlisted"]


def generations(spark, sf_dir):
    """Conversation turns as generations of four models."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("conv_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        model.alias("model"),
        F.when(F.col("turn") % 6 == 5, "").otherwise(F.col("text")).alias("answer"),
        F.length("text").alias("tokens_in"),
        F.when(F.col("turn") % 4 != 3, F.col("turn") * 10).alias("tokens_out"),
        ((F.col("conv_id") + F.col("turn")) % 5 / F.lit(4.0)).alias("latency_sec"),
    )


GENERATIONS_SQL = f"""g AS (SELECT ({_list_sql(MODELS)})[conv_id % 4 + 1] AS model, CASE WHEN turn % 6 = 5 THEN '' ELSE text END AS answer,
  length(text) AS tokens_in, CASE WHEN turn % 4 <> 3 THEN turn * 10 END AS tokens_out, ((conv_id + turn) % 5) / 4.0::DOUBLE AS latency_sec
  FROM conversations),
tot AS (SELECT model, count(*) AS total, count(*) FILTER (WHERE answer <> '') AS answered, sum(tokens_in)::BIGINT AS tokens_in,
  coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, round(avg(nullif(latency_sec, 0)), 9) AS avg_latency_nonzero,
  round(avg(latency_sec), 9) AS avg_latency_all FROM g GROUP BY model)"""


@query(
    "token_cost",
    f"""WITH {GENERATIONS_SQL} SELECT tot.*, round(tokens_in / 1e6::DOUBLE * coalesce(usd_in, 1.0) + tokens_out / 1e6::DOUBLE * coalesce(usd_out, 5.0), 9) AS cost_usd
    FROM tot LEFT JOIN {PRICE_SQL} USING (model)""",
)
def token_cost(spark, sf_dir):
    """Usage totals and money per model; an unlisted model has the default price."""
    prices = spark.createDataFrame([(m, *p) for m, p in costs.PRICES.items()], "model string, usd_in double, usd_out double")
    return costs.priced(costs.usage_totals(generations(spark, sf_dir), ["model"]), F.broadcast(prices))


@query(
    "token_estimates",
    """SELECT lang, round(avg(length(text) / 3.2::DOUBLE), 9) AS average,
    sum(CASE WHEN length(text) > 0 THEN floor(length(text) / 3.3::DOUBLE)::BIGINT + 1 ELSE 0 END)::BIGINT AS upper_bound, sum(length(text) // 4)::BIGINT AS quarter FROM documents GROUP BY lang""",
)
def token_estimates(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.round(F.avg(costs.tokens_average(t)), 9).alias("average"),
        F.sum(costs.tokens_upper(t)).alias("upper_bound"),
        F.sum(costs.tokens_quarter(t)).alias("quarter"),
    )


@query(
    "latency_stats",
    """SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean_ms, round(quantile_cont(value, 0.95), 9) AS p95_ms,
    round(count(*) / (sum(value) / 1000), 6) AS qps FROM events GROUP BY event_type""",
)
def latency_stats(spark, sf_dir):
    return costs.latency_stats(table(spark, sf_dir, "events"), "value", ["event_type"])


# --- wide tables ------------------------------------------------------------


def _column(name):
    return name.replace(".", "_").replace("-", "_")


@query(
    "wide_pivot",
    f"""WITH {VOTES_SQL} SELECT qid, judge, """
    + ", ".join(f"max(ox) FILTER (WHERE cand = '{c}') AS {_column(c)}_ox" for c in CANDIDATES)
    + " FROM cells GROUP BY qid, judge",
)
def wide_pivot(spark, sf_dir):
    """Every judge's cells as a row per question and a column per candidate."""
    wide = cells(spark, sf_dir).groupBy("qid", "judge").pivot("cand", CANDIDATES).agg(F.max("ox"))
    return wide.select("qid", "judge", *[F.col(f"`{c}`").alias(f"{_column(c)}_ox") for c in CANDIDATES])


@query(
    "wide_unpivot",
    f"""WITH {VOTES_SQL} SELECT qid, judge, cand, coalesce(ox, '') AS ox
    FROM (SELECT DISTINCT qid, judge FROM cells) LEFT JOIN (SELECT unnest({_list_sql(CANDIDATES)}) AS cand) ON true LEFT JOIN cells USING (qid, judge, cand)""",
)
def wide_unpivot(spark, sf_dir):
    """The wide form turned back into cells, blank where unjudged."""
    wide = wide_pivot(spark, sf_dir).na.fill("")
    back = F.create_map(*[v for c in CANDIDATES for v in (F.lit(f"{_column(c)}_ox"), F.lit(c))])
    long = wide.unpivot(["qid", "judge"], [f"{_column(c)}_ox" for c in CANDIDATES], "col", "ox")
    return long.select("qid", "judge", back[F.col("col")].alias("cand"), "ox")


# --- names, prompts ---------------------------------------------------------


@query(
    "name_rules",
    f"""WITH d AS (SELECT doc_id, ({_list_sql(CANDIDATES)})[doc_id % 12 + 1] AS name FROM documents)
    SELECT doc_id, name, CASE WHEN name LIKE '%qwen%' THEN 'qwen' WHEN name LIKE 'gpt-%' THEN 'gpt' WHEN name LIKE '%gemini%' THEN 'gemini'
      WHEN name LIKE '%mistral%' THEN 'mistral' WHEN name LIKE '%kimi%' THEN 'kimi' WHEN name LIKE '%deepseek%' THEN 'deepseek'
      WHEN name LIKE '%exaone%' THEN 'exaone' WHEN name LIKE '%phi%' THEN 'phi' WHEN name LIKE '%lfm%' THEN 'lfm' ELSE 'other' END AS family,
    CASE WHEN name LIKE '%gpt%' THEN 'openai' WHEN name LIKE '%gemini%' THEN 'google' WHEN name LIKE '%deepseek%' THEN 'deepseek'
      WHEN name LIKE '%kimi%' THEN 'moonshotai' WHEN name LIKE '%qwen%' THEN 'alibaba' WHEN name LIKE '%mistral%' THEN 'mistralai' ELSE 'unknown' END AS vendor,
    regexp_matches(name, 'qwen|deepseek|exaone|lfm|phi|minimax|mistral|moonshot|kimi|nemotron|gpt-oss|mimo|glm|gemma4|solar-open') AS open_weights,
    CASE doc_id % 3 WHEN 0 THEN '_think' WHEN 1 THEN '_nothink' ELSE '' END AS suffix FROM d""",
)
def name_rules(spark, sf_dir):
    """Family, vendor, openness and result suffix by name."""
    i = F.col("doc_id")
    name = F.element_at(F.array(*[F.lit(c) for c in CANDIDATES]), (i % 12 + 1).cast("int"))
    think = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    n = F.col("name")
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), think.alias("think")).select(
        "doc_id", "name", N.candidate_family(n).alias("family"), N.vendor(n).alias("vendor"),
        N.open_by_words(n).alias("open_weights"), N.result_suffix(F.col("think")).alias("suffix"),
    )


TEMPLATE = "Answer from the context only.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"
RUBRIC = "Rate 1 to 5.\nQuestion: {question}\nExpected: {target}\nAnswer: {generated}\nScore:"


@query(
    "prompt_render",
    """SELECT conv_id, turn, md5('Answer from the context only.' || chr(10) || chr(10) || 'Context:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || role || chr(10) || 'Answer:') AS prompt,
    md5('Rate 1 to 5.' || chr(10) || 'Question: ' || role || chr(10) || 'Expected: ' || turn || chr(10) || 'Answer: ') AS head,
    md5(text || chr(10) || 'Score:') AS tail FROM conversations""",
)
def prompt_render(spark, sf_dir):
    """A filled prompt, and a judge prompt cut into a cacheable head and a tail."""
    head, tail = X.split_template(RUBRIC, "generated")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.md5(X.render(TEMPLATE, context=F.col("text"), question=F.col("role"))).alias("prompt"),
        F.md5(X.render(head, question=F.col("role"), target=F.col("turn").cast("string"))).alias("head"),
        F.md5(X.render(tail, generated=F.col("text"))).alias("tail"),
    )


@query(
    "context_join",
    f"""WITH {RUNS_SQL}, h AS (SELECT system, qid, rank, text FROM runs JOIN documents ON doc_id = page WHERE rank <= 5)
    SELECT system, qid, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS ruled,
    md5(string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank)) AS numbered FROM h GROUP BY ALL""",
)
def context_join(spark, sf_dir):
    """Texts of the five best hits in rank order, ruled off or numbered."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    hits = runs(spark, sf_dir).where("rank <= 5").select("system", "qid", "rank", "page").join(texts, "page")
    numbered = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "text")
    return hits.groupBy("system", "qid").agg(
        F.md5(X.joined_by_rank(F.col("rank"), F.col("text"), X.CONTEXT_RULE)).alias("ruled"),
        F.md5(X.joined_by_rank(F.col("rank"), numbered, "\n\n")).alias("numbered"),
    )


@query(
    "source_alias_map",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'alias of ' || source ELSE source END AS name, source AS file FROM documents""",
)
def source_alias_map(spark, sf_dir):
    """Names that are aliases of files are put right, others stay."""
    docs = table(spark, sf_dir, "documents")
    alias = F.concat(F.lit("alias of "), "source")
    aliases = docs.select(F.col("source").alias("alias"), alias.alias("file")).distinct()
    named = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, alias).otherwise(F.col("source")).alias("file"))
    renamed = loaders.rename_files(named.withColumn("name", F.col("file")), aliases)
    return renamed.select("doc_id", "name", "file")


# --- files ------------------------------------------------------------------


@query("source_jsonl_tolerant", "SELECT conv_id, turn, md5(text) AS digest FROM conversations WHERE turn % 7 <> 3")
def source_jsonl_tolerant(spark, sf_dir):
    """Turns written as lines, some broken and some blank, read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    line = F.to_json(F.struct("conv_id", "turn", "text"))
    broken = F.when(F.col("turn") % 7 == 3, F.concat(F.lit("{"), line)).otherwise(line)
    path = scratch_path(spark, "turns")
    rows.select(F.explode(F.array(broken, F.lit("  "))).alias("value")).write.text(path)
    read = readers.jsonl(spark, path, "conv_id bigint, turn bigint, text string", tolerant=True)
    return read.select("conv_id", "turn", F.md5("text").alias("digest"))


@query("source_json_array", "SELECT doc_id, quality FROM labels")
def source_json_array(spark, sf_dir):
    """Labels as JSON array files and back."""
    path = scratch_path(spark, "labels")
    rows = table(spark, sf_dir, "labels")
    # one array per thousand ids keeps every file small
    arrays = rows.groupBy(F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "quality"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.json_array(spark, path, "doc_id bigint, quality int")


@query("sink_csv_parquet", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang")
def sink_csv_parquet(spark, sf_dir):
    """A summary written as parquet and CSV, the CSV read back."""
    path = scratch_path(spark, "summary")
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))
    writers.write_both(rows, path)
    return spark.read.schema("lang string, n bigint, n_chars bigint").csv(f"{path}/csv", header=True)


@query("sink_versioned_table", "SELECT doc_id, quality + 1 AS quality FROM labels")
def sink_versioned_table(spark, sf_dir):
    """A table replaced by a newer version; readers see the newest."""
    path = scratch_path(spark, "registry")
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality")
    writers.replace_table(rows, path)
    writers.replace_table(rows.withColumn("quality", F.col("quality") + 1), path)
    return writers.current_table(spark, path)


@query(
    "sink_request_lines",
    """SELECT conv_id, turn, md5(text) AS prompt, 'm' AS model FROM conversations""",
)
def sink_request_lines(spark, sf_dir):
    """Batch request lines written as text shards and parsed back."""
    path = scratch_path(spark, "requests")
    cid = F.format_string("c%d::%d", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations").select(E.chat_request(cid, F.lit("m"), F.col("text"), 10).alias("line"))
    writers.write_requests(rows, "line", path)
    schema = "custom_id string, body struct<model: string, messages: array<struct<role: string, content: string>>>"
    read = readers.jsonl(spark, path, schema)
    part = lambda i: F.regexp_extract("custom_id", r"^c(\d+)::(\d+)$", i).cast("bigint")
    return read.select(
        part(1).alias("conv_id"), part(2).alias("turn"), F.md5(F.get("body.messages", 0)["content"]).alias("prompt"), F.col("body.model").alias("model")
    )

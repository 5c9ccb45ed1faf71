"""Result folders, score caches, page files, settings and reports, written by Spark and read back."""

from pyspark.sql import functions as F

from rankforge.functions import ids
from rankforge.functions import text as X
from rankforge.functions.envelopes import chat_request
from rankforge.operators import grid, votes
from rankforge.plans.common import CANDIDATES, JUDGES, METRIC_NAMES, VOTES_SQL, _in_sql, questions
from rankforge.plans.common import votes as all_votes
from rankforge.plans.judging import CELL
from rankforge.plans.registry import query
from rankforge.session import scratch_path, table
from rankforge.sources import loaders, readers, writers

# --- folders ----------------------------------------------------------------

# twenty conversations a file; every fifth file is a retry, which never counts
FOLDER_SQL = """f AS (SELECT role || '__part' || (conv_id // 20) || CASE WHEN (conv_id // 20) % 5 = 3 THEN '_retry' ELSE '' END AS key,
  role, conv_id, turn FROM conversations)"""


def result_folder(spark, sf_dir, path):
    """JSON array files of turns, named by role and part."""
    part = F.floor(F.col("conv_id") / 20)
    name = F.concat("role", F.lit("__part"), part.cast("string"), F.when(part % 5 == 3, "_retry").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select(F.concat(name, F.lit(".json")).alias("name"), "conv_id", "turn")
    arrays = rows.groupBy("name").agg(F.to_json(F.collect_list(F.struct("conv_id", "turn"))).alias("value"))
    writers.write_named(arrays, path)


@query(
    "source_json_directory",
    f"WITH {FOLDER_SQL} SELECT key AS system, conv_id, turn FROM f WHERE role <> 'system' AND NOT contains(key, '_retry')",
)
def source_json_directory(spark, sf_dir):
    """Result files keyed by name; names of no allowed beginning and retries are never opened."""
    path = scratch_path(spark, "results")
    result_folder(spark, sf_dir, path)
    read = readers.json_directory(spark, path, "conv_id bigint, turn bigint", prefixes=["user", "assistant"])
    return read.select(F.col("key").alias("system"), "conv_id", "turn")


# --- score cache ------------------------------------------------------------

# Configurations with scores, and one that was never judged.
JUDGED = ["baseline__dense__no_rerank", "hyde__hybrid_5_5__mmr"]
UNJUDGED = "step_back__bm25__mmr"
SCORE_SQL = f"""s AS (SELECT config, item_id, metric,
  CASE WHEN (item_id + c * 3 + m) % 11 = 0 THEN 0 ELSE 1 + (item_id * 7 + c * 5 + m * 3) % 5 END AS score
  FROM benchmark, (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(JUDGED))}) a(config, c),
    (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(METRIC_NAMES))}) b(metric, m))"""


@query(
    "config_accuracy_from_cache",
    f"""WITH {SCORE_SQL}, o AS (SELECT config, item_id, count(*) FILTER (WHERE score >= 4) >= 2 AS ox FROM s GROUP BY ALL)
    SELECT config, coalesce(accuracy, 0) AS accuracy
    FROM (SELECT unnest({JUDGED + [UNJUDGED]}) AS config) LEFT JOIN
      (SELECT config, count(*) FILTER (WHERE ox)::DOUBLE / (SELECT count(*) FROM benchmark) AS accuracy FROM o GROUP BY config) USING (config)""",
)
def config_accuracy_from_cache(spark, sf_dir):
    """One tiny file per score to the accuracy of each configuration, 0.0 where none was judged."""
    asked = questions(spark, sf_dir)
    one = lambda names: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("i")) for i, n in enumerate(names)]))
    rows = asked.select("qid", one(JUDGED).alias("c")).select("*", one(METRIC_NAMES).alias("m"))
    empty = (F.col("qid") + F.col("c.i") * 3 + F.col("m.i")) % 11 == 0
    value = F.when(empty, "").otherwise((1 + (F.col("qid") * 7 + F.col("c.i") * 5 + F.col("m.i") * 3) % 5).cast("string"))
    name = F.concat(F.concat_ws("_", "c.name", ids.qid(F.col("qid")), "m.name"), F.lit(".txt"))
    path = scratch_path(spark, "scores")
    writers.write_named(rows.select(name.alias("name"), value.alias("value")), path)
    scores = readers.score_cache(spark, path)
    judged = scores.groupBy("config", "qid").agg((F.count_if(F.col("score") >= votes.THRESHOLD) >= votes.NEEDED).alias("o"))
    n = asked.agg(F.count(F.lit(1)))
    accuracy = judged.groupBy("config").agg(F.count_if("o").alias("o")).select("config", (F.col("o") / n.scalar()).alias("accuracy"))
    summary = spark.createDataFrame([(c,) for c in JUDGED + [UNJUDGED]], "config string")
    return grid.with_accuracy(summary, accuracy)


# --- pages ------------------------------------------------------------------


def _texts(data):
    text = data.decode("utf-8")
    if text.startswith("!"):
        raise ValueError("damaged")
    return text.split("\f")


@query(
    "source_page_files",
    r"""WITH p AS (SELECT lang, doc_id // 100 AS part, row_number() OVER (PARTITION BY lang, doc_id // 100 ORDER BY doc_id) AS page,
      regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS text FROM documents)
    SELECT lang AS folder, part, page, md5(text) AS digest, false AS failed FROM p WHERE text <> '' AND part % 5 <> 3
    UNION ALL SELECT DISTINCT lang, part, NULL, NULL, true FROM p WHERE part % 5 = 3""",
)
def source_page_files(spark, sf_dir):
    """Page files in nested folders, found by walking them; a file that cannot be read is one error row."""
    path = scratch_path(spark, "pages")
    part = F.floor(F.col("doc_id") / 100)
    rows = table(spark, sf_dir, "documents").select("lang", part.alias("part"), "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    pages = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    files = rows.groupBy("lang", "part").agg(F.array_join(pages, "\f").alias("body"))
    name = F.concat("lang", F.lit("/"), F.col("part").cast("string"), F.lit(".page"))
    body = F.when(F.col("part") % 5 == 3, F.concat(F.lit("!"), "body")).otherwise(F.col("body"))
    writers.write_named(files.select(name.alias("name"), body.alias("value")), path)
    found = loaders.load_pages(spark, path, _texts, "*.page")
    part = lambda i: F.regexp_extract("file", r"([^/]+)/(\d+)\.page$", i)
    return found.select(
        part(1).alias("folder"), part(2).cast("bigint").alias("part"), F.col("page").cast("bigint").alias("page"),
        F.md5("text").alias("digest"), F.col("error").isNotNull().alias("failed"),
    )


# --- tables, settings, reports ----------------------------------------------


@query("source_optional_table", "SELECT 'labels' AS source, doc_id, quality FROM labels")
def source_optional_table(spark, sf_dir):
    """Tables that may be missing; those that are there are read."""
    found = {name: readers.parquet_or_none(spark, f"{sf_dir}/{name}.parquet") for name in ("labels", "labels_of_last_year")}
    out = None
    for name, df in found.items():
        if df is not None:
            rows = df.select(F.lit(name).alias("source"), "doc_id", "quality")
            out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "source_settings",
    "SELECT 'KEY_' || item_id AS key, 'a=' || length(text) AS value FROM benchmark WHERE item_id % 4 NOT IN (1, 2)",
)
def source_settings(spark, sf_dir):
    """Environment lines with comments and lines without a value between them."""
    path = scratch_path(spark, "settings")
    line = F.concat(F.lit("KEY_"), F.col("qid").cast("string"), F.lit(" = a="), F.length("text").cast("string"))
    line = F.when(F.col("qid") % 4 == 1, F.concat(F.lit("# "), line)).when(F.col("qid") % 4 == 2, F.lit("=x")).otherwise(line)
    questions(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.settings(spark, path)


@query(
    "sink_request_shards",
    """SELECT printf('shard-%05d.jsonl', (row_number() OVER (ORDER BY conv_id, turn) - 1) // 100) AS shard, conv_id, turn, md5(text) AS prompt
    FROM conversations""",
)
def sink_request_shards(spark, sf_dir):
    """Request lines in numbered shards of a hundred, filled across tasks, read back by their manifest."""
    path = scratch_path(spark, "request-shards")
    cid = F.format_string("c%d::%d", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations")
    line = chat_request(cid, F.lit("m"), F.col("text"), 10).alias("line")
    writers.write_shards(rows.select("conv_id", "turn", line), "line", path, "conv_id", "turn", size=100)
    schema = "custom_id string, body struct<messages: array<struct<role: string, content: string>>>"
    read = writers.read_shards(spark, path).select("name", F.from_json("value", schema).alias("r"))
    part = lambda i: F.regexp_extract("r.custom_id", r"^c(\d+)::(\d+)$", i).cast("bigint")
    prompt = F.md5(F.get("r.body.messages", 0)["content"])
    return read.select(F.col("name").alias("shard"), part(1).alias("conv_id"), part(2).alias("turn"), prompt.alias("prompt"))


@query("sink_json_result", "SELECT lang, count(*) AS n, max(n_chars) FILTER (WHERE lang <> 'en') AS longest FROM documents GROUP BY lang")
def sink_json_result(spark, sf_dir):
    """A summary as JSON with its empty fields, read back."""
    path = scratch_path(spark, "summary-json")
    longest = F.max(F.when(F.col("lang") != "en", F.col("n_chars")))
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), longest.alias("longest"))
    writers.write_json(rows, path)
    return spark.read.schema("lang string, n bigint, longest bigint").json(path)


@query(
    "report_markdown",
    """WITH t AS (SELECT source, lang, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (ORDER BY source, lang) + 2 AS line FROM t)
    SELECT 1 AS line, '| source | lang | n | mean |' AS text UNION ALL SELECT 2, '| --- | --- | --- | --- |'
    UNION ALL SELECT line, '| ' || source || ' | ' || lang || ' | ' || n || ' | ' || format('{:.4f}', mean) || ' |' FROM o""",
)
def report_markdown(spark, sf_dir):
    """A report table as numbered lines, of any length."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean")
    )
    return writers.markdown_lines(rows, "source", "lang")


@query("text_prefix_500", "SELECT doc_id, md5(substring(text, 1, 500)) AS digest FROM documents")
def text_prefix_500(spark, sf_dir):
    """The prefix an embedder is sent: the cut is the operator here, nothing else reads it."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.prefix(F.col("text"), 500)).alias("digest"))


# --- jobs -------------------------------------------------------------------


@query(
    "unique_request_ids",
    r"""WITH r AS (SELECT item_id AS qid, metric, repeat('model/x:', 8) || '__q' || item_id || '__' || metric AS raw,
      regexp_replace(repeat('model/x:', 8) || '__q' || item_id || '__' || metric, '[^a-zA-Z0-9_-]', '_', 'g') AS safe
      FROM benchmark, (SELECT unnest(['similarity', 'correctness']) AS metric))
    SELECT qid, metric, CASE WHEN raw = safe AND length(raw) <= 64 THEN raw ELSE substring(safe, 1, 47) || '_' || substring(md5(raw), 1, 16) END AS id
    FROM r""",
)
def unique_request_ids(spark, sf_dir):
    """Ids of long names in the allowed letters that stay apart."""
    asked = questions(spark, sf_dir).select("qid", F.explode(F.array(F.lit("similarity"), F.lit("correctness"))).alias("metric"))
    raw = ids.request_id(F.lit("model/x:" * 8), F.concat(F.lit("q"), F.col("qid").cast("string")), F.col("metric"))
    return asked.select("qid", "metric", ids.unique_safe_id(raw).alias("id"))


@query(
    "judge_work_places",
    f"""SELECT printf('q%04d', item_id) AS qid, metric, judge,
      row_number() OVER (ORDER BY printf('q%04d', item_id), metric, judge) AS place
    FROM benchmark, (SELECT unnest({METRIC_NAMES}) AS metric), (SELECT unnest({JUDGES}) AS judge)""",
)
def judge_work_places(spark, sf_dir):
    """Judge calls with an equal prompt head side by side, and each call's place."""
    one = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
    jobs = questions(spark, sf_dir).select(ids.qid(F.col("qid")).alias("qid"), one(METRIC_NAMES).alias("metric"))
    jobs = jobs.select("*", one(JUDGES).alias("judge"))
    return votes.placed(votes.work_order(jobs, "qid", "metric", "judge"))


SUBSET = {"cands": CANDIDATES[2:5], "judges": JUDGES[:2]}


@query(
    "accuracy_of_subset",
    f"""WITH {VOTES_SQL} SELECT cand, judge, count(*) FILTER (WHERE ox = 'O') AS o, count(*) AS n FROM cells
    WHERE cand IN {_in_sql(SUBSET['cands'])} AND judge IN {_in_sql(SUBSET['judges'])} GROUP BY cand, judge""",
)
def accuracy_of_subset(spark, sf_dir):
    """Counts of chosen candidates and judges; the choice is made before anything is aggregated."""
    chosen = votes.subset(all_votes(spark, sf_dir), **SUBSET)
    return votes.with_missing_policy(votes.ox_cells(chosen, cell=CELL), "complete").groupBy("cand", "judge").agg(
        F.count_if(F.col("ox") == "O").alias("o"), F.count(F.lit(1)).alias("n")
    )

"""Judge text, ids, provider replies and list parsing on derived strings."""

from pyspark.sql import functions as F

from rankforge.functions import envelopes as E
from rankforge.functions import ids as I
from rankforge.functions import scores as S
from rankforge.functions import text as X
from rankforge.plans.registry import query
from rankforge.session import table

REPLIES_SQL = """
n AS (SELECT event_id, 1 + (event_id * 7) % 5 AS s, 1 + (event_id * 3) % 5 AS r FROM events),
replies AS (
  SELECT event_id,
    CASE event_id % 10 WHEN 0 THEN 'Score: ' || s || '/5' WHEN 1 THEN '<think>3</think> ' || s
      WHEN 2 THEN '점수' || s || '점' WHEN 3 THEN s::VARCHAR WHEN 4 THEN '' WHEN 5 THEN 'no rating'
      WHEN 6 THEN '10' WHEN 7 THEN '<think>only 2</think>' WHEN 8 THEN s || '점 ' || r ELSE 'rating 7.' END AS content,
    CASE WHEN event_id % 3 = 0 THEN 'so ' || r ELSE '' END AS reasoning
  FROM n)"""


def replies(spark, sf_dir):
    """Judge replies of ten shapes rendered from event numbers."""
    e = F.col("event_id")
    s, r = [(1 + (e * k) % 5).cast("string") for k in (7, 3)]
    shapes = [
        F.concat(F.lit("Score: "), s, F.lit("/5")), F.concat(F.lit("<think>3</think> "), s),
        F.concat(F.lit("점수"), s, F.lit("점")), s, F.lit(""), F.lit("no rating"), F.lit("10"),
        F.lit("<think>only 2</think>"), F.concat(s, F.lit("점 "), r), F.lit("rating 7."),
    ]
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.element_at(F.array(*shapes), (e % 10 + 1).cast("int")).alias("content"),
        F.when(e % 3 == 0, F.concat(F.lit("so "), r)).otherwise("").alias("reasoning"),
    )


LONE = "list_filter(string_split(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' '), lambda t: t IN ('1','2','3','4','5'))[-1]::INT"
LAST = "coalesce(" + LONE + ", try_cast(regexp_extract({0}, '(?s).*([1-5])', 1) AS INT), 0)"


@query(
    "score_extract_canonical",
    f"""WITH {REPLIES_SQL} SELECT event_id, coalesce(nullif({LAST.format('content')}, 0),
      nullif({LAST.format("regexp_replace(content, '(?s)<think>.*?</think>', '', 'g')")}, 0), {LAST.format('reasoning')})::INT AS score
    FROM replies""",
)
def score_extract_canonical(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", S.extract_score(F.col("content"), F.col("reasoning")).alias("score"))


@query("score_extract_last_null", f"WITH {REPLIES_SQL} SELECT event_id, {LONE.format('content')} AS score FROM replies")
def score_extract_last_null(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", S.last_lone_score(F.col("content")).alias("score"))


@query(
    "score_extract_first",
    f"WITH {REPLIES_SQL} SELECT event_id, coalesce(try_cast(regexp_extract(content, '[1-5]', 0) AS INT), 0) AS score FROM replies",
)
def score_extract_first(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", S.first_score(F.col("content")).alias("score"))


@query(
    "score_extract_anydigit",
    f"WITH {REPLIES_SQL} SELECT event_id, coalesce(try_cast(regexp_extract(content, '[0-9]', 0) AS INT), 0) AS score FROM replies",
)
def score_extract_anydigit(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", S.first_digit(F.col("content")).alias("score"))


@query(
    "strip_think",
    f"WITH {REPLIES_SQL} SELECT event_id, trim(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g')) AS answer FROM replies",
)
def strip_think(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", X.strip_think(F.col("content")).alias("answer"))


BITS_SQL = """
bits AS (SELECT event_id, event_id % 2 AS a, event_id // 2 % 2 AS b, event_id // 4 % 2 AS c FROM events),
lists AS (SELECT event_id, a, b, c,
  CASE event_id % 7
    WHEN 0 THEN 'verdicts: [' || a || ', ' || b || ', ' || c || '] done'
    WHEN 1 THEN '```json' || chr(10) || '[' || a || ', ' || b || ', ' || c || ', 1]' || chr(10) || '```'
    WHEN 2 THEN '[true, false, ' || c || ']'
    WHEN 3 THEN 'no array' WHEN 4 THEN '[]' WHEN 5 THEN '[1, "x", ' || a || ']'
    ELSE '[' || a || ', 0, ' || c || ', ' || b || ', 1]' END AS reply FROM bits),
vd AS (SELECT event_id, json_extract(j, '$[*]') AS items FROM (
  SELECT event_id, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM (
    SELECT event_id, nullif(regexp_extract(reply, '(?s)\\[.*\\]', 0), '') AS x FROM lists))),
flags AS (SELECT event_id, CASE WHEN len(list_filter(items, lambda i: json_type(i) NOT IN ('BOOLEAN', 'UBIGINT', 'BIGINT'))) = 0
  THEN list_transform(items, lambda i: CASE WHEN i::VARCHAR IN ('true', '1') THEN 1 ELSE 0 END) END AS v FROM vd)"""


def verdict_replies(spark, sf_dir):
    e = F.col("event_id")
    a, b, c = [(F.floor(e / k) % 2).cast("string") for k in (1, 2, 4)]
    j = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    shapes = [
        j("verdicts: [", a, ", ", b, ", ", c, "] done"),
        j("```json\n[", a, ", ", b, ", ", c, ", 1]\n```"),
        j("[true, false, ", c, "]"),
        F.lit("no array"), F.lit("[]"), j('[1, "x", ', a, "]"),
        j("[", a, ", 0, ", c, ", ", b, ", 1]"),
    ]
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*shapes), (e % 7 + 1).cast("int")).alias("reply"))


@query("json_array_verdicts", f"WITH {BITS_SQL} SELECT event_id, array_to_string(v, ',') AS verdicts FROM flags")
def json_array_verdicts(spark, sf_dir):
    v = S.verdicts(F.col("reply"))
    return verdict_replies(spark, sf_dir).select("event_id", F.array_join(v.cast("array<string>"), ",").alias("verdicts"))


@query(
    "context_precision",
    f"""WITH {BITS_SQL}, p AS (SELECT event_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM flags),
    r AS (SELECT event_id, i, x, sum(x) OVER (PARTITION BY event_id ORDER BY i) AS h FROM p),
    ap AS (SELECT event_id, coalesce(sum(h::DOUBLE / i) FILTER (WHERE x = 1) / nullif(sum(x), 0), 0) AS s FROM r GROUP BY event_id)
    SELECT event_id, CASE WHEN v IS NOT NULL THEN round(coalesce(s, 0), 9) END AS precision
    FROM flags LEFT JOIN ap USING (event_id)""",
)
def context_precision(spark, sf_dir):
    score = F.round(S.average_precision(S.verdicts(F.col("reply"))), 9)
    return verdict_replies(spark, sf_dir).select("event_id", score.alias("precision"))


@query(
    "context_recall",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL
      ELSE (event_id % 2 + event_id // 2 % 2)::DOUBLE / (2 + event_id % 5 % 2) END AS recall FROM events""",
)
def context_recall(spark, sf_dir):
    """Share of supported statements; replies without a list have none."""
    return statement_replies(spark, sf_dir).select("event_id", S.supported_share(F.col("reply")).alias("recall"))


def statement_replies(spark, sf_dir):
    e = F.col("event_id")
    said = lambda flag: F.struct(F.lit("s").alias("statement"), flag.alias("supported"))
    two = F.array(said(e % 2 == 1), said(F.floor(e / 2) % 2 == 1))
    items = F.when(e % 5 % 2 == 1, F.concat(two, F.array(said(F.lit(False))))).otherwise(two)
    reply = F.when(e % 5 == 4, "I cannot tell").otherwise(F.concat(F.lit("```json\n"), F.to_json(items), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


@query(
    "ragas_summary",
    f"""WITH {BITS_SQL}, p AS (SELECT event_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM flags),
    r AS (SELECT event_id, i, x, sum(x) OVER (PARTITION BY event_id ORDER BY i) AS h FROM p),
    ap AS (SELECT event_id, coalesce(sum(h::DOUBLE / i) FILTER (WHERE x = 1) / nullif(sum(x), 0), 0) AS s FROM r GROUP BY event_id),
    q AS (SELECT event_type, CASE WHEN v IS NOT NULL THEN coalesce(s, 0) END AS p,
      CASE WHEN event_id % 5 <> 4 THEN (event_id % 2 + event_id // 2 % 2)::DOUBLE / (2 + event_id % 5 % 2) END AS c
      FROM flags LEFT JOIN ap USING (event_id) JOIN events USING (event_id))
    SELECT event_type AS system, count(*) AS total, round(avg(p), 9) AS precision_avg, round(avg(c), 9) AS recall_avg,
      count(p) AS precision_n, count(c) AS recall_n FROM q GROUP BY event_type""",
)
def ragas_summary(spark, sf_dir):
    """Means over the readable replies of each system."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    rows = e.join(context_precision(spark, sf_dir), "event_id").join(context_recall(spark, sf_dir), "event_id")
    return rows.groupBy(F.col("event_type").alias("system")).agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.avg("precision"), 9).alias("precision_avg"),
        F.round(F.avg("recall"), 9).alias("recall_avg"),
        F.count("precision").alias("precision_n"),
        F.count("recall").alias("recall_n"),
    )


# --- list replies -----------------------------------------------------------

PREFIX = r"^[\-\*\d\.\)\s]+"


def list_replies(spark, sf_dir):
    """Conversation turns as numbered or bulleted lists of their words."""
    words = F.split("text", r"\s+")
    lines = F.transform(
        words,
        lambda w, i: F.concat(F.when(i % 3 == 0, F.concat((i + 1).cast("string"), F.lit(". "))).when(i % 3 == 1, "- ").otherwise("  "), w),
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array_join(lines, "\n").alias("reply"))


LINES_SQL = f"""
rep AS (SELECT conv_id, turn, text, array_to_string(list_transform(regexp_split_to_array(text, '\\s+'),
  lambda w, i: CASE (i - 1) % 3 WHEN 0 THEN i || '. ' WHEN 1 THEN '- ' ELSE '  ' END || w), chr(10)) AS reply FROM conversations),
items AS (SELECT *, list_transform(list_filter(list_transform(string_split({{}}, {{}}), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: trim(regexp_replace(x, '{PREFIX}', ''))) AS it FROM rep)"""


@query(
    "parse_lines",
    f"""WITH {LINES_SQL.format('reply', 'chr(10)')},
    k AS (SELECT conv_id, turn, list_filter(it, lambda x: length(x) > 2)[1:3] AS k, text FROM items)
    SELECT conv_id, turn, array_to_string(k || list_transform(range(3 - len(k)), lambda i: 'fallback'), '|') AS lines FROM k""",
)
def parse_lines(spark, sf_dir):
    kept = X.parse_lines(F.col("reply"), 3, F.lit("fallback"))
    return list_replies(spark, sf_dir).select("conv_id", "turn", F.array_join(kept, "|").alias("lines"))


@query(
    "parse_keywords",
    f"""WITH {LINES_SQL.format("replace(reply, chr(10), ',')", "','")}
    SELECT conv_id, turn, array_to_string(list_filter(it, lambda x: length(x) > 1 AND length(x) < 30)[1:5], '|') AS keywords FROM items""",
)
def parse_keywords(spark, sf_dir):
    return list_replies(spark, sf_dir).select("conv_id", "turn", F.array_join(X.parse_keywords(F.col("reply")), "|").alias("keywords"))


# --- ids --------------------------------------------------------------------


@query(
    "custom_id_roundtrip",
    r"""WITH b AS (SELECT conv_id, turn, printf('q%03d', conv_id * 37) AS qid,
        'org/model-' || (conv_id % 7) || '.5:' || role AS model, ['similarity', 'correctness'][turn % 2 + 1] AS metric FROM conversations),
    i AS (SELECT *, model || '__' || qid || '__' || metric AS rid FROM b)
    SELECT conv_id, turn, left(regexp_replace(rid, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS safe, model AS tail_model, qid AS tail_qid,
      metric AS tail_metric, model AS colon_model, qid AS colon_qid, metric AS colon_metric,
      substr(qid, 2) AS lazy_number, replace(model, ':', '_') AS restored,
      coalesce(nullif(regexp_extract('item ' || CASE WHEN turn % 2 = 0 THEN qid ELSE 'none' END, 'q\d{3,}', 0), ''), printf('q%03d', turn)) AS normal_qid,
      model || '::' || qid AS key_rest
    FROM i""",
)
def custom_id_roundtrip(spark, sf_dir):
    """Request ids of every format built and read back."""
    b = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        I.qid(F.col("conv_id") * 37, 3).alias("qid"),
        F.concat(F.lit("org/model-"), (F.col("conv_id") % 7).cast("string"), F.lit(".5:"), "role").alias("model"),
        F.when(F.col("turn") % 2 == 0, "similarity").otherwise("correctness").alias("metric"),
    )
    rid = I.request_id(F.col("model"), F.col("qid"), F.col("metric"))
    colon = F.concat_ws("::", "model", "qid", "metric")
    dotless = F.regexp_replace("model", "[.:]", "_")
    raw = F.concat(F.lit("item "), F.when(F.col("turn") % 2 == 0, F.col("qid")).otherwise("none"))
    return b.select(
        "conv_id",
        "turn",
        I.safe_id(rid).alias("safe"),
        *I.parsed(rid, I.UNDERSCORE_ID, "tail_model", "tail_qid", "tail_metric"),
        *I.parsed(colon, I.COLON_ID, "colon_model", "colon_qid", "colon_metric"),
        I.parsed(rid, I.LAZY_ID, "m", "lazy_number")[1],
        I.restore_dots(dotless).alias("restored"),
        I.normalize_qid(raw, F.col("turn")).alias("normal_qid"),
        F.get(I.key_parts(F.concat_ws("::", F.lit("gen"), "model", "qid"), 2), 1).alias("key_rest"),
    )


@query(
    "safe_id_reverse",
    r"""WITH b AS (SELECT DISTINCT 'org/model-' || source || ':' || lang AS model FROM documents),
    s AS (SELECT model, left(regexp_replace(model, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS safe FROM b)
    SELECT doc_id, 'org/model-' || source || ':' || lang AS model, left(regexp_replace('org/model-' || source || ':' || lang, '[^a-zA-Z0-9_-]', '_', 'g'), 64) AS safe FROM documents""",
)
def safe_id_reverse(spark, sf_dir):
    """Safe ids mapped back to the ids they came from; unknown ones stay."""
    docs = table(spark, sf_dir, "documents")
    model = F.concat(F.lit("org/model-"), "source", F.lit(":"), "lang")
    # two models may share a safe id; like a dictionary, the map holds one
    known = docs.groupBy(I.safe_id(model).alias("safe")).agg(F.max(model).alias("model"))
    return (
        docs.select("doc_id", I.safe_id(model).alias("safe"))
        .join(known, "safe", "left")
        .select("doc_id", "safe", F.coalesce("model", "safe").alias("model"))
    )


# --- provider replies -------------------------------------------------------


@query(
    "provider_chat",
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS content,
    CASE WHEN turn % 5 = 4 THEN 0 ELSE length(text) END AS prompt, CASE WHEN turn % 5 = 4 THEN 0 ELSE turn END AS completion,
    (CASE WHEN turn % 5 = 4 OR turn % 2 = 1 THEN 0 ELSE conv_id END)::BIGINT AS cached FROM conversations""",
)
def provider_chat(spark, sf_dir):
    """Chat replies written as JSON and read back; errors give empty text."""
    failed = F.col("turn") % 5 == 4
    usage = F.struct(
        F.length("text").alias("prompt_tokens"),
        F.col("turn").alias("completion_tokens"),
        F.when(F.col("turn") % 2 == 0, F.struct(F.col("conv_id").alias("cached_tokens"))).alias("prompt_tokens_details"),
    )
    body = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"), usage.alias("usage"))
    line = F.to_json(
        F.struct(
            F.format_string("c%d", "conv_id").alias("custom_id"),
            F.when(failed, "server error").alias("error"),
            F.when(~failed, F.struct(body.alias("body"))).alias("response"),
        )
    )
    u = E.chat_usage(F.col("line"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).select(
        "conv_id", "turn", E.chat_text(F.col("line")).alias("content"),
        u["prompt"].alias("prompt"), u["completion"].alias("completion"), u["cached"].alias("cached"),
    )


@query(
    "provider_responses",
    """SELECT conv_id, turn, 'r' || role || text || '!' AS all_text, role || text || '!' AS message_text,
    CASE WHEN turn % 3 = 2 THEN 'chat' ELSE role END AS first_text FROM conversations""",
)
def provider_responses(spark, sf_dir):
    """Output blocks: all, message blocks only, or the first with a chat fallback."""
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    block = lambda kind, *parts: F.struct(F.lit(kind).alias("type"), F.array(*parts).alias("content"))
    out = F.array(
        block("reasoning", part("output_text", F.lit("r"))),
        block("message", part("output_text", F.col("role")), part("refusal", F.lit("x"))),
        block("message", part("output_text", F.col("text")), part("output_text", F.lit("!"))),
    )
    wrap = lambda o, chat: F.to_json(
        F.struct(F.struct(F.struct(o.alias("output"), chat.alias("choices")).alias("body")).alias("response"))
    )
    chat = F.array(F.struct(F.struct(F.lit("chat").alias("content")).alias("message")))
    line = wrap(out, chat)
    # every third reply has no output blocks at all
    first = wrap(F.when(F.col("turn") % 3 != 2, out), chat)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"), first.alias("first")).select(
        "conv_id", "turn", E.responses_text(F.col("line")).alias("all_text"),
        E.responses_text(F.col("line"), "message").alias("message_text"),
        E.responses_text(F.col("first"), "first").alias("first_text"),
    )


@query(
    "provider_messages",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE role || text END AS all_text,
    CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS first_text FROM conversations""",
)
def provider_messages(spark, sf_dir):
    line = _message_line()
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).select(
        "conv_id", "turn", E.messages_text(F.col("line")).alias("all_text"), E.messages_text(F.col("line"), "first").alias("first_text")
    )


def _message_line():
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    content = F.array(part("thinking", F.lit("hm")), part("text", F.col("role")), part("text", F.col("text")))
    usage = F.struct(
        F.col("turn").alias("input_tokens"),
        F.when(F.col("turn") % 2 == 0, F.col("conv_id")).alias("cache_read_input_tokens"),
        F.length("role").cast("bigint").alias("cache_creation_input_tokens"),
    )
    result = F.struct(
        F.when(F.col("turn") % 4 == 3, "errored").otherwise("succeeded").alias("type"),
        F.struct(content.alias("content"), usage.alias("usage")).alias("message"),
    )
    return F.to_json(F.struct(F.format_string("c%d", "conv_id").alias("custom_id"), result.alias("result")))


@query(
    "cache_read_ratio",
    """WITH u AS (SELECT role, sum(CASE WHEN turn % 2 = 0 THEN conv_id ELSE 0 END)::BIGINT AS cached,
      sum(turn + CASE WHEN turn % 2 = 0 THEN conv_id ELSE 0 END + length(role))::BIGINT AS total FROM conversations GROUP BY role)
    SELECT role, cached, total, round(cached::DOUBLE / nullif(total, 0), 9) AS ratio, cached::DOUBLE / nullif(total, 0) < 0.3 AS low FROM u""",
)
def cache_read_ratio(spark, sf_dir):
    """Share of prompt tokens served from cache; below 0.3 is a warning."""
    cached, total = E.messages_cache_ratio(F.col("line"))
    sums = (
        table(spark, sf_dir, "conversations")
        .select("role", _message_line().alias("line"))
        .groupBy("role")
        .agg(F.sum(cached).alias("cached"), F.sum(total).alias("total"))
    )
    ratio = F.try_divide("cached", "total")
    return sums.withColumn("ratio", F.round(ratio, 9)).withColumn("low", ratio < 0.3)


@query(
    "provider_candidates",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN role ELSE text END AS content, length(text) AS prompt FROM conversations""",
)
def provider_candidates(spark, sf_dir):
    """First non-empty part or inline text; both spellings of the usage keys."""
    parts = F.array(F.struct(F.lit("").alias("text")), F.struct(F.col("text").alias("text")))
    cands = F.array(F.struct(F.struct(parts.alias("parts")).alias("content")))
    n = F.length("text")
    response = F.struct(
        F.when(F.col("turn") % 3 != 2, cands).alias("candidates"),
        F.col("role").alias("text"),
        F.when(F.col("turn") % 2 == 0, F.struct(n.alias("prompt_token_count"))).alias("usage_metadata"),
        F.when(F.col("turn") % 2 == 1, F.struct(n.alias("promptTokenCount"))).alias("usageMetadata"),
    )
    line = F.to_json(F.struct(F.format_string("c%d", "conv_id").alias("key"), response.alias("response")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).select(
        "conv_id", "turn", E.candidates_text(F.col("line")).alias("content"), E.candidates_prompt_tokens(F.col("line")).alias("prompt")
    )


@query(
    "provider_embeddings",
    "SELECT vec_id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS head, round(embedding[64]::DOUBLE, 6) AS other FROM embeddings",
)
def provider_embeddings(spark, sf_dir):
    """Embedding replies whose items come out of order."""
    item = lambda i, v: F.struct(F.lit(i).alias("index"), v.alias("embedding"))
    v = F.col("embedding").cast("array<double>")
    body = F.struct(F.array(item(1, F.reverse(v)), item(0, v)).alias("data"))
    line = F.to_json(F.struct(F.lit("e").alias("custom_id"), F.struct(body.alias("body")).alias("response")))
    vectors = E.embedding_vectors(F.col("line"))
    return table(spark, sf_dir, "embeddings").select("vec_id", line.alias("line")).select(
        "vec_id", F.size(F.get(vectors, 0)).alias("dim"),
        F.round(F.get(F.get(vectors, 0), 0), 6).alias("head"), F.round(F.get(F.get(vectors, 1), 0), 6).alias("other"),
    )

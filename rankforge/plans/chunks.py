"""Chunkers over whole documents and text of web pages."""

from pyspark.sql import functions as F

from rankforge.functions import text as X
from rankforge.models import hash_embedder
from rankforge.operators import chunking as C
from rankforge.operators.table_functions import pack_sentences, register_chunker
from rankforge.operators.tokens import token_window_chunks
from rankforge.plans.common import documents, tokens_sql
from rankforge.plans.registry import query
from rankforge.session import spread, table
from rankforge.sources.html import html_text
from rankforge.sources.loaders import split_pages


def out(df):
    """Chunk place, length and digest: enough to compare whole texts."""
    return df.select(
        "doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest")
    )


def chunked(spark, sf_dir, chunks, text=None):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", (F.col("text") if text is None else text).alias("body"))
    return out(C.exploded(docs, chunks(F.col("body")), ["doc_id"]))


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
OUT_SQL = "length(text) AS n_chars, md5(text) AS digest"
# a fold as recursion: one step per piece, a chunk leaves when the next piece does not fit
FOLD_SQL = """fold AS (
  SELECT doc_id, 0 AS i, '' AS cur, NULL::VARCHAR AS emitted, p FROM parts
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN i = len(p) THEN '' WHEN length(cur) + length(p[i + 1]) + 1 <= {size}
      THEN CASE WHEN cur = '' THEN p[i + 1] ELSE cur || {glue} || p[i + 1] END ELSE {restart} END,
    CASE WHEN i = len(p) OR length(cur) + length(p[i + 1]) + 1 > {size} THEN cur END, p
  FROM fold WHERE i <= len(p))"""
NUMBERED = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, " + OUT_SQL


@query(
    "chunk_paragraph_pack",
    f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
    parts AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p
      FROM d WHERE length(text) > 1000),
    {FOLD_SQL.format(size=1000, glue="chr(10) || chr(10)", restart='p[i + 1]')},
    chunks AS (SELECT doc_id, i, emitted AS text FROM fold WHERE length(emitted) >= 50
      UNION ALL SELECT doc_id, 0, text FROM d WHERE length(text) BETWEEN 50 AND 1000)
    {NUMBERED} FROM chunks""",
)
def chunk_paragraph_pack(spark, sf_dir):
    """Documents with each line a paragraph, packed to 1000 characters."""
    return chunked(spark, sf_dir, C.paragraph_chunks, F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))


SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


def sentence_sql(size, overlap):
    restart = f"CASE WHEN length(cur) > {overlap} THEN right(cur, {overlap}) || ' ' || p[i + 1] ELSE p[i + 1] END" if overlap else "p[i + 1]"
    return f"""WITH RECURSIVE parts AS (SELECT doc_id, {SENTENCES} AS p FROM documents),
    {FOLD_SQL.format(size=size, glue="' '", restart=restart)},
    chunks AS (SELECT doc_id, i, {STRIP.format('emitted')} AS text FROM fold WHERE emitted <> '')
    {NUMBERED} FROM chunks WHERE length(text) >= 30"""


@query("chunk_sentence_overlap", sentence_sql(500, 100))
def chunk_sentence_overlap(spark, sf_dir):
    return chunked(spark, sf_dir, C.sentence_chunks)


for size, overlap in [(300, 50), (800, 150), (1000, 200), (1500, 200), (500, 0)]:
    query(f"chunk_sentence_{size}_{overlap}", sentence_sql(size, overlap))(
        lambda spark, sf_dir, size=size, overlap=overlap: chunked(spark, sf_dir, lambda t: C.sentence_chunks(t, size, overlap))
    )


def merge_sql(size, overlap):
    """Packing with whole pieces repeated; the tail to keep is the longest that fits."""
    span = lambda l: f"length(array_to_string({l}, chr(10)))"
    added = lambda l: f"(CASE WHEN len({l}) > 0 THEN {span(l)} + 1 ELSE 0 END + length(p[i + 1]))"
    tail = f"""list_filter(list_transform(range(len(cur) + 1), lambda k: cur[k + 1 :]),
        lambda t: len(t) = 0 OR ({span('t')} <= {overlap} AND {added('t')} <= {size}))[1]"""
    return f"""WITH RECURSIVE parts AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM documents),
    fold AS (
      SELECT doc_id, 0 AS i, []::VARCHAR[] AS cur, NULL::VARCHAR AS emitted, p FROM parts
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN i = len(p) THEN [] WHEN len(cur) = 0 OR {added('cur')} <= {size} THEN list_append(cur, p[i + 1])
          ELSE list_append({tail}, p[i + 1]) END,
        CASE WHEN len(cur) > 0 AND (i = len(p) OR {added('cur')} > {size}) THEN array_to_string(cur, chr(10)) END, p
      FROM fold WHERE i <= len(p)),
    chunks AS (SELECT doc_id, i, {STRIP.format('emitted')} AS text FROM fold WHERE emitted IS NOT NULL)
    {NUMBERED} FROM chunks WHERE length(text) >= 30"""


@query("chunk_character", merge_sql(500, 100))
def chunk_character(spark, sf_dir):
    return chunked(spark, sf_dir, lambda t: C.character_chunks(t, 500, 100))


@query(
    "chunk_file_numbering",
    merge_sql(500, 100).replace(NUMBERED, """SELECT source || '-' || (doc_id // 20) AS file, doc_id AS page,
      row_number() OVER (PARTITION BY source, doc_id // 20 ORDER BY doc_id, i) - 1 AS chunk_index, length(text) AS n_chars, md5(text) AS digest""")
    .replace("FROM chunks WHERE", "FROM chunks JOIN documents d USING (doc_id) WHERE")
    .replace("WHERE length(text) >= 30", "WHERE length(chunks.text) >= 30")
    .replace("length(text) AS n_chars, md5(text)", "length(chunks.text) AS n_chars, md5(chunks.text)"),
)
def chunk_file_numbering(spark, sf_dir):
    """Documents as pages of files: chunk numbers run on from page to page."""
    pages = documents(spark, sf_dir, "doc_id", "source", "text").select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / 20).cast("string")).alias("file"), F.col("doc_id").alias("page"), "text"
    )
    chunks = C.numbered_by_file(pages, C.character_chunks(F.col("text"), 500, 100))
    return chunks.select("file", "page", "chunk_index", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    "chunk_token_window",
    f"""WITH t AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
    chunks AS (SELECT doc_id, k AS i, array_to_string(w[k * 206 + 1 : k * 206 + 256], ' ') AS text FROM (
      SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 256) / 206.0::DOUBLE), 0)::BIGINT + 1)) AS k FROM t))
    {NUMBERED} FROM chunks WHERE length(text) >= 30""",
)
def chunk_token_window(spark, sf_dir):
    return chunked(spark, sf_dir, lambda t: C.token_windows(X.tokenize_words(t)))


@query(
    "chunk_md_header",
    f"""WITH d AS (SELECT doc_id, regexp_replace(text, '\\n([^\\n]*)\\n', chr(10) || '## \\1' || chr(10), 'g') AS text FROM documents),
    l AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), chr(10)) AS text FROM d),
    s AS (SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '(?m)^#{{1,3}} .*$', chr(1), 'g'), chr(1)),
      lambda x: regexp_replace({STRIP.format('x')}, '\\n\\n+', '  ' || chr(10), 'g'))) AS text,
      generate_subscripts(string_split(regexp_replace(text, '(?m)^#{{1,3}} .*$', chr(1), 'g'), chr(1)), 1) AS i FROM l)
    {NUMBERED} FROM s WHERE length(text) >= 30""",
)
def chunk_md_header(spark, sf_dir):
    """Every second line turned into a heading, then cut at headings."""
    return chunked(spark, sf_dir, C.heading_chunks, F.regexp_replace("text", r"\n([^\n]*)\n", "\n## $1\n"))


def recursive_sql(size, overlap):
    """Level by level: pieces of open texts, runs of short ones, long ones to the next separator."""
    steps, runs = [], []
    for i, sep in enumerate(["chr(10) || chr(10)", "chr(10)", "' '", "''"]):
        pieces = f"string_split(text, {sep})" if i < 3 else "string_split(text, '')"
        has = f"contains(text, {sep})" if i < 3 else "true"
        steps.append(f"""cut{i} AS (SELECT doc_id, path, k, CASE WHEN k = 1 OR {i} = 3 THEN x ELSE {sep} || x END AS x FROM (
    SELECT doc_id, path, unnest({pieces}) AS x, generate_subscripts({pieces}, 1) AS k FROM open{i} WHERE {has})),
  piece{i} AS (SELECT *, length(x) >= {size} AS long, sum((length(x) >= {size})::INT) OVER (PARTITION BY doc_id, path ORDER BY k) AS run
    FROM cut{i} WHERE x <> ''),
  open{i + 1} AS (SELECT doc_id, list_append(path, k) AS path, x AS text FROM piece{i} WHERE long
    UNION ALL SELECT doc_id, path, text FROM open{i} WHERE NOT {has})""")
        runs.append(f"SELECT doc_id, list_append(path, min(k)) AS path, list(x ORDER BY k) AS p FROM piece{i} WHERE NOT long GROUP BY doc_id, path, run")
    total = lambda l: f"length(array_to_string({l}, ''))"
    tail = f"""list_filter(list_transform(range(len(cur) + 1), lambda k: cur[k + 1 :]),
        lambda t: len(t) = 0 OR ({total('t')} <= {overlap} AND {total('t')} + length(p[i + 1]) <= {size}))[1]"""
    full = f"len(cur) > 0 AND {total('cur')} + length(p[i + 1]) > {size}"
    return f"""WITH RECURSIVE open0 AS (SELECT doc_id, []::BIGINT[] AS path, text FROM documents), {", ".join(steps)},
    runs AS ({" UNION ALL ".join(runs)} UNION ALL SELECT doc_id, path, [text] FROM open4),
    fold AS (
      SELECT doc_id, path, 0 AS i, []::VARCHAR[] AS cur, NULL::VARCHAR AS emitted, p FROM runs
      UNION ALL
      SELECT doc_id, path, i + 1, CASE WHEN i = len(p) THEN [] WHEN {full} THEN list_append({tail}, p[i + 1]) ELSE list_append(cur, p[i + 1]) END,
        CASE WHEN (i = len(p) AND len(cur) > 0) OR (i < len(p) AND {full}) THEN array_to_string(cur, '') END, p
      FROM fold WHERE i <= len(p)),
    chunks AS (SELECT doc_id, path, i, {STRIP.format('emitted')} AS text FROM fold WHERE emitted IS NOT NULL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path, i) - 1 AS chunk_index, {OUT_SQL} FROM chunks WHERE length(text) >= 30"""


def _refusing(text):
    """Sentence packing that refuses some pages."""
    if len(text) % 13 == 5:
        raise ValueError("page refused")
    return pack_sentences(500)(text)


@query(
    "chunk_table_function",
    f"""WITH RECURSIVE parts AS (SELECT doc_id, {SENTENCES} AS p FROM documents WHERE length(text) % 13 <> 5),
    {FOLD_SQL.format(size=500, glue="' '", restart="p[i + 1]")},
    chunks AS (SELECT doc_id, i, {STRIP.format('emitted')} AS text FROM fold WHERE emitted <> ''
      UNION ALL SELECT doc_id, 0, {STRIP.format('text')} FROM documents WHERE length(text) % 13 = 5)
    SELECT d.source || '-' || (doc_id // 50) AS file, doc_id AS page,
      row_number() OVER (PARTITION BY d.source, doc_id // 50 ORDER BY doc_id, i) - 1 AS chunk_index, length(c.text) AS n_chars, md5(c.text) AS digest
    FROM chunks c JOIN documents d USING (doc_id) WHERE length(c.text) >= 30""",
)
def chunk_table_function(spark, sf_dir):
    """Pages of files cut by a table function in SQL; pages whose splitter fails stay whole."""
    register_chunker(spark, "chunk", _refusing)
    documents(spark, sf_dir, "doc_id", "source", "text").select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / 50).cast("string")).alias("file"), F.col("doc_id").alias("page"), "text"
    ).createOrReplaceTempView("pages_of_files")
    found = spark.sql("SELECT * FROM chunk(TABLE(pages_of_files) PARTITION BY file ORDER BY page)")
    return found.select("file", "page", "chunk_index", F.length("chunk").cast("bigint").alias("n_chars"), F.md5("chunk").alias("digest"))


#: Where the public rank table lies on the driver.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query("chunk_bpe_window")
def chunk_bpe_window(spark, sf_dir, path=RANKS_PATH):
    """Windows of 256 merged tokens, 50 shared with the one before."""
    found = token_window_chunks(documents(spark, sf_dir, "doc_id", "text"), path)
    return out(found.withColumnRenamed("chunk", "text"))


# Sizes and overlaps of the splitters.
SIZES = [(300, 50), (500, 100), (800, 150), (1000, 200), (1500, 200)]
for size, overlap in SIZES:
    query(f"chunk_recursive_{size}_{overlap}", recursive_sql(size, overlap))(
        lambda spark, sf_dir, size=size, overlap=overlap: chunked(spark, sf_dir, lambda t: C.recursive_chunks(t, size, overlap))
    )


SEMANTIC_SQL = f"""
st AS (SELECT doc_id, {SENTENCES} AS p FROM documents),
se AS (SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS pos FROM st),
cx AS (SELECT *, array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), ' ') AS ctx FROM se),
bk AS (SELECT doc_id, pos, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c
  FROM (SELECT doc_id, pos, unnest({tokens_sql('ctx')}) AS term FROM cx) GROUP BY ALL),
nm AS (SELECT doc_id, pos, sqrt(sum(c * c)) AS n FROM bk GROUP BY ALL),
dp AS (SELECT a.doc_id, a.pos, sum(a.c * b.c) AS dot FROM bk a JOIN bk b ON a.doc_id = b.doc_id AND a.b = b.b AND b.pos = a.pos + 1 GROUP BY ALL),
gp AS (SELECT s.doc_id, s.pos, s.sentence, CASE WHEN nx.pos IS NOT NULL
    THEN round(1 - coalesce(dp.dot / (n1.n * n2.n), 0), 9) END AS gap
  FROM se s LEFT JOIN se nx ON nx.doc_id = s.doc_id AND nx.pos = s.pos + 1
  LEFT JOIN nm n1 ON n1.doc_id = s.doc_id AND n1.pos = s.pos LEFT JOIN nm n2 ON n2.doc_id = s.doc_id AND n2.pos = s.pos + 1
  LEFT JOIN dp ON dp.doc_id = s.doc_id AND dp.pos = s.pos),
lm AS (SELECT doc_id, round(quantile_cont(gap, 0.95), 9) AS lim FROM gp GROUP BY doc_id),
ct AS (SELECT *, coalesce((lag(gap) OVER w > lim)::INT, 0) AS cut FROM gp JOIN lm USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
il AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM ct),
ch AS (SELECT doc_id, chunk, string_agg(sentence, ' ' ORDER BY pos) AS text FROM il GROUP BY ALL)"""


@query(
    "chunk_semantic",
    f"WITH {SEMANTIC_SQL} SELECT doc_id, chunk::BIGINT AS chunk_index, {OUT_SQL} FROM ch WHERE length({STRIP.format('text')}) >= 30",
)
def chunk_semantic(spark, sf_dir):
    """Sentences with one neighbour each side, cut at the 95th percentile distance."""
    return semantic(spark, sf_dir)


DEVIATION_SQL = SEMANTIC_SQL.replace("round(quantile_cont(gap, 0.95), 9)", "round(avg(gap) + stddev_pop(gap) * 1.5::DOUBLE, 9)")


@query(
    "chunk_semantic_deviation",
    f"WITH {DEVIATION_SQL} SELECT doc_id, chunk::BIGINT AS chunk_index, {OUT_SQL} FROM ch WHERE length({STRIP.format('text')}) >= 30",
)
def chunk_semantic_deviation(spark, sf_dir):
    """The same, cut at the mean distance plus one and a half deviations."""
    return semantic(spark, sf_dir, stdevs=1.5)


BUFFER_SQL = SEMANTIC_SQL.replace("1 PRECEDING AND 1 FOLLOWING", "2 PRECEDING AND 2 FOLLOWING")


@query(
    "chunk_semantic_buffer",
    f"WITH {BUFFER_SQL} SELECT doc_id, chunk::BIGINT AS chunk_index, {OUT_SQL} FROM ch WHERE length({STRIP.format('text')}) >= 30",
)
def chunk_semantic_buffer(spark, sf_dir):
    """Sentence vectors summed over two neighbours each side, cut at the 95th percentile distance."""
    return out(C.semantic_chunks(C.window_vectors(sentence_vectors(spark, sf_dir), buffer=2)).withColumnRenamed("chunk", "chunk_index"))


# the text of a word count by bucket as a vector, and the fold as recursion over the sentences
COUNTED_SQL = f"list_transform({tokens_sql('x')}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
DOT_SQL = "list_sum([z[1] * z[2] for z in list_zip({a}, {b})])"
NEAR_SQL = f"""round(coalesce({DOT_SQL.format(a="cur", b="v[i + 1]")}
    / nullif(sqrt({DOT_SQL.format(a="cur", b="cur")}) * sqrt({DOT_SQL.format(a="v[i + 1]", b="v[i + 1]")}), 0), 0), 9) >= 0.5::DOUBLE
  AND n + 1 + length(p[i + 1]) <= 500"""


@query(
    "chunk_semantic_threshold",
    f"""WITH RECURSIVE st AS (SELECT doc_id, {SENTENCES} AS p FROM documents),
    vs AS (SELECT doc_id, p, list_transform(list_transform(p, lambda x: {COUNTED_SQL}), lambda w: list_transform(range(64), lambda b: len(list_filter(w, lambda y: y = b))::DOUBLE)) AS v FROM st),
    fold AS (
      SELECT doc_id, 0 AS i, []::DOUBLE[] AS cur, 0 AS n, -1 AS chunk, p, v FROM vs
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN near THEN [z[1] + z[2] for z in list_zip(cur, v[i + 1])] ELSE v[i + 1] END,
        CASE WHEN near THEN n + 1 ELSE 0 END + length(p[i + 1]), CASE WHEN near THEN chunk ELSE chunk + 1 END, p, v
      FROM (SELECT *, i > 0 AND {NEAR_SQL} AS near FROM fold WHERE i < len(p))),
    ch AS (SELECT doc_id, chunk, string_agg(p[i], ' ' ORDER BY i) AS text FROM fold WHERE i > 0 GROUP BY doc_id, chunk)
    SELECT doc_id, chunk::BIGINT AS chunk_index, {OUT_SQL} FROM ch WHERE length({STRIP.format('text')}) >= 30""",
)
def chunk_semantic_threshold(spark, sf_dir):
    """Groups of sentences near their centroid, up to 500 characters."""
    return out(C.threshold_chunks(sentence_vectors(spark, sf_dir)).withColumnRenamed("chunk", "chunk_index"))


def sentences(spark, sf_dir, context):
    """(doc_id, pos, sentence, vector) with the vector of ``context(pos)``."""
    pieces = F.filter(F.transform(F.split("text", C.SENTENCE_END), X.strip), lambda x: x != "")
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", pieces.alias("s"))
    items = F.transform(F.col("s"), lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), context(x, i).alias("context")))
    rows = docs.select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.*")
    return rows.select("doc_id", "pos", "sentence", hash_embedder(F.col("context")).alias("vector"))


def sentence_vectors(spark, sf_dir):
    return sentences(spark, sf_dir, lambda x, i: x)


def semantic(spark, sf_dir, **limit):
    around = lambda x, i: F.array_join(F.slice("s", F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")
    return out(C.semantic_chunks(sentences(spark, sf_dir, around), **limit).withColumnRenamed("chunk", "chunk_index"))


@query(
    "html_to_text_pages",
    r"""WITH a AS (SELECT page_id, url, regexp_replace(html, '(?is)<(script|style|head|nav)\b.*?</(script|style|head|nav)>|<!--.*?-->', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '(?i)</?(p|div|br|h[1-6]|li|tr|article|section|ul|ol|table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b),
    e AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM c)
    SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM e WHERE t <> ''""",
)
def html_to_text_pages(spark, sf_dir):
    text = html_text(F.col("html"))
    return (
        spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
        .select("page_id", text.alias("text"))
        .where(F.col("text") != "")
        .select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))
    )


@query(
    "page_separator_split",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
    SELECT doc_id, page, md5({STRIP.format('text')}) AS digest FROM p WHERE {STRIP.format('text')} <> ''""",
)
def page_separator_split(spark, sf_dir):
    """One extracted text per file, cut into numbered pages at a separator."""
    whole = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\f")).alias("text"))
    return split_pages(whole, "\f", ["doc_id"]).select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("digest"))

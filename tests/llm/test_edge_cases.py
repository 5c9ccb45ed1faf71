"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from rankforge.llm import chat, decontaminate, html_text, language_model, near_dedup, pieces, pii, quality, sharding, vectors
from rankforge.llm.queries import MODEL_PATH

LONG = " ".join(f"word{i % 977} the" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "one two"), (4, "one two"), (5, LONG), (5, LONG), (6, " \n\t "),
    (7, "a@b.example mail a@b.example call +1 (555) 123-4567"), (None, "text without an id"), (8, "▁ \U0001f600 ok"),
]
# names that the operators use themselves
CLASH = ["row", "n", "c", "kept", "score", "n_hit", "items", "spans", "base", "samples", "ids", "sketch", "shard", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (None, "word"), (1, "one two")], "item_id long, text string")


def test_near_dedup(docs, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (6, 0, 6, True) in got
    assert (3, 1, 3, True) in got and (4, 1, 3, False) in got
    assert [g for g in got if g[0] == 5] == [(5, 1954, 5, True)] * 2
    assert [g for g in got if g[0] is None] == [(None, 1, None, True)]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_pii(docs, nothing):
    got = {r.row.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].base == got[2].base == "" and got[1].spans == []
    assert (got[7].n_email, got[7].n_phone) == (2, 1)
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == len(ROWS)
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[7] == "[EMAIL] mail [EMAIL] call [PHONE]" and text[1] is None and text[5] == LONG
    assert pii.find(nothing).count() == 0


def test_language_model(docs, nothing):
    learn = F.lit(True)
    for again in (False, True):
        got = {r.doc_id: r for r in language_model.score(docs, learn, ["doc_id", "row"], again).collect()}
        assert got[1].n_tokens == got[2].n_tokens == got[6].n_tokens == 1
        assert got[1].score == got[2].score < 0 and got[5].n_tokens == 60_001 and got[None].row == "x"
    assert language_model.score(docs, F.lit(None).cast("boolean"), ["doc_id"]).filter("n_known > 0").count() == 0
    assert language_model.score(nothing, learn, ["doc_id"]).count() == 0


def test_chat(spark):
    rows = [(1, 0, None, None), (1, 1, "user", "a<|b\\"), (1, 1, "user", "a<|b\\"), (None, None, "assistant", "x"), (2, 5, "ro\nle", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    made = chat.format_chats(turns)
    back = made.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in back.collect()}
    assert got[1] == ([("", ""), ("user", "a<|b\\"), ("user", "a<|b\\")], "")
    assert got[None] == ([("assistant", "x")], "x")
    assert got[2] == ([("ro\nle", "<|im_end|>")], "")
    assert chat.format_chats(turns.filter("false")).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x" * 3000), (4, "<a \"<b <!-- <script>")], "page_id long, html string")
    got = {r.row.page_id: r.main_text for r in html_text.extract(pages.withColumn("main_text", F.lit(0))).collect()}
    assert got[1] == got[2] == "" and set(got) == {1, 2, 3, 4}
    assert html_text.extract(pages.filter("false")).count() == 0


def test_pieces(docs, nothing):
    made = pieces.encode(docs, MODEL_PATH)
    flat = made.select("row.doc_id", F.explode("samples").alias("s")).select("doc_id", "s.ids")
    texts = {r.row.doc_id: set() for r in pieces.decode(flat, MODEL_PATH).collect()}
    for r in pieces.decode(flat, MODEL_PATH).collect():
        texts[r.row.doc_id].add(r.decoded)
    assert texts == {i: {t or ""} for i, t in ROWS}
    empty = made.filter("row.doc_id = 1").first().samples
    assert [(s.ids, s.inclusion) for s in empty] == [([], 0.0)]
    assert pieces.encode(nothing, MODEL_PATH).count() == 0


def test_sharding(docs, nothing):
    got = [tuple(r) for r in sharding.shard(docs).collect()]
    assert len(got) == len(ROWS) and all(0 <= r[3] < 16 for r in got)
    assert {r[1:3] for r in got if r[0] in (1, 2)} == {(1, 0)}
    assert len({r[3] for r in got if r[0] == 5}) == 1
    for s in {r[3] for r in got}:
        slots = sorted(r[4] for r in got if r[3] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(nothing).count() == 0


def test_decontaminate(docs, nothing, benchmark):
    got = {r.row.doc_id: r for r in decontaminate.scan(docs, benchmark).collect()}
    assert (got[3].n_words, got[3].n_hit, got[3].items) == (2, 2, ["1"])
    assert (got[1].n_words, got[1].n_hit, got[1].items) == (0, 0, [])
    left = decontaminate.drop_documents(docs, benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, 5, 6, 7, 8, None}
    cut = {r.doc_id: r.text for r in decontaminate.drop_spans(docs, benchmark).collect()}
    assert cut[3] == "" and cut[1] is None and cut[5] == LONG
    assert decontaminate.drop_documents(docs, benchmark.filter("false")).count() == len(ROWS)
    assert decontaminate.scan(nothing, benchmark).count() == 0


def test_decontaminate_in_parts(spark, docs, sf):
    """Small parts of the benchmark, one pass each: the same findings."""
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = lambda df: sorted((str(r.row.doc_id), r.n_words, r.n_hit, r["items"], r.hits) for r in df.collect())
    whole = rows(decontaminate.scan(some, bench))
    assert sum(r[2] > 0 for r in whole) >= 3
    assert rows(decontaminate.scan(some, bench, part_words=300)) == whole


def test_quality(docs, nothing):
    got = {r.row.doc_id: r for r in quality.classify(docs).collect()}
    assert len(got) == len(ROWS) - 1
    assert got[1].score is None and not got[1].kept and not got[2].kept and got[5].score is not None
    assert quality.classify(nothing).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (100, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (200, None), (0, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("width", F.lit("x"))
    got = [tuple(r) for r in vectors.nearest(df, df.filter("vec_id = 100"), 10).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 2, 0, 0] and got[0][3] == 0.0
    assert vectors.nearest(df, df.filter("vec_id = 200"), 10).count() == 0
    assert vectors.nearest(df.filter("false"), df.filter("false"), 10).count() == 0


def test_vectors_repeated_queries_and_large_values(spark, monkeypatch):
    """A repeated query row has rows of its own; squares that overflow leave the order right."""
    rows = [(100, [0.0, 1.0])] * 3 + [(i, [0.0, 1.0 + i]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for chunk in (3, 1 << 18):
        monkeypatch.setattr(vectors, "CHUNK_ROWS", chunk)
        got = [tuple(r) for r in vectors.nearest(df, df.filter("vec_id = 100"), 5).orderBy("rank", "vec_id").collect()]
        assert got == [(100, r, r, float(r)) for r in range(1, 6) for _ in range(3)]
    far = spark.createDataFrame([(0, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [4e200, 0.0]), (3, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.nearest(far, far.filter("vec_id = 0"), 5).orderBy("rank").collect()]
    assert [g[2] for g in got] == [1, 3, 2] and [g[3] for g in got] == [1e200, 1e200, 3e200]

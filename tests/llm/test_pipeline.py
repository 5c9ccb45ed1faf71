"""Pipeline stages and the whole run against their operators' rules."""

import re

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from rankforge.llm import decontaminate, pieces, pii, quality, words
from rankforge.llm.queries import MODEL_PATH
from tests.llm.test_exact import brute_components


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "sentencepiece"]


def test_each_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    one = stages["near_dedup"](spark, docs, sf)
    assert one.schema.names == docs.columns and one.count() == one.select("text").distinct().count() < docs.count()
    clean = stages["decontaminate"](spark, docs, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = decontaminate.scan(clean, bench)
    assert clean.count() < docs.count() and found.filter(decontaminate.contaminated(found)).count() == 0
    safe = stages["pii"](spark, docs, sf)
    assert safe.count() == docs.count() and safe.filter("n_chars <> length(text)").count() == 0
    assert not any(m[3] for r in safe.select("text").collect() for m in pii.base_matches(r.text))


def test_repeated_and_missing_ids_in_dedup(spark, sf):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (1, text), (2, text), (3, "other words"), (None, text), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(1))
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert sorted((r.doc_id or 0, r.text) for r in got.filter("text is not null").collect()) == [(0, text), (1, text), (3, "other words")]
    assert got.filter("text is null").count() == 1 and got.columns == docs.columns


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    total = duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert 0 < len(rows) < total and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_samples >= 1 and len(r.ids) for r in rows)


def test_stages_match_plain_versions(spark, sf):
    """Every stage on what the stage before kept, against plain Python over the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    good = stages["quality"](spark, docs, sf)
    scored = {r.row.doc_id: r for r in quality.classify(docs).collect()}
    kept = rows(good)
    assert set(kept) == {i for i, r in scored.items() if r.score is not None and r.score >= quality.CUT}
    good = spark.createDataFrame(good.collect(), docs.schema)

    # one document of each component of the links on full shingle sets
    one = rows(stages["near_dedup"](spark, good, sf))
    assert one == {i: kept[i] for i, (_, root) in brute_components(kept).items() if i == root}
    left = spark.createDataFrame(good.filter(F.col("doc_id").isin(list(one))).collect(), docs.schema)

    # windows of 13 words, or a whole shorter item
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    windows = {tuple(w[i : i + 13]) for t in bench if (w := words(t)) for i in range(max(1, len(w) - 12))}
    clean = {}
    for i, text in one.items():
        w, hit = words(text), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                hit |= set(range(at, at + size)) if tuple(w[at : at + size]) in windows else set()
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = text
    assert rows(stages["decontaminate"](spark, left, sf)) == clean
    left = spark.createDataFrame(left.filter(F.col("doc_id").isin(list(clean))).collect(), docs.schema)

    # every span replaced by its kind, overlapping ones as one
    spans = {r.row.doc_id: sorted((s.start, s.end, s.kind) for s in r.spans) for r in pii.find(left).collect()}
    safe = {}
    for i, text in clean.items():
        out, at = "", 0
        for start, end, kind in spans[i]:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        safe[i] = out + text[at:]
    got = stages["pii"](spark, left, sf)
    assert rows(got) == safe
    got = spark.createDataFrame(got.collect(), docs.schema)

    # every sampled segmentation reads back as the text, and they differ
    made = stages["sentencepiece"](spark, got, sf)
    flat = made.select("doc_id", F.posexplode("ids").alias("nth", "ids"))
    for r in pieces.decode(flat, MODEL_PATH).collect():
        assert r.decoded == safe[r.row.doc_id]
    for r in made.collect():
        assert len(r.ids) == r.n_samples == len({tuple(x) for x in r.ids})


def test_stages_on_nulls_and_empty_tables(spark, sf):
    """Null texts and ids, empty and long texts, repeated rows and clashing columns pass every stage."""
    long = " ".join(f"word{i % 977} and the other of it" for i in range(9_000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "no id here"), (None, None), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "kept", "hits", "spans", "samples", "ids", "score", "count")])
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf)
        if name != "sentencepiece":
            assert made.columns == docs.columns, name
            made.collect()
        assert stage(spark, docs.filter("false"), sf).count() == 0, name
    assert corpus_pipeline.keep_quality(spark, docs, sf).filter("text is null or text = ''").count() == 0
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, sf)
    assert kept.filter("doc_id = 3").count() == 1 and kept.filter("doc_id is null").count() == 2
    assert corpus_pipeline.keep_uncontaminated(spark, docs, sf).count() == len(rows)
    assert corpus_pipeline.redact_personal_data(spark, docs, sf).filter("text is null").count() == 2
    last = {r.doc_id: r for r in corpus_pipeline.sample_pieces(spark, docs.drop("ids"), sf).filter("doc_id is not null").collect()}
    assert last[1].n_samples == 1 and list(last[1].ids) == [[]]


def test_stages_bound_what_a_worker_holds(spark, sf, monkeypatch):
    """Arrow batches of few rows, and tables of powers no longer than the block at hand."""
    before = spark.conf.get(corpus_pipeline.BATCH_CONF)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH_CONF, 10_000)
            stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            assert int(spark.conf.get(corpus_pipeline.BATCH_CONF)) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline.BATCH_CONF, 7)
        corpus_pipeline.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert int(spark.conf.get(corpus_pipeline.BATCH_CONF)) == 7
    finally:
        spark.conf.set(corpus_pipeline.BATCH_CONF, before)
    monkeypatch.setattr(words, "_powers", {})
    assert len(words.powers(3, 1000)) == 1000 and len(words._powers[3]) == 1 << 16
    assert int(words.powers(3, 100_000)[99_999]) == pow(3, 99_999, 1 << 64)

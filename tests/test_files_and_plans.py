"""Readers, loaders, streaming resume and the shape of physical plans."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import plan_of
from rankforge import session
from rankforge.session import table
from rankforge.sources import loaders, readers, writers
from rankforge.sources.html import html_text
from rankforge.streaming import registry


def test_score_cache_and_settings(spark, tmp_path):
    for name, body in {"hyde__dense__none_q001_correctness.txt": "4\n", "a_b_q002_similarity.txt": "x", "notes.txt": "1"}.items():
        (tmp_path / name).write_text(body)
    got = {(r.config, r.qid, r.metric): r.score for r in readers.score_cache(spark, str(tmp_path)).collect()}
    assert got == {("hyde__dense__none", "q001", "correctness"): 4, ("a_b", "q002", "similarity"): None}
    env = tmp_path / "env"
    env.write_text("# note\nA=1\n B = x=y \n\nbad\n")
    assert {tuple(r) for r in readers.settings(spark, str(env)).collect()} == {("A", "1"), ("B", "x=y")}


def test_json_directory_skips_non_results(spark, tmp_path):
    (tmp_path / "koe5.json").write_text('[{"q": "a"}, {"q": "b"}]')
    (tmp_path / "koe5_retry.json").write_text('[{"q": "c"}]')
    got = {tuple(r) for r in readers.json_directory(spark, str(tmp_path), "q string").collect()}
    assert got == {("a", "koe5"), ("b", "koe5")}


def test_parquet_or_none(spark, tmp_path):
    assert readers.parquet_or_none(spark, str(tmp_path / "missing")) is None


def test_corrupt_parquet_is_no_table(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not a footer PAR1")
    with pytest.warns(UserWarning):
        assert readers.parquet_or_none(spark, str(tmp_path / "bad.parquet")) is None


@pytest.mark.parametrize("tolerant", [True, False])
def test_lines_of_white_space_are_no_records(spark, tmp_path, tolerant):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\t\n \r\n{"a": 2}\n')
    got = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int", tolerant=tolerant).collect()
    assert sorted(r.a for r in got) == [1, 2]


def test_json_directory_takes_allowed_prefixes(spark, tmp_path):
    for name in ("run_a.json", "run_b.json", "other.json", "run_a_retry.json"):
        (tmp_path / name).write_text('[{"a": 1}]')
    got = readers.json_directory(spark, str(tmp_path), "a int", prefixes=["run_"]).collect()
    assert sorted(r.key for r in got) == ["run_a", "run_b"]


def test_load_pages_skips_bad_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes(b"one\f \ftwo")
    (tmp_path / "sub" / "b.html").write_bytes(b"\xff\xfe")
    pages = loaders.load_pages(spark, str(tmp_path), lambda data: data.decode("utf-8").split("\f"), "*.html")
    rows = pages.withColumn("stem", loaders.file_stem(F.col("file"))).collect()
    assert {(r.stem, r.page, r.text) for r in rows if not r.error} == {("a", 1, "one"), ("a", 3, "two")}
    assert [(r.stem, r.page) for r in rows if r.error] == [("b", None)]


def test_html_text(spark):
    html = "<html><head><title>t</title></head><body><p>a&amp;b<br>c</p><script>x()</script><!-- n --><div> d </div></body></html>"
    assert spark.range(1).select(html_text(F.lit(html))).first()[0] == "a&b\nc\nd"


def test_request_shards_and_markdown(spark, tmp_path):
    path = str(tmp_path / "req")
    writers.write_requests(spark.range(25).select(F.col("id").cast("string").alias("v")).coalesce(1), "v", path, shard_rows=10)
    assert len(list((tmp_path / "req").glob("*.txt"))) == 3
    assert "| a |" in writers.markdown_table(spark.range(2).withColumnRenamed("id", "a"))
    long = writers.markdown_table(spark.range(900).selectExpr("id", "cast(id as double) / 3 as x"), "id").splitlines()
    assert len(long) == 902 and long[2] == "| 0 | 0.0000 |" and long[901] == "| 899 | 299.6667 |"


def test_left_out_files_are_never_opened(spark, tmp_path):
    """Names outside the prefixes and non-results are dropped when the scan is planned."""
    for name in ("run_a.json", "run_b_retry.json", "other.json", "run_registry.json"):
        (tmp_path / name).write_text('[{"a": 1}]')
    found = readers.json_directory(spark, str(tmp_path), "a int", prefixes=["run_"])
    assert [r.key for r in found.collect()] == ["run_a"]
    scan = found._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numFiles").value() == 1


def test_named_files(spark, tmp_path):
    rows = [("x/a b.txt", "1"), ("x/a b.txt", "2"), ("c=d.txt", "é")]
    writers.write_named(spark.createDataFrame(rows, "name string, value string"), str(tmp_path / "out"))
    assert sorted((tmp_path / "out" / "x" / "a b.txt").read_text().split()) == ["1", "2"]
    assert (tmp_path / "out" / "c=d.txt").read_text() == "é\n"
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] != ".") == ["c=d.txt", "x"]


def test_stream_takes_up_where_it_stopped(spark, sf, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    half = events.count() // 2
    for n, part in enumerate((events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half))):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
    for n in range(2):
        file = next((tmp_path / f"part{n}").glob("*.parquet"))
        shutil.copy(file, source / f"{n}.parquet")
        log = registry.arriving(spark, str(source), events.schema)
        registry.upsert(registry.latest_by_key(log, "user_id", "ts", "event_type"), out, mark)
    got = {(r.user_id, r.event_type) for r in registry.current(spark, out, "user_id").collect()}
    want = events.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("t"))
    assert got == {(r.user_id, r.t) for r in want.collect()}


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk"])
def test_top_k_is_cut_before_the_shuffle(spark, sf, name):
    assert plan_of(entry.queries()[name](spark, sf)).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["ox_votes", "leaderboard", "leave_one_out_rank_change", "score_extract_canonical", "provider_chat", "chunk_paragraph_pack", "bm25_topk"])
def test_no_python_in_built_in_operators(spark, sf, name):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "Python" not in plan and "InPandas" not in plan


def test_scan_reads_only_what_is_used(spark, sf):
    assert "ReadSchema: struct<lang:string,n_chars:bigint>" in plan_of(
        table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars"))
    )
    plan = plan_of(entry.queries()["ox_votes"](spark, sf))
    assert "text" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_request_shards_need_their_manifest(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(25).select("id", F.concat(F.lit("line "), F.col("id").cast("string")).alias("v")).repartition(5)
    writers.write_shards(rows, "v", path, "id", size=10)
    got = writers.read_shards(spark, path).groupBy("name").count().collect()
    assert {tuple(r) for r in got} == {("shard-00000.jsonl", 10), ("shard-00001.jsonl", 10), ("shard-00002.jsonl", 5)}
    (tmp_path / "shards" / "shard-00009.jsonl").write_text("not listed\n")
    assert writers.read_shards(spark, path).count() == 25
    (tmp_path / "shards" / "shard-00001.jsonl").write_text("cut\n")
    (tmp_path / "shards" / ".shard-00001.jsonl.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="shard-00001"):
        writers.read_shards(spark, path)


def test_aborted_shards_leave_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "shards")
    bad = spark.range(40).select("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))
    with pytest.raises(Exception, match="lost"):
        writers.write_shards(bad, "v", path, "id", size=10)
    assert not [p for p in tmp_path.rglob("*") if not any(part.startswith("_") for part in p.parts) and p.is_file()]


def test_spread_deals_a_file_of_one_row_group_in_several_splits(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        docs = session.table(spark, str(tmp_path), "documents")
        assert docs.rdd.getNumPartitions() > 1
        dealt = session.spread(docs, "doc_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r["count"] for r in dealt) == 20_000
    assert max(r["count"] for r in dealt) < 2 * 20_000 / spark.sparkContext.defaultParallelism


def test_spread_leaves_a_table_of_even_splits(spark):
    rows = spark.range(0, 8000, 1, 2 * spark.sparkContext.defaultParallelism).select(F.col("id").alias("doc_id"))
    assert session.spread(rows, "doc_id") is rows
    none = rows.where("doc_id < 0")
    assert session.spread(none, "doc_id").count() == 0


def test_together_keeps_order_and_raises(spark):
    calls = [lambda n=n: spark.range(n).count() for n in (3, 1, 2)]
    assert session.together(*calls) == [3, 1, 2] and session.together() == []
    with pytest.raises(ZeroDivisionError):
        session.together(lambda: 1, lambda: 1 // 0)

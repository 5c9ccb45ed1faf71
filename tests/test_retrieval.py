"""Retrieval operators against brute force on small random inputs."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankforge.operators import dense, fusion, sparse
from rankforge.operators.containment import containing
from tests.conftest import plan_of


def vector_frames(spark, n_q, n_c, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    # coarse values and copies make ties
    c = rng.integers(-2, 3, (n_c, dim)).astype(float)
    c[n_c // 2 :] = c[: n_c - n_c // 2]
    c[0] = 0
    q = rng.integers(-2, 3, (n_q, dim)).astype(float)
    rows = lambda m, name: spark.createDataFrame(
        [(i, v.tolist(), int(i % 3)) for i, v in enumerate(m)], f"{name} bigint, vector array<float>, grp int"
    )
    return q, c, rows(q, "qid"), rows(c, "doc_id")


def brute_ranks(q, c):
    sims = np.round(dense.unit_rows(q) @ dense.unit_rows(c).T, 9) + 0.0
    ids = np.arange(len(c))
    return [np.lexsort((ids, -row)) for row in sims]


@pytest.mark.parametrize("resident", [100_000, 0])
def test_dense_topk_both_ways(spark, resident):
    q, c, qs, cs = vector_frames(spark, 9, 60)
    got = dense.dense_topk(qs, cs, 7, resident_cells=resident, tile_rows=16).collect()
    by_q = {i: [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] for i in range(9)}
    for i, order in enumerate(brute_ranks(q, c)):
        assert by_q[i] == order[:7].tolist()


def test_dense_topk_small_corpus(spark):
    _, _, qs, cs = vector_frames(spark, 3, 4)
    assert dense.dense_topk(qs, cs, 10).count() == 12


def test_dense_topk_within_group(spark):
    q, c, qs, cs = vector_frames(spark, 6, 40)
    got = dense.dense_topk(qs, cs, 3, within="grp", tile_rows=4).collect()
    for i, order in enumerate(brute_ranks(q, c)):
        want = [d for d in order.tolist() if d % 3 == i % 3][:3]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] == want


@pytest.mark.parametrize("resident", [100_000, 0])
def test_dense_ranks_count_every_place(spark, resident):
    q, c, qs, cs = vector_frames(spark, 4, 50)
    pairs = qs.select("qid").join(cs.select("doc_id"))
    got = {(r.qid, r.doc_id): r["rank"] for r in dense.dense_ranks(pairs, qs, cs, tile_rows=16, resident_cells=resident).collect()}
    for i, order in enumerate(brute_ranks(q, c)):
        assert all(got[i, d] == place for place, d in enumerate(order.tolist(), 1))


WORDS = "red blue green one two three four five six seven eight nine ten tree".split()


def corpus(seed=3, n=80):
    rng = np.random.default_rng(seed)
    docs = [" ".join(rng.choice(WORDS, rng.integers(0, 12))) for _ in range(n)]
    docs[n // 3 : n // 2] = ["one two copy"] * (n // 2 - n // 3)
    return docs


def brute_bm25(docs, query):
    words = lambda t: [w for w in re.sub(r"[^\w\s]", " ", t).lower().split()]
    toks = [words(d) for d in docs]
    n, avgdl = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    out = []
    for t in toks:
        tf = Counter(t)
        out.append(
            sum(
                (idf[w] if idf[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
                for w in words(query)
                if w in idf
            )
        )
    return np.round(out, 9)


def text_frames(spark, docs, queries):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    t = spark.createDataFrame(list(enumerate(queries)), "text_id bigint, text string")
    return d, t


QUERIES = ["one two", "tree tree seven", "copy", "absent", "red blue green one"]


def lexical_order(docs):
    return [np.lexsort((np.arange(len(docs)), -brute_bm25(docs, q))) for q in QUERIES]


def test_bm25_and_tail_ranks(spark):
    docs = corpus()
    d, t = text_frames(spark, docs, QUERIES)
    ranker = fusion.LexicalRanker(t, d)
    order = lexical_order(docs)
    top = ranker.top(25).collect()
    for i, want in enumerate(order):
        assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.text_id == i] == want[:25].tolist()
    pairs = t.select("text_id").join(d.select("doc_id"))
    got = {(r.text_id, r.doc_id): r["rank"] for r in ranker.ranks(pairs).collect()}
    for i, want in enumerate(order):
        assert all(got[i, x] == place for place, x in enumerate(want.tolist(), 1))


def test_bm25_fill_completes_short_lists(spark):
    docs = corpus()
    d, t = text_frames(spark, docs, QUERIES)
    got = fusion.LexicalRanker(t, d).top(10).collect()
    for i, want in enumerate(lexical_order(docs)):
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.text_id == i] == want[:10].tolist()


@pytest.fixture(scope="module")
def mixed(spark):
    """300 documents, so lists end well before the corpus does."""
    docs = corpus(n=300)
    d, t = text_frames(spark, docs, QUERIES)
    rng = np.random.default_rng(5)
    qv, cv = rng.normal(size=(5, 4)), rng.normal(size=(300, 4))
    frame = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} bigint, vector array<double>")
    rankers = {"dense": fusion.DenseRanker(frame(qv, "text_id"), frame(cv, "doc_id")), "sparse": fusion.LexicalRanker(t, d)}
    rank = {}
    for name, orders in (("dense", brute_ranks(qv, cv)), ("sparse", lexical_order(docs))):
        for i, order in enumerate(orders):
            rank[name, i] = np.empty(300, int)
            rank[name, i][order] = np.arange(1, 301)
    return rankers, rank


def check_fused(got, lines, rank, score, k):
    for key in {(c, q) for c, q, *_ in lines}:
        total = sum(score(w, rank[name, t]) for c, q, name, t, w in lines if (c, q) == key)
        want = np.lexsort((np.arange(len(total)), -np.round(total, 12)))[:k]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if (r.config, r.qid) == key] == want.tolist()


def test_rrf_equals_full_ranks(spark, mixed):
    rankers, rank = mixed
    lines = []
    for q in range(5):
        for c, (a, b) in {"7_3": (0.7, 0.3), "5_5": (0.5, 0.5), "3_7": (0.3, 0.7)}.items():
            lines += [(c, q, "dense", q, a), (c, q, "sparse", q, b)]
    # three variants per question
    lines += [("multi", q, n, (q + v) % 5, 0.5) for q in range(5) for v in range(3) for n in ("dense", "sparse")]
    plan = spark.createDataFrame(lines, "config string, qid int, ranker string, text_id bigint, weight double")
    got = fusion.fuse_rrf(plan, rankers, 6).collect()
    check_fused(got, lines, rank, lambda w, r: w / (60 + r), 6)


def test_borda_deepens_until_sure(spark, mixed):
    rankers, rank = mixed
    lines = [("b", q, n, t, 1.0) for q in range(3) for n, t in (("dense", q), ("dense", q + 1), ("sparse", q))]
    plan = spark.createDataFrame(lines, "config string, qid int, ranker string, text_id bigint, weight double")
    got = fusion.fuse_borda(plan, rankers, 4, depth=8).collect()
    check_fused(got, lines, rank, lambda w, r: -(r - 1.0), 4)


def test_bm25_in_blocks_of_texts(spark, monkeypatch):
    docs = corpus()
    d, t = text_frames(spark, docs, QUERIES)
    whole = fusion.LexicalRanker(t, d)
    pairs = t.select("text_id").join(d.select("doc_id"))
    want = sorted(map(tuple, whole.ranks(pairs).collect())), sorted(map(tuple, whole.top(7).collect()))
    monkeypatch.setattr(sparse, "BLOCK_TERMS", 3)
    monkeypatch.setattr(sparse, "CELLS", 10)
    assert (sorted(map(tuple, whole.ranks(pairs).collect())), sorted(map(tuple, whole.top(7).collect()))) == want


def test_bm25_scans_the_text_once_and_ships_no_score_table(spark, sf):
    """The ranking passes read the term table; no exchange carries texts x documents."""
    d, t = text_frames(spark, corpus(), QUERIES)
    ranker = fusion.LexicalRanker(t, d)
    plan = plan_of(ranker.top(3))
    assert plan.count("MapInArrow") and "Join" not in plan and plan.count("Scan parquet") == 2


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>")
    got = [{p.term: p.tf for p in r[0]} for r in df.select(sparse.term_counts(F.col("t"))).collect()]
    assert got == [{"a": 1, "b": 2}, {}, {"x": 1}]


def test_containing_equals_text_search(spark):
    docs = ["x aa bb cc dd ee yy", "zaa bb cc dd eez", "aa  bb cc dd ee", "nothing here", "tiny", "a tiny b"]
    passages = ["aa bb cc dd ee", "tiny", "bb cc dd", "absent words are not here"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "qid int, text string")
    got = {(r.qid, r.doc_id) for r in containing(d, p).collect()}
    assert got == {(i, j) for i, a in enumerate(passages) for j, b in enumerate(docs) if a in b}


def test_short_passages_need_no_nested_loop(spark):
    d = spark.createDataFrame([(0, "a tiny b"), (1, "xtinyx"), (2, "none"), (3, None)], "doc_id int, text string")
    p = spark.createDataFrame([(0, "tiny"), (1, "tiny b"), (2, "absent")], "qid int, text string")
    found = containing(d, p)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == [(0, 0), (0, 1), (1, 0)]


def test_null_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5]), (4, [])]
    c = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    q = c.withColumnRenamed("doc_id", "qid").orderBy(F.col("vector").isNotNull())
    got = {(r.qid, r.doc_id) for r in dense.dense_topk(q, c, 5).collect()}
    assert got == {(1, 1), (1, 3), (3, 1), (3, 3)} and dense.left_out(c) == 2


def test_only_hot_groups_are_tiled(spark):
    rows = [("hot", i) for i in range(400)] + [(f"g{i}", 1000 + i) for i in range(50)]
    df = spark.createDataFrame([(g, i, [1.0, float(i)]) for g, i in rows], "g string, doc_id int, vector array<double>")
    q = df.withColumnRenamed("doc_id", "qid")
    tiles = {r.g: (r.nq, r.nc) for r in dense._group_tiles(q, df, "g", 100).collect()}
    assert tiles["hot"] == (4, 4) and {v for g, v in tiles.items() if g != "hot"} == {(1, 1)}
    got = dense.dense_topk(q, df, 3, within="g", tile_rows=100).collect()
    assert len(got) == 3 * 400 + 50


def test_exact_percentile(spark):
    from rankforge.operators.costs import exact_percentile

    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.lognormal(size=999)] + [("b", 7.0)] * 40 + [("c", float(i % 3)) for i in range(10)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.percentile for r in exact_percentile(df, "v", ["g"], 0.95).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], 0.95), abs=1e-12)


def test_pruned_search_equals_all_pairs_with_ties(spark):
    """Clustered vectors, many equal ones and zero vectors: the same rows, with tile pairs left out."""
    from rankforge.operators import dense, pivots

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(24, 16))
    rows = [(i, (centers[i % 24] + rng.normal(size=16) * 0.02).round(3).tolist()) for i in range(1_500)]
    rows += [(2_000 + i, rows[i % 7][1]) for i in range(60)] + [(3_000 + i, [0.0] * 16) for i in range(3)]
    corpus = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    queries = corpus.withColumnRenamed("doc_id", "qid")
    met = []
    schema = dense._schema(queries, corpus)
    found = dense.top_k(pivots.pruned_topk(queries, corpus, 6, True, schema, 64, 40, met), 6, ("system", "qid"), "doc_id")
    plain = dense.dense_topk(queries, corpus, 6, exclude_self=True)
    as_rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())
    assert as_rows(found) == as_rows(plain)
    pairs, every = met[0]
    assert pairs < every / 3
    # the way that a large query side takes
    large = dense.dense_topk(queries, corpus, 6, exclude_self=True, tile_rows=64, resident_cells=10)
    assert as_rows(large) == as_rows(plain)


def test_a_ranker_bounds_the_rows_of_a_batch(spark):
    name, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", 5000
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id")).alias("text"))
        texts = spark.createDataFrame([(1, "word")], "text_id int, text string")
        ranker = fusion.LexicalRanker(texts, docs)
        sizes = ranker.index.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        assert sum(r["n"] for r in sizes) == rows and max(r["n"] for r in sizes) <= 2000
    finally:
        spark.conf.set(name, before)

"""Long lists, blocks and rank sums: what tasks hold and send is bounded, results stay whole."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankforge.operators import dense, fusion, pivots, scan, sparse
from tests.test_retrieval import QUERIES, brute_ranks, corpus, lexical_order, mixed, text_frames  # noqa: F401


def test_parts_hold_bounded_entries(monkeypatch):
    monkeypatch.setattr(sparse, "ENTRIES", 50)
    lists = [["a", "b", "a"]] * 40 + [["c"] * 90] + [[]] * 5 + [["d"]] * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    made = list(sparse._count_batches([batch]))
    assert [i for part in made for i in part.column(0).to_pylist()] == list(range(len(lists)))
    assert all(part.num_rows == 1 or sum(part.column(1).to_pylist()) <= 50 for part in made)


def test_long_lists_send_few_rows_more_than_wanted(spark, monkeypatch):
    docs = corpus(n=1_200)
    d, t = text_frames(spark, docs, QUERIES)
    ranker = fusion.LexicalRanker(t, d.repartition(6))
    ranker.index = ranker.index.repartition(6)
    order = lexical_order(docs)
    monkeypatch.setattr(scan, "FREE_ROWS", 0)
    sent = []
    real = sparse.top_k
    monkeypatch.setattr(sparse, "top_k", lambda rows, *a: sent.append(rows.count()) or real(rows, *a))
    top = ranker.top(150).collect()
    for i, want in enumerate(order):
        assert [r.doc_id for r in sorted(top, key=lambda r: r["rank"]) if r.text_id == i] == want[:150].tolist()
    assert sent[0] <= 1.4 * 150 * len(QUERIES)


def test_dense_long_lists_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(8)
    q, c = rng.integers(0, 3, (9, 6)).astype(float), rng.integers(0, 3, (900, 6)).astype(float)
    frame = lambda m, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{n} bigint, vector array<double>")
    monkeypatch.setattr(scan, "FREE_ROWS", 0)
    found = dense.dense_topk(frame(q, "qid"), frame(c, "doc_id").repartition(5), 140, resident_cells=600)
    assert not any(x in found._jdf.queryExecution().toString() for x in ("CoGroup",))
    got = found.collect()
    for i, want in enumerate(brute_ranks(q, c)):
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i] == want[:140].tolist()


def test_blocks_meet_where_cells_rule_out_little(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=12).round(1).tolist()) for i in range(900)] + [(1_000 + i, [1.0] * 12) for i in range(40)]
    c = spark.createDataFrame(rows, "doc_id long, vector array<double>").repartition(3)
    q = c.withColumnRenamed("doc_id", "qid")
    plain = dense.dense_topk(q, c, 6, exclude_self=True)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 400)
    keys = []
    real = pivots._search
    monkeypatch.setattr(pivots, "_search", lambda q, c, names, *a: keys.append(names) or real(q, c, names, *a))
    found = dense.dense_topk(q, c, 6, exclude_self=True, tile_rows=32, resident_cells=10)
    as_rows = lambda df: sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())
    assert as_rows(found) == as_rows(plain) and ["qb", "cb"] in keys


class Counted:
    def __init__(self, ranker, asked):
        self.ranker, self.asked = ranker, asked

    def top(self, n):
        return self.ranker.top(n)

    def ranks(self, pairs):
        self.asked.append(pairs.count())
        return self.ranker.ranks(pairs)


def test_borda_counts_ranks_of_contenders_only(spark, mixed):  # noqa: F811
    rankers, rank = mixed
    lines = [("b", q, n, t, 1.0) for q in range(3) for n, t in (("dense", q), ("dense", q + 1), ("sparse", q))]
    plan = spark.createDataFrame(lines, "config string, qid int, ranker string, text_id bigint, weight double")
    asked = []
    got = fusion.fuse_borda(plan, {n: Counted(r, asked) for n, r in rankers.items()}, 4, depth=8).collect()
    for q in range(3):
        total = rank["dense", q] + rank["dense", q + 1] + rank["sparse", q]
        want = np.lexsort((np.arange(300), total))[:4]
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == q] == want.tolist()
    assert sum(asked) < 150


def test_borda_of_nothing_ends(spark, mixed):  # noqa: F811
    rankers, _ = mixed
    none = Counted(rankers["dense"], [])
    none.top = lambda n: rankers["dense"].top(n).where(F.lit(False))
    plan = spark.createDataFrame([("b", 1, "dense", 1, 1.0)], "config string, qid int, ranker string, text_id bigint, weight double")
    assert fusion.fuse_borda(plan, {"dense": none}, 4).count() == 0


class NoLists:
    """A ranker whose lists must not be asked for."""

    def __init__(self, ranker):
        self.ranker = ranker

    def __getattr__(self, name):
        assert name != "top", "a list was searched"
        return getattr(self.ranker, name)


@pytest.mark.parametrize("name", ["dense", "sparse"])
@pytest.mark.parametrize("contenders", [1024, 5])
def test_rank_sums_without_lists(spark, mixed, monkeypatch, name, contenders):  # noqa: F811
    rankers, rank = mixed
    monkeypatch.setattr(scan, "CONTENDERS", contenders)
    monkeypatch.setattr(scan, "SAMPLE", 40)
    monkeypatch.setattr(scan, "TEXTS", 4)
    lines = [("b", q, name, (q + v) % 5, 1.0 + (v == 1)) for q in range(5) for v in range(3)] + [("one", 7, name, 2, 1.0)]
    plan = spark.createDataFrame(lines, "config string, qid int, ranker string, text_id bigint, weight double")
    # with few contenders a task some sums stay open and are searched in lists
    ranker = NoLists(rankers[name]) if contenders > 300 else rankers[name]
    got = fusion.fuse_borda(plan, {name: ranker}, 4, depth=8).collect()
    for q in (*range(5), 7):
        total = sum(w * (rank[name, t] - 1) for _, i, _, t, w in lines if i == q)
        want = np.lexsort((np.arange(300), total))[:4]
        mine = sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])
        assert [r.doc_id for r in mine] == want.tolist()
        assert [-r.score for r in mine] == total[want].tolist()


def test_rank_bounds_hold_the_rank():
    rng = np.random.default_rng(3)
    near = rng.integers(0, 40, (3, 500)).astype(np.float32) / 7
    slack = np.array([1e-6, 0.1, 1.0])
    parts = [(np.arange(0, 200), near[:, :200], None, slack), (np.arange(200, 500), near[:, 200:], None, slack)]
    edges = scan._edges([(None, near[:, ::9], None, slack)], np.full(3, 6.0))
    counts = np.pad(scan._histogram(parts, edges), ((0, 0), (0, 1)))
    low, high = scan._rank_bounds(near, slack, edges, np.cumsum(counts[:, ::-1], axis=1)[:, ::-1])
    true = near + rng.uniform(-1, 1, near.shape) * slack[:, None]
    place = (-true).argsort(axis=1).argsort(axis=1)
    assert (low <= place).all() and (place <= high).all()
    assert (high - low)[0].max() < 150


def test_pairs_from_counted_words(spark):
    from rankforge.functions import text as X

    docs = ["Anna bananas a, é\U0001d518x anna", None, "", "!?", "x", "naïve İstanbul ß 12 1234 bananas", "word " * 700]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    t = spark.createDataFrame([(0, "banana annals"), (1, "x"), (2, "")], "text_id bigint, text string")
    words = sparse.LexicalRanker(t, d, X.tokenize_words).index
    plain = sparse.LexicalRanker(t, d, X.tokenize_bigrams)
    listed = lambda index: {r.doc_id: (r.dl, dict(zip(r.terms, r.tfs)), len(r.terms)) for r in index.collect()}
    want, ranks = listed(plain.index), sorted(plain.top(7).collect())
    assert len(want) == len(docs)
    for given in (None, words):
        # no pair is made by an expression over every character of every document
        ranker = sparse.LexicalRanker(t, d, X.tokenize_bigrams, split=X.word_pairs, words=given)
        assert listed(ranker.index) == want and sorted(ranker.top(7).collect()) == ranks

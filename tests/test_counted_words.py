"""Vectors, pairs and ranks from words counted once are those of the texts themselves."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from rankforge.functions import text as X
from rankforge.models import counted_embedder, hash_embedder, overlap_scorer
from rankforge.operators import containment, fusion, rerank, scan, sparse
from rankforge.plans import lexical_search
from tests.conftest import plan_of
from tests.test_retrieval import QUERIES, corpus, lexical_order, mixed, text_frames  # noqa: F401

TEXTS = ["Anna bananas a, é\U0001d518x anna", "", "!?", "x", "naïve İstanbul ß 12 1234 bananas 한국어", "word " * 700]


def test_vectors_from_counted_words(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    words = sparse.LexicalRanker(docs.select(F.col("doc_id").alias("text_id"), "text"), docs, X.tokenize_words).index
    counted = words.select("doc_id", counted_embedder(F.col("terms"), F.col("tfs")).alias("vector"))
    plain = docs.select("doc_id", hash_embedder(F.col("text")).alias("vector"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, plain.collect()))


def test_rankers_tokenise_the_corpus_once(spark, sf, monkeypatch):
    """Neither the vectors nor the pairs read the texts of the documents again."""
    read = []
    real = lexical_search.documents
    monkeypatch.setattr(lexical_search, "documents", lambda *a: read.append(a) or real(*a))
    texts = lexical_search.passages(spark, sf).limit(2)
    lexical_search.rankers(spark, sf, texts, ("dense", "sparse", "words"))
    assert len(read) == 1


def test_pairs_of_many_words_are_those_of_each():
    for words in (["a", "", "ab", "éx", "\U0001d518x", "b", "abab"], [], ["a"], ["한국어", "x\x00y"]):
        each, code, names = X.word_pairs.of_words(words)
        made = np.split(np.array([names[i] for i in code], dtype=object), np.cumsum(each)[:-1]) if words else []
        assert [x.tolist() for x in made] == [X.word_pairs(w) for w in words]


def test_entries_hold_only_terms_of_texts(spark):
    docs = corpus(n=300)
    d, t = text_frames(spark, docs, QUERIES)
    ranker = fusion.LexicalRanker(t, d)
    table, number = ranker.entries()
    asked = {w for q in QUERIES for w in q.lower().split()}
    assert set(number) <= asked
    held = {r.doc_id: np.frombuffer(r.held, np.int32).reshape(-1, 2).tolist() for r in table.collect()}
    for r in ranker.index.collect():
        assert held[r.doc_id] == [[number[w], n] for w, n in zip(r.terms, r.tfs) if w in number]


def test_groups_of_texts_leave_out_most_products():
    rng = np.random.default_rng(5)
    lines = [(i, f"t{(i // 5) * 40 + j:04d}", float(rng.uniform(0.5, 2))) for i in range(100) for j in rng.choice(40, 20, False)]
    texts = vars(sparse._Texts(list(range(101)), lines))
    near = np.zeros((101, len(texts["first"]) - 1))
    for rows, terms, weights in sparse._groups(texts):
        near[np.ix_(rows, terms)] = weights
    want = np.zeros_like(near)
    for i, term, weight in lines:
        want[i, texts["terms"][term]] = np.float32(weight)
    assert (near == want).all()
    assert sum(w.size for _, _, w in sparse._groups(texts)) < 0.1 * near.size


def test_marks_are_scored_only_where_close():
    """Of a part without ties only documents near a mark are scored exactly."""
    rng = np.random.default_rng(2)
    scores, slack, asked = rng.normal(size=(3, 5_000)), np.full(3, 1e-6), []

    def parts():
        for at in range(0, 5_000, 1_000):
            some = scores[:, at : at + 1_000]
            exact = lambda i, at, some=some: asked.append(len(at)) or some[i, at]
            yield np.arange(at, at + 1_000), some.astype(np.float32), exact, slack

    marks = []
    for row in scores:
        ids = rng.choice(5_000, 40, False)
        ids = ids[np.argsort(-row[ids])]
        marks.append((-row[ids], ids))
    gaps = scan.ahead(parts(), marks)
    for row, (mark, _), gap in zip(scores, marks, gaps):
        assert np.cumsum(gap)[:-1].tolist() == [int((row > -m).sum()) for m in mark]
        assert gap.sum() == 5_000
    assert sum(asked) < 400


@pytest.mark.parametrize("name", ["dense", "sparse"])
@pytest.mark.parametrize("high", [False, True])
def test_bars_from_a_sample(spark, mixed, monkeypatch, name, high):  # noqa: F811
    """Lists are whole whether the sample's bars are far enough down or, found too short, all documents are marked."""
    rankers, rank = mixed
    monkeypatch.setattr(scan, "FREE_ROWS", 0)
    monkeypatch.setattr(scan, "LIST_SAMPLE", 10)
    monkeypatch.setattr(scan, "LIST_PLACE", 130 / 4)
    asked = []
    real = scan.bars

    def bars(*a):
        found = real(*a)
        asked.append(a[-1])
        assert None not in found
        return [(score + 10, i) for score, i in found] if high and len(asked) == 1 else found

    monkeypatch.setattr(scan, "bars", bars)
    got = rankers[name].top(130).collect()
    assert len(asked) == 1 + high
    for text in {r.text_id for r in got}:
        mine = [r.doc_id for r in sorted((r for r in got if r.text_id == text), key=lambda r: r["rank"])]
        assert mine == np.argsort(rank[name, text])[:130].tolist()


@pytest.mark.parametrize("offered", [4_000_000, 1])
def test_containment_sends_only_triples_of_passages(spark, monkeypatch, offered):
    rng = np.random.default_rng(4)
    spaces = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\f", " ", " "]
    word = lambda: "".join(rng.choice(list("abéß한"), rng.integers(1, 3)))
    docs = ["".join(word() + rng.choice(spaces) for _ in range(rng.integers(1, 60))) for _ in range(150)] + ["", None, "a b", " "]
    cut = lambda t: t[(at := int(rng.integers(0, max(1, len(t) - 30)))) : at + int(rng.integers(1, 40))]
    passages = [cut(rng.choice(docs[:150])) for _ in range(40)] + ["a a a a a a", "b", " a b a b a b ", "é", None]
    d = spark.createDataFrame([*enumerate(docs), (3, docs[3])], "doc_id bigint, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(passages)), "qid bigint, text string")
    sent = []
    real = containment.materialize
    monkeypatch.setattr(containment, "materialize", lambda df: sent.append((df.columns, real(df))) or sent[-1][1])
    monkeypatch.setattr(containment, "OFFERED", offered)
    got = {tuple(r) for r in containment.containing(d, p).select("qid", "doc_id").collect()}
    want = {(i, j) for i, x in enumerate(passages) for j, t in enumerate(docs) if x is not None and t is not None and x in t}
    assert got == want
    grams = {r.gram for columns, df in sent if columns == ["qid", "gram"] for r in df.collect()}
    assert {r.gram for columns, df in sent if columns == ["doc_id", "gram"] for r in df.collect()} <= grams


def test_only_named_documents_meet_the_pairs(spark):
    hits = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("a", 2, 5), ("a", 3, 99)], "config string, qid bigint, doc_id bigint")
    texts = spark.createDataFrame([(1, "x y"), (2, "z")], "qid bigint, query string")
    docs = spark.createDataFrame([(i, "x z" if i % 2 else "x") for i in range(10)], "doc_id bigint, text string")
    table = rerank.pair_table(hits, texts, docs, overlap_scorer)
    assert sorted(map(tuple, table.collect())) == [(1, 2, 0.5), (2, 5, 1.0)]
    assert "LeftSemi" in plan_of(table)

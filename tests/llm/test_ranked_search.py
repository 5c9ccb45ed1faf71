"""NRA search against plain scores, with many blocks, parts, ties and repeated rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import ranked_search as rs

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, items, k):
    """[(item_id, rank, doc_id, score)] of every item row."""
    counts = [(i, collections.Counter(_words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            long = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * long))
                for t in _words(text)
                if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(50)] + [(3, docs[3][1]), (None, docs[3][1]), (None, None), (7, "")]
    items = [(i, text(rng.randint(1, 12))) for i in range(40)] + [(0, docs[3][1]), (None, "w0 w1"), (5, None), (6, "unseen words"), (7, "W0 w0 w0")]
    return docs, items


def test_against_plain_scores(spark, made):
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    expected = plain(docs, items, 20)
    assert got(rs.search(d, i)) == expected
    # small parts of the items and small blocks of the documents change nothing
    assert got(rs.search(d, i, part_words=40, postings=300)) == expected


def test_empty_tables(spark, made):
    docs, items = made
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id string, text string")
    assert rs.search(d.filter("false"), i).collect() == []
    none = rs.search(d, i.filter("false"))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0


def test_rounds_stop_early_and_resolve():
    """Lists are not read to their ends, and the documents left have final scores."""
    rng = np.random.default_rng(2)
    n, read = 20_000, []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop is not None:
                read.append(min(at.stop, len(self)) - (at.start or 0))
            return super().__getitem__(at)

    lists, full = [], np.zeros(n, np.int64)
    for _ in range(3):
        docs = rng.permutation(n)
        scores = np.sort((1e6 / (1 + np.arange(n))).astype(np.int64))[::-1] + 1
        full[docs] += scores
        lists.append((docs.view(Counted), scores))
    docs, scores = rs._resolve(lists, n, 10, 1)
    assert (full[docs] == scores).all()
    assert sorted(-full)[:10] == sorted(-scores)[:10]
    assert sum(read) < 3 * n

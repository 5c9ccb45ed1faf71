"""Merged tokens and their windows against the public library."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from rankforge.operators import tokens
from rankforge.plans.chunks import RANKS_PATH


@pytest.fixture(scope="module")
def ranks():
    return tokens.read_ranks(RANKS_PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(2)
    made = ["", " ", "a", "don't  stop\n\n now", "x" * 3000, "한국어 문서 😀😀 naïve", "".join(rng.choices("ab한😀 \n'", k=900))]
    return made + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").where("text is not null").collect()]


def test_tokens_are_the_librarys(ranks, library, texts):
    kept = {}
    for text in texts:
        ids = library.encode_ordinary(text)
        ends = tokens.token_ends(text, ranks, kept)
        at, expected = 0, []
        for token in ids:
            at += len(library.decode_single_token_bytes(token))
            expected.append(len(text.encode()[:at].decode("utf-8", "ignore")))
        assert ends.tolist() == expected


def test_windows(spark, library, texts):
    df = spark.createDataFrame(list(enumerate([*texts, None])), "i int, text string").withColumn("row", F.lit("x"))
    got = {}
    for r in tokens.token_window_chunks(df, RANKS_PATH, 40, 10, min_len=1).collect():
        got.setdefault(r.i, []).append((r.chunk_index, r.n_tokens, r.chunk))
    for i, text in enumerate(texts):
        data = [library.decode_single_token_bytes(t) for t in library.encode_ordinary(text)]
        windows, first = [], 0
        while first < len(data):
            lo, hi = (len(b"".join(data[:k]).decode("utf-8", "ignore")) for k in (first, first + 40))
            windows.append((min(40, len(data) - first), text[lo:hi].strip()))
            if first + 40 >= len(data):
                break
            first += 30
        windows = [w for w in windows if w[1]]
        assert sorted(got.get(i, [])) == [(k, *w) for k, w in enumerate(windows)], i
    assert len(texts) not in got

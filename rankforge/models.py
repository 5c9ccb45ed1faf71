"""Model slots: columns produced by user functions, with offline stand-ins.

An embedder maps a text column to ``array<float>``, a scorer maps (query,
text) columns to a double, a generator maps a prompt to text. Any pandas UDF
of that shape fits. The stand-ins below are deterministic and say nothing
about model quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions.text import tokenize_words

HASH_DIM = 64


def hash_buckets(text: Column, dim: int = HASH_DIM) -> Column:
    return F.transform(
        tokenize_words(text),
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"),
    )


def hash_embedder(text: Column, dim: int = HASH_DIM) -> Column:
    """Word counts by hash bucket; stands in for an embedding model."""

    @F.pandas_udf("array<float>")
    def count(buckets: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(b, minlength=dim).astype(np.float32) for b in buckets])

    return count(hash_buckets(text, dim))


def counted_embedder(terms: Column, counts: Column, dim: int = HASH_DIM) -> Column:
    """The vector that ``hash_embedder`` makes of a text, from its distinct words and their counts; a word is hashed once a batch."""

    @F.arrow_udf("array<float>")
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, counts in batches:
            words = terms.flatten().dictionary_encode()
            names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            digests = b"".join([hashlib.md5(w.encode()).digest() for w in names])
            bucket = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dim
            sizes = pa.compute.list_value_length(terms).fill_null(0).to_numpy(zero_copy_only=False)
            doc, code = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy(zero_copy_only=False)
            cell = doc * dim + bucket[code.astype(np.int64)] if len(code) else doc
            tfs = counts.flatten().to_numpy(zero_copy_only=False)
            made = np.bincount(cell, tfs, len(sizes) * dim).astype(np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dim, pa.int32()), pa.array(made))

    return count(terms, counts)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of distinct query words in the text; stands in for a cross-encoder."""
    words = F.array_distinct(tokenize_words(query))
    shared = F.size(F.array_intersect(words, tokenize_words(text)))
    return F.coalesce(F.try_divide(shared, F.size(words)), F.lit(0.0))


def word_overlap(fails=lambda query, text: False):
    """A pair model for tests and queries: share of the query's distinct words in the text.

    Raises for pairs that ``fails`` picks.
    """

    def make():
        def score(queries, texts):
            if any(map(fails, queries, texts)):
                raise ValueError("pair refused")
            sets = [(set(q.split()), set(t.split())) for q, t in zip(queries, texts)]
            return [len(q & t) / len(q) if q else 0.0 for q, t in sets]

        return score

    return make

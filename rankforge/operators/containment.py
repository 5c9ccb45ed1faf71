"""Which documents hold a passage word for word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.session import broadcast_if_small, bounded_batches, has_at_most, materialize

GRAM = 3
# triples of passages that a task is sent
OFFERED = 4_000_000
# of the hashes: two odd numbers, and the bytes that the pattern below calls white space
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
SHORT_BLOCK = 1000


def _words(text):
    return F.split(text, r"\s+")


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n):
        if n > len(self.up):
            self.up, self.down = (
                np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, x, np.uint64))]) for x in (BASE, pow(BASE, -1, 1 << 64))
            )
        return self.up, self.down


def _grams(batch, powers):
    """``(row, gram)`` of the word triples of a column of texts; words are cut at white space, as bytes.

    A word's hash is a difference of sums over the bytes; equal hashes of other
    words only bring more texts to be tested.
    """
    text = batch.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    # a word begins where its text does, too
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[ends] = True
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    up, down = powers.of(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = (sums[last] - sums[first]) * down[first]
    word ^= word >> np.uint64(29)
    n = max(0, len(word) - GRAM + 1)
    gram = np.zeros(n, np.uint64)
    for i in range(GRAM):
        gram = (gram + word[i : i + n]) * np.uint64(MIX)
        gram ^= gram >> np.uint64(32)
    row = np.searchsorted(ends, first, "right") - 1
    whole = row[:n] == row[GRAM - 1 : GRAM - 1 + n]
    return row[:n][whole], gram[whole]


def _slices(batch, most=1 << 20):
    """Parts of a batch of at most so many bytes of its second column, but for single rows."""
    sizes = pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _gram_batches(batches, wanted=None):
    """``(id, gram)``, once per row, of rows ``(id, text)``; of the grams wanted, in order, if they are given."""
    powers = _Powers()
    if wanted is not None:
        likely = np.zeros(1 << 22, dtype=bool)
        likely[wanted >> np.uint64(42)] = True
    for part in (p for batch in batches for p in _slices(batch)):
        row, gram = _grams(part.column(1), powers)
        if wanted is not None:
            some = np.flatnonzero(likely[gram >> np.uint64(42)])
            row, gram = row[some], gram[some]
            place = np.minimum(np.searchsorted(wanted, gram), max(0, len(wanted) - 1))
            some = wanted[place] == gram if len(wanted) else np.zeros(0, dtype=bool)
            row, gram = row[some], gram[some]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (np.diff(row) != 0) | (gram[1:] != gram[:-1])
        columns = [part.column(0).take(pa.array(row[new], pa.int64())), pa.array(gram[new].view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "gram"])


def _held(rows, run):
    """``(id, gram)`` of the texts of ``rows (id, text)``."""
    return rows.mapInArrow(run, T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("gram", T.LongType())]))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(qid, doc_id)`` for ``docs (doc_id, text)`` and ``passages (qid, text)``.

    A passage's inner words are whole words of any document that holds it, so
    each of its inner word triples finds all its documents. The triple found in
    the fewest documents is taken; documents meet it by its hash, and
    the text test runs on the few pairs that remain. Passages too short for a
    triple are tested directly, in blocks, where a document is read.
    """
    bounded_batches(docs.sparkSession)
    p = passages.select("qid", F.col("text").alias("passage"), _words(F.col("text")).alias("pw"))
    # the first and the last word may be cut inside a document word
    long, short = p.where(F.size("pw") >= GRAM + 2), p.where(F.size("pw") < GRAM + 2)
    inner = F.array_join(F.slice("pw", 2, F.size("pw") - 2), " ")
    offered = materialize(_held(long.select("qid", inner.alias("text")), _gram_batches).toDF("qid", "gram"))
    names = offered.select("gram").distinct()
    words = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    if has_at_most(names, OFFERED):
        # triples that no passage has are left out where a document is read
        grams = np.sort(names.toArrow().column("gram").to_numpy().view(np.uint64))
        wanted = docs.sparkSession.sparkContext.broadcast(grams)
        met = _held(words, lambda batches: _gram_batches(batches, wanted.value))
    else:
        met = _held(words, _gram_batches).join(names, "gram").select("id", "gram")
    met = materialize(met.toDF("doc_id", "gram"))
    counts = met.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchor = (
        offered.join(counts, "gram")
        .groupBy("qid")
        .agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    )
    pairs = materialize(met.join(anchor, "gram").select("qid", "doc_id"))
    named = broadcast_if_small(pairs.select("doc_id").distinct())
    found = (
        pairs.join(docs.select("doc_id", "text").join(named, "doc_id", "left_semi"), "doc_id")
        .join(long.select("qid", "passage"), "qid")
        .where(F.contains("text", "passage"))
        .select("qid", "doc_id")
        .distinct()
    )
    for block in _blocks(short):
        listed = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t).alias("passage")) for q, t in block])
        hits = F.filter(listed, lambda x: F.contains(F.col("text"), x["passage"]))
        direct = docs.select("doc_id", F.explode(hits).alias("hit")).select("hit.qid", "doc_id")
        found = found.unionByName(direct.select(F.col("qid").cast(passages.schema["qid"].dataType), "doc_id"))
    return found


def _blocks(short):
    """Short passages in lists of bounded length."""
    block = []
    for row in short.select("qid", "passage").toLocalIterator():
        block.append((row["qid"], row["passage"]))
        if len(block) == SHORT_BLOCK:
            yield block
            block = []
    if block:
        yield block

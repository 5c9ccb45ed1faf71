"""Best documents of each item by exact lexical scores: NRA over impact-sorted lists.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
term's weight comes from the corpus counts, its impact in a document from the
document's term count and length, both in integers. A task turns its documents,
block by block, into one list of (impact, document) per term, sorted by impact,
and answers every item from these lists by sorted access only. Reading goes in
rounds, all of an item's lists together. A document's score lies between what
was read of it (lower) and that plus the last impact read of each list in which
it was not met yet (upper). Rounds go on until no other document can reach the
k-th lower score, equal scores included; then the lists are read on for the
documents left until their scores are final. A task keeps its k best per item,
whose least score is a floor for its later blocks, and Spark merges the tasks'
lists by a limited window.

The items are read in parts of at most ``PART_WORDS`` words, each part one pass
for the counts and one for the search, so what a task holds of them is bounded;
a document block has at most ``POSTINGS`` entries besides one text's. Terms are
told apart by 64-bit hashes.

Defined cases: a null text has no terms; documents without terms count nowhere;
every row of the items is an item of its own, also where ids repeat or are null,
and one without terms known to the corpus has no rows; every row of the documents
is a document of its own; a null doc_id comes after the others of its score.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm import words

PART_WORDS = 100_000
POSTINGS = 2_000_000
#: Entries of each list that the first round reads; every round reads twice as many as the last.
FIRST_READ = 32
_DOCS, _WORDS = -1, -2


class Items:
    """Some items as (term place, repeats) lists over their sorted distinct term hashes."""

    def __init__(self, ids, texts):
        self.ids, hashes, item = ids, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for block in words.blocks(pa.array(texts, pa.string()), words.NOT_ALNUM):
            hashes.append(block.hashes())
            item.append(block.texts_of_words() + block.first_row)
        self.terms, place = np.unique(np.concatenate(hashes), return_inverse=True)
        pairs, repeats = np.unique(np.stack([np.concatenate(item), place]), axis=1, return_counts=True)
        self.items = [(pairs[1, pairs[0] == i], repeats[pairs[0] == i]) for i in range(len(texts))]
        self.weights = self.docs = self.words = None

    def weigh(self, counts):
        self.docs, self.words = counts.get(_DOCS, 0), counts.get(_WORDS, 0)
        top = 2 * self.docs + 2
        df = (counts.get(t, 0) for t in range(len(self.terms)))
        self.weights = np.array([math.floor(1000 * math.log(top / (2 * n + 1))) for n in df], dtype=np.int64)

    def met(self, block):
        """(text, term place) of each word of a block that is a term, and the words of each text."""
        hashes = block.hashes()
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == hashes if len(self.terms) else np.zeros(len(hashes), bool)
        return block.texts_of_words()[known], at[known], np.diff(block.first)


def _item_parts(items: DataFrame, part_words: int):
    """Items in parts of bounded size, read one part at a time."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        text = row["text"] or ""
        # no text has more words than half its characters and one
        more = len(text) // 2 + 1
        if texts and size + more > part_words:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += more
    if texts:
        yield Items(ids, texts)


def _count(batches, items):
    """Documents that hold each term, documents with terms, and words, of one task."""
    held, docs, total = np.zeros(len(items.terms), np.int64), 0, 0
    for batch in batches:
        for block in words.blocks(batch.column(0), words.NOT_ALNUM):
            text, term, n = items.met(block)
            held += np.bincount(np.unique(text * len(items.terms) + term) % max(len(items.terms), 1), minlength=len(held))
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays(
        [pa.array([_DOCS, _WORDS, *some], pa.int64()), pa.array([docs, total, *held[some]], pa.int64())], names=["term", "n"]
    )


class _Best:
    """The k best (score, id) so far of each item; a missing id comes last among equals."""

    def __init__(self, n, k):
        self.k, none = k, np.zeros(0, np.int64)
        self.rows = [(none, none, none.astype(bool))] * n

    def floor(self, i):
        scores = self.rows[i][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, i, scores, ids, missing):
        scores, ids, missing = (np.concatenate([a, b]) for a, b in zip(self.rows[i], (scores, ids, missing)))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.rows[i] = scores[order], ids[order], missing[order]


def _resolve(lists, n_docs, k, floor):
    """Documents that may be among the k best of a block, with final scores.

    ``lists``: (documents, scores) per term, highest score first. Documents that
    cannot reach ``floor`` may be left out.
    """
    lower, seen = np.zeros(n_docs, np.int64), np.zeros((len(lists), n_docs), bool)
    at, step = 0, FIRST_READ
    longest = max((len(d) for d, _ in lists), default=0)
    while True:
        end = at + step
        bounds = np.zeros(len(lists), np.int64)
        for t, (docs, scores) in enumerate(lists):
            read = docs[at:end]
            lower[read] += scores[at:end]
            seen[t, read] = True
            if end < len(docs):
                bounds[t] = scores[end - 1]
        met = np.flatnonzero(lower)
        low = lower[met]
        least = floor
        if len(met) >= k:
            least = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
        high = low + bounds.sum() - bounds @ seen[:, met].astype(np.int64)
        left = met[high >= least]
        at, step = end, 2 * step
        if at >= longest:
            return left, lower[left]
        if bounds.sum() < least and (len(left) <= k or bool((high == low)[high >= least].all())):
            break
    # membership is settled: read on for these documents alone until nothing is open
    kept = np.zeros(n_docs, bool)
    kept[left] = True
    for docs, scores in lists:
        rest = kept[docs[at:]]
        lower[docs[at:][rest]] += scores[at:][rest]
    return left, lower[left]


def _answer(items, best, text, term, tf, size, ids, missing):
    """Answer every item from one block's lists."""
    long = 75 + (25 * size * items.docs) // items.words
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * long[text])
    order = np.lexsort((text, -impact, term))
    text, impact = text[order], impact[order]
    starts = np.searchsorted(term[order], np.arange(len(items.terms) + 1))
    for i, (terms, repeats) in enumerate(items.items):
        lists = []
        for t, r in zip(terms.tolist(), repeats.tolist()):
            lo, hi = starts[t], starts[t + 1]
            if hi > lo and items.weights[t]:
                lists.append((text[lo:hi], impact[lo:hi] * (int(items.weights[t]) * r)))
        if lists:
            docs, scores = _resolve(lists, len(size), best.k, best.floor(i))
            best.add(i, scores, ids[docs], missing[docs])


def _search(batches, items, k, postings):
    best = _Best(len(items.items), k)
    held, n_docs, n_entries = [], 0, 0

    def flush():
        if n_entries:
            _answer(items, best, *(np.concatenate(c) for c in zip(*held)))

    for batch in batches:
        ids = batch.column(0)
        missing = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        for block in words.blocks(batch.column(1), words.NOT_ALNUM):
            text, term, n = items.met(block)
            pairs, tf = np.unique(text * len(items.terms) + term, return_counts=True)
            rows = slice(block.first_row, block.first_row + len(block))
            width = max(len(items.terms), 1)
            held.append((n_docs + pairs // width, pairs % width, tf.astype(np.int64), n.astype(np.int64), ids[rows], missing[rows]))
            n_docs, n_entries = n_docs + len(block), n_entries + len(pairs)
            if n_entries >= postings:
                flush()
                held, n_docs, n_entries = [], 0, 0
    flush()
    for i, (scores, found, gone) in enumerate(best.rows):
        if len(scores):
            columns = [
                pa.array(np.full(len(scores), i)),
                pa.array(found, pa.int64(), mask=gone),
                pa.array(scores),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 20, part_words: int = PART_WORDS, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best ``doc_id, text`` rows of each ``item_id, text`` row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    names = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType)])
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = []
    for part in _item_parts(items, part_words):
        counts = docs.select("text").mapInArrow(lambda b, part=part: _count(b, part), "term long, n long")
        part.weigh({r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()})
        best = docs.mapInArrow(lambda b, part=part: _search(b, part, k, postings), "item long, doc_id long, score long")
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame(list(enumerate(part.ids)), names)
        found.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        empty = T.StructType([names["item_id"], *T._parse_datatype_string("rank int, doc_id long, score long").fields])
        return spark.createDataFrame([], empty)
    return functools.reduce(DataFrame.unionByName, found)

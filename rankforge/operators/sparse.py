"""BM25: documents are scored in the task that holds them.

The corpus is tokenised once into a table of term counts per document. Texts
are taken in blocks of bounded size; a block's weighted terms are broadcast, the
table streams past, and a task keeps the best ``n`` documents of each text, or
only counts the documents ahead of given ones. No table of texts times
documents is ever formed. Short lists leave out blocks of documents by bounds;
for longer ones a part's near scores are products of groups of texts and the
terms they share, over a table of these terms only, and what they cannot leave
out is scored exactly. Parts are bounded in documents and in entries.
"""

from __future__ import annotations

import functools
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rankforge.functions.text import tokenize_words
from rankforge.operators import scan
from rankforge.operators.scan import first_places as _first
from rankforge.session import bounded_batches, broadcast_if_small, materialize

# Okapi defaults.
K1 = 1.5
B = 0.75
EPSILON = 0.25

# bounds of what a task is sent or keeps: weighted terms, kept rows, weight cells, score cells, entries of a part
BLOCK_TERMS = 300_000
BLOCK_ROWS = 4_000_000
WEIGHT_CELLS = 16_000_000
CELLS = 4_000_000
ENTRIES = 400_000
# documents of a block with score bounds of its own
BLOCK_DOCS = 128
# what taking a term's gains to a group of texts costs, in products
GATHER = 10


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token list, counted inside the row.

    Equal tokens stand together once sorted, so a count is the distance
    between the places where the token changes; nothing is shuffled.
    """
    ordered = F.sort_array(tokens)
    with_starts = F.transform(
        F.array(F.struct(ordered.alias("t"))),
        lambda o: F.struct(
            o["t"].alias("t"),
            F.filter(
                F.when(F.size(o["t"]) > 0, F.sequence(F.lit(0), F.size(o["t"]) - 1)).otherwise(F.array().cast("array<int>")),
                lambda i: (i == 0) | (F.get(o["t"], i) != F.get(o["t"], i - 1)),
            ).alias("at"),
        ),
    )
    counted = F.transform(
        with_starts,
        lambda o: F.transform(
            o["at"],
            lambda start, j: F.struct(
                F.get(o["t"], start).alias("term"),
                (F.coalesce(F.get(o["at"], j + 1), F.size(o["t"])) - start).alias("tf"),
            ),
        ),
    )
    return F.get(counted, 0)


def document_terms(docs: DataFrame, tokenize=tokenize_words, id_col="doc_id", text_col="text") -> DataFrame:
    """``(id_col, dl, term, tf)``; made where the document was read."""
    # the outer form keeps Spark from testing the token list in a filter first
    return (
        docs.select(F.col(id_col), tokenize(F.col(text_col)).alias("tokens"))
        .select(id_col, F.size("tokens").alias("dl"), F.explode_outer(term_counts(F.col("tokens"))).alias("p"))
        .select(id_col, "dl", "p.term", "p.tf")
    )


def query_terms(queries: DataFrame, tokenize=tokenize_words, keys=("qid",), text_col="text") -> DataFrame:
    """``(*keys, term, qtf)``; a repeated query word counts each time."""
    return (
        queries.select(*keys, F.explode(tokenize(F.col(text_col))).alias("term"))
        .groupBy(*keys, "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


class _Texts:
    """Weighted terms of a block of texts: plain values, to be broadcast."""

    def __init__(self, ids, lines):
        """``lines``: (text number, term, weight) triples."""
        self.ids = ids
        lines = sorted(lines, key=lambda x: x[1])
        self.terms, firsts = {}, []
        for i, (_, term, _) in enumerate(lines):
            if term not in self.terms:
                self.terms[term] = len(firsts)
                firsts.append(i)
        self.first = np.array([*firsts, len(lines)], dtype=np.int64)
        self.text = np.array([x[0] for x in lines], dtype=np.int64)
        self.weight = np.array([x[2] for x in lines], dtype=np.float64)


def _numbers(column):
    return column.to_numpy(zero_copy_only=False)


def _parts(batch, lists, most, share=1):
    """Slices of a batch with at most ``most`` rows and, but for single rows, ``ENTRIES // share`` entries of a list column."""
    sizes = _numbers(pa.compute.list_value_length(batch.column(lists)).fill_null(0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        held = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENTRIES // share, "right"))
        end = min(max(held, at + 1), at + most)
        yield batch.slice(at, end - at)
        at = end


def _count_batches(batches):
    """Distinct terms and their counts per document, by codes of the part's terms."""
    for batch in (part for whole in batches for part in _parts(whole, 1, whole.num_rows)):
        ids, lists = batch.column(0), batch.column(1)
        sizes = _numbers(pa.compute.list_value_length(lists)).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        n = max(1, len(words.dictionary))
        code = _numbers(words.indices).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        cells, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + code, return_counts=True)
        ends = pa.array(np.searchsorted(cells, np.arange(len(sizes) + 1) * n), pa.int32())
        terms = words.dictionary.take(pa.array(cells % n)) if len(words) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                ids, pa.array(sizes.astype(np.int32)),
                pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
            ],
            names=["doc_id", "dl", "terms", "tfs"],
        )


def _split_batches(batches, split):
    """As ``_count_batches`` from counted words, each distinct word of a part split once."""
    # a word makes several terms
    for part in (p for batch in batches for p in _parts(batch, 2, batch.num_rows, 8)):
        words = part.column(2).flatten().dictionary_encode()
        each, code, names = getattr(split, "of_words", functools.partial(_each_split, split))(_numbers(words.dictionary).tolist())
        n = max(1, len(names))
        word = _numbers(words.indices).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        tf, counts = _numbers(part.column(3).flatten()).astype(np.int64), each[word]
        doc = np.repeat(np.arange(part.num_rows), _numbers(pa.compute.list_value_length(part.column(2))))
        at = _expand((np.cumsum(each) - each)[word], counts) if len(word) else word
        cells, sums = _sums(np.repeat(doc, counts) * n + code[at], np.repeat(tf, counts), part.num_rows * n)
        sizes = np.bincount(doc, tf * counts, part.num_rows).astype(np.int32)
        ends = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * n), pa.int32())
        held = pa.array(names, pa.string()).take(pa.array(cells % n)) if len(cells) else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(sizes), pa.ListArray.from_arrays(ends, held), pa.ListArray.from_arrays(ends, pa.array(sums.astype(np.int32)))],
            names=["doc_id", "dl", "terms", "tfs"],
        )


def _each_split(split, words):
    """``(terms of each word, their numbers, distinct terms)`` by a function of one word."""
    made, numbers = [split(w) for w in words], {}
    code = [numbers.setdefault(x, len(numbers)) for one in made for x in one]
    return np.array([len(x) for x in made], dtype=np.int64), np.array(code, dtype=np.int64), list(numbers)


def _sums(cells, values, n):
    """Distinct cells, ascending, with the sums of their values; counted in a table where cells fill enough of it."""
    if n <= 16 * len(cells):
        table = np.bincount(cells, values, n)
        # every value is at least 1
        found = np.flatnonzero(table)
        return found, table[found]
    found, place = np.unique(cells, return_inverse=True)
    return found, np.bincount(place, values, len(found))


def _term_batches(batches):
    """``(term, df)`` of the documents of each batch, whose terms are distinct."""
    for batch in batches:
        terms = batch.column(0).flatten().dictionary_encode()
        if len(terms):
            counts = np.bincount(_numbers(terms.indices), minlength=len(terms.dictionary))
            yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(counts, pa.int64())], names=["term", "df"])


def _entry_batches(batches, known):
    """``(doc_id, dl, held)``: of each document the numbers and counts of the terms known, as pairs of whole numbers."""
    for batch in batches:
        terms = batch.column(2).flatten().dictionary_encode()
        number = _numbers(pa.compute.index_in(terms.dictionary, value_set=known).fill_null(-1)).astype(np.int32)
        code = number[_numbers(terms.indices)] if len(terms) else np.zeros(0, np.int32)
        doc = np.repeat(np.arange(batch.num_rows), _numbers(pa.compute.list_value_length(batch.column(2)).fill_null(0)))
        some = np.flatnonzero(code >= 0)
        pairs = np.stack([code[some], _numbers(batch.column(3).flatten())[some].astype(np.int32)], axis=1)
        ends = np.searchsorted(doc[some], np.arange(batch.num_rows + 1)) * 8
        held = pa.Array.from_buffers(
            pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(pairs))]
        ).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["doc_id", "dl", "held"])


def _expand(first, counts):
    """``first``, ``first + 1``, ... of each slice, one after another."""
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return shift + np.arange(int(counts.sum()))


def _postings(part, texts, avgdl, k1, b):
    """``(ids, document, term, gain)`` of the entries of a part whose term some text uses."""
    ids, dl = _numbers(part.column(0)), _numbers(part.column(1)).astype(np.float64)
    sizes = _numbers(pa.compute.list_value_length(part.column(2)).fill_null(0))
    words = part.column(2).flatten().dictionary_encode()
    known = np.array([texts["terms"].get(w, -1) for w in _numbers(words.dictionary)] or [-1], dtype=np.int64)
    term = known[_numbers(words.indices)] if len(words) else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(part.num_rows), sizes)[term >= 0]
    tf = _numbers(part.column(3).flatten()).astype(np.float64)[term >= 0]
    gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)) if len(doc) else tf
    return ids, doc, term[term >= 0], gain


def _entries(part, texts, avgdl, k1, b):
    """``(ids, document, term, gain)`` as ``_postings``, of a part of the table of entries."""
    ids, dl, held = _numbers(part.column(0)), _numbers(part.column(1)).astype(np.float64), part.column(2)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 8
    pairs = np.frombuffer(held.buffers()[2] or b"", np.int32).reshape(-1, 2)[ends[0] : ends[-1]]
    term = texts["local"][pairs[:, 0]]
    some = np.flatnonzero(term >= 0)
    doc, tf = np.repeat(np.arange(len(ids)), np.diff(ends))[some], pairs[some, 1].astype(np.float64)
    return ids, doc, term[some], tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl)) if len(doc) else tf


def _groups(texts):
    """Texts in groups that share terms: ``(texts, terms, weights)`` of each, whose products leave out most terms.

    The longest texts come first; each joins the group where it costs least, or
    begins one.
    """
    term_of, weight_of, edge = _by_text(texts)
    n_terms = max(1, len(texts["first"]) - 1)
    has, members, sizes, n_groups = np.zeros((16, n_terms), dtype=bool), [], np.zeros((2, 16), dtype=np.int64), 0
    for i in np.argsort(-np.diff(edge), kind="stable"):
        mine = term_of[edge[i] : edge[i + 1]]
        if not len(mine):
            continue
        more = len(mine) - has[:n_groups, mine].sum(axis=1)
        # a group's products are its texts times its terms
        cost = sizes[1, :n_groups] + more * (sizes[0, :n_groups] + 1 + GATHER)
        at = int(np.argmin(cost)) if n_groups else 0
        if not n_groups or cost[at] > len(mine) * (1 + GATHER):
            at, n_groups = n_groups, n_groups + 1
            members.append([])
            if n_groups > len(has):
                has, sizes = np.concatenate([has, np.zeros_like(has)]), np.concatenate([sizes, np.zeros_like(sizes)], axis=1)
        has[at, mine] = True
        members[at].append(i)
        sizes[:, at] = len(members[at]), has[at].sum()
    found = []
    for at, some in enumerate(members):
        terms = np.flatnonzero(has[at])
        weights = np.zeros((len(some), len(terms)), dtype=np.float32)
        for j, i in enumerate(some):
            mine = slice(edge[i], edge[i + 1])
            weights[j, np.searchsorted(terms, term_of[mine])] = weight_of[mine]
        found.append((np.array(some), terms, weights))
    return found


def _scored(batches, texts, avgdl, k1, b):
    """Parts for ``scan``: near scores by products of gains and weights in single precision, a group of texts at a time."""
    n_texts, n_terms = len(texts["ids"]), len(texts["first"]) - 1
    term_of, weight_of, edge = _by_text(texts)
    # a sum of j products is off by at most (j + 3) roundings of the sum of their sizes; gains stay below k1 + 1
    size = np.add.reduceat(np.append(np.abs(weight_of), 0), edge[:-1]) * (np.diff(edge) > 0) * (k1 + 1)
    slack = (np.diff(edge) + 4) * np.float64(1.2e-7) * size + 1e-8
    most = max(1, CELLS // max(1, n_terms, n_texts))
    for part in (batch.slice(at, most) for batch in batches for at in range(0, batch.num_rows, most)):
        ids, doc, term, gain = _entries(part, texts, avgdl, k1, b)
        gains = np.zeros((max(1, n_terms), len(ids)))
        gains[term, doc] = gain
        single, near = gains.astype(np.float32), np.zeros((n_texts, len(ids)), dtype=np.float32)
        for rows, terms, weights in texts["groups"]:
            near[rows] = weights @ single[terms]

        def exact(i, at, gains=gains):
            mine = slice(edge[i], edge[i + 1])
            if edge[i] == edge[i + 1]:
                return np.zeros(len(at))
            # one term after another, so equal texts score alike wherever they stand
            products = gains[np.ix_(term_of[mine], at)].T * weight_of[mine]
            return np.round(np.cumsum(products, axis=1)[:, -1], 9)

        yield ids, near, exact, slack


def _by_text(texts):
    """Terms and weights ordered by text, terms ascending, and where each text's begin."""
    line = np.argsort(texts["text"], kind="stable")
    term_of = np.repeat(np.arange(len(texts["first"]) - 1), np.diff(texts["first"]))[line]
    return term_of, texts["weight"][line], np.searchsorted(texts["text"][line], np.arange(len(texts["ids"]) + 1))


class _Bounded:
    """Postings of a part by term, with the largest gain of each term in each block of documents."""

    def __init__(self, ids, doc, term, gain, n_terms, width):
        self.ids, self.width = ids, width
        self.n_blocks = -(-len(ids) // width)
        order = np.argsort(term, kind="stable")
        self.doc, self.gain = doc[order], gain[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        # within a term the documents ascend, so its blocks lie together too
        cell = term[order] * self.n_blocks + self.doc // width
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.most = np.zeros((n_terms, self.n_blocks))
        if len(first):
            self.most.reshape(-1)[cell[first]] = np.maximum.reduceat(self.gain, first)

    def best(self, terms, weights, n, least):
        """``(scores, ids, blocks left out)``: what may be among the ``n`` best.

        ``least`` is the n-th best score so far, None while fewer are known; while it
        is 0, documents without any of the terms may still come in. A
        block whose bound stays below it is not scored; neither is a document
        all of whose terms together cannot lift it that far.
        """
        counts = self.start[terms + 1] - self.start[terms]
        at = _expand(self.start[terms], counts)
        docs, weight = self.doc[at], np.repeat(weights, counts)
        if least is None or least <= 0:
            scores = np.round(np.bincount(docs, weight * self.gain[at], len(self.ids)), 9)
            first = _first(scores, self.ids, n)
            return scores[first], self.ids[first], 0
        # scores are rounded to nine places, so bounds get a little more
        bounds = np.maximum(weights, 0)[:, None] * self.most[terms]
        alive = bounds.sum(axis=0) + 1e-8 >= least
        if not alive.any():
            return np.zeros(0), self.ids[:0], self.n_blocks
        highest = bounds.max(axis=1)
        order = np.argsort(highest, kind="stable")
        needed = np.empty(len(terms), dtype=bool)
        needed[order] = np.cumsum(highest[order]) + 1e-8 >= least
        reach = np.zeros(len(self.ids), dtype=bool)
        reach[docs[np.repeat(needed, counts)]] = True
        reach &= np.repeat(alive, self.width)[: len(self.ids)]
        kept = reach[docs]
        total = np.bincount(docs[kept], weight[kept] * self.gain[at][kept], len(self.ids))
        left = np.flatnonzero(reach)
        scores = np.round(total[left], 9)
        left, scores = left[scores >= least], scores[scores >= least]
        first = _first(scores, self.ids[left], n)
        return scores[first], self.ids[left[first]], int((~alive).sum())


def _top_batches(batches, texts, n, avgdl, k1, b, seen=None):
    """The task's ``n`` best documents per text, without scoring blocks that cannot hold one.

    ``seen``, if given, gets ``(blocks, blocks left out)`` of each step.
    """
    n_texts, n_terms = len(texts["ids"]), len(texts["first"]) - 1
    term_of, weight_of, edge = _by_text(texts)
    # blocks narrow enough for their bounds to differ, their table within CELLS
    step = BLOCK_DOCS * max(1, min(64, CELLS // max(1, n_terms)))
    kept, id_type = [(np.zeros(0), None)] * n_texts, None
    for batch in batches:
        id_type = batch.schema.types[0]
        for rows in _parts(batch, 2, step):
            part = _Bounded(*_postings(rows, texts, avgdl, k1, b), n_terms, BLOCK_DOCS)
            for i in range(n_texts):
                scores, ids = kept[i]
                mine = slice(edge[i], edge[i + 1])
                least = scores.min() if len(scores) >= n else None
                more, more_ids, out = part.best(term_of[mine], weight_of[mine], n, least)
                if seen is not None:
                    seen.append((part.n_blocks, out))
                if len(more):
                    scores = np.concatenate([scores, more])
                    ids = more_ids if ids is None else np.concatenate([ids, more_ids])
                    first = _first(scores, ids, n)
                    kept[i] = scores[first], ids[first]
    for name, (scores, ids) in zip(texts["ids"], kept):
        if len(scores):
            names = pa.array([name] * len(ids), texts["type"])
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(ids.tolist(), id_type), pa.array(scores)], names=["text", "id", "score"]
            )


def _long_batches(batches, texts, n, avgdl, k1, b, bars):
    """As ``_top_batches`` for lists longer than a block of documents."""
    batches = iter(batches)
    first = next(batches, None)
    if first is not None:
        kept = scan.best(_scored(_again(first, batches), texts, avgdl, k1, b), len(texts["ids"]), n, bars)
        yield from scan.sent(kept, texts["ids"], texts["type"], first.schema.types[0])


def _mark_batches(batches, texts, n, avgdl, k1, b):
    batches = iter(batches)
    first = next(batches, None)
    if first is not None:
        yield scan.marked(scan.best(_scored(_again(first, batches), texts, avgdl, k1, b), len(texts["ids"]), n), first.schema.types[0])


def _again(first, rest):
    yield first
    yield from rest


def _pair_batches(batches, texts, avgdl, k1, b):
    """Scores of the (document, text) pairs asked for: the batch's last column lists texts."""
    number = {name: i for i, name in enumerate(texts["ids"])}
    term_of, weight_of, edge = _by_text(texts)
    most = max(1, CELLS // max(1, len(texts["first"])))
    for part in (batch.slice(at, most) for batch in batches for at in range(0, batch.num_rows, most)):
        ids, doc, term, gain = _entries(part, texts, avgdl, k1, b)
        gains = np.zeros((len(ids), max(1, len(texts["first"]) - 1)))
        gains[doc, term] = gain
        rows = [(t, d, number[t]) for d, ts in enumerate(part.column(3).to_pylist()) for t in ts if t in number]
        scores = []
        for _, d, i in rows:
            mine = slice(edge[i], edge[i + 1])
            products = gains[d, term_of[mine]] * weight_of[mine]
            scores.append(np.cumsum(products)[-1] if len(products) else 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([t for t, _, _ in rows], texts["type"]),
                pa.array([ids[d] for _, d, _ in rows], part.schema.types[0]),
                pa.array(np.round(np.array(scores, dtype=np.float64), 9), pa.float64()),
            ],
            names=["text", "id", "score"],
        )


class LexicalRanker:
    """BM25 ranks of ``docs (doc_id, text)`` for ``texts (text_id, text)``.

    All documents are ranked, by falling score, equal scores by the smaller
    id; a document that shares no term with a text scores 0.
    Where ``tokenize`` takes terms out of words, ``split`` makes those of one
    word, its attribute ``of_words``, if it has one, those of many, and ``words`` may be the index of a ranker by words of the same
    documents: the documents then need not be tokenised for it.
    """

    def __init__(
        self, texts: DataFrame, docs: DataFrame, tokenize=tokenize_words, k1=K1, b=B, epsilon=EPSILON, split=None, words: DataFrame | None = None
    ):
        self.spark, self.k1, self.b = docs.sparkSession, k1, b
        bounded_batches(self.spark)
        whole = tokenize if split is None else tokenize_words
        tokens = docs.select("doc_id", F.coalesce(whole(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("dl int, terms array<string>, tfs array<int>").fields])
        if split is None:
            index = tokens.mapInArrow(_count_batches, schema)
        elif words is None:
            index = tokens.mapInArrow(lambda batches: _split_batches(_count_batches(batches), split), schema)
        else:
            index = words.mapInArrow(lambda batches: _split_batches(batches, split), schema)
        self.index = materialize(index)
        totals = self.index.agg(F.count(F.lit(1)), F.sum(F.col("dl").cast("bigint"))).first()
        self.n, self.avgdl = totals[0], (totals[1] or 0) / max(1, totals[0])
        # a document's terms are distinct: tasks count them before the shuffle
        held = self.index.select("terms").mapInArrow(_term_batches, "term string, df bigint")
        vocab = materialize(held.groupBy("term").agg(F.sum("df").alias("df")))
        raw = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        # the weight depends on df alone, so the mean adds one value per distinct df
        by_df = vocab.groupBy("df").agg(F.count(F.lit(1)).alias("terms")).withColumn("raw", raw)
        mean = by_df.agg(F.sum(F.col("terms") * F.col("raw")) / F.sum("terms")).first()[0]
        floor = (mean or 0.0) * epsilon
        weight = F.col("qtf") * F.when(raw < 0, F.lit(floor)).otherwise(raw)
        terms = query_terms(texts, tokenize, ("text_id",)).join(vocab, "term")
        lists = terms.groupBy("text_id").agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("lines"))
        self.weights = materialize(texts.select("text_id").distinct().join(lists, "text_id", "left"))
        self.text_type, self.id_type = texts.schema["text_id"].dataType, docs.schema["doc_id"].dataType
        self._lock, self._entries = threading.Lock(), None

    def entries(self) -> tuple:
        """``(table, number)``: of each document only the terms that some text has, and the number of each term.

        The passes of long lists and ranks read this table instead of the index.
        """
        with self._lock:
            if self._entries is None:
                terms = sorted(r[0] for r in self.weights.select(F.explode("lines.term")).distinct().toLocalIterator())
                known = self.spark.sparkContext.broadcast(pa.array(terms, pa.string()))
                schema = T.StructType([T.StructField("doc_id", self.id_type), *T._parse_datatype_string("dl int, held binary").fields])
                table = self.index.select("doc_id", "dl", "terms", "tfs").mapInArrow(lambda x: _entry_batches(x, known.value), schema)
                self._entries = materialize(table), {term: i for i, term in enumerate(terms)}
            return self._entries

    def _held(self, ids, lines, **more):
        """A block of texts to be broadcast, with its terms by their number in the entries."""
        block = vars(_Texts(ids, lines))
        local = np.full(len(self.entries()[1]) + 1, -1, dtype=np.int64)
        local[[self.entries()[1][term] for term in block["terms"]]] = list(block["terms"].values())
        return self.spark.sparkContext.broadcast({**block, "local": local, "groups": _groups(block), **more})

    def _blocks(self, per_text: int, only: list | None = None, entries=True):
        """Blocks of texts, each within ``BLOCK_TERMS`` terms and ``BLOCK_ROWS`` kept rows; of all texts or those named."""
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(self.text_type)

        def made(ids, lines):
            if entries:
                return ids, self._held(ids, lines, type=kind)
            return ids, self.spark.sparkContext.broadcast({**vars(_Texts(ids, lines)), "type": kind})

        ids, lines, terms = [], [], set()
        weights = self.weights if only is None else self.weights.join(F.broadcast(self._names(only)), "text_id", "left_semi")
        for row in weights.toLocalIterator():
            mine = row["lines"] or []
            more = terms.union(x["term"] for x in mine)
            cells = len(more) * (len(ids) + 1)
            if ids and (len(lines) + len(mine) > BLOCK_TERMS or (len(ids) + 1) * per_text > BLOCK_ROWS or cells > WEIGHT_CELLS):
                yield made(ids, lines)
                ids, lines, more = [], [], {x["term"] for x in mine}
            lines += [(len(ids), x["term"], x["w"]) for x in mine]
            ids.append(row["text_id"])
            terms = more
        if ids:
            yield made(ids, lines)

    def _found(self, parts):
        rows = None
        for part in parts:
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _schema(self):
        fields = [("text_id", self.text_type), ("doc_id", self.id_type), ("score", T.DoubleType())]
        return T.StructType([T.StructField(n, t) for n, t in fields])

    def top(self, n: int) -> DataFrame:
        """``(text_id, doc_id, score, rank)`` down to rank ``n``; tasks send ``n`` rows per text."""
        schema, avgdl, k1, b = self._schema(), self.avgdl, self.k1, self.b

        def part(ids, block):
            if n < BLOCK_DOCS:
                return self.index.mapInArrow(lambda x: _named(_top_batches(x, block.value, n, avgdl, k1, b), schema), schema)
            marks = lambda most: lambda x: _mark_batches(x, block.value, most, avgdl, k1, b)
            send = lambda bars: lambda x: _named(_long_batches(x, block.value, n, avgdl, k1, b, bars.value), schema)
            return scan.long_lists(self.entries()[0], marks, send, schema, ["text_id"], ids, n)

        rows = self._found([part(ids, block) for ids, block in self._blocks(n, entries=n >= BLOCK_DOCS)])
        if rows is None:
            rows = self.spark.createDataFrame([], schema)
        return top_k(rows, n, ("text_id",))

    def names(self) -> DataFrame:
        """``text_id`` of the texts that are ranked."""
        return self.weights.select("text_id")

    def at_once(self) -> int:
        """How many texts to score together in ``scored``."""
        words = self.weights.select(F.explode("lines.term").alias("term")).distinct().count()
        return max(1, min(scan.TEXTS, WEIGHT_CELLS // max(1, words)))

    def scored(self, ids: list):
        """Index, how ``scan`` scores it for the texts named, its kind of ids, and their highest scores."""
        from pyspark.sql.pandas.types import to_arrow_type

        mine = self.weights.join(F.broadcast(self._names(ids)), "text_id").select("text", "lines")
        lines = [(r["text"], x["term"], x["w"]) for r in mine.toLocalIterator() for x in r["lines"] or []]
        held = self._held(ids, lines)
        # gains stay below k1 + 1
        highest = np.zeros(len(ids))
        np.add.at(highest, held.value["text"], np.maximum(held.value["weight"], 0) * (self.k1 + 1))
        avgdl, k1, b = self.avgdl, self.k1, self.b
        return self.entries()[0], lambda batches: _scored(batches, held.value, avgdl, k1, b), to_arrow_type(self.id_type), highest

    def scores(self, pairs: DataFrame) -> DataFrame:
        """``(text_id, doc_id, score)`` of given ``(text_id, doc_id)`` pairs."""
        schema, avgdl, k1, b = self._schema(), self.avgdl, self.k1, self.b
        asked = pairs.groupBy("doc_id").agg(F.collect_set("text_id").alias("asked"))
        wanted = materialize(self.entries()[0].join(broadcast_if_small(asked), "doc_id").select("doc_id", "dl", "held", "asked"))

        def part(block):
            return wanted.mapInArrow(lambda x: _named(_pair_batches(x, block.value, avgdl, k1, b), schema), schema)

        rows = self._found([part(block) for _, block in self._blocks(1)])
        return self.spark.createDataFrame([], schema) if rows is None else rows

    def ranks(self, pairs: DataFrame) -> DataFrame:
        """``(text_id, doc_id, rank)`` of given pairs in the ranking of all documents.

        Their scores are fetched first; then one pass counts, per text, the
        documents between neighbouring pairs.
        """
        avgdl, k1, b = self.avgdl, self.k1, self.b

        def blocks(texts, longest):
            for ids, block in self._blocks(longest, texts):
                yield ids, self.entries()[0], lambda batches, block=block: _scored(batches, block.value, avgdl, k1, b)

        return scan.ranks(self.scores(pairs), BLOCK_ROWS, blocks)

    def _names(self, ids):
        fields = [T.StructField("text_id", self.text_type), T.StructField("text", T.LongType())]
        return self.spark.createDataFrame([(name, i) for i, name in enumerate(ids)], T.StructType(fields))


def _named(batches, schema):
    for batch in batches:
        yield batch.rename_columns(schema.names)


def top_k(scores: DataFrame, k: int, keys=("qid",), id_col="doc_id") -> DataFrame:
    """Best ``k`` per key; ties go to the smaller id.

    Spark limits each group inside the map tasks before the shuffle, so a key
    that owns most rows still sends only ``k`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col(id_col))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

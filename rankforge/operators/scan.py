"""Best documents per text out of blocks of scores, inside the task that holds the documents.

A part is ``(ids, scores, exact, slack)``: document ids, near scores as texts x
documents in single precision, ``exact(i, at)`` for the true scores of text
``i`` and some documents, and how far a near score may be off for each text.
Near scores only leave documents out; what is kept or counted is exact.

For long lists tasks first send marks: their documents at ranks that grow
by a twentieth. Added up over the tasks they give each text a bar, the place
at or before which ``n`` documents are known to be; the next pass sends what
is not behind it, so what tasks send grows with ``n``, not with their number.
Of a large corpus only a sample is marked, a little deeper, and the lists are
counted; if one is too short, all documents are marked.

Sums of ranks need no lists at all: documents are counted between ``edges`` of
each text's scores, so every document's rank has bounds where it is scored, and
only documents whose bounds allow them among the best of a sum are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rankforge.session import materialize

# rows that tasks may send without a bar
FREE_ROWS = 2_000_000
STEP = 1.05
# of rank sums: texts of a block, documents that set the edges, their growth and the steps above them, contenders a task may send per sum
TEXTS = 2048
SAMPLE = 2048
EDGE_STEP = 1.02
ABOVE = 64
CONTENDERS = 1024
# of bars by a sample: its documents at least, and the place in it of a list's last document
LIST_SAMPLE = 4096
LIST_PLACE = 12
SUM_SLACK = 1e-6
# below every score that counts; a near score of minus infinity leaves a document out
LOWEST = -3e38


def single(bounds):
    """Lower bounds in single precision, so that no block of scores is widened to meet them."""
    return np.nextafter(np.maximum(bounds, LOWEST).astype(np.float32), np.float32(-np.inf))


def first_places(scores, ids, n):
    """Places of the ``n`` best scores; equal scores by the smaller id."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([above, equal[np.argsort(ids[equal], kind="stable")[: n - len(above)]]])


def best(parts, n_texts, n, bars=None):
    """``(scores, ids)`` of each text's ``n`` best documents; ``bars`` are (score, id) pairs or None."""
    kept = [None] * n_texts
    least = np.array([LOWEST if not bars or bars[i] is None else bars[i][0] for i in range(n_texts)], dtype=np.float64)
    for ids, near, exact, slack in parts:
        some = near >= single(least - slack)[:, None]
        for i in np.flatnonzero(some.any(axis=1)):
            at = np.flatnonzero(some[i])
            if len(at) > n:
                mine = near[i, at]
                at = at[mine >= np.partition(mine, len(mine) - n)[len(mine) - n] - 2 * slack[i]]
            scores, names = exact(i, at), ids[at]
            if bars and bars[i] is not None:
                mark, last = bars[i]
                fits = (scores > mark) | ((scores == mark) & (names <= last))
                scores, names = scores[fits], names[fits]
            if kept[i] is not None:
                scores, names = np.concatenate([kept[i][0], scores]), np.concatenate([kept[i][1], names])
            place = first_places(scores, names, n)
            kept[i] = scores[place], names[place]
            if len(place) == n and n:
                least[i] = max(least[i], kept[i][0].min())
    return kept


def ahead(parts, marks):
    """How many documents fall between the marks of each text: sorted (-score, id) lists.

    Sorted near scores tell how many documents are surely before each mark;
    only those within the slack of one are scored exactly.
    """
    gaps = [np.zeros(len(m[0]) + 1, dtype=np.int64) for m in marks]
    bounds, bounds_of = None, None
    for ids, near, exact, slack in parts:
        if bounds_of is not slack:
            bounds = [_around(-mark, slack[i]) for i, (mark, _) in enumerate(marks)]
            bounds_of = slack
        ordered, n = np.sort(near, axis=1), len(ids)
        for i, (mark, mark_id) in enumerate(marks):
            if not len(mark):
                gaps[i][0] += n
                continue
            lower, upper = bounds[i]
            # the documents from `above` on are before a mark, those from `close` on may be
            above, close = np.searchsorted(ordered[i], upper, "right"), np.searchsorted(ordered[i], lower, "left")
            if not (close < above).any():
                gaps[i] += np.diff(n - above, prepend=0, append=n)
                continue
            steps = np.bincount(close, minlength=n + 1) - np.bincount(above, minlength=n + 1)
            unsure = np.cumsum(steps)[:n] > 0
            sure = np.concatenate([[0], np.cumsum(~unsure)])
            gaps[i] += np.diff(sure[-1] - sure[above], prepend=0, append=sure[-1])
            values = ordered[i][unsure]
            at = np.flatnonzero(values[np.minimum(np.searchsorted(values, near[i]), len(values) - 1)] == near[i])
            true = -exact(i, at)
            start, end = np.searchsorted(mark, true, "left"), np.searchsorted(mark, true, "right")
            place, tied = start.copy(), np.flatnonzero(start < end)
            for first in np.unique(start[tied]):
                same = tied[start[tied] == first]
                place[same] = first + np.searchsorted(mark_id[first : end[same[0]]], ids[at[same]], "right")
            gaps[i] += np.bincount(place, minlength=len(gaps[i]))
    return gaps


def _around(scores, slack):
    """Single-precision bounds below and above scores, at least the slack away."""
    infinite = np.float32(np.inf)
    return np.nextafter((scores - slack).astype(np.float32), -infinite), np.nextafter((scores + slack).astype(np.float32), infinite)


def gap_rows(gaps):
    """Counts that are not 0 as one record batch ``(text, gap, n)``."""
    sizes = np.array([len(g) for g in gaps], dtype=np.int64)
    held = np.concatenate(gaps) if gaps else np.zeros(0, np.int64)
    text, gap = np.repeat(np.arange(len(gaps)), sizes), np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (text, gap, held)], names=["text", "gap", "n"])


def ranks(scored: DataFrame, most: int, blocks) -> DataFrame:
    """``(text_id, doc_id, rank)`` of scored pairs in the ranking of all documents.

    ``blocks(texts, marks of the longest)`` yields ``(texts, corpus, parts)``, of
    which one pass counts the documents between neighbouring pairs of each text.
    A pass takes at most ``most`` pairs, but for single texts; texts without pairs take none.
    """
    spark, kind = scored.sparkSession, scored.schema["text_id"]
    on = W.partitionBy("text_id").orderBy(F.col("score").desc(), "doc_id")
    marked = materialize(scored.withColumn("mark", F.row_number().over(on) - 1))
    asked, held, counted = [], 0, None
    waiting = []
    longest = 1
    for name, n in marked.groupBy("text_id").count().orderBy("text_id").toLocalIterator():
        if asked and held + n > most:
            waiting.append((asked, longest))
            asked, held, longest = [], 0, 1
        asked.append(name)
        held, longest = held + n, max(longest, n)
    if asked:
        waiting.append((asked, longest))
    for names, corpus, parts in (x for some, deepest in waiting for x in blocks(some, deepest)):
        numbers = spark.createDataFrame([(name, i) for i, name in enumerate(names)], T.StructType([kind, T.StructField("text", T.LongType())]))
        rows = marked.join(F.broadcast(numbers), "text_id").select("text", "mark", "score", "doc_id").toArrow()
        text, mark, score = (rows.column(c).to_numpy() for c in ("text", "mark", "score"))
        order = np.lexsort((mark, text))
        ids = rows.column("doc_id").to_pandas().to_numpy()[order]
        edge = np.searchsorted(text[order], np.arange(len(names) + 1))
        lists = [(-score[order[a:b]], ids[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        marks = spark.sparkContext.broadcast(lists)

        def count(batches, parts=parts, marks=marks):
            yield gap_rows(ahead(parts(batches), marks.value))

        gaps = corpus.mapInArrow(count, "text bigint, gap bigint, n bigint").groupBy("text", "gap").agg(F.sum("n").alias("n"))
        part = gaps.join(F.broadcast(numbers), "text").select("text_id", F.col("gap").alias("mark"), "n")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return marked.select("text_id", "doc_id", F.lit(1).cast("bigint").alias("rank"))
    # gap j holds the documents after mark j - 1 and before mark j
    lines = marked.select("text_id", F.col("mark").cast("bigint").alias("mark"), "doc_id").join(counted, ["text_id", "mark"], "full")
    before = W.partitionBy("text_id").orderBy("mark").rowsBetween(W.unboundedPreceding, 0)
    place = F.sum(F.coalesce("n", F.lit(0))).over(before)
    return lines.withColumn("rank", place + 1).where("doc_id IS NOT NULL").select("text_id", "doc_id", "rank")


def _ranks(n, step=STEP):
    """1, 2, 3, ... growing by a twentieth (``step``), up to ``n``."""
    found, at = [], 1
    while at < n:
        found.append(at)
        at = max(at + 1, int(at * step))
    return np.array([*found, n]) if n else np.zeros(0, int)


def sent(kept, names, kind, id_type, at_once=200_000):
    """Kept rows as record batches ``(text, id, score)`` of bounded size."""
    held, rows = [], 0
    for i, pair in enumerate(kept):
        if pair is not None and len(pair[0]):
            held.append((i, *pair))
            rows += len(pair[0])
        if held and (rows >= at_once or i == len(kept) - 1):
            yield _rows(held, names, kind, id_type)
            held, rows = [], 0
    if held:
        yield _rows(held, names, kind, id_type)


def _rows(held, names, kind, id_type):
    number = np.concatenate([np.full(len(s), j) for j, (_, s, _) in enumerate(held)])
    texts = pa.array([names[i] for i, _, _ in held], kind).take(pa.array(number))
    ids = pa.array(np.concatenate([d for _, _, d in held]).tolist(), id_type)
    return pa.RecordBatch.from_arrays([texts, ids, pa.array(np.concatenate([s for _, s, _ in held]))], names=["text", "id", "score"])


def marked(kept, id_type):
    """Marks of kept lists as one record batch ``(text, id, score, step)``."""
    numbers, ids, scores, steps = [], [], [], []
    for i, pair in enumerate(kept):
        if pair is None or not len(pair[0]):
            continue
        ranks = _ranks(len(pair[0]))
        order = np.lexsort((np.unique(pair[1], return_inverse=True)[1], -pair[0]))[ranks - 1]
        numbers.append(np.full(len(ranks), i))
        ids.extend(pair[1][order].tolist())
        scores.append(pair[0][order])
        steps.append(np.diff(ranks, prepend=0))
    join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
    return pa.RecordBatch.from_arrays(
        [join(numbers, pa.int64()), pa.array(ids, id_type), join(scores, pa.float64()), join(steps, pa.int64())],
        names=["text", "id", "score", "step"],
    )


def bars(corpus: DataFrame, run, id_type, n_texts: int, n: int) -> list:
    """``(score, id)`` per text at or before which at least ``n`` documents are; ``run`` makes marks of a task's batches."""
    schema = T.StructType(
        [T.StructField("text", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.DoubleType()), T.StructField("step", T.LongType())]
    )
    order = W.partitionBy("text").orderBy(F.col("score").desc(), "id").rowsBetween(W.unboundedPreceding, 0)
    found = (
        corpus.mapInArrow(run, schema)
        .withColumn("known", F.sum("step").over(order))
        .where(F.col("known") >= n)
        .groupBy("text")
        .agg(F.min_by(F.struct("score", "id"), "known").alias("bar"))
        .collect()
    )
    out = [None] * n_texts
    for row in found:
        out[row["text"]] = row["bar"]["score"], row["bar"]["id"]
    return out


def long_lists(corpus: DataFrame, marks, send, schema, keys, names, n: int) -> DataFrame:
    """What tasks send of lists of ``n`` documents; no more than they need by ``n`` and the bars.

    ``marks(n)`` makes marks of a task's batches, ``send(bars)`` its rows, whose
    ``keys`` name a text, one of ``names``. Of a large corpus a sample gives bars
    that are likely far enough down; where a list then shows fewer documents
    than it has, all documents are marked as in a small one.
    """
    spark, id_type = corpus.sparkSession, schema["doc_id"].dataType
    if corpus.rdd.getNumPartitions() * n * len(names) <= FREE_ROWS:
        return corpus.mapInArrow(send(spark.sparkContext.broadcast(None)), schema)
    total = corpus.count()
    every = int(min(n / LIST_PLACE, total / LIST_SAMPLE))
    if every >= 4 and len(set(names)) == len(names):
        place = n / every
        place = int(np.ceil(place + 4 * np.sqrt(place) + 4))
        sample = corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
        likely = spark.sparkContext.broadcast(bars(sample, marks(place), id_type, len(names), place))
        found = materialize(corpus.mapInArrow(send(likely), schema))
        whole = found.groupBy(*keys).count().where(F.col("count") >= min(n, total)).count()
        if whole == len(names):
            return found
    sure = spark.sparkContext.broadcast(bars(corpus, marks(n), id_type, len(names), n))
    return corpus.mapInArrow(send(sure), schema)


def _edges(parts, highest):
    """Ascending scores per text: a sample's at ranks growing by ``EDGE_STEP``, then even steps up to ``highest``."""
    near = np.concatenate([part[1] for part in parts], axis=1).astype(np.float64)
    near = -np.sort(-near, axis=1)
    places = _ranks(near.shape[1], EDGE_STEP) - 1
    steps = np.arange(1, ABOVE + 1) / ABOVE
    above = near[:, :1] + np.maximum(highest[:, None] - near[:, :1], 0) * steps
    return np.concatenate([near[:, places[::-1]], above], axis=1).astype(np.float32)


def _histogram(parts, edges):
    """Documents of the parts below the first edge of each text, between edges, and at or above the last."""
    counts = np.zeros((len(edges), edges.shape[1] + 1), dtype=np.int64)
    for _, near, _, _ in parts:
        for i, row in enumerate(np.sort(near, axis=1)):
            counts[i] += np.diff(np.searchsorted(row, edges[i], "left"), prepend=0, append=len(row))
    return counts


def _ordered(scores):
    """Single-precision scores as whole numbers in the same order."""
    bits = np.asarray(scores, dtype=np.float32).view(np.int32).astype(np.int64)
    return np.where(bits < 0, -(1 << 31) - bits, bits)


class _Bounds:
    """Bounds of 0-based ranks; ``at_least`` counts each text's documents from an edge on.

    Near scores further apart than twice their slack are in the order of the
    true ones, so an edge that far off tells who is ahead and who is behind.
    """

    def __init__(self, edges, at_least):
        self.edges, self.at_least = edges, at_least
        self.keys = (_ordered(edges) + (np.arange(len(edges)) << 33)[:, None]).reshape(-1)

    def _place(self, scores, text):
        """How many of its text's edges are at or below each score."""
        return np.searchsorted(self.keys, _ordered(scores) + (text << 33), "right") - text * self.edges.shape[1]

    def of(self, near, text, slack):
        """Least and greatest ranks of documents in texts, by their near scores."""
        lower, upper = _around(near.astype(np.float64), 2 * slack)
        low = self.at_least[text, self._place(upper, text) + 1].astype(np.float64)
        return low, self.at_least[text, self._place(lower, text)] - 1.0

    def least(self, text, rank, slack):
        """Near scores below which documents are behind a rank in a text."""
        place = (self.at_least[text, 1:] > rank[:, None]).sum(axis=1)
        edge = self.edges[text, np.maximum(place - 1, 0)].astype(np.float64)
        return np.where(place > 0, edge - 2 * slack, LOWEST)


def _rank_bounds(near, slack, edges, at_least):
    """Least and greatest 0-based ranks of each document in each text."""
    text = np.repeat(np.arange(len(near)), near.shape[1])
    found = _Bounds(edges, at_least).of(near.reshape(-1), text, np.repeat(slack, near.shape[1]))
    return [x.reshape(near.shape) for x in found]


def _limits(parts, bounds, text, weight, first, k, at_once=128):
    """An upper bound of the ``k``-th least sum of ranks, by the documents of the parts."""
    best = np.full((len(first), k), np.inf)
    for ids, near, _, slack in parts:
        for at in range(0, len(ids), at_once):
            some = near[:, at : at + at_once]
            each = np.repeat(np.arange(len(some)), some.shape[1])
            high = bounds.of(some.reshape(-1), each, np.repeat(slack, some.shape[1]))[1].reshape(some.shape)
            high = np.add.reduceat(high[text] * weight[:, None], first, axis=0)
            best = np.sort(np.concatenate([best, high], axis=1), axis=1)[:, :k]
    return best[:, k - 1]


def _k_least(best, number, high):
    """Rows of least values with those of new ``(row number, value)`` pairs."""
    order = np.lexsort((high, number))
    number, high = number[order], high[order]
    place = np.arange(len(number)) - np.searchsorted(number, number, "left")
    more, kept = np.full(best.shape, np.inf), place < best.shape[1]
    more[number[kept], place[kept]] = high[kept]
    return np.sort(np.concatenate([best, more], axis=1), axis=1)[:, : best.shape[1]]


def _contenders(parts, bounds, text, weight, first, k, limit):
    """``(sums, ids, lows, highs, open sums)``: documents that may be among the ``k`` least sums of ranks.

    Sum ``j`` adds up ``weight`` times the rank in ``text`` over the lines from
    ``first[j]`` on; its ``k``-th least is known to be at most ``limit[j]``. A sum
    with more than ``CONTENDERS`` of them here is left open.
    """
    n_sums, sizes = len(first), np.diff(np.append(first, len(text)))
    sum_of = np.repeat(np.arange(n_sums), sizes)
    # with weights above 0 no line of a sum can be greater than the sum
    above = np.repeat(np.minimum.reduceat(weight, first) > 0, sizes)
    best, limit = np.full((n_sums, k), np.inf), limit.copy()
    is_open = np.zeros(n_sums, dtype=bool)
    held, rows = [], 0

    def fitting(found):
        number, ids, low, high = (np.concatenate(x) for x in zip(*found))
        fits = (low <= limit[number] + SUM_SLACK) & ~is_open[number]
        is_open[np.bincount(number[fits], minlength=n_sums) > CONTENDERS] = True
        fits &= ~is_open[number]
        return number[fits], ids[fits], low[fits], high[fits]

    for ids, whole, _, slack in parts:
        at = 0
        while at < len(ids):
            known = above & np.isfinite(limit[sum_of])
            # without a limit every document is bounded
            end = len(ids) if known.all() else min(len(ids), at + max(k, 500_000 // len(text)))
            rank = (limit[sum_of] + SUM_SLACK) / np.where(known, weight, 1.0)
            least = np.where(known, bounds.least(text, np.where(known, rank, 0.0), slack[text]), LOWEST)
            near = whole[:, at:end]
            fits = np.logical_and.reduceat(near[text] >= single(least)[:, None], first, axis=0)
            fits[is_open] = False
            number, place = np.nonzero(fits)
            if len(number):
                line = np.repeat(first[number] - np.cumsum(sizes[number]) + sizes[number], sizes[number]) + np.arange(sizes[number].sum())
                mine = text[line]
                pair = bounds.of(near[mine, np.repeat(place, sizes[number])], mine, slack[mine])
                starts = np.cumsum(sizes[number]) - sizes[number]
                low, high = (np.add.reduceat(x * weight[line], starts) for x in pair)
                best = _k_least(best, number, high)
                limit = np.minimum(limit, best[:, k - 1])
                kept = low <= limit[number] + SUM_SLACK
                held.append((number[kept], ids[at + place[kept]], low[kept], high[kept]))
                rows += int(kept.sum())
            if rows > FREE_ROWS:
                held = [fitting(held)]
                rows = len(held[0][0]) - n_sums * CONTENDERS
            at = end
    return (*fitting(held), np.flatnonzero(is_open)) if held else None


def least_sums(corpus: DataFrame, parts, kind, highest, sums: list, k: int) -> DataFrame:
    """``(sum, doc_id, low, high)``: a superset of the documents with the ``k`` least weighted sums of 0-based ranks.

    ``corpus``, with ids of Arrow type ``kind``, is scored by ``parts``, ``highest`` bounds the scores of each text
    and ``sums`` lists ``(text number, weight)`` pairs. A null ``doc_id`` marks a
    sum that too many documents may lead, as among equal scores.
    """
    spark, n = corpus.sparkSession, corpus.count()
    lines = [line for one in sums for line in one]
    text, weight = np.array([x[0] for x in lines], dtype=np.int64), np.array([x[1] for x in lines], dtype=np.float64)
    first = np.concatenate([[0], np.cumsum([len(one) for one in sums])[:-1]]).astype(np.int64)
    # the sample places the edges and gives first limits; all documents are counted and bounded
    sample = materialize(corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // SAMPLE))) == 0).repartition(1))

    def set_edges(batches):
        made = list(parts(batches))
        if made:
            yield _lists(_edges(made, highest), pa.float32())

    def count(batches):
        yield _lists(_histogram(parts(batches), edges.value), pa.int64())

    found = {r[0]: r[1] for r in sample.mapInArrow(set_edges, "text int, held array<float>").toLocalIterator()}
    edges = np.array([found[i] for i in range(len(highest))]) if found else np.repeat(highest[:, None], 2, axis=1)
    edges = spark.sparkContext.broadcast(edges.astype(np.float32))
    counts = np.zeros((len(highest), edges.value.shape[1] + 2), dtype=np.int64)
    each = corpus.mapInArrow(count, "text int, held array<bigint>")
    for row in each.groupBy("text").applyInArrow(_added, "text int, held array<bigint>").toLocalIterator():
        counts[row[0], :-1] = row[1]
    at_least = spark.sparkContext.broadcast(np.cumsum(counts[:, ::-1], axis=1)[:, ::-1])

    def bound_sample(batches):
        limit = _limits(parts(batches), _Bounds(edges.value, at_least.value), text, weight, first, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(first)), pa.int32()), pa.array(limit)], names=["sum", "least"])

    limit = np.full(len(first), np.inf)
    for row in sample.mapInArrow(bound_sample, "sum int, least double").collect():
        limit[row["sum"]] = min(limit[row["sum"]], row["least"])
    limit = spark.sparkContext.broadcast(limit)

    def bound(batches):
        made = _contenders(parts(batches), _Bounds(edges.value, at_least.value), text, weight, first, k, limit.value)
        if made is not None:
            number, ids, low, high, hard = made
            none = [None] * len(hard)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([number, hard]), pa.int32()), pa.array(ids.tolist() + none, kind),
                    pa.array(low.tolist() + none, pa.float64()), pa.array(high.tolist() + none, pa.float64()),
                ],
                names=["sum", "doc_id", "low", "high"],
            )

    kinds = [("sum", T.IntegerType()), ("doc_id", corpus.schema["doc_id"].dataType), ("low", T.DoubleType()), ("high", T.DoubleType())]
    return corpus.mapInArrow(bound, T.StructType([T.StructField(*x) for x in kinds]))


def _lists(rows, kind):
    ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    held = pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1), kind))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), held], names=["text", "held"])


def _added(table):
    """Counts of one text added up over the tasks."""
    rows = table.column("held").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    held = pa.array([rows.sum(axis=0)], pa.list_(pa.int64()))
    return pa.table({"text": table.column("text").slice(0, 1).combine_chunks(), "held": held})

"""Text quality without labels: heuristic labellers, EM, hashed linear scorer.

1. Nine labellers look at each whole text; they overlap and disagree. Six know
   one fault each and vote bad or nothing, three compare with running prose and
   vote good, bad or nothing.
2. Votes of all documents are counted by pattern (at most 3**9 rows), and
   expectation-maximisation on those counts estimates each labeller's accuracy
   and the share of bad documents. The pattern table is all that reaches the
   driver, whatever the corpus size.
3. The posterior of each pattern labels a bounded sample (``SAMPLE_DOCS``, by a
   hash of the text), on which a linear scorer over hashed word shapes is
   trained. The scorer sees every document and decides.

Defined cases: a text that is null or without words scores null and is
rejected; an empty table gives an empty result; where all patterns agree the
scorer is trained on one class and keeps it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm import words
from rankforge.llm.rows import with_report

LABELLERS = ["symbols", "capitals", "repeats", "word_length", "sentences", "short_words", "suffixes", "bars", "lines"]
ABSTAIN, BAD, GOOD = 0, 1, 2
DIMENSIONS = 1 << 12
SAMPLE_DOCS = 8_000
CUT = 0.5
#: What is taken for granted of every labeller: so many of its bad votes are right.
TRUST = 0.95

# byte classes: what a word's shape is made of
_UPPER, _LOWER, _DIGIT, _STOP, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = _DIGIT, _UPPER, _LOWER, _LOWER
for _c in b".,;:?'\"()-":
    _CLASS[_c] = _STOP
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def _per_text(values, block):
    """Sum of word values for each text of a block."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[block.first[1:]] - total[block.first[:-1]]


def _per_text_bytes(flags, block):
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[block.bounds[1:]] - total[block.bounds[:-1]]


def _vote(value, good_to, bad_from, can):
    """Good up to one limit, bad from the other, nothing between or where ``can`` is false."""
    return np.where(~can, ABSTAIN, np.where(value <= good_to, GOOD, np.where(value >= bad_from, BAD, ABSTAIN)))


def _fault(value, bad_from, can):
    """Bad from a limit, else nothing: how much silence says is left to the estimate."""
    return np.where(can & (value >= bad_from), BAD, ABSTAIN)


def _shape(block):
    """Hashed shape of each word: classes of its first and last two bytes, and its length."""
    kind = _CLASS[block.raw]
    length = block.ends - block.starts
    second, before = np.minimum(block.starts + 1, block.ends - 1), np.maximum(block.ends - 2, block.starts)
    code = kind[block.starts].astype(np.uint64)
    for at in (kind[second], kind[before], kind[block.ends - 1], np.minimum(length, 20)):
        code = code * np.uint64(32) + at.astype(np.uint64)
    return (words.mix(code) >> np.uint64(52)).astype(np.int64)


def _repeated(block):
    """Which words repeat the one before them."""
    hashes, text = block.hashes(), block.texts_of_words()
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    return again


def votes(block):
    """One row of votes per text of a block."""
    n = np.diff(block.first).astype(np.float64)
    some, many = n >= 1, n >= 20
    per_word = 1 / np.maximum(n, 1)
    kind, last = _CLASS[block.raw], block.raw[block.ends - 1]
    before = np.maximum(block.ends - 2, block.starts)
    length = block.ends - block.starts
    size = np.maximum(_per_text_bytes(kind <= _LOWER, block), 1)
    odd = _per_text_bytes(kind == _OTHER, block) - _per_text_bytes((block.raw == 32) | ((block.raw >= 9) & (block.raw <= 13)), block)
    capitals = _per_text_bytes(kind == _UPPER, block) / size
    suffix = _per_text((kind[block.ends - 1] == _OTHER) & (kind[before] == _OTHER) & (length > 2), block) * per_word
    bars = _per_text((length == 1) & (last == ord("|")), block) * per_word
    mean_length = _per_text(length, block) * per_word
    ends = _per_text(_END[last], block) * per_word
    short = _per_text(length <= 3, block) * per_word
    repeats = _per_text(_repeated(block), block) * per_word
    lines, same = np.zeros(len(block)), np.zeros(len(block))
    for i in range(len(block)):
        cut = block.raw[block.bounds[i] : block.bounds[i + 1]].tobytes().split(b"\n")
        lines[i], same[i] = len(cut), 1 - len(set(cut)) / len(cut)
    found = [
        _fault(odd / size, 0.03, some),
        _fault(capitals, 0.5, some & (size >= 20)),
        _fault(repeats, 0.15, many),
        _vote(np.abs(mean_length - 6), 3, 6, some),
        _vote(-ends, -0.02, -0.004, many),
        _vote(-short, -0.12, -0.05, many),
        _fault(suffix, 0.1, some),
        _fault(bars, 0.1, some),
        _fault(same, 0.4, lines >= 5),
    ]
    return np.stack(found, axis=1)


def _pattern(v):
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _unpattern(codes):
    return np.asarray(codes)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class LabelModel:
    """Labeller accuracies and class share from vote pattern counts, by EM."""

    def __init__(self, patterns, counts, steps=100):
        v, n = _unpattern(patterns), np.asarray(counts, dtype=np.float64)
        # start from the plain reading: any fault named makes a text doubtful
        p = np.where((v == BAD).any(axis=1), 0.1, 0.9)
        for _ in range(steps):
            self.share = float((p * n).sum() + 1) / float(n.sum() + 2)
            # probability of each vote for good and for bad documents
            self.of = np.stack(
                [
                    np.stack([((v == k) * (q * n)[:, None]).sum(axis=0) + 1 for k in range(3)]) / ((q * n).sum() + 3)
                    for q in (p, 1 - p)
                ]
            )
            self._trust(v, n)
            new = self.posterior(patterns)
            if np.abs(new - p).max() < 1e-9:
                break
            p = new

    def _trust(self, v, n):
        """Hold each labeller's wrong bad votes to the share ``TRUST`` allows.

        Faults that never meet in a text support each other nowhere, so counts
        alone could call one of them normal.
        """
        bad = ((v == BAD) * n[:, None]).sum(axis=0)
        most = (1 - TRUST) * bad / max(self.share * n.sum(), 1e-9)
        good_rate = np.minimum(self.of[0, BAD], most + 1e-9)
        bad_rate = ((bad - good_rate * self.share * n.sum()) / max((1 - self.share) * n.sum(), 1e-9)).clip(1e-9, 0.99)
        for k, rate in ((0, good_rate), (1, bad_rate)):
            rest = self.of[k, ABSTAIN] + self.of[k, GOOD]
            self.of[k, [ABSTAIN, GOOD]] *= (1 - rate) / rest
            self.of[k, BAD] = rate

    def posterior(self, patterns):
        """Probability that a document with these votes is good; silence counts as an answer."""
        v = _unpattern(patterns)
        odds = np.full(len(v), math.log(self.share / (1 - self.share)))
        for j in range(v.shape[1]):
            ratio = np.log(self.of[0, :, j] / self.of[1, :, j])
            odds += ratio[v[:, j]]
        return 1 / (1 + np.exp(-odds.clip(-30, 30)))

    def accuracy(self):
        """Share of right votes among a labeller's votes, by name."""
        right = self.share * self.of[0, GOOD] + (1 - self.share) * self.of[1, BAD]
        cast = self.share * (1 - self.of[0, ABSTAIN]) + (1 - self.share) * (1 - self.of[1, ABSTAIN])
        return dict(zip(LABELLERS, (right / cast).tolist()))


def _hashed(block):
    """(text, dimension, value) triples: each text's word shapes as square-rooted shares."""
    text, shape = block.texts_of_words(), _shape(block)
    repeat = _repeated(block)
    text, shape = np.concatenate([text, text[repeat]]), np.concatenate([shape, np.zeros(int(repeat.sum()), dtype=np.int64)])
    cells, counts = np.unique(text * DIMENSIONS + shape, return_counts=True)
    text, shape = cells // DIMENSIONS, cells % DIMENSIONS
    # eight words' worth of nothing, so that a few words decide little
    return text, shape, np.sqrt(counts / (np.diff(block.first)[text] + 8))


def _pattern_batches(batches):
    total: dict = {}
    for batch in batches:
        for block in words.blocks(batch.column(0), words.SPACE):
            for code, k in zip(*np.unique(_pattern(votes(block))[np.diff(block.first) > 0], return_counts=True)):
                total[int(code)] = total.get(int(code), 0) + int(k)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"]
    )


def _sample_batches(batches):
    for batch in batches:
        for block in words.blocks(batch.column(0), words.SPACE):
            code, (text, shape, value) = _pattern(votes(block)), _hashed(block)
            at = np.searchsorted(text, np.arange(len(block) + 1))
            keep = [i for i in range(len(block)) if at[i] < at[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(code[i]) for i in keep], pa.int64()),
                    pa.array([shape[at[i] : at[i + 1]].astype(np.int32) for i in keep], pa.list_(pa.int32())),
                    pa.array([value[at[i] : at[i + 1]].astype(np.float32) for i in keep], pa.list_(pa.float32())),
                ],
                names=["pattern", "dims", "weights"],
            )


def _fit_linear(dims, weights, target, steps=150, rate=0.5, decay=1e-5):
    """Logistic regression on sparse rows with soft targets, by adaptive gradient steps."""
    row = np.repeat(np.arange(len(dims)), [len(d) for d in dims])
    dim = np.concatenate(dims) if len(dims) else np.zeros(0, np.int64)
    value = np.concatenate(weights) if len(dims) else np.zeros(0)
    w, bias, seen, seen_bias = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[dim], len(dims)) + bias)))
        g = (p - target) / max(1, len(target))
        grad = np.bincount(dim, value * g[row], DIMENSIONS) + decay * w
        seen += grad**2
        seen_bias += g.sum() ** 2
        w -= rate * grad / np.sqrt(seen)
        bias -= rate * g.sum() / math.sqrt(seen_bias)
    return w, bias


class QualityModel:
    """Label model and scorer, fitted on one document table."""

    def __init__(self, docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
        text = docs.select(F.col("text").cast("string").alias("text"))
        rows = text.mapInArrow(_pattern_batches, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
        rows = sorted(tuple(r) for r in rows)
        self.labels = self.scorer = None
        if not rows:
            return
        patterns, counts = zip(*rows)
        self.labels = LabelModel(patterns, counts)
        share = min(1.0, sample_docs / sum(counts))
        some = text.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).dropDuplicates(["text"])
        found = some.mapInArrow(_sample_batches, "pattern long, dims array<int>, weights array<float>").limit(2 * sample_docs)
        # as arrays, which take a tenth of the driver's memory that rows of numbers take
        found = found.toArrow()
        if found.num_rows:
            pattern = found["pattern"].to_numpy()
            dims, weights = ([x.values.to_numpy() for x in found[c]] for c in ("dims", "weights"))
            order = sorted(range(len(dims)), key=lambda i: (pattern[i], dims[i].tobytes(), weights[i].tobytes()))
            target = self.labels.posterior(pattern[order])
            self.scorer = _fit_linear([dims[i] for i in order], [weights[i] for i in order], target)


def _report(texts, labels, scorer, cut):
    posterior, score, kept = [], [], []
    for block in words.blocks(texts, words.SPACE):
        some = np.diff(block.first) > 0
        text, shape, value = _hashed(block)
        w, bias = scorer
        p = 1 / (1 + np.exp(-(np.bincount(text, value * w[shape], len(block)) + bias)))
        posterior.append(np.where(some, labels.posterior(_pattern(votes(block))), np.nan))
        score.append(np.where(some, p, np.nan))
        kept.append(some & (p >= cut))
    posterior, score = (pa.array(np.concatenate(x), pa.float64(), from_pandas=True) for x in (posterior, score))
    return [posterior, score, pa.array(np.concatenate(kept), pa.bool_())]


def classify(docs: DataFrame, model: QualityModel | None = None, cut: float = CUT) -> DataFrame:
    """(row, posterior, score, kept) for each row of ``docs`` (needs ``text``).

    ``posterior`` is what the labellers say together, ``score`` what the trained
    scorer says; the scorer decides.
    """
    model = model or QualityModel(docs)
    labels, scorer = model.labels, model.scorer
    if scorer is None:
        none = F.lit(None).cast("double")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        return docs.select(row, none.alias("posterior"), none.alias("score"), F.lit(False).alias("kept"))
    return with_report(
        docs, "text", lambda texts: _report(texts, labels, scorer, cut), "posterior double, score double, kept boolean"
    )

"""Log probability of texts under a smoothed n-gram model, as a weighted backoff automaton.

Unigrams are counted over all training tokens and smoothed by adding a half.
Every bigram and trigram of the training texts is in the model with its exact
count, however rare it is and however large the corpus. A history's seen
successors are discounted by ``DISCOUNT``; what that frees is shared out by the
shorter history, so the weight of backing off needs nothing but the history's
own successors and every distribution sums to one.

Texts go in blocks of about ``BLOCK`` bytes. A block sends its distinct n-grams
once, dealt by the hash of their history into parts whose number grows with the
bytes: sorted keys as differences, in byte planes, with the block's training
counts. A part adds up the counts of all blocks, finds each history's total and
number of successors, and returns to each block what belongs to its own n-grams.
The block turns that into its automaton: states are the histories known to the
model, sorted arcs carry the log probability of a seen successor and lead to the
longest known history, failure arcs carry the backoff weight and lead to the
shorter history. All its texts step from left to right together, each carrying
its state and its sum. Stretches of long texts step side by side; each starts in
the state after the two tokens before it, which is all a state can know.

No task, broadcast or driver holds the vocabulary or the model, and no table is
written: blocks are read twice and n-grams shuffled once. ``again`` tells that
the documents come in the same order when read again, as a scan of files does;
otherwise they are written first.

Words are told apart by 64-bit hashes, n-grams by 36 bits of their history's
hash beside those that name its part, and 22 bits of the word's.

Defined cases: a null text is empty and has one token, its end; a row without
``doc_id`` belongs to training; repeated rows count each; an empty training set
makes every token unknown.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm import words
from rankforge.llm.store import Scratch

DISCOUNT = 0.5
#: Text bytes per part and per block, and tokens of a stretch.
PART = 1 << 24
BLOCK = 1 << 23
STRETCH = 128
#: Hash of the end token; no word hash is reserved, so this is one more word.
END = np.uint64(0xE17A1465B3C5D927)

_HISTORY_BITS, _WORD_BITS = 36, 22
_ASKS = "n int, part int, src long, keys binary, counts binary, size int"
_WORDS = "part int, keys binary, size int, tokens long"
_ANSWERS = "n int, part int, src long, counts binary, totals binary, kinds binary"
_U = np.uint64


def _tokens(data, bounds):
    """(token hashes with an end after each text, first token of each text), hashed in small blocks."""
    hashes, first, so_far = [], [np.zeros(1, np.int64)], 0
    for row, end in words.spans(bounds):
        lo, hi = bounds[row], bounds[end]
        block = words.Block(data[lo:hi], bounds[row : end + 1] - lo, words.SPACE, row)
        hashes.append(np.insert(block.hashes(), block.first[1:], END))
        first.append(so_far + block.first[1:] + np.arange(1, len(block) + 1))
        so_far = int(first[-1][-1])
    return np.concatenate(hashes), np.concatenate(first)


def _blocks(texts):
    """(first row, row after the last, bytes, byte limits) of a batch's blocks."""
    data, offsets = words.columns(texts)
    for row, end in words.spans(offsets, BLOCK):
        lo, hi = offsets[row], offsets[end]
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo


def _pair(left, right):
    return words.mix(left * _U(0x9FB21C651E98DF25) + right)


def _packed(values):
    """Numbers as compressed byte planes: planes of leading zeros take no room."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data, size):
    planes = np.frombuffer(pa.decompress(data, 8 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).reshape(-1).view("<u8")


def _table(rows, fields):
    fields = [f.split() for f in fields.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


class _Grams:
    """Distinct n-grams of a block of order ``n`` in the order in which they are sent.

    ``at`` is the place of one occurrence of each, ``of`` the number of the
    n-gram that starts at each place of ``places``.
    """

    def __init__(self, n, history, word, places, parts):
        whole = word if n == 1 else _pair(history, word)
        _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        deal = word[first] if n == 1 else history[first]
        part = words.mix(deal ^ _U(0xA0761D6478BD642F)) % _U(parts)
        # radix sort where the number of parts allows it
        part = part.astype(np.uint16 if parts < 1 << 16 else np.int64)
        key = deal
        if n > 1:
            short = words.mix(word[first]) >> _U(64 - _WORD_BITS)
            key = (deal >> _U(64 - _HISTORY_BITS) << _U(_WORD_BITS)) | short
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.key, self.at = key[order], places[first[order]].astype(np.int32)
        self.of, self.places = rank[inverse], places.astype(np.int32)
        met, starts = np.unique(part[order], return_index=True)
        self.slices = [(int(p), int(lo), int(hi)) for p, lo, hi in zip(met, starts, [*starts[1:], len(order)])]


def _histories(key):
    """Number of the history run of each sorted key of a part."""
    return np.cumsum(np.diff(key >> _U(_WORD_BITS), prepend=key[:1] >> _U(_WORD_BITS)) != 0)


def _block_grams(hashes, first, parts):
    """The n-grams inside the texts of a block, one order at a time."""
    inside = np.ones(max(len(hashes) - 1, 0), dtype=bool)
    inside[first[1:-1] - 1] = False
    two = np.flatnonzero(inside)
    three = np.flatnonzero(inside[:-1] & inside[1:])
    for n in (1, 2, 3):
        if n == 1:
            yield n, _Grams(n, None, hashes, np.arange(len(hashes)), parts)
        elif n == 2:
            yield n, _Grams(n, hashes[two], hashes[two + 1], two, parts)
        else:
            yield n, _Grams(n, _pair(hashes[three], hashes[three + 1]), hashes[three + 2], three, parts)


def _ask_batches(batches, parts):
    """The distinct n-grams of each block with its training counts."""
    src = TaskContext.get().partitionId() << 33
    for batch in batches:
        trains = np.asarray(batch.column(2))
        for row, end, data, bounds in _blocks(batch.column(1)):
            hashes, first = _tokens(data, bounds)
            train = np.repeat(trains[row:end], np.diff(first))
            for n, g in _block_grams(hashes, first, parts):
                counts = np.bincount(g.of, train[g.places], len(g.at)).astype(np.uint64)
                rows = [
                    (n, p, src, _packed(np.diff(g.key[lo:hi], prepend=_U(0))), _packed(counts[lo:hi]), hi - lo)
                    for p, lo, hi in g.slices
                ]
                yield from _table(rows, _ASKS).to_batches()
            src += 1


def _read_asks(table):
    sizes = table["size"].to_pylist()
    keys = [np.cumsum(_unpacked(k, s)) for k, s in zip(table["keys"].to_pylist(), sizes)]
    counts = [_unpacked(c, s).astype(np.int64) for c, s in zip(table["counts"].to_pylist(), sizes)]
    return sizes, np.concatenate(keys), np.concatenate(counts)


def _merged(keys, counts):
    """(place of each ask's key among the distinct ones, distinct keys, their counts)."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, sorted_[new], np.add.reduceat(counts[order], np.flatnonzero(new))


def _word_batches(batches, parts):
    """The distinct words of a task's training texts, and its tokens as the counts of part 0."""
    seen, total = [np.array([], np.uint64)], 0
    for batch in batches:
        for _, _, data, bounds in _blocks(batch.column(0)):
            hashes, _ = _tokens(data, bounds)
            total += len(hashes)
            seen.append(np.unique(hashes))
            if sum(map(len, seen)) > 4 * BLOCK // 8:
                yield from _word_rows(np.unique(np.concatenate(seen)), total, parts)
                seen, total = seen[:1], 0
    yield from _word_rows(np.unique(np.concatenate(seen)), total, parts)


def _word_rows(hashes, total, parts):
    part = (words.mix(hashes ^ _U(0xA0761D6478BD642F)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.searchsorted(part[order], np.arange(parts + 1))
    for p, lo, hi in zip(range(parts), starts[:-1].tolist(), starts[1:].tolist()):
        if hi > lo or (p == 0 and total):
            keys = _packed(np.diff(hashes[order[lo:hi]], prepend=_U(0)))
            yield from _table([(p, keys, hi - lo, total if p == 0 else 0)], _WORDS).to_batches()


def _answer_part(table):
    """Counts of each ask's n-grams, and total and number of successors of their histories."""
    n, part = table["n"][0].as_py(), table["part"][0].as_py()
    sizes, keys, counts = _read_asks(table)
    place, distinct, total = _merged(keys, counts)
    if n > 1:
        run = _histories(distinct)
        sums = np.bincount(run, total).astype(np.int64)
        kinds = np.bincount(run, total > 0).astype(np.int64)
    rows, at = [], 0
    for src, size in zip(table["src"].to_pylist(), sizes):
        own = place[at : at + size]
        at += size
        row = [n, part, src, _packed(total[own]), None, None]
        if n > 1:
            runs = run[own]
            first = np.flatnonzero(np.diff(runs, prepend=-1))
            row[4:] = _packed(sums[runs[first]]), _packed(kinds[runs[first]])
        rows.append(tuple(row))
    return _table(rows, _ANSWERS)


def _totals_part(table):
    """Distinct words of one part."""
    keys = [np.cumsum(_unpacked(k, s)) for k, s in zip(table["keys"].to_pylist(), table["size"].to_pylist())]
    return pa.table({"tokens": pa.array([sum(table["tokens"].to_pylist())]), "kinds": pa.array([len(np.unique(np.concatenate(keys)))])})


class Automaton:
    """Backoff automaton of a block's n-grams.

    State 0 is the empty history, state 1 + i the i-th word, the rest the
    bigrams. A state's arcs lie together, sorted by word, from ``start`` on;
    ``arc_key`` is state * words + word. ``fail`` and ``back`` are each state's
    failure arc and its weight. Histories without successors
    are no states: arcs that would lead there lead to the longest known suffix.
    """

    def __init__(self, grams, answers, n_tokens, denominator):
        one, two, three = grams[1], grams[2], grams[3]
        self.n_words = len(one.at)
        word = one.of
        uni = (answers.pop(1)[0] + 0.5) / denominator
        (count2, total2, kinds2), (count3, total3, kinds3) = answers.pop(2), answers.pop(3)
        v, w = word[two.at], word[two.at + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            # backoff weights by word and by bigram, from any n-gram that starts with them
            share1, share2 = np.zeros(self.n_words), np.zeros(len(two.at))
            share1[v] = np.where(total2 > 0, DISCOUNT * kinds2 / total2, 0)
            bigram = np.full(n_tokens, -1, np.int32)
            bigram[two.places] = two.of
            history = bigram[three.at]
            share2[history] = np.where(total3 > 0, DISCOUNT * kinds3 / total3, 0)
            lower = np.where(share1[v] > 0, share1[v], 1) * uni[w]
            p2 = np.where(count2 > 0, (count2 - DISCOUNT) / total2 + lower, lower)
            x, y = bigram[three.at + 1], word[three.at + 2]
            p3 = np.where(count3 > 0, (count3 - DISCOUNT) / total3 + share2[history] * p2[x], 0)
            self.back = np.log10(np.concatenate([[1.0], share1, share2]))
        known_word, known_pair = share1 > 0, share2 > 0
        seen2, seen3 = count2 > 0, count3 > 0
        # a block's tables are its task's memory: what is done with goes
        del count2, total2, kinds2, count3, total3, kinds3, share1, share2, lower, bigram
        of_word = np.where(known_word, 1 + np.arange(self.n_words), 0)
        of_pair = np.where(known_pair, 1 + self.n_words + np.arange(len(two.at)), of_word[w])
        self.fail = np.concatenate([[0], np.zeros(self.n_words, np.int64), of_word[w]])
        state = np.concatenate([1 + v[seen2], 1 + self.n_words + history[seen3]]).astype(np.int64)
        key = state * self.n_words + np.concatenate([w[seen2], y[seen3]])
        del state, v, y, history
        order = np.argsort(key, kind="stable")
        self.arc_key = key[order]
        del key
        self.start = np.searchsorted(self.arc_key, np.arange(len(self.fail) + 1) * self.n_words)
        self.arc_weight = np.log10(np.concatenate([p2[seen2], p3[seen3]]))[order]
        self.arc_to = np.concatenate([of_pair[seen2], of_pair[x[seen3]]])[order]
        self.root_weight, self.root_to = np.log10(uni), of_word

    def _arc(self, state, word):
        """Place of the arc of each (state, word), -1 where there is none."""
        at, end = self.start[state], self.start[state + 1]
        key = state * self.n_words + word
        place = np.full(len(state), -1)
        some = np.flatnonzero(at < end)
        hit = self.arc_key[at[some]] == key[some]
        place[some[hit]] = at[some[hit]]
        # most states have one arc; the others are searched
        more = some[~hit]
        more = more[end[more] - at[more] > 1]
        found = np.minimum(np.searchsorted(self.arc_key, key[more]), len(self.arc_key) - 1)
        hit = self.arc_key[found] == key[more] if len(more) else np.zeros(0, bool)
        place[more[hit]] = found[hit]
        return place

    def step(self, state, word):
        """(weights, next states) after reading one word from each state."""
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        open_, now = np.arange(len(state)), state
        while len(open_):
            w = word[open_]
            arc = self._arc(now, w)
            found = arc >= 0
            weight[open_[found]] += self.arc_weight[arc[found]]
            to[open_[found]] = self.arc_to[arc[found]]
            root = ~found & (now == 0)
            weight[open_[root]] += self.root_weight[w[root]]
            to[open_[root]] = self.root_to[w[root]]
            failing = ~found & (now > 0)
            open_, now = open_[failing], now[failing]
            weight[open_] += self.back[now]
            now = self.fail[now]
        return weight, to

    def read(self, word, first, stretch=STRETCH):
        """(log10 probability of each text, state after each token), all texts side by side."""
        begin, text = [], []
        lengths = np.diff(first)
        pieces = -(-lengths // stretch)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[:-1][text] + nth * stretch
        end = np.minimum(begin + stretch, first[1:][text])
        # two tokens before a later stretch lead to the state it starts in
        state = np.zeros(len(text), np.int64)
        later = np.flatnonzero(nth > 0)
        for back in (2, 1):
            _, state[later] = self.step(state[later], word[begin[later] - back])
        order = np.argsort(begin - end, kind="stable")
        begin, end, state, text = begin[order], end[order], state[order], text[order]
        sums, states = np.zeros(len(text)), np.zeros(len(word), np.int64)
        for t in range(int((end - begin).max()) if len(text) else 0):
            live = int(np.searchsorted(begin - end, -t, side="left"))
            weight, state[:live] = self.step(state[:live], word[begin[:live] + t])
            sums[:live] += weight
            states[begin[:live] + t] = state[:live]
        return np.bincount(text, sums, len(lengths)), states


def _text_batches(batches):
    """Blocks as packed texts beside their rows."""
    src = TaskContext.get().partitionId() << 33
    for batch in batches:
        for row, end, data, bounds in _blocks(batch.column(1)):
            rows = batch.column(0).slice(row, end - row)
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            text = pa.Codec("zstd", compression_level=3).compress(data.tobytes(), asbytes=True) if len(data) else b""
            columns = [pa.array([src]), lists, pa.array([text], pa.binary()), pa.array([_packed(bounds)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["src", "rows", "text", "bounds"])
            src += 1


def _read_tokens(text, bounds, n_rows):
    bounds = _unpacked(bounds, n_rows + 1).astype(np.int64)
    data = pa.decompress(text, int(bounds[-1]), "zstd", asbytes=True) if bounds[-1] else b""
    return _tokens(np.frombuffer(data, np.uint8), bounds)


def _gathered(n, gram, answers, rows):
    """(count, total of the history, its successors) of each n-gram of the block."""
    made = np.zeros((3, len(gram.at)), np.int64)
    for p, lo, hi in gram.slices:
        counts, totals, kinds = (answers[c][rows[n, p]].as_py() for c in ("counts", "totals", "kinds"))
        made[0, lo:hi] = _unpacked(counts, hi - lo)
        if n > 1:
            run = _histories(gram.key[lo:hi])
            made[1, lo:hi] = _unpacked(totals, int(run[-1]) + 1)[run]
            made[2, lo:hi] = _unpacked(kinds, int(run[-1]) + 1)[run]
    return made


def _score_block(answers, block, parts, denominator):
    rows = block["rows"].combine_chunks().flatten()
    hashes, first = _read_tokens(block["text"][0].as_py(), block["bounds"][0].as_py(), len(rows))
    at = {(n, p): i for i, (n, p) in enumerate(zip(answers["n"].to_pylist(), answers["part"].to_pylist()))}
    grams, found = {}, {}
    for n, gram in _block_grams(hashes, first, parts):
        grams[n], found[n] = gram, _gathered(n, gram, answers, at)
        gram.key = None
    word, known = grams[1].of, found[1][0] > 0
    automaton = Automaton(grams, found, len(hashes), denominator)
    del grams, found, hashes
    pa.default_memory_pool().release_unused()
    score, _ = automaton.read(word, first)
    return pa.table(
        {
            "row": rows,
            "n_tokens": pa.array(np.diff(first)),
            "n_known": pa.array(np.add.reduceat(known[word].astype(np.int64), first[:-1])),
            "base": pa.array(np.add.reduceat(automaton.root_weight[word], first[:-1])),
            "score": pa.array(score),
        }
    )


def score(docs: DataFrame, train, keep: list, again: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with n_tokens, n_known, train_tokens, base_score and score.

    ``train`` is a Boolean column: the rows the model learns from.
    """
    text, taught = F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    packed = docs.select(F.struct(*keep).alias("row"), text, taught)
    if not again:
        packed = Scratch(docs.sparkSession, "language-model").write(packed, "docs")
    size = packed.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    parts = 1 + size // PART

    found = packed.where("train").select("text").mapInArrow(lambda b: _word_batches(b, parts), _WORDS)
    sums = found.groupBy("part").applyInArrow(_totals_part, "tokens long, kinds long")
    sums = sums.agg(F.sum("tokens").alias("t"), F.sum("kinds").alias("k")).first()
    total, kinds = sums["t"] or 0, sums["k"] or 0
    denominator = total + 0.5 * (kinds + 1)
    # asks and texts read the same columns, so that blocks begin at the same rows
    asks = packed.mapInArrow(lambda b: _ask_batches(b, parts), _ASKS)
    answers = asks.groupBy("n", "part").applyInArrow(_answer_part, _ANSWERS)
    row = packed.schema["row"]
    more = T._parse_datatype_string("text binary, bounds binary").fields
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("rows", T.ArrayType(row.dataType)), *more])
    blocks = packed.mapInArrow(_text_batches, schema)
    values = T._parse_datatype_string("n_tokens long, n_known long, base double, score double").fields
    scored = answers.groupBy("src").cogroup(blocks.groupBy("src")).applyInArrow(
        lambda left, right: _score_block(left, right, parts, denominator), T.StructType([row, *values])
    )
    return scored.select(
        "row.*", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )


def fold(doc_id):
    """crc32 of the id as text, modulo 5; null ids count as an empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5))

"""Sampled SentencePiece segmentations without replacement, and decoding.

Spaces become U+2581 and texts are cut into words as pieces can lie: before a
run of spaces, and around characters that occur in no longer piece. A word's
lattice holds every vocabulary piece that matches, and byte pieces for a
character that no piece stands for alone. Piece probabilities follow the
vocabulary order, 1 / (rank + ``RANK_SHIFT``): a byte-pair vocabulary has merge
ranks, not probabilities.

Sampling is Gumbel top-k without replacement. The text's lattice is searched
from the left, best first: a partial segmentation carries its perturbed log
probability, the maximum over its completions. The root's is one Gumbel value;
where a path goes on, the chosen arc inherits the value and every other arc gets
a Gumbel value cut off at it. So the first path is drawn by the arcs' backward
probabilities, and each next one starts at the best arc passed over so far. The
paths come out distinct and in falling order. Each has its inclusion score: the
log probability that a sample of k holds it, given the best value left out.

Random numbers are hashes of row key, path, word and step: a row gives the same
samples wherever it runs. Lattices are built by array operations for the
distinct words of a block of texts; nothing grows with the corpus.

Defined cases: a null or empty text has one empty segmentation with inclusion 1;
texts with fewer segmentations than k give all of them; the character U+2581
itself goes through byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm import words

SAMPLES = 2
RANK_SHIFT = 10.0
BLOCK = 1 << 18
#: Arcs whose own log probability lies this far under their path's value are
#: not kept: their chance to come next is under e**-40.
FLOOR = 40.0
SPACE, LITERAL = 0x2581, 0x110000
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_FIELDS = "array<struct<ids:array<int>,log_prob:double,perturbed:double,inclusion:double,round_trip:boolean>>"


def _codes(text):
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def _spread(codes):
    return words.mix((codes.astype(np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03)) | _U(1)


class Vocabulary:
    """Pieces of a model file as arrays, to look up and to decode."""

    def __init__(self, path):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.bytes = np.zeros(256, dtype=np.int32)
        text = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[value], text[i] = i, bytes([value])
        for i in usual:
            text[i] = model.id_to_piece(i).replace("▁", " ").encode()
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)
        order = sorted(usual, key=lambda i: (-model.get_score(i), i))
        names = [_codes(model.id_to_piece(i)) for i in order]
        self.longest = max(len(x) for x in names)
        keys = np.array([_hash_one(x) for x in names], dtype=np.uint64)
        weight = -np.log(np.arange(len(order)) + RANK_SHIFT)
        at = np.argsort(keys)
        self.keys, self.ids, self.weight = keys[at], np.array(order, dtype=np.int32)[at], weight[at]
        # first look: the only piece of a slot, -1 for an empty slot, -2 for one with several
        slot = self.keys >> _U(43)
        self.slots = np.full(1 << 21, -1, dtype=np.int32)
        self.slots[slot] = np.arange(len(slot))
        many = np.flatnonzero(np.diff(slot) == 0)
        self.slots[slot[many]] = -2
        # beginnings of pieces: where a word goes on unlike any piece, longer ones need no look
        self.begins = np.zeros(1 << 21, dtype=bool)
        for x in names:
            run = _running(x)
            self.begins[_slice_hashes(run, np.zeros(len(x), dtype=np.int64), np.arange(1, len(x) + 1)) >> _U(43)] = True
        # pieces of one character, -1 where there is none, and characters that begin any
        self.single = np.full(LITERAL + 1, -1, dtype=np.int32)
        self.length = np.array([len(x) for x in names])[at]
        one = np.flatnonzero(self.length == 1)
        self.single[[int(names[i][0]) for i in at[one]]] = one
        self.first = np.zeros(LITERAL + 1, dtype=bool)
        self.first[[int(x[0]) for x in names]] = True
        self.byte_weight = float(-np.log(len(order) + RANK_SHIFT)) - 2.0
        # characters met inside longer pieces; all others stand alone
        self.joined = np.zeros(LITERAL + 1, dtype=bool)
        for x in names:
            if len(x) > 1:
                self.joined[x] = True

    def find(self, hashes):
        """Place of each hash among the pieces, -1 where there is none."""
        out = self.slots[hashes >> _U(43)]
        several = np.flatnonzero(out == -2)
        if len(several):
            out[several] = np.minimum(np.searchsorted(self.keys, hashes[several]), len(self.keys) - 1)
        out[self.keys[out] != hashes] = -1
        return out


def _hash_one(codes):
    return _slice_hashes(_running(codes), np.array([0]), np.array([len(codes)]))[0]


def _running(codes):
    run = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_spread(codes) * words.powers(_STEP, len(codes)), out=run[1:])
    return run


def _slice_hashes(run, start, end):
    return (run[end] - run[start]) * words.powers(_STEP_BACK, len(run))[start]


def _take(starts, counts):
    """Indices start, start+1, ... of each slice, one after another."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else starts
    return shift + np.arange(total)


class Lattice:
    """Arcs of the distinct words of some texts; nodes are their characters."""

    def __init__(self, codes, limits, vocabulary):
        """``codes``: the texts' characters one after another, ``limits``: where each begins."""
        self.v = vocabulary
        joined = vocabulary.joined[codes]
        space = codes == SPACE
        edge = np.ones(len(codes) + 1, dtype=bool)
        if len(codes):
            edge[1:-1] = (space[1:] & ~space[:-1]) | ~joined[1:] | ~joined[:-1]
        edge[limits] = True
        self.begin = np.flatnonzero(edge)
        self._arcs(codes, self.begin[:-1], self.begin[1:])

    def _arcs(self, codes, start, end):
        """Match all pieces in the distinct words; ``word`` maps each occurrence to its word."""
        v, run = self.v, _running(codes)
        keys, index, self.word = np.unique(_slice_hashes(run, start, end), return_index=True, return_inverse=True)
        length = (end - start)[index]
        self.first = np.concatenate([[0], np.cumsum(length)])
        chars = codes[_take(start[index], length)]
        self.stop = np.repeat(self.first[1:], length)
        rest = self.stop - np.arange(len(chars))
        run = _running(chars)
        piece = v.single[chars]
        alone = piece < 0
        found_at, found = [np.flatnonzero(~alone)], [piece[~alone]]
        at = np.flatnonzero(v.first[chars])
        for size in range(2, v.longest + 1):
            at = at[rest[at] >= size]
            hashes = _slice_hashes(run, at, at + size)
            # a whole piece is a beginning too, so what begins none is not looked up
            begun = v.begins[hashes >> _U(43)]
            at = at[begun]
            if not len(at):
                break
            piece = v.find(hashes[begun])
            ok = piece >= 0
            found_at.append(at[ok])
            found.append(piece[ok])
        lone = np.flatnonzero(alone)
        raw = [chr(c).encode() if c != LITERAL else "▁".encode() for c in chars[lone].tolist()]
        count = np.array([len(b) for b in raw], dtype=np.int64)
        # ids of an arc lie in one pool: a piece has one, a byte arc, numbered behind the pieces, one per byte
        self.pool = np.concatenate([v.ids, v.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]])
        self.pool_n = np.concatenate([np.ones(len(v.ids), dtype=np.int64), count])
        self.pool_at = np.cumsum(self.pool_n) - self.pool_n
        # by node, long pieces first: they are the likely ones; a node has one arc of a width
        many = alone.astype(np.int64)
        for at in found_at:
            many[at] += 1
        self.arc_first = np.concatenate([[0], np.cumsum(many)])
        self.piece, free = np.empty(int(self.arc_first[-1]), dtype=np.int32), self.arc_first[:-1].copy()
        for at, mine in zip(found_at[::-1], found[::-1]):
            self.piece[free[at]] = mine
            free[at] += 1
        self.piece[free[lone]] = len(v.ids) + np.arange(len(lone))
        self.node = np.repeat(np.arange(len(chars)), many)
        self.width = np.concatenate([v.length, np.ones(len(lone), dtype=np.int64)])[self.piece]
        weight = np.concatenate([v.weight, count * v.byte_weight])[self.piece]
        self._backward(weight, rest, len(chars))

    def _backward(self, weight, rest, n):
        """Arc log probabilities from the weights of all completions."""
        total = np.zeros(n + 1)
        many = np.diff(self.arc_first)
        nodes = np.argsort(rest.astype(np.uint16) if n and rest.max() < 1 << 16 else rest, kind="stable")
        limits = np.searchsorted(rest[nodes], np.arange(1, (int(rest.max()) if n else 0) + 2))
        # arcs of the nodes one step from their word's end, then two, and so on
        many = many[nodes]
        order, heads = _take(self.arc_first[nodes], many), np.concatenate([[0], np.cumsum(many)])
        arc_limits = heads[limits]
        to = self.node + self.width
        to[self.width == rest[self.node]] = n
        to, value = to[order], weight[order]
        for i in range(len(limits) - 1):
            a, b = arc_limits[i], arc_limits[i + 1]
            if a == b:
                continue
            here = slice(limits[i], limits[i + 1])
            first, mine = heads[here] - a, value[a:b]
            mine += total[to[a:b]]
            high = np.maximum.reduceat(mine, first)
            sums = np.add.reduceat(np.exp(mine - np.repeat(high, many[here])), first)
            total[nodes[here]] = high + np.log(sums)
        self.log_p = np.empty(len(value))
        self.log_p[order] = value
        self.log_p -= total[self.node]
        # the sum of the probabilities up to each arc of a node
        share = np.cumsum(np.exp(self.log_p))
        before = np.concatenate([[0.0], share])[self.arc_first[:-1]]
        self.upto = share - before[self.node]
        # rounding must not leave a gap after a node's last arc
        self.upto[self.arc_first[1:] - 1] = 2.0

    def draw(self, occurrence, node, seed):
        """Sampled arcs from ``node`` to each word's end: (occurrence, arc), in order."""
        stop = self.first[self.word[occurrence] + 1]
        live = np.flatnonzero(node < stop)
        lives, arcs, steps = [], [], np.zeros(len(occurrence), dtype=np.int64)
        node = node.copy()
        with np.errstate(over="ignore"):
            base = seed + occurrence.astype(np.uint64) * _U(0xBF58476D1CE4E5B9)
        while len(live):
            with np.errstate(over="ignore"):
                u = words.mix(base[live] + _U((len(arcs) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF))
            u = (u >> _U(11)).astype(np.float64) * 2.0**-53
            here = node[live]
            arc = self.arc_first[here]
            more = np.flatnonzero(self.upto[arc] <= u)
            while len(more):
                arc[more] += 1
                more = more[self.upto[arc[more]] <= u[more]]
            lives.append(live)
            arcs.append(arc)
            steps[live] += 1
            here += self.width[arc]
            node[live] = here
            live = live[here < stop[live]]
        # occurrences ascend, so each one's arcs go behind those of the ones before
        first = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), dtype=np.int64)
        for step, (live, arc) in enumerate(zip(lives, arcs)):
            out[first[live] + step] = arc
        return np.repeat(occurrence, steps), out


def _row_seeds(keys, salt):
    with np.errstate(over="ignore"):
        return words.mix(words.mix(keys.astype(np.int64).view(np.uint64) + _U(0x632BE59BD9B4E019)) + _U(salt))


def _siblings(lattice, paths, fixed, before, values, seeds, heaps, turn, k):
    """Push the arcs passed over along new paths, each with its cut-off Gumbel value.

    For each path: ``fixed`` arcs are an older path's, ``before`` is the log
    probability up to there, ``values`` its perturbed log probability. Of many
    values only the highest can come up in k turns, the rest is left out.
    """
    length = np.array([len(p) for p in paths]) - fixed
    size = np.minimum(length, 256)
    while True:
        arcs = np.concatenate([p[f : f + n] for p, f, n in zip(paths, fixed, size)])
        first = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(np.arange(len(paths)), size)
        after = np.cumsum(lattice.log_p[arcs])
        base = np.concatenate([[0.0], after])[first[:-1]]
        after += (before - base)[row]
        reach = np.concatenate([[0.0], after[:-1]])
        reach[first[:-1][size > 0]] = before[size > 0]
        ends = after[np.maximum(first[1:] - 1, 0)] if len(after) else before
        more = (size < length) & (ends >= values - FLOOR)
        if not more.any():
            break
        size = np.where(more, length, size)
    kept = reach >= values[row] - FLOOR
    step = (np.arange(len(arcs)) - first[row] + np.asarray(fixed)[row])[kept]
    arcs, reach, row = arcs[kept], reach[kept], row[kept]
    node = lattice.node[arcs]
    count = lattice.arc_first[node + 1] - lattice.arc_first[node] - 1
    # each node's arcs lie together; step over the chosen one
    other = _take(lattice.arc_first[node], count)
    at = np.repeat(np.arange(len(arcs)), count)
    other += other >= arcs[at]
    row, step = row[at], step[at]
    phi = lattice.log_p[other] + reach[at]
    limits = np.searchsorted(row, np.arange(len(paths) + 1))
    with np.errstate(over="ignore"):
        x = words.mix(seeds[row] + (np.arange(1, len(row) + 1) - limits[row]).astype(np.uint64) * _U(0x9FB21C651E98DF25))
        u = ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        g = phi - np.log(np.exp(np.minimum(phi - values[row], 700)) - np.log(u))
    for i, heap in enumerate(heaps):
        a, b = limits[i], limits[i + 1]
        best = a + np.argpartition(-g[a:b], k)[: k + 1] if b - a > k + 1 else range(a, b)
        for j in best:
            heapq.heappush(heap, (-float(g[j]), turn, int(step[j]), int(other[j]), float(phi[j])))


def sample_block(texts, keys, vocabulary, k):
    """k sampled segmentations for each text: lists of (ids, log_prob, perturbed, inclusion)."""
    whole = "".join(texts)
    codes = _codes(whole)
    limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = np.where(codes == SPACE, LITERAL, np.where(codes == 32, SPACE, codes))
    lattice = Lattice(codes, limits, vocabulary)
    begin = lattice.begin
    # words of each text, numbered from its first
    row_first = np.searchsorted(begin[:-1], limits)
    n_words = np.diff(row_first)
    row = np.repeat(np.arange(len(texts)), n_words)
    local = np.arange(len(begin) - 1) - row_first[row]
    seeds = _row_seeds(keys, 1)
    owner, arcs = _draw_rows(lattice, row_first, row, local, lattice.first[lattice.word], np.arange(len(row)), seeds[row])
    at = np.searchsorted(owner, row_first)
    paths = [arcs[at[i] : at[i + 1]] for i in range(len(texts))]
    values = -np.log(-np.log(((_row_seeds(keys, 2) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53))
    heaps, out = [[] for _ in texts], [[] for _ in texts]
    shared = np.zeros(len(texts), dtype=np.int64)
    start = np.zeros(len(texts))
    alive = range(len(texts))
    heads = {}
    for turn in range(k):
        alive = np.asarray(alive)
        for i in alive:
            out[i].append((paths[i], float(lattice.log_p[paths[i]].sum()), float(values[i])))
        _siblings(
            lattice, [paths[i] for i in alive], shared[alive], start[alive], values[alive], _row_seeds(keys, 100 + turn)[alive],
            [heaps[i] for i in alive], turn, k,
        )
        if turn + 1 == k:
            break
        alive = [i for i in alive if heaps[i]]
        if not alive:
            break
        # the best arcs passed over, each followed by a fresh draw to the text's end
        occurrence, node = [], []
        for i in alive:
            g, came, place, arc, phi = heapq.heappop(heaps[i])
            source = out[i][came][0]
            head = np.append(source[:place], arc)
            heads[i] = head
            values[i], start[i], shared[i] = -g, phi, len(head)
            word = row_first[i] + _word_of(lattice, source, place)
            occurrence.append(np.arange(word, row_first[i + 1]))
            first = lattice.first[lattice.word[occurrence[-1]]]
            first[0] = lattice.node[arc] + lattice.width[arc]
            node.append(first)
        occurrence, node = np.concatenate(occurrence), np.concatenate(node)
        turn_seeds = _row_seeds(keys, 3 + turn)
        owner, arcs = _draw_rows(lattice, row_first, row, local, node, occurrence, turn_seeds[row[occurrence]])
        at = np.searchsorted(owner, row_first)
        for i in alive:
            paths[i] = np.append(heads[i], arcs[at[i] : at[i + 1]])
    return lattice, [_finished(o, h) for o, h in zip(out, heaps)]


def _draw_rows(lattice, row_first, row, local, node, occurrence, seeds):
    """Draw with numbers that depend on a word's place in its text only."""
    with np.errstate(over="ignore"):
        seeds = seeds + (local[occurrence] - occurrence).astype(np.int64).view(np.uint64) * _U(0xBF58476D1CE4E5B9)
    return lattice.draw(occurrence, node, seeds)


def _word_of(lattice, path, place):
    """How many words of the text end before the arc at ``place``."""
    to = lattice.node[path[:place]] + lattice.width[path[:place]]
    return int((to == lattice.stop[lattice.node[path[:place]]]).sum())


def _finished(paths, heap):
    left_out = -heap[0][0] if heap else -math.inf
    rows = []
    for path, log_prob, value in paths:
        x = log_prob - left_out
        # log(1 - exp(-exp(x)))
        inclusion = 0.0 if x > 5 else x if x < -30 else math.log(-math.expm1(-math.exp(x)))
        rows.append((path, log_prob, value, inclusion))
    return rows


def _encode_batches(batches, vocabulary, k, block):
    v = Vocabulary.__new__(Vocabulary)
    v.__dict__.update(vocabulary)
    for batch in batches:
        _, offsets = words.columns(batch.column(1))
        for a, b in words.spans(offsets, block):
            part = batch.slice(a, b - a)
            texts = [t or "" for t in part.column(1).to_pylist()]
            keys = np.asarray(part.column(2).fill_null(0))
            lattice, found = sample_block(texts, keys, v, k)
            flat = [s for rows in found for s in rows]
            arcs = np.concatenate([s[0] for s in flat]) if flat else np.zeros(0, np.int64)
            made = lattice.piece[arcs]
            counts = lattice.pool_n[made]
            ids = lattice.pool[_take(lattice.pool_at[made], counts)].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])])]
            samples = pa.StructArray.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                    *[pa.array([s[j] for s in flat], pa.float64()) for j in (1, 2, 3)],
                    pa.array(_same_text(v, ids, ends, [t for t, rows in zip(texts, found) for _ in rows]), pa.bool_()),
                ],
                names=["ids", "log_prob", "perturbed", "inclusion", "round_trip"],
            )
            limits = np.concatenate([[0], np.cumsum([len(rows) for rows in found])])
            lists = pa.ListArray.from_arrays(pa.array(limits, pa.int32()), samples)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["row", "samples"])


def _bytes_of(text, text_at, ids, ends):
    """Bytes of id lists laid end to end, and where each list's bytes end."""
    length = (text_at[1:] - text_at[:-1])[ids]
    return text[_take(text_at[:-1][ids], length)], np.concatenate([[0], np.cumsum(length)])[ends]


def _same_text(v, ids, ends, texts):
    """Whether each id list decodes to its text."""
    raw, at = _bytes_of(v.text, v.text_at, ids, ends)
    return [raw[a:b].tobytes() == t.encode() for a, b, t in zip(at[:-1], at[1:], texts)]


def _decode_batches(batches, text, text_at):
    for batch in batches:
        ids = batch.column(1)
        flat, counts = np.asarray(ids.flatten()), np.asarray(pa.compute.list_value_length(ids).fill_null(0))
        raw, ends = _bytes_of(text, text_at, flat, np.concatenate([[0], np.cumsum(counts)]))
        texts = pa.Array.from_buffers(
            pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
        ).cast(pa.large_string())
        yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], names=["row", "decoded"])


def encode(docs: DataFrame, model_path: str, k: int = SAMPLES, block: int = BLOCK) -> DataFrame:
    """(row, samples): k sampled segmentations of each row's ``text``, seeded by ``doc_id``.

    ``row`` holds the other columns; the text comes back from the ids. Each
    sample is decoded where it was made and compared with the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_path)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    packed = docs.select(row, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("key"))
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string(f"samples {_FIELDS}").fields])
    return packed.mapInArrow(lambda batches: _encode_batches(batches, shared.value, k, block), schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """(row, decoded): the text of each row's id list."""
    v = Vocabulary(model_path)
    shared = encoded.sparkSession.sparkContext.broadcast((v.text, v.text_at))
    row = F.struct(*[F.col(f"`{c}`") for c in encoded.columns if c != ids]).alias("row")
    packed = encoded.select(row, F.col(ids).alias("ids"))
    schema = T.StructType([packed.schema["row"], T.StructField("decoded", T.StringType())])
    return packed.mapInArrow(lambda batches: _decode_batches(batches, *shared.value), schema)

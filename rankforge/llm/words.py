"""Word hashes of whole Arrow batches, by array operations inside the tasks.

A text's bytes are lower-cased (A-Z only) and cut at separator bytes. A word's
64-bit hash is a sum of byte codes times powers of an odd number, taken from one
running sum over the batch, so no Python runs per word. Batches are cut into
blocks of about ``BLOCK`` bytes, at document borders, which bounds the memory
however long or many the texts are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

# everything in ASCII but digits and letters
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False

_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict = {}


def mix(x):
    """Finish a hash so that every bit depends on all bits (64-bit avalanche)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def powers(step: int, n: int):
    """step**0 .. step**(n-1) modulo 2**64, kept for the next block."""
    have = _powers.get(step)
    if have is None or len(have) < n:
        # of a usual block and no more: every worker keeps them
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, step, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers.clear() if len(_powers) > 4 else None
        _powers[step] = have
    return have[:n]


class Block:
    """Words of some consecutive texts of a batch.

    ``raw`` and ``data`` hold the bytes as they are and lower-cased, ``bounds`` the texts' byte limits,
    ``starts``/``ends`` each word's byte limits, ``first`` the number of words
    before each text (one more entry than texts) and ``first_row`` the batch
    row of the first text.
    """

    def __init__(self, data, bounds, separators, first_row):
        self.raw, self.data, self.bounds, self.first_row = data, LOWER[data], bounds, first_row
        inside = ~separators[data]
        # a text border inside a run of word bytes cuts the run
        edge = np.diff(inside.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        cuts = inner[inside[inner] & inside[inner - 1]] if len(inner) else inner
        if len(cuts):
            cuts = np.unique(cuts)
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, bounds, side="left")

    def __len__(self):
        return len(self.bounds) - 1

    def hashes(self):
        """One well-mixed uint64 per word."""
        n = len(self.data)
        run = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[self.data] * powers(_STEP, n), out=run[1:])
        return mix((run[self.ends] - run[self.starts]) * powers(_STEP_BACK, n + 1)[self.starts])

    def texts_of_words(self):
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def word(self, i):
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def columns(texts):
    """Bytes and byte limits of an Arrow string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def spans(offsets, block=BLOCK):
    """Row ranges of about ``block`` bytes each; a longer text is a range of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, side="right")) - 1)
        yield row, min(end, n)
        row = end


def blocks(texts, separators, block=BLOCK):
    data, offsets = columns(texts)
    for row, end in spans(offsets, block):
        base = offsets[row]
        yield Block(data[base : offsets[end]], offsets[row : end + 1] - base, separators, row)


_GRAM = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def grams(hashes, n):
    """Hash of each run of ``n`` words (also across texts: the caller masks those)."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(k, _U(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * _U(_GRAM[i % 4]) + hashes[i : i + k]
            out ^= out >> _U(29)
    return mix(out)


def shingle_sets(block, size=5):
    """Each text's sorted distinct shingle hashes.

    A text with fewer words than ``size``, but not none, has its whole word
    sequence as one shingle; a text without words has none.
    """
    hashes = block.hashes()
    long = grams(hashes, size)
    for i in range(len(block)):
        lo, hi = block.first[i], block.first[i + 1]
        if hi - lo >= size:
            yield np.unique(long[lo : hi - size + 1])
        elif hi > lo:
            yield grams(hashes[lo:hi], hi - lo)
        else:
            yield hashes[:0]

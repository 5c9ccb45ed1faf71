"""Byte pairs merged by rank, with the places of every token in its text.

The vocabulary is a public rank table (``base64 rank`` lines) named by its path
on the driver; tasks get it with the function. Texts are cut into words by the
vocabulary's pattern, a word's bytes are merged lowest rank first, and a word
met before in the task is not merged again.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the words of a byte-level vocabulary.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merged words a task remembers.
KEPT_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte lengths of a word's tokens: the pair of least rank is merged first, the left one of equals.

    Candidate pairs wait in a heap; a pair whose parts have changed since is
    passed over, so a long word costs n log n.
    """
    n = len(word)
    if n < 2 or word in ranks:
        return [n] if n else []
    end = list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(waiting, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    gone = bytearray(n)
    while waiting:
        _, i, middle, stop = heapq.heappop(waiting)
        j = after[i]
        if gone[i] or j >= n or end[i] != middle or end[j] != stop:
            continue
        end[i], gone[j], after[i] = stop, 1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(end[i] - i)
        i = after[i]
    return out


def token_ends(text: str, ranks: dict[bytes, int], kept: dict, words=regex.compile(WORDS)) -> np.ndarray:
    """Place after each token, in characters; a token that ends inside a character ends before it."""
    ends, at = [], 0
    for match in words.finditer(text):
        word = match.group()
        sizes = kept.get(word)
        if sizes is None:
            data = word.encode("utf-8", "surrogatepass")
            stops = np.cumsum(merged(data, ranks))
            if len(data) != len(word):
                # characters that begin before a stop, less one that goes on behind it
                starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                begun = np.searchsorted(starts, stops)
                inside = (stops < len(data)) & ~np.isin(stops, starts)
                stops = begun - inside
            sizes = stops.tolist()
            if len(kept) < KEPT_WORDS:
                kept[word] = sizes
        ends += [at + s for s in sizes]
        at += len(word)
    return np.array(ends, dtype=np.int64)


def token_window_chunks(docs: DataFrame, path: str, size: int = 256, overlap: int = 50, text: str = "text", min_len: int = 30) -> DataFrame:
    """``docs`` without ``text``, with (chunk_index, n_tokens, chunk): windows of ``size`` tokens cut out of the text itself.

    A window begins ``size - overlap`` tokens after the last one; the last ends
    with the text. Windows are stripped, those under ``min_len`` dropped. A null
    text has none.
    """
    ranks, step = read_ranks(path), size - overlap
    rest = [c for c in docs.columns if c != text]
    schema = T.StructType(
        [T.StructField("row", T.StructType([docs.schema[c] for c in rest])), *T._parse_datatype_string("at int, n_tokens int, chunk string").fields]
    )

    def run(batches):
        kept: dict = {}
        for batch in batches:
            rows, at, counts, chunks = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ends = token_ends(value or "", ranks, kept)
                starts = np.concatenate([[0], ends])
                index = 0
                for first in range(0, max(1, len(ends) - overlap) if len(ends) else 0, step):
                    last = min(first + size, len(ends))
                    piece = value[starts[first] : ends[last - 1]].strip()
                    if len(piece) >= min_len:
                        rows.append(i)
                        at.append(index)
                        counts.append(last - first)
                        chunks.append(piece)
                        index += 1
                    if last == len(ends):
                        break
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(counts, pa.int32()), pa.array(chunks, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "n_tokens", "chunk"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text).cast("string").alias("text"))
    found = packed.mapInArrow(run, schema)
    return found.select("row.*", F.col("at").alias("chunk_index"), "n_tokens", F.col("chunk"))

"""Nearest neighbours by a block matrix join on int8 tiles.

Vectors are packed into blocks inside the tasks that read them. Every candidate
block meets every query block once, by an equality join on query block numbers;
in a tile the int8 products give all distances with a bound of the quantisation
error. Only pairs whose lower bound does not exceed the k-th smallest upper
bound are recomputed from the original values in double precision, and merged
into one heap of k per query. So results are exact, and what leaves a task is k
rows per query and run of tiles.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id; vectors of different length
never meet; rows that repeat a query's id are not its candidates, and as queries
each has rows of its own; with fewer than k candidates all are returned. Values
whose squares would leave the range of doubles are scaled by a power of two, so
distances within that range are right.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from rankforge.llm.store import Scratch

CANDIDATE_ROWS, QUERY_ROWS = 4096, 512
#: Candidates that meet a query block under one join key, and query rows whose heaps a task holds.
CHUNK_ROWS, HELD_ROWS = 1 << 18, 1 << 14
_PACKED = "ids binary, width int, data binary"


def _pack_batches(batches, dtype, rows):
    """Blocks of at most ``rows`` usable vectors of one length."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        usable = np.asarray(vectors.is_valid()) & np.asarray(ids.is_valid())
        out = []
        for width in np.unique(lengths[usable & (np.nan_to_num(lengths) > 0)]).astype(int):
            at = np.flatnonzero(usable & (lengths == width))
            flat = vectors.take(pa.array(at)).flatten()
            whole = np.asarray(flat.is_valid()).reshape(-1, width).all(axis=1)
            x = np.asarray(flat.fill_null(0)).astype(dtype).reshape(-1, width)
            # components that overflow nothing: finite, and not all zero
            good = whole & np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x, key = x[good], np.asarray(ids.take(pa.array(at[good]))).astype(np.int64)
            out += [(key[i : i + rows], int(width), x[i : i + rows]) for i in range(0, len(x), rows)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k.tobytes() for k, _, _ in out], pa.binary()),
                pa.array([w for _, w, _ in out], pa.int32()),
                pa.array([x.tobytes() for _, _, x in out], pa.binary()),
            ],
            names=["ids", "width", "data"],
        )


def _quantise(x):
    """int8 codes as floats, scale, and each vector's exact error norm and code norm."""
    scale = max(float(np.abs(x).max()), 1e-300) / 127
    codes = np.rint(x / scale)
    near = codes * scale
    return codes, scale, np.sqrt(((x - near) ** 2).sum(axis=1)), np.sqrt((near**2).sum(axis=1))


def _exact(x, y):
    """Euclidean distances of row pairs, components added in order."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += (x[:, j] - y[:, j]) ** 2
    return np.sqrt(total)


def _tile(heaps, q_ids, q, c_ids, c, k):
    """Merge one tile into the queries' heaps, lists of at most k (-score, -id)."""
    most = max(float(np.abs(q).max()), float(np.abs(c).max()))
    unit = 1.0 if 1e-100 < most < 1e100 else 2.0 ** np.frexp(most)[1]
    if unit != 1:
        q, c = q / unit, c / unit
    kind = np.float32 if q.shape[1] <= 1000 else np.float64  # products of codes stay exact
    q_codes, q_scale, q_error, q_near = _quantise(q)
    c_codes, c_scale, c_error, c_near = _quantise(c)
    product = (q_codes.astype(kind) @ c_codes.astype(kind).T).astype(np.float64) * (q_scale * c_scale)
    q_norm, c_norm = np.sqrt((q**2).sum(axis=1)), np.sqrt((c**2).sum(axis=1))
    square = q_norm[:, None] ** 2 + c_norm[None, :] ** 2 - 2 * product
    # |x.y - x'.y'| <= |x| e(y) + e(x) |y'|, doubled; the rest is for rounding
    slack = 2 * (q_norm[:, None] * c_error[None, :] + q_error[:, None] * c_near[None, :])
    slack += 1e-9 * (q_norm[:, None] + c_norm[None, :]) ** 2
    own = q_ids[:, None] == c_ids[None, :]
    upper = np.where(own, np.inf, square + slack)
    lower = np.where(own, np.inf, square - slack)
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
    for i, heap in enumerate(heaps):
        bound = min(limit[i], (heap[0][0] / unit) ** 2 * (1 + 1e-9)) if len(heap) == k else limit[i]
        at = np.flatnonzero((lower[i] <= bound) & ~own[i])
        for score, key in zip(_exact(np.broadcast_to(q[i], (len(at), q.shape[1])), c[at]).tolist(), c_ids[at].tolist()):
            entry = (-score * unit, -key)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def _join_batches(batches, dtype, k):
    def matrix(data, width):
        return np.frombuffer(data, dtype=dtype).reshape(-1, width).astype(np.float64)

    def result(block, ids, heaps):
        rows = [(block * QUERY_ROWS + i, int(name), -key, -score) for i, (name, heap) in enumerate(zip(ids, heaps)) for score, key in heap]
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.float64()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names=["asked", "query_id", "vec_id", "score"]
        )

    # blocks come in any order: their heaps are kept side by side, up to a bound
    held: dict = {}
    for batch in batches:
        for row in batch.to_pylist():
            key = row["block"], row["width"]
            if key not in held:
                if sum(len(ids) for ids, _, _ in held.values()) >= HELD_ROWS:
                    yield from (result(block, ids, heaps) for (block, _), (ids, _, heaps) in held.items())
                    held = {}
                ids = np.frombuffer(row["q_ids"], dtype=np.int64)
                held[key] = ids, matrix(row["q_data"], row["width"]), [[] for _ in ids]
            ids, q, heaps = held[key]
            _tile(heaps, ids, q, np.frombuffer(row["ids"], dtype=np.int64), matrix(row["data"], row["width"]), k)
    yield from (result(block, ids, heaps) for (block, _), (ids, _, heaps) in held.items())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest in ``vectors``.

    Both tables need ``vec_id`` and ``embedding``.
    """
    tmp = Scratch(vectors.sparkSession, "vectors")
    element = vectors.schema["embedding"].dataType.elementType
    dtype = np.dtype("<f4") if isinstance(element, T.FloatType) else np.dtype("<f8")

    def packed(df, rows):
        pairs = df.select(F.col("vec_id").cast("long"), "embedding")
        return pairs.mapInArrow(lambda batches: _pack_batches(batches, dtype, rows), _PACKED)

    # one row per query block: numbering them sorts rows / QUERY_ROWS small ids
    asked = tmp.write(packed(queries, QUERY_ROWS).withColumn("mark", F.monotonically_increasing_id()), "queries")
    order = asked.select("mark").withColumn("block", F.row_number().over(W.orderBy("mark")).cast("long") - 1)
    asked = tmp.write(asked.join(order, "mark").select("block", "width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "asked")
    count = asked.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    if not count:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # part of the key, so that one query block never has the whole table in one task
    chunks = 1 + vectors.count() // CHUNK_ROWS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    tiles = packed(vectors, CANDIDATE_ROWS).withColumn("chunk", F.pmod(F.xxhash64("ids"), F.lit(chunks))).withColumn("block", every(count))
    tiles = tiles.join(asked.withColumn("chunk", every(chunks)), ["block", "width", "chunk"])
    tiles = tiles.select("block", "width", "ids", "data", "q_ids", "q_data")
    found = tiles.mapInArrow(lambda batches: _join_batches(batches, dtype, k), "asked long, query_id long, vec_id long, score double")
    first = W.partitionBy("asked").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

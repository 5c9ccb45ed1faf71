"""Exact nearest vectors where tiles that cannot matter never meet.

Every vector belongs to the cell of its nearest pivot, one of at most
``PIVOTS`` corpus vectors picked by hash; a cell is cut into tiles of bounded
rows. A tile's radius is the largest angle between its pivot and its vectors.
First each tile of queries is searched in its own cell, which gives a k-th
score for each query. By the triangle inequality two vectors of a query tile
and a corpus tile are at an angle of at least that of the pivots less both
radii; a pair of tiles whose best possible score stays below every query's
k-th score is left out. Only the corpus tiles that are left are sent to a query
tile, so no tile of queries gets a copy of the corpus. Where so many are left
that whole blocks of ``BLOCK_ROWS`` rows meet with fewer rows sent, blocks are
searched instead, from the k-th scores already known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators import dense
from rankforge.session import materialize

PIVOTS = 256
BLOCK_ROWS = 32_768
#: Angles and scores are computed in doubles; bounds get this much more.
SLACK = 1e-6


def _pivots(corpus: DataFrame, most: int) -> np.ndarray:
    share = min(1.0, most / max(1, corpus.count()))
    some = corpus.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(np.ceil(share * (1 << 30))))
    # the hash picks about ``most``; the limit only bounds what the driver gets
    found = some.orderBy(F.xxhash64("doc_id")).limit(2 * most).select("vector").toPandas()["vector"]
    return dense.unit_rows(found) if len(found) else np.ones((1, 1))


def _in_cells(df: DataFrame, key: str, pivots: np.ndarray, tile_rows: int, name: str) -> DataFrame:
    """Rows with their cell, tile and angle to the cell's pivot."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, vector {df.schema['vector'].dataType.simpleString()}, cell int, angle double"

    def assign(batches):
        for batch in batches:
            unit = dense.unit_rows(batch["vector"]) if len(batch) else np.zeros((0, pivots.shape[1]))
            near = unit @ pivots.T
            cell = near.argmax(axis=1) if len(batch) else np.zeros(0, int)
            angle = np.arccos(np.clip(near[np.arange(len(batch)), cell], -1, 1))
            # a zero vector is near to nothing; its tile is left out nowhere
            angle[~unit.any(axis=1)] = np.pi
            yield batch.assign(cell=cell.astype("int32"), angle=angle)

    rows = materialize(df.select(key, "vector").mapInPandas(assign, schema))
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(key, F.lit(7)), F.col("parts")).cast("int")
    return materialize(rows.join(F.broadcast(parts), "cell").withColumn(name, F.col("cell").cast("long") * (1 << 31) + part).drop("parts"))


def _search(q: DataFrame, c: DataFrame, keys: list[str], k: int, exclude_self: bool, schema) -> DataFrame:
    """The ``k`` best of each query in each pair of tiles or blocks, from its ``least`` score on."""

    def tile(left, right):
        if left.empty or right.empty:
            return pd.DataFrame({"system": [], "qid": [], "doc_id": [], "score": []})
        q_ids, c_ids = left["qid"].to_numpy(), right["doc_id"].to_numpy()
        unit = dense.unit_rows(left["vector"]), dense.unit_rows(right["vector"])
        found = dense._tile_top(q_ids, unit[0], c_ids, unit[1], k, exclude_self, left["least"].to_numpy())
        return dense._frame(q_ids, found, "all")

    # both sides come from one table: fresh columns keep them apart
    left, right = (df.toDF(*df.columns).groupBy(*keys) for df in (q.select(*keys, "qid", "vector", "least"), c.select(*keys, "doc_id", "vector")))
    return left.cogroup(right).applyInPandas(tile, schema)


def _in_blocks(q: DataFrame, c: DataFrame, n_q: int, n_c: int) -> tuple[DataFrame, DataFrame]:
    """Every block of queries beside every block of the corpus."""
    n_q, n_c = (-(-n // BLOCK_ROWS) for n in (n_q, n_c))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("cb", every(n_c)),
        c.withColumn("cb", F.pmod(F.xxhash64("doc_id"), F.lit(n_c)).cast("int")).withColumn("qb", every(n_q)),
    )


def pruned_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool, schema, tile_rows: int, most: int = PIVOTS, report: list | None = None) -> DataFrame:
    """``(system, qid, doc_id, score)`` candidates with each query's ``k`` nearest among them.

    ``report``, if given, gets the numbers of tile pairs that met and that there are.
    """
    spark = queries.sparkSession
    pivots = _pivots(corpus, most)
    if pivots.shape == (1, 1):
        return spark.createDataFrame([], schema)
    q = _in_cells(queries, "qid", pivots, tile_rows, "qt")
    c = _in_cells(corpus, "doc_id", pivots, tile_rows, "ct")
    tiles = lambda df, name: df.groupBy(name, "cell").agg(F.max("angle").alias("radius"))
    c_tiles = materialize(tiles(c, "ct"))
    own = tiles(q, "qt").select("qt", "cell").join(c_tiles.select("ct", "cell"), "cell").select("qt", "ct")
    lowest = F.lit(dense.scan.LOWEST).alias("least")
    near = materialize(_search(q.join(own, "qt").select("*", lowest), c.join(own, "ct"), ["qt", "ct"], k, exclude_self, schema))
    last = dense.top_k(near, k, ("qid",)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    # a query that found fewer than k has no bound yet
    q = materialize(q.join(last, "qid", "left").withColumn("least", F.when(F.col("n") >= k, F.col("last")).otherwise(dense.scan.LOWEST)).drop("n", "last"))
    floor = q.groupBy("qt", "cell").agg(F.max("angle").alias("radius"), F.greatest(F.min("least"), F.lit(-2.0)).alias("floor"))
    # tiles of the corpus by pivot: as many as there are tiles, a few numbers each
    held = c_tiles.toPandas()
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))

    def partners(batches):
        for batch in batches:
            for qt, cell, radius, least in zip(batch["qt"], batch["cell"], batch["radius"], batch["floor"]):
                angle = np.maximum(apart[cell, held["cell"]] - radius - held["radius"] - SLACK, 0)
                left = held["ct"][(np.cos(angle) + SLACK >= least) & (held["cell"] != cell)]
                yield pd.DataFrame({"qt": qt, "ct": left})

    pairs = materialize(floor.mapInPandas(partners, "qt long, ct long"))
    if report is not None:
        report.append((own.count() + pairs.count(), q.select("qt").distinct().count() * len(held)))
    q_met, c_met = q.join(pairs, "qt"), c.join(pairs, "ct")
    n_q, n_c = q.count(), c.count()
    if q_met.count() + c_met.count() > n_q * -(-n_c // BLOCK_ROWS) + n_c * -(-n_q // BLOCK_ROWS):
        return _search(*_in_blocks(q, c, n_q, n_c), ["qb", "cb"], k, exclude_self, schema)
    return near.unionByName(_search(q_met, c_met, ["qt", "ct"], k, exclude_self, schema))

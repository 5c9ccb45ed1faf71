"""Shards of nearly equal bytes that keep equal texts together.

Texts are ordered by a 64-bit hash; equal texts form one atomic group. The
smallest shard capacity that a greedy fill of 16 contiguous shards can meet is
found by binary search, and the shards are cut where that fill cuts.

The search works on cells: all groups that share their first hash bits. A cell
is taken once as dividable anywhere (a bound from below) and once as atomic (a
bound from above). Only the cells in which some cut can still lie are divided
further, 256 ways, until both bounds meet; so the driver sees a bounded number
of cell sums, never the groups, and the result is exact.

Built-in functions only. Defined cases: a null text counts as an empty one, its
size is 1; an empty table gives an empty result; repeated rows each take a slot.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankforge.llm.store import Scratch

SHARDS = 16
FIRST_BITS, MORE_BITS = 16, 8
SLOT_CELLS = 4096


class Cells:
    """Ordered cells as (first hash, bits, bytes, groups); see the module's text."""

    def __init__(self, cells, shards):
        self.cells = sorted(cells)
        self.shards = shards
        # limits[i] is the number of bytes before cell i
        self.limits = [0, *accumulate(c[2] for c in self.cells)]
        self.total = self.limits[-1]

    def atomic(self, i):
        return self.cells[i][3] == 1 or self.cells[i][1] >= 64

    def cuts(self, capacity, fluid):
        """Where a greedy fill ends each shard, or None if bytes are left over."""
        at, out = 0, []
        for _ in range(self.shards):
            want = min(at + capacity, self.total)
            i = bisect_right(self.limits, want) - 1
            inside = i < len(self.cells) and self.limits[i] < want
            at = want if inside and fluid and not self.atomic(i) else max(at, self.limits[i])
            out.append(at)
        return out if at >= self.total else None

    def least(self, fluid):
        low, high = -(-self.total // self.shards), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, fluid) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def open(self):
        """Cells in which a cut of the best fill may still lie; none when it is known."""
        low, high = self.least(True), self.least(False)
        first, last = self.cuts_upto(low), self.cuts(high, True)
        found = set()
        for a, b in zip(first, last):
            start = max(0, bisect_right(self.limits, a) - 1)
            end = min(len(self.cells), bisect_left(self.limits, b) + 1)
            found.update(i for i in range(start, end) if not self.atomic(i))
        return [] if low == high and self.cuts(low, True) == self.cuts(low, False) else sorted(found)

    def cuts_upto(self, capacity):
        """Ends of the pessimistic fill, whether or not it takes in everything."""
        at, out = 0, []
        for _ in range(self.shards):
            at = max(at, self.limits[bisect_right(self.limits, min(at + capacity, self.total)) - 1])
            out.append(at)
        return out

    def borders(self):
        """First hash of each shard but the first; None where a shard stays empty."""
        cuts = self.cuts(self.least(False), False)
        starts = []
        for end in cuts[:-1]:
            i = bisect_left(self.limits, end)
            starts.append(self.cells[i][0] if i < len(self.cells) else None)
        return starts


def _cells(groups: DataFrame, bits: int):
    """Cell sums of the groups at so many leading bits."""
    return [
        (r.first, bits, r.bytes, r.groups)
        for r in groups.groupBy(F.shiftleft(F.shiftright("h", 64 - bits), 64 - bits).alias("first"))
        .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
        .collect()
    ]


def minimax_borders(groups: DataFrame, shards: int = SHARDS):
    """Hashes at which the shards of ``groups`` (h, bytes) begin."""
    cells = Cells(_cells(groups, FIRST_BITS), shards)
    while cells.cells:
        divide = cells.open()
        if not divide:
            break
        old = [cells.cells[i] for i in divide]
        fresh = []
        for bits in sorted({c[1] for c in old}):
            starts = [c[0] for c in old if c[1] == bits]
            part = groups.filter(F.shiftleft(F.shiftright("h", 64 - bits), 64 - bits).isin(starts))
            fresh += _cells(part, bits + MORE_BITS)
        kept = set(old)
        cells = Cells([c for c in cells.cells if c not in kept] + fresh, shards)
    return cells.borders() if cells.cells else []


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = tmp.write(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "rows",
    )
    groups = tmp.write(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "groups")
    place = F.lit(0)
    for border in minimax_borders(groups, shards):
        if border is not None:
            place = place + F.when(F.col("h") >= F.lit(border), 1).otherwise(0)
    placed = rows.withColumn("shard", place.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SLOT_CELLS))
    )
    # a slot is the rows of the shard's earlier cells plus the place in the own one
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "cell").orderBy("doc_id", "h")
    # at most shards x SLOT_CELLS rows, whatever the number of documents
    return (
        placed.withColumn("at", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at") - 1).alias("slot"))
    )

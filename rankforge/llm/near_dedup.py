"""Near-duplicate documents by HyperMinHash sketches.

A document is the set of its distinct 5-word shingles. One hash per shingle is
dealt to one of 128 buckets; a bucket keeps its smallest value in compressed
form, the count of leading zeros and the mantissa bits that follow. Four
neighbouring registers form a band. At a similarity of 0.75 two documents miss
each other in all 32 bands with a probability of 0.684**32, about 5e-6. Short
sets use few registers, so sets of ``SHORT`` shingles and less are met without
them: the least n - ceil(0.75 n) + 1 hashes of a set are buckets too, one of
which any two such sets at 0.75 share, and their pairs go to the full sets
unestimated.

The work, all on Spark tables:

1. sketch every document inside the task that reads it; equal sets become one
   class, so copies never meet again;
2. in each band bucket, pair every class with one leader, estimate the
   similarity from the registers with the expected chance collisions taken off,
   and confirm the rest on the full sets; join the links to components;
3. what still shares a bucket in different components is compared in tiles:
   estimates from the registers, then the full sets, all inside the task. Only
   links that join two components leave a tile. Members of a group's most common
   component never meet each other: they are sent once for each part of the
   others. A group of copies, however large, so costs a pair per member and
   leader, and no pair of different components in a bucket goes unseen.

Defined cases: null or word-less texts have an empty set and are linked with
nothing. A row without ``doc_id`` is linked with nothing, its component is null
and it is kept. Repeated rows each get a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm import words
from rankforge.llm.components import components
from rankforge.llm.store import Scratch

BUCKETS, ROWS, MANTISSA = 128, 4, 26
BANDS = BUCKETS // ROWS
VALUE_BITS = 64 - 7
EMPTY = np.uint32(0xFFFFFFFF)
#: A pair is dropped unread only when its estimate lies this many standard
#: deviations of an estimate from the registers in use under the threshold.
DEVIATIONS = 4
#: Sets up to this size meet by their least hashes, also with larger ones.
SHORT = 32
TILE_ROWS, TILE_SHINGLES = 1024, 500_000
LEADER_ROUNDS = 1
WORDS = 5


def registers(hashes):
    """128 compressed registers of a sorted array of distinct shingle hashes."""
    edges = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(VALUE_BITS)
    at = np.searchsorted(hashes, edges)
    ends = np.append(at[1:], len(hashes))
    full = at < ends
    low = np.zeros(BUCKETS, dtype=np.uint64)
    low[full] = hashes[at[full]] & np.uint64((1 << VALUE_BITS) - 1)
    return low, full


def compress(low, full):
    """Leading zeros (6 bits) and mantissa (26 bits) of each bucket's value."""
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(VALUE_BITS - exponent, 0, 62).astype(np.uint32)
    tail = np.floor((fraction * 2 - 1) * (1 << MANTISSA)).clip(0, (1 << MANTISSA) - 1).astype(np.uint32)
    tail[low == 0] = 0
    return np.where(full, (zeros << np.uint32(MANTISSA)) | tail, EMPTY)


def band_keys(sketches):
    """(keys, used) for a matrix of registers; a band of empty registers is not used."""
    with np.errstate(over="ignore"):
        parts = sketches.reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.full(parts.shape[:2], 0x51ED270B7A103F2D, dtype=np.uint64)
        key = key + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(ROWS):
            key = words.mix(key ^ parts[:, :, i])
    return key.view(np.int64), (parts != EMPTY).any(axis=2)


def chance(n, m):
    """Expected share of registers that agree by chance for disjoint sets.

    Bucket minima are exponential with rates proportional to ``n`` and ``m``. A
    register's cell is 2**-26 of its octave wide, 0.7213 = 1 / (2 ln 2) times
    the value on average, so the share is 0.7213 * 2**-26 * n*m / (n+m)**2.
    """
    n, m = np.asarray(n, dtype=np.float64), np.asarray(m, dtype=np.float64)
    return 2.0**-MANTISSA / (2 * np.log(2)) * n * m / np.maximum(n + m, 1) ** 2


def estimate(a, b, n, m):
    """Similarity from two register matrices, chance collisions taken off, and registers in use."""
    used = (a != EMPTY) | (b != EMPTY)
    in_use = np.maximum(used.sum(axis=-1), 1)
    share = ((a == b) & used).sum(axis=-1) / in_use
    off = chance(n, m)
    return np.clip((share - off) / (1 - off), 0, 1), in_use


def may_link(a, b, n, m, percent):
    """Pairs whose full sets are compared: short ones, and those not estimated far too low."""
    similar, in_use = estimate(a, b, n, m)
    least = percent / 100
    low = similar < least - DEVIATIONS * np.sqrt(least * (1 - least) / in_use)
    return ~low | (np.minimum(n, m) <= SHORT)


def least_hashes(hashes, percent):
    """The hashes of a short set of which a linked set has one among its own; none of a long set."""
    n = len(hashes)
    if n * percent > SHORT * 100:
        return hashes[:0]
    return hashes[: n - -(-n * percent // 100) + 1]


def _binary(rows, width):
    """Arrow binary column of equally wide byte rows."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _matrix(column, dtype, width):
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _set_key(hashes):
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch_batches(batches, size, percent):
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.zeros(batch.num_rows, dtype=np.int64)
        key = np.zeros(batch.num_rows, dtype=np.int64)
        low = np.zeros((batch.num_rows, BUCKETS), dtype=np.uint64)
        full = np.zeros((batch.num_rows, BUCKETS), dtype=bool)
        short = [b""] * batch.num_rows
        for block in words.blocks(batch.column(1), words.SPACE):
            for i, hashes in enumerate(words.shingle_sets(block, size), block.first_row):
                if len(hashes):
                    n[i], key[i] = len(hashes), _set_key(hashes)
                    low[i], full[i] = registers(hashes)
                    short[i] = least_hashes(hashes, percent).tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(key), _binary(compress(low, full), 4 * BUCKETS), pa.array(short, pa.binary())],
            names=["doc_id", "n", "c", "sketch", "short"],
        )


def sketch(docs: DataFrame, size: int = WORDS, percent: int = 75) -> DataFrame:
    """(doc_id, n, c, sketch, short): set size, key of the set, registers, least hashes of a short set."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _sketch_batches(batches, size, percent), "doc_id long, n long, c long, sketch binary, short binary"
    )


def _band_batches(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        classes = np.asarray(batch.column(0))
        keys, used = band_keys(_matrix(batch.column(1), np.uint32, BUCKETS))
        least = [np.frombuffer(v, np.uint64) for v in batch.column(2).to_pylist()]
        c = np.concatenate([np.repeat(classes, used.sum(axis=1)), np.repeat(classes, [len(v) for v in least])])
        # not the value that a band of the same number would have
        short = words.mix(np.concatenate(least) ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[used], short])), pa.array(c)], names=["k", "c"])


def _estimate_batches(batches, percent):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (_matrix(batch.column(i), np.uint32, BUCKETS) for i in (4, 5))
        keep = may_link(a, b, np.asarray(batch.column(2)), np.asarray(batch.column(3)), percent)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _set_batches(batches, size):
    for batch in batches:
        if not batch.num_rows:
            continue
        want, keep, sets = np.asarray(batch.column(0)), [], []
        for block in words.blocks(batch.column(1), words.SPACE):
            for i, hashes in enumerate(words.shingle_sets(block, size), block.first_row):
                if len(hashes) and _set_key(hashes) == want[i]:
                    keep.append(want[i])
                    sets.append(hashes.tobytes())
            if sum(map(len, sets)) > 8 * words.BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], names=["c", "hashes"])
                keep, sets = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], names=["c", "hashes"])


def _confirm_batches(batches, percent):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _read_rows(table):
    """Columns of one role in a tile: classes, labels, registers, sets."""
    sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["hashes"]]
    return np.asarray(table["c"]), np.asarray(table["label"]), _matrix(table["sketch"], np.uint32, BUCKETS), sets


def _tile_links(table, percent):
    """Confirmed links that join different components within one tile.

    Rows of the tile's most common component are compared with the others only.
    Registers are compared first; sets are intersected through the tile's
    postings. A link is kept if it joins two components not joined yet here.
    """
    import pyarrow.compute as pc

    out, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    roles = [_read_rows(table.filter(pc.equal(table["side"], side))) for side in (0, 1)]
    if all(len(r[0]) for r in roles):
        names, counts = np.unique(np.concatenate([r[1] for r in roles]), return_counts=True)
        common = names[counts.argmax()]
        for (c, label, registers_, sets), (other_c, other_label, other_registers, other_sets), rest in (
            (*roles, False), (*roles[::-1], True),
        ):
            sizes = np.array([len(s) for s in other_sets])
            flat, owner = np.concatenate(other_sets), np.repeat(np.arange(len(other_sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            # the second turn only adds what the first left out: its rows against the common component
            pool = other_label == common if rest else np.ones(len(other_c), dtype=bool)
            for i in np.flatnonzero(label != common):
                mine = sets[i]
                at = pool & (other_label != label[i])
                at &= 100 * np.minimum(sizes, len(mine)) >= percent * np.maximum(sizes, len(mine))
                at = np.flatnonzero(at)
                at = at[may_link(registers_[i], other_registers[at], len(mine), sizes[at], percent)]
                if not len(at):
                    continue
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                spans = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low)
                both = np.bincount(owner[spans + np.arange(len(spans))], minlength=len(sizes))[at]
                for j in at[100 * both >= percent * (len(mine) + sizes[at] - both)]:
                    x, y = root(label[i]), root(other_label[j])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((min(c[i], other_c[j]), max(c[i], other_c[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


class NearDuplicates:
    """Links of one document table; see the module's text for the steps."""

    def __init__(self, docs: DataFrame, percent: int = 75, size: int = WORDS):
        self.docs, self.percent, self.size = docs, percent, size
        self.tmp = Scratch(docs.sparkSession, "near-dedup")
        self.base = self.tmp.write(sketch(docs, size, percent), "sketches")

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), one row per input row."""
        tmp = self.tmp
        linked = self.base.filter("n > 0 and doc_id is not null")
        self.classes = tmp.write(
            linked.groupBy("c").agg(F.min("doc_id").alias("doc_id"), *[F.first(x).alias(x) for x in ("n", "sketch", "short")]),
            "classes",
        )
        bands = tmp.write(self.classes.select("c", "sketch", "short").mapInArrow(_band_batches, "k long, c long"), "bands")
        held = bands.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
        self.members = tmp.write(bands.join(held, "k"), "members")
        tmp.drop("bands")
        self.tested, self.labels = None, None
        for step in range(LEADER_ROUNDS):
            if not self._link(self._leader_pairs(step), f"leaders-{step}"):
                break
        self._join(self.tmp.write(self._cross_links(), "cross"), "cross")
        self.tmp.drop("open-sets")
        return self._result()

    def _labelled(self) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        if self.labels is None:
            return self.members.withColumn("label", F.col("c"))
        rows = self.members.join(self.labels.withColumnRenamed("node", "c"), "c", "left").withColumn(
            "label", F.coalesce("label", "c")
        )
        several = rows.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        return rows.join(several.select("k"), "k")

    def _leader_pairs(self, step: int) -> DataFrame:
        rows = self._labelled()
        leader = rows.groupBy("k").agg(
            F.min_by(F.struct("c", "label"), F.xxhash64("c", F.lit(step))).alias("leader")
        )
        return (
            rows.join(leader, "k")
            .filter("label <> leader.label")
            .select(F.least("c", "leader.c").alias("a"), F.greatest("c", "leader.c").alias("b"))
        )

    def _cross_links(self) -> DataFrame:
        """Links between components that still share a bucket, confirmed in tiles.

        Buckets with the same leader hold nearly the same classes and form one
        group, so a class goes to few groups. A group's most common component
        and the rest are cut into parts of bounded rows and shingles each; a
        tile compares two parts of the rest, or a part of the rest with one of
        the common component.
        """
        tmp = self.tmp
        rows = tmp.write(self._labelled().select("k", "c", "label"), "open")
        leader = tmp.write(rows.groupBy("k").agg(F.min_by("c", F.xxhash64("c")).alias("group")), "groups")
        rows = rows.join(leader, "k").select("group", "c", "label").distinct()
        rows = tmp.write(rows.join(self.classes.select("c", "n"), "c"), "rows")
        sets = tmp.write(self._sets(rows.select("c")), "open-sets").dropDuplicates(["c"])
        by_label = rows.groupBy("group", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
        most = F.max(F.struct("rows", "label", "shingles"))
        parts = lambda rows, shingles: F.greatest(F.ceil(rows / TILE_ROWS), F.ceil(shingles / TILE_SHINGLES))
        # a written table, so that the join may split the rows of a large group
        sized = tmp.write(
            by_label.groupBy("group")
            .agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
            .select(
                "group",
                F.col("most.label").alias("common"),
                parts(F.col("most.rows"), F.col("most.shingles")).alias("common_parts"),
                parts(F.col("rows") - F.col("most.rows"), F.col("shingles") - F.col("most.shingles")).alias("other_parts"),
            ),
            "sized",
        )
        common = F.col("label") == F.col("common")
        part = F.pmod(F.xxhash64("c", F.lit(1)), F.when(common, F.col("common_parts")).otherwise(F.col("other_parts")))
        # (of the rest, of the other side, whether that is the common component, this row's side)
        tile = lambda x, y, c, side: F.struct(
            x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(c).alias("common_side"), F.lit(side).alias("side")
        )
        every = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f)
        of_common = every(F.col("other_parts"), lambda x: tile(x, F.col("part"), True, 1))
        upwards = F.transform(F.sequence("part", F.col("other_parts") - 1), lambda y: tile(F.col("part"), y, False, 0))
        downwards = F.transform(F.sequence(F.lit(0).cast("long"), "part"), lambda x: tile(x, F.col("part"), False, 1))
        against = every(F.col("common_parts"), lambda y: tile(F.col("part"), y, True, 0))
        dealt = (
            rows.join(sized.filter("other_parts > 0"), "group")
            .withColumn("part", part)
            .select("group", "c", "label", F.explode(F.when(common, of_common).otherwise(F.concat(upwards, downwards, against))).alias("t"))
            .select("group", "t.*", "c", "label")
        )
        percent = self.percent
        return (
            dealt.join(self.classes.select("c", "sketch"), "c")
            .join(sets, "c")
            .groupBy("group", "x", "y", "common_side")
            .applyInArrow(lambda table: _tile_links(table, percent), "a long, b long")
        )

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(c, hashes) of the classes in ``wanted``, from a text of each class."""
        size = self.size
        wanted = wanted.distinct().join(self.classes.select("c", "doc_id"), "c")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return texts.join(wanted, "doc_id").select("c", "text").mapInArrow(
            lambda batches: _set_batches(batches, size), "c long, hashes binary"
        )

    def _link(self, pairs: DataFrame, name: str) -> bool:
        """Test the pairs not tested yet, add the links, renew the labels."""
        tmp = self.tmp
        side = self.classes.select("c", "n")
        fresh = pairs.distinct()
        if self.tested is not None:
            fresh = fresh.join(self.tested, ["a", "b"], "left_anti")
        sized = fresh.join(side.toDF("a", "na"), "a").join(side.toDF("b", "nb"), "b").filter(
            F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        )
        sized = tmp.write(sized, f"{name}-pairs")
        self.tested = sized.select("a", "b") if self.tested is None else self.tested.union(sized.select("a", "b"))
        sketches = self.classes.select("c", "sketch")
        percent = self.percent
        near = tmp.write(
            sized.join(sketches.toDF("a", "sa"), "a")
            .join(sketches.toDF("b", "sb"), "b")
            .select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(lambda batches: _estimate_batches(batches, percent), "a long, b long"),
            f"{name}-near",
        )
        wanted = near.select(F.col("a").alias("c")).union(near.select(F.col("b").alias("c")))
        sets = tmp.write(self._sets(wanted), f"{name}-sets")
        links = tmp.write(
            near.join(sets.toDF("a", "ha"), "a")
            .join(sets.toDF("b", "hb"), "b")
            .select("a", "b", "ha", "hb")
            .mapInArrow(lambda batches: _confirm_batches(batches, percent), "a long, b long"),
            f"{name}-links",
        )
        tmp.drop(f"{name}-sets")
        return self._join(links, name)

    def _join(self, links: DataFrame, name: str) -> bool:
        """Renew the labels with new links; false when there are none."""
        if links.isEmpty():
            return False
        start = links if self.labels is None else links.union(
            self.labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        )
        self.labels = components(start, self.tmp, f"{name}-stars")
        return True

    def _result(self) -> DataFrame:
        found = self.classes.select("c", "doc_id")
        if self.labels is not None:
            found = found.join(self.labels.withColumnRenamed("node", "c"), "c", "left").withColumn(
                "label", F.coalesce("label", "c")
            )
            least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
            found = found.join(least, "label").select("c", "component_id")
        else:
            found = found.select("c", F.col("doc_id").alias("component_id"))
        rows = self.base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(found, "c", "left")
        alone = (F.col("n") == 0) | F.col("doc_id").isNull()
        rows = rows.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
        return rows.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = WORDS) -> DataFrame:
    """One row per document: set size, smallest doc_id of its component, kept or not."""
    return NearDuplicates(docs, percent, size).run()

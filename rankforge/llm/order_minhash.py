"""Fingerprints of texts that follow edit distance: Order MinHash.

A text is a row of symbols that together are the whole text: a run of letters
and digits (cut after ``RUN`` code points) or one other character, each with the
white space before it. Every run of ``k`` symbols is a k-mer, numbered by how
often it occurred before in the text, so repeats count. The hash of a numbered
k-mer names one of ``slots`` slots and its rank there. A slot keeps its
``length`` least numbered k-mers, puts them back into text order and hashes that
tuple, so a slot of two texts agrees only if they share those k-mers in the same
order. Likeness is the share of agreeing slots among those either text uses.

All expressions are Spark's own. A key of a k-mer is one number: 35 bits of hash
above 28 bits of place, so one sort brings equal k-mers together in text order.
Texts of any length are read whole; an array of more than 2^28 symbols does not
fit into a Spark row anyway.

Defined cases: a null text is empty; an empty text has no slots and is like
other empty ones (1) and unlike the rest (0); a text of fewer than ``k`` symbols,
but not none, has its whole row of symbols as its one k-mer. Repeated rows count
each. Rows with the same id follow one another in the order of their texts. Rows
without an id stand apart: they form ``APART`` groups by text hash, each in the
order of its hashes and ending at the first document. Where no row has an id, the
last of a group is compared with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K, LENGTH, SLOTS, RUN = 3, 2, 128, 8
#: Rows of a stretch of the order, unless that makes more stretches than STRETCHES.
STRETCH, STRETCHES, APART = 64, 65_536, 1_024

SYMBOL = rf"\s*(?:[\p{{L}}\p{{N}}\p{{M}}]{{1,{RUN}}}|\S)|\s+"
_PLACE = 28
_HASH = (1 << 63) - (1 << _PLACE)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and then read without a copy."""
    return F.transform(F.array(value), body)[0]


def _key(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(_HASH)).bitwiseOR(place)


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << _PLACE) - 1))


def _kmer(symbols: Column, at: Column, k: int) -> list[Column]:
    return [F.get(symbols, (at + j).cast("int")) for j in range(k)]


def _keys(symbols: Column, k: int) -> Column:
    """Sorted keys of all k-mers; equal k-mers follow each other in text order."""
    last = F.greatest(F.size(symbols) - k, F.lit(0)).cast("long")
    made = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: _key(F.xxhash64(*_kmer(symbols, i, k)), i))
    return F.sort_array(made)


def _numbered(keys: Column) -> Column:
    """Sorted keys of (k-mer, number of earlier occurrences); a first occurrence keeps its key."""
    same = F.lit(1 << _PLACE)
    bits = F.ceil(F.log2(F.size(keys) + 1)).cast("int")

    def equal(x, i, back):
        return F.get(keys, i - back).bitwiseXOR(x) < same

    def number(steps):
        def times(x, i):
            # the farthest equal key before this one, found bit by bit, since equal keys lie together
            farthest = F.reduce(steps, F.lit(0), lambda o, b: F.when(equal(x, i, o + b), o + b).otherwise(o))
            few = F.when(~F.coalesce(equal(x, i, 2), F.lit(False)), 1)
            return few.when(~F.coalesce(equal(x, i, 3), F.lit(False)), 2).otherwise(farthest)

        def key(x, i):
            again = _key(F.xxhash64(F.shiftright(x, _PLACE), times(x, i)), _place(x))
            return F.when(equal(x, i, 1), again).otherwise(x)

        return F.sort_array(F.transform(keys, key))

    return _let(F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b)), number)


def _slots(symbols: Column, keys: Column, k: int, length: int, slots: int) -> Column:
    """(slot << 32 | tuple hash) of every slot in use, from numbered keys."""
    width = F.lit(1 << (63 - (slots - 1).bit_length()))
    low = 63 - (slots - 1).bit_length()

    def other_slot(a, b):
        return a.bitwiseXOR(b) >= width

    def tuple_of(least, x, i):
        own = F.filter(F.array(*[F.get(least, i + j) for j in range(length)]), lambda y: ~other_slot(x, y))
        text_order = F.sort_array(F.transform(own, _place))
        hashed = F.xxhash64(F.transform(text_order, lambda p: F.array(*_kmer(symbols, p, k))))
        return F.shiftleft(F.shiftright(x, low), 32).bitwiseOR(hashed.bitwiseAND(F.lit((1 << 32) - 1)))

    def made(least):
        first = F.transform(
            least, lambda x, i: F.when((i == 0) | other_slot(F.get(least, i - 1), x), tuple_of(least, x, i))
        )
        return F.array_compact(first)

    least = F.filter(keys, lambda x, i: (i < length) | other_slot(F.get(keys, i - length), x))
    return _let(least, made)


def fingerprint(text: Column, k: int = K, length: int = LENGTH, slots: int = SLOTS) -> Column:
    """Slots in use of a text, ascending. ``slots``: a power of two."""
    none = F.array().cast("array<bigint>")

    def of(symbols):
        made = _let(_keys(symbols, k), lambda keys: _let(_numbered(keys), lambda n: _slots(symbols, n, k, length, slots)))
        return F.when(F.size(symbols) == 0, none).otherwise(made)

    return _let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)), of)


def as_text(slots: Column) -> Column:
    """A fingerprint as hexadecimal digits, ten per slot in use."""
    return F.array_join(F.transform(slots, lambda s: F.lpad(F.lower(F.hex(s)), 10, "0")), "")


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of agreeing slots among those in use in ``a`` or ``b``; 1 for two empty texts."""
    in_use = lambda f: F.transform(f, lambda s: F.shiftright(s, 32))
    full = (F.size(a) == slots) | (F.size(b) == slots)
    either = F.when(full, F.lit(slots)).otherwise(F.size(F.array_union(in_use(a), in_use(b))))
    agree = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(either == 0, F.lit(1.0)).otherwise(agree / either)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def _stretches(docs: DataFrame) -> DataFrame:
    """Rows dealt to stretches of descending ids, each ended by the row that follows its last one.

    The borders are ids that a hash picks, so each is the first row of its
    stretch and, as a guest, the last of the stretch before.
    """
    seen = docs.agg(F.count("id").alias("n"), F.max("id").alias("most"), F.count("*").alias("rows")).first()
    step = max(STRETCH, seen["n"] // STRETCHES)
    picked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("id").distinct()
    borders = sorted({*(r["id"] for r in picked.collect()), *([] if seen["most"] is None else [seen["most"]])})
    if not borders:
        at = (-1 - F.pmod(F.xxhash64("text"), F.lit(APART))).cast("int")
        return docs.withColumn("guest", F.lit(False)).withColumn("stretch", at)
    known = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")
    # borders below the id, found bit by bit
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(borders).bit_length()))])
    below = lambda at: F.coalesce(F.get(known, at - 1) < F.col("id"), F.lit(False))
    own = F.reduce(steps, F.lit(0), lambda at, b: F.when(below(at + b), at + b).otherwise(at))
    apart = (-1 - F.pmod(F.xxhash64("text"), F.lit(APART))).cast("int")
    last = len(borders) - 1
    homes = F.when(F.col("id").isNull(), F.array(apart))
    top = [F.lit(0)] + ([F.lit(-1 - g) for g in range(APART)] if seen["rows"] > seen["n"] else [])
    homes = homes.when(F.col("id") == borders[-1], F.array(F.lit(last), *top))
    dealt = docs.withColumn("own", own)
    is_border = F.get(known, F.col("own")) == F.col("id")
    homes = homes.when(is_border, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    return dealt.select("*", F.posexplode(homes).alias("at", "stretch")).withColumn("guest", F.col("at") > 0)


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fingerprints of ``doc_id, text`` rows, of their edited texts, and likenesses.

    ``row`` (a struct of the ``keep`` columns), n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next. One shuffle: a
    stretch of the order is one window group, and the fingerprint of the next row
    is read from the next row.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or ["doc_id"]]).alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = W.partitionBy("stretch").orderBy("guest", F.desc("id"), "tie", "text")
    tie = F.when(F.col("id").isNull(), F.xxhash64("text"))
    rows = _stretches(packed).select("row", "id", "text", "stretch", "guest", tie.alias("tie"))
    rows = rows.withColumn("following", F.coalesce(F.lead("text").over(order), "text"))
    # a row's own order key goes on by a hash, so that the texts end here
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("edit", edited(F.col("text"), F.col("following")))
    rows = rows.select(
        "row", "stretch", "guest", "place",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edit", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"),
        F.when(F.col("guest"), F.array().cast("array<bigint>")).otherwise(fingerprint(F.col("edit"))).alias("other"),
    )
    after = F.coalesce(F.lead("own").over(W.partitionBy("stretch").orderBy("place")), "own")
    return rows.withColumn("after", after).filter(~F.col("guest")).select(
        "row",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )

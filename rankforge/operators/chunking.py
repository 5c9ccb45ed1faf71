"""Chunkers: one page row in, ``(…, chunk_index, text)`` rows out.

Each is a fold over the pieces of one text inside its row, so pages stay in
the partition they were read in. Sizes count code points.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rankforge.functions.text import PARAGRAPH_BREAK, strip

# Least chunk lengths and the sentence and heading patterns.
PARAGRAPH_MIN = 50
SPLITTER_MIN = 30
SENTENCE_END = r"(?<=[.?!])\s+"
HEADING = r"(?m)^#{1,3} .*$"


def exploded(df: DataFrame, chunks: Column, keep) -> DataFrame:
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "text"))


def numbered_by_file(pages: DataFrame, chunks: Column, file: str = "file", page: str = "page", keep=()) -> DataFrame:
    """Chunks with an index that runs through all pages of a file.

    Pages carry their chunk counts into the window, never their chunks twice:
    a page's first index is the sum of the counts of the pages before it.
    """
    made = pages.select(file, page, *keep, chunks.alias("chunks"))
    before = W.partitionBy(file).orderBy(page).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("chunks")).over(before), F.lit(0)).alias("first")
    return made.select("*", first).select(
        file, page, *keep, F.posexplode("chunks").alias("at", "text"), "first"
    ).select(file, page, *keep, (F.col("first") + F.col("at")).cast("bigint").alias("chunk_index"), "text")


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda x: x != "")


def _state(out: Column, cur: Column) -> Column:
    return F.struct(out.alias("out"), cur.alias("cur"))


_NONE = lambda: F.array().cast("array<string>")


def _emit(out: Column, text: Column, keep: Column) -> Column:
    return F.when(keep, F.concat(out, F.array(text))).otherwise(out)


def paragraph_chunks(text: Column, size: int = 1000, min_len: int = PARAGRAPH_MIN, pattern: str = PARAGRAPH_BREAK) -> Column:
    """Whole short pages; long ones packed from paragraphs.

    Paragraphs join with a blank line while they fit. A paragraph longer than
    ``size`` stays whole; packs under ``min_len`` are dropped. Chunks do not
    overlap.
    """

    def step(s, p):
        fits = F.length(s["cur"]) + F.length(p) + 1 <= size
        joined = F.when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n\n"), p))
        full = _emit(s["out"], s["cur"], F.length(s["cur"]) >= min_len)
        return F.when(fits, _state(s["out"], joined)).otherwise(_state(full, p))

    packed = F.aggregate(
        _pieces(text, pattern),
        _state(_NONE(), F.lit("")),
        step,
        lambda s: _emit(s["out"], s["cur"], F.length(s["cur"]) >= min_len),
    )
    whole = F.when(F.length(text) >= min_len, F.array(text)).otherwise(_NONE())
    return F.when(F.length(text) <= size, whole).otherwise(packed)


def sentence_chunks(text: Column, size: int = 500, overlap: int = 100, min_len: int = SPLITTER_MIN) -> Column:
    """Sentences packed to ``size``; the next pack starts with the last ``overlap`` characters."""

    def step(s, x):
        fits = F.length(s["cur"]) + F.length(x) + 1 <= size
        joined = F.when(s["cur"] == "", x).otherwise(F.concat(s["cur"], F.lit(" "), x))
        if overlap:
            tail = F.when(F.length(s["cur"]) > overlap, F.concat(F.right(s["cur"], F.lit(overlap)), F.lit(" "), x)).otherwise(x)
        else:
            tail = x
        return F.when(fits, _state(s["out"], joined)).otherwise(_state(_emit(s["out"], s["cur"], s["cur"] != ""), tail))

    packed = F.aggregate(
        _pieces(text, SENTENCE_END),
        _state(_NONE(), F.lit("")),
        step,
        lambda s: _emit(s["out"], s["cur"], s["cur"] != ""),
    )
    return long_enough(packed, min_len)


def long_enough(chunks: Column, min_len: int) -> Column:
    return F.filter(F.transform(chunks, strip), lambda x: F.length(x) >= min_len)


def token_windows(tokens: Column, size: int = 256, overlap: int = 50, min_len: int = SPLITTER_MIN) -> Column:
    """Windows of ``size`` tokens that advance by ``size - overlap``."""
    step = size - overlap
    last = F.greatest(F.ceil((F.size(tokens) - size) / step), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(tokens, i * step + 1, size), " "))
    return long_enough(windows, min_len)


def heading_chunks(text: Column, min_len: int = SPLITTER_MIN) -> Column:
    """Sections between ``#`` to ``###`` headings, headings left out.

    Lines are stripped and blank runs become a soft break.
    """
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    sections = F.transform(F.split(lines, HEADING), lambda s: F.regexp_replace(strip(s), r"\n\n+", "  \n"))
    return long_enough(sections, min_len)


def character_chunks(text: Column, size: int, overlap: int, separator: str = "\n", min_len: int = SPLITTER_MIN) -> Column:
    """Pieces between separators packed to ``size``, whole pieces repeated up to ``overlap``."""
    gap = len(separator)

    def span(pieces):
        return F.length(F.array_join(pieces, separator))

    def step(s, p):
        joined = F.when(F.size(s["cur"]) > 0, span(s["cur"]) + gap).otherwise(0) + F.length(p)

        def tail_from(i):
            return F.slice(s["cur"], i + 1, F.greatest(F.size(s["cur"]) - i, F.lit(0)))

        def fits(i):
            rest = tail_from(i)
            added = F.when(F.size(rest) > 0, span(rest) + gap).otherwise(0) + F.length(p)
            return (F.size(rest) == 0) | ((span(rest) <= overlap) & (added <= size))

        first = F.get(F.filter(F.sequence(F.lit(0), F.size(s["cur"])), fits), 0)
        emitted = F.concat(s["out"], F.array(F.array_join(s["cur"], separator)))
        add = lambda cur: F.concat(cur, F.array(p))
        return F.when((joined <= size) | (F.size(s["cur"]) == 0), _state(s["out"], add(s["cur"]))).otherwise(
            _state(emitted, add(tail_from(first)))
        )

    packed = F.aggregate(
        F.filter(F.split(text, separator), lambda x: x != ""),
        _state(_NONE(), _NONE()),
        step,
        lambda s: _emit(s["out"], F.array_join(s["cur"], separator), F.size(s["cur"]) > 0),
    )
    return long_enough(packed, min_len)


# Separators of the recursive splitter, coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_chunks(text: Column, size: int = 300, overlap: int = 50, min_len: int = SPLITTER_MIN, separators=SEPARATORS) -> Column:
    """Pieces at the coarsest separator present, packed to ``size``; longer pieces go one separator finer.

    Separator by separator all open spans of the text are cut at once. Pieces
    under ``size`` are packed with whole pieces repeated up to ``overlap``, a
    longer piece ends the pack and stays open for the next separator. Spans are
    places in the text, so no text is copied before the last step.
    """
    return F.transform(F.array(text), lambda t: _recursive(t, size, overlap, min_len, separators))[0]


def _span(start, length, open_):
    return F.struct(start.alias("start"), length.alias("length"), F.lit(open_).alias("open"))


def _recursive(text, size, overlap, min_len, separators):
    def pack(lengths, begin, last):
        """Spans of consecutive pieces: packs, and long pieces on their own."""
        state = lambda out, cur, at: F.struct(out.alias("out"), cur.alias("cur"), at.alias("at"))
        held = lambda s: s["at"] - s["cur"][0]
        closed = lambda s: F.concat(s["out"], F.array(_span(s["cur"][0], held(s), False)))

        def step(s, n):
            after = s["at"] + n
            flushed = F.when(F.size(s["cur"]) > 0, closed(s)).otherwise(s["out"])
            long = state(F.concat(flushed, F.array(_span(s["at"], n, not last))), F.array().cast("array<int>"), after)
            full = (F.size(s["cur"]) > 0) & (held(s) + n > size)
            kept = F.filter(s["cur"], lambda c: (s["at"] - c <= overlap) & (s["at"] - c + n <= size))
            repeated = state(closed(s), F.concat(kept, F.array(s["at"])), after)
            more = state(s["out"], F.concat(s["cur"], F.array(s["at"])), after)
            return F.when(n >= size, long).when(full, repeated).otherwise(more)

        none = F.array().cast("array<struct<start:int,length:int,open:boolean>>")
        return F.aggregate(
            lengths, state(none, F.array().cast("array<int>"), begin), step,
            lambda s: F.when(F.size(s["cur"]) > 0, closed(s)).otherwise(s["out"]),
        )

    def cutter(separator, last):
        return lambda span: cut(span, separator, last)

    def cut(span, separator, last):
        part = F.substring(text, span["start"] + 1, span["length"])
        if separator:
            pieces = F.split(part, re.escape(separator), -1)
            lengths = F.transform(pieces, lambda x, i: F.length(x) + F.when(i > 0, len(separator)).otherwise(0))
            lengths = F.filter(lengths, lambda n: n > 0)
        else:
            lengths = F.array_repeat(F.lit(1), span["length"])
        whole = ~span["open"] if last else ~span["open"] | ~F.contains(part, F.lit(separator))
        return F.when(whole, F.array(span)).otherwise(pack(lengths, span["start"], last))

    spans = F.array(_span(F.lit(0), F.length(text), True))
    for i, separator in enumerate(separators):
        last = separator == "" or i == len(separators) - 1
        spans = F.flatten(F.transform(spans, cutter(separator, last)))
        if last:
            break
    return long_enough(F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["length"])), min_len)


def semantic_chunks(sentences: DataFrame, doc: str = "doc_id", percentile: float = 0.95, stdevs: float | None = None, min_len: int = SPLITTER_MIN) -> DataFrame:
    """Islands of sentences cut where neighbours are far apart.

    ``sentences`` has ``(doc, pos, sentence, vector)``; a cut falls after a
    sentence whose cosine distance to the next exceeds the document's
    percentile (or its mean plus ``stdevs`` deviations). All windows run on
    one document, so one shuffle by document serves them all.
    """
    from rankforge.operators.dense import unit_rows
    import numpy as np

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        gone = b.isna()
        out = pd.Series([None] * len(a), dtype="float64")
        if (~gone).any():
            x, y = unit_rows(a[~gone]), unit_rows(b[~gone])
            out[~gone.to_numpy()] = np.round(1 - np.einsum("ij,ij->i", x, y), 9)
        return out

    order = W.partitionBy(doc).orderBy("pos")
    gaps = sentences.withColumn("next", F.lead("vector").over(order)).withColumn("gap", distance("vector", "next"))
    whole = W.partitionBy(doc)
    if stdevs is None:
        limit = F.percentile("gap", F.lit(percentile)).over(whole)
    else:
        limit = F.avg("gap").over(whole) + F.stddev_pop("gap").over(whole) * stdevs
    cut = F.coalesce((F.lag("gap").over(order) > F.lag("limit").over(order)).cast("int"), F.lit(0))
    islands = gaps.withColumn("limit", F.round(limit, 9)).withColumn("cut", cut).withColumn("chunk", F.sum("cut").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return islands.groupBy(doc, "chunk").agg(joined.alias("text")).where(F.length(strip(F.col("text"))) >= min_len)


def window_vectors(sentences: DataFrame, doc: str = "doc_id", buffer: int = 1) -> DataFrame:
    """Each sentence's vector replaced by the sum over ``buffer`` neighbours on both sides."""
    near = F.collect_list("vector").over(W.partitionBy(doc).orderBy("pos").rowsBetween(-buffer, buffer))
    summed = lambda vs: F.aggregate(
        F.slice(vs, 2, F.size(vs)), vs[0].cast("array<double>"), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)
    )
    return sentences.withColumn("vector", near).withColumn("vector", summed(F.col("vector")))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def threshold_chunks(sentences: DataFrame, doc: str = "doc_id", threshold: float = 0.5, size: int = 500, min_len: int = SPLITTER_MIN) -> DataFrame:
    """Sentences join the group while they are near its centroid and it stays within ``size``.

    ``sentences`` has ``(doc, pos, sentence, vector)``. One fold per document
    carries the sum of the group's vectors, whose direction is the centroid's;
    a sentence whose cosine to it (9 places) is under ``threshold`` starts the
    next group, as does one without a vector.
    """

    def step(s, x):
        v = F.transform(x["vector"], lambda e: e.cast("double"))
        cosine = F.try_divide(_dot(s["sum"], v), F.sqrt(_dot(s["sum"], s["sum"])) * F.sqrt(_dot(v, v)))
        joins = (F.size(s["sum"]) > 0) & (F.round(F.coalesce(cosine, F.lit(0.0)), 9) >= threshold)
        joins &= s["chars"] + 1 + F.length(x["sentence"]) <= size
        joined = F.struct(
            s["groups"].alias("groups"),
            F.zip_with(s["sum"], v, lambda a, b: a + b).alias("sum"),
            (s["chars"] + 1 + F.length(x["sentence"])).alias("chars"),
            (s["at"] + 1).alias("at"),
        )
        fresh = F.struct(
            F.concat(s["groups"], F.array(s["at"])).alias("groups"),
            v.alias("sum"),
            F.length(x["sentence"]).alias("chars"),
            (s["at"] + 1).alias("at"),
        )
        return F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(fresh)

    start = F.struct(
        F.array().cast("array<int>").alias("groups"),
        F.array().cast("array<double>").alias("sum"),
        F.lit(0).alias("chars"),
        F.lit(0).alias("at"),
    )
    whole = sentences.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence", "vector"))).alias("s"))
    cut = whole.select(doc, F.transform("s", lambda x: x["sentence"]).alias("s"), F.aggregate("s", start, step, lambda s: s["groups"]).alias("g"))
    upto = lambda i: F.coalesce(F.get("g", i + 1), F.size("s"))
    texts = F.transform("g", lambda at, i: F.array_join(F.slice("s", at + 1, upto(i) - at), " "))
    return cut.select(doc, F.posexplode(texts).alias("chunk", "text")).where(F.length(strip(F.col("text"))) >= min_len)

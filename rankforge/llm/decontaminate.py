"""Documents that hold passages of a benchmark: broadcast window set, one scan.

Words are runs of letters, digits and non-ASCII characters of the A-Z
lower-cased text. A benchmark item's windows are its runs of 13 words; an item
of fewer words, but not none, is one window. Every document is read once, its
windows are hashed by array operations, looked up in the broadcast set, and
each hit is compared word by word before it counts.

The set is broadcast in parts of at most ``PART_WORDS`` benchmark words. Each
part is one narrow pass over the documents; the findings of a pass are written
before the next part is built, so the driver and each task hold one part at a
time however large the benchmark is. An item longer than a part is cut with an
overlap of a window less one word.

Defined cases: null texts and texts without words have no hits; an item without
words or without ``item_id`` has no windows; items with the same id count as
one; an empty benchmark marks nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm import words
from rankforge.llm.rows import with_report
from rankforge.llm.store import Scratch

WINDOW = 13
PART_WORDS = 1_000_000
FIELDS = "n_words long, n_hit long, items array<string>, hits array<struct<start:long,end:long>>"


class WindowSet:
    """Hash set of some benchmark windows with their words and items."""

    def __init__(self, items, window):
        """``items``: (item id, list of words, whole) triples; only whole short items are windows."""
        self.sizes, self.windows = set(), {}
        for item, tokens, whole in items:
            size = min(window, len(tokens))
            if not size or (size < window and not whole):
                continue
            self.sizes.add(size)
            # the words are their own separators' absence: joined by a space they read back
            block = words.Block(*_joined(tokens), words.NOT_ALNUM, 0)
            for at, h in enumerate(words.grams(block.hashes(), size).tolist()):
                self.windows.setdefault((size, h), {}).setdefault(tuple(tokens[at : at + size]), set()).add(item)
        self.table = {}
        for size in self.sizes:
            table = np.zeros(1 << 20, dtype=bool)
            keys = np.array([h for s, h in self.windows if s == size], dtype=np.uint64)
            table[keys >> np.uint64(44)] = True
            self.table[size] = (table, np.sort(keys))

    @classmethod
    def of(cls, parts):
        """The set again from its broadcast parts, which are plain values."""
        found = cls.__new__(cls)
        found.__dict__.update(parts)
        return found

    def scan(self, block):
        """(hit ranges as word positions, items) of each text of a block."""
        n = len(block.starts)
        hashes, mark = block.hashes(), np.zeros(n + 1, dtype=np.int64)
        items = [set() for _ in range(len(block))]
        text = block.texts_of_words()
        for size, (table, keys) in self.table.items():
            found = words.grams(hashes, size)
            at = np.flatnonzero(table[found >> np.uint64(44)])
            where = np.searchsorted(keys, found[at])
            at = at[(where < len(keys)) & (keys[np.minimum(where, len(keys) - 1)] == found[at])]
            at = at[text[at] == text[at + size - 1]]
            for p in at.tolist():
                passage = tuple(block.word(p + j) for j in range(size))
                owners = self.windows[size, int(found[p])].get(passage)
                if owners:
                    mark[p] += 1
                    mark[p + size] -= 1
                    items[text[p]] |= owners
        return np.cumsum(mark)[:n] > 0, items


def _joined(tokens):
    data = np.frombuffer(b" ".join(tokens), dtype=np.uint8)
    return data, np.array([0, len(data)])


def tokens_of(text):
    """Word list of one text, the same cut as in the scan."""
    block = next(words.blocks(pa.array([text], pa.string()), words.NOT_ALNUM))
    return [block.word(i) for i in range(len(block.starts))]


def _parts(benchmark, window, part_words):
    """Window sets of at most ``part_words`` words, read row by row."""
    part, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.filter("item_id is not null and text is not null").toLocalIterator():
        tokens = tokens_of(text)
        step = max(1, part_words - window + 1)
        for at in range(0, max(1, len(tokens) - window + 1), step):
            cut = tokens[at : at + step + window - 1]
            if part and size + len(cut) > part_words:
                yield WindowSet(part, window)
                part, size = [], 0
            part.append((item, cut, len(cut) == len(tokens)))
            size += len(cut)
    if part:
        yield WindowSet(part, window)


def _lists(values, kind):
    return pa.array(values, type=pa.list_(kind))


def _report(texts, windows, before=None):
    """Findings of one part of the windows, added to those ``before`` (items, hits)."""
    n_words, n_hit, items, hits = [], [], [], []
    for block in words.blocks(texts, words.NOT_ALNUM):
        hit, owners = windows.scan(block) if windows else (np.zeros(len(block.starts), dtype=bool), [set() for _ in range(len(block))])
        for i in range(len(block)) if before else ():
            owners[i] |= set(before[0][block.first_row + i].as_py())
            lo, hi = block.first[i], block.first[i + 1]
            for h in before[1][block.first_row + i].as_py():
                a, b = h["start"] + block.bounds[i], h["end"] + block.bounds[i]
                hit[lo + np.searchsorted(block.starts[lo:hi], a) : lo + np.searchsorted(block.ends[lo:hi], b, side="right")] = True
        for i in range(len(block)):
            lo, hi = block.first[i], block.first[i + 1]
            inside = hit[lo:hi]
            n_words.append(hi - lo)
            n_hit.append(int(inside.sum()))
            items.append(sorted(owners[i]))
            ranges = []
            if n_hit[-1]:
                edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
                for a, b in zip(np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) + lo - 1):
                    ranges.append({"start": int(block.starts[a] - block.bounds[i]), "end": int(block.ends[b] - block.bounds[i])})
            hits.append(ranges)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), _lists(items, pa.string()), _lists(hits, span)]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """(row, n_words, n_hit, items, hits) for each row of ``docs`` (needs ``text``).

    ``hits`` are UTF-8 byte ranges of the text, ``items`` the ids found.
    """
    context, tmp = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "decontaminate")
    found = sent = None
    for number, part in enumerate(_parts(benchmark, window, part_words)):
        if found is not None:
            found = tmp.write(found, f"part-{number}")
            sent.unpersist()
            tmp.drop(f"part-{number - 1}")
        sent = context.broadcast(vars(part))
        found = _first(docs, sent) if found is None else _next(found, sent)
    return found if found is not None else with_report(docs, "text", lambda texts: _report(texts, None), FIELDS)


def _first(docs, sent):
    return with_report(docs, "text", lambda texts: _report(texts, WindowSet.of(sent.value)), FIELDS)


def _next(found: DataFrame, sent) -> DataFrame:
    """The findings so far with those of one more part."""
    names = found.columns

    def run(batches):
        windows = WindowSet.of(sent.value)
        for batch in batches:
            if batch.num_rows:
                more = _report(batch.column(1), windows, (batch.column(2), batch.column(3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=names)

    return found.select("row", F.col("row.text").cast("string").alias("text"), "items", "hits").mapInArrow(run, found.schema)


def contaminated(found: DataFrame):
    """The rule: some hit, and at least a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    found = scan(docs, benchmark, window)
    return found.filter(~contaminated(found)).select("row.*")


def drop_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every hit passage cut out of ``text``; rows without hits keep theirs."""
    found = scan(docs, benchmark, window)
    raw = F.encode(F.col("row.text"), "UTF-8")
    kept = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("at"), F.encode(F.lit(""), "UTF-8").alias("out")),
        lambda s, h: F.struct(
            h["end"].alias("at"),
            F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), (h["start"] - s["at"]).cast("int"))).alias("out"),
        ),
    )
    text = F.concat(kept["out"], F.substring(raw, (kept["at"] + 1).cast("int"), F.octet_length(raw)))
    cut = F.when(F.size("hits") > 0, F.decode(text, "UTF-8")).otherwise(F.col("row.text"))
    return found.withColumn("cut", cut).select(
        *[F.col("cut").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )

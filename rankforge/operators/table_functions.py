"""Chunkers as table functions: ``SELECT * FROM chunk(TABLE(pages) PARTITION BY file ORDER BY page)``.

The function learns its output from its input: every column but the text comes
back beside ``chunk_index`` and ``text``. Rows of a partition come in order, so
chunk numbers run through the pages of a file; only that number is kept between
pages, however many a file has. A page whose splitter fails is one whole chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

Splitter = Callable[[str], list[str]]


def pack_sentences(size: int, end: str = r"(?<=[.?!])\s+") -> Splitter:
    """Sentences joined by a space while they fit into ``size``."""
    cut = re.compile(end)

    def split(text):
        out, cur = [], ""
        for sentence in filter(None, map(str.strip, cut.split(text))):
            if len(cur) + len(sentence) + 1 <= size:
                cur = f"{cur} {sentence}" if cur else sentence
            else:
                out += [cur] if cur else []
                cur = sentence
        return out + ([cur] if cur else [])

    return split


def register_chunker(spark: SparkSession, name: str, split: Splitter, text: str = "text", min_len: int = 30) -> None:
    """Make ``split`` a table function; ``text`` names the column it cuts."""

    class Chunker:
        def __init__(self):
            self.next = 0

        @staticmethod
        def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable:
                raise ValueError("chunk takes a TABLE argument")
            kept = [f for f in pages.dataType.fields if f.name != text]
            if len(kept) == len(pages.dataType.fields):
                raise ValueError(f"the table has no column {text}")
            made = [T.StructField("chunk_index", T.LongType()), T.StructField("chunk", T.StringType())]
            return AnalyzeResult(schema=T.StructType([*kept, *made]))

        def eval(self, pages: T.Row):
            page = pages.asDict()
            body = page.pop(text)
            if body is None:
                return
            try:
                pieces = split(body)
            except Exception:  # whatever a splitter raises leaves the page whole
                pieces = [body]
            for piece in pieces:
                piece = piece.strip()
                if len(piece) >= min_len:
                    yield (*page.values(), self.next, piece)
                    self.next += 1

    spark.udtf.register(name, udtf(Chunker))

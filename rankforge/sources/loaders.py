"""Files to pages: any extractor of one file's pages, run where the file is read."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.text import strip

PAGE_SCHEMA = "file string, page int, text string, error string"


def load_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*") -> DataFrame:
    """``(file, page, text, error)`` of every file below ``path``; blank pages drop out.

    ``extract`` gets a file's bytes and gives its page texts. A file it cannot
    read yields one row with the error, without page and text.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "content")
    )

    def pages(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    texts = extract(bytes(content))
                except Exception as error:  # whatever a plug-in raises is a row, not the job's end
                    rows.append((file, None, None, f"{type(error).__name__}: {error}"))
                    continue
                rows += [(file, n, t.strip(), None) for n, t in enumerate(texts, 1) if t and t.strip()]
            yield pd.DataFrame(rows, columns=["file", "page", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(pages, PAGE_SCHEMA)


def pdf_extractor(library: str = "pymupdf") -> Callable[[bytes], list[str]]:
    """Page texts of a PDF by whichever library is installed on the workers."""

    def with_pymupdf(data):
        import pymupdf

        return [page.get_text() for page in pymupdf.open(stream=data, filetype="pdf")]

    def with_pypdf(data):
        import io

        import pypdf

        return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages]

    def with_pdfplumber(data):
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]

    return {"pymupdf": with_pymupdf, "pypdf": with_pypdf, "pdfplumber": with_pdfplumber}[library]


def split_pages(texts: DataFrame, separator: str, keep) -> DataFrame:
    """Whole-file texts cut into numbered pages at a separator."""
    pieces = texts.select(*keep, F.posexplode(F.split("text", separator)).alias("at", "piece"))
    return pieces.select(*keep, (F.col("at") + 1).alias("page"), strip(F.col("piece")).alias("text")).where("text <> ''")


def file_stem(path):
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def rename_files(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace file names by their aliases ``(alias, file)``; others stay."""
    return pages.join(aliases.withColumnRenamed("alias", "renamed"), "file", "left").withColumn(
        "file", F.coalesce("renamed", "file")
    ).drop("renamed")

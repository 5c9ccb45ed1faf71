"""Readers for the record files of an evaluation: JSON, JSONL, score caches, tables."""

from __future__ import annotations

import re
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.text import strip

# errors that say there is no readable table: no path, no files, no footer
NO_TABLE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER"}

# File names that are never results, and the score cache format.
SKIPPED_FILES = r"dryrun|damaged|before_rebuild|\.bak|_retry|registry"
SCORE_FILE = r"^(.*)_(q\d+)_([a-z]+)\.txt$"


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that each hold one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """One record per line, blank lines skipped; ``tolerant`` also skips bad lines."""
    mode = "PERMISSIVE" if tolerant else "FAILFAST"
    bad = "_bad_line"
    lines = spark.read.text(path).where(strip(F.col("value")) != "")
    record = F.from_json("value", f"{schema}, {bad} string", {"mode": mode, "columnNameOfCorruptRecord": bad})
    parsed = lines.select(record.alias("r")).select("r.*")
    return parsed.where(F.col(bad).isNull()).drop(bad) if tolerant else parsed.drop(bad)


def with_file_key(df: DataFrame, pattern: str = r"^(.*?)(\.[^.]*)?$", name: str = "key") -> DataFrame:
    """Adds the part of the file name that a pattern picks; skips non-result files."""
    file = F.col("_metadata.file_name")
    return df.where(~file.rlike(SKIPPED_FILES)).withColumn(name, F.regexp_extract(file, pattern, 1))


def json_directory(spark: SparkSession, path: str, schema: str, prefixes=None) -> DataFrame:
    """All JSON array files of a folder, keyed by file name without suffix.

    With ``prefixes`` only files whose name begins with one of them count.
    """
    rows = json_array(spark, path, schema)
    if prefixes is not None:
        # a condition on the file name alone: Spark leaves such files out when it plans the scan
        rows = rows.where(F.col("_metadata.file_name").rlike("^(" + "|".join(map(re.escape, prefixes)) + ")"))
    return with_file_key(rows)


def score_cache(spark: SparkSession, path: str) -> DataFrame:
    """``(config, qid, metric, score)`` from one tiny text file per score."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    part = lambda i: F.regexp_extract("file", SCORE_FILE, i)
    return files.where(F.col("file").rlike(SCORE_FILE)).select(
        part(1).alias("config"), part(2).alias("qid"), part(3).alias("metric"), F.trim("value").try_cast("int").alias("score")
    )


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or ``None`` with a warning when it is missing or its footer is unreadable."""
    try:
        return spark.read.parquet(path)
    except PySparkException as error:
        why = (error.getCondition() or "").split(".")[0]
        if why not in NO_TABLE:
            raise
    except Py4JJavaError as error:
        # the footer is read by a job, whose failure names the cause
        why = "CANNOT_READ_FILE_FOOTER"
        if why not in str(error):
            raise
    warnings.warn(f"no table at {path}: {why}", stacklevel=2)
    return None


def settings(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value)`` lines of an environment file."""
    line = F.trim("value")
    at = F.instr(line, "=")
    return (
        spark.read.text(path)
        .where((line != "") & ~line.startswith("#") & (at > 1))
        .select(F.trim(F.substring(line, F.lit(1), at - 1)).alias("key"), F.trim(F.substring(line, at + 1, F.length(line))).alias("value"))
    )

"""Sinks: whole tables replaced, appended or rendered."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.operators.votes import placed
from rankforge.session import materialize


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones; readers follow the newest marker.

    A version becomes visible only when its job has committed, so a lost
    executor or driver leaves the previous version in place.
    """
    version = f"{path}/version={uuid.uuid1().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    marker = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(version).alias("version"))
    marker.write.mode("append").parquet(f"{path}/versions")
    return version


def current_table(spark, path: str) -> DataFrame:
    newest = spark.read.parquet(f"{path}/versions").agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    return spark.read.parquet(newest)


def write_both(df: DataFrame, path: str) -> None:
    """Parquet and CSV copies of a table, replacing earlier ones."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    flat_csv(df).write.mode("overwrite").csv(f"{path}/csv", header=True)


def flat_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, NULL as the empty string."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]
    return df.select(*cols).na.fill("")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_requests(df: DataFrame, line: str, path: str, shard_rows: int = 5000) -> None:
    """Request lines as text files of at most ``shard_rows`` lines."""
    df.select(line).write.mode("overwrite").option("maxRecordsPerFile", shard_rows).text(path)


def write_named(df: DataFrame, path: str) -> None:
    """One text file per ``name`` from its ``value``; a name may hold folders.

    Tasks write hidden part files; the driver gives them their names once all
    are there, so an aborted job leaves no named file.
    """
    hidden = f"{path}/_parts-{uuid.uuid4().hex}"
    df.select("name", "value").repartition("name").write.partitionBy("name").text(hidden)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(hidden).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(at(hidden)):
        if folder.isDirectory():
            name = unquote(folder.getPath().getName().removeprefix("name="))
            part = next(f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            target = at(f"{path}/{name}")
            files.mkdirs(target.getParent())
            files.rename(part, target)
    files.delete(at(hidden), True)


def write_shards(df: DataFrame, line: str, path: str, *order: str, size: int = 5000) -> None:
    """Lines in the given order as numbered shards of ``size`` lines, and a manifest.

    Shards are filled across tasks, so only the last may be short. They get
    their names after all are written, the manifest after them: without it
    there is no request, whatever an aborted job has left.
    """
    by = [F.col(c) for c in order]
    rows = placed(df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(line).alias("value")))
    shard = F.floor((F.col("place") - 1) / size)
    rows = materialize(rows.select(F.format_string("shard-%05d.jsonl", shard).alias("name"), "value"))
    write_named(rows, path)
    # rows of a shard that are in any order have the same sum
    listed = rows.groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.crc32(F.encode("value", "UTF-8"))).alias("check"))
    write_named(listed.select(F.lit("manifest.json").alias("name"), F.to_json(F.struct("name", "lines", "check")).alias("value")), path)


def read_shards(spark, path: str) -> DataFrame:
    """``(name, value)`` lines of the shards that the manifest lists; raises where one is not whole."""
    listed = spark.read.schema("name string, lines bigint, check bigint").json(f"{path}/manifest.json")
    lines = spark.read.option("pathGlobFilter", "shard-*.jsonl").text(path).select(F.col("_metadata.file_name").alias("name"), "value")
    found = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(F.encode("value", "UTF-8"))).alias("sum"))
    bad = listed.join(found, "name", "left").where(~F.coalesce((F.col("n") == F.col("lines")) & (F.col("sum") == F.col("check")), F.lit(False)))
    broken = [r["name"] for r in bad.select("name").limit(5).collect()]
    if broken:
        raise ValueError(f"shards that are not whole: {broken}")
    return lines.join(F.broadcast(listed.select("name")), "name", "left_semi")


def markdown_lines(df: DataFrame, *order: str) -> DataFrame:
    """``(line, text)`` of a report table in the given order, of any length."""
    kinds = dict(df.dtypes)
    shown = [
        F.coalesce(F.format_string("%.4f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
        for c in df.columns
    ]
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = [bar([F.lit(c) for c in df.columns]), bar([F.lit("---")] * len(df.columns))]
    top = df.sparkSession.range(1).select(F.posexplode(F.array(*head)).alias("line", "text"))
    first = top.select((F.col("line") + 1).cast("bigint").alias("line"), "text")
    rows = placed(df.repartitionByRange(*order).sortWithinPartitions(*order).select(bar(shown).alias("text")))
    return first.unionByName(rows.select((F.col("place") + 2).alias("line"), "text"))


def markdown_table(df: DataFrame, *order: str) -> str:
    """The report table as one text, read line by line."""
    lines = markdown_lines(df, *(order or df.columns)).orderBy("line").select("text")
    return "".join(row["text"] + "\n" for row in lines.toLocalIterator())

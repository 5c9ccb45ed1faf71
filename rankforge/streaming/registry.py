"""Incremental state: latest status per batch and boards kept up to date.

Sources are files that arrive; each trigger takes what is new. State lives in
the query's checkpoint and every micro-batch writes its own folder, so a batch
that runs again after a loss replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States that end a batch.
TERMINAL = ("completed", "failed", "expired", "cancelled", "error", "skipped")


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def arriving(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def latest_by_key(log: DataFrame, key: str, at: str, *values: str, tie: str | None = None) -> DataFrame:
    """Streaming aggregate: the values of each key's newest row, equal times by ``tie``."""
    order = F.struct(at, tie) if tie else F.col(at)
    return log.groupBy(key).agg(F.max_by(F.struct(at, *values), order).alias("r")).select(key, "r.*")


def upsert(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Run what is there; changed keys of a batch go to that batch's folder."""

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    running = query.trigger(availableNow=True).start()
    running.awaitTermination()


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest row of each key over all batches."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def append(stream: DataFrame, path: str, checkpoint: str, **conf):
    """Append-only result log; the checkpoint remembers what is done.

    ``conf`` holds for this query alone, which reads it when it starts.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pending(registry: DataFrame, status: str = "status") -> DataFrame:
    """Keys to ask about again."""
    return registry.where(~is_terminal(F.col(status)))

"""Session helpers: builder, shared folder, size-checked broadcast."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_CONF, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def build_session(app="rankforge", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is local, as in
    tests, a folder below Spark's warehouse is used and noted in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name its shared folder in spark.checkpoint.dir")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/rankforge/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    That cuts the lineage, survives a lost executor, and tells the planner
    how large the table is.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*calls):
    """Results of calls that start jobs of their own, run at the same time: one's small stages leave cores to the others."""
    if len(calls) < 2:
        return [call() for call in calls]
    spark = SparkSession.getActiveSession()
    inheriting = inheritable_thread_target(spark) if spark else inheritable_thread_target
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(inheriting(call)) for call in calls]]


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint when a row count proves the side small, else ``df`` as is.

    Without the hint Spark plans a shuffled join, which adaptive execution may
    still turn into a broadcast or split on skew.
    """
    return F.broadcast(df) if has_at_most(df, rows) else df


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows, which the session keeps.

    Lists of words make wide rows; without this a Python worker holds ever more of
    them, up to 10,000, as a table's partitions grow.
    """
    rows = int(spark.conf.get(ARROW_CONF))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set(ARROW_CONF, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that few tasks would read, dealt to all cores by ``key``.

    For a costly expression over one small file. A file has more splits than
    row groups, so rows are counted by task, without reading them. A table whose
    tasks have at most twice an even share is returned as it is: its scan is
    spread already, and a shuffle would only add to it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores == 1:
        return df
    each = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    held = each.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    return df.repartition(cores, key) if (held["most"] or 0) * cores > 2 * (held["total"] or 0) else df

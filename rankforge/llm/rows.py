"""Passing whole input rows through an Arrow operator beside its findings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_report(docs: DataFrame, text: str, report, fields: str) -> DataFrame:
    """(row, <fields>): each input row packed into ``row``, with its text's report.

    ``report(texts)`` takes one Arrow string column and returns the columns of
    ``fields`` in order. Packing keeps extra columns with any names apart from
    the findings.
    """
    found = T._parse_datatype_string(fields) if isinstance(fields, str) else fields
    schema = T.StructType([T.StructField("row", docs.schema), *found.fields])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *report(batch.column(1))], names=names)

    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text")
    )
    return packed.mapInArrow(run, schema)


def unpack(df: DataFrame) -> DataFrame:
    return df.select("row.*")

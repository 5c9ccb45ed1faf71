"""Times of re-polling are counted in milliseconds as the SQL counts them."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from rankforge.plans import ORACLE, QUERIES
from rankforge.plans.incremental import to_millis
from tests.test_oracles import compare

HALVES = ["1969-12-31 23:59:59.9995", "1969-12-31 23:59:59.9984", "2024-01-01 00:00:07.179575", "2024-01-01 00:00:07.1795", "2024-01-01 00:00:07.179499"]


def test_millis_are_rounded_like_epoch_ms(spark):
    con = duckdb.connect()
    expected = [con.sql(f"select epoch_ms('{x}'::timestamp)").fetchall()[0][0] for x in HALVES]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(HALVES)], "i int, x string")
    found = rows.select("i", F.unix_millis(to_millis(F.col("x").cast("timestamp"))).alias("ms")).orderBy("i").collect()
    assert [r["ms"] for r in found] == expected


def test_repolling_of_reports_between_milliseconds(spark, tmp_path):
    start = pd.Timestamp("2024-01-01 00:00:07.179575")
    ends = pd.Timestamp("2024-01-02 06:00:07.181700")
    rows = [(1, start, 7, "click"), (2, start + pd.Timedelta("1ms"), 8, "view"), (3, start + pd.Timedelta("7h"), 7, "purchase"), (4, ends, 9, "click")]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"]).astype({"ts": "datetime64[us]"})
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    rel = con.sql(ORACLE["stream_repolling"])
    df = QUERIES["stream_repolling"](spark, str(tmp_path))
    assert compare(df.columns, [tuple(r) for r in df.collect()], rel.columns, rel.fetchall()) is None

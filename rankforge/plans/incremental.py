"""Registry and board kept by streaming queries over ``events``."""

from pyspark.sql import functions as F

from rankforge.plans.registry import query
from rankforge.session import scratch_path, table
from rankforge.streaming import registry as R
from rankforge.streaming.polling import ROCKS, polls

STATUS = {"click": "submitted", "view": "running", "purchase": "completed", "error": "failed", "signup": "expired"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


FILES = 4


def log(spark, sf_dir, path):
    """``events`` arriving as several files, one a micro-batch; a later run finds the same files."""
    events = table(spark, sf_dir, "events")
    arrived = f"{path}/arrived"
    events.repartitionByRange(FILES, "event_id").write.mode("ignore").parquet(arrived)
    return R.arriving(spark, arrived, events.schema, files_per_batch=1)


def status():
    out = F
    for kind, name in STATUS.items():
        out = out.when(F.col("event_type") == kind, name)
    return out


@query(
    "stream_registry_latest",
    f"""SELECT user_id, status, status IN ('completed', 'failed', 'expired') AS terminal FROM (
      SELECT user_id, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""",
)
def stream_registry_latest(spark, sf_dir):
    """Latest status of every batch, kept by a streaming upsert."""
    path = scratch_path(spark, "registry-stream")
    stream = log(spark, sf_dir, path).select("user_id", "ts", "event_id", status().alias("status"))
    R.upsert(R.latest_by_key(stream, "user_id", "ts", "status", tie="event_id"), f"{path}/table", f"{path}/checkpoint")
    now = R.current(spark, f"{path}/table", "user_id")
    return now.select("user_id", "status", R.is_terminal(F.col("status")).alias("terminal"))


@query(
    "stream_leaderboard",
    """SELECT cand, count(*) AS n, count(*) FILTER (WHERE score >= 4)::DOUBLE / count(*) AS accuracy
    FROM (SELECT user_id % 12 AS cand, 1 + (event_id * 7) % 5 AS score FROM events) GROUP BY cand""",
)
def stream_leaderboard(spark, sf_dir):
    """A board recomputed after every batch."""
    path = scratch_path(spark, "board-stream")
    board = (
        log(spark, sf_dir, path)
        .select((F.col("user_id") % 12).alias("cand"), (1 + (F.col("event_id") * 7) % 5).alias("score"))
        .groupBy("cand")
        .agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("score") >= 4) / F.count(F.lit(1))).alias("accuracy"))
    )
    R.upsert(board, f"{path}/table", f"{path}/checkpoint", "complete")
    return R.current(spark, f"{path}/table", "cand")


@query("stream_append_log", "SELECT event_id, event_type = 'error' AS failed FROM events")
def stream_append_log(spark, sf_dir):
    """Results appended once per item, failures as rows of their own; a second run adds nothing."""
    path = scratch_path(spark, "log-stream")
    for _ in range(2):
        rows = log(spark, sf_dir, path).select("event_id", (F.col("event_type") == "error").alias("failed"))
        R.append(rows, f"{path}/table", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/table")


# How long an open batch waits for the next question, and how long it lives.
POLL_EVERY, POLL_LIMIT = "6 hours", "48 hours"


def to_millis(ts):
    """A time to the nearest millisecond, halves away from 1970, as ``epoch_ms`` counts it."""
    us = F.unix_micros(ts)
    up = F.abs(us) + 500
    return F.timestamp_millis((F.signum(us) * ((up - up % 1000) / 1000)).cast("bigint"))


@query(
    "stream_repolling",
    f"""WITH r AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, {STATUS_SQL} AS status FROM events),
    w AS (SELECT max(ms) AS now FROM r),
    ends AS (SELECT user_id, min(ms) AS opened, min(ms) FILTER (WHERE status IN ('completed', 'failed', 'expired')) AS done FROM r GROUP BY user_id),
    life AS (SELECT *, opened + 172800000 AS deadline, least(coalesce(done, now), opened + 172800000, now) AS until FROM ends, w),
    live AS (SELECT r.*, life.*, lead(r.ms) OVER o AS nxt FROM r JOIN life USING (user_id)
      WHERE r.ms <= deadline AND (done IS NULL OR r.ms <= done) WINDOW o AS (PARTITION BY user_id ORDER BY ms, event_id)),
    due AS (SELECT user_id, unnest(range(ms + 21600000, least(coalesce(nxt, now), deadline, now), 21600000)) AS poll FROM live
      WHERE status NOT IN ('completed', 'failed', 'expired')),
    p AS (SELECT user_id, count(*) AS polls, max(poll) AS last_poll FROM due GROUP BY user_id),
    s AS (SELECT user_id, arg_max(status, (ms, event_id)) FILTER (WHERE done IS NULL OR ms <= done) AS status FROM live GROUP BY user_id)
    SELECT user_id, CASE WHEN (done IS NULL OR done > deadline) AND deadline < now THEN 'expired' ELSE s.status END AS status,
      coalesce(polls, 0) AS polls, last_poll FROM life JOIN s USING (user_id) LEFT JOIN p USING (user_id)""",
)
def stream_repolling(spark, sf_dir):
    """Open batches asked again every six hours until done or two days old; stopped and restarted half-way."""
    path = scratch_path(spark, "polling-stream")
    # rounded before the reports are dealt to files: equal times stay in one micro-batch
    at = to_millis(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("user_id", at.alias("ts"), "event_id", status().alias("status"))
    borders = events.select(F.percentile_approx("ts", F.array(*[F.lit(i / FILES) for i in range(1, FILES)]), 10_000)).first()[0]
    part = F.lit(0)
    for b in borders:
        part = part + (F.col("ts") > F.lit(b)).cast("int")
    arrived = f"{path}/arrived"
    for run in range(2):
        # reports come in order of time; the second run starts from the first one's checkpoint
        for i in range(run * FILES // 2, (run + 1) * FILES // 2):
            events.where(part == i).coalesce(1).write.mode("append").parquet(arrived)
        stream = R.arriving(spark, arrived, events.schema, files_per_batch=1)
        asked = polls(stream, "user_id", "ts", "status", "event_id", POLL_EVERY, POLL_LIMIT)
        R.append(asked, f"{path}/table", f"{path}/checkpoint", **{"spark.sql.streaming.stateStore.providerClass": ROCKS})
    log_rows = spark.read.parquet(f"{path}/table")
    polled = F.col("kind") == "poll"
    return log_rows.groupBy(F.col("key").alias("user_id")).agg(
        F.max_by("status", F.struct("at", F.when(F.col("kind") == "ended", 2).when(polled, 1).otherwise(0))).alias("status"),
        F.count_if(polled).alias("polls"),
        F.max(F.when(polled, F.col("at"))).alias("last_poll"),
    )

"""Structured Streaming: windows, sessions, alerts, deduplication and review state over the stream of events.

Each stream reads what there is (trigger availableNow) and writes to a folder of the shared checkpoint path, from which
its result is read; a user who wants an endless stream calls the function that takes and gives a streaming DataFrame.
Results are written by foreachBatch as a folder for each batch, so a batch that is run again after a failure
overwrites only itself. Windows run in update mode and are merged by key, sessions in append mode: a session is given
once, when the watermark has passed its end, and what comes later than that is dropped.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: How late an event may come; sessions end and repeated questions are forgotten after these times.
LATE, IDLE, REPEAT = "1 hour", "30 minutes", "300 seconds"
#: How long after its last decision a review is kept, and what is given of it.
KEEP = dt.timedelta(days=30)
REVIEW = "user_id long, state string, us long, ended boolean"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events; the pattern serves a table that is one file as well as one that is a folder."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def error_windows(stream: DataFrame) -> DataFrame:
    """Errors in each hour: hour_start, n_errors."""
    w = stream.where("event_type = 'error'").withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"))
    return w.agg(F.count("*").alias("n_errors")).select(F.col("window.start").alias("hour_start"), "n_errors")


def latency_windows(stream: DataFrame) -> DataFrame:
    """Mean latency of each day, moved by six hours: window_start, n, mean_ms."""
    w = stream.withWatermark("ts", LATE).groupBy(F.window("ts", "24 hours", "6 hours"))
    return w.agg(F.count("*").alias("n"), F.round(F.avg(F.col("value") * 10), 2).alias("mean_ms")).select(F.col("window.start").alias("window_start"), "n", "mean_ms")


def user_sessions(stream: DataFrame) -> DataFrame:
    """Runs of events of a user without a pause of IDLE: user_id, first_ts, last_ts, n."""
    w = stream.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", IDLE))
    return w.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "last_ts", "n")


def slow_alerts(stream: DataFrame) -> DataFrame:
    """Events slower than a limit: event_id, total_ms."""
    return stream.where("value * 10 > 500").select("event_id", (F.col("value") * 10).alias("total_ms"))


def deduped(stream: DataFrame) -> DataFrame:
    """The first event of each user and kind within REPEAT: event_id, user_id, event_type, ts."""
    return stream.select("event_id", "user_id", "event_type", "ts").withWatermark("ts", REPEAT).dropDuplicatesWithinWatermark(["user_id", "event_type"])


class Reviews(StatefulProcessor):
    """Of each key the latest decision: its time, event and state. A timer, set anew by each later decision, ends the review and forgets it."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us long, event_id long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        had = self.latest.get() if self.latest.exists() else None
        best = had
        for r in rows:
            decision = (r.us, r.event_id, r.event_type)
            if r.us // 1000 >= passed and (best is None or decision[:2] > tuple(best)[:2]):  # late ones may be of a review that has ended
                best = decision
        if best is not had:
            if had is not None:
                self.handle.deleteTimer(had[0] // 1000 + self.keep_ms)
            self.handle.registerTimer(best[0] // 1000 + self.keep_ms)
            self.latest.update(tuple(best))
            yield Row(user_id=key[0], state=best[2], us=best[0], ended=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.latest.exists():
            us, _, state = self.latest.get()
            self.latest.clear()
            yield Row(user_id=key[0], state=state, us=us, ended=True)


def review_state(stream: DataFrame, keep: dt.timedelta = KEEP) -> DataFrame:
    """user_id, state, decided_at, ended: the latest decision of each user by time and event, each time that it changes, and once more when the review ends.

    A review ends when the watermark, LATE behind the latest event, has passed its last decision by keep; it is then
    forgotten, so that the state holds the users of that time only. Decisions behind the watermark are dropped, repeated
    ones change nothing; a user who decides again later has a new review.
    """
    rows = stream.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "event_type").withWatermark("ts", LATE).groupBy("user_id")
    out = rows.transformWithState(Reviews(int(keep.total_seconds() * 1000)), REVIEW, "Update", "EventTime")
    return out.select("user_id", "state", F.timestamp_micros("us").alias("decided_at"), "ended")


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile keep their state in RocksDB, as timers need it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only in local mode without one a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparkquill-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def drain(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what there is and gives its rows. With keys it runs in update mode, and of the rows of a key the last batch's is taken; without in append mode."""
    spark = stream.sparkSession
    base, written = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        written.append(path)

    with state_in_rocksdb(spark):
        stream.writeStream.outputMode("update" if keys else "append").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.option("basePath", f"{base}/rows").schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(*sorted(set(written)))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*") if keys else rows.drop("batch")


def registered(name: str, operator, keys: list[str] | None):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = drain(operator(events(spark, sf_dir)), name, keys).drop("ended")
        # as in the table: without a time zone
        return out.select(*(F.col(f.name).cast("timestamp_ntz") if f.dataType.typeName() == "timestamp" else f.name for f in out.schema))

    return query


QUERIES = {
    name: registered(name, f, keys)
    for name, f, keys in (
        ("stream_error_window", error_windows, ["hour_start"]),
        ("stream_latency_window", latency_windows, ["window_start"]),
        ("stream_user_sessions", user_sessions, None),
        ("stream_slow_alerts", slow_alerts, None),
        ("stream_query_dedupe", deduped, None),
        ("stream_review_state", review_state, ["user_id"]),
    )
}

SQL = {
    "stream_error_window": "select date_trunc('hour', ts) as hour_start, count(*) as n_errors from events where event_type = 'error' group by date_trunc('hour', ts)",
    "stream_latency_window": """
select w as window_start, count(*) as n, round(avg(value * 10), 2) as mean_ms from (select value, unnest([time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - to_hours(6 * i) for i in [0, 1, 2, 3]]) as w from events) x group by w""",
    "stream_user_sessions": """
with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval '30' minute then 1 else 0 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as no from g)
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from s group by user_id, no having max(ts) + interval '90' minute <= (select max(ts) from events)""",
    "stream_slow_alerts": "select event_id, value * 10 as total_ms from events where value * 10 > 500",
    "stream_review_state": "select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) as state, max(ts) as decided_at from events group by user_id",
}

"""Streams over several batches: late rows, sessions that close, repeats, the latest decision, an index that is kept in step."""

import datetime as dt

import pytest

from sparkquill.operators import maintenance
from sparkquill.streaming import streams

DDL = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    """A function from batches of (id, minute, user, type) to a stream that reads one batch after the other."""

    def make(*batches):
        for i, rows in enumerate(batches):
            data = [(e, at(m), u, t, 1.0, "{}") for e, m, u, t in rows]
            spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
            for f in (tmp_path / "events").glob("part-*.parquet"):
                if not f.name.startswith("part-b"):
                    f.rename(f.with_name(f"part-b{i}.parquet"))
            (tmp_path / "events" / f"part-b{i}.parquet").touch()
        return spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))

    return make


def test_late_errors_are_dropped_by_the_watermark(stream):
    # a batch's late rows are judged by the watermark of the batch before it
    s = stream([(1, 10, 1, "error"), (2, 20, 1, "error")], [(3, 400, 1, "error")], [(6, 405, 1, "error")], [(4, 30, 1, "error"), (5, 410, 1, "error")])
    got = {(r.hour_start, r.n_errors) for r in streams.drain(streams.error_windows(s), "errors", ["hour_start"]).collect()}
    assert got == {(at(0), 2), (at(360), 3)}


def test_sessions_are_given_once_they_are_closed(stream):
    s = stream([(1, 0, 1, "view"), (2, 20, 1, "view")], [(3, 45, 1, "view"), (4, 100, 1, "view")], [(5, 500, 2, "view")])
    got = sorted((r.user_id, r.first_ts, r.last_ts, r.n) for r in streams.drain(streams.user_sessions(s), "sessions").collect())
    assert got == [(1, at(0), at(45), 3), (1, at(100), at(100), 1)]  # the last one may still grow


def test_repeats_within_the_time_are_dropped(stream):
    # what was seen is forgotten once the watermark has passed it by the time, so the third batch only lets time go by
    s = stream([(1, 0, 1, "view"), (2, 2, 1, "view"), (3, 2, 1, "click"), (4, 2, 2, "view")], [(5, 4, 1, "view"), (9, 60, 3, "view")], [(10, 61, 3, "click")], [(6, 61, 1, "click"), (7, 61, 2, "error"), (8, 62, 1, "view")])
    got = {r.event_id for r in streams.drain(streams.deduped(s), "repeats").collect()}
    assert {3, 4, 6, 7, 8, 9, 10} <= got and len(got & {1, 2}) == 1 and 5 not in got


def reviews(stream, *batches, keep=60):
    out = streams.review_state(stream(*batches), dt.timedelta(minutes=keep))
    return {(r.user_id, r.state, r.decided_at, r.ended) for r in streams.drain(out, "reviews", ["user_id"]).collect()}


def test_the_latest_decision_wins_over_batches(stream):
    # an earlier and a repeated decision of later batches change nothing; of one time the larger event counts
    got = reviews(stream, [(1, 0, 1, "view"), (2, 5, 2, "view")], [(3, 9, 1, "error"), (4, 9, 1, "click")], [(5, 3, 1, "click"), (4, 9, 1, "click")])
    assert got == {(1, "click", at(9), False), (2, "view", at(5), False)}


def test_a_review_ends_after_its_time_and_late_decisions_are_dropped(stream):
    # user 3 moves the watermark an hour behind 300, so users 1 and 2 end; what user 1 decides at 12 is late, what user 2 decides at 290 opens a new review
    got = reviews(stream, [(1, 10, 1, "view"), (2, 20, 2, "view")], [(3, 300, 3, "view")], [(4, 12, 1, "error"), (5, 290, 2, "click")])
    assert got == {(1, "view", at(10), True), (2, "click", at(290), False), (3, "view", at(300), False)}


def test_a_later_decision_moves_the_end(stream):
    got = reviews(stream, [(1, 10, 1, "view")], [(2, 60, 1, "error"), (3, 100, 2, "view")], [(4, 150, 2, "view")], [(5, 151, 2, "view")])
    assert got == {(1, "error", at(60), False), (2, "view", at(151), False)}


def test_the_state_of_reviews_is_bounded(spark, stream, tmp_path):
    """Each batch has new users; those of earlier ones are forgotten."""
    batches = [[(100 * b + i, 200 * b + i, 100 * b + i, "view") for i in range(20)] for b in range(8)]
    out, seen = streams.review_state(stream(*batches), dt.timedelta(minutes=30)), []
    with streams.state_in_rocksdb(spark):
        query = out.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(seen) >= 8 * 20 + 6 * 20 and max(rows) <= 3 * rows[0]


def test_an_empty_build_is_not_published(spark, tmp_path):
    df, root = spark.createDataFrame([(1,)], "id long"), f"file://{tmp_path}/versions"
    assert not maintenance.publish(df.limit(0), root) and maintenance.current(spark, root, df.schema).count() == 0
    assert maintenance.publish(df, root) and not maintenance.publish(df.limit(0), root)
    assert maintenance.current(spark, root, df.schema).count() == 1

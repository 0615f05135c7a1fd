"""The index of changes: versions, removals, replays, compaction, and what a batch writes, against a dictionary."""

import random

import pytest

from sparkquill.operators import maintenance, versioned

DDL = "path string, hash string, version long, deleted boolean"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], "path string, hash string").schema
    return versioned.VersionedTable(spark, f"file://{tmp_path}/index", schema, "path", fan=3, buckets=2)


def put(spark, table, number, *rows):
    table.apply(spark.createDataFrame(list(rows), DDL), number)
    return dict(sorted(map(tuple, table.read().collect())))


def test_of_two_versions_the_higher_counts_in_a_batch_and_over_batches(spark, table):
    assert put(spark, table, 0, ("a", "zz", 1, False), ("a", "aa", 2, None), ("b", "x", 5, False), (None, "x", 1, False)) == {"a": "aa", "b": "x"}
    assert put(spark, table, 1, ("b", "old", 4, False), ("a", "new", 3, False)) == {"a": "new", "b": "x"}
    assert put(spark, table, 2, ("b", "same version", 5, False)) == {"a": "new", "b": "same version"}


def test_removed_sources_leave_and_may_come_back(spark, table):
    put(spark, table, 0, ("a", "1", 1, False), ("b", "1", 1, False))
    assert put(spark, table, 1, ("a", None, 2, True)) == {"b": "1"}
    assert put(spark, table, 2, ("a", "late", 1, False)) == {"b": "1"}  # compacts, and forgets the tombstone
    assert [r.name for r in table.runs()] == ["run-1-0-2"] and table.rows_of(table.runs()).count() == 1
    assert put(spark, table, 3, ("a", "back", 3, False)) == {"a": "back", "b": "1"}


def test_a_replayed_batch_changes_nothing(spark, table):
    rows = [("a", "1", 1, False), ("b", "1", 1, False)]
    put(spark, table, 0, *rows)
    before = put(spark, table, 1, ("a", "2", 2, False))
    assert put(spark, table, 1, ("a", "2", 2, False)) == before and [r.name for r in table.runs()] == ["run-0-0-0", "run-0-1-1"]
    put(spark, table, 2, ("c", "1", 1, False))
    assert put(spark, table, 0, *rows) == {"a": "2", "b": "1", "c": "1"} and [r.name for r in table.runs()] == ["run-1-0-2"]


def test_what_a_lost_writer_left_is_not_read(spark, table, tmp_path):
    put(spark, table, 0, ("a", "1", 1, False))
    table.write(table.rows_of(table.runs()), versioned.Run(1, 1, 0))
    (tmp_path / "index" / "run-0-1-1" / "_SUCCESS").unlink()
    assert [r.name for r in table.runs()] == ["run-0-0-0"]
    assert put(spark, table, 1, ("b", "1", 1, False)) == {"a": "1", "b": "1"}


def test_random_changes_are_those_of_a_dictionary_and_batches_write_what_they_change(spark, table):
    rng, state = random.Random(3), {}
    for number in range(10):
        rows = [(rng.choice("abcdefgh"), f"{number}-{i}", 10 * rng.randint(0, number + 1) + rng.randint(0, 9), rng.random() < 0.3) for i in range(5)]
        rows = list({(r[0], r[2]): r for r in rows}.values())
        for p, h, v, gone in sorted(rows, key=lambda r: r[2]):
            if p not in state or v >= state[p][0]:
                state[p] = (v, h, gone)
        got = put(spark, table, number, *rows)
        live = {p: h for p, (_, h, gone) in state.items() if not gone}
        # a source whose tombstone is forgotten may come back by a version that is older than its removal
        assert {p: h for p, h in got.items() if p in live} == live and all(state[p][2] for p in got.keys() - live.keys())
        for p in got.keys() - live.keys():
            state[p] = (max(v for q, _, v, gone in rows if q == p and not gone), got[p], False)
    assert [r.name for r in table.runs()] == ["run-2-0-8", "run-0-9-9"]
    assert table.rows_of(table.runs()[1:]).count() <= 5


def test_a_stream_of_changes(spark, tmp_path):
    root = f"file://{tmp_path}/sync"
    for rows in ([("a", "1", 1, False), ("b", "1", 1, False)], [("a", "2", 3, False), ("a", "9", 2, False), ("b", None, 2, True), ("c", "1", 1, False)]):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = maintenance.sync_index(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), root)
    assert sorted(map(tuple, out.read().collect())) == [("a", "2"), ("c", "1")] and [r.name for r in out.runs()] == ["run-0-0-0", "run-0-1-1"]

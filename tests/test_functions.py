"""Quantiles when one value is far from the others, and rows in spans of time, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquill.functions.intervals import in_spans
from sparkquill.functions.quantiles import RANGES, nearest_rank, percentile_cont, ranked_values
from sparkquill.operators import closings


@pytest.mark.parametrize("values", [[float(i % 997) + i / 7 for i in range(5000)] + [1e9], [3.0] * 50 + [None], [1.0, 2.0], [-5.5, None, 7.25, 1e12, 7.25]])
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranked_values(df, "v").agg(*(percentile_cont(p) for p in (0.0, 0.5, 0.95, 1.0)), nearest_rank(0.5)).first()
    some = np.array([v for v in values if v is not None])
    assert list(got)[:4] == pytest.approx([np.quantile(some, p) for p in (0.0, 0.5, 0.95, 1.0)])
    assert got[4] == sorted(some)[round((len(some) - 1) * 0.5)]


def test_one_far_value_leaves_the_ranges_even(spark):
    df = spark.range(20_000).select((F.col("id") * 0.01).alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    plan = ranked_values(df, "v")
    bounds = sorted(df.approxQuantile("v", [i / RANGES for i in range(1, RANGES)], 0.001))
    sizes = np.bincount(np.searchsorted(bounds, [r.value for r in plan.select("value").collect()], "right"))
    assert len(sizes) == RANGES and sizes.max() < 5 * 20_000 / RANGES


def test_no_values(spark):
    assert ranked_values(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def at(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_spans_are_those_of_brute_force(spark, bins):
    rng = random.Random(bins)
    rows = [(i, at(rng.randint(0, 3000))) for i in range(400)] + [(900, None), (901, at(0)), (901, at(0))]
    spans = [("gap", at(100), at(200)), ("far", at(-9000), at(-8000)), ("before", at(-50), at(30)), ("whole", at(-1), at(99999)), ("open", at(2000), None), ("none", None, at(5)), ("empty", at(70), at(70)), ("late", at(50_000), None)]
    r, s = spark.createDataFrame(rows, "id long, ts timestamp"), spark.createDataFrame(spans, "name string, s timestamp, e timestamp")
    out = in_spans(r, "ts", s, "s", "e", bins)
    want = sorted((i, n) for i, t in rows for n, lo, hi in spans if t is not None and lo is not None and lo <= t and (hi is None or t < hi))
    assert sorted((x.id, x.name) for x in out.select("id", "name").collect()) == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert in_spans(r.limit(0), "ts", s, "s", "e").count() == 0


def test_closings_take_the_latest_value_of_the_same_period(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, "A", "2024-01", day(1), '{"production":"1.234,50"}'), (1, 2, "A", "2024-02", day(2), '{"production":"9"}'), (2, 1, None, "2024-01", day(1), '{"production":"12,5"}'), (2, 2, None, "2024-01", day(3), '{"production":"2.000,25"}'), (3, 1, "A", "2024-03", day(1), "broken"), (4, 1, "A", "2024-01", day(1), '{"production":"0"}')]
    values = [(1, 1, "A", "production", "2024-02", day(1), "100"), (1, 2, "A", "production", "2024-02", day(5), "1.100,75"), (2, 1, "", "production", "2023-12", day(1), "7"), (4, 1, "A", "other", "2024-01", day(1), "5")]
    r = spark.createDataFrame(rows, "id long, line int, area string, period string, updated_at timestamp, json string")
    v = spark.createDataFrame(values, "id long, line int, area string, field string, period string, updated_at timestamp, value_text string")
    found = closings.closing_values(r, v, "production")
    assert {(x.id, x.area): x.value and float(x.value) for x in found.collect()} == {(1, "A"): 1100.75, (2, ""): 2000.25, (3, "A"): None, (4, "A"): 0.0}
    got = {x.area: (x.n, x.total, x["mean"], x.largest, x.mean_of_top) for x in closings.closing_aggregate(found).collect()}
    assert got == {"A": (3, 1100.75, 550.38, 1100.75, 1100.75), "": (1, 2000.25, 2000.25, 2000.25, 2000.25)}

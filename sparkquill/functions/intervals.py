"""Rows and the spans of time that contain them, by an equi-join on bins of time instead of comparing each with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins that the time from the first row to the last is cut into.
BINS = 4096


def in_spans(rows: DataFrame, time: str, spans: DataFrame, start: str, end: str, bins: int = BINS) -> DataFrame:
    """rows with the columns of each span that contains their time: start inclusive, end exclusive, a null end open. Null times and starts are in none.

    A span is listed in the bins that it touches, so spans that do not overlap are bins + spans rows in
    all, however long they are; a bin with many rows is a skewed key of an ordinary join.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lo, hi = rows.agg(F.min(micros(time)), F.max(micros(time))).first()
    if lo is None:
        return rows.join(spans, F.lit(False))
    width = max((hi - lo) // bins, 1)
    place = lambda c: F.floor((c - lo) / width)
    last = F.least(F.coalesce(micros(end), F.lit(hi)), F.lit(hi))
    listed = spans.where((micros(start) <= hi) & (last >= lo)).withColumn("__bin", F.explode(F.sequence(place(F.greatest(micros(start), F.lit(lo))), place(last))))
    both = rows.withColumn("__bin", place(micros(time))).join(listed, "__bin")
    return both.where((F.col(time) >= F.col(start)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))).drop("__bin")

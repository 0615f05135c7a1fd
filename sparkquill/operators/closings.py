"""Monthly closings: the latest row of each work and area, the latest normalised values, and aggregates over both; and metrics of the periods between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.intervals import in_spans
from ..sources import views


def parsed(text: Column) -> Column:
    """A number as text: '1.234,50' and '1234.50' are the same; null if it is none."""
    return F.when(F.contains(text, F.lit(",")), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(text).try_cast("decimal(18,2)")


def latest(rows: DataFrame, content: str, *keys: str) -> DataFrame:
    """The row of the last period, update and line of each key, of those the one with the last content; null areas are ''."""
    order = Window.partitionBy(*keys).orderBy(F.desc("period"), F.desc("updated_at"), F.desc("line"), F.desc(content))
    return rows.withColumn("area", F.coalesce("area", F.lit(""))).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def closing_values(rows: DataFrame, values: DataFrame, field: str) -> DataFrame:
    """id, area, period, value: of each latest row of a work (id) and area the field's latest normalised value of the same period, else what the row's JSON has."""
    given = latest(values.where(F.col("field") == field), "value_text", "id", "field", "area").select("id", "area", "period", parsed(F.col("value_text")).alias("given"))
    own = parsed(F.get_json_object("json", f"$.{field}"))
    return latest(rows, "json", "id", "area").join(given, ["id", "area", "period"], "left").select("id", "area", "period", F.coalesce("given", own).alias("value"))


def closing_aggregate(found: DataFrame, n: int = 3) -> DataFrame:
    """area, count (of values that are none, too), total, mean, largest, and mean of the n largest values that are not 0."""
    order = Window.partitionBy("area").orderBy(F.desc("value"), "id")
    some = found.where("value <> 0").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    top = some.groupBy("area").agg(F.round(F.avg(F.col("value").cast("double")), 2).alias("mean_of_top"))
    double = lambda c: c.cast("double")
    sums = found.groupBy("area").agg(F.count("*").alias("n"), double(F.sum("value")).alias("total"), F.round(F.avg(double(F.col("value"))), 2).alias("mean"), double(F.max("value")).alias("largest"))
    return sums.join(top, "area", "left")


def period_compare(interactions: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, total, avg_ms, validation_rate of the interactions from the end of each run to that of the next."""
    spans = runs.select("run_id", F.col("completed_at").alias("s"), F.lead("completed_at").over(Window.orderBy("completed_at")).alias("e"))
    right, judged = F.count_if(F.col("state") == "validated"), F.count_if(F.col("state").isin("validated", "rejected"))
    rows = in_spans(interactions.select("created_at", "total_ms", "state"), "created_at", spans, "s", "e")
    return rows.groupBy("run_id").agg(F.count("*").alias("total"), F.round(F.avg("total_ms"), 2).alias("avg_ms"), F.round(right / F.nullif(judged, F.lit(0)), 4).alias("validation_rate"))


_PERIOD = "substr(cast(l_shipdate as string), 1, 7)"
_LOCALE = "<<replace(replace(replace(format_number(cast(l_extendedprice as decimal(18,2)), 2), ',', '#'), '.', ','), '#', '.')|||replace(replace(replace(format('{:,.2f}', cast(cast(l_extendedprice as decimal(18,2)) as double)), ',', '#'), '.', ','), '#', '.')>>"
#: A line is a closing row; those that are done have a normalised value too, the others only what their JSON says.
ROWS = f"select l_orderkey as id, l_linenumber as line, case when l_returnflag <> 'N' then l_returnflag end as area, {_PERIOD} as period, l_shipdate as updated_at, concat(chr(123), '\"production\":\"', case when l_quantity = 7 then 'none' else {_LOCALE} end, '\"', chr(125)) as json from lineitem"
VALUES = f"select l_orderkey as id, l_linenumber as line, case when l_returnflag <> 'N' then l_returnflag end as area, 'production' as field, {_PERIOD} as period, l_shipdate as updated_at, case when l_quantity = 9 then '0' else cast(cast(l_extendedprice + 1 as decimal(18,2)) as string) end as value_text from lineitem where l_linestatus = 'F'"


def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing_aggregate(closing_values(views.run(spark, sf_dir, ROWS), views.run(spark, sf_dir, VALUES), "production"))


QUERIES = {
    "closing_aggregate": aggregated,
    "period_compare": lambda s, d: period_compare(views.run(s, d, "select * from v_interactions"), views.run(s, d, "select * from v_runs")),
}

SQL = {
    "closing_aggregate": views.oracle(f"""
with a as (select *, coalesce(area, '') as ar from ({ROWS}) r), l as (select * from a qualify row_number() over (partition by id, ar order by period desc, updated_at desc, line desc, json desc) = 1),
b as (select *, coalesce(area, '') as ar from ({VALUES}) r), w as (select id, ar, period, try_cast(value_text as decimal(18,2)) as given from b qualify row_number() over (partition by id, field, ar order by period desc, updated_at desc, line desc, value_text desc) = 1),
v as (select l.id, l.ar as area, coalesce(given, try_cast(replace(replace(json_extract_string(json, '$.production'), '.', ''), ',', '.') as decimal(18,2))) as value from l left join w on w.id = l.id and w.ar = l.ar and w.period = l.period),
t as (select area, value from v where value <> 0 qualify row_number() over (partition by area order by value desc, id) <= 3)
select area, count(*) as n, sum(value)::double as total, round(avg(value::double), 2) as mean, max(value)::double as largest, (select round(avg(t.value::double), 2) from t where t.area = v.area) as mean_of_top from v group by area"""),
    "period_compare": views.oracle("""
with spans as (select run_id, completed_at as s, lead(completed_at) over (order by completed_at) as e from v_runs)
select run_id, count(*) as total, round(avg(total_ms), 2) as avg_ms, round((count(*) filter (state = 'validated'))::double / nullif(count(*) filter (state in ('validated', 'rejected')), 0), 4) as validation_rate
from v_interactions join spans on created_at >= s and (created_at < e or e is null) group by run_id"""),
}

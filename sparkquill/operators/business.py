"""Business lookups and aggregates over tenders, works and closings; questions are a table, never a loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from .scoring import bare

#: Years that a measure is asked for, and names of months in questions; inputs of a user.
YEARS = list(range(1992, 1999))
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
#: Forms of a reference in a normalised question, tried in this order.
REFERENCES = [r"(^|[^a-z0-9])(est[- ]?[0-9]{1,4}[- ]?(19|20)[0-9]{2})([^a-z0-9]|$)", r"(^|[^a-z0-9])([a-z]{2,6}-[0-9]{1,5}-(19|20)[0-9]{2})([^a-z0-9]|$)", r"(^|[^a-z0-9])(?:proyecto|obra|licitacion|oferta|estudio) ([a-z0-9-]*[0-9][a-z0-9-]{3,29})([^a-z0-9-]|$)"]
QUARTERS = ["c1|primer cuatrimestre|1er cuatrimestre|cuatrimestre 1|trimestre 1", "c2|segundo cuatrimestre|2do cuatrimestre|cuatrimestre 2|trimestre 2", "c3|tercer cuatrimestre|3er cuatrimestre|cuatrimestre 3|trimestre 3"]
AREAS = {"OI": "oi|o i", "MAN": "man", "MT": "mt", "BT": "bt"}


def whole(pattern: str) -> str:
    return rf"(^|[^a-z0-9])({pattern})([^a-z0-9]|$)"


def first_of(values: list[Column]) -> Column:
    return F.coalesce(*values) if len(values) > 1 else values[0]


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_questions(questions: DataFrame) -> DataFrame:
    """question_id, reference, years, quarter, month, per_month, per_year, period, area, client of each business question."""
    text = F.trim(F.regexp_replace(bare(F.col("text")), "[ \t\n]+", " "))
    q = questions.withColumn("q", text)
    numbers = F.filter(F.regexp_extract_all("q", F.lit("(?<![a-z0-9-])([0-9]{4,8})(?![a-z0-9-])"), 1), lambda n: ~n.rlike("^(19|20)[0-9]{2}$"))
    reference = F.coalesce(*(F.upper(F.replace(found(F.col("q"), p, 2), F.lit(" "), F.lit("-"))) for p in REFERENCES), F.get(numbers, F.lit(0)), found(F.col("text"), "\"([^\"]+)\"", 1))
    q = q.withColumn("reference", reference)
    bare_of_reference = F.when(F.col("reference").isNull(), F.col("q")).otherwise(F.replace("q", F.lower("reference"), F.lit(" ")))
    q = q.withColumn("rest", bare_of_reference)
    years = F.array_distinct(F.regexp_extract_all("rest", F.lit("(?<![a-z0-9-])((19|20)[0-9]{2})(?![a-z0-9-])"), 1))
    quarter = first_of([F.when(F.col("q").rlike(whole(p)), i + 1) for i, p in enumerate(QUARTERS)])
    month = first_of([F.when(F.col("q").rlike(whole(m)), i + 1) for i, m in enumerate(MONTHS)])
    area = first_of([F.when(F.col("q").rlike(whole(p)), a) for a, p in AREAS.items()])
    return q.select(
        "question_id",
        "reference",
        F.array_join(years, ",").alias("years"),
        quarter.alias("quarter"),
        month.alias("month"),
        F.col("q").rlike("cada mes|por mes|mes a mes|todos los meses").alias("per_month"),
        (F.col("q").rlike("cada ano|por ano|anual|todos los anos") | (F.size(years) > 1)).alias("per_year"),
        found(F.col("q"), whole("(19|20)[0-9]{2}-[0-9]{2}"), 2).alias("period"),
        area.alias("area"),
        found(F.col("text"), "cliente ([A-Za-z]+#[0-9]+)", 1).alias("client"),
    )


def match_or_ambiguous(questions: DataFrame, tenders: DataFrame) -> DataFrame:
    """question_id, outcome and id: one tender with the question's normalised code is its match, several are ambiguous, none is not_found."""
    code = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    asked = questions.where("reference is not null").select("question_id", code(F.col("reference")).alias("code"))
    known = tenders.groupBy(code(F.col("offer_no")).alias("code")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return asked.join(known, "code", "left").select("question_id", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def monthly_unpivot(wide: DataFrame, periods: DataFrame) -> DataFrame:
    """id, month, amount, origin: the month columns that are not null as rows; works that have none give their period rows."""
    columns = [f"m{m}" for m in range(1, 13)]
    months = wide.select("id", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("month"), F.col(c).alias("amount")) for i, c in enumerate(columns)))).alias("x")).select("id", "x.*")
    none = wide.where(reduce(Column.__and__, (F.col(c).isNull() for c in columns))).select("id")
    rows = months.where("amount is not null").withColumn("origin", F.lit("columns"))
    return rows.unionByName(periods.join(none, "id", "left_semi").where("amount is not null").select("id", "month", "amount", F.lit("periods").alias("origin")))


def yearly_fanout(tenders: DataFrame, years: list[int] = YEARS) -> DataFrame:
    """year, total, is_zero: the sums of all years in one pass, as a series; a year without rows has 0."""
    sums = tenders.agg(*(F.round(F.coalesce(F.sum(F.when(F.year("award_date") == y, F.col("amount"))), F.lit(0.0)), 2).alias(str(y)) for y in years))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(y).alias("year"), F.col(str(y)).alias("total")) for y in years))).alias("x")).select("x.*", (F.col("x.total") == 0).alias("is_zero"))


def work_aggregate(works: DataFrame, tenders: DataFrame) -> DataFrame:
    """state, n, total, mean, largest: works with a value, with the tender they came from, if any."""
    joined = works.where("amount is not null").join(tenders.select(F.col("id").alias("tender_id"), "state"), "tender_id", "left")
    return joined.groupBy(F.coalesce("state", F.lit("sin licitacion")).alias("state")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.avg("amount"), 2).alias("mean"), F.max("amount").alias("largest"))


def nested(rows: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row a key with its child rows, ordered, as one array."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def work_detail(works: DataFrame, tenders: DataFrame, people: DataFrame, periods: DataFrame) -> DataFrame:
    """id, offer_no, responsible, n_periods, periods: a work, its tender, the names of the person there are, and its periods in order."""
    children = nested(periods, "id", ["year", "month", "amount"], "periods")
    out = works.join(tenders.select(F.col("id").alias("tender_id"), "offer_no"), "tender_id", "left").join(people, "person_id", "left").join(children, "id", "left")
    text = F.array_join(F.transform("periods", lambda p: F.concat_ws("-", p["year"], p["month"])), ",")
    return out.select("id", "offer_no", F.concat_ws(" ", "first_name", "last_name").alias("responsible"), F.coalesce(F.size("periods"), F.lit(0)).alias("n_periods"), F.coalesce(text, F.lit("")).alias("periods"))


def tender_detail(tenders: DataFrame, lines: DataFrame) -> DataFrame:
    """id, quarters, months: a tender with its distribution over quarters and its monthly amounts, both ordered."""
    cents = lambda c: F.round(c * 100).cast("long")
    quarters = nested(lines.groupBy("id", "year", "quarter").agg(F.sum(cents(F.col("amount"))).alias("cents")), "id", ["year", "quarter", "cents"], "quarters")
    months = nested(lines.groupBy("id", "year", "month").agg(F.sum(cents(F.col("amount"))).alias("cents")), "id", ["year", "month", "cents"], "months")
    text = lambda c, x: F.coalesce(F.array_join(F.transform(c, lambda p: F.concat_ws(":", p["year"], p[x], p["cents"])), ","), F.lit(""))
    return tenders.select("id").join(quarters, "id", "left").join(months, "id", "left").select("id", text("quarters", "quarter").alias("quarters"), text("months", "month").alias("months"))


def closing_detail(closings: DataFrame) -> DataFrame:
    """id, area, line, updated_at, n_fields, value: of each key the row updated last, with one value of its JSON, null if that cannot be read."""
    latest = closings.groupBy("id", "area").agg(F.max_by(F.struct("line", "updated_at", "values_json"), F.struct("updated_at", "period", "line", "values_json")).alias("r"), F.count("*").alias("n_fields"))
    values = F.from_json("r.values_json", "map<string,string>")
    return latest.select("id", "area", "r.line", "r.updated_at", "n_fields", values["presupuestoTotal"].alias("value"))


WORKS = "select o_orderkey as id, case when o_orderkey % 5 = 0 then null else o_orderkey end as tender_id, o_custkey % 50 as person_id, case when o_orderkey % 9 = 0 then null else o_totalprice end as amount from orders"
PEOPLE = "select n_nationkey as person_id, n_name as first_name, case when n_nationkey % 3 = 0 then null else 'de ' || n_name end as last_name from nation"
PERIODS = "select l_orderkey as id, year(l_shipdate) as year, month(l_shipdate) as month, round(sum(l_extendedprice), 2) as amount from lineitem group by l_orderkey, year(l_shipdate), month(l_shipdate)"
WIDE = "select l_orderkey as id, " + ", ".join(f"round(sum(case when month(l_shipdate) = {m} and l_orderkey % 3 <> 0 then l_extendedprice end), 2) as m{m}" for m in range(1, 13)) + " from lineitem group by l_orderkey"
LINES = "select l_orderkey as id, year(l_shipdate) as year, quarter(l_shipdate) as quarter, month(l_shipdate) as month, l_extendedprice as amount from lineitem"


def closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.run(spark, sf_dir, "select * from v_closings")
    good = F.concat(F.lit('{"presupuestoTotal":"'), "value_text", F.lit('","area":"'), "area", F.lit('"}'))
    return rows.withColumn("values_json", F.when(F.col("line") % 6 == 0, "{broken").otherwise(good))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, "select * from v_questions")


def tenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, "select * from v_tenders")


def of(text: str):
    return lambda spark, sf_dir: views.run(spark, sf_dir, text)


works, people, periods, wide, lines = of(WORKS), of(PEOPLE), of(PERIODS), of(WIDE), of(LINES)

QUERIES = {
    "parse_business_question": lambda s, d: parse_questions(questions(s, d)),
    "match_or_ambiguous": lambda s, d: match_or_ambiguous(parse_questions(questions(s, d)), tenders(s, d)),
    "monthly_unpivot": lambda s, d: monthly_unpivot(wide(s, d), periods(s, d)),
    "yearly_fanout": lambda s, d: yearly_fanout(tenders(s, d)),
    "work_aggregate": lambda s, d: work_aggregate(works(s, d), tenders(s, d)),
    "work_detail_nested": lambda s, d: work_detail(works(s, d), tenders(s, d), people(s, d), periods(s, d)),
    "tender_detail_nested": lambda s, d: tender_detail(tenders(s, d), lines(s, d)),
    "closing_detail": lambda s, d: closing_detail(closings(s, d)),
}

_Q = "trim(regexp_replace(lower(strip_accents(text)), '[ \t\n]+', ' ', 'g'))"
_PARSED = rf"""
z as (select question_id, text, {_Q} as q from v_questions),
y as (select *, coalesce(upper(replace(nullif(regexp_extract(q, '{REFERENCES[0]}', 2), ''), ' ', '-')), upper(replace(nullif(regexp_extract(q, '{REFERENCES[1]}', 2), ''), ' ', '-')), upper(replace(nullif(regexp_extract(q, '{REFERENCES[2]}', 2), ''), ' ', '-')),
 list_filter(list_filter(regexp_split_to_array(q, '[^a-z0-9-]+'), lambda w: regexp_matches(w, '^[0-9]{{4,8}}$')), lambda w: not regexp_matches(w, '^(19|20)[0-9]{{2}}$'))[1], nullif(regexp_extract(text, '"([^"]+)"', 1), '')) as reference from z),
x as (select *, case when reference is null then q else replace(q, lower(reference), ' ') end as rest from y),
p as (select question_id, reference, array_to_string(list_filter(regexp_split_to_array(rest, '[^a-z0-9-]+'), lambda w: regexp_matches(w, '^(19|20)[0-9]{{2}}$')), ',') as years, case {" ".join(f"when regexp_matches(q, '{whole(p)}') then {i + 1}" for i, p in enumerate(QUARTERS))} end as quarter,
 case {" ".join(f"when regexp_matches(q, '{whole(m)}') then {i + 1}" for i, m in enumerate(MONTHS))} end as month, regexp_matches(q, 'cada mes|por mes|mes a mes|todos los meses') as per_month,
 regexp_matches(q, 'cada ano|por ano|anual|todos los anos') as per_year, nullif(regexp_extract(q, '{whole("(19|20)[0-9]{2}-[0-9]{2}")}', 2), '') as period, case {" ".join(f"when regexp_matches(q, '{whole(p)}') then '{a}'" for a, p in AREAS.items())} end as area,
 nullif(regexp_extract(text, 'cliente ([A-Za-z]+#[0-9]+)', 1), '') as client from x)"""
SQL = {
    "parse_business_question": views.oracle(f"with {_PARSED} select question_id, reference, years, quarter, month, per_month, per_year or contains(years, ',') as per_year, period, area, client from p"),
    "match_or_ambiguous": views.oracle(f"""
with {_PARSED}, t as (select regexp_replace(upper(offer_no), '[^A-Z0-9]', '', 'g') as code, id from v_tenders), k as (select code, count(*) as n, min(id) as id from t group by code)
select question_id, case when n is null then 'not_found' when n = 1 then 'unique' else 'ambiguous' end as outcome, case when n = 1 then id end as id from p left join k on k.code = regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') where reference is not null"""),
    "monthly_unpivot": views.oracle("""
with s as (select l_orderkey as id, l_orderkey % 3 <> 0 as in_columns, year(l_shipdate) as y, month(l_shipdate) as month, l_extendedprice as v from lineitem)
select id, month, round(sum(v), 2) as amount, 'columns' as origin from s where in_columns group by id, month union all select id, month, round(sum(v), 2), 'periods' from s where not in_columns group by id, y, month"""),
    "yearly_fanout": views.oracle("select y as year, round(coalesce(sum(amount), 0), 2) as total, coalesce(sum(amount), 0) = 0 as is_zero from (select unnest(range(1992, 1999)) as y) r left join v_tenders on year(award_date) = y group by y"),
    "work_aggregate": views.oracle("""
select case when o_orderkey % 5 = 0 then 'sin licitacion' else t.state end as state, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 2) as mean, max(o_totalprice) as largest
from orders left join v_tenders t on t.id = o_orderkey where o_orderkey % 9 <> 0 group by 1"""),
    "work_detail_nested": views.oracle("""
with p as (select distinct l_orderkey as id, year(l_shipdate) as y, month(l_shipdate) as m from lineitem), g as (select id, count(*) as n, string_agg(y || '-' || m, ',' order by y, m) as periods from p group by id)
select o_orderkey as id, case when o_orderkey % 5 <> 0 then t.offer_no end as offer_no, case when n_name is null then '' when n_nationkey % 3 = 0 then n_name else n_name || ' de ' || n_name end as responsible, coalesce(n, 0) as n_periods, coalesce(periods, '') as periods
from orders left join v_tenders t on t.id = o_orderkey left join nation on n_nationkey = o_custkey % 50 left join g on g.id = o_orderkey"""),
    "tender_detail_nested": views.oracle("""
with l as (select l_orderkey as id, year(l_shipdate) as y, quarter(l_shipdate) as q, month(l_shipdate) as m, round(l_extendedprice * 100)::bigint as c from lineitem),
a as (select id, string_agg(y || ':' || q || ':' || c, ',' order by y, q) as quarters from (select id, y, q, sum(c)::bigint as c from l group by all) group by id),
b as (select id, string_agg(y || ':' || m || ':' || c, ',' order by y, m) as months from (select id, y, m, sum(c)::bigint as c from l group by all) group by id)
select t.id, coalesce(quarters, '') as quarters, coalesce(months, '') as months from v_tenders t left join a on a.id = t.id left join b on b.id = t.id"""),
    "closing_detail": views.oracle("""
with r as (select *, count(*) over (partition by id, area) as n_fields, row_number() over (partition by id, area order by updated_at desc, period desc, line desc, case when line % 6 = 0 then chr(123) || 'broken' else value_text end desc) as rn from v_closings)
select id, area, line, updated_at, n_fields, case when line % 6 <> 0 then value_text end as value from r where rn = 1"""),
}

"""The second step of coverage repair: of candidates that hold a value, the one that shares most words with what stands around the other values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import views
from . import scoring
from .listings import STOPWORDS
from .relevance import _norm, normal
from .scoring import CANDIDATES

#: Characters around a value that are its context, letters of a word that counts, and words that are compared.
AROUND, LETTERS, TERMS = 240, 7, 10
#: Groups of values of a question at most: each is one step, since a swap for one changes what the next sees.
GROUPS = 2


def holds(group: Column) -> Column:
    return F.exists(group, lambda t: F.contains(F.col("d"), t))


def around(group: Column) -> Column:
    """The section and the text around the first value of the group that the text holds."""
    term = F.get(F.filter(group, lambda t: F.contains(F.col("d"), t)), F.lit(0))
    at = F.instr(F.col("d"), term) - 1
    start = F.greatest(at - AROUND, F.lit(0))
    return F.concat("s", F.substr("d", start + 1, at + F.length(term) + AROUND - start))


def long_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("([a-z]{4,})"), 1), lambda w: (F.length(w) >= LETTERS) & ~w.isin(STOPWORDS) & ~w.startswith("itc"))


def context_swap(pairs: DataFrame, n_groups: int = GROUPS) -> DataFrame:
    """question_id, chunk_id, place after the swaps.

    pairs: question_id, chunk_id, rank, score, place (null: not selected), section, text, and groups, an array of
    n_groups arrays of normal forms of a value. For each group in turn: the ten most frequent long words around the other
    groups' values in selected texts are counted in each candidate that holds the group; one that has more than the selected
    ones takes the place of the weakest of those, or the last place. A question has as many rows as candidates, a bounded number.
    """
    rows = pairs.withColumns({"d": normal(F.col("text")), "s": normal(F.col("section"))})
    q = Window.partitionBy("question_id")
    for g in range(n_groups):
        others = [h for h in range(n_groups) if h != g]
        words = F.concat(*(F.when(holds(F.get("groups", F.lit(h))), long_words(around(F.get("groups", F.lit(h))))).otherwise(F.array().cast("array<string>")) for h in others))
        counted = rows.where("place is not null").select("question_id", F.explode(words).alias("w")).groupBy("question_id", "w").agg(F.count("*").alias("n"))
        best = F.row_number().over(q.orderBy(F.desc("n"), F.desc(F.length("w")), F.desc("w")))
        terms = counted.withColumn("nth", best).where(F.col("nth") <= TERMS).groupBy("question_id").agg(F.collect_list("w").alias("terms"))
        rows = rows.join(terms, "question_id", "left")
        text = F.concat("s", "d")
        rows = rows.withColumns({"has": F.coalesce(holds(F.get("groups", F.lit(g))), F.lit(False)), "hits": F.when(F.col("terms").isNotNull(), F.size(F.filter("terms", lambda t: F.contains(text, t)))).otherwise(0)})
        mine, chosen = F.when(F.col("has"), F.struct("hits", "score", (-F.col("rank")).alias("r"))), F.col("has") & F.col("place").isNotNull()
        top = F.max_by("rank", mine).over(q)
        rows = rows.withColumns({"top": top, "top_hits": F.max(F.when(F.col("has"), F.col("hits"))).over(q), "now": F.coalesce(F.max(F.when(chosen, F.col("hits"))).over(q), F.lit(0)), "weakest": F.min_by("place", F.when(chosen, F.struct("hits", "score", "place"))).over(q), "last": F.max("place").over(q)})
        rows = rows.withColumn("top_in", F.max((F.col("rank") == F.col("top")) & F.col("place").isNotNull()).over(q))
        swap, gives = (F.col("top_hits") > F.col("now")) & ~F.col("top_in"), F.coalesce("weakest", "last")
        place = F.when(swap & (F.col("rank") == F.col("top")), gives).when(swap & (F.col("place") == gives), None).otherwise(F.col("place"))
        rows = rows.withColumn("place", F.when(F.coalesce(swap, F.lit(False)), place).otherwise(F.col("place"))).drop("terms", "has", "hits", "top", "top_hits", "now", "weakest", "last", "top_in")
    return rows.where("place is not null").select("question_id", "chunk_id", "place")


#: Stands for comparisons: all questions compare the values that lines of the fixture have.
K = 6
VALUES = [[" 0,2 mm2 ", " 0,2mm2 "], [" clase ii ", " tipo b2 "]]


def swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.candidates(spark, sf_dir).drop("text").join(views.run(spark, sf_dir, "select chunk_id, section, text from v_norms"), "chunk_id")
    groups = F.array(*(F.array(*map(F.lit, v)) for v in VALUES))
    return context_swap(found.withColumns({"score": F.col("hits"), "place": F.when(F.col("rank") <= K, F.col("rank")), "groups": groups}))


QUERIES = {"context_swap": swapped}


def _step(g: int, before: str) -> str:
    has = lambda h: "(" + " or ".join(f"contains(d, '{t}')" for t in VALUES[h]) + ")"
    at = lambda h: "case " + " ".join(f"when contains(d, '{t}') then {{'p': instr(d, '{t}') - 1, 'l': {len(t)}}}" for t in VALUES[h]) + " end"
    o = 1 - g
    return f"""
a{g} as (select question_id, s || substr(d, greatest(x.p - {AROUND}, 0) + 1, x.p + x.l + {AROUND} - greatest(x.p - {AROUND}, 0)) as ctx from (select *, {at(o)} as x from {before}) y where place is not null and {has(o)}),
w{g} as (select question_id, unnest(list_filter(regexp_extract_all(ctx, '[a-z]{{4,}}'), lambda w: length(w) >= {LETTERS} and w not in ({", ".join(repr(w) for w in STOPWORDS)}) and not starts_with(w, 'itc'))) as w from a{g}),
t{g} as (select question_id, list(w) as terms from (select question_id, w, count(*) as n from w{g} group by 1, 2 qualify row_number() over (partition by question_id order by n desc, length(w) desc, w desc) <= {TERMS}) z group by 1),
h{g} as (select b.*, {has(g)} as has, coalesce(len(list_filter(terms, lambda t: contains(s || d, t))), 0) as nh from {before} b left join t{g} using (question_id)),
m{g} as (select question_id, arg_max(rank, (nh, score, -rank)) filter (has) as top, max(nh) filter (has) as top_hits, coalesce(max(nh) filter (has and place is not null), 0) as now, coalesce(arg_min(place, (nh, score, place)) filter (has and place is not null), max(place)) as gives from h{g} group by 1),
i{g} as (select m.*, top_hits > now and (select place is null from h{g} h where h.question_id = m.question_id and h.rank = m.top) as swap from m{g} m),
p{g} as (select question_id, chunk_id, rank, score, d, s, case when coalesce(swap, false) and rank = top then gives when coalesce(swap, false) and place = gives then null else place end as place from h{g} join i{g} using (question_id))"""


SQL = {
    "context_swap": views.oracle(f"""
with c0 as (with c as ({CANDIDATES}) select question_id, c.chunk_id, c.rank, c.hits as score, case when c.rank <= {K} then c.rank end as place, n.section, n.text from c join (select chunk_id, section, text from v_norms) n on n.chunk_id = c.chunk_id),
p as (select question_id, chunk_id, rank, score, place, {_norm("text")} as d, {_norm("section")} as s from c0), {_step(0, "p")}, {_step(1, "p0")}
select question_id, chunk_id, place from p1 where place is not null"""),
}

"""Evaluation of answers and of retrieval: batch jobs over questions, answers and contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import nearest_rank, percentile_cont, ranked_values
from ..sources import views
from . import listings, scoring, shared
from .corpus import HITS
from .retrieval import tokens
from .scoring import bare

#: A user's list of words that say nothing; these stand for it.
STOPWORDS = ["sobre", "entre", "desde", "hasta", "donde", "cuando", "about", "there", "their", "which"]
#: Answers that say they know nothing, or only a part; fixed values.
UNSURE = ["no hay informacion suficiente", "no hay información suficiente", "no se menciona", "no se especifica", "no se indica"]
PARTIAL = "parcial|partly"
QUALIFIER = "excepto|salvo|siempre que|only|not"


def answers(turns: DataFrame) -> DataFrame:
    """Each assistant's turn with the turn before it as its context, and the last user's turn as its question."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = turns.withColumns({"context": F.lag("text").over(w), "question": asked})
    return out.where("role = 'assistant'").select("conv_id", "turn", "question", F.col("text").alias("answer"), "context")


def faithfulness(rows: DataFrame) -> DataFrame:
    """conv_id, turn, faithfulness: the share of the answer's sentences with a keyword that have one in common with the context; null if no sentence has."""
    sentences = F.split("answer", r"(?<=[.!?;])\s+|\n+")
    keywords = F.transform(sentences, lambda s: F.filter(tokens(bare(s)), lambda t: (F.length(t) >= 5) & ~t.isin(STOPWORDS)))
    rows = rows.withColumns({"keywords": F.filter(keywords, lambda k: F.size(k) > 0), "known": tokens(bare(F.col("context")))})
    supported = F.size(F.filter("keywords", lambda k: F.arrays_overlap(k, "known")))
    blank = F.coalesce((F.trim("answer") == "") | (F.trim("context") == ""), F.lit(True))
    return rows.select("conv_id", "turn", F.when(~blank & (F.size("keywords") > 0), F.round(supported / F.size("keywords"), 4)).alias("faithfulness"))


def points(*rules: tuple[Column, float]) -> Column:
    """The value of the first rule that holds, else 0."""
    return F.coalesce(reduce(lambda c, r: c.when(r[0], r[1]), rules, F.when(F.lit(False), 0.0)), F.lit(0.0))


def answer_confidence(rows: DataFrame) -> DataFrame:
    """conv_id, turn, the parts of the confidence, the cap, and the confidence: the sum of the parts between 0 and the cap. rows: answers() with n_sources."""
    text, low, context, asked = F.col("answer"), F.lower("answer"), F.lower(F.coalesce("context", F.lit(""))), F.lower(F.coalesce("question", F.lit("")))
    words = F.slice(F.regexp_extract_all(low, F.lit("([a-z0-9]{5,})"), 1), 1, 30)
    rows = rows.withColumns({"words": words, "known": context})
    ratio = F.when(F.size("words") > 0, F.size(F.filter("words", lambda w: F.contains(F.col("known"), w))) / F.size("words")).otherwise(0.0)
    own = F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 5))
    support = F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(F.col("context")))) / F.size(own)).otherwise(0.0)
    rows = rows.withColumns({"ratio": ratio, "support": support})
    has = context != ""
    number, reference = text.rlike("[0-9]"), low.rlike(r"(^|[^a-z])(tabla|articulo|itc|table)([^a-z]|$)")
    unsure = reduce(Column.__or__, (F.contains(low, F.lit(p)) for p in UNSURE))
    partial, wants_number = low.rlike(PARTIAL), asked.rlike("cuant|how many|number")
    missing = context.rlike(QUALIFIER) & ~low.rlike(QUALIFIER)
    length, r, s = F.length(text), F.col("ratio"), F.col("support")
    parts = {
        "length_part": points((length >= 180, 0.25), (length >= 90, 0.18), (length >= 60, 0.12)),
        "source_part": points((F.col("n_sources") >= 2, 0.25), (F.col("n_sources") >= 1, 0.2)),
        "overlap_part": points((has & (r >= 0.3), 0.3), (has & (r >= 0.18), 0.22), (has & (r >= 0.1), 0.12), (has & (r < 0.08), -0.2), (has, -0.05)),
        "evidence_part": points((number, 0.05)) + points((reference, 0.05)),
        "signal_part": points((partial, -0.05)) + points((wants_number & number, 0.05), (wants_number & ~unsure, -0.2)),
        "support_part": points((s >= 0.72, 0.12), (s >= 0.55, 0.06), (s < 0.22, -0.08)),
        "qualifier_part": points((missing, -0.1)),
    }
    caps = [F.when((F.col("n_sources") >= 2) & (r >= 0.25) & reference, 0.95).otherwise(0.9), points((wants_number & ~number, 0.7), (F.lit(True), 1.0)), points((partial, 0.75), (F.lit(True), 1.0)), points((unsure, 0.6), (F.lit(True), 1.0)), points((missing, 0.7), (F.lit(True), 1.0))]
    rows = rows.withColumns({**parts, "cap": F.least(*caps)})
    total = reduce(Column.__add__, (F.col(p) for p in parts))
    return rows.select("conv_id", "turn", *(F.round(p, 4).alias(p) for p in parts), "cap", F.round(F.least(F.greatest(total, F.lit(0.0)), F.col("cap")), 4).alias("confidence"))


def battery_expectations(rows: DataFrame) -> DataFrame:
    """part, difficulty, n, n_passed, pass_rate. rows: part, difficulty, text, route, expected_route, terms, pattern: all expectations of a question must be met."""
    met = (F.col("route") == F.col("expected_route")) & F.forall("terms", lambda t: F.contains(F.lower("text"), t)) & F.regexp_like("text", F.col("pattern"))
    out = rows.groupBy("part", "difficulty").agg(F.count("*").alias("n"), F.count_if(met).alias("n_passed"))
    return out.withColumn("pass_rate", F.round(F.col("n_passed") / F.col("n"), 4))


def latency_breakdown(rows: DataFrame) -> DataFrame:
    """Mean of each stage, and continuous percentiles of the whole, in ranges of values."""
    rows = rows.where("router_ms is not null")
    means = rows.agg(*(F.round(F.avg(c), 2).alias(c) for c in ("router_ms", "rag_ms", "llm_ms", "db_ms")), F.count("*").alias("n"))
    tops = ranked_values(rows, "total_ms").agg(F.round(percentile_cont(0.5), 4).alias("p50"), F.round(percentile_cont(0.95), 4).alias("p95"))
    return means.crossJoin(F.broadcast(tops))  # a row each


#: Retrieved and expected sources of each question; its candidates stand for its latency.
GOLDEN = f"""
with {HITS}, top as (select question_id, source, c.text from (select * from ranked where rank <= 3) r join (select chunk_id, text from v_chunks) c using (chunk_id)),
got as (select question_id, count(*) as n_selected, COLLECT(source) as sources, lower(JOIN_ARR(array_sort(COLLECT(text)), ' ')) as context from top group by question_id),
wanted as (select question_id, COLLECT(source) as expected from (select distinct question_id, source from scored where hits >= 8) x group by question_id),
size as (select question_id, count(*) as n_candidates from scored group by question_id)
select item_id as question_id, text, n_selected, sources, context, expected, coalesce(n_candidates, 0) as n_candidates from benchmark left join got on got.question_id = item_id left join wanted on wanted.question_id = item_id left join size on size.question_id = item_id"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of GOLDEN, from two passes over the chunks instead of a join by word."""
    questions, asked, chunks, words = scoring.searched(spark, sf_dir)
    best = shared.most_shared(questions, asked, chunks, words, "chunk_id", ["source"], 3)
    top = chunks.select("chunk_id", "text").join(F.broadcast(best), "chunk_id")
    got = top.groupBy("question_id").agg(F.count("*").alias("n_selected"), F.collect_list("source").alias("sources"), F.lower(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("context"))
    sums = shared.shared_by_group(questions, asked, chunks, words, "source").groupBy("question_id")
    of = sums.agg(F.collect_list(F.when(F.col("most") >= 8, F.col("source"))).alias("expected"), F.sum("found").alias("n_candidates"))
    rows = questions.withColumnRenamed("question", "text").join(got, "question_id", "left").join(of, "question_id", "left")
    return rows.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "expected": F.when(F.size("expected") > 0, F.col("expected"))})


def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, recall, precision_at_k: of the sources of each question's chunks with four shared words those among its three best, and of these those that are among them."""
    questions, asked, chunks, words = scoring.searched(spark, sf_dir)
    got = shared.most_shared(questions, asked, chunks, words, "chunk_id", ["source"], 3).groupBy("question_id").agg(F.collect_set("source").alias("got"))
    wanted = shared.shared_by_group(questions, asked, chunks, words, "source").where("most >= 4").groupBy("question_id").agg(F.collect_list("source").alias("wanted"))
    rows = questions.join(wanted, "question_id", "left").join(got, "question_id", "left").withColumn("h", F.size(F.array_intersect("wanted", "got")))
    recall = F.when(F.col("wanted").isNull(), 1.0).otherwise(F.round(F.col("h") / F.size("wanted"), 4))
    precision = F.when(F.col("wanted").isNull() | F.col("got").isNull(), 0.0).otherwise(F.round(F.col("h") / F.size("got"), 4))
    return rows.select("question_id", recall.alias("recall"), precision.alias("precision_at_k"))


def golden_report(rows: DataFrame) -> DataFrame:
    """One row: share of empty retrievals, of questions with a source they should have, phrase and evidence coverage over those that define them, and nearest-rank latencies."""
    words = F.split(F.lower("text"), " ")
    phrases = F.when(F.size(words) >= 6, F.array(F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, -3, 3), " ")))
    evidence = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1))
    rows = rows.withColumns({"phrases": phrases, "evidence": evidence, "known": F.coalesce("context", F.lit("")), "latency_ms": F.col("n_candidates") * 0.5})
    share = lambda a: F.when(F.size(a) > 0, F.size(F.filter(a, lambda p: F.contains(F.col("known"), p))) / F.size(a))
    hit = F.when(F.size("expected") > 0, F.coalesce(F.arrays_overlap("sources", "expected"), F.lit(False)).cast("int"))
    out = rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.coalesce("n_selected", F.lit(0)) == 0, 1.0).otherwise(0.0)), 4).alias("empty_retrieval_rate"),
        F.round(F.avg(hit), 4).alias("source_hit_rate"),
        F.round(F.avg(share(F.col("phrases"))), 4).alias("phrase_coverage"),
        F.round(F.avg(share(F.col("evidence"))), 4).alias("evidence_coverage"),
    )
    return out.crossJoin(F.broadcast(ranked_values(rows, "latency_ms").agg(F.round(nearest_rank(0.5), 2).alias("p50"), F.round(nearest_rank(0.95), 2).alias("p95"))))


BATTERY = """
select case when question_id >= 2000000000 then 'technical' when question_id >= 1000000000 then 'business' else 'chat' end as part, case question_id % 3 when 0 then 'easy' when 1 then 'medium' else 'hard' end as difficulty, text, question_id,
 case when question_id >= 2000000000 then 'knowledge' when question_id >= 1000000000 then 'business_tenders' else 'knowledge' end as expected_route,
 case when question_id >= 2000000000 then ARRAY_OF('articulo', 'tabla') when question_id >= 1000000000 then ARRAY_OF('importe', 'cliente') else ARRAY_OF('e', 'n') end as terms,
 case when question_id >= 2000000000 then 'pag[.] [1-6]' when question_id >= 1000000000 then 'EST-[0-9]+-199[2-6]' else '[a-z]' end as pattern from v_questions"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations of all questions, held against the routes of the cascade."""
    rows = views.run(spark, sf_dir, BATTERY)
    return battery_expectations(rows.join(listings.routes(rows).select("question_id", "route"), "question_id"))


QUERIES = {
    "faithfulness": lambda spark, sf_dir: faithfulness(turns(spark, sf_dir)),
    "answer_confidence": lambda spark, sf_dir: answer_confidence(turns(spark, sf_dir).withColumn("n_sources", F.col("turn") % 3)),
    "battery_expectations": battery,
    "golden_report": lambda spark, sf_dir: golden_report(golden(spark, sf_dir)),
    "recall_precision_at_k": recall_precision,
    "latency_breakdown": lambda spark, sf_dir: latency_breakdown(views.run(spark, sf_dir, "select * from v_interactions")),
}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_ANSWERS = """
a as (select conv_id, turn, role, text as answer, lag(text) over (partition by conv_id order by turn) as context, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as question from conversations),
n as (select * from a where role = 'assistant')"""
SQL = {
    "faithfulness": rf"""
with {_ANSWERS}, s as (select conv_id, turn, list_distinct(regexp_extract_all(lower(strip_accents(context)), '\p{{L}}{{4,}}')) as known, unnest(string_split(regexp_replace(answer, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10))) as sentence from n where trim(answer) <> '' and trim(context) <> ''),
k as (select conv_id, turn, known, list_filter(regexp_extract_all(lower(strip_accents(sentence)), '\p{{L}}{{4,}}'), lambda t: length(t) >= 5 and t not in ({_STOP})) as words from s),
f as (select conv_id, turn, round(count(*) filter (list_has_any(words, known))::double / count(*), 4) as faithfulness from k where len(words) > 0 group by conv_id, turn)
select n.conv_id, n.turn, faithfulness from n left join f using (conv_id, turn)""",
    "answer_confidence": rf"""
with {_ANSWERS}, b as (select conv_id, turn, turn % 3 as ns, answer, lower(answer) as low, lower(coalesce(context, '')) as ctx, lower(coalesce(question, '')) as q, length(answer) as l,
 regexp_extract_all(lower(answer), '[a-z0-9]{{5,}}')[1:30] as words, list_distinct(list_filter(regexp_extract_all(lower(answer), '\p{{L}}{{4,}}'), lambda t: length(t) >= 5)) as own, regexp_extract_all(lower(coalesce(context, '')), '\p{{L}}{{4,}}') as known from n),
c as (select *, case when len(words) > 0 then len(list_filter(words, lambda w: contains(ctx, w)))::double / len(words) else 0 end as r, case when len(own) > 0 then len(list_intersect(own, known))::double / len(own) else 0 end as s,
 regexp_matches(answer, '[0-9]') as num, regexp_matches(low, '(^|[^a-z])(tabla|articulo|itc|table)([^a-z]|$)') as ref, {" or ".join(f"contains(low, '{p}')" for p in UNSURE)} as unsure, regexp_matches(low, '{PARTIAL}') as part, regexp_matches(q, 'cuant|how many|number') as wants,
 regexp_matches(ctx, '{QUALIFIER}') and not regexp_matches(low, '{QUALIFIER}') as missing from b),
p as (select *, case when l >= 180 then 0.25 when l >= 90 then 0.18 when l >= 60 then 0.12 else 0 end::double as length_part, case when ns >= 2 then 0.25 when ns >= 1 then 0.2 else 0 end::double as source_part,
 case when ctx = '' then 0 when r >= 0.3 then 0.3 when r >= 0.18 then 0.22 when r >= 0.1 then 0.12 when r < 0.08 then -0.2 else -0.05 end::double as overlap_part, (case when num then 0.05 else 0 end + case when ref then 0.05 else 0 end)::double as evidence_part,
 (case when part then -0.05 else 0 end + case when wants and num then 0.05 when wants and not unsure then -0.2 else 0 end)::double as signal_part, case when s >= 0.72 then 0.12 when s >= 0.55 then 0.06 when s < 0.22 then -0.08 else 0 end::double as support_part, case when missing then -0.1 else 0 end::double as qualifier_part,
 least(case when ns >= 2 and r >= 0.25 and ref then 0.95 else 0.9 end, case when wants and not num then 0.7 else 1 end, case when part then 0.75 else 1 end, case when unsure then 0.6 else 1 end, case when missing then 0.7 else 1 end)::double as cap from c)
select conv_id, turn, round(length_part, 4) as length_part, round(source_part, 4) as source_part, round(overlap_part, 4) as overlap_part, round(evidence_part, 4) as evidence_part, round(signal_part, 4) as signal_part, round(support_part, 4) as support_part, round(qualifier_part, 4) as qualifier_part, cap,
 round(least(greatest(length_part + source_part + overlap_part + evidence_part + signal_part + support_part + qualifier_part, 0), cap), 4) as confidence from p""",
    "battery_expectations": views.oracle(f"""
with {listings._routed("select question_id as id, text from v_questions")}, bt as (select x.*, route from ({BATTERY}) x join r on r.id = x.question_id), mt as (select part, difficulty, route = expected_route and len(list_filter(terms, lambda t: not contains(lower(text), t))) = 0 and regexp_matches(text, pattern) as met from bt)
select part, difficulty, count(*) as n, count(*) filter (met) as n_passed, round(count(*) filter (met)::double / count(*), 4) as pass_rate from mt group by part, difficulty"""),
    "golden_report": views.oracle(f"""
with g as ({GOLDEN}), w as (select *, string_split(lower(text), ' ') as words, list_distinct(regexp_extract_all(text, '[0-9]+')) as evidence, n_candidates * 0.5 as ms, coalesce(context, '') as known from g),
h as (select *, case when len(words) >= 6 then [array_to_string(words[1:3], ' '), array_to_string(words[-3:], ' ')] end as phrases, (row_number() over (order by ms) - 1) as pos, count(*) over () as total from w)
select count(*) as n, round(avg(case when n_selected is null then 1 else 0 end), 4) as empty_retrieval_rate, round(avg(case when expected is not null then case when coalesce(list_has_any(sources, expected), false) then 1 else 0 end end), 4) as source_hit_rate,
 round(avg(len(list_filter(phrases, lambda p: contains(known, p)))::double / len(phrases)), 4) as phrase_coverage, round(avg(case when len(evidence) > 0 then len(list_filter(evidence, lambda p: contains(known, p)))::double / len(evidence) end), 4) as evidence_coverage,
 round(max(case when pos = round_even((total - 1) * 0.5, 0) then ms end), 2) as p50, round(max(case when pos = round_even((total - 1) * 0.95, 0) then ms end), 2) as p95 from h"""),
    "latency_breakdown": views.oracle("select round(avg(router_ms), 2) as router_ms, round(avg(rag_ms), 2) as rag_ms, round(avg(llm_ms), 2) as llm_ms, round(avg(db_ms), 2) as db_ms, round(percentile_cont(0.5) within group (order by total_ms), 4) as p50, round(percentile_cont(0.95) within group (order by total_ms), 4) as p95, count(*) as n from v_interactions where router_ms is not null"),
}

"""From candidates to an answer's context: boosts, thresholds, neighbours, definitions, statistics; and what is told about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import views
from .evaluation import PARTIAL, QUALIFIER, UNSURE, answers
from .questions import COMPARISON, DEFINITION, LIST, PROCEDURE, SUMMARY
from .retrieval import tokens
from .scoring import CANDIDATES, bare, best_chunks, candidates, sql

#: Boosts of layers of authority, for questions of how to do something and for others; of domains; of a rule without points of its own.
LAYER_BOOSTS = {"law": 8, "guide": 4, "manual": 0, "other": -5}
PROCEDURE_BOOSTS = {"law": 0, "guide": 4, "manual": 6, "other": -5}
SAME_DOMAIN, FOREIGN_DOMAIN, EXCLUSION = 12, -30, -20
#: Scores below which candidates, and those of foreign domains, are left out if others are left.
LEAST_SCORE, LEAST_FOREIGN = 4, 30
#: Rows of a page that are looked up.
PAGE_ROWS = 20


def boosts(pairs: DataFrame, layers: DataFrame, exclusions: DataFrame) -> DataFrame:
    """question_id, chunk_id, layer_part, domain_part, exclusion_part, score. pairs have domain, the question's; layers: source, layer, its domain; exclusions: primary, excluded, unless (a word of the question), points."""
    procedure = F.lower("question").rlike("como|how|pasos")
    boost = lambda of: F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for p in of.items() for x in p)), lambda k, v: k == F.col("layer"))), F.lit(0)), F.lit(0))
    layers = layers.withColumnRenamed("domain", "source_domain")
    rules = exclusions.groupBy("primary", "excluded").agg(F.first("unless").alias("unless"), F.first("points").alias("points"))
    out = pairs.join(layers, "source", "left").join(rules, (F.col("domain") == F.col("primary")) & (F.col("source_domain") == F.col("excluded")), "left")
    domain = F.when(F.col("source_domain").isNull() | F.col("domain").isNull(), 0).when(F.col("source_domain") == F.col("domain"), SAME_DOMAIN).otherwise(FOREIGN_DOMAIN)
    excluded = F.when(F.col("primary").isNotNull() & ~F.contains(F.lower("question"), F.col("unless")), F.coalesce("points", F.lit(EXCLUSION))).otherwise(0)
    parts = {"layer_part": F.when(procedure, boost(PROCEDURE_BOOSTS)).otherwise(boost(LAYER_BOOSTS)), "domain_part": domain, "exclusion_part": excluded}
    return out.select("question_id", "chunk_id", *(c.cast("long").alias(n) for n, c in parts.items()), (F.col("hits") + sum((c for c in parts.values()), F.lit(0))).alias("score"))


def threshold(pairs: DataFrame) -> DataFrame:
    """question_id, chunk_id, place: rows below LEAST_SCORE go, unless that empties the question; then those of other domains below LEAST_FOREIGN, unless that does. The question's domain comes first."""
    q = Window.partitionBy("question_id")
    keep = lambda df, c: df.withColumn("ok", c).withColumn("any_ok", F.bool_or("ok").over(q)).where("ok or not any_ok").drop("ok", "any_ok")
    own = F.col("source_domain").eqNullSafe(F.col("domain"))
    rows = keep(keep(pairs, F.col("score") >= LEAST_SCORE), own | (F.col("score") >= LEAST_FOREIGN))
    place = F.row_number().over(q.orderBy(F.when(own, 0).otherwise(1), F.desc("score"), "chunk_id"))
    return rows.select("question_id", "chunk_id", place.alias("place"))


def neighbours(top: DataFrame, chunks: DataFrame, wide: Column) -> DataFrame:
    """question_id, chunk_id: the chunks one before and after the selected ones in document and page (two, where wide), and the first of the next page for the first two of a page; none that is selected."""
    deltas = F.when(wide, F.array(*map(F.lit, (-2, -1, 1, 2)))).otherwise(F.array(*map(F.lit, (-1, 1))))
    near = F.transform(deltas, lambda d: F.struct(F.col("page"), (F.col("nth") + d).alias("nth")))
    next_ = F.when(F.col("nth") <= 2, F.array(F.struct((F.col("page") + 1).alias("page"), F.lit(1).cast("long").alias("nth")))).otherwise(F.array().cast("array<struct<page:bigint,nth:bigint>>"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("chunk")).cast("long")
    numbered = chunks.withColumn("nth", nth)
    placed = top.select("question_id", "question", "chunk_id").join(numbered.select("chunk_id", "doc_id", "page", "nth"), "chunk_id")
    wanted = placed.select("question_id", "doc_id", F.explode(F.concat(near.cast("array<struct<page:bigint,nth:bigint>>"), next_)).alias("at")).select("question_id", "doc_id", "at.*").distinct()
    found = wanted.join(numbered.select("chunk_id", "doc_id", "page", "nth"), ["doc_id", "page", "nth"]).select("question_id", "chunk_id")
    return found.join(top.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")


def context(top: DataFrame) -> DataFrame:
    """question_id, context (label and text of each chunk in the order of rank, parted by blank lines), sources (labels, each once, in the order of first sight)."""
    label = F.concat(F.col("source"), F.lit(" (pag. "), F.col("page").cast("string"), F.lit(")"))
    parts = F.array_sort(F.collect_list(F.struct("rank", label.alias("label"), F.trim("text").alias("text"))))
    rows = top.groupBy("question_id").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["label"], F.lit("]\n"), x["text"])), "\n\n")
    return rows.select("question_id", text.alias("context"), F.array_join(F.array_distinct(F.transform("p", lambda x: x["label"])), "; ").alias("sources"))


def definitions(top: DataFrame) -> DataFrame:
    """question_id, code, meaning: codes like C7 with the words behind them, from the chunk of the best rank that has them."""
    pattern = r"\b(C(?:1[0-3]?|[1-9]))\s+([a-z][a-z ]{2,40})"
    found = top.select("question_id", "rank", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("m"))
    found = found.select("question_id", "rank", F.regexp_extract("m", pattern, 1).alias("code"), F.trim(F.regexp_extract("m", pattern, 2)).alias("meaning"))
    return found.groupBy("question_id", "code").agg(F.min_by("meaning", F.struct("rank", "meaning")).alias("meaning"))


def dedupe(asked: DataFrame) -> DataFrame:
    """key_id, result_of, n: of questions equal when normalised, in k, domain and hints (in any order), one is run, the first, and its result serves all."""
    normal = F.trim(F.regexp_replace(F.regexp_replace(bare(F.col("text")), r"[.,;:!?¿¡()]+", " "), r"\s+", " "))
    key = F.sha2(F.concat_ws("|", normal, F.col("k").cast("string"), F.coalesce("domain", F.lit("")), F.array_join(F.array_sort("hints"), ",")), 256)
    rows = asked.select("key_id", key.alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("key_id").alias("result_of"), F.count("*").alias("n")), "key").select("key_id", "result_of", "n")


def stats(top: DataFrame) -> DataFrame:
    """Of each question: how many chunks and sources, the main source, how many chunks are of its domain, share of chunks with half its words, best share of its words, best and last score, and whether all are below the threshold."""
    asked = F.array_distinct(tokens(F.col("question")))
    share = F.when(F.size(asked) > 0, F.col("hits") / F.size(asked)).otherwise(0.0)
    rows = top.withColumn("share", share)
    by_source = rows.groupBy("question_id", "source").agg(F.count("*").alias("n")).groupBy("question_id").agg(F.max_by("source", F.struct("n", "source")).alias("top_source"))
    out = rows.groupBy("question_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("source").alias("n_sources"),
        F.round(F.avg(F.when(F.col("source_domain").eqNullSafe(F.col("domain")), 1.0).otherwise(0.0)), 4).alias("domain_match_ratio"),
        F.round(F.avg(F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0)), 4).alias("supported_ratio"),
        F.round(F.max("share"), 4).alias("max_coverage"),
        F.max("hits").alias("top_score"),
        F.min_by("hits", F.struct(-F.col("rank"))).alias("bottom_score"),
        (F.max("hits") < LEAST_SCORE).alias("all_below"),
        F.bool_or(F.col("domain").isNotNull()).alias("has_domain"),
    )
    return out.join(by_source, "question_id")


def quality(questions: DataFrame, of: DataFrame) -> DataFrame:
    """question_id, quality: empty, poor, mixed or good by stats()."""
    rows = questions.join(of, "question_id", "left")
    poor = F.col("all_below") | (~F.col("has_domain") & (F.col("supported_ratio") == 0) & (F.col("max_coverage") < 0.25)) | (F.col("has_domain") & (F.col("domain_match_ratio") < 0.34))
    good = (F.col("domain_match_ratio") >= 0.67) | ~F.col("has_domain")
    return rows.select("question_id", F.when(F.col("n").isNull(), "empty").when(poor, "poor").when(good, "good").otherwise("mixed").alias("quality"))


def page_lookup(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_id, rank: the first PAGE_ROWS chunks of the page that a question names. A page's first rows are found before they meet the questions, from partial ones of each part of the page, so that a page that all documents have is no single task."""
    page = F.nullif(F.regexp_extract(F.lower("text"), r"pag[.] ([0-9]+)", 1), F.lit("")).cast("long")
    some = F.row_number().over(Window.partitionBy("page", "part").orderBy("chunk_id"))
    parts = chunks.select("page", "chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(256)).alias("part")).withColumn("n", some).where(F.col("n") <= PAGE_ROWS)
    first = parts.select("page", "chunk_id", F.row_number().over(Window.partitionBy("page").orderBy("chunk_id")).alias("rank")).where(F.col("rank") <= PAGE_ROWS)
    return questions.select("question_id", page.alias("page")).where("page is not null").join(first, "page").select("question_id", "chunk_id", "rank")


# -- answers ------------------------------------------------------------------------------------------------------------


def source_overlap(rows: DataFrame) -> DataFrame:
    """question_id, n_expected, n_hits, recall, precision. Sources are compared without case, accents, folder and page, either within the other; hits are the different expected ones at most."""
    normal = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(F.split_part(F.regexp_replace(bare(s), r"^(data[/\\])?documentos[/\\]", ""), F.lit("("), F.lit(1)))))
    plain = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda s: F.trim(F.split_part(F.regexp_replace(bare(s), r"^(data[/\\])?documentos[/\\]", ""), F.lit("("), F.lit(1))))
    rows = rows.withColumns({"wanted": normal(F.col("expected")), "got": plain(F.col("retrieved"))})
    hit = F.filter("got", lambda g: F.exists("wanted", lambda w: F.contains(g, w) | F.contains(w, g)))
    rows = rows.withColumn("n_hits", F.least(F.size(hit), F.size("wanted")))
    n, m = F.size("wanted"), F.size("got")
    return rows.select("question_id", n.alias("n_expected"), "n_hits", F.when(n == 0, 1.0).otherwise(F.round(F.col("n_hits") / n, 4)).alias("recall"), F.when((n == 0) | (m == 0), 0.0).otherwise(F.round(F.col("n_hits") / m, 4)).alias("precision_at_k"))


def report(rows: DataFrame) -> DataFrame:
    """One row over source_overlap(): n, evaluable (with something expected), mean recall and precision, both of the evaluable ones."""
    mine = F.col("n_expected") > 0
    return rows.agg(F.count("*").alias("n"), F.count_if(mine).alias("n_evaluable"), F.round(F.avg("recall"), 4).alias("avg_recall"), F.round(F.avg("precision_at_k"), 4).alias("avg_precision"), F.round(F.avg(F.when(mine, F.col("recall"))), 4).alias("evaluable_recall"))


def regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """question_id, delta, regressed: recall that fell by more than 0.01; questions of one side only have none."""
    delta = F.round(F.col("a.recall") - F.col("b.recall"), 4)
    return before.alias("b").join(after.alias("a"), "question_id").select("question_id", delta.alias("delta"), (delta < -0.01).alias("regressed"))


def gate(of_report: DataFrame, regressions: DataFrame) -> DataFrame:
    """One row: recall of 0.40, precision of 0.25, and no regression."""
    fell = regressions.agg(F.count_if("regressed").alias("n_regressed"))
    return of_report.crossJoin(fell).select("avg_recall", "avg_precision", "n_regressed", ((F.col("avg_recall") >= 0.4) & (F.col("avg_precision") >= 0.25) & (F.col("n_regressed") == 0)).alias("passes"))


def support(rows: DataFrame) -> DataFrame:
    """conv_id, turn, support: of the context's sentences the one that supports the answer best: 0.45 for the question's words, 0.35 for the answer's, 0.1 each if it has all of their numbers and labels."""
    words = lambda c: F.array_distinct(F.filter(tokens(bare(c)), lambda w: F.length(w) >= 5))
    digits = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([0-9]+)"), 1))
    labels = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("([A-Z]{2,})"), 1))
    rows = rows.withColumns({"focus": words(F.coalesce("question", F.lit(""))), "own": words(F.col("answer")), "n1": digits(F.col("answer")), "l1": labels(F.col("answer"))})
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    has = lambda a, b: F.when((F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0), 1.0).otherwise(0.0)
    pieces = rows.select("conv_id", "turn", "focus", "own", "n1", "l1", F.explode_outer(F.split("context", r"(?<=[.!?;])\s+|\n+")).alias("s"))
    score = 0.45 * share(F.col("focus"), words(F.coalesce("s", F.lit("")))) + 0.35 * share(F.col("own"), words(F.coalesce("s", F.lit("")))) + 0.1 * has(F.col("n1"), digits(F.col("s"))) + 0.1 * has(F.col("l1"), labels(F.col("s")))
    return pieces.groupBy("conv_id", "turn").agg(F.round(F.max(score), 4).alias("support"))


def escalation(rows: DataFrame) -> DataFrame:
    """reason, n, share. rows: question, answer, context, confidence, quality: the first reason that holds to ask a second model; the threshold depends on the kind of question."""
    q, low = bare(F.col("question")), F.lower("answer")
    off = F.when(q.rlike(COMPARISON) | q.rlike(SUMMARY) | F.contains(q, F.lit("tabla")), 0.08).when(q.rlike(LIST) | q.rlike(PROCEDURE), 0.06).when(q.rlike(DEFINITION), 0.04).otherwise(0.0)
    limit = F.greatest(F.lit(0.5), F.round(0.65 - F.coalesce(off, F.lit(0.0)), 2))
    fine = F.col("quality").isin("good", "mixed")
    c = F.col("confidence")
    missing = F.lower("context").rlike(QUALIFIER) & ~low.rlike(QUALIFIER)
    reason = F.when(low.rlike("|".join(UNSURE[:2])) & fine, "insufficient_with_context").when(low.rlike(PARTIAL) & fine & (c >= F.greatest(F.lit(0.72), limit)), "partial_high_confidence").when(missing & fine & (c >= F.greatest(F.lit(0.7), limit)), "missing_qualifiers")
    reason = reason.when(~fine, "none").when((F.length("question") > 220) & (c < limit), "complex_low_confidence").when((limit - c >= 0.05) & (c <= 0.6), "low_confidence").otherwise("none")
    out = rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    return out.join(F.broadcast(out.agg(F.sum("n").alias("total")))).select("reason", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


LAYERS = "select * from (values ('src0', 'law', 'en'), ('src1', 'guide', 'fr'), ('src2', 'manual', 'de'), ('src3', 'other', 'es'), ('src4', 'law', 'fr')) as t(source, layer, domain)"
EXCLUSIONS = "select * from (values ('en', 'fr', 'with', cast(null as int)), ('en', 'de', 'nunca', -7)) as t(primary, excluded, unless, points)"
DOMAIN = "case question_id % 3 when 0 then 'en' when 1 then 'fr' end"


def of(text: str):
    return lambda s, d: views.run(s, d, text)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).withColumn("domain", F.expr(DOMAIN))


def with_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).join(F.broadcast(of(LAYERS)(spark, sf_dir)).select("source", F.col("domain").alias("source_domain")), "source", "left").withColumn("score", F.col("hits"))


def best(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return candidates(spark, sf_dir).where(F.col("rank") <= n)


def overlap(spark: SparkSession, sf_dir: str, found: DataFrame, n: int) -> DataFrame:
    """source_overlap() of each question: expected are the sources of its candidates (found) with eight shared words, retrieved those of the n best, spelled otherwise."""
    spelled = F.concat(F.when(F.col("rank") % 2 == 0, "documentos/").otherwise(""), F.upper("source"), F.lit(" (pag. "), F.col("page").cast("string"), F.lit(")"))
    both = found.groupBy("question_id").agg(F.collect_set(F.when(F.col("hits") >= 8, F.col("source"))).alias("expected"), F.collect_list(F.when(F.col("rank") <= n, spelled)).alias("retrieved"))
    return source_overlap(of("select item_id as question_id from benchmark")(spark, sf_dir).join(both, "question_id", "left"))


def overlaps(spark: SparkSession, sf_dir: str, *ns: int) -> list[DataFrame]:
    """overlap() for each number of best ones, from one search."""
    found = best_chunks(spark, sf_dir)
    return [overlap(spark, sf_dir, found, n) for n in ns]


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    (mine,) = overlaps(spark, sf_dir, 3)
    return gate(report(mine), regression(mine, mine))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = of("select conv_id * 100 + turn as key_id, conv_id, text from conversations where role = 'user'")(spark, sf_dir)
    return rows.select("key_id", "text", (F.col("conv_id") % 2).alias("k"), F.when(F.col("conv_id") % 5 == 0, "norms").alias("domain"), F.when(F.col("key_id") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("hints"))


def normative(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = of("select chunk_id, text as norm from v_norms")(spark, sf_dir)
    return best(spark, sf_dir, 8).join(texts, "chunk_id").withColumn("text", F.col("norm"))


def escalated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    n = F.col("conv_id") * 7 + F.col("turn")
    quality = F.element_at(F.array(*map(F.lit, ("good", "mixed", "poor", "empty"))), (n % 4 + 1).cast("int"))
    return rows.withColumns({"confidence": (n % 10).cast("double") / 10 + 0.02, "quality": quality, "answer": F.when(n % 5 == 0, F.concat(F.lit("no se menciona "), "answer")).when(n % 5 == 1, F.concat(F.lit("parcial "), "answer")).otherwise(F.col("answer"))})


QUERIES = {
    "authority_and_domain_boost": lambda s, d: boosts(pairs(s, d), of(LAYERS)(s, d), of(EXCLUSIONS)(s, d)),
    "threshold_with_fallback": lambda s, d: threshold(with_layers(s, d)),
    "neighbor_expansion": lambda s, d: neighbours(best(s, d, 3), of("select chunk_id, doc_id, page, chunk from v_chunks")(s, d), F.col("question_id") % 4 == 0),
    "assemble_context": lambda s, d: context(best(s, d, 5)),
    "consolidate_definitions": lambda s, d: definitions(normative(s, d)),
    "query_dedupe": lambda s, d: dedupe(asked(s, d)),
    "retrieval_stats": lambda s, d: stats(with_layers(s, d).where("rank <= 8")),
    "retrieval_quality": lambda s, d: quality(of("select item_id as question_id from benchmark")(s, d), stats(with_layers(s, d).where("rank <= 8"))),
    "page_lookup": lambda s, d: page_lookup(of("select * from v_questions")(s, d), of("select page, chunk_id from v_chunks")(s, d)),
    "source_overlap": lambda s, d: overlaps(s, d, 3)[0],
    "evaluation_report": lambda s, d: report(overlaps(s, d, 3)[0]),
    "baseline_regression": lambda s, d: regression(*overlaps(s, d, 6, 2)),
    "quality_gate": gated,
    "chunk_support": lambda s, d: support(turns(s, d)),
    "escalation_decision": lambda s, d: escalation(escalated(s, d)),
}

_L = f"l as ({LAYERS})"
_CD = f"d as (select c.*, case question_id % 3 when 0 then 'en' when 1 then 'fr' end as domain, l.layer, l.domain as sd from c left join l on l.source = c.source)"
_OV = lambda n: f"""
, e as (select question_id, list(distinct source) as expected from c where hits >= 8 group by question_id), g as (select question_id, list(source) as got from c where rank <= {n} group by question_id),
o as (select item_id as question_id, coalesce(len(expected), 0) as ne, coalesce(len(got), 0) as ng, least(coalesce(len(list_filter(got, lambda x: len(list_filter(expected, lambda y: contains(x, y) or contains(y, x))) > 0)), 0), coalesce(len(expected), 0)) as hits from benchmark left join e on e.question_id = item_id left join g on g.question_id = item_id),
r as (select question_id, ne as n_expected, hits as n_hits, case when ne = 0 then 1 else round(hits::double / ne, 4) end as recall, case when ne = 0 or ng = 0 then 0 else round(hits::double / ng, 4) end as precision_at_k from o)"""  # noqa: E731
_STATS = rf"""
, {_L}, {_CD}, x as (select *, list_distinct(regexp_extract_all(lower(question), '\p{{L}}{{4,}}')) as asked from d where rank <= 8), y as (select *, case when len(asked) > 0 then hits::double / len(asked) else 0 end as share from x),
st as (select question_id, count(*) as n, count(distinct source) as n_sources, round(avg(case when sd is not distinct from domain then 1 else 0 end), 4) as domain_match_ratio, round(avg(case when share >= 0.5 then 1 else 0 end), 4) as supported_ratio, round(max(share), 4) as max_coverage, max(hits) as top_score, arg_max(hits, rank) as bottom_score, max(hits) < 4 as all_below, bool_or(domain is not null) as has_domain from y group by question_id),
ts as (select question_id, source as top_source from (select question_id, source, count(*) as n from y group by 1, 2) z qualify row_number() over (partition by question_id order by n desc, source desc) = 1)"""
_SENT = r"string_split(regexp_replace(context, '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10))"
_LONG = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '\p{{L}}{{4,}}'), lambda w: length(w) >= 5))"
_TURNS = "a as (select conv_id, turn, role, text as answer, lag(text) over (partition by conv_id order by turn) as context, last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as question from conversations), n as (select * from a where role = 'assistant')"
SQL = {
    "authority_and_domain_boost": sql(f"""
, {_L}, {_CD}, p as (select question_id, chunk_id, hits, case when regexp_matches(lower(question), 'como|how|pasos') then case layer when 'guide' then 4 when 'manual' then 6 when 'other' then -5 else 0 end else case layer when 'law' then 8 when 'guide' then 4 when 'other' then -5 else 0 end end as layer_part,
 case when sd is null or domain is null then 0 when sd = domain then 12 else -30 end as domain_part, case when domain = 'en' and sd = 'fr' and not contains(lower(question), 'with') then -20 when domain = 'en' and sd = 'de' and not contains(lower(question), 'nunca') then -7 else 0 end as exclusion_part from d)
select question_id, chunk_id, layer_part, domain_part, exclusion_part, hits + layer_part + domain_part + exclusion_part as score from p"""),
    "threshold_with_fallback": sql(f"""
, {_L}, {_CD}, a as (select *, hits >= 4 as ok from d), b as (select * from a where ok or question_id not in (select question_id from a where ok)), e as (select *, sd is not distinct from domain as own, (sd is not distinct from domain) or hits >= 30 as fit from b),
f as (select * from e where fit or question_id not in (select question_id from e where fit)) select question_id, chunk_id, row_number() over (partition by question_id order by own desc, hits desc, chunk_id) as place from f"""),
    "neighbor_expansion": views.oracle(f"""
with c as ({CANDIDATES}), k as (select chunk_id, doc_id, page, row_number() over (partition by doc_id, page order by chunk) as nth from v_chunks), t as (select question_id, chunk_id from c where rank <= 3), p as (select t.question_id, k.doc_id, k.page, k.nth from t join k using (chunk_id))
select distinct p.question_id, k.chunk_id from p join k on k.doc_id = p.doc_id and ((k.page = p.page and abs(k.nth - p.nth) between 1 and case when p.question_id % 4 = 0 then 2 else 1 end) or (k.page = p.page + 1 and k.nth = 1 and p.nth <= 2))
where (p.question_id, k.chunk_id) not in (select (question_id, chunk_id) from t)"""),
    "assemble_context": sql("""
, p as (select question_id, rank, source || ' (pag. ' || page || ')' as label, trim(text) as text from c where rank <= 5), f as (select question_id, label, min(rank) as first from p group by 1, 2),
s as (select question_id, string_agg(label, '; ' order by first) as sources from f group by 1) select question_id, string_agg('[' || label || ']' || chr(10) || text, chr(10) || chr(10) order by rank) as context, any_value(sources) as sources from p join s using (question_id) group by question_id"""),
    "consolidate_definitions": views.oracle(rf"""
with c as ({CANDIDATES}), t as (select question_id, rank, n.text from c join v_norms n on n.chunk_id = c.chunk_id where rank <= 8), m as (select question_id, rank, unnest(regexp_extract_all(text, '\bC(?:1[0-3]?|[1-9])\s+[a-z][a-z ]{{2,40}}')) as m from t),
d as (select question_id, rank, regexp_extract(m, '^(C[0-9]+)', 1) as code, trim(regexp_extract(m, '^C[0-9]+\s+(.*)$', 1)) as meaning from m) select question_id, code, meaning from d qualify row_number() over (partition by question_id, code order by rank, meaning) = 1"""),
    "query_dedupe": rf"""
with q as (select conv_id * 100 + turn as key_id, conv_id % 2 as k, conv_id % 5 = 0 as d, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[.,;:!?¿¡()]+', ' ', 'g'), '\s+', ' ', 'g')) as t from conversations where role = 'user')
select key_id, min(key_id) over w as result_of, count(*) over w as n from q window w as (partition by t, k, d)""",
    "retrieval_stats": sql(_STATS + " select st.*, top_source from st join ts using (question_id)"),
    "retrieval_quality": sql(_STATS + " select item_id as question_id, case when n is null then 'empty' when all_below or (not has_domain and supported_ratio = 0 and max_coverage < 0.25) or (has_domain and domain_match_ratio < 0.34) then 'poor' when domain_match_ratio >= 0.67 or not has_domain then 'good' else 'mixed' end as quality from benchmark left join st on st.question_id = item_id"),
    "page_lookup": views.oracle("""
with q as (select question_id, try_cast(nullif(regexp_extract(lower(text), 'pag[.] ([0-9]+)', 1), '') as bigint) as page from v_questions), f as (select page, chunk_id, row_number() over (partition by page order by chunk_id) as rank from v_chunks qualify rank <= 20) select question_id, chunk_id, rank from q join f using (page)"""),
    "source_overlap": sql(_OV(3) + " select * from r"),
    "evaluation_report": sql(_OV(3) + " select count(*) as n, count(*) filter (n_expected > 0) as n_evaluable, round(avg(recall), 4) as avg_recall, round(avg(precision_at_k), 4) as avg_precision, round(avg(recall) filter (n_expected > 0), 4) as evaluable_recall from r"),
    "baseline_regression": sql(f"""
, e as (select question_id, list(distinct source) as x from c where hits >= 8 group by 1), k as (select question_id, len(x) as n, x from e), a as (select question_id, least(count(*) filter (rank <= 6 and len(list_filter(x, lambda y: contains(source, y) or contains(y, source))) > 0), any_value(n)) as six, least(count(*) filter (rank <= 2 and len(list_filter(x, lambda y: contains(source, y) or contains(y, source))) > 0), any_value(n)) as two, any_value(n) as n from c join k using (question_id) group by 1),
r as (select item_id as question_id, coalesce(round(two::double / n, 4) - round(six::double / n, 4), 0) as d from benchmark left join a on a.question_id = item_id) select question_id, round(d, 4) as delta, round(d, 4) < -0.01 as regressed from r"""),
    "quality_gate": sql(_OV(3) + " select round(avg(recall), 4) as avg_recall, round(avg(precision_at_k), 4) as avg_precision, 0 as n_regressed, round(avg(recall), 4) >= 0.4 and round(avg(precision_at_k), 4) >= 0.25 as passes from r"),
    "chunk_support": rf"""
with {_TURNS}, w as (select conv_id, turn, {_LONG('question')} as focus, {_LONG('answer')} as own, list_distinct(regexp_extract_all(answer, '[0-9]+')) as n1, list_distinct(regexp_extract_all(answer, '[A-Z]{{2,}}')) as l1, {_SENT} as ss from n),
s as (select *, unnest(case when len(ss) > 0 then ss else [''] end) as s from w), k as (select *, {_LONG('s')} as sw, regexp_extract_all(s, '[0-9]+') as n2, regexp_extract_all(s, '[A-Z]{{2,}}') as l2 from s)
select conv_id, turn, round(max(0.45 * case when len(focus) > 0 then len(list_intersect(focus, sw))::double / len(focus) else 0 end + 0.35 * case when len(own) > 0 then len(list_intersect(own, sw))::double / len(own) else 0 end + 0.1 * case when len(n1) > 0 and list_has_all(n2, n1) then 1 else 0 end + 0.1 * case when len(l1) > 0 and list_has_all(l2, l1) then 1 else 0 end), 4) as support from k group by conv_id, turn""",
    "escalation_decision": rf"""
with {_TURNS}, r as (select lower(strip_accents(question)) as q, length(question) as lq, lower(context) as ctx, conv_id * 7 + turn as m, (conv_id * 7 + turn) % 10 / 10.0::double + 0.02::double as c, lower(case when (conv_id * 7 + turn) % 5 = 0 then 'no se menciona ' || answer when (conv_id * 7 + turn) % 5 = 1 then 'parcial ' || answer else answer end) as low from n),
t as (select *, m % 4 < 2 as fine, greatest(0.5, round(0.65 - case when regexp_matches(q, '{COMPARISON}') or regexp_matches(q, '{SUMMARY}') or contains(q, 'tabla') then 0.08 when regexp_matches(q, '{LIST}') or regexp_matches(q, '{PROCEDURE}') then 0.06 when regexp_matches(q, '{DEFINITION}') then 0.04 else 0 end, 2))::double as lim from r),
k as (select case when regexp_matches(low, '{"|".join(UNSURE[:2])}') and fine then 'insufficient_with_context' when regexp_matches(low, '{PARTIAL}') and fine and c >= greatest(0.72, lim) then 'partial_high_confidence' when regexp_matches(ctx, '{QUALIFIER}') and not regexp_matches(low, '{QUALIFIER}') and fine and c >= greatest(0.7, lim) then 'missing_qualifiers'
 when not fine then 'none' when lq > 220 and c < lim then 'complex_low_confidence' when lim - c >= 0.05 and c <= 0.6 then 'low_confidence' else 'none' end as reason from t) select reason, count(*) as n, round(count(*)::double / sum(count(*)) over (), 4) as share from k group by reason""",
}

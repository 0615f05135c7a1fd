"""Validated memory: the single nearest stored answer of a question, and the gates that it must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views
from .listings import STOPWORDS
from .retrieval import knn_topk, tokens

#: A stored answer farther away is none, and questions must share this share of their words; fixed values.
MAX_DISTANCE, LEAST_SHARED = 0.6, 0.25
#: Answers under this route are lists of documents, which go out of date.
EXCLUDED = "document_inventory"
#: What stands before the answer in a stored text.
MARK = "Respuesta:"


def kept_words(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(STOPWORDS)))


def memory_lookup(queries: DataFrame, memory: DataFrame) -> DataFrame:
    """query_id, vec_id, distance, verdict, confidence, answer: for each query (query_id, q, question) the nearest of the memory (vec_id, embedding, question, route, stored).

    Only the nearest is looked at: if a gate rejects it, no other takes its place. The verdict is the first gate that
    does, by distance, route or words, or accepted; a question without words of its own passes the last. A query
    without a neighbour, or with a null vector, has no row.
    """
    best = knn_topk(queries.select("query_id", "q"), memory.select("vec_id", "embedding"), 1)
    asked = queries.select("query_id", kept_words(F.col("question")).alias("a"))
    known = memory.select("vec_id", "route", "stored", kept_words(F.col("question")).alias("b"))
    rows = best.join(asked, "query_id").join(known, "vec_id").withColumn("distance", F.round(1 - F.col("score"), 5))
    shared = F.size(F.array_intersect("a", "b")) >= LEAST_SHARED * F.size(F.array_union("a", "b"))
    verdict = F.when(F.col("distance").isNull() | (F.col("distance") > MAX_DISTANCE), "far").when(F.col("route").eqNullSafe(EXCLUDED), "route").when(~(shared | (F.size("a") == 0) | (F.size("b") == 0)), "words").otherwise("accepted")
    at = F.instr("stored", MARK)
    answer = F.trim(F.when(at > 0, F.substr("stored", at + len(MARK))).otherwise(F.col("stored")))
    taken = F.col("verdict") == "accepted"
    rows = rows.withColumn("verdict", verdict)
    return rows.select("query_id", "vec_id", "distance", "verdict", F.when(taken, F.round(F.greatest(F.lit(0.9), 1 - F.col("distance")), 4)).alias("confidence"), F.when(taken, answer).alias("answer"))


#: Documents stand for stored questions; an even one has its answer behind the mark.
STORED = f"select vec_id, embedding, text as question, case vec_id % 7 when 0 then '{EXCLUDED}' when 1 then cast(null as string) else 'knowledge' end as route, case when vec_id % 2 = 0 then concat('Pregunta: x. {MARK} ', source, ' ') else source end as stored from embeddings left join documents on doc_id = vec_id"


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set, every vector whose id is divisible by 100, against all."""
    stored = views.run(spark, sf_dir, STORED)
    return memory_lookup(stored.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as q", "question"), stored)


QUERIES = {"memory_lookup": lookup}

_WORDS = lambda c: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '\p{{L}}{{4,}}'), lambda w: w not in ({', '.join(repr(w) for w in STOPWORDS)})))"
SQL = {
    "memory_lookup": views.oracle(f"""
with m as ({STORED}), s as (select q.vec_id as query_id, v.vec_id, q.question as asked, v.question, v.route, v.stored, round(1 - round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5), 5) as distance from m q join m v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
b as (select * from s qualify row_number() over (partition by query_id order by distance, vec_id) = 1), w as (select *, {_WORDS("asked")} as x, {_WORDS("question")} as y from b),
g as (select *, case when distance > {MAX_DISTANCE} then 'far' when route = '{EXCLUDED}' then 'route' when len(x) > 0 and len(y) > 0 and len(list_intersect(x, y)) < {LEAST_SHARED} * len(list_distinct(list_concat(x, y))) then 'words' else 'accepted' end as verdict from w)
select query_id, vec_id, distance, verdict, case when verdict = 'accepted' then round(greatest(0.9, 1 - distance), 4) end as confidence, case when verdict = 'accepted' then trim(case when contains(stored, '{MARK}') then split_part(stored, '{MARK}', 2) else stored end) end as answer from g"""),
}

"""Retrieval as batch jobs: questions are a table, matched with chunks by BM25 over an inverted index and by vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..streaming.streams import shared_folder
from . import inverted

#: Bytes of question vectors that are broadcast at most; beyond it questions go in blocks.
MAX_BROADCAST = 64 << 20
#: Vectors of a pack, queries of one, places of a score.
VECTORS, QUERIES_AT_ONCE, PLACES = 2048, 512, 5


def tokens(text: Column) -> Column:
    """Runs of four letters or more, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), 1)


def bm25_topk(questions: DataFrame, chunks: DataFrame, k: int = 5, cap: int = 2) -> DataFrame:
    """For each question the best k chunks, at most cap of a source: question_id, chunk_id, source, score, rank.

    BM25 has no document frequency; the average length is over a question's candidates, which are the chunks that share
    a token with it. Chunks are indexed first; see inverted.py for how blocks are searched and skipped.
    """
    path = f"{shared_folder(chunks.sparkSession)}/inverted-{uuid.uuid4().hex}"
    index = inverted.build_index(chunks, tokens, "chunk_id", ["source"], path)
    best = index.search(questions, tokens(F.col("text")), inverted.bm25, k, cap, "source", with_means=True)
    return best.select("question_id", "row.chunk_id", "row.source", F.round(F.col("points") / 10**inverted.PLACES, inverted.PLACES).alias("score"), "rank")


def pack(rows: DataFrame, id_: str, vector: str, extra: list[str], name: str, size: int) -> DataFrame:
    """rows in packs of size at most: the column `name`, an array of the id, the vector and the extra columns, and only, the id of a pack of one and else the name."""
    fields = F.struct(F.col(id_).alias("id"), F.col(vector).alias("v"), *extra)
    narrow = rows.select(fields.alias("x")).select("x.*")
    schema = StructType().add(name, ArrayType(narrow.schema)).add(f"{name}_only", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                values = pa.StructArray.from_arrays([pa.concat_arrays([c]) for c in b.columns], names=b.schema.names)
                only = str(b.column("id")[0].as_py()) if b.num_rows == 1 else name
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), values), pa.array([only])], names=[name, f"{name}_only"])

    return narrow.mapInArrow(run, schema)


def every_pair(queries: DataFrame, vectors: DataFrame, asked: list[str], known: list[str]) -> DataFrame:
    """Packs of queries (query_id, q, asked) with packs of vectors (vec_id, embedding, known): each query meets each vector; but for its own, which a pack of one is not joined with.

    Queries are broadcast in blocks of about MAX_BROADCAST bytes.
    """
    size = queries.agg(F.sum(F.greatest(F.coalesce(F.size("q"), F.lit(0)), F.lit(0)).cast("long") * 8 + 64)).first()[0] or 0
    n = max(-(-size // MAX_BROADCAST), 1)
    packed, out = pack(vectors, "vec_id", "embedding", known, "vectors", VECTORS), None
    for i in range(n):
        block = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        part = packed.join(F.broadcast(pack(block, "query_id", "q", asked, "queries", QUERIES_AT_ONCE)), F.col("vectors_only") != F.col("queries_only"))
        out = part if out is None else out.unionByName(part)
    return out


def matrix(vectors: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of n numbers as rows, and which are usable: not null, of that length, without null or infinite numbers, and not zero."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), n), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), n))
    out[fits] = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(fits.sum()), n)
    good = fits & np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    out[~good] = 0
    return out, good


def rounded(x: np.ndarray) -> np.ndarray:
    """Whole units of the last place, half up by the shortest decimal of a number, as Spark rounds."""
    scaled = x * 10**PLACES
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(PLACES).quantize(Decimal(1), ROUND_HALF_UP))
    return out.astype(np.int64)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The cosine of each row with the other's; products are added one by one, so that it does not depend on how rows are packed."""
    total = lambda a, b: reduce(lambda s, i: s + a[:, i] * b[:, i], range(a.shape[1]), np.zeros(len(a)))
    return total(q, v) / (np.sqrt(total(q, q)) * np.sqrt(total(v, v)))


def best_pairs(k: int, kinds: list[tuple[Callable | None, float | None]]) -> Callable:
    def best(q: pa.StructArray, v: pa.StructArray, kind: int) -> Iterator[pa.RecordBatch]:
        allow, least = kinds[kind]
        ids, known = q.field("id"), v.field("id")
        order = pc.sort_indices(known)
        v, known = v.take(order), known.take(order)
        met = np.ones((len(q), len(v)), bool) if allow is None else allow(q, v)
        met &= np.array(ids.to_pylist(), object)[:, None] != np.array(known.to_pylist(), object)[None, :] if ids.type != pa.int64() else ids.to_numpy()[:, None] != known.to_numpy()[None, :]
        lengths = pc.list_value_length(q.field("v")).to_pylist()
        for n in dict.fromkeys(lengths):
            rows = np.flatnonzero(np.array([x == n for x in lengths]) & met.any(axis=1))
            if not len(rows):
                continue
            a, a_good = matrix(q.field("v").take(pa.array(rows)), n or 0)
            b, b_good = matrix(v.field("v"), n or 0)
            unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
            near = np.where(met[rows] & a_good[:, None] & b_good[None, :], unit(a) @ unit(b).T, -np.inf)
            top = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
            # what cannot be told apart from the last of the best is scored exactly
            i, j = np.nonzero((near >= top[:, None] - 3 * 10.0**-PLACES) & (near > -np.inf) & (True if least is None else near >= least - 3 * 10.0**-PLACES))
            units = rounded(cosines(a[i], b[j]))
            if least is not None:
                i, j, units = (x[units >= round(least * 10**PLACES)] for x in (i, j, units))
            by = np.lexsort((j, -units, i))
            i, j, units = i[by], j[by], units[by]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, units = i[nth < k], j[nth < k], units[nth < k]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[i])), known.take(pa.array(j)), pa.array(units / 10**PLACES), pa.array(np.full(len(i), kind, np.int32))], names=["query_id", "vec_id", "score", "kind"])
            if least is None:  # pairs without a cosine come last, if there are too few others
                few = np.flatnonzero((near > -np.inf).sum(axis=1) < k)
                for r in few.tolist():
                    rest = np.flatnonzero(met[rows[r]] & (near[r] == -np.inf))[:k]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([rows[r]] * len(rest), pa.int64())), known.take(pa.array(rest)), pa.nulls(len(rest), pa.float64()), pa.array([kind] * len(rest), pa.int32())], names=["query_id", "vec_id", "score", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column("queries")[i].values, batch.column("vectors")[i].values
                for kind in range(len(kinds)):
                    yield from best(q, v, kind)

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, kinds: list[tuple[Callable | None, float | None]], asked: list[str] = (), known: list[str] = ()) -> DataFrame:
    """query_id, vec_id, score, kind: for each kind of neighbour the k nearest by cosine of each query (query_id, q), in each pack of vectors (vec_id, embedding).

    A kind is a function of a pack of queries and one of vectors (with the columns asked and known), which says as a
    matrix of booleans who meets whom, and the least score; None for all. Packs are multiplied as matrices, and what comes
    near the best is scored again, exactly, so that scores are those of the plain formula. A pair without a cosine (null,
    zero or of another length) has a null score and comes last. What leaves a task are k rows of a query and pack.
    """
    pairs = every_pair(queries.select("query_id", "q", *asked), vectors.select("vec_id", "embedding", *known), list(asked), list(known))
    types = (queries.schema["query_id"].dataType, vectors.schema["vec_id"].dataType)
    return pairs.mapInArrow(best_pairs(k, kinds), StructType().add("query_id", types[0]).add("vec_id", types[1]).add("score", "double").add("kind", "integer"))


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest vectors by cosine of each query (query_id, q): query_id, vec_id, score, rank. The queries' vectors are a stated, bounded set."""
    return ranked(nearest(queries, vectors, k, [(None, None)]).drop("kind"), k)


def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as question_id", "text")
    return bm25_topk(questions, spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as chunk_id", "source", "text"))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn_topk(v.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as q"), v.select("vec_id", "embedding"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return t.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(tokens(F.col("text")), " ").alias("joined"))


QUERIES = {"answer_questions": answer_questions, "knn_topk": knn, "tokenize": tokenize}

_TOK = r"regexp_extract_all(lower({0}), '\p{{L}}{{4,}}')"
SQL = {
    "answer_questions": f"""
with asked as (select item_id as question_id, unnest(list_distinct({_TOK.format("text")})) as token from benchmark),
words as (select doc_id as chunk_id, source, len({_TOK.format("text")}) as n, unnest({_TOK.format("text")}) as token from documents),
counted as (select chunk_id, source, n, token, count(*) as tf from words group by all),
hits as (select * from asked join counted using (token)),
m as (select question_id, avg(n) as mean from (select distinct question_id, chunk_id, n from hits) group by 1),
scored as (select question_id, chunk_id, source, round(sum(tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / mean))), 5) as score from hits join m using (question_id) group by 1, 2, 3),
capped as (select * from scored qualify row_number() over (partition by question_id, source order by score desc, chunk_id) <= 2)
select question_id, chunk_id, source, score, row_number() over (partition by question_id order by score desc, chunk_id) as rank from capped qualify rank <= 5""",
    "knn_topk": """
select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5) desc, v.vec_id) as rank
from embeddings q join embeddings v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id qualify rank <= 5""",
    "tokenize": f"select doc_id, len({_TOK.format('text')}) as n_tokens, array_to_string({_TOK.format('text')}, ' ') as joined from documents",
}

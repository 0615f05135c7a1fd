"""Vector retrieval, chunk packing and publishing: operators that need more than one query text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .retrieval import nearest, ranked

#: Vectors that cells are fitted on, queries of the sample that the number of cells to look at is found with, cells at most, rounds of fitting.
SAMPLE, TRIED, MAX_CELLS, ROUNDS = 20_000, 256, 4096, 8
#: Score that a neighbour of the query's own domain must have.
LEAST = 0.5
#: Characters of a chunk, characters shared with the one before, and the shortest chunk that is kept.
CHUNK, OVERLAP, SHORTEST = 450, 90, 80
#: Chunks that leave a task at once; all that it holds of them.
CHUNKS_AT_ONCE = 2000
#: How far a cut may move to the end of a sentence, and to a space.
SENTENCE, SPACE = 120, 80


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


class Cells:
    """Cells around centres, fitted on a bounded sample, and how many a query must look at for the recall wanted."""

    def __init__(self, sample: np.ndarray, n: int, k: int, recall: float) -> None:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng = np.random.default_rng(0)
        count = max(1, min(int(n**0.5), MAX_CELLS, len(unit) // 4))
        centres = unit[rng.choice(len(unit), count, replace=False)]
        for _ in range(ROUNDS):
            cell = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, unit)
            centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centres)
            centres /= np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = centres
        # nearest neighbours in the sample are farther apart than in the whole, so the whole has this recall at least
        asked = unit[:TRIED]
        score = asked @ unit.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -2
        near = np.argsort(-score, axis=1)[:, :k]
        cell = (unit @ centres.T).argmax(axis=1)
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)  # of each centre for each query
        needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
        self.probes = int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1 if len(needed) else 1

    def of(self, rows: DataFrame, vector: str, probes: int) -> DataFrame:
        """rows with the numbers of their nearest cells, an array; null vectors and those without a direction are left out."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for b in batches:
                x = np.stack([np.asarray(v, np.float64) for v in b.column(vector).to_pylist()]) if b.num_rows else np.zeros((0, centres.shape[1]))
                near = x @ centres.T
                cells = (near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1)[:, :probes]).astype(np.int32)
                yield b.append_column("cells", pa.array(list(cells), pa.list_(pa.int32())))

        rows = rows.where(F.col(vector).isNotNull() & (dot(F.col(vector), F.col(vector)) > 0))
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("cells", ArrayType(IntegerType()))]))


def ann_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, recall: float = 0.95) -> DataFrame:
    """About the k nearest vectors by cosine of each query (query_id, q): query_id, vec_id, score, rank.

    Vectors go to one cell each, as many as the square root of their number (MAX_CELLS at most); a query meets
    those of the nearest cells, so many that the sample's own queries find this share of their neighbours.
    Cells are fitted on SAMPLE vectors, every vector is in one. Candidates are scored exactly. Null vectors are left out.
    """
    some = vectors.where(F.col("embedding").isNotNull() & (dot(F.col("embedding"), F.col("embedding")) > 0))
    sample = [r[0] for r in some.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE).collect()]
    if len(sample) < 2:
        return queries.select("query_id").join(vectors.select("vec_id"), F.lit(False)).select("query_id", "vec_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    cells = Cells(np.array(sample, np.float64), some.count(), k, recall)
    near, placed = cells.of(queries.select("query_id", "q"), "q", cells.probes), cells.of(vectors.select("vec_id", "embedding"), "embedding", 1)
    # vectors of a cell come together, so that a pack has few cells
    placed = placed.withColumn("cell", F.get("cells", F.lit(0))).repartitionByRange("cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    return ranked(nearest(near, placed, k, [(in_cells, None)], ["cells"], ["cell"]).drop("kind"), k)


def in_cells(queries: pa.StructArray, vectors: pa.StructArray) -> np.ndarray:
    """Whether a query looks at the cell of a vector."""
    cell, probed = vectors.field("cell").to_numpy(), queries.field("cells")
    seen, at = np.unique(cell, return_inverse=True)
    wanted = probed.flatten().to_numpy()
    row = np.repeat(np.arange(len(queries)), pc.list_value_length(probed).to_numpy())
    place = np.minimum(np.searchsorted(seen, wanted), len(seen) - 1)
    looks = np.zeros((len(queries), len(seen)), bool)
    looks[row[seen[place] == wanted], place[seen[place] == wanted]] = True
    return looks[:, at]


def boundary(text: str, start: int, end: int) -> int:
    """Where a chunk that starts at start and may reach end is cut: a paragraph's end, a sentence's, a space, or end."""
    if end >= len(text):
        return len(text)
    at = text.rfind("\n\n", start + 1, end)
    if at > start + OVERLAP:
        return at + 2
    stops = [i for i in range(end, min(end + SENTENCE, len(text))) if text[i] in ".!?"] or [i for i in range(end - 1, max(end - SENTENCE, start + OVERLAP), -1) if text[i] in ".!?"]
    if stops:
        return stops[0] + 1
    spaces = [i for i in range(max(end - SPACE, start + OVERLAP + 1), min(end + SPACE, len(text))) if text[i] == " "]
    return min(spaces, key=lambda i: abs(i - end)) + 1 if spaces else end


def pieces(text: str | None) -> Iterator[tuple[int, str]]:
    """Start and text of each chunk."""
    start, text = 0, text or ""
    while start < len(text):
        end = boundary(text, start, start + CHUNK)
        if end - start >= SHORTEST:
            yield start, text[start:end]
        if end >= len(text):
            return
        start = max(end - OVERLAP, start + 1)


def chunk_structured(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts: doc_id, chunk, start, text. Null and short texts have none. Documents do not depend on each other, so no shuffle."""

    def chunked(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
        rows: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
        for batch in batches:
            for d, text in zip(batch["doc_id"], batch["text"]):
                for n, (s, t) in enumerate(pieces(text.as_py())):
                    rows.append((d.as_py(), n, s, t))
                    if len(rows) == CHUNKS_AT_ONCE:
                        yield give()
                        rows.clear()
        yield give()

    return docs.select("doc_id", "text").mapInArrow(chunked, "doc_id long, chunk long, start long, text string")


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, every vector whose id is divisible by 100, and all vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label")), v


def ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_topk(*asked(spark, sf_dir))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of the query's own domain that are close enough; a query with none is asked again without the filter."""
    q, v = asked(spark, sf_dir)
    best = nearest(q, v, 5, [(same_label, LEAST), (None, None)], ["q_label"], ["label"]).withColumn("filtered", F.col("kind") == 0)
    best = best.withColumn("found", F.bool_or("filtered").over(Window.partitionBy("query_id"))).where("filtered = found")
    return ranked(best.select("query_id", "vec_id", "score", "filtered"), 5)


def same_label(queries: pa.StructArray, vectors: pa.StructArray) -> np.ndarray:
    code = pa.concat_arrays([queries.field("q_label"), vectors.field("label")]).dictionary_encode().indices
    code = pc.fill_null(code, -1).to_numpy()
    a, b = code[: len(queries), None], code[None, len(queries) :]
    return (a == b) & (a >= 0)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_structured(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"ann_topk": ann, "filtered_search_fallback": filtered, "chunk_structured": chunks}

COSINE = "round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 5)"
SQL = {
    "chunk_structured": rf"""
with recursive d as (select doc_id, text as t, length(text) as n from documents where text <> ''),
c as (select doc_id, t, n, -1::bigint as s, 0::bigint as e from d
 union all
 select doc_id, t, n, s, case when s + {CHUNK} >= n then n when par > 0 and s + par > s + {OVERLAP} then s + par + 2 when aft <> '' then s + {CHUNK} + length(aft) when bef <> '' then low + length(bef) when sl is null and sr is null then s + {CHUNK} when sr is null or (sl is not null and s + {CHUNK} - sl <= sr - s - {CHUNK}) then sl + 1 else sr + 1 end as e
 from (select *, case when regexp_matches(r1, '^.*\n\n', 's') then 1 + length(regexp_extract(r1, '^(.*)\n\n', 1, 's')) else 0 end as par, regexp_extract(substr(t, s + {CHUNK} + 1, {SENTENCE}), '^[^.!?]*[.!?]') as aft, regexp_extract(substr(t, low + 1, s + {CHUNK} - low), '^.*[.!?]', 0, 's') as bef,
  case when contains(r2, ' ') then slow + length(regexp_extract(r2, '^(.*) ', 1, 's')) end as sl, case when contains(r3, ' ') then s + {CHUNK} + length(regexp_extract(r3, '^[^ ]*')) end as sr
  from (select *, substr(t, s + 2, {CHUNK} - 1) as r1, s + {CHUNK} - {SENTENCE} + 1 as low, s + {CHUNK} - {SPACE} as slow, substr(t, s + {CHUNK} - {SPACE} + 1, {SPACE}) as r2, substr(t, s + {CHUNK} + 1, {SPACE}) as r3 from (select doc_id, t, n, greatest(e - {OVERLAP}, s + 1) as s from c where e < n) w) x) y)
select doc_id, row_number() over (partition by doc_id order by s) - 1 as chunk, s as start, substr(t, s + 1, e - s) as text from c where s >= 0 and e - s >= {SHORTEST}""",
    "filtered_search_fallback": f"""
with s as (select q.vec_id as query_id, v.vec_id, q.label = v.label as same, {COSINE} as score from embeddings q join embeddings v on q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
f as (select query_id, bool_or(same and score >= 0.5) as found from s group by 1)
select query_id, vec_id, score, found as filtered, row_number() over (partition by query_id order by score desc, vec_id) as rank from s join f using (query_id) where (found and same and score >= 0.5) or not coalesce(found, false) qualify rank <= 5""",
}

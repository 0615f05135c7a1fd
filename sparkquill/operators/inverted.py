"""An inverted index in blocks of documents, and searches that skip blocks which cannot reach a question's best.

A block holds some documents of about the same length: their words, for each word a posting list (documents and
frequencies) with the largest frequency and the largest share of a document's words, and the documents' lengths. A
search gives every task some blocks and all questions, which are broadcast in parts of bounded size; a task keeps the
best of each question, so that what leaves it grows with the number of results, not with the lists of common words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

#: Documents and words of a block at most (a longer document is a block by itself).
BLOCK_DOCS, BLOCK_WORDS = 1024, 1 << 20
#: Ranges of documents for each shuffle partition.
RANGES = 4
#: Bytes of questions' words that are broadcast at once.
QUESTION_BYTES = 16 << 20
K1, B = 1.5, 0.75
#: Scores are compared in whole parts of a unit, as they are given.
PLACES = 5
LISTS = "lengths binary, words array<string>, starts binary, docs binary, tfs binary, top_tf binary, top_share binary"


def pack(rows: pa.RecordBatch, key: str, words: pa.Array) -> dict:
    """One block: its documents in the order of their key, and posting lists."""
    order = pc.sort_indices(rows, sort_keys=[(key, "ascending")])
    rows, words = rows.take(order), words.take(order)
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(lengths) + doc, return_counts=True)
    docs, starts = at % max(len(lengths), 1), np.searchsorted(at // max(len(lengths), 1), np.arange(len(coded.dictionary) + 1))
    top = lambda v: np.maximum.reduceat(v, starts[:-1]) if len(v) else v
    arrays = {"lengths": lengths, "starts": starts.astype(np.int64), "docs": docs.astype(np.int32), "tfs": tf.astype(np.int32), "top_tf": top(tf).astype(np.int64), "top_share": top(tf / lengths[docs])}
    return {"rows": rows.to_pylist(), "words": coded.dictionary.to_pylist(), **{n: a.tobytes() for n, a in arrays.items()}}


def pack_blocks(schema: pa.Schema, key: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("__words")), 0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_WORDS, "right"))
                hi = max(lo + 1, min(hi, lo + BLOCK_DOCS))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_pylist([pack(part.drop_columns(["__words"]), key, part.column("__words"))], schema=schema)
                lo = hi

    return run


def build_index(docs: DataFrame, tokens: Callable[[Column], Column], key: str, carried: list[str], path: str, text: str = "text") -> InvertedIndex:
    """Writes an index of docs by the words of their texts, as tokens() gives them; key and the carried columns are what results have of a document.

    Documents without a text or without a key are left out. They are sorted into ranges by the lengths
    of their texts, in one shuffle of the texts; ranges are finer than partitions, as the last ones have most words.
    """
    rows = docs.select(key, *carried, F.col(text).alias("__text")).where(F.col("__text").isNotNull() & F.col(key).isNotNull())
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.octet_length("__text"), key).sortWithinPartitions(F.octet_length("__text"), key)
    rows = rows.withColumn("__words", tokens(F.col("__text"))).drop("__text")
    schema = StructType().add("rows", ArrayType(rows.drop("__words").schema))
    schema = StructType([*schema.fields, *StructType.fromDDL(LISTS).fields])
    rows.mapInArrow(pack_blocks(to_arrow_schema(schema), key), schema).write.parquet(path)
    return InvertedIndex(docs.sparkSession, path, key)


class Block:
    """A block as a search reads it."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        of = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)
        self.rows, self.words = batch.column("rows")[i].values, batch.column("words")[i].values
        self.lengths, self.starts, self.docs, self.tfs = of("lengths", "i8"), of("starts", "i8"), of("docs", "i4"), of("tfs", "i4")
        self.top_tf, self.top_share = of("top_tf", "i8"), of("top_share", "f8")

    def postings(self, lists: np.ndarray) -> np.ndarray:
        """Places of the postings of some lists, one list after the other."""
        counts = self.starts[lists + 1] - self.starts[lists]
        ends = np.cumsum(counts)
        return np.arange(ends[-1]) + np.repeat(self.starts[lists] - np.append(0, ends[:-1]), counts)


def found(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, questions: list) -> Iterator[tuple[Block, int, np.ndarray]]:
    """Each block with each question that has words in it, and the lists of those."""
    for b in batches:
        for i in range(b.num_rows):
            block = Block(b, i)
            at = pc.fill_null(pc.index_in(vocabulary, value_set=block.words), -1).to_numpy().astype(np.int64)
            for n, words in enumerate(questions):
                lists = at[words]
                if (lists >= 0).any():
                    yield block, n, lists[lists >= 0]


@dataclass
class Best:
    """The best of a question so far, at most cap of a group."""

    k: int
    cap: int
    kept: list[tuple] = field(default_factory=list)

    def least(self) -> int:
        """What a document must reach."""
        return -self.kept[-1][0] if len(self.kept) == self.k else 0

    def add(self, entries: Iterator[tuple]) -> None:
        """entries: (minus the points, key, group, row), the best first."""
        groups: dict = {}
        new: list[tuple] = []
        for e in entries:
            if len(new) == self.k or (len(self.kept) == self.k and e[:2] > self.kept[-1][:2]):
                break
            groups[e[2]] = groups.get(e[2], 0) + 1
            if groups[e[2]] <= self.cap:
                new.append(e)
        groups, both = {}, []
        for e in sorted([*self.kept, *new], key=lambda e: e[:2]):
            groups[e[2]] = groups.get(e[2], 0) + 1
            if groups[e[2]] <= self.cap:
                both.append(e)
        self.kept = both[: self.k]


def points(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 10**PLACES + 0.5).astype(np.int64)


def bm25(block: Block, lists: np.ndarray, mean: float) -> tuple[int, Callable[[], np.ndarray]]:
    """What a document of the block can reach at most, and a function that gives what each has."""
    weight = lambda length: K1 * (1 - B + B * length / mean)
    bound = (K1 + 1) / (1 + K1 * (1 - B) / block.top_tf[lists] + K1 * B / (mean * block.top_share[lists]))

    def scores() -> np.ndarray:
        at = block.postings(lists)
        doc, tf = block.docs[at], block.tfs[at]
        return points(np.bincount(doc, tf * (K1 + 1) / (tf + weight(block.lengths[doc])), len(block.lengths)))

    return int(points(bound.sum())) + 1, scores


def shared_words(block: Block, lists: np.ndarray, _: float) -> tuple[int, Callable[[], np.ndarray]]:
    return len(lists), lambda: np.bincount(block.docs[block.postings(lists)], minlength=len(block.lengths))


def lengths_of_found(asked: Broadcast) -> Callable:
    """How many documents have a word of each question, and how many words they have in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, questions, _ = asked.value
        n, total = np.zeros(len(questions), np.int64), np.zeros(len(questions), np.int64)
        for block, q, lists in found(batches, vocabulary, questions):
            has = np.zeros(len(block.lengths), bool)
            has[block.docs[block.postings(lists)]] = True
            n[q] += has.sum()
            total[q] += block.lengths[has].sum()
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some])], names=["q", "n", "total"])

    return run


def best_of_found(asked: Broadcast, scorer: Callable, k: int, cap: int, key: str, group: str | None, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, questions, means = asked.value
        best = [Best(k, cap) for _ in questions]
        seen, keys, groups = None, None, None
        for block, q, lists in found(batches, vocabulary, questions):
            bound, scores = scorer(block, lists, means[q])
            if bound < best[q].least():
                continue
            if block is not seen:
                seen, keys = block, block.rows.field(key)
                groups = block.rows.field(group) if group else None
            have = scores()
            docs = np.flatnonzero((have > 0) & (have >= best[q].least()))
            docs = docs[np.argsort(-have[docs], kind="stable")]  # documents of a block stand in the order of their key
            best[q].add((-int(have[d]), keys[d].as_py(), groups[d].as_py() if group else d, block.rows[d]) for d in docs.tolist())
        out = [{"q": q, "points": -e[0], "row": e[3].as_py()} for q, x in enumerate(best) for e in x.kept]
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


class InvertedIndex:
    """An index that build_index() has written; key is the column that documents are told apart by."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, questions: DataFrame, words: Column, scorer: Callable, k: int, cap: int | None = None, group: str | None = None, with_means: bool = False) -> DataFrame:
        """question_id, points, row (of the documents), rank: the best k of each question by points and key, at most cap of a group.

        questions: question_id and words, an array; words that repeat count once, questions that repeat are different
        questions. Each part of the questions of QUESTION_BYTES goes through the driver to all tasks.
        """
        asked = questions.select("question_id", F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))).alias("words"))
        size = asked.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 64)).first()[0] or 0
        parts = max(-(-size // QUESTION_BYTES), 1)
        out = None
        for i in range(parts):
            part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == i)
            ranked = self.search_part(part, scorer, k, cap, group, with_means)
            out = ranked if out is None else out.unionByName(ranked)
        return out

    def search_part(self, asked: DataFrame, scorer: Callable, k: int, cap: int | None, group: str | None, with_means: bool) -> DataFrame:
        blocks, rows = self.blocks(), asked.collect()
        vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for r in rows for w in r.words))}
        words = [np.array([vocabulary[w] for w in r.words], np.int64) for r in rows]
        means = [0.0] * len(rows)
        share = lambda: self.spark.sparkContext.broadcast((pa.array(list(vocabulary), pa.string()), words, means))
        if with_means:
            for r in blocks.mapInArrow(lengths_of_found(share()), "q int, n long, total long").groupBy("q").agg(F.sum("n"), F.sum("total")).collect():
                means[r[0]] = r[2] / r[1]
        row = blocks.schema["rows"].dataType.elementType
        schema = StructType.fromDDL("q int, points long").add("row", row)
        best = blocks.mapInArrow(best_of_found(share(), scorer, k, cap or k, self.key, group, to_arrow_schema(schema)), schema)
        if group:
            in_group = Window.partitionBy("q", f"row.{group}").orderBy(F.desc("points"), f"row.{self.key}")
            best = best.withColumn("nth", F.row_number().over(in_group)).where(F.col("nth") <= cap)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("points"), f"row.{self.key}"))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        ids = self.spark.createDataFrame([(n, r.question_id) for n, r in enumerate(rows)], StructType.fromDDL("q int").add("question_id", asked.schema["question_id"].dataType))
        return best.join(F.broadcast(ids), "q").select("question_id", "points", "row", "rank")

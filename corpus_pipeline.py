"""A corpus pipeline of five stages, each one of the operators: documents in, sharded training rows out.

Rows without a doc_id are known by a number made from their text, above all real ids, so that copies
among them are copies too. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from sparkquill.llm.queries import mix_path, mix_weight, n_words, table
from sparkquill.llm.shared import Scratch, stage, without

#: Share of the tokens there are that the mixture has, and how often it may repeat a document.
MIX_TOTAL, MIX_EPOCHS, SEED = 0.9, 2, 7
SHARDS = 40
#: SQL has no learned decision list, so the stages are tested against a brute-force version.
ORACLE_SQL = None


def row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + text_hash().bitwiseAND(F.lit((1 << 61) - 1)))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from labels."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("row"), "text")
    return quality_rules.apply_rules(whole, rules).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents joined by similarities of 0.8 or more, in shingles of five words, the one with the smallest key.

    Rows are told apart by key and text: two texts of one id stay unless they are similar, and of rows
    equal in both one stays. Documents without words stay. Only numbers are shuffled, as long as those
    of the removed rows are few enough to broadcast.
    """
    scratch = Scratch(spark)
    found = scratch.stage(ngram_join.similar_groups(docs, row_key(), k=5, num=80, den=100), "groups")
    rows = found.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.first("group").alias("group"))
    keepers = rows.groupBy("group").agg(F.min(F.struct("doc_id", "tkey")).alias("k")).select("k.*")
    gone = stage(rows.select("doc_id", "tkey").join(keepers, ["doc_id", "tkey"], "left_anti"), "gone")
    again = stage(rows.where("n > 1").join(keepers, ["doc_id", "tkey"], "left_semi").select("doc_id", "tkey"), "again")
    scratch.drop("groups")
    keys = [row_key(), text_hash()]
    if again.isEmpty():
        return without(docs, keys, gone)
    once = without(docs, keys, gone.unionByName(again))
    copies = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in zip(again.columns, keys))).join(again, again.columns, "left_semi")
    return once.unionByName(copies.groupBy(again.columns).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, nor one with other numbers, names or units."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture's proportions; a document that two epochs take is there twice."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang", "source")
    return mixing.mix(whole, mix_path(), n_words(), mix_weight, MIX_TOTAL, MIX_EPOCHS, SEED, key=row_key()).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents along a Hilbert curve over source, language and length, cut into SHARDS runs of equal row counts."""
    return sharding.hilbert_shards(docs, "doc_id", ["source", "lang", "n_chars"], SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

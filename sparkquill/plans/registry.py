"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import business, chunks, closings, context_swap, corpus, evaluation, listings, maintenance, memory, metadata, questions, relational, relevance, retrieval, scoring, selection, vectors
from ..sources import views
from ..streaming import streams

FLAGSHIP = "answer_questions"
#: Modules whose queries and SQL are written apart.
MODULES = (retrieval, vectors, scoring, relevance, context_swap, chunks, metadata, questions, evaluation, selection, business, listings, memory, closings, maintenance, streams)
#: Queries whose one text serves Spark and the SQL that checks it.
SHARED = relational.QUERIES | corpus.QUERIES


def ask(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.run(spark, sf_dir, spark_text(text))


def spark_text(text: str) -> str:
    """Names that Spark has for what another engine calls differently."""
    return text.replace("sha256(", "sha2_256(").replace("sha2_256(concat('v1|', text))", "sha2(concat('v1|', text), 256)").replace("cardinality_of(", "size(")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: partial(ask, text) for name, text in SHARED.items()}
    for m in MODULES:
        found |= m.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: views.oracle(text).replace("cardinality_of(", "len(") for name, text in SHARED.items()}
    for m in MODULES:
        found |= m.SQL
    return found

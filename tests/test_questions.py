"""Questions held against their SQL on rows made for them."""

import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkquill.operators import questions
from sparkquill.plans import registry

from .oracle import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["query_intent", "query_profile"])
def test_a_letter_of_any_script_is_part_of_a_word(spark, tmp_path, name):
    """ßa ends in no unit of its own, and ßlista is no list."""
    for t in os.listdir(SMALL):
        if t != "conversations.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    texts = ["Straßa mit 3 Leuten", "ein ßlista", "groß a 3", "pag. 4ß", "resumenß", "cuandoß", "die tabla 3ß", "como puedeß", "versus", "a 3"]
    rows = [(2 * i, j, "user", t) for i, t in enumerate(texts) for j in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    assert compare(spark, str(tmp_path), registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_fields_of_questions_that_share_an_id(spark, tmp_path):
    """Each question is read with its own year and quarter, also where ids repeat or are null."""
    for t in os.listdir(SMALL):
        if t != "conversations.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    texts = ["importe total de 1998", "hola 1995", "seccion", "seccion y cliente", "trimestre 1", "nada del trimestre 3"]
    rows = [(i // 2, 1, "user", t) for i, t in enumerate(texts)] + [(None, 1, "user", "cliente")] * 2
    pq.write_table(pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": [r[2] for r in rows], "text": [r[3] for r in rows]}), tmp_path / "conversations.parquet")
    assert compare(spark, str(tmp_path), registry.queries()["detect_fields"], registry.oracle_sql()["detect_fields"]) == ""


def test_fields_are_found_without_a_join_of_questions(spark, monkeypatch):
    """Nothing but the rows of a result is shuffled, in parts that grow with the tables."""
    asked = spark.read.parquet(f"{SMALL}/conversations.parquet").selectExpr("conv_id as question_id", "text")
    synonyms = spark.sql(questions.SYNONYMS)
    plan = questions.detect_fields(asked, synonyms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    few = questions.parts(asked)
    monkeypatch.setattr(questions, "PART_BYTES", 1 << 10)
    plan = questions.detect_fields(asked, synonyms)._jdf.queryExecution().optimizedPlan().toString()
    assert few == 4 and questions.parts(asked) > 20 and re.search(rf"RepartitionByExpression \[question_id#\d+L\], {questions.parts(asked)}\b", plan)

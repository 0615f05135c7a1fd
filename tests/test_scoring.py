"""Rules of scoring and evaluation on rows made for them."""

import numpy as np
import pytest

from sparkquill.functions.quantiles import nearest_rank, percentile_cont, ranked_values
from sparkquill.operators import business, evaluation, maintenance, scoring


def test_anchor_of_an_article_is_not_one_of_its_parts(spark):
    rows = [
        ("a", "Artículo 5", "Artículo 5. Objeto", "article", "x", 9),
        ("b", "articulo 5", "Artículo 5.1. Objeto", "article", "x", 9),
        ("c", "articulo 5", "Artículo 55", "article", "x", 9),
        ("d", "articulo 5", "Anexo", "section", "Artículo 5 dice", 9),
        ("e", "articulo 5", "articulo 5 . . . . 12", "section", "x", 9),
        ("f", "articulo 5", None, None, None, 9),
        ("g", "articulo 5", "articulo 5", "section", "articulo articulo articulo artículo", 2),
    ]
    df = spark.createDataFrame(rows, "id string, ref string, section string, section_type string, text string, page int")
    got = {r.id: (r.anchor, r.clean) for r in scoring.structural_anchor(df).collect()}
    assert got == {"a": (24, 32), "b": (0, 0), "c": (0, 0), "d": (16, 16), "e": (24, 0), "f": (0, 0), "g": (24, -16)}


def test_one_short_word_is_no_mention(spark):
    q = spark.createDataFrame([(1, "norma de acero"), (2, "ver caja"), (3, "caja roja"), (4, "el manual pdf"), (5, None)], "question_id long, text string")
    s = spark.createDataFrame([("x/acero.pdf",), ("x/caja-roja.pdf",), ("manual.pdf",)], "path string")
    assert sorted((r.question_id, r.path, r.boost) for r in scoring.source_mention(q, s).collect()) == [(1, "x/acero.pdf", 14), (3, "x/caja-roja.pdf", 14)]


def test_mentions_by_common_and_by_rare_words(spark, monkeypatch):
    """Each threshold of common words gives what every pair held against each other does, and no pair is shuffled."""
    words = ["doc", "md", "src0", "src1", "es", "fr", "legal", "norma"]
    rng = np.random.default_rng(3)
    q = [(i, " ".join(rng.choice(words, rng.integers(0, 4))) + f" {i % 40}") for i in range(60)] + [(7, "doc legal"), (99, None)]
    s = [("/".join(rng.choice(words, rng.integers(1, 4))) + f"/{i % 40}",) for i in range(120)]
    asked = {}
    for i, t in q:
        asked.setdefault(i, set()).update((t or "").split())
    want = set()
    for i, tokens in asked.items():
        for (path,) in s:
            both = (tokens & set(path.split("/"))) - set(scoring.NOISE)
            if len(both) > 1 or any(len(w) >= 5 for w in both):
                want.add((i, path))
    questions, sources = spark.createDataFrame(q, "question_id long, text string"), spark.createDataFrame(s, "path string")
    for common, at_once in ((0, 1000), (5, 20), (30, 1000), (1000, 1000)):
        monkeypatch.setattr(scoring, "COMMON", common)
        monkeypatch.setattr(scoring, "QUESTIONS_AT_ONCE", at_once)
        got = [(r.question_id, r.path) for r in scoring.source_mention(questions, sources).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_greedy_caps_and_backfill(spark):
    rows = [(1, f"c{i}", i, "s1" if i < 5 else "s2", 1 if i in (1, 2) else i, 7) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, rank int, source string, page long, doc_id long")
    got = [r.chunk_id for r in scoring.greedy_select(df, 4).orderBy("place").collect()]
    assert got == ["c1", "c3", "c5", "c6"]
    assert [r.chunk_id for r in scoring.greedy_select(df, 6).orderBy("place").collect()] == ["c1", "c3", "c5", "c6", "c2", "c4"]


def test_missing_classes_take_the_tail(spark):
    texts = ["a", "b 1", "c", "d", "Head line", "e 2"]
    df = spark.createDataFrame([(1, f"c{i}", i + 1, t) for i, t in enumerate(texts)], "question_id long, chunk_id string, rank int, text string")
    got = {(r.chunk_id, r.place) for r in scoring.coverage_repair(df, scoring.CLASSES, 3).collect()}
    assert got == {("c0", 1), ("c1", 2), ("c4", 3)}


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 1.0], list(np.random.default_rng(1).normal(size=501)), [*range(100), 1e9]])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = ranked_values(df, "v").agg(percentile_cont(0.5).alias("a"), percentile_cont(0.95).alias("b"), nearest_rank(0.5).alias("c")).first()
    if not values:
        assert tuple(got) == (None, None, None)
        return
    want = np.quantile(values, [0.5, 0.95])
    assert np.allclose(got[:2], want) and got[2] == sorted(values)[round((len(values) - 1) * 0.5)]


def test_faithfulness_of_sentences(spark):
    rows = [(1, 1, "El motor funciona bien. Nadie sabe nada; ok.", "El motor tiene potencia"), (1, 2, "", "x"), (1, 3, "a b.", "motor"), (1, 4, "motor", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, answer string, context string")
    got = {r.turn: r.faithfulness for r in evaluation.faithfulness(df).collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: None}


def test_questions_are_parsed(spark):
    texts = ["Importe de EST-12-2024 en marzo por mes", "obra ab-1234x del segundo cuatrimestre", "proyecto 26018 y 2025", 'cliente de "Torre Sur"', "total de 2024 y 2025 en el area bt", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")
    got = {r.question_id: r for r in business.parse_questions(df).collect()}
    assert [got[i].reference for i in range(7)] == ["EST-12-2024", "AB-1234X", "26018", "Torre Sur", None, None, None]
    assert got[0].month == 3 and got[0].per_month and got[1].quarter == 2 and got[2].years == "2025"
    assert got[4].years == "2024,2025" and got[4].per_year and got[4].area == "BT"


def test_same_hash_without_chunks_is_an_update(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("e", "1")], "path string, hash string")
    index = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    got = dict(map(tuple, maintenance.incremental_diff(old, new, index).collect()))
    assert got == {"a": "unchanged", "b": "updated", "c": "updated", "d": "removed", "e": "added"}

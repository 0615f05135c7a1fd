"""Recall of the approximate search against the exact one; chunks against their own rules."""

import numpy as np
import pytest

from sparkquill.operators import retrieval, vectors

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_ann_recall(spark, folder):
    exact = {(r.query_id, r.vec_id) for r in retrieval.knn(spark, folder).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.ann(spark, folder).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ann_looks_at_few_of_vectors_that_lie_in_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (10 * np.eye(16)[i % 16] + rng.normal(size=16)).tolist()) for i in range(3000)]
    v = spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 16)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding q")
    x = np.array([r[1] for r in rows])
    cells = vectors.Cells(x, 3000, 5, 0.95)
    assert cells.probes <= len(cells.centres) / 4
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.query_id, r.vec_id) for r in vectors.ann_topk(q, v).collect()}
    exact = {(i, int(j)) for i in range(0, 3000, 100) for j in np.argsort(-(unit @ unit[i]))[1:6]}
    assert len(exact & found) >= 0.9 * len(exact)
    assert vectors.ann_topk(q.limit(0), v.limit(0)).count() == 0


def test_queries_go_in_blocks(spark, monkeypatch):
    for query in (retrieval.knn, vectors.filtered):
        monkeypatch.setattr(retrieval, "MAX_BROADCAST", 64 << 20)
        whole = query(spark, SMALL)
        monkeypatch.setattr(retrieval, "MAX_BROADCAST", 1200)
        dealt = query(spark, SMALL)
        joins = [d._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, NOT") for d in (whole, dealt)]
        assert joins[1] > joins[0] == 1
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))


def test_chunks_cover_whole_texts():
    text = "abc def. " * 300 + "x" * 2000
    got = list(vectors.pieces(text))
    covered = set()
    for start, piece in got:
        assert text[start : start + len(piece)] == piece and len(piece) >= vectors.SHORTEST
        covered.update(range(start, start + len(piece)))
    assert len(covered) >= len(text) - vectors.SHORTEST
    assert list(vectors.pieces(None)) == list(vectors.pieces("")) == list(vectors.pieces("short")) == []


def test_chunks_leave_a_task_in_small_batches(spark):
    """Ten long texts in one batch are more chunks than leave a task at once, and none is lost."""
    text = "abc def. " * 20_000
    docs = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string").coalesce(1)
    want = [(n, s, t) for n, (s, t) in enumerate(vectors.pieces(text))]
    assert len(want) * 10 > 2 * vectors.CHUNKS_AT_ONCE
    got = [tuple(r) for r in vectors.chunk_structured(docs).collect()]
    assert sorted(got) == [(i, *w) for i in range(10) for w in want]


def test_chunks_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "y" * 1000)], "doc_id long, text string")
    assert {r.doc_id for r in vectors.chunk_structured(docs).collect()} == {3}


def test_packs_give_what_every_pair_scored_alone_does(spark, monkeypatch):
    """Copies, nulls, zero vectors and other lengths; packs of three and of all, so that ties and packs of one occur."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(60)] + [(i, [1.0, 2.0, 0.0, 1.0], 1) for i in range(60, 80)] + [(80, None, 1), (81, [1.0], 2), (82, [0.0] * 4, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3, "vec_id")
    ids = [*range(0, 80, 9), 80, 81]
    q = v.where(v.vec_id.isin(ids)).selectExpr("vec_id query_id", "embedding q", "label q_label")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return None
        return round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 5)

    want = set()
    for i in ids:
        near = sorted(((cosine(rows[i][1], x), j) for j, x, _ in rows if j != i), key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        want |= {(i, j, s, n + 1) for n, (s, j) in enumerate(near[:5])}
    for size in (1, 3, 1000):
        monkeypatch.setattr(retrieval, "VECTORS", size)
        monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", size)
        assert {(r.query_id, r.vec_id, r.score, r.rank) for r in retrieval.knn_topk(q, v).collect()} == want


def test_only_the_best_of_each_pack_leave_a_task(spark):
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(1000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = v.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding q")
    assert retrieval.nearest(q, v, 5, [(None, None)]).count() == 50

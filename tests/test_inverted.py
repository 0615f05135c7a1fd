"""Searches by an inverted index against brute force over all pairs, with copies, ties, nulls and long texts; and blocks that are skipped."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkquill.operators import inverted
from sparkquill.operators.retrieval import bm25_topk, tokens

WORD = re.compile(r"[^\W\d_]{4,}")


def words(text):
    return WORD.findall((text or "").lower())


def brute(questions, docs, k, cap, mode):
    out = []
    for q, asked in questions:
        asked, scored = set(words(asked)), []
        have = [(i, g, collections.Counter(words(t))) for i, g, t in docs if i is not None and asked & set(words(t))]
        mean = np.mean([sum(c.values()) for _, _, c in have]) if have else 0
        for i, g, c in have:
            n = sum(c.values())
            score = round(sum(c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * n / mean)) for w in asked if c[w]), 5) if mode == "bm25" else len(asked & set(c))
            scored.append((-score, i, g))
        seen, best = collections.Counter(), []
        for s, i, g in sorted(scored):
            seen[g] += 1
            if seen[g] <= cap and len(best) < k:
                best.append((q, i, -s))
        out += best
    return sorted(out)


def corpus():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(120)]
    text = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.05)), 119)] for _ in range(n))
    docs = [(i, f"s{i % 7}", text(rng.randint(1, 60))) for i in range(300)]
    docs += [(400 + i, f"s{i % 3}", docs[5][2]) for i in range(60)]  # copies: equal scores, ranked by id
    docs += [(600, "s1", text(4000)), (601, None, docs[9][2]), (602, None, docs[9][2]), (603, "s2", None), (604, "s2", ""), (605, "s2", "a b c"), (None, "s2", docs[5][2])]
    questions = [(i, text(rng.randint(1, 9))) for i in range(40)] + [(50, None), (51, ""), (52, docs[5][2]), (52, "zzzzzz"), (53, "none of these wordsxyz")]
    return questions, docs


@pytest.mark.parametrize(("ranges", "bytes_at_once"), [(4, 16 << 20), (40, 16 << 20), (10, 200)])
def test_bm25_is_that_of_all_pairs(spark, monkeypatch, ranges, bytes_at_once):
    monkeypatch.setattr(inverted, "QUESTION_BYTES", bytes_at_once)
    monkeypatch.setattr(inverted, "RANGES", ranges)
    questions, docs = corpus()
    q, d = spark.createDataFrame(questions, "question_id long, text string"), spark.createDataFrame(docs, "chunk_id long, source string, text string")
    got = bm25_topk(q, d, 5, 2)
    want = brute(questions, docs, 5, 2, "bm25")
    assert sorted((r.question_id, r.chunk_id, r.score) for r in got.collect()) == [(a, b, pytest.approx(c, abs=2e-5)) for a, b, c in want]
    assert bm25_topk(q.limit(0), d).count() == 0 and bm25_topk(q, d.limit(0)).count() == 0


def test_shared_words_and_strings_as_keys(spark, tmp_path):
    questions, docs = corpus()
    docs = [(f"c-{i}", g, t) for i, g, t in docs if i is not None]
    d = spark.createDataFrame(docs, "id string, g string, text string")
    index = inverted.build_index(d, tokens, "id", ["g"], f"file://{tmp_path}/index")
    q = spark.createDataFrame(questions, "question_id long, text string")
    got = index.search(q, tokens(q.text), inverted.shared_words, 12)
    assert sorted((r.question_id, r.row.id, r.points) for r in got.collect()) == brute(questions, [(i, n, t) for n, (i, _, t) in enumerate(docs)], 12, 12, "hits")
    assert all(r.row.g is None or r.row.g[0] == "s" for r in got.collect())


def block_of(docs):
    rows = pa.RecordBatch.from_pylist([{"id": i, "g": "x"} for i, _ in docs], schema=pa.schema([("id", pa.int64()), ("g", pa.string())]))
    packed = inverted.pack(rows, "id", pa.array([words(t) for _, t in docs], pa.list_(pa.string())))
    return pa.RecordBatch.from_pylist([packed])


def test_blocks_that_cannot_reach_the_best_are_not_scored(monkeypatch):
    rng = random.Random(4)
    good = block_of([(i, "alpha beta gamma delta " * 3) for i in range(10)])
    poor = [block_of([(100 + 10 * b + i, " ".join(["alpha", *(f"word{chr(97 + rng.randint(0, 25))}" for _ in range(30))])) for i in range(10)]) for b in range(20)]
    vocabulary = pa.array(["alpha", "beta", "gamma", "delta"])

    class Shared:
        value = (vocabulary, [np.arange(4)], [20.0])

    scored = []
    plain = inverted.Block.postings
    monkeypatch.setattr(inverted.Block, "postings", lambda self, lists: scored.append(1) or plain(self, lists))
    schema = pa.schema([("q", pa.int32()), ("points", pa.int64()), ("row", pa.struct([("id", pa.int64()), ("g", pa.string())]))])
    run = inverted.best_of_found(Shared, inverted.bm25, 5, 5, "id", None, schema)
    out = [r for b in run(iter([good, *poor])) for r in b.to_pylist()]
    assert [r["row"]["id"] for r in out] == [0, 1, 2, 3, 4] and len(scored) == 1


def test_bounds_hold_for_every_document():
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "other", "words"]) for _ in range(rng.randint(1, 40)))) for i in range(200)]
    block = inverted.Block(block_of(docs), 0)
    at = {w: i for i, w in enumerate(block.words.to_pylist())}
    for asked in (["alpha"], ["alpha", "gamma"], ["words", "beta", "other"]):
        for mean in (1.0, 12.5, 300.0):
            bound, scores = inverted.bm25(block, np.array([at[w] for w in asked]), mean)
            assert scores().max() <= bound

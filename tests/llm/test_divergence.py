"""Operator 11 against brute force in plain Python, and its tree against dense matrices."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkquill.llm import divergence, queries

from ..oracle import compare
from .test_operators import SMALL, docs, odd, same  # noqa: F401

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    """rows: (lang, source, text)."""
    count, in_docs, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]
        count.update((lang, source, t) for t in found)
        in_docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in in_docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in [*sources, None]:
            of = {t: sum(count[lang, x, t] for x in ([s] if s is not None else sources)) for t in kept}
            p[s] = {t: 1 + 1_000_000_000 * (n + 5) // (sum(of.values()) + 5 * len(kept)) for t, n in of.items()}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - p[None][t]) for t in kept if count[lang, s, t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(items[:most])]
    return out


def skewed(spark):
    """Many small sources beside one large, a group without terms, a language without kept terms, ties, marks and letters outside ASCII."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(300)]
    rows = [("en", "src0", " ".join(words[j] for j in range(300) if j % (i % 9 + 1) == 0)) for i in range(40)]
    rows += [("en", f"src{i}", f"{words[i]} {words[2 * i]} Größe GRÖSSE größe naïve_naïve 3x3") for i in range(1, 60)]
    rows += [("en", "none", "12 _ 3"), ("en", None, None), ("de", "a", "nur hier"), ("de", "b", "nur da"), (None, None, "x y"), ("fr", "one", "seul"), ("en", "src1", rows[40][2]), ("en", "src1", rows[40][2])]
    return spark.createDataFrame([(n, *r, "k", 1, 2, 3) for n, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n long, row long, block int")


@pytest.mark.parametrize(("name", "least", "top", "cells"), [("given", 30, 50, None), ("odd", 1, 50, None), ("skewed", 3, 5, None), ("skewed", 3, 5, 64), ("none", 30, 50, None)])
def test_audit_is_that_of_brute_force(spark, odd, name, least, top, cells, monkeypatch):  # noqa: F811
    if cells:  # many blocks of few columns
        monkeypatch.setattr(divergence, "BLOCK_CELLS", cells)
    df = {"given": docs(spark), "odd": odd, "skewed": skewed(spark) if name == "skewed" else None, "none": odd.limit(0)}[name]
    got = divergence.audit(df, least, top)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    same([tuple(r) for r in got.collect()], brute([(r.lang, r.source, r.text) for r in df.collect()], least, top))


@pytest.mark.parametrize(("rows", "cols", "cells"), [(1, 1, 1), (3, 40, 0), (20, 700, 900), (9, 1024, 9216), (300, 1100, 2000), (600, 30, 700)])
def test_tree_sums_are_those_of_the_dense_matrix(rows, cols, cells):
    rng = np.random.default_rng(rows)
    at = rng.choice(rows * cols, cells, replace=False)
    base = rng.integers(1, 1000, rows)
    dense = np.repeat(base[:, None], cols, 1)
    dense[at // cols, at % cols] = rng.integers(1, 10**9, cells)
    tree = divergence.K2Tree(at // cols, at % cols, dense[at // cols, at % cols], base, cols)
    for i in range(tree.tile_rows):
        for j in range(i, tree.tile_rows):
            got = tree.tile_sums(i, j)
            for a in range(0, min(divergence.TILE_ROWS, rows - i * divergence.TILE_ROWS)):
                for b in range(a + 1 if i == j else 0, min(divergence.TILE_ROWS, rows - j * divergence.TILE_ROWS), 7 if rows > 100 else 1):
                    assert got[a, b] == np.abs(dense[i * divergence.TILE_ROWS + a] - dense[j * divergence.TILE_ROWS + b]).sum()


def test_zero_quadrants_are_never_looked_into(monkeypatch):
    """Two rows with one count each at either end of many columns: all but their own leaves are priced by width."""
    n = divergence.TILE_COLS
    tree = divergence.K2Tree(np.array([0, 200]), np.array([0, n - 1]), np.array([70, 90]), np.array([5] * 200 + [9]), n)
    looked = []
    plain = tree.find
    monkeypatch.setattr(tree, "find", lambda level, r, c: looked.append((level, len(r))) or plain(level, r, c))
    assert tree.tile_sums(0, 0)[0, 200] == 4 * (n - 2) + (70 - 9) + (90 - 5)
    full = {level: (1 << divergence.DEPTH - level) * ((1 << divergence.DEPTH - level) + 1) // 2 << divergence.DEPTH - level for level, _ in looked}
    assert sum(n for level, n in looked if level == 0) < full[0] / 100


def test_terms_and_counts_of_a_batch():
    batch = pa.record_batch([["en", "en", "de"], ["a", "a", "b"], ["Ab ab-c", "AB É é", ""]], names=["lang", "source", "text"])
    got = [r for b in divergence.count_terms(iter([batch, batch])) for r in b.to_pylist()]
    same([tuple(r.values()) for r in got if r["term"]], [("en", "a", "ab", 6, 4), ("en", "a", "c", 2, 2), ("en", "a", "É", 2, 2), ("en", "a", "é", 2, 2)])
    assert [(r["lang"], r["source"]) for r in got if r["term"] is None] == [("de", "b"), ("en", "a")] or len([r for r in got if r["term"] is None]) == 2


def test_shares_are_exact_beyond_longs_times_a_unit(spark):
    rows = [(0, 7, 3), (10**17 + 1, 3 * 10**17, 10**9), (5, 11, 1)]
    df = spark.createDataFrame(rows, "n long, total long, v long")
    assert [r[0] for r in df.select(divergence.share("n", "total", "v")).collect()] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]


def test_query_equals_its_sql(spark):
    name = "op11_source_divergence"
    assert compare(spark, SMALL, queries.QUERIES[name], queries.SQL[name]) == ""

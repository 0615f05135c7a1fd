"""Operator 13 against brute force, and its index against Python's own strings."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkquill.llm import fill_in_middle, queries

from ..oracle import compare
from .test_operators import LONG, SMALL, docs, odd, rows_of, same  # noqa: F401

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(i, text, units=TOKEN.findall, seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = list(units(text))
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (i, len(u), "plain", None, None, text)
    if h[3] % 100 < 80:
        return (i, len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (i, len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


ODD = ["é", "\U0001f600 a", " \t", "a\n", "ab<P>c", "a < P> <S", "<" * 40, "x" * 300, "名前 は 何", " é é ", "́a b\x0bc", "é" * 5000 + " end"]


@pytest.mark.parametrize("units", ["token", "char"])
@pytest.mark.parametrize("name", ["given", "odd", "many", "none"])
def test_rows_are_those_of_brute_force(spark, odd, name, units):  # noqa: F811
    many = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD * 30)] + [(7, ODD[7], "y")] * 3, "doc_id long, text string, n string")
    df = {"given": docs(spark), "odd": odd, "many": many, "none": odd.limit(0)}[name]
    out = fill_in_middle.fill_in_middle(df, 42, units=units)
    got = out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output", fill_in_middle.restore(out.fim.output, out.fim.form).alias("restored"), "text").collect()
    same([tuple(r)[:6] for r in got], [brute(i, t, list if units == "char" else TOKEN.findall) for i, t in rows_of(df)])
    assert all(r.restored == (r.text or "") for r in got)
    if name == "many":
        assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_other_columns_stay_and_the_new_one_is_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "mine")], "doc_id long, text string, fim int, form string")
    out = fill_in_middle.fill_in_middle(df, 42)
    assert out.columns == ["doc_id", "text", "fim", "form"] and out.first().form == "mine" and out.first().fim.n == 3
    assert fill_in_middle.fill_in_middle(df, 42, into="cut").first().fim == 5


@settings(max_examples=200, deadline=None)
@given(st.text(), st.text(alphabet="aé名\U0001f600 \n"))
def test_index_converts_like_strings(a, b):
    text = a + b
    data = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
    text = data.tobytes().decode()
    index = fill_in_middle.Exceptions(data)
    places = np.cumsum([0, *(len(c.encode()) for c in text)])
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert index.to_chars(places).tolist() == list(range(len(text) + 1))
    assert len(index.byte) == sum(ord(c) > 127 for c in text)


def test_slices_of_a_batch(monkeypatch):
    texts = pa.array(["ab é c", None, "", " x", "名 b c d e"] * 20)
    draws = tuple(np.arange(100) * k for k in (7, 13))
    forms = pa.array([("plain", "psm", "spm")[i % 3] for i in range(100)])
    want = fill_in_middle.cut_texts(texts, forms, draws, "token").to_pylist()
    plain = fill_in_middle.text_slices
    monkeypatch.setattr(fill_in_middle, "text_slices", lambda column: plain(column, 16))
    assert fill_in_middle.cut_texts(texts, forms, draws, "token").to_pylist() == want


def test_query_equals_its_sql(spark):
    name = "op13_fill_in_middle"
    assert compare(spark, SMALL, queries.QUERIES[name], queries.SQL[name]) == ""

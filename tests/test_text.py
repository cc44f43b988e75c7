"""Text functions (X01-X19, S11) on literal examples and against plain Python."""

from __future__ import annotations

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def column(spark, values, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in frame.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    got = column(spark, ["the security and review", "mustn't Use_it _x_ a B2 Ünder_", None, "", "constructor cafés"], X.tokens)
    assert got == [["security", "review"], ["mustn", "use_it", "b2", "ünder"], [], [], ["cafés"]]


def test_korean_forms(spark):
    got = column(spark, ["자연어처리합니다", "abc", "가", "나무는", "데이터"], X.korean_forms)
    assert [(f["token"], f["weight"]) for f in got[0]] == [("자연어처리", 0.78), ("자연", 0.52), ("어처리", 0.52), ("자연어", 0.52), ("처리", 0.52)]
    assert got[1] == [] and got[2] == [] and [f["token"] for f in got[3]] == ["나무"]


def test_document_tokens(spark):
    (got,) = column(spark, ["자연어처리 도서목록 정리 자연어"], X.document_tokens)
    assert got[:4] == ["자연어처리", "도서목록", "정리", "자연어"] and "처리" in got and got.count("자연어") == 1


def test_folding_matches_the_full_text_tokenizer(spark):
    letters, _ = X.folding()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize = 'unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    sample = [c for c in letters if ord(c) < 0x180 and c.isalpha() and c == c.lower()]
    for i, c in enumerate(sample):
        con.execute("insert into t values (?)", (f"q{c}z{i}",))
    kept = {r[0] for r in con.execute("select term from v")}
    got = column(spark, [f"q{c}z{i}" for i, c in enumerate(sample)], X.folded)
    assert set(got) == kept
    assert column(spark, ["café ß 한국 _a"], X.folded) == ["cafe ß 한국 _a"]


def test_names_and_previews(spark):
    assert column(spark, [" Skill-My Guide.MD ", "skill_skill_x", "a  b"], X.canonical_name) == ["my-guide", "skill_x", "a-b"]
    assert column(spark, ["a\n\nb\nc", None], lambda c: X.preview(c, 4)) == ["a b", ""]


def test_similarity(spark):
    assert column(spark, ["abc", "abd", "", "x" * 300], lambda c: F.round(X.similarity(c, F.lit("abc")), 6)) == [1.0, 0.666667, 0.0, 0.0]


def plain_osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(1, 3))
def test_osa(a, b, most):
    want = plain_osa(a, b)
    assert X.osa(a, b, most) == (want if 0 < want <= most else None)


def test_osa_is_the_restricted_form():
    assert X.osa("ca", "abc", 3) == 3 and X.osa("cartogrphers", "cartographers", 2) == 1 and X.osa("same", "same", 2) is None


@pytest.mark.parametrize(("value", "want"), [(1.0005, 1.0), (0.0625, 0.063), (-0.0625, -0.063), (2.5, 2.5), (3.0004999, 3.0)])
def test_fixed3(value, want):
    assert X.fixed3(value) == want

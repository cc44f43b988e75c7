"""Requested names are looked up without moving the bodies of other documents."""

from __future__ import annotations

from corpusloom.operators import search as S
from tests.test_search import corpus, record


def test_only_named_documents_are_joined(spark):
    c = corpus(spark, *(record(i, f"n{i}", f"text {i}") for i in range(5)))
    found = S.named(c, ["n3", "nobody", "n1", "n3"])
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["requested"]: (r["pos"], r["canonical_name"], r["body_text"]) for r in found.collect()}
    assert rows == {"n3": (0, "n3", "text 3"), "nobody": (1, None, None), "n1": (2, "n1", "text 1")}

"""Postings counted within a document's row."""

from __future__ import annotations

from collections import Counter

from corpusloom.operators import index as I
from tests.test_search import corpus, record

BODIES = ["One two one_two _two_ TWO a_ _ x", "", "été ete the thé", "가람으로 터실 one", "__", "one " * 5000]


def test_counts_need_no_shuffle_and_are_those_of_all_fields(spark):
    c = corpus(spark, *(record(i, f"n{i}", b) for i, b in enumerate(BODIES)))
    rows = I.postings(c.documents.localCheckpoint())
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in I.tokenised(c.documents).collect():
        tf, wtf = Counter(), Counter()
        for f in r["fields"]:
            for t in f["terms"]:
                t = t.replace("é", "e")
                tf[t] += 1
                wtf[t] += f["weight"]
        want |= {(t, r["skill_id"]): (r["n_tokens"], n, wtf[t]) for t, n in tf.items()}
    found = {(r["term"], r["skill_id"]): (r["n_tokens"], r["tf"], r["wtf"]) for r in rows.collect()}
    assert found == want and rows.count() == len(want)
    of = lambda i: {t: n[1] for (t, s), n in found.items() if s == c.documents.where(f"ordinal = {i}").first()["skill_id"]}
    assert of(0)["two"] == 3 and of(0)["one"] == 1 and of(0)["one_two"] == 1 and of(5)["one"] == 5000
    assert "the" in of(2) and not {"_", "a", "x", "a_"} & of(0).keys()


def test_ranges_follow_the_number_of_postings(spark, monkeypatch):
    c = corpus(spark, *(record(i, f"n{i}", b) for i, b in enumerate(BODIES)))
    rows, n = I.settled(c.documents)
    assert n == rows.count() == I.postings(c.documents).count()
    monkeypatch.setattr(I, "PER_RANGE", 4)
    dealt = I.arranged(rows, n)
    assert dealt.rdd.getNumPartitions() == -(-n // 4) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    assert I.settled(c.documents.limit(0))[1] == 0

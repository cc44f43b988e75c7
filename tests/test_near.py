from __future__ import annotations

import random

from corpusloom.functions.text import osa
from corpusloom.operators import index as I
from corpusloom.operators import search as S


def test_near_terms_by_equal_pieces(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 12))) for _ in range(60)]

    def edited(word):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word))
            kind = rng.choice(["swap", "drop", "add", "set"])
            swapped = word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :]
            word = {"swap": swapped, "drop": word[:i] + word[i + 1 :], "add": word[:i] + rng.choice("abc") + word[i:], "set": word[:i] + rng.choice("abc") + word[i + 1 :]}[kind] or "a"
        return word

    terms = sorted({*base, *(edited(rng.choice(base)) for _ in range(1500)), "été", "a", "ab"})
    index = I.Index(None, spark.createDataFrame([(t, 1) for t in terms], "term string, df int"), 1, 1.0)
    words = list(enumerate(dict.fromkeys([*(edited(w) for w in base), *base[:10], "ab", "xyzzyx"])))
    want = {}
    for place, w in words:
        most = 2 if len(w) >= 7 else 1
        near = [(osa(t, w, most), len(t), t) for t in terms if len(w) >= 5 and t.isascii() and t[0] == w[0] and abs(len(t) - len(w)) <= most]
        want[place] = [t for _, _, t in sorted(x for x in near if x[0] is not None)[: S.FUZZY_MOST]]
    found = {place: [] for place, _ in words}
    # the word itself is no near term in a search, which asks for exact terms first
    for v in S.near(index, words):
        found[v.place].append(v.term)
    assert {k: x for k, x in found.items() if words[k][1] not in terms} == {k: x for k, x in want.items() if words[k][1] not in terms}
    assert sum(map(len, found.values())) > 100


def test_pieces_are_the_same_on_both_sides(spark):
    words = ["a", "ab", "abcdefghij", "aab", "aaaaaaa"]
    rows = spark.createDataFrame([(w,) for w in words], "term string").select("term", I.pieces_of(I.F.col("term")).alias("p")).collect()
    assert {r["term"]: sorted(r["p"]) for r in rows} == {w: I.pieces_of_word(w, I.DELETIONS) for w in words}


def test_the_plan_has_no_scan_of_the_vocabulary(spark):
    index = I.Index(None, spark.createDataFrame([("attention", 1)], "term string, df int"), 1, 1.0)
    plan = index.deletions().where(I.F.col("piece").isin("atte", "atten"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(piece" in plan and "deletions-" in plan


def test_few_words_take_no_index_of_deletions(spark):
    terms = ["attention", "attentoin", "attendion", "atention", "btention", "attention_s", "attentionné", "zoo", "zoos"]
    held = lambda: I.Index(None, spark.createDataFrame([(t, 1) for t in terms], "term string, df int"), 1, 1.0)
    words = [(0, "attentionx"), (1, "zooss"), (2, "attenti")]
    few, many = held(), held()
    many.deletions()
    assert S.near(few, words) == S.near(many, words) != []
    assert few.pieces is None and few.passes == 3
    few.passes = S.PASSES
    assert S.near(few, words) == S.near(many, words) and few.pieces is not None

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lines

SCHEMA = "doc_id long, text string, lang string, d long, `a.b` string"
STRIP = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_chars=40, least_docs=5):
    """(doc_id, text) -> kept text, over rows with ids."""
    held = defaultdict(set)
    key = lambda line: line.strip(STRIP).translate(LOWER)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    stay = lambda i, line: len(held[key(line)]) < least_docs or max(held[key(line)]) == i
    out = []
    for i, text in rows:
        got = [line for line in (text or "").split("\n") if stay(i, line)]
        n = len((text or "").split("\n"))
        out.append((i, n, n - len(got), hashlib.sha256("\n".join(got).encode()).hexdigest()))
    return sorted(out)


def random_rows(seed, n=150):
    rng = random.Random(seed)
    pool = ["hot line that is long enough to be counted as one " + "é" * 3] + [f"Shared Line number {k} with Ünïcode and enough code points" for k in range(25)]
    rows = []
    for i in range(n):
        got = []
        for _ in range(rng.choice([0, 1, 3, 8, 150])):
            line = rng.choice(pool[:1] * 12 + pool + ["short", "", f"a line of its own {rng.random()} that nobody else has got"])
            line = rng.choice([line, line.upper() if line.isascii() else line, f"  {line}\t", f" {line}", line + "\r"])
            got.append(line)
        rows.append((i, rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(got)))
    return rows + rows[:10] + [(n, "\n".join(pool[:1] * 200)), (n + 1, "x" * 39), (n + 2, "\n\n")]


@pytest.mark.parametrize(("seed", "most"), [(1, 256), (2, 20), (3, 1)])
def test_against_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(lines.repeated, "__defaults__", (lines.LEAST_DOCS, most))
    monkeypatch.setattr(lines.line_bitmaps, "__defaults__", (*lines.line_bitmaps.__defaults__[:-1], most))
    rows = random_rows(seed)
    random.Random(seed).shuffle(rows)
    found = lines.report(spark.createDataFrame([(i, t, "en", 0, "x") for i, t in rows], SCHEMA).repartition(3))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_texts_nulls_and_clashing_columns(spark):
    line = "this very line stands in each of all the documents here"
    rows = [(None, f"{line}\nA {k}", "en", k, "x") for k in range(3)] + [(k, f"{line}\nB {k}", None, k, "y") for k in (4, 9)] + [(7, None, "en", 1, None)]
    found = {(r["d"], r["a.b"]): r for r in lines.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[9, "y"]["text"] == f"{line}\nB 9" and found[4, "y"]["text"] == "B 4" and found[1, None]["text"] is None
    assert [found[k, "x"]["text"] for k in range(3)] == ["A 0", "A 1", "A 2"]
    # without ids one of the texts keeps the line, in every form of the search
    for most in (256, 1):
        alone = lines.without_repeats(spark.createDataFrame([(None, f"{line}\n{k}", "en", k, "") for k in range(6)], SCHEMA), most=most)
        kept = [r["text"] for r in alone.where(F.col("text").contains("very")).collect()]
        assert len(kept) == 1 and alone.count() == 6


def test_empty_table_and_bitmaps(spark):
    assert lines.report(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = spark.createDataFrame([(1, 0, 0, p) for p in (0, 1, 63, 64 * 5, 64 * 6 + 63, 64 * 6 + 63)], "d long, t0 long, t1 long, pos int")
    drops = lines.bitmaps(gone).first()["drops"]
    assert [(x["skip"], x["drop"] & (2**64 - 1)) for x in drops] == [(0, (1 << 63) + 3), (4, 1), (0, 1 << 63)]
    text = "\n".join(map(str, range(500)))
    got = lines.bitmaps(gone).select(lines.kept_text(F.lit(text), F.col("drops")).alias("t"), lines.n_dropped(F.col("drops")).alias("n")).first()
    assert got["n"] == 5 and got["t"].split("\n") == [str(k) for k in range(500) if k not in (0, 1, 63, 320, 447)]


def test_windows_take_the_ranges_as_they_are(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = lines.repeated(lines.line_hashes(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "PythonUDF" not in plan
    between = plan[plan.index("dense_rank") : plan.index("rangepartitioning")]
    assert "hashpartitioning" not in between and between.count("Sort [") <= 1

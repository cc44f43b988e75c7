from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, `a.b` string"
LOWER = {c: c + 32 for c in range(65, 91)}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes, fan):
    """Digest of the top, and for each node its proof as (left, right) pairs."""
    proofs, members = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, below = [], []
        for k in range(0, len(nodes), fan):
            run = nodes[k : k + fan]
            for i in range(len(run)):
                for m in members[k + i]:
                    proofs[m].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            below.append([m for x in members[k : k + fan] for m in x])
        nodes, members = up, below
    return nodes[0], proofs


def brute(rows, fan):
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), i, text, source, n))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]], fan)
    root, above = tree([trees[g][0] for g in order], fan)
    out = []
    for g, upper in zip(order, above, strict=True):
        for (_, _, digest, i, text, source, n), proof in zip(groups[g], trees[g][1], strict=True):
            proof = proof + upper
            now = digest
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                now = leaf(i, source, g, n, text.translate(LOWER))
            for left, right in proof:
                now = h(left, now, right)
            out.append((i, digest, trees[g][0], root, h(*[x for s in proof for x in s]), now, now == root))
    return out


def rows_of(rng, n, langs):
    return [(k, rng.choice([None, "", f"Text {k} é\nÜ", "text", "ABC" * 50]), rng.choice(langs), rng.choice([None, "s", "-"]), rng.choice([None, 3])) for k in range(n)]


@pytest.mark.parametrize(("seed", "n", "fan"), [(1, 700, 8), (2, 90, 2), (3, 1, 8), (4, 9, 8)])
def test_against_brute_force(spark, seed, n, fan, monkeypatch):
    rng = random.Random(seed)
    rows = rows_of(rng, n, ["en"] * 20 + ["de", "é", "zz", None, "", *map(str, range(12))])
    rows += [(None, f"N{k}", "en", "x", k) for k in range(5)] * (n > 9) + rows[:3] * (n > 9) + [(7, f"other {k}", "en", None, 1) for k in range(4)] * (n > 9)
    rng.shuffle(rows)
    monkeypatch.setattr(manifest.manifest, "__defaults__", (*manifest.manifest.__defaults__[:-1], fan))
    found = manifest.report(spark.createDataFrame([(*r, "clash", "dot") for r in rows], SCHEMA).repartition(3))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows, fan), key=repr)


def test_empty_table_and_kept_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.report(none).collect() == []
    one = spark.createDataFrame([(1, "x", None, "s", 1, "r", "dot")], SCHEMA)
    row = manifest.manifest(one, keep=("doc_id", "a.b")).first()
    assert row["a.b"] == "dot" and row["leaf"] == row["subroot"] == row["root"] and row["proof"] == []
    with pytest.raises(ValueError, match="root"):
        manifest.manifest(one, keep=("root",))


def test_every_proof_folds_to_the_root_and_no_other_does(spark):
    rows = rows_of(random.Random(9), 200, ["en", "de", None])
    docs = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    found = manifest.manifest(docs)
    sound = found.select((manifest.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), (manifest.folded(F.lit("0"), F.col("proof")) == F.col("root")).alias("bad"))
    assert {tuple(r) for r in sound.collect()} == {(True, False)}
    changed = manifest.manifest(spark.createDataFrame([(*r, "", "") for r in [(rows[0][0], "changed", *rows[0][2:]), *rows[1:]]], SCHEMA))
    assert changed.first()["root"] != found.first()["root"]

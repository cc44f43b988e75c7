"""Merkle manifest of a dataset: digests bottom-up, proofs top-down.

Rows are leaves of a tree for each language, in the order of their ids; ``FAN``
consecutive nodes become one digest, level by level, until one is left, and the
languages' last digests form a tree of their own in the same way. Levels are kept as
written tables of runs: the nodes of one parent, with the place of that parent.

A proof goes the other way. From the root down, each run joins the run that its parent
stands in and puts the parent's siblings before what that run has inherited; a leaf
puts its own siblings first. So a proof is a list, from the leaf to the root, of the
texts of the siblings to its left and to its right; folding a leaf with them gives the
root again.

A level is an eighth of the level below it; a row holds at most ``FAN`` digests and
one proof, and a language with any share of the rows spreads over ranges of its ids.

Defined results: a null field is ``-``; rows without id come before all others; rows
that share an id stand in the order of their digests (equal rows are equal leaves:
either may be first, and both proofs hold). Null is a language of its own, before all
others. An empty table has no rows and no root. Extra columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.operators.ranks import numbered

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The siblings of a node at one level; a proof is an array of these.
PROOF = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields, each ``-`` or its UTF-8 byte count, ``:`` and value."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def levels(nodes: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """``nodes`` (a written table) has g, a tree, n, its size, at, a leaf's place from 0,
    and digest. Returns the written runs of each level (g, n, at, nodes: digests in
    order), where at is the place of their parent, and g, digest of each tree's top."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    found, tops, width = [], [nodes.where("n <= 1").select("g", "digest")], 1
    while width < most:
        runs = nodes.where(F.col("n") > width).groupBy("g", "n", F.expr(f"at div {fan}").alias("up"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("x")).select("g", "n", F.col("up").alias("at"), F.col("x.digest").alias("nodes"))
        found.append(written(runs, "level"))
        nodes, width = found[-1].select("g", "n", "at", digest(F.array_join("nodes", "")).alias("digest")), width * fan
        tops.append(nodes.where(F.col("n") <= width).select("g", "digest"))
    return found, reduce(DataFrame.unionByName, tops)


def pushed(leaves: DataFrame, runs: Sequence[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """``leaves`` (g, n, at and more) with ``proof``. ``above`` (g, proof) is what each
    tree's top inherits."""
    top = above.select(F.col("g").alias("pg"), F.lit(-1).cast("long").alias("pat"), F.lit(None).cast("array<string>").alias("run"), F.col("proof").alias("suffix"))
    parents, found = top, leaves
    for k in range(len(runs), -1, -1):
        nodes = runs[k - 1] if k else leaves
        up = F.when(F.col("n") <= fan**k, F.lit(-1)).otherwise(F.expr(f"at div {fan}"))
        joined = nodes.join(parents, (F.col("g") == F.col("pg")) & (up == F.col("pat")))
        own = F.pmod("at", F.lit(fan)).cast("int")
        beside = F.struct(F.array_join(F.slice("run", F.lit(1), own), "").alias("left"), F.array_join(F.slice("run", own + 2, F.lit(fan)), "").alias("right"))
        found = joined.withColumn("proof", F.when(F.col("run").isNull(), F.col("suffix")).otherwise(F.concat(F.array(beside), "suffix"))).select(*nodes.columns, "proof")
        if k:
            found = written(found, "proofs")
            parents = top.unionByName(found.select(F.col("g").alias("pg"), F.col("at").alias("pat"), F.col("nodes").alias("run"), F.col("proof").alias("suffix")))
    return found


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", lang: str = "lang", keep: Sequence[str] = ("doc_id",), fan: int = FAN) -> DataFrame:
    """The columns ``keep`` of each row and its leaf, its language's subroot, the root
    and its proof."""
    if clash := {*keep} & {"leaf", "subroot", "root", "proof"}:
        raise ValueError(f"columns that the manifest makes itself can't be kept: {sorted(clash)}")
    column = lambda c: docs[f"`{c}`"]
    kept = [f"k{i}" for i in range(len(keep))]
    # null sorts before any language, languages bytewise
    g = F.coalesce(F.concat(F.lit(":"), column(lang).cast("string")), F.lit("-"))
    rows = docs.select(g.alias("g"), column(doc_id).alias("id"), leaf([column(f) for f in fields]).alias("digest"), *[column(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    rows = written(numbered(rows, ["id", "digest"], ["g"], "at", first=0, total="n", name="leaves"), "leaves")
    runs, tops = levels(rows, fan)
    tops = written(numbered(tops, ["g"], (), "at", first=0, total="n", name="subroots").select(F.lit("").alias("g"), "at", "n", "digest", F.col("g").alias("tree")), "subroots")
    upper, root = levels(tops, fan)
    start = root.select("g", F.array().cast(PROOF).alias("proof"))
    # one row: the root of all
    whole = F.broadcast(root.select("g", F.col("digest").alias("root")))
    tops = written(pushed(tops, upper, start, fan).join(whole, "g"), "subroot-proofs")
    found = pushed(rows, runs, tops.select(F.col("tree").alias("g"), "proof"), fan)
    named = tops.select(F.col("tree").alias("g"), F.col("digest").alias("subroot"), "root")
    return found.join(named, "g").select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.col("digest").alias("leaf"), "subroot", "root", "proof")


def proof_text(proof: Column) -> Column:
    """All siblings of a proof from the leaf up, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda a, s: digest(F.concat(s["left"], a, s["right"])))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, with the
    text lower-cased in every row whose crc32 is a multiple of 3."""
    fields = {f: F.col(f) for f in FIELDS}
    tampered = leaf(list((fields | {"text": F.translate("text", ascii_uppercase, ascii_lowercase)}).values()))
    meddled = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    found = manifest(docs.select(*FIELDS, F.when(meddled, tampered).alias("tampered")), keep=("doc_id", "tampered"))
    now = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    found = found.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("proof"))).alias("proof_sha256"), now.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(most: int = 8) -> str:
    """DuckDB SQL of :func:`report` for up to 8 ** ``most`` rows a language and languages.

    g is the tree: the languages first, then the tree of their tops; c is the node's
    number from 1, n the tree's size at that level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda text: "sha256(concat(" + ", ".join(field(text if f == "text" else f) for f in FIELDS) + "))"
    crc = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS r(i))"
    out = [
        f"WITH crc AS {crc}",
        f"""d0 AS (SELECT doc_id, coalesce(':' || lang, '-') AS g, {row("text")} AS leaf,
          {row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS meddled,
          xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0 AS bad FROM documents, crc)""",
        "d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) AS c FROM d0)",
        "a0 AS (SELECT g, c, leaf AS h FROM d)",
    ]

    def tree(p: str) -> None:
        for k in range(most):
            out.append(f"{p}{k}n AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {p}{k})")
            out.append(f"{p}{k + 1} AS (SELECT g, (c - 1) // 8 + 1 AS c, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY c)) END AS h FROM {p}{k}n GROUP BY g, (c - 1) // 8)")
            run = "PARTITION BY g, (c - 1) // 8 ORDER BY c ROWS BETWEEN"
            beside = lambda side: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(h, '') OVER ({run} {side}), '') END"
            out.append(f"{p}{k}s AS (SELECT g, c, n > 1 AS real, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {p}{k}n)")

    tree("a")
    out.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) AS c, h, g AS lang FROM a{most})")
    tree("b")
    joins, steps = [], []
    for p, start in (("a", "d.c"), ("b", "u.c")):
        for k in range(most):
            g = "d.g" if p == "a" else "''"
            joins.append(f"JOIN {p}{k}s AS x{p}{k} ON x{p}{k}.g = {g} AND x{p}{k}.c = ({start} - 1) // {8**k} + 1")
            steps.append(f"x{p}{k}")
    up = ["JOIN b0 AS u ON u.lang = d.g", f"JOIN b{most} AS z ON true"]
    out.append(f"p AS (SELECT doc_id, leaf, u.h AS subroot, z.h AS root, meddled, bad, {', '.join(f'{s}.real AS {s}_y, {s}.l AS {s}_l, {s}.r AS {s}_r' for s in steps)} FROM d {' '.join(up)} {' '.join(joins)})")
    fold = "f0 AS (SELECT *, CASE WHEN bad AND meddled IS NOT NULL THEN meddled ELSE leaf END AS f FROM p)"
    out.append(fold)
    for i, s in enumerate(steps):
        out.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN {s}_y THEN sha256({s}_l || f || {s}_r) ELSE f END AS f) FROM f{i})")
    text = " || ".join(f"{s}_l || {s}_r" for s in steps)
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256({text}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


REPORT_SQL = _sql()

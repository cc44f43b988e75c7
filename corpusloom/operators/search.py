"""Ranked search: query variants, BM25, fallback, diagnostics, resolve, gap."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import blocks
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.index import ASCII_TERM, Index, pieces_of_word
from corpusloom.operators.tables import written

K1, B = 1.2, 0.75
FUZZY = {1: 0.45, 2: 0.25}
PREFIX_WEIGHT, PREFIX_MOST, FUZZY_MOST = 0.7, 8, 5
#: Postings of a request's terms up to which all are scored at once.
DIRECT = 1_000_000
#: Words whose near terms are looked for in the vocabulary itself, before an index of deletions is built.
PASSES = 16
# Query words that a fallback query leaves out, and those that stand for a report on operations.
FALLBACK_DROPPED = "diagnostic diagnostics improvement low mismatch improvements postmortem report reports retrospective usefulness value".split()
FALLBACK_TRIGGERS = "diagnostic diagnostics mismatch postmortem report retrospective usefulness value".split()
FALLBACK_QUERIES = ("skill registry diagnostics", "skill registry")
SUGGESTIONS, SUGGESTIONS_MOST, SUGGESTION_LEAST = 3, 5, 0.8
RECOVERY_BYTES, RECOVERY_TOKENS = 4096, 1024

HIT = "name string, score double, coverage int, matched_terms array<string>"


@dataclass(frozen=True)
class Variant:
    """A term that stands for a query token."""

    place: int
    token: str
    term: str
    source: str
    weight: float


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """Distinct tokens of a query in order (a local relation: no job runs)."""
    return spark.createDataFrame([(query,)], "q string").select(F.array_distinct(X.tokens(F.col("q"))).alias("t")).first()["t"]


def variants(index: Index, query: str) -> list[Variant]:
    """Terms for each query token, see :func:`variants_of`."""
    return variants_of(index, query_tokens(index.vocab.sparkSession, query))


def variants_of(index: Index, words: list[str]) -> list[Variant]:
    """Terms for each word: exact ones and Korean forms that the vocabulary holds; else
    up to 8 terms with the word as prefix; else up to 5 near terms. At most one pass
    over the vocabulary for each of the three, however many words.

    Words are those of one request; the vocabulary is filtered by them, never collected."""
    spark = index.vocab.sparkSession
    if not words:
        return []
    forms = spark.createDataFrame(list(enumerate(words)), "place int, token string").select("place", "token", X.korean_forms(F.col("token")).alias("f")).collect()
    exact = {r["place"]: [(r["token"], 1.0, "base"), *((f["token"], f["weight"], "ko-morph") for f in r["f"])] for r in forms}
    wanted = sorted({t for terms in exact.values() for t, _, _ in terms})
    known = {r["term"] for r in index.vocab.where(F.col("term").isin(wanted)).select("term").collect()}
    found: dict[int, list[Variant]] = {}
    for place, token in enumerate(words):
        best: dict[str, tuple[float, str]] = {}
        for term, weight, source in exact[place]:
            if term in known and weight > best.get(term, (0.0, ""))[0]:
                best[term] = (weight, source)
        if best:
            found[place] = [Variant(place, token, t, s, w) for t, (w, s) in sorted(best.items(), key=lambda x: (-x[1][0], x[1][1] != "base", x[0]))]
    for more in (lambda left: prefixed(index.vocab, left), lambda left: near(index, left)):
        if left := [(place, token) for place, token in enumerate(words) if place not in found]:
            for v in more(left):
                found.setdefault(v.place, []).append(v)
    return [v for place in sorted(found) for v in found[place]]


def prefixed(vocab: DataFrame, words: list[tuple[int, str]]) -> list[Variant]:
    """For each (place, word) of 4 or more characters the first terms that begin with it."""
    words = [(p, w) for p, w in words if len(w) >= 4]
    if not words:
        return []
    # words of one request
    few = F.broadcast(vocab.sparkSession.createDataFrame([(p, w, w[:4]) for p, w in words], "place int, token string, head string"))
    # ranges of terms, so that sorted files without them are skipped
    wanted = reduce(Column.__or__, [(F.col("term") >= w) & (F.col("term") < w + chr(0x10FFFF)) for w in sorted({w for _, w in words})])
    met = vocab.where(wanted).select("term", F.substring("term", 1, 4).alias("head")).join(few, "head").where(F.col("term").startswith(F.col("token")))
    order = Window.partitionBy("place").orderBy("term")
    rows = met.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PREFIX_MOST).orderBy("place", "r").collect()
    return [Variant(r["place"], r["token"], r["term"], "base", PREFIX_WEIGHT) for r in rows]


def near(index: Index, words: list[tuple[int, str]]) -> list[Variant]:
    """For each (place, ASCII word of 5 or more characters) its nearest terms: 1 edit, 2
    from 7 on; the first character stays and lengths differ by no more than the edits.

    The first words of an index look through the terms that begin alike, whose ranges the
    sorted vocabulary's files tell; only for more of them than ``PASSES`` it pays to build
    :meth:`Index.deletions`, where candidates share a piece with the word."""
    asked = [(p, w, 2 if len(w) >= 7 else 1) for p, w in words if len(w) >= 5 and re.fullmatch(r"[a-z][a-z0-9_]*", w)]
    if not asked:
        return []
    spark = index.vocab.sparkSession
    index.passes += len(asked)
    if index.pieces is None and index.passes <= PASSES:
        few = F.broadcast(spark.createDataFrame([(p, w, most, w[0]) for p, w, most in asked], "place int, token string, most int, head string"))
        alike = reduce(Column.__or__, [(F.col("term") >= c) & (F.col("term") < chr(ord(c) + 1)) for c in sorted({w[0] for _, w, _ in asked})])
        held = index.vocab.where(alike & F.col("term").rlike(ASCII_TERM)).select("term", F.substring("term", 1, 1).alias("head")).join(few, "head")
    else:
        # at most 22 pieces for each word of a request
        probes = [(p, w, most, piece) for p, w, most in asked for piece in pieces_of_word(w, most)]
        few = F.broadcast(spark.createDataFrame(probes, "place int, token string, most int, piece string"))
        held = index.deletions().where(F.col("piece").isin(sorted({x[3] for x in probes}))).join(few, "piece").select("place", "token", "most", "term").distinct()
    met = held.where(F.abs(F.char_length("term") - F.char_length("token")) <= F.col("most"))
    # a swap is two plain edits, so plain distance bounds what is looked at row by row
    met = met.where(F.levenshtein("term", "token", 4).between(0, 2 * F.col("most")))
    scored = met.select("place", "token", "term", X.osa_column(F.col("term"), F.col("token"), F.col("most")).alias("d")).where("d is not null")
    order = Window.partitionBy("place").orderBy("d", F.char_length("term"), X.locale_order(F.col("term")))
    rows = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FUZZY_MOST).orderBy("place", "r").collect()
    return [Variant(r["place"], r["token"], r["term"], "en-fuzzy", FUZZY[r["d"]]) for r in rows]


def idf(n_docs: int, df: int) -> float:
    """Inverse document frequency; what is not positive counts as a millionth."""
    value = math.log((n_docs - df + 0.5) / (df + 0.5))
    return value if value > 0 else 1e-6


def bm25(wtf: Column, n_tokens: Column, weight: Column, avg_len: float) -> Column:
    """Field-weighted BM25 of a posting; ``wtf`` in tenths."""
    f = wtf / F.lit(10.0)
    return weight * (f * (K1 + 1.0)) / (f + K1 * (1.0 - B + B * n_tokens / F.lit(avg_len)))


SCORES = "skill_id string, score double, coverage int, matched_terms array<string>"


def score(index: Index, found: list[Variant]) -> DataFrame:
    """skill_id, score, coverage, matched_terms of all documents with a variant: for
    each query token its best variant, summed in the query's order."""
    return score_many(index, {0: found}).drop("ask")


def score_many(index: Index, asked: dict[int, list[Variant]]) -> DataFrame:
    """:func:`score` for the variants of several queries: ask and its columns."""
    spark = index.postings.sparkSession
    terms = sorted({v.term for found in asked.values() for v in found})
    if not terms:
        return spark.createDataFrame([], f"ask int, {SCORES}")
    dfs = {r["term"]: r["df"] for r in index.vocab.where(F.col("term").isin(terms)).collect()}
    rows = [(ask, v.term, v.place, i, v.weight, idf(index.n_docs, dfs.get(v.term, 0))) for ask, found in asked.items() for i, v in enumerate(found)]
    few = spark.createDataFrame(rows, "ask int, term string, place int, nth int, mult double, idf double")
    # at most 8 variants for each of a request's tokens: bounded, so it is broadcast
    met = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(few), "term")
    each = met.withColumn("s", bm25(F.col("wtf"), F.col("n_tokens"), F.col("idf"), index.avg_len) * F.col("mult")).where("s > 0")
    best = each.groupBy("ask", "skill_id", "place").agg(F.max(F.struct("s", (-F.col("nth")).alias("n"), "term")).alias("b"))
    gathered = best.groupBy("ask", "skill_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("b.s").alias("s"), F.col("b.term").alias("term")))).alias("parts"))
    return gathered.select("ask", "skill_id", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"]).alias("score"), F.size("parts").alias("coverage"), F.transform("parts", lambda p: p["term"]).alias("matched_terms"))


def score_leading(index: Index, found: list[Variant], k: int, direct: int = DIRECT) -> DataFrame:
    """:func:`score` of at least all documents that reach the k-th greatest score. Terms
    with more than ``direct`` postings together are read by :mod:`blocks`."""
    terms = sorted({v.term for v in found})
    dfs = {r["term"]: r["df"] for r in index.vocab.where(F.col("term").isin(terms)).collect()} if terms else {}
    if sum(dfs.values()) <= direct or k < 1:
        return score(index, found)
    weighted = [(v.place, v.term, v.weight * idf(index.n_docs, dfs[v.term])) for v in found if v.term in dfs]
    return score(replace(index, postings=blocks.leading(index, weighted, k, K1, B)), found)


def scope_ranks(corpus: Corpus, scoped: DataFrame | None = None) -> DataFrame:
    """scope (``__unscoped__`` for none), rank: listed priority first, others in byte order."""
    listed = corpus.settings.scope_priority
    seen = (ranking_scopes(corpus) if scoped is None else scoped).select("scope").distinct()
    place = F.coalesce(*[F.when(F.col("scope") == s, F.lit(i)) for i, s in enumerate(listed)], F.lit(len(listed))) if listed else F.lit(0)
    # scopes are few: one row each
    return seen.withColumn("rank", F.row_number().over(Window.orderBy(place, "scope")))


def ranking_scopes(corpus: Corpus) -> DataFrame:
    """skill_id, canonical_name, scope of every document as ranking sees it: its own; if
    that is blank, the scope whose root lies nearest above its source root (of several
    such scopes the first in byte order); else ``__unscoped__``."""
    own = F.nullif(F.btrim("scope"), F.lit(""))
    d = corpus.documents.select("skill_id", "canonical_name", own.alias("own"), "source_root")
    roots = [(s, r.rstrip("/")) for s, rs in corpus.settings.scope_roots.items() for r in rs if r.rstrip("/")]
    # roots of scopes and source roots are few; a literal for each
    above = F.lit(None).cast("string")
    top = F.regexp_replace("source_root", "/+$", "")
    for root, scope in sorted({r: min(s for s, x in roots if x == r) for _, r in roots}.items(), key=lambda x: len(x[0])):
        above = F.when((top == root) | top.startswith(f"{root}/"), F.lit(scope)).otherwise(above)
    return d.select("skill_id", "canonical_name", F.coalesce("own", above, F.lit("__unscoped__")).alias("scope"))


def ranked(corpus: Corpus, index: Index, query: str | None, limit: int, min_score: float = 0.0, direct: int = DIRECT) -> DataFrame:
    """The best documents for a query: rank, document columns, score, coverage,
    matched_terms; ordered by score, coverage, scope rank, name."""
    hits = score_leading(index, variants(index, query or ""), limit, direct).where((F.col("score") >= min_score) & (F.col("score") > 0))
    thin = ranking_scopes(corpus)
    ordered = hits.join(thin, "skill_id").join(scope_ranks(corpus, thin), "scope", "left")
    order = [F.col("score").desc(), F.col("coverage").desc(), F.col("rank"), X.locale_order(F.col("canonical_name"))]
    top = ordered.orderBy(*order).limit(limit).select("skill_id", "score", "coverage", "matched_terms", F.col("rank").alias("scope_rank"))
    numbered = top.join(corpus.documents, "skill_id")
    # at most ``limit`` rows stand here, so one task numbers them
    final = [F.col("score").desc(), F.col("coverage").desc(), F.col("scope_rank"), X.locale_order(F.col("canonical_name"))]
    return numbered.withColumn("rank", F.row_number().over(Window.orderBy(*final)))


def fallback_query(index: Index, query: str) -> str | None:
    """What is asked instead of a query without hits."""
    words = query_tokens(index.vocab.sparkSession, query)
    kept = [w for w in words if w not in FALLBACK_DROPPED]

    def indexed(word: str) -> bool:
        match = F.col("term") == word
        return bool(index.vocab.where(match | F.col("term").startswith(word) if len(word) >= 4 else match).take(1))

    if held := [w for w in kept if indexed(w)]:
        return " ".join(held)
    if any(w in FALLBACK_TRIGGERS for w in words):
        return FALLBACK_QUERIES[0]
    return FALLBACK_QUERIES[1] if "skill" in words else None


@dataclass
class Found:
    """Hits and how they came about."""

    hits: DataFrame
    query: str
    mode: str
    aliases: list[str]


def evidence(found: Found, asked: str) -> tuple[list[str], dict[str, str | None]]:
    """Names of the hits in order, and why the first is the first or why there is none."""
    rows = found.hits.select("rank", "canonical_name", "matched_terms", "score").orderBy("rank").collect()
    if not rows:
        why = f"the rewritten query {found.query!r} has no hits either" if found.query != asked.strip() else "no token of the query is in the index"
        return [], {"why_top": None, "why_none": why}
    first = rows[0]
    return [r["canonical_name"] for r in rows], {"why_top": f"{first['canonical_name']} matched {', '.join(first['matched_terms']) or 'its score'} with score {first['score']:.3f}", "why_none": None}


def matched_aliases(hits: DataFrame, query: str) -> list[str]:
    """Aliases of hits that the query contains or shares a token with."""
    spark = hits.sparkSession
    words = F.array(*[F.lit(w) for w in query_tokens(spark, query)]).cast("array<string>")
    rows = hits.select(F.explode("aliases").alias("a")).where(F.lit(query.lower()).contains(F.lower("a")) | F.arrays_overlap(X.tokens(F.col("a")), words))
    return sorted(r["a"] for r in rows.distinct().collect())


def search(corpus: Corpus, index: Index, query: str, limit: int, min_score: float = 0.0) -> Found:
    """Ranked hits; a query without any is rewritten once."""
    asked = query.strip()
    hits = written(ranked(corpus, index, asked, limit, min_score), "hits")
    if hits.take(1):
        return Found(hits, asked, "none", matched_aliases(hits, asked))
    other = fallback_query(index, asked)
    if other and other != asked:
        again = written(ranked(corpus, index, other, limit, min_score), "hits")
        if again.take(1):
            return Found(again, other, "query-rewrite", matched_aliases(again, other))
    return Found(hits, other or asked, "safe-zero", [])


def named(corpus: Corpus, names: list[str]) -> DataFrame:
    """Requested names through aliases: pos, requested, and the document (null where
    none); the first request of a document stands."""
    spark = corpus.spark
    asked = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, requested string")
    real = F.broadcast(asked).join(corpus.aliases, asked["requested"] == corpus.aliases["alias"], "left")
    real = real.select("pos", "requested", F.coalesce(corpus.aliases["canonical_name"], asked["requested"]).alias("name"))
    # names of one request: written and broadcast, so that only what they name is shuffled
    real = written(real, "asked")
    held = corpus.documents.join(F.broadcast(real.select(F.col("name").alias("canonical_name"))), "canonical_name", "left_semi").select(corpus.documents.columns)
    met = real.join(held, real["name"] == held["canonical_name"], "left").drop("name")
    first = Window.partitionBy(F.coalesce("canonical_name", F.concat(F.lit("\0"), F.col("pos").cast("string")))).orderBy("pos")
    return met.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def effective_chars(chars: int, tokens: int) -> int:
    return min(chars, tokens * 4) if chars > 0 and tokens > 0 else max(chars, tokens * 4)


def budget_fold(entries: DataFrame, order: list[Column], body: str, budget: int) -> DataFrame:
    """name, included for the documents that a request names, see
    :mod:`corpusloom.operators.budget`: they are no more than its names, so their names
    and lengths are one array and take no pass."""
    size = F.char_length(F.coalesce(F.col(body), F.lit("")))
    rows = entries.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("name").alias("name"), size.alias("n")).alias("e"))
    line = rows.agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["name"].alias("name"), e["n"].cast("long").alias("n"))).alias("line"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<name:string,included:boolean>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        fits = (F.lit(budget) <= 0) | (a["used"] + e["n"] <= budget)
        taken = F.when(e["n"] > 0, fits)
        return F.struct((a["used"] + F.when(F.coalesce(taken, F.lit(False)), e["n"]).otherwise(0)).alias("used"), F.concat(a["out"], F.array(F.struct(e["name"].alias("name"), taken.alias("included")))).alias("out"))

    return line.select(F.inline(F.aggregate("line", start, step)["out"]))


def resolve(corpus: Corpus, index: Index | None, names: list[str], include_body: bool, chars: int, tokens: int, suggestions: int = SUGGESTIONS) -> dict[str, DataFrame]:
    """Exact lookup: resolved (in request order, bodies within the budget), missing
    names, and suggestions for these."""
    found = named(corpus, names)
    budget = effective_chars(chars, tokens)
    hit = found.where("canonical_name is not null").withColumn("name", F.col("canonical_name"))
    fold = budget_fold(hit, [F.col("pos")], "body_text", budget)
    rows = hit.join(fold, "name", "left")
    body = F.when(F.lit(include_body) & F.col("included"), F.col("body_text"))
    resolved = rows.select("pos", "name", X.read_path(F.col("name")).alias("read_path"), "path", "title", "category", "scope", "aliases", "requires", "recommends", X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("preview"), body.alias("body"), (F.lit(include_body) & F.coalesce(~F.col("included"), F.lit(False))).alias("omitted_by_budget"))
    missing = found.where("canonical_name is null").select("pos", "requested")
    return {"resolved": resolved, "missing": missing, "suggestions": suggest(corpus, index, missing, suggestions)}


def suggest(corpus: Corpus, index: Index | None, missing: DataFrame, limit: int) -> DataFrame:
    """name, read_path, confidence: near names among the best hits of a missing name."""
    spark, schema = corpus.spark, "name string, read_path string, confidence double"
    limit = max(0, min(limit, SUGGESTIONS_MOST))
    if not limit or index is None:
        return spark.createDataFrame([], schema)
    # names of one request, each of them bounded by the request's own size
    names = {i: r["requested"] for i, r in enumerate(missing.orderBy("pos").collect()) if 0 < len(r["requested"].strip()) <= 256}
    out: dict[str, float] = {}
    for name, confidence in _near_names(corpus, index, names):
        out.setdefault(name, X.fixed3(confidence))
    best = sorted(out.items(), key=lambda x: (-x[1], x[0]))[:limit]
    kept, used, words = [], 0, 0
    for name, confidence in best:
        shown = json.dumps({"name": name, "readPath": f"skill://{name}", "confidence": confidence}, ensure_ascii=False, separators=(",", ":"))
        size, count = len(shown.encode()), len(shown.split())
        if used + size <= RECOVERY_BYTES and words + count <= RECOVERY_TOKENS:
            kept.append((name, f"skill://{name}", confidence))
            used, words = used + size, words + count
    return spark.createDataFrame(kept, schema)


def _near_names(corpus: Corpus, index: Index, names: dict[int, str]) -> list[tuple[str, float]]:
    """Names and their similarity among the best hits of each missing name, in the
    order of the names and of their hits; all names are searched for at once."""
    spark = corpus.spark
    if not names:
        return []
    cut = spark.createDataFrame(list(names.items()), "ask int, q string").select("ask", "q", F.array_distinct(X.tokens(F.col("q"))).alias("t")).collect()
    words = list(dict.fromkeys(t for r in cut for t in r["t"]))
    of: dict[str, list[Variant]] = {}
    for v in variants_of(index, words):
        of.setdefault(v.token, []).append(v)
    asked = {r["ask"]: [replace(v, place=k) for k, t in enumerate(r["t"]) for v in of.get(t, ())] for r in cut}
    thin = ranking_scopes(corpus)
    hits = score_many(index, asked).where("score > 0").join(thin, "skill_id").join(scope_ranks(corpus, thin), "scope", "left")
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("coverage").desc(), F.col("rank"), X.locale_order(F.col("canonical_name")))
    top = written(hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SUGGESTIONS_MOST).select("ask", "place", "skill_id"), "near")
    # what has no hit and speaks of reports or skills is searched for as a query would be
    met = {r["ask"] for r in top.select("ask").distinct().collect()}
    for r in cut:
        if r["ask"] not in met and {*FALLBACK_TRIGGERS, "skill"}.intersection(r["t"]):
            again = search(corpus, index, r["q"], SUGGESTIONS_MOST).hits
            top = top.unionByName(again.select(F.lit(r["ask"]).alias("ask"), F.col("rank").alias("place"), "skill_id"))
    few = F.broadcast(spark.createDataFrame([(a, n.strip().lower()) for a, n in names.items()], "ask int, wanted string"))
    shown = top.join(few, "ask").join(corpus.documents.select("skill_id", "canonical_name", "aliases"), "skill_id")
    alike = F.array_max(F.transform(F.concat(F.array("canonical_name"), "aliases"), lambda c: X.similarity(F.lower(c), F.col("wanted"))))
    rows = shown.select("ask", "place", "canonical_name", alike.alias("c")).where(F.col("c") >= SUGGESTION_LEAST).orderBy("ask", "place").collect()
    return [(r["canonical_name"], r["c"]) for r in rows]


def bounded_text(text: str, most_bytes: int = RECOVERY_BYTES, most_tokens: int = RECOVERY_TOKENS) -> str:
    """The longest beginning of a text within both bounds."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        fits = len(text[:mid].encode("utf-8", "surrogatepass")) <= most_bytes and len(text[:mid].split()) <= most_tokens
        low, high = (mid, high) if fits else (low, mid - 1)
    return text[:low]


def gap(corpus: Corpus, index: Index, query: str, names: list[str], threshold: float, limit: int, min_score: float = 0.0) -> dict[str, DataFrame]:
    """Whether the corpus covers a query: candidates, and one row with covered and
    uncovered terms, ratio, action and scaffold."""
    hits = ranked(corpus, index, query, limit, min_score)
    if names:
        allowed = named(corpus, names).where("canonical_name is not null").select("canonical_name")
        hits = hits.join(allowed, "canonical_name", "left_semi")
    words = F.array(*[F.lit(w) for w in query_tokens(corpus.spark, query)]).cast("array<string>")
    one = hits.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("covered_terms"), F.count("*").alias("candidates"))
    one = one.withColumn("uncovered_terms", F.array_except(words, "covered_terms"))
    ratio = F.when(F.size(words) > 0, F.size("covered_terms") / F.greatest(F.size(words), F.lit(1))).otherwise(0.0)
    action = F.when((F.col("candidates") > 0) & (ratio >= threshold), "use-existing").when(F.size("covered_terms") > 0, "add-alias").otherwise("create-skill")
    one = one.withColumn("coverage_ratio", ratio).withColumn("recommended_action", action).withColumn("ok", action == "use-existing")
    scaffold = F.struct(F.coalesce(F.nullif(F.array_join(F.slice(words, 1, 3), "-"), F.lit("")), F.lit("new-skill")).alias("name"), F.lit("custom").alias("category"), F.slice(words, 1, 5).alias("keywords"), F.lit(f"{query.strip()} coverage scaffold").alias("description"), F.lit("").alias("body"))
    one = one.withColumn("scaffold", F.when(~F.col("ok"), scaffold))
    candidates = hits.select("rank", F.col("canonical_name").alias("name"), X.read_path(F.col("canonical_name")).alias("read_path"), "path", "title", "category", "scope", "aliases", "score", "coverage", "matched_terms", X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("preview"))
    return {"gap": one, "candidates": candidates}

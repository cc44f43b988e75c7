"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of transformed statistics. Per language and source the
minimum covariance determinant (MCD) is sought: the half of the rows whose
covariance has the least determinant. Two deterministic starts (medians with
absolute deviations, and classical moments) are improved by ``steps`` concentration
steps (take the half nearest by Mahalanobis distance, re-estimate); the start with
the lesser determinant is kept and concentrated until no determinant falls any more
(``most_steps`` at most), re-weighted once, and rows beyond the chi-square quantile
of the distance are rejected.

The half is found deterministically: squared distances fall into logarithmic bins
(32 to a natural logarithm), sums of moments are gathered for each (group, start,
bin) before the shuffle, and bins are accumulated up to the half. Of the bin that
crosses it every row counts with the same fraction, so that the weights add up to
the half exactly. A hot source is a few thousand rows after partial aggregation; no
group is ever gathered, and the small tables of estimates are joined by broadcast
where their counted rows are few, else with salted keys (:func:`_by_group`), so no
row is dealt by its group alone.
Covariances carry a ridge (``FLOORS``): spreads below it do not count as deviation,
so that statistics which are zero in most texts leave the estimate regular.

Groups of fewer than ``least_rows`` rows are estimated with the other small groups
of their language, and if these are too few as well, with those of all languages.

Defined results: null texts, empty texts and texts without words have zero
statistics and fail the base rule; null languages and sources are groups like any
other; equal rows have equal verdicts; with too few rows for any estimate only the
base rule decides; further columns do not matter, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import named_back, plainly_named, written

#: ln words, ln mean word length, roots of the shares of symbols, repeated lines, repeated words.
DIMENSIONS = 5
#: Least spreads that count, in the order of the statistics.
FLOORS = (0.6, 0.12, 0.05, 0.15, 0.15)
P = DIMENSIONS
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _chi_square(x: float, k: int) -> float:
    """Cumulative chi-square distribution, by the series of the incomplete gamma function."""
    term = total = 1 / (k / 2)
    for i in range(1, 500):
        term *= (x / 2) / (k / 2 + i)
        total += term
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def _quantile(share: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square(mid, k) < share else (low, mid)
    return low


def _consistency(share: float) -> float:
    """What makes the covariance of the nearest share of normal rows that of all."""
    return share / _chi_square(_quantile(share, P), P + 2)


HALF, WEIGHTED = 0.5, 0.975
#: The fall of a log determinant that is worth another concentration step.
FALL = 0.01


#: Hash of three words, by which windows are sorted before their words are compared.
HASH = "xxhash64({0}, {1}, {2})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated() -> str:
    """Words in windows of three that occur twice in the array w of words; m is a mask
    of the low bits that hold a window's place beside its hash."""

    def alike(k: str) -> str:
        return f"((x | m) <=> (get(s, {k}) | m))"

    def at(place: str) -> str:
        return f"struct(get(w, int({place})), get(w, int({place}) + 1), get(w, int({place}) + 2))"

    def equal(k: str) -> str:
        return f"({alike(k)} AND {at('x & m')} = {at(f'get(s, {k}) & m')})"

    # neighbours of one hash are compared word for word; where windows of one hash differ (hashes seldom meet), with all of that hash
    among = f"exists(s, y -> y != x AND (y | m) = (x | m) AND {at('y & m')} = {at('x & m')})"
    met = f"CASE WHEN NOT {alike('k - 1')} AND NOT {alike('k + 1')} THEN NULL WHEN {equal('k - 1')} OR {equal('k + 1')} THEN x & m WHEN {among} THEN x & m END"
    places = f"sort_array(filter(transform(s, (x, k) -> {met}), p -> p IS NOT NULL))"
    covered = "aggregate(transform(p, (x, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, int(x - get(p, k - 1))) END), 0L, (a, x) -> a + x)"
    full = _let("sort_array(transform(h, (x, i) -> x | i))", "s", _let(places, "p", covered))
    hashes = f"transform(sequence(0, size(w) - 3), i -> {HASH.format('get(w, i)', 'get(w, i + 1)', 'get(w, i + 2)')} & ~m)"
    # most texts have no two windows of one hash
    some = _let(hashes, "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {full} END")
    return f"CASE WHEN size(w) < 3 THEN 0L ELSE {_let('shiftleft(1L, int(ceil(log2(size(w) + 1)))) - 1', 'm', some)} END"


def statistics(text: str) -> list[Column]:
    """counted (n_words, word_chars, n_repeat_words), n_symbols, lined (n_lines, n_dup_lines) of a text."""
    t = f"coalesce(`{text}`, '')"
    counted = _let(f"regexp_extract_all({t}, r'[^ \\t-\\r]+', 0)", "w", f"named_struct('n_words', bigint(size(w)), 'word_chars', bigint(char_length(array_join(w, ''))), 'n_repeat_words', {_repeated()})")
    lined = _let(f"filter(split({t}, '\\n'), x -> x RLIKE r'[^ \\t-\\r]')", "x", "named_struct('n_lines', bigint(size(x)), 'n_dup_lines', bigint(size(x) - size(array_distinct(x))))")
    return [F.expr(counted).alias("counted"), F.expr(f"bigint(regexp_count({t}, r'[#*$%&|<>]'))").alias("n_symbols"), F.expr(lined).alias("lined")]


def base(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the statistics and base_failed."""
    s = docs.select(*keep, *statistics(text)).select(*keep, "counted.n_words", "counted.word_chars", "n_symbols", "lined.n_dup_lines", "counted.n_repeat_words", "lined.n_lines")
    return s.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


# Expressions of many terms are SQL texts: one call each instead of one for every term.
_N, _C = "greatest(n_words, 1)", "greatest(word_chars, 1)"
TRANSFORMED = (f"ln(double({_N}))", f"ln({_C} / {_N})", f"sqrt(n_symbols / {_C})", "sqrt(n_dup_lines / greatest(n_lines, 1))", f"sqrt(n_repeat_words / {_N})")
Z = [f"z{i}" for i in range(P)]


def transformed() -> list[Column]:
    return [F.expr(f"{t} AS {z}") for t, z in zip(TRANSFORMED, Z, strict=True)]


def _inverse(cells: str) -> str:
    """Inverse of a positive definite matrix (flat array of P * P) by Gauss-Jordan
    steps, with the log determinant as a last element."""
    row, column, d = f"m[k * {P} + t % {P}]", f"m[t div {P} * {P} + k]", f"m[k * {P} + k]"
    entry = f"CASE WHEN t = {P * P} THEN m[t] + ln({d}) WHEN t div {P} = k AND t % {P} = k THEN 1 / {d} WHEN t div {P} = k THEN {row} / {d} WHEN t % {P} = k THEN -{column} / {d} ELSE m[t] - {column} * {row} / {d} END"
    return f"aggregate(sequence(0, {P - 1}), concat({cells}, array(0D)), (m, k) -> transform(sequence(0, {P * P}), t -> {entry.replace(' div ', ' DIV ').replace('m[', 'get(m, int(').replace(']', '))')}))"


def _estimates(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means m*, precisions q*_* and log determinant from n, sums s* and products s*_*."""

    def cell(i: int, j: int) -> str:
        a, b = min(i, j), max(i, j)
        value = f"{factor!r}D * (s{a}_{b} / n - s{a} / n * s{b} / n)"
        return f"greatest({value}, 0D) + {FLOORS[i] ** 2!r}D" if i == j else value

    flat = ", ".join(cell(i, j) for i in range(P) for j in range(P))
    # rounding may leave a matrix that is not quite positive: then its diagonal stands
    diagonal = ", ".join(cell(i, j) if i == j else "0D" for i in range(P) for j in range(P))
    out = moments.selectExpr(*keys, *[f"s{i} / n AS m{i}" for i in range(P)], f"array({flat}) AS f", f"array({diagonal}) AS g")
    out = out.selectExpr(*keys, *[f"m{i}" for i in range(P)], f"{_inverse('f')} AS a", f"{_inverse('g')} AS b")
    sound = f"forall(sequence(0, {P - 1}), i -> coalesce(a[i * {P + 1}] > 0 AND NOT isnan(a[i * {P + 1}]), false)) AND NOT isnan(coalesce(a[{P * P}], double('NaN')))"
    out = out.selectExpr(*keys, *[f"m{i}" for i in range(P)], f"CASE WHEN {sound} THEN a ELSE b END AS a")
    return out.selectExpr(*keys, *[f"m{i}" for i in range(P)], *[f"a[{i * P + j}] AS q{i}_{j}" for i, j in PAIRS], f"a[{P * P}] AS logdet")


DISTANCE = "greatest(" + " + ".join(f"{1 if i == j else 2} * q{i}_{j} * (z{i} - m{i}) * (z{j} - m{j})" for i, j in PAIRS) + ", 0D)"


def _moments() -> list[Column]:
    return [F.expr(e) for e in ("count(*) AS n", *(f"sum({z}) AS s{i}" for i, z in enumerate(Z)), *(f"sum(z{i} * z{j}) AS s{i}_{j}" for i, j in PAIRS))]


_MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]


#: Rows of a table of estimates (25 numbers each) up to which it is broadcast, and salts beyond it.
BROADCAST_ROWS, SALTS = 50_000, 64


def _by_group(rows: DataFrame, few: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``few`` (a written table of few rows a gid)."""
    if small:
        return rows.join(F.broadcast(few), "gid", how)
    salted = rows.withColumn("__salt", _salt())
    return salted.join(few.withColumn("__salt", _salts()), ["gid", "__salt"], how).drop("__salt")


def _salt() -> Column:
    return F.expr(f"int(pmod(xxhash64({', '.join(Z)}), {SALTS}))")


def _salts() -> Column:
    return F.expr(f"explode(sequence(0, {SALTS - 1}))")


def _grouped(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """``rows`` with their gid (null where no group has their language and source)."""
    same = F.expr("lang <=> gl AND source <=> gs")
    if small:
        return rows.join(F.broadcast(groups), same, "left").drop("gl", "gs")
    return rows.withColumn("__salt", _salt()).join(groups.withColumn("__many", _salts()), same & F.expr("__salt = __many"), "left").drop("gl", "gs", "__salt", "__many")


def _nearest(rows: DataFrame, estimates: DataFrame, sizes: DataFrame, small: bool) -> DataFrame:
    """One concentration step: moments of each group's nearer half, for each start."""
    near = _by_group(rows, estimates, small)
    bins = near.withColumn("bin", F.expr(f"floor(ln({DISTANCE} + 1e-9D) * 32)")).groupBy("gid", "start", "bin").agg(*_moments())
    before = bins.withColumn("before", F.expr("coalesce(sum(n) OVER (PARTITION BY gid, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).join(sizes, "gid").where("before < half")
    return before.groupBy("gid", "start").agg(*[F.expr(f"sum({c} * least(1D, (half - before) / n)) AS {c}") for c in _MOMENTS])


def estimates(rows: DataFrame, least_rows: int = 60, steps: int = 2, most_steps: int = 10) -> tuple[DataFrame, DataFrame, bool]:
    """From ``rows`` (a written table with lang, source and the statistics): groups
    (gl, gs, gid), for each gid the re-weighted robust mean and precision, and whether
    these tables are small. Both are written tables with a row a group."""
    vectors = rows.where("n_words > 0").select("lang", "source", *transformed())
    # groups: (language, source), or what small ones are pooled to
    sizes = vectors.groupBy("lang", "source").count()
    by_lang = sizes.where(F.col("count") < least_rows).groupBy(F.col("lang").alias("l")).agg(F.sum("count").alias("pooled"))
    gid = F.expr(f"""CASE WHEN count >= {least_rows} THEN to_json(struct(2 AS of, lang, source)) WHEN pooled >= {least_rows} THEN to_json(struct(1 AS of, lang)) ELSE '{{"of":0}}' END""")
    groups = written(sizes.join(by_lang, F.expr("lang <=> l"), "left").select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "count", gid.alias("gid")), "groups")
    small = 2 * groups.count() <= BROADCAST_ROWS
    usable = written(_grouped(vectors, groups.drop("count"), small).select("gid", *Z), "vectors")
    halves = written(groups.groupBy("gid").agg(F.sum("count").alias("rows")).where(f"rows >= {2 * P}").select("gid", F.expr(f"ceil(rows * {HALF}) AS half")), "halves")
    # starts: medians and median deviations, classical moments
    classical = usable.groupBy("gid").agg(*_moments()).select("gid", F.lit(1).alias("start"), *_MOMENTS)
    middle = written(_medians(usable), "medians")
    spread = _medians(_by_group(usable, middle, small).selectExpr("gid", *[f"abs(z{i} - c{i}) AS z{i}" for i in range(P)]))
    robust = middle.join(spread.selectExpr("gid", *[f"c{i} AS d{i}" for i in range(P)]), "gid")
    robust = robust.selectExpr("gid", "0 AS start", *[f"c{i} AS m{i}" for i in range(P)], *[f"1 / (pow(1.4826D * d{i}, 2) + {FLOORS[i] ** 2!r}D) AS q{i}_{j}" if i == j else f"0D AS q{i}_{j}" for i, j in PAIRS], "0D AS logdet")
    found = written(robust.unionByName(_estimates(classical, ["gid", "start"], 1.0)), "starts")
    for _ in range(steps):
        found = written(_estimates(_nearest(usable, found, halves, small), ["gid", "start"], _consistency(HALF)), "halved")
    best = found.groupBy("gid").agg(F.min_by(F.struct(*[c for c in found.columns if c != "gid"]), F.struct("logdet", "start")).alias("e")).select("gid", "e.*")
    best = written(best, "best")
    for _ in range(steps, most_steps):
        better = written(_estimates(_nearest(usable, best, halves, small), ["gid", "start"], _consistency(HALF)), "better")
        falls = best.selectExpr("gid", "logdet AS was").join(better.select("gid", "logdet"), "gid").where(f"logdet < was - {FALL}")
        if not falls.take(1):
            break
        best = better
    best = best.drop("start")
    inner = _by_group(usable, best, small).where(F.expr(f"{DISTANCE} <= {_quantile(WEIGHTED, P)!r}D")).groupBy("gid").agg(*_moments())
    return groups.select("gl", "gs", "gid"), written(_estimates(inner, ["gid"], _consistency(WEIGHTED)), "weighted"), small


def judged(rows: DataFrame, groups: DataFrame, final: DataFrame, small: bool, level: float = 0.99999) -> DataFrame:
    """``rows`` with ``distance`` (squared, robust; null if there is no estimate) and
    ``inlier``. Both joins are with tables of a row a group."""
    vectors = rows.select("*", *transformed())
    near = _by_group(_grouped(vectors, groups, small), final, small, "left").withColumn("distance", F.expr(f"CASE WHEN n_words > 0 THEN {DISTANCE} END"))
    return near.select(*rows.columns, "distance", F.expr(f"distance IS NULL OR distance <= {_quantile(level, P)!r}D").alias("inlier"))


def _medians(rows: DataFrame) -> DataFrame:
    """gid, c0.. : medians of z0.. of each group, of values to a hundredth: a task holds
    counts of these, of which there are a few thousand at most, and one row a task and
    group is shuffled."""
    return rows.groupBy("gid").agg(*[F.expr(f"percentile(round({z}, 2), 0.5) AS c{i}") for i, z in enumerate(Z)])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row."""
    rows = written(base(docs, ["doc_id", "lang", "source"]), "statistics")
    found = judged(rows, *estimates(rows))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("inlier")).alias("kept"), "distance")


def stage(docs: DataFrame) -> DataFrame:
    """The kept rows. Texts are written once beside their statistics; they are shuffled
    only where there are more than ``BROADCAST_ROWS`` groups, and then by salted keys."""
    plain, names = plainly_named(docs)
    named = plain.select(F.struct(*plain.columns).alias("row"), *[F.col(names[c]).alias(c) for c in ("lang", "source", "text")])
    rows = written(base(named, ["lang", "source", "row"]), "statistics")
    kept = judged(rows, *estimates(rows.drop("row"))).where(~F.col("base_failed") & F.col("inlier"))
    return named_back(kept.select("row.*"), names)

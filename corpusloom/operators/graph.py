"""Relations between documents: edges, reach, components, layers, composition.

Every algorithm has a distributed form (frontier and relaxation loops over written
tables) and a local form that runs in one task. The local form is taken when the
counted edges are at most ``LOCAL_EDGES``, a bound on that task's memory; both give
the same rows. Components and layers send only edges to that task: nodes without any
are alone, however many they are.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.chains import contracted, longest, thickened, thinned, trimmed
from corpusloom.operators.corpus import Corpus, Settings, owners, preferred, scoped, winning
from corpusloom.operators.ranks import numbered as placed
from corpusloom.operators.tables import shuffled, written
from corpusloom.operators.walk import REASONS, walk

LOCAL_EDGES = 400_000
#: Rounds of a loop after which what it gathered is written as one table.
REWRITE = 8
#: Rows of a front that go to all tasks, so that arcs needn't be shuffled to meet them.
FEW = 5_000


def edges(corpus: Corpus) -> DataFrame:
    """from_name, target, to_name (null if unresolved), relation, resolved, pos."""
    return _resolved(_asked(corpus.documents, "requires").unionByName(_asked(corpus.documents, "recommends")), corpus.aliases)


def linked(documents: DataFrame, settings: Settings, relation: str) -> tuple[DataFrame, DataFrame]:
    """Names (name) of the corpus of ``documents`` and its :func:`edges` of one relation, by
    names, paths, times and aliases alone: bodies aren't read, conflicts aren't logged, and
    owners are found for the aliases that the relation has."""
    winners, _ = winning(scoped(documents, settings), settings.scope_priority)
    rows = _asked(winners, relation)
    targets = rows.select(F.col("target").alias("alias")).distinct()
    to = preferred(owners(winners, settings.scope_priority).join(shuffled(targets), "alias", "left_semi"))
    return winners.select(F.col("canonical_name").alias("name")), _resolved(rows, to)


def _asked(documents: DataFrame, relation: str) -> DataFrame:
    return documents.select(F.col("canonical_name").alias("from_name"), F.posexplode(relation).alias("pos", "target"), F.lit(relation).alias("relation"))


def _resolved(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    to = aliases.select(F.col("alias").alias("target"), F.col("canonical_name").alias("to_name"))
    joined = rows.join(to, "target", "left")
    return joined.select("from_name", "target", "to_name", "relation", F.col("to_name").isNotNull().alias("resolved"), "pos")


def arcs(edge_rows: DataFrame) -> DataFrame:
    """Distinct resolved (u, v)."""
    return edge_rows.where("to_name is not null").select(F.col("from_name").alias("u"), F.col("to_name").alias("v")).distinct()


def _fits(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


# ---- local forms -----------------------------------------------------------------


def adjacency(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for u, v in pairs:
        out.setdefault(u, []).append(v)
    return out


def reach_of(pairs: Iterable[tuple[str, str]], seeds: Iterable[str]) -> dict[str, int]:
    """Nodes that seeds lead to, with their distance."""
    near = adjacency(pairs)
    found = dict.fromkeys(seeds, 0)
    line = deque(found)
    while line:
        u = line.popleft()
        for v in near.get(u, ()):
            if v not in found:
                found[v] = found[u] + 1
                line.append(v)
    return found


def components_of(nodes: Iterable[str], pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """node -> least member of its strongly connected component (two sweeps)."""
    nodes = sorted(set(nodes))
    held = set(nodes)
    pairs = [(u, v) for u, v in pairs if u in held and v in held]
    ahead, behind = adjacency(pairs), adjacency((v, u) for u, v in pairs)
    done: set[str] = set()
    order: list[str] = []
    for root in nodes:
        if root in done:
            continue
        done.add(root)
        stack = [(root, iter(ahead.get(root, ())))]
        while stack:
            u, rest = stack[-1]
            for v in rest:
                if v not in done:
                    done.add(v)
                    stack.append((v, iter(ahead.get(v, ()))))
                    break
            else:
                order.append(u)
                stack.pop()
    root_of: dict[str, str] = {}
    for start in reversed(order):
        if start in root_of:
            continue
        members, line = [start], [start]
        root_of[start] = start
        while line:
            for v in behind.get(line.pop(), ()):
                if v not in root_of:
                    root_of[v] = start
                    members.append(v)
                    line.append(v)
        least = min(members)
        for m in members:
            root_of[m] = least
    return root_of


def levels_of(root_of: dict[str, str], pairs: Iterable[tuple[str, str]]) -> tuple[dict[str, int], dict[str, int]]:
    """Per node its read level (dependencies first) and apply level (dependents first)
    over the components' acyclic graph: the longest path from a start."""

    def longest(links: set[tuple[str, str]]) -> dict[str, int]:
        ahead = adjacency(links)
        waiting = dict.fromkeys(root_of.values(), 0)
        for _, v in links:
            waiting[v] += 1
        level = {c: 0 for c, n in waiting.items() if not n}
        line = deque(level)
        while line:
            u = line.popleft()
            for v in ahead.get(u, ()):
                level[v] = max(level.get(v, 0), level[u] + 1)
                waiting[v] -= 1
                if not waiting[v]:
                    line.append(v)
        return level

    between = {(root_of[u], root_of[v]) for u, v in pairs if u in root_of and v in root_of and root_of[u] != root_of[v]}
    apply, read = longest(between), longest({(v, u) for u, v in between})
    return {n: read[c] for n, c in root_of.items()}, {n: apply[c] for n, c in root_of.items()}


def locale_key(name: str) -> tuple:
    """Language-aware order of names: signs, digits, letters; accents and case last."""
    plain = unicodedata.normalize("NFD", name)
    base = [(0 if not c.isalnum() else 1 if c.isdigit() else 2, "_-".find(c) if c in "_-" else 2, c.casefold()) for c in plain if not unicodedata.combining(c)]
    return base, plain, name


def compose_of(seeds: list[str], targets: Callable[[str], list[tuple[str, str | None, str]]]) -> tuple[dict[str, tuple[str, int, str | None]], set[tuple[str, str, str, int]]]:
    """Label-correcting walk from seeds: per document its best (reason, depth, via),
    where a stronger reason beats a smaller depth beats a smaller via, and improved
    documents are opened again; and the missing relations met (relation, target,
    via, depth). ``targets`` gives (target, document or None, reason) in order."""
    best: dict[str, tuple[str, int, str | None]] = {s: ("seed", 0, None) for s in seeds}
    line = deque((s, best[s]) for s in best)
    opened: dict[str, tuple] = {}
    missing: set[tuple[str, str, str, int]] = set()
    while line:
        name, label = line.popleft()
        if best[name] != label or opened.get(name) == label:
            continue
        opened[name] = label
        for target, to, reason in targets(name):
            if to is None:
                missing.add((reason, target, name, label[1] + 1))
                continue
            offer, held = (reason, label[1] + 1, name), best.get(to)
            if held is not None:
                strength = REASONS[reason] - REASONS[held[0]]
                if strength < 0 or not strength and (offer[1], locale_key(name)) >= (held[1], locale_key(held[2] or "")):
                    continue
            best[to] = offer
            line.append((to, offer))
    return best, missing


# ---- operators -------------------------------------------------------------------


def reach(pairs: DataFrame, seeds: list[str], inbound: bool = False, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """name, depth of all nodes that seeds lead to (or that lead to seeds)."""
    spark = pairs.sparkSession
    if inbound:
        pairs = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    start = spark.createDataFrame([(s, 0) for s in dict.fromkeys(seeds)], "name string, depth int")
    if not seeds:
        return start
    if _fits(pairs, local_edges):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            found = reach_of(zip(rows["u"], rows["v"], strict=True), seeds)
            return pd.DataFrame({"name": list(found), "depth": list(found.values())})

        found = pairs.groupBy().applyInPandas(run, "name string, depth int")
        return found.unionByName(start).groupBy("name").agg(F.min("depth").alias("depth"))
    pairs = written(pairs, "arcs")
    seen, front, depth = written(start, "reached"), start, 0
    while front.take(1):
        depth += 1
        step = front.join(pairs, front["name"] == pairs["u"]).select(F.col("v").alias("name")).distinct()
        front = written(step.join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
        if depth % REWRITE == 0:
            # so that the plan doesn't grow with the depth
            seen = written(seen, "reached")
    return seen


def strong_components(nodes: DataFrame, pairs: DataFrame, local_edges: int = LOCAL_EDGES, inside: bool = False) -> DataFrame:
    """name, root (least member) for every node of ``nodes`` (name), over arcs among them;
    ``inside``: ``pairs`` has no others."""
    inner = _inner(nodes, pairs, inside)
    found = _at_once(inner) if _fits(inner, local_edges) else _merged(written(inner.distinct(), "arcs"), local_edges)
    return _rooted(nodes, found)


def _inner(nodes: DataFrame, pairs: DataFrame, inside: bool) -> DataFrame:
    """The arcs of ``pairs`` among ``nodes``, without those of a node to itself."""
    pairs = pairs.select("u", "v").where("u <> v")
    return pairs if inside else pairs.join(shuffled(nodes.select(F.col("name").alias("u"))), "u", "left_semi").join(shuffled(nodes.select(F.col("name").alias("v"))), "v", "left_semi").select("u", "v")


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """name, root of all ``nodes``: those that ``found`` (name, root) lacks are alone."""
    return nodes.select("name").distinct().join(shuffled(found), "name", "left").select("name", F.coalesce("root", "name").alias("root"))


def _merged(arc: DataFrame, local_edges: int) -> DataFrame:
    """name, root (least member) of at least the nodes that share a component with others,
    over ``arc`` (u, v; distinct, without loops, written).

    Nodes without ways in or out are dropped while they are many, paths of nodes with one
    way in and one out become single arcs, see :mod:`corpusloom.operators.chains`, nodes
    with one way in or out are passed by, and :func:`_coloured` finds the components of what
    is left, if that doesn't fit. The nodes of a path belong to the component of its two
    ends where these share one, else each is its own."""
    rings, paths, taken = None, None, []
    arc, n, thin = trimmed(arc, local_edges)
    # only where these nodes are worth the passes over arcs
    if n > local_edges and thin and thin >= n * 0.1:
        arc, rings, paths = contracted(arc)
        arc, taken = thinned(arc, local_edges)
    if _fits(arc, local_edges):
        found = written(_at_once(arc), "components")
    else:
        rest = written(arc.select(F.explode(F.array("u", "v")).alias("name")).distinct(), "nodes")
        found = written(_coloured(rest, arc), "components")
    found = thickened(found, taken)
    if paths is not None:
        found = written(_with_paths(found, rings, paths), "components")
    # nodes taken out before may be less than those found
    found = found.unionByName(found.select(F.col("root").alias("name"), "root")).distinct()
    least = found.groupBy("root").agg(F.min("name").alias("least"))
    return written(found.join(shuffled(least), "root").select("name", F.col("least").alias("root")), "components")


def _with_paths(found: DataFrame, rings: DataFrame, paths: DataFrame) -> DataFrame:
    """``found`` (name, root) with what :func:`contracted` took out."""
    ends = found.select(F.col("name").alias("head"), F.col("root").alias("of_head")), found.select(F.col("name").alias("foot"), F.col("root").alias("of_foot"))
    within = paths.join(shuffled(ends[0]), "head", "left").join(shuffled(ends[1]), "foot", "left").where("coalesce(of_head, head) = coalesce(of_foot, foot)")
    within = within.select(F.explode(F.array("name", "head")).alias("name"), F.coalesce("of_head", "head").alias("root")).distinct()
    return found.unionByName(rings).unionByName(within).distinct()


def _at_once(arc: DataFrame) -> DataFrame:
    """name, root of the nodes of ``arc`` (u, v) in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = components_of([*rows["u"], *rows["v"]], zip(rows["u"], rows["v"], strict=True))
        return pd.DataFrame({"name": list(found), "root": list(found.values())})

    return arc.groupBy().applyInPandas(run, "name string, root string")


def _coloured(rest: DataFrame, arc: DataFrame) -> DataFrame:
    """name, root of ``rest`` (name) over ``arc`` (u, v; no loops), both written.

    Nodes without arcs in or out peel off; then each node takes the greatest colour that
    reaches it, and what reaches back to a colour's own node within its colour is a
    component; repeated on the rest."""
    done: list[DataFrame] = [rest.select("name", F.col("name").alias("root")).limit(0)]
    while rest.take(1):
        # peel nodes that can't lie on a cycle
        while True:
            live = arc.select(F.col("u").alias("name")).distinct().join(arc.select(F.col("v").alias("name")).distinct(), "name")
            gone = written(rest.join(shuffled(live), "name", "left_anti"), "peeled")
            if not gone.take(1):
                break
            done.append(gone.select("name", F.col("name").alias("root")))
            rest = written(rest.join(shuffled(gone), "name", "left_anti"), "nodes")
            arc = written(arc.join(shuffled(gone.withColumnRenamed("name", "u")), "u", "left_anti").join(shuffled(gone.withColumnRenamed("name", "v")), "v", "left_anti").select("u", "v"), "arcs")
        if not rest.take(1):
            break
        colour = _spread(rest.select("name", F.col("name").alias("c")), arc)
        same = arc.join(shuffled(colour.select(F.col("name").alias("u"), F.col("c").alias("cu"))), "u").join(shuffled(colour.select(F.col("name").alias("v"), F.col("c").alias("cv"))), "v").where("cu = cv").select("u", "v", F.col("cu").alias("c"))
        same = written(same, "coloured")
        front = found = written(colour.where("name = c"), "roots")
        rounds = 0
        while n := front.count():
            step = same.join(_near(front, n).select(F.col("name").alias("v"), F.col("c").alias("c2")), "v").where("c = c2").select(F.col("u").alias("name"), "c").distinct()
            front = written(step.join(shuffled(found), "name", "left_anti"), "back")
            found, rounds = found.unionByName(front), rounds + 1
            if rounds % REWRITE == 0:
                found = written(found, "component")
        found = written(found, "component")
        least = found.groupBy("c").agg(F.min("name").alias("root"))
        done.append(found.join(shuffled(least), "c").select("name", "root"))
        rest = written(rest.join(shuffled(found), "name", "left_anti"), "nodes")
        arc = written(arc.join(shuffled(found.select(F.col("name").alias("u"))), "u", "left_anti").join(shuffled(found.select(F.col("name").alias("v"))), "v", "left_anti").select("u", "v"), "arcs")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _near(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of a front for a join with arcs, which stay in place where these are few."""
    return F.broadcast(rows) if n <= FEW else shuffled(rows)


def _spread(colour: DataFrame, arc: DataFrame) -> DataFrame:
    """The greatest colour that reaches each node. A node offers its colour when it has a
    new one."""
    colour = moved = written(colour, "colour")
    n = None
    while n != 0:
        near = shuffled(moved) if n is None else _near(moved, n)
        offer = arc.join(near.select("name", "c"), F.col("u") == F.col("name")).groupBy("v").agg(F.max("c").alias("o"))
        better = colour.join(shuffled(offer), colour["name"] == offer["v"], "left").select("name", F.greatest("c", F.coalesce("o", "c")).alias("c"), (F.coalesce("o", "c") > F.col("c")).alias("moved"))
        better = written(better, "colour")
        colour, moved = better.select("name", "c"), better.where("moved")
        n = moved.count()
    return colour


def layers(nodes: DataFrame, pairs: DataFrame, local_edges: int = LOCAL_EDGES, inside: bool = False) -> DataFrame:
    """name, root, read_layer, apply_layer: levels of the components' acyclic graph;
    ``inside``: ``pairs`` has only arcs among ``nodes``."""
    inner = _inner(nodes, pairs, inside)
    if _fits(inner, local_edges):

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            arc = list(zip(rows["u"], rows["v"], strict=True))
            root_of = components_of([n for both in arc for n in both], arc)
            read, apply = levels_of(root_of, arc)
            return pd.DataFrame({"name": list(root_of), "root": list(root_of.values()), "read_layer": [read[n] for n in root_of], "apply_layer": [apply[n] for n in root_of]})

        found = inner.groupBy().applyInPandas(run, "name string, root string, read_layer int, apply_layer int")
        rows = nodes.select("name").distinct().join(shuffled(found), "name", "left")
        return rows.select("name", F.coalesce("root", "name").alias("root"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("read_layer", "apply_layer")])
    link = written(inner.distinct(), "arcs")
    merged = _merged(link, local_edges)
    root = nodes.select("name").distinct().withColumn("root", F.col("name"))
    if merged.where("name <> root").take(1):
        ends = [merged.select(F.col("name").alias(c), F.col("root").alias(r)) for c, r in (("u", "a"), ("v", "b"))]
        link = link.join(shuffled(ends[0]), "u", "left").join(shuffled(ends[1]), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
        link = written(link.where("u <> v").distinct(), "links")
        root = _rooted(nodes, merged)
    # both directions side by side, as two graphs whose nodes have a mark before their names
    way = lambda mark, a, b: link.select(F.concat(F.lit(mark), a).alias("a"), F.concat(F.lit(mark), b).alias("b"))
    both = way(">", "u", "v").unionByName(way("<", "v", "u"))
    level = longest(both.select(F.explode(F.array("a", "b")).alias("name")).distinct(), both).where("level > 0")
    of = lambda mark: F.coalesce(F.max(F.when(F.col("name").startswith(mark), F.col("level"))), F.lit(0))
    level = level.groupBy(F.substring("name", 2, 2**31 - 1).alias("root")).agg(of("<").alias("read_layer"), of(">").alias("apply_layer"))
    return root.join(shuffled(level), "root", "left").select("name", "root", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("read_layer", "apply_layer")])


def cycle_rows(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """root, name: the members of components (``roots``: name, root) of several nodes or
    with an arc to itself, a row each, so that a component may be of any size."""
    several = roots.groupBy("root").count().where("count > 1").select("root")
    loops = pairs.where("u = v").select(F.col("u").alias("name"))
    alone = roots.join(loops, "name", "left_semi").select("root")
    return roots.join(several.unionByName(alone).distinct(), "root", "left_semi").select("root", "name")


def cycles(nodes: DataFrame, pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """root, members (sorted) of :func:`cycle_rows`: for reports, which show a cycle as
    one list of names (memory: the names of one component)."""
    rows = cycle_rows(roots if roots is not None else written(strong_components(nodes, pairs), "roots"), pairs)
    return rows.groupBy("root").agg(F.array_sort(F.collect_list("name")).alias("members"))


def orphans(corpus: Corpus, edge_rows: DataFrame) -> DataFrame:
    """name of documents that no edge leaves (resolved or not) or enters."""
    names = corpus.documents.select(F.col("canonical_name").alias("name"))
    return names.join(edge_rows.select(F.col("from_name").alias("name")), "name", "left_anti").join(edge_rows.where("to_name is not null").select(F.col("to_name").alias("name")), "name", "left_anti")


def seeds(corpus: Corpus, names: list[str], hits: DataFrame | None) -> list[str]:
    """Named documents in request order, then hits; each once. At most the request's
    names and its hit limit."""
    from corpusloom.operators.search import named

    first = [r["canonical_name"] for r in named(corpus, names).where("canonical_name is not null").select("canonical_name", "pos").orderBy("pos").collect()] if names else []
    more = [r["canonical_name"] for r in hits.select("canonical_name", "rank").orderBy("rank").collect()] if hits is not None else []
    return list(dict.fromkeys([*first, *more]))


def compose(corpus: Corpus, edge_rows: DataFrame, seed_names: list[str], full: bool, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Entries (name, reason, depth, via) of everything that seeds lead to, and the
    missing relations (name, relation, via, depth).

    Required relations alone: levels of a breadth-first walk. With recommendations
    the outcome depends on the order of the walk, see :mod:`corpusloom.operators.walk`."""
    spark = corpus.spark
    if full:
        entries, missing = walk(edge_rows, seed_names)
        return written(entries, "walked"), missing
    used = edge_rows.where("relation = 'requires'")
    near = reach(arcs(used), seed_names, local_edges=local_edges)
    mine = used.join(near.select(F.col("name").alias("from_name")), "from_name", "left_semi")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["relation", "pos"], ascending=[False, True], kind="stable")
        out: dict[str, list] = {}
        for u, target, to, relation in zip(rows["from_name"], rows["target"], rows["to_name"], rows["relation"], strict=True):
            out.setdefault(u, []).append((target, None if pd.isna(to) else to, "required" if relation == "requires" else "recommended"))
        best, missing = compose_of(seed_names, lambda n: out.get(n, []))
        kept = [(n, r, d, v, None) for n, (r, d, v) in best.items()]
        return pd.DataFrame([*kept, *((v, r, d, None, t) for r, t, v, d in missing)], columns=["name", "reason", "depth", "via", "target"])

    schema = "name string, reason string, depth int, via string, target string"
    if _fits(mine, local_edges):
        walked = mine.groupBy().applyInPandas(run, schema)
        alone = spark.createDataFrame([(s, "seed", 0, None, None) for s in seed_names], schema)
        walked = walked.unionByName(alone).distinct()
    else:
        levels = written(near, "levels")
        up = levels.select(F.col("name").alias("from_name"), F.col("depth").alias("d"))
        step = mine.join(up, "from_name").join(levels.select(F.col("name").alias("to_name"), "depth"), "to_name").where("depth = d + 1")
        via = step.groupBy("to_name", "depth").agg(F.min_by("from_name", X.locale_order(F.col("from_name"))).alias("via"))
        walked = levels.join(via.select(F.col("to_name").alias("name"), "via"), "name", "left").select("name", F.when(F.col("depth") == 0, "seed").otherwise("required").alias("reason"), "depth", "via", F.lit(None).cast("string").alias("target"))
        broken = mine.where("to_name is null").join(up, "from_name").select(F.col("from_name").alias("name"), F.lit("required").alias("reason"), (F.col("d") + 1).alias("depth"), F.lit(None).cast("string").alias("via"), "target")
        walked = walked.unionByName(broken)
    # one job for both
    walked = written(walked, "walked")
    entries = walked.where("target is null").select("name", "reason", "depth", "via")
    missing = walked.where("target is not null").select(F.col("target").alias("name"), F.col("reason").alias("relation"), F.col("name").alias("via"), "depth").distinct()
    return entries, missing


def graph(corpus: Corpus, edge_rows: DataFrame, seed_names: list[str], mode: str = "outbound") -> dict[str, DataFrame]:
    """A slice of the relation graph: nodes, edges, layers, cycles, orphans, missing."""
    spark, pairs = corpus.spark, arcs(edge_rows)
    everyone = corpus.documents.select(F.col("canonical_name").alias("name"))
    alone = orphans(corpus, edge_rows)
    few = spark.createDataFrame([(s,) for s in seed_names], "name string")
    whole = None
    if mode == "cycles":
        whole = cycles(everyone, pairs)
        if seed_names:
            whole = whole.where(F.arrays_overlap("members", F.array(*[F.lit(s) for s in seed_names])))
        names = whole.select(F.explode("members").alias("name"))
    elif mode == "orphans":
        names = alone.join(F.broadcast(few), "name", "left_semi") if seed_names else alone
    else:
        names = reach(pairs, seed_names, inbound=mode == "inbound").select("name")
    names = written(names, "slice")
    inside = edge_rows.join(names.select(F.col("name").alias("from_name")), "from_name", "left_semi")
    kept = inside.where("to_name is null").unionByName(inside.where("to_name is not null").join(names.select(F.col("name").alias("to_name")), "to_name", "left_semi").select(inside.columns))
    kept = written(kept, "slice-edges")
    d = corpus.documents
    nodes = d.join(names, d["canonical_name"] == names["name"], "left_semi").select(F.col("canonical_name").alias("name"), "path", "title", "category", "scope", "aliases", "requires", "recommends")
    level = written(layers(names, arcs(kept)), "layers") if mode != "cycles" else spark.createDataFrame([], "name string, root string, read_layer int, apply_layer int")
    return {
        "nodes": nodes,
        "edges": kept,
        "layers": level,
        "cycles": whole if whole is not None else cycles(names, arcs(kept), level.select("name", "root")),
        "orphans": alone.join(names, "name", "left_semi"),
        "missing": kept.where("to_name is null").select(F.col("target").alias("name"), F.when(F.col("relation") == "requires", "required").otherwise("recommended").alias("relation"), F.col("from_name").alias("via"), F.lit(1).alias("depth")).distinct(),
    }


def project(corpus: Corpus, edge_rows: DataFrame, seed_names: list[str], full: bool) -> dict[str, DataFrame]:
    """Composition with layers: entries (name, reason, depth, via, read_layer,
    apply_layer), missing, cycles, orphans. Edges among composed documents count
    whatever their relation."""
    entries, missing = compose(corpus, edge_rows, seed_names, full)
    names = entries.select("name")
    inside = written(edge_rows.join(names.select(F.col("name").alias("from_name")), "from_name", "left_semi"), "inside")
    solid = inside.where("to_name is not null").join(names.select(F.col("name").alias("to_name")), "to_name", "left_semi").select(inside.columns)
    pairs = arcs(solid)
    level = written(layers(names, pairs), "layers")
    linked = inside.where("to_name is null").select(F.col("from_name").alias("name")).unionByName(solid.select(F.explode(F.array("from_name", "to_name")).alias("name")))
    return {
        "entries": entries.join(level.drop("root"), "name", "left"),
        "missing": missing,
        "cycles": cycles(names, pairs, level.select("name", "root")),
        "orphans": names.join(linked, "name", "left_anti"),
    }


def degrees(corpus: Corpus, edge_rows: DataFrame) -> DataFrame:
    """name, path, inbound, outbound, requires, recommends of every document; edges
    that don't resolve count as outbound."""
    count_if = lambda c: F.count_if(F.col("relation") == c)
    out = edge_rows.groupBy(F.col("from_name").alias("name")).agg(F.count("*").alias("outbound"), count_if("requires").alias("requires"), count_if("recommends").alias("recommends"))
    into = edge_rows.where("to_name is not null").groupBy(F.col("to_name").alias("name")).agg(F.count("*").alias("inbound"))
    rows = corpus.documents.select(F.col("canonical_name").alias("name"), "path").join(out, "name", "left").join(into, "name", "left")
    return rows.select("name", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inbound", "outbound", "requires", "recommends")])


def layer_rows(level: DataFrame, column: str) -> DataFrame:
    """layer, pos, name: members in byte order within components, components by their
    first member in language order."""
    order = Window.partitionBy(column).orderBy(X.locale_order(F.col("root")), "name")
    return level.select(F.col(column).alias("layer"), (F.row_number().over(order) - 1).alias("pos"), "name")


def entry_order() -> list[Column]:
    """Composed entries: near ones first, then by strength of the reason, then by name."""
    strength = F.coalesce(*[F.when(F.col("reason") == r, F.lit(-n)) for r, n in REASONS.items()], F.lit(0))
    return [F.col("depth"), strength, X.locale_order(F.col("name"))]


def missing_order() -> list[Column]:
    return [F.col("depth"), *[X.locale_order(F.col(c)) for c in ("relation", "via", "name")]]


def edge_order() -> list[Column]:
    return [X.locale_order(F.col("from_name")), X.locale_order(F.coalesce("to_name", "target")), X.locale_order(F.col("relation"))]


def numbered(rows: DataFrame, order: list[Column], number: str = "place") -> DataFrame:
    """``rows`` with their place in an order (from 1), however many they are."""
    return placed(rows, order, column=number, name="places")

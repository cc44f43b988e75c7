"""One entry for all actions over a corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import decide as D
from corpusloom.operators import diagnostics, packets
from corpusloom.operators import graph as G
from corpusloom.operators import search as S
from corpusloom.operators.corpus import Corpus, Settings
from corpusloom.operators.index import Index, build_index
from corpusloom.operators.tables import written
from corpusloom.plans import render
from corpusloom.plans.request import Request, RequestError
from corpusloom.sources.snapshot import SnapshotError, Store, opened


@dataclass
class Result:
    """Frames by name and facts of one action; ``error`` if it could not run."""

    kind: str
    frames: dict[str, DataFrame] = field(default_factory=dict)
    facts: dict[str, object] = field(default_factory=dict)
    error: str | None = None

    def text(self) -> str:
        """What the action found, as text (see :mod:`corpusloom.plans.render`); frames are
        lazy, so what fails on the way is told here as it is by the action."""
        try:
            return render.text_of(self.kind, self.frames, self.facts, self.error)
        except Exception as e:
            return render.text_of(self.kind, {}, {}, f"{self.kind} failed: {e}")


class Engine:
    """Answers requests over one corpus. Indexes are built once for each restriction
    of the corpus and kept in the shared folder."""

    def __init__(self, corpus: Corpus, index: Index | None = None, kept: int = 4):
        self.corpus, self.kept = corpus, kept
        self._indexes: dict[tuple, Index] = {(): index} if index else {}
        self._bundles: dict[tuple, tuple[packets.Bundle, DataFrame]] = {}
        self._edges: dict[tuple, DataFrame] = {}
        self._open: Callable[[bool], tuple[Corpus, Index, str]] | None = None
        self._token: str | None = None
        self._require: Callable[[], None] | None = None

    @classmethod
    def over(cls, store: Store, settings: Settings, build: Callable[[], Corpus], signature: Callable[[], str], request: dict | None = None, kept: int = 4) -> Engine:
        """An engine over snapshots: before each request the stored version is taken if it
        is fresh and its sources (``signature``) are unchanged; else, or with ``refresh``, a
        new one is built and stored."""

        def at(refresh: bool) -> tuple[Corpus, Index, str]:
            return opened(store, request or {}, settings, build, signature, refresh)

        corpus, index, token = at(False)
        engine = cls(corpus, index, kept)
        engine._open, engine._token = at, token
        return engine

    @classmethod
    def pinned(cls, store: Store, settings: Settings, kept: int = 4) -> Engine:
        """An engine that keeps to the version that is current now. Once another is, its
        requests are refused, with ``refresh`` too; what it has answered stays readable."""
        facts = store.facts()
        if facts is None:
            raise SnapshotError("there is no snapshot")
        engine = cls(*store.frames(settings, facts), kept)
        engine._require = lambda: store.require(facts["token"])
        return engine

    def _current(self, refresh: bool) -> None:
        if self._require is not None:
            self._require()
        if self._open is None:
            return
        corpus, index, token = self._open(refresh)
        if token != self._token:
            self.corpus, self._token = corpus, token
            self._indexes, self._bundles, self._edges = {(): index}, {}, {}

    def edges(self, key: tuple, corpus: Corpus) -> DataFrame:
        """The corpus' relations, resolved once for all requests on it."""
        if key not in self._edges:
            while len(self._edges) >= self.kept:
                self._edges.pop(next(iter(self._edges)))
            self._edges[key] = written(G.edges(corpus), "edges")
        return self._edges[key]

    def _built(self, key: tuple, corpus: Corpus) -> Index:
        if key not in self._indexes:
            while len(self._indexes) >= self.kept:
                self._indexes.pop(next(iter(self._indexes)))
            self._indexes[key] = build_index(corpus.documents)
        return self._indexes[key]

    def _view(self, r: Request) -> tuple[Corpus, tuple]:
        scopes, names = r.known_scopes(self.corpus.settings), r.corpus_names(self.corpus.settings)
        corpus = self.corpus
        if scopes is not None:
            d = corpus.documents.where(F.col("scope").isin(scopes)) if scopes else corpus.documents.limit(0)
            corpus = Corpus(d, corpus.aliases.join(d.select("canonical_name"), "canonical_name", "left_semi"), corpus.duplicates, corpus.alias_conflicts, corpus.malformed, corpus.settings)
        return corpus.restricted(names).materialised() if names else corpus, (tuple(scopes) if scopes is not None else None, tuple(names)) if scopes is not None or names else ()

    def run(self, action: str, **parameters) -> Result:
        """The result of an action. A request that can't be answered, or that fails on
        the way, gives a result with an error; nothing is raised."""
        try:
            return self._run(action, parameters)
        except RequestError as e:
            return Result(action, error=str(e))
        except Exception as e:
            return Result(action, error=f"{action} failed: {e}")

    def _run(self, action: str, parameters: dict) -> Result:
        r = Request(action, **parameters).normalised(self.corpus.settings)
        if action in ("discover", "search", "select", "gap") and not r.query:
            raise RequestError(f"{action} needs a query")
        if action == "resolve" and not r.names:
            raise RequestError("resolve needs names")
        if not r.query and not r.names and action not in ("index", "validate", "metrics", "audit", "graph"):
            raise RequestError(f"{action} needs a query or names")
        self._current(r.refresh)
        corpus, key = self._view(r)
        result = getattr(self, "_" + action.replace("-", "_"), self._packet)(r, corpus, key)
        result.facts |= {"query": result.facts.get("query", r.query), "relation_mode": r.relation_mode}
        return result

    def _missing(self, r: Request, corpus: Corpus) -> list[str]:
        """Requested names that no document of the corpus answers to."""
        asked = r.names or r.corpus_names(corpus.settings)
        if not asked:
            return []
        met = {x[0] for x in corpus.aliases.where(F.col("alias").isin(asked)).select("alias").collect()}
        return [n for n in asked if n not in met]

    # -- search ----------------------------------------------------------------------

    def _index(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        d = corpus.documents
        n, parsed = d.count(), corpus.duplicates.count()
        top = d.orderBy("ordinal", "path").limit(r.limit).select("ordinal", "canonical_name", "path", "title", "category", "scope", "source_root")
        stats = {"documents": n, "parsed": n + parsed, "deduplicated": parsed, "parse_errors": corpus.malformed.count(), "name_filter": "targeted" if r.corpus_names(corpus.settings) else "full", "missing_from_requested": self._missing(r, corpus), "requested_names": r.names}
        return Result("index", {"documents": top, "scopes": diagnostics.metrics(corpus)["by_scope"], "duplicates": corpus.duplicates, "malformed": corpus.malformed}, stats)

    def _discover(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        found = S.search(corpus, self._built(key, corpus), r.query, r.limit, r.min_score)
        shown = found.hits.select("rank", F.col("canonical_name").alias("name"), X.read_path(F.col("canonical_name")).alias("read_path"), "score", "coverage", "path", "scope", "category", "aliases", "requires", "recommends", "matched_terms", X.preview(F.col("body_text"), r.preview_chars or corpus.settings.preview_chars).alias("preview"))
        if r.action == "discover":
            shown = shown.drop("preview")
        names, why = S.evidence(found, r.query)
        missing = self._missing(r, corpus)
        told = {"query": found.query, "fallback_mode": found.mode, "matched_aliases": found.aliases, **why, "missing_requested": missing}
        return Result(r.action, {"hits": shown}, told | {"telemetry": {"query": r.query, "returned": names, "used": [], "complaint": diagnostics.complaint_of(len(missing), len(names), r.limit)}})

    _search = _discover

    def _select(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        chars = 2 * (r.preview_chars or corpus.settings.preview_chars) if r.include_body else 180
        hits = S.ranked(corpus, self._built(key, corpus), r.query, r.limit, r.min_score)
        return Result("select", {"hits": hits.select("rank", F.col("canonical_name").alias("name"), "score", "coverage", "path", "scope", "category", X.preview(F.col("body_text"), chars).alias("preview"))})

    def _resolve(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        frames = S.resolve(corpus, self._built(key, corpus), r.names, r.include_body, r.budget_chars, r.budget_tokens, r.suggestion_limit)
        frames["resolved"] = written(frames["resolved"], "resolved")
        rows = frames["resolved"].select("read_path", F.coalesce(F.char_length("body"), F.lit(0)).alias("n"), "omitted_by_budget").orderBy("pos").collect()
        budget = {"chars": r.budget_chars, "tokens": r.budget_tokens, "effective_chars": S.effective_chars(r.budget_chars, r.budget_tokens), "used_chars": sum(x["n"] for x in rows)}
        missing = [x[0] for x in frames["missing"].orderBy("pos").select("requested").collect()]
        return Result("resolve", frames, {"missing": missing, "omitted": [x["read_path"] for x in rows if x["omitted_by_budget"]], "budget": budget, "resolved": len(rows)})

    def _gap(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        return Result("gap", S.gap(corpus, self._built(key, corpus), r.query, r.names, r.coverage_threshold, r.limit, r.min_score))

    # -- relations -------------------------------------------------------------------

    def _seeds(self, r: Request, corpus: Corpus, key: tuple, limit: int | None = None) -> list[str]:
        hits = S.ranked(corpus, self._built(key, corpus), r.query, limit or r.limit, r.min_score) if r.query else None
        return G.seeds(corpus, r.names, hits)

    def _compose(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        seeds = self._seeds(r, corpus, key)
        entries, missing = G.compose(corpus, self.edges(key, corpus), seeds, r.relation_mode == "full")
        return Result("compose", {"entries": G.numbered(entries, G.entry_order()), "missing": G.numbered(missing, G.missing_order())}, {"seeds": seeds})

    def _graph(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        seeds = self._seeds(r, corpus, key) if r.query or r.names else []
        found = G.graph(corpus, self.edges(key, corpus), seeds, r.graph_mode)
        found |= {"nodes": found["nodes"].orderBy(X.locale_order(F.col("name"))), "edges": found["edges"].orderBy(*G.edge_order()), "missing": found["missing"].orderBy(*G.missing_order())}
        found |= {f"{kind}_layers": G.layer_rows(found["layers"], f"{kind}_layer").orderBy("layer", "pos") for kind in ("read", "apply")}
        return Result("graph", found, {"seeds": seeds, "mode": r.graph_mode})

    def _projection(self, r: Request, corpus: Corpus, key: tuple, limit: int) -> dict[str, DataFrame]:
        return G.project(corpus, self.edges(key, corpus), self._seeds(r, corpus, key, limit), r.relation_mode == "full")

    def _explain(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        projection = self._projection(r, corpus, key, r.limit)
        hits = S.ranked(corpus, self._built(key, corpus), r.query, r.limit, r.min_score) if r.query else None
        return Result("explain", {"entries": D.explain(corpus, projection["entries"], hits), "missing": projection["missing"], "cycles": projection["cycles"]})

    def _pack(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        projection = self._projection(r, corpus, key, r.limit)
        entries = packets.pack(corpus, projection["entries"], r.budget_chars, r.budget_tokens, r.include_body)
        sound = diagnostics.counts(diagnostics.validate(corpus)).first()["ok"]
        ok = sound and not projection["missing"].where("relation = 'required'").take(1) and not projection["cycles"].take(1)
        return Result("pack", {**projection, "entries": entries}, {"ok": bool(ok)})

    # -- decisions -------------------------------------------------------------------

    def _pool(self, r: Request, corpus: Corpus, key: tuple, limit: int) -> DataFrame:
        return D.candidates(corpus, self._built(key, corpus), r.query, r.names, limit, r.min_score)

    def _decide(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        decision = D.decide(corpus, self._pool(r, corpus, key, r.limit), r.limit)
        head = decision.where("rank = 1").select("name").first()
        return Result("decide", {"candidates": decision}, {"basis": D.basis(r.query, r.names), "winner": head["name"] if head else None})

    def _planned(self, r: Request, corpus: Corpus, key: tuple) -> tuple[str | None, DataFrame, DataFrame]:
        width = D.decide_width(corpus, self._built(key, corpus).n_docs, r.limit)
        return D.plan(D.decide(corpus, self._pool(r, corpus, key, width), width), r.relation_mode == "full", r.limit)

    def _plan(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        winner, steps, deferred = self._planned(r, corpus, key)
        return Result("plan", {"steps": steps.drop("tier"), "deferred": deferred}, {"basis": D.basis(r.query, r.names), "winner": winner})

    def _route(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        winner, steps, deferred = self._planned(r, corpus, key)
        phases = D.route(steps, self._projection(r, corpus, key, r.limit)["entries"])
        return Result("route", {"phases": phases, "deferred": deferred}, {"basis": D.basis(r.query, r.names), "winner": winner})

    def _compare(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        entries, pairs = D.compare(self._pool(r, corpus, key, max(2, min(r.limit, 8))), r.limit)
        return Result("compare", {"entries": entries, "pairs": pairs}, {"basis": D.basis(r.query, r.names)})

    def _recommend(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        seeds = self._seeds(r, corpus, key)
        rows = D.recommend(corpus, self._built(key, corpus), self.edges(key, corpus), seeds, r.query, r.relation_mode == "full", r.limit, r.min_score)
        return Result("recommend", {"recommendations": rows}, {"seeds": seeds})

    # -- packets ---------------------------------------------------------------------

    def bundle(self, r: Request, corpus: Corpus, key: tuple, include_body: bool = True) -> tuple[packets.Bundle, DataFrame]:
        """Phases, brief entries and omitted bodies, computed once for all packets of a
        request and kept in the shared folder."""
        asked = (key, r.query, tuple(r.names), r.limit, r.min_score, r.relation_mode, r.budget_chars, r.budget_tokens, include_body)
        if asked not in self._bundles:
            while len(self._bundles) >= self.kept:
                self._bundles.pop(next(iter(self._bundles)))
            self._bundles[asked] = self._bundled(r, corpus, key, include_body)
        return self._bundles[asked]

    def _bundled(self, r: Request, corpus: Corpus, key: tuple, include_body: bool) -> tuple[packets.Bundle, DataFrame]:
        winner, steps, deferred = self._planned(r, corpus, key)
        projection = self._projection(r, corpus, key, r.limit)
        packed = written(packets.pack(corpus, projection["entries"], r.budget_chars, r.budget_tokens, include_body), "packed")
        phases = written(D.route(steps, projection["entries"]), "phases")
        omitted = [x["read_path"] for x in packed.where("omitted_by_budget").orderBy(F.when(F.col("reason") == "seed", 1).when(F.col("reason") == "required", 2).otherwise(3), F.coalesce("read_layer", F.lit(2**31 - 1)), "depth", X.locale_order(F.col("name"))).select("read_path").collect()]
        return packets.Bundle(phases, written(packets.brief(phases, packed), "brief"), winner, omitted), deferred

    def _packet(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        b, deferred = self.bundle(r, corpus, key, r.include_body if r.action == "brief" else True)
        facts = {"basis": D.basis(r.query, r.names), "winner": b.winner, "ready": b.ready, "omitted": b.omitted, "recovery_guidance": b.guidance}
        frames: dict[str, DataFrame] = {"deferred": deferred}
        if r.action in ("brief", "bundle"):
            frames |= {"phases": b.phases, "entries": b.entries}
        elif r.action == "handoff":
            frames |= {"handoff": packets.handoff(b), "phases": b.phases, "entries": b.entries}
        elif r.action == "session-packet":
            frames["steps"] = packets.session_steps(b)
        elif r.action == "turn-packet":
            frames["turns"] = packets.turns(b)
        elif r.action == "recovery-packet":
            frames["blocked_turns"] = packets.blocked_turns(b)
        elif r.action == "resume-packet":
            frames |= {"turns": packets.remaining(b), "blocked_turns": packets.blocked_turns(b)}
        elif r.action == "current-turn-packet":
            frames["turn"] = packets.current(b)
        else:
            columns = {
                "instruction-packet": ["instruction_text", "checklist_text", "command_block"],
                "summary-packet": ["summary_text"],
                "markdown-packet": ["markdown", "command_block", "checklist_lines"],
                "checklist-packet": ["items", "checklist_text"],
                "commands-packet": ["command_block"],
                "file-ready-packet": ["base_name", "files"],
                "apply-packet": ["base_name", "writes", "apply_text"],
                "write-script-packet": ["script_path", "script_content", "run_command"],
                "execution-packet": ["script_path", "script_content", "run_command", "execution_text"],
                "verification-packet": ["run_command", "verification_items", "verification_text"],
            }[r.action]
            frames["packet"] = packets.texts(written(packets.current(b), "turn")).select("winner", "ready", "active_turn_order", *columns)
        return Result(r.action, frames, facts)

    # -- health ----------------------------------------------------------------------

    def _validate(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        issues = diagnostics.validate(corpus)
        return Result("validate", {"issues": issues, "counts": diagnostics.counts(issues)})

    def _audit(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        seeds = self._seeds(r, corpus, key) if r.query or r.names else []
        return Result("audit", diagnostics.audit(corpus, self.edges(key, corpus), seeds, min(r.limit, 10)))

    def _metrics(self, r: Request, corpus: Corpus, key: tuple) -> Result:
        return Result("metrics", diagnostics.metrics(corpus, self._built(key, corpus)))

"""Results as text: a head line with the number of rows, a line of facts, and a block
a row, for the first rows. What is left out is said."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.search import bounded_text
from corpusloom.plans.request import REQUEST_MOST

#: Rows of a frame that a text shows at most.
SHOWN = REQUEST_MOST
_PACKET = ("basis", "query", "relation_mode", "winner", "ready", "omitted", "recovery_guidance")
#: Of each kind: facts of the head, the frame shown, its order, its title and its labelled columns.
LAYOUTS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...], str, tuple[str, ...]]] = {
    "index": (("documents", "parsed", "deduplicated", "parse_errors", "name_filter", "missing_from_requested"), "documents", ("ordinal",), "canonical_name", ("category", "scope", "source_root")),
    "discover": (("query", "fallback_mode", "matched_aliases", "why_top", "why_none"), "hits", ("rank",), "name read_path", ("score", "coverage", "matched_terms", "category", "scope", "aliases", "requires", "recommends", "path")),
    "search": (("query", "fallback_mode", "matched_aliases", "why_top", "why_none"), "hits", ("rank",), "name", ("score", "coverage", "matched_terms", "category", "scope", "aliases", "requires", "recommends", "path", "preview")),
    "select": (("query",), "hits", ("rank",), "name", ("score", "coverage", "category", "scope", "path", "preview")),
    "resolve": (("resolved", "missing", "omitted", "budget"), "resolved", ("pos",), "name read_path", ("category", "aliases", "omitted_by_budget", "path")),
    "gap": (("query",), "gap", (), "recommended_action", ("candidates", "coverage_ratio", "covered_terms", "uncovered_terms", "scaffold")),
    "compose": (("seeds", "relation_mode"), "entries", ("place",), "name", ("reason", "depth", "via")),
    "graph": (("mode", "seeds"), "nodes", ("name",), "name", ("category", "scope", "path")),
    "explain": (("query", "relation_mode"), "entries", ("depth", "name"), "name read_path", ("reason", "via", "depth", "read_layer", "apply_layer", "score", "coverage", "matched_terms", "match_preview")),
    "decide": (("basis", "query", "winner"), "candidates", ("rank",), "name read_path", ("score", "category", "query_score", "query_coverage", "explicit", "peer_required_by", "peer_recommended_by", "required_peers", "unresolved_requires", "reasons", "preview")),
    "plan": (("basis", "query", "relation_mode", "winner"), "steps", ("order",), "name read_path", ("phase", "reason", "via", "score", "query_score", "preview")),
    "route": (("basis", "query", "relation_mode", "winner"), "phases", ("order",), "kind layer", ("names", "read_paths", "rationale")),
    "compare": (("basis", "query"), "pairs", ("left_name", "right_name"), "left_name right_name", ("same_category", "shared_aliases", "shared_matched_terms", "left_only_matched_terms", "right_only_matched_terms", "shared_requires", "shared_recommends", "left_to_right", "right_to_left", "score_delta")),
    "recommend": (("query", "relation_mode", "seeds"), "recommendations", ("rank",), "name read_path", ("score", "query_score", "outbound_signals", "inbound_signals", "shared_category_seeds", "matched_terms", "preview")),
    "brief": (_PACKET, "entries", ("phase_order", "pos"), "name read_path", ("phase_kind", "layer", "category", "body", "omitted_by_budget", "preview")),
    "bundle": (_PACKET, "entries", ("phase_order", "pos"), "name read_path", ("phase_kind", "layer", "category", "omitted_by_budget", "preview")),
    "handoff": (_PACKET, "handoff", (), "winner", ("source_path", "source_category", "source_scope", "next_command", "apply_hint")),
    "pack": (("ok", "query", "relation_mode"), "entries", ("place",), "name read_path", ("reason", "via", "depth", "read_layer", "apply_layer", "body", "omitted_by_budget", "preview")),
    "session-packet": (_PACKET, "steps", ("order",), "name", ("source_path", "next_command", "phase_kind", "layer", "omitted_by_budget")),
    "turn-packet": (_PACKET, "turns", ("order",), "phase_kind layer", ("objective", "names", "source_paths", "next_commands", "checklist", "exit_criteria", "blocked_by_budget")),
    "recovery-packet": (_PACKET, "blocked_turns", ("order",), "phase_kind layer", ("objective", "names", "omitted_read_paths", "source_paths", "recovery_commands", "unblock_criteria")),
    "resume-packet": (_PACKET, "turns", ("order",), "phase_kind layer", ("objective", "names", "source_paths", "next_commands", "checklist", "exit_criteria", "blocked_by_budget")),
    "current-turn-packet": (_PACKET, "turn", (), "phase_kind layer", ("objective", "names", "source_paths", "next_commands", "checklist", "exit_criteria", "blocked_by_budget")),
    "audit": (("ok",), "issues", ("place",), "severity kind", ("message", "skill_name", "path")),
    "validate": ((), "issues", ("severity", "kind", "message"), "severity kind", ("message", "skill_name", "path", "target")),
    "metrics": ((), "by_category", (), "category", ("count",)),
}
#: The one text of each packet that stands for itself.
WHOLE = {
    "instruction-packet": "instruction_text", "summary-packet": "summary_text", "markdown-packet": "markdown", "checklist-packet": "checklist_text", "commands-packet": "command_block", "file-ready-packet": "files",
    "apply-packet": "apply_text", "write-script-packet": "script_content", "execution-packet": "execution_text", "verification-packet": "verification_text",
}


def shown(value: object) -> str:
    """A value on one line; empty ones and nothing are a dash."""
    if value is None or value == "" or value == [] or value == {}:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, float):
        return f"{value:.3f}"
    if hasattr(value, "asDict"):
        return shown(value.asDict())
    if isinstance(value, dict):
        return " ".join(f"{k}={shown(v)}" for k, v in value.items())
    if isinstance(value, list):
        return ", ".join(map(shown, value))
    return " ".join(str(value).split())


def text_of(kind: str, frames: dict[str, DataFrame], facts: dict[str, object], error: str | None = None) -> str:
    """The text of a result. Where names were asked and none was found, it stays within
    the bounds of a recovery (:func:`corpusloom.operators.search.bounded_text`)."""
    if error is not None:
        return f"error: {error}"
    if kind in WHOLE:
        row = frames["packet"].first()
        value = row[WHOLE[kind]]
        body = "\n".join(f"{f['path']}:\n{f['content']}" for f in value) if kind == "file-ready-packet" else value
        return f"{kind}: winner {shown(row['winner'])}, {'ready' if row['ready'] else 'not ready'}\n{body}"
    head, name, order, title, columns = LAYOUTS[kind]
    frame = frames[name]
    rows = (frame.orderBy(*[F.col(c) for c in order]) if order else frame).limit(SHOWN + 1).collect()
    total = frame.count() if len(rows) > SHOWN else len(rows)
    rows = rows[:SHOWN]
    lines = [f"{kind}: {total}", f"shown: the first {SHOWN}, {total - SHOWN} more are not" if total > SHOWN else "", " | ".join(f"{f}: {shown(facts.get(f))}" for f in head if f in facts)]
    for n, row in enumerate(rows, 1):
        lines.append(f"{n}. " + " -> ".join(shown(row[c]) for c in title.split() if row[c] is not None))
        lines += [f"   {c}: {shown(row[c])}" for c in columns if shown(row[c]) != "-"]
    if kind == "resolve" and "suggestions" in frames:
        lines += [f"near: {shown(r['name'])} -> {r['read_path']} ({r['confidence']:.3f})" for r in frames["suggestions"].collect()]
    text = "\n".join(x for x in lines if x)
    return bounded_text(text) if kind == "resolve" and facts.get("missing") and not rows else text

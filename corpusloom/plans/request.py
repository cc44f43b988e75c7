"""Requests: what an action is asked with, normalised once on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from corpusloom.operators.corpus import Settings

ACTIONS = (
    "index discover search select resolve compose graph gap explain decide plan route compare recommend brief bundle handoff pack session-packet turn-packet "
    "recovery-packet resume-packet current-turn-packet instruction-packet summary-packet markdown-packet checklist-packet commands-packet file-ready-packet "
    "apply-packet write-script-packet execution-packet verification-packet audit validate metrics"
).split()
#: Actions that see the whole corpus whatever names are asked.
ALWAYS_WHOLE = frozenset("validate recommend audit graph pack resolve gap explain compose".split())
#: Actions that see the whole corpus if there is a query, else the named documents only.
WHOLE_WITH_QUERY = frozenset(
    "compare decide plan route brief bundle handoff session-packet turn-packet recovery-packet resume-packet markdown-packet checklist-packet commands-packet "
    "file-ready-packet apply-packet write-script-packet execution-packet verification-packet summary-packet".split()
)
#: Actions that, asked by query alone, are refused unless the task is large.
ONLY_LARGE = frozenset("decide plan route current-turn-packet session-packet turn-packet".split())
LIMITS = {"small": 2, "medium": 5}
REQUEST_MOST = 200


def canonical_name(name: str) -> str:
    """The canonical form of a name (see :func:`corpusloom.functions.text.canonical_name`)."""
    plain = re.sub(r"(?i)\.md$", "", name.strip())
    plain = re.sub(r"(?i)^skill[-_]", "", plain)
    return re.sub(r"\s+", "-", plain).lower()


class RequestError(ValueError):
    """A request that no action can answer."""


@dataclass
class Request:
    """Parameters of an action with their defaults and bounds."""

    action: str
    query: str | None = None
    names: list[str] = field(default_factory=list)
    limit: int | None = None
    min_score: float = 0.0
    task_size: str = "medium"
    relation_mode: str = "full"
    graph_mode: str = "outbound"
    include_body: bool | None = None
    budget_chars: int = 4000
    budget_tokens: int = 1000
    preview_chars: int | None = None
    suggestion_limit: int = 3
    coverage_threshold: float = 0.7
    scopes: list[str] | None = None
    refresh: bool = False

    def normalised(self, settings: Settings) -> Request:
        """Checked and clamped: the limit by the settings and the size of the task;
        names canonical, each once and (but for resolve) sorted; full relations for large tasks only."""
        if self.action not in ACTIONS:
            raise RequestError(f"unknown action {self.action!r}")
        if self.query is not None and len(self.query) > 1024:
            raise RequestError("a query has at most 1024 characters")
        query = self.query.strip() if self.query and self.query.strip() else None
        names = list(dict.fromkeys(n for n in map(canonical_name, self.names) if n))
        most = min(settings.max_top_k, LIMITS.get(self.task_size, settings.max_top_k))
        limit = max(1, min(self.limit if self.limit is not None else most, most, REQUEST_MOST))
        mode = "full" if self.relation_mode == "full" and self.task_size == "large" else "required"
        body = self.action != "resolve" if self.include_body is None else self.include_body
        if self.action != "resolve":
            names.sort()
        if query and not names and self.action in ONLY_LARGE and self.task_size != "large":
            raise RequestError(f"{self.action} by query alone needs a large task")
        return Request(
            self.action, query, names, limit, max(0.0, min(self.min_score, 1000.0)), self.task_size, mode, self.graph_mode, body, self.budget_chars, self.budget_tokens,
            self.preview_chars, max(0, min(self.suggestion_limit, 5)), max(0.0, min(self.coverage_threshold, 1.0)), self.scopes, self.refresh,
        )

    def corpus_names(self, settings: Settings) -> list[str]:
        """Names that the corpus is restricted to before the action; empty: none."""
        if self.action in ALWAYS_WHOLE or self.action in WHOLE_WITH_QUERY and self.query:
            return []
        return self.names or [canonical_name(n) for n in settings.preset_names]

    def known_scopes(self, settings: Settings) -> list[str] | None:
        """Scopes asked for; None: all; empty (also if any is unknown): an empty corpus."""
        if self.scopes is None:
            return None
        asked = list(dict.fromkeys(s.strip() for s in self.scopes if s.strip()))
        return asked if asked and all(s in settings.scope_roots for s in asked) else []


def expand_root(root: str, home: str | None = None, cwd: str | None = None) -> str:
    """A root with ``~``, ``$home`` and ``$cwd`` resolved, without a last slash."""
    home, cwd = home or os.path.expanduser("~"), cwd or os.getcwd()
    out = re.sub(r"^~(?=/|$)|^\$home(?=/|$)", lambda _: home, root.strip())
    out = re.sub(r"^\$cwd(?=/|$)", lambda _: cwd, out)
    return out.rstrip("/") or "/"


def roots_for_scopes(roots: list[str], scope_roots: list[str]) -> list[str]:
    """Roots that lie in, or hold, a selected scope's root (at slashes)."""

    def within(path: str, top: str) -> bool:
        return path == top or path.startswith(top.rstrip("/") + "/")

    return [r for r in roots if any(within(r, s) or within(s, r) for s in scope_roots)]

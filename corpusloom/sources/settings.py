"""Settings from the first readable of several JSON files, field by field."""

from __future__ import annotations

import json
from pathlib import Path

from corpusloom.operators.corpus import Settings
from corpusloom.plans.request import expand_root

#: Where settings are looked for below the working and the home directory.
CANDIDATES = ("corpusloom.json", ".corpusloom/settings.json", ".corpusloom.json", ".config/corpusloom/settings.json")


def candidates(cwd: str, home: str) -> list[Path]:
    return [Path(base) / name for base in (cwd, home) for name in CANDIDATES]


def load_settings(paths: list[Path], home: str | None = None, cwd: str | None = None) -> Settings:
    """The first file that parses counts, bare or under ``corpusloom``; a field of the
    wrong type keeps its default."""
    payload: dict = {}
    for path in paths:
        try:
            found = json.loads(path.read_text())
        except (OSError, ValueError):
            continue
        if isinstance(found, dict):
            payload = found["corpusloom"] if isinstance(found.get("corpusloom"), dict) else found
            break
    default = Settings()

    def number(key: str, value: int, least: int = 1) -> int:
        got = payload.get(key)
        return got if isinstance(got, int) and not isinstance(got, bool) and got >= least else value

    def texts(value: object) -> list[str]:
        return list(dict.fromkeys(v.strip() for v in value if isinstance(v, str) and v.strip())) if isinstance(value, list) else []

    roots = payload.get("scopeRoots")
    scopes = {s.strip(): [expand_root(r, home, cwd) for r in ([rs] if isinstance(rs, str) else texts(rs))] for s, rs in roots.items() if s.strip()} if isinstance(roots, dict) else {}
    priority = [s for s in texts(payload.get("scopePriority")) if not scopes or s in scopes]
    return Settings(priority or list(scopes), {s: r for s, r in scopes.items() if r}, texts(payload.get("presetSkills")), number("maxTopK", default.max_top_k), number("includePreviewBodyChars", default.preview_chars), number("cacheTtlMs", default.cache_ttl_ms, 0))

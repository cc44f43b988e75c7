"""DuckDB SQL for the queries of :mod:`corpusloom.plans.queries`."""

from __future__ import annotations

from corpusloom.functions.text import STOP_WORDS, folding
from corpusloom.operators.index import FIELDS
from corpusloom.sources.tables import SCOPE_ROOTS

_FROM, _TO = folding()
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in [*STOP_WORDS, "constructor"])


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: trim(x, '_')), lambda x: len(x) > 1 AND NOT list_contains([{_STOP}], x))"


#: d: the document records of the adapter.
CORPUS = """
lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cnt AS (SELECT count(*) AS n_docs FROM documents),
d AS (SELECT doc_id AS ordinal, 'doc-' || doc_id AS name, '/corpus/' || source AS source_root, '/corpus/' || source || '/doc-' || doc_id || '/SKILL.md' AS path,
  substr(split_part(text, chr(10), 1), 1, 80) AS title, lang AS category,
  list_filter(['quality-' || quality, 'toxic-' || toxic], lambda x: x IS NOT NULL) AS tags, 'alias-' || (doc_id // 2) AS alias,
  list_filter([CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN 'doc-' || (doc_id // 3) END, CASE WHEN doc_id % 11 = 0 THEN 'missing-' || doc_id END], lambda x: x IS NOT NULL) AS requires,
  'doc-' || ((doc_id * 7 + 1) % n_docs) AS recommends, text AS body, doc_id AS mtime
  FROM documents CROSS JOIN cnt LEFT JOIN lab USING (doc_id))"""

_ROOTS = [(s, r, i) for i, (s, r) in enumerate((s, r) for s, rs in SCOPE_ROOTS.items() for r in rs)]
#: s: the scope of each document; al: the owner of each alias; e: edges.
SCOPES = f"""
roots(scope, root, rank) AS (VALUES {", ".join(str(x) for x in _ROOTS)}),
s AS (SELECT name, scope FROM (SELECT name, scope, row_number() OVER (PARTITION BY name ORDER BY length(root) DESC, rank) AS r
  FROM d JOIN roots ON path = root OR starts_with(path, root || '/')) WHERE r = 1)"""
ALIASES = """
pref AS (SELECT name, alias, path, mtime, CASE scope WHEN 'first' THEN 0 WHEN 'second' THEN 1 ELSE 2 END AS p FROM d JOIN s USING (name)),
own AS (SELECT name AS alias, name, p, mtime, path FROM pref UNION ALL SELECT alias, name, p, mtime, path FROM pref),
al AS (SELECT alias, name FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY p, mtime DESC, path) AS r FROM own) WHERE r = 1)"""
EDGES = """
raw AS (SELECT name AS from_name, unnest(requires) AS target, 'requires' AS relation FROM d UNION ALL SELECT name, recommends, 'recommends' FROM d),
e AS (SELECT from_name, target, al.name AS to_name, relation, al.name IS NOT NULL AS resolved FROM raw LEFT JOIN al ON raw.target = al.alias)"""
_FIELD_SQL = {"canonical_name": "name", "aliases": "alias", "title": "title", "description": "''", "category": "category", "keywords": "category", "tags": "array_to_string(tags, ' ')", "body_text": "body"}
_ROWS = " UNION ALL ".join(f"SELECT name, {w} AS w, unnest({_tokens(_FIELD_SQL[f])}) AS t FROM d" for f, w in FIELDS.items())
POSTINGS = f"""
tok AS (SELECT name, w, translate(t, '{_FROM}', '{_TO}') AS term FROM ({_ROWS})),
post AS (SELECT term, name, count(*) AS tf, sum(w) AS wtf FROM tok GROUP BY term, name),
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term),
len AS (SELECT d.name, coalesce(n, 0) AS n_tokens FROM d LEFT JOIN (SELECT name, count(*) AS n FROM tok GROUP BY name) USING (name)),
st AS (SELECT count(*) AS n_docs, sum(n_tokens) / count(*) AS avg_len FROM len)"""


def fuzzy_sql(table: str, most: int = 5) -> str:
    """place, token, term, d, nth: the nearest terms of the tokens of ``table``. Terms
    have a first character and about the length of the token, so swaps of neighbours
    within two edits are the only ones that count."""
    edits = "CASE WHEN length(token) >= 7 THEN 2 WHEN length(token) >= 5 THEN 1 ELSE 0 END"
    return f"""(SELECT place, token, term, d, row_number() OVER (PARTITION BY place ORDER BY d, length(term), term) AS nth
  FROM (SELECT place, token, term, damerau_levenshtein(term, token) AS d, {edits} AS most FROM {table} JOIN vocab ON left(term, 1) = left(token, 1) AND abs(length(term) - length(token)) <= {edits}
        WHERE regexp_full_match(token, '[a-z][a-z0-9_]*') AND regexp_full_match(term, '[a-z][a-z0-9_]*')) WHERE d BETWEEN 1 AND most QUALIFY nth <= {most})"""


def variants_sql(words: list[str]) -> str:
    """v: for each word its exact term, else up to 8 that begin with it, else near ones."""
    asked = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""
qw(place, token) AS (VALUES {asked}),
v0 AS (SELECT place, term, 1.0 AS mult, 1 AS k FROM qw JOIN vocab ON term = token),
v1 AS (SELECT place, term, 0.7 AS mult, row_number() OVER (PARTITION BY place ORDER BY term) AS k FROM qw JOIN vocab ON starts_with(term, token) WHERE length(token) >= 4 AND place NOT IN (SELECT place FROM v0) QUALIFY k <= 8),
qf AS (SELECT * FROM qw WHERE place NOT IN (SELECT place FROM v0) AND place NOT IN (SELECT place FROM v1)),
v2 AS (SELECT place, term, CASE d WHEN 1 THEN 0.45 ELSE 0.25 END AS mult, nth AS k FROM {fuzzy_sql("qf")}),
v AS (SELECT place, term, mult, row_number() OVER (ORDER BY place, k) AS nth FROM (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2))"""


def search_sql(variants: list[tuple[int, str, float]] | None, limit: int, least: float = 0.0) -> str:
    """h: ranked hits of given variants (place, term, weight), or those of a table v."""
    rows = ", ".join(f"({p}, '{t}', {w}, {i})" for i, (p, t, w) in enumerate(variants or []))
    given = f"v(place, term, mult, nth) AS (VALUES {rows})," if variants else ""
    return f"""
{given}
idf AS (SELECT v.term, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 0) AS raw, n_docs, avg_len FROM (SELECT DISTINCT term FROM v) v JOIN vocab USING (term), st),
sc AS (SELECT post.name, v.place, v.nth, v.term, (CASE WHEN raw > 0 THEN raw ELSE 1e-6 END) * ((wtf / 10.0) * 2.2) / ((wtf / 10.0) + 1.2 * (0.25 + 0.75 * n_tokens / avg_len)) * v.mult AS s
  FROM v JOIN post USING (term) JOIN idf USING (term) JOIN len USING (name)),
b AS (SELECT name, place, s, term FROM (SELECT *, row_number() OVER (PARTITION BY name, place ORDER BY s DESC, nth) AS r FROM sc) WHERE r = 1),
agg AS (SELECT name, sum(s) AS score, count(*) AS coverage, list(term ORDER BY place) AS terms FROM b GROUP BY name),
h AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, coverage DESC, sr, name) AS rank, name, score, coverage, terms
  FROM agg JOIN (SELECT name, CASE scope WHEN 'first' THEN 0 WHEN 'second' THEN 1 ELSE 2 END AS sr FROM s) USING (name) WHERE score >= {least}
  QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, coverage DESC, sr, name) <= {limit})"""


def sql(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)} {select}"


#: After the candidates (pool): comp0: what its documents require, with depth and via; sub: relations among
#: these; entries with their layers (the longest paths over the components of sub).
PROJECT = """
seeds AS (SELECT name FROM pool),
rq AS (SELECT DISTINCT from_name AS u, to_name AS v FROM e WHERE resolved AND relation = 'requires'),
w0(name, depth) AS (SELECT name, 0 FROM seeds UNION SELECT v, depth + 1 FROM w0 JOIN rq ON u = name WHERE depth < 40),
m0 AS (SELECT name, min(depth) AS depth FROM w0 GROUP BY name),
comp0 AS (SELECT m0.name, CASE WHEN m0.depth = 0 THEN 'seed' ELSE 'required' END AS reason, m0.depth, min(p.name) AS via FROM m0 LEFT JOIN rq ON rq.v = m0.name AND m0.depth > 0
  LEFT JOIN m0 p ON p.name = rq.u AND p.depth = m0.depth - 1 GROUP BY m0.name, m0.depth),
sub AS (SELECT DISTINCT from_name AS u, to_name AS v FROM e WHERE resolved AND from_name IN (SELECT name FROM comp0) AND to_name IN (SELECT name FROM comp0)),
cl0(u, v) AS (SELECT u, v FROM sub UNION SELECT cl0.u, sub.v FROM cl0 JOIN sub ON cl0.v = sub.u),
rt AS (SELECT comp0.name, least(comp0.name, coalesce(min(x.v), comp0.name)) AS root FROM comp0 LEFT JOIN (SELECT a.u, a.v FROM cl0 a JOIN cl0 b ON a.u = b.v AND a.v = b.u) x ON x.u = comp0.name GROUP BY comp0.name),
cond AS (SELECT DISTINCT a.root AS u, b.root AS v FROM sub JOIN rt a ON a.name = u JOIN rt b ON b.name = v WHERE a.root <> b.root),
rl(root, l) AS (SELECT DISTINCT root, 0 FROM rt UNION SELECT u, l + 1 FROM rl JOIN cond ON v = root WHERE l < 60),
ap(root, l) AS (SELECT DISTINCT root, 0 FROM rt UNION SELECT v, l + 1 FROM ap JOIN cond ON u = root WHERE l < 60),
entries AS (SELECT comp0.*, r.l AS read_layer, a.l AS apply_layer FROM comp0 JOIN rt USING (name) JOIN (SELECT root, max(l) AS l FROM rl GROUP BY root) r USING (root) JOIN (SELECT root, max(l) AS l FROM ap GROUP BY root) a USING (root))"""


#: turns: a queue of documents whose labels got better; a label is (s: strength, depth, via).
WALK = """
offered AS (SELECT from_name, to_name, CASE relation WHEN 'requires' THEN 2 ELSE 1 END AS s FROM e WHERE resolved QUALIFY row_number() OVER (PARTITION BY from_name, to_name ORDER BY relation DESC) = 1),
first(name, num) AS (VALUES {seeds}),
turns(kind, id, num, name, s, depth, via) USING KEY (kind, id) AS (
  SELECT kind, CASE kind WHEN 'q' THEN CAST(num AS VARCHAR) ELSE name END, CAST(num AS BIGINT), name, 3, 0, CAST(NULL AS VARCHAR) FROM first, (VALUES ('q'), ('b')) AS k(kind)
  UNION ALL SELECT 'c', '', 0, '', 0, {last}, NULL
  UNION
  (WITH cur AS (SELECT num AS head, depth AS tail FROM recurring.turns WHERE kind = 'c'),
   item AS (SELECT q.* FROM recurring.turns AS q, cur WHERE q.kind = 'q' AND q.num = head),
   live AS (SELECT item.* FROM item JOIN recurring.turns AS b ON b.kind = 'b' AND b.name = item.name AND b.s = item.s AND b.depth = item.depth AND b.via IS NOT DISTINCT FROM item.via),
   accepted AS (SELECT o.to_name, o.s, live.depth + 1 AS depth, live.name AS via, row_number() OVER (ORDER BY o.s DESC) AS nth FROM live JOIN offered AS o ON o.from_name = live.name
     LEFT JOIN recurring.turns AS b ON b.kind = 'b' AND b.name = o.to_name
     WHERE b.name IS NULL OR o.s > b.s OR o.s = b.s AND (live.depth + 1 < b.depth OR live.depth + 1 = b.depth AND live.name < b.via))
   SELECT 'b', to_name, 0, to_name, s, depth, via FROM accepted
   UNION ALL SELECT 'q', CAST(tail + nth AS VARCHAR), tail + nth, to_name, s, depth, via FROM accepted, cur
   UNION ALL SELECT 'c', '', head + 1, '', 0, tail + (SELECT count(*) FROM accepted), NULL FROM cur WHERE head <= tail))"""


def route_sql(limit: int) -> str:
    """After tiers and entries: steps, phases."""
    return f"""
steps AS (SELECT row_number() OVER (ORDER BY t, rank) AS o, t, name FROM tier QUALIFY o <= {limit}),
kinds AS (SELECT o, name, ['start', 'read-layer', 'apply-layer', 'fallback'][t + 1] AS kind, CASE t WHEN 1 THEN read_layer WHEN 2 THEN coalesce(apply_layer, read_layer) END AS layer FROM steps LEFT JOIN entries USING (name)),
fresh AS (SELECT *, CASE WHEN lag(o) OVER w IS NULL OR kind IS DISTINCT FROM lag(kind) OVER w OR layer IS DISTINCT FROM lag(layer) OVER w THEN 1 ELSE 0 END AS f FROM kinds WINDOW w AS (ORDER BY o)),
isle AS (SELECT *, sum(f) OVER (ORDER BY o) AS i FROM fresh),
phases AS (SELECT CAST(i AS INTEGER) AS "order", kind, layer, list(name ORDER BY o) AS names, list('skill://' || name ORDER BY o) AS read_paths,
  CASE kind WHEN 'start' THEN 'decide winner' WHEN 'read-layer' THEN 'pack read layer ' || coalesce(CAST(layer AS VARCHAR), '-') WHEN 'apply-layer' THEN 'pack apply layer ' || coalesce(CAST(layer AS VARCHAR), '-') ELSE 'remaining planned steps' END AS rationale
  FROM isle GROUP BY i, kind, layer)"""


def pack_sql(budget: int) -> str:
    """After entries: packed, each with its body if it fits into what is left of the budget."""
    return f"""
line AS (SELECT entries.*, path, body, category, s.scope, length(body) AS n, row_number() OVER (ORDER BY CASE reason WHEN 'seed' THEN -3 WHEN 'required' THEN -2 ELSE -1 END, coalesce(read_layer, 2147483647), depth, name) AS k FROM entries JOIN d USING (name) JOIN s USING (name)),
fold(k, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), NULL::BOOLEAN UNION ALL
  SELECT line.k, used + CASE WHEN n > 0 AND used + n <= {budget} THEN n ELSE 0 END, CASE WHEN n > 0 THEN used + n <= {budget} END FROM fold JOIN line ON line.k = fold.k + 1),
packed AS (SELECT line.*, CASE WHEN taken THEN body END AS included, coalesce(NOT taken, false) AS omitted FROM line JOIN fold USING (k))"""


_COMMAND = lambda p: f"'read(\"' || {p} || '\")'"
#: After phases and packed: be: packed entries in the order of phases; tn: turns; bt: blocked turns; head.
PACKETS = f"""
be AS (SELECT "order" AS phase_order, kind AS phase_kind, layer, CAST(pos - 1 AS INTEGER) AS pos, packed.name, packed.path, packed.scope, packed.category, packed.omitted
  FROM (SELECT "order", kind, layer, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM phases) p JOIN packed USING (name)),
head AS (SELECT (SELECT name FROM win) AS winner, NOT (SELECT bool_or(omitted) FROM packed) AS ready),
bw AS (SELECT phase_order, list(path ORDER BY pos) AS paths, bool_or(omitted) AS blocked, list(path ORDER BY pos) FILTER (omitted) AS lost, list('skill://' || name ORDER BY pos) FILTER (omitted) AS lost_read FROM be GROUP BY phase_order),
tn0 AS (SELECT "order", kind AS phase_kind, layer, names, read_paths, coalesce(paths, []) AS source_paths, coalesce(blocked, false) AS blocked_by_budget, lost, lost_read,
  list_transform(coalesce(paths, []), lambda p: {_COMMAND("p")}) AS next_commands, coalesce(CAST(layer AS VARCHAR), '-') AS shown FROM phases LEFT JOIN bw ON phase_order = "order"),
tn AS (SELECT "order", phase_kind, layer, names, read_paths, source_paths, blocked_by_budget, next_commands,
  CASE phase_kind WHEN 'start' THEN 'Start with winner ' || coalesce(names[1], '-') WHEN 'read-layer' THEN 'Read required layer ' || shown || ' before dependent peers'
    WHEN 'apply-layer' THEN 'Read apply layer ' || shown || ' for optional extension' ELSE 'Inspect remaining fallback steps' END AS objective,
  list_filter([CASE WHEN len(read_paths) > 0 THEN 'Read packet entries: ' || array_to_string(read_paths, ', ') END, CASE WHEN len(next_commands) > 0 THEN 'Open source files: ' || array_to_string(next_commands, ' -> ') END,
    CASE WHEN blocked_by_budget THEN 'Resolve omitted skill bodies before applying this turn.' ELSE 'No omitted skill body in this turn.' END], lambda x: x IS NOT NULL) AS checklist,
  list_filter([CASE WHEN len(names) > 0 THEN 'Reviewed skills: ' || array_to_string(names, ', ') END,
    CASE WHEN blocked_by_budget THEN 'Budget omissions cleared for turn ' || "order" ELSE 'Turn ' || "order" || ' is ready without extra budget recovery' END], lambda x: x IS NOT NULL) AS exit_criteria FROM tn0),
bt AS (SELECT "order", phase_kind, layer, names, lost_read AS omitted_read_paths, lost AS source_paths, list_transform(lost, lambda p: {_COMMAND("p")}) AS recovery_commands,
  CASE phase_kind WHEN 'start' THEN 'Recover winner ' || coalesce(names[1], '-') || ' before continuing' WHEN 'read-layer' THEN 'Recover required layer ' || shown || ' before dependent peers'
    WHEN 'apply-layer' THEN 'Recover optional apply layer ' || shown || ' before extension work' ELSE 'Recover fallback steps before resuming' END AS objective,
  ['Read omitted skill bodies: ' || array_to_string(lost_read, ', '), 'Open source files: ' || array_to_string(list_transform(lost, lambda p: {_COMMAND("p")}), ' -> ')] AS unblock_criteria FROM tn0 WHERE blocked_by_budget),
rest AS (SELECT * FROM tn WHERE "order" >= coalesce((SELECT min("order") FROM bt), 0)),
guide AS (SELECT CASE WHEN len(o) > 0 THEN ['Read omitted paths first: ' || array_to_string(o, ', '), 'Increase budgetChars/budgetTokens or inspect omittedReadPaths before apply.'] ELSE [] END AS recovery_guidance
  FROM (SELECT coalesce(list('skill://' || name ORDER BY name) FILTER (omitted), []) AS o FROM packed)),
cur AS (SELECT winner, recovery_guidance, NOT blocked_by_budget AS ready, rest.* FROM head, guide, (SELECT * FROM rest ORDER BY "order" LIMIT 1) rest)"""

_NUMBERED = lambda x: f"array_to_string(list_transform({x}, lambda v, i: i || '. ' || v), chr(10))"
_DASHED = lambda x: f"array_to_string(list_transform({x}, lambda v: '- ' || v), chr(10))"
#: After cur: t1, t2, t3: the texts of the current turn.
TEXTS = f"""
t0 AS (SELECT *, {_NUMBERED("checklist")} AS checklist_text, array_to_string(next_commands, chr(10)) AS command_block, coalesce(':' || layer, '') AS at_layer FROM cur),
t1 AS (SELECT *, 'Focus on turn ' || "order" || ' (' || phase_kind || at_layer || ').' || chr(10) || 'Read skills: ' || array_to_string(names, ', ') || '.' || chr(10) || objective || chr(10)
  || CASE WHEN command_block <> '' THEN 'Commands:' || chr(10) || command_block ELSE 'Commands: -' END || chr(10) || CASE WHEN checklist_text <> '' THEN 'Checklist:' || chr(10) || checklist_text ELSE 'Checklist: -' END AS instruction_text,
  winner || ' turn ' || "order" || ': ' || objective || '. commands=' || len(next_commands) || ', checklist=' || len(checklist) AS summary_text, winner || '-turn-' || "order" AS base_name FROM t0),
t2 AS (SELECT *, '# ' || winner || ' turn ' || "order" || chr(10) || chr(10) || '## Summary' || chr(10) || instruction_text || chr(10) || chr(10) || '## Commands' || chr(10) || coalesce(nullif(command_block, ''), '-') || chr(10) || chr(10)
  || '## Checklist' || chr(10) || coalesce(nullif({_DASHED("string_split(checklist_text, chr(10))")}, ''), '-') || chr(10) || chr(10) || '## Recovery' || chr(10) || coalesce(nullif({_DASHED("recovery_guidance")}, ''), '-') AS markdown FROM t1),
t3 AS (SELECT *, [{{'kind': 'markdown', 'path': 'packets/' || base_name || '.md', 'media': 'text/markdown', 'content': markdown}},
    {{'kind': 'checklist', 'path': 'packets/' || base_name || '.checklist.md', 'media': 'text/markdown', 'content': coalesce(nullif({_DASHED("checklist")}, ''), '-')}},
    {{'kind': 'commands', 'path': 'packets/' || base_name || '.commands.txt', 'media': 'text/plain', 'content': coalesce(nullif(command_block, ''), '-')}}] AS files, 'packets/' || base_name || '.write.py' AS script_path FROM t2),
t4 AS (SELECT *, 'python ' || script_path AS run_command, {_NUMBERED("list_transform(files, lambda f: 'write ' || f.path || ' (' || f.kind || ')')")} AS apply_text FROM t3),
t5 AS (SELECT *, '1. Write script file: ' || script_path || chr(10) || '2. Run command: ' || run_command || chr(10) || '3. Expect ' || len(files) || ' file write operations.' AS execution_text,
  'Run:' || chr(10) || run_command || chr(10) || chr(10) || 'Verify:' || chr(10) || {_NUMBERED("exit_criteria")} AS verification_text,
  'import json' || chr(10) || 'from pathlib import Path' || chr(10) || chr(10) || 'WRITES = json.loads(' || to_json([CAST(to_json(list_transform(files, lambda f: {{'kind': 'write', 'sourceKind': f.kind, 'path': f.path, 'mediaType': f.media, 'content': f.content}})) AS VARCHAR)]) || '[0])' || chr(10) || chr(10)
  || 'for write in WRITES:' || chr(10) || '    path = Path(write["path"])' || chr(10) || '    path.parent.mkdir(parents=True, exist_ok=True)' || chr(10) || '    path.write_text(write["content"])' || chr(10) || '    print("wrote", path, "(" + write["sourceKind"] + ")")' AS script_content FROM t4)"""

"""Markdown documents with frontmatter as document records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.corpus import DOCUMENT, Corpus, Settings, build
from corpusloom.plans.request import roots_for_scopes
from corpusloom.sources.walk import PLACES, walk

# Directories that are not entered, and the names that a field goes by (first present counts).
SKIPPED = (".git", ".svn", "node_modules", ".venv", "dist", "build", "out", "constructor")
FIELDS = {
    "name": ["name"],
    "description": ["description", "summary"],
    "category": ["category", "group", "type"],
    "keywords": ["keywords"],
    "tags": ["tags", "tag"],
    "aliases": ["aliases", "alias"],
    "requires": ["requires", "require", "depends_on"],
    "recommends": ["recommends", "recommend", "related"],
    "version": ["version", "skill_version"],
}
#: Places of one root: as many as 2^19 partitions number.
_ROOT_PLACES = PLACES << 19
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)"
_ENTRY, _ITEM = re.compile(r"([A-Za-z][A-Za-z0-9_-]*):(.*)"), re.compile(r"\s*-\s*(\S.*)")


def _unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value


def parse_front(block: str) -> dict[str, list[str]]:
    """Lines of a frontmatter block: ``key: value`` (the key begins with a letter and
    stands right before the colon) and lists of ``- item`` or ``-item`` lines. A
    scalar is a list whose first element is marked with a leading NUL, so that lists
    and scalars stay apart; a later key of one name replaces an earlier one."""
    found: dict[str, list[str]] = {}
    open_list: str | None = None
    for line in block.replace("\r\n", "\n").split("\n"):
        if entry := _ENTRY.fullmatch(line):
            key, value = entry[1].lower(), entry[2].strip()
            open_list = None if value else key
            found[key] = ["\0" + value] if value else []
        elif open_list and (item := _ITEM.fullmatch(line)):
            found[open_list].append(_unquoted(item[1]))
        elif line.strip() and not line[0].isspace():
            open_list = None
    return found


def as_list(values: list[str] | None) -> list[str]:
    """The items of a field: of a list, of ``[a, "b"]``, or of text cut at commas,
    semicolons and line ends (quotes stay there)."""
    if not values:
        return []
    if not values[0].startswith("\0"):
        return [v.strip() for v in values if v.strip()]
    text = values[0][1:].strip()
    if text.startswith("[") and text.endswith("]"):
        return [v for p in text[1:-1].split(",") if (v := _unquoted(p))]
    return [v.strip() for v in re.split(r"[,;\n]", text) if v.strip()]


def as_text(values: list[str] | None) -> str | None:
    return None if values is None else _unquoted(values[0][1:]) if values and values[0].startswith("\0") else ", ".join(values)


def safe_name(name: str) -> bool:
    """Whether a name may be looked up as a path below a root."""
    return bool(name) and name not in (".", "..") and not name.startswith("/") and "/" not in name and "\\" not in name


def scan(spark: SparkSession, root: str, file_names: tuple[str, ...] = ("SKILL.md",), names: list[str] | None = None) -> DataFrame | None:
    """path, size, mtime_ms, content of the files below a root whose name fits; None if
    there is no such root. Skipped directories are those below the root.

    With ``names``, ``root/name/file`` and ``root/name.ext`` are looked up first; if
    every name is found so, only these files are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    system = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(top) or not system.getFileStatus(top).isDirectory():
        return None
    direct: list[str] = []
    for name in names or []:
        places = [f"{root}/{name}/{f}" for f in file_names] + [f"{root}/{name}{PurePosixPath(f).suffix}" for f in file_names]
        met = [p for p in places if safe_name(name) and system.exists(hadoop.Path(p))]
        if not met:
            direct = []
            break
        direct += met
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    rows = reader.load(direct if direct else root)
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    rows = rows.select(plain.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), "content")
    if direct:
        return rows.distinct()
    below = F.split(F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.char_length("path")), "/")
    folders = F.slice(below, F.lit(1), F.size(below) - 1)
    return rows.where(F.element_at(below, -1).isin(*file_names) & ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED])))


def sources(spark: SparkSession, root: str, file_names: tuple[str, ...] = ("SKILL.md",), names: list[str] | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The files below a root, with their contents and as a list without; None if there is
    no such root. A root on a file system that all executors see as a local folder is
    walked (:mod:`walk`; rows have a ``place``); others, and names, go by :func:`scan`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if names or system.getUri().getScheme() != "file":
        files = scan(spark, root, file_names, names)
        return files and (files, files)
    if not system.exists(path) or not system.getFileStatus(path).isDirectory():
        return None
    local = path.toUri().getPath()
    return walk(spark, local, file_names, SKIPPED), walk(spark, local, file_names, SKIPPED, contents=False)


def manifests(files: DataFrame, *by: str) -> DataFrame:
    """``by``, signature: for each value of the columns ``by`` a digest of (path, size,
    mtime_ms) of its files in any order; contents aren't read."""
    line = F.concat_ws("|", "path", F.col("size").cast("string"), F.col("mtime_ms").cast("long").cast("string"))
    digest = files.select(*by, F.sha2(line.cast("binary"), 256).alias("d"))
    # order-free and without gathering: counts and sums of the digests' parts
    parts = [F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(5)]
    return digest.groupBy(*by).agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts).cast("binary"), 256).alias("signature"))


def manifest(files: DataFrame) -> str:
    """The one digest of all files."""
    return manifests(files).first()["signature"]


def parse(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Document records (:data:`DOCUMENT` columns) and malformed files (path, reason).
    Ordinals are the files' ``place`` where they have one, else hashes of their paths."""
    placed = "place" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, mtime, content, place in zip(rows["path"], rows["mtime_ms"], rows["content"], rows["place"], strict=True):
                try:
                    if content is None:
                        raise OSError("no content")
                    text = content.decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    none = {k: [] for k in ("keywords", "tags", "aliases", "requires", "recommends")}
                    out.append({"path": path, "place": place, "mtime_ms": mtime, "body_text": "", "name": "", "description": "", "category": "", "version": None, "reason": f"read failed: {e}", **none})
                    continue
                m = re.match(FRONT, text)
                front = parse_front(m[1]) if m else {}
                body = text[m.end() :] if m else text
                f = {k: next((front[n] for n in names if n in front), None) for k, names in FIELDS.items()}
                out.append({"path": path, "place": place, "mtime_ms": mtime, "body_text": body, "name": as_text(f["name"]) or PurePosixPath(path).parent.name, "description": as_text(f["description"]) or "", "category": as_text(f["category"]) or "", "version": as_text(f["version"]), "reason": None, **{k: as_list(f[k]) for k in ("keywords", "tags", "aliases", "requires", "recommends")}})
            yield pd.DataFrame(out, columns=["path", "place", "mtime_ms", "body_text", "name", "description", "category", "version", "reason", "keywords", "tags", "aliases", "requires", "recommends"])

    schema = "path string, place long, mtime_ms double, body_text string, name string, description string, category string, version string, reason string, keywords array<string>, tags array<string>, aliases array<string>, requires array<string>, recommends array<string>"
    place = F.col("place") if placed else F.xxhash64("path")
    rows = files.select("path", "mtime_ms", "content", place.alias("place")).mapInPandas(run, schema).withColumn("canonical_name", X.canonical_name(F.col("name")))
    empty = F.col("canonical_name") == ""
    malformed = rows.where(F.col("reason").isNotNull() | empty).select("path", F.coalesce("reason", F.lit("no name")).alias("reason"))
    own = F.col("canonical_name")

    def named(column: str) -> Column:
        return F.array_remove(F.array_distinct(F.transform(column, X.canonical_name)), own)

    def plain(column: str) -> Column:
        return F.array_distinct(F.transform(column, lambda v: F.lower(F.btrim(v, F.lit("\"' ")))))

    heading = F.substring(F.btrim(F.regexp_extract("body_text", r"(?m)^#+\s*(.+)$", 1)), 1, 80)
    title = F.coalesce(F.nullif(heading, F.lit("")), F.nullif("description", F.lit("")), own)
    good = rows.where(F.col("reason").isNull() & ~empty)
    records = good.select(
        F.col("place").alias("ordinal"), own.alias("skill_id"), "canonical_name", "path", F.lit(root).alias("source_root"), F.lit(None).cast("string").alias("scope"), title.alias("title"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorized")).alias("category"), "description", plain("keywords").alias("keywords"), plain("tags").alias("tags"),
        named("aliases").alias("aliases"), named("requires").alias("requires"), F.array_except(named("recommends"), named("requires")).alias("recommends"), "body_text", "version", "mtime_ms",
    )
    return records, malformed


def load(spark: SparkSession, roots: list[str], settings: Settings, file_names: tuple[str, ...] = ("SKILL.md",), names: list[str] | None = None, scopes: list[str] | None = None) -> tuple[Corpus, dict]:
    """The corpus below several roots (documents in order of root and walk, or of root and
    path where a root can't be walked), with
    facts: missing roots and the digest of the sources. With ``scopes`` only roots are
    read that lie in, or hold, a root of theirs."""
    if scopes is not None:
        roots = roots_for_scopes(roots, [r for s in scopes for r in settings.scope_roots.get(s, [])])
    records = malformed = None
    missing, signatures = [], []
    for nth, root in enumerate(roots):
        held = sources(spark, root.rstrip("/"), file_names, names)
        if held is None:
            missing.append(root)
            continue
        files, thin = held
        signatures.append(manifest(thin))
        good, bad = parse(files, root.rstrip("/"))
        walked = F.col("ordinal") if "place" in files.columns else F.lit(0).cast("long")
        good = good.withColumn("ordinal", F.lit(nth * _ROOT_PLACES).cast("long") + walked)
        records = good if records is None else records.unionByName(good)
        malformed = bad if malformed is None else malformed.unionByName(bad)
    if records is None:
        records, malformed = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], "path string, reason string")
    return build(records, settings, malformed), {"missing_roots": missing, "signatures": signatures}

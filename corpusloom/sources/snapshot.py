"""Snapshots of a corpus and its index: written once, reused while fresh, and followed by
what has changed since.

A version is a list of parts. The first holds all documents, their postings and vocabulary;
each later one the documents that are new or differ, with their postings, and what this
changes in the vocabulary (signed). ``seen`` names the documents that a part replaces or
removes, so a row of a part stands unless a later part has seen its document. A reader
keeps to the parts of its version; a version of too many parts, or one that differs too
much from the last, is written whole.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.corpus import Corpus, Settings
from corpusloom.operators.index import Index, arranged, postings, settled, vocabulary
from corpusloom.operators.tables import written

#: Content of the mark that says a folder is ours.
OWNER = "corpusloom snapshot 1"
FRAMES = ("documents", "aliases", "duplicates", "alias_conflicts", "malformed")
#: A version of so many parts, or of which more than this share has changed, is followed by a whole one.
PARTS_MOST, CHANGED_MOST = 8, 0.25
_TOKEN = re.compile("[0-9a-f]{32}")


def _digest(documents: DataFrame) -> Column:
    """What tells whether any column of a document has changed."""
    return F.sha2(F.to_json(F.struct(*sorted(documents.columns))).cast("binary"), 256)


class SnapshotError(RuntimeError):
    """A folder that is not ours, or a snapshot that is no longer current."""


class Store:
    """A folder of versions. A version's files are complete before a pointer names it;
    pointers are numbered and never changed, and the highest whole one counts, so a
    write that breaks off anywhere leaves the version before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        if self._exists("") and self._list() and self._read("_ENGINE") != OWNER:
            raise SnapshotError(f"{folder} belongs to something else")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        system, path = self._path(name)
        return system.exists(path)

    def _list(self) -> list[str]:
        system, path = self._path("")
        return [s.getPath().getName() for s in system.listStatus(path)]

    def _read(self, name: str) -> str | None:
        system, path = self._path(name)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A new file; one of this name is an error."""
        system, path = self._path(name)
        stream = system.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _pointers(self) -> list[str]:
        return sorted((n for n in self._list() if n.startswith("current-")), reverse=True) if self._exists("") else []

    def save(self, corpus: Corpus, request: dict, signature: str, now_ms: int | None = None, whole: bool = False) -> str:
        """Write a version and make it the current one; its token. Unless ``whole``, only
        what differs from the version before is indexed and written."""
        began = time.time()
        token = uuid.uuid4().hex
        held = None if whole else self.facts()
        totals = self._changes(corpus, held, token) if held and len(held.get("parts", ())) in range(1, PARTS_MOST) else None
        totals = totals or self._whole(corpus, token)
        for name in FRAMES[1:]:
            getattr(corpus, name).write.parquet(f"{self.folder}/{token}/{name}")
        parts, n_docs, n_tokens = totals
        facts = {"token": token, "request": request, "signature": signature, "generated_at": now_ms or int(time.time() * 1000), "ttl_ms": corpus.settings.cache_ttl_ms, "parts": parts, "n_docs": n_docs, "n_tokens": n_tokens, "avg_len": n_tokens / n_docs if n_docs else 0.0, "index_build_ms": int((time.time() - began) * 1000)}
        if not self._exists("_ENGINE"):
            self._write("_ENGINE", OWNER)
        pointers = self._pointers()
        self._write(f"current-{int(pointers[0].rsplit('-', 1)[1]) + 1 if pointers else 1:09d}", json.dumps(facts, sort_keys=True))
        return token

    def _table(self, part: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{part}/{name}")

    def _put(self, df: DataFrame, part: str, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{part}/{name}")
        return self._table(part, name)

    def _whole(self, corpus: Corpus, token: str) -> tuple[list[str], int, int]:
        """Write all documents and their index as the only part; parts, documents, tokens."""
        documents = self._put(corpus.documents, token, "documents")
        rows = self._put(arranged(*settled(documents)), token, "postings")
        self._put(vocabulary(rows).repartitionByRange("term").sortWithinPartitions("term"), token, "vocab")
        seen = self._put(documents.select("skill_id", _digest(documents).alias("digest")), token, "seen")
        return [token], seen.count(), rows.agg(F.sum("tf")).first()[0] or 0

    def _changes(self, corpus: Corpus, held: dict, token: str) -> tuple[list[str], int, int] | None:
        """Write the documents that differ from the version ``held`` as one more part (none
        if nothing does); parts, documents, tokens. None where too much has changed.

        Documents are compared by digests; their bodies move in no shuffle, as what has
        changed is at most a share of the names and is what the joins broadcast where small."""
        now = written(corpus.documents.select("skill_id", _digest(corpus.documents).alias("now")), "digests")
        was = self._standing("seen", held["parts"]).where("digest is not null")
        changed = written(was.join(now, "skill_id", "full").where(~F.col("digest").eqNullSafe(F.col("now"))).select("skill_id"), "changed")
        if (n := changed.count()) > CHANGED_MOST * held["n_docs"]:
            return None
        if n == 0:
            return held["parts"], held["n_docs"], held["n_tokens"]
        fresh = self._put(corpus.documents.join(changed, "skill_id", "left_semi"), token, "documents")
        stale = written(self._standing("documents", held["parts"]).join(changed, "skill_id", "left_semi"), "stale")
        rows, gone = self._put(arranged(*settled(fresh)), token, "postings"), written(postings(stale), "gone")
        signed = vocabulary(rows).unionByName(vocabulary(gone).withColumn("df", -F.col("df"))).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        self._put(signed.repartitionByRange("term").sortWithinPartitions("term"), token, "vocab")
        # digests of what was written, whatever the sources have become since
        self._put(changed.join(fresh.select("skill_id", _digest(fresh).alias("digest")), "skill_id", "left"), token, "seen")
        more, less = (x.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0] for x in (rows, gone))
        return [*held["parts"], token], held["n_docs"] + fresh.count() - stale.count(), held["n_tokens"] + more - less

    def _standing(self, name: str, parts: list[str]) -> DataFrame:
        """The rows of a table of documents or postings that no later part replaces."""
        found = None
        for i, part in enumerate(parts):
            rows = self._table(part, name)
            if later := parts[i + 1 :]:
                rows = rows.join(self.spark.read.parquet(*[f"{self.folder}/{p}/seen" for p in later]).select("skill_id"), "skill_id", "left_anti")
            found = rows if found is None else found.unionByName(rows)
        return found

    def _vocab(self, parts: list[str]) -> DataFrame:
        if len(parts) == 1:
            return self._table(parts[0], "vocab")
        rows = self.spark.read.parquet(*[f"{self.folder}/{p}/vocab" for p in parts])
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def prune(self, kept: int = 2) -> list[str]:
        """Delete all but the latest ``kept`` versions and the folders that none of these
        needs; the folders' names. Readers of older versions, and a version that is being
        written, lose their files, so this belongs between writes."""
        held = list(islice(self._whole_pointers(), max(kept, 1)))
        if not held:
            return []
        needed = {t for _, f in held for t in (f["token"], *f.get("parts", ()))}
        folders = [n for n in self._list() if _TOKEN.fullmatch(n) and n not in needed]
        for name in [*(p for p in self._pointers() if p < held[-1][0]), *folders]:
            system, path = self._path(name)
            system.delete(path, True)
        return folders

    def facts(self) -> dict | None:
        """The current version's facts; None if there is none or they can't be read."""
        return next(self._whole_pointers(), (None, None))[1]

    def _whole_pointers(self) -> Iterator[tuple[str, dict]]:
        """Pointers that can be read, latest first, and the facts of their versions."""
        for pointer in self._pointers():
            try:
                found = json.loads(self._read(pointer) or "null")
            except ValueError:
                continue
            if isinstance(found, dict) and {"token", "request", "generated_at", "ttl_ms", "n_docs", "avg_len"} <= found.keys():
                yield pointer, found

    def load(self, request: dict, settings: Settings, signature: str | None = None, now_ms: int | None = None) -> tuple[Corpus, Index, str] | None:
        """The current version if it answers the request: same parameters, same
        sources, not older than its time to live."""
        f = self.facts()
        now = now_ms or int(time.time() * 1000)
        if f is None or f["request"] != request or now - f["generated_at"] >= f["ttl_ms"] or signature is not None and f["signature"] != signature:
            return None
        return *self.frames(settings, f), f["token"]

    def frames(self, settings: Settings, facts: dict | None = None) -> tuple[Corpus, Index]:
        """Corpus and index of the version that ``facts`` tell of, or of the current one,
        whatever its age."""
        f = facts or self.facts()
        parts = f.get("parts") or [f["token"]]
        thin = [self._table(f["token"], n) for n in FRAMES[1:]]
        return Corpus(self._standing("documents", parts), *thin, settings=settings), Index(self._standing("postings", parts), self._vocab(parts), f["n_docs"], f["avg_len"])

    def require(self, token: str) -> None:
        """Refuse a version that is no longer the current one."""
        f = self.facts()
        if f is None or f["token"] != token:
            raise SnapshotError("the snapshot is no longer current")


def opened(store: Store, request: dict, settings: Settings, build: Callable[[], Corpus], signature: Callable[[], str], refresh: bool = False, now_ms: int | None = None) -> tuple[Corpus, Index, str]:
    """The corpus and index that answer a request: the current version if it was made for
    the same request, is within its time to live and its sources are unchanged; else, or
    with ``refresh``, a new one."""
    digest = signature()
    if not refresh and (held := store.load(request, settings, digest, now_ms)) is not None:
        return held
    token = store.save(build(), request, digest, now_ms)
    corpus, index = store.frames(settings)
    return corpus, index, token

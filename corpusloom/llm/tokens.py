"""Token counts and delta-maintained rollups of them.

:class:`Rollup` keeps additive totals (documents, tokens) by source, language and
tokenizer version. A batch of signed changes (insert, delete, revise) is reduced
to one row a key and committed under its id: a batch is written to a folder of its
own and counts once Spark's success marker stands there. Committing an id again
does nothing; a commit that broke off left no marker and is written anew, so
retries and lost executors never count twice. Totals are the sums over committed
batches; :meth:`Rollup.compact` folds these into one, which takes their place in a
single step.

Defined results: null and empty texts have no tokens and count as documents; null
sources and languages are keys of their own; a null count is zero tokens; equal
rows each count; deltas of an unknown kind or an empty batch add nothing (an
empty batch is committed all the same); further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import sliced

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at a time, which bounds memory on very long texts.
_PART = 1 << 20
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def version(path: str = RANKS) -> str:
    """Name and digest of a rank file: what a count depends on."""
    with open(path, "rb") as ranks:
        return f"{path.rsplit('/', 1)[-1].removesuffix('.tiktoken')}@{hashlib.sha256(ranks.read()).hexdigest()[:8]}"


def count_tokens(text: str | None, path: str = RANKS) -> int:
    """The number of byte-level BPE tokens of a whole text.

    Merges never cross what PATTERN cuts, and it cuts before every blank that
    stands alone; so very long texts are encoded in parts that begin with one."""
    total, place, text = 0, 0, text or ""
    while place < len(text):
        cut = _LONE_BLANK.search(text, place + _PART) if len(text) - place > _PART else None
        end = cut.start() if cut else len(text)
        total += len(_encoding(path).encode_ordinary(text[place:end]))
        place = end
    return total


def counted(docs: DataFrame, keep: tuple[str, ...], text: str = "text", path: str = RANKS, name: str = "n_tokens") -> DataFrame:
    """``keep`` columns with the token count of ``text``."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "__text"):
            n = [count_tokens(t, path) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(np.array(n, np.int64))], names=[*keep, name])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


KEYS = ("source", "lang", "version")


def signed(deltas: DataFrame) -> DataFrame:
    """Signed contributions of deltas (op, source, lang, version, n_tokens,
    old_tokens), one row a key: inserts add, deletes take away, a revision adds
    the difference to the old count. A column ``times``, if there is one, says how
    many equal deltas a row stands for."""
    op, new, old = F.col("op"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    times = F.coalesce("times", F.lit(1)) if "times" in deltas.columns else F.lit(1)
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(0)
    return deltas.groupBy(*KEYS).agg(F.sum(docs * times).cast("long").alias("docs"), F.sum(tokens * times).cast("long").alias("tokens"))


class Rollup:
    """Totals under one folder that all executors share."""

    SCHEMA = "source string, lang string, version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), found

    def _exists(self, path: str) -> bool:
        system, found = self._path(path)
        return system.exists(found)

    def _batch(self, batch_id: str) -> str:
        return f"{self.folder}/batch-{base64.urlsafe_b64encode(batch_id.encode()).decode().rstrip('=')}"

    def committed(self, batch_id: str) -> bool:
        """A batch counts once Spark's success marker stands; folded batches keep theirs."""
        return self._exists(f"{self._batch(batch_id)}/_SUCCESS")

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch once. False if it had been applied before."""
        if self.committed(batch_id):
            return False
        rows = signed(deltas).select(*KEYS, "docs", "tokens")
        rows.write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def _names(self) -> list[str]:
        system, folder = self._path(self.folder)
        return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []

    def _manifest(self, names: list[str]) -> dict:
        """The manifest of the highest number that is whole: the live total and the
        batches in it. One that was being written when its writer broke off is none."""
        for name in sorted((n for n in names if n.startswith("manifest-")), reverse=True):
            system, path = self._path(f"{self.folder}/{name}")
            stream = system.open(path)
            try:
                return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            except ValueError:
                continue
            finally:
                stream.close()
        return {"total": None, "folded": []}

    def _parts(self) -> tuple[dict, list[str]]:
        """The manifest, and the committed batches that are not in its total."""
        names = self._names()
        manifest = self._manifest(names)
        folded = set(manifest["folded"])
        return manifest, [n for n in names if n.startswith("batch-") and n not in folded and self._exists(f"{self.folder}/{n}/_SUCCESS")]

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all committed batches; keys that
        have come back to nothing are left out."""
        return self._summed(*self._parts())

    def _summed(self, manifest: dict, batches: list[str]) -> DataFrame:
        parts = [f"{self.folder}/{n}" for n in [manifest["total"], *batches] if n]
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*parts)
        summed = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold what is committed into one total. The new total counts from the moment
        when a manifest with the next number names it and the batches in it; whatever
        breaks off before leaves the old manifest, and with it all totals, as they were.
        Of two compactions at once one fails, as a manifest is never overwritten."""
        manifest, batches = self._parts()
        if not batches:
            return
        numbers = [int(n.rsplit("-", 1)[1]) for n in self._names() if n.startswith("manifest-")]
        total = f"total-{uuid.uuid4().hex}"
        self._summed(manifest, batches).write.parquet(f"{self.folder}/{total}")
        self._publish(f"manifest-{max(numbers, default=0) + 1:09d}", json.dumps({"total": total, "folded": [*manifest["folded"], *batches]}))

    def _publish(self, name: str, text: str) -> None:
        system, path = self._path(f"{self.folder}/{name}")
        stream = system.create(path, False)
        stream.write(bytearray(text.encode()))
        stream.close()


def word_count(text: Column) -> Column:
    """White-space words: the plain tokenizer ``words-1``."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[ \t-\r]+"))).cast("long")


def letter_word_count(text: Column) -> Column:
    """White-space words that hold a letter or digit: ``words-1`` as revised."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.size(F.filter(F.split(trimmed, "[ \t-\r]+"), lambda w: w.rlike("[\\p{L}\\p{N}]"))).cast("long")

"""Line dedup: lines that many documents share stay in one of them only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; of
it only 128 bits are kept. Hashes are range-partitioned and within a partition come
in the order (hash, document from the largest down, position), so that the first
document of a hash is the one that keeps its lines and the number of documents is
the last rank. What is gone comes back as a compressed bitmap for each document, not
as text: the words of 64 lines of which at least one is dropped, each with the number
of words before it that are kept whole.

A hash with more than ``MOST`` lines, which would fill a task, takes no part in that:
its documents and the largest of them are counted before the shuffle, and its lines
join that one row (a join that Spark splits where one key is large).

Defined results: a document is a doc_id; rows that share it count once and keep or
lose the same lines. Rows with a null doc_id are documents by their text; they come
after all others, so one keeps a line only where no doc_id has it, the first by hash
of the text. A null text is an empty one, and an empty text is one empty line. Keys
shorter than ``LEAST_CHARS`` code points stay wherever they are.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import named_back, plainly_named, written

#: Keys of fewer code points, or of fewer documents, are never dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines of one hash that a window task may hold.
MOST = 256
BLANKS = " \t\n\x0b\x0c\r"
BITMAP = "array<struct<skip:int,drop:bigint>>"


def _hashes(*of: Column | str) -> list[Column]:
    """128 bits as two columns: the hash under two seeds."""
    return [F.xxhash64(*of), F.xxhash64(F.lit("line"), *of)]


def _identity(doc_id: str, text: Column) -> list[Column]:
    """What tells documents apart: the id, and where it is null the text's hash."""
    return [F.col(doc_id).alias("d"), *[F.when(F.col(doc_id).isNull(), h).otherwise(F.lit(0)).alias(f"t{i}") for i, h in enumerate(_hashes(text))]]


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """d, t0, t1 (the document), h0, h1 (the key), pos (from 0): all lines with a key
    of at least ``least_chars`` code points."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(*_identity(doc_id, whole), F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
    stripped = lines.select("d", "t0", "t1", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= least_chars)
    h0, h1 = _hashes(F.translate("line", ascii_uppercase, ascii_lowercase))
    return stripped.select("d", "t0", "t1", h0.alias("h0"), h1.alias("h1"), "pos")


def repeated(lines: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """Those of ``lines`` (see :func:`line_hashes`; a written table) that go: their key
    is in at least ``least_docs`` documents, and theirs isn't the largest of them."""
    counts = written(lines.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs), "repeated-lines")
    # lines that can go at all; a line of a key with fewer lines than documents needed can't
    some = lines.join(counts, ["h0", "h1"])

    by_hash = Window.partitionBy("h0", "h1")
    order = [F.col("d").desc_nulls_last(), F.col("t0").desc(), F.col("t1").desc()]
    # both windows take the partitions and the order as they are
    ranged = some.where(F.col("n") <= most).repartitionByRange("h0", "h1").sortWithinPartitions("h0", "h1", *order, "pos")
    ranked = ranged.withColumn("rank", F.dense_rank().over(by_hash.orderBy(*order))).withColumn("docs", F.max("rank").over(by_hash))
    few = ranked.where((F.col("docs") >= least_docs) & (F.col("rank") > 1)).select("d", "t0", "t1", "pos")

    large = lines.join(counts.where(F.col("n") > most).select("h0", "h1"), ["h0", "h1"], "left_semi")
    holders = large.groupBy("h0", "h1", "d", "t0", "t1").agg(F.lit(1).alias("one"))
    # ids are compared first; texts decide only among documents without id
    found = holders.groupBy("h0", "h1").agg(F.count("*").alias("docs"), F.max("d").alias("last"), F.max(F.when(F.col("d").isNull(), F.struct("t0", "t1"))).alias("last_text"))
    found = written(found.where(F.col("docs") >= least_docs), "hot-lines")
    own = F.col("d").eqNullSafe(F.col("last")) & (F.col("d").isNotNull() | ((F.col("t0") == F.col("last_text.t0")) & (F.col("t1") == F.col("last_text.t1"))))
    many = lines.join(found, ["h0", "h1"]).where(~own).select("d", "t0", "t1", "pos")
    return few.unionByName(many)


def bitmaps(gone: DataFrame) -> DataFrame:
    """d, t0, t1, drops: the compressed bitmap of each document that loses lines."""
    words = gone.groupBy("d", "t0", "t1", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("drop"))
    kept = words.groupBy("d", "t0", "t1").agg(F.array_sort(F.collect_list(F.struct("word", "drop"))).alias("w"))
    packed = F.expr("transform(w, (x, i) -> struct(cast(x.word - if(i = 0, -1, w[i - 1].word) - 1 as int) as skip, x.drop as drop))")
    return kept.select("d", "t0", "t1", packed.cast(BITMAP).alias("drops"))


def _found(docs: DataFrame, doc_id: str, text: str, least_chars: int, least_docs: int, most: int) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with plain names and ``drops``; the plain names."""
    plain, names = plainly_named(docs)
    lines = written(line_hashes(plain, names[doc_id], names[text], least_chars), "lines")
    maps = written(bitmaps(repeated(lines, least_docs, most)), "bitmaps").toDF("md", "m0", "m1", "drops")
    keyed = plain.select("*", *_identity(names[doc_id], F.coalesce(F.col(names[text]), F.lit(""))))
    same = F.col("d").eqNullSafe(F.col("md")) & (F.col("t0") == F.col("m0")) & (F.col("t1") == F.col("m1"))
    # texts move once at every size; bitmaps, a bit a line at most, are the side that is held
    return keyed.join(maps.hint("shuffle_hash"), same, "left").select(*names.values(), "drops"), names


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", column: str = "drops", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """The columns of ``docs`` and ``column``, the document's compressed bitmap (null
    where all its lines stay); a bit of ``drop`` that is 1 is a line that goes."""
    found, names = _found(docs, doc_id, text, least_chars, least_docs, most)
    return named_back(found, names | {column: "drops"})


def n_dropped(drops: Column) -> Column:
    return F.coalesce(F.aggregate(drops, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["drop"])), F.lit(0).cast("long"))


def kept_text(text: Column, drops: Column) -> Column:
    """The lines that stay, joined; the text itself where the bitmap is null."""
    word = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(x["drop"], b) == 1)
    flags = F.flatten(F.transform(drops, lambda x: F.concat(F.array_repeat(F.lit(False), x["skip"] * 64), word(x))))
    lines = F.arrays_zip(F.split(text, "\n", -1).alias("line"), flags.alias("gone"))
    stay = F.filter(lines, lambda z: z["line"].isNotNull() & ~F.coalesce(z["gone"], F.lit(False)))
    return F.when(drops.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda z: z["line"]), "\n"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """``docs`` with the lines that stay as their text (null texts stay null)."""
    found, names = _found(docs, doc_id, text, least_chars, least_docs, most)
    return named_back(found.withColumn(names[text], kept_text(F.col(names[text]), F.col("drops"))), names)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    text = F.coalesce("text", F.lit(""))
    found = line_bitmaps(docs.select("doc_id", "text"))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return found.select("doc_id", n_lines.cast("long").alias("n_lines"), n_dropped(F.col("drops")).alias("n_dropped"), F.sha2(kept_text(text, F.col("drops")).cast("binary"), 256).alias("kept_sha256"))


REPORT_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, pos, line, r.key IS NULL OR k.doc_id = r.last AS stays FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

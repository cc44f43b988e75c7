"""Inverted index: postings with weighted term frequencies, vocabulary, lengths."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.tables import written

#: Fields and their weights in tenths, so that sums stay exact integers.
FIELDS = {"canonical_name": 30, "aliases": 26, "title": 22, "description": 20, "category": 14, "keywords": 12, "tags": 11, "body_text": 10}
#: Characters of a term's beginning whose deletions are indexed, and how many are deleted.
HEAD, DELETIONS = 7, 2
#: Terms that near terms are looked for among.
ASCII_TERM = "^[a-z][a-z0-9_]*$"
LISTS = ("aliases", "keywords", "tags")
#: Postings of a range, so that a task sorts its range in memory however many there are.
PER_RANGE = 1_000_000


@dataclass
class Index:
    """``postings``: term, skill_id, tf, wtf (weighted, tenths), n_tokens (of the
    document, so that scoring needs no further join); ``vocab``: term, df; ``pieces``:
    piece, term, see :meth:`deletions`; ``impacts``: see :func:`blocks.impacts`;
    ``passes``: words whose near terms were asked for."""

    postings: DataFrame
    vocab: DataFrame
    n_docs: int
    avg_len: float
    pieces: DataFrame | None = None
    impacts: tuple[DataFrame, DataFrame] | None = None
    passes: int = 0

    def deletions(self) -> DataFrame:
        """piece, term: what is left of the beginning of each ASCII term after up to
        ``DELETIONS`` deletions, in ranges of the piece. Terms within as many edits of a
        word share a piece with it, so near terms are found by equality and the sorted
        files without them are skipped. Built when first asked for."""
        if self.pieces is None:
            terms = self.vocab.where(F.col("term").rlike(ASCII_TERM))
            rows = terms.select(F.explode(pieces_of(F.col("term"))).alias("piece"), "term")
            self.pieces = written(rows.repartitionByRange("piece", "term").sortWithinPartitions("piece"), "deletions")
        return self.pieces


def pieces_of(term: Column) -> Column:
    """The first ``HEAD`` characters of a term after no, one or two deletions; the first
    character always stays."""

    def shorter(words: Column) -> Column:
        one = lambda w: F.transform(F.sequence(F.lit(2), F.char_length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
        return F.flatten(F.transform(F.filter(words, lambda w: F.char_length(w) > 1), one))

    whole = F.array(F.substring(term, 1, HEAD))
    first = F.array_distinct(shorter(whole))
    return F.array_distinct(F.concat(whole, first, shorter(first)))


def pieces_of_word(word: str, deletions: int) -> list[str]:
    """:func:`pieces_of` for a word of a request, with at most so many deletions."""
    head = word[:HEAD]
    return sorted({"".join(c for i, c in enumerate(head) if i not in gone) for n in range(deletions + 1) for gone in combinations(range(1, len(head)), n)})


def _fields() -> Column:
    """The indexed fields as an array of (weight, text)."""
    return F.array(*[F.struct(F.lit(w).alias("weight"), F.coalesce(F.array_join(f, " ") if f in LISTS else F.col(f), F.lit("")).alias("text")) for f, w in FIELDS.items()])


def tokenised(documents: DataFrame) -> DataFrame:
    """skill_id, fields (an array of weight and terms), n_tokens: each text is cut once."""
    fields = F.transform(_fields(), lambda f: F.struct(f["weight"].alias("weight"), X.document_tokens(f["text"]).alias("terms")))
    rows = documents.select("skill_id", fields.alias("fields"))
    return rows.withColumn("n_tokens", F.aggregate("fields", F.lit(0).cast("long"), lambda a, f: a + F.size(f["terms"])))


def counted(documents: DataFrame) -> DataFrame:
    """skill_id, n_tokens, items (an array of term, tf, wtf): a document's tokens stand in
    one row, so they are sorted and counted there; no task holds counts of many documents."""
    token = lambda f: F.transform(f["terms"], lambda t: F.struct(X.folded(t).alias("term"), f["weight"].alias("weight")))
    line = F.sort_array(F.flatten(F.transform("fields", token)))

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))

        def items(at: Column) -> Column:
            def item(p: Column, k: Column) -> Column:
                tf = F.coalesce(F.get(at, k + 1), n) - p
                weight = F.aggregate(F.slice(s, p + 1, tf), F.lit(0).cast("long"), lambda a, x: a + x["weight"])
                return F.struct(F.get(s, p)["term"].alias("term"), tf.cast("long").alias("tf"), weight.alias("wtf"))

            return F.transform(at, item)

        return F.when(n > 0, X.let(starts, items))

    return tokenised(documents).select("skill_id", "n_tokens", X.let(line, runs).alias("items"))


def inlined(rows: DataFrame) -> DataFrame:
    """term, skill_id, n_tokens, tf, wtf of :func:`counted` documents."""
    # the outer form, as the other one is preceded by a filter that cuts the texts once more
    return rows.select("skill_id", "n_tokens", F.inline_outer("items")).where("term is not null").select("term", "skill_id", "n_tokens", "tf", "wtf")


def postings(documents: DataFrame) -> DataFrame:
    """term, skill_id, n_tokens, tf, wtf, without a shuffle."""
    return inlined(counted(documents))


def settled(documents: DataFrame) -> tuple[DataFrame, int]:
    """:func:`postings` with the counts written first, as ranges take two passes over them,
    and how many there are."""
    rows = written(counted(documents).withColumn("n_items", F.coalesce(F.size("items"), F.lit(0))), "counted")
    return inlined(rows), rows.agg(F.sum("n_items")).first()[0] or 0


def vocabulary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def lengths(documents: DataFrame) -> DataFrame:
    """skill_id, n_tokens of every document, without a shuffle: sizes of its token lists."""
    return tokenised(documents).select("skill_id", "n_tokens")


def arranged(rows: DataFrame, n: int) -> DataFrame:
    """``n`` postings in ranges of term and document (so that a frequent term is no single
    task), sorted within files, so that filters on both skip files, row groups and pages.
    Where the session's partitions would hold more than ``PER_RANGE`` each, there are more."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = -(-n // PER_RANGE)
    dealt = rows.repartitionByRange(ranges, "term", "skill_id") if ranges > least else rows.repartitionByRange("term", "skill_id")
    return dealt.sortWithinPartitions("term", "skill_id")


def build_index(documents: DataFrame, persist: bool = True) -> Index:
    """The index of a corpus; written to the shared folder if ``persist``, with
    postings as :func:`arranged`."""
    rows = written(arranged(*settled(documents)), "postings") if persist else postings(documents)
    vocab = vocabulary(rows)
    if persist:
        vocab = written(vocab.repartitionByRange("term").sortWithinPartitions("term"), "vocab")
    n, total = documents.count(), rows.agg(F.sum("tf")).first()[0]
    return Index(rows, vocab, n, (total or 0) / n if n else 0.0)

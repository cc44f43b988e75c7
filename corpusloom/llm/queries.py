"""Queries that apply each operation, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontam, extract, langid, lines, manifest, packing, quality, rules, simhash, tokens, trie, urls
from corpusloom.llm.common import scratch, written
from corpusloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches over all
    documents: loaded with two tokenizers, one recounted, exact copies deleted; each
    batch is committed twice and counts once."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", "source", "lang", "text", F.xxhash64(text, F.octet_length(text)).alias("h"), tokens.word_count(text).alias("words"), tokens.letter_word_count(text).alias("letter_words"))
    counts = written(tokens.counted(rows, ("doc_id", "source", "lang", "h", "words", "letter_words")), "counts")
    # copies of one text, however many, become a row for each source and language before they meet
    alike = ("h", "source", "lang", "words", "letter_words", "n_tokens")
    groups = counts.groupBy(*alike, "doc_id").count().groupBy(*alike).agg(F.min("doc_id").alias("least"), F.min_by("count", "doc_id").alias("at_least"), F.sum("count").alias("n"))
    groups = written(groups, "copies")
    first = groups.groupBy("h").agg(F.min("least").alias("first"))
    copies = groups.join(first, "h").withColumn("times", F.col("n") - F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)).where("times > 0")
    bpe, none = tokens.version(), F.lit(None).cast("long")

    def delta(rows: DataFrame, op: str, version: str, new: str, old=none) -> DataFrame:
        times = "times" if "times" in rows.columns else F.lit(1).cast("long").alias("times")
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.col(new).alias("n_tokens"), old.alias("old_tokens"), times)

    batches = {
        "load words-1": delta(counts, "insert", "words-1", "words"),
        "load bpe": delta(counts, "insert", bpe, "n_tokens"),
        "recount words-1": delta(counts, "revise", "words-1", "letter_words", F.col("words")),
        "delete copies": delta(copies, "delete", "words-1", "letter_words").unionByName(delta(copies, "delete", bpe, "n_tokens")),
    }
    rollup = tokens.Rollup(spark, scratch(spark, "rollup"))
    for _ in range(2):
        for name, deltas in batches.items():
            rollup.commit(name, deltas)
    return rollup.totals()


#: Dated list entries: list, verdict, action, key, day.
ENTRIES = [
    ("gambling", "block", "add", "d:casino-win.example.com", "2024-01-15"),
    ("gambling", "block", "remove", "d:casino-win.example.com", "2024-06-01"),
    ("gambling", "block", "add", "d:casino-win.example.com", "2024-09-01"),
    ("gambling", "block", "add", "d:free-bets.example.com", "2024-03-01"),
    ("pharmacy", "block", "add", "d:cheap-pills.example.com", "2023-12-01"),
    ("pharmacy", "block", "remove", "d:cheap-pills.example.com", "2024-11-01"),
    ("tracking", "block", "add", "d:ads-track.example.com", "2024-02-10"),
    ("tracking", "allow", "add", "p:m.ads-track.example.com/en", "2024-05-01"),
    ("tracking", "allow", "remove", "p:m.ads-track.example.com/en", "2024-08-01"),
    ("partners", "block", "add", "d:example.net", "2024-07-01"),
    ("partners", "block", "remove", "d:example.net", "2024-07-15"),
    ("partners", "allow", "add", "d:tiontion.example.net", "2024-01-01"),
    ("partners", "block", "add", "p:blog.tionsh.example.com/fr", "2024-04-01"),
    # two lists on one key, of which one takes it back
    ("scams", "block", "add", "d:casino-win.example.com", "2024-03-01"),
    ("scams", "block", "remove", "d:casino-win.example.com", "2024-10-01"),
    ("scams", "block", "add", "d:example.org", "2024-02-01"),
    ("partners", "block", "add", "d:example.org", "2024-05-01"),
    ("scams", "block", "remove", "d:example.org", "2024-08-01"),
    ("partners", "allow", "add", "d:example.org", "2024-11-01"),
]


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day; the query takes 2024-01-01 plus page_id modulo 366 days."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched_at"))
    entries = spark.createDataFrame(ENTRIES, "list string, verdict string, action string, key string, at string").withColumn("at", F.col("at").cast("date"))
    return urls.evaluate(pages, entries, ("page_id", "url"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.report(table(spark, sf_dir, "pages"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def base_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rule of op8 alone, which SQL can express."""
    return rules.base(table(spark, sf_dir, "documents"), ["doc_id"]).drop("n_lines")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    found = (op1_chat_transcripts, op2_quality_ranking, op3_language_id, op4_token_rollup, op5_url_lists, op6_html_wrappers, op7_winnowing, op8_robust_outliers, op9_best_fit_packing, op10_simhash, op11_line_dedup, op12_merkle_manifest, op13_prefix_trie, base_statistics)
    return {f.__name__: f for f in found}


URL_SQL = f"""
WITH e(list, verdict, action, key, day) AS (VALUES {", ".join(str(x) for x in ENTRIES)}),
last AS (SELECT list, verdict, action, key, CAST(day AS DATE) AS since FROM e
         QUALIFY row_number() OVER (PARTITION BY list, verdict, key, day ORDER BY action DESC) = 1),
i AS (SELECT *, lead(since) OVER (PARTITION BY list, verdict, key ORDER BY since) AS until FROM last),
v AS (SELECT key, verdict, list, since, until FROM i WHERE action = 'add'),
u AS (SELECT row_number() OVER () AS row, page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS taken,
             regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?([^?#]*)', ['host', 'path']) AS x FROM pages),
p AS (SELECT row, page_id, url, taken, regexp_replace(lower(x.host), '\\.$', '') AS host, trim(x.path, '/') AS path FROM u),
m AS (SELECT row, key, verdict, list FROM p JOIN v ON since <= taken AND (until IS NULL OR taken < until) AND host <> '' AND
        CASE WHEN key LIKE 'd:%' THEN ends_with('.' || host, '.' || substr(key, 3))
             ELSE starts_with('p:' || host || '/' || path || '/', key || '/') END),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(key) DESC, key DESC, verdict, list DESC) = 1),
n AS (SELECT row, count(*) AS n FROM m GROUP BY row)
SELECT page_id, url, coalesce(verdict = 'block', false) AS blocked, coalesce(n, 0) AS n_active, key AS decided_by, list
FROM p LEFT JOIN d USING (row) LEFT JOIN n USING (row)
"""


BASE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
h AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
FROM t JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"base_statistics": BASE_SQL, "op5_url_lists": URL_SQL, "op7_winnowing": decontam.REPORT_SQL, "op11_line_dedup": lines.REPORT_SQL, "op12_merkle_manifest": manifest.REPORT_SQL, "op13_prefix_trie": trie.REPORT_SQL}

"""Rewrites of prompts, provider payloads and failed reads, as column expressions."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<skills>", "</skills>"
#: What stands for a catalogue that was taken out of a prompt.
GUIDANCE = "\n".join(
    [
        START,
        "- The catalogue is left out to keep the prompt small.",
        "- Look documents up by discover or search, resolve their exact names, then read skill://<name>.",
        "- An unknown name yields no catalogue: few near names or none.",
        END,
    ]
)


def rewrite_catalog(text: Column, guidance: str = GUIDANCE) -> Column:
    """Replaces the first ``<skills>`` ... ``</skills>`` block; null without both marks."""
    start = F.locate(START, text)
    after = F.substring(text, start + len(START), F.char_length(text))
    offset = F.locate(END, after)
    tail = F.substring(after, offset + len(END), F.char_length(text))
    found = F.concat(F.substring(text, F.lit(1), start - 1), F.lit(guidance), tail)
    return F.when((start > 0) & (offset > 0), found)


def rewrite_blocks(blocks: Column, guidance: str = GUIDANCE) -> Column:
    """A prompt of several blocks, joined by blank lines."""
    return rewrite_catalog(F.array_join(blocks, "\n\n"), guidance)


def rewrite_messages(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", guidance: str = GUIDANCE) -> DataFrame:
    """Messages with ``text`` rewritten in the first system or developer message of each
    conversation that has a catalogue; others as they are. Adds ``rewritten``."""
    new = rewrite_catalog(F.col(text), guidance)
    fit = F.col(role).isin("system", "developer") & new.isNotNull()
    # the first by an aggregate (partial sums before the shuffle), not by a window over the conversation
    first = messages.where(fit).groupBy(conversation).agg(F.min(turn).alias("__first"))
    rows = messages.join(first, conversation, "left")
    here = fit & (F.col(turn) == F.col("__first"))
    return rows.withColumn("rewritten", F.coalesce(here, F.lit(False))).withColumn(text, F.when(here, new).otherwise(F.col(text))).drop("__first")


def rewrite_text(text: str, guidance: str = GUIDANCE) -> str | None:
    """:func:`rewrite_catalog` for one text."""
    start = text.find(START)
    end = text.find(END, start + len(START)) if start >= 0 else -1
    return None if end < 0 else text[:start] + guidance + text[end + len(END) :]


def rewrite_payload(payload: Any, guidance: str = GUIDANCE) -> Any | None:
    """A provider's request with its first catalogue replaced: in ``instructions``, else
    in the first system or developer message; None if there is none."""

    def value(x: Any) -> tuple[Any, bool]:
        if isinstance(x, str):
            new = rewrite_text(x, guidance)
            return (x, False) if new is None else (new, True)
        if isinstance(x, list):
            for i, part in enumerate(x):
                new, changed = value(part)
                if changed:
                    return [*x[:i], new, *x[i + 1 :]], True
        elif isinstance(x, dict) and isinstance(x.get("text"), str):
            new = rewrite_text(x["text"], guidance)
            return (x, False) if new is None else ({**x, "text": new}, True)
        return x, False

    if not isinstance(payload, dict):
        return None
    if "instructions" in payload:
        new, changed = value(payload["instructions"])
        if changed:
            return {**payload, "instructions": new}
    messages = payload.get("messages")
    for i, m in enumerate(messages if isinstance(messages, list) else []):
        if isinstance(m, dict) and m.get("role") in ("system", "developer"):
            new, changed = value(m.get("content"))
            if changed:
                return {**payload, "messages": [*messages[:i], {**m, "content": new}, *messages[i + 1 :]]}
    return None


def compact_unknown_reads(results: DataFrame) -> DataFrame:
    """Failed reads (tool_name, is_error, path, text) of unknown names whose message
    lists all names: adds ``compacted``, a short text in place of it, else null."""
    fires = (F.col("tool_name") == "read") & F.col("is_error") & F.col("path").startswith("skill://") & F.col("text").startswith("Unknown skill:") & F.col("text").contains("\nAvailable:")
    raw = F.expr("substring(path, 9)")
    decoded = F.coalesce(F.expr("try_url_decode(replace(substring(path, 9), '+', '%2B'))"), raw)
    plain = F.regexp_replace(decoded, "[\\x00-\\x1F\\x7F-\\x9F]", "")
    # the longest beginning of at most 512 bytes: sizes of the characters, added up
    chars = F.split(plain, "")
    kept = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(True).alias("go")), lambda a, c: F.when(a["go"] & (F.octet_length(F.concat(a["t"], c)) <= 512), F.struct(F.concat(a["t"], c).alias("t"), F.lit(True).alias("go"))).otherwise(F.struct(a["t"].alias("t"), F.lit(False).alias("go"))))["t"]
    name = F.coalesce(F.nullif(F.when(F.octet_length(plain) <= 512, plain).otherwise(kept), F.lit("")), F.lit("(empty)"))
    lines = F.concat(F.lit("Unknown skill: "), name, F.lit("\nrecovery: use discover/search\nthen resolve exact canonical name\nthen read skill://<canonical-name>"))
    return results.withColumn("compacted", F.when(fires, lines))


def rewrite_payload_json(column: Column) -> Column:
    """:func:`rewrite_payload` over JSON texts (null where nothing changes or the text is no JSON)."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                new = rewrite_payload(json.loads(t)) if t else None
            except (ValueError, RecursionError):
                return None
            return None if new is None else json.dumps(new, ensure_ascii=False)

        return texts.map(one)

    return run(column)

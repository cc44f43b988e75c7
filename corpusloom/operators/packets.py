"""Packets: bodies within a budget, turns, recovery, and their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.corpus import Corpus
from corpusloom.operators.budget import sized_fold
from corpusloom.operators.search import effective_chars
from corpusloom.operators.tables import written

# The words of packets.
APPLY_HINT = "Increase budgetChars/budgetTokens or inspect omittedReadPaths before apply."
NO_TURN = "No active turn is available."


def pack(corpus: Corpus, entries: DataFrame, chars: int, tokens: int, include_body: bool = True) -> DataFrame:
    """Projected entries with their place and bodies within the budget: stronger reasons
    first, then read layer, depth, name."""
    d = corpus.documents.withColumnRenamed("canonical_name", "name")
    # written, so that few of them are broadcast and no body is shuffled to meet them
    entries = written(entries, "packed-entries")
    sized = entries.join(d.select("name", F.char_length(F.coalesce("body_text", F.lit(""))).alias("n")), "name")
    strength = F.when(F.col("reason") == "seed", -3).when(F.col("reason") == "required", -2).otherwise(-1)
    order = [strength, F.coalesce("read_layer", F.lit(2**31 - 1)), F.col("depth"), X.locale_order(F.col("name"))]
    fold = written(sized_fold(sized, order, F.col("n"), effective_chars(chars, tokens)), "fold")
    shown = d.select("name", "path", "title", "category", "scope", "aliases", "requires", "recommends", X.preview(F.col("body_text"), corpus.settings.preview_chars).alias("preview"))
    rows = entries.join(shown, "name").join(fold, "name", "left")
    bodies = d.select("name", F.col("body_text").alias("body")).join(fold.where("included").select("name"), "name", "left_semi")
    rows = rows.join(bodies, "name", "left") if include_body else rows.withColumn("body", F.lit(None).cast("string"))
    return rows.select("place", "name", "path", "title", "category", "scope", "aliases", "requires", "recommends", "reason", "via", "depth", "read_layer", "apply_layer", "preview", "body", X.read_path(F.col("name")).alias("read_path"), (F.lit(include_body) & F.coalesce(~F.col("included"), F.lit(False))).alias("omitted_by_budget"))


def brief(phases: DataFrame, packed: DataFrame) -> DataFrame:
    """Packed entries in the order of phases; names that aren't packed drop out."""
    rows = phases.select(F.col("order").alias("phase_order"), F.col("kind").alias("phase_kind"), "layer", F.posexplode("names").alias("pos", "name"))
    return rows.join(packed, "name").select("phase_order", "pos", "phase_kind", "layer", "name", "read_path", "path", "title", "category", "scope", "preview", "body", "omitted_by_budget")


@dataclass
class Bundle:
    """What packets are made of: phases, their entries, and the packet's header."""

    phases: DataFrame
    entries: DataFrame
    winner: str | None
    omitted: list[str]

    @property
    def ready(self) -> bool:
        return not self.omitted

    @property
    def guidance(self) -> list[str]:
        return [] if self.ready else [f"Read omitted paths first: {', '.join(self.omitted)}", APPLY_HINT]


def command(path: Column) -> Column:
    return F.concat(F.lit('read("'), path, F.lit('")'))


def handoff(b: Bundle) -> DataFrame:
    """One row: winner, ready, source_path, source_category, source_scope, next_command, apply_hint."""
    spark = b.entries.sparkSession
    head = spark.createDataFrame([(b.winner, b.ready)], "winner string, ready boolean")
    mine = b.entries.select(F.col("name").alias("winner"), F.col("path").alias("source_path"), F.col("category").alias("source_category"), F.col("scope").alias("source_scope"))
    return head.join(mine, "winner", "left").withColumn("next_command", command(F.col("source_path"))).withColumn("apply_hint", F.when(~F.col("ready"), APPLY_HINT))


def session_steps(b: Bundle) -> DataFrame:
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy("phase_order", "pos"))
    return b.entries.select(order.alias("order"), "name", F.col("path").alias("source_path"), F.col("scope").alias("source_scope"), F.col("category").alias("source_category"), command(F.col("path")).alias("next_command"), "phase_kind", "layer", "omitted_by_budget")


def _layer() -> Column:
    return F.coalesce(F.col("layer").cast("string"), F.lit("-"))


def turns(b: Bundle) -> DataFrame:
    """One row a phase: order, phase_kind, layer, names, read_paths, source_paths,
    next_commands, objective, checklist, exit_criteria, blocked_by_budget."""
    mine = b.entries.groupBy(F.col("phase_order").alias("order")).agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("e"), F.bool_or("omitted_by_budget").alias("blocked"))
    rows = b.phases.join(mine, "order", "left")
    paths = F.coalesce(F.transform("e", lambda x: x["path"]), F.array().cast("array<string>"))
    rows = rows.select("order", F.col("kind").alias("phase_kind"), "layer", "names", "read_paths", paths.alias("source_paths"), F.coalesce("blocked", F.lit(False)).alias("blocked_by_budget"))
    rows = rows.withColumn("next_commands", F.transform("source_paths", command))
    kind, first = F.col("phase_kind"), F.coalesce(F.get("names", F.lit(0)), F.lit("-"))
    objective = (
        F.when(kind == "start", F.concat(F.lit("Start with winner "), first))
        .when(kind == "read-layer", F.concat(F.lit("Read required layer "), _layer(), F.lit(" before dependent peers")))
        .when(kind == "apply-layer", F.concat(F.lit("Read apply layer "), _layer(), F.lit(" for optional extension")))
        .otherwise("Inspect remaining fallback steps")
    )
    blocked = F.col("blocked_by_budget")
    checklist = F.array(
        F.when(F.size("read_paths") > 0, F.concat(F.lit("Read packet entries: "), F.array_join("read_paths", ", "))),
        F.when(F.size("next_commands") > 0, F.concat(F.lit("Open source files: "), F.array_join("next_commands", " -> "))),
        F.when(blocked, "Resolve omitted skill bodies before applying this turn.").otherwise("No omitted skill body in this turn."),
    )
    number = F.col("order").cast("string")
    criteria = F.array(
        F.when(F.size("names") > 0, F.concat(F.lit("Reviewed skills: "), F.array_join("names", ", "))),
        F.when(blocked, F.concat(F.lit("Budget omissions cleared for turn "), number)).otherwise(F.concat(F.lit("Turn "), number, F.lit(" is ready without extra budget recovery"))),
    )
    return rows.withColumns({"objective": objective, "checklist": F.array_compact(checklist), "exit_criteria": F.array_compact(criteria)})


def blocked_turns(b: Bundle) -> DataFrame:
    """Phases with omitted bodies: order, phase_kind, layer, names, omitted_read_paths,
    source_paths, recovery_commands, objective, unblock_criteria."""
    out = b.entries.where("omitted_by_budget").groupBy(F.col("phase_order").alias("order")).agg(F.array_sort(F.collect_list(F.struct("pos", "path", "read_path"))).alias("e"))
    rows = b.phases.join(out, "order").select("order", F.col("kind").alias("phase_kind"), "layer", "names", F.transform("e", lambda x: x["read_path"]).alias("omitted_read_paths"), F.transform("e", lambda x: x["path"]).alias("source_paths"))
    rows = rows.withColumn("recovery_commands", F.transform("source_paths", command))
    kind = F.col("phase_kind")
    objective = (
        F.when(kind == "start", F.concat(F.lit("Recover winner "), F.coalesce(F.get("names", F.lit(0)), F.lit("-")), F.lit(" before continuing")))
        .when(kind == "read-layer", F.concat(F.lit("Recover required layer "), _layer(), F.lit(" before dependent peers")))
        .when(kind == "apply-layer", F.concat(F.lit("Recover optional apply layer "), _layer(), F.lit(" before extension work")))
        .otherwise("Recover fallback steps before resuming")
    )
    criteria = F.array(F.concat(F.lit("Read omitted skill bodies: "), F.array_join("omitted_read_paths", ", ")), F.when(F.size("recovery_commands") > 0, F.concat(F.lit("Open source files: "), F.array_join("recovery_commands", " -> "))))
    return rows.withColumns({"objective": objective, "unblock_criteria": F.array_compact(criteria)})


def remaining(b: Bundle) -> DataFrame:
    """Turns from the first blocked one on, or all."""
    start = blocked_turns(b).agg(F.min("order").alias("resume_order"))
    return turns(b).join(F.broadcast(start), F.col("order") >= F.coalesce("resume_order", F.lit(0))).drop("resume_order")


def current(b: Bundle) -> DataFrame:
    """Exactly one row: the header and the first remaining turn (its columns null if
    there is none), with ready and active_turn_order."""
    head = b.entries.sparkSession.createDataFrame([(b.winner, b.ready, b.guidance)], "winner string, packet_ready boolean, recovery_guidance array<string>")
    first = remaining(b).orderBy("order").limit(1)
    rows = head.join(F.broadcast(first), F.lit(True), "left")
    return rows.withColumn("ready", F.coalesce(~F.col("blocked_by_budget"), F.col("packet_ready"))).withColumn("active_turn_order", F.col("order"))


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _dashed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def _or_dash(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def texts(turn: DataFrame) -> DataFrame:
    """All texts of the current turn, one row: instruction, summary, markdown,
    checklist, commands, files, writes, script, execution, verification. Nothing is
    written or run; scripts are text."""
    none = F.array().cast("array<string>")
    there = F.col("order").isNotNull()
    t = turn.withColumns({"items": F.coalesce("checklist", none), "commands": F.coalesce("next_commands", none), "criteria": F.coalesce("exit_criteria", none)})
    t = t.withColumns({"checklist_text": _numbered(F.col("items")), "command_block": F.array_join("commands", "\n")})
    layer = F.coalesce(F.concat(F.lit(":"), F.col("layer").cast("string")), F.lit(""))
    number = F.col("order").cast("string")
    instruction = _lines(
        F.concat(F.lit("Focus on turn "), number, F.lit(" ("), F.col("phase_kind"), layer, F.lit(").")),
        F.concat(F.lit("Read skills: "), F.array_join("names", ", "), F.lit(".")),
        F.col("objective"),
        F.when(F.col("command_block") != "", F.concat(F.lit("Commands:\n"), F.col("command_block"))).otherwise("Commands: -"),
        F.when(F.col("checklist_text") != "", F.concat(F.lit("Checklist:\n"), F.col("checklist_text"))).otherwise("Checklist: -"),
    )
    who = F.coalesce("winner", F.lit("skill"))
    summary = F.concat(who, F.lit(" turn "), number, F.lit(": "), F.col("objective"), F.lit(". commands="), F.size("commands").cast("string"), F.lit(", checklist="), F.size("items").cast("string"))
    t = t.withColumns({"instruction_text": F.when(there, instruction).otherwise(NO_TURN), "summary_text": F.when(there, summary).otherwise(NO_TURN)})
    t = t.withColumn("checklist_lines", F.when(F.col("checklist_text") == "", none).otherwise(F.split("checklist_text", "\n")))
    title = F.concat(F.lit("# "), who, F.lit(" turn "), F.coalesce(number, F.lit("-")))
    markdown = _lines(title, "", "## Summary", F.col("instruction_text"), "", "## Commands", _or_dash(F.col("command_block")), "", "## Checklist", _or_dash(_dashed(F.col("checklist_lines"))), "", "## Recovery", _or_dash(_dashed(F.col("recovery_guidance"))))
    t = t.withColumns({"markdown": markdown, "base_name": F.concat(who, F.lit("-turn-"), F.coalesce(number, F.lit("current")))})
    place = lambda end: F.concat(F.lit("packets/"), F.col("base_name"), F.lit(end))
    file = lambda kind, end, media, content: F.struct(F.lit(kind).alias("kind"), place(end).alias("path"), F.lit(media).alias("mediaType"), content.alias("content"))
    files = F.array(
        file("markdown", ".md", "text/markdown", F.col("markdown")),
        file("checklist", ".checklist.md", "text/markdown", _or_dash(_dashed(F.col("items")))),
        file("commands", ".commands.txt", "text/plain", _or_dash(F.col("command_block"))),
    )
    t = t.withColumn("files", files)
    t = t.withColumn("writes", F.transform("files", lambda f: F.struct(F.lit("write").alias("kind"), f["kind"].alias("sourceKind"), f["path"].alias("path"), f["mediaType"].alias("mediaType"), f["content"].alias("content"))))
    t = t.withColumn("apply_text", _numbered(F.transform("writes", lambda w: F.concat(F.lit("write "), w["path"], F.lit(" ("), w["sourceKind"], F.lit(")")))))
    t = t.withColumn("script_path", place(".write.py"))
    script = _lines("import json", "from pathlib import Path", "", F.concat(F.lit("WRITES = json.loads("), F.to_json(F.array(F.to_json("writes"))), F.lit("[0])")), "", "for write in WRITES:", '    path = Path(write["path"])', "    path.parent.mkdir(parents=True, exist_ok=True)", '    path.write_text(write["content"])', '    print("wrote", path, "(" + write["sourceKind"] + ")")')
    t = t.withColumns({"script_content": script, "run_command": F.concat(F.lit("python "), F.col("script_path"))})
    t = t.withColumn("execution_text", _lines(F.concat(F.lit("1. Write script file: "), F.col("script_path")), F.concat(F.lit("2. Run command: "), F.col("run_command")), F.concat(F.lit("3. Expect "), F.size("writes").cast("string"), F.lit(" file write operations."))))
    t = t.withColumn("verification_items", F.when(F.size("criteria") > 0, F.col("criteria")).otherwise(F.array(F.lit("Run command completed without write errors."))))
    t = t.withColumn("verification_text", _lines("Run:", F.col("run_command"), "", "Verify:", _numbered(F.col("verification_items"))))
    return t

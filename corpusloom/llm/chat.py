"""Chat formatting: roles of transcript lines by a hidden Markov model.

A transcript is rows (conversation, turn, text) without roles; each line of a text
shows features: a speaker marker at its start (of a user, an assistant, a system,
of someone else, or none), whether it starts a row, its length, and whether it asks.
Hidden states are a role and whether the line begins a turn of it or goes on.
Transition and emission counts come from labelled conversations (all of them, as
sums); Viterbi decoding recovers the states, and turns are rendered in canonical
form with markers taken off.

Long conversations are not gathered: rows are range-sorted and cut into blocks of at
most ``block_rows`` rows and about ``block_bytes`` bytes (a longer row stands alone).
Where a conversation crosses blocks, each block is reduced to its
max-plus transfer matrix (best score from each state before it to each state at its
end); these are chained, and every block is decoded between the states found. The
result is that of Viterbi over the whole conversation.

Defined results: null and empty texts are one empty line; rows of a null
conversation are one conversation; rows that share a turn go by text; equal rows
are lines one after the other; unknown or null roles are not learned from; without
labelled rows all roles are equally likely except for markers (a fixed prior);
ties go to the state listed first; further columns are ignored, and those of ``keep``
may have any names but those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fold_of, plainly_named, written

ROLES = ("system", "user", "assistant")
#: States: (role, begins) in this order.
STATES = tuple((r, b) for r in ROLES for b in (True, False))
K = len(STATES)
# Names that mark a speaker.
SPEAKERS = {
    "system": "system instruction instructions context setup".split(),
    "user": "user human question q customer client prompter me you".split(),
    "assistant": "assistant ai bot answer a model agent gpt response".split(),
}
_BY_NAME = {n: ROLES.index(r) + 1 for r, names in SPEAKERS.items() for n in names}
MARKER = re.compile(r"^\s*(?:#{1,6}\s*|\*\*|<\|?|\[|-\s*)?([A-Za-z][A-Za-z _.-]{0,20}?)(?:(?:\*\*|\|?>|\])\s*:?|\s*:\s*(?:\*\*)?)(?=\s|$)\s*")
#: Features of a line and how many values each has.
SIZES = (5, 2, 4, 2)
FORM = ("<|im_start|>{role}\n", "<|im_end|>\n")


def features(line: str, starts_row: bool) -> tuple[tuple[int, int, int, int], str]:
    """Feature values of a line, and the line without its speaker marker."""
    m = MARKER.match(line)
    marker, rest = 0, line
    if m:
        marker = _BY_NAME.get(m[1].strip().lower(), 4)
        rest = line[m.end() :] if marker != 4 else line
    n = len(line)
    return (marker, int(starts_row), 0 if not line.strip() else 1 if n <= 40 else 2 if n <= 160 else 3, int(rest.rstrip().endswith("?"))), rest


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    show: tuple[np.ndarray, ...]

    def emissions(self, found: list[tuple[int, int, int, int]]) -> np.ndarray:
        values = np.array(found, np.int64).reshape(-1, len(SIZES))
        return sum((self.show[f][:, values[:, f]].T for f in range(len(SIZES))), np.zeros((len(values), K)))


def _prior() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    start, move = np.full(K, 1e-3), np.zeros((K, K))
    show = [np.full((K, n), 1.0) for n in SIZES]
    for i, (_, begins) in enumerate(STATES):
        start[i] = 1.0 if begins else 1e-3
        show[0][i] = [2, 1, 1, 1, 1] if begins else [20, 0.02, 0.02, 0.02, 0.5]
        if begins:
            show[0][i][1 + i // 2] = 10
        for j, (_, again) in enumerate(STATES):
            move[i, j] = 1.0 if again or i // 2 == j // 2 else 1e-6
    return start, move, show


def model_of(starts: dict[int, int], moves: dict[tuple[int, int], int], shows: dict[tuple[int, int, int], int]) -> Model:
    """The model of counts, smoothed by the fixed prior."""
    start, move, show = _prior()
    for i, n in starts.items():
        start[i] += n
    for (i, j), n in moves.items():
        move[i, j] += n
    for (f, i, v), n in shows.items():
        show[f][i, v] += n
    return Model(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)), tuple(np.log(s / s.sum(axis=1, keepdims=True)) for s in show))


def train(labelled: DataFrame) -> Model:
    """Counts over all rows (conv_id, turn, role, text) with a known role."""
    known = labelled.where(F.col("role").isin(*ROLES))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out: dict[tuple[int, int, int], int] = {}
            for role, text in zip(rows["role"], rows["text"], strict=True):
                for k, line in enumerate(lines_of(text)):
                    state = 2 * ROLES.index(role) + (k > 0)
                    for f, v in enumerate(features(line, k == 0)[0]):
                        out[f, state, v] = out.get((f, state, v), 0) + 1
                    if k:
                        key = (-1, state if k > 1 else state - 1, state)
                        out[key] = out.get(key, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["f", "i", "v", "n"])

    counts = known.select("role", "text").mapInPandas(count, "f int, i int, v int, n long").groupBy("f", "i", "v").agg(F.sum("n").alias("n"))
    shows, moves = {}, {}
    for r in counts.collect():
        (shows if r["f"] >= 0 else moves)[(r["f"], r["i"], r["v"]) if r["f"] >= 0 else (r["i"], r["v"])] = r["n"]
    # from one turn to the next: one row a turn, joined with the turn before
    begin = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) * 2 - 2
    turns = known.groupBy("conv_id", "turn").agg(F.min(F.struct(begin.alias("b"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))).alias("x"))
    last = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), (F.col("x.b") + (F.col("x.lines") > 1).cast("int")).alias("i"))
    first = turns.select("conv_id", "turn", F.col("x.b").alias("j"))
    for r in first.join(last, ["conv_id", "turn"]).groupBy("i", "j").count().collect():
        moves[r["i"], r["j"]] = moves.get((r["i"], r["j"]), 0) + r["count"]
    starts = {r["j"]: r["n"] for r in first.where("turn = 0").groupBy("j").agg(F.count("*").alias("n")).collect()}
    return model_of(starts, moves, shows)


def transfer(model: Model, shown: np.ndarray, first: bool) -> np.ndarray:
    """Best scores from each state before the lines (for the first lines of a
    conversation: from nowhere, all rows alike) to each state at their end."""
    best = np.tile(model.start + shown[0], (K, 1)) if first else model.move + shown[0]
    for row in shown[1:]:
        best = (best[:, :, None] + model.move[None]).max(axis=1) + row
    return best


def viterbi(model: Model, shown: np.ndarray, before: int | None = None, end: int | None = None) -> np.ndarray:
    """The best states of the lines, given the state before them and at their end."""
    n = len(shown)
    best = (model.start if before is None else model.move[before]) + shown[0]
    back = np.zeros((n, K), np.int64)
    for t in range(1, n):
        step = best[:, None] + model.move
        back[t] = step.argmax(axis=0)
        best = step[back[t], np.arange(K)] + shown[t]
    out = np.zeros(n, np.int64)
    out[-1] = best.argmax() if end is None else end
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _runs(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """Conversations of a block in order; __key is never null."""
    keys = rows["__key"].to_numpy()
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield keys[a], rows.iloc[a:b]


def _observed(rows: pd.DataFrame) -> tuple[list[tuple[int, int, int, int]], list[str], list[int]]:
    found, rests, of = [], [], []
    for i, text in enumerate(rows["text"]):
        for k, line in enumerate(lines_of(text)):
            f, rest = features(line, k == 0)
            found.append(f)
            rests.append(rest)
            of.append(i)
    return found, rests, of


def parse(transcripts: DataFrame, model: Model, keep: tuple[str, ...] = (), block_rows: int = 2000, block_bytes: int = 4 << 20) -> DataFrame:
    """Turns of ``transcripts`` (conv_id, turn, text and ``keep``), one row for each
    stretch of a row's lines with one turn: conv_id, turn, ``keep``, part, role,
    opens, closes (whether the turn begins and ends with the stretch), text and
    rendered (canonical form; concatenated in order it is the whole conversation)."""
    spark = transcripts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    plain, named = plainly_named(transcripts)
    transcripts = plain.select(*[F.col(named[c]).alias(c) for c in ("conv_id", "turn", "text")], *[F.col(named[c]).alias(f"k{i}") for i, c in enumerate(keep)])
    given, keep = keep, tuple(f"k{i}" for i in range(len(keep)))
    kinds = {c: transcripts.schema[c].dataType.simpleString() for c in ("conv_id", "turn", *keep)}
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    rows = transcripts.select("conv_id", "turn", *keep, F.coalesce("text", F.lit("")).alias("text"), key.alias("__key"), F.monotonically_increasing_id().alias("__id"))
    order = ["__key", "turn", "text", "__id"]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["conv_id", "turn", *keep, "text", "__key", "__id"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = start = TaskContext.get().partitionId() << 40
        held = size = 0
        for rows in batches:
            of = np.empty(len(rows), np.int64)
            for i, text in enumerate(rows["text"]):
                more = len(text.encode("utf-8", "replace"))
                if held and (held == block_rows or size + more > block_bytes):
                    block, held, size = block + 1, 0, 0
                held, size, of[i] = held + 1, size + more, block
            rows["__at"], rows["__block"] = np.arange(start, start + len(rows)), of
            start += len(rows)
            yield rows

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "text string, __key string, __id long, __at long, __block long"])
    placed = rows.select(*names).repartitionByRange(width, *order).sortWithinPartitions(*order).mapInPandas(blocks, schema)
    placed = written(placed, "ordered")

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        """Transfer matrices of the first and last conversation of a block: once as of
        a conversation's start, once as of a state before."""
        rows = rows.sort_values("__at", ignore_index=True)
        runs = list(_runs(rows))
        out = []
        for name, part in {0: runs[0], len(runs) - 1: runs[-1]}.values():
            shown = shared.value.emissions(_observed(part)[0])
            out.append((name, int(rows["__block"].iloc[0]), transfer(shared.value, shown, True).ravel().tolist(), transfer(shared.value, shown, False).ravel().tolist()))
        return pd.DataFrame(out, columns=["__key", "__block", "first", "later"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        """States before and at the end of each block of a conversation."""
        rows = rows.sort_values("__block", ignore_index=True)
        if len(rows) == 1:
            return pd.DataFrame(columns=["__key", "__block", "before", "end", "after"])
        steps = [np.array(rows["first" if i == 0 else "later"].iloc[i]).reshape(K, K) for i in range(len(rows))]
        best, backs = steps[0][0], []
        for step in steps[1:]:
            scores = best[:, None] + step
            backs.append(scores.argmax(axis=0))
            best = scores.max(axis=0)
        ends = [int(best.argmax())]
        for back in reversed(backs):
            ends.append(int(back[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"__key": rows["__key"], "__block": rows["__block"], "before": [-1, *ends[:-1]], "end": ends, "after": [0] * (len(ends) - 1) + [-1]})

    def decode(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at", ignore_index=True)
        known = {r["__key"]: r for r in held.to_dict("records")}
        out = []
        for name, part in _runs(rows):
            found, rests, of = _observed(part)
            edge = known.get(name)
            states = viterbi(shared.value, shared.value.emissions(found), None if edge is None or edge["before"] < 0 else int(edge["before"]), None if edge is None else int(edge["end"]))
            begins = [s % 2 == 0 for s in states]
            # what follows the last line: nothing, or a line of the next block
            follows = True if edge is None or edge["after"] < 0 else bool(edge["next_begins"])
            kept = part[["conv_id", "turn", *keep]].to_numpy(dtype=object)
            at, number = 0, {}
            while at < len(of):
                to = at + 1
                while to < len(of) and of[to] == of[at] and not begins[to]:
                    to += 1
                closes = begins[to] if to < len(of) else follows
                role, text = STATES[states[at]][0], "\n".join(rests[at:to])
                number[of[at]] = number.get(of[at], -1) + 1
                shown = (FORM[0].format(role=role) if begins[at] else "\n") + text + (FORM[1] if closes else "")
                out.append((*kept[of[at]], number[of[at]], role, bool(begins[at]), bool(closes), text, shown))
                at = to
        return pd.DataFrame(out, columns=["conv_id", "turn", *keep, "part", "role", "opens", "closes", "text", "rendered"])

    matrices = placed.groupBy("__block").applyInPandas(edges, "__key string, __block long, first array<double>, later array<double>").distinct()
    bounds = written(matrices.groupBy("__key").applyInPandas(chain, "__key string, __block long, before int, end int, after int"), "bounds")
    # whether the block after goes on with a begun turn is known once it is decoded from its first line
    bounds = _with_next(placed, bounds, shared)
    result = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "part int, role string, opens boolean, closes boolean, text string, rendered string"])
    found = placed.groupBy("__block").cogroup(bounds.groupBy("__block")).applyInPandas(decode, result)
    return found.select("conv_id", "turn", *[F.col(k).alias(c) for k, c in zip(keep, given, strict=True)], "part", "role", "opens", "closes", "text", "rendered")


def _with_next(placed: DataFrame, bounds: DataFrame, shared) -> DataFrame:
    """Adds next_begins: whether the first line of a conversation's next block begins a turn."""

    def firsts(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            known = {r["__key"]: r for r in held.to_dict("records")}
            for name, part in _runs(rows.sort_values("__at", ignore_index=True)):
                if (edge := known.get(name)) and edge["before"] >= 0:
                    states = viterbi(shared.value, shared.value.emissions(_observed(part)[0]), int(edge["before"]), int(edge["end"]))
                    out.append((name, int(edge["__block"]), bool(states[0] % 2 == 0)))
        return pd.DataFrame(out, columns=["__key", "__block", "begins"])

    crossing = placed.join(bounds.select("__block").distinct(), "__block", "left_semi")
    starts = crossing.groupBy("__block").cogroup(bounds.groupBy("__block")).applyInPandas(firsts, "__key string, __block long, begins boolean")
    # the next block of the same conversation, by rank among its blocks (few rows)
    from pyspark.sql import Window

    order = Window.partitionBy("__key").orderBy("__block")
    following = bounds.withColumn("next", F.lead("__block").over(order)).join(starts.select(F.col("__key").alias("k"), F.col("__block").alias("b"), "begins"), (F.col("k") == F.col("__key")) & (F.col("b") == F.col("next")), "left")
    return written(following.select("__key", "__block", "before", "end", "after", F.coalesce("begins", F.lit(True)).alias("next_begins")), "crossings")


#: Speaker markers in which :func:`transcripts_of` writes a turn; an empty one writes none.
STYLES = {
    "system": ("System: ", "### System:\n", "<|system|> ", ""),
    "user": ("User: ", "Human: ", "### User:\n", "**Q:** ", "", ""),
    "assistant": ("Assistant: ", "AI: ", "### Assistant:\n", "**A:** ", "", ""),
}


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of a table of turns: each turn opens with a marker in one of
    several styles, chosen by hash, or with none; the role column is for comparison."""
    pick = F.xxhash64("conv_id", "turn")
    marker = F.lit("")
    for role, styles in STYLES.items():
        chosen = F.get(F.array(*[F.lit(s) for s in styles]), F.pmod(pick, F.lit(len(styles))).cast("int"))
        marker = F.when(F.col("role") == role, chosen).otherwise(marker)
    return conversations.select("conv_id", "turn", "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def report(conversations: DataFrame) -> DataFrame:
    """Recovered turns of all conversations written as raw transcripts; learned from
    those whose crc32(conv_id) mod 4 is not 2. role_given is the table's own role."""
    raw = transcripts_of(conversations)
    model = train(raw.where(fold_of("conv_id", 4) != 2))
    found = parse(raw.withColumnRenamed("role", "role_given"), model, keep=("role_given",))
    return found.withColumn("held_out", fold_of("conv_id", 4) == 2)

"""Transcript parsing: a hidden Markov model over line features recovers who speaks; turns are then rendered alike.

A line of a transcript opens a turn or continues one, and a role speaks it: these pairs are the states. What is seen
of a line is one code made of its speaker marker and its form. Probabilities are counted on labelled transcripts. The
most likely states are found by Viterbi in blocks of lines: a block's best path scores between any two states form
a small matrix, the matrices are combined along a transcript, and each block is then decoded between its fixed ends. The
result is that of one pass over the whole transcript, and no transcript has to fit in a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Scratch, running_sums

# Words that name a speaker, by the kind of role they stand for.
SPEAKERS = [
    ("system", ["system", "instruction", "instructions", "context"]),
    ("user", ["user", "human", "customer", "question", "prompt", "q", "me"]),
    ("assistant", ["assistant", "ai", "bot", "answer", "agent", "model", "a"]),
]
#: A marker stands at the start of a line: a name in brackets or after ``#`` or ``*``, or before a colon.
MARKER = (r"^[ \t]*(?:<\|?|\[|#{1,4}[ \t]*|\*{1,2})?(" + "|".join(sorted((w for _, ws in SPEAKERS for w in ws), key=len, reverse=True))
          + r")(?:\|?>|\]|\*{0,2}[ \t]*:\*{0,2}|[ \t]*$)[ \t]*")
CODES = 4 * 2 * 3 * 2 * 2
MOST_ROLES = 64


@dataclass(frozen=True)
class Model:
    """States are ``2 * role`` for a line that opens a turn and ``2 * role + 1`` for one that continues it."""

    roles: tuple[str, ...]
    start: np.ndarray
    move: np.ndarray
    seen: np.ndarray


def split_lines(turns: DataFrame, scratch: Scratch, name: str, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(conv, idx, first, line) and the other columns named ``x_``: lines of each transcript, counted from 0."""
    extra = [c for c in turns.columns if c.startswith("x_")]
    rows = turns.select(F.col(id_col).cast("string").alias("conv"), F.col(order_col).cast("long").alias("pos"),
                        F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), "\n", -1).alias("lines"), *extra)
    rows = rows.withColumns({"n": F.size("lines").cast("long"), "tie": F.xxhash64("lines")})
    placed = running_sums(rows, scratch, name, ["conv"], ["pos", "tie"], before="n")
    return placed.select("conv", "before", *extra, F.posexplode("lines").alias("j", "line")).select(
        "conv", (F.col("before") + F.col("j")).alias("idx"), (F.col("j") == 0).alias("first"), "line", *extra)


def marker_of(line: Column) -> Column:
    """0 without a speaker marker, else 1 system, 2 user, 3 assistant."""
    word = F.lower(F.regexp_extract(line, f"(?i){MARKER}", 1))
    out = F.lit(0)
    for i, (_, words) in enumerate(SPEAKERS):
        out = F.when(word.isin(words), F.lit(i + 1)).otherwise(out)
    return out


def line_code(line: Column, before: Column) -> Column:
    """One number for what is seen of a line: marker, question, length, mark-up, and whether the line before is blank."""
    size = F.length(line)
    parts = [(marker_of(line), 4), (F.rtrim(line).endswith("?").cast("int"), 2),
             (F.when(size == 0, 0).when(size < 80, 1).otherwise(2), 3),
             (line.rlike(r"^[ \t]*(```|[-*] |[0-9]+[.)] |\{|#include|def )").cast("int"), 2),
             (F.coalesce(F.length(before) == 0, F.lit(True)).cast("int"), 2)]
    code = F.lit(0)
    for value, base in parts:
        code = code * base + value
    return code.cast("int")


def coded(lines: DataFrame) -> DataFrame:
    """Lines with their block and code. A block looks back over its first line by the line before it."""
    rows = lines.withColumn("block", F.floor(F.col("idx") / BLOCK))
    # the last line of a block is also sent to the next one, so windows stay within a block
    carried = rows.filter(F.col("idx") % BLOCK == BLOCK - 1).select(
        *[(F.col("block") + 1).alias("block") if c == "block" else F.col(c) for c in rows.columns]).withColumn("carried", F.lit(True))
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried)
    at = Window.partitionBy("conv", "block").orderBy("idx")
    return (both.withColumn("before", F.lag("line").over(at)).filter(~F.col("carried")).drop("carried")
            .withColumn("code", line_code(F.col("line"), F.col("before"))).drop("before"))


BLOCK = 1024


def fit(labelled: DataFrame, roles: list[str] | None = None) -> Model:
    """Count starts, moves and codes over coded lines with ``x_role`` and ``first``.

    (conv, block, idx, code, first, x_role); all counts are made in Spark, and tables of states and codes come back.
    Counts start from a small prior, so nothing is impossible; without labelled lines the model is uniform.
    """
    known = labelled.filter(F.col("x_role").isNotNull())
    roles = roles or [r["x_role"] for r in known.select("x_role").distinct().orderBy("x_role").limit(MOST_ROLES + 1).collect()]
    if len(roles) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} roles")
    roles = roles or ["user"]
    number = F.lit(None).cast("int")
    for i, role in enumerate(roles):
        number = F.when(F.col("x_role") == role, F.lit(2 * i)).otherwise(number)
    state = number + F.when(F.col("first"), 0).otherwise(1)
    rows = known.withColumn("state", state)
    n = 2 * len(roles)
    start, move, seen = np.full(n, 0.1), np.full((n, n), 0.1), np.full((n, CODES), 0.1)
    for r in rows.filter("idx = 0").groupBy("state").count().collect():
        start[r["state"]] += r["count"]
    at = Window.partitionBy("conv", "block").orderBy("idx")  # moves across the ends of blocks are a small share
    for r in rows.withColumn("was", F.lag("state").over(at)).filter("was IS NOT NULL").groupBy("was", "state").count().collect():
        move[r["was"], r["state"]] += r["count"]
    for r in rows.groupBy("state", "code").count().collect():
        seen[r["state"], r["code"]] += r["count"]
    start[1::2] = 1e-9  # a transcript begins with a turn
    for role in range(len(roles)):
        for other in range(len(roles)):
            if role != other:
                move[2 * role:2 * role + 2, 2 * other + 1] = 1e-9  # a turn is continued by its own role
    return Model(tuple(roles), np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(seen / seen.sum(1, keepdims=True)))


def block_matrix(codes: np.ndarray, model: Model) -> np.ndarray:
    """Best path score from state a on the block's first line to state b on its last, both lines' codes included."""
    n = len(model.start)
    best = np.full((n, n), -np.inf)
    np.fill_diagonal(best, model.seen[:, codes[0]])
    for c in codes[1:]:
        best = (best[:, :, None] + model.move[None]).max(axis=1) + model.seen[:, c][None]
    return best


def block_ends(matrices: list[np.ndarray], model: Model) -> list[tuple[int, int]]:
    """The best (first, last) states of each block of one transcript."""
    scores, back = [], []
    entry = model.start
    for m in matrices:
        total = entry[:, None] + m
        back.append(total.argmax(axis=0))
        last = total.max(axis=0)
        scores.append(last)
        entry = (last[:, None] + model.move).max(axis=0)
    ends, state = [], int(scores[-1].argmax())
    for i in range(len(matrices) - 1, -1, -1):
        first = int(back[i][state])
        ends.append((first, state))
        if i:
            state = int((scores[i - 1] + model.move[:, first]).argmax())
    return ends[::-1]


def block_path(codes: np.ndarray, first: int, last: int, model: Model) -> np.ndarray:
    """The best states of a block's lines between its fixed ends."""
    score = np.full(len(model.start), -np.inf)
    score[first] = model.seen[first, codes[0]]
    back = []
    for c in codes[1:]:
        total = score[:, None] + model.move
        back.append(total.argmax(axis=0))
        score = total.max(axis=0) + model.seen[:, c]
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1], np.int32)


def decode(lines: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """(conv, idx, state) of coded lines. Only codes, matrices and states are grouped, never texts.

    A transcript's matrices, one per ``BLOCK`` lines, are combined in one task.
    """
    shared = lines.sparkSession.sparkContext.broadcast(model)
    blocks = (lines.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("idx", "code"))).alias("x"))
              .select("conv", "block", F.col("x")[0]["idx"].alias("at"), F.transform("x", lambda v: v["code"]).alias("codes")))

    @F.pandas_udf("array<double>")
    def matrices(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: block_matrix(np.asarray(c), shared.value).ravel())

    @F.pandas_udf("array<struct<block:long,first:int,last:int>>")
    def ends(blocks: pd.Series) -> pd.Series:
        def one(rows) -> list[dict]:
            rows = sorted(rows, key=lambda r: r["block"])
            n = len(shared.value.start)
            found = block_ends([np.asarray(r["m"]).reshape(n, n) for r in rows], shared.value)
            return [{"block": r["block"], "first": a, "last": b} for r, (a, b) in zip(rows, found)]
        return blocks.map(one)

    @F.pandas_udf("array<int>")
    def paths(codes: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([block_path(np.asarray(c), int(a), int(b), shared.value) for c, a, b in zip(codes, first, last)])

    blocks = scratch.write(blocks.withColumn("m", matrices("codes")), "blocks")
    fixed = (blocks.groupBy("conv").agg(F.collect_list(F.struct("block", "m")).alias("x")).select("conv", F.explode(ends("x")).alias("e"))
             .select(F.col("conv").alias("_conv"), "e.block", "e.first", "e.last"))
    joined = blocks.join(fixed.withColumnRenamed("block", "_block"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
    return joined.select("conv", "at", F.posexplode(paths("codes", "first", "last")).alias("j", "state")).select(
        "conv", (F.col("at") + F.col("j")).alias("idx"), "state")


def render(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def parse_transcripts(lines: DataFrame, model: Model, scratch: Scratch | None = None) -> DataFrame:
    """(conv, turn, role, text, rendered) from lines (conv, idx, line): one row per recovered turn.

    ``idx`` counts the lines of a transcript from 0. A turn's text is its lines without the speaker marker and without
    blank lines at its ends. Transcripts keep any length; a null transcript id is a transcript of its own, and an empty one is one
    turn without text. Lines that are alike in all columns still are lines. An empty table gives no rows.
    """
    scratch = scratch or Scratch(lines.sparkSession)
    rows = scratch.write(coded(lines.select("conv", "idx", "line")), "lines")
    states = decode(rows.select("conv", "block", "idx", "code"), model, scratch).withColumnRenamed("conv", "_conv").withColumnRenamed("idx", "_idx")
    names = F.array(*[F.lit(r) for r in model.roles])
    found = (rows.join(states, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("idx") == F.col("_idx")))
             .select("conv", "idx", "line", (F.col("state") % 2 == 0).cast("long").alias("opens"),
                     F.element_at(names, (F.floor(F.col("state") / 2) + 1).cast("int")).alias("role")))
    numbered = running_sums(found, scratch, "states", ["conv"], ["idx"], opened="opens").withColumn("turn", F.col("opened") + F.col("opens") - 1)
    spoken = F.when(F.col("opens") == 1, F.regexp_replace("line", f"(?i){MARKER}", "")).otherwise(F.col("line"))
    turns = (numbered.select("conv", "turn", "role", F.struct("idx", spoken.alias("s")).alias("x")).groupBy("conv", "turn", "role")
             .agg(F.array_sort(F.collect_list("x")).alias("x"))
             .withColumn("text", F.regexp_replace(F.array_join(F.transform("x", lambda v: v["s"]), "\n"), r"^\s+|\s+$", "")))
    return turns.select("conv", "turn", "role", "text", render(F.col("role"), F.col("text")).alias("rendered"))


# ------------------------------------------------------------------ transcripts made of labelled turns

# Ways in which plain transcripts name the speaker of a line.
STYLES = [
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Instruction: ", "user": "Human: ", "assistant": "AI: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[assistant] "},
    {"system": "### System\n", "user": "### Question\n", "assistant": "### Answer\n"},
]


def plain_transcripts(turns: DataFrame, unmarked: int = 8, id_col: str = "conv_id", order_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, text, x_role): each turn as a plain transcript has it, with a marker in the style of its transcript.

    One turn in ``unmarked``, by hash, has no marker. The role is kept for fitting and for measuring only.
    """
    style = F.pmod(F.xxhash64(F.col(id_col)), F.lit(len(STYLES)))
    mark = F.lit("")
    for i, names in enumerate(STYLES):
        for role, text in names.items():
            mark = F.when((style == i) & (F.col(role_col) == role), F.lit(text)).otherwise(mark)
    bare = F.pmod(F.xxhash64(F.col(id_col), F.col(order_col), F.lit(1)), F.lit(unmarked)) == 0
    return turns.select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("turn"),
                        F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce(F.col(text_col), F.lit(""))).alias("text"),
                        F.col(role_col).cast("string").alias("x_role"))


def learnable(conv: Column) -> Column:
    """Transcripts to fit on; the others measure."""
    return F.coalesce(F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def recover_roles(conversations: DataFrame, unmarked: int = 8) -> DataFrame:
    """Turn labelled conversations into plain transcripts, fit on three quarters of them, and parse them all."""
    scratch = Scratch(conversations.sparkSession)
    plain = plain_transcripts(conversations, unmarked)
    lines = scratch.write(split_lines(plain, scratch, "turns", "conv_id", "turn", "text"), "split")
    model = fit(coded(lines.filter(learnable(F.col("conv")))))
    return parse_transcripts(lines, model, scratch)

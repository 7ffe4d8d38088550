"""Reply trees as chat transcripts: self-joins enumerate the paths from roots to leaves, branches are ranked
by score, and each chosen path becomes one conversation with a loss mask.

Paths: every message points to its parent; joining the pointers with themselves doubles their reach, so a
tree of depth d takes log2(d) joins. The same pointers then give each chosen leaf its ancestors, in as
many joins. Only messages of chosen paths are repeated.

A turn is `<|im_start|>`, role, line end, text, `<|im_end|>`, line end. In texts and roles a backslash goes
between `<` (and the backslashes after it) and `|`, so no text can hold a control string, and taking one
backslash away restores it. In roles, line ends and backslashes are escaped as well.

Defined results: null roles and texts are empty; a message whose parent is null or not in its conversation
is a root; messages on or below a cycle of parents reach no root and are on no path; message ids are
unique within a conversation (threaded() makes them so for rows in turn order: ties by role and text, null
turns first, equal rows each a turn); a null conversation id is a conversation of its own; branches of
equal score rank by leaf id; a conversation without assistant turns has an empty loss mask; an empty table
gives no conversations; only the named columns are read. One conversation is one row, so its texts
meet in one task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import join_hot, join_sized, limit_batches, written

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Shares that a conversation's leaves are ranked in first; numbers that a message's key takes the room of.
_SALTS, _KEY_WIDTH = 64, 4

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The transcript of (role, text) turns, and where in it (in code points) assistant texts start and end."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        at += len(head)
        if role == ASSISTANT:
            starts.append(at)
            ends.append(at + len(body))
        out += [head, body, f"{END}\n"]
        at += len(body) + len(END) + 1
    return "".join(out), starts, ends


def parse(transcript: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a transcript."""
    out, at = [], 0
    for m in _TURN.finditer(transcript):
        if m.start() != at:
            raise ValueError(f"no turn begins at character {at}")
        out.append((_unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(transcript):
        raise ValueError(f"no turn begins at character {at}")
    return out


def threaded(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, msg, parent, score, role, text) of rows that follow each other: each replies to the one before."""
    own = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    msg = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("long")
    numbered = own.select("conv", msg.alias("msg"), "role", "text")
    return numbered.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _node(conv: str, msg: str) -> F.Column:
    """A key of a message; null conversations differ from all others."""
    return F.when(F.col(msg).isNotNull(), F.concat(F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")), F.lit("/"), F.col(msg).cast("string")))


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(path, conv, path_score, at, node) for the messages (conv, msg, parent, score): a row for each message of each
    chosen path. path is the leaf's key, at the place on the path from 0, path_score the mean score of its messages.
    branches: how many paths of a conversation are chosen, the best first; None: all."""
    up = messages.select("conv", _node("conv", "msg").alias("node"), _node("conv", "parent").alias("up"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    nodes = up.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    total = messages.count()
    wide = _KEY_WIDTH * total
    up = join_sized(up.where("up is not null"), nodes, "up", total, wide, "left").select("conv", "node", F.when(F.col("there"), F.col("up")).alias("up"), "score").unionByName(up.where("up is null"))
    # How far each pointer reaches, and the score of the messages it passes (its own included).
    reach = written(up.select("conv", "node", "up", F.lit(1).cast("long").alias("far"), "score"), "reach")
    levels = []
    for _ in range(total.bit_length() + 1):
        levels.append(reach)
        if not reach.where("up is not null").limit(1).count():
            break
        ahead = reach.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("score").alias("add"))
        moving = join_sized(reach.where("up is not null"), ahead, "up", total, wide)
        moved = moving.select("conv", "node", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("score") + F.col("add")).alias("score"))
        reach = written(moved.unionByName(reach.where("up is null")), "reach")
    ends = levels[-1].where("up is null")  # what is left beyond that is on or below a cycle
    leaves = ends.join(up.where("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    leaves = leaves.select("conv", F.col("node").alias("path"), (F.col("score") / F.col("far")).alias("path_score"), (F.col("far") - 1).alias("at"))
    if branches is not None:  # the best of each share of a conversation's leaves, then the best of these
        order = [F.desc("path_score"), "path"]
        share = F.pmod(F.xxhash64("path"), F.lit(_SALTS))
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv", share).orderBy(*order))).where(F.col("rank") <= branches)
        leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).where(F.col("rank") <= branches).drop("rank")
    found = written(leaves.select("path", "conv", "path_score", "at", F.col("path").alias("node")), "paths")
    for k, level in enumerate(levels):
        steps = level.where((F.col("up").isNotNull()) & (F.col("far") == 1 << k)).select("node", F.col("up"))
        far = join_sized(found, steps, "node", total, wide).select("path", "conv", "path_score", (F.col("at") - (1 << k)).alias("at"), F.col("up").alias("node"))
        found = written(found.unionByName(far), "paths")
    return found


def transcripts(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv, path, path_score, n_turns, transcript, loss_starts, loss_ends) of each chosen path."""
    limit_batches(messages.sparkSession)
    own = messages.select(_node("conv", "msg").alias("node"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = join_hot(paths(messages, branches), own, "node", messages.count())
    whole = turns.groupBy("path").agg(F.first("conv").alias("conv"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            counts = pa.array([len(t) for t in batch.column("turns")], pa.int64())
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("path"), batch.column("path_score"), counts, *columns], names)

    names = ["conv", "path", "path_score", "n_turns", "transcript", "loss_starts", "loss_ends"]
    kind = messages.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, path string, path_score double, n_turns long, transcript string, loss_starts array<long>, loss_ends array<long>"
    return whole.select("conv", "path", "path_score", "turns").mapInArrow(run, schema)


def turns_of(made: DataFrame) -> DataFrame:
    """(conv, path, turns array<struct<role, text>>, loss string): transcripts read back; loss is the unescaped
    text under the mask."""
    kind = made.schema["conv"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            turns, loss = [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("transcript", "loss_starts", "loss_ends")), strict=True):
                turns.append([{"role": r, "text": t} for r, t in parse(text)])
                loss.append("".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)))
            of = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("path"), pa.array(turns, of), pa.array(loss, pa.string()), batch.column("transcript")], ["conv", "path", "turns", "loss", "transcript"])

    return made.select("conv", "path", "transcript", "loss_starts", "loss_ends").mapInArrow(run, f"conv {kind}, path string, turns array<struct<role string, text string>>, loss string, transcript string")

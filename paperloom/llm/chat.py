"""Reply trees as conversations: enumerate root-to-leaf paths, rank them, format the chosen ones.

Self-joins double the reach of every message's pointer towards the root, so a tree of depth d
needs about log d rounds; the pointers of each round are kept.  They give every leaf the
length and the score of its path, and for the chosen leaves they are read again to list the
messages of the path.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, stage

HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
# every character that a control string begins with has an escape, so none occurs inside a text
ESCAPES = {"\\": "\\b", "#": "\\h", "<": "\\l"}
ROLE_ESCAPES = {**ESCAPES, ":": "\\c", "\n": "\\n"}
PLAIN = {v: k for k, v in ROLE_ESCAPES.items()}


def escaped(text: str, table: dict[str, str] = ESCAPES) -> str:
    return text.translate(str.maketrans(table))


def unescaped(text: str) -> str:
    return re.sub(r"\\[bhlcn]", lambda m: PLAIN[m[0]], text)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, length) in code points under the loss mask."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head = f"{HEAD}{escaped(role, ROLE_ESCAPES)}{COLON}"
        body = escaped(text)
        if role == loss_role:
            spans.append((at + len(head), len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: the exact inverse of ``format_turns``."""
    found = []
    for turn in formatted.split(TAIL)[:-1]:
        role, _, body = turn.removeprefix(HEAD).partition(COLON)
        found.append((unescaped(role), unescaped(body)))
    return found


def masked_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """What the loss mask covers, unescaped."""
    return "".join(unescaped(formatted[start : start + length]) for start, length in spans)


def _key(column: str) -> Column:
    """A text that equals itself also where the value is NULL."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(column).cast("string")))


def linear_replies(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn-numbered conversations as reply trees without branches: each row answers the one before it.

    Rows of a conversation are ordered by turn, then role and text, so repeated turns have
    a place.  A conversation leaves as one text, so its rows do fit one task.
    """
    ordered = Window.partitionBy(conv_id).orderBy(turn, role, text)
    numbered = turns.select(
        F.col(conv_id).alias("conv_id"), F.row_number().over(ordered).alias("msg_id"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    previous = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return numbered.select("*", previous.alias("parent_id"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def root_paths(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, msg, turns, total) of every message with a root, and per round (conv, msg, up): the 2**i-th ancestor.

    ``turns`` counts the messages from the root to this one, ``total`` adds their scores.
    """
    state = messages.select("conv", "msg", F.col("parent").alias("up"), F.lit(1).cast("long").alias("turns"), F.col("score").alias("total"))
    state = stage(state, "paths")
    jumps, before = [state.where("up is not null").select("conv", "msg", "up")], None
    while True:
        left = state.where("up is not null").count()
        if not left or left == before:
            # what is left hangs on a cycle: each round must end at least the shallowest rest
            return state.where("up is null").select("conv", "msg", "turns", "total"), jumps
        before = left
        above = state.select("conv", F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("turns").alias("_turns"), F.col("total").alias("_total"))
        # only messages that have not reached their root are joined; the others pass
        climbed = state.where("up is not null").join(above, ["conv", "up"]).select(
            "conv",
            "msg",
            F.col("_up").alias("up"),
            (F.col("turns") + F.col("_turns")).alias("turns"),
            (F.col("total") + F.col("_total")).alias("total"),
        )
        state = stage(state.where("up is null").unionByName(climbed), "paths")
        jumps.append(state.where("up is not null").select("conv", "msg", "up"))


def conversations(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, branch, n_turns, score, formatted, loss_spans) of the best ``branches`` paths per conversation.

    ``messages``: conv_id, msg_id, parent_id, role, text, score.  A path runs from a root to a
    leaf; branches are ranked by the mean score of their messages, then the longer, then the
    smaller message id.  A message whose parent is NULL or unknown is a root.  Of rows with the
    same conv_id and msg_id the one with the best score, then the smallest text, stays.
    Messages on a cycle of parents, or below one, have no root and belong to no path.  NULL role
    and text count as empty, NULL score as 0, NULL conv_id as a conversation of its own; an empty
    table gives no rows.
    """
    kind = field_type(messages, "conv_id")
    rows = messages.select(
        "conv_id",
        _key("conv_id").alias("conv"),
        _key("msg_id").alias("msg"),
        F.when(F.col("parent_id").isNotNull(), _key("parent_id")).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    best = F.min_by(F.struct("conv_id", "parent", "role", "text", "score"), F.struct(F.negative("score"), "text", "role", "parent"))
    nodes = stage(rows.groupBy("conv", "msg").agg(best.alias("m")).select("conv", "msg", "m.*"), "messages")
    known = nodes.select("conv", F.col("msg").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.select("conv", "msg", "parent", "score").join(known, ["conv", "parent"], "left")
    linked = stage(linked.select("conv", "msg", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"), "replies")
    reached, jumps = root_paths(linked)
    answered = linked.where("parent is not null").select("conv", F.col("parent").alias("msg"))
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("turns")), F.desc("turns"), "msg"))
    leaves = reached.join(answered, ["conv", "msg"], "left_anti").withColumn("branch", rank).where(F.col("branch") <= branches)
    leaves = stage(leaves, "leaves")
    path = leaves.select("conv", "branch", "msg", F.col("turns").alias("place"))
    for reach, jump in enumerate(jumps):
        up = path.join(jump, ["conv", "msg"]).select(
            "conv", "branch", F.col("up").alias("msg"), (F.col("place") - 2**reach).alias("place")
        )
        path = stage(path.unionByName(up), "path-messages")
    turns = path.join(nodes.select("conv", "msg", "conv_id", "role", "text"), ["conv", "msg"])
    grouped = turns.groupBy("conv", "branch").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    scored = grouped.join(leaves.select("conv", "branch", (F.col("total") / F.col("turns")).alias("score")), ["conv", "branch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [[(t["role"], t["text"]) for t in c] for c in batch.column(3).to_pylist()]
            made = [format_turns(t, loss_role) for t in turns]
            spans = pa.array([[{"start": a, "length": n} for a, n in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(2)],
                    pa.array([len(t) for t in turns], pa.int64()),
                    batch.column(2),
                    pa.array([f for f, _ in made], pa.string()),
                    spans,
                ],
                names=["conv_id", "branch", "n_turns", "score", "formatted", "loss_spans"],
            )

    schema = f"conv_id {kind}, branch int, n_turns long, score double, formatted string, loss_spans array<struct<start:long,length:long>>"
    return scored.select("conv_id", "branch", "score", "turns").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from formatted conversations alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = masked_text(text, [(s["start"], s["length"]) for s in spans])
                listed = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = field_type(formatted, "conv_id")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)

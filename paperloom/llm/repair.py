"""Conversation structure repair by Knuth's lightest derivations.

A damaged conversation is repaired by keeping, reroling, deleting and inserting rows until its roles
read ``(s?(ua)+)?``.  An item (k, state) says that the first k rows are repaired and the repaired roles
lead to ``state`` of that grammar.  Deductions build items from items and rows: their weight functions
add a cost and append a letter to the audit, so they are monotone and never lower a weight, and weights
(cost, audit) are ordered by cost, then audit.  The agenda therefore pops every item at its least weight,
and the first goal item popped is the best repair; what is dearer is never built.

Rows are annotated by windows over their conversation and stay in tables.  The agenda sees two letters
of a row, so one task holds as much of a conversation as its audit does, which leaves as one value.  Texts
of the repaired rows pass the hash one by one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import field_type, stage

WHITE = r"\x20\x09-\x0D"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: state of the grammar after another role: 0 nothing yet, 1 a system row, 2 an open question, 3 an answer
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = 4
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: role letters that may be inserted or given, by state
GIVEN = {state: [r for r in "ua" if (state, r) in STEPS] for state in range(STATES)}


class Derivation:
    """A derived item: its cost, its last edit and the derivation before it; ``jump`` leads far up the same path."""

    __slots__ = ("cost", "item", "letter", "role", "before", "depth", "jump")

    def __init__(self, cost: int, item: tuple[int, int], letter: str = "", role: str = "", before: Derivation | None = None):
        self.cost, self.item, self.letter, self.role, self.before = cost, item, letter, role, before
        if before is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = before.depth + 1
            far = before.jump
            # jumps of powers of two joined, so that any ancestor is about log(depth) steps away
            self.jump = far.jump if before.depth - far.depth == far.depth - far.jump.depth else before

    def at_depth(self, depth: int) -> Derivation:
        node = self
        while node.depth > depth:
            node = node.jump if node.jump.depth >= depth else node.before
        return node

    def __lt__(self, other: Derivation) -> bool:
        """Cheaper, or of the same cost with the smaller audit; a prefix is smaller."""
        if self.cost != other.cost:
            return self.cost < other.cost
        depth = min(self.depth, other.depth)
        a, b = self.at_depth(depth), other.at_depth(depth)
        if a is b:
            return self.depth < other.depth
        while a.before is not b.before:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.before, b.before)
        return a.letter < b.letter


def deductions(done: Derivation, rows: str) -> Iterator[Derivation]:
    """Every conclusion from a finished item and, where it reads one, the next row.

    Rows are axioms of weight (0, "").  ``rows`` has two letters a row: its role's initial, and ``k`` (fine),
    ``t`` (truncated) or ``d`` (to be deleted).
    """
    place, state = done.item
    for role in GIVEN[state]:
        yield Derivation(done.cost + INSERT, (place, STEPS[state, role]), "I", role, done)
    if 2 * place == len(rows):
        return
    initial, fault = rows[2 * place], rows[2 * place + 1]
    yield Derivation(done.cost + DELETE, (place + 1, state), "D", "", done)
    if fault == "d":
        return
    extra = TRUNCATED if fault == "t" else 0
    if (state, initial) in STEPS:
        yield Derivation(done.cost + extra, (place + 1, STEPS[state, initial]), "K", initial, done)
    for role in GIVEN[state]:
        if role != initial:
            yield Derivation(done.cost + REROLE + extra, (place + 1, STEPS[state, role]), "R", role, done)


def lightest(rows: str) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, repaired rows) of the lightest derivation of a goal item.

    A repaired row is (number of its row from 1, role to set or "") or (0, role) for an inserted one.
    """
    agenda, finished = [Derivation(0, (0, 0))], set()
    while True:
        done = heapq.heappop(agenda)
        if done.item in finished:
            continue
        finished.add(done.item)
        place, state = done.item
        if 2 * place == len(rows) and state in FINAL:
            break
        for made in deductions(done, rows):
            if made.item not in finished:
                heapq.heappush(agenda, made)
    letters, repaired, node = [], [], done
    while node.before is not None:
        letters.append(node.letter)
        if node.letter == "I":
            repaired.append((0, ROLES[node.role]))
        elif node.letter != "D":
            repaired.append((node.item[0], ROLES[node.role] if node.letter == "R" else ""))
        node = node.before
    return done.cost, "".join(reversed(letters)), repaired[::-1]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with NULL roles and texts as one space and faults planted by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _conversation(conv_id: str = "conv_id") -> Column:
    """A key that equals itself also where the id is NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("-")).alias("conv")


def annotated(turns: DataFrame) -> DataFrame:
    """(conv, place, turn, role, text, fault, new_turn, illegal) of ``turns`` (conv_id, turn, role, text).

    Rows of a conversation are ordered by turn (NULL first), then role and text, and numbered from 1.  ``fault`` is
    the first of blank, duplicate, truncated, or NULL; ``illegal`` marks a role that may not follow the one before.
    """
    inside = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = turns.select(_conversation(), "turn", "role", "text").select(
        "*",
        F.row_number().over(inside).cast("long").alias("place"),
        F.coalesce(F.col("turn") != F.lag("turn").over(inside), F.col("turn").isNotNull()).alias("new_turn"),
        F.concat(F.lag(initial).over(inside), initial).alias("_pair"),
    )
    # the same conversation key, so the rows are sorted again where they are
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1
    fault = (
        F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank")
        .when(again, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{WHITE}]*+\z"), "truncated")
    )
    return rows.select(
        "conv", "place", "turn", "role", "text", fault.alias("fault"), "new_turn", F.coalesce(~F.col("_pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal")
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Per conversation the counts of its faults, and two letters a row in order."""
    initial = F.substring("role", 1, 1)
    letters = F.concat(
        F.when(initial.isin(*ROLES), initial).otherwise("x"),
        F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k"),
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    number = lambda c: F.count(F.when(c, 1))
    grouped = rows.groupBy("conv").agg(
        (F.max(wide("turn")) - F.min(wide("turn")) + 1).alias("span"),
        number(F.col("new_turn")).alias("turns"),
        *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(F.struct("place", letters.alias("letters")))).alias("rows"),
    )
    # a span beyond 64 bits is NULL
    gaps = F.coalesce(F.col("span"), F.lit(0)) - F.col("turns")
    return grouped.select(
        "conv",
        gaps.try_cast("long").alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        "illegal",
        F.array_join(F.transform("rows", lambda r: r["letters"]), "").alias("rows"),
    )


REPAIRS = "conv string, cost long, audit string, repaired array<struct<place:long,role:string>>"


def repairs(counted: DataFrame) -> DataFrame:
    """(conv, cost, audit, repaired) of ``counted`` (conv, rows); equal rows are repaired once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int64()), ("role", pa.string())]))
        for batch in batches:
            found: dict[str, tuple[int, str, list[dict]]] = {}
            for rows in batch.column(1).to_pylist():
                if rows not in found:
                    cost, audit, repaired = lightest(rows)
                    found[rows] = cost, audit, [{"place": p, "role": r} for p, r in repaired]
            costs, audits, repaired = zip(*[found[rows] for rows in batch.column(1).to_pylist()]) if len(batch) else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(repaired, kind)],
                names=["conv", "cost", "audit", "repaired"],
            )

    return counted.select("conv", "rows").mapInArrow(run, REPAIRS)


def repaired_rows(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv, number, role, text): the rows of the repaired conversations, numbered from 0."""
    listed = repaired.select("conv", F.posexplode("repaired").alias("number", "r")).select("conv", "number", "r.place", F.col("r.role").alias("given"))
    joined = listed.join(rows.select("conv", "place", "role", "text").hint("merge"), ["conv", "place"], "left")
    role = F.when(F.col("given") != "", F.col("given")).otherwise(F.col("role"))
    return joined.select("conv", "number", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def hashed_conversations(rows: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of repaired rows: SHA-256 of ``role:text`` lines joined by line breaks.

    The rows of a conversation pass in order; only the state of the hash is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for conv, role, text in zip(*[batch.column(i) for i in range(3)]):
                conv = conv.as_py()
                if conv != open_conv:
                    if open_conv is not None:
                        done.append((open_conv, digest.hexdigest()))
                    open_conv, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role.as_py()}:{text.as_py()}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["conv", "repaired_sha256"])
        if open_conv is not None:
            last = [[open_conv], [digest.hexdigest()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in last], names=["conv", "repaired_sha256"])

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "number")
    return ordered.select("conv", "role", "text").mapInArrow(run, "conv string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, rows) of ``turns`` (conv_id, turn, role, text): what was wrong and the cheapest repair per conversation, and its rows.

    report: conv, gaps, blank, duplicate, truncated, illegal, cost, audit.  rows: conv, number, role, text.  ``conv`` is
    ``=`` and the id, or ``-`` for the conversation without id.  A role whose initial the grammar lacks, also an empty one,
    cannot be kept.  NULL roles or texts must be filled before; rows of equal turn are ordered by role and text; repeated
    rows are duplicates; other columns are ignored; an empty table gives no rows.
    """
    rows = stage(annotated(turns), "turns")
    counted = stage(_counted(rows), "conversations")
    repaired = stage(repairs(counted), "repairs")
    report = counted.drop("rows").join(repaired.drop("repaired"), "conv")
    return report, repaired_rows(rows, repaired)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id, turn, role, text): its planted faults and their repair.

    A conversation without rows after the damage has zeros, an empty audit and the hash of an empty text.
    """
    kind = field_type(conversations, "conv_id")
    report, rows = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    hashes = hashed_conversations(rows)
    given = conversations.select(_conversation(), "conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = given.join(report, "conv", "left").join(hashes, "conv", "left")
    return joined.select(
        F.col("conv_id").cast(kind).alias("conv_id"),
        *[F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

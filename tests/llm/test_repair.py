import hashlib
import random
import re
import zlib
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string, conv string, place int, number int, fault string"


def every_repair(rows, inserts=2):
    """The least (cost, audit) with its repaired rows, from all edit sequences with at most ``inserts`` inserted rows a gap."""
    best = None
    gaps = [list(p) for n in range(inserts + 1) for p in product("ua", repeat=n)]
    edits = []
    for place, (initial, fault) in enumerate(rows, 1):
        options = [(3, "D", "", None)]
        if fault != "d":
            extra = 1 if fault == "t" else 0
            options.append((extra, "K", initial, (place, "")))
            options += [(2 + extra, "R", r, (place, NAMES[r])) for r in "ua"]
        edits.append(options)
    for chosen in product(*edits):
        for filled in product(gaps, repeat=len(rows) + 1):
            cost, audit, roles, out = 0, "", "", []
            for gap, edit in zip(filled, [*chosen, None]):
                cost, audit, roles = cost + 2 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                out += [(0, NAMES[r]) for r in gap]
                if edit:
                    cost, audit, roles = cost + edit[0], audit + edit[1], roles + edit[2]
                    out += [edit[3]] if edit[3] else []
            if LEGAL.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


ROW = st.tuples(st.sampled_from("suax"), st.sampled_from("kktd"))


@settings(max_examples=60, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_lightest_against_all_edits(rows):
    assert repair.lightest("".join(map("".join, rows))) == every_repair(rows)


def by_position(rows):
    """The same optimum from left to right, with whole audits."""
    best = {0: (0, "")}
    for initial, fault in [*rows, (None, None)]:
        for _ in range(2):
            for q, (c, a) in list(best.items()):
                for r in "ua":
                    if (q, r) in repair.STEPS:
                        to = repair.STEPS[q, r]
                        best[to] = min(best.get(to, (10**9, "")), (c + 2, a + "I"))
        if initial is None:
            return min(best[q] for q in (0, 3) if q in best)
        after = {}
        for q, (c, a) in best.items():
            moves = [(3, "D", q)]
            if fault != "d":
                moves += [(0, "K", repair.STEPS[q, initial])] if (q, initial) in repair.STEPS else []
                moves += [(2, "R", repair.STEPS[q, r]) for r in "ua" if (q, r) in repair.STEPS]
            for cost, letter, to in moves:
                cost += fault == "t" and letter != "D"
                after[to] = min(after.get(to, (10**9, "")), (c + cost, a + letter))
        best = after


def test_long_conversations():
    rng = random.Random(11)
    for n in (1, 7, 40, 900):
        for _ in range(12):
            rows = [(rng.choice("suuaax"), rng.choice("kkkktd")) for _ in range(n)]
            assert repair.lightest("".join(map("".join, rows)))[:2] == by_position(rows)


def brute(turns):
    """Every column of the query for plain rows (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in turns}:
        rows = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            role = "user" if h == 4 else role
            rows += [(turn, role, text)] * (2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            faults.append("b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "k")
            seen.add((role, text))
        known = {t for t, *_ in rows if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        letters = "".join((r[1][:1] if r[1][:1] in tuple("sua") else "x") + ("d" if f in "bd" else f) for r, f in zip(rows, faults))
        cost, audit = by_position([(letters[i], letters[i + 1]) for i in range(0, len(letters), 2)])
        lines, at, state = [], 0, 0
        for letter in audit:
            given = next((r for r in "ua" if (state, r) in repair.STEPS), None)
            if letter == "I":
                lines.append(f"{NAMES[given]}:")
                state = repair.STEPS[state, given]
                continue
            if letter == "R":
                lines.append(f"{NAMES[given]}:{rows[at][2]}")
                state = repair.STEPS[state, given]
            if letter == "K":
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
                state = repair.STEPS[state, rows[at][1][0]]
            at += 1
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        counts = [faults.count(f) for f in "bdt"]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(13)
    texts = ["Yes.", "No!", "Why?", "so so", " \t", "", "end. \n", "é 你?", None]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    table = spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], SCHEMA)
    assert found(repair.repair_damaged(table)) == brute(rows)


def test_one_long_conversation_and_edges(spark):
    rows = [(5, t, "user" if t % 2 else "assistant", f"turn {t}" + ". " * (t % 3) + "x" * (200_000 if t == 50 else 0)) for t in range(3000)]
    rows += [(6, 2**62, "user", "far."), (6, -(2**62), "assistant", "near.")]
    got = found(repair.repair_damaged(spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], SCHEMA)))
    want = brute(rows)
    assert got[0] == want[0]
    assert got[1][2:] == want[1][2:] and got[1][1] in (want[1][1], None)
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    alone = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "a.", "x", 1, 1, "x")], SCHEMA))
    assert found(alone) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]

import random

from hypothesis import given
from hypothesis import strategies as st

from paperloom.llm import chat

SCHEMA = "conv_id long, msg_id long, parent_id long, role string, text string, score double, formatted string, place int"
hostile = st.text(alphabet="#<\\/:>turnassistant \nhlbc", max_size=30) | st.text(max_size=12)


@given(st.lists(st.tuples(hostile | st.just("assistant"), hostile), max_size=6))
def test_template_is_reversible(turns):
    text, spans = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert chat.masked_text(text, spans) == "".join(t for r, t in turns if r == "assistant")


def paths(rows):
    """Root-to-leaf paths of one conversation's rows {msg: (parent, score)}, best first."""
    out = []
    parents = {p for p, _ in rows.values()}
    for leaf in rows:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at in rows and at not in path:
            path.append(at)
            at = rows[at][0]
        if at in path:
            continue
        out.append((-sum(rows[m][1] for m in path) / len(path), -len(path), f"={leaf}", path[::-1]))
    return [p for *_, p in sorted(out)]


def test_best_branches_of_random_trees(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(12):
        tree = {0: (None, 1.0)}
        for m in range(1, rng.randint(2, 40)):
            tree[m] = (rng.choice([*range(m), 999]) if rng.random() < 0.9 else m - 1, float(rng.randrange(5)))
        rows += [(conv, m, p, f"r{m}", f"t{m}", s, "x", 1) for m, (p, s) in tree.items()]
        want[conv] = [[(f"r{m}", f"t{m}") for m in p] for p in paths(tree)[:3]]
    got = chat.conversations(spark.createDataFrame(rows, SCHEMA), branches=3).collect()
    found = {c: [chat.read_turns(r.formatted) for r in sorted((r for r in got if r.conv_id == c), key=lambda r: r.branch)] for c in want}
    assert found == want


def test_edges(spark):
    rows = [
        (1, 1, None, "user", None, None, "x", 1),
        (1, 2, 1, None, "answer", 1.0, "x", 1),
        (1, 2, 1, None, "answer", 1.0, "x", 1),  # a repeated row
        (2, 1, 2, "user", "cycle", 1.0, "x", 1),
        (2, 2, 1, "user", "cycle", 1.0, "x", 1),
        (2, 3, 2, "user", "below the cycle", 1.0, "x", 1),
        (3, 1, 1, "user", "own parent", 1.0, "x", 1),
        (4, 1, 77, "user", "unknown parent", 1.0, "x", 1),
        (None, 1, None, "assistant", "no conversation", 1.0, "x", 1),
        (None, 2, 1, "user", "x" * 300_000, 1.0, "x", 1),
        (5, None, None, "user", "", 1.0, "x", 1),
    ]
    got = {r.conv_id: chat.read_turns(r.formatted) for r in chat.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: [("user", ""), ("", "answer")],
        4: [("user", "unknown parent")],
        None: [("assistant", "no conversation"), ("user", "x" * 300_000)],
        5: [("user", "")],
    }
    assert chat.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_chain_and_ties_of_turns(spark):
    rows = [(1, i // 2, "user" if i % 2 else "assistant", f"t{i}") for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.conversations(chat.linear_replies(turns))
    row = made.collect()[0]
    ordered = [(r, t) for _, _, r, t in sorted(rows)]
    assert chat.read_turns(row.formatted) == ordered and row.n_turns == 600
    back = chat.read_back(made).collect()[0]
    assert back.loss_chars == sum(len(t) for r, t in ordered if r == "assistant")
    assert chat.read_back(made.where("conv_id < 0")).count() == 0

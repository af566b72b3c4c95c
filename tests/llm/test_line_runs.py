import random

import numpy as np
from edges import docs, empty

from paperloom.llm import line_chunks as L


def slow(rows):
    """Every run of two lines or more that starts at an earlier place of any text left out, tried at each length."""
    places = [(i, at) for i, (_, lines) in enumerate(rows) for at in range(len(lines))]
    gone = set()
    for n, (i, at) in enumerate(places):
        for j, start in places[:n]:
            size = 0
            while at + size < len(rows[i][1]) and start + size < len(rows[j][1]) and rows[i][1][at + size] == rows[j][1][start + size]:
                size += 1
            if size > 1:
                gone |= {(i, at + k) for k in range(size)}
    return {doc_id: "\n".join(x for at, x in enumerate(lines) if (i, at) not in gone) for i, (doc_id, lines) in enumerate(rows)}


def test_whole_runs_go(spark):
    rng = random.Random(11)
    passages = [[f"p{k} {i}" for i in range(rng.randint(2, 12))] for k in range(8)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 5)):
            passage = rng.choice(passages)
            a = rng.randint(0, len(passage) - 1)
            lines += passage[a : rng.randint(a + 1, len(passage))] if rng.random() < 0.6 else [f"own {rng.random()}"]
        rows.append((i, lines or [""]))
    rows.append((50, rows[40][1] + ["x", "x", "x"]))
    got = L.drop_repeated_runs(docs(spark, [(i, "\n".join(x), "en", "s") for i, x in rows])).select("_row.doc_id", "_row.text", "removed").collect()
    assert {r.doc_id: r.text for r in got} == slow(rows)
    for r in got:
        runs = r.removed or []
        assert all(b.first > a.first + a.size for a, b in zip(runs, runs[1:]))
        assert sum(x.size for x in runs) == len(rows[r.doc_id][1]) - (len(r.text.split("\n")) if r.text or not runs else 0)
    assert {x for _, lines in rows for x in lines} == {x for r in got for x in r.text.split("\n")}  # no line is lost


def test_edge_rows(spark):
    source = docs(spark)
    rows = L.drop_repeated_runs(source).collect()
    assert len(rows) == source.count()
    texts = {r["_row"].doc_id: r["_row"].text for r in rows if r["_row"].doc_id in (1, 3, 4, 8)}
    assert texts[3] is None and texts[4] == "" and texts[8] == "one" and "Third" in texts[1]
    assert L.drop_repeated_runs(empty(spark)).count() == 0


def cleaned(spark, *texts):
    rows = L.drop_repeated_runs(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).select("_row.doc_id", "_row.text").collect()
    return [r.text for r in sorted(rows, key=lambda r: r.doc_id)]


def test_blank_lines_are_no_run(spark):
    first, paragraphs = "alpha one\n\n\nbeta two", "Intro\n\ngamma three\n\n\ndelta four"
    code = "x1\n}\n\ny1\n}\n\nz1"
    assert cleaned(spark, first, paragraphs, code) == [first, paragraphs, code]
    # blank lines within a repeated run go with it, those around it stay
    assert cleaned(spark, "a\n\nb\nc", "x\n\na\n\nb\nc\n\ny", "a\nb") == ["a\n\nb\nc", "x\n\n\ny", "a\nb"]


def slow_with_blanks(texts):
    """As ``slow``, for runs that start and end with filled lines and hold two of them or more."""
    places = [(i, at) for i, lines in enumerate(texts) for at in range(len(lines)) if lines[at].strip()]
    gone = set()
    for n, (i, at) in enumerate(places):
        for j, start in places[:n]:
            size = 0
            while at + size < len(texts[i]) and start + size < len(texts[j]) and texts[i][at + size] == texts[j][start + size]:
                size += 1
            while size and not texts[i][at + size - 1].strip():
                size -= 1
            if sum(1 for x in texts[i][at : at + size] if x.strip()) > 1:
                gone |= {(i, at + k) for k in range(size)}
    return ["\n".join(x for at, x in enumerate(lines) if (i, at) not in gone) for i, lines in enumerate(texts)]


def test_blank_lines_braces_and_copies_by_brute_force(spark):
    rng = random.Random(5)
    parts = [[rng.choice(["}", "", "", f"w{k} {i}", f"v{i % 3}"]) for i in range(rng.randint(3, 14))] for k in range(6)]
    texts = []
    for _ in range(30):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += rng.choice(parts) if rng.random() < 0.7 else [f"own {rng.random()}", ""]
        texts.append(lines)
    texts += [texts[3], texts[3] + texts[5]]
    assert cleaned(spark, *["\n".join(x) for x in texts]) == slow_with_blanks(texts)


def test_chunks_of_any_size_give_the_same_lines(spark):
    rng = random.Random(9)
    shared = [f"line {i}" for i in range(60)]
    texts = ["\n".join(shared[rng.randint(0, 20) : rng.randint(25, 60)] + [f"own {rng.random()}"]) for _ in range(20)]
    source = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    found = [
        sorted(L.drop_repeated_runs(source, divisor=d).select("_row.doc_id", "_row.text").collect()) for d in (2, 3, 50)
    ]
    assert found[0] == found[1] == found[2]


def test_copies_are_removed_by_their_chunks():
    text = "\n".join(f"line {i}" for i in range(200)).encode()
    chunks, pairs = L.filled_chunks(text), L.line_pairs(text)
    held = {f + k for f, n, _ in chunks for k in range(n)}
    first, size = (np.array([p[i] for p in chunks + pairs]) for i in range(2))
    whole = np.arange(len(first)) < len(chunks)
    open_marks = L._open_marks(first, size, np.zeros(len(first), bool), whole)
    assert open_marks[whole].all()
    assert [p[0] for p, o in zip(pairs, open_marks[~whole]) if o] == [f for f, _, _ in pairs if not {f, f + 1} <= held]
    assert open_marks[~whole].mean() < 0.5  # chunks remove most of a copy
    assert L._open_marks(first, size, np.ones(len(first), bool), whole).all()  # owners are always read

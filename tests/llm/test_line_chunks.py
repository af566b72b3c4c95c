import random

from edges import CLASHING, docs, empty

from paperloom.llm import line_chunks as L


def slow(rows):
    """Rows in order of id with the chunks of several lines seen before left out."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            continue
        lines, kept = text.split("\n"), []
        for first, size, body in L.line_chunks(text.encode()):
            if size > 1 and body in seen:
                continue
            if size > 1:
                seen.add(body)
            kept += lines[first - 1 : first - 1 + size]
        out[doc_id, text] = "\n".join(kept)
    return out


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(2)
    lines = [f"line {rng.random()}" for _ in range(200)]
    text = "\n".join(lines).encode()
    cut = L.line_chunks(text)
    assert b"\n".join(body for _, _, body in cut) == text
    assert [f for f, _, _ in cut] == [1 + sum(n for _, n, _ in cut[:i]) for i in range(len(cut))]
    moved = {body for _, _, body in L.line_chunks(b"new first line\nand another\n" + text)}
    assert len([1 for _, _, body in cut if body not in moved]) <= 2


def test_random_passages(spark):
    rng = random.Random(7)
    passages = [[f"p{k} {i}" for i in range(rng.randint(2, 9))] for k in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(passages) if rng.random() < 0.6 else [f"own {rng.random()}"]
        rows.append((i, "\n".join(lines)))
    want = slow(rows)
    got = L.drop_repeated_chunks(docs(spark, [(i, t, "en", "s") for i, t in rows])).select("_row.doc_id", "_row.text").collect()
    assert {(r.doc_id): r.text for r in got} == {i: want[i, t] for i, t in rows}
    assert any(want[k] != k[1] for k in want)


def test_edge_rows(spark):
    source = docs(spark)
    rows = L.drop_repeated_chunks(source).collect()
    assert len(rows) == source.count()
    assert rows[0]["_row"].asDict().keys() == set(source.columns)
    assert all(r["_row"][c] == "x" for r in rows for c in CLASHING)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["_row"].doc_id, []).append(r["_row"].text)
    want = slow([(r.doc_id, r.text) for r in source.collect()])
    for (doc_id, _), text in want.items():
        assert text in by_id[doc_id]
    assert by_id[3] == [None] and by_id[4] == [""]
    assert len(set(t for t in by_id[2] if "another" not in t)) == 1  # repeated rows are treated alike


def test_empty_table(spark):
    assert L.drop_repeated_chunks(empty(spark)).count() == 0

import random
import re

from edges import docs, empty

from paperloom.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(texts, items, size):
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            b = words(item)
            n = min(size, len(b))
            for j in range(len(b) - n + 1) if b else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == b[j : j + n]:
                        hit.update(range(i, i + n))
                        if name is not None:
                            names.add(str(name))
        out.append((len(w), len(hit), sorted(names)))
    return out


def check(spark, rows, items, size):
    source = docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(source, bench, size).collect()]
    want = [(r[0], *x) for r, x in zip(rows, slow([r[1] for r in rows], items, size))]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_random_texts_in_small_segments_and_blocks(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("aa bb cc dd Éé f1".split()) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)), "en", "s") for i in range(120)]
    items = [(i, text(rng.choice([0, 1, 2, 4, 5, 9]))) for i in range(12)] + [(3, text(6)), (None, text(6)), (50, None)]
    check(spark, rows, items, 4)
    monkeypatch.setattr(D, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(D, "PHRASES_PER_BLOCK", 5)
    check(spark, rows, items, 4)


def test_edge_rows(spark):
    from edges import ROWS

    items = [(1, "quick brown FOX jumps over the"), (2, "one"), (10, "word3 and3 word4"), (9, "!!"), (7, "123")]
    check(spark, ROWS, items, 3)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert D.contamination(empty(spark), bench).count() == 0
    rows = D.contamination(docs(spark), bench.where("item_id < 0")).collect()
    assert {(r.n_hit, len(r["items"])) for r in rows} == {(0, 0)}


def test_phrase_does_not_cross_documents(spark):
    check(spark, [(1, "a b", "", ""), (2, "c d", "", "")], [(1, "b c"), (2, "a b c d")], 10)


def test_proximity(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(20)]
    index = D.build_index(docs(spark, [(i, t, "", "") for i, t in enumerate(texts)]))
    got = sorted(map(tuple, D.find_near(index, ["A", "b", "c"], 2).collect()))
    want = [
        (d, i) for d, t in enumerate(texts) for i, y in enumerate(t.split())
        if y == "a" and all(z in t.split()[max(0, i - 2) : i + 3] for z in "bc")
    ]
    assert got == want
    assert D.find_near(index, ["a", "zzz"], 3).count() == 0

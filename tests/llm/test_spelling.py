import random
import zlib
from collections import Counter

from edges import docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import spelling


def typed(rows):
    counts = Counter()
    for doc, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    near = {w: sorted((v for v in words if one_edit(v, w)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 2 * n else None for w, n in words.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_random_words_against_brute_force(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    rows = []
    for doc in range(40):
        words = []
        for _ in range(120):
            w = rng.choice(stems[: rng.randint(1, 60)])
            at = rng.randrange(len(w))
            w = rng.choice([w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice("abÀ") + w[at:], w[:at] + "c" + w[at + 1 :]])
            words.append(w)
        rows.append((doc, " ".join(words)))
    want = brute(typed(rows))
    assert len(want) > 300 and sum(r[1] is not None for r in want) > 50
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.variants(table)) == want
    # the same through the smallest tiles, so that every bucket is cut as far as it goes
    assert found(spelling.variants(table, tile_words=2, tile_letters=20)) == want


def test_edges(spark):
    table = docs(spark)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert found(spelling.variants(table)) == brute(typed(rows))
    assert found(spelling.variants(empty(spark))) == []
    long = ["x" * 30_000 + "y", "x" * 30_000, "x" * 29_999 + "z"]
    many = [(i, f"{long[i % 3]} {'Été' * 3} ÉTÉÉtéÉté") for i in range(9)]
    assert found(spelling.variants(spark.createDataFrame(many, "doc_id long, text string"))) == brute(typed(many))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=7), min_size=2, max_size=12, unique=True))
def test_tiles_agree_with_the_definition(words):
    import numpy as np

    data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.array([[len(w) for w in words]])
    starts = np.cumsum(lengths, axis=1) - lengths
    for m in {len(w) for w in words} | {len(w) + 1 for w in words}:
        whole = spelling.near_in_tiles(data, starts, lengths, np.array([m]), np.array([0]), np.array([m]))[0][0]
        want = [sum(one_edit(v, w) and max(len(v), len(w)) == m for v in words) for w in words]
        assert whole.tolist() == want
        halves = [(0, m // 2), (m // 2, m)]
        parts = [spelling.near_in_tiles(data, starts, lengths, np.array([m]), np.array([a]), np.array([b]))[0][0] for a, b in halves]
        assert (parts[0] + parts[1]).tolist() == want


def test_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "abcdefghijklm no pqrstuv, wxyz " * 5
    counts = Counter()
    for word, times in spelling.typed_words(text, "n"):
        counts[word] += times
    want = Counter()
    for word, times in Counter(spelling.WORD.findall(text)).items():
        h = zlib.crc32(f"n:{word}".encode())
        want[word if h % 97 else word[: h % len(word)] + word[h % len(word) + 1 :]] += times
    assert counts == want

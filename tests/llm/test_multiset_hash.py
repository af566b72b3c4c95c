import hashlib
import random

import pytest
from edges import ROWS, docs, empty

from paperloom.llm import multiset_hash as M


def test_order_insertion_and_deletion():
    a, b, c = (M.states([t])[0] for t in (b"one two three\nfour five", b"four five\none two three", b"one two three"))
    assert a.digest() == b.digest() != c.digest()
    assert (c + M.states([b"four five"])[0]).digest() == a.digest()
    assert (a - M.states([b"four five"])[0]).digest() == c.digest()
    twice = M.states([b"x\nx"])[0]
    assert twice.digest() != M.states([b"x"])[0].digest()
    assert M.states([b""])[0].digest() == M.State().digest()


def test_likeness_estimates_shared_pairs():
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    first, second, third = text(400), text(400), text(400)
    a, b, c = M.states([f"{first}\n{second}".encode(), f"{first}\n{third}".encode(), third.encode()])
    assert abs(a.likeness(b) - 0.5) < 0.1
    assert a.likeness(c) < 0.1 and a.likeness(a) == 1.0


@pytest.mark.parametrize("parts", [1, 6])
def test_edits_equal_brute_force(spark, partitions, parts):
    partitions(parts)
    rng = random.Random(9)
    rows = [(rng.randrange(10**6), " ".join(rng.choice("ab cd\n ef ü 你".split(" ")) for _ in range(rng.randint(0, 30))), "", "") for _ in range(80)]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in M.compare_edits(docs(spark, rows)).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for k, (doc_id, text, *_) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = (text[: len(text) - half] + following[:half]).encode()
        own, changed, after = M.states([text.encode(), edited, following.encode()])
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.digest(), changed.digest())
        assert (r.near_edited, r.near_next) == (own.likeness(changed), own.likeness(after))


def test_edge_rows(spark):
    rows = M.compare_edits(docs(spark)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    prints = M.fingerprints(docs(spark)).collect()
    assert sorted(r.fingerprint for r in prints) == sorted(r.fingerprint for r in rows)
    assert len({r.fingerprint for r in prints}) == len({t or "" for _, t, *_ in ROWS})
    assert M.compare_edits(empty(spark)).count() == M.fingerprints(empty(spark)).count() == 0
    one = M.compare_edits(docs(spark, [(1, "abcd", "", "")])).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()

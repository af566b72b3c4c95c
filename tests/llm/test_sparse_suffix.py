import random
from collections import Counter

import numpy as np
import pytest
from edges import docs, empty

from paperloom.llm import sparse_suffix as S


def covered(words, least):
    """Word places under windows of ``least`` words that occur more than once."""
    count = Counter(tuple(w[i : i + least]) for w in words.values() for i in range(len(w) - least + 1))
    return {
        d: {p for i in range(len(w) - least + 1) if count[tuple(w[i : i + least])] > 1 for p in range(i, i + least)}
        for d, w in words.items()
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 5])
def test_planted_passages(spark, partitions, seed, parts):
    partitions(parts)
    rng = random.Random(seed)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [own(rng.randint(12, 60)) for _ in range(8)]
    words = {}
    for i in range(60):
        text = own(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 4)
            text += p[a : len(p) - rng.randrange(0, 4)] + own(rng.randint(1, 20))
        words[i] = text
    want = covered(words, 12)
    rows = S.repeated_passages(docs(spark, [(i, " ".join(w), "", "") for i, w in words.items()]), least=12, gram=2, window=5).collect()
    got = {i: set() for i in words}
    for r in rows:
        assert r.n_words >= 12
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
        here = words[r.doc_id][r.start_word : r.start_word + 12]
        assert here == words[r.match_doc_id][r.match_start_word : r.match_start_word + 12]
    assert all(got[i] <= want[i] for i in words)
    missed = sum(len(want[i] - got[i]) for i in words)
    assert missed <= 0.01 * sum(map(len, want.values()))


def test_minimisers_are_chosen_by_content():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 400, dtype=np.uint64)
    whole = S.minimisers(words, 4, 8)
    part = S.minimisers(words[100:300], 4, 8) + 100
    assert set(part) == {p for p in whole if part[0] <= p <= part[-1]}
    assert max(np.diff(whole)) <= 8


def test_copies_and_edges(spark):
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(1, text, "", ""), (2, text, "", ""), (2, text, "", ""), (3, text + " more", "", ""), (None, text, "", ""), (4, None, "", ""), (5, "", "", "")]
    got = sorted((str(r.doc_id), r.start_word, r.n_words, r.match_doc_id) for r in S.repeated_passages(docs(spark, rows)).collect())
    assert got == [("1", 0, 70, 2), ("2", 0, 70, 1), ("2", 0, 70, 1), ("3", 0, 70, 1), ("None", 0, 70, 1)]
    assert S.repeated_passages(docs(spark), least=50).where("doc_id <> 7").count() == 0
    assert S.repeated_passages(empty(spark)).count() == 0


def test_repeats_within_one_text(spark):
    block = [f"b{i}" for i in range(60)]
    words = [*block, *[f"x{i}" for i in range(40)], *block]
    rows = S.repeated_passages(docs(spark, [(1, " ".join(words), "", "")])).collect()
    assert sorted((r.start_word, r.n_words, r.match_start_word) for r in rows) == [(0, 60, 100), (100, 60, 0)]

"""Near words of a list against the definition, word by word."""

from __future__ import annotations

import math
import random

import pytest

from paperloom.functions.similar import dissimilar_places


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _brute(words, limit, top):
    taken = []
    for place, word in enumerate(words):
        if len(taken) == top:
            break
        bounds = [(words[t], math.ceil(max(len(word), len(words[t])) * (1 - limit) - 1e-9) - 1) for t in taken]
        if not any(_distance(word, other) <= bound for other, bound in bounds):
            taken.append(place)
    return taken


@pytest.mark.parametrize("letters, longest, n", [("ab", 8, 600), ("abcdeé𝒳", 14, 400), ("abc", 90, 50)])
def test_places_equal_the_definition(letters, longest, n):
    rnd = random.Random(longest)
    roots = ["".join(rnd.choices(letters, k=rnd.randint(1, longest))) for _ in range(12)]
    words = []
    for _ in range(n):
        word = list(rnd.choice(roots))
        for _ in range(rnd.randint(0, 5)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randint(0, 1)] = rnd.choices(letters, k=rnd.randint(0, 1))
        words.append("".join(word))
    for limit, top in [(0.7, 150), (0.9, 20), (0.5, 30)]:
        assert dissimilar_places(words, limit, top) == _brute(words, limit, top)


def test_many_words_of_a_chunk_in_bounded_time():
    """Pair by pair this takes minutes."""
    import time

    rnd = random.Random(3)
    lists = [["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(4, 11))) for _ in range(150)] for _ in range(400)]
    began = time.time()
    assert all(len(dissimilar_places(words, 0.7, 150)) > 100 for words in lists)
    assert time.time() - began < 10

import numpy as np
import pytest

from paperloom.llm import multiset_hash as M


@pytest.mark.parametrize("times", [60_000, 70_000, 140_000])
def test_a_line_repeated_often_does_not_wrap(times):
    line = "one line of words"
    text = "\n".join([line] * times)
    edited = "\n".join([line] * (times // 2))
    own, changed = M.states([text.encode(), edited.encode()])
    assert int(np.abs(own.sketch).max()) >= times
    # lanes of n and n / 2 everywhere: 2 * (n * n / 2) / (n * n + n * n / 4) = 0.8
    assert own.likeness(changed) == pytest.approx(0.8, abs=1e-3)


def test_sums_still_add_up():
    a, b, both = M.states([b"x y z", b"u v", b"x y z\nu v"])
    assert (a + b).digest() == both.digest() and (both - b).digest() == a.digest()

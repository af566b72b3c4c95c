"""Near words of a list, found in numpy: a filter by length and letters, then edit distances side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK, LEAST = 256, 24  # words of a list that are compared with each other at once
PAIRS = 1 << 19  # pairs of words that are looked at together
WORD_BITS = 64  # words up to this length fit one machine word
WIDTHS = (0, 8, 16, 32, WORD_BITS)  # words are padded to the next of these lengths


def _bounds(longest: np.ndarray, limit: float) -> np.ndarray:
    """Most edits at which two words, the longer of this length, are more alike than ``limit``; -1: none."""
    return np.ceil(longest * (1 - limit) - 1e-9).astype(np.int64) - 1


def _long_distance(a: np.ndarray, b: np.ndarray, bound: int) -> bool:
    """Whether ``a`` and ``b`` (code points) are within ``bound`` edits; row by row within the band."""
    if abs(len(a) - len(b)) > bound:
        return False
    row = np.minimum(np.arange(len(b) + 1), bound + 1)
    for i, code in enumerate(a, 1):
        lo, hi = max(1, i - bound), min(len(b), i + bound)
        new = np.full(len(b) + 1, bound + 1) if i == 1 else spare
        new[max(0, lo - 2) : lo] = bound + 1
        if i <= bound:
            new[0] = i
        best = np.minimum(row[lo - 1 : hi] + (b[lo - 1 : hi] != code), row[lo : hi + 1] + 1)
        best[0] = min(best[0], new[lo - 1] + 1)
        steps = np.arange(len(best))
        new[lo : hi + 1] = np.minimum(np.minimum.accumulate(best - steps) + steps, bound + 1)
        if min(new[lo : hi + 1].min(), new[0] if i <= bound else bound + 1) > bound:
            return False
        new[hi + 1 : hi + 2] = bound + 1
        row, spare = new, row
    return bool(row[len(b)] <= bound)


def _distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of ``a`` and ``b`` (padded letters, 8 to 64 of them, 1 or more used): bit vectors after Myers and Hyyro."""
    kind = np.dtype(f"u{a.shape[1] // 8}").type
    one, last = kind(1), (n_a - 1).astype(kind)
    up, down = np.full(len(a), ~kind(0)), np.zeros(len(a), kind)
    score, out = n_a.copy(), n_a.copy()
    for j in range(int(n_b.max())):
        same = np.packbits(a == b[:, j, None], axis=1, bitorder="little").view(kind)[:, 0]
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(horizontal | up), up & horizontal
        score += ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
        plus, minus = (plus << one) | one, minus << one
        up, down = minus | ~(vertical | plus), plus & vertical
        out = np.where(n_b == j + 1, score, out)
    return out


class Words:
    """Letters, lengths and bit sets of some words side by side."""

    def __init__(self, words: Sequence[str], limit: float):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.bounds = _bounds(np.arange(self.lengths.max(initial=0) + 1), limit)
        self.starts = np.cumsum(self.lengths) - self.lengths
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        different, letter = np.unique(codes, return_inverse=True)
        # 0 and the largest value pad words
        self.all = (letter + 1).astype(np.min_scalar_type(len(different) + 1))
        owner = np.repeat(np.arange(len(words)), self.lengths)
        pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
        self.letters = self._bits(owner, letter)
        self.pairs = self._bits(owner[pair], letter[pair] * 31 + letter[pair + 1])

    def _bits(self, owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A set of 64 bits per word; ``owner`` is in order."""
        out = np.zeros(len(self.lengths), np.uint64)
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[owner[first]] = np.bitwise_or.reduceat(np.uint64(1) << (value & 63).astype(np.uint64), first)
        return out

    def codes(self, place: int) -> np.ndarray:
        return self.all[self.starts[place] : self.starts[place] + self.lengths[place]]

    def padded(self, places: np.ndarray, width: int, padding: int) -> np.ndarray:
        column = np.arange(width)
        given = self.all[np.minimum(self.starts[places][:, None] + column, len(self.all) - 1)]
        return np.where(column < self.lengths[places][:, None], given, self.all.dtype.type(padding))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of some pairs of words, in which a pair may come often, are more alike than the limit."""
        bound = self.bounds[np.maximum(self.lengths[a], self.lengths[b])]
        at = np.arange(len(a))
        # an edit settles at most one letter, and two pairs of letters, that the other word lacks
        for bits, most in ((self.letters, 1), (self.pairs, 2)):
            x, y, allowed = bits[a[at]], bits[b[at]], most * bound[at]
            at = at[(np.bitwise_count(x & ~y) <= allowed) & (np.bitwise_count(y & ~x) <= allowed)]
        count = len(self.lengths)
        different, back = np.unique(np.minimum(a[at], b[at]) * count + np.maximum(a[at], b[at]), return_inverse=True)
        near = np.zeros(len(a), bool)
        near[at] = self._alike(different // count, different % count)[back]
        return near

    def _alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        longest, shortest = np.maximum(self.lengths[i], self.lengths[j]), np.minimum(self.lengths[i], self.lengths[j])
        bound = self.bounds[longest]
        found = (i == j) & (bound >= 0)
        short = (longest <= WORD_BITS) & (shortest > 0) & (i != j)
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            chosen, step = np.flatnonzero(short & (longest > low) & (longest <= high)), max(1, PAIRS // high)
            for start in range(0, len(chosen), step):
                part = chosen[start : start + step]
                x, y = i[part], j[part]
                # paddings of both sides differ, so that they never match
                found[part] = _distances(self.padded(x, high, -1 % 256 ** self.all.itemsize), self.lengths[x], self.padded(y, high, 0), self.lengths[y]) <= bound[part]
        for k in np.flatnonzero(~short & (i != j)):
            found[k] = _long_distance(self.codes(i[k]), self.codes(j[k]), int(bound[k]))
        return found


def dissimilar_members(words: Sequence[str], member: np.ndarray, offsets: np.ndarray, limit: float, top: int) -> np.ndarray:
    """Places in ``member`` (lists of places among ``words``, from ``offsets`` on) of what each list takes in order.

    A word too similar to one already taken is skipped, until ``top`` are taken.  A round looks at the next words of all lists that
    are not through, some lists at a time.
    """
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    if limit >= 1:
        return _ranges(begin, np.minimum(end - begin, top))
    table = Words(words, limit)
    taken, at = np.zeros(len(member), bool), begin.copy()
    held = np.zeros(len(begin), np.int64)  # how many a list has taken
    while True:
        open_lists = np.flatnonzero((at < end) & (held < top))
        if not len(open_lists):
            return np.flatnonzero(taken)
        fresh = np.minimum(np.clip((top - held[open_lists]) * 5 // 4, LEAST, BLOCK), (end - at)[open_lists])
        work = np.cumsum((held[open_lists] + fresh) * fresh) // PAIRS
        cuts = np.flatnonzero(np.diff(work)) + 1
        for these, new in zip(np.split(open_lists, cuts), np.split(fresh, cuts)):
            _round(table, member, taken, begin[these], at[these], new)
        seen = _ranges(at[open_lists], fresh)
        owner = np.repeat(open_lists, fresh)
        ours = owner[taken[seen]]
        # those beyond the wanted number are put back
        rank = np.arange(len(ours)) - np.searchsorted(ours, ours) + held[ours]
        taken[seen[taken[seen]][rank >= top]] = False
        held += np.bincount(ours[rank < top], minlength=len(held))
        at[open_lists] += fresh


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range in turn."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _round(table: Words, member: np.ndarray, taken: np.ndarray, begin: np.ndarray, at: np.ndarray, new: np.ndarray) -> None:
    """Mark those of the next ``new`` words of some lists that are not too similar to one taken before them."""
    old = _ranges(begin, at - begin)
    old = old[taken[old]]
    fresh = _ranges(at, new)
    place = np.concatenate([old, fresh])
    # the list of an old one: the first whose next words come after
    of = np.concatenate([np.searchsorted(at, old, side="right"), np.repeat(np.arange(len(begin)), new)])
    # by list and length, words meet the shorter ones of their list that may be near
    length = table.lengths[member[place]]
    width = int(length.max()) + 1
    key = of * width + length
    order = key.argsort(kind="stable")
    key, place, word = key[order], place[order], member[place[order]]
    bound = table.bounds[length[order]]
    first = np.minimum(np.searchsorted(key, key - bound), np.arange(len(key)))
    # a shorter word may be of another list
    first = np.maximum(first, np.searchsorted(key, key // width * width))
    size = np.where(bound < 0, 0, np.arange(len(key)) - first)
    y = np.repeat(np.arange(len(key)), size)
    x = _ranges(first, size)
    near = table.near(word[x], word[y])
    x, y = place[x[near]], place[y[near]]
    x, y = np.minimum(x, y), np.maximum(x, y)
    by_later = np.lexsort((x, y))
    dropped: set[int] = set()
    for i, j in zip(x[by_later].tolist(), y[by_later].tolist()):
        if i not in dropped and not taken[j]:
            dropped.add(j)
    taken[fresh] = True
    taken[np.fromiter(dropped, np.int64, len(dropped))] = False


def dissimilar_places(words: Sequence[str], limit: float, top: int) -> list[int]:
    """Places of the words taken in order, skipping one too similar to a word already taken, until ``top`` are taken."""
    return dissimilar_members(words, np.arange(len(words)), np.array([0, len(words)]), limit, top).tolist()

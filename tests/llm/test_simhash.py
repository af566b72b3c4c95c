import itertools
import random

import numpy as np
from edges import docs, empty

from paperloom.llm import simhash
from paperloom.llm.components import components


def groups_of(values, radius):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_close_pair_meets_in_a_table():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        change = sum(1 << b for b in bits)
        assert any(not m & change for m in masks)


def test_links_equal_brute_force_also_when_buckets_are_cut(spark, monkeypatch):
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            v = center
            for b in rng.sample(range(64), rng.randint(0, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(signed(v) for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    want = groups_of(values, 3)
    for limit in (4096, 9):
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        got = dict(components(simhash.near_links(frame, 3)).collect())
        assert {v: got.get(v, v) for v in values} == want


def test_fingerprint_follows_its_definition():
    import xxhash

    def slow(text, k=3):
        words = text.encode().lower().split()
        parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if parts else 0

    for text in ["", " ", "One", "one TWO", "a b c", "a b c a b c a b c", "Ünï cödé x y\x1cz z", "w " * 500]:
        assert simhash.fingerprint(text.encode()) == slow(text)


def test_block_edges(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(300)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_edge_rows(spark):
    source = docs(spark)
    rows = simhash.near_duplicates(source).collect()
    assert len(rows) == source.count()
    prints = [signed(simhash.fingerprint((r.text or "").encode())) for r in source.collect()]
    assert sorted(r.fp for r in rows) == sorted(prints)
    ids = {}
    for r, fp in zip(source.collect(), prints):
        ids.setdefault(fp, []).append(r.doc_id)
    roots = groups_of(set(prints), 3)
    for r in rows:
        same = [i for fp, found in ids.items() if roots[fp] == roots[r.fp] for i in found if i is not None]
        assert r.component_id == min(same, default=None)
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(components(chain).collect())
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}
    assert components(chain.where("a < 0")).count() == 0


def test_numpy_counts_bits_of_all_64(spark):
    found = list(simhash._near(np.array([-1, -2, 1], np.int64), 3))
    assert found == [(-1, -2)] or found == [(-2, -1)]

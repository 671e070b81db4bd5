"""SimHash near-duplicates against all pairs; components against union-find."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lexigate.llm import simhash
from lexigate.llm.components import components


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A b C d", "x y z w " * 50, "é É ü Ü ß" * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def cluster(rng, n):
    """Fingerprints with planted neighbours, dense groups and equal values."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for base in out[:n // 4]:
        near = base
        for _ in range(rng.randint(1, 6)):
            near ^= 1 << rng.randrange(64)
        out.append(near)
    centre = rng.getrandbits(64)
    for _ in range(n):
        near = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            near ^= 1 << b
        out.append(near)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("block", [4096, 16])
def test_links_connect_exactly_the_near_ones(spark, block):
    fps = cluster(random.Random(block), 150)
    edges = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2)
             if int(fps[i] ^ fps[j]).bit_count() <= 4]
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.links(nodes, 4, block).collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    assert all(((r["u"] ^ r["v"]) & (2 ** 64 - 1)).bit_count() <= 4 for r in found)
    assert roots(len(fps), [(place[r["u"]], place[r["v"]]) for r in found]) == roots(len(fps), edges)


@pytest.mark.parametrize("limits", [[0, 0, 0, 0, 0], [1, 0, 1], [2, 1], [1, 2], [1, -1, 0, 1], [3, 0], [4, -1]])
def test_every_allocation_finds_all_pairs(spark, limits):
    assert sum(t + 1 for t in limits) == 5
    rng = np.random.default_rng(1)
    groups = [sorted(int(b) for b in g) for g in np.array_split(rng.permutation(64), max(len(limits), 4))][:len(limits)]
    if len(limits) < 4:  # few groups: narrow ones, so that the probes stay few; other bits equal
        groups = [g[:8] for g in groups]
    used = [b for g in groups for b in g]
    base = [int(x) for x in rng.integers(0, 2 ** 63, 6)]
    pairs = [(b, b ^ sum(1 << int(k) for k in rng.choice(used, rng.integers(0, 5), replace=False)))
             for b in base for _ in range(6)]
    fps = np.unique(np.array([x for p in pairs for x in p], dtype=np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    keys = {}
    for r in simhash.probe_keys(nodes, groups, limits).collect():
        keys.setdefault(r["fp"] & (2 ** 64 - 1), set()).add(r["key"])
    assert all(keys[a] & keys[b] for a, b in pairs)


def test_allocation_is_the_cheapest():
    rng = random.Random(3)
    cost = [[0.0] + [rng.random() * 100 for _ in range(5)] for _ in range(4)]
    total, chosen = simhash.allocate(cost, 4)
    every = [(sum(c[s] for c, s in zip(cost, steps)), [s - 1 for s in steps])
             for steps in itertools.product(range(6), repeat=4) if sum(steps) == 5]
    assert abs(total - min(every)[0]) < 1e-9 and sum(t + 1 for t in chosen) == 5


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + k) for k in range(1, 80)] + [(500, 500)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots(1200, edges)
    assert all(got.get(i, i) == want[i] for i in range(1200))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    fps = {r["doc_id"]: (r["fp"] & (2 ** 64 - 1), r["component_id"]) for r in got}
    for r in rows:
        assert fps[r["doc_id"]][0] == plain_fingerprint(r["text"])
    assert {fps[i][1] for i in (1, 2, 3)} == {1} and {fps[i][1] for i in (4, 5, 6)} == {4}
    kept = simhash.keep_one(odd_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids))
    assert 1 in ids and 4 in ids and not {2, 3, 5, 6} & set(ids)
    assert simhash.near_duplicates(no_docs.select("doc_id", "text")).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_keeps_a_row_of_every_group(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (9, d), (9, d), (None, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, a), (0, b), (5, c), (5, d)])

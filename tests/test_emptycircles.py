"""Edges with an empty circle, against a look at every third point, and on tables too dense to go through all pairs."""

import numpy as np
import pytest

from millrace.operators import emptycircles, placing
from millrace.plans import registry

RNG = np.random.default_rng(5)
GRID = np.stack([g.ravel() for g in np.meshgrid(np.arange(15) * 0.01, np.arange(15) * 0.01)])
TURN = np.linspace(0, 6.28, 200)
CASES = {
    "normal": (RNG.normal(0, 0.1, (2, 400)), 0.03),
    "all in reach": (RNG.normal(0, 0.1, (2, 300)), 10.0),
    "grid, with ties": (GRID, 0.03),
    "line": (np.stack([np.linspace(0, 1, 300), np.zeros(300)]), 0.5),
    "ring": (np.stack([np.cos(TURN), np.sin(TURN)]) * 0.1, 0.3),
    "two clusters": (np.concatenate([RNG.normal(0, 1e-3, (2, 150)), RNG.normal(0.02, 1e-3, (2, 150))], axis=1), 0.05),
    "closer than the digits": ((RNG.normal(0, 0.1, (2, 15, 1)) + RNG.normal(0, 1e-8, (2, 15, 8))).reshape(2, -1), 0.3),
    "far from the origin": (RNG.normal(0, 0.1, (2, 300)) + np.array([[1e6], [0]]), 0.03),
    "two": (np.array([[0, 0.1], [0, 0]]), 0.3),
}


def brute(x, y, longest, ids=None):
    ids, out = np.arange(len(x)) if ids is None else ids, set()
    for a in range(len(x)):
        for b in np.flatnonzero((ids > ids[a]) & (np.sqrt((x[a] - x) ** 2 + (y[a] - y) ** 2) <= longest)):
            both = (x[a] - x) ** 2 + (y[a] - y) ** 2 + (x[b] - x) ** 2 + (y[b] - y) ** 2
            inside = emptycircles.rounded(both) < emptycircles.rounded((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2)
            inside[[a, b]] = False
            if not inside.any():
                out.add((int(ids[a]), int(ids[b])))
    return out


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(case):
    (x, y), longest = CASES[case]
    n = np.arange(len(x))
    a, b, _ = emptycircles.edges(x, y, n >= 0, n, n, longest)
    assert len(a) == len(set(zip(a, b, strict=True)))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == brute(x, y, longest)


def test_copies_nulls_and_tiles(spark):
    """Copies of a place don't hide each other; points without finite coordinates take no part."""
    x, y = RNG.normal(0, 0.08, (2, 150))
    x, y = np.append(x, [x[0], x[0], x[1], 0.0, -0.0]), np.append(y, [y[0], y[0], y[1], 0.0, 0.0])
    ids = RNG.permutation(len(x))
    rows = [(int(i), float(p), float(q)) for i, p, q in zip(ids, x, y, strict=True)]
    odd = [(1000, None, 0.0), (1001, float("nan"), 0.0), (1002, 0.0, float("inf")), (None, 0.0, 0.0)]
    got = placing.gabriel_edges(spark.createDataFrame(rows + odd, "id long, x double, y double"), 0.03).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b) for r in got} == brute(x, y, 0.03, ids)
    at = {i: (p, q) for i, p, q in rows}
    assert all(abs(r.w - np.hypot(at[r.a][0] - at[r.b][0], at[r.a][1] - at[r.b][1])) < 1e-12 for r in got)


def test_thousands_within_reach_of_each_other(spark):
    """30,000 points in one tile: 450 million pairs in reach, of which some 60,000 are edges."""
    x, y = RNG.normal(0, 0.002, (2, 30_000))
    rows = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    got = placing.gabriel_edges(rows, 0.03).collect()
    assert 30_000 <= len(got) <= 3 * 30_000
    seen, picked = {(r.a, r.b) for r in got}, set(range(0, 30_000, 3000))
    for a in picked:
        d = (x - x[a]) ** 2 + (y - y[a]) ** 2
        for b in np.argsort(d)[1:40].tolist():
            inside = emptycircles.rounded(d + (x - x[b]) ** 2 + (y - y[b]) ** 2) < emptycircles.rounded(d[b])
            inside[[a, b]] = False
            assert ((min(a, b), max(a, b)) in seen) == (not inside.any())


def test_tiers_of_a_dense_table(spark, tmp_path):
    """4,000 points all in reach of each other: an edge has the highest tier that has it."""
    v = RNG.normal(0, 0.001, (4000, 2))
    rows = [(i, 0, [float(p), float(q)]) for i, (p, q) in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for k in (1, 2, 4):
        ids = np.arange(0, 4000, k)
        a, b, _ = emptycircles.edges(*v[ids].T.copy(), ids >= 0, ids, ids, 0.015 * k)
        want |= {(int(p), int(q)): k for p, q in zip(ids[a], ids[b], strict=True)}
    got = registry.load()[0]["tiered_network"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b): r.tier for r in got} == want and len(got) == len(want)

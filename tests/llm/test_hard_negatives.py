"""Hard negatives against a search over all pairs, and the bounds that leave blocks out."""

import math
import random

import numpy as np
import pytest

from terraloom.llm import hard_negatives as hn


def expected(rows, every=100, positives=5, negatives=10):
    use = {}
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        use[vec_id, label, tuple(math.floor(256 * v) for v in x)] = True
    rows = list(use)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for a, la, xa in rows:
        if a % every:
            continue
        scored = [(-dot(xa, x), i, lab) for i, lab, x in rows]
        for ps, p, _ in sorted(s for s in scored if s[2] == la and s[1] != a)[:positives]:
            fits = sorted(s for s in scored if s[2] != la and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, block int, keys string")
    return sorted(tuple(r) for r in hn.hard_negatives(df, **settings).collect())


def vector(draw, center=None, d=6):
    return [float(np.float32((center[i] if center else 0) + draw.gauss(0, 0.3))) for i in range(d)]


def test_random_vectors_ties_copies_and_odd_rows(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(5)], draw.randrange(4)) for i in range(700)]
    rows += [(i, [0.5] * 5, 1) for i in range(1000, 1300)]  # one very common vector
    rows += [(100, [0.5] * 5, 1), (100, [0.5] * 5, 1), (200, [9.0, -9.0], 2), (7, None, 1), (8, [None, 1.0], 1), (9, [float("nan")], 1), (11, [float("inf"), 1.0], 1),
             (None, [1.0], 1), (1400, [1.0] * 5, None), (300, [], 3), (1500, [1e9] * 5, 1)]
    want = expected([r for r in rows if r[0] != 1500])
    assert found(spark, rows) == want
    assert found(spark, rows, ranges=7) == want


def test_clustered_vectors_leave_blocks_out(spark, monkeypatch):
    draw = random.Random(4)
    centers = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = [(i, vector(draw, centers[i % 12]), (i % 12) % 5) for i in range(1200)]
    counts = []
    needed = hn.needed
    monkeypatch.setattr(hn, "needed", lambda a, z, same: counts.append((needed(a, z, same).count(), hn._met(a, z).selectExpr("sum(length(blocks) / 8)").first()[0])) or needed(a, z, same))
    assert found(spark, rows, ranges=40) == expected(rows)
    assert all(n < possible for n, possible in counts), counts


def test_empty_tables_and_no_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(0, [1.0], 1)]) == []


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_neighbours_on_the_curve_are_neighbours_in_space(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in hn.hilbert_keys(grid, bits)]
    assert len(set(keys)) == len(grid)
    walk = grid[sorted(range(len(grid)), key=lambda i: keys[i])]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_vector_of_a_box():
    draw = np.random.default_rng(1)
    x, a = draw.integers(-50, 50, (40, 8)), draw.integers(-50, 50, (5, 8))
    low, high = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = hn.scores(a, x)
    assert (low <= s.min(axis=1)[:, None]).all() and (high >= s.max(axis=1)[:, None]).all()
    big = np.full((1, 4), 1 << 27)
    assert hn.scores(big, big)[0, 0] == 4 << 54

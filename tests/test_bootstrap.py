"""Bootstraps over blocks: the matrix of wins, AUROC of replicates, paired differences, stored predictions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import models as L
from terraloom.operators.bootstrap import block_draws, block_wins, bootstrap_auroc, paired_f1


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    return [(f"b{draw.randrange(7)}", int(draw.random() < 0.4), draw.choice([0.1, 0.2, 0.2, draw.random()])) for _ in range(400)]


@pytest.mark.parametrize("ranges", [1, 3, 9])
def test_wins_between_blocks_match_all_pairs(spark, rows, ranges):
    df = spark.createDataFrame([*rows, ("b1", None, 0.5), ("b2", 1, None)], "block string, y int, score double")
    want = defaultdict(float)
    for a, ya, sa in rows:
        for b, yb, sb in rows:
            if ya == 1 and yb == 0 and sa >= sb:
                want[a, b] += 1.0 if sa > sb else 0.5
    assert {(r.a, r.b): r.wins for r in block_wins(df, "block", "y", "score", ranges).collect()} == want


def test_auroc_of_replicates(spark, rows):
    df = spark.createDataFrame(rows, "block string, y int, score double")
    weights = defaultdict(dict)
    for r in block_draws(df, "block", 200, 5).collect():
        weights[r.replicate][r.block] = r.weight
    values = []
    for w in weights.values():
        pos, neg = ([(s, w[b]) for b, y, s in rows if y == k and b in w] for k in (1, 0))
        pairs = sum(p for _, p in pos) * sum(n for _, n in neg)
        values.append(sum(p * n * ((s > t) + (s == t) / 2) for s, p in pos for t, n in neg) / pairs)
    got = bootstrap_auroc(df, "block", "y", "score", 200, 5).first()
    assert np.allclose([got.ci_low, got.ci_high], np.quantile(values, [0.025, 0.975])) and got.valid_reps == 200
    one = bootstrap_auroc(df.where("y = 1"), "block", "y", "score", 20, 5).first()
    assert one.valid_reps == 0 and one.ci_low is None


def test_paired_arms_equal_and_reversed_at_a_thousand_replicates(spark):
    y, blocks = [0, 1] * 4, [0, 0, 1, 1, 2, 2, 3, 3]
    for other, delta in (([float(v) for v in y], 0.0), ([1.0 - v for v in y], -1.0)):
        table = [(arm, s, b, v, p) for s in range(3) for arm, ps in (("a", [float(v) for v in y]), ("b", other)) for b, v, p in zip(blocks, y, ps)]
        df = spark.createDataFrame(table, "arm string, seed int, block int, y int, p double")
        got = paired_f1(df, ["seed"], "block", "arm", "a", "b", F.col("p") >= 0.5, F.col("y") == 1, 1000, 9).first()
        assert (got.delta_f1, got.ci_low, got.ci_high, got.valid_reps, got.n_blocks) == (delta, delta, delta, 1000, 4)


def test_changed_evaluation_rows_change_the_stored_answer(spark, tmp_path):
    draw = np.random.default_rng(1)
    table = lambda first, n, shift: spark.createDataFrame([(first + i, int(i % 2), i % 8, [float(v) for v in draw.normal(shift * (i % 2), 1, 3)]) for i in range(n)],
                                                         "id long, y int, block int, x array<double>").cache()
    pool, source, one, two = table(0, 80, 2), table(1000, 60, 2), table(2000, 20, 2), table(3000, 20, 2)
    grid = [{"regime": "distributed", "seed": 42, "budget": 20, "method": "target_only"}]
    run = lambda rows, src=source: sorted(map(tuple, L.few_shot_grid(spark, str(tmp_path), pool, rows, src, "id", "y", "block", "x", grid, 3).collect()))
    first = run(one)
    files = lambda: {p.name for p in tmp_path.iterdir() if not p.name.startswith(".")}
    made = files()
    assert run(one) == first and files() == made
    assert {r[0] for r in run(two)} == set(range(3000, 3020)) and len(files()) == 2 * len(made)
    stored = next(p for p in tmp_path.iterdir() if p.is_dir() and not p.name.endswith(".record") and spark.read.parquet(str(p)).first().id < 3000)
    spark.createDataFrame([(1, 1, 1, 0.5, "distributed", 42, 20, "target_only")], spark.read.parquet(str(stored)).schema).write.mode("overwrite").parquet(str(stored))
    assert run(one) == first  # damaged rows are not answered from

import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F
from terraloom.operators import bootstrap as B
from terraloom.operators import contracts as K
from terraloom.operators import metrics as M
from terraloom.operators import ordering


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), names)


def test_curve_endpoints(spark, path):
    df = frame(spark, y=[0, 0, 1, 1], p=[0.1] * 4, score=[0.0, 1.0, 2.0, 3.0])
    rows = M.selective_curve(df, [], "y", "p", "score").orderBy("k").collect()
    assert [r.risk for r in rows] == pytest.approx([0, 0, 1 / 3, 1 / 2])
    assert rows[-1].coverage == 1.0


def test_tied_curve_is_the_mean_over_all_orders(spark, path):
    y, p = [0, 1, 0, 1], [0.1, 0.1, 0.9, 0.9]
    wrong = [int((a >= 0.5) != (b == 1)) for a, b in zip(p, y)]
    want = np.mean([np.cumsum([wrong[i] for i in order]) / np.arange(1, 5) for order in itertools.permutations(range(4))], axis=0)
    rows = M.selective_curve(frame(spark, y=y, p=p, score=[7.0] * 4), [], "y", "p", "score").orderBy("k").collect()
    assert [r.risk for r in rows] == pytest.approx(want.tolist())


def test_long_tie_groups_are_expanded_in_spans(spark, monkeypatch):
    monkeypatch.setattr(M, "CURVE_STEP", 3)
    df = frame(spark, y=[0, 1] * 10, p=[0.1] * 20, score=[1.0] * 20)
    rows = M.selective_curve(df, [], "y", "p", "score").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 21)) and all(r.risk == pytest.approx(0.5) for r in rows)


def test_non_finite_scores_are_rejected(spark):
    with pytest.raises(Exception, match="finite"):
        M.selective_curve(frame(spark, y=[0, 1], p=[0.1, 0.2], score=[1.0, float("nan")]), [], "y", "p", "score").collect()


def test_operating_points_read_the_curve(spark):
    df = frame(spark, y=[0, 1, 0, 1, 1], p=[0.2, 0.1, 0.8, 0.9, 0.3], score=[1.0, 1.0, 2.0, 2.0, 3.0])
    curve = {r.k: r.risk for r in M.selective_curve(df, [], "y", "p", "score").collect()}
    for row in M.operating_points(df, [], "y", "p", "score", [0.1, 0.5, 1.0]).collect():
        assert row.k == max(1, math.ceil(row.requested * 5)) and row.risk == pytest.approx(curve[row.k])


def test_calibration_uses_literal_edges(spark):
    df = frame(spark, p=[0.3, 0.29, 0.7, 1.0])
    assert [r.b for r in df.select(M.bin_index(F.col("p"), 10).alias("b")).collect()] == [2, 2, 6, 9]


def test_rank_metrics(spark, path):
    df = frame(spark, y=[1, 0, 1, 0, 1], s=[0.9, 0.8, 0.8, 0.3, 0.2])
    row = M.rank_metrics(df, [], "y", "s").first()
    assert row.auroc == pytest.approx((2 + 1.5 + 0) / 6)
    assert row.auprc == pytest.approx((1 / 3) * 1 + (1 / 3) * (2 / 3) + (1 / 3) * (3 / 5))
    assert M.rank_metrics(df.where("y = 1"), [], "y", "s").first().auroc is None


def test_undefined_policies(spark):
    counts = frame(spark, tp=[0], fp=[0], fn=[0], tn=[5])
    null = counts.select(*[c.alias(n) for n, c in M.count_metrics("null").items()]).first()
    zero = counts.select(*[c.alias(n) for n, c in M.count_metrics("zero").items()]).first()
    assert null.f1 is None and null.precision is None and null.accuracy == 1.0
    assert zero.f1 == 0.0 and zero.balanced_accuracy == 0.5


def test_quantile_bins_keep_ties_together(spark, path):
    df = frame(spark, v=[1.0] * 6 + [2.0, 3.0, 4.0, 5.0])
    bins = {r.v: r.bin for r in M.quantile_bins(df, [], "v", 4).select("v", "bin").distinct().collect()}
    assert bins[1.0] == 0 and sorted(bins.values()) == [bins[v] for v in sorted(bins)]
    assert M.quantile_bins(frame(spark, v=[2.0] * 5), [], "v", 10).agg(F.max("bin")).first()[0] == 0


def test_spearman_with_ties(spark, path):
    a, b = [1.0, 2.0, 2.0, 4.0, 5.0], [2.0, 1.0, 3.0, 3.0, 5.0]
    ra, rb = [1, 2.5, 2.5, 4, 5], [2, 1, 3.5, 3.5, 5]
    got = M.spearman(frame(spark, a=a, b=b), [], "a", "b").first().spearman
    assert got == pytest.approx(np.corrcoef(ra, rb)[0, 1])


def test_identical_arms_have_no_difference(spark):
    rows = [(arm, 1, i % 4, i % 2, 0.9 if i % 3 else 0.1) for arm in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "arm string, seed int, block int, y int, p double")
    out = B.paired_f1(df, ["seed"], "block", "arm", "a", "b", F.col("p") >= 0.5, F.col("y") == 1, 30, 1).first()
    assert (out.delta_f1, out.ci_low, out.ci_high, out.n_blocks) == (0.0, 0.0, 0.0, 4)


def test_better_arm_is_positive(spark):
    rows = [("a", 1, i % 5, i % 2, 0.4) for i in range(50)] + [("b", 1, i % 5, i % 2, 0.9 if i % 2 else 0.1) for i in range(50)]
    df = spark.createDataFrame(rows, "arm string, seed int, block int, y int, p double")
    out = B.paired_f1(df, ["seed"], "block", "arm", "a", "b", F.col("p") >= 0.5, F.col("y") == 1, 30, 1).first()
    assert out.delta_f1 == 1.0 and out.ci_low == 1.0


def test_perfect_map_gives_exact_share(spark):
    strata = spark.createDataFrame([(0, 900), (1, 100)], "cls long, total long")
    sample = spark.createDataFrame([(c, c, s) for c in (0, 1) for s in range(1, 101)], "cls long, ref long, slot long")
    out = B.stratified_area(strata, sample, "cls", "ref", "slot", 1.0, 20, 3).first()
    assert (out.naive_area, out.adjusted_area, out.area_low, out.area_high) == (100.0, 100.0, 100.0, 100.0)


def test_positions_of_a_large_curve_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1)
    monkeypatch.setattr(M, "CURVE_STEP", 10)
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), (F.col("id") / 1000).alias("p"), (F.col("id") % 3).cast("double").alias("score"))
    curve = M.selective_curve(df, [], "y", "p", "score")
    assert curve.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.k for r in curve.collect()) == list(range(1, 1001))


def test_curve_grid_is_checked_position_by_position(spark):
    """Repeats, gaps, late starts and nulls, also across the ends of words of 64 positions."""
    grids = {"whole": list(range(1, 131)), "repeat": [*range(1, 129), 130, 130], "gap": [1, 2, 4], "sums": [1, 1, 4, 4, 5, 6], "late": [2, 3], "null": [1, 2, None]}
    df = spark.createDataFrame([(g, k, 0.5, 0.25) for g, ks in grids.items() for k in ks], "g string, k bigint, coverage double, risk double")
    got = {r.g: r for r in K.curve_invariants(df, ["g"]).collect()}
    for g, ks in grids.items():
        seen = [k for k in ks if k is not None]
        assert got[g].points == len(ks) and got[g].starts_at_one == (min(seen) == 1) and got[g].grid_complete == (max(seen) == len(ks) == len(set(seen)))
    plan = K.curve_invariants(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "_word" in plan

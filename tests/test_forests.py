import numpy as np
import pytest

from pyspark.sql import functions as F
from terraloom.operators import forests, metrics
from terraloom.operators import models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1200, 9)).round(2)
    y = (x[:, 0] + x[:, 3] * x[:, 4] + rng.normal(0, 0.5, 1200) > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(1200)], "id long, label long, x array<double>").cache()


def probabilities(model, rows):
    return np.array(rows.select("id", model.tree_probabilities()(F.col("x")).alias("p")).orderBy("id").toPandas()["p"].tolist())


def by_hand(seed, tree, node, bins, y, w, drawn, leaf, depth):
    """P(class 1) of each row by one plain recursion; twin leaves merged on the way up."""
    impure = lambda m: 2 * (a := (w * drawn)[m & (y == 0)].sum()) * (b := (w * drawn)[m & (y == 1)].sum()) / max(a + b, 1e-300)

    def visit(node, at, level):
        s1, s = (w * drawn)[at & (y == 1)].sum(), (w * drawn)[at].sum()
        best = (1e-12, None, None)
        if level < depth:
            for f in forests.node_features(seed, tree, np.array([node]), bins.shape[1])[0]:
                for b in range(forests.BINS - 1):
                    l, r = at & (bins[:, f] <= b), at & (bins[:, f] > b)
                    if drawn[l].sum() >= leaf and drawn[r].sum() >= leaf:
                        gain = (impure(at) - impure(l) - impure(r)) / s
                        best = max(best, (gain, -f, -b), key=lambda c: c[0])
        if best[1] is None:
            return {0: s1 / s}, np.zeros(len(y), int), s1 > s - s1
        l = bins[:, -best[1]] <= -best[2]
        (p, a, x), (q, b, z) = visit(2 * node, at & l, level + 1), visit(2 * node + 1, at & ~l, level + 1)
        if len(p) == len(q) == 1 and x == z:
            return {0: s1 / s}, np.zeros(len(y), int), s1 > s - s1
        return {**p, **{k + len(p): v for k, v in q.items()}}, np.where(l, a, b + len(p)), None

    p, leaves, _ = visit(node, np.ones(len(y), bool), 0)
    return np.array([p[i] for i in leaves])


def test_subtree_agrees_with_plain_recursion():
    rng = np.random.default_rng(2)
    bins, y, drawn = rng.integers(0, 6, (60, 5)).astype("uint8"), rng.integers(0, 2, 60).astype(float), rng.integers(1, 4, 60)
    w = rng.choice([0.5, 1.0, 2.0], 60)
    for depth in (30, 3):
        nodes = forests.grow(7, 2, 1, bins, y, w, drawn, 2, depth)
        found = nodes.set_index("node")
        got = []
        for row in bins:
            at = 1
            while found.feature[at] >= 0:
                at = 2 * at + int(row[found.feature[at]] > found.bin[at])
            got.append(found.s1[at] / (found.s0[at] + found.s1[at]))
        assert np.allclose(got, by_hand(7, 2, 1, bins, y, w, drawn, 2, depth)) and forests.level_of(nodes["node"]).max() <= depth


def test_the_size_of_a_task_does_not_change_the_forest(rows, monkeypatch):
    monkeypatch.setattr(L, "LIBRARY_ROWS", 1000)
    whole = probabilities(L.fit_forest(rows.withColumn("w", F.lit(1.0)), "label", "x", 4, 3, class_weights=False), rows)
    sizes = []
    grow = forests._grown
    monkeypatch.setattr(forests, "_grown", lambda *a: sizes.append(len(a[4])) or grow(*a))
    monkeypatch.setattr(forests, "NODE_ROWS", 100)
    cut = probabilities(L.fit_forest(rows.withColumn("w", F.lit(1.0)), "label", "x", 4, 3, class_weights=False), rows)
    assert sizes[0] > 20 and np.array_equal(whole, cut)


def test_many_rows_give_as_good_a_forest_as_the_library(rows, monkeypatch):
    train, test = rows.where("id < 900"), rows.where("id >= 900")
    auroc = lambda m: metrics.rank_metrics(L.score(m, test, "x"), [], "label", "p").first().auroc
    library = L.fit_forest(train, "label", "x", 20, 3)
    monkeypatch.setattr(L, "LIBRARY_ROWS", 800)
    monkeypatch.setattr(forests, "NODE_ROWS", 200)
    own = L.fit_forest(train, "label", "x", 20, 3)
    assert isinstance(own, forests.Forest) and abs(own.n_nodes / library.totalNumNodes - 1) < 0.15
    assert abs(auroc(own) - auroc(library)) < 0.03
    out = L.tree_uncertainty(own, test, "x").toPandas()
    assert np.allclose(out["p"], out["tree_mean"]) and out["vote_uncertainty"].between(0, 0.5).all() and (out["tree_variance"] > 0).any()


def test_equal_rows_that_cannot_be_split_stay_in_no_task(spark, monkeypatch):
    monkeypatch.setattr(L, "LIBRARY_ROWS", 100)
    monkeypatch.setattr(forests, "NODE_ROWS", 50)
    monkeypatch.setattr(forests, "_grown", lambda *a: pytest.fail("a large node went to one task"))
    same = spark.range(400).select("id", (F.col("id") % 4 == 0).cast("long").alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    p = probabilities(L.fit_forest(same.withColumn("w", F.lit(1.0)), "label", "x", 3, 1, class_weights=False), same)
    assert (abs(p - 0.25) < 0.1).all()


def test_trees_grown_together_are_those_grown_alone(monkeypatch):
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 20, (300, 6)).astype("uint8"), rng.integers(0, 2, 300).astype(float)
    w = np.where(y == 1, 0.5, 1.0) * np.where(np.arange(300) < 200, 1.0, 4.0)
    trees = np.arange(5)
    for rows, depth in ((96, 30), (0, 30), (10**6, 30), (20, 4)):  # sorted rows for small nodes, for none, for all
        monkeypatch.setattr(forests, "SORTED_ROWS", rows)
        together = forests.grow_trees(3, trees, bins, y, w, 2, depth)
        for t in trees:
            drawn = forests.drawn_times(3, t, np.arange(300))
            on = drawn > 0
            alone = forests.grow(3, t, 1, bins[on], y[on], w[on], drawn[on], 2, depth)
            assert np.allclose(together[together["tree"] == t][alone.columns].to_numpy(float), alone.to_numpy(float))
    monkeypatch.setattr(forests, "SORTED_PLACES", 512)  # few nodes at once
    assert forests.grow_trees(3, trees, bins, y, w, 2, depth).equals(together)
    p = forests.summed_probabilities(together, trees, bins) / len(trees)
    by_tree = np.mean([by_hand(3, t, 1, bins, y, w, forests.drawn_times(3, t, np.arange(300)), 2, 4) for t in trees], axis=0)
    assert np.allclose(p, by_tree)


def test_the_few_shot_queries_run_the_published_grid(spark, tmp_path, monkeypatch):
    from terraloom.plans import models as P

    asked = {}

    class Stop(Exception):
        pass

    def few_shot_grid(*args):
        asked["grid"], asked["trees"] = args[9], args[10]
        raise Stop

    monkeypatch.setattr(L, "few_shot_grid", few_shot_grid)
    sizes = {"i12_few_shot_grid": 2 * 30 * 5 * 2, "i14_label_budget_study": 30 * 5 * 2 + 30, "i20_repeated_adaptation_study": 2 * 30 * 5}
    from __spark_entry__ import queries

    for name, runs in sizes.items():
        with pytest.raises(Stop):
            queries()[name](spark, "/root/testdata/sf0.001")
        assert len(asked["grid"]) == runs and asked["trees"] == 300
        assert {g["seed"] for g in asked["grid"]} == set(range(42, 72))
        assert {g["budget"] for g in asked["grid"]} - {0} == {20, 50, 100, 200, 500}


@pytest.fixture(scope="module")
def study(spark):
    draw = np.random.default_rng(8)
    table = lambda first, n, shift: spark.createDataFrame([(first + i, int(i % 2), i % 8, [float(v) for v in draw.normal(shift * (i % 2), 1, 3)]) for i in range(n)],
                                                         "id long, y int, block int, x array<double>").cache()
    return table(0, 160, 1), table(1000, 120, 1), table(2000, 40, 1)


def test_a_run_gets_the_rows_that_its_sampler_draws(spark, study):
    from terraloom.operators.sampling import SAMPLERS

    pool = study[0]
    grid = [{"regime": g, "seed": s, "budget": b, "method": "joint"} for g in SAMPLERS for s in (42, 43) for b in (20, 50)]
    found = L.drawn_runs(spark, pool, "id", "y", "block", "x", grid, 3).join(pool.select("id", F.to_json("x").alias("k")), F.to_json("x") == F.col("k")).select("run", "id").collect()
    for i, g in enumerate(grid):
        alone = SAMPLERS[g["regime"]](pool, ["y"], "block", "id", g["budget"] // 2, g["seed"])
        assert sorted(r.id for r in found if r.run == i) == sorted(r.id for r in alone.select("id").collect()) and len([r for r in found if r.run == i]) == g["budget"]


def test_a_grid_too_large_for_one_task_is_as_whole(spark, study, tmp_path, monkeypatch):
    pool, source, rows = study
    grid = [{"regime": "distributed", "seed": 42, "budget": b, "method": m} for m in ("target_only", "joint") for b in (20, 50)]
    grid += [{"regime": "none", "seed": s, "budget": 0, "method": "source_only", "trees": 5} for s in (42, 43)]
    run = lambda folder: L.few_shot_grid(spark, str(tmp_path / folder), pool, rows, source, "id", "y", "block", "x", grid, 15).toPandas()
    together = run("a")
    monkeypatch.setattr(forests, "RUN_VALUES", 0)
    monkeypatch.setattr(forests, "fit_runs", lambda *a: pytest.fail("a large table went to one task"))
    alone = run("b")
    keys = ["regime", "seed", "budget", "method"]
    for out in (together, alone):
        assert len(out) == 6 * 40 and (out.groupby(keys).size() == 40).all() and out["p"].between(0, 1).all()
    hits = lambda out: ((out["p"] >= 0.5) == (out["y"] == 1)).groupby([out[k] for k in keys]).mean()
    assert (abs(hits(together) - hits(alone)) < 0.25).all() and hits(together).mean() > 0.6

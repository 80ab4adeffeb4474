import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F
from terraloom.operators import covariance as V
from terraloom.operators import neighbors as N
from terraloom.operators import parcels as P
from terraloom.operators.graph import cell_components, components


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("blocked", [False, True])
def test_neighbours_match_brute_force(spark, monkeypatch, metric, blocked):
    if blocked:
        monkeypatch.setattr(N, "BROADCAST_VALUES", 0)
        monkeypatch.setattr(N, "CHUNK_ROWS", 13)
    rng = np.random.default_rng(1)
    q, s = rng.normal(size=(30, 5)), rng.normal(size=(47, 5))
    s[10] = s[3]  # exact tie: the lower id must win
    got = N.knn(vectors(spark, q), vectors(spark, s, 1000), "id", "x", 3, metric).orderBy("query_id", "rank").toPandas()
    if metric == "cosine":
        dist = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (s / np.linalg.norm(s, axis=1, keepdims=True)).T
    else:
        dist = np.sqrt(((q[:, None] - s[None]) ** 2).sum(2))
    order = np.array([np.lexsort((np.arange(47), np.round(row, 12)))[:3] for row in dist])
    assert (got["neighbor_id"].to_numpy().reshape(30, 3) == order + 1000).all()
    assert np.allclose(got["distance"].to_numpy().reshape(30, 3), np.take_along_axis(dist, order, 1))


def test_mahalanobis_and_shrinkage(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    z = x - x.mean(0)
    s, p = z.T @ z / 60, 4
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / 60**2 / p)
    want = (1 - b2 / d2) * s + b2 / d2 * m * np.eye(p)
    mean, cov, shrink = V.shrunk_covariance(vectors(spark, x).repartition(3), "x")
    assert np.allclose(cov, want) and shrink == pytest.approx(b2 / d2)
    got = V.mahalanobis(vectors(spark, x), vectors(spark, x), "x").orderBy("id").toPandas()["mahalanobis"]
    assert np.allclose(got, np.sqrt(np.einsum("ni,ij,nj->n", z, np.linalg.inv(want), z)))


def test_coral_survives_singular_input_and_moves_the_mean(spark):
    source = np.array([[1.0, 2.0, 2.0], [1.0, 4.0, 4.0], [1.0, 9.0, 9.0]])
    out = V.coral(vectors(spark, source), vectors(spark, source + 4), "x").toPandas()["x"]
    moved = np.array(out.tolist())
    assert np.isfinite(moved).all() and np.allclose(moved.mean(0), (source + 4).mean(0))


def test_components_with_hub_and_long_chain(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(80)] + [(500, 501)]
    nodes = sorted({v for e in edges for v in e} | {900})
    got = components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"))
    comp = {r.id: r.comp for r in got.collect()}
    assert all(comp[i] == 0 for i in range(60)) and all(comp[100 + i] == 100 for i in range(81))
    assert comp[501] == 500 and comp[900] == 900


def test_cell_components_by_connectivity_and_group(spark):
    cells = [("g", 0, 0), ("g", 0, 1), ("g", 1, 2), ("g", 3, 0), ("h", 1, 1)]
    df = spark.createDataFrame(cells, "z string, row long, col long")
    eight = {(r.z, r.row, r.col): r.size for r in cell_components(df, ["z"]).collect()}
    assert eight[("g", 1, 2)] == 3 and eight[("g", 3, 0)] == 1 and eight[("h", 1, 1)] == 1
    four = {(r.z, r.row, r.col): r.size for r in cell_components(df, ["z"], [(-1, 0), (1, 0), (0, -1), (0, 1)]).collect()}
    assert four[("g", 0, 0)] == 2 and four[("g", 1, 2)] == 1


def test_points_in_ring(spark):
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (40.0, 0.0), (40.0, 20.0), (0.0, 20.0), (0.0, 0.0)])], "ring_id int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame(pd.DataFrame({"x": [1.0, 39.5, 41.0, 20.0], "y": [1.0, 19.0, 5.0, 20.5]}))
    assert sorted(r.x for r in P.points_in_rings(points, ring).collect()) == [1.0, 39.5]


def test_reason_strings_are_ordered_and_unique(spark):
    base = dict(area=600000.0, water=0.85, built=0.0, trees=0.5, bare=0.0, repaired_area=100.0, participant=True, deployment_edge=True, tile_disagreement=0.3)
    df = spark.createDataFrame([tuple(base.values())], list(base))
    row = df.select(*[c.alias(n) for n, c in P.safeguard_reasons().items()]).withColumn("s", P.mapping_status()).first()
    assert row.exclusion == "water_dominant;tidal_flat_like;extreme_area;cross_tile_overlap"
    assert row.geometry_risk == "extreme_area;cross_tile_overlap;deployment_edge;high_tile_disagreement"
    assert row.cover_risk == "water_dominant;tree_dominant;tidal_flat_like" and row.s == "excluded"
    assert F is not None


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_distant_cells_are_not_met(spark, monkeypatch, metric):
    monkeypatch.setattr(N, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(N, "CHUNK_ROWS", 25)
    counts, near = [], N.near_cells
    monkeypatch.setattr(N, "near_cells", lambda p, q, s, k: counts.append((len(near(p, q, s, k)), len(q) * len(s))) or near(p, q, s, k))
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 5)) * 8
    q, s = (np.concatenate([c + rng.normal(size=(n, 5)) * 0.2 for c in centers]) for n in (10, 60))
    s[5], q[3], s[9] = s[4], 0, 0
    got = N.knn(vectors(spark, q), vectors(spark, s, 1000), "id", "x", 4, metric).orderBy("query_id", "rank").toPandas()
    if metric == "cosine":
        unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
        dist = 1 - unit(q) @ unit(s).T
    else:
        dist = np.sqrt(((q[:, None] - s[None]) ** 2).sum(2))
    order = np.array([np.lexsort((np.arange(len(s)), np.round(row, 12)))[:4] for row in dist])
    assert (got["neighbor_id"].to_numpy().reshape(-1, 4) == order + 1000).all()
    met, possible = counts[0]
    assert met < possible / 2


def test_focal_counts_of_a_large_grid_keep_their_partitions(spark, monkeypatch):
    from terraloom.operators import ordering, raster

    grid = spark.range(600).select(F.floor(F.col("id") / 30).alias("row"), (F.col("id") % 30).alias("col"))
    count = lambda: raster.focal_count(grid, (F.col("row") + F.col("col")) % 3 == 0, raster.CROSS)
    want = sorted(map(tuple, count().collect()))
    monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1)
    assert sorted(map(tuple, count().collect())) == want
    assert count().rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

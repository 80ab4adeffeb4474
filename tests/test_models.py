import numpy as np
import pytest

from pyspark.sql import functions as F
from terraloom.operators import models as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(240):
        label = int(rng.random() < 0.3)
        data.append((i, label, i % 8, [float(v) for v in rng.normal(label, 1.0, 4)]))
    return spark.createDataFrame(data, "id long, label long, block long, x array<double>").cache()


def test_trees_average_to_the_forest(rows):
    model = L.fit_forest(rows, "label", "x", 7, 1)
    out = L.tree_uncertainty(model, rows, "x").toPandas()
    assert np.allclose(out["p"], out["tree_mean"]) and (out["tree_variance"] >= 0).all() and out["vote_uncertainty"].between(0, 0.5).all()


def test_balanced_and_joint_weights(rows):
    sums = {r.label: r.w for r in L.balanced(rows, "label").groupBy("label").agg(F.sum("w").alias("w")).collect()}
    assert sums[0] == pytest.approx(120) and sums[1] == pytest.approx(120)
    joint = L.joint_weights(rows.where("id < 60"), rows.where("id >= 60"))
    assert joint.where("id >= 60").agg(F.sum("w")).first()[0] == pytest.approx(60)


def test_importance_weights_are_normalised_and_complete(rows):
    source, pool = rows.where("id < 80"), rows.where("id >= 80").withColumn("x", F.transform("x", lambda v: v + 0.5))
    out = L.importance_weights(source, pool, "id", "block", "x", folds=3).toPandas()
    assert len(out) == 80 and out["w"].mean() == pytest.approx(1.0) and out["clipped"].between(0.1, 10).all()


def test_permutation_keeps_the_label_counts(rows):
    out = L.permute_labels(rows.select("id", "label"), "id", "label", 5)
    assert out.count() == 240 and out.agg(F.sum("label")).first() == rows.agg(F.sum("label")).first()
    assert out.join(rows.select("id", F.col("label").alias("old")), "id").where("label <> old").count() > 0


def test_map_scoring_marks_thin_pixels(spark, rows):
    model = L.fit_forest(rows, "label", "x", 5, 1)
    pixels = spark.createDataFrame([(0, 0, [1.0, 1.0, 1.0, 1.0]), (0, 1, [1.0, None, None, None])], "row long, col long, x array<double>")
    out = {r.col: r for r in L.score_map(model, pixels, "x", F.array(*[F.lit(0.0)] * 4), 3).collect()}
    assert out[1].p == -9999.0 and out[1]["class"] == 255 and 0 <= out[0].p <= 1


def test_recalibration_improves_a_distorted_score(rows):
    model = L.fit_forest(rows, "label", "x", 5, 1)
    scored = L.score(model, rows, "x").withColumn("p", F.pow("p", 4.0)).cache()
    out = L.platt(scored, scored, "label", "p")
    brier = lambda c: out.agg(F.avg(F.pow(F.col(c) - F.col("label"), 2))).first()[0]
    assert brier("p_calibrated") < brier("p")

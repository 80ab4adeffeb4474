"""Cases that an earlier version answered wrongly: late duplicates, absent classes, near ties, zero vectors, ambiguous digests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions.hashing import row_digest
from terraloom.operators import neighbors as N
from terraloom.operators import sampling as S
from terraloom.sources.files import scratch
from terraloom.streaming.ingest import reject_duplicates


def test_no_row_is_lost_to_file_order(spark):
    draw = random.Random(1)
    rows = [(i % 300, f"2024-01-{1 + draw.randrange(28):02d} 00:00:00", i) for i in range(900)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, t string, v long").withColumn("t", F.col("t").cast("timestamp"))
    incoming, out = scratch(spark, "in"), scratch(spark, "out")
    for at in range(0, 900, 100):
        df.where(f"pmod(hash(v), 9) = {at // 100}").coalesce(1).write.mode("append").parquet(incoming)
    got = reject_duplicates(spark, incoming, df.schema, "k", "t", out, files_per_batch=2)
    assert sorted(r.k for r in got.collect()) == list(range(300))
    assert reject_duplicates(spark, incoming, df.schema, "k", "t", out).count() == 300


@pytest.mark.parametrize("draw", [
    lambda df: S.balanced_draw(df, "distributed", "c", "b", "id", 20, 1),
    lambda df: S.balanced_draw(df, "clustered", "c", "b", "id", 20, 1),
    lambda df: S.matched_by_class(df, "c", "id", {0: 5, 1: 50}, 1),
    lambda df: S.group_split(df, "b", "c", 0.5, 1),
    lambda df: S.require_rows(df.where("false"), "c", {0: 1}),
])
def test_short_or_absent_classes_are_errors(spark, draw):
    df = spark.range(60).select("id", F.lit(0).cast("bigint").alias("c"), (F.col("id") % 6).alias("b"))
    with pytest.raises(Exception, match="rows with c|none of"):
        draw(df).collect()


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def test_far_from_the_origin_the_identical_point_is_nearest(spark):
    base = np.array([1e5, 1e5])
    got = N.knn(vectors(spark, [base]), vectors(spark, [base + [1e-3, 0], base, base + [0, 1]]), "id", "x", 1, "euclidean").collect()
    assert [(r.neighbor_id, r.distance) for r in got] == [(1, 0.0)]


def test_zero_vectors_are_at_cosine_distance_one(spark):
    got = N.knn(vectors(spark, [[1, 0], [0, 0]]), vectors(spark, [[0, 0], [1, 1], [1, 0]]), "id", "x", 3, "cosine").orderBy("query_id", "rank").collect()
    assert [r.neighbor_id for r in got] == [2, 1, 0, 0, 1, 2] and [r.distance for r in got if r.query_id == 1] == [1.0, 1.0, 1.0]


def test_digests_tell_values_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("", "")], "x string, y string")
    assert df.select(row_digest("x", "y").alias("d")).distinct().count() == 5

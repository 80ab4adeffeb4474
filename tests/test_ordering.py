import numpy as np
import pandas as pd

from pyspark.sql import functions as F
from terraloom.operators.ordering import exact_quantiles, ranked_rows, running_totals, top_rows


def skewed(spark, n=4000):
    """One key holds most rows and one value holds a third of that key."""
    rng = np.random.default_rng(0)
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.random(n), 3))
    frame = pd.DataFrame({"id": rng.permutation(n), "key": key, "value": value})
    return frame, spark.createDataFrame(frame).repartition(7)


def test_ranks_with_hot_key_and_hot_value(spark, path):
    frame, df = skewed(spark)
    got = ranked_rows(df, ["key"], F.col("value"), F.col("id"), "rank", "size").toPandas().sort_values("id")
    want = frame.sort_values(["key", "value", "id"])
    want["rank"] = want.groupby("key").cumcount() + 1
    want = want.sort_values("id")
    assert (got["rank"].to_numpy() == want["rank"].to_numpy()).all()
    assert (got["size"].to_numpy() == want.groupby("key")["id"].transform("size").to_numpy()).all()


def test_ranks_without_key_and_descending(spark, path):
    frame, df = skewed(spark, 900)
    got = ranked_rows(df, [], -F.col("value"), F.col("id")).orderBy("rank").toPandas()
    want = frame.sort_values(["value", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist()


def test_running_totals(spark, path):
    frame, df = skewed(spark)
    grouped = df.groupBy("key", "value").agg(F.count("*").alias("n"))
    got = running_totals(grouped, ["key"], "value", ["n"]).toPandas().sort_values(["key", "value"])
    want = frame.groupby(["key", "value"]).size().rename("n").reset_index()
    cum = want.groupby("key")["n"].cumsum() - want["n"]
    assert (got["before_n"].to_numpy() == cum.to_numpy()).all()
    assert (got["total_n"].to_numpy() == want.groupby("key")["n"].transform("sum").to_numpy()).all()


def test_quantiles_match_numpy(spark, path):
    frame, df = skewed(spark)
    with_nulls = df.unionByName(df.limit(50).withColumn("value", F.lit(None).cast("double")))
    got = exact_quantiles(with_nulls, ["key"], "value", {"a": 0.0, "b": 0.137, "c": 0.5, "d": 1.0}).toPandas().set_index("key")
    for key, group in frame.groupby("key"):
        assert np.allclose(got.loc[key].to_numpy(dtype=float), np.quantile(group["value"], [0, 0.137, 0.5, 1]))


def test_weighted_quantiles(spark, path):
    df = spark.createDataFrame([("k", 1.0, 3), ("k", 2.0, 1), ("k", 9.0, 2)], "key string, value double, n long")
    got = exact_quantiles(df, ["key"], "value", {"m": 0.5, "q": 0.9}, weight="n").first()
    assert np.allclose([got.m, got.q], np.quantile([1, 1, 1, 2, 9, 9], [0.5, 0.9]))


def test_top_rows_beyond_the_group_limit(spark, path):
    frame, df = skewed(spark)
    small = top_rows(df, ["key"], F.col("value"), F.col("id"), 5).toPandas()
    large = top_rows(df, ["key"], F.col("value"), F.col("id"), 1500).toPandas()
    order = frame.sort_values(["key", "value", "id"])
    assert set(small["id"]) == set(order.groupby("key").head(5)["id"])
    assert set(large["id"]) == set(order.groupby("key").head(1500)["id"])


def test_any_bucket_count_gives_the_same_ranks(spark, monkeypatch):
    from terraloom.operators import ordering

    monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1)
    monkeypatch.setattr(ordering, "PLAIN_WINDOW_ROWS", -1)
    frame, df = skewed(spark, 1500)
    want = frame.sort_values(["key", "value", "id"]).groupby("key").cumcount().sort_index() + 1
    expected = dict(zip(frame["id"], want.reindex(frame.index)))
    for buckets in (2, 3, 5, 37, 200):
        got = ranked_rows(df, ["key"], F.col("value"), F.col("id"), buckets=buckets).select("id", "rank").collect()
        assert {r.id: r["rank"] for r in got} == expected
        q = exact_quantiles(df, [], "value", {"m": 0.61}, buckets=buckets).first().m
        assert abs(q - np.quantile(frame["value"], 0.61)) < 1e-12

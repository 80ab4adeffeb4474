import pytest

from pyspark.sql import functions as F
from terraloom.operators import sampling as S
from terraloom.operators import temporal as T


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(100 + i, i % 2, f"b{(i // 2) % 4}") for i in range(40)]
    return spark.createDataFrame(rows, "id long, label int, block string")


@pytest.mark.parametrize("regime", ["distributed", "clustered"])
def test_draws_are_balanced_and_repeatable(pool, regime):
    first = {r.id for r in S.balanced_draw(pool, regime, "label", "block", "id", 8, 42).collect()}
    again = S.balanced_draw(pool.repartition(5), regime, "label", "block", "id", 8, 42)
    assert {r.id for r in again.collect()} == first and len(first) == 8
    assert {r.label: r["count"] for r in again.groupBy("label").count().collect()} == {0: 4, 1: 4}
    blocks = again.groupBy("label").agg(F.countDistinct("block").alias("n")).collect()
    assert all(r.n == (4 if regime == "distributed" else 1) for r in blocks)


def test_short_class_is_an_error(pool):
    with pytest.raises(Exception, match="fewer than"):
        S.balanced_draw(pool, "distributed", "label", "block", "id", 60, 1).collect()


def test_blocks_first_uses_every_block(pool):
    out = S.blocks_first(pool, ["label"], "block", "id", 5, 3)
    assert all(r.n == 4 for r in out.groupBy("label").agg(F.countDistinct("block").alias("n")).collect())


def test_allocation_sums_and_limits(spark, path):
    sizes = {"a": 70, "b": 20, "c": 6, "d": 3, "e": 1}
    df = spark.createDataFrame([(k, i) for k, n in sizes.items() for i in range(n)], "g string, i long")
    for n in (3, 5, 7, 33, 99, 100, 200):
        take = {r.g: r.take for r in S.proportional_allocation(df, "g", n).collect()}
        assert sum(take.values()) == min(n, 100) and all(take[k] <= sizes[k] for k in sizes)
        if n >= 5:
            assert min(take.values()) >= 1


def test_group_split_is_disjoint_with_both_classes(spark):
    df = spark.createDataFrame([(i % 10, int(i % 10 in (1, 3, 5) and i % 3 > 0)) for i in range(300)], "block long, label long")
    split = S.train_val_test(df, "block", "label", 0.2, 0.2, 7, tries=20)
    assert split.count() == 10 and split.select("block").distinct().count() == 10
    per = df.join(split, "block").groupBy("split").agg(F.countDistinct("label").alias("n")).collect()
    assert {r.split for r in per} == {"train", "val", "test"} and all(r.n == 2 for r in per)


def test_folds_never_share_a_group(spark, path):
    df = spark.createDataFrame([(f"g{i % 13}",) for i in range(200)], "g string")
    folds = S.group_folds(df, "g", 5)
    assert folds.count() == 13 and folds.select("fold").distinct().count() == 5


def test_all_missing_column_gets_zero_median(spark, path):
    df = spark.createDataFrame([([1.0, None], True), ([3.0, None], True), ([100.0, 5.0], False)], "x array<double>, train boolean")
    medians = T.train_medians(df, F.col("train"), "x", 2)
    assert medians.first().medians == [2.0, 0.0]
    assert T.impute(spark.createDataFrame([([None, None],)], "x array<double>"), medians, "x").first().x == [2.0, 0.0]


def test_windows_overlap_and_exclude_their_end(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, "2024-01-02 23:59:59")], "id int, t string").select("id", F.to_timestamp_ntz("t").alias("t"))
    windows = spark.createDataFrame([("a", "2024-01-01", "2024-01-03"), ("b", "2024-01-02", "2024-01-05")], "tag string, s string, e string").select(
        "tag", F.to_timestamp_ntz("s").alias("start"), F.to_timestamp_ntz("e").alias("end"))
    got = sorted((r.id, r.tag) for r in T.interval_join(df, "t", windows).collect())
    assert got == [(1, "a"), (2, "b"), (3, "a"), (3, "b")]

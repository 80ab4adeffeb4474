"""Checks that describe what must hold, as tables of (check_name, ok, observed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_table(wide: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One-row aggregate -> one row per check."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("check_name"), ok.alias("ok"), observed.cast("bigint").alias("observed")) for name, (ok, observed) in checks.items()]))
    return wide.select(rows.alias("c")).select("c.*")


def enforce(checks: DataFrame) -> None:
    """Raise with the names of failed checks (the table has one row per check)."""
    failed = [row.check_name for row in checks.where(~F.col("ok")).collect()]
    if failed:
        raise ValueError("failed checks: " + ", ".join(failed))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def groups_crossing(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def duplicate_audit(df: DataFrame, keys: list[str], digest: str, group: str) -> DataFrame:
    """Rows in duplicated keys, in duplicated feature vectors, and in vectors that occur in several groups."""
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("v"))
    by_row = df.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), (F.min(group) != F.max(group)).alias("cross"))
    by_row = by_row.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("v"), F.sum(F.when(F.col("cross"), F.col("n")).otherwise(0)).alias("x"))
    line = lambda df, name, c: df.select(F.lit(name).alias("check_name"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n_rows"))
    rows = F.explode(F.array(F.struct(F.lit("duplicate_features").alias("check_name"), F.coalesce("v", F.lit(0)).cast("bigint").alias("n_rows")),
                             F.struct(F.lit("features_crossing_blocks").alias("check_name"), F.coalesce("x", F.lit(0)).cast("bigint").alias("n_rows"))))
    return line(by_key, "duplicate_keys", F.col("v")).unionByName(by_row.select(rows.alias("r")).select("r.*"))


def manifest_contract(df: DataFrame) -> DataFrame:
    """Key uniqueness, block-disjoint splits, binary classes, split names consistent with the region."""
    rows = df.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("class_id").isin(0, 1)).alias("bad_class"),
        F.count_if((F.col("region") == "source") != F.col("split").startswith("source_")).alias("bad_region"))
    wide = rows.agg((F.sum("n") - F.count(F.lit(1))).alias("dup"), F.sum("bad_class").alias("cls"), F.sum("bad_region").alias("reg"))
    leaks = df.groupBy("region", "block").agg((F.min("split") != F.max("split")).alias("leak")).agg(F.count_if(F.col("leak")).alias("leaks"))
    return check_table(wide, {
        "unique_key": (F.col("dup") == 0, F.col("dup")), "binary_classes": (F.col("cls") == 0, F.col("cls")),
        "region_matches_split": (F.col("reg") == 0, F.col("reg")),
    }).unionByName(check_table(leaks, {"block_disjoint": (F.col("leaks") == 0, F.col("leaks"))}))


def draw_contract(draw: DataFrame, pool: DataFrame, row: str, label: str, budget: int) -> DataFrame:
    """Size, uniqueness, balance and pool membership of a draw."""
    wide = draw.groupBy(row).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"), F.sum("pos").alias("pos"))
    strangers = draw.join(pool.select(row), row, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return check_table(wide, {
        "size": (F.col("n") == budget, F.col("n")), "unique": (F.col("n") == F.col("u"), F.col("u")),
        "balanced": (F.col("pos") * 2 == F.col("n"), F.col("pos")),
    }).unionByName(check_table(strangers, {"pool_only": (F.col("n") == 0, F.col("n"))}))


def nonempty_splits(df: DataFrame, split: str, names: list[str]) -> DataFrame:
    """Keep the named splits; fail when one of them has no row."""
    from terraloom.operators.attach import attach

    kept = df.where(F.col(split).isin(names))
    seen = kept.agg(*[F.count_if(F.col(split) == n).alias(f"_n{i}") for i, n in enumerate(names)]).select(
        F.least(*[F.col(f"_n{i}") for i in range(len(names))] or [F.lit(1)], F.lit(1).cast("bigint")).alias("_least"))
    return attach(kept, seen, []).where(
        F.when(F.col("_least") < 1, F.raise_error(F.lit("a requested split is empty")).cast("boolean")).otherwise(True)).drop("_least")


def unique_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails when a key repeats on either side."""
    from terraloom.operators.attach import attach

    repeats = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
    worst = repeats(left).unionByName(repeats(right)).agg(F.max("n").alias("_most"))
    ok = F.when(F.coalesce("_most", F.lit(0)) <= 1, True).otherwise(F.raise_error(F.lit("join key is not one to one")).cast("boolean"))
    return attach(left.join(right, keys), worst, []).where(ok).drop("_most")


def agreement(new: DataFrame, old: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Recomputed against saved values: matched rows, largest difference, and whether it is within tolerance."""
    both = new.select(*keys, F.col(value).alias("_a")).join(old.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(gap).alias("matched"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
                    F.max(gap).alias("max_difference"), (F.coalesce(F.max(gap), F.lit(0.0)) <= tolerance).alias("within"))


def ledger_check(ledger: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """verified / changed / missing / unexpected per file of a recorded ledger and the current inventory."""
    both = ledger.select(key, F.col(digest).alias("_old")).join(current.select(key, F.col(digest).alias("_new")), key, "full_outer")
    state = F.when(F.col("_old").isNull(), "unexpected").when(F.col("_new").isNull(), "missing").when(F.col("_old") == F.col("_new"), "verified").otherwise("changed")
    return both.select(key, state.alias("state"))


def inventory_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows only expected ("missing") or only found ("unexpected"), duplicates counted."""
    return expected.exceptAll(actual).withColumn("kind", F.lit("missing")).unionByName(actual.exceptAll(expected).withColumn("kind", F.lit("unexpected")))


def chunk_contract(chunk: DataFrame, manifest: DataFrame, row: str, region: str, numbers: list[str], start: int, stop: int) -> DataFrame:
    """Exact integral keys start..stop-1, once each, with the manifest's region, and finite numbers."""
    key = F.col(row)
    per_key = chunk.withColumn("_k", F.floor(key).cast("bigint")).withColumn("_frac", key != F.floor(key)).groupBy("_k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_frac")).alias("frac"), F.min(region).alias("_lo"), F.max(region).alias("_hi"),
        F.count_if(F.greatest(*[F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in numbers], F.lit(False))).alias("bad"))
    wanted = manifest.where((F.col(row) >= start) & (F.col(row) < stop)).select(F.col(row).cast("bigint").alias("_k"), F.lower(region).alias("_want"))
    joined = per_key.join(wanted, "_k", "full_outer")
    wide = joined.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("foreign"), F.count_if(F.col("n") > 1).alias("dup"),
        F.coalesce(F.sum("frac"), F.lit(0)).alias("frac"), F.count_if((F.lower("_lo") != F.col("_want")) | (F.lower("_hi") != F.col("_want"))).alias("region"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    names = {"no_missing_keys": "missing", "no_foreign_keys": "foreign", "no_duplicate_keys": "dup", "integral_keys": "frac", "region_identity": "region", "finite_values": "bad"}
    return check_table(wide, {n: (F.col(c) == 0, F.col(c)) for n, c in names.items()})


def grid_alignment(profiles: DataFrame, reference: DataFrame) -> DataFrame:
    """Per product: which of shape, transform and CRS differ from the reference grid."""
    from terraloom.operators.attach import attach

    names = ["crs", "shape", "transform"]
    ref = reference.select(*[F.col(c).alias(f"_{c}") for c in names])
    issues = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in names])), ";")
    return attach(profiles, ref, []).select("product", issues.alias("mismatches"), (issues == "").alias("aligned"))


def curve_invariants(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Per curve: coverage grid exact, last coverage 1, first and last k.

    Distinct k are counted as bits of words that stand for 64 positions each, so a task groups a 64th of its points.
    """
    k = F.col("k").cast("bigint")
    words = curve.withColumn("_word", F.shiftright(k, 6)).groupBy(*keys, "_word").agg(
        F.count(F.lit(1)).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.max_by("coverage", k).alias("coverage"), F.max_by("risk", k).alias("risk"),
        F.sum("risk").alias("sum"), F.count("risk").alias("risks"),
        F.bit_or(F.expr("shiftleft(1L, CAST(CAST(k AS BIGINT) & 63 AS INT))")).alias("bits"))
    n = F.sum("n")
    distinct = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return words.groupBy(*keys).agg(
        n.alias("points"), (F.min("lo") == 1).alias("starts_at_one"), ((F.max("hi") == n) & (distinct == n)).alias("grid_complete"),
        F.max_by("coverage", "hi").alias("last_coverage"), F.max_by("risk", "hi").alias("last_risk"), (F.sum("sum") / F.sum("risks")).alias("aurc"))


def same_config(configs: DataFrame, retired: list[str]) -> DataFrame:
    """Compare two config maps per row after dropping retired keys."""
    live = lambda c: F.map_filter(c, lambda k, v: ~k.isin(retired))
    text = lambda c: F.to_json(F.array_sort(F.map_entries(live(c))))
    return configs.withColumn("same", text(F.col("a")) == text(F.col("b")))

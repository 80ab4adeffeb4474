"""Parcels as cell sets: overlap, ownership, reconciliation, repair, zonal statistics and QA rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.attach import attach
from terraloom.operators.blocks import OPEN, SUPPORT, free_parts, grow_supports
from terraloom.operators.contracts import union_all
from terraloom.operators.graph import TILE, cell_components, component_name, components, reach_of
from terraloom.operators.ordering import exact_quantiles, summary_quantiles
from terraloom.session import materialize

# fixed values: land-cover class names by code
COVER = ("water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare", "snow_and_ice")


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float = 16.0) -> DataFrame:
    """Points strictly inside polygon rings by ray casting.

    Rings are spread over the coarse cells their bounding box touches, so candidates come from an equi-join and
    only they are tested edge by edge.
    """
    xs, ys = F.transform("ring", lambda v: v["x"]), F.transform("ring", lambda v: v["y"])
    span = lambda c: F.sequence(F.floor(F.array_min(c) / cell), F.floor(F.array_max(c) / cell))
    spread = rings.withColumn("_gx", F.explode(span(xs))).withColumn("_gy", F.explode(span(ys)))
    keyed = points.withColumn("_gx", F.floor(F.col("x") / cell)).withColumn("_gy", F.floor(F.col("y") / cell))
    pairs = keyed.join(spread, ["_gx", "_gy"])
    edges = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    x, y = F.col("x"), F.col("y")
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
        x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return pairs.where(inside).drop("_gx", "_gy", "ring")


def parcel_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_cells"), F.min("tile").alias("tile"))


def overlap_pairs(cells: DataFrame, cross_tile: bool = True) -> DataFrame:
    """Parcel pairs a < b that share cells: shared count and its ratio to the smaller parcel.

    The self-join is on the cell, so only true overlaps meet; there is no all-pairs step.
    """
    a = cells.select(F.col("parcel_id").alias("a"), F.col("tile").alias("tile_a"), "row", "col")
    b = cells.select(F.col("parcel_id").alias("b"), F.col("tile").alias("tile_b"), "row", "col")
    met = a.join(b, ["row", "col"]).where("a < b")
    if cross_tile:
        met = met.where("tile_a <> tile_b")
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    size = materialize(parcel_sizes(cells))  # one row per parcel, read twice
    sized = shared.join(size.select(F.col("parcel_id").alias("a"), F.col("n_cells").alias("n_a")), "a").join(
        size.select(F.col("parcel_id").alias("b"), F.col("n_cells").alias("n_b")), "b")
    union = F.col("n_a") + F.col("n_b") - F.col("shared")
    return sized.withColumn("ratio", F.col("shared") / F.least("n_a", "n_b")).withColumn("iou", F.col("shared") / union)


def overlap_summary(cells: DataFrame, cell_area: float) -> DataFrame:
    pairs = overlap_pairs(cells, cross_tile=False).agg(F.count(F.lit(1)).alias("pair_count"), (F.coalesce(F.sum("shared"), F.lit(0)) * cell_area).alias("overlap_area"))
    union = cells.select("row", "col").distinct().agg((F.count(F.lit(1)) * cell_area).alias("_union"))
    return attach(pairs, union, []).select("pair_count", "overlap_area", F.coalesce(F.col("overlap_area") / F.nullif(F.col("_union"), F.lit(0.0)), F.lit(0.0)).alias("rate"))


def representative_cells(cells: DataFrame) -> DataFrame:
    """Cell nearest the centroid of each parcel (lowest row, col on ties) and the parcel's extent."""
    shape = cells.groupBy("parcel_id", "tile").agg(
        F.avg("row").alias("_cr"), F.avg("col").alias("_cc"), F.count(F.lit(1)).alias("n_cells"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    dist = F.round(F.pow(F.col("row") - F.col("_cr"), 2) + F.pow(F.col("col") - F.col("_cc"), 2), 6)
    nearest = cells.join(shape.select("parcel_id", "tile", "_cr", "_cc"), ["parcel_id", "tile"]).groupBy("parcel_id", "tile").agg(
        F.min(F.struct(dist.alias("d"), "row", "col")).alias("_m"))
    return shape.drop("_cr", "_cc").join(nearest, ["parcel_id", "tile"]).select(
        "*", F.col("_m.row").alias("rep_row"), F.col("_m.col").alias("rep_col")).drop("_m")


def ownership(cells: DataFrame, shape: DataFrame, core_rows: int, core_cols: int, halo: int) -> DataFrame:
    """Per parcel: does its tile's core hold the representative cell, how far is that cell from the halo edge, and which edges
    its cells touch: the deployment's, the halo's, the core's (from inside or across)."""
    reps = attach(representative_cells(cells), shape, [])
    tr, tc = F.split_part("tile", F.lit("_"), F.lit(1)).cast("bigint"), F.split_part("tile", F.lit("_"), F.lit(2)).cast("bigint")
    r0, c0 = F.greatest(tr * core_rows - halo, F.lit(0)), F.greatest(tc * core_cols - halo, F.lit(0))
    r1, c1 = F.least((tr + 1) * core_rows + halo, F.col("n_rows")), F.least((tc + 1) * core_cols + halo, F.col("n_cols"))
    y, x = F.col("rep_row") + 0.5, F.col("rep_col") + 0.5
    owned = (F.floor(F.col("rep_row") / core_rows) == tr) & (F.floor(F.col("rep_col") / core_cols) == tc)
    edge = (F.col("min_row") == 0) | (F.col("min_col") == 0) | (F.col("max_row") == F.col("n_rows") - 1) | (F.col("max_col") == F.col("n_cols") - 1)
    core = (F.col("min_row") < tr * core_rows) | (F.col("max_row") >= (tr + 1) * core_rows) | (F.col("min_col") < tc * core_cols) | (F.col("max_col") >= (tc + 1) * core_cols)
    halo_edge = (F.col("min_row") == r0) | (F.col("max_row") == r1 - 1) | (F.col("min_col") == c0) | (F.col("max_col") == c1 - 1)
    core_edge = (F.col("min_row") <= tr * core_rows) | (F.col("max_row") >= (tr + 1) * core_rows - 1) | (F.col("min_col") <= tc * core_cols) | (F.col("max_col") >= (tc + 1) * core_cols - 1)
    return reps.select("parcel_id", "tile", "n_cells", "rep_row", "rep_col", owned.alias("owned"), F.least(y - r0, r1 - y, x - c0, c1 - x).alias("halo_distance"),
                       edge.alias("deployment_edge"), core.alias("core_crossing"), halo_edge.alias("halo_edge"), core_edge.alias("core_edge"))


def duplicate_components(pairs: DataFrame) -> DataFrame:
    """(parcel_id, comp) of parcels linked by duplicate pairs."""
    nodes = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return components(nodes, pairs.select("a", "b")).withColumnRenamed("id", "parcel_id")


def component_winners(members: DataFrame) -> DataFrame:
    """Winner per component: farthest from the halo edge, then largest, then lowest id. A map-side combined minimum."""
    best = F.min(F.struct((-F.col("halo_distance")).alias("d"), (-F.col("n_cells")).alias("n"), F.col("parcel_id").alias("w"))).alias("_b")
    return members.groupBy("comp").agg(best).select("comp", F.col("_b.w").alias("kept"))


def reconcile(cells: DataFrame, owned: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parcels kept with flag and removed versions, audit of dropped versions, audit of overlaps that stay), over the parcels
    that their own tile's core owns.

    A kept parcel is flagged if it won over duplicates, crosses its core, touches the halo's edge or still shares cells
    with a kept parcel of another tile; the last are listed as (a, b, shared, ratio).
    """
    owned = owned.where("owned")
    cells = cells.join(owned.select("parcel_id"), "parcel_id", "left_semi")
    pairs = materialize(overlap_pairs(cells).select("a", "b", "shared", "ratio"))
    members = duplicate_components(pairs.where(F.col("ratio") >= threshold)).join(owned, "parcel_id")
    winners = component_winners(members)
    audit = materialize(members.join(winners, "comp").where("parcel_id <> kept").select("kept", F.col("parcel_id").alias("dropped")))
    gone = lambda c: audit.select(F.col("dropped").alias(c))
    residual = materialize(pairs.join(gone("a"), "a", "left_anti").join(gone("b"), "b", "left_anti").select("a", "b", "shared", "ratio"))
    versions = audit.groupBy("kept").agg(F.count(F.lit(1)).alias("removed")).withColumnRenamed("kept", "parcel_id")
    overlapping = residual.select(F.explode(F.array("a", "b")).alias("parcel_id")).distinct().withColumn("residual_overlap", F.lit(True))
    kept = owned.join(gone("parcel_id"), "parcel_id", "left_anti").join(versions, "parcel_id", "left").join(overlapping, "parcel_id", "left")
    kept = kept.withColumn("removed", F.coalesce("removed", F.lit(0)).cast("bigint")).withColumn("residual_overlap", F.coalesce("residual_overlap", F.lit(False)))
    return kept.withColumn("reconciled", (F.col("removed") > 0) | F.col("core_crossing") | F.col("halo_edge") | F.col("residual_overlap")), audit, residual


def repair_overlaps(cells: DataFrame, owned: DataFrame) -> DataFrame:
    """Give every shared cell to one parcel: farthest from the halo edge, then largest, then lowest id."""
    rank = F.struct((-F.col("halo_distance")).alias("d"), (-F.col("n_cells")).alias("n"), F.col("parcel_id").alias("w"))
    tagged = cells.join(owned.select("parcel_id", "halo_distance", "n_cells"), "parcel_id")
    return tagged.groupBy("row", "col").agg(F.min(rank).alias("_b"), F.count(F.lit(1)).alias("claims")).select(
        "row", "col", F.col("_b.w").alias("parcel_id"), "claims")


def burn_last(cells: DataFrame, values: DataFrame, order: str, value: str) -> DataFrame:
    """Parcel value per cell; where parcels overlap the later one in `order` wins."""
    return cells.join(values, "parcel_id").groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def burn_priority(cells: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Class codes per cell: positive (1) overrides negative (0); abstaining parcels leave no code."""
    code = F.when(F.col(label) == "positive", 1).when(F.col(label) == "negative", 0)
    coded = classes.select("parcel_id", code.cast("bigint").alias("code")).where("code IS NOT NULL")
    return cells.join(coded, "parcel_id").groupBy("row", "col").agg(F.max("code").alias("code"))


def zonal(cells: DataFrame, pixels: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """n, mean, median, population deviation and positive share per parcel; null where no valid pixel."""
    joined = cells.join(pixels.select("row", "col", value), ["row", "col"], "left")
    base = joined.groupBy("parcel_id").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.avg((F.col(value) >= threshold).cast("double")).alias("positive_share"))
    return base.join(exact_quantiles(joined, ["parcel_id"], value, {"median": 0.5}), "parcel_id", "left")


def zonal_shares(cells: DataFrame, pixels: DataFrame, code: str) -> DataFrame:
    """Share of each land-cover class per parcel, 0 where no pixel."""
    joined = cells.join(pixels.select("row", "col", code), ["row", "col"], "left")
    return joined.groupBy("parcel_id").agg(*[
        F.coalesce(F.avg(F.when(F.col(code).isNotNull(), (F.col(code) == i).cast("double"))), F.lit(0.0)).alias(name) for i, name in enumerate(COVER)])


def area_distribution(parcels: DataFrame, area: str) -> DataFrame:
    spread = exact_quantiles(parcels, [], area, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    base = parcels.agg(F.count(F.lit(1)).alias("n"), F.min(area).alias("min"), F.avg(area).alias("mean"), F.max(area).alias("max"),
                       F.count_if(F.col(area) > 200000).alias("over_20ha"), F.count_if(F.col(area) > 500000).alias("over_50ha"))
    return attach(base, spread, [])


def class_by_summary(threshold: float = 0.5) -> dict[str, Column]:
    """Class by mean, median and positive share (null counts as negative) and whether the three disagree."""
    label = lambda c: F.when(F.col(c) >= threshold, "positive").otherwise("negative")
    three = {"class_by_mean": label("mean"), "class_by_median": label("median"), "class_by_share": label("positive_share")}
    return {**three, "summary_disagreement": F.size(F.array_distinct(F.array(*three.values()))) > 1}


def quality_flags() -> dict[str, Column]:
    """Label-free parcel flags; needs area, n, cover shares, tile_disagreement, reconciled, deployment_edge."""
    return {
        "large": F.col("area") > 200000, "very_large": F.col("area") > 500000, "low_pixels": F.col("n") < 4,
        "built_dominant": F.col("built") >= 0.5, "tree_dominant": F.col("trees") >= 0.5, "water_dominant": F.col("water") >= 0.5,
        "disagreement": F.col("tile_disagreement") >= 0.05, "cross_tile": F.col("reconciled"), "edge": F.col("deployment_edge"),
    }


def flag_count(flags: list[str]) -> Column:
    return sum((F.col(f).cast("bigint") for f in flags), F.lit(0).cast("bigint"))


def not_crop_dominant() -> Column:
    return (F.col("crops") < 0.2) & (F.greatest("water", "trees", "built") >= 0.5)


def _reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(test, name) for test, name in rules]))), ";")


def safeguard_reasons() -> dict[str, Column]:
    """Ordered, de-duplicated reason strings; areas are those before repair except for the fragment rule."""
    c = F.col
    tidal = (c("area") > 200000) & (c("water") + c("bare") >= 0.70)
    fragment, huge, big = c("repaired_area") < 2500, c("area") > 500000, c("area") > 200000
    return {
        "exclusion": _reasons([(c("water") >= 0.80, "water_dominant"), (c("built") >= 0.80, "built_dominant"), (tidal, "tidal_flat_like"),
                               (huge, "extreme_area"), (fragment, "cross_tile_overlap")]),
        "geometry_risk": _reasons([(big, "extreme_area"), (c("participant") | fragment, "cross_tile_overlap"), (c("deployment_edge"), "deployment_edge"),
                                   (c("tile_disagreement") >= 0.25, "high_tile_disagreement")]),
        "cover_risk": _reasons([(c("water") >= 0.50, "water_dominant"), (c("built") >= 0.50, "built_dominant"), (c("trees") >= 0.50, "tree_dominant"),
                                (tidal, "tidal_flat_like")]),
    }


def mapping_status() -> Column:
    risky = (F.col("geometry_risk") != "") | (F.col("cover_risk") != "")
    return F.when(F.col("exclusion") != "", "excluded").when(risky, "retained_QA_risk").otherwise("retained_clear")


# fixed values: warning limits per tile
TILE_LIMITS = {
    "retained": 0.68116, "built": 0.13637, "tree": 0.09091, "water": 0.01040, "over20": 0.09741, "over50": 0.03247,
    "disagreement": 0.27296, "summary": 0.02080,
}


def robust_limit(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: median + 3 * max(median absolute deviation, 1). `df` has one row per tile."""
    stored = materialize(df.select(value))
    middle = summary_quantiles(stored, value, {"_m": 0.5})
    spread = attach(stored, middle, []).select(F.abs(F.col(value) - F.col("_m")).alias("_d"))
    mad = summary_quantiles(spread, "_d", {"_mad": 0.5})
    return attach(middle, mad, []).select((F.col("_m") + 3 * F.greatest("_mad", F.lit(1.0))).alias(name))


def tile_quality(parcels: DataFrame, retained: DataFrame) -> DataFrame:
    """Shares per tile against fixed limits plus the robust cross-tile limit, warning count and review flag."""
    share = lambda f: (F.count_if(F.col(f)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"{f}_share")
    names = ["built_dominant", "tree_dominant", "water_dominant", "large", "very_large", "disagreement", "summary_disagreement"]
    tiles = parcels.groupBy("tile").agg(
        F.count(F.lit(1)).alias("parcel_count"), *[share(f) for f in names], F.count_if(F.col("very_large")).alias("very_large_count"),
        F.count_if(F.col("cross_tile")).alias("cross_tile_count")).join(retained, "tile", "left")
    tiles = materialize(tiles)
    rows = attach(tiles, robust_limit(tiles, "cross_tile_count", "cross_limit"), [])
    lim = TILE_LIMITS
    warns = {
        "warn_retained": F.col("retained_share") > lim["retained"], "warn_built": F.col("built_dominant_share") > lim["built"],
        "warn_tree": F.col("tree_dominant_share") > lim["tree"], "warn_water": F.col("water_dominant_share") > lim["water"],
        "warn_over20": F.col("large_share") > lim["over20"],
        "warn_over50": (F.col("very_large_count") >= 2) | (F.col("very_large_share") > lim["over50"]),
        "warn_disagreement": F.col("disagreement_share") > lim["disagreement"], "warn_summary": F.col("summary_disagreement_share") > lim["summary"],
        "warn_cross_tile": F.col("cross_tile_count") > F.col("cross_limit"),
    }
    rows = rows.select("*", *[F.coalesce(w, F.lit(False)).alias(n) for n, w in warns.items()])
    return rows.withColumn("warning_count", flag_count(list(warns))).withColumn("review", F.col("warning_count") > 0)


def reason_counts(parcels: DataFrame, reasons: str) -> DataFrame:
    return parcels.where(F.col(reasons) != "").select(F.explode(F.split(reasons, ";")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _order(confidence: DataFrame) -> DataFrame:
    """(id, k): the place of each instance in the sequential order, by falling confidence, then id."""
    return confidence.select(F.col("parcel_id").alias("id"), F.struct((-F.col("confidence")).alias("c"), F.col("parcel_id").alias("i")).alias("k"))


def _rivals(cells: DataFrame, order: DataFrame) -> DataFrame:
    """(a, b): instances that share cells, b before a in the sequential order."""
    named = cells.join(order, F.col("parcel_id") == F.col("id")).select("id", "k", "row", "col")
    one, two = (named.select(F.col("id").alias(x), F.col("k").alias(f"k{x}"), "row", "col") for x in "ab")
    return materialize(one.join(two, ["row", "col"]).where("kb < ka").select("a", "b").distinct())


def merge_instances(cells: DataFrame, confidence: DataFrame, iou: float = 0.60, containment: float = 0.80, block: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(parcel_id, kept) of every instance and (kept, row, col), the support of every kept one: greedy merging by falling confidence.

    An instance joins the most confident kept instance whose support, grown by all that joined it before, it meets at `iou`
    or at `containment` of the smaller of the two; otherwise it is kept. `grow_supports` follows that order inside blocks of
    the map. What no block can hold goes on in rounds, which take every instance whose turn cannot be changed by an undecided
    one: all its rivals before it are decided, and none undecided that comes before it touches the supports it touches. So
    the result equals the sequential order.
    """
    cells = materialize(cells.select("parcel_id", "row", "col").distinct())
    decided, support, left = grow_supports(cells, confidence, iou, containment, block)
    empty = confidence.join(cells.select("parcel_id").distinct(), "parcel_id", "left_anti").select(F.col("parcel_id").cast("string").alias("id"))
    state = decided.union(empty.select("id", F.col("id").alias("kept")))
    if not left.isEmpty():
        more, grown = _merge_rounds(left, iou, containment)
        state, support = state.union(more), support.union(grown)
    return state.select(F.col("id").alias("parcel_id"), "kept"), support


def _merge_rounds(left: DataFrame, iou: float, containment: float) -> tuple[DataFrame, DataFrame]:
    """(id, kept) of the open instances among the rows `left` by `grow_supports`, and (kept, row, col) of all its supports."""
    named = left.withColumnRenamed("id", "parcel_id")
    order = materialize(_order(left.select(F.col("id").alias("parcel_id"), "confidence").distinct()))
    cells = named.where(F.col("kind") == OPEN).select("parcel_id", "row", "col")
    support = named.where(F.col("kind") == SUPPORT).select(F.col("parcel_id").alias("kept"), "row", "col").distinct()
    rivals = _rivals(cells, order)
    area = materialize(cells.groupBy(F.col("parcel_id").alias("a")).agg(F.count(F.lit(1)).alias("area")))
    waiting, states = materialize(area.select("a").join(order.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a")), []
    while not waiting.isEmpty():
        own = cells.join(waiting.select(F.col("a").alias("parcel_id")), "parcel_id", "left_semi")
        shared = own.join(support, ["row", "col"]).groupBy(F.col("parcel_id").alias("a"), "kept").agg(F.count(F.lit(1)).alias("shared"))
        touched = materialize(shared.join(waiting, "a"))
        first = touched.groupBy("kept").agg(F.min("ka").alias("first"))
        earlier = rivals.join(waiting.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        waits = earlier.union(touched.join(first, "kept").where("ka > first").select("a")).distinct()
        ready = materialize(waiting.join(waits, "a", "left_anti").select("a"))
        areas = support.groupBy("kept").agg(F.count(F.lit(1)).alias("kept_area"))
        sized = touched.join(ready, "a", "left_semi").join(area, "a").join(areas, "kept")
        fits = (F.col("shared") >= iou * (F.col("area") + F.col("kept_area") - F.col("shared"))) | (F.col("shared") >= containment * F.least("area", "kept_area"))
        keys = order.select(F.col("id").alias("kept"), F.col("k").alias("kk"))
        joins = sized.where(fits).join(keys, "kept").groupBy("a").agg(F.min("kk").alias("kk")).select("a", F.col("kk.i").alias("into"))
        decided = materialize(ready.join(joins, "a", "left").select(F.col("a").alias("id"), F.coalesce("into", "a").alias("kept")))
        states.append(decided)
        grown = own.join(decided.withColumnRenamed("id", "parcel_id"), "parcel_id").select("kept", "row", "col")
        support = materialize(support.union(grown).distinct())
        waiting = materialize(waiting.join(ready, "a", "left_anti"))
    return union_all(states), support


def resolve_conflicts(cells: DataFrame, confidence: DataFrame, large_enough: Column, steps: list[tuple[int, int]] | None = None, block: int = TILE) -> DataFrame:
    """(parcel_id, row, col, comp, size): parts that instances keep when each takes, by falling confidence, the cells still free.

    Free cells of an instance fall into connected parts; parts that are not `large_enough` (a condition on `size`) are
    dropped and their cells stay free for the next. `free_parts` follows that order inside blocks of the map. What no block
    can hold goes on in rounds of all instances whose rivals before them are decided; these share no cell, so a round is one
    labelling of all their free cells. So the result equals the sequential order.
    """
    cells = materialize(cells.select("parcel_id", "row", "col").distinct())
    sizes = cells.sparkSession.range(1, block * block + 1).select(F.col("id").alias("size")).where(large_enough)
    allowed = np.zeros(block * block + 1, bool)
    allowed[[r[0] for r in sizes.collect()]] = True  # at most the cells of a block
    found, left = free_parts(cells, confidence, allowed, reach_of(steps), block)
    parts = found.select(F.col("id").alias("parcel_id"), "row", "col", component_name(["id"]).alias("comp"), "size")
    return parts if left.isEmpty() else parts.unionByName(_conflict_rounds(left, large_enough, steps))


def _conflict_rounds(left: DataFrame, large_enough: Column, steps: list[tuple[int, int]] | None) -> DataFrame:
    """The parts that the open instances among the rows `left` by `free_parts` keep."""
    order = materialize(_order(left.select(F.col("id").alias("parcel_id"), "confidence").distinct()))
    cells = left.select(F.col("id").alias("parcel_id"), "row", "col")
    rivals = _rivals(cells, order)
    waiting, taken = order.select("id"), None
    while not waiting.isEmpty():
        blocked = rivals.join(waiting.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id")).distinct()
        ready = materialize(waiting.join(blocked, "id", "left_anti"))
        free = cells.join(ready.withColumnRenamed("id", "parcel_id"), "parcel_id", "left_semi")
        if taken is not None:
            free = free.join(taken.select("row", "col"), ["row", "col"], "left_anti")
        parts = materialize(cell_components(free, ["parcel_id"], steps).where(large_enough))
        taken = parts if taken is None else materialize(taken.unionByName(parts))
        waiting = materialize(waiting.join(ready, "id", "left_anti"))
    return taken

"""Pixel-table operators: a raster is (row, col, value...), overlay is an equi-join, focal is shift-and-sum.

Focal sums emit shifted contributions and aggregate them. Tables sorted by tile keep neighbours in one
partition, so the partial aggregation already merges most contributions before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.attach import attach
from terraloom.operators.metrics import confusion_columns, count_metrics
from terraloom.operators.ordering import fits_one_task, range_count

CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
SQUARE = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def offsets(steps: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(r).cast("bigint").alias("dr"), F.lit(c).cast("bigint").alias("dc")) for r, c in steps]))


def decode_probability(value: Column, nodata: float, threshold: float = 0.5) -> dict[str, Column]:
    """valid / pred of a probability raster; nodata is matched with a relative and absolute tolerance."""
    is_nodata = F.abs(value - F.lit(nodata)) <= F.lit(1e-8 + 1e-5 * abs(nodata))
    valid = value.isNotNull() & ~F.isnan(value) & ~is_nodata
    return {"valid": F.coalesce(valid, F.lit(False)), "pred": F.coalesce(valid & (value >= threshold), F.lit(False))}


def decode_classes(code: Column) -> dict[str, Column]:
    """valid / committed / pred of parcel classes 0, 1, 2 = abstain, 255 = nodata; other codes are an error."""
    known = F.when(code.isin(0, 1, 2, 255), code).otherwise(F.raise_error(F.lit("unexpected parcel class code")).cast("bigint"))
    return {"valid": known != 255, "committed": known.isin(0, 1), "pred": known == 1}


def overlay(base: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """Left-join layers on (row, col); each layer's remaining columns get its name as prefix.

    All joins share one key, so the base is shuffled once.
    """
    out = base
    for name, layer in layers.items():
        renamed = layer.select("row", "col", *[F.col(c).alias(f"{name}_{c}") for c in layer.columns if c not in ("row", "col")])
        out = out.join(renamed, ["row", "col"], "left")
    return out


def resample_nearest(template: DataFrame, source: DataFrame, value: str, scale: float) -> DataFrame:
    """Value of the source pixel under each template pixel centre; template pixels are `scale` source pixels wide."""
    keyed = template.select("row", "col", F.floor((F.col("row") + 0.5) * scale).alias("_r"), F.floor((F.col("col") + 0.5) * scale).alias("_c"))
    src = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    return keyed.join(src, ["_r", "_c"], "left").select("row", "col", (F.coalesce("_v", F.lit(0)) > 0).cast("bigint").alias("label"))


def two_by_two(fine: DataFrame, code: str, allowed: tuple[int, ...] = (3, 4), classes: int = 9) -> DataFrame:
    """10 m -> 20 m: votes of allowed classes, gate (at least 2 of 4) and majority class (lowest code on ties)."""
    keys = [F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")]
    counts = [F.count_if(F.col(code) == c) for c in range(classes)]
    grouped = fine.groupBy(*keys).agg(F.count_if(F.col(code).isin(*allowed)).alias("votes"), F.array(*counts).alias("_n"))
    majority = F.array_position("_n", F.array_max("_n")) - 1
    return grouped.select("row", "col", "votes", (F.col("votes") >= 2).alias("gate"), majority.cast("bigint").alias("majority"))


def neighbor_disagreement(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Share of right and down neighbour pairs, both present, whose values differ."""
    keys = keys or []
    far = df.withColumn("_o", offsets([(0, 1), (1, 0)])).select(
        *keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"), F.col(value).alias("_v"))
    pairs = far.join(df.select(*keys, "row", "col", value), [*keys, "row", "col"])
    agg = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_v") != F.col(value)).alias("differing"))
    return agg.withColumn("rate", F.coalesce(F.col("differing") / F.nullif(F.col("pairs"), F.lit(0)), F.lit(0.0)))


def focal_count(df: DataFrame, mask: Column, steps: list[tuple[int, int]]) -> DataFrame:
    """(row, col, self, around): whether the pixel itself is set and how many of its neighbours are.

    Contributions of a large grid meet in a given number of partitions: pixels compress so well that adaptive execution,
    which goes by bytes, would leave millions of groups to each task.
    """
    here = df.select("row", "col", F.lit(True).alias("_here"), mask.cast("int").alias("_self"))
    set_ = here.where("_self = 1").withColumn("_o", offsets([(0, 0), *steps]))
    shifted = set_.select((F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"), F.lit(False).alias("_here"),
                          F.when((F.col("_o.dr") == 0) & (F.col("_o.dc") == 0), 1).otherwise(0).alias("_own"))
    both = here.select("row", "col", "_here", F.lit(0).alias("_own"), F.lit(0).alias("_n")).unionByName(shifted.withColumn("_n", 1 - F.col("_own")))
    if not fits_one_task(df):
        both = both.repartition(range_count(df), "row", "col")
    out = both.groupBy("row", "col").agg(F.max("_here").alias("_here"), F.max("_own").alias("self"), F.sum("_n").alias("around"))
    return out.where("_here").select("row", "col", F.col("self").cast("bigint").alias("self"), F.col("around").cast("bigint").alias("around"))


def class_edges(df: DataFrame, mask: Column, steps: list[tuple[int, int]] = SQUARE) -> DataFrame:
    """Set pixels that erosion removes: at least one neighbour is unset or off the grid."""
    return focal_count(df, mask, steps).where("self = 1").withColumn("edge", F.col("around") < len(steps))


def boundary_clearance(df: DataFrame, mask: Column) -> DataFrame:
    """(row, col, boundary, clear): dilation XOR erosion with a cross, and whether no boundary pixel lies closer than 2."""
    focal = focal_count(df, mask, CROSS)
    boundary = ((F.col("self") == 1) & (F.col("around") < 4)) | ((F.col("self") == 0) & (F.col("around") > 0))
    marked = focal.select("row", "col", boundary.alias("boundary"))
    near = focal_count(marked, F.col("boundary"), SQUARE)
    return near.select("row", "col", (F.col("self") == 1).alias("boundary"), ((F.col("self") + F.col("around")) == 0).alias("clear"))


def grid_shape(df: DataFrame) -> DataFrame:
    return df.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def block_metrics(df: DataFrame, products: list[str], ref: Column, nb: int, least: int, base: str) -> DataFrame:
    """Metrics per nb x nb block and product, and the F1 difference to `base` (null if either is undefined).

    `df` holds one boolean column per product and `<product>_kept`; the last block of each axis takes the rest.
    """
    tagged = attach(df, grid_shape(df), [])
    index = lambda c, n: F.least(F.floor(F.col(c) / F.floor(F.col(n) / nb)), F.lit(nb - 1)).cast("bigint")
    long = tagged.select(
        index("row", "n_rows").alias("block_row"), index("col", "n_cols").alias("block_col"), ref.alias("_ref"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("product"), F.col(p).alias("pred"), F.col(f"{p}_kept").alias("kept")) for p in products])).alias("_p"))
    keys = ["block_row", "block_col", "product"]
    counts = long.select("block_row", "block_col", "_ref", "_p.*").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pixels"), F.count_if(F.col("kept")).alias("_kept"), *confusion_columns(F.col("pred"), F.col("_ref")))
    m = count_metrics("null")
    rows = counts.where(F.col("n_pixels") >= least).select(*keys, "n_pixels", (F.col("_kept") / F.col("n_pixels")).alias("coverage"), m["f1"].alias("f1"), m["iou"].alias("iou"))
    block = Window.partitionBy("block_row", "block_col")  # one row per product
    reference = F.max(F.when(F.col("product") == base, F.col("f1"))).over(block)
    return rows.withColumn("delta_f1", F.when(F.col("product") != base, F.col("f1") - reference))


def paired_block_summary(blocks: DataFrame, base: str) -> DataFrame:
    """Counts of improved, worsened and unchanged blocks per product; at most nb * nb blocks each."""
    delta = F.col("delta_f1")
    return blocks.where((F.col("product") != base) & delta.isNotNull()).groupBy("product").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.percentile("delta_f1", F.lit(0.5)).alias("median_delta"), F.avg("delta_f1").alias("mean_delta"),
        F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("worsened"), F.count_if(delta == 0).alias("unchanged"))


def deployment_modes(df: DataFrame, products: list[str], ref: Column, pixel_area: float) -> DataFrame:
    """Full-grid (abstained = negative) and retained-only metrics per product from one pass over the pixels."""
    long = df.select(ref.alias("_ref"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("product"), F.col(p).alias("pred"), F.col(f"{p}_kept").alias("kept")) for p in products])).alias("_p"))
    long = long.select("_ref", "_p.*").withColumn("mode", F.explode(F.when(F.col("kept"), F.array(F.lit("full_grid"), F.lit("retained"))).otherwise(F.array(F.lit("full_grid")))))
    counts = long.groupBy("product", "mode").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("kept")).alias("kept_pixels"), *confusion_columns(F.col("pred"), F.col("_ref")))
    whole = F.max("pixels").over(Window.partitionBy("product"))  # two rows per product
    area_a, area_b = F.max(F.col("tp") + F.col("fp")).over(Window.partitionBy("product")), F.min(F.col("tp") + F.col("fp")).over(Window.partitionBy("product"))
    checked = F.when(area_a != area_b, F.raise_error(F.lit("predicted area depends on the mode")).cast("bigint")).otherwise(F.col("tp") + F.col("fp"))
    return counts.select(
        "product", "mode", *[c.alias(n) for n, c in count_metrics("null").items()], (checked * pixel_area).alias("predicted_area"),
        (F.col("kept_pixels") / whole).alias("coverage"), ((whole - F.col("kept_pixels")) * pixel_area).alias("excluded_area"))


def gate_stages(df: DataFrame, p: str, gates: dict[str, Column], threshold: float, high: float, pixel_area: float) -> DataFrame:
    """Retained share, positives kept and removed, strong positives removed and area per gate, in one pass."""
    valid, pos, strong = F.col(p).isNotNull(), F.col(p) >= threshold, F.col(p) >= high
    aggs = [F.count_if(valid).alias("_valid")]
    for g, keep in gates.items():
        aggs += [F.count_if(valid & keep).alias(f"{g}_n"), F.count_if(pos & keep).alias(f"{g}_pos"), F.count_if(pos & ~keep).alias(f"{g}_out"), F.count_if(strong & ~keep).alias(f"{g}_strong")]
    rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("stage"), (F.col(f"{g}_n") / F.col("_valid")).alias("retained_share"), F.col(f"{g}_pos").alias("positives_kept"),
                 F.col(f"{g}_out").alias("positives_removed"), F.col(f"{g}_strong").alias("strong_removed"), (F.col(f"{g}_pos") * pixel_area).alias("area"))
        for g in gates]))
    return df.agg(*aggs).select(rows.alias("r")).select("r.*")


def tile_positions(length: Column, size: int, step: int) -> Column:
    """Start positions of overlapping tiles; the last one is flush with the edge."""
    regular = F.sequence(F.lit(0).cast("bigint"), F.greatest(length - size, F.lit(0)).cast("bigint"), F.lit(step).cast("bigint"))
    return F.when(length <= size, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_union(regular, F.array((length - size).cast("bigint"))))


def tile_index(shape: DataFrame, core_rows: int, core_cols: int, halo: int) -> DataFrame:
    """Tiles r00c00... with core and halo extents clipped to the grid (half-open)."""
    axis = lambda n, step: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / step)))
    tiles = shape.withColumn("tr", axis("n_rows", core_rows)).withColumn("tc", axis("n_cols", core_cols))
    r0, c0 = F.col("tr") * core_rows, F.col("tc") * core_cols
    r1, c1 = F.least(r0 + core_rows, F.col("n_rows")), F.least(c0 + core_cols, F.col("n_cols"))
    zero = F.lit(0).cast("bigint")
    return tiles.select(
        F.format_string("r%02dc%02d", "tr", "tc").alias("tile"), r0.alias("core_r0"), r1.alias("core_r1"), c0.alias("core_c0"), c1.alias("core_c1"),
        F.greatest(r0 - halo, zero).alias("halo_r0"), F.least(r1 + halo, F.col("n_rows")).alias("halo_r1"),
        F.greatest(c0 - halo, zero).alias("halo_c0"), F.least(c1 + halo, F.col("n_cols")).alias("halo_c1"))


def owned_by_core(df: DataFrame, tile: str, core_rows: int, core_cols: int) -> DataFrame:
    """Mosaic: keep each pixel only from the tile whose regular core owns it. Pure arithmetic, no join."""
    owner = F.format_string("r%02dc%02d", F.floor(F.col("row") / core_rows), F.floor(F.col("col") / core_cols))
    return df.where(F.col(tile) == owner)


def window_scores(df: DataFrame, code: str, block: int, width: int) -> DataFrame:
    """Sliding windows of width x width blocks, moved one block at a time: class counts and class-4 edge pixels.

    Pixels are summed to blocks once; rows of blocks are summed to window rows and then columns to windows, so a
    pixel is read once and a block is repeated 2 * width times instead of width squared. Erosion treats pixels
    outside the window as unset, so set pixels on the window border count as edges too: interior set pixels are
    also summed along each block's four sides and corners.
    """
    crop = F.col(code) == 4
    edges = class_edges(df, crop).select("row", "col", F.col("edge"))
    tagged = df.select("row", "col", code).join(edges, ["row", "col"], "left")
    inner = F.coalesce(~F.col("edge"), F.lit(False))
    top, bottom = F.col("row") % block == 0, F.col("row") % block == block - 1
    left, right = F.col("col") % block == 0, F.col("col") % block == block - 1
    sides = {"t": top, "b": bottom, "l": left, "r": right, "tl": top & left, "tr": top & right, "bl": bottom & left, "br": bottom & right}
    blocks = tagged.groupBy(F.floor(F.col("row") / block).alias("i"), F.floor(F.col("col") / block).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(code) == c).alias(f"n{c}") for c in range(9)],
        F.count_if(F.coalesce("edge", F.lit(False))).alias("e"), *[F.count_if(inner & test).alias(k) for k, test in sides.items()])
    steps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")))
    plain = ["n", *[f"n{c}" for c in range(9)], "e", "l", "r"]
    first, last = F.col("s") == 0, F.col("s") == width - 1
    only = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0))
    rows = blocks.withColumn("s", steps).groupBy((F.col("i") - F.col("s")).alias("wi"), "j").agg(
        *[F.sum(c).alias(c) for c in plain], only(first, "t").alias("t"), only(last, "b").alias("b"),
        (only(first, "tl") + only(last, "bl")).alias("cl"), (only(first, "tr") + only(last, "br")).alias("cr"))
    wins = rows.withColumn("s", steps).groupBy("wi", (F.col("j") - F.col("s")).alias("wj")).agg(
        *[F.sum(c).alias(c) for c in plain if c not in ("l", "r")],
        (F.sum("t") + F.sum("b") + only(first, "l") + only(last, "r") - only(first, "cl") - only(last, "cr")).alias("ring"))
    full = wins.where((F.col("n") == (block * width) ** 2) & (F.col("wi") >= 0) & (F.col("wj") >= 0))
    share = lambda c: F.col(c) / F.col("n")
    mixed = share("n1") + share("n2") + share("n5")
    diversity = sum(((share(f"n{c}") >= 0.01).cast("int") for c in range(8)), F.lit(0))
    eligible = share("n4").between(0.30, 0.82) & (share("n0") >= 0.01) & (share("n6") >= 0.01) & (mixed >= 0.02) & (diversity >= 4)
    edge = (F.col("e") + F.col("ring")) / F.col("n")
    score = (2.2 * share("n4") + 6.0 * edge + 1.5 * F.least(share("n0"), F.lit(0.10)) + 1.5 * F.least(share("n6"), F.lit(0.10))
             + 0.8 * F.least(mixed, F.lit(0.15)) + 0.03 * diversity)
    return full.select((F.col("wi") * block).alias("row"), (F.col("wj") * block).alias("col"), share("n4").alias("crop_share"), edge.alias("edge_density"),
                       diversity.cast("bigint").alias("diversity"), eligible.alias("eligible"), score.alias("score"))


def label_aided_scores(spread: DataFrame, keys: list[str], mask: Column, p: str, pixels: int, label) -> DataFrame:
    """Window scores that use a reference: class mix, boundary density, probability spread, components of 9+ pixels.

    `spread` repeats each pixel for every window that holds it, so components are those of the window itself.
    """
    on = mask & F.col(p).isNotNull()
    stats = spread.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), F.count(p).alias("n"), F.count_if(on).alias("pos"), F.stddev_pop(p).alias("spread"), F.avg(F.col(p).between(0.2, 0.8).cast("double")).alias("mid"))
    cells = spread.where(on).select(*keys, "row", "col")
    around = cells.withColumn("_o", offsets(CROSS)).select(*keys, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"))
    inner = around.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4").join(cells, [*keys, "row", "col"], "left_semi")
    inner = inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("_inner"))
    parts = label(cells, keys).where("size >= 9").groupBy(*keys).agg(F.countDistinct("comp").alias("_parts"))
    rows = stats.where(F.col("n_all") == pixels).join(inner, keys, "left").join(parts, keys, "left")
    share, edge = F.col("pos") / F.col("n"), (F.col("pos") - F.coalesce("_inner", F.lit(0))) / F.col("n")
    score = 2.0 * 4.0 * share * (1 - share) + 12.0 * edge + 0.8 * F.col("spread") + 0.4 * F.col("mid") + 0.002 * F.least(F.coalesce("_parts", F.lit(0)), F.lit(250))
    eligible = (F.col("n") / F.col("n_all") >= 0.98) & share.between(0.12, 0.70)
    return rows.select(*keys, share.alias("share"), edge.alias("boundary_density"), F.coalesce("_parts", F.lit(0)).alias("components"), eligible.alias("eligible"), score.alias("score"))

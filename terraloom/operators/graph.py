"""Connected components by parent hooking and pointer jumping, one stored table per round.

Each round replaces a node's parent by the smallest grandparent seen at itself or at a neighbour and hooks the
old parent to it as well, so chains shrink geometrically instead of one hop per round. Minima are aggregated
map-side before the shuffle, which keeps nodes with very many neighbours cheap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.operators.raster import SQUARE, offsets
from terraloom.session import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) with comp = smallest id reachable. `nodes` has column id; `edges` has a, b in one direction."""
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    parents = materialize(nodes.select("id", F.col("id").alias("f")))
    while True:  # labels only fall, so the rounds end
        grand = parents.alias("x").join(parents.alias("y"), F.col("x.f") == F.col("y.id")).select(
            F.col("x.id").alias("id"), F.col("x.f").alias("f"), F.col("y.f").alias("g"))
        seen = both.join(grand.select(F.col("id").alias("v"), F.col("g").alias("_g")), "v").groupBy("u").agg(F.min("_g").alias("_g"))
        mine = grand.join(seen.withColumnRenamed("u", "id"), "id", "left").select(
            "id", "f", F.least("g", F.coalesce("_g", "g")).alias("best"))
        hooks = mine.groupBy("f").agg(F.min("best").alias("_h")).select(F.col("f").alias("id"), "_h")
        step = mine.join(hooks, "id", "left").select("id", F.col("f").alias("old"), F.least("f", "best", F.coalesce("_h", "best")).alias("f"))
        step = materialize(step)
        changed = step.where(F.col("old") != F.col("f")).limit(1).count()
        parents = step.select("id", "f")
        if not changed:
            return parents.select("id", F.col("f").alias("comp"))


def _first_runs(code: np.ndarray, row: np.ndarray, col: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells sorted by (code, row, col): the run each cell lies in, and the first run of that run's component.

    Runs of neighbouring rows meet where their columns do, or with `reach` 1 where they touch by a corner.
    """
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(code) != 0) | (np.diff(row) != 0) | (np.diff(col) > 1)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    left, right = col[starts], col[np.append(starts[1:], len(col)) - 1]
    low, width = left.min() - 2, right.max() - left.min() + 6
    line = code[starts] * (row.max() - row.min() + 2) + row[starts] - row.min()
    first = np.searchsorted(line * width + right - low, (line + 1) * width + left - low - reach, "left")
    last = np.searchsorted(line * width + left - low, (line + 1) * width + right - low + reach, "right")
    counts = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(starts)), counts)
    b = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    label = np.arange(len(starts))
    while True:  # labels only fall
        low_ab = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            return run, label
        for end in (a, b):
            np.minimum.at(label, label[end], low_ab)
        while (label[label] != label).any():
            label = label[label]


TILE = 256


def tile_labels(cells: DataFrame, group: list[str], reach: int, tile: int = TILE) -> DataFrame:
    """Cells with `_first_row`, `_first_col` (first cell of their component inside the tile) and `_n`, its cells in the tile.

    One pass: a task holds one tile at a time, at most tile x tile cells of each group.
    """
    from terraloom.session import ship_package

    ship_package(cells.sparkSession)
    kinds = dict(cells.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in group] + ["row bigint", "col bigint", "_tr bigint", "_tc bigint", "_first_row bigint", "_first_col bigint", "_n bigint"])

    def label(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        code = np.zeros(len(row), np.int64)
        for c in group:
            values = table.column(c).combine_chunks().dictionary_encode()
            if isinstance(values, pa.ChunkedArray):
                values = values.combine_chunks()
            codes = values.indices.fill_null(len(values.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.unique(code * (len(values.dictionary) + 1) + codes, return_inverse=True)[1]
        order = np.lexsort((col, row, code))
        code, row, col = code[order], row[order], col[order]
        run, first = _first_runs(code, row, col, reach)
        starts = np.searchsorted(run, np.arange(run[-1] + 1))
        head = first[run]
        sizes = np.bincount(head, minlength=run[-1] + 1)
        out = table.take(pa.array(order)).select([*group, "row", "col", "_tr", "_tc"])
        for name, values in (("_first_row", row[starts[head]]), ("_first_col", col[starts[head]]), ("_n", sizes[head])):
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        return out

    tiled = cells.select(*group, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).select(
        "*", F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"))
    return tiled.groupBy("_tr", "_tc").applyInArrow(label, schema)


def reach_of(steps: list[tuple[int, int]] | None) -> int:
    """1 if the steps (8-connected by default) go to cells that touch by a corner, else 0."""
    return 1 if any(dr and dc for dr, dc in steps or SQUARE) else 0


def component_name(group: list[str], row: str = "first_row", col: str = "first_col") -> Column:
    """Name of a component: its group and its first cell in row-major order."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in group]
    return F.concat_ws(":", *named, F.format_string("%012d:%012d", row, col))


def cell_components(cells: DataFrame, group: list[str] | None = None, steps: list[tuple[int, int]] | None = None, tile: int = TILE) -> DataFrame:
    """Components of a cell set (optionally inside each group), 8-connected by default; adds `comp` and `size`.

    `comp` names the group and the component's first cell in row-major order. Each tile is labelled by itself; only labels
    that touch a neighbouring tile enter the rounds of `components`, and what these find is joined back by tile and label,
    never by component. Rows with a null row or col are no cells.
    """
    group = group or []
    reach = reach_of(steps)
    name = component_name(group, "_first_row", "_first_col")
    local = materialize(tile_labels(cells.where("row IS NOT NULL AND col IS NOT NULL"), group, reach, tile))
    edge = local.where(f"pmod(row, {tile}) IN (0, {tile - 1}) OR pmod(col, {tile}) IN (0, {tile - 1})").select(*group, "row", "col", "_tr", "_tc", name.alias("_id"), "_n")
    ahead = [(1, dc) for dc in range(-reach, reach + 1)] + [(0, 1)]
    moved = edge.withColumn("_o", offsets(ahead)).select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"),
        F.col("_tr").alias("_r"), F.col("_tc").alias("_c"), F.col("_id").alias("a"), F.col("_n").alias("a_n"))
    moved = moved.where(f"floor(row / {tile}) <> _r OR floor(col / {tile}) <> _c")
    same = [moved["row"] == edge["row"], moved["col"] == edge["col"], *[F.col(f"_g{i}").eqNullSafe(F.col(c)) for i, c in enumerate(group)]]
    edges = materialize(moved.join(edge.select(*group, "row", "col", F.col("_id").alias("b"), F.col("_n").alias("b_n")), same).select("a", "a_n", "b", "b_n").distinct())
    nodes = materialize(edges.select(F.col("a").alias("id"), F.col("a_n").alias("n")).union(edges.select("b", "b_n")).distinct())
    out = [*group, "row", "col"]
    if nodes.isEmpty():
        return local.select(*out, name.alias("comp"), F.col("_n").alias("size"))
    comp = components(nodes.select("id"), edges.select("a", "b")).join(nodes, "id")
    sizes = comp.groupBy("comp").agg(F.sum("n").alias("size"))
    joined = materialize(comp.join(sizes, "comp").select(F.col("id").alias("_id"), "comp", "size"))
    marked = local.withColumn("_id", name)
    return marked.join(joined, "_id", "left").select(*out, F.coalesce("comp", "_id").alias("comp"), F.coalesce("size", "_n").alias("size"))

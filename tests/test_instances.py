"""Tile-local components, merged instances and resolved conflicts against sequential versions; quantiles of tied values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import ordering
from terraloom.operators.graph import cell_components
from terraloom.operators.ordering import exact_quantiles
from terraloom.operators.parcels import merge_instances, resolve_conflicts
from terraloom.operators.raster import CROSS

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def parts(cells, steps):
    left, out = set(cells), []
    while left:
        part, stack = set(), [left.pop()]
        while stack:
            r, c = stack.pop()
            part.add((r, c))
            near = {(r + a, c + b) for a, b in steps} & left
            left -= near
            stack += near
        out.append(part)
    return out


@pytest.mark.parametrize("tile, steps", [(4, None), (5, CROSS), (256, None)])
def test_components_over_tiles_match_a_flood_fill(spark, tile, steps):
    draw = random.Random(tile)
    cells = [(g, r, c) for g in ("a", "b:c", None) for r in range(23) for c in range(19) if draw.random() < 0.55]
    df = spark.createDataFrame([(*x, 1) for x in cells] + [("a", None, 3, 1)], "z string, row bigint, col bigint, size int")
    got = {}
    for r in cell_components(df, ["z"], steps, tile).collect():
        got.setdefault((r.z, r.comp), [set(), set()])
        got[r.z, r.comp][0].add((r.row, r.col))
        got[r.z, r.comp][1].add(r.size)
    want = [(g, frozenset(p)) for g in ("a", "b:c", None) for p in parts([(r, c) for z, r, c in cells if z == g], steps or EIGHT)]
    assert sorted(((g, sorted(p)) for (g, _), (p, _) in got.items()), key=str) == sorted(((g, sorted(p)) for g, p in want), key=str)
    assert all(s == {len(p)} for p, s in got.values())
    assert cell_components(df.where("false"), ["z"]).count() == 0


@pytest.fixture(scope="module")
def instances():
    draw = random.Random(8)
    boxes = [(f"p{i}", draw.randrange(30), draw.randrange(30), draw.randrange(2, 9), draw.randrange(2, 9), draw.choice([0.2, 0.5, 0.9, draw.random()])) for i in range(45)]
    return {n: (conf, {(r + i, c + j) for i in range(h) for j in range(w)}) for n, r, c, h, w, conf in boxes}


def frames(spark, instances):
    cells = [(n, r, c) for n, (_, cs) in instances.items() for r, c in cs]
    return spark.createDataFrame(cells, "parcel_id string, row bigint, col bigint"), spark.createDataFrame([(n, c) for n, (c, _) in instances.items()], "parcel_id string, confidence double")


def test_merged_instances_grow_as_in_sequence(spark, instances):
    kept, joined = {}, {}
    for n in sorted(instances, key=lambda n: (-instances[n][0], n)):
        own = instances[n][1]
        for k, support in kept.items():
            both = len(own & support)
            if both and (both >= 0.4 * len(own | support) or both >= 0.6 * min(len(own), len(support))):
                support |= own
                joined[n] = k
                break
        else:
            kept[n], joined[n] = set(own), n
    found, support = merge_instances(*frames(spark, instances), 0.4, 0.6)
    assert {r.parcel_id: r.kept for r in found.collect()} == joined
    grown = {}
    for r in support.collect():
        grown.setdefault(r.kept, set()).add((r.row, r.col))
    assert grown == kept
    assert len(kept) < len(instances)


def test_freed_cells_go_to_the_next_claimant(spark, instances):
    taken, want = set(), {}
    for n in sorted(instances, key=lambda n: (-instances[n][0], n)):
        for part in parts(instances[n][1] - taken, CROSS):
            if len(part) >= 6:
                taken |= part
                want.setdefault(n, []).append(sorted(part))
    got = {}
    for r in resolve_conflicts(*frames(spark, instances), F.col("size") >= 6, CROSS).collect():
        got.setdefault(r.parcel_id, {}).setdefault(r.comp, []).append((r.row, r.col))
    assert {n: sorted(map(sorted, p.values())) for n, p in got.items()} == {n: sorted(p) for n, p in want.items()}


def test_blocks_smaller_than_the_map_give_the_same_instances(spark, instances, block=9):
    cells, confidence = frames(spark, instances)
    extra = spark.createDataFrame([("none", 0.4)], "parcel_id string, confidence double")
    found, support = merge_instances(cells, confidence.union(extra), 0.4, 0.6, block)
    want, grown = merge_instances(cells, confidence.union(extra), 0.4, 0.6)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, support.collect())) == sorted(map(tuple, grown.collect()))
    parts_of = lambda df: sorted(map(tuple, df.select("parcel_id", "row", "col", "comp", "size").collect()))
    assert parts_of(resolve_conflicts(cells, confidence, F.col("size") >= 6, CROSS, block)) == parts_of(resolve_conflicts(cells, confidence, F.col("size") >= 6, CROSS))


@pytest.mark.parametrize("rule", ["merge", "resolve"])
def test_a_long_chain_of_instances_takes_few_stored_tables(spark, monkeypatch, rule):
    """Each of 30 instances waits for the one before it: one pass over a block, not one round each."""
    from terraloom.operators import blocks, graph, parcels

    stored = []

    def counted(df, kept=parcels.materialize):
        stored.append(1)
        return kept(df)

    for module in (blocks, graph, parcels):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", counted)
    chain = {f"p{i:02d}": (1.0 - i / 100, {(r, 2 * i + c) for r in range(3) for c in range(3)}) for i in range(30)}
    cells, confidence = frames(spark, chain)
    if rule == "merge":
        assert merge_instances(cells, confidence, 0.9, 0.9)[0].where("parcel_id <> kept").count() == 0
    else:
        assert resolve_conflicts(cells, confidence, F.col("size") >= 6, CROSS).select("parcel_id").distinct().count() == 30
    assert len(stored) < 10


def test_quantiles_of_ties_agree_on_both_plans(spark, monkeypatch):
    draw = random.Random(1)
    rows = [("const", 0.1 + 0.2) for _ in range(143)] + [("ties", draw.choice([0.1, 0.1, 0.7, 1 / 3])) for _ in range(100)] + [(None, draw.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "key string, value double")
    probs = {f"q{i}": i / 21 for i in range(22)}
    plain = {r.key: tuple(r)[1:] for r in exact_quantiles(df, ["key"], "value", probs).collect()}
    monkeypatch.setattr(ordering, "ONE_TASK_BYTES", -1)
    for limit in (-1, 70, 120, 10**6):  # all keys in ranges, some, one, none
        monkeypatch.setattr(ordering, "PLAIN_WINDOW_ROWS", limit)
        got = {r.key: tuple(r)[1:] for r in exact_quantiles(df, ["key"], "value", probs).collect()}
        assert got == {k: v for k, v in plain.items()} or (limit == -1 and {k: v for k, v in got.items() if k} == {k: v for k, v in plain.items() if k})
    assert set(plain["const"]) == {0.1 + 0.2}
    assert np.allclose(plain["ties"], np.quantile([v for k, v in rows if k == "ties"], list(probs.values())))

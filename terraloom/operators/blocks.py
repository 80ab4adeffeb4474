"""Sequential rules over overlapping cell sets, followed inside square blocks of the map.

A pass sends every open cell to its block. A block goes through its instances in the sequential order and decides those
whose turn lies in the block for certain: the instance lies in it, and nothing it meets waits for something outside.
What is left open goes into the next pass, whose blocks are shifted by a third of their side, so that a place near a
border lies inside a block in one of three passes. A pass is one shuffle of the open cells, however long the chains of
instances that wait for each other are inside a block, and a task holds one block at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.graph import _first_runs
from terraloom.session import materialize, ship_package

OPEN, SUPPORT, CLOSED, DECIDED = 0, 1, 2, 3
BOX = ["r0", "r1", "c0", "c1"]
ROW = "id string, confidence double, row bigint, col bigint, r0 bigint, r1 bigint, c0 bigint, c1 bigint, kind int"


def boxed(cells: DataFrame, confidence: DataFrame) -> DataFrame:
    """Open cells of the instances that have a confidence, each with the instance's extent."""
    box = cells.groupBy("parcel_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    named = confidence.select("parcel_id", F.col("confidence").cast("double").alias("confidence")).join(box, "parcel_id")
    rows = cells.select("parcel_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col")).join(named, "parcel_id")
    return rows.select(F.col("parcel_id").cast("string").alias("id"), "confidence", "row", "col", *[F.col(c).cast("bigint").alias(c) for c in BOX], F.lit(OPEN).alias("kind"))


def passes(rows: DataFrame, block: int, decide: Callable[[pa.Table, tuple[int, int]], pa.Table], schema: str) -> tuple[list[DataFrame], DataFrame]:
    """(tables of the passes, rows still open): `decide` gets the rows of one block and its first row and column.

    Ends when nothing is open or when the instances open did not change in three passes, one with each shift.
    """
    ship_package(rows.sparkSession)
    done, idle, turn, left = [], 0, 0, None

    def one_pass(shift: int) -> DataFrame:
        place = [F.floor((F.col(c) + shift) / block).alias(p) for c, p in (("row", "_br"), ("col", "_bc"))]

        def run(table: pa.Table) -> pa.Table:
            return decide(table, tuple(table.column(p)[0].as_py() * block - shift for p in ("_br", "_bc")))

        return rows.select("*", *place).groupBy("_br", "_bc").applyInArrow(run, schema)

    while idle < 3:
        found = materialize(one_pass((turn % 3) * block // 3))
        done.append(found.where(F.col("kind") > SUPPORT))
        rows = found.where(F.col("kind") <= SUPPORT).select(*[f.split()[0] for f in ROW.split(", ")])
        waiting = found.where(F.col("kind") == OPEN).select("id").distinct().count()
        if not waiting:
            break
        idle = idle + 1 if waiting == left else 0
        left, turn = waiting, turn + 1
    return done, rows


class Block:
    """The rows of one block as arrays: `names`, instances (and supports) in the sequential order, and the places of their cells."""

    def __init__(self, table: pa.Table, corner: tuple[int, int], block: int):
        ids = table.column("id").combine_chunks().dictionary_encode()
        kinds, code = table.column("kind").to_numpy().astype(np.int64), ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        unit, first, which = np.unique(code * 2 + kinds, return_index=True, return_inverse=True)
        names, picked = ids.dictionary.to_pylist(), table.take(pa.array(first))
        confidence = picked.column("confidence").to_pylist()

        def key(i: int):  # as Spark sorts (-confidence, id): null first, NaN last
            c = confidence[i]
            return (0, 0.0) if c is None else (2, 0.0) if c != c else (1, -c), names[unit[i] // 2]

        order = sorted(range(len(unit)), key=key)
        rank = np.empty(len(unit), np.int64)
        rank[order] = np.arange(len(unit))
        rows, cols = (table.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        at = np.lexsort((cols, rows, rank[which]))
        self.row, self.col = rows[at], cols[at]
        self.place = (self.row - corner[0]) * block + self.col - corner[1]
        self.cuts = np.append(0, np.cumsum(np.bincount(rank[which], minlength=len(unit))))
        self.names = [names[unit[i] // 2] for i in order]
        self.confidence = [confidence[i] for i in order]
        self.kind = [int(unit[i] % 2) for i in order]
        box = np.array([picked.column(c).to_numpy() for c in BOX]).T[order]
        self.box = box.tolist()
        self.whole = ((box[:, 0] >= corner[0]) & (box[:, 1] < corner[0] + block) & (box[:, 2] >= corner[1]) & (box[:, 3] < corner[1] + block)).tolist()


def _table(schema: str, columns: list) -> pa.Table:
    kinds = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def free_parts(cells: DataFrame, confidence: DataFrame, allowed: np.ndarray, reach: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(cells of the parts that instances keep, free cells of the instances still open), see `resolve_conflicts`.

    `allowed[size]` tells whether a part of that size is large enough, up to the cells of a block.
    """
    schema = ROW + ", first_row bigint, first_col bigint, size bigint"

    def decide(table: pa.Table, corner: tuple[int, int]) -> pa.Table:
        b = Block(table, corner, block)
        state = np.zeros(block * block, np.int8)  # 1: taken, 2: claimed by an instance that is still open
        n = len(b.place)
        keep, kind = np.zeros(n, bool), np.full(n, OPEN, np.int32)
        head_row, head_col, size = (np.zeros(n, np.int64) for _ in range(3))
        for i in range(len(b.names)):
            own = np.arange(b.cuts[i], b.cuts[i + 1])
            seen = state[b.place[own]]
            own = own[seen != 1]
            if not len(own):
                continue
            if not b.whole[i] or (seen == 2).any():
                state[b.place[own]] = 2
                keep[own] = True
                continue
            run, first = _first_runs(np.zeros(len(own), np.int64), b.row[own], b.col[own], reach)
            head = first[run]
            starts = np.searchsorted(run, np.arange(run[-1] + 1))
            count = np.bincount(head, minlength=run[-1] + 1)[head]
            good = allowed[count]
            mine, lead = own[good], own[starts[head]][good]
            state[b.place[mine]] = 1
            keep[mine], kind[mine], size[mine] = True, CLOSED, count[good]
            head_row[mine], head_col[mine] = b.row[lead], b.col[lead]
        unit = np.repeat(np.arange(len(b.names)), np.diff(b.cuts))[keep]
        box = np.array(b.box, np.int64).reshape(-1, 4)[unit]
        out = [pa.array(b.names, pa.string()).take(pa.array(unit)), pa.array(b.confidence, pa.float64()).take(pa.array(unit)), b.row[keep], b.col[keep],
               *box.T, kind[keep], head_row[keep], head_col[keep], size[keep]]
        return _table(schema, out)

    done, left = passes(boxed(cells, confidence), block, decide, schema)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found, left


def grow_supports(cells: DataFrame, confidence: DataFrame, iou: float, containment: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, kept) of the decided instances, (kept, row, col) of finished supports, and the rows still open; see `merge_instances`.

    An instance is decided if it and all supports it meets lie in the block, no open instance before it shares a cell with
    it and none touched those supports. A support that lies in the block and meets no open instance is finished.
    """
    schema = ROW + ", kept string"

    def decide(table: pa.Table, corner: tuple[int, int]) -> pa.Table:
        b = Block(table, corner, block)
        claimed, cover = np.zeros(block * block, bool), {}  # cover: supports by place
        area, box, whole, open_, decided = {}, {}, {}, [], []
        touched = set()  # supports that an open instance meets
        for s in range(len(b.names)):  # the supports of the passes before come first
            if b.kind[s] == SUPPORT:
                own = b.place[b.cuts[s]:b.cuts[s + 1]].tolist()
                area[s], box[s], whole[s] = len(own), list(b.box[s]), b.whole[s]
                for p in own:
                    cover.setdefault(p, []).append(s)
        for i in range(len(b.names)):
            if b.kind[i] == SUPPORT:
                continue
            places = b.place[b.cuts[i]:b.cuts[i + 1]]
            own = places.tolist()
            met = Counter(s for p in own for s in cover.get(p, ()))
            if not b.whole[i] or claimed[places].any() or any(not whole[s] or s in touched for s in met):
                claimed[places] = True
                touched.update(met)
                open_.append(i)
                continue
            into = i
            for s in sorted(met):  # numbers follow the order of confidence
                shared, n, k = met[s], len(own), area[s]
                if shared >= iou * (n + k - shared) or shared >= containment * min(n, k):
                    into = s
                    break
            decided.append((i, into))
            if into == i:
                area[i], box[i], whole[i] = 0, list(b.box[i]), True
            mine, other = box[into], b.box[i]
            box[into] = [min(mine[0], other[0]), max(mine[1], other[1]), min(mine[2], other[2]), max(mine[3], other[3])]
            for p in own:
                there = cover.setdefault(p, [])
                if into not in there:
                    there.append(into)
                    area[into] += 1
        grown = [(s, p) for p, there in cover.items() for s in there]
        unit = np.array([s for s, _ in grown], np.int64)
        spot = np.array([p for _, p in grown], np.int64)
        cut = np.concatenate([np.arange(b.cuts[i], b.cuts[i + 1]) for i in open_] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.array(open_, np.int64), [b.cuts[i + 1] - b.cuts[i] for i in open_])
        finished = np.array([CLOSED if whole[s] and s not in touched else SUPPORT for s in unit], np.int32)
        boxes = np.array([box[s] for s in unit] + [b.box[i] for i in owner] + [b.box[i] for i, _ in decided], np.int64).reshape(-1, 4)
        who = np.concatenate([unit, owner, np.array([i for i, _ in decided], np.int64)])
        nothing = [None] * len(decided)
        rows = np.concatenate([spot // block + corner[0], b.row[cut]]).tolist() + nothing
        cols = np.concatenate([spot % block + corner[1], b.col[cut]]).tolist() + nothing
        kinds = np.concatenate([finished, np.full(len(cut), OPEN, np.int32), np.full(len(decided), DECIDED, np.int32)])
        kept = [None] * (len(unit) + len(cut)) + [b.names[s] for _, s in decided]
        names = pa.array(b.names, pa.string())
        return _table(schema, [names.take(pa.array(who)), pa.array(b.confidence, pa.float64()).take(pa.array(who)), rows, cols, *boxes.T, kinds, kept])

    done, left = passes(boxed(cells, confidence), block, decide, schema)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return (found.where(F.col("kind") == DECIDED).select("id", "kept"),
            found.where(F.col("kind") == CLOSED).select(F.col("id").alias("kept"), "row", "col"), left)

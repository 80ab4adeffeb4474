"""Hard-negative mining: Hilbert-ordered blocks of vectors with zone maps, read only where interval bounds ask for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.session import materialize, ship_package

#: Rows of a block, anchors that meet a block at once, zone maps that meet those anchors at once.
BLOCK, CHUNK, ZONES = 1024, 256, 256
#: Bits of a component on the Hilbert curve, for up to KEY_BITS in all.
BITS, KEY_BITS = 4, 512
#: Components beyond it have no part: sums of their products could pass 64 bits.
LARGEST = 1 << 28
MIN, MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCKS = "block bigint, label bigint, n int, ids binary, vectors binary, low binary, high binary"
ANCHORS = "chunk bigint, keys binary, ids binary, labels binary, vectors binary, lows binary, highs binary"


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of small non-negative integers, as bytes that sort like it."""
    x = x.T.astype(np.uint32).copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(dims):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t).astype(np.uint32)
            if i:
                x[i] ^= t.astype(np.uint32)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        t ^= np.where(x[-1] & q, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= t
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to `width`."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): distinct rows that take part, labels shifted where vec_id is divisible by 7, components floor(256 x)."""
    fine = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine)
    rows = rows.where(f"forall(embedding, x -> abs(256 * x) < {LARGEST})")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x).cast("int")).alias("q")).distinct()


def blocks_of(rows: DataFrame, ranges: int) -> DataFrame:
    """Blocks of BLOCK rows of one label in the order of the Hilbert curve, a row each, with the least and largest value of every component."""
    # component ranges: one row for each task and component, then for each component
    width = rows.agg(F.max(F.size("q"))).first()[0] or 0

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, MAX), np.full(width, MIN)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    found = rows.select("q").mapInArrow(spans, "d bigint, low bigint, high bigint").groupBy("d").agg(F.min("low"), F.max("high")).collect()  # one row for each component
    limits = np.array([[r[1], r[2]] for r in sorted(found)], np.float64).reshape(-1, 2)
    bits = max(1, min(BITS, KEY_BITS // max(width, 1)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, size = limits[:, 0], np.maximum(limits[:, 1] - limits[:, 0] + 1, 1)
        for batch in batches:
            cells = ((_matrix(batch.column(2), width) - low) * (1 << bits) // size).astype(np.int64)
            keys = hilbert_keys(cells, bits) if width and batch.num_rows else np.zeros((batch.num_rows, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], ["vec_id", "label", "q", "place"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def emit(label: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            order = np.argsort(ids, kind="stable")
            x = x[order].astype(np.int32)
            number += 1
            cells = [number, label, len(ids), ids[order].tobytes(), x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], ["block", "label", "n", "ids", "vectors", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = _matrix(batch.column(2), width)
            if held is not None:
                ids, labels, x = np.concatenate([held[0], ids]), np.concatenate([held[1], labels]), np.concatenate([held[2], x])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
            held = None
            for s, e in zip(cuts[:-1], cuts[1:]):
                at = s
                while e - at >= BLOCK or e < len(labels) and at < e:
                    to = min(e, at + BLOCK)
                    yield emit(int(labels[at]), ids[at:to], x[at:to])
                    at = to
                if at < e:
                    held = ids[at:e], labels[at:e], x[at:e]
        if held is not None:
            yield emit(int(held[1][0]), held[0], held[2])

    placed = rows.select("vec_id", "label", "q").mapInArrow(keyed, "vec_id bigint, label bigint, q array<int>, place binary")
    ordered = placed.repartitionByRange(ranges, "label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id")
    return materialize(ordered.select("vec_id", "label", "q").mapInArrow(packed, BLOCKS))


def _ints(cell: bytes, width: int | None = None) -> np.ndarray:
    return np.frombuffer(cell, np.int64) if width is None else np.frombuffer(cell, np.int32).reshape(-1, width)


def _pack(fields: list) -> list[bytes]:
    return [np.ascontiguousarray(x).tobytes() for x in fields]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by way of doubles where these are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max())
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def anchors_of(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """Anchors in chunks, with the k-th best score that their own block has for them as a floor of their first window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, n = TaskContext.get().partitionId() << 24, [], 0

        def emit() -> pa.RecordBatch:
            nonlocal chunk, held, n
            ids, labels, x, floors = (np.concatenate([h[i] for h in held]) for i in range(4))
            keys = chunk * CHUNK + np.arange(len(ids))
            cells = _pack([keys, ids, labels, x, floors, np.full(len(ids), MAX)])
            out = pa.RecordBatch.from_arrays([pa.array([chunk]), *[pa.array([c], pa.binary()) for c in cells]], [f.split()[0] for f in ANCHORS.split(", ")])
            chunk, held, n = chunk + 1, [], 0
            return out

        for batch in batches:
            for label, ids, vectors in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids = _ints(ids)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                x = _ints(vectors, len(vectors) // 4 // len(ids))
                own = scores(x[at], x)
                own[ids[at][:, None] == ids[None, :]] = MIN
                floors = np.partition(own, -k, axis=1)[:, -k] if own.shape[1] >= k else np.full(len(at), MIN)
                for s in range(0, len(at), CHUNK):
                    if n + min(CHUNK, len(at) - s) > CHUNK:
                        yield emit()
                    held.append((ids[at[s:s + CHUNK]], np.full(len(at[s:s + CHUNK]), label, np.int64), x[at[s:s + CHUNK]], floors[s:s + CHUNK]))
                    n += len(held[-1][0])
        if held:
            yield emit()

    return materialize(blocks.select("label", "ids", "vectors").mapInArrow(run, ANCHORS))


def zone_maps(blocks: DataFrame) -> DataFrame:
    """(zone, blocks, labels, lows, highs): zone maps of up to ZONES blocks in a row; only their columns of the blocks are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zone = TaskContext.get().partitionId() << 24
        for batch in batches:
            for s in range(0, batch.num_rows, ZONES):
                part = batch.slice(s, ZONES)
                cells = [part.column(0).to_numpy().tobytes(), part.column(1).to_numpy().tobytes(), *(b"".join(part.column(c).to_pylist()) for c in (2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array([zone]), *[pa.array([c], pa.binary()) for c in cells]], ["zone", "blocks", "labels", "lows", "highs"])
                zone += 1

    return materialize(blocks.select("block", "label", "low", "high").mapInArrow(run, "zone bigint, blocks binary, labels binary, lows binary, highs binary"))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that any vector between low and high can have with each anchor."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return scores(up, low) + scores(down, high), scores(up, high) + scores(down, low)


def _met(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Every chunk of anchors next to every row of zone maps: the stated query set against all blocks."""
    numbers = [r.zone for r in zones.select("zone").orderBy("zone").collect()]  # one for ZONES x BLOCK vectors
    several = anchors.withColumn("zone", F.explode(F.lit(numbers).cast("array<bigint>")))
    maps = zones.select("zone", F.struct("blocks", "labels", "lows", "highs").alias("map"))
    return several.join(maps, "zone").select("chunk", "keys", "ids", "labels", "vectors", "lows", "highs", "map.blocks", F.col("map.labels").alias("map_labels"),
                                             F.col("map.lows").alias("map_lows"), F.col("map.highs").alias("map_highs"))


def _unpacked(row: tuple) -> tuple:
    keys, ids, labels = (_ints(c) for c in row[:3])
    width = len(row[3]) // 4 // len(ids)
    x = np.frombuffer(row[3], np.int32).reshape(len(ids), width)
    lows, highs = (_ints(c).reshape(len(ids), -1) for c in row[4:6])
    return keys, ids, labels, x, lows, highs


def needed(anchors: DataFrame, zones: DataFrame, same: bool) -> DataFrame:
    """(block, keys, ids, labels, vectors, lows, highs): blocks that may hold a score in a window of some anchors, with those anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                keys, ids, labels, x, lows, highs = _unpacked(row[1:7])
                numbers, kinds = _ints(row[7]), _ints(row[8])
                least, most = bounds(x, *(np.frombuffer(c, np.int32).reshape(len(numbers), x.shape[1]) for c in row[9:11]))
                fits = (labels[:, None] == kinds[None, :]) == same
                near = (most[:, :, None] >= lows[:, None, :]) & (least[:, :, None] <= highs[:, None, :]) & (lows <= highs)[:, None, :]
                fits &= near.any(axis=2)
                for j in np.flatnonzero(fits.any(axis=0)):
                    at = np.flatnonzero(fits[:, j])
                    cells = _pack([keys[at], ids[at], labels[at], x[at], lows[at], highs[at]])
                    yield pa.RecordBatch.from_arrays([pa.array([int(numbers[j])]), *[pa.array([c], pa.binary()) for c in cells]],
                                                     ["block", "keys", "ids", "labels", "vectors", "lows", "highs"])

    return _met(anchors, zones).mapInArrow(run, "block bigint" + ANCHORS.removeprefix("chunk bigint"))


def likeliest(anchors: DataFrame, zones: DataFrame) -> DataFrame:
    """Each chunk of anchors with the block of other labels that bounds promise most of: it yields floors before the full search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                _, _, labels, x, _, _ = _unpacked(row[1:7])
                numbers, kinds = _ints(row[7]), _ints(row[8])
                _, most = bounds(x, *(np.frombuffer(c, np.int32).reshape(len(numbers), x.shape[1]) for c in row[9:11]))
                worth = np.where(labels[:, None] == kinds[None, :], 0.0, most.astype(np.float64)).mean(axis=0)
                j = int(np.argmax(worth))
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([int(numbers[j])]), pa.array([float(worth[j])])], ["chunk", "block", "worth"])

    best = _met(anchors, zones).mapInArrow(run, "chunk bigint, block bigint, worth double").groupBy("chunk").agg(F.max_by("block", F.struct("worth", "block")).alias("block"))
    return anchors.join(best, "chunk").drop("chunk")


def _first_of_groups(found: np.ndarray, k: int) -> np.ndarray:
    """First k rows of (key, slot, id, score) by falling score, then id, of each key and slot."""
    order = np.lexsort((found[:, 2], -found[:, 3], found[:, 1], found[:, 0]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found[:, :2], axis=0) != 0).any(axis=1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return found[np.arange(len(found)) - start < k]


def search(pairs: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, slot, id, score): the first k candidates of each anchor's windows, as far as one task sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                keys, own, labels, x, lows, highs = _unpacked(row[:6])
                ids = _ints(row[7])
                s = scores(x, np.frombuffer(row[8], np.int32).reshape(len(ids), x.shape[1]))
                order = np.argsort(-s, axis=1, kind="stable")  # a block's rows are in the order of their ids
                s, ids = np.take_along_axis(s, order, axis=1), ids[order]
                mine = ids == own[:, None]
                part = (labels == row[6]) == same
                for slot in range(lows.shape[1]):
                    inside = (s <= highs[:, slot, None]) & (s >= lows[:, slot, None]) & part[:, None]
                    if same:
                        inside &= ~mine
                    rank = np.cumsum(inside, axis=1)
                    a, c = np.nonzero(inside & (rank <= k))
                    held.append(np.stack([keys[a], np.full(len(a), slot), ids[a, c], s[a, c]], axis=1))
                    n += len(a)
                if n > 500_000:
                    held = [_first_of_groups(np.concatenate(held), k)]
                    n = 0
        out = _first_of_groups(np.concatenate(held), k) if held else np.empty((0, 4), np.int64)
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[at:at + 10_000, c]) for c in range(4)], ["key", "slot", "id", "score"])

    stored = blocks.select("block", F.col("label").alias("block_label"), F.col("ids").alias("block_ids"), F.col("vectors").alias("block_vectors"))
    met = pairs.join(stored, "block").select("keys", "ids", "labels", "vectors", "lows", "highs", "block_label", "block_ids", "block_vectors")
    found = met.mapInArrow(run, "key bigint, slot bigint, id bigint, score bigint")
    first = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def with_windows(anchors: DataFrame, windows: DataFrame, slots: int) -> DataFrame:
    """`anchors` with the windows (key, slot, low, high); a slot without one is never met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in zip(zip(*(batch.column(c).to_pylist() for c in range(5))), batch.column(5).to_pylist()):
                first = _ints(row[1])[0]
                lows, highs = np.ones((len(row[1]) // 8, slots), np.int64), np.zeros((len(row[1]) // 8, slots), np.int64)
                for w in found:
                    lows[w["key"] - first, w["slot"]], highs[w["key"] - first, w["slot"]] = w["low"], w["high"]
                yield pa.RecordBatch.from_arrays([pa.array([row[0]]), *[pa.array([c], pa.binary()) for c in [*row[1:], *_pack([lows, highs])]]],
                                                 [f.split()[0] for f in ANCHORS.split(", ")])

    lists = windows.groupBy(F.expr(f"key div {CHUNK}").alias("chunk")).agg(F.collect_list(F.struct("key", "slot", "low", "high")).alias("w"))  # at most CHUNK x slots
    return materialize(anchors.join(lists, "chunk").select("chunk", "keys", "ids", "labels", "vectors", "w").mapInArrow(run, ANCHORS))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
                   ranges: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of `vectors` (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`. For each of an anchor's first `positives` rows of its label
    (score falling, then vec_id) come the first `negatives` rows of other labels with a score between `least` and `most`
    percent of the positive's. Scores are integer inner products of floor(256 x).

    Rows of one label are stored in blocks along a Hilbert curve, with the least and largest value of every component.
    Interval arithmetic on these bounds what a block can score with an anchor: a block is read for the positives of an
    anchor if it can reach the floor set by the anchor's own block, and for its negatives if it can reach a window above
    the floor set by one block tried first. In data without clusters bounds exclude little; the answer is the same.

    Rows with a null vec_id, label, vector or component, or a component that is not finite or 2^20 or more in size, take
    no part. Vectors of different lengths count as padded with zeros. Rows equal in vec_id, label and vector count once;
    other rows of one vec_id are candidates, and anchors, of their own, but never each other's positives. Ties go to the
    smaller vec_id. A negative positive score leaves no room for negatives. Empty tables, or no anchors: an empty result.
    Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    rows = materialize(usable(vectors))
    total = rows.count()
    blocks = blocks_of(rows, ranges or max(1, -(-total // (8 * BLOCK))))
    anchors, zones = anchors_of(blocks, every, positives), zone_maps(blocks)
    near = materialize(search(needed(anchors, zones, True), blocks, True, positives))
    best = near.select("key", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    windows = best.select("key", "slot", F.ceil(p * least / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("low"),
                          F.floor(p * most / F.lit(100).cast("decimal(3,0)")).cast("bigint").alias("high")).where("low <= high")
    windows = materialize(windows)
    open_anchors = with_windows(anchors, windows, positives)
    tried = search(likeliest(open_anchors, zones), blocks, False, negatives).where(F.col("rank") == negatives).select("key", "slot", F.col("score").alias("floor"))
    raised = windows.join(tried, ["key", "slot"], "left").select("key", "slot", F.greatest("low", F.coalesce("floor", "low")).alias("low"), "high")
    found = search(needed(with_windows(anchors, raised, positives), zones, False), blocks, False, negatives)
    names = anchors.select("keys", "ids").mapInArrow(_named, "key bigint, anchor_id bigint")
    return found.join(best, ["key", "slot"]).join(names, "key").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_ints(keys)), pa.array(_ints(ids))], ["key", "anchor_id"])


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""

"""Exact nearest neighbours and centroid distances between vector tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.attach import attach
from terraloom.session import materialize, ship_package

BROADCAST_VALUES = 4_000_000  # largest source side (rows * length) sent to every task: 32 MB of doubles
PAIR_VALUES = 4_000_000  # largest distance matrix held at once
CHUNK_ROWS = 20_000  # rows per side of a block when the source is not broadcast


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; a zero row stays zero, so its cosine distance to anything is 1."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _nearest(q: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and distances of the k nearest rows of `s` (sorted by id), ties by id.

    One matrix product gives every distance up to rounding. Euclidean rows are first moved to the source's centre, where
    the expanded square loses least; whatever could still be among the k nearest, given a bound on the rounding error, is
    then measured directly and ranked by that.
    """
    k = min(k, len(s))
    if metric == "cosine":
        qn, sn = _unit(q), _unit(s)
        rough, slack = 1.0 - qn @ sn.T, np.full(len(q), 1e-12)
    else:
        qn, sn = q - s.mean(0), s - s.mean(0)
        qq, ss = (qn * qn).sum(1), (sn * sn).sum(1)
        rough = qq[:, None] + ss[None, :] - 2.0 * qn @ sn.T
        slack = 8 * (q.shape[1] + 2) * np.finfo(float).eps * (qq + ss.max())
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
    positions, distances = np.empty((len(q), k), int), np.empty((len(q), k))
    for i in range(len(q)):
        near = np.flatnonzero(rough[i] <= kth[i] + 2 * slack[i] + 1e-12)
        exact = rough[i][near] if metric == "cosine" else np.sqrt(((q[i] - s[near]) ** 2).sum(1))
        order = np.lexsort((ids[near], np.round(exact, 12)))[:k]
        positions[i], distances[i] = near[order], exact[order]
    return positions, distances


def _rows(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int, metric: str) -> Iterator[pd.DataFrame]:
    step = max(1, PAIR_VALUES // max(1, len(s)))
    for at in range(0, len(q), step):
        pos, dist = _nearest(q[at:at + step], s, ids, k, metric)
        width = pos.shape[1]
        yield pd.DataFrame({
            "query_id": np.repeat(query_ids[at:at + step], width), "neighbor_id": ids[pos].ravel(), "distance": dist.ravel()})


def knn(queries: DataFrame, source: DataFrame, row: str, vector: str, k: int, metric: str) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest source rows, ties by id.

    The source is counted first. A small one goes to every task once and each batch of queries is one matrix product that
    leaves k rows per query. A larger one is cut into cells around pivots: both sides are assigned to their nearest pivot,
    and by the triangle inequality cells that are too far from a cell of queries to hold one of its k nearest are not met
    at all. Large cells are split by hash, so no task holds more than one pair of chunks; the final top k is taken across.
    """
    ship_package(source.sparkSession)
    size = source.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    schema = "query_id bigint, neighbor_id bigint, distance double"
    if size.n * (size.d or 0) <= BROADCAST_VALUES:
        local = source.select(row, vector).orderBy(row).toPandas()
        shared = source.sparkSession.sparkContext.broadcast((local[row].to_numpy(), np.array(local[vector].tolist(), dtype=float)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, s = shared.value
            for batch in batches:
                if len(batch) and len(ids):
                    yield from _rows(batch[row].to_numpy(), np.array(batch[vector].tolist(), dtype=float), ids, s, k, metric)

        found = queries.select(row, vector).mapInPandas(scan, schema)
    else:
        found = _blocked(queries, source, row, vector, k, metric, size.n, schema)
    nearest = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "neighbor_id")
    return found.withColumn("rank", F.row_number().over(nearest).cast("bigint")).where(F.col("rank") <= k)


def _placed(rows: DataFrame, row: str, vector: str, pivots: np.ndarray, metric: str) -> DataFrame:
    """(row, vector, _p, _d): nearest pivot of each row and the distance to it; pivot -1 is for rows without direction (cosine of zero)."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch[vector].tolist(), dtype=float)
                x = _unit(x) if metric == "cosine" else x
                near, far = np.zeros(len(x), int), np.full(len(x), np.inf)
                for i, p in enumerate(pivots):
                    d = np.sqrt(((x - p) ** 2).sum(1))
                    near, far = np.where(d < far, i, near), np.minimum(d, far)
                if metric == "cosine":
                    near = np.where((x == 0).all(1), -1, near)
                yield batch.assign(_p=near.astype("int64"), _d=far)

    kinds = dict(rows.dtypes)
    return materialize(rows.select(row, vector).mapInPandas(place, f"`{row}` {kinds[row]}, `{vector}` {kinds[vector]}, _p bigint, _d double"))


def near_cells(pivots: np.ndarray, queries: dict[int, tuple[int, float]], source: dict[int, tuple[int, float]], k: int) -> list[tuple[int, int]]:
    """Pairs (query cell, source cell) that may hold one of the k nearest; cells are pivot -> (rows, radius).

    Whole source cells within reach of a query cell bound its k-th distance from above; a cell whose nearest possible row
    lies beyond that is left out. Cell -1 has no place and is always met. A margin covers rounding and ties.
    """
    pairs = []
    cells = sorted(c for c in source if c >= 0)
    for q, (_, rq) in sorted(queries.items()):
        if -1 in source:
            pairs.append((q, -1))
        if q < 0:
            pairs += [(q, c) for c in cells]
            continue
        apart = np.sqrt(((pivots[cells] - pivots[q]) ** 2).sum(1)) if cells else np.empty(0)
        reach = np.array([source[c][1] for c in cells])
        far, held = apart + rq + reach, np.array([source[c][0] for c in cells])
        order = np.argsort(far)
        enough = np.flatnonzero(np.cumsum(held[order]) >= k)
        limit = far[order][enough[0]] if len(enough) else np.inf
        margin = 1e-6 * (1 + limit) if np.isfinite(limit) else 0.0
        pairs += [(q, c) for c, low in zip(cells, apart - rq - reach) if low <= limit + margin]
    return pairs


def _blocked(queries: DataFrame, source: DataFrame, row: str, vector: str, k: int, metric: str, n_source: int, schema: str) -> DataFrame:
    spark = source.sparkSession
    wanted = max(16, min(1024, 4 * -(-n_source // CHUNK_ROWS)))
    drawn = source.select(vector).orderBy(F.xxhash64(row)).limit(wanted).toPandas()[vector]  # at most 1024 vectors
    pivots = np.unique(np.array(drawn.tolist(), dtype=float), axis=0)
    if metric == "cosine":
        pivots = np.unique(_unit(pivots), axis=0)
    placed = {"q": _placed(queries, row, vector, pivots, metric), "s": _placed(source, row, vector, pivots, metric)}
    cells = {side: {r._p: (r.n, r.d) for r in df.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("d")).collect()} for side, df in placed.items()}
    pairs = near_cells(pivots, cells["q"], cells["s"], k)
    chunks = {side: {p: -(-n // CHUNK_ROWS) for p, (n, _) in c.items()} for side, c in cells.items()}
    met = spark.createDataFrame([(q, s, chunks["q"][q], chunks["s"][s]) for q, s in pairs], "_pq bigint, _ps bigint, _nq bigint, _ns bigint")

    def meet(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbor_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        if not len(q) or not len(s):
            return empty
        s = s.sort_values(row)
        return pd.concat(list(_rows(q[row].to_numpy(), np.array(q[vector].tolist(), dtype=float), s[row].to_numpy(),
                                    np.array(s[vector].tolist(), dtype=float), k, metric)))

    def side(own: str, other: str) -> DataFrame:
        """Rows of one side, once for each chunk of the other side that their cell meets."""
        mine = placed[own].select(row, vector, F.col("_p").alias(f"_p{own}")).join(met, f"_p{own}")
        return mine.select(row, vector, "_pq", "_ps", F.pmod(F.xxhash64(row), F.col(f"_n{own}")).alias(f"_c{own}"),
                           F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_n{other}") - 1)).alias(f"_c{other}"))

    keys = ["_pq", "_ps", "_cq", "_cs"]
    return side("q", "s").groupBy(*keys).cogroup(side("s", "q").groupBy(*keys)).applyInPandas(meet, schema)


def mean_distance(neighbors: DataFrame, name: str) -> DataFrame:
    return neighbors.groupBy("query_id").agg(F.avg("distance").alias(name))


def centroid_distance(df: DataFrame, train: DataFrame, label: str, vector: str) -> DataFrame:
    """Euclidean distance to the nearest class mean; the means travel as one short array."""
    long = train.select(label, F.posexplode(vector).alias("_i", "_v")).groupBy(label, "_i").agg(F.avg("_v").alias("_m"))
    means = long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda e: e["_m"]).alias("_c"))
    packed = means.agg(F.collect_list("_c").alias("_centers"))
    square = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return attach(df, packed, []).withColumn("distance", F.sqrt(F.array_min(F.transform("_centers", square)))).drop("_centers")

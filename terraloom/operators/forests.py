"""Random forests on many rows: large nodes are split from summed histograms, small ones are grown to the end in one task.

Spark ML makes one pass and shuffles the histograms of all open nodes for each level of a forest, and most nodes of a deep
tree hold a few rows only. Here a row is 1 byte a feature; nodes of more than NODE_ROWS drawn rows are split level by level
from histograms that Spark sums, and each smaller node goes with its rows to one task that grows all of its subtree. The
rules are Spark ML's: Poisson bags, 32 bins from at most 10,000 rows, sqrt features a node, Gini gain on weights, leaf size
in drawn rows, twin leaves with the same prediction merged.

Studies fit very many forests on few rows each: `fit_runs` gives each forest to one task, which grows its trees together and
scores the evaluation rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.session import materialize, ship_package

NODE_ROWS = 16_384  # drawn rows of a node that one task may grow to the end
SPLIT_ROWS = 10_000  # rows that the bins are taken from
BINS = 32
GROW_TASKS = 2_000
RUN_VALUES = 10_000_000  # largest shared or evaluation side (rows * length) that the tasks of `fit_runs` hold
TREE_ROWS = 50_000  # rows of all trees that one of them grows or scores at once
OPEN_NODES = 256  # nodes whose histograms it holds at once
SORTED_ROWS = 64  # rows of a node up to which its cuts are read off sorted rows, since most of its bins would be empty
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(12)])
PLACED = "tree int, node bigint, drawn int, bins binary, y double, w double"
NODES = "tree int, node bigint, feature int, bin int, s0 double, s1 double"
SORTED_PLACES = 1 << 20  # rows sorted at once: their places fill 20 bits


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """64 hashed bits of the parts (splitmix), broadcast against each other."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype("uint64")) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def drawn_times(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is in the bag of a tree: Poisson with mean 1, by hash."""
    return np.searchsorted(POISSON, _mix(seed, 1, tree, rows) / 2.0**64)


def node_features(seed: int, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """Features that each node may split on, by hash of the node, in rising order."""
    take = ceil(sqrt(width))
    order = _mix(seed, 2, tree, nodes[:, None], np.arange(width)[None, :])
    return np.sort(np.argpartition(order, take - 1, axis=1)[:, :take], axis=1)


def histograms(bins: np.ndarray, slot: np.ndarray, features: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """(3, node, feature of the node, bin): weight of class 0, of class 1 and drawn rows."""
    nodes, take = features.shape
    at = (slot[:, None] * take + np.arange(take)) * BINS + bins[np.arange(len(slot))[:, None], features[slot]]
    total = lambda v: np.bincount(at.ravel(), np.repeat(v, take), nodes * take * BINS)
    return np.stack([total(w * drawn * (y == 0)), total(w * drawn * (y == 1)), total(drawn)]).reshape(3, nodes, take, BINS)


FOUND = ["feature", "bin", "s0", "s1", "n", "l0", "l1", "ln"]


def best_splits(h: np.ndarray, features: np.ndarray, leaf: int) -> pd.DataFrame:
    """One row a node: its totals, and the split of highest Gini gain with the totals left of it; feature -1 where none gains."""
    return pd.DataFrame(_best(h, features, leaf), columns=FOUND).astype({"feature": "int64", "bin": "int64"})


def _best(h: np.ndarray, features: np.ndarray, leaf: int) -> np.ndarray:
    left, whole = np.cumsum(h, axis=3)[..., :-1], h[:, :, :1].sum(3, keepdims=True)
    right = whole - left
    impure = lambda s: 2.0 * s[0] * s[1] / np.maximum(s[0] + s[1], 1e-300)  # noqa: E731  (impurity times weight)
    gain = (impure(whole) - impure(left) - impure(right)) / np.maximum(whole[0] + whole[1], 1e-300)
    gain = np.where((left[2] >= leaf) & (right[2] >= leaf), gain, -1.0).reshape(len(features), -1)
    best, at = gain.argmax(1), np.arange(len(features))
    place, cut = np.divmod(best, BINS - 1)
    part = left[:, at, place, cut]
    return np.column_stack([np.where(gain[at, best] > 1e-12, features[at, place], -1), cut, whole[:, :, 0, 0].T, part.T])


def level_of(node: np.ndarray) -> np.ndarray:
    """Depth of a node: the root is 1, the children of i are 2 i and 2 i + 1."""
    return np.frexp(np.asarray(node, dtype=float))[1] - 1


def _children(nodes: np.ndarray, found: pd.DataFrame, leaf: int, depth: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Both children of each split node with their totals, and which of them cannot be split further."""
    split = found["feature"].to_numpy() >= 0
    f, up = found[split], nodes[split]
    left = pd.DataFrame({"node": 2 * up, "s0": f["l0"], "s1": f["l1"], "n": f["ln"]})
    right = pd.DataFrame({"node": 2 * up + 1, "s0": f["s0"] - f["l0"], "s1": f["s1"] - f["l1"], "n": f["n"] - f["ln"]})
    both = pd.concat([left, right], ignore_index=True)
    least = both[["s0", "s1"]].min(axis=1) <= 1e-12 * (both["s0"] + both["s1"])
    return both, (least | (both["n"] < 2 * leaf) | (level_of(both["node"]) >= depth)).to_numpy()


def merged_twins(nodes: pd.DataFrame) -> pd.DataFrame:
    """Nodes without pairs of leaves that predict the same class; their parent becomes the leaf. Of one tree, or by `tree`."""
    nodes = nodes.sort_values(["tree", "node"] if "tree" in nodes else "node", ignore_index=True)
    ids, feature = nodes["node"].to_numpy(), nodes["feature"].to_numpy().copy()
    keys = ids + (nodes["tree"].to_numpy().astype("int64") << 32) if "tree" in nodes else ids  # a node is below 2^31
    says, keep, level = (nodes["s1"] > nodes["s0"]).to_numpy(), np.ones(len(nodes), bool), level_of(ids)
    for d in range(int(level.max()) - 1, int(level.min()) - 1, -1):
        up = np.flatnonzero((level == d) & (feature >= 0))
        a = np.searchsorted(keys, keys[up] + ids[up])  # the left child, and the right one after it
        b = a + 1
        twins = (feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])
        feature[up[twins]] = -1
        keep[a[twins]] = keep[b[twins]] = False
    return nodes.assign(feature=feature)[keep]


def grow(seed: int, tree: int, root: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, leaf: int, depth: int) -> pd.DataFrame:
    """All nodes of the subtree under `root`, level by level."""
    open_nodes, out = np.array([root]), []
    slot = np.zeros(len(y), int)
    while len(open_nodes):
        features = node_features(seed, tree, open_nodes, bins.shape[1])
        found = best_splits(histograms(bins, slot, features, y, w, drawn), features, leaf)
        out.append(found.assign(node=open_nodes)[["node", "feature", "bin", "s0", "s1"]])
        children, done = _children(open_nodes, found, leaf, depth)
        out.append(children[done].assign(feature=-1, bin=0)[["node", "feature", "bin", "s0", "s1"]])
        feature, cut = found["feature"].to_numpy()[slot], found["bin"].to_numpy()[slot]
        inner = feature >= 0
        node = 2 * open_nodes[slot] + (bins[np.arange(len(slot)), feature] > cut)
        following = np.sort(children["node"].to_numpy()[~done])
        spot = np.searchsorted(following, node)
        stay = inner & (following[np.minimum(spot, len(following) - 1)] == node) if len(following) else np.zeros(len(node), bool)
        bins, y, w, drawn, slot, open_nodes = bins[stay], y[stay], w[stay], drawn[stay], spot[stay], following
    return merged_twins(pd.concat(out, ignore_index=True))


def _cells(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Place of each row in the histograms of its node, one for each feature of the node."""
    take, width = features.shape[1], bins.shape[1]
    values = np.take(bins.ravel(), (row * width)[:, None] + features[slot], mode="clip")
    return (slot[:, None] * take + np.arange(take)) * BINS + values


def _kind_histograms(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, features: np.ndarray, kind: np.ndarray, weights: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """What `histograms` gives, from counts of the kinds of rows (see `_kinds`), two of them in one number."""
    cells, size = _cells(bins, row, slot, features), features.size * BINS
    h = np.zeros((3, size))
    for i in (0, 2) if weights[2:].any() else (0,):
        on = np.flatnonzero(kind >> 1 == i >> 1) if weights[2:].any() else slice(None)
        both = np.bincount(cells[on].ravel(), np.repeat(drawn[on] * np.where(kind[on] & 1, 67_108_864.0, 1.0), features.shape[1]), size)
        ones = np.floor(both / 67_108_864.0)
        zeros = both - ones * 67_108_864.0
        h += zeros * weights[i], ones * weights[i + 1], zeros + ones
    return h.reshape(3, *features.shape, BINS)


def sorted_splits(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, features: np.ndarray, counts: np.ndarray, weights: np.ndarray, leaf: int) -> np.ndarray:
    """What `best_splits` finds, from the rows of each node in the order of their bins; columns as FOUND.

    `counts` has the drawn times of each row, in 16 of 64 bits by its kind (class, and which of two weights), so that one
    running sum counts all kinds exactly; `weights` are those of the kinds (0a, 1a, 0b, 1b). Rows lie in the order of nodes.
    """
    nodes, take = features.shape
    at = _cells(bins, row, slot, features)
    line = np.sort((at * SORTED_PLACES + np.arange(len(row))[:, None]).ravel())  # place of the row in the low bits
    place, at = np.divmod(line, SORTED_PLACES)
    below = np.concatenate([[0], np.cumsum(counts[at])])
    first = np.concatenate([[0], np.cumsum(np.repeat(np.bincount(slot, minlength=nodes), take))])  # of each node and feature

    def sums(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = c & 0xFFFF, c >> 16 & 0xFFFF
        if not weights[2:].any():
            return a * weights[0], b * weights[1], a + b
        e, f = c >> 32 & 0xFFFF, c >> 48 & 0xFFFF
        return a * weights[0] + e * weights[2], b * weights[1] + f * weights[3], a + b + e + f

    s0, s1, n = sums(below[first[1::take]] - below[first[:-1:take]])
    out = np.column_stack([np.full(nodes, -1.0), np.zeros(nodes), s0, s1, n, np.zeros((nodes, 3))])
    line = place // BINS
    cut = np.flatnonzero((place[1:] != place[:-1]) & (line[1:] == line[:-1]))
    group = line[cut]
    node = group // take
    l0, l1, ln = sums(below[cut + 1] - below[first[group]])
    keep = np.flatnonzero((ln >= leaf) & (n[node] - ln >= leaf))
    if not len(keep):
        return out
    node, l0, l1 = node[keep], l0[keep], l1[keep]
    impure = lambda a, b: 2.0 * a * b / np.maximum(a + b, 1e-300)
    gain = (impure(s0, s1)[node] - impure(l0, l1) - impure(s0[node] - l0, s1[node] - l1)) / (s0 + s1)[node]  # as `best_splits` rounds it
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(node)))))
    top = top[np.concatenate([[True], node[top][1:] != node[top][:-1]])]
    top = top[gain[top] > 1e-12]
    at = node[top]
    chosen = keep[top]
    out[at, 0], out[at, 1] = features[at, group[chosen] % take], place[cut[chosen]] % BINS
    out[at, 5], out[at, 6], out[at, 7] = l0[top], l1[top], ln[chosen]
    return out


def _level(bins: np.ndarray, row: np.ndarray, slot: np.ndarray, features: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, kinds, leaf: int) -> np.ndarray:
    """Splits of all open nodes, columns as FOUND; rows lie in the order of nodes."""
    few = np.bincount(slot, minlength=len(features)) <= (SORTED_ROWS if kinds is not None else -1)
    out = np.empty((len(features), len(FOUND)))
    for small in (False, True):
        chosen = np.flatnonzero(few == small)
        if not len(chosen):
            continue
        new = np.full(len(features), -1)
        new[chosen] = np.arange(len(chosen))
        on = np.flatnonzero(new[slot] >= 0)
        r, s, d, f = row[on], new[slot[on]], drawn[on], features[chosen]
        step = max(1, SORTED_PLACES // SORTED_ROWS) if small else OPEN_NODES
        for at in range(0, len(f), step):
            a, b = np.searchsorted(s, (at, at + step))
            rows, slots, times, own = r[a:b], s[a:b] - at, d[a:b], f[at:at + step]
            if small:
                out[chosen[at:at + step]] = sorted_splits(bins, rows, slots, own, times.astype("int64") << (16 * kinds[0][rows]), kinds[1], leaf)
                continue
            if kinds is None:
                h = histograms(bins[rows], slots, own, y[rows], w[rows], times)
            else:
                h = _kind_histograms(bins, rows, slots, own, kinds[0][rows], kinds[1], times)
            out[chosen[at:at + step]] = _best(h, own, leaf)
    return out


def _kinds(y: np.ndarray, w: np.ndarray):
    """Kind of each row (class, and first or second weight of the class) and the weights of the kinds; None if a class has more than two."""
    kind, weights = np.zeros(len(y), "int64"), np.zeros(4)
    for c in (0, 1):
        on = y == c
        values, which = np.unique(w[on], return_inverse=True)
        if len(values) > 2:
            return None
        kind[on] = c + 2 * which
        weights[c:c + 2 * len(values):2] = values
    return kind, weights


def grow_trees(seed: int, trees: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: int, depth: int) -> pd.DataFrame:
    """All nodes of whole trees on the same rows, level by level over the trees together; the nodes that `grow` gives, up to the rounding of sums."""
    times = np.stack([drawn_times(seed, t, np.arange(len(y))) for t in trees])
    slot, row = np.nonzero(times)
    drawn, out, kinds = times[slot, row], [], _kinds(y, w)
    tree, node, level = np.asarray(trees), np.ones(len(trees), "int64"), 0
    while len(node):
        level += 1
        features = node_features(seed, tree[:, None], node, bins.shape[1])
        found = _level(bins, row, slot, features, y, w, drawn, kinds, leaf)
        out.append((tree, node, found[:, 0], found[:, 1], found[:, 2], found[:, 3]))
        up = np.flatnonzero(found[:, 0] >= 0)
        left, whole = found[up, 5:], found[up, 2:5]
        s = np.stack([left, whole - left], axis=1).reshape(-1, 3)  # both children of each split node, in the order of (tree, node)
        of, ids = np.repeat(tree[up], 2), np.stack([2 * node[up], 2 * node[up] + 1], axis=1).ravel()
        done = (s[:, :2].min(1) <= 1e-12 * (s[:, 0] + s[:, 1])) | (s[:, 2] < 2 * leaf) | (level >= depth)
        out.append((of[done], ids[done], np.full(done.sum(), -1.0), np.zeros(done.sum()), s[done, 0], s[done, 1]))
        # where the rows of each child go on: its place among the open nodes of the next level, or nowhere
        place = np.full((len(node), 2), -1)
        place[up] = np.where(done, -1, np.cumsum(~done) - 1).reshape(-1, 2)
        chosen = found[slot, :2].astype("int64")
        spot = place[slot, (bins[row, chosen[:, 0]] > chosen[:, 1]).astype(int)]
        stay = np.flatnonzero(spot >= 0)
        stay = stay[np.argsort(spot[stay], kind="stable")]
        row, drawn, slot, tree, node = row[stay], drawn[stay], spot[stay], of[~done], ids[~done]
    nodes = pd.DataFrame(dict(zip(("tree", "node", "feature", "bin", "s0", "s1"), (np.concatenate(c) for c in zip(*out)))))
    return merged_twins(nodes.astype({"feature": "int64", "bin": "int64"}))


def summed_probabilities(nodes: pd.DataFrame, trees: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Sum over the trees of P(class 1) in the leaf of each row; nodes are in the order of (tree, node)."""
    ids, feature, limit = nodes["node"].to_numpy(), nodes["feature"].to_numpy(), nodes["bin"].to_numpy()
    keys = ids + (nodes["tree"].to_numpy().astype("int64") << 32)
    inner = feature >= 0
    left = np.where(inner, np.searchsorted(keys, keys + ids), 0)
    p = (nodes["s1"] / (nodes["s0"] + nodes["s1"])).to_numpy()
    out = np.zeros(len(bins))
    roots = np.searchsorted(keys, (np.asarray(trees).astype("int64") << 32) + 1)
    step = max(1, TREE_ROWS // max(1, len(trees)))
    for at in range(0, len(bins), step):
        part = bins[at:at + step]
        row = np.tile(np.arange(len(part)), len(roots))
        here = np.repeat(roots, len(part))
        end, going = here.copy(), np.arange(len(here))
        while len(going):
            on = inner[here]
            end[going[~on]] = here[~on]
            going, row, here = going[on], row[on], here[on]
            here = left[here] + (part[row, feature[here]] > limit[here])
        out[at:at + step] = p[end].reshape(len(roots), len(part)).sum(0)
    return out


def cut_points(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """At most BINS - 1 midpoints between neighbouring values that cut the weight into equal parts."""
    distinct, at = np.unique(values, return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(distinct) <= BINS:
        return middle
    below = np.cumsum(np.bincount(at, weights))[:-1]
    return np.unique(middle[np.minimum(np.searchsorted(below, weights.sum() * np.arange(1, BINS) / BINS), len(middle) - 1)])


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(cut, x[:, i]) for i, cut in enumerate(cuts)], axis=1).astype("uint8")


def forest_probabilities(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int, seed: int, leaf: int, depth: int, rows: np.ndarray) -> np.ndarray:
    """P(class 1) of `rows` by a forest on (x, y, w); bins are taken from at most SPLIT_ROWS rows by hash."""
    sample = np.argsort(_mix(seed, 3, np.arange(len(y))))[:SPLIT_ROWS]
    cuts = [cut_points(x[sample, i].astype(float), w[sample]) for i in range(x.shape[1])]
    bins, asked, total = binned(x, cuts), binned(rows, cuts), np.zeros(len(rows))
    step = max(1, TREE_ROWS // len(y))
    for first in range(0, trees, step):
        some = np.arange(first, min(trees, first + step))
        total += summed_probabilities(grow_trees(seed, some, bins, y, w, leaf, depth), some, asked)
    return total / trees


def _narrow(df: DataFrame, keys: list[str], x: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in the order of the first key, vectors in single precision where that loses nothing."""
    local = df.select(*keys, x).orderBy(keys[0]).toPandas()
    values = np.array(local[x].tolist(), dtype=float).reshape(len(local), -1)
    single = values.astype("float32")
    return local[keys], single if np.array_equal(single, values, equal_nan=True) else values


def fits_runs(*sides: DataFrame, x: str) -> bool:
    """Whether the tasks of `fit_runs` may hold each of these tables."""
    sizes = [side.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(x)).alias("d")).first() for side in sides]
    return all(s.n * (s.d or 0) <= RUN_VALUES for s in sizes)


def fit_runs(runs: DataFrame, base: DataFrame, evaluation: DataFrame, row: str, label: str, x: str, leaf: int = 2, depth: int = 30) -> DataFrame:
    """(run, row, p): each run's forest on its own rows, with the rows of `base` before them if it is so marked.

    `runs` has run, seed, trees, with_base, place, label and x, one row a run and drawn row (null label and vector: none drawn).
    In a run with base rows the drawn ones weigh together as much as those; both classes are balanced. A task holds one run's
    drawn rows, the base rows and the evaluation rows, so both have to pass `fits_runs`; it grows TREE_ROWS rows at a time.
    """
    spark = runs.sparkSession
    ship_package(spark)
    source, sx = _narrow(base, [row, label], x)
    target, tx = _narrow(evaluation, [row], x)
    shared = spark.sparkContext.broadcast((source[label].to_numpy().astype(float), sx, target[row].to_numpy(), tx))

    def fit_one(group: pd.DataFrame) -> pd.DataFrame:
        sy, sx, ids, tx = shared.value
        one, own = group.iloc[0], group[group[label].notna()].sort_values("place")
        x_, y = np.array(own[x].tolist(), dtype=float).reshape(len(own), sx.shape[1]), own[label].to_numpy().astype(float)
        w = np.ones(len(y))
        if one["with_base"]:
            w = np.concatenate([np.ones(len(sy)), np.full(len(y), len(sy) / max(1, len(y)))])
            x_, y = np.concatenate([sx, x_]), np.concatenate([sy, y])
        if not len(y):
            raise ValueError(f"no rows to fit run {one['run']}")
        n1 = (y == 1).sum()
        w = w * np.where(y == 1, len(y) / (2.0 * max(1, n1)), len(y) / (2.0 * max(1, len(y) - n1)))
        return pd.DataFrame({"run": one["run"], row: ids, "p": forest_probabilities(x_, y, w, int(one["trees"]), int(one["seed"]), leaf, depth, tx)})

    kind = dict(evaluation.dtypes)[row]
    n = runs.select("run").distinct().count()
    return runs.repartition(min(n, GROW_TASKS), "run").groupBy("run").applyInPandas(fit_one, f"run int, {row} {kind}, p double")


class Forest:
    """Trees as flat arrays, one after the other; leaves point to themselves."""

    def __init__(self, spark, nodes: pd.DataFrame, cuts: list[np.ndarray], trees: int):
        tables, self.roots, at = [], [], 0
        for tree in range(trees):
            t = merged_twins(nodes[nodes["tree"] == tree])
            ids, inner, own = t["node"].to_numpy(), t["feature"].to_numpy() >= 0, np.arange(len(t)) + at
            left = np.where(inner, np.searchsorted(ids, 2 * ids) + at, own)
            right = np.where(inner, np.searchsorted(ids, 2 * ids + 1) + at, own)
            limit = np.array([cuts[f][b] if f >= 0 else 0.0 for f, b in zip(t["feature"], t["bin"])])
            tables.append((np.maximum(t["feature"].to_numpy(), 0).astype("int32"), limit, left.astype("int32"), right.astype("int32"), (t["s1"] / (t["s0"] + t["s1"])).to_numpy()))
            self.roots.append(at)
            at += len(t)
        self.n_nodes = at
        self._shared = spark.sparkContext.broadcast((self.roots, *[np.concatenate(column) for column in zip(*tables)]))

    def tree_probabilities(self) -> Column:
        """Function of a vector column: P(class 1) in the leaf that each tree assigns."""
        shared = self._shared

        @F.pandas_udf("array<double>")
        def leaves(vectors: pd.Series) -> pd.Series:
            roots, feature, limit, left, right, p = shared.value
            if not len(vectors):
                return vectors
            x = np.array(vectors.tolist(), dtype=float)
            out = np.empty((len(x), len(roots)))
            for i, root in enumerate(roots):
                node, going = np.full(len(x), root), np.arange(len(x))
                while len(going):
                    here = node[going]
                    after = np.where(x[going, feature[here]] <= limit[here], left[here], right[here])
                    node[going] = after
                    going = going[after != here]
                out[:, i] = p[node]
            return pd.Series(list(out))

        return leaves


def _binned(train: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                b = binned(np.array(batch["x"].tolist(), dtype=float), cuts)
                yield pd.DataFrame({"id": batch["id"], "bins": [row.tobytes() for row in b], "y": batch["y"], "w": batch["w"]})

    return materialize(train.mapInPandas(narrow, "id bigint, bins binary, y double, w double"))


def _placed(batch: pd.DataFrame, width: int, seed: int, tree: int, splits: dict[int, tuple[int, int]]):
    """Node that each row has reached in a tree whose first splits are given, and how often the tree has drawn it."""
    bins = np.frombuffer(b"".join(batch["bins"]), "uint8").reshape(-1, width)
    node = np.ones(len(bins), "int64")
    for up in sorted(splits):  # parents come before their children
        rows = np.flatnonzero(node == up)
        feature, cut = splits[up]
        node[rows] = 2 * up + (bins[rows, feature] > cut)
    return bins, node, drawn_times(seed, tree, batch["id"].to_numpy())


def fit(df: DataFrame, label: str, x: str, weight: str, trees: int, seed: int, leaf: int, depth: int) -> Forest:
    """Forest on the rows of `df`; no task holds more than its own part of the rows or NODE_ROWS of them."""
    spark = df.sparkSession
    ship_package(spark)
    train = materialize(df.select(F.monotonically_increasing_id().alias("id"), F.col(x).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).alias("w")))
    n = train.count()
    sample = train.where(F.pmod(F.xxhash64("id"), F.lit(n)) < SPLIT_ROWS).select("x", "w").toPandas()
    cuts = [cut_points(column, sample["w"].to_numpy()) for column in np.array(sample["x"].tolist(), dtype=float).T]
    width, rows = len(cuts), _binned(train, cuts)
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
    wide, small, done = [(t, 1) for t in range(trees)], [], []
    if n <= NODE_ROWS / 2:  # a bag is hardly ever twice as large as the rows
        wide, small = [], wide
    while wide:
        found = _wide_splits(rows, width, seed, splits, wide, leaf)
        wide = []
        for tree, group in found.groupby("tree"):
            nodes = group["node"].to_numpy()
            children, ended = _children(nodes, group, leaf, depth)
            done += [(tree, *v) for v in group[["node", "feature", "bin", "s0", "s1"]].itertuples(index=False)]
            done += [(tree, v.node, -1, 0, v.s0, v.s1) for v in children[ended].itertuples()]
            splits[tree].update({v.node: (v.feature, v.bin) for v in group[group["feature"] >= 0].itertuples()})
            for v in children[~ended].itertuples():
                (wide if v.n > NODE_ROWS else small).append((tree, v.node))
    parts = [pd.DataFrame(done, columns=["tree", "node", "feature", "bin", "s0", "s1"])] if done else []
    if small:
        parts.append(_grown(rows, width, seed, splits, small, leaf, depth).toPandas())
    return Forest(spark, pd.concat(parts, ignore_index=True), cuts, trees)


def _of_tree(places: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    return {t: np.sort([n for tree, n in places if tree == t]) for t in {tree for tree, _ in places}}


def _wide_splits(rows: DataFrame, width: int, seed: int, splits: list[dict], wide: list[tuple[int, int]], leaf: int) -> pd.DataFrame:
    """Best split of each node too large for a task: tasks send one histogram a node, which are summed in the order of tasks."""
    nodes = _of_tree(wide)
    features = {t: node_features(seed, t, ids, width) for t, ids in nodes.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
            for t, ids in nodes.items() if len(batch) else ():
                bins, node, drawn = _placed(batch, width, seed, t, splits[t])
                slot = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                on = (ids[slot] == node) & (drawn > 0)
                h = histograms(bins[on], slot[on], features[t], y[on], w[on], drawn[on])
                sums[t] = sums[t] + h if t in sums else h
        part = TaskContext.get().partitionId()
        for t, h in sums.items():
            yield pd.DataFrame({"tree": t, "node": nodes[t], "part": part, "h": [h[:, i].tobytes() for i in range(len(nodes[t]))]})

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(group["tree"].iloc[0]), group["node"].to_numpy()[:1]
        own = node_features(seed, tree, node, width)
        h = sum(np.frombuffer(v).reshape(3, 1, own.shape[1], BINS) for v in group.sort_values("part")["h"])
        return best_splits(h, own, leaf).assign(tree=tree, node=node)[["tree", "node", "feature", "bin", "s0", "s1", "n", "l0", "l1", "ln"]]

    counted = rows.mapInPandas(count, "tree int, node bigint, part int, h binary")
    return counted.groupBy("tree", "node").applyInPandas(choose, f"{NODES}, n double, l0 double, l1 double, ln double").orderBy("tree", "node").toPandas()


def _grown(rows: DataFrame, width: int, seed: int, splits: list[dict], small: list[tuple[int, int]], leaf: int, depth: int) -> DataFrame:
    nodes = _of_tree(small)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, ids in nodes.items() if len(batch) else ():
                _, node, drawn = _placed(batch, width, seed, t, splits[t])
                on = (ids[np.minimum(np.searchsorted(ids, node), len(ids) - 1)] == node) & (drawn > 0)
                yield batch[on].assign(tree=t, node=node[on], drawn=drawn[on], id=batch["id"][on])[["tree", "node", "drawn", "bins", "y", "w", "id"]]

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")  # sums of weights in one order, whatever the shuffle's
        tree, bins = int(group["tree"].iloc[0]), np.frombuffer(b"".join(group["bins"]), "uint8").reshape(-1, width)
        out = grow(seed, tree, int(group["node"].iloc[0]), bins, group["y"].to_numpy(), group["w"].to_numpy(), group["drawn"].to_numpy(), leaf, depth)
        return out.assign(tree=tree)[["tree", "node", "feature", "bin", "s0", "s1"]]

    dealt = rows.mapInPandas(deal, f"{PLACED}, id bigint").repartition(min(len(small), GROW_TASKS), "tree", "node")
    return dealt.groupBy("tree", "node").applyInPandas(finish, NODES)

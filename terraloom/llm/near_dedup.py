"""Near-duplicate classes of documents: MinHash bands, sequential Bayesian verification, exact check on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.components import components
from terraloom.llm.text import parts, shingle_sets
from terraloom.session import materialize, ship_package

#: 32 bands of 4 rows miss a pair of similarity 0.75 with probability (1 - 0.75^4)^32 < 6e-6.
BANDS, ROWS = 32, 4
#: Signature values compared before each look at the posterior.
BATCH = 16
#: Chosen probability of pruning a pair that is similar enough, per look.
MISS = 1e-7
#: Rounds that test bucket members against one drawn member, after the hubs, before the remaining pairs of a bucket are all tested.
ROUNDS = 0
#: Members beyond which a bucket's remaining pairs are first ruled out by their shingles, and holders up to which a shingle is rare.
CROWD, RARE = 64, 16


def signature(shingles: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """MinHash values of one set, in blocks so that a very long text needs bounded memory."""
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        block = short[at:at + 2048, None] * multipliers[None, :]
        block += shifts[None, :]
        np.minimum(low, block.min(axis=0), out=low)
    return low


@lru_cache(maxsize=8)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240611)
    return (draw.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)), draw.integers(0, 2**32, n, dtype=np.uint32)


@lru_cache(maxsize=64)
def fewest_matches(n: int, percent: int, miss: float) -> int:
    """Fewest agreements of n at which a pair stays: below, P(similarity >= percent / 100 | data) < miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def signatures(docs: DataFrame, n: int = BANDS * ROWS, size: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, sig) of every row; class_id is a 128-bit digest of the full set, null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(n)
        for batch in batches:
            for s, e in parts(batch.column(2)):
                sets = shingle_sets(batch.column(2).slice(s, e - s), size)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                    pa.array([signature(x, a, b).tobytes() if len(x) else None for x in sets], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "class_id", "sig"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, class_id binary, sig binary")


def band_rows(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(bucket, node, band): one row per band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, bands, rows)
            keys = np.array([xxhash.xxh64_intdigest(sigs[i, k].tobytes(), seed=k) for i in range(len(sigs)) for k in range(bands)], np.uint64)
            nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            order = np.tile(np.arange(bands, dtype=np.int32), len(sigs))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes), pa.array(order)], ["bucket", "node", "band"])

    return classes.select("node", "sig").mapInArrow(run, "bucket bigint, node bigint, band int")


def unpruned(pairs: DataFrame, percent: int, miss: float = MISS, batch_size: int = BATCH) -> DataFrame:
    """Pairs (a, b) of `pairs` (a, b, sig_a, sig_b) whose posterior keeps a similarity of percent / 100 possible after every
    batch of signature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for at in range(0, x.shape[1], batch_size):
                matches[alive] += (x[alive, at:at + batch_size] == y[alive, at:at + batch_size]).sum(axis=1)
                alive = alive[matches[alive] >= fewest_matches(min(at + batch_size, x.shape[1]), percent, miss)]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def with_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    left, right = (sigs.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int = 5) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(2), 4_000_000):
                one, two = (shingle_sets(batch.column(k).slice(s, e - s), size) for k in (2, 3))
                shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
                good = [s + i for i, n in enumerate(shared) if n and 100 * n >= percent * (len(one[i]) + len(two[i]) - n)]
                if good:
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(good)) for k in (0, 1)], ["a", "b"])

    left, right = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """(shingle, node, label, stray): one row per shingle of each text of `texts` (node, label, stray, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in parts(batch.column(3), 4_000_000):
                sets = shingle_sets(batch.column(3).slice(s, e - s), size)
                which = pa.array(np.repeat(np.arange(s, e), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *(batch.column(k).take(which) for k in range(3))],
                                                 ["shingle", "node", "label", "stray"])

    return texts.select("node", "label", "stray", "text").mapInArrow(run, "shingle bigint, node bigint, label bigint, stray boolean")


def pairs_in_buckets(rows: DataFrame, sigs: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) of different labels in each bucket of `rows` (bucket, node, band, label, main, hub), one of them
    outside the bucket's main label, each in the first bucket that it shares, and not with the hub, which all have met; with
    `reach` (node, n, most) only pairs with n + m <= both `most`. Signatures come along, so pairs are pruned where they meet."""
    keys = rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "bucket"))).alias("keys"))
    keyed, fits = rows.where("node <> hub").join(keys.join(sigs, "node"), "node"), "true"
    if reach is not None:
        keyed, fits = keyed.join(reach, "node"), "n + other_n <= least(most, other_most)"
        least = rows.select("bucket", "node").join(reach, "node").groupBy("bucket").agg(F.min("n").alias("least_n"))
        keyed = keyed.join(least, "bucket").where("n + least_n <= most")
    other = keyed.select("bucket", F.col("node").alias("drawn"), F.col("label").alias("other_label"), F.col("keys").alias("other_keys"), F.col("sig").alias("other_sig"),
                         *([F.col("n").alias("other_n"), F.col("most").alias("other_most")] if reach is not None else []))
    new = F.expr(f"label <> other_label AND {fits} AND NOT exists(map_keys(keys), k -> k < band AND keys[k] <=> other_keys[k])"
                 " AND (other_label = main.label OR node < drawn)")  # two strays meet from both sides
    return keyed.where("label <> main.label").join(other, "bucket").where(new).select(
        F.col("node").alias("a"), F.col("drawn").alias("b"), F.col("sig").alias("sig_a"), F.col("other_sig").alias("sig_b"))


def pairs_in_crowds(rows: DataFrame, sigs: DataFrame, texts: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different labels that may be similar enough, in buckets too full to pair everyone: (a, b) met at rare shingles,
    and (a, b, sig_a, sig_b) met in buckets.

    A shingle is rare here if at most RARE of the texts have it. A stray (a text outside the main label of one of its
    buckets) shares a rare shingle with another text, and then meets it there, or all that they share is common; then
    100 * shared >= percent * (n + m - shared) bounds the sum of their sizes by what the stray has of common shingles. So
    a copy with many edits of its own is not paired with the whole crowd, and no link is lost, for every pair has a stray.
    Of each shingle RARE + 1 holders are gathered at most, which tells rare from common; what is not rare is common. Texts
    that are no strays are bounded by their own size.
    """
    labels = rows.groupBy("node").agg(F.min("label").alias("label"), F.bool_or(F.expr("label <> main.label")).alias("stray"))
    shingles = materialize(shingle_rows(texts.join(labels, "node"), size))
    first = shingles.withColumn("nth", F.row_number().over(Window.partitionBy("shingle").orderBy("node"))).where(f"nth <= {RARE + 1}")
    groups = first.groupBy("shingle").agg(F.collect_list(F.struct("node", "label", "stray")).alias("holders"))
    groups = materialize(groups.where(f"size(holders) <= {RARE} AND exists(holders, h -> h.stray)").select("holders"))
    several = groups.where("size(holders) > 1")
    strays = F.explode(F.expr("transform(filter(holders, h -> h.stray), h -> h.node)")).alias("node")
    rare = groups.where("size(holders) = 1").select(F.expr("holders[0].node").alias("node")).unionByName(several.select(strays))
    rare = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    most = F.expr(f"floor({100 + percent} * IF(stray, n - coalesce(rare, 0), n) / {percent})").cast("bigint")
    sizes = shingles.groupBy("node", "stray").agg(F.count(F.lit(1)).alias("n"))
    reach = materialize(sizes.join(rare, "node", "left").select("node", "n", most.alias("most")))
    pairs = F.expr("flatten(transform(filter(holders, h -> h.stray), h -> transform(filter(holders, o -> o.label <> h.label), o -> struct(h.node AS node, o.node AS drawn))))")
    met = several.select(F.explode(pairs).alias("p")).select("p.*")
    return _ordered(met, "node", "drawn"), pairs_in_buckets(rows, sigs, reach)


def links_between_classes(classes: DataFrame, docs: DataFrame, percent: int, bands: int, rows: int, miss: float, size: int, rounds: int) -> DataFrame:
    """Links that span every component of the classes' similarity graph.

    Pairs inside a component need no test once the component is known. First every bucket member is tested against the
    bucket's hub, the member with the most company over all its buckets (of edited copies the least edited one). Then, for `rounds`
    rounds (none by default), members of other components are tested against one drawn member of the bucket's largest component. At
    last (or as soon as that is no more than a few pairs per row) all pairs of a bucket that still cross components are
    tested; in buckets of more than CROWD members only those that `pairs_in_crowds` cannot rule out. A group of copies so
    costs a multiple of its size, and no pair that shares a bucket goes untested unless both are known to be in one
    component or to be no link.
    """
    banded = materialize(band_rows(classes, bands, rows))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(banded.join(shared, "bucket"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    hubs = members.join(company, "node").groupBy("bucket").agg(F.max_by("node", F.struct("company", F.expr("-node"))).alias("hub"))
    nodes = members.select("node").distinct()
    sigs = materialize(classes.join(nodes, "node", "left_semi").select("node", "sig"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    wanted = classes.join(nodes, "node", "left_semi").select("node", "doc_id", "text_hash")
    texts = materialize(texts.join(wanted.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"))

    def left(pairs: DataFrame) -> DataFrame:
        return unpruned(with_signatures(pairs, sigs), percent, miss)

    def test(pairs: DataFrame) -> DataFrame:
        return materialize(confirmed(pairs, texts, percent, size))

    links = test(left(_ordered(members.join(hubs, "bucket"), "node", "hub")))
    for turn in range(rounds + 1):
        labels = components(links)
        labelled = materialize(members.drop("n").join(labels, "node", "left").select("bucket", "node", "band", F.coalesce("label", "node").alias("label")))
        sizes = labelled.groupBy("bucket", "label").agg(
            F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("drawn"))
        mixed = sizes.groupBy("bucket").agg(F.max_by(F.struct("label", "drawn", "n"), F.struct("n", F.xxhash64("label"))).alias("main"),
                                            F.sum("n").alias("n")).where("n > main.n")
        mixed = materialize(mixed.join(hubs, "bucket"))
        cost = mixed.agg(F.sum("n"), F.sum(F.expr("n * (n - main.n)"))).first()
        if not cost[0]:
            break
        open_rows = labelled.join(mixed, "bucket")
        strays = open_rows.where("label <> main.label")
        last = turn == rounds or cost[1] <= 8 * cost[0]
        if last:
            open_rows = materialize(open_rows)
            pairs = unpruned(pairs_in_buckets(open_rows.where(f"n > 2 AND n <= {CROWD}").drop("n"), sigs), percent, miss)
            crowds = open_rows.where(f"n > {CROWD}").drop("n")
            if not crowds.isEmpty():
                met, banded_pairs = pairs_in_crowds(crowds, sigs, texts, percent, size)
                pairs = pairs.union(unpruned(banded_pairs, percent, miss)).union(left(met))
            pairs = _ordered(pairs, "a", "b")
        else:
            pairs = left(_ordered(strays.select("node", F.col("main.drawn").alias("drawn")), "node", "drawn"))
        links = links.union(test(pairs))
        if last:
            break
    return links


def classified(docs: DataFrame, percent: int, size: int, bands: int, rows: int, miss: float, rounds: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, component_id) of every row; component is null for rows that take no part."""
    seen = materialize(signatures(docs, bands * rows, size))
    named = seen.where("doc_id IS NOT NULL AND class_id IS NOT NULL")
    first = F.min_by(F.struct("doc_id", "text_hash", "sig"), F.struct("doc_id", "text_hash"))
    classes = named.groupBy("class_id").agg(first.alias("first")).select(F.monotonically_increasing_id().alias("node"), "class_id", "first.*")
    classes = materialize(classes)  # from here on a class keeps its number
    labels = components(links_between_classes(classes, docs, percent, bands, rows, miss, size, rounds))
    label_of = materialize(classes.join(labels, "node", "left").select("class_id", "doc_id", F.coalesce("label", "node").alias("component")))
    smallest = label_of.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    label_of = label_of.join(smallest, "component").select("class_id", "component", "smallest")
    found = seen.drop("sig").join(label_of, "class_id", "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id"))
    return found.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component"), component_id.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = MISS,
                    rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) of every row of `docs` (doc_id, text; other columns are ignored).

    Rows with equal shingle sets form a class; classes whose sets have a Jaccard similarity of percent / 100 or more are
    linked; component_id is the smallest doc_id reachable and kept marks it. Candidate pairs come from MinHash bands, are
    pruned by sequential comparison of signature batches and confirmed on the full sets of whole texts.

    Null or blank text: n_shingles 0, its own component. Null doc_id: the row is named by nobody, so it takes no part in
    linking; its component_id is null and kept is true. Repeated rows: each returns, with the same answer. Rows that repeat
    a doc_id with another text are linked by their own text alone. Very long texts are hashed in blocks. Empty table: empty
    result.
    """
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    found = classified(docs, percent, size, bands, rows, miss, rounds)
    return found.select("doc_id", "text_hash", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, size: int = 5, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with one row of each near-duplicate component, all columns kept: the smallest doc_id's, then the least text hash.

    Of repeated rows one stays, also of those without words; rows without doc_id all stay. A doc_id that repeats with
    other texts keeps each text that duplicates no other. An empty table stays empty.
    """
    found = classified(docs, percent, size, bands, rows, miss, rounds).where("doc_id IS NOT NULL")
    alone = found.where("component IS NULL").select("doc_id", "text_hash").distinct()
    found = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("f")).select("f.*").union(alone)
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    given = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_hash"), F.col("doc_id").cast("bigint").alias("_id"))
    joined = given.join(found, ["_id", "_hash"], "left_semi")
    return joined.dropDuplicates(["_id", "_hash"]).select("row.*").unionByName(docs.where("CAST(doc_id AS BIGINT) IS NULL"))

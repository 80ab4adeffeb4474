"""Trie of shared conversation prefixes: sorted shards between the splitters of a range partition, and a skeleton above them."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5, sha256
from struct import calcsize, pack, unpack_from

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.tables import parallelism
from terraloom.session import materialize, ship_package

#: Conversations with the same quotient by it share the opening of the first of them.
FAMILY = 20
#: Openings are 0 to 3 turns long.
OPENINGS = 4
#: Conversations a shard holds at most on average, and at least unless there are fewer.
SHARD, LEAST = 100_000, 500
#: Conversations whose paths are drawn for each splitter; the draw decides where shards are cut and nothing else.
DRAWN = 30
#: Ids of conversations that end at a skeleton node that travel as one text.
ENDS = 4096
#: A turn in a path: digest of all turns up to it, words of its text.
STEP = ">16sI"
STEP_BYTES = calcsize(STEP)
ROOT = bytes(16)

NODES = ("key binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens bigint, ends_sha256 string, first_end bigint, ends string, skeleton boolean")


def turn_digest(role: Column, text: Column) -> Column:
    """128-bit digest of a turn; the length in front keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def turn_lists(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns of each conversation as (turn, digest, words) in order, null turns first, equal ones by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.size(F.array_remove(F.split(text, "[ \\t-\\r]+", -1), ""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
        F.col("turn").cast("bigint").alias("turn"), turn_digest(role, text).alias("digest"), words.alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(lists: DataFrame, family: int = FAMILY, openings: int = OPENINGS) -> DataFrame:
    """(conv_id, turns): the opening of the first conversation of the family, then the own turns after as many."""
    heads = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, openings - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(openings)).cast("int")
    rows = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(heads, "base", "left")
    none = F.array().cast("array<struct<turn:bigint,digest:binary,words:int>>")
    opening = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(opening, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): 20 bytes for each rebuilt turn, whose digests name the nodes from depth 1 on; sorts like the turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            digests, words = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for ds, ws in zip(digests, words):
                key, steps = ROOT, []
                for d, w in zip(ds, ws):
                    key = md5(key + d).digest()
                    steps.append(pack(STEP, key, w))
                out.append(b"".join(steps))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["conv_id", "path"])

    rows = rebuilt(turn_lists(conversations)).select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return rows.mapInArrow(run, "conv_id bigint, path binary")


@dataclass
class Skeleton:
    """Splitters (path, conv_id) in order, and the nodes on their paths in preorder with the end of each one's subtree."""

    splitters: list[tuple[bytes, int]]
    nodes: dict[bytes, tuple[int, int, bytes | None, int, int]] = field(default_factory=dict)  # key -> place, end, parent, depth, words

    def __post_init__(self) -> None:
        order: list[list] = [[ROOT, 0, None, 0, 0]]
        for path, _ in self.splitters:  # sorted, so nodes are met in preorder
            parent = ROOT
            for depth in range(1, len(path) // STEP_BYTES + 1):
                key, words = unpack_from(STEP, path, (depth - 1) * STEP_BYTES)
                if key not in self.nodes:
                    self.nodes[key] = (0, 0, None, 0, 0)
                    order.append([key, 0, parent, depth, words])
                parent = key
        ends = [0] * len(order)
        for i in range(len(order) - 1, -1, -1):
            j = i + 1
            while j < len(order) and order[j][3] > order[i][3]:
                j = ends[j] + 1
            ends[i] = j - 1
        self.nodes = {key: (i, ends[i], parent, depth, words) for i, (key, _, parent, depth, words) in enumerate(order)}

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def skeleton_of(rows: DataFrame, shards: int, total: int) -> Skeleton:
    """Splitters at the quantiles of about DRAWN paths for each shard, drawn by hash of conv_id."""
    if shards < 2:
        return Skeleton([])
    draw = rows.where(F.pmod(F.xxhash64("conv_id"), F.lit(total)) < DRAWN * shards)
    drawn = sorted((bytes(r.path), r.conv_id) for r in draw.toLocalIterator())
    return Skeleton(sorted({drawn[i * len(drawn) // shards] for i in range(1, shards)})) if drawn else Skeleton([])


class Shard:
    """One pass over the sorted paths of a shard; open nodes are the path of the row at hand.

    A node off the skeleton lies in this shard as a whole and is finished when it closes; its children wait for its
    smallest member. A skeleton node closes with what this shard adds to it.
    """

    def __init__(self, skeleton: dict):
        self.skeleton, self.open, self.done = skeleton, [], []

    def begin(self, key: bytes, parent: bytes | None, depth: int, words: int) -> None:
        self.open.append({"key": key, "parent": parent, "depth": depth, "words": words, "least": None, "n": 0, "children": 0, "leaves": 0, "saved": 0,
                          "ends": [], "hash": None, "wait": [], "on": key in self.skeleton})

    def flush(self, v: dict) -> None:
        if v["ends"]:
            text = ",".join(map(str, v["ends"]))
            if v["on"]:
                self.done.append((v["key"], None, v["depth"], None, None, 0, 0, 0, 0, None, v["ends"][0], text, True))
            else:
                if v["hash"] is None:
                    v["hash"] = sha256()
                else:
                    text = "," + text
                v["hash"].update(text.encode())
            v["ends"] = []

    def close(self) -> None:
        v = self.open.pop()
        self.flush(v)
        up = self.open[-1] if self.open else None
        if v["on"]:
            self.done.append((v["key"], v["parent"], v["depth"], v["least"], None, v["n"], v["children"], v["leaves"], v["saved"], None, None, None, True))
        else:
            leaves = v["leaves"] or 1
            saved = v["saved"] + (v["n"] - 1) * v["words"]
            ends = (v["hash"] or sha256()).hexdigest()
            row = [v["key"], v["parent"], v["depth"], v["least"], None, v["n"], v["children"], leaves, saved, ends, None, None, False]
            if up["on"]:
                self.done.append(tuple(row))
            else:
                up["wait"].append(row)
            up["children"] += 1
            up["leaves"] += leaves
            up["saved"] += saved
            for child in v["wait"]:
                child[4] = v["least"]
                self.done.append(tuple(child))
        if up is not None:
            up["least"] = v["least"] if up["least"] is None else min(up["least"], v["least"])
            up["n"] += v["n"]

    def add(self, conv_id: int, path: bytes) -> None:
        if not self.open:
            self.begin(ROOT, None, 0, 0)
        depth = len(path) // STEP_BYTES
        same = 0
        while same < min(depth, len(self.open) - 1) and path[same * STEP_BYTES:same * STEP_BYTES + 16] == self.open[same + 1]["key"]:
            same += 1
        while len(self.open) - 1 > same:
            self.close()
        for d in range(same, depth):
            key, words = unpack_from(STEP, path, d * STEP_BYTES)
            self.begin(key, self.open[-1]["key"], d + 1, words)
        v = self.open[-1]
        v["n"] += 1
        v["least"] = conv_id if v["least"] is None else min(v["least"], conv_id)
        v["ends"].append(conv_id)
        if len(v["ends"]) >= ENDS:
            self.flush(v)

    def finish(self) -> None:
        while self.open:
            self.close()

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [x.split()[0] for x in NODES.split(", ")])


def _sharded(rows: DataFrame, shared, shards: int) -> DataFrame:
    """Rows with the number of their shard, each shard in one partition, sorted by path and conv_id."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value
        for batch in batches:
            at = [skeleton.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], ["conv_id", "path", "shard"])

    placed = rows.mapInArrow(assign, "conv_id bigint, path binary, shard int")
    return placed.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node, the root included.

    Conversations are sorted by path and cut into shards at splitters. A node that is no prefix of a splitter lies in one
    shard and is finished there in one pass. The nodes on the splitters' paths, the skeleton, get a partial aggregate from
    every shard; these are summed by node, and subtree sums follow from running sums in preorder over the skeleton alone
    (at most shards x the longest splitter path rows). Lists of ids that end at a skeleton node travel as texts of ENDS ids.

    Null conv_id: the row belongs to no conversation and is left out. Null turn first; null role or text is empty; equal
    turns of a conversation follow by digest of role and text; repeated rows are turns of their own. A conversation that
    keeps no turn is a member of the root alone. Families of negative ids are counted towards zero, as SQL's remainder does. Very long texts count by their words and travel as digests; a
    conversation's path takes 20 bytes a turn and has to fit in a row. No rows: an empty result, without a root. Other
    columns are ignored.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    rows = materialize(paths(conversations))
    total = rows.count()
    if shards is None:
        shards = max(1, min(parallelism(rows), total // LEAST), -(-total // SHARD))
    skeleton = skeleton_of(rows, shards, max(total, 1))
    shared = spark.sparkContext.broadcast(skeleton)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, current = Shard(shared.value.nodes), None
        for batch in batches:
            for conv_id, path, shard in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    work.finish()
                    current = shard
                work.add(conv_id, path)
                if len(work.done) >= 4096:
                    yield work.rows()
        work.finish()
        yield work.rows()

    found = materialize(_sharded(rows, shared, shards).mapInArrow(local, NODES))
    tops = materialize(_reduced(found, skeleton))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = tops.select(F.col("key").alias("parent"), F.col("conv_id").alias("_above"))
    below = found.where("NOT skeleton").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return below.select(*shown).unionByName(tops.select(*shown))


def _reduced(found: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished skeleton nodes from the shards' partial aggregates."""
    spark = found.sparkSession
    frame = spark.createDataFrame([(k, *x) for k, x in skeleton.nodes.items()], "key binary, place int, last int, parent binary, depth bigint, words bigint")
    parts = found.where("skeleton AND ends IS NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    inner = frame.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("inner")).withColumnRenamed("parent", "key")
    known = frame.join(parts, "key").join(inner, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    known = known.withColumn("own_leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("words"))
    # preorder: the subtree of a node is the run of places from its own to its last
    order = Window.orderBy("place")
    run = materialize(known.select("*", *[F.sum(F.col(a) + F.col(b)).over(order).alias(f"run_{a}") for a, b in (("n_leaves", "own_leaf"), ("saved_tokens", "own_saved"))]))
    upto = run.select(F.col("place").alias("last"), F.col("run_n_leaves").alias("end_leaves"), F.col("run_saved_tokens").alias("end_saved"))
    whole = run.join(upto, "last").select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children",
        (F.col("end_leaves") - F.col("run_n_leaves") + F.col("n_leaves") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("run_saved_tokens") + F.col("saved_tokens") + F.col("own_saved")).alias("saved_tokens"))
    parents = run.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(parents, "parent", "left").join(_ends(found), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())))


def _ends(found: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the skeleton nodes at which conversations end: their texts of ids hashed in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != current:
                    if current is not None:
                        out.append((current, state.hexdigest()))
                    current, state = key, sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
        if current is not None:
            out.append((current, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["key", "ends_sha256"])

    texts = found.where("ends IS NOT NULL").select("key", "first_end", "ends")
    sorted_texts = texts.repartition(parallelism(found), "key").sortWithinPartitions("key", "first_end")
    return sorted_texts.select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


_CRC = ("list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END))")
ORACLE = rf"""
WITH t AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (
    SELECT conv_id, list({{'d': md5(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}}
                         ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns
    FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, CAST(xor({_CRC}, 4294967295::UBIGINT) % {OPENINGS} AS BIGINT) AS h, conv_id - conv_id % {FAMILY} AS base FROM l),
r AS (
    SELECT h.conv_id, list_concat(coalesce(l.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN l ON l.conv_id = h.base),
p AS (
    SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_transform(turns[1:d], lambda x: x.d), '') END AS k,
           CASE WHEN d = 0 THEN NULL ELSE array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), '') END AS up,
           CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w, len(turns) = d AS ends
    FROM r, unnest(range(0, CAST(len(turns) + 1 AS BIGINT))) AS u(d)),
n AS (
    SELECT k, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM p GROUP BY k),
c AS (SELECT up AS k, count(*) AS n FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (
    SELECT substr(n.k, 1, 32 * CAST(a AS INT)) AS k, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved
    FROM n LEFT JOIN c USING (k), unnest(range(0, CAST(depth + 1 AS BIGINT))) AS u(a) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS q ON n.up = q.k LEFT JOIN c ON n.k = c.k JOIN s ON n.k = s.k
"""

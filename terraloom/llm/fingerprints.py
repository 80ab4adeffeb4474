"""Document fingerprints: invertible Bloom lookup tables of paragraph digests that subtract between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.tables import let, parallelism

#: Words per paragraph piece: a line is a paragraph, and a longer one is cut, so that an edit changes few digests.
PIECE = 16
#: Digests per shard that a fingerprint is laid out for, cells per hash function in a shard, and times a failed shard is enlarged.
SHARD, CELLS, RETRIES = 10, 4, 5
#: Peeling passes over a shard's cells before it counts as failed.
PASSES = 6
EMPTY = "named_struct('c', 0, 'k', 0L, 'h', 0L)"


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraph pieces of a text; blank lines have none."""

    def pieces(line: Column) -> Column:
        return let(F.array_remove(F.split(line, "[ \\t-\\r]+", -1), ""), lambda w: F.when(F.size(w) > 0, F.transform(
            F.sequence(F.lit(0), ((F.size(w) - 1) / PIECE).cast("int")), lambda i: F.xxhash64(F.slice(w, i * PIECE + 1, PIECE)))).otherwise(
            F.array().cast("array<bigint>")))

    return F.array_distinct(F.flatten(F.transform(F.split(text, "\n", -1), pieces)))


def shards_for(count: str) -> str:
    """Power of two of shards for a number of digests."""
    return f"CAST(shiftleft(1, CAST(ceil(log2(greatest(1, ({count}) / {SHARD}D))) AS INT)) AS INT)"


def table_of(plus: str, minus: str | None, t: str) -> str:
    """Cells of a shard's table in attempt t: (count, XOR of digests, XOR of their check hashes), one cell per hash function.

    A cell only sums up its digests, so the tables of two versions are subtracted by adding the second with count -1.
    """
    place = ", ".join(f"CAST(shiftrightunsigned(xxhash64(x, {t}), {16 * j}) & {CELLS - 1} AS INT) AS p{j}" for j in range(3))
    entries = lambda keys, c: f"transform({keys}, x -> struct({c} AS c, x AS k, xxhash64(x, 99) & 4294967295L AS h, {place}))"
    both = entries(plus, 1) if minus is None else f"concat({entries(plus, 1)}, {entries(minus, -1)})"
    add = "named_struct('c', a.c + e.c, 'k', a.k ^ e.k, 'h', a.h ^ e.h)"
    parts = ", ".join(f"transform(sequence(0, {CELLS - 1}), i -> aggregate(es, {EMPTY}, (a, e) -> IF(i = e.p{j}, {add}, a)))" for j in range(3))
    return f"transform(array({both}), es -> concat({parts}))[0]"


def peeled(cells: str, t: str) -> str:
    """(ok, plus, minus): digests of the first and of the second version recovered from subtracted cells."""
    place = ", ".join(f"{j * CELLS} + CAST(shiftrightunsigned(xxhash64(c.k, {t}), {16 * j}) & {CELLS - 1} AS INT) AS p{j}" for j in range(3))
    single = "filter(s.cells, c -> abs(c.c) = 1 AND c.h = xxhash64(c.k, 99) & 4294967295L)"
    found = f"array_distinct(transform({single}, c -> struct(c.c AS c, c.k AS k, c.h AS h, {place})))"
    less = "IF(i = p.p0 OR i = p.p1 OR i = p.p2, named_struct('c', a.c - p.c, 'k', a.k ^ p.k, 'h', a.h ^ p.h), a)"
    step = f"""transform(array({found}), f -> IF(size(f) = 0, s, named_struct('cells', transform(s.cells, (c, i) -> aggregate(f, c, (a, p) -> {less})),
        'plus', s.plus + size(filter(f, p -> p.c = 1)), 'minus', s.minus + size(filter(f, p -> p.c = -1)))))[0]"""
    start = f"named_struct('cells', {cells}, 'plus', 0, 'minus', 0)"
    done = "named_struct('ok', forall(s.cells, c -> c.c = 0 AND c.k = 0 AND c.h = 0), 'plus', s.plus, 'minus', s.minus)"
    return f"aggregate(sequence(1, {PASSES}), {start}, (s, r) -> {step}, s -> {done})"


def shard_lists(keys: str, shards: str) -> str:
    """Digests of each shard (their low bits), split in two steps so that a long text costs n times the root of its shards."""
    low = f"shiftleft(1, CAST(floor(log2({shards}) / 2) AS INT))"
    inner = f"transform(sequence(0, CAST({shards} / {low} AS INT) - 1), b -> filter(part, x -> (x & ({shards} - 1)) = a + b * {low}))"
    outer = f"transform(sequence(0, {low} - 1), a -> transform(array(filter({keys}, x -> (x & ({low} - 1)) = a)), part -> {inner})[0])"
    return f"flatten({outer})"


def difference(one: str, two: str, shards: str) -> str:
    """(plus, minus): how many digests only the first, only the second version has, recovered shard by shard.

    Both versions' cells are subtracted and peeled. A shard that does not peel to nothing is laid out again, four times as
    large and by other hashes, up to RETRIES times (then, for less than one shard in 10^9, its lists are compared).
    """
    own = "filter({}, x -> (shiftrightunsigned(xxhash64(x, t), 52) & (shiftleft(1, 2 * t) - 1)) = b)"
    cells = table_of(*[f"IF(t = 0, {z}, {own.format(z)})" for z in ("z.one", "z.two")], "t")
    attempt = f"""aggregate(transform(sequence(0, shiftleft(1, 2 * t) - 1), b -> {peeled(cells, 't')}), named_struct('ok', true, 'plus', 0, 'minus', 0),
        (a, d) -> named_struct('ok', a.ok AND d.ok, 'plus', a.plus + d.plus, 'minus', a.minus + d.minus))"""
    tries = f"""aggregate(sequence(0, {RETRIES}), named_struct('ok', false, 'plus', 0, 'minus', 0), (st, t) -> IF(st.ok, st, {attempt}),
        st -> IF(st.ok, named_struct('plus', st.plus, 'minus', st.minus), named_struct('plus', size(array_except(z.one, z.two)), 'minus', size(array_except(z.two, z.one)))))"""
    pairs = f"zip_with({shard_lists(one, shards)}, {shard_lists(two, shards)}, (x, y) -> named_struct('one', x, 'two', y))"
    return f"aggregate(transform({pairs}, z -> {tries}), named_struct('plus', 0, 'minus', 0), (a, d) -> named_struct('plus', a.plus + d.plus, 'minus', a.minus + d.minus))"


def likeness(one: str, two: str) -> str:
    """Shared digests over the mean number of digests (Dice), from the recovered difference; two texts without paragraphs are alike."""
    shards = shards_for(f"greatest(size({one}), size({two}))")
    plus = f"transform(array({difference(one, two, 'm')}), d -> 1D - (d.plus + d.minus) / greatest(1, size({one}) + size({two})))[0]"
    return f"transform(array({shards}), m -> {plus})[0]"


def fingerprint(keys: str) -> str:
    """Text form: number of digests and shards, then count, digests and checks of every cell in hexadecimal."""
    hexed = "concat(lpad(hex(c.c & 255), 2, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h), 8, '0'))"
    shown = f"concat_ws('', transform(flatten(transform({shard_lists(keys, 'm')}, z -> {table_of('z', None, '0')})), c -> {hexed}))"
    return f"transform(array({shards_for(f'size({keys})')}), m -> concat('iblt1:', size({keys}), ':', m, ':', {shown}))[0]"


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, keys, next_text, next_keys): every document with the next one by descending doc_id, the first after the last.

    Documents are cut into ranges of doc_id (quantiles over all of them); inside a range the next text is the row before,
    and the one row that a range lacks is the last of the range before it, looked up by id: one row for each range.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_id"), text.alias("text"))
    n = 4 * parallelism(docs)
    marks = rows.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 100000).alias("marks")).first()[0]
    marks = sorted(set(marks or []))
    rows = rows.withColumn("_range", F.size(F.filter(F.lit(marks).cast("array<bigint>"), lambda m: m < F.col("_id"))) if marks else F.lit(0))
    ends = rows.groupBy("_range").agg(F.max("_id").alias("_id")).orderBy("_range").collect()  # one row for each range
    before = {r["_range"]: ends[i - 1]["_id"] for i, r in enumerate(ends)}
    last = rows.where(F.col("_id").isin(sorted(set(before.values())))).groupBy("_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    opening = docs.sparkSession.createDataFrame([(k, v) for k, v in before.items()], "_range int, _id bigint").join(F.broadcast(last), "_id").select(
        "_range", F.col("text").alias("_last"))
    order = Window.partitionBy("_range").orderBy("_id", "_hash")
    keyed = rows.join(F.broadcast(opening), "_range", "left").repartition(parallelism(docs), "_range").withColumn("_hash", F.xxhash64("text")).withColumn("keys", digests(F.col("text")))
    out = keyed.withColumn("_next", F.lag("text").over(order)).withColumn("_keys", F.lag("keys").over(order))
    return out.select("doc_id", "text", "keys", F.coalesce("_next", "_last").alias("next_text"), F.coalesce("_keys", digests(F.col("_last"))).alias("next_keys"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of `docs`.

    The edited text replaces the last third of the code points by the first as many (or all) of the next document. Equal
    texts have equal fingerprints. Null text counts as empty; texts without paragraphs are alike (1.0) and unlike any
    other (0.0). Rows follow in the order of doc_id (null first), then of a hash of the text; repeated rows follow each
    other; a table of one row is its own next; other columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.expr("CAST(n_chars div 3 AS INT)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_keys", digests(F.col("edited")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(fingerprint("keys")).alias("fingerprint"),
                       F.expr(fingerprint("edited_keys")).alias("edited_fingerprint"), F.expr(likeness("keys", "edited_keys")).alias("near_edited"),
                       F.expr(likeness("keys", "next_keys")).alias("near_next"))

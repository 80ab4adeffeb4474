"""Spatially balanced samplers, group-disjoint splits and draw summaries.

Orders are hashes of (seed, key), so a draw is repeatable and needs no random state. Selections of k rows use
`top_rows` (map-side trimmed); ranks inside arbitrary groups use the bucketed `ranked_rows`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.hashing import md5_int, md5_wide, row_digest, table_digest
from terraloom.operators.attach import attach
from terraloom.operators.ordering import ranked_rows, ranked_summary, top_rows
from terraloom.session import materialize

HIGH = 2**32
SHIFT = Decimal(10) ** 19


def first_per_group(df: DataFrame, keys: list[str], order: Column, row: str) -> DataFrame:
    """Key of the first row per group in (order, row) order: a map-side combined minimum, no sort."""
    return df.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.col(row).alias("r"))).alias("_m")).select(*keys, F.col("_m.r").alias("_first"))


def one_per_block(df: DataFrame, keys: list[str], block: str, row: str, seed: int) -> DataFrame:
    firsts = first_per_group(df, [*keys, block], md5_int(seed, F.col(row)), row)
    return df.join(firsts, [*keys, block]).where(F.col(row) == F.col("_first")).drop("_first")


def blocks_first(df: DataFrame, keys: list[str], block: str, row: str, need: int, seed: int) -> DataFrame:
    """`need` rows per key: one from each block before any block is used twice."""
    order = md5_int(seed, F.col(row))
    tagged = df.join(first_per_group(df, [*keys, block], order, row), [*keys, block])
    lead = F.when(F.col(row) == F.col("_first"), order).otherwise(order + HIGH)
    return top_rows(tagged, keys, lead, F.col(row), need).drop("_first")


def distributed(df: DataFrame, keys: list[str], block: str, row: str, need: int, seed: int) -> DataFrame:
    """Round-robin over hash-ordered blocks: round i takes each block's i-th row."""
    ranked = top_rows(df, [*keys, block], md5_int(seed, F.col(row)), F.col(row), need, "_round")
    lead = F.col("_round") * HIGH + md5_int(seed, "block", F.col(block))
    return top_rows(ranked, keys, lead, F.col(row), need).drop("_round")


def clustered(df: DataFrame, keys: list[str], block: str, row: str, need: int, seed: int) -> DataFrame:
    """Fill from as few hash-ordered blocks as possible."""
    tie = md5_int(seed, F.col(row)).cast("decimal(38,0)") * F.lit(SHIFT) + F.col(row)
    return top_rows(df, keys, md5_int(seed, "block", F.col(block)), tie, need)


CLASSES = (0, 1)  # every draw is over both
SAMPLERS: dict[str, Callable[..., DataFrame]] = {"distributed": distributed, "clustered": clustered}


def balanced_draw(df: DataFrame, regime: str, label: str, block: str, row: str, budget: int, seed: int) -> DataFrame:
    """budget / 2 rows per class; raises when a class cannot supply its half."""
    need = budget // 2
    drawn = SAMPLERS[regime](df, [label], block, row, need, seed).drop("rank")
    return require_rows(drawn, label, dict.fromkeys(CLASSES, need))


def require_rows(df: DataFrame, key: str, need: dict[int, int]) -> DataFrame:
    """Fail the query, not the driver, when an expected key holds fewer rows than `need` says; an absent key holds none.

    The check is a union branch that returns no rows, so it also runs when `df` itself is empty.
    """
    sizes = df.agg(*[F.count_if(F.col(key) == F.lit(k)).alias(f"n{i}") for i, k in enumerate(need)])
    checks = [F.when(F.col(f"n{i}") < n, F.raise_error(F.lit(f"fewer than {n} rows with {key} = {k}")).cast("boolean")).otherwise(F.lit(False)) for i, (k, n) in enumerate(need.items())]
    guard = sizes.where(reduce(lambda a, b: a | b, checks)).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(guard)


def matched_by_class(df: DataFrame, label: str, row: str, counts: dict[int, int], seed: int) -> DataFrame:
    """Exactly counts[c] rows of each class c in hash order; a class with fewer is an error."""
    picked = top_rows(df.where(F.col(label).isin(list(counts))), [label], md5_int(seed, F.col(row)), F.col(row), max(counts.values()))
    limit = F.coalesce(*[F.when(F.col(label) == c, n) for c, n in counts.items()])
    return require_rows(picked.where(F.col("rank") <= limit), label, counts)


def proportional_allocation(df: DataFrame, group: str, n: int) -> DataFrame:
    """(group, take): floor of the proportional share, at least one if n covers the groups.

    Surplus is taken back from the smallest remainders, a deficit is given to the largest remainders; equal
    remainders resolve by the hash of the group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    whole = sizes.agg(F.sum("_size").alias("_all"), F.count(F.lit(1)).alias("_groups"))
    share = attach(sizes, whole, []).withColumn("_exact", F.lit(float(n)) * F.col("_size") / F.col("_all"))
    base = F.floor("_exact").cast("bigint")
    base = F.when(F.lit(n) >= F.col("_groups"), F.greatest(base, F.lit(1))).otherwise(base)
    share = share.withColumn("_base", F.when(F.col("_all") <= n, F.col("_size")).otherwise(base))
    gap = share.agg((F.sum("_base") - F.least(F.lit(n), F.max("_all"))).alias("_over"))
    share = materialize(attach(share, gap, [])).withColumn("_rem", F.col("_exact") - F.col("_base")).withColumn("_tie", md5_wide(F.col(group)))
    spare = share.where((F.col("_over") > 0) & (F.col("_base") > 1)).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_base") - 2)))
    tie = F.col("_tie").cast("decimal(38,0)") * 1000000 + F.col("_step")
    cut = ranked_summary(spare, [], F.col("_rem") + F.col("_step"), tie, "_k").where(F.col("_k") <= F.col("_over"))
    cut = cut.groupBy(group).agg((-F.count(F.lit(1))).alias("_delta"))
    wanting = share.where((F.col("_over") < 0) & (F.col("_base") < F.col("_size")))
    add = ranked_summary(wanting, [], -F.col("_rem"), F.col("_tie"), "_k").where(F.col("_k") <= -F.col("_over"))
    add = add.select(group, F.lit(1).cast("bigint").alias("_delta"))
    changes = cut.unionByName(add)
    return share.select(group, "_base").join(changes, group, "left").select(
        group, (F.col("_base") + F.coalesce("_delta", F.lit(0))).cast("bigint").alias("take"))


def proportional_sample(df: DataFrame, group: str, row: str, n: int, seed: int) -> DataFrame:
    takes = proportional_allocation(df, group, n)
    ranked = top_rows(df, [group], md5_int(seed, F.col(row)), F.col(row), n, "_k")
    return ranked.join(takes, group).where(F.col("_k") <= F.col("take")).drop("_k", "take")


def priority_strata(df: DataFrame, group: str, row: str, strata: list[tuple[str, Column, int]], total: int, seed: int) -> DataFrame:
    """Take each stratum in turn from the rows not taken before, then fill to `total` from all rows.

    A step's selection has at most its requested size; it is written to the shared folder so the
    next step starts from stored rows.
    """
    taken = None
    for name, test, n in [*strata, ("fill", F.lit(True), 0)]:
        rows = df.where(test)
        if taken is not None:
            rows = rows.join(taken.select(row), row, "left_anti")
        if name == "fill":
            n = total - taken.count()
            if n <= 0:
                break
        step = materialize(proportional_sample(rows, group, row, n, seed).select(row, group).withColumn("stratum", F.lit(name)))
        taken = step if taken is None else taken.unionByName(step)
    return taken


def spatial_block_id(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def group_split(df: DataFrame, group: str, label: str, fraction: float, seed: int, tries: int = 100) -> DataFrame:
    """(group, held): the hash order among `tries` whose two sides both hold both classes and deviate least
    from the overall class rate; an error if there is none. Works on one row per group."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).cast("bigint").alias("_pos"))
    trial = groups.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    order = md5_int(F.col("_try") + seed, F.col(group))
    ranked = ranked_summary(trial, ["_try"], order, md5_wide(F.col(group)), "_k", "_g")
    sided = materialize(ranked.withColumn("held", F.col("_k") <= F.ceil(F.col("_g") * F.lit(fraction))))
    left, right = ~F.col("held"), F.col("held")
    part = lambda side, c: F.sum(F.when(side, F.col(c)).otherwise(0))
    stats = sided.groupBy("_try").agg(
        part(left, "_n").alias("nl"), part(left, "_pos").alias("pl"), part(right, "_n").alias("nr"), part(right, "_pos").alias("pr"))
    mixed = stats.where("pl > 0 AND pl < nl AND pr > 0 AND pr < nr")
    rate = (F.col("pl") + F.col("pr")) / (F.col("nl") + F.col("nr"))
    score = F.abs(F.col("pl") / F.col("nl") - rate) + F.abs(F.col("pr") / F.col("nr") - rate)
    best = mixed.agg(F.min(F.struct(score.alias("s"), F.col("_try").alias("t"))).alias("_b")).select(
        F.coalesce(F.col("_b.t"), F.raise_error(F.lit(f"none of {tries} orders puts both classes on both sides")).cast("int")).alias("_best"))
    return attach(sided, best, []).where(F.col("_try") == F.col("_best")).select(group, "held")


def train_val_test(df: DataFrame, group: str, label: str, test: float, val: float, seed: int, tries: int = 100) -> DataFrame:
    """(group, split) in two stages; the second splits what the first left."""
    first = group_split(df, group, label, test, seed, tries)
    rest = df.join(first.where(~F.col("held")).select(group), group, "left_semi")
    second = group_split(rest, group, label, val / (1 - test), seed + 1000, tries).withColumnRenamed("held", "val")
    split = F.when(F.col("held"), "test").when(F.col("val"), "val").otherwise("train")
    return first.join(second, group, "left").select(group, split.alias("split"))


def group_folds(df: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): groups by falling size dealt in a snake, so fold sizes stay close."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked_summary(sizes, [], -F.col("_n"), md5_wide(F.col(group)), "_k")
    lap, seat = F.floor((F.col("_k") - 1) / folds), (F.col("_k") - 1) % folds
    return ranked.select(group, F.when(lap % 2 == 0, seat).otherwise(folds - 1 - seat).cast("bigint").alias("fold"))


def confident_rows(df: DataFrame, p: str, row: str, threshold: float, limit: int, seed: int) -> DataFrame:
    """Most confident rows at or above the threshold, equal confidence in hash order."""
    confidence = F.greatest(F.col(p), 1 - F.col(p))
    tie = md5_int(seed, F.col(row)).cast("decimal(38,0)") * F.lit(SHIFT) + F.col(row)
    rows = df.withColumn("confidence", confidence).where(F.col("confidence") >= threshold)
    return top_rows(rows, [], -F.col("confidence"), tie, limit).withColumn("pseudo", (F.col(p) >= 0.5).cast("bigint"))


def confident_per_class(df: DataFrame, p: str, row: str, threshold: float, limit: int) -> DataFrame:
    """Equal numbers of confident rows per predicted class, at most `limit` each."""
    rows = df.withColumn("pseudo", F.when(F.col(p) >= threshold, F.lit(1)).when(F.col(p) <= 1 - threshold, F.lit(0)).cast("bigint"))
    top = top_rows(rows.where("pseudo IS NOT NULL"), ["pseudo"], -F.abs(F.col(p) - 0.5), F.col(row), limit)
    sizes = top.agg(F.count(F.when(F.col("pseudo") == 1, 1)).alias("_a"), F.count(F.when(F.col("pseudo") == 0, 1)).alias("_b"))
    return attach(top, sizes, []).where(F.col("rank") <= F.least("_a", "_b")).drop("_a", "_b")


def draw_summary(draws: DataFrame, keys: list[str], block: str, row: str) -> DataFrame:
    """Blocks per draw and an order-free identity digest of its rows."""
    blocks = draws.groupBy(*keys).agg(F.countDistinct(block).alias("n_blocks"))
    return blocks.join(table_digest(draws, keys, row_digest(row)), keys)


def numbered(df: DataFrame, lead: Column, tie: Column, name: str, pattern: str, first: int = 1) -> DataFrame:
    """Formatted sequential ids in (lead, tie) order."""
    ranked = ranked_rows(df, [], lead, tie, "_k")
    return ranked.select(F.format_string(pattern, F.col("_k") - 1 + first).alias(name), *df.columns)


def parameter_grid(df: DataFrame, axes: dict[str, list[int]]) -> DataFrame:
    """Every row of `df` with every combination of the literal axes, expanded in place (no join)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v).cast("bigint") for v in values])))
    return df


def unordered_pairs(names: DataFrame, column: str, left: str, right: str, limit: int = 10_000) -> DataFrame:
    """Pairs left < right of a list of names, which travels as one array: the result has n(n - 1) / 2 rows by definition, so
    a list longer than `limit` is an error that the caller can move."""
    listed = names.agg(F.array_sort(F.collect_set(column)).alias("_all"), F.count(F.lit(1)).alias("_n")).select(
        F.when(F.col("_n") > limit, F.raise_error(F.lit("too many names to pair"))).otherwise(F.col("_all")).alias("_all"))
    tagged = attach(names, listed, []).withColumn(right, F.explode(F.filter("_all", lambda x: x > F.col(column))))
    return tagged.select(F.col(column).alias(left), right)

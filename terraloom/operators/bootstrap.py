"""Block bootstrap on pre-aggregated block totals.

Rows never get resampled. A replicate is a multiset of blocks, so any statistic built from sums needs only the
per-block totals, weighted by how often the block was drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.hashing import md5_int
from terraloom.operators.attach import attach
from terraloom.operators.metrics import ratio
from terraloom.operators.ordering import range_count, ranked_summary
from terraloom.session import materialize, ship_package


def block_draws(blocks: DataFrame, block: str, reps: int, seed: int) -> DataFrame:
    """(replicate, block, weight): each replicate draws as many blocks as there are, with replacement.

    Every block also stands for one draw slot, so the slot table is the block table itself expanded by the
    replicates; the drawn index comes from the hash of (seed, rep, slot).
    """
    indexed = materialize(ranked_summary(blocks.select(block).distinct(), [], F.col(block), F.col(block), "_i", "_n"))
    slots = indexed.withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(reps).cast("bigint"))))
    drawn = slots.select("replicate", (md5_int(seed, F.col("replicate"), F.col("_i")) % F.col("_n") + 1).alias("_i"))
    weights = drawn.groupBy("replicate", "_i").agg(F.count(F.lit(1)).alias("weight"))
    return weights.join(indexed.select("_i", block), "_i").select("replicate", block, "weight")


def interval(df: DataFrame, value: str) -> DataFrame:
    """95 % percentile interval and number of defined replicates; the input has one row per replicate."""
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    wide = df.agg(ends.alias("_e"), F.count(value).alias("valid_reps"))
    return wide.select(F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"), "valid_reps")


def bootstrap_mean(df: DataFrame, block: str, value: str, reps: int, seed: int) -> DataFrame:
    """Cluster bootstrap interval of a row mean."""
    totals = df.groupBy(block).agg(F.sum(value).cast("double").alias("_s"), F.count(value).alias("_c"))
    draws = block_draws(totals, block, reps, seed).join(totals, block)
    per_rep = draws.groupBy("replicate").agg(
        (F.sum(F.col("weight") * F.col("_s")) / F.sum(F.col("weight") * F.col("_c"))).alias("estimate"))
    return interval(per_rep, "estimate")


def block_wins(df: DataFrame, block: str, y: str, score: str, ranges: int | None = None) -> DataFrame:
    """(a, b, wins): over pairs of a positive in block a and a negative in block b, how often the positive scores higher, ties half.

    One ordered pass: counts by block, score and outcome are range-partitioned by score, so equal scores meet in one task,
    which carries the negatives so far of every block. Totals of the ranges (one row for each range and block) add the
    negatives of lower ranges. Nothing depends on replicates.
    """
    cells = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(block).alias("block"), F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    blocks = materialize(cells.select("block").distinct().select("block", F.dense_rank().over(Window.orderBy("block")).alias("i")))
    width = blocks.count()
    ship_package(df.sparkSession)

    def one_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, wins = TaskContext.get().partitionId(), np.zeros((width, width))
        before, own = np.zeros(width), np.zeros(width)  # negatives and positives of each block so far
        held, last = (np.zeros(width), np.zeros(width)), None

        def close() -> None:
            nonlocal before, own
            for i in np.flatnonzero(held[0]):
                wins[i] += held[0][i] * (before + held[1] / 2)
            before, own = before + held[1], own + held[0]
            held[0][:], held[1][:] = 0, 0

        for batch in batches:
            for i, value, pos, neg in zip(*(c.to_pylist() for c in batch.columns)):
                if value != last:
                    close()
                    last = value
                held[0][i - 1] += pos
                held[1][i - 1] += neg
        close()
        a, b = np.nonzero(wins)
        i = np.flatnonzero(before + own)
        rows = [("w", x + 1, z + 1, wins[x, z], 0.0) for x, z in zip(a, b)] + [("t", x + 1, 0, own[x], before[x]) for x in i]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), *[pa.array([k(v) if k else v for v in c], t) for c, t, k in zip(columns, kinds, (None, int, int, float, float))]],
                                         ["range", "kind", "a", "b", "x", "y"])

    placed = cells.join(blocks, "block").repartitionByRange(ranges or range_count(df), "score").sortWithinPartitions("score")
    parts = materialize(placed.select("i", "score", "pos", "neg").mapInArrow(one_range, "range bigint, kind string, a bigint, b bigint, x double, y double"))
    totals = parts.where("kind = 't'").select("range", F.col("a").alias("i"), F.col("x").alias("pos"), F.col("y").alias("neg"))
    earlier = Window.partitionBy("b").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lower = totals.select(F.explode(F.sequence(F.lit(1), F.lit(max(width, 1)))).alias("b"), "range").distinct()  # ranges x blocks
    lower = lower.join(totals.select(F.col("i").alias("b"), "range", "neg"), ["b", "range"], "left")
    lower = lower.select("b", "range", F.coalesce(F.sum("neg").over(earlier), F.lit(0.0)).alias("below")).where("below > 0")
    across = totals.where("pos > 0").select("range", F.col("i").alias("a"), "pos").join(lower, "range").groupBy("a", "b").agg(F.sum(F.col("pos") * F.col("below")).alias("x"))
    both = parts.where("kind = 'w'").select("a", "b", "x").unionByName(across).groupBy("a", "b").agg(F.sum("x").alias("wins"))
    names = lambda k: blocks.select(F.col("block").alias(f"{k}_block"), F.col("i").alias(k))
    return both.join(names("a"), "a").join(names("b"), "b").select(F.col("a_block").alias("a"), F.col("b_block").alias("b"), "wins")


def bootstrap_auroc(df: DataFrame, block: str, y: str, score: str, reps: int, seed: int) -> DataFrame:
    """Cluster bootstrap interval of AUROC; replicates with one outcome are skipped and counted.

    A replicate is a weighted sum over the matrix of wins between blocks, so its cost does not depend on the rows.
    """
    df = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    wins = materialize(block_wins(df, block, y, score))
    sizes = materialize(df.groupBy(F.col(block).alias("block")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))
    draws = materialize(block_draws(sizes, "block", reps, seed))
    side = lambda k: draws.select("replicate", F.col("block").alias(k), F.col("weight").alias(f"w{k}"))
    inner = side("a").join(wins, "a").groupBy("replicate", "b").agg(F.sum(F.col("wa") * F.col("wins")).alias("s"))
    won = inner.join(side("b"), ["replicate", "b"]).groupBy("replicate").agg(F.sum(F.col("wb") * F.col("s")).alias("won"))
    counts = draws.join(sizes, "block").groupBy("replicate").agg((F.sum(F.col("weight") * F.col("pos")) * F.sum(F.col("weight") * F.col("neg"))).cast("double").alias("pairs"))
    per_rep = counts.join(won, "replicate", "left").select("replicate", (F.coalesce("won", F.lit(0.0)) / F.nullif("pairs", F.lit(0.0))).alias("auroc"))
    return interval(per_rep, "auroc")


def paired_f1(df: DataFrame, keys: list[str], block: str, arm: str, a: str, b: str, pred: Column, ref: Column,
              reps: int, seed: int) -> DataFrame:
    """Paired interval of the seed-mean F1 of arm b minus arm a, from per-(arm, seed, block) counts."""
    from terraloom.operators.metrics import confusion_counts

    counts = materialize(confusion_counts(df, [arm, *keys, block], pred, ref))  # read for the draws, the point and the blocks
    f1 = lambda tp, fp, fn: ratio(2 * tp, 2 * tp + fp + fn, "zero")
    drawn = counts.join(block_draws(counts, block, reps, seed), block)
    weighted = drawn.groupBy("replicate", arm, *keys).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("tp", "fp", "fn")])
    mean_of = lambda side: F.avg(F.when(F.col(arm) == side, f1(F.col("tp"), F.col("fp"), F.col("fn"))))
    per_rep = weighted.groupBy("replicate").agg((mean_of(b) - mean_of(a)).alias("delta"))
    point = counts.groupBy(arm, *keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).agg((mean_of(b) - mean_of(a)).alias("delta_f1"))
    n_blocks = counts.agg(F.countDistinct(block).alias("n_blocks"))
    return attach(attach(interval(per_rep, "delta"), point, []), n_blocks, [])


def stratified_area(strata: DataFrame, sample: DataFrame, stratum: str, ref: str, slot: str, pixel_area: float,
                    reps: int, seed: int) -> DataFrame:
    """Area of the reference class from a sample stratified by map class.

    `strata` has (stratum, total) for the whole map, `sample` one row per sampled unit with a dense 1-based `slot`
    inside its stratum. Replicates redraw slots inside each stratum.
    """
    sized = attach(sample, sample.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), [stratum])
    rates = sample.groupBy(stratum).agg(F.avg(ref).alias("_rate"))
    whole = strata.agg(F.sum("total").alias("_all"), F.sum(F.when(F.col(stratum) == 1, F.col("total")).otherwise(0)).alias("_mapped"))
    weighted = attach(strata, whole, [])
    estimate = weighted.join(rates, stratum).agg(
        (F.sum(F.col("total") * F.col("_rate")) / F.max("_all")).alias("share"), F.max("_all").alias("_all"), F.max("_mapped").alias("_mapped"))
    redraw = sized.withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(reps).cast("bigint")))).select(
        stratum, "replicate", (md5_int(seed, F.col("replicate"), F.col(stratum), F.col(slot)) % F.col("_n") + 1).alias(slot))
    picks = redraw.groupBy(stratum, "replicate", slot).agg(F.count(F.lit(1)).alias("_w")).join(sample.select(stratum, slot, ref), [stratum, slot])
    means = picks.groupBy(stratum, "replicate").agg((F.sum(F.col("_w") * F.col(ref)) / F.sum("_w")).alias("_rate"))
    boots = means.join(weighted, stratum).groupBy("replicate").agg((F.sum(F.col("total") * F.col("_rate")) / F.max("_all")).alias("share"))
    ends = F.percentile("share", F.array(F.lit(0.025), F.lit(0.975)))
    spread = boots.agg(ends.alias("_e"), F.stddev_samp("share").alias("_se")).select(F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi"), "_se")
    area = F.col("_all") * F.lit(pixel_area)
    return attach(estimate, spread, []).select(
        (F.col("_mapped") * F.lit(pixel_area)).alias("naive_area"), (F.col("share") * area).alias("adjusted_area"),
        (F.col("_lo") * area).alias("area_low"), (F.col("_hi") * area).alias("area_high"), (F.col("_se") * area).alias("area_se"))

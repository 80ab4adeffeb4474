"""Classification, calibration, ranking and selective-prediction metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.operators.attach import attach
from terraloom.operators.ordering import exact_quantiles, fits_one_task, mid_ranks, range_count, ranked_rows, ranked_summary, running_totals

CURVE_STEP = 100_000


EPSILON = 2.0**-52  # spacing of doubles at one: log loss clips probabilities to it and its complement

def confusion_columns(pred: Column, ref: Column, valid: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn over the rows where `valid` holds; map-side combinable sums."""
    keep = valid if valid is not None else F.lit(True)
    count = lambda test: F.sum(F.when(keep & test, 1).otherwise(0)).cast("bigint")
    return [
        count(pred & ref).alias("tp"), count(pred & ~ref).alias("fp"),
        count(~pred & ref).alias("fn"), count(~pred & ~ref).alias("tn"),
    ]


def confusion_counts(df: DataFrame, keys: list[str], pred: Column, ref: Column, valid: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(*confusion_columns(pred, ref, valid))


def ratio(top: Column, bottom: Column, on_undefined: str) -> Column:
    """top / bottom where bottom > 0; otherwise null ("null") or 0 ("zero")."""
    value = top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return F.coalesce(value, F.lit(0.0)) if on_undefined == "zero" else value


def count_metrics(on_undefined: str = "null", prefix: str = "") -> dict[str, Column]:
    """Metric columns from tp, fp, fn, tn. Deployment tables leave undefined values null, sample tables use 0."""
    tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn, on_undefined), ratio(tn, tn + fp, on_undefined)
    return {
        "precision": ratio(tp, tp + fp, on_undefined), "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn, on_undefined), "iou": ratio(tp, tp + fp + fn, on_undefined),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, on_undefined),
        "balanced_accuracy": (recall + specificity) / 2.0,
    }


def bin_index(p: Column, bins: int) -> Column:
    """Equal-width bin on [0, 1], left-closed, last bin closed.

    Edges are the doubles i * (1 / bins), compared literally: flooring p * bins would move values that sit on
    an edge whose double is not the decimal one.
    """
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    index = F.lit(0)
    for edge in edges:
        index = index + F.when(p >= F.lit(edge), 1).otherwise(0)
    return index


def reliability(df: DataFrame, keys: list[str], y: str, p: str, bins: int) -> DataFrame:
    return df.groupBy(*keys, bin_index(F.col(p), bins).cast("bigint").alias("bin")).agg(
        F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_frequency"), F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    table = reliability(df, keys, y, p, bins)
    gap = F.abs(F.col("observed_frequency") - F.col("mean_probability")) * F.col("n")
    return table.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def probability_metrics(df: DataFrame, keys: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(EPSILON)), F.lit(1 - EPSILON))
    nll = -(F.col(y) * F.log(clipped) + (1 - F.col(y)) * F.log(1 - clipped))
    wrong = (F.col(p) >= threshold) != (F.col(y) == 1)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(nll).alias("log_loss"),
        F.avg(wrong.cast("double")).alias("error_rate"))


def rank_metrics(df: DataFrame, keys: list[str], y: str, score: str, weight: str | None = None) -> DataFrame:
    """Exact AUROC (ties count half) and step-wise average precision per key; null with a single class.

    Rows are reduced to one per distinct score before anything is ordered.
    """
    w = F.col(weight) if weight else F.lit(1)
    grouped = df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).cast("double").alias("neg"))
    run = running_totals(grouped, keys, score, ["pos", "neg"])
    pos_ge = F.col("total_pos") - F.col("before_pos")
    all_ge = pos_ge + F.col("total_neg") - F.col("before_neg")
    out = run.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_wins"),
        F.sum(F.col("pos") * pos_ge / F.nullif(all_ge, F.lit(0.0))).alias("_steps"),
        F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"))
    return out.select(
        *keys, (F.col("_wins") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("auroc"),
        F.when(F.col("_n") > 0, F.col("_steps") / F.nullif(F.col("_p"), F.lit(0.0))).alias("auprc"))



def evaluation_bundle(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """n, Brier score, log loss, error rate, calibration error, AUROC and average precision per key; rank metrics are null with one class."""
    from terraloom.session import materialize

    rows = materialize(df.select(*keys, y, p))  # read once for each family of metrics
    return probability_metrics(rows, keys, y, p).join(calibration_error(rows, keys, y, p), keys).join(rank_metrics(rows, keys, y, p), keys)


def quantile_bins(df: DataFrame, keys: list[str], value: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins with duplicate edges dropped, so equal values always share a bin."""
    probs = {f"_q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(df, keys, value, probs)
    interior = F.array_distinct(F.array(*probs))
    interior = F.slice(interior, 2, F.greatest(F.size(interior) - 2, F.lit(0)))
    edges = edges.select(*keys, interior.alias("_edges"))
    tagged = attach(df, edges, keys)
    index = F.size(F.filter("_edges", lambda e: e < F.col(value))).cast("bigint")
    return tagged.withColumn(name, index).drop("_edges")


def distance_bands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """nearest_20 / middle_60 / farthest_20 by the 20 % and 80 % quantiles (both ends inclusive)."""
    tagged = attach(df, exact_quantiles(df, keys, value, {"_q20": 0.2, "_q80": 0.8}), keys)
    band = F.when(F.col(value) <= F.col("_q20"), "nearest_20").when(F.col(value) >= F.col("_q80"), "farthest_20").otherwise("middle_60")
    return tagged.withColumn("band", band).drop("_q20", "_q80")


def _cells(y: str, p: str, threshold: float) -> list[Column]:
    pred, ref = F.col(p) >= threshold, F.col(y) == 1
    return [F.count(F.lit(1)).alias("n"), *confusion_columns(pred, ref)]


def tie_groups(df: DataFrame, keys: list[str], y: str, p: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row per distinct risk score with the confusion counts inside it and before it."""
    safe = F.when(F.col(score).isNull() | F.isnan(score), F.raise_error(F.lit("risk scores must be finite"))).otherwise(F.col(score))
    grouped = df.withColumn(score, safe.cast("double")).groupBy(*keys, score).agg(*_cells(y, p, threshold))
    return running_totals(grouped, keys, score, ["n", "tp", "fp", "fn", "tn"])


def _curve_columns() -> list[Column]:
    """Expected metrics after k rows when the order inside a tie group is uniformly random."""
    share = (F.col("k") - F.col("before_n")) / F.col("n")
    tp, fp, fn = (F.col(f"before_{c}") + F.col(c) * share for c in ("tp", "fp", "fn"))
    return [
        (F.col("k") / F.col("total_n")).alias("coverage"), ((fp + fn) / F.col("k")).alias("risk"),
        ratio(2 * tp, 2 * tp + fp + fn, "zero").alias("f1"),
    ]


def selective_curve(df: DataFrame, keys: list[str], y: str, p: str, score: str, threshold: float = 0.5) -> DataFrame:
    """k = 1..n risk-coverage curve.

    A tie group can hold a large part of all rows, so it is first cut into spans of CURVE_STEP positions that
    are redistributed, and only then expanded to single positions. For a large input the number of
    partitions is given: by the size of the spans, adaptive execution would join them into one task that writes all positions.
    """
    groups = tie_groups(df, keys, y, p, score, threshold)
    last = F.col("before_n") + F.col("n")
    spans = groups.withColumn("_from", F.explode(F.sequence(F.col("before_n") + 1, last, F.lit(CURVE_STEP).cast("bigint"))))
    places = [*[F.col(c) for c in keys], F.col("_from")]
    spans = spans.repartition(*places) if fits_one_task(df) else spans.repartition(range_count(df), *places)
    points = spans.withColumn("k", F.explode(F.sequence(F.col("_from"), F.least(last, F.col("_from") + CURVE_STEP - 1))))
    return points.select(*keys, "k", *_curve_columns())


def operating_points(
    df: DataFrame, keys: list[str], y: str, p: str, score: str, coverages: list[float], threshold: float = 0.5
) -> DataFrame:
    """Curve values at k = max(1, ceil(coverage * n)), read off the tie groups without building the curve."""
    groups = tie_groups(df, keys, y, p, score, threshold)
    asked = F.explode(F.array(*[F.lit(float(c)) for c in coverages]))
    points = groups.withColumn("requested", asked).withColumn(
        "k", F.greatest(F.lit(1), F.ceil(F.col("requested") * F.col("total_n"))).cast("bigint"))
    hit = points.where((F.col("before_n") < F.col("k")) & (F.col("k") <= F.col("before_n") + F.col("n")))
    return hit.select(*keys, "requested", "k", *_curve_columns())


def prefix_metrics(
    df: DataFrame, keys: list[str], y: str, p: str, score: str, tie: str, coverages: list[float], threshold: float = 0.5
) -> DataFrame:
    """Counts over the first round(n * coverage) rows (half to even) in (score, tie) order."""
    ranked = ranked_rows(df, keys, F.col(score), F.col(tie), "_rank", "_size")
    pred, ref = F.col(p) >= threshold, F.col(y) == 1
    kept = lambda c: F.col("_rank") <= F.bround(F.col("_size") * F.lit(float(c)), 0)
    sums = []
    for i, c in enumerate(coverages):
        sums += [column.alias(f"{name}_{i}") for name, column in
                 zip(("tp", "fp", "fn", "tn"), confusion_columns(pred, ref, kept(c)))]
    wide = ranked.groupBy(*keys).agg(*sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("coverage"), *[F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn")])
        for i, c in enumerate(coverages)]))
    return wide.select(*keys, rows.alias("r")).select(*keys, "r.*")


def spearman(df: DataFrame, keys: list[str], a: str, b: str, name: str = "spearman") -> DataFrame:
    """Rank correlation with average ties; rows are reduced to distinct (a, b) pairs before the joins."""
    pairs = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_w"))
    ra = mid_ranks(df, keys, a).select(*keys, a, F.col("mid_rank").alias("_ra"), F.col("total").alias("_n"))
    rb = mid_ranks(df, keys, b).select(*keys, b, F.col("mid_rank").alias("_rb"))
    both = pairs.join(ra, [*keys, a]).join(rb, [*keys, b])
    da, db = F.col("_ra") - (F.col("_n") + 1) / 2.0, F.col("_rb") - (F.col("_n") + 1) / 2.0
    sums = both.groupBy(*keys).agg(
        F.sum(F.col("_w") * da * db).alias("_ab"), F.sum(F.col("_w") * da * da).alias("_aa"), F.sum(F.col("_w") * db * db).alias("_bb"))
    return sums.select(*keys, (F.col("_ab") / F.nullif(F.sqrt(F.col("_aa") * F.col("_bb")), F.lit(0.0))).alias(name))


def block_halves(df: DataFrame, block: str, seeds: list[int]) -> DataFrame:
    """(seed, block, role): the first half of the blocks in hash order tunes, the others are held out."""
    from terraloom.functions.hashing import md5_int

    blocks = df.select(block).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
    ranked = ranked_summary(blocks, ["seed"], md5_int(F.col("seed"), F.col(block)), F.col(block), "_rank", "_size")
    role = F.when(F.col("_rank") <= F.floor(F.col("_size") / 2), "tune").otherwise("held")
    return ranked.select("seed", block, role.alias("role"))


def frozen_thresholds(df: DataFrame, halves: DataFrame, block: str, score: str, error: str, coverages: list[float]) -> DataFrame:
    """Per seed: cut-off from the tune blocks, coverage and error on the held blocks."""
    rows = df.join(halves, block)
    probs = {f"_t{i}": c for i, c in enumerate(coverages)}
    cuts = exact_quantiles(rows.where("role = 'tune'"), ["seed"], score, probs)
    held = rows.where("role = 'held'").join(cuts, "seed")
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(error).alias("_full")]
    for i in range(len(coverages)):
        keep = F.col(score) <= F.col(f"_t{i}")
        aggs += [F.sum(F.when(keep, 1).otherwise(0)).cast("bigint").alias(f"_n{i}"), F.avg(F.when(keep, F.col(error))).alias(f"_e{i}"),
                 F.max(f"_t{i}").alias(f"_c{i}")]
    wide = held.groupBy("seed").agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("target_coverage"), F.col(f"_c{i}").alias("threshold"), F.col(f"_n{i}").alias("n"),
                 (F.col(f"_n{i}") / F.col("_n")).alias("actual_coverage"), F.col(f"_e{i}").alias("error_rate"),
                 F.col("_full").alias("held_full_error")) for i, c in enumerate(coverages)]))
    return wide.select("seed", rows.alias("r")).select("seed", "r.*")


def zscore_sum(df: DataFrame, fit: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Sum of z-scores using mean and sample deviation of the `fit` rows."""
    stats = fit.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    total = F.lit(0.0)
    for c in columns:
        total = total + (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")
    joined = attach(df, stats, keys)
    return joined.withColumn(name, total).select(*df.columns, name)


def overconfidence(df: DataFrame, keys: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    confidence, right = F.greatest(F.col(p), 1 - F.col(p)), (F.col(p) >= threshold) == (F.col(y) == 1)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"),
        (F.avg(confidence) - F.avg(right.cast("double"))).alias("confidence_minus_accuracy"),
        F.avg(F.when(~right, confidence)).alias("confidence_when_wrong"))


def seed_summary(df: DataFrame, keys: list[str], value: str, seed: str = "seed") -> DataFrame:
    """Mean, sample deviation, number of seeds and the normal 95 % interval of the mean."""
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.countDistinct(seed).alias("n_seeds"))
    half = F.col("sd") * 1.96 / F.sqrt(F.col("n_seeds").cast("double"))
    return base.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def largest_of(columns: list[str], labels: list[str]) -> Column:
    """Label of the largest column; the first wins ties."""
    values = F.array(*[F.col(c) for c in columns])
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(values, F.array_max(values)).cast("int"))

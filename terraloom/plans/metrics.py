"""Accuracy, calibration, ranking, selective prediction and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.hashing import hash_unit, md5_int
from terraloom.operators import bootstrap as B
from terraloom.operators import metrics as M
from terraloom.operators.attach import attach
from terraloom.operators.ordering import exact_quantiles, mid_ranks, top_rows
from terraloom.plans.registry import R, query, r, with_ctes
from terraloom.sources.tables import SEEDS, scored, scored_sql, sql_md5, table


def is_positive() -> Column:
    return F.col("p") >= 0.5


def is_true() -> Column:
    return F.col("y") == 1


COUNTS = """CAST(sum(CASE WHEN {p} AND {t} THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN {p} AND NOT {t} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
 CAST(sum(CASE WHEN NOT {p} AND {t} THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT {p} AND NOT {t} THEN 1 ELSE 0 END) AS BIGINT) AS tn"""


def counts_sql(p: str = "(p >= 0.5e0)", t: str = "(y = 1)") -> str:
    return COUNTS.format(p=p, t=t)


def metric_sql(policy: str = "null") -> dict[str, str]:
    div = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"
    fix = (lambda e: f"coalesce({e}, 0)") if policy == "zero" else (lambda e: f"({e})")
    recall, spec = fix(div("tp", "tp + fn")), fix(div("tn", "tn + fp"))
    return {
        "precision": fix(div("tp", "tp + fp")), "recall": recall, "f1": fix(div("2 * tp", "2 * tp + fp + fn")),
        "iou": fix(div("tp", "tp + fp + fn")), "accuracy": fix(div("tp + tn", "tp + fp + fn + tn")),
        "balanced_accuracy": f"({recall} + {spec}) / 2",
    }


def metric_list(policy: str = "null") -> str:
    return ", ".join(f"{R(e)} AS {name}" for name, e in metric_sql(policy).items())


def metric_cols(policy: str = "null"):
    return [r(c).alias(name) for name, c in M.count_metrics(policy).items()]


ONE = with_ctes(scored_sql())
TWO = with_ctes(scored_sql(("a", "b")))
BINS10 = " + ".join(f"CASE WHEN p >= {i * (1.0 / 10)!r}e0 THEN 1 ELSE 0 END" for i in range(1, 10))
BINS8 = " + ".join(f"CASE WHEN p >= {i / 8!r}e0 THEN 1 ELSE 0 END" for i in range(1, 8))


@query("b07_threshold_prediction", ONE + "SELECT seed, sample_id, CAST(p >= 0.5e0 AS BIGINT) AS pred FROM scored")
def _(spark, d):
    return scored(spark, d).select("seed", "sample_id", is_positive().cast("bigint").alias("pred"))


@query("d09_confusion_counts", ONE + f"SELECT seed, {counts_sql()} FROM scored WHERE block <> 7 GROUP BY seed")
def _(spark, d):
    return M.confusion_counts(scored(spark, d), ["seed"], is_positive(), is_true(), F.col("block") != 7)


@query("d10_block_confusion", TWO + f"SELECT rep, seed, block, {counts_sql()} FROM scored GROUP BY rep, seed, block")
def _(spark, d):
    return M.confusion_counts(scored(spark, d, ("a", "b")), ["rep", "seed", "block"], is_positive(), is_true())


@query("d11_metrics_undefined_null", ONE + f"""SELECT seed, grp, {metric_list()} FROM
  (SELECT seed, floor(p * 10e0) AS grp, {counts_sql()} FROM scored GROUP BY ALL)""")
def _(spark, d):
    grouped = scored(spark, d).withColumn("grp", F.floor(F.col("p") * 10.0).cast("double"))
    return M.confusion_counts(grouped, ["seed", "grp"], is_positive(), is_true()).select("seed", "grp", *metric_cols())


@query("d11_metrics_undefined_zero", ONE + f"""SELECT seed, grp, {metric_list('zero')} FROM
  (SELECT seed, floor(p * 10e0) AS grp, {counts_sql()} FROM scored GROUP BY ALL)""")
def _(spark, d):
    grouped = scored(spark, d).withColumn("grp", F.floor(F.col("p") * 10.0).cast("double"))
    return M.confusion_counts(grouped, ["seed", "grp"], is_positive(), is_true()).select("seed", "grp", *metric_cols("zero"))


@query("d12_calibration_error", ONE + f"""SELECT seed, {R('sum(n * abs(f - m)) / sum(n)')} AS ece FROM
  (SELECT seed, {BINS10} AS b, count(*) AS n, avg(y) AS f, avg(p) AS m FROM scored GROUP BY ALL) GROUP BY seed""")
def _(spark, d):
    return M.calibration_error(scored(spark, d), ["seed"], "y", "p").select("seed", r("ece").alias("ece"))


def off_ties(name: str):
    """Rounded metric; small blocks give exact decimals, so shares are nudged off the middle between two roundings, as in the SQL."""
    return r(F.col(name) + (1e-10 if name in ("brier", "ece") else 0.0))


def bundle_sql(keys: str, rows: str = "scored") -> list[str]:
    """CTEs pb, ec and au with the probability metrics, the calibration error and the AUROC of each key."""
    return [f"""pb AS (SELECT {keys}, count(*) AS n, {R('avg((p - y) * (p - y)) + 1e-10')} AS brier,
  {R('avg(-(y * ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) + (1 - y) * ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))))')} AS log_loss,
  {R('avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END)')} AS error_rate FROM {rows} GROUP BY {keys})""",
            f"ec AS (SELECT {keys}, {R('sum(n * abs(f - m)) / sum(n) + 1e-10')} AS ece FROM (SELECT {keys}, {BINS10} AS b, count(*) AS n, avg(y) AS f, avg(p) AS m FROM {rows} GROUP BY ALL) GROUP BY {keys})",
            f"""au AS (SELECT {keys}, {R("(sum(CASE WHEN y = 1 THEN mr ELSE 0 END) - np * (np + 1) / 2e0) / nullif(np * nn, 0)")} AS auroc FROM (
  SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2e0 AS mr,
    CAST(sum(y) OVER (PARTITION BY {keys}) AS DOUBLE) AS np, CAST(sum(1 - y) OVER (PARTITION BY {keys}) AS DOUBLE) AS nn FROM {rows}) GROUP BY {keys}, np, nn)"""]


@query("d13_probability_metrics", with_ctes(scored_sql(), *bundle_sql("seed")) + "SELECT seed, n, brier, log_loss, error_rate, ece, auroc FROM pb JOIN ec USING (seed) JOIN au USING (seed)")
def _(spark, d):
    out = M.evaluation_bundle(scored(spark, d), ["seed"], "y", "p")
    return out.select("seed", "n", *[off_ties(c).alias(c) for c in ("brier", "log_loss", "error_rate", "ece", "auroc")])


RANK_SQL = f"""SELECT seed, {R("(sum(CASE WHEN y = 1 THEN mr ELSE 0 END) - np * (np + 1) / 2e0) / nullif(np * nn, 0)")} AS auroc FROM (
  SELECT seed, y, rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2e0 AS mr,
    CAST(sum(y) OVER (PARTITION BY seed) AS DOUBLE) AS np, CAST(sum(1 - y) OVER (PARTITION BY seed) AS DOUBLE) AS nn FROM scored) GROUP BY seed, np, nn"""


@query("d14_auroc_exact", ONE + RANK_SQL)
def _(spark, d):
    return M.rank_metrics(scored(spark, d), ["seed"], "y", "p").select("seed", r("auroc").alias("auroc"))


@query("d15_average_precision", ONE + f"""SELECT seed, {R('sum(pos * cp / ca) / max(np)')} AS auprc FROM (
  SELECT seed, p, pos, sum(pos) OVER w AS cp, sum(n) OVER w AS ca, sum(pos) OVER (PARTITION BY seed) AS np FROM (
    SELECT seed, p, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM scored GROUP BY seed, p)
  WINDOW w AS (PARTITION BY seed ORDER BY p DESC)) GROUP BY seed""")
def _(spark, d):
    return M.rank_metrics(scored(spark, d), ["seed"], "y", "p").select("seed", r("auprc").alias("auprc"))


@query("d16_reliability_width_bins", ONE + f"""SELECT seed, CAST({BINS8} AS BIGINT) AS bin, {R('avg(p)')} AS mean_probability,
  {R('avg(y)')} AS observed_frequency, count(*) AS n FROM scored GROUP BY ALL""")
def _(spark, d):
    out = M.reliability(scored(spark, d), ["seed"], "y", "p", 8)
    return out.select("seed", "bin", r("mean_probability").alias("mean_probability"), r("observed_frequency").alias("observed_frequency"), "n")


def qbin_sql(value: str, bins: int, source: str, keys: str = "seed") -> str:
    """CTE `binned`: right-closed quantile bins with distinct edges."""
    qs = ", ".join(repr(i / bins) for i in range(bins + 1))
    return f"""edges AS (SELECT {keys}, list_sort(list_distinct(quantile_cont({value}, [{qs}]))) AS e FROM {source} GROUP BY {keys}),
binned AS (SELECT s.*, CAST(len(list_filter(e[2:len(e) - 1], lambda q: q < s.{value})) AS BIGINT) AS bin FROM {source} s JOIN edges USING ({keys}))"""


@query("d16_reliability_quantile_bins", with_ctes(scored_sql(), qbin_sql("p", 10, "scored")) + f"""SELECT seed, bin, {R('avg(p)')} AS mean_probability,
  {R('avg(y)')} AS observed_frequency, count(*) AS n FROM binned GROUP BY ALL""")
def _(spark, d):
    binned = M.quantile_bins(scored(spark, d), ["seed"], "p", 10)
    return binned.groupBy("seed", "bin").agg(r(F.avg("p")).alias("mean_probability"), r(F.avg("y")).alias("observed_frequency"), F.count(F.lit(1)).alias("n"))


@query("e01_quantile_bins", with_ctes(scored_sql(), qbin_sql("risk", 10, "scored")) + "SELECT seed, sample_id, bin FROM binned")
def _(spark, d):
    return M.quantile_bins(scored(spark, d), ["seed"], "risk", 10).select("seed", "sample_id", "bin")


@query("d51_quantile_profile", with_ctes(scored_sql(), qbin_sql("risk", 5, "scored")) + f"""SELECT seed, bin + 1 AS quintile, count(*) AS n, {R('avg(risk)')} AS mean_score,
  {R('avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END)')} AS error_rate, {R('avg(p)')} AS mean_probability FROM binned GROUP BY ALL""")
def _(spark, d):
    binned = M.quantile_bins(scored(spark, d), ["seed"], "risk", 5)
    return binned.groupBy("seed", (F.col("bin") + 1).alias("quintile")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("risk")).alias("mean_score"), r(F.avg((is_positive() != is_true()).cast("double"))).alias("error_rate"),
        r(F.avg("p")).alias("mean_probability"))


@query("e02_mid_and_percent_rank", ONE + f"""SELECT seed, p, count(*) AS n, {R('min(mr)')} AS mid_rank, {R('min(mr / tot)')} AS pct_rank FROM (
  SELECT seed, p, rank() OVER (PARTITION BY seed ORDER BY p) + (count(*) OVER (PARTITION BY seed, p) - 1) / 2e0 AS mr,
  count(*) OVER (PARTITION BY seed) AS tot FROM scored) GROUP BY seed, p""")
def _(spark, d):
    out = mid_ranks(scored(spark, d), ["seed"], "p")
    return out.select("seed", "p", "n", r("mid_rank").alias("mid_rank"), r(F.col("mid_rank") / F.col("total")).alias("pct_rank"))


TIES = f"""g AS (SELECT seed, risk, count(*) AS n, {counts_sql()} FROM scored GROUP BY seed, risk),
c AS (SELECT *, sum(n) OVER w - n AS bn, sum(tp) OVER w - tp AS btp, sum(fp) OVER w - fp AS bfp, sum(fn) OVER w - fn AS bfn,
  sum(n) OVER (PARTITION BY seed) AS tot FROM g WINDOW w AS (PARTITION BY seed ORDER BY risk)),
pts AS (SELECT seed, CAST(bn + i AS BIGINT) AS k, tot, btp + tp * CAST(i AS DOUBLE) / n AS etp, bfp + fp * CAST(i AS DOUBLE) / n AS efp, bfn + fn * CAST(i AS DOUBLE) / n AS efn
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c))"""
CURVE_COLS = f"{R('CAST(k AS DOUBLE) / tot')} AS coverage, {R('(efp + efn) / k')} AS risk, {R('coalesce(2 * etp / nullif(2 * etp + efp + efn, 0), 0)')} AS f1"


@query("e03_risk_coverage_curve", with_ctes(scored_sql(), TIES) + f"SELECT seed, k, {CURVE_COLS} FROM pts")
def _(spark, d):
    out = M.selective_curve(scored(spark, d), ["seed"], "y", "p", "risk")
    return out.select("seed", "k", *[r(c).alias(c) for c in ("coverage", "risk", "f1")])


@query("e03_area_under_risk_coverage", with_ctes(scored_sql(), TIES) + f"SELECT seed, {R('avg((efp + efn) / k)')} AS aurc, count(*) AS n FROM pts GROUP BY seed")
def _(spark, d):
    curve = M.selective_curve(scored(spark, d), ["seed"], "y", "p", "risk")
    return curve.groupBy("seed").agg(r(F.avg("risk")).alias("aurc"), F.count(F.lit(1)).alias("n"))


COVERAGES = [1.0, 0.9, 0.8, 0.7, 0.5]
COVER_SQL = ", ".join(f"({c}e0)" for c in COVERAGES)


@query("e05_operating_points", with_ctes(scored_sql(), TIES, f"cov AS (SELECT * FROM (VALUES {COVER_SQL}) AS v(requested))") + f"""SELECT seed, requested, k, {CURVE_COLS}
  FROM pts, cov WHERE k = greatest(1, CAST(ceil(requested * tot) AS BIGINT))""")
def _(spark, d):
    out = M.operating_points(scored(spark, d), ["seed"], "y", "p", "risk", COVERAGES)
    return out.select("seed", "requested", "k", *[r(c).alias(c) for c in ("coverage", "risk", "f1")])


@query("e04_coverage_prefix_metrics", with_ctes(scored_sql(), f"cov AS (SELECT * FROM (VALUES {COVER_SQL}) AS v(coverage))",
       "o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY risk, sample_id) AS rk, count(*) OVER (PARTITION BY seed) AS tot FROM scored)") + f"""
  SELECT seed, coverage, tp, fp, fn, tn, {metric_list('zero')} FROM (SELECT seed, coverage, {counts_sql()} FROM o, cov WHERE rk <= round_even(tot * coverage, 0) GROUP BY ALL)""")
def _(spark, d):
    out = M.prefix_metrics(scored(spark, d), ["seed"], "y", "p", "risk", "sample_id", COVERAGES)
    return out.select("seed", "coverage", "tp", "fp", "fn", "tn", *metric_cols("zero"))


@query("e06_threshold_transfer", with_ctes(scored_sql(), f"cov AS (SELECT * FROM (VALUES {COVER_SQL}) AS v(coverage))",
       "cuts AS (SELECT seed, coverage, CASE WHEN coverage < 1 THEN quantile_cont(risk, coverage) ELSE 'inf'::DOUBLE END AS cutoff FROM (SELECT * FROM scored WHERE block < 18), cov GROUP BY seed, coverage)".replace(
           "quantile_cont(risk, coverage)", "CASE " + " ".join(f"WHEN coverage = {c}e0 THEN quantile_cont(risk, {c})" for c in COVERAGES) + " END")) + f"""
  SELECT seed, coverage, CAST(sum(CASE WHEN risk <= cutoff THEN 1 ELSE 0 END) AS BIGINT) AS n, {R('avg(CASE WHEN risk <= cutoff THEN 1e0 ELSE 0e0 END)')} AS actual_coverage,
  {R('avg(CASE WHEN risk <= cutoff THEN CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END END)')} AS risk
  FROM (SELECT * FROM scored WHERE block >= 18) JOIN cuts USING (seed) GROUP BY seed, coverage""")
def _(spark, d):
    rows = scored(spark, d)
    cuts = exact_quantiles(rows.where("block < 18"), ["seed"], "risk", {f"c{i}": c for i, c in enumerate(COVERAGES)})
    limits = F.explode(F.array(*[
        F.struct(F.lit(c).alias("coverage"), (F.col(f"c{i}") if c < 1 else F.lit(float("inf"))).alias("cutoff")) for i, c in enumerate(COVERAGES)]))
    cuts = cuts.select("seed", limits.alias("l")).select("seed", "l.*")
    kept, wrong = F.col("risk") <= F.col("cutoff"), (is_positive() != is_true()).cast("double")
    return rows.where("block >= 18").join(cuts, "seed").groupBy("seed", "coverage").agg(
        F.sum(F.when(kept, 1).otherwise(0)).cast("bigint").alias("n"), r(F.avg(kept.cast("double"))).alias("actual_coverage"),
        r(F.avg(F.when(kept, wrong))).alias("risk"))


HALVES = f"""halves AS (SELECT sd AS seed, block, CASE WHEN rk <= nb // 2 THEN 'tune' ELSE 'held' END AS role FROM (
  SELECT sd, block, row_number() OVER (PARTITION BY sd ORDER BY {sql_md5("concat_ws(':', sd, block)")}, block) AS rk, count(*) OVER (PARTITION BY sd) AS nb
  FROM (SELECT DISTINCT block FROM scored), (VALUES (1::BIGINT), (2::BIGINT)) AS s(sd)))"""
FROZEN_COV = [0.9, 0.7, 0.5]


def frozen_sql(score: str) -> str:
    cuts = " UNION ALL ".join(f"SELECT seed, {c}e0 AS target_coverage, quantile_cont({score}, {c}) AS threshold FROM rows_ WHERE role = 'tune' GROUP BY seed" for c in FROZEN_COV)
    err = "CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END"
    return f"""cuts AS ({cuts})
SELECT seed, target_coverage, {R('max(threshold)')} AS threshold, CAST(sum(CASE WHEN {score} <= threshold THEN 1 ELSE 0 END) AS BIGINT) AS n,
  {R(f'avg(CASE WHEN {score} <= threshold THEN 1e0 ELSE 0e0 END)')} AS actual_coverage, {R(f'avg(CASE WHEN {score} <= threshold THEN {err} END)')} AS error_rate,
  {R(f'avg({err})')} AS held_full_error FROM rows_ JOIN cuts USING (seed) WHERE role = 'held' GROUP BY seed, target_coverage"""


BASE42 = "base AS (SELECT sample_id, block, y, p, risk FROM scored WHERE seed = 42)"


@query("e07_tune_held_thresholds", with_ctes(scored_sql(), BASE42, HALVES, "rows_ AS (SELECT h.seed, h.role, b.* FROM base b JOIN halves h USING (block))") + ", " + frozen_sql("risk"))
def _(spark, d):
    base = scored(spark, d, seeds=(42,)).drop("seed").withColumn("error", (is_positive() != is_true()).cast("double"))
    out = M.frozen_thresholds(base, M.block_halves(base, "block", [1, 2]), "block", "risk", "error", FROZEN_COV)
    return out.select("seed", "target_coverage", r("threshold").alias("threshold"), "n", *[r(c).alias(c) for c in ("actual_coverage", "error_rate", "held_full_error")])


@query("e07_combined_zscore_thresholds", with_ctes(scored_sql(), BASE42, HALVES, "raw_ AS (SELECT h.seed, h.role, b.*, 1 - abs(2 * b.p - 1) AS conf FROM base b JOIN halves h USING (block))",
       "st AS (SELECT seed, avg(conf) AS mc, stddev_samp(conf) AS sc, avg(risk) AS mr, stddev_samp(risk) AS sr FROM raw_ WHERE role = 'tune' GROUP BY seed)",
       "rows_ AS (SELECT raw_.*, round((conf - mc) / sc + (risk - mr) / sr, 9) AS combined FROM raw_ JOIN st USING (seed))") + ", " + frozen_sql("combined"))
def _(spark, d):
    base = scored(spark, d, seeds=(42,)).drop("seed").withColumn("error", (is_positive() != is_true()).cast("double"))
    halves = M.block_halves(base, "block", [1, 2])
    rows = base.withColumn("conf", 1 - F.abs(2 * F.col("p") - 1)).join(halves, "block")
    combined = M.zscore_sum(rows, rows.where("role = 'tune'"), ["seed"], ["conf", "risk"], "combined").withColumn("combined", F.round("combined", 9))
    probs = {f"t{i}": c for i, c in enumerate(FROZEN_COV)}
    limits = exact_quantiles(combined.where("role = 'tune'"), ["seed"], "combined", probs)
    held = combined.where("role = 'held'").join(limits, "seed").withColumn("t", F.explode(F.array(*[
        F.struct(F.lit(c).alias("target_coverage"), F.col(f"t{i}").alias("threshold")) for i, c in enumerate(FROZEN_COV)])))
    keep = F.col("combined") <= F.col("t.threshold")
    return held.groupBy("seed", F.col("t.target_coverage").alias("target_coverage")).agg(
        r(F.max("t.threshold")).alias("threshold"), F.sum(F.when(keep, 1).otherwise(0)).cast("bigint").alias("n"),
        r(F.avg(keep.cast("double"))).alias("actual_coverage"), r(F.avg(F.when(keep, F.col("error")))).alias("error_rate"),
        r(F.avg("error")).alias("held_full_error"))


RUN_F1 = f"f AS (SELECT rep, seed, {metric_sql('zero')['f1']} AS f1 FROM (SELECT rep, seed, {counts_sql()} FROM scored GROUP BY ALL))"


def run_f1(spark, d, reps=("a", "b")):
    return M.confusion_counts(scored(spark, d, reps), ["rep", "seed"], is_positive(), is_true()).select("rep", "seed", M.count_metrics("zero")["f1"].alias("f1"))


@query("d28_seed_summary", with_ctes(scored_sql(("a", "b")), RUN_F1) + f"""SELECT rep, {R('avg(f1)')} AS mean, {R('stddev_samp(f1)')} AS sd, count(DISTINCT seed) AS n_seeds,
  {R('avg(f1) - 1.96e0 * stddev_samp(f1) / sqrt(count(DISTINCT seed))')} AS ci_low, {R('avg(f1) + 1.96e0 * stddev_samp(f1) / sqrt(count(DISTINCT seed))')} AS ci_high FROM f GROUP BY rep""")
def _(spark, d):
    out = M.seed_summary(run_f1(spark, d), ["rep"], "f1")
    return out.select("rep", "n_seeds", *[r(c).alias(c) for c in ("mean", "sd", "ci_low", "ci_high")])


#: Replicates of the bootstraps of means and differences, and of scores' AUROC.
REPS, SCORE_REPS = 1000, 500


def draws_sql(seed: int, reps: int = REPS) -> str:
    return f"""idx AS (SELECT block, row_number() OVER (ORDER BY block) AS i, count(*) OVER () AS nb FROM (SELECT DISTINCT block FROM base)),
slots AS (SELECT rep_, {sql_md5(f"concat_ws(':', {seed}, rep_, i)")} % nb + 1 AS i FROM idx, range(1, {reps + 1}) AS t(rep_)),
draws AS (SELECT rep_, block, count(*) AS w FROM slots JOIN idx USING (i) GROUP BY ALL)"""


@query("d29_bootstrap_mean", with_ctes(scored_sql(), BASE42, draws_sql(7), """tot AS (SELECT block, CAST(sum(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1 ELSE 0 END) AS DOUBLE) AS s, count(*) AS c FROM base GROUP BY block)""",
       "est AS (SELECT rep_, sum(w * s) / sum(w * c) AS e FROM draws JOIN tot USING (block) GROUP BY rep_)") + f"SELECT {R('quantile_cont(e, 0.025)')} AS ci_low, {R('quantile_cont(e, 0.975)')} AS ci_high, count(e) AS valid_reps FROM est")
def _(spark, d):
    base = scored(spark, d, seeds=(42,)).withColumn("error", (is_positive() != is_true()).cast("int"))
    out = B.bootstrap_mean(base, "block", "error", REPS, 7)
    return out.select(r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"), "valid_reps")


@query("d29_bootstrap_auroc", with_ctes(scored_sql(), BASE42, draws_sql(8, SCORE_REPS),
       "cells AS (SELECT rep_, risk, sum(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 0 ELSE w END)::DOUBLE AS neg FROM base JOIN draws USING (block) GROUP BY ALL)",
       "run AS (SELECT rep_, pos * (sum(neg) OVER (PARTITION BY rep_ ORDER BY risk) - neg / 2) AS win, pos, neg FROM cells)",
       "est AS (SELECT rep_, sum(win) / nullif(sum(pos) * sum(neg), 0) AS e FROM run GROUP BY rep_)") + f"SELECT {R('quantile_cont(e, 0.025)')} AS ci_low, {R('quantile_cont(e, 0.975)')} AS ci_high, count(e) AS valid_reps FROM est")
def _(spark, d):
    base = scored(spark, d, seeds=(42,)).withColumn("error", (is_positive() != is_true()).cast("int"))
    out = B.bootstrap_auroc(base, "block", "error", "risk", SCORE_REPS, 8)
    return out.select(r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"), "valid_reps")


F1_SUMS = "coalesce(2e0 * sum(w * tp) / nullif(sum(w * (2 * tp + fp + fn)), 0), 0)"


@query("d30_paired_block_bootstrap", with_ctes(scored_sql(("a", "b")), "base AS (SELECT * FROM scored)", draws_sql(9), f"cnt AS (SELECT rep, seed, block, {counts_sql()} FROM scored GROUP BY ALL)",
       f"fr AS (SELECT rep_, rep, seed, {F1_SUMS} AS f1 FROM cnt JOIN draws USING (block) GROUP BY ALL)",
       "est AS (SELECT rep_, avg(f1) FILTER (rep = 'b') - avg(f1) FILTER (rep = 'a') AS e FROM fr GROUP BY rep_)",
       "pt AS (SELECT rep, seed, coalesce(2e0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS f1 FROM cnt GROUP BY ALL)") + f"""
  SELECT {R('quantile_cont(e, 0.025)')} AS ci_low, {R('quantile_cont(e, 0.975)')} AS ci_high, count(e) AS valid_reps,
  (SELECT {R("avg(f1) FILTER (rep = 'b') - avg(f1) FILTER (rep = 'a')")} FROM pt) AS delta_f1, (SELECT count(DISTINCT block) FROM base) AS n_blocks FROM est""")
def _(spark, d):
    out = B.paired_f1(scored(spark, d, ("a", "b")), ["seed"], "block", "rep", "a", "b", is_positive(), is_true(), REPS, 9)
    return out.select(r("ci_low").alias("ci_low"), r("ci_high").alias("ci_high"), "valid_reps", r("delta_f1").alias("delta_f1"), "n_blocks")


MIDRANK = "rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2e0"


@query("d32_spearman_sample", ONE + f"""SELECT seed, {R('corr(ra, rb)')} AS spearman FROM (SELECT seed, {MIDRANK.format(k='seed', v='risk')} AS ra, {MIDRANK.format(k='seed', v='p')} AS rb FROM scored) GROUP BY seed""")
def _(spark, d):
    return M.spearman(scored(spark, d), ["seed"], "risk", "p").select("seed", r("spearman").alias("spearman"))


@query("d32_spearman_block_means", ONE + f"""SELECT seed, {R('corr(ra, rb)')} AS spearman FROM (SELECT seed, {MIDRANK.format(k='seed', v='s')} AS ra, {MIDRANK.format(k='seed', v='e')} AS rb FROM (
  SELECT seed, block, round(avg(risk), 9) AS s, round(avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END), 9) AS e FROM scored GROUP BY ALL)) GROUP BY seed""")
def _(spark, d):
    blocks = scored(spark, d).groupBy("seed", "block").agg(F.round(F.avg("risk"), 9).alias("s"), F.round(F.avg((is_positive() != is_true()).cast("double")), 9).alias("e"))
    return M.spearman(blocks, ["seed"], "s", "e").select("seed", r("spearman").alias("spearman"))


PAIR = f"""pair AS (SELECT sample_id, block, y, risk, max(p) FILTER (rep = 'a') AS pa, max(p) FILTER (rep = 'b') AS pb FROM scored WHERE seed = 42 GROUP BY ALL),
grp AS (SELECT *, CASE WHEN ca AND cb THEN 'both_correct' WHEN ca THEN 'a_only_correct' WHEN cb THEN 'b_only_correct' ELSE 'both_wrong' END AS error_group
  FROM (SELECT *, (pa >= 0.5e0) = (y = 1) AS ca, (pb >= 0.5e0) = (y = 1) AS cb FROM pair))"""


def error_pairs(spark, d):
    rows = scored(spark, d, ("a", "b"), (42,))
    wide = rows.groupBy("sample_id", "block", "y", "risk").agg(F.max(F.when(F.col("rep") == "a", F.col("p"))).alias("pa"), F.max(F.when(F.col("rep") == "b", F.col("p"))).alias("pb"))
    right_a, right_b = (F.col("pa") >= 0.5) == is_true(), (F.col("pb") >= 0.5) == is_true()
    return wide.withColumn("error_group", F.when(right_a & right_b, "both_correct").when(right_a, "a_only_correct").when(right_b, "b_only_correct").otherwise("both_wrong"))


@query("b18_error_complementarity", with_ctes(scored_sql(("a", "b")), PAIR) + "SELECT sample_id, error_group FROM grp")
def _(spark, d):
    return error_pairs(spark, d).select("sample_id", "error_group")


@query("d41_error_overlap_summary", with_ctes(scored_sql(("a", "b")), PAIR) + f"""SELECT error_group, count(*) AS n, {R('avg(risk)')} AS mean_distance,
  {R('avg(CASE WHEN ((pa + pb) / 2 >= 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END)')} AS mean_accuracy, {R('count(*) / (SELECT count(*)::DOUBLE FROM grp)')} AS share FROM grp GROUP BY error_group""")
def _(spark, d):
    rows = error_pairs(spark, d)
    fused = ((F.col("pa") + F.col("pb")) / 2 >= 0.5) == is_true()
    summary = rows.groupBy("error_group").agg(F.count(F.lit(1)).alias("n"), r(F.avg("risk")).alias("mean_distance"), r(F.avg(fused.cast("double"))).alias("mean_accuracy"))
    return attach(summary, summary.agg(F.sum("n").alias("_all")), []).withColumn("share", r(F.col("n") / F.col("_all"))).drop("_all")


BANDS = """bands AS (SELECT s.*, CASE WHEN risk <= q20 THEN 'nearest_20' WHEN risk >= q80 THEN 'farthest_20' ELSE 'middle_60' END AS band FROM scored s
  JOIN (SELECT seed, quantile_cont(risk, 0.2) AS q20, quantile_cont(risk, 0.8) AS q80 FROM scored GROUP BY seed) USING (seed))"""


@query("b19_distance_bands", with_ctes(scored_sql(), BANDS) + "SELECT seed, sample_id, band FROM bands")
def _(spark, d):
    return M.distance_bands(scored(spark, d), ["seed"], "risk").select("seed", "sample_id", "band")


@query("d49_overconfidence_by_band", with_ctes(scored_sql(), BANDS) + f"""SELECT seed, band, count(*) AS n, {R('avg(ok)')} AS accuracy, {R('avg(cf)')} AS mean_confidence,
  {R('avg(cf) - avg(ok)')} AS confidence_minus_accuracy, {R('avg(CASE WHEN ok = 0 THEN cf END)')} AS confidence_when_wrong FROM (
  SELECT seed, band, greatest(p, 1 - p) AS cf, CASE WHEN (p >= 0.5e0) = (y = 1) THEN 1e0 ELSE 0e0 END AS ok FROM bands) GROUP BY ALL""")
def _(spark, d):
    out = M.overconfidence(M.distance_bands(scored(spark, d), ["seed"], "risk"), ["seed", "band"], "y", "p")
    return out.select("seed", "band", "n", *[r(c).alias(c) for c in ("accuracy", "mean_confidence", "confidence_minus_accuracy", "confidence_when_wrong")])


@query("d47_subset_sensitivity", with_ctes(scored_sql(), BANDS, "sub AS (SELECT seed, 'all' AS subset, y, p, risk FROM bands UNION ALL SELECT seed, 'interior', y, p, risk FROM bands WHERE block % 4 <> 0 UNION ALL SELECT seed, band, y, p, risk FROM bands)",
       f"m AS (SELECT seed, subset, {counts_sql()} FROM sub GROUP BY ALL)",
       "e AS (SELECT seed, subset, risk, sum(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END) AS pos, sum(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 0e0 ELSE 1e0 END) AS neg FROM sub GROUP BY ALL)",
       "a AS (SELECT seed, subset, sum(win) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, pos * (sum(neg) OVER (PARTITION BY seed, subset ORDER BY risk) - neg / 2) AS win FROM e) GROUP BY ALL)") + f"""
  SELECT seed, subset, {metric_list('zero')}, {R('auc')} AS error_auroc FROM m JOIN a USING (seed, subset)""")
def _(spark, d):
    rows = M.distance_bands(scored(spark, d), ["seed"], "risk")
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("block") % 4 != 0, F.lit("interior")), F.col("band")))
    rows = rows.withColumn("subset", F.explode(names)).withColumn("error", (is_positive() != is_true()).cast("int"))
    counts = M.confusion_counts(rows, ["seed", "subset"], is_positive(), is_true()).select("seed", "subset", *metric_cols("zero"))
    auc = M.rank_metrics(rows, ["seed", "subset"], "error", "risk").select("seed", "subset", r("auroc").alias("error_auroc"))
    return counts.join(auc, ["seed", "subset"])


@query("d48_metrics_by_representation", with_ctes(scored_sql(("a", "b")), "sp AS (SELECT *, CASE WHEN block < 12 THEN 'val' ELSE 'test' END AS split FROM scored)",
       f"m AS (SELECT rep, seed, split, {counts_sql()} FROM sp GROUP BY ALL)", *bundle_sql("rep, seed, split", "sp"))
       + f"SELECT rep, seed, split, {metric_list('zero')}, brier, log_loss, ece, auroc FROM m JOIN pb USING (rep, seed, split) JOIN ec USING (rep, seed, split) JOIN au USING (rep, seed, split)")
def _(spark, d):
    keys = ["rep", "seed", "split"]
    rows = scored(spark, d, ("a", "b")).withColumn("split", F.when(F.col("block") < 12, "val").otherwise("test"))
    counts = M.confusion_counts(rows, keys, is_positive(), is_true()).select(*keys, *metric_cols("zero"))
    more = M.evaluation_bundle(rows, keys, "y", "p").select(*keys, *[off_ties(c).alias(c) for c in ("brier", "log_loss", "ece", "auroc")])
    return counts.join(more, keys)



@query("d42_transfer_table", with_ctes(scored_sql(("a", "b")), f"m AS (SELECT rep, seed, block < 12 AS src, {metric_sql('zero')['f1']} AS f1 FROM (SELECT rep, seed, block, {counts_sql()} FROM (SELECT rep, seed, CASE WHEN block < 12 THEN 0 ELSE 99 END AS block, y, p FROM scored) GROUP BY ALL))",
       f"t AS (SELECT rep, avg(f1) FILTER (src) AS sm, stddev_samp(f1) FILTER (src) AS ss, avg(f1) FILTER (NOT src) AS tm, stddev_samp(f1) FILTER (NOT src) AS ts, count(DISTINCT seed) AS n_seeds FROM m GROUP BY rep)") + f"""
  SELECT rep, n_seeds, {R('sm')} AS source_mean, {R('ss')} AS source_sd, {R('tm')} AS target_mean, {R('ts')} AS target_sd, {R('sm - tm')} AS transfer_drop,
  {R("tm - (SELECT tm FROM t WHERE rep = 'a')")} AS gain_over_baseline FROM t""")
def _(spark, d):
    rows = scored(spark, d, ("a", "b")).withColumn("src", F.col("block") < 12)
    runs = M.confusion_counts(rows, ["rep", "seed", "src"], is_positive(), is_true()).select("rep", "seed", "src", M.count_metrics("zero")["f1"].alias("f1"))
    src, tgt = F.when(F.col("src"), F.col("f1")), F.when(~F.col("src"), F.col("f1"))
    t = runs.groupBy("rep").agg(F.avg(src).alias("sm"), F.stddev_samp(src).alias("ss"), F.avg(tgt).alias("tm"), F.stddev_samp(tgt).alias("ts"), F.countDistinct("seed").alias("n_seeds"))
    return attach(t, t.where("rep = 'a'").select(F.col("tm").alias("base")), []).select(
        "rep", "n_seeds", r("sm").alias("source_mean"), r("ss").alias("source_sd"), r("tm").alias("target_mean"), r("ts").alias("target_sd"),
        r(F.col("sm") - F.col("tm")).alias("transfer_drop"), r(F.col("tm") - F.col("base")).alias("gain_over_baseline"))


@query("b21_lowest_budget_reaching", with_ctes(scored_sql(("a", "b")), f"m AS (SELECT rep, budget, {metric_sql('zero')['f1']} AS f1 FROM (SELECT rep, 50 * (1 + sample_id % 10) AS budget, {counts_sql()} FROM scored GROUP BY ALL))") + "SELECT rep, th AS threshold, CAST(min(budget) AS BIGINT) AS min_budget FROM m, (VALUES (0.3e0), (0.4e0), (0.45e0)) AS v(th) WHERE f1 >= th GROUP BY ALL")
def _(spark, d):
    rows = scored(spark, d, ("a", "b")).withColumn("budget", 50 * (1 + F.col("sample_id") % 10))
    runs = M.confusion_counts(rows, ["rep", "budget"], is_positive(), is_true()).withColumn("f1", M.count_metrics("zero")["f1"])
    runs = runs.withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.4), F.lit(0.45))))
    return runs.where(F.col("f1") >= F.col("threshold")).groupBy("rep", "threshold").agg(F.min("budget").alias("min_budget"))


@query("b20_single_row_lookup", with_ctes(scored_sql(("a", "b")), RUN_F1) + f"SELECT rep, seed, {R('f1')} AS f1 FROM f WHERE rep = 'b' AND seed = 43")
def _(spark, d):
    return run_f1(spark, d).where("rep = 'b' AND seed = 43").limit(1).select("rep", "seed", r("f1").alias("f1"))


@query("d44_held_risk_summary", with_ctes(scored_sql(), BASE42, HALVES, "rows_ AS (SELECT h.seed, h.role, b.* FROM base b JOIN halves h USING (block))") + ", " + "fz AS (WITH " + frozen_sql("risk") + f") SELECT target_coverage, {R('avg(actual_coverage)', 5)} AS actual_coverage, {R('avg(error_rate)', 5)} AS error_rate, {R('avg(held_full_error)', 5)} AS held_full_error FROM fz GROUP BY target_coverage")
def _(spark, d):
    base = scored(spark, d, seeds=(42,)).drop("seed").withColumn("error", (is_positive() != is_true()).cast("double"))
    out = M.frozen_thresholds(base, M.block_halves(base, "block", [1, 2]), "block", "risk", "error", FROZEN_COV)
    names = ("actual_coverage", "error_rate", "held_full_error")
    return out.groupBy("target_coverage").agg(*[r(F.avg(r(c)), 5).alias(c) for c in names])


@query("d45_block_scores", with_ctes(scored_sql(), f"m AS (SELECT seed, block, min(y) AS lo, max(y) AS hi, {counts_sql()} FROM scored GROUP BY ALL)", *bundle_sql("seed, block"))
       + f"SELECT seed, block, {metric_list('zero')}, brier, log_loss, ece, auroc FROM m JOIN pb USING (seed, block) JOIN ec USING (seed, block) JOIN au USING (seed, block) WHERE lo < hi")
def _(spark, d):
    rows = scored(spark, d)
    grouped = rows.groupBy("seed", "block").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), *M.confusion_columns(is_positive(), is_true()))
    counts = grouped.where("lo < hi").select("seed", "block", *metric_cols("zero"))
    more = M.evaluation_bundle(rows, ["seed", "block"], "y", "p").select("seed", "block", *[off_ties(c).alias(c) for c in ("brier", "log_loss", "ece", "auroc")])
    return counts.join(more, ["seed", "block"])


@query("d46_finding_summary", with_ctes(scored_sql()) + f"""
  SELECT 'source' AS finding, 'mean_probability' AS metric, {R('avg(p)')} AS value FROM scored UNION ALL
  SELECT 'source', 'prevalence', {R('avg(y)')} FROM scored UNION ALL
  SELECT 'selective', 'error_rate', {R('avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END)')} FROM scored WHERE risk <= 0.5e0 UNION ALL
  SELECT 'blocks', 'n_blocks', {R('count(DISTINCT block)')} FROM scored""")
def _(spark, d):
    rows = scored(spark, d)
    wide = rows.agg(F.avg("p").alias("mp"), F.avg("y").alias("pv"), F.avg(F.when(F.col("risk") <= 0.5, (is_positive() != is_true()).cast("double"))).alias("er"),
                    F.countDistinct("block").cast("double").alias("nb"))
    names = [("source", "mean_probability", "mp"), ("source", "prevalence", "pv"), ("selective", "error_rate", "er"), ("blocks", "n_blocks", "nb")]
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("finding"), F.lit(b).alias("metric"), r(c).alias("value")) for a, b, c in names]))
    return wide.select(rows.alias("r")).select("r.*")


@query("labels_quality_calibration", "WITH scored AS (SELECT d.source, l.quality AS y, " + sql_md5("'p:' || l.doc_id") + f" / 4294967296e0 AS p FROM labels l JOIN documents d USING (doc_id)) SELECT source, {R('sum(n * abs(f - m)) / sum(n)')} AS ece FROM (SELECT source, {BINS10} AS b, count(*) AS n, avg(y) AS f, avg(p) AS m FROM scored GROUP BY ALL) GROUP BY source")
def _(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(
        "source", F.col("quality").alias("y"), hash_unit("p", F.col("doc_id")).alias("p"))
    return M.calibration_error(rows, ["source"], "y", "p").select("source", r("ece").alias("ece"))


@query("d31_stratified_area", with_ctes(scored_sql(), "map_ AS (SELECT sample_id, CAST(p >= 0.5e0 AS BIGINT) AS cls, y FROM scored WHERE seed = 42)",
       f"smp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {sql_md5('concat_ws(chr(58), 11, sample_id)')}, sample_id) AS slot FROM map_) WHERE slot <= 300)",
       "st AS (SELECT cls, count(*) AS total FROM map_ GROUP BY cls)", "sn AS (SELECT cls, count(*) AS n, avg(y) AS rate FROM smp GROUP BY cls)",
       f"rd AS (SELECT s.cls, rep_, {sql_md5('concat_ws(chr(58), 12, rep_, s.cls, s.slot)')} % n + 1 AS slot FROM smp s JOIN sn USING (cls), range(1, {REPS + 1}) AS t(rep_))",
       "mb AS (SELECT rd.cls, rep_, avg(y) AS rate FROM rd JOIN smp ON smp.cls = rd.cls AND smp.slot = rd.slot GROUP BY ALL)",
       "bo AS (SELECT rep_, sum(total * rate) / (SELECT sum(total) FROM st) AS share FROM mb JOIN st USING (cls) GROUP BY rep_)", "al AS (SELECT sum(total) * 0.04e0 AS area FROM st)") + f"""
  SELECT {R('(SELECT sum(total) * 0.04e0 FROM st WHERE cls = 1)')} AS naive_area, {R('(SELECT sum(total * rate) * 0.04e0 FROM st JOIN sn USING (cls))')} AS adjusted_area,
  {R('quantile_cont(share, 0.025) * max(area)')} AS area_low, {R('quantile_cont(share, 0.975) * max(area)')} AS area_high, {R('stddev_samp(share) * max(area)')} AS area_se FROM bo, al""")
def _(spark, d):
    mapped = scored(spark, d, seeds=(42,)).select("sample_id", is_positive().cast("bigint").alias("cls"), "y")
    sample = top_rows(mapped, ["cls"], md5_int(11, F.col("sample_id")), F.col("sample_id"), 300, "slot")  # trimmed to 300 a class in every map task
    strata = mapped.groupBy("cls").agg(F.count(F.lit(1)).alias("total"))
    out = B.stratified_area(strata, sample, "cls", "y", "slot", 0.04, REPS, 12)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("d31_area_sample_weights", with_ctes(scored_sql(), "map_ AS (SELECT sample_id, CAST(p >= 0.5e0 AS BIGINT) AS cls FROM scored WHERE seed = 42)",
       f"smp AS (SELECT *, count(*) OVER (PARTITION BY cls) AS total FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY {sql_md5('concat_ws(chr(58), 11, sample_id)')}, sample_id) AS slot FROM map_))") + f"""
  SELECT cls, sample_id, {R('least(300, total) / total::DOUBLE')} AS inclusion_probability, {R('total / least(300, total)::DOUBLE')} AS sample_weight, 'map_class_' || cls AS stratum FROM smp WHERE slot <= 300""")
def _(spark, d):
    mapped = scored(spark, d, seeds=(42,)).select("sample_id", is_positive().cast("bigint").alias("cls"))
    drawn = top_rows(mapped, ["cls"], md5_int(11, F.col("sample_id")), F.col("sample_id"), 300)
    rows = attach(drawn, mapped.groupBy("cls").agg(F.count(F.lit(1)).alias("total")), ["cls"])
    n = F.least(F.lit(300), F.col("total"))
    return rows.select("cls", "sample_id", r(n / F.col("total")).alias("inclusion_probability"), r(F.col("total") / n).alias("sample_weight"),
                       F.concat(F.lit("map_class_"), F.col("cls").cast("string")).alias("stratum"))


@query("d32_spearman_deciles", with_ctes(scored_sql(), qbin_sql("risk", 10, "scored")) + f"""SELECT seed, {R('corr(ra, rb)')} AS spearman FROM (SELECT seed, {MIDRANK.format(k='seed', v='bin')} AS ra, {MIDRANK.format(k='seed', v='e')} AS rb FROM (
  SELECT seed, bin, round(avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END), 9) AS e FROM binned GROUP BY ALL)) GROUP BY seed""")
def _(spark, d):
    deciles = M.quantile_bins(scored(spark, d), ["seed"], "risk", 10).groupBy("seed", "bin").agg(F.round(F.avg((is_positive() != is_true()).cast("double")), 9).alias("e"))
    return M.spearman(deciles, ["seed"], "bin", "e").select("seed", r("spearman").alias("spearman"))

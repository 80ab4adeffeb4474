"""Fits and scoring on Spark ML, and the adaptation and reliability studies built from them."""

from __future__ import annotations

import json
from pathlib import Path
from collections.abc import Callable
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.hashing import md5_int, row_digest, table_digest
from terraloom.functions.scalars import clipped_logit, density_odds
from terraloom.operators import forests
from terraloom.operators.attach import attach
from terraloom.operators.metrics import confusion_counts, count_metrics, rank_metrics
from terraloom.operators.ordering import ranked_summary
from terraloom.operators.sampling import SAMPLERS, confident_per_class, confident_rows, group_folds, matched_by_class
from terraloom.operators.temporal import standardize, train_scaling
from terraloom.session import materialize, shared_folder


LIBRARY_ROWS = 20_000  # rows that a forest of Spark ML is fitted on at most


def balanced(df: DataFrame, label: str, weight: str = "w") -> DataFrame:
    """Class weights n / (2 n_c), multiplied into an existing weight column if there is one."""
    sizes = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_n1"))
    factor = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_n1"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_n1"))))
    base = F.col(weight) if weight in df.columns else F.lit(1.0)
    return attach(df, sizes, []).withColumn("_w", base * factor).drop("_n", "_n1").drop(*([weight] if weight in df.columns else [])).withColumnRenamed("_w", weight)


def joint_weights(source: DataFrame, target: DataFrame) -> DataFrame:
    """Union in which the target rows together weigh as much as the source rows."""
    ns, nt = source.agg(F.count(F.lit(1)).alias("_ns")), target.agg(F.count(F.lit(1)).alias("_nt"))
    weighted = attach(attach(target, ns, []), nt, []).withColumn("w", F.col("_ns") / F.col("_nt")).drop("_ns", "_nt")
    return source.withColumn("w", F.lit(1.0)).unionByName(weighted)


def _vectors(df: DataFrame, x: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(x)))


def _positive(model, df: DataFrame, x: str, name: str) -> DataFrame:
    if isinstance(model, forests.Forest):
        return _tree_summary(model.tree_probabilities()(F.col(x)), df).select(*df.columns, F.col("_s.mean").alias(name))
    scored = model.transform(_vectors(df, x))
    return scored.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def fit_forest(df: DataFrame, label: str, x: str, trees: int, seed: int, leaf: int = 2, class_weights: bool = True, depth: int = 30):
    """Random forest with leaf size 2, sqrt features and balanced class weights, grown to `depth` (30 is the library's limit).

    Up to LIBRARY_ROWS rows by Spark ML, whose shuffle grows with nodes times tasks; beyond that by `forests`.
    """
    rows = balanced(df, label) if class_weights else (df if "w" in df.columns else df.withColumn("w", F.lit(1.0)))
    if df.count() > LIBRARY_ROWS:
        return forests.fit(rows, label, x, "w", trees, seed, leaf, depth)
    train = _vectors(rows.select(F.col(label).cast("double").alias("_y"), x, "w"), x).select("_y", "_features", "w")
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_features", weightCol="w", numTrees=trees, minInstancesPerNode=leaf,
                                    featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed)
    return forest.fit(train)


def fit_logistic(df: DataFrame, label: str, x: str, penalty: float, weight: str | None = None, steps: int = 3000):
    """Logistic regression; a fit that needs more than `steps` iterations is an error, not a quiet early stop."""
    train = _vectors(df, x).withColumn("_y", F.col(label).cast("double"))
    model = LogisticRegression(labelCol="_y", featuresCol="_features", regParam=penalty, maxIter=steps, standardization=False)
    return _converged((model.setWeightCol(weight) if weight else model).fit(train), steps)


def _converged(model, steps: int):
    if model.summary.totalIterations >= steps:
        raise RuntimeError(f"no convergence within {steps} iterations")
    return model


def fit_network(df: DataFrame, label: str, x: str, length: int, seed: int, steps: int = 500):
    """Two hidden layers; stops at the library's tolerance or after `steps` iterations."""
    train = _vectors(df, x).withColumn("_y", F.col(label).cast("double"))
    return MultilayerPerceptronClassifier(labelCol="_y", featuresCol="_features", layers=[length, 96, 48, 2], maxIter=steps, seed=seed).fit(train)


def score(model, df: DataFrame, x: str, name: str = "p") -> DataFrame:
    return _positive(model, df, x, name)


def score_map(model, pixels: DataFrame, x: str, medians: Column, least: int) -> DataFrame:
    """Map-scale scoring: p = -9999 and class 255 where fewer than `least` values were observed, gaps imputed."""
    observed = F.size(F.filter(x, lambda v: v.isNotNull()))
    filled = F.zip_with(x, medians, lambda v, m: F.coalesce(v, m))
    rows = pixels.withColumn("_ok", observed >= least).withColumn(x, filled)
    scored = _positive(model, rows, x, "_p")
    return scored.select("row", "col", F.when(F.col("_ok"), F.col("_p")).otherwise(F.lit(-9999.0)).alias("p"),
                         F.when(F.col("_ok"), (F.col("_p") >= 0.5).cast("int")).otherwise(255).alias("class"))


def _leaf_probabilities(model, folder: str) -> list[np.ndarray]:
    """P(class 1) per leaf and tree, in the order `predictLeaf` numbers leaves.

    Read back from the saved model; its size is bounded by the model, which the driver already holds.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    path = f"{folder}/forest-{uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").where("leftChild < 0").select("treeID", "id", "impurityStats").toPandas()
    nodes = nodes.sort_values(["treeID", "id"])
    stats = np.array(nodes["impurityStats"].tolist(), dtype=float)
    nodes["p"] = stats[:, 1] / stats.sum(1)
    return [group["p"].to_numpy() for _, group in nodes.groupby("treeID")]


def tree_uncertainty(model, df: DataFrame, x: str) -> DataFrame:
    """Adds p, vote_uncertainty and tree_variance from the leaf each tree assigns."""
    if isinstance(model, forests.Forest):
        scored = _tree_summary(model.tree_probabilities()(F.col(x)), df).withColumn("_p", F.col("_s.mean"))
    else:
        tables = _leaf_probabilities(model, shared_folder(df.sparkSession))

        @F.pandas_udf("array<double>")
        def assigned(leaves: pd.Series) -> pd.Series:
            index = np.array(leaves.tolist(), dtype=int)
            return pd.Series(list(np.stack([tables[t][index[:, t]] for t in range(len(tables))], axis=1)))

        model.setLeafCol("_leaf")
        moved = model.transform(_vectors(df, x)).withColumn("_p", vector_to_array("probability")[1])
        scored = _tree_summary(assigned(vector_to_array("_leaf")), moved)
    return scored.select(*df.columns, F.col("_p").alias("p"), F.col("_s.mean").alias("tree_mean"),
                         F.col("_s.vote").alias("vote_uncertainty"), F.col("_s.variance").alias("tree_variance"))


def _tree_summary(values: Column, df: DataFrame) -> DataFrame:
    """Adds `_s` (mean, vote, variance) of an array of the trees' probabilities."""

    @F.pandas_udf("struct<mean: double, vote: double, variance: double>")
    def summarize(trees: pd.Series) -> pd.DataFrame:
        p = np.array(trees.tolist(), dtype=float)
        vote = (p >= 0.5).mean(1)
        return pd.DataFrame({"mean": p.mean(1), "vote": 1 - np.maximum(vote, 1 - vote), "variance": p.var(1)})

    return df.withColumn("_s", summarize(values))


def importance_weights(source: DataFrame, pool: DataFrame, row: str, block: str, x: str, folds: int = 5, penalty_c: float = 1.0,
                       clip: tuple[float, float] = (0.1, 10.0)) -> DataFrame:
    """Out-of-fold density-ratio weights of source rows; adds raw, clipped and mean-normalised weight.

    A block never sits on both sides of a fold; standardisation and prior come from each fold's training rows.
    """
    cols = [row, block, x]
    both = source.select(*cols).withColumn("_d", F.lit(0)).unionByName(pool.select(*cols).withColumn("_d", F.lit(1)))
    both = both.withColumn("_g", F.concat_ws(":", F.when(F.col("_d") == 0, "s").otherwise("t"), F.col(block).cast("string")))
    both = materialize(both.join(group_folds(both, "_g", folds), "_g"))
    parts = []
    for fold in range(folds):
        train, held = both.where(F.col("fold") != fold), both.where((F.col("fold") == fold) & (F.col("_d") == 0))
        scaling = materialize(train_scaling(train, F.lit(True), x))
        n = train.count()
        model = fit_logistic(standardize(train, scaling, x), "_d", x, 1.0 / (penalty_c * n))
        prior = train.agg((F.count_if(F.col("_d") == 0) / F.count_if(F.col("_d") == 1)).alias("_prior"))
        scored = attach(_positive(model, standardize(held, scaling, x), x, "_p"), prior, [])
        parts.append(scored.select(row, "fold", density_odds(F.col("_p"), F.col("_prior")).alias("raw")))
    from terraloom.operators.contracts import union_all

    raw = materialize(union_all(parts).withColumn("clipped", F.least(F.greatest("raw", F.lit(clip[0])), F.lit(clip[1]))))
    return attach(raw, raw.agg(F.avg("clipped").alias("_mean")), []).withColumn("w", F.col("clipped") / F.col("_mean")).drop("_mean")


def permute_labels(df: DataFrame, row: str, label: str, seed: int) -> DataFrame:
    """Labels reassigned by matching two independent hash orders of the rows."""
    a = ranked_summary(df, [], md5_int(seed, "a", F.col(row)), F.col(row), "_k")
    b = ranked_summary(df.select(row, label), [], md5_int(seed, "b", F.col(row)), F.col(row), "_k").select("_k", F.col(label).alias("_new"))
    return a.join(b, "_k").withColumn(label, F.col("_new")).drop("_k", "_new")


def domain_audit(source: DataFrame, pool: DataFrame, source_test: DataFrame, target_test: DataFrame, row: str, label: str, x: str,
                 counts: tuple[dict[int, int], dict[int, int]], trees: int, seed: int) -> DataFrame:
    """AUROC of a source/target classifier on class-matched rows, and the same with permuted training labels."""
    mark = lambda df, d: df.select(row, x).withColumn("_d", F.lit(d))
    train = materialize(mark(source, 0).unionByName(mark(matched_by_class(pool, label, row, counts[0], seed), 1)))
    test = materialize(mark(source_test, 0).unionByName(mark(matched_by_class(target_test, label, row, counts[1], seed + 100), 1)))
    rows = []
    for name, data in (("true_domain", train), ("permuted_labels", permute_labels(train, row, "_d", seed + 900))):
        model = fit_forest(data, "_d", x, trees, seed)
        rows.append(rank_metrics(_positive(model, test, x, "p"), [], "_d", "p").select(F.lit(name).alias("test"), "auroc"))
    return rows[0].unionByName(rows[1])


def platt(calibration: DataFrame, evaluation: DataFrame, label: str, p: str) -> DataFrame:
    """Logistic recalibration of the clipped logit, fitted on one part and applied to the other."""
    logit = lambda df: df.withColumn("_z", F.array(clipped_logit(F.col(p))))
    model = fit_logistic(logit(calibration), label, "_z", 0.0)
    return _positive(model, logit(evaluation), "_z", "p_calibrated").drop("_z")


def principal_components(train: DataFrame, rows: DataFrame, x: str, k: int) -> DataFrame:
    """Scores on k components of the standardised training rows."""
    scaling = materialize(train_scaling(train, F.lit(True), x))
    model = PCA(k=k, inputCol="_features", outputCol="_pc").fit(_vectors(standardize(train, scaling, x), x))
    return model.transform(_vectors(standardize(rows, scaling, x), x)).withColumn(x, vector_to_array("_pc")).drop("_features", "_pc")


def pseudo_label_refit(source: DataFrame, pool: DataFrame, row: str, label: str, x: str, trees: int, seed: int, threshold: float = 0.95,
                       limit: int = 850):
    """Refit on source plus confident pool rows whose total weight equals the source's."""
    first = fit_forest(source, label, x, trees, seed)
    chosen = materialize(confident_rows(_positive(first, pool, x, "p"), "p", row, threshold, limit, seed).select(x, F.col("pseudo").alias(label)))
    if not chosen.limit(1).count():
        return first, 0
    return fit_forest(joint_weights(source.select(x, label), chosen), label, x, trees, seed), chosen.count()


def pseudo_label_rounds(source: DataFrame, pool: DataFrame, row: str, label: str, x: str, trees: int, seed: int, rounds: int = 3,
                        threshold: float = 0.90, limit: int = 1000, weight: float = 0.5) -> list[tuple[int, object, int]]:
    """Iterated refits: equal numbers of confident rows per class at a fixed weight, no class weights after round 0."""
    model = fit_forest(source, label, x, trees, seed)
    out = [(0, model, 0)]
    for i in range(1, rounds + 1):
        chosen = materialize(confident_per_class(_positive(model, pool, x, "p"), "p", row, threshold, limit).select(x, F.col("pseudo").alias(label)))
        n = chosen.count()
        rows = source.select(x, label).withColumn("w", F.lit(1.0)).unionByName(chosen.withColumn("w", F.lit(weight)))
        model = fit_forest(rows, label, x, trees, seed + i, class_weights=False)
        out.append((i, model, n))
    return out


def evaluation_row(scored: DataFrame, label: str, p: str, **tags) -> DataFrame:
    """One row of metrics with literal tags."""
    counts = confusion_counts(scored, [], F.col(p) >= 0.5, F.col(label) == 1)
    names = {n: c for n, c in count_metrics("zero").items()}
    row = attach(counts.select(*[c.alias(n) for n, c in names.items()]), rank_metrics(scored, [], label, p), [])
    return row.select(*[F.lit(v).alias(k) for k, v in tags.items()], *names, "auroc", "auprc")


def _written_digest(df: DataFrame) -> str:
    columns = sorted(df.columns)
    found = table_digest(df, [], row_digest(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])).first()
    return found.digest if found else ""


def cached_table(spark, folder: str, protocol: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """Result stored under the digest of its protocol, with a digest of its rows beside it.

    A finished table whose rows still have that digest is reused; an unfinished, damaged or unrecorded one is rebuilt.
    """
    key = sha256(json.dumps(protocol, sort_keys=True).encode()).hexdigest()[:32]
    path, record = f"{folder}/{key}", f"{folder}/{key}.record"
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS") for p in (path, record)]
    files = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    if all(files.exists(p) for p in paths):
        stored = spark.read.parquet(path)
        if spark.read.parquet(record).first().digest == _written_digest(stored):
            return stored
    build().write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    spark.createDataFrame([(_written_digest(stored),)], "digest string").write.mode("overwrite").parquet(record)
    return stored


def drawn_runs(spark, pool: DataFrame, row: str, label: str, block: str, x: str, grid: list[dict], trees: int) -> DataFrame:
    """The rows that each run of the grid draws from the pool, as `forests.fit_runs` takes them; run is the place in the grid.

    A draw of fewer rows is the start of a draw of more with the same regime and seed, so each of those is drawn once.
    """
    settings = spark.createDataFrame([(i, g["regime"], g["seed"], g["budget"], g.get("trees", trees), g["method"] != "target_only") for i, g in enumerate(grid)],
                                     "run int, regime string, seed int, budget int, trees int, with_base boolean")
    parts = []
    for regime in sorted({g["regime"] for g in grid if g["budget"]}):
        mine = [g for g in grid if g["regime"] == regime and g["budget"]]
        seeds = spark.createDataFrame([(s,) for s in sorted({g["seed"] for g in mine})], "seed int")
        rows = materialize(pool.select(row, label, block).crossJoin(F.broadcast(seeds)))
        drawn = SAMPLERS[regime](rows, ["seed", label], block, row, max(g["budget"] for g in mine) // 2, F.col("seed"))
        parts.append(drawn.select(F.lit(regime).alias("regime"), "seed", "rank", row))
    if not parts:
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("place", "int"), (label, dict(pool.dtypes)[label]), (x, dict(pool.dtypes)[x]))]
        return settings.select("run", "seed", "trees", "with_base", *empty)
    from terraloom.operators.contracts import union_all

    wanted = settings.join(materialize(union_all(parts)), ["regime", "seed"]).where(F.col("rank") <= F.floor(F.col("budget") / 2))
    drawn = wanted.join(pool.select(row, label, x), row).select("run", (2 * F.col("rank") + F.col(label)).alias("place"), label, x)  # ranks are by class
    return settings.select("run", "seed", "trees", "with_base").join(drawn, "run", "left")


def few_shot_grid(spark, folder: str, pool: DataFrame, evaluation: DataFrame, source: DataFrame, row: str, label: str, block: str, x: str,
                  grid: list[dict], trees: int) -> DataFrame:
    """One fit per (regime, seed, budget, method); the runs of a (regime, method) are one job, whose predictions are stored, so an interrupted study resumes.

    The method is target_only, joint (source rows beside the drawn ones) or source_only (budget 0); a setting may name its `trees`.
    The key covers the settings, the digests of the pool, the source and the evaluation rows, and those of the code of
    this module and of `forests`, so changed data or code is never answered from an old result. Stored rows are counted and digested again on
    reading; a table that does not match its record is built anew, and only missing keys are fitted.

    Each forest is grown by one task, which also holds the source and the evaluation rows; where those are too large for that,
    the forests of the grid are fitted one after the other by all tasks.
    """
    from terraloom.operators.contracts import union_all

    digest = lambda df, *names: table_digest(df.select(*names, x), [], row_digest(*names, F.to_json(x))).first().digest
    content = [digest(pool, row, label, block), digest(source, label), digest(evaluation, row, label, block), *[sha256(Path(f).read_bytes()).hexdigest() for f in (__file__, forests.__file__)]]
    names = ["regime", "seed", "budget", "method"]
    together = forests.fits_runs(source, evaluation, x=x)

    def alone(setting: dict, runs: DataFrame) -> DataFrame:
        draw = runs.where(F.col("place").isNotNull()).select(x, label)
        base = source.select(x, label)
        train = {"target_only": draw, "source_only": base}.get(setting["method"])
        model = fit_forest(materialize(joint_weights(base, draw) if train is None else train), label, x, setting.get("trees", trees), setting["seed"])
        return _positive(model, evaluation, x, "p").select(F.col(row), F.col(label).alias("y"), block, "p", *[F.lit(setting[k]).alias(k) for k in names])

    def build(part: list[dict]) -> DataFrame:
        runs = materialize(drawn_runs(spark, pool, row, label, block, x, part, trees))
        if not together:
            return union_all([materialize(alone(s, runs.where(F.col("run") == i))) for i, s in enumerate(part)])
        scored = forests.fit_runs(runs, source, evaluation, row, label, x)
        tags = spark.createDataFrame([(i, *[s[k] for k in names]) for i, s in enumerate(part)], "run int, regime string, seed int, budget int, method string")
        keyed = evaluation.select(row, F.col(label).alias("y"), block)
        return materialize(scored).join(F.broadcast(tags), "run").join(keyed, row).select(row, "y", block, "p", *names)

    parts: dict[tuple, list[dict]] = {}
    for setting in grid:
        parts.setdefault((setting["regime"], setting["method"]), []).append(setting)
    return union_all([cached_table(spark, folder, {"runs": part, "trees": trees, "content": content}, lambda part=part: build(part)) for part in parts.values()])

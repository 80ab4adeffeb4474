"""Neighbour scores, covariance, model fits, adaptation and reliability studies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from terraloom.functions import scalars as X
from terraloom.functions.hashing import md5_int
from terraloom.operators import covariance as V
from terraloom.operators import metrics as M
from terraloom.operators import models as L
from terraloom.operators import neighbors as N
from terraloom.operators import temporal as T
from terraloom.operators.attach import attach
from terraloom.operators.contracts import union_all
from terraloom.operators.ordering import top_rows
from terraloom.plans.metrics import CURVE_COLS, COVER_SQL, counts_sql
from terraloom.plans.registry import R, query, r, with_ctes
from terraloom.session import materialize, shared_folder
from terraloom.sources.tables import GRID20, SAMPLES, grid20, samples

DIM = 64


@dataclass(frozen=True)
class Study:
    """Sizes of the model studies; the defaults are the published ones (2,400 few-shot fits for each representation pair)."""

    source_trees: int = 500
    adaptation_trees: int = 300
    seeds: tuple[int, ...] = tuple(range(42, 72))
    budgets: tuple[int, ...] = (20, 50, 100, 200, 500)
    regimes: tuple[str, ...] = ("distributed", "clustered")
    methods: tuple[str, ...] = ("target_only", "joint")
    map_rows: int = 20_000  # rows that a map model is fitted on at most, the first by hash

    @classmethod
    def of(cls, spark) -> Study:
        """What the registered queries run: the session's `terraloom.study.*` settings, `published` or else SHORT."""
        return cls() if spark.conf.get("terraloom.study", "short") == "published" else SHORT


#: What the registered queries of single fits run unless the session sets terraloom.study to "published"; README has the measured
#: reason. The few-shot studies have the published grid in any case.
SHORT = Study(source_trees=12)


def part(spark, d, split):
    return samples(spark, d).where(F.col("split") == split)


KNN = """nb AS (SELECT q.sample_id, q.class_id, q.block, s.class_id AS label, list_cosine_distance(q.x, s.x) AS dist,
  row_number() OVER (PARTITION BY q.sample_id ORDER BY round(list_cosine_distance(q.x, s.x), 12), s.sample_id) AS k FROM samples q, samples s WHERE q.region = 'target' AND s.split = 'source_train'),
kn AS (SELECT sample_id, class_id AS y, block, round(avg(dist) FILTER (k <= 10), 9) AS risk, max(label) FILTER (k = 1)::DOUBLE AS p FROM nb GROUP BY ALL)"""


def knn_scored(spark, d):
    """Target rows with the nearest source label as prediction and the mean 10-NN cosine distance as risk."""
    rows = samples(spark, d)
    near = N.knn(rows.where("region = 'target'"), rows.where("split = 'source_train'"), "sample_id", "x", 10, "cosine")
    labels = rows.select(F.col("sample_id").alias("neighbor_id"), F.col("class_id").alias("label"))
    summary = near.join(labels, "neighbor_id").groupBy("query_id").agg(
        F.round(F.avg("distance"), 9).alias("risk"), F.max(F.when(F.col("rank") == 1, F.col("label"))).cast("double").alias("p"))
    keyed = rows.select(F.col("sample_id").alias("query_id"), F.col("class_id").alias("y"), "block")
    return materialize(summary.join(keyed, "query_id").withColumnRenamed("query_id", "sample_id"))


ENTRY_TIES = f"""g AS (SELECT risk, count(*) AS n, {counts_sql()} FROM kn GROUP BY risk),
c AS (SELECT *, sum(n) OVER w - n AS bn, sum(tp) OVER w - tp AS btp, sum(fp) OVER w - fp AS bfp, sum(fn) OVER w - fn AS bfn, sum(n) OVER () AS tot FROM g WINDOW w AS (ORDER BY risk)),
pts AS (SELECT CAST(bn + i AS BIGINT) AS k, tot, btp + tp * CAST(i AS DOUBLE) / n AS etp, bfp + fp * CAST(i AS DOUBLE) / n AS efp, bfn + fn * CAST(i AS DOUBLE) / n AS efn FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c)),
cov AS (SELECT * FROM (VALUES {COVER_SQL}) AS v(requested))"""


@query("entry_knn_selective_risk", with_ctes(SAMPLES, KNN, ENTRY_TIES) + f"SELECT requested, k, {CURVE_COLS} FROM pts, cov WHERE k = greatest(1, CAST(ceil(requested * tot) AS BIGINT))")
def _(spark, d):
    from terraloom.plans.metrics import COVERAGES
    out = M.operating_points(knn_scored(spark, d), [], "y", "p", "risk", COVERAGES)
    return out.select("requested", "k", *[r(c).alias(c) for c in ("coverage", "risk", "f1")])


@query("knn_risk_coverage_curve", with_ctes(SAMPLES, KNN, ENTRY_TIES) + f"SELECT k, {CURVE_COLS} FROM pts")
def _(spark, d):
    return M.selective_curve(knn_scored(spark, d), [], "y", "p", "risk").select("k", *[r(c).alias(c) for c in ("coverage", "risk", "f1")])


@query("c12_knn_cosine", with_ctes(SAMPLES, KNN) + f"SELECT sample_id, {R('min(dist)')} AS nn_distance, {R('avg(dist)')} AS mean_distance FROM nb WHERE k <= 10 GROUP BY sample_id")
def _(spark, d):
    rows = samples(spark, d)
    near = N.knn(rows.where("region = 'target'"), rows.where("split = 'source_train'"), "sample_id", "x", 10, "cosine")
    return near.groupBy(F.col("query_id").alias("sample_id")).agg(r(F.min("distance")).alias("nn_distance"), r(F.avg("distance")).alias("mean_distance"))


ZS = """lz AS (SELECT sample_id, unnest(range(0, len(x))) AS pos, unnest(x) AS v, split FROM samples),
st AS (SELECT pos, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1e0 ELSE stddev_pop(v) END AS s FROM lz WHERE split = 'source_train' GROUP BY pos),
z AS (SELECT sample_id, list((v - m) / s ORDER BY pos) AS z FROM lz JOIN st USING (pos) GROUP BY sample_id),
zs AS (SELECT samples.* EXCLUDE (x), z AS x FROM samples JOIN z USING (sample_id))"""


def standardized(spark, d):
    rows = samples(spark, d)
    return materialize(T.standardize(rows, T.train_scaling(rows, F.col("split") == "source_train", "x"), "x"))


@query("c12_knn_euclidean_standardized", with_ctes(SAMPLES, ZS) + f"SELECT q.sample_id, {R('min(list_distance(q.x, s.x))')} AS nn_distance FROM zs q, zs s WHERE q.region = 'target' AND s.split = 'source_train' GROUP BY q.sample_id")
def _(spark, d):
    z = standardized(spark, d)
    near = N.knn(z.where("region = 'target'"), z.where("split = 'source_train'"), "sample_id", "x", 1, "euclidean")
    return near.select(F.col("query_id").alias("sample_id"), r("distance").alias("nn_distance"))


@query("c13_centroid_distance", with_ctes(SAMPLES, ZS, "ce AS (SELECT class_id, list(m ORDER BY pos) AS c FROM (SELECT class_id, pos, avg(v) AS m FROM (SELECT class_id, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM zs WHERE split = 'source_train') GROUP BY ALL) GROUP BY class_id)") + f"SELECT sample_id, {R('min(list_distance(x, c))')} AS distance FROM zs, ce WHERE region = 'target' GROUP BY sample_id")
def _(spark, d):
    z = standardized(spark, d)
    return N.centroid_distance(z.where("region = 'target'"), z.where("split = 'source_train'"), "class_id", "x").select("sample_id", r("distance").alias("distance"))


LW = """lt AS (SELECT sample_id, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM zs WHERE split = 'source_train'),
mu AS (SELECT pos, avg(v) AS m FROM lt GROUP BY pos), ct AS (SELECT sample_id, pos, v - m AS v FROM lt JOIN mu USING (pos)),
nn AS (SELECT count(DISTINCT sample_id)::DOUBLE AS n, count(DISTINCT pos)::DOUBLE AS p FROM ct),
s AS (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) / (SELECT n FROM nn) AS s FROM ct a JOIN ct b USING (sample_id) GROUP BY ALL),
k AS (SELECT n, p, (SELECT sum(s) FROM s WHERE i = j) / p AS m, (SELECT sum(s * s) FROM s) AS fr, (SELECT sum(q * q) FROM (SELECT sum(v * v) AS q FROM ct GROUP BY sample_id)) / n AS f4 FROM nn),
sh AS (SELECT m, least((fr - p * m * m) / p, (f4 - fr) / (n * p)) / ((fr - p * m * m) / p) AS w FROM k)"""


@query("d34_shrunk_covariance", with_ctes(SAMPLES, ZS, LW) + f"SELECT i, j, {R('(1 - w) * s + CASE WHEN i = j THEN w * m ELSE 0 END')} AS cov FROM s, sh")
def _(spark, d):
    z = standardized(spark, d).where("split = 'source_train'")
    return V.covariance_table(z, "x").select("i", "j", r("cov").alias("cov"))


@query("i08_mahalanobis_distance")
def _(spark, d):
    z = standardized(spark, d)
    return V.mahalanobis(z.where("region = 'target'"), z.where("split = 'source_train'"), "x").select("sample_id", r("mahalanobis").alias("mahalanobis"))


@query("i06_coral_alignment")
def _(spark, d):
    z = standardized(spark, d)
    out = V.coral(z.where("split = 'source_train'"), z.where("split = 'target_pool'"), "x")
    return out.select("sample_id", F.posexplode("x").alias("pos", "v")).select("sample_id", "pos", r("v").alias("value"))


@query("i02_joint_training_weights", with_ctes(SAMPLES) + f"""SELECT sample_id, {R("CASE WHEN split = 'source_train' THEN 1e0 ELSE (SELECT count(*)::DOUBLE FROM samples WHERE split = 'source_train') / (SELECT count(*) FROM samples WHERE split = 'target_pool') END")} AS w FROM samples WHERE split IN ('source_train', 'target_pool')""")
def _(spark, d):
    return L.joint_weights(part(spark, d, "source_train"), part(spark, d, "target_pool")).select("sample_id", r("w").alias("w"))


@query("i01_balanced_class_weights", with_ctes(SAMPLES) + f"SELECT sample_id, {R('count(*) OVER () / (2e0 * count(*) OVER (PARTITION BY class_id))')} AS w FROM samples WHERE split = 'source_train'")
def _(spark, d):
    return L.balanced(part(spark, d, "source_train"), "class_id").select("sample_id", r("w").alias("w"))


def evaluations(scored, **tags):
    return L.evaluation_row(materialize(scored), "class_id", "p", **tags)


@query("i01_forest_source_fit")
def _(spark, d):
    train = materialize(part(spark, d, "source_train"))
    model = L.fit_forest(train, "class_id", "x", Study.of(spark).source_trees, 42)
    return union_all([evaluations(L.score(model, part(spark, d, s), "x"), split=s) for s in ("source_test", "target_val")])


@query("i03_map_scoring")
def _(spark, d):
    g = grid20(spark, d)
    features = F.array("p", F.col("lcw").cast("double"), (F.col("lc") / 9.0), F.when(F.col("row") % 5 != 0, F.col("col") / 150.0))
    rows = g.select("row", "col", "ref", features.alias("x"))
    drawn = materialize(top_rows(rows, [], md5_int(42, F.col("row"), F.col("col")), F.col("row") * 150 + F.col("col"), Study.of(spark).map_rows).drop("rank"))
    medians = materialize(T.train_medians(drawn, F.lit(True), "x", 4))
    train = materialize(T.impute(drawn, medians, "x"))
    model = L.fit_forest(train, "ref", "x", Study.of(spark).source_trees, 42)
    return L.score_map(model, attach(rows, medians, []), "x", F.col("medians"), 3)


@query("i04_tree_vote_uncertainty")
def _(spark, d):
    train = materialize(part(spark, d, "source_train"))
    model = L.fit_forest(train, "class_id", "x", Study.of(spark).source_trees, 42)
    out = L.tree_uncertainty(model, part(spark, d, "target_val").select("sample_id", "x"), "x")
    return out.select("sample_id", "p", "tree_mean", "vote_uncertainty", "tree_variance")


@query("i05_importance_weights")
def _(spark, d):
    return L.importance_weights(part(spark, d, "source_train"), part(spark, d, "target_pool"), "sample_id", "block", "x")


@query("i07_pseudo_label_refit")
def _(spark, d):
    source, pool, val = materialize(part(spark, d, "source_train")), materialize(part(spark, d, "target_pool")), part(spark, d, "target_val")
    model, n = L.pseudo_label_refit(source, pool, "sample_id", "class_id", "x", Study.of(spark).source_trees, 42, threshold=0.7)
    return evaluations(L.score(model, val, "x"), method="pseudo_label", pseudo_rows=n)


@query("i07_pseudo_label_rounds")
def _(spark, d):
    source, pool, val = materialize(part(spark, d, "source_train")), materialize(part(spark, d, "target_pool")), part(spark, d, "target_val")
    rounds = L.pseudo_label_rounds(source, pool, "sample_id", "class_id", "x", Study.of(spark).source_trees, 42, rounds=3, threshold=0.6)
    return union_all([evaluations(L.score(m, val, "x"), round_id=i, pseudo_rows=n) for i, m, n in rounds])


@query("i09_domain_audit")
def _(spark, d):
    sizes = lambda s: {row.class_id: row["count"] for row in part(spark, d, s).groupBy("class_id").count().collect()}
    return L.domain_audit(part(spark, d, "source_train"), part(spark, d, "target_pool"), part(spark, d, "source_test"), part(spark, d, "target_val"),
                          "sample_id", "class_id", "x", (sizes("source_train"), sizes("source_test")), Study.of(spark).source_trees, 42)


@query("i10_platt_calibration")
def _(spark, d):
    model = L.fit_forest(materialize(part(spark, d, "source_train")), "class_id", "x", Study.of(spark).source_trees, 42)
    scored = materialize(L.score(model, part(spark, d, "target_val"), "x"))
    halves = M.block_halves(scored, "block", [42])
    rows = materialize(scored.join(halves, "block"))
    out = L.platt(rows.where("role = 'tune'"), rows.where("role = 'held'"), "class_id", "p")
    bundle = lambda p, name: M.probability_metrics(out, [], "class_id", p).withColumn("variant", F.lit(name))
    return bundle("p", "uncalibrated").unionByName(bundle("p_calibrated", "platt"))


def views(rows):
    """Two representations of the same rows: the first and the last half of the vector."""
    return rows.select("sample_id", "class_id", "block", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"), "x")


@query("i11_feature_fusion")
def _(spark, d):
    train, val = materialize(views(part(spark, d, "target_pool"))), materialize(views(part(spark, d, "target_val")))
    out = []
    for name, column in (("first", "a"), ("second", "b"), ("concat", "x")):
        model = L.fit_forest(train, "class_id", column, Study.of(spark).source_trees, 42)
        out.append(evaluations(L.score(model, val, column), representation=name))
    scaling = materialize(T.train_scaling(train, F.lit(True), "x"))
    logistic = L.fit_logistic(L.balanced(T.standardize(train, scaling, "x"), "class_id"), "class_id", "x", 1.0 / train.count(), "w")
    out.append(evaluations(L.score(logistic, T.standardize(val, scaling, "x"), "x"), representation="standardized_concat_logistic"))
    both = lambda rows: L.principal_components(train, rows, "a", 16).withColumn("x", F.concat("a", "b"))
    model = L.fit_forest(materialize(both(train)), "class_id", "x", Study.of(spark).source_trees, 42)
    out.append(evaluations(L.score(model, both(val), "x"), representation="components_plus_second"))
    return union_all(out)


def few_shot(spark, d, grid, evaluation="target_val"):
    pool, source, rows = (materialize(part(spark, d, s)) for s in ("target_pool", "source_train", evaluation))
    folder = f"{shared_folder(spark)}/few-shot"
    return L.few_shot_grid(spark, folder, pool, rows, source, "sample_id", "class_id", "block", "x", grid, Study().adaptation_trees)


def settings(regimes, seeds, budgets, methods):
    return [dict(regime=g, seed=s, budget=b, method=m) for g in regimes for s in seeds for b in budgets for m in methods]


@query("i12_few_shot_grid")
def _(spark, d):
    study = Study.of(spark)
    runs = few_shot(spark, d, settings(study.regimes, study.seeds, study.budgets, study.methods))
    keys = ["regime", "budget", "method", "seed"]
    f1 = M.confusion_counts(runs, keys, F.col("p") >= 0.5, F.col("y") == 1).select(*keys, M.count_metrics("zero")["f1"].alias("f1"))
    return M.seed_summary(f1, ["regime", "budget", "method"], "f1")


@query("i13_feature_group_ablation")
def _(spark, d):
    train, test = materialize(views(part(spark, d, "source_train"))), materialize(views(part(spark, d, "source_test")))
    out = []
    for name, column in (("first_only", "a"), ("second_only", "b"), ("fusion", "x")):
        scored = materialize(L.score(L.fit_forest(train, "class_id", column, Study.of(spark).source_trees, 42), test, column))
        blocks = scored.groupBy("block").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"), *M.confusion_columns(F.col("p") >= 0.5, F.col("class_id") == 1))
        out.append(blocks.where("lo < hi").select(F.lit(name).alias("features"), "block", M.count_metrics("zero")["f1"].alias("f1")))
    return union_all(out)


@query("i14_label_budget_study")
def _(spark, d):
    study = Study.of(spark)
    base = [dict(s, trees=Study().source_trees) for s in settings(["none"], study.seeds, [0], ["source_only"])]
    runs = few_shot(spark, d, settings(["distributed"], study.seeds, study.budgets, study.methods) + base)
    f1 = M.confusion_counts(runs, ["method", "budget", "seed"], F.col("p") >= 0.5, F.col("y") == 1).select("method", "budget", "seed", M.count_metrics("zero")["f1"].alias("f1"))
    return M.seed_summary(f1, ["method", "budget"], "f1")


@query("i15_generalization_gap")
def _(spark, d):
    train, val = materialize(part(spark, d, "source_train")), part(spark, d, "source_val")
    model = L.fit_forest(train, "class_id", "x", Study.of(spark).source_trees, 42)
    a, b = evaluations(L.score(model, train, "x"), part="train"), evaluations(L.score(model, val, "x"), part="val")
    return attach(a.select(F.col("f1").alias("train_f1")), b.select(F.col("f1").alias("val_f1")), []).withColumn("gap", F.col("train_f1") - F.col("val_f1"))


@query("i16_risk_score_table")
def _(spark, d):
    z = standardized(spark, d)
    raw = samples(spark, d)
    train, target = materialize(part(spark, d, "source_train")), materialize(part(spark, d, "target_val"))
    model = L.fit_forest(train, "class_id", "x", Study.of(spark).source_trees, 42)
    trees = materialize(L.tree_uncertainty(model, target.select("sample_id", "class_id", "block", "x"), "x"))
    zt, zs = z.where("split = 'target_val'"), z.where("split = 'source_train'")
    cosine = N.knn(raw.where("split = 'target_val'"), train, "sample_id", "x", 10, "cosine").groupBy(F.col("query_id").alias("sample_id")).agg(F.min("distance").alias("cosine_nn"), F.avg("distance").alias("cosine_knn"))
    euclid = N.knn(zt, zs, "sample_id", "x", 1, "euclidean").select(F.col("query_id").alias("sample_id"), F.col("distance").alias("euclidean_nn"))
    maha = V.mahalanobis(zt, zs, "x").select("sample_id", "mahalanobis")
    center = N.centroid_distance(zt, zs, "class_id", "x").select("sample_id", F.col("distance").alias("centroid"))
    pool = materialize(part(spark, d, "target_pool"))
    domain = L.fit_forest(train.select("x", F.lit(0).alias("d")).unionByName(pool.select("x", F.lit(1).alias("d"))), "d", "x", Study.of(spark).source_trees, 42)
    domain = L.score(domain, target, "x", "domain_probability").select("sample_id", "domain_probability")
    rows = trees.drop("x", "tree_mean").withColumn("entropy", X.entropy(F.col("p"))).withColumn("confidence", X.least_confidence(F.col("p"))).withColumn("margin", X.margin_distrust(F.col("p")))
    for table in (cosine, euclid, maha, center, domain):
        rows = rows.join(table, "sample_id")
    names = ["euclidean_nn", "cosine_nn", "cosine_knn", "mahalanobis", "centroid", "entropy", "confidence", "margin", "vote_uncertainty", "tree_variance", "domain_probability"]
    long = rows.select("sample_id", "block", F.col("class_id").alias("y"), "p", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.round(n, 9).alias("value")) for n in names])).alias("s")).select("sample_id", "block", "y", "p", "s.*")
    long = materialize(long.withColumn("error", ((F.col("p") >= 0.5) != (F.col("y") == 1)).cast("int")))
    ranks = M.rank_metrics(long, ["score"], "error", "value")
    rho = M.spearman(long, ["score"], "value", "error", "spearman")
    aurc = M.selective_curve(long, ["score"], "y", "p", "value").groupBy("score").agg(F.avg("risk").alias("aurc"))
    return ranks.join(rho, "score").join(aurc, "score")


@query("i17_adaptation_methods")
def _(spark, d):
    source, pool, val = materialize(part(spark, d, "source_train")), materialize(part(spark, d, "target_pool")), materialize(part(spark, d, "target_val"))
    z = standardized(spark, d)
    out = [evaluations(L.score(L.fit_forest(source, "class_id", "x", Study.of(spark).source_trees, 42), val, "x"), method="source_only"),
           evaluations(L.score(L.fit_forest(pool, "class_id", "x", Study.of(spark).source_trees, 42), val, "x"), method="target_full")]
    aligned = materialize(V.coral(z.where("split = 'source_train'"), z.where("split = 'target_pool'"), "x"))
    out.append(evaluations(L.score(L.fit_forest(aligned, "class_id", "x", Study.of(spark).source_trees, 42), z.where("split = 'target_val'"), "x"), method="coral"))
    weights = L.importance_weights(source, pool, "sample_id", "block", "x").select("sample_id", "w")
    out.append(evaluations(L.score(L.fit_forest(source.join(weights, "sample_id"), "class_id", "x", Study.of(spark).source_trees, 42), val, "x"), method="importance"))
    model, _ = L.pseudo_label_refit(source, pool, "sample_id", "class_id", "x", Study.of(spark).source_trees, 42, threshold=0.7)
    out.append(evaluations(L.score(model, val, "x"), method="pseudo_label"))
    return union_all(out)


@query("i18_weight_degeneracy")
def _(spark, d):
    train, val = materialize(part(spark, d, "source_train")), part(spark, d, "target_val")
    plain = L.score(L.fit_forest(train, "class_id", "x", Study.of(spark).source_trees, 42), val, "x", "p1").select("sample_id", "p1")
    unit = L.score(L.fit_forest(train.withColumn("w", F.lit(1.0)), "class_id", "x", Study.of(spark).source_trees, 42), val, "x", "p2").select("sample_id", "p2")
    return plain.join(unit, "sample_id").agg(F.max(F.abs(F.col("p1") - F.col("p2"))).alias("max_delta"), F.count(F.lit(1)).alias("n"))


@query("i19_network_baseline")
def _(spark, d):
    z = standardized(spark, d)
    model = L.fit_network(z.where("split = 'source_train'"), "class_id", "x", DIM, 42)
    return union_all([evaluations(L.score(model, z.where(F.col("split") == s), "x"), split=s) for s in ("source_test", "target_val")])


@query("i20_repeated_adaptation_study")
def _(spark, d):
    study = Study.of(spark)
    runs = few_shot(spark, d, settings(study.regimes, study.seeds, study.budgets, ["target_only"]))
    risk = knn_scored(spark, d).select("sample_id", "risk")
    banded = M.distance_bands(runs.join(risk, "sample_id"), ["regime", "seed", "budget"], "risk")
    keys = ["regime", "budget", "seed", "band"]
    f1 = M.confusion_counts(banded, keys, F.col("p") >= 0.5, F.col("y") == 1).select(*keys, M.count_metrics("zero")["f1"].alias("f1"))
    return M.seed_summary(f1, ["regime", "budget", "band"], "f1")

"""Observation windows, composites, imputation, scaling and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions import geo, scalars as X
from terraloom.functions.hashing import md5_int, row_digest, table_digest
from terraloom.operators import temporal as T
from terraloom.operators.attach import attach
from terraloom.operators.ordering import exact_quantiles
from terraloom.plans.registry import R, query, r, with_ctes, row_text
from terraloom.sources.tables import (
    GRID20, MANIFEST, OBSERVATIONS, POOL, SAMPLES, WINDOWS, grid20, manifest, observations, pool, samples, sql_md5, table, windows)

OBS = with_ctes(OBSERVATIONS)
CLEAR = "clear AS (SELECT * FROM observations WHERE scl NOT IN (3, 8, 9, 10, 11))"
HITS = "hits AS (SELECT c.*, w.tag FROM clear c JOIN windows w ON c.ts >= w.start_ts AND c.ts < w.end_ts)"


def hits(spark, d):
    return T.interval_join(T.clear_pixels(observations(spark, d), "scl"), "ts", windows(spark)).drop("start", "end")


@query("b01_sentinel_to_null", OBS + f"""SELECT event_id, {R('CASE WHEN cloud >= 90 OR cloud BETWEEN 80 AND 84 OR cloud BETWEEN 70 AND 74 THEN NULL ELSE red END')} AS above,
  {R('CASE WHEN cloud >= 90 OR cloud BETWEEN 80 AND 84 THEN NULL WHEN cloud BETWEEN 70 AND 74 THEN -9995e0 ELSE red END')} AS equal FROM observations""")
def _(spark, d):
    k = F.col("cloud")
    raw = F.when(k >= 90, -9999.0).when(k.between(80, 84), float("nan")).when(k.between(70, 74), -9995.0).otherwise(F.col("red"))
    rows = observations(spark, d).withColumn("raw", raw)
    return rows.select("event_id", r(X.missing_to_null(F.col("raw"))).alias("above"), r(X.missing_to_null(F.col("raw"), "equal")).alias("equal"))


@query("b02_minimum_observations", with_ctes(OBSERVATIONS, "dy AS (SELECT DISTINCT location, ts::DATE AS day FROM observations WHERE cloud <= 15)") + "SELECT location, count(*) AS n_observed FROM dy GROUP BY location HAVING count(*) >= 7")
def _(spark, d):
    days = observations(spark, d).withColumn("day", F.to_date("ts"))
    daily = days.groupBy("location", "day").agg(F.avg(F.when(F.col("cloud") <= 15, F.col("red"))).alias("v"))
    packed = daily.groupBy("location").agg(F.map_from_entries(F.collect_list(F.struct("day", "v"))).alias("m"))
    grid = F.sequence(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30")))
    series = packed.withColumn("series", F.transform(grid, lambda day: F.try_element_at("m", day)))
    return series.where(X.enough_observed(F.col("series"))).select("location", X.observed_count(F.col("series")).cast("bigint").alias("n_observed"))


@query("b04_complete_vectors", with_ctes(SAMPLES) + "SELECT sample_id FROM samples WHERE len(list_filter(x, lambda v: v > 0.3e0)) = 0")
def _(spark, d):
    rows = samples(spark, d).withColumn("x", F.transform("x", lambda v: F.when(v > 0.3, F.lit(None)).otherwise(v)))
    return rows.where(X.complete(F.col("x"))).select("sample_id")


@query("b05_quality_mask", OBS + "SELECT event_id, scl, scl NOT IN (0, 1, 3, 7, 8, 9, 10, 11) AS tile_clear FROM observations WHERE scl NOT IN (3, 8, 9, 10, 11)")
def _(spark, d):
    return T.clear_pixels(observations(spark, d), "scl").select("event_id", "scl", (~F.col("scl").isin(*T.TILE_MASK)).alias("tile_clear"))


@query("b06_scene_filter", OBS + "SELECT event_id, mode FROM observations WHERE cloud <= 60 AND mode IN ('click', 'view', 'purchase') AND event_id % 3 = 0")
def _(spark, d):
    pols = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("VV"), F.lit("VH"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("VV"))).otherwise(F.array(F.lit("HH"), F.lit("VH")))
    rows = observations(spark, d).withColumn("pols", pols)
    return T.usable_scenes(rows, "cloud", 60, ["click", "view", "purchase"], "mode", "pols").select("event_id", "mode")


@query("c04_interval_join", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, HITS) + "SELECT event_id, tag FROM hits")
def _(spark, d):
    return hits(spark, d).select("event_id", "tag")


@query("c05_calendar_months", with_ctes(OBSERVATIONS) + "SELECT date_trunc('month', ts)::TIMESTAMP AS month_start, (date_trunc('month', ts) + INTERVAL 1 MONTH)::TIMESTAMP AS month_end, location, count(*) AS n FROM observations GROUP BY ALL")
def _(spark, d):
    return T.with_month(observations(spark, d), "ts").groupBy("month_start", "month_end", "location").agg(F.count(F.lit(1)).alias("n"))


@query("d04_median_composite", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, HITS, "long AS (SELECT location, tag, unnest(['red', 'nir', 'vv', 'vh']) AS band, unnest([red, nir, vv, vh]) AS v FROM hits)") + f"SELECT location, tag, band, {R('quantile_cont(v, 0.5)')} AS value FROM long GROUP BY ALL")
def _(spark, d):
    out = T.median_composite(hits(spark, d), ["location", "tag"], {b: F.col(b) for b in ("red", "nir", "vv", "vh")})
    return out.select("location", "tag", "band", r("value").alias("value"))


@query("d05_window_counts", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, "few AS (SELECT * FROM clear WHERE cloud < 12)", HITS.replace("clear", "few")) + """
  SELECT location, tag, count(event_id) AS n_obs, CAST(count(event_id) > 0 AS BIGINT) AS valid FROM (SELECT DISTINCT location FROM observations), (SELECT tag FROM windows) LEFT JOIN hits USING (location, tag) GROUP BY ALL""".replace(
      "FROM (SELECT DISTINCT location FROM observations), (SELECT tag FROM windows) LEFT JOIN", "FROM (SELECT location, tag FROM (SELECT DISTINCT location FROM observations), (SELECT tag FROM windows)) LEFT JOIN"))
def _(spark, d):
    matched = hits(spark, d).where("cloud < 12")
    return T.window_counts(observations(spark, d), "location", windows(spark), "event_id", matched)


@query("d06_temporal_mode", OBS + "SELECT location, scl, n FROM (SELECT location, scl, count(*) AS n, row_number() OVER (PARTITION BY location ORDER BY count(*) DESC, scl) AS k FROM observations GROUP BY location, scl) WHERE k = 1")
def _(spark, d):
    return T.temporal_mode(observations(spark, d), ["location"], "scl")


@query("h01_ndvi_median", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, HITS) + f"SELECT location, tag, {R('quantile_cont((nir - red) / nullif(nir + red, 0), 0.5)')} AS ndvi FROM hits GROUP BY ALL HAVING count(nullif(nir + red, 0)) > 0")
def _(spark, d):
    ndvi = X.normalized_difference(F.col("nir").cast("double"), F.col("red").cast("double"))
    out = exact_quantiles(hits(spark, d).withColumn("v", ndvi), ["location", "tag"], "v", {"ndvi": 0.5})
    return out.select("location", "tag", r("ndvi").alias("ndvi"))


@query("h02_radar_index", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, HITS, "m AS (SELECT location, tag, pow(10e0, quantile_cont(vv, 0.5) / 10) AS a, pow(10e0, quantile_cont(vh, 0.5) / 10) AS b FROM hits GROUP BY ALL)") + f"SELECT location, tag, {R('4 * b / (a + b)')} AS rvi FROM m")
def _(spark, d):
    medians = T.pivot_bands(T.median_composite(hits(spark, d), ["location", "tag"], {"vv": F.col("vv"), "vh": F.col("vh")}), ["location", "tag"], ["vv", "vh"])
    return medians.select("location", "tag", r(X.radar_vegetation_index(F.col("vv"), F.col("vh"))).alias("rvi"))


@query("h11_series_arrays", with_ctes(OBSERVATIONS, WINDOWS, CLEAR, HITS, "m AS (SELECT location, tag, quantile_cont(red, 0.5) AS v FROM hits GROUP BY ALL)") + f"SELECT location, row_number() OVER (PARTITION BY location ORDER BY tag) - 1 AS pos, {R('v')} AS value FROM m")
def _(spark, d):
    medians = T.median_composite(hits(spark, d), ["location", "tag"], {"red": F.col("red")})
    series = T.series_array(medians, ["location"], "tag", "value")
    return series.select("location", F.posexplode("series").alias("pos", "v")).select("location", F.col("pos").cast("bigint").alias("pos"), r("v").alias("value"))


HOLES = "holes AS (SELECT sample_id, split, block, class_id, list_transform(x, lambda v: CASE WHEN v > 0.15e0 THEN NULL ELSE v END) AS x FROM samples)"
LONG = "long AS (SELECT sample_id, split, unnest(range(0, len(x))) AS pos, unnest(x) AS v FROM {src})"


def holes(spark, d):
    return samples(spark, d).withColumn("x", F.transform("x", lambda v: F.when(v > 0.15, F.lit(None)).otherwise(v)))


@query("d07_train_median_imputation", with_ctes(SAMPLES, HOLES, LONG.format(src="holes"), "m AS (SELECT pos, quantile_cont(v, 0.5) AS m FROM long WHERE split = 'source_train' GROUP BY pos)") + f"SELECT sample_id, CAST(pos AS BIGINT) AS pos, {R('coalesce(v, m, 0)')} AS value FROM long LEFT JOIN m USING (pos)")
def _(spark, d):
    rows = holes(spark, d)
    filled = T.impute(rows, T.train_medians(rows, F.col("split") == "source_train", "x", 64), "x")
    return filled.select("sample_id", F.posexplode("x").alias("pos", "v")).select("sample_id", F.col("pos").cast("bigint").alias("pos"), r("v").alias("value"))


@query("d08_train_standardization", with_ctes(SAMPLES, LONG.format(src="samples"), "s AS (SELECT pos, avg(v) AS m, CASE WHEN stddev_pop(v) < 1e-6 THEN 1e0 ELSE stddev_pop(v) END AS s FROM long WHERE split = 'source_train' GROUP BY pos)") + f"SELECT sample_id, CAST(pos AS BIGINT) AS pos, {R('(v - m) / s')} AS value FROM long JOIN s USING (pos)")
def _(spark, d):
    rows = samples(spark, d)
    scaled = T.standardize(rows, T.train_scaling(rows, F.col("split") == "source_train", "x"), "x")
    return scaled.select("sample_id", F.posexplode("x").alias("pos", "v")).select("sample_id", F.col("pos").cast("bigint").alias("pos"), r("v").alias("value"))


@query("d39_vector_norms", with_ctes(SAMPLES, "n AS (SELECT split, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM samples)") + f"SELECT split, {R('min(n)')} AS norm_min, {R('avg(n)')} AS norm_mean, {R('max(n)')} AS norm_max FROM n GROUP BY split")
def _(spark, d):
    n = X.norm(F.col("x"))
    return samples(spark, d).groupBy("split").agg(r(F.min(n)).alias("norm_min"), r(F.avg(n)).alias("norm_mean"), r(F.max(n)).alias("norm_max"))


@query("d40_mask_sentinel_disagreement", OBS + """SELECT location, CAST(sum(CASE WHEN (cloud < 50) <> (red > 5e0) THEN 1 ELSE 0 END) AS BIGINT) AS disagreements, CAST(sum(CASE WHEN cloud < 50 AND red > 5e0 THEN 1 ELSE 0 END) AS BIGINT) AS usable FROM observations GROUP BY location""")
def _(spark, d):
    rows = observations(spark, d)
    signals = T.validity(F.col("cloud") < 50, F.col("red") > 5.0)
    return rows.groupBy("location").agg(F.sum(signals["disagree"]).alias("disagreements"), F.sum(signals["valid"]).alias("usable"))


SQL_P = with_ctes(POOL)
PC = "least(greatest(p, 1e-6), 1 - 1e-6)"


@query("h03_entropy", SQL_P + f"SELECT sample_id, {R('-(p * ln(p)) - CASE WHEN 1 - p > 0 THEN (1 - p) * ln(1 - p) ELSE 0 END')} AS entropy, {R('-(p * log2(greatest(p, 1e-6)) + (1 - p) * log2(greatest(1 - p, 1e-6)))')} AS entropy_bits FROM pool")
def _(spark, d):
    return pool(spark, d).select("sample_id", r(X.entropy(F.col("p"))).alias("entropy"), r(X.entropy(F.col("p"), "2")).alias("entropy_bits"))


@query("h04_confidence_and_margin", SQL_P + f"SELECT sample_id, {R('1 - greatest(p, 1 - p)', 9)} AS least_confidence, {R('1 - abs(2 * p - 1)', 9)} AS margin FROM pool")
def _(spark, d):
    return pool(spark, d).select("sample_id", r(X.least_confidence(F.col("p")), 9).alias("least_confidence"), r(X.margin_distrust(F.col("p")), 9).alias("margin"))


@query("h05_clipped_logit", SQL_P + f"SELECT sample_id, {R(f'ln({PC} / (1 - {PC}))')} AS logit FROM pool")
def _(spark, d):
    return pool(spark, d).select("sample_id", r(X.clipped_logit(F.col("p"))).alias("logit"))


ODDS = f"w AS (SELECT sample_id, block, least(greatest({PC} / (1 - {PC}) * ((SELECT count(*) FROM pool WHERE block < 20)::DOUBLE / (SELECT count(*) FROM pool WHERE block >= 20)), 0.1e0), 10e0) AS w, {PC} / (1 - {PC}) * ((SELECT count(*) FROM pool WHERE block < 20)::DOUBLE / (SELECT count(*) FROM pool WHERE block >= 20)) AS raw FROM pool WHERE block < 20)"


def odds(spark, d):
    rows = pool(spark, d)
    prior = rows.agg((F.count_if(F.col("block") < 20) / F.count_if(F.col("block") >= 20)).alias("prior"))
    raw = attach(rows.where("block < 20"), prior, []).withColumn("raw", X.density_odds(F.col("p"), F.col("prior")))
    return raw.withColumn("w", F.least(F.greatest("raw", F.lit(0.1)), F.lit(10.0)))


@query("h06_density_odds_weights", with_ctes(POOL, ODDS) + f"SELECT sample_id, {R('w / (SELECT avg(w) FROM w)')} AS weight FROM w")
def _(spark, d):
    rows = odds(spark, d)
    return attach(rows, rows.agg(F.avg("w").alias("mean_w")), []).select("sample_id", r(F.col("w") / F.col("mean_w")).alias("weight"))


@query("d35_importance_diagnostics", with_ctes(POOL, ODDS) + f"SELECT {R('min(raw)')} AS raw_min, {R('max(raw)', 3)} AS raw_max, {R('avg(CASE WHEN raw <> w THEN 1e0 ELSE 0e0 END)')} AS clipped_share, {R('sum(w) * sum(w) / sum(w * w)', 4)} AS effective_n FROM w")
def _(spark, d):
    return odds(spark, d).agg(r(F.min("raw")).alias("raw_min"), r(F.max("raw"), 3).alias("raw_max"), r(F.avg((F.col("raw") != F.col("w")).cast("double"))).alias("clipped_share"),
                              r(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 4).alias("effective_n"))


@query("h07_percentile_stretch", with_ctes(GRID20, "q AS (SELECT quantile_cont(p, 0.01) AS lo, quantile_cont(p, 0.99) AS hi FROM grid20)") + "SELECT row, col, CAST(floor(least(greatest((p - lo) / (hi - lo), 0e0), 1e0) * 255e0) AS BIGINT) AS level FROM grid20, q WHERE p IS NOT NULL")
def _(spark, d):
    rows = grid20(spark, d).where("p IS NOT NULL")
    ends = exact_quantiles(rows, [], "p", {"lo": 0.01, "hi": 0.99})
    level = F.least(F.greatest((F.col("p") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)) * 255.0
    return attach(rows, ends, []).select("row", "col", level.cast("bigint").alias("level"))


def utm_sql() -> str:
    a = " + ".join(["eta"] + [f"{c!r}e0 * cos({2 * j} * xi) * sinh({2 * j} * eta)".replace("e-", "E-").replace("e0 *", " *") for j, c in enumerate(geo.ALPHA, 1)])
    b = " + ".join(["xi"] + [f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo.ALPHA, 1)])
    k = f"{geo.SCALE * geo.RADIUS!r}"
    return f"""t AS (SELECT sample_id, radians(longitude - 123) AS lam, sinh(atanh(sin(radians(latitude))) - {geo.ECC!r} * atanh({geo.ECC!r} * sin(radians(latitude)))) AS t FROM manifest),
u AS (SELECT sample_id, atan(t / cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t),
utm AS (SELECT sample_id, 500000 + {k} * ({a}) AS x, {k} * ({b}) AS y FROM u)"""


@query("h08_lonlat_to_utm", with_ctes(MANIFEST, utm_sql()) + f"SELECT sample_id, {R('x', 3)} AS x, {R('y', 3)} AS y FROM utm")
def _(spark, d):
    x, y = geo.to_utm(F.col("longitude"), F.col("latitude"))
    return manifest(spark, d).select("sample_id", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("h08_utm_round_trip", with_ctes(MANIFEST) + f"SELECT sample_id, {R('longitude', 5)} AS longitude, {R('latitude', 5)} AS latitude FROM manifest")
def _(spark, d):
    x, y = geo.to_utm(F.col("longitude"), F.col("latitude"))
    rows = manifest(spark, d).select("sample_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.to_lonlat(F.col("x"), F.col("y"))
    return rows.select("sample_id", r(lon, 5).alias("longitude"), r(lat, 5).alias("latitude"))


@query("h08_pixel_centers", with_ctes(GRID20) + "SELECT row, col, 362320e0 + (col + 0.5e0) * 20 AS x, 3510320e0 - (row + 0.5e0) * 20 AS y FROM grid20")
def _(spark, d):
    x, y = geo.pixel_center(F.col("row"), F.col("col"), 362320.0, 3510320.0, 20.0)
    return grid20(spark, d).select("row", "col", x.alias("x"), y.alias("y"))


@query("c06_point_to_pixel_sample", with_ctes(MANIFEST, GRID20) + f"SELECT sample_id, g.row, g.col, {R('g.p', 9)} AS p FROM manifest m JOIN grid20 g ON g.row = CAST(floor((33e0 - latitude) / 0.06e0) AS BIGINT) AND g.col = CAST(floor((longitude - 115e0) / 0.0533e0) AS BIGINT)")
def _(spark, d):
    row, col = geo.pixel_of(F.col("longitude"), F.col("latitude"), 115.0, 33.0, 0.0533, 0.06)
    points = manifest(spark, d).select("sample_id", row.alias("row"), col.alias("col"))
    return points.join(grid20(spark, d).select("row", "col", "p"), ["row", "col"]).select("sample_id", "row", "col", r("p", 9).alias("p"))


VEC_TEXT = "array_to_string(list_transform(embedding, lambda v: CAST(floor(v::DOUBLE * 1e6) AS BIGINT)), ',')"
VEC = f"vec AS (SELECT vec_id, label, sha256({row_text('vec_id', VEC_TEXT)}) AS h FROM embeddings)"


@query("h09_row_digests", f"WITH {VEC} SELECT vec_id, h AS digest FROM vec")
def _(spark, d):
    return vectors(spark, d).select("vec_id", "digest")


def vectors(spark, d):
    text = F.array_join(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1e6).cast("string")), ",")
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), row_digest("vec_id", text).alias("digest"))


@query("h09_table_digest", f"WITH {VEC} SELECT CAST(label AS BIGINT) AS label, count(*) AS n_rows, sha256(concat_ws(':', count(*), " + ", ".join(f"sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12)) AS UBIGINT)::HUGEINT)" for i in range(5)) + ")) AS digest FROM vec GROUP BY label")
def _(spark, d):
    return table_digest(vectors(spark, d), ["label"], F.col("digest"))


@query("h10_string_predicates", "SELECT p_partkey, CAST(regexp_extract(p_name || '_t' || lpad((p_size % 23)::VARCHAR, 2, '0'), '_t([0-9]+)$', 1) AS BIGINT) AS suffix, starts_with(p_type, 'ECON') AS prefixed, regexp_matches(p_name, 'ring|widget') AS matched FROM part")
def _(spark, d):
    name = F.concat("p_name", F.lit("_t"), F.lpad((F.col("p_size") % 23).cast("string"), 2, "0"))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(name, "_t([0-9]+)$", 1).cast("bigint").alias("suffix"),
                                           F.col("p_type").startswith("ECON").alias("prefixed"), F.col("p_name").rlike("ring|widget").alias("matched"))


PATCH = "patch AS (SELECT sample_id AS center, unnest([0,0,0,1,1,1,2,2,2])::BIGINT AS prow, unnest([0,1,2,0,1,2,0,1,2])::BIGINT AS pcol, sample_id // 150 AS row, sample_id % 150 AS col FROM pool WHERE class_id = 1)"


def patch(spark, d):
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))
    centers = pool(spark, d).where("class_id = 1").select(F.col("sample_id").alias("center"), F.floor(F.col("sample_id") / 150).alias("row"), (F.col("sample_id") % 150).alias("col"))
    return centers.withColumn("prow", F.explode(axis)).withColumn("pcol", F.explode(axis))


@query("h12_patch_expansion", with_ctes(POOL, PATCH) + "SELECT center, prow, pcol, row + prow - 1 AS prow_abs, col + pcol - 1 AS pcol_abs, pcol - 1 AS dx, 1 - prow AS dy FROM patch")
def _(spark, d):
    return patch(spark, d).select("center", "prow", "pcol", (F.col("row") + F.col("prow") - 1).alias("prow_abs"), (F.col("col") + F.col("pcol") - 1).alias("pcol_abs"),
                                  (F.col("pcol") - 1).alias("dx"), (1 - F.col("prow")).alias("dy"))


@query("h13_patch_tensor", with_ctes(POOL, PATCH, GRID20) + f"SELECT center, prow, pcol, {R('p', 9)} AS value, CAST(p IS NOT NULL AS BIGINT) AS valid FROM (SELECT center, prow, pcol, g.p FROM patch LEFT JOIN grid20 g ON g.row = patch.row + prow - 1 AND g.col = patch.col + pcol - 1)")
def _(spark, d):
    cells = patch(spark, d).withColumn("row", F.col("row") + F.col("prow") - 1).withColumn("col", F.col("col") + F.col("pcol") - 1)
    values = cells.join(grid20(spark, d).select("row", "col", "p"), ["row", "col"], "left")
    rows = values.groupBy("center", "prow").agg(F.transform(F.array_sort(F.collect_list(F.struct("pcol", "p"))), lambda s: s["p"]).alias("line"))
    tensor = rows.groupBy("center").agg(F.transform(F.array_sort(F.collect_list(F.struct("prow", "line"))), lambda s: s["line"]).alias("tensor"))
    lines = tensor.select("center", F.posexplode("tensor").alias("prow", "line"))
    return lines.select("center", "prow", F.posexplode("line").alias("pcol", "v")).select(
        "center", F.col("prow").cast("bigint").alias("prow"), F.col("pcol").cast("bigint").alias("pcol"), r("v", 9).alias("value"), F.col("v").isNotNull().cast("bigint").alias("valid"))

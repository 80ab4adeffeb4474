"""Sources, sinks, contracts, set operations and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.functions.hashing import md5_int, row_digest
from terraloom.functions.scalars import complete, norm
from terraloom.operators import contracts as K
from terraloom.operators import metrics as M
from terraloom.operators import raster as G
from terraloom.operators import sampling as S
from terraloom.operators.attach import attach
from terraloom.operators.models import cached_table
from terraloom.plans.registry import R, query, r, with_ctes
from terraloom.session import shared_folder
from terraloom.sources import files as IO
from terraloom.sources.tables import GRID20, MANIFEST, POOL, SAMPLES, grid20, manifest, pool, samples, scored, scored_sql, sql_md5, table
from terraloom.streaming import ingest as stream

CHUNK_SCHEMA = T.StructType([T.StructField("manifest_row", T.LongType()), T.StructField("region", T.StringType()), T.StructField("value", T.DoubleType())])
PART_CHUNKS = "ch AS (SELECT p_partkey AS manifest_row, lower(p_brand) AS region, p_retailprice AS value, 'c' || printf('%03d', p_partkey // 500) AS chunk FROM part)"


def chunk_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("manifest_row"), F.lower("p_brand").alias("region"), F.col("p_retailprice").alias("value"))


@query("a01_typed_manifest_scan", with_ctes(MANIFEST) + f"SELECT sample_id, region, class_id, {R('longitude', 9)} AS longitude, {R('latitude', 9)} AS latitude, label_source, manifest_row FROM manifest")
def _(spark, d):
    path = IO.scratch(spark, "manifest")
    IO.write_sorted(manifest(spark, d), path, ["manifest_row"], "csv")
    return IO.read_csv(spark, path, IO.MANIFEST_SCHEMA).withColumn("longitude", r("longitude", 9)).withColumn("latitude", r("latitude", 9))


@query("a02_point_text_parse", with_ctes(MANIFEST) + f"SELECT sample_id, {R('longitude', 9)} AS longitude, {R('latitude', 9)} AS latitude FROM manifest")
def _(spark, d):
    rows = manifest(spark, d)
    text = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")))
    parsed = IO.parse_points(rows.select("sample_id", text.alias(".geo")))
    return parsed.select("sample_id", r("longitude", 9).alias("longitude"), r("latitude", 9).alias("latitude"))


@query("a03_chunk_ingest", f"WITH {PART_CHUNKS} SELECT chunk, count(*) AS rows, min(manifest_row) AS first_row, max(manifest_row) AS last_row, 0::BIGINT AS misplaced FROM ch GROUP BY chunk")
def _(spark, d):
    path = IO.scratch(spark, "chunks")
    IO.write_chunks(chunk_rows(spark, d), path, "manifest_row", 500)
    return IO.chunk_inventory(IO.read_chunks(spark, path, CHUNK_SCHEMA), "manifest_row", 500).drop("digest")


@query("a04_embedding_batch_ingest", with_ctes(SAMPLES) + f"SELECT count(*) AS rows, count(DISTINCT sample_id) AS keys, {R('avg(CASE WHEN len(list_filter(x, lambda v: v IS NULL)) = 0 THEN 1e0 ELSE 0e0 END)')} AS valid_share, {R('min(sqrt(list_sum(list_transform(x, lambda v: v * v))))')} AS norm_min, {R('max(sqrt(list_sum(list_transform(x, lambda v: v * v))))')} AS norm_max FROM samples")
def _(spark, d):
    rows = samples(spark, d)
    batches = K.union_all([rows.where(F.col("sample_id") % 3 == i) for i in range(3)])
    n = norm(F.col("x"))
    stats = batches.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"), F.min(complete(F.col("x"))).alias("ok"), F.min(n).alias("lo"), F.max(n).alias("hi")).agg(
        F.sum("c").alias("rows"), F.count(F.lit(1)).alias("keys"), F.avg(F.col("ok").cast("double")).alias("valid_share"), F.min("lo").alias("norm_min"), F.max("hi").alias("norm_max"))
    bad = (F.col("valid_share") < 0.98) | (F.col("rows") != F.col("keys"))
    return stats.select("rows", "keys", r(F.when(bad, F.raise_error(F.lit("incomplete or duplicated batch")).cast("double")).otherwise(F.col("valid_share"))).alias("valid_share"),
                        r("norm_min").alias("norm_min"), r("norm_max").alias("norm_max"))


@query("a05_columns_to_vector", with_ctes(SAMPLES) + f"SELECT sample_id, {R('x[1]', 9)} AS a00, {R('x[64]', 9)} AS a63, {R('list_sum(x)')} AS total, len(x) AS length FROM samples".replace("len(x) AS length", "CAST(len(x) AS BIGINT) AS length"))
def _(spark, d):
    names = [f"A{i:02d}" for i in range(64)]
    wide = samples(spark, d).select("sample_id", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    vec = wide.select("sample_id", F.array(*names).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + v)
    return vec.select("sample_id", r(F.col("v")[0], 9).alias("a00"), r(F.col("v")[63], 9).alias("a63"), r(total).alias("total"), F.size("v").cast("bigint").alias("length"))


@query("a06_windowed_band_scan", with_ctes(GRID20) + f"SELECT row, col, {R('p', 9)} AS p FROM grid20 WHERE row >= 25 AND row < 50 AND col >= 50 AND col < 100 AND row < 40")
def _(spark, d):
    path = IO.scratch(spark, "pixels")
    IO.write_pixels(grid20(spark, d), path, 25, 50)
    return IO.read_pixels(spark, path, ["p"], F.col("row") < 40, ["r01c01"]).withColumn("p", r("p", 9))


@query("a07_feature_round_trip", with_ctes(MANIFEST) + f"SELECT sample_id, class_id, region, {R('longitude', 9)} AS longitude, {R('latitude', 9)} AS latitude FROM manifest")
def _(spark, d):
    path = IO.scratch(spark, "features")
    IO.write_features(manifest(spark, d).select("sample_id", "class_id", "region", "longitude", "latitude"), path, "longitude", "latitude")
    props = T.StructType([f for f in IO.MANIFEST_SCHEMA.fields if f.name in ("sample_id", "class_id", "region")])
    out = IO.read_features(spark, path, props, "longitude", "latitude")
    return out.withColumn("longitude", r("longitude", 9)).withColumn("latitude", r("latitude", 9))


@query("a08_sorted_sinks", with_ctes(POOL) + "SELECT 'parquet' AS form, count(*) AS n, CAST(sum(sample_id) AS BIGINT) AS key_sum FROM pool UNION ALL SELECT 'csv', count(*), CAST(sum(sample_id) AS BIGINT) FROM pool")
def _(spark, d):
    rows = pool(spark, d).select("sample_id", "class_id", "block")
    a, b = IO.scratch(spark, "sorted"), IO.scratch(spark, "sorted")
    IO.write_sorted(rows, a, ["class_id", "sample_id"])
    IO.write_sorted(rows, b, ["class_id", "sample_id"], "csv")
    line = lambda df, n: df.agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("key_sum")).select(F.lit(n).alias("form"), "n", "key_sum")
    return line(spark.read.parquet(a), "parquet").unionByName(line(IO.read_csv(spark, b, rows.schema), "csv"))


@query("a09_chunk_plan", "SELECT p_partkey // 500 AS chunk_index, count(*) AS rows, min(p_partkey) AS start, max(p_partkey) + 1 AS stop, 'points_c' || printf('%03d', p_partkey // 500) || '_' || printf('%05d', min(p_partkey)) || '_' || printf('%05d', max(p_partkey) + 1) AS name FROM part GROUP BY p_partkey // 500")
def _(spark, d):
    return IO.chunk_plan(chunk_rows(spark, d), "manifest_row", 500)


def names_table(spark, d):
    events = table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))) + 1
    tags = events.select(F.floor((day - 1) / 7).alias("tag_order")).distinct().withColumn("tag", F.format_string("t%02d", F.col("tag_order") + 1))
    bands = events.select("event_type").distinct().select(F.concat(F.lit("S2_"), "event_type").alias("band"), md5_int("band", F.col("event_type")).alias("band_order"))
    return IO.band_columns(tags, bands)


NAMES = f"""nm AS (SELECT row_number() OVER (ORDER BY tag_order, band_order) - 1 AS position, lower('S2_' || event_type) || '_t' || printf('%02d', tag_order + 1) AS name FROM
  (SELECT DISTINCT (ts::DATE - DATE '2024-01-01') // 7 AS tag_order FROM events), (SELECT event_type, {sql_md5("'band:' || event_type")} AS band_order FROM (SELECT DISTINCT event_type FROM events)))"""


@query("a10_band_name_expansion", f"WITH {NAMES} SELECT position, name FROM nm")
def _(spark, d):
    return names_table(spark, d)


@query("a11_feature_groups", f"WITH {NAMES} SELECT CASE WHEN starts_with(name, 's2_click') THEN 'click' ELSE 'view' END AS \"group\", name, CAST(regexp_extract(name, 't([0-9]+)$', 1) AS BIGINT) AS suffix FROM nm WHERE starts_with(name, 's2_click') OR starts_with(name, 's2_view')")
def _(spark, d):
    return IO.feature_groups(names_table(spark, d), {"s2_click": "click", "s2_view": "view"})


LISTING = "ls AS (SELECT p_partkey, '/data/' || p_brand || '/' || p_type || '_' || (2015 + p_size % 8) || CASE WHEN p_partkey % 3 = 0 THEN '.TIF' WHEN p_partkey % 3 = 1 THEN '.zip' ELSE '.txt' END AS path FROM part)"


def listing(spark, d):
    ext = F.when(F.col("p_partkey") % 3 == 0, ".TIF").when(F.col("p_partkey") % 3 == 1, ".zip").otherwise(".txt")
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_type", F.lit("_"), (2015 + F.col("p_size") % 8).cast("string"), ext)
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


@query("a12_file_listing_filter", f"WITH {LISTING} SELECT p_partkey, path FROM ls WHERE lower(path) LIKE '%brand#12%' AND path LIKE '%2020%' AND lower(path) LIKE '%.tif'")
def _(spark, d):
    return IO.matching_files(listing(spark, d), "path", "brand#12", "2020", "economy")


@query("a12_listing_archive_fallback", f"WITH {LISTING} SELECT p_partkey, path FROM ls WHERE path LIKE '%2020%' AND lower(path) LIKE '%economy%' AND path LIKE '%.zip'")
def _(spark, d):
    return IO.matching_files(listing(spark, d), "path", "atlantis", "2020", "economy")


@query("a13_asset_registry", """WITH f AS (SELECT p_size, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey, p_name)) AS h, sum(strlen(p_name) + 1) AS n, min(p_name) AS low FROM part GROUP BY p_size)
  SELECT 'asset=' || p_size AS path, CASE WHEN p_size % 5 = 0 THEN 'MISSING' WHEN p_size % 7 = 0 THEN 'PRESENT' WHEN p_size % 11 = 0 THEN 'REBUILT' WHEN p_size % 13 = 0 THEN 'FOREIGN' ELSE 'OK' END AS state,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(n + CASE WHEN p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 11 = 0 THEN 8 ELSE 0 END AS BIGINT) END AS length,
    CASE WHEN p_size % 5 <> 0 AND (p_size % 7 = 0 OR p_size % 11 <> 0) THEN h END AS digest FROM f""")
def _(spark, d):
    """Files written here, one for each part size, some missing, damaged, unregistered or without digest; read back byte by byte."""
    root, key = IO.scratch(spark, "assets"), F.col("p_size")
    rows = table(spark, d, "part").select("p_size", "p_partkey", "p_name")
    plain = (key % 5 != 0) & (key % 7 != 0)
    damage = rows.where(plain & (key % 11 == 0)).groupBy("p_size").agg(F.lit(2**62).alias("p_partkey"), F.lit("damaged").alias("p_name"))
    written = rows.where(key % 5 != 0).unionByName(damage)
    written.repartition("p_size").sortWithinPartitions("p_size", "p_partkey", "p_name").select("p_size", "p_name").withColumnRenamed("p_size", "asset").write.partitionBy("asset").text(root)
    lines = rows.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("l"))
    content = F.sha2(F.concat(F.array_join(F.transform("l", lambda x: x["p_name"]), "\n"), F.lit("\n")), 256)
    registry = lines.where(~(plain & (key % 11 != 0) & (key % 13 == 0))).select(F.concat(F.lit("asset="), key.cast("string")).alias("path"), F.when(key % 7 != 0, F.upper(content)).alias("expected"))
    files = IO.file_digests(spark, root).where(F.col("path").rlike(r"/part-[^/]*$")).withColumn("path", F.regexp_extract("path", r"(asset=\d+)/", 1))
    states = IO.asset_states(registry, files)
    return states.select("path", "state", "length", F.when(F.col("state") != "REBUILT", F.col("digest")).alias("digest"))


@query("a14_existing_column_projection", with_ctes(MANIFEST) + "SELECT sample_id, region, class_id FROM manifest")
def _(spark, d):
    path = IO.scratch(spark, "narrow")
    IO.project_existing(manifest(spark, d), ["sample_id", "region", "absent", "class_id"]).write.parquet(path)
    return spark.read.parquet(path)


@query("a15_artifact_metadata", with_ctes(MANIFEST, GRID20) + f"SELECT 'points' AS artifact, count(*) AS n, {R('min(longitude)')} AS min_x, {R('max(longitude)')} AS max_x, {R('min(latitude)')} AS min_y, {R('max(latitude)')} AS max_y, 'sample_id,longitude,latitude' AS columns FROM manifest UNION ALL SELECT 'pixels', count(*), {R('min(col)')}, {R('max(col)')}, {R('min(row)')}, {R('max(row)')}, 'row,col,p' FROM grid20")
def _(spark, d):
    out = IO.artifact_metadata({"points": (manifest(spark, d).select("sample_id", "longitude", "latitude"), "longitude", "latitude"), "pixels": (grid20(spark, d).select("row", "col", "p"), "col", "row")})
    return out.select("artifact", "n", *[r(c).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")], "columns")


@query("c01_one_to_one_join", with_ctes(POOL, scored_sql()) + f"SELECT sample_id, class_id, {R('s.p', 9)} AS p FROM pool JOIN (SELECT sample_id, p FROM scored WHERE seed = 42) s USING (sample_id)")
def _(spark, d):
    left, right = pool(spark, d).select("sample_id", "class_id"), scored(spark, d, seeds=(42,)).select("sample_id", "p")
    return K.unique_join(left, right, ["sample_id"]).select("sample_id", "class_id", r("p", 9).alias("p"))


@query("c02_identity_join", with_ctes(MANIFEST) + "SELECT region, sample_id, manifest_row FROM manifest WHERE class_id = 1")
def _(spark, d):
    rows = manifest(spark, d)
    drawn = rows.where("class_id = 1").select("region", "sample_id")
    return drawn.join(rows.select("region", "sample_id", "manifest_row"), ["region", "sample_id"])


LEDGER = "cur AS (SELECT p_partkey // 20 AS chunk, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY ALL)"


@query("c17_ledger_reconciliation", f"WITH {LEDGER} SELECT chunk, CASE WHEN chunk % 9 = 0 THEN 'missing' WHEN chunk % 7 = 0 THEN 'unexpected' WHEN chunk % 5 = 0 THEN 'changed' ELSE 'verified' END AS state FROM cur WHERE NOT (chunk % 9 = 0 AND chunk % 7 = 0)")
def _(spark, d):
    cur = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s"))
    cur = cur.withColumn("digest", row_digest("chunk", "n", "s"))
    ledger = cur.where("chunk % 7 <> 0").withColumn("digest", F.when(F.col("chunk") % 5 == 0, F.lit("old")).otherwise(F.col("digest")))
    return K.ledger_check(ledger, cur.where("chunk % 9 <> 0"), "chunk", "digest")


@query("c20_recomputed_against_saved", with_ctes(scored_sql()) + "SELECT count(*) AS matched, 0::BIGINT AS unmatched, 0e0 AS max_difference, true AS within FROM scored WHERE seed = 42")
def _(spark, d):
    path = IO.scratch(spark, "saved")
    scored(spark, d, seeds=(42,)).select("sample_id", "p").write.parquet(path)
    return K.agreement(scored(spark, d, seeds=(42,)), spark.read.parquet(path), ["sample_id"], "p", 1e-12)


@query("s01_manifest_union", with_ctes(MANIFEST) + "SELECT region, sample_id, class_id FROM manifest")
def _(spark, d):
    rows = manifest(spark, d)
    source = rows.where("region = 'source'").select("sample_id", "class_id", "region")
    return source.unionByName(rows.where("region = 'target'").select("region", "sample_id", "class_id")).select("region", "sample_id", "class_id")


@query("s03_inventory_difference", f"WITH {LEDGER} SELECT chunk, CASE WHEN chunk % 9 = 0 THEN 'missing' ELSE 'unexpected' END AS kind FROM cur WHERE (chunk % 9 = 0) <> (chunk % 7 = 0)")
def _(spark, d):
    chunks = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("chunk")).distinct()
    return K.inventory_difference(chunks.where("chunk % 7 <> 0"), chunks.where("chunk % 9 <> 0"))


@query("k02_chunk_contract", """SELECT 'no_missing_keys' AS check_name, false AS ok, count(*) FILTER (p_partkey % 97 = 0) AS observed FROM part UNION ALL SELECT 'no_foreign_keys', true, 0 UNION ALL
  SELECT 'no_duplicate_keys', false, count(*) FILTER (p_partkey % 101 = 1) FROM part WHERE p_partkey % 97 <> 0 UNION ALL SELECT 'integral_keys', true, 0 UNION ALL
  SELECT 'region_identity', false, count(*) FROM part WHERE p_partkey % 89 = 2 AND p_partkey % 97 <> 0 UNION ALL SELECT 'finite_values', false, count(*) FROM part WHERE p_partkey % 83 = 3 AND p_partkey % 97 <> 0 AND p_partkey % 101 <> 1""")
def _(spark, d):
    rows, k = chunk_rows(spark, d), F.col("manifest_row")
    first = rows.where(k % 97 != 0)
    damaged = first.unionByName(first.where(k % 101 == 1)).withColumn("region", F.when(k % 89 == 2, "elsewhere").otherwise(F.col("region"))).withColumn(
        "value", F.when((k % 83 == 3) & (k % 101 != 1), float("nan")).otherwise(F.col("value"))).withColumn("manifest_row", k.cast("double"))
    return K.chunk_contract(damaged, rows, "manifest_row", "region", ["value"], 0, rows.count())


@query("k04_grid_alignment", with_ctes(GRID20, "sh AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM grid20)") + "SELECT unnest(['M0', 'shifted', 'cropped']) AS product, unnest(['', 'transform', 'shape']) AS mismatches, unnest([true, false, false]) AS aligned FROM sh")
def _(spark, d):
    shape = G.grid_shape(grid20(spark, d))
    make = lambda name, x0, cut: shape.select(F.lit(name).alias("product"), F.lit("EPSG:32651").alias("crs"), F.array(F.col("n_rows") - cut, F.col("n_cols")).alias("shape"),
                                              F.array(F.lit(20.0), F.lit(0.0), F.lit(x0), F.lit(0.0), F.lit(-20.0), F.lit(3510320.0)).alias("transform"))
    return K.grid_alignment(K.union_all([make("M0", 362320.0, 0), make("shifted", 362340.0, 0), make("cropped", 362320.0, 1)]), make("ref", 362320.0, 0).drop("product"))


@query("k05_idempotent_materialization", with_ctes(POOL) + f"SELECT block, count(*) AS n, {R('avg(p)')} AS mean_p, 1::BIGINT AS builds FROM pool GROUP BY block")
def _(spark, d):
    folder, calls = IO.scratch(spark, "protocol"), []

    def build():
        calls.append(1)
        return pool(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n"), r(F.avg("p")).alias("mean_p"))

    for _ in range(2):
        out = cached_table(spark, folder, {"table": "pool", "version": 1}, build)
    return out.withColumn("builds", F.lit(len(calls)).cast("bigint"))


@query("k06_result_invariants", with_ctes(scored_sql()) + f"SELECT seed, count(*) AS points, true AS starts_at_one, true AS grid_complete, 1e0 AS last_coverage, {R('avg(CASE WHEN (p >= 0.5e0) <> (y = 1) THEN 1e0 ELSE 0e0 END)')} AS last_risk FROM scored GROUP BY seed")
def _(spark, d):
    curve = M.selective_curve(scored(spark, d), ["seed"], "y", "p", "risk")
    return K.curve_invariants(curve, ["seed"]).select("seed", "points", "starts_at_one", "grid_complete", "last_coverage", r("last_risk").alias("last_risk"))


@query("k07_rebuilt_source_validation", with_ctes(MANIFEST) + "SELECT 'binary_classes' AS check_name, true AS ok, 0::BIGINT AS observed UNION ALL SELECT 'column_order', true, 7 UNION ALL SELECT 'rows', count(*) > 0, count(*) FROM manifest UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT sample_id), count(DISTINCT sample_id) FROM manifest")
def _(spark, d):
    rows = manifest(spark, d)
    per_id = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("class_id").isin(0, 1)).alias("bad"))
    wide = per_id.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ids"), F.sum("bad").alias("bad"))
    ordered = rows.columns == IO.MANIFEST_SCHEMA.names
    return K.check_table(wide, {"binary_classes": (F.col("bad") == 0, F.col("bad")), "column_order": (F.lit(ordered), F.lit(len(rows.columns))),
                                "rows": (F.col("rows") > 0, F.col("rows")), "unique_ids": (F.col("rows") == F.col("ids"), F.col("ids"))})


@query("k08_config_comparison", "SELECT p_partkey, p_size % 5 <> 0 AS same FROM part")
def _(spark, d):
    size = F.col("p_size").cast("string")
    a = F.create_map(F.lit("trees"), size, F.lit("threads"), F.lit("4"), F.lit("brand"), F.col("p_brand"))
    b = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("trees"), F.when(F.col("p_size") % 5 == 0, F.concat(size, F.lit("0"))).otherwise(size))
    return K.same_config(table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b")), ["threads"]).select("p_partkey", "same")


@query("l01_restartable_chunk_ingest", f"WITH {PART_CHUNKS} SELECT chunk, count(*) AS rows, count(*) FILTER (manifest_row % 500 = 499) = 0 AS accepted, 1::BIGINT AS times_ledgered FROM ch WHERE chunk <> 'c001' GROUP BY chunk")
def _(spark, d):
    """Each chunk comes in two runs; a whole chunk is ledgered once. c001 never gets its last rows; last rows elsewhere come twice."""
    incoming, out = IO.scratch(spark, "incoming"), IO.scratch(spark, "landed")
    rows = chunk_rows(spark, d)
    place = F.col("manifest_row") % 500
    short = F.floor(F.col("manifest_row") / 500) == 1
    for part_ in (rows.where(place < 200), rows.where((place >= 200) & ~(short & (place > 490))), None):  # the last run finds nothing new
        if part_ is not None:
            part_ = part_.unionByName(part_.where((place == 499)))
            keyed = part_.withColumn("chunk", F.format_string("c%03d", F.floor(F.col("manifest_row") / 500)))
            keyed.repartition(spark.sparkContext.defaultParallelism, "chunk").write.mode("append").option("header", True).partitionBy("chunk").csv(incoming)
        stream.ingest_chunks(spark, incoming, CHUNK_SCHEMA, "manifest_row", 500, out, rows)
    ledger = spark.read.parquet(f"{out}/ledger")
    times = ledger.groupBy("chunk").agg(F.max("rows").alias("all_rows"), F.min("accepted").alias("accepted"), F.count(F.lit(1)).alias("times_ledgered"), F.max("duplicate").alias("again"))
    return times.select("chunk", (F.col("all_rows") - F.col("again")).alias("rows"), "accepted", "times_ledgered")


@query("l02_duplicate_key_rejection", "SELECT event_id, user_id FROM events")
def _(spark, d):
    incoming, out = IO.scratch(spark, "events"), IO.scratch(spark, "unique")
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    for turn in range(2):  # the second copy of every event arrives in other files, all of them in a time order of their own
        events.repartitionByRange(8, F.xxhash64("event_id", F.lit(turn))).write.mode("append").parquet(incoming)
    return stream.reject_duplicates(spark, incoming, events.schema, "event_id", "ts", out, files_per_batch=4).select("event_id", "user_id")


@query("l03_incremental_composite", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, user_id, {R('quantile_cont(value, 0.5)', 9)} AS median, count(*) AS n_obs FROM events GROUP BY ALL""")
def _(spark, d):
    incoming, out = IO.scratch(spark, "events"), IO.scratch(spark, "composite")
    events = table(spark, d, "events").select("user_id", "ts", "value")
    events.write.parquet(incoming)
    rows = stream.incremental_composite(spark, incoming, events.schema, "user_id", "ts", "value", "1 day", "1 day", "1 day", out)
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id", r("median", 9).alias("median"), "n_obs")


SPREAD = """sp AS (SELECT g.row, g.col, g.ref, g.p, wi, wj, (wi * 1000 + wj) * 1000000 + row * 150 + col AS id FROM grid20 g, (SELECT unnest(range(0, (SELECT max(row) // 10 + 1 FROM grid20))) AS wi), (SELECT unnest(range(0, 15)) AS wj)
  WHERE row // 10 BETWEEN wi AND wi + 2 AND col // 10 BETWEEN wj AND wj + 2),
cel AS (SELECT * FROM sp WHERE ref = 1 AND p IS NOT NULL),
adj AS (SELECT a.id AS a, b.id AS b FROM (SELECT * FROM cel, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) a JOIN cel b ON b.wi = a.wi AND b.wj = a.wj AND b.row = a.row + a.dr AND b.col = a.col + a.dc),
rch(id, o) AS (SELECT id, id FROM cel UNION SELECT r.id, j.b FROM rch r JOIN adj j ON j.a = r.o),
cmp AS (SELECT id, min(o) AS comp, count(*) AS size FROM rch GROUP BY id),
prt AS (SELECT wi, wj, count(DISTINCT comp) AS parts FROM cel JOIN cmp USING (id) WHERE size >= 9 GROUP BY ALL),
inn AS (SELECT wi, wj, count(*) AS inner_ FROM (SELECT a.wi, a.wj, a.id FROM (SELECT * FROM cel, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dr, dc)) a JOIN cel b ON b.wi = a.wi AND b.wj = a.wj AND b.row = a.row + a.dr AND b.col = a.col + a.dc GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL),
stt AS (SELECT wi, wj, count(*) AS n_all, count(p)::DOUBLE AS n, count(*) FILTER (ref = 1 AND p IS NOT NULL) AS pos, stddev_pop(p) AS spread, avg(CASE WHEN p IS NOT NULL THEN CASE WHEN p BETWEEN 0.2e0 AND 0.8e0 THEN 1e0 ELSE 0e0 END END) AS mid FROM sp GROUP BY ALL HAVING count(*) = 900),
lab AS (SELECT wi, wj, pos / n AS share, (pos - coalesce(inner_, 0)) / n AS edge, coalesce(parts, 0) AS components, n / n_all >= 0.98e0 AND pos / n BETWEEN 0.12e0 AND 0.70e0 AS eligible, spread, mid FROM stt LEFT JOIN inn USING (wi, wj) LEFT JOIN prt USING (wi, wj))"""


@query("g05_label_aided_window_scores", "WITH RECURSIVE " + GRID20 + ", " + SPREAD + f"SELECT wi, wj, {R('share')} AS share, {R('edge')} AS boundary_density, components, eligible, {R('8 * share * (1 - share) + 12 * edge + 0.8e0 * spread + 0.4e0 * mid + 0.002e0 * least(components, 250)')} AS score FROM lab")
def _(spark, d):
    from terraloom.operators.graph import cell_components

    block, width = 10, 3
    axis = lambda c: F.explode(F.filter(F.sequence(F.floor(F.col(c) / block) - (width - 1), F.floor(F.col(c) / block)), lambda i: i >= 0))
    spread = grid20(spark, d).withColumn("wi", axis("row")).withColumn("wj", axis("col"))
    out = G.label_aided_scores(spread, ["wi", "wj"], F.col("ref") == 1, "p", (block * width) ** 2, cell_components)
    return out.select("wi", "wj", r("share").alias("share"), r("boundary_density").alias("boundary_density"), "components", "eligible", r("score").alias("score"))

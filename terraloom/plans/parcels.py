"""Parcel queries: overlap, ownership, reconciliation, repair, zonal statistics, QA and safeguards."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions.hashing import hash_unit, md5_int
from terraloom.operators import parcels as P
from terraloom.operators import raster as G
from terraloom.operators.attach import attach
from terraloom.operators.graph import cell_components
from terraloom.plans.registry import R, query, r, with_ctes
from terraloom.session import materialize
from terraloom.sources.tables import GRID20, PARCEL_CELLS, RINGS, grid20, parcel_cells, rings, sql_md5

CELLS = [GRID20, PARCEL_CELLS]
AREA = 6500.0


def centers(spark, d):
    return grid20(spark, d).select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))


INSIDE = """edge AS (SELECT ring_id, ring[i].x AS ax, ring[i].y AS ay, ring[i + 1].x AS bx, ring[i + 1].y AS by_ FROM rings, (SELECT unnest([1, 2, 3, 4]) AS i)),
box AS (SELECT ring_id, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM edge GROUP BY ring_id),
cand AS (SELECT g.row, g.col, b.ring_id FROM grid20 g JOIN box b ON g.col + 0.5e0 >= x0 AND g.col + 0.5e0 <= x1 AND g.row + 0.5e0 >= y0 AND g.row + 0.5e0 <= y1),
inside AS (SELECT c.row, c.col, c.ring_id FROM cand c JOIN edge e USING (ring_id) GROUP BY ALL
  HAVING count(*) FILTER ((ay > c.row + 0.5e0) <> (by_ > c.row + 0.5e0) AND c.col + 0.5e0 < (bx - ax) * (c.row + 0.5e0 - ay) / nullif(by_ - ay, 0) + ax) % 2 = 1)"""


@query("c08_point_in_polygon", with_ctes(GRID20, RINGS, INSIDE) + "SELECT ring_id, row, col FROM inside")
def _(spark, d):
    return P.points_in_rings(centers(spark, d), rings(spark, d)).select("ring_id", "row", "col")


@query("g01_field_and_cover_gates", with_ctes(GRID20, RINGS, INSIDE) + f"""SELECT row, col, {R('CASE WHEN f THEN p END', 9)} AS m1, {R('CASE WHEN f AND lcw IN (3, 4) THEN p END', 9)} AS m1b,
  CASE WHEN p IS NULL THEN 255 ELSE CAST(f AND p >= 0.5e0 AS BIGINT) END AS m1_binary FROM (SELECT g.*, i.row IS NOT NULL AS f FROM grid20 g LEFT JOIN (SELECT DISTINCT row, col FROM inside) i USING (row, col))""".replace("i.row IS NOT NULL AS f", "hit IS NOT NULL AS f").replace("SELECT DISTINCT row, col FROM", "SELECT DISTINCT row, col, 1 AS hit FROM"))
def _(spark, d):
    field = P.points_in_rings(centers(spark, d), rings(spark, d)).select("row", "col").distinct().withColumn("hit", F.lit(True))
    g = grid20(spark, d).join(field, ["row", "col"], "left").withColumn("f", F.coalesce("hit", F.lit(False)))
    return g.select("row", "col", r(F.when(F.col("f"), F.col("p")), 9).alias("m1"), r(F.when(F.col("f") & F.col("lcw").isin(3, 4), F.col("p")), 9).alias("m1b"),
                    F.when(F.col("p").isNull(), 255).otherwise((F.col("f") & (F.col("p") >= 0.5)).cast("bigint")).alias("m1_binary"))


SIZES = "sz AS (SELECT parcel_id, min(tile) AS tile, count(*) AS n FROM parcel_cells GROUP BY parcel_id)"
PAIRS = """pr AS (SELECT a.parcel_id AS a, b.parcel_id AS b, count(*) AS shared FROM parcel_cells a JOIN parcel_cells b ON a.row = b.row AND a.col = b.col AND a.parcel_id < b.parcel_id AND a.tile <> b.tile GROUP BY ALL),
pairs AS (SELECT pr.*, shared::DOUBLE / least(x.n, y.n) AS ratio, shared::DOUBLE / (x.n + y.n - shared) AS iou FROM pr JOIN sz x ON x.parcel_id = a JOIN sz y ON y.parcel_id = b)"""


@query("c09_overlap_pairs", with_ctes(*CELLS, SIZES, PAIRS) + f"SELECT a, b, shared, {R('ratio')} AS ratio FROM pairs")
def _(spark, d):
    return P.overlap_pairs(parcel_cells(spark, d)).select("a", "b", "shared", r("ratio").alias("ratio"))


@query("c10_overlap_summary", with_ctes(*CELLS, SIZES, PAIRS.replace(" AND a.tile <> b.tile", "")) + f"SELECT count(*) AS pair_count, {R('sum(shared) * 400e0')} AS overlap_area, {R('sum(shared) / (SELECT count(*)::DOUBLE FROM (SELECT DISTINCT row, col FROM parcel_cells))')} AS rate FROM pairs")
def _(spark, d):
    out = P.overlap_summary(parcel_cells(spark, d), 400.0)
    return out.select("pair_count", r("overlap_area").alias("overlap_area"), r("rate").alias("rate"))


OWN = """shp AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM grid20),
ext AS (SELECT parcel_id, tile, avg(row) AS cr, avg(col) AS cc, count(*) AS n_cells, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1, split_part(tile, '_', 1)::BIGINT AS tr, split_part(tile, '_', 2)::BIGINT AS tc FROM parcel_cells GROUP BY ALL),
rep AS (SELECT * FROM (SELECT e.*, c.row AS rep_row, c.col AS rep_col, row_number() OVER (PARTITION BY parcel_id, tile ORDER BY round(pow(c.row - cr, 2) + pow(c.col - cc, 2), 6), c.row, c.col) AS k FROM ext e JOIN parcel_cells c USING (parcel_id, tile)) WHERE k = 1),
own AS (SELECT parcel_id, tile, n_cells, rep_row, rep_col, rep_row // 25 = tr AND rep_col // 50 = tc AS owned,
  least(rep_row + 0.5e0 - greatest(tr * 25 - 3, 0), least((tr + 1) * 25 + 3, nr) - rep_row - 0.5e0, rep_col + 0.5e0 - greatest(tc * 50 - 3, 0), least((tc + 1) * 50 + 3, nc) - rep_col - 0.5e0) AS halo_distance,
  r0 = 0 OR c0 = 0 OR r1 = nr - 1 OR c1 = nc - 1 AS deployment_edge, r0 < tr * 25 OR r1 >= (tr + 1) * 25 OR c0 < tc * 50 OR c1 >= (tc + 1) * 50 AS core_crossing,
  r0 = greatest(tr * 25 - 3, 0) OR r1 = least((tr + 1) * 25 + 3, nr) - 1 OR c0 = greatest(tc * 50 - 3, 0) OR c1 = least((tc + 1) * 50 + 3, nc) - 1 AS halo_edge,
  r0 <= tr * 25 OR r1 >= (tr + 1) * 25 - 1 OR c0 <= tc * 50 OR c1 >= (tc + 1) * 50 - 1 AS core_edge FROM rep, shp)"""


def owned(spark, d):
    """One row per parcel, stored because most parcel steps read it several times."""
    return materialize(P.ownership(parcel_cells(spark, d), G.grid_shape(grid20(spark, d)), 25, 50, 3))


@query("c15_core_ownership", with_ctes(*CELLS, OWN) + "SELECT parcel_id, tile, rep_row, rep_col, owned, halo_distance FROM own")
def _(spark, d):
    return owned(spark, d).select("parcel_id", "tile", "rep_row", "rep_col", "owned", "halo_distance")


@query("g16_edge_flags", with_ctes(*CELLS, OWN) + "SELECT parcel_id, deployment_edge, core_crossing, halo_edge, core_edge FROM own")
def _(spark, d):
    return owned(spark, d).select("parcel_id", "deployment_edge", "core_crossing", "halo_edge", "core_edge")


def comp_sql(threshold: float, rows: str = "pairs") -> str:
    return f"""und AS (SELECT a, b FROM {rows} WHERE ratio >= {threshold}e0 UNION SELECT b, a FROM {rows} WHERE ratio >= {threshold}e0),
reach(parcel_id, other) AS (SELECT a, a FROM und UNION SELECT r.parcel_id, u.b FROM reach r JOIN und u ON u.a = r.other),
comp AS (SELECT parcel_id, min(other) AS comp FROM reach GROUP BY parcel_id)"""


REC = "WITH RECURSIVE "
OWNER_PAIRS = "(SELECT * FROM pairs WHERE a IN (SELECT parcel_id FROM own WHERE owned) AND b IN (SELECT parcel_id FROM own WHERE owned))"


@query("g08_duplicate_components", REC + ",\n".join([*CELLS, SIZES, PAIRS, comp_sql(0.25)]) + " SELECT parcel_id, comp FROM comp")
def _(spark, d):
    return P.duplicate_components(P.overlap_pairs(parcel_cells(spark, d)).where("ratio >= 0.25"))


WIN = """mem AS (SELECT c.comp, o.* FROM comp c JOIN own o USING (parcel_id)),
win AS (SELECT comp, parcel_id AS kept FROM (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY halo_distance DESC, n_cells DESC, parcel_id) AS k FROM mem) WHERE k = 1),
audit AS (SELECT kept, parcel_id AS dropped FROM mem JOIN win USING (comp) WHERE parcel_id <> kept)"""


@query("e21_component_winners", REC + ",\n".join([*CELLS, SIZES, PAIRS, OWN, comp_sql(0.25), WIN]) + " SELECT kept, dropped FROM audit")
def _(spark, d):
    found = P.duplicate_components(P.overlap_pairs(parcel_cells(spark, d)).where("ratio >= 0.25"))
    members = materialize(found.join(owned(spark, d), "parcel_id"))
    audit = members.join(P.component_winners(members), "comp").where("parcel_id <> kept")
    return audit.select("kept", F.col("parcel_id").alias("dropped"))


RESIDUAL = f"resid AS (SELECT a, b, shared, ratio FROM {OWNER_PAIRS} WHERE a NOT IN (SELECT dropped FROM audit) AND b NOT IN (SELECT dropped FROM audit))"


@query("g09_cross_tile_reconciliation", REC + ",\n".join([*CELLS, SIZES, PAIRS, OWN, comp_sql(0.5, OWNER_PAIRS), WIN, RESIDUAL, "part AS (SELECT a AS parcel_id FROM resid UNION SELECT b FROM resid)"]) + """
  SELECT parcel_id, coalesce(removed, 0) AS removed, parcel_id IN (SELECT parcel_id FROM part) AS residual_overlap,
    coalesce(removed, 0) > 0 OR core_crossing OR halo_edge OR parcel_id IN (SELECT parcel_id FROM part) AS reconciled
  FROM own LEFT JOIN (SELECT kept AS parcel_id, count(*) AS removed FROM audit GROUP BY kept) USING (parcel_id) WHERE owned AND parcel_id NOT IN (SELECT dropped FROM audit)""")
def _(spark, d):
    return P.reconcile(parcel_cells(spark, d), owned(spark, d), 0.5)[0].select("parcel_id", "removed", "residual_overlap", "reconciled")


@query("g09_residual_overlaps", REC + ",\n".join([*CELLS, SIZES, PAIRS, OWN, comp_sql(0.5), WIN, RESIDUAL.replace(OWNER_PAIRS, "pairs")]) + f" SELECT a, b, shared * {AREA}e0 AS overlap_area, {R('ratio')} AS overlap_vs_smaller FROM resid")
def _(spark, d):
    """Over the parcels of both versions, owned or not: here no two owned ones share cells."""
    found = P.reconcile(parcel_cells(spark, d), owned(spark, d).withColumn("owned", F.lit(True)), 0.5)[2]
    return found.select("a", "b", (F.col("shared") * float(AREA)).alias("overlap_area"), r("ratio").alias("overlap_vs_smaller"))


REP = "fix AS (SELECT row, col, parcel_id, claims FROM (SELECT c.row, c.col, c.parcel_id, row_number() OVER (PARTITION BY c.row, c.col ORDER BY halo_distance DESC, n_cells DESC, c.parcel_id) AS k, count(*) OVER (PARTITION BY c.row, c.col) AS claims FROM parcel_cells c JOIN own o USING (parcel_id)) WHERE k = 1)"


@query("g10_overlap_repair", with_ctes(*CELLS, OWN, REP) + f"SELECT parcel_id, count(f.row) AS cells_left, count(f.row) * {AREA}e0 < 2500 AS fragment FROM own LEFT JOIN fix f USING (parcel_id) GROUP BY parcel_id")
def _(spark, d):
    o = owned(spark, d)
    left = P.repair_overlaps(parcel_cells(spark, d), o).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("cells_left"))
    out = o.select("parcel_id").join(left, "parcel_id", "left").withColumn("cells_left", F.coalesce("cells_left", F.lit(0)).cast("bigint"))
    return out.withColumn("fragment", F.col("cells_left") * AREA < 2500)


ZON = "zon AS (SELECT parcel_id, count(p) AS n, avg(p) AS mean, quantile_cont(p, 0.5) AS median, stddev_pop(p) AS std, avg(CASE WHEN p IS NOT NULL THEN CASE WHEN p >= 0.5e0 THEN 1e0 ELSE 0e0 END END) AS positive_share FROM parcel_cells c JOIN grid20 g USING (row, col) GROUP BY parcel_id)"


@query("d17_zonal_statistics", with_ctes(*CELLS, ZON) + f"SELECT parcel_id, n, {R('mean')} AS mean, {R('median', 9)} AS median, {R('std')} AS std, {R('positive_share')} AS positive_share FROM zon")
def _(spark, d):
    out = P.zonal(parcel_cells(spark, d), grid20(spark, d), "p")
    return out.select("parcel_id", "n", *[r(c, 9 if c == "median" else 6).alias(c) for c in ("mean", "median", "std", "positive_share")])


LCF = "lcf AS (SELECT parcel_id, " + ", ".join(f"avg(CASE WHEN lcw = {i} THEN 1e0 ELSE 0e0 END) AS {n}" for i, n in enumerate(P.COVER)) + " FROM parcel_cells JOIN grid20 USING (row, col) GROUP BY parcel_id)"


@query("d18_zonal_class_shares", with_ctes(*CELLS, LCF) + "SELECT parcel_id, " + ", ".join(f"{R(n)} AS {n}" for n in P.COVER) + " FROM lcf")
def _(spark, d):
    out = P.zonal_shares(parcel_cells(spark, d), grid20(spark, d), "lcw")
    return out.select("parcel_id", *[r(n).alias(n) for n in P.COVER])


@query("b17_not_crop_dominant", with_ctes(*CELLS, LCF) + "SELECT parcel_id, crops < 0.2e0 AND greatest(water, trees, built) >= 0.5e0 AS flagged FROM lcf")
def _(spark, d):
    return P.zonal_shares(parcel_cells(spark, d), grid20(spark, d), "lcw").select("parcel_id", P.not_crop_dominant().alias("flagged"))


@query("d19_area_distribution", with_ctes(*CELLS, f"ar AS (SELECT parcel_id, count(*) * {AREA}e0 AS area FROM parcel_cells GROUP BY parcel_id)") + f"""SELECT count(*) AS n, {R('min(area)')} AS min, {R('quantile_cont(area, 0.1)')} AS p10, {R('quantile_cont(area, 0.5)')} AS median,
  {R('avg(area)')} AS mean, {R('quantile_cont(area, 0.9)')} AS p90, {R('max(area)')} AS max, count(*) FILTER (area > 200000) AS over_20ha, count(*) FILTER (area > 500000) AS over_50ha FROM ar""")
def _(spark, d):
    sizes = parcel_cells(spark, d).groupBy("parcel_id").agg((F.count(F.lit(1)) * AREA).alias("area"))
    out = P.area_distribution(sizes, "area")
    return out.select("n", *[r(c).alias(c) for c in ("min", "p10", "median", "mean", "p90", "max")], "over_20ha", "over_50ha")


FLAGS = ["large", "very_large", "low_pixels", "built_dominant", "tree_dominant", "water_dominant", "disagreement", "cross_tile", "edge"]
PARCELS = [*CELLS, OWN, ZON, LCF, f"dis AS (SELECT parcel_id, avg(CASE WHEN {sql_md5(f'concat_ws(chr(58), 8, row, col)')} % 100 < 6 THEN 1e0 ELSE 0e0 END) AS tile_disagreement FROM parcel_cells GROUP BY parcel_id)",
           f"""par AS (SELECT o.*, z.n, z.mean, z.median, z.positive_share, l.* EXCLUDE (parcel_id), d.tile_disagreement, o.n_cells * {AREA}e0 AS area, o.core_crossing AS reconciled FROM own o JOIN zon z USING (parcel_id) JOIN lcf l USING (parcel_id) JOIN dis d USING (parcel_id))""",
           """cls AS (SELECT *, CASE WHEN mean >= 0.5e0 THEN 'positive' ELSE 'negative' END AS class_by_mean, CASE WHEN median >= 0.5e0 THEN 'positive' ELSE 'negative' END AS class_by_median, CASE WHEN positive_share >= 0.5e0 THEN 'positive' ELSE 'negative' END AS class_by_share,
  area > 200000 AS large, area > 500000 AS very_large, n < 4 AS low_pixels, built >= 0.5e0 AS built_dominant, trees >= 0.5e0 AS tree_dominant, water >= 0.5e0 AS water_dominant, tile_disagreement >= 0.05e0 AS disagreement, reconciled AS cross_tile, deployment_edge AS edge FROM par)""",
           f"flg AS (SELECT *, NOT (class_by_mean = class_by_median AND class_by_median = class_by_share) AS summary_disagreement, {' + '.join(f'CAST({f} AS BIGINT)' for f in FLAGS)} AS base_flags FROM cls)"]


def parcels(spark, d, own=None):
    """Parcels with zonal values, cover shares, disagreement, edge context and quality flags."""
    cells, grid = parcel_cells(spark, d), grid20(spark, d)
    dis = cells.groupBy("parcel_id").agg(F.avg((md5_int(8, F.col("row"), F.col("col")) % 100 < 6).cast("double")).alias("tile_disagreement"))
    base = (own or owned(spark, d)).join(P.zonal(cells, grid, "p"), "parcel_id").join(P.zonal_shares(cells, grid, "lcw"), "parcel_id").join(dis, "parcel_id")
    base = base.withColumn("area", F.col("n_cells") * AREA).withColumn("reconciled", F.col("core_crossing"))
    return base.select("*", *[c.alias(n) for n, c in P.class_by_summary().items()], *[c.alias(n) for n, c in P.quality_flags().items()])


@query("b13_quality_flags", with_ctes(*PARCELS) + f"SELECT parcel_id, {', '.join(FLAGS)}, base_flags AS flag_count FROM flg")
def _(spark, d):
    return parcels(spark, d).select("parcel_id", *FLAGS, P.flag_count(FLAGS).alias("flag_count"))


@query("b14_parcel_class", with_ctes(*PARCELS) + "SELECT parcel_id, class_by_mean, class_by_median, class_by_share, summary_disagreement, CASE WHEN base_flags + CAST(summary_disagreement AS BIGINT) > 0 THEN 'abstain' ELSE class_by_mean END AS parcel_class FROM flg")
def _(spark, d):
    rows = parcels(spark, d)
    final = F.when(P.flag_count([*FLAGS, "summary_disagreement"]) > 0, "abstain").otherwise(F.col("class_by_mean"))
    return rows.select("parcel_id", "class_by_mean", "class_by_median", "class_by_share", "summary_disagreement", final.alias("parcel_class"))


SAFE = f"""res AS (SELECT parcel_id, count(f.row) * {AREA}e0 AS repaired_area FROM own LEFT JOIN fix f USING (parcel_id) GROUP BY parcel_id),
part_ AS (SELECT DISTINCT c.parcel_id FROM parcel_cells c JOIN (SELECT row, col FROM parcel_cells GROUP BY ALL HAVING count(DISTINCT tile) > 1) USING (row, col)),
saf0 AS (SELECT f.*, r.repaired_area, f.parcel_id IN (SELECT parcel_id FROM part_) AS participant FROM flg f JOIN res r USING (parcel_id)),
saf AS (SELECT *, concat_ws(';', CASE WHEN water >= 0.8e0 THEN 'water_dominant' END, CASE WHEN built >= 0.8e0 THEN 'built_dominant' END, CASE WHEN area > 200000 AND water + bare >= 0.7e0 THEN 'tidal_flat_like' END, CASE WHEN area > 500000 THEN 'extreme_area' END, CASE WHEN repaired_area < 2500 THEN 'cross_tile_overlap' END) AS exclusion,
  concat_ws(';', CASE WHEN area > 200000 THEN 'extreme_area' END, CASE WHEN participant OR repaired_area < 2500 THEN 'cross_tile_overlap' END, CASE WHEN deployment_edge THEN 'deployment_edge' END, CASE WHEN tile_disagreement >= 0.25e0 THEN 'high_tile_disagreement' END) AS geometry_risk,
  concat_ws(';', CASE WHEN water >= 0.5e0 THEN 'water_dominant' END, CASE WHEN built >= 0.5e0 THEN 'built_dominant' END, CASE WHEN trees >= 0.5e0 THEN 'tree_dominant' END, CASE WHEN area > 200000 AND water + bare >= 0.7e0 THEN 'tidal_flat_like' END) AS cover_risk FROM saf0),
sta AS (SELECT *, CASE WHEN exclusion <> '' THEN 'excluded' WHEN geometry_risk <> '' OR cover_risk <> '' THEN 'retained_QA_risk' ELSE 'retained_clear' END AS mapping_status FROM saf)"""


def safeguarded(spark, d):
    cells, o = parcel_cells(spark, d), owned(spark, d)
    left = P.repair_overlaps(cells, o).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("_left"))
    pairs = P.overlap_pairs(cells)
    part = pairs.select(F.col("a").alias("parcel_id")).unionByName(pairs.select(F.col("b").alias("parcel_id"))).distinct().withColumn("_part", F.lit(True))
    rows = parcels(spark, d, o).join(left, "parcel_id", "left").join(part, "parcel_id", "left")
    rows = rows.withColumn("repaired_area", F.coalesce("_left", F.lit(0)) * AREA).withColumn("participant", F.coalesce("_part", F.lit(False)))
    rows = rows.select("*", *[c.alias(n) for n, c in P.safeguard_reasons().items()])
    return rows.withColumn("mapping_status", P.mapping_status())


@query("b15_safeguard_reasons", with_ctes(*PARCELS, REP, SAFE) + "SELECT parcel_id, exclusion, geometry_risk, cover_risk FROM sta")
def _(spark, d):
    return safeguarded(spark, d).select("parcel_id", "exclusion", "geometry_risk", "cover_risk")


@query("b16_mapping_status", with_ctes(*PARCELS, REP, SAFE) + "SELECT parcel_id, mapping_status, mapping_status <> 'excluded' AS in_product_b, mapping_status <> 'retained_clear' AS in_product_c FROM sta")
def _(spark, d):
    return safeguarded(spark, d).select("parcel_id", "mapping_status", (F.col("mapping_status") != "excluded").alias("in_product_b"), (F.col("mapping_status") != "retained_clear").alias("in_product_c"))


@query("d38_reason_frequencies", with_ctes(*PARCELS, REP, SAFE, "ex AS (SELECT unnest(string_split(exclusion, ';')) AS reason FROM sta WHERE exclusion <> '')") + "SELECT reason, count(*) AS n FROM ex GROUP BY reason")
def _(spark, d):
    return P.reason_counts(safeguarded(spark, d), "exclusion")


@query("d38_dominant_cover_before_after", with_ctes(*PARCELS, REP, SAFE) + " UNION ALL ".join(f"""SELECT '{c}' AS cover, count(*) AS before_count, {R('coalesce(sum(area), 0) / 10000')} AS before_ha, count(*) FILTER (mapping_status <> 'excluded') AS after_count,
  {R("coalesce(sum(repaired_area) FILTER (mapping_status <> 'excluded'), 0) / 10000")} AS after_ha FROM sta WHERE {c}_dominant""" for c in ("water", "built", "tree")))
def _(spark, d):
    rows = safeguarded(spark, d)
    kept = F.col("mapping_status") != "excluded"
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(f"{c}_dominant"), F.lit(c)) for c in ("water", "built", "tree")])))
    found = rows.withColumn("cover", named).groupBy("cover").agg(
        F.count(F.lit(1)).alias("before_count"), r(F.sum("area") / 10000).alias("before_ha"), F.count_if(kept).alias("after_count"),
        r(F.coalesce(F.sum(F.when(kept, F.col("repaired_area"))), F.lit(0.0)) / 10000).alias("after_ha"))
    covers = rows.select(F.explode(F.array(F.lit("water"), F.lit("built"), F.lit("tree"))).alias("cover")).distinct()
    zero = F.lit(0).cast("bigint")
    return covers.join(found, "cover", "left").select(
        "cover", F.coalesce("before_count", zero).alias("before_count"), F.coalesce("before_ha", F.lit(0.0)).alias("before_ha"),
        F.coalesce("after_count", zero).alias("after_count"), F.coalesce("after_ha", F.lit(0.0)).alias("after_ha"))


RET = "ret AS (SELECT (row // 25) || '_' || (col // 50) AS tile, avg(CASE WHEN f.row IS NOT NULL AND (row // 7 + col // 11) % 3 <> 0 THEN 1e0 ELSE 0e0 END) AS retained_share FROM grid20 f GROUP BY ALL)"
TSH = ["built_dominant", "tree_dominant", "water_dominant", "large", "very_large", "disagreement", "summary_disagreement"]
TQ = f"""tq AS (SELECT tile, count(*) AS parcel_count, {', '.join(f'count(*) FILTER ({f})::DOUBLE / greatest(count(*), 1) AS {f}_share' for f in TSH)}, count(*) FILTER (very_large) AS very_large_count, count(*) FILTER (cross_tile) AS cross_tile_count FROM flg GROUP BY tile),
md AS (SELECT quantile_cont(cross_tile_count, 0.5) AS m FROM tq), mad AS (SELECT m + 3 * greatest(quantile_cont(abs(cross_tile_count - m), 0.5), 1) AS lim FROM tq, md GROUP BY m),
tw AS (SELECT tq.*, retained_share, lim, CAST(coalesce(retained_share > 0.68116e0, false) AS BIGINT) + CAST(built_dominant_share > 0.13637e0 AS BIGINT) + CAST(tree_dominant_share > 0.09091e0 AS BIGINT) + CAST(water_dominant_share > 0.0104e0 AS BIGINT) + CAST(large_share > 0.09741e0 AS BIGINT)
  + CAST(very_large_count >= 2 OR very_large_share > 0.03247e0 AS BIGINT) + CAST(disagreement_share > 0.27296e0 AS BIGINT) + CAST(summary_disagreement_share > 0.0208e0 AS BIGINT) + CAST(cross_tile_count > lim AS BIGINT) AS warning_count FROM tq LEFT JOIN ret USING (tile), mad)"""


def tile_table(spark, d):
    keep = (F.floor(F.col("row") / 7) + F.floor(F.col("col") / 11)) % 3 != 0
    tile = F.concat_ws("_", F.floor(F.col("row") / 25).cast("string"), F.floor(F.col("col") / 50).cast("string"))
    retained = grid20(spark, d).groupBy(tile.alias("tile")).agg(F.avg(keep.cast("double")).alias("retained_share"))
    return P.tile_quality(parcels(spark, d), retained)


@query("d37_tile_quality", with_ctes(*PARCELS, RET, TQ) + f"SELECT tile, parcel_count, {R('large_share')} AS large_share, {R('retained_share')} AS retained_share, cross_tile_count, {R('lim')} AS cross_limit, warning_count, warning_count > 0 AS review FROM tw")
def _(spark, d):
    return tile_table(spark, d).select("tile", "parcel_count", r("large_share").alias("large_share"), r("retained_share").alias("retained_share"), "cross_tile_count", r("cross_limit").alias("cross_limit"), "warning_count", "review")


@query("d36_robust_limit", with_ctes(*PARCELS, RET, TQ) + f"SELECT {R('max(lim)')} AS cross_limit FROM mad")
def _(spark, d):
    tiles = parcels(spark, d).groupBy("tile").agg(F.count_if(F.col("cross_tile")).alias("n"))
    return P.robust_limit(tiles, "n", "cross_limit").select(r("cross_limit").alias("cross_limit"))


@query("c16_before_after_tiles", with_ctes(*PARCELS, REP, SAFE) + """SELECT b.tile, b.n AS parcels_before, coalesce(a.n, 0) AS parcels_after, coalesce(a.n, 0) - b.n AS change FROM (SELECT tile, count(*) AS n FROM flg GROUP BY tile) b LEFT JOIN (SELECT tile, count(*) AS n FROM sta WHERE mapping_status <> 'excluded' GROUP BY tile) a USING (tile)""")
def _(spark, d):
    before = parcels(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("parcels_before"))
    after = safeguarded(spark, d).where("mapping_status <> 'excluded'").groupBy("tile").agg(F.count(F.lit(1)).alias("_a"))
    a = F.coalesce("_a", F.lit(0)).cast("bigint")
    return before.join(after, "tile", "left").select("tile", "parcels_before", a.alias("parcels_after"), (a - F.col("parcels_before")).alias("change"))


@query("g02_parcel_value_burn", with_ctes(*CELLS, ZON) + f"SELECT row, col, {R('arg_max(mean, parcel_id)')} AS mean FROM parcel_cells JOIN zon USING (parcel_id) GROUP BY ALL")
def _(spark, d):
    cells, grid = parcel_cells(spark, d), grid20(spark, d)
    means = cells.join(grid.select("row", "col", "p"), ["row", "col"]).groupBy("parcel_id").agg(F.avg("p").alias("mean"))
    return P.burn_last(cells, means, "parcel_id", "mean").select("row", "col", r("mean").alias("mean"))


@query("g03_priority_burn", with_ctes(*PARCELS) + "SELECT row, col, max(CASE class_by_mean WHEN 'positive' THEN 1 ELSE 0 END)::BIGINT AS code FROM parcel_cells JOIN flg USING (parcel_id) WHERE NOT edge GROUP BY ALL")
def _(spark, d):
    label = F.when(F.col("edge"), "abstain").otherwise(F.col("class_by_mean"))
    return P.burn_priority(parcel_cells(spark, d), parcels(spark, d).select("parcel_id", label.alias("label")), "label")


def ccl_sql(mask: str, extra: str = "") -> str:
    return f"""cel AS (SELECT row, col, row * 150 + col AS id {extra} FROM grid20 WHERE {mask}),
adj AS (SELECT a.id AS a, b.id AS b FROM cel a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN cel b ON b.row = a.row + dr AND b.col = a.col + dc)""".replace(
        f"FROM cel a, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc) JOIN cel b ON b.row = a.row + dr AND b.col = a.col + dc",
        "FROM (SELECT * FROM cel, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)) a JOIN cel b ON b.row = a.row + a.dr AND b.col = a.col + a.dc") + """,
rch(id, o) AS (SELECT id, id FROM cel UNION SELECT r.id, j.b FROM rch r JOIN adj j ON j.a = r.o),
cmp AS (SELECT id, min(o) AS comp, count(*) AS size FROM rch GROUP BY id)"""


def comp_cell():
    """Component id as the row-major index of its first cell."""
    parts = F.split("comp", ":")
    return F.element_at(parts, -2).cast("bigint") * 150 + F.element_at(parts, -1).cast("bigint")


@query("g07_connected_components", REC + ",\n".join([GRID20, ccl_sql("ref = 1")]) + " SELECT row, col, comp, size FROM cel JOIN cmp USING (id)")
def _(spark, d):
    out = cell_components(grid20(spark, d).where("ref = 1"))
    return out.select("row", "col", comp_cell().alias("comp"), "size")


@query("g15_mask_instances", REC + ",\n".join([GRID20, ccl_sql("lc = 4")]) + " SELECT row, col, comp FROM cel JOIN cmp USING (id) WHERE size * 400 >= 1200")
def _(spark, d):
    out = cell_components(grid20(spark, d).where("lc = 4")).where("size * 400 >= 1200")
    return out.select("row", "col", comp_cell().alias("comp"))


@query("b22_interior_large_patch", REC + ",\n".join([GRID20, ccl_sql("ref = 1"), "m AS (SELECT row, col, ref = 1 AS s FROM grid20)",
       "nb4 AS (SELECT row, col, s, (SELECT count(*) FROM m b WHERE b.s AND abs(b.row - a.row) + abs(b.col - a.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1) AS n FROM m a)".replace(
           "(SELECT count(*) FROM m b WHERE b.s AND abs(b.row - a.row) + abs(b.col - a.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1) AS n FROM m a",
           "coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT row + dr AS row, col + dc AS col, count(*) AS n FROM m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) AS o(dr, dc) WHERE s GROUP BY ALL) USING (row, col)"),
       "bd AS (SELECT row, col FROM nb4 WHERE (s AND n < 4) OR (NOT s AND n > 0))",
       "cl AS (SELECT g.row, g.col, g.ref FROM grid20 g WHERE (g.row, g.col) NOT IN (SELECT (row + dr, col + dc) FROM bd, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)))".replace("(g.row, g.col) NOT IN (SELECT (row + dr, col + dc)", "g.row * 1000 + g.col NOT IN (SELECT (row + dr) * 1000 + col + dc")])
       + " SELECT cl.row, cl.col FROM cl LEFT JOIN cmp ON cmp.id = cl.row * 150 + cl.col WHERE ref = 0 OR size >= 25")
def _(spark, d):
    g = grid20(spark, d)
    sizes = cell_components(g.where("ref = 1")).select("row", "col", "size")
    clear = G.boundary_clearance(g, F.col("ref") == 1).where("clear").select("row", "col")
    rows = g.select("row", "col", "ref").join(clear, ["row", "col"]).join(sizes, ["row", "col"], "left")
    return rows.where("ref = 0 OR size >= 25").select("row", "col")


def confidences(spark, d):
    return parcel_cells(spark, d).select("parcel_id").distinct().withColumn("confidence", hash_unit("conf", F.col("parcel_id")))


#: Instances in falling confidence with their cells, for the SQL that follows the sequential order step by step.
IN_ORDER = f"""it AS (SELECT parcel_id, row_number() OVER (ORDER BY any_value(conf) DESC, parcel_id) AS k, list(row * 150 + col ORDER BY row, col) AS cells
  FROM parcel_cells JOIN (SELECT parcel_id, {sql_md5(chr(39) + 'conf:' + chr(39) + ' || parcel_id')} / 4294967296e0 AS conf FROM (SELECT DISTINCT parcel_id FROM parcel_cells)) USING (parcel_id) GROUP BY parcel_id)"""


@query("g11_instance_deduplication", REC + ",\n".join([*CELLS, IN_ORDER,
       """st(i, kept, seen) AS (
    SELECT 0::BIGINT, []::STRUCT(id VARCHAR, cells BIGINT[], n BIGINT)[], []::STRUCT(id VARCHAR, kept VARCHAR)[]
    UNION ALL SELECT i + 1,
        CASE WHEN hit IS NULL THEN list_append(kept, {'id': parcel_id, 'cells': cells, 'n': 1::BIGINT})
             ELSE list_transform(kept, lambda x: CASE WHEN x.id = hit THEN {'id': x.id, 'cells': list_distinct(list_concat(x.cells, cells)), 'n': x.n + 1} ELSE x END) END,
        list_append(seen, {'id': parcel_id, 'kept': coalesce(hit, parcel_id)})
    FROM (SELECT i, kept, seen, parcel_id, cells, list_filter(kept, lambda x: len(list_intersect(x.cells, cells)) >= 0.15e0 * (len(x.cells) + len(cells) - len(list_intersect(x.cells, cells)))
                     AND len(list_intersect(x.cells, cells)) > 0 OR len(list_intersect(x.cells, cells)) >= 0.3e0 * least(len(x.cells), len(cells)))[1].id AS hit
          FROM st JOIN it ON k = i + 1)),
fin AS (SELECT kept, seen FROM st WHERE i = (SELECT max(k) FROM it)),
sup AS (SELECT x.id, len(x.cells) AS support, x.n FROM (SELECT unnest(kept) AS x FROM fin))"""]) + """
  SELECT x.id AS parcel_id, x.kept AS kept, sup.support AS support_cells, sup.n AS n_merged FROM (SELECT unnest(seen) AS x FROM fin) JOIN sup ON sup.id = x.kept""")
def _(spark, d):
    found, support = P.merge_instances(parcel_cells(spark, d), confidences(spark, d), 0.15, 0.30)
    grown = support.groupBy("kept").agg(F.count(F.lit(1)).alias("support_cells"))
    merged = found.groupBy("kept").agg(F.count(F.lit(1)).alias("n_merged"))
    return found.join(grown, "kept").join(merged, "kept").select("parcel_id", "kept", "support_cells", "n_merged")


@query("g12_conflict_resolution", REC + ",\n".join([*CELLS, IN_ORDER,
       """st(i, taken, parts) AS (
    SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(id VARCHAR, part BIGINT, size BIGINT)[]
    UNION ALL SELECT i + 1, list_concat(taken, list_transform(good, lambda x: x.c)), list_concat(parts, list_distinct(list_transform(good, lambda x: {'id': parcel_id, 'part': x.l, 'size': x.n})))
    FROM (SELECT i, taken, parts, parcel_id, list_filter(list_transform(ls, lambda x: {'c': x.c, 'l': x.l, 'n': len(list_filter(ls, lambda y: y.l = x.l))}), lambda x: x.n * 400 >= 2500) AS good
        FROM (SELECT i, taken, parts, parcel_id, list_reduce(list_prepend(list_transform(free, lambda c: {'c': c, 'l': c}), list_transform(free, lambda c: []::STRUCT(c BIGINT, l BIGINT)[])),
                lambda a, b: list_transform(a, lambda x: {'c': x.c, 'l': list_min(list_transform(list_filter(a, lambda y: y.c IN (x.c, x.c - 1, x.c + 1, x.c - 150, x.c + 150)), lambda y: y.l))})) AS ls
            FROM (SELECT i, taken, parts, parcel_id, list_filter(cells, lambda c: NOT list_contains(taken, c)) AS free FROM st JOIN it ON k = i + 1))))"""])
       + " SELECT x.id AS parcel_id, x.part AS part, x.size AS size FROM (SELECT unnest(parts) AS x FROM st WHERE i = (SELECT max(k) FROM it))")
def _(spark, d):
    from terraloom.operators.raster import CROSS
    parts = P.resolve_conflicts(parcel_cells(spark, d), confidences(spark, d), F.col("size") * 400 >= 2500, CROSS)
    return parts.groupBy("parcel_id", "comp").agg(F.max("size").alias("size")).select("parcel_id", comp_cell().alias("part"), "size")

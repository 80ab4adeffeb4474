"""Pixel-grid queries: decode, overlay, gates, focal statistics, block metrics, AOI windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.operators import raster as G
from terraloom.operators.attach import attach
from terraloom.plans.metrics import counts_sql, metric_list, metric_sql
from terraloom.plans.registry import R, query, r, with_ctes
from terraloom.sources.tables import GRID10, GRID20, grid10, grid20, sql_md5

GRID = with_ctes(GRID20)
PRODUCTS = """prod AS (SELECT row, col, lcw, ref = 1 AS ref, p, coalesce(p >= 0.5e0, false) AS M0, p IS NOT NULL AS M0_kept,
  coalesce(p >= 0.5e0 AND (row // 7 + col // 11) % 3 <> 0, false) AS M1, p IS NOT NULL AND (row // 7 + col // 11) % 3 <> 0 AS M1_kept,
  coalesce(p >= 0.5e0 AND (row // 7 + col // 11) % 3 <> 0 AND lcw IN (3, 4), false) AS M1b, p IS NOT NULL AND (row // 7 + col // 11) % 3 <> 0 AND lcw IN (3, 4) AS M1b_kept
  FROM grid20 WHERE p IS NOT NULL)"""
NAMES = ["M0", "M1", "M1b"]


def products(spark, d):
    pixel = grid20(spark, d).where("p IS NOT NULL")
    field = (F.floor(F.col("row") / 7) + F.floor(F.col("col") / 11)) % 3 != 0
    gate = F.col("lcw").isin(3, 4)
    pos = F.col("p") >= 0.5
    return pixel.select("row", "col", "lcw", (F.col("ref") == 1).alias("ref"), "p", pos.alias("M0"), F.lit(True).alias("M0_kept"),
                        (pos & field).alias("M1"), field.alias("M1_kept"), (pos & field & gate).alias("M1b"), (field & gate).alias("M1b_kept"))


@query("b08_valid_mask_and_prediction", GRID + "SELECT row, col, p IS NOT NULL AS valid, coalesce(p >= 0.5e0, false) AS pred FROM grid20")
def _(spark, d):
    rows = grid20(spark, d).withColumn("v", F.coalesce("p", F.lit(-9999.0)))
    return rows.select("row", "col", *[c.alias(n) for n, c in G.decode_probability(F.col("v"), -9999.0).items()])


CODES = "codes AS (SELECT row, col, CASE WHEN p IS NULL THEN 255 WHEN lc = 6 THEN 2 WHEN p >= 0.5e0 THEN 1 ELSE 0 END AS code FROM grid20)"


@query("b09_parcel_class_decode", with_ctes(GRID20, CODES) + "SELECT row, col, code <> 255 AS valid, code IN (0, 1) AS committed, code = 1 AS pred FROM codes")
def _(spark, d):
    code = F.when(F.col("p").isNull(), 255).when(F.col("lc") == 6, 2).when(F.col("p") >= 0.5, 1).otherwise(0)
    return grid20(spark, d).select("row", "col", *[c.alias(n) for n, c in G.decode_classes(code).items()])


@query("b10_common_grid_clip", with_ctes(GRID20, CODES) + "SELECT row, col, code = 1 AND row % 10 <> 9 AS pred_common, code IN (0, 1) AND row % 10 <> 9 AS retained_common FROM codes")
def _(spark, d):
    code = F.when(F.col("p").isNull(), 255).when(F.col("lc") == 6, 2).when(F.col("p") >= 0.5, 1).otherwise(0)
    decoded = G.decode_classes(code)
    common = grid20(spark, d).select("row", "col", (F.col("row") % 10 != 9).alias("common"))
    rows = common.join(grid20(spark, d).select("row", "col", *[c.alias(n) for n, c in decoded.items()]), ["row", "col"], "left")
    return rows.select("row", "col", F.coalesce(F.col("pred") & F.col("common"), F.lit(False)).alias("pred_common"), F.coalesce(F.col("committed") & F.col("common"), F.lit(False)).alias("retained_common"))


@query("c07_raster_overlay", GRID + f"SELECT a.row, a.col, {R('a.p', 9)} AS m0_p, {R('b.p', 9)} AS m1_p, {R('c.p', 9)} AS m1b_p, a.ref FROM grid20 a LEFT JOIN (SELECT * FROM grid20 WHERE row % 2 = 0) b USING (row, col) LEFT JOIN (SELECT * FROM grid20 WHERE lcw = 4) c USING (row, col)")
def _(spark, d):
    g = grid20(spark, d)
    out = G.overlay(g.select("row", "col", "ref"), {"m0": g.select("row", "col", "p"), "m1": g.where("row % 2 = 0").select("row", "col", "p"), "m1b": g.where("lcw = 4").select("row", "col", "p")})
    return out.select("row", "col", r("m0_p", 9).alias("m0_p"), r("m1_p", 9).alias("m1_p"), r("m1b_p", 9).alias("m1b_p"), "ref")


@query("c11_nearest_resample", GRID + "SELECT t.row, t.col, CAST(coalesce(s.ref, 0) > 0 AS BIGINT) AS label FROM grid20 t LEFT JOIN grid20 s ON s.row = CAST(floor((t.row + 0.5e0) * 0.66e0) AS BIGINT) AND s.col = CAST(floor((t.col + 0.5e0) * 0.66e0) AS BIGINT)")
def _(spark, d):
    g = grid20(spark, d)
    return G.resample_nearest(g, g, "ref", 0.66)


VOTES = "votes AS (SELECT row // 2 AS row, col // 2 AS col, count(*) FILTER (lc IN (3, 4)) AS votes, [" + ", ".join(f"count(*) FILTER (lc = {c})" for c in range(9)) + "] AS n FROM grid10 GROUP BY ALL)"


@query("c21_grid_alignment_votes", with_ctes(GRID10, VOTES) + "SELECT row, col, votes, votes >= 2 AS gate, CAST(list_position(n, list_max(n)) - 1 AS BIGINT) AS majority FROM votes")
def _(spark, d):
    return G.two_by_two(grid10(spark, d), "lc")


@query("d21_vote_gate_shares", with_ctes(GRID10, VOTES) + f"SELECT CAST(list_position(n, list_max(n)) - 1 AS BIGINT) AS majority, count(*) AS n, {R('avg(CASE WHEN votes >= 2 THEN 1e0 ELSE 0e0 END)')} AS gate_share FROM votes GROUP BY ALL")
def _(spark, d):
    return G.two_by_two(grid10(spark, d), "lc").groupBy("majority").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("gate").cast("double"))).alias("gate_share"))


@query("b12_dominant_class", with_ctes(GRID20, "f AS (SELECT row // 7 AS pr, col // 11 AS pc, [" + ", ".join(f"count(*) FILTER (lcw = {c})" for c in range(9)) + "] AS n FROM grid20 GROUP BY ALL)") + "SELECT pr, pc, CAST(list_position(n, list_max(n)) - 1 AS BIGINT) AS dominant FROM f")
def _(spark, d):
    from terraloom.operators.metrics import largest_of
    names = [f"n{c}" for c in range(9)]
    f = grid20(spark, d).groupBy(F.floor(F.col("row") / 7).alias("pr"), F.floor(F.col("col") / 11).alias("pc")).agg(*[F.count_if(F.col("lcw") == c).alias(f"n{c}") for c in range(9)])
    return f.select("pr", "pc", largest_of(names, list(range(9))).cast("bigint").alias("dominant"))


PAIRS = "SELECT a.row, a.col, a.{v} AS x, b.{v} AS y FROM {s} a JOIN {s} b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)"


def pairs_sql(v: str, s: str) -> str:
    return f"(SELECT a.{v} AS x, b.{v} AS y FROM {s} a JOIN {s} b ON b.row = a.row AND b.col = a.col + 1 UNION ALL SELECT a.{v}, b.{v} FROM {s} a JOIN {s} b ON b.row = a.row + 1 AND b.col = a.col)"


@query("d23_neighbor_disagreement", with_ctes(GRID20, PRODUCTS) + f"SELECT count(*) AS pairs, count(*) FILTER (x <> y) AS differing, {R('count(*) FILTER (x <> y)::DOUBLE / count(*)')} AS rate FROM {pairs_sql('M0', 'prod')}")
def _(spark, d):
    return G.neighbor_disagreement(products(spark, d), "M0").select("pairs", "differing", r("rate").alias("rate"))


@query("d24_fragmentation_reduction", with_ctes(GRID20, PRODUCTS, "par AS (SELECT row, col, avg(p) OVER (PARTITION BY row // 7, col // 11) >= 0.5e0 AS b FROM prod)") + f"""
  SELECT {R("(a - b) / greatest(a, 1e-12)")} AS reduction FROM (SELECT count(*) FILTER (x <> y)::DOUBLE / count(*) AS a FROM {pairs_sql('M0', 'prod')}), (SELECT count(*) FILTER (x <> y)::DOUBLE / count(*) AS b FROM {pairs_sql('b', 'par')})""")
def _(spark, d):
    rows = products(spark, d).select("row", "col", "p", "M0", F.floor(F.col("row") / 7).alias("pr"), F.floor(F.col("col") / 11).alias("pc"))
    means = rows.groupBy("pr", "pc").agg((F.avg("p") >= 0.5).alias("b"))
    raw = G.neighbor_disagreement(rows, "M0").select(F.col("rate").alias("a"))
    parcel = G.neighbor_disagreement(rows.join(means, ["pr", "pc"]), "b").select(F.col("rate").alias("b"))
    return attach(raw, parcel, []).select(r((F.col("a") - F.col("b")) / F.greatest("a", F.lit(1e-12))).alias("reduction"))


@query("d20_class_capture", with_ctes(GRID20, PRODUCTS) + f"SELECT lcw, count(*) AS n, {R('avg(CASE WHEN M1_kept THEN 1e0 ELSE 0e0 END)')} AS captured FROM prod GROUP BY lcw")
def _(spark, d):
    return products(spark, d).groupBy("lcw").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.col("M1_kept").cast("double"))).alias("captured"))


STAGES = " UNION ALL ".join(f"""SELECT '{g}' AS stage, {R(f'count(*) FILTER ({g}_kept)::DOUBLE / count(*)')} AS retained_share, count(*) FILTER (M0 AND {g}_kept) AS positives_kept,
  count(*) FILTER (M0 AND NOT {g}_kept) AS positives_removed, count(*) FILTER (p >= 0.8e0 AND NOT {g}_kept) AS strong_removed, {R(f'count(*) FILTER (M0 AND {g}_kept) * 0.04e0')} AS area FROM prod""" for g in ("M1", "M1b"))


@query("d22_gate_stage_summary", with_ctes(GRID20, PRODUCTS) + STAGES)
def _(spark, d):
    out = G.gate_stages(products(spark, d), "p", {"M1": F.col("M1_kept"), "M1b": F.col("M1b_kept")}, 0.5, 0.8, 0.04)
    return out.select("stage", r("retained_share").alias("retained_share"), "positives_kept", "positives_removed", "strong_removed", r("area").alias("area"))


@query("d50_positives_removed_by_class", with_ctes(GRID20, PRODUCTS) + f"SELECT lcw, count(*) AS removed, {R('count(*) / (SELECT count(*)::DOUBLE FROM prod WHERE M1 AND NOT M1b)')} AS share FROM prod WHERE M1 AND NOT M1b GROUP BY lcw")
def _(spark, d):
    by = products(spark, d).where("M1 AND NOT M1b").groupBy("lcw").agg(F.count(F.lit(1)).alias("removed"))
    return attach(by, by.agg(F.sum("removed").alias("all_")), []).select("lcw", "removed", r(F.col("removed") / F.col("all_")).alias("share"))


LONGP = "lp AS (SELECT row, col, ref, unnest(['M0', 'M1', 'M1b']) AS product, unnest([M0, M1, M1b]) AS pred, unnest([M0_kept, M1_kept, M1b_kept]) AS kept FROM prod)"
BLOCKS = f"""bk AS (SELECT least(row // ((SELECT max(row) + 1 FROM prod) // 4), 3) AS block_row, least(col // ((SELECT max(col) + 1 FROM prod) // 4), 3) AS block_col, * FROM lp),
bc AS (SELECT block_row, block_col, product, count(*) AS n_pixels, count(*) FILTER (kept)::DOUBLE / count(*) AS coverage, {counts_sql('pred', 'ref')} FROM bk GROUP BY ALL),
bm AS (SELECT *, {metric_sql()['f1']} AS f1, {metric_sql()['iou']} AS iou FROM bc WHERE n_pixels >= 50),
bd AS (SELECT *, CASE WHEN product <> 'M0' THEN f1 - max(f1) FILTER (product = 'M0') OVER (PARTITION BY block_row, block_col) END AS delta_f1 FROM bm)"""


@query("d25_block_grid_metrics", with_ctes(GRID20, PRODUCTS, LONGP, BLOCKS) + f"SELECT block_row, block_col, product, n_pixels, {R('coverage')} AS coverage, {R('f1')} AS f1, {R('iou')} AS iou, {R('delta_f1')} AS delta_f1 FROM bd")
def _(spark, d):
    out = G.block_metrics(products(spark, d), NAMES, F.col("ref"), 4, 50, "M0")
    return out.select("block_row", "block_col", "product", "n_pixels", *[r(c).alias(c) for c in ("coverage", "f1", "iou", "delta_f1")])


@query("d26_paired_block_summary", with_ctes(GRID20, PRODUCTS, LONGP, BLOCKS) + f"SELECT product, count(*) AS n_blocks, {R('quantile_cont(delta_f1, 0.5)')} AS median_delta, {R('avg(delta_f1)')} AS mean_delta, count(*) FILTER (delta_f1 > 0) AS improved, count(*) FILTER (delta_f1 < 0) AS worsened, count(*) FILTER (delta_f1 = 0) AS unchanged FROM bd WHERE delta_f1 IS NOT NULL GROUP BY product")
def _(spark, d):
    out = G.paired_block_summary(G.block_metrics(products(spark, d), NAMES, F.col("ref"), 4, 50, "M0"), "M0")
    return out.select("product", "n_blocks", r("median_delta").alias("median_delta"), r("mean_delta").alias("mean_delta"), "improved", "worsened", "unchanged")


@query("d27_full_and_retained_modes", with_ctes(GRID20, PRODUCTS, LONGP, f"""md AS (SELECT product, 'full_grid' AS mode, count(*) FILTER (kept) AS kp, count(*) AS n, {counts_sql('pred', 'ref')} FROM lp GROUP BY product UNION ALL SELECT product, 'retained', count(*), (SELECT count(*) FROM prod), {counts_sql('pred', 'ref')} FROM lp WHERE kept GROUP BY product)""") + f"""
  SELECT product, mode, {metric_list()}, {R('(tp + fp) * 0.04e0')} AS predicted_area, {R('kp::DOUBLE / n')} AS coverage, {R('(n - kp) * 0.04e0')} AS excluded_area FROM md""")
def _(spark, d):
    out = G.deployment_modes(products(spark, d), NAMES, F.col("ref"), 0.04)
    return out.select("product", "mode", *[r(c).alias(c) for c in out.columns if c not in ("product", "mode")])


NB = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in G.SQUARE) + ") AS o(dr, dc)"
NB4 = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in G.CROSS) + ") AS o(dr, dc)"


def around_sql(mask: str, nb: str, src: str = "grid20") -> str:
    return f"SELECT g.row, g.col, CAST(g.{mask} AS BIGINT) AS self, CAST(coalesce(sum(CASE WHEN n.{mask} THEN 1 ELSE 0 END), 0) AS BIGINT) AS around FROM {src} g, {nb} LEFT JOIN {src} n ON n.row = g.row + dr AND n.col = g.col + dc GROUP BY ALL".replace(f"{src} g, {nb} LEFT", f"(SELECT * FROM {src}, {nb}) g LEFT")


@query("g04_class_edge_density", with_ctes(GRID20, "m AS (SELECT row, col, lcw = 4 AS crop FROM grid20)", f"f AS ({around_sql('crop', NB, 'm')})") + f"SELECT count(*) AS crop_pixels, count(*) FILTER (around < 8) AS edge_pixels, {R('count(*) FILTER (around < 8)::DOUBLE / (SELECT count(*) FROM grid20)')} AS density FROM f WHERE self = 1")
def _(spark, d):
    g = grid20(spark, d)
    edges = G.class_edges(g, F.col("lcw") == 4).agg(F.count(F.lit(1)).alias("crop_pixels"), F.count_if(F.col("edge")).alias("edge_pixels"))
    return attach(edges, g.agg(F.count(F.lit(1)).alias("n")), []).select("crop_pixels", "edge_pixels", r(F.col("edge_pixels") / F.col("n")).alias("density"))


@query("g06_boundary_clearance", with_ctes(GRID20, "m AS (SELECT row, col, ref = 1 AS s FROM grid20)", f"f AS ({around_sql('s', NB4, 'm')})", "b AS (SELECT row, col, (self = 1 AND around < 4) OR (self = 0 AND around > 0) AS s FROM f)", f"n AS ({around_sql('s', NB, 'b')})") + "SELECT row, col, self = 1 AS boundary, self + around = 0 AS clear FROM n")
def _(spark, d):
    return G.boundary_clearance(grid20(spark, d), F.col("ref") == 1)


@query("g13_tile_positions", with_ctes(GRID20, "s AS (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM grid20)", "a AS (SELECT 'row' AS axis, unnest(CASE WHEN nr <= 64 THEN [0::BIGINT] ELSE list_distinct(list_append(range(0, nr - 64 + 1, 48), nr - 64)) END) AS start FROM s UNION ALL SELECT 'col', unnest(list_distinct(list_append(range(0, nc - 64 + 1, 48), nc - 64))) FROM s)") + "SELECT axis, start FROM a")
def _(spark, d):
    shape = G.grid_shape(grid20(spark, d))
    axes = shape.select(F.explode(F.array(F.struct(F.lit("row").alias("axis"), F.col("n_rows").alias("n")), F.struct(F.lit("col").alias("axis"), F.col("n_cols").alias("n")))).alias("a")).select("a.*")
    return axes.select("axis", F.explode(G.tile_positions(F.col("n"), 64, 48)).alias("start"))


TILES = """tiles AS (SELECT 'r' || printf('%02d', tr) || 'c' || printf('%02d', tc) AS tile, tr * 25 AS core_r0, least(tr * 25 + 25, nr) AS core_r1, tc * 50 AS core_c0, least(tc * 50 + 50, nc) AS core_c1,
  greatest(tr * 25 - 3, 0) AS halo_r0, least(least(tr * 25 + 25, nr) + 3, nr) AS halo_r1, greatest(tc * 50 - 3, 0) AS halo_c0, least(least(tc * 50 + 50, nc) + 3, nc) AS halo_c1
  FROM (SELECT nr, nc, tr, unnest(range(0, (nc - 1) // 50 + 1)) AS tc FROM (SELECT nr, nc, unnest(range(0, (nr - 1) // 25 + 1)) AS tr FROM (SELECT max(row) + 1 AS nr, max(col) + 1 AS nc FROM grid20))))"""


@query("g14_tile_index", with_ctes(GRID20, TILES) + "SELECT * FROM tiles")
def _(spark, d):
    return G.tile_index(G.grid_shape(grid20(spark, d)), 25, 50, 3)


@query("c14_core_mosaic", GRID + "SELECT row, col, lc FROM grid20")
def _(spark, d):
    g = grid20(spark, d).select("row", "col", "lc")
    near = lambda c, core, low: F.floor((F.col(c) + (-3 if low else 3)) / core)
    tr = F.explode(F.sequence(F.greatest(near("row", 25, True), F.lit(0).cast("bigint")), near("row", 25, False)))
    tc = F.explode(F.sequence(F.greatest(near("col", 50, True), F.lit(0).cast("bigint")), near("col", 50, False)))
    halos = g.withColumn("tr", tr).withColumn("tc", tc).withColumn("tile", F.format_string("r%02dc%02d", "tr", "tc"))
    return G.owned_by_core(halos, "tile", 25, 50).select("row", "col", "lc")


AOI = f"""w AS (SELECT r0, c0 FROM (SELECT unnest(range(0, (SELECT max(row) + 1 FROM grid20) - 20 + 1, 5)) AS r0), (SELECT unnest(range(0, (SELECT max(col) + 1 FROM grid20) - 20 + 1, 5)) AS c0)),
m AS (SELECT row, col, lcw, lcw = 4 AS crop FROM grid20), f AS ({around_sql('crop', NB, 'm')}),
px AS (SELECT r0, c0, m.lcw, f.self = 1 AND (f.around < 8 OR m.row IN (r0, r0 + 19) OR m.col IN (c0, c0 + 19)) AS e FROM w JOIN m ON m.row >= r0 AND m.row < r0 + 20 AND m.col >= c0 AND m.col < c0 + 20 JOIN f ON f.row = m.row AND f.col = m.col),
sh AS (SELECT r0, c0, {', '.join(f'count(*) FILTER (lcw = {c}) / 400e0 AS f{c}' for c in range(9))}, count(*) FILTER (e) / 400e0 AS edge FROM px GROUP BY ALL HAVING count(*) = 400),
sd AS (SELECT *, {' + '.join(f'CAST(f{c} >= 0.01e0 AS BIGINT)' for c in range(8))} AS diversity FROM sh),
sc AS (SELECT *, f4 BETWEEN 0.30e0 AND 0.82e0 AND f0 >= 0.01e0 AND f6 >= 0.01e0 AND f1 + f2 + f5 >= 0.02e0 AND diversity >= 4 AS eligible,
  2.2e0 * f4 + 6 * edge + 1.5e0 * least(f0, 0.1e0) + 1.5e0 * least(f6, 0.1e0) + 0.8e0 * least(f1 + f2 + f5, 0.15e0) + 0.03e0 * diversity AS score FROM sd)"""


@query("g05_aoi_window_scores", with_ctes(GRID20, AOI) + f"SELECT r0 AS row, c0 AS col, {R('f4')} AS crop_share, {R('edge')} AS edge_density, diversity, eligible, {R('score')} AS score FROM sc")
def _(spark, d):
    out = G.window_scores(grid20(spark, d), "lcw", 5, 4)
    return out.select("row", "col", r("crop_share").alias("crop_share"), r("edge_density").alias("edge_density"), "diversity", "eligible", r("score").alias("score"))


@query("c18_rectangle_exclusion", with_ctes(GRID20, AOI) + f"SELECT r0 AS row, c0 AS col, {R('score')} AS score FROM sc WHERE eligible AND sqrt(pow(greatest(0, 40 - (c0 + 20), c0 - 60), 2) + pow(greatest(0, 30 - (r0 + 20), r0 - 50), 2)) * 20 >= 200")
def _(spark, d):
    wins = G.window_scores(grid20(spark, d), "lcw", 5, 4).where("eligible")
    dx = F.greatest(F.lit(0), 40 - (F.col("col") + 20), F.col("col") - 60)
    dy = F.greatest(F.lit(0), 30 - (F.col("row") + 20), F.col("row") - 50)
    return wins.where(F.sqrt((dx * dx + dy * dy).cast("double")) * 20 >= 200).select("row", "col", r("score").alias("score"))


@query("s04_mask_intersection_difference", with_ctes(GRID20, PRODUCTS) + "SELECT row, col, 'both' AS part FROM prod WHERE M0 AND lcw = 4 UNION ALL SELECT row, col, 'only_first' FROM prod WHERE M0 AND lcw <> 4")
def _(spark, d):
    rows = products(spark, d)
    a, b = rows.where("M0").select("row", "col"), rows.where("lcw = 4").select("row", "col")
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).withColumn("part", F.lit("only_first")))


@query("d33_pearson_mean_median", with_ctes(GRID20, "z AS (SELECT row // 7 AS a, col // 11 AS b, avg(p) AS m, quantile_cont(p, 0.5) AS q FROM grid20 WHERE p IS NOT NULL GROUP BY ALL)") + f"SELECT {R('corr(m, q)')} AS pearson, {R('avg(abs(m - q))')} AS mean_abs_diff, count(*) AS n FROM z")
def _(spark, d):
    from terraloom.operators.ordering import exact_quantiles
    rows = grid20(spark, d).where("p IS NOT NULL").select("p", F.floor(F.col("row") / 7).alias("a"), F.floor(F.col("col") / 11).alias("b"))
    z = exact_quantiles(rows, ["a", "b"], "p", {"q": 0.5}).join(rows.groupBy("a", "b").agg(F.avg("p").alias("m")), ["a", "b"])
    return z.agg(r(F.corr("m", "q")).alias("pearson"), r(F.avg(F.abs(F.col("m") - F.col("q")))).alias("mean_abs_diff"), F.count(F.lit(1)).alias("n"))

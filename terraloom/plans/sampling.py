"""Sampler, split and draw-contract queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraloom.functions.hashing import md5_int
from terraloom.operators import contracts as K
from terraloom.operators import sampling as S
from terraloom.operators.attach import attach
from terraloom.operators.ordering import ranked_rows, top_rows
from terraloom.plans.registry import R, query, r, with_ctes, row_text
from terraloom.sources.tables import GRID20, MANIFEST, POOL, SAMPLES, grid20, manifest, pool, samples, sql_md5, sql_md5_wide

SQL_P = with_ctes(POOL)
ORDER = lambda seed, key="sample_id": sql_md5(f"concat_ws(':', {seed}, {key})")


@query("e08_one_per_block", SQL_P + f"SELECT class_id, block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id, block ORDER BY {ORDER(5)}, sample_id) AS k FROM pool) WHERE k = 1")
def _(spark, d):
    return S.one_per_block(pool(spark, d), ["class_id"], "block", "sample_id", 5).select("class_id", "block", "sample_id")


FIRSTS = f"f AS (SELECT *, {ORDER(6)} AS h, row_number() OVER (PARTITION BY class_id, block ORDER BY {ORDER(6)}, sample_id) AS k FROM pool)"


@query("e09_blocks_first_sampler", with_ctes(POOL, FIRSTS) + "SELECT class_id, block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY k > 1, h, sample_id) AS n FROM f) WHERE n <= 250")
def _(spark, d):
    return S.require_rows(S.blocks_first(pool(spark, d), ["class_id"], "block", "sample_id", 250, 6).select("class_id", "block", "sample_id"), "class_id", {0: 250, 1: 250})


@query("e10_distributed_sampler", with_ctes(POOL, FIRSTS) + f"""SELECT class_id, block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY k, {sql_md5("concat_ws(':', 6, 'block', block)")}, sample_id) AS n FROM f) WHERE n <= 250""")
def _(spark, d):
    return S.balanced_draw(pool(spark, d), "distributed", "class_id", "block", "sample_id", 500, 6).select("class_id", "block", "sample_id")


@query("e11_clustered_sampler", with_ctes(POOL, FIRSTS) + f"""SELECT class_id, block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {sql_md5("concat_ws(':', 6, 'block', block)")}, h, sample_id) AS n FROM f) WHERE n <= 250""")
def _(spark, d):
    return S.balanced_draw(pool(spark, d), "clustered", "class_id", "block", "sample_id", 500, 6).select("class_id", "block", "sample_id")


@query("e12_class_matched_sample", SQL_P + f"SELECT class_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {ORDER(7)}, sample_id) AS n FROM pool) WHERE n <= CASE WHEN class_id = 1 THEN 120 ELSE 300 END")
def _(spark, d):
    return S.matched_by_class(pool(spark, d), "class_id", "sample_id", {0: 300, 1: 120}, 7).select("class_id", "sample_id")


@query("e13_weak_label_sample", SQL_P + f"""SELECT class_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {ORDER(9)}, sample_id) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY {ORDER(8)}, sample_id) AS n FROM pool) WHERE n <= 300 AND p > 0.15e0) WHERE m <= 200""")
def _(spark, d):
    rows = top_rows(pool(spark, d), ["class_id"], md5_int(8, F.col("sample_id")), F.col("sample_id"), 300).drop("rank")
    kept = top_rows(rows.where(F.col("p") > 0.15), ["class_id"], md5_int(9, F.col("sample_id")), F.col("sample_id"), 200)
    return S.require_rows(kept.select("class_id", "sample_id"), "class_id", {0: 200, 1: 200})


STRATA = """cand AS (SELECT row, col, row * 150 + col AS cell, (row // 20) || '_' || (col // 20) AS block, CAST(p >= 0.5e0 AS BIGINT) AS map_class,
  CASE WHEN greatest(p, 1 - p) < 0.6e0 THEN 'uncertain' WHEN greatest(p, 1 - p) < 0.8e0 THEN 'medium' ELSE 'high' END AS stratum FROM grid20 WHERE p IS NOT NULL)"""


def candidates(spark, d):
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    return grid20(spark, d).where("p IS NOT NULL").select(
        "row", "col", (F.col("row") * 150 + F.col("col")).alias("cell"), S.spatial_block_id(F.col("row"), F.col("col"), 20).alias("block"),
        (F.col("p") >= 0.5).cast("bigint").alias("map_class"), F.when(conf < 0.6, "uncertain").when(conf < 0.8, "medium").otherwise("high").alias("stratum"))


@query("b11_confidence_strata", with_ctes(GRID20, STRATA) + "SELECT row, col, map_class, stratum FROM cand")
def _(spark, d):
    return candidates(spark, d).select("row", "col", "map_class", "stratum")


@query("e14_dispersed_candidates", with_ctes(GRID20, STRATA, f"""f AS (SELECT *, {ORDER(10, 'cell')} AS h, row_number() OVER (PARTITION BY map_class, stratum, block ORDER BY {ORDER(10, 'cell')}, cell) AS k FROM cand)""") + """
  SELECT map_class, stratum, row, col FROM (SELECT *, row_number() OVER (PARTITION BY map_class, stratum ORDER BY k > 1, h, cell) AS n FROM f) WHERE n <= 50""")
def _(spark, d):
    return S.blocks_first(candidates(spark, d), ["map_class", "stratum"], "block", "cell", 50, 10).select("map_class", "stratum", "row", "col")


def prop_sql(tag: str, source: str, n: str, seed: int) -> str:
    """CTEs `{tag}_take` and `{tag}`: proportional sample of n rows over blocks."""
    return f"""{tag}_n AS (SELECT CAST({n} AS BIGINT) AS n),
{tag}_s AS (SELECT block, count(*) AS sz, sum(count(*)) OVER () AS tot, count(*) OVER () AS g FROM {source} GROUP BY block),
{tag}_x AS (SELECT *, n::DOUBLE * sz / tot AS ex, CASE WHEN tot <= n THEN sz WHEN n >= g THEN greatest(CAST(floor(n::DOUBLE * sz / tot) AS BIGINT), 1) ELSE CAST(floor(n::DOUBLE * sz / tot) AS BIGINT) END AS base FROM {tag}_s, {tag}_n),
{tag}_o AS (SELECT *, sum(base) OVER () - least(n, tot) AS ovr, ex - base AS rem, {sql_md5_wide('block::VARCHAR')} AS tie FROM {tag}_x),
{tag}_c AS (SELECT block, -count(*) AS delta FROM (SELECT block, ovr, row_number() OVER (ORDER BY rem + st, tie, st) AS k FROM (SELECT *, unnest(range(0, base - 1)) AS st FROM {tag}_o WHERE ovr > 0 AND base > 1)) WHERE k <= ovr GROUP BY block),
{tag}_a AS (SELECT block, 1 AS delta FROM (SELECT block, ovr, row_number() OVER (ORDER BY -rem, tie) AS k FROM {tag}_o WHERE ovr < 0 AND base < sz) WHERE k <= -ovr),
{tag}_take AS (SELECT block, CAST(base + coalesce(delta, 0) AS BIGINT) AS take FROM {tag}_o LEFT JOIN (SELECT * FROM {tag}_c UNION ALL SELECT * FROM {tag}_a) USING (block)),
{tag} AS (SELECT sample_id, block FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY {ORDER(seed)}, sample_id) AS k FROM {source}) JOIN {tag}_take USING (block) WHERE k <= take)"""


@query("e15_proportional_allocation", with_ctes(POOL, prop_sql("t", "pool", "203", 11)) + "SELECT block, take FROM t_take")
def _(spark, d):
    return S.proportional_allocation(pool(spark, d), "block", 203)


@query("e15_proportional_minimum_one", with_ctes(POOL, "src AS (SELECT sample_id, CASE WHEN sample_id % 100 < 90 THEN 0 ELSE block END AS block FROM pool)", prop_sql("t", "src", "64", 11)) + "SELECT block, sample_id FROM t")
def _(spark, d):
    skewed = pool(spark, d).select("sample_id", F.when(F.col("sample_id") % 100 < 90, F.lit(0)).otherwise(F.col("block")).cast("bigint").alias("block"))
    return S.proportional_sample(skewed, "block", "sample_id", 64, 11).select("block", "sample_id")


@query("e16_priority_strata", with_ctes(POOL, "s1 AS (SELECT * FROM pool WHERE p > 0.95e0)", prop_sql("a", "s1", "(SELECT least(20, count(*)) FROM s1)", 12),
       "s2 AS (SELECT * FROM pool WHERE p > 0.9e0 AND sample_id NOT IN (SELECT sample_id FROM a))", prop_sql("b", "s2", "(SELECT least(50, count(*)) FROM s2)", 12),
       "s3 AS (SELECT * FROM pool WHERE sample_id NOT IN (SELECT sample_id FROM a UNION ALL SELECT sample_id FROM b))",
       prop_sql("c", "s3", "200 - (SELECT count(*) FROM a) - (SELECT count(*) FROM b)", 12),
       "u AS (SELECT 'extreme' AS stratum, 1 AS pr, * FROM a UNION ALL SELECT 'high', 2, * FROM b UNION ALL SELECT 'fill', 3, * FROM c)") + """
  SELECT 'CMV-' || printf('%04d', row_number() OVER (ORDER BY pr, sample_id)) AS validation_id, stratum, block, sample_id FROM u""")
def _(spark, d):
    rows = S.priority_strata(pool(spark, d).drop("class_id"), "block", "sample_id",
                             [("extreme", F.col("p") > 0.95, 20), ("high", F.col("p") > 0.9, 50)], 200, 12)
    order = F.when(F.col("stratum") == "extreme", 1).when(F.col("stratum") == "high", 2).otherwise(3)
    return S.numbered(rows, order, F.col("sample_id"), "validation_id", "CMV-%04d")


@query("e17_spatial_blocks", with_ctes(MANIFEST) + "SELECT sample_id, CAST(floor(longitude / 0.05e0) AS BIGINT) || '_' || CAST(floor(latitude / 0.05e0) AS BIGINT) AS block FROM manifest")
def _(spark, d):
    return manifest(spark, d).select("sample_id", S.spatial_block_id(F.col("longitude"), F.col("latitude"), 0.05).alias("block"))


def split_sql(tag: str, source: str, fraction: float, seed: int, tries: int) -> str:
    return f"""{tag}_g AS (SELECT block, count(*) AS n, sum(class_id) AS pos FROM {source} GROUP BY block),
{tag}_r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {sql_md5(f"concat_ws(':', t + {seed}, block)")}, {sql_md5_wide('block::VARCHAR')}) <= ceil(count(*) OVER (PARTITION BY t) * {fraction!r}e0) AS held FROM {tag}_g, range(0, {tries}) AS x(t)),
{tag}_m AS (SELECT t, sum(n) FILTER (NOT held)::DOUBLE AS nl, sum(pos) FILTER (NOT held)::DOUBLE AS pl, sum(n) FILTER (held)::DOUBLE AS nr, sum(pos) FILTER (held)::DOUBLE AS pr FROM {tag}_r GROUP BY t),
{tag} AS (SELECT block, held FROM {tag}_r WHERE t = (SELECT t FROM {tag}_m WHERE pl > 0 AND pl < nl AND pr > 0 AND pr < nr ORDER BY abs(pl / nl - (pl + pr) / (nl + nr)) + abs(pr / nr - (pl + pr) / (nl + nr)), t LIMIT 1))"""


SPLIT = [POOL, split_sql("one", "pool", 0.2, 42, 100), "rest AS (SELECT * FROM pool WHERE block IN (SELECT block FROM one WHERE NOT held))",
         split_sql("two", "rest", 0.2 / (1 - 0.2), 1042, 100)]


@query("e18_group_disjoint_split", with_ctes(*SPLIT) + "SELECT one.block, CASE WHEN one.held THEN 'test' WHEN two.held THEN 'val' ELSE 'train' END AS split FROM one LEFT JOIN two USING (block)")
def _(spark, d):
    return S.train_val_test(pool(spark, d), "block", "class_id", 0.2, 0.2, 42)


@query("e19_group_folds", SQL_P + f"SELECT block, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS BIGINT) AS fold FROM (SELECT block, row_number() OVER (ORDER BY -count(*), {sql_md5_wide('block::VARCHAR')}) - 1 AS k FROM pool GROUP BY block)")
def _(spark, d):
    return S.group_folds(pool(spark, d), "block", 5)


@query("e20_pseudo_label_selection", SQL_P + f"SELECT sample_id, CAST(p >= 0.5e0 AS BIGINT) AS pseudo, {R('conf', 9)} AS confidence FROM (SELECT *, greatest(p, 1 - p) AS conf, row_number() OVER (ORDER BY -greatest(p, 1 - p), {ORDER(13)}, sample_id) AS k FROM pool WHERE greatest(p, 1 - p) >= 0.95e0) WHERE k <= 850")
def _(spark, d):
    out = S.confident_rows(pool(spark, d), "p", "sample_id", 0.95, 850, 13)
    return out.select("sample_id", "pseudo", r("confidence", 9).alias("confidence"))


@query("e20_pseudo_label_per_class", with_ctes(POOL, "c AS (SELECT *, CASE WHEN p >= 0.9e0 THEN 1 WHEN p <= 1 - 0.9e0 THEN 0 END::BIGINT AS pseudo FROM pool)",
       "k AS (SELECT *, row_number() OVER (PARTITION BY pseudo ORDER BY -abs(p - 0.5e0), sample_id) AS n FROM c WHERE pseudo IS NOT NULL)") + """
  SELECT sample_id, pseudo FROM k WHERE n <= least(1000, (SELECT count(*) FROM c WHERE pseudo = 1), (SELECT count(*) FROM c WHERE pseudo = 0))""")
def _(spark, d):
    return S.confident_per_class(pool(spark, d), "p", "sample_id", 0.9, 1000).select("sample_id", "pseudo")


@query("e22_sequential_ids", with_ctes(GRID20) + "SELECT 'SH_W_' || printf('%05d', row_number() OVER (ORDER BY row, col) - 1) AS sample_id, row, col FROM grid20 WHERE ref = 1")
def _(spark, d):
    rows = grid20(spark, d).where("ref = 1").select("row", "col")
    return S.numbered(rows, F.col("row"), F.col("col"), "sample_id", "SH_W_%05d", first=0)


@query("c19_parameter_grid", with_ctes(POOL, "reg AS (SELECT DISTINCT block % 3 AS regime FROM pool)") + "SELECT regime, seed, budget FROM reg, (VALUES (42::BIGINT), (43), (44)) AS s(seed), (VALUES (50::BIGINT), (100), (500)) AS b(budget)")
def _(spark, d):
    regimes = pool(spark, d).select((F.col("block") % 3).alias("regime")).distinct()
    return S.parameter_grid(regimes, {"seed": [42, 43, 44], "budget": [50, 100, 500]})


@query("c19_representation_pairs", "WITH rep AS (SELECT DISTINCT p_brand AS name FROM part) SELECT a.name AS rep_a, b.name AS rep_b FROM rep a JOIN rep b ON a.name < b.name")
def _(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("name")).distinct()
    return S.unordered_pairs(names, "name", "rep_a", "rep_b")


@query("d01_split_counts", with_ctes(SAMPLES) + f"SELECT split, class_id, count(*) AS n, min(sample_id) AS first_id, max(sample_id) AS last_id, {R('min(x[1])')} AS min_x, {R('max(x[1])')} AS max_x, count(*) FILTER (x[1] IS NULL) AS missing FROM samples GROUP BY split, class_id")
def _(spark, d):
    return samples(spark, d).groupBy("split", "class_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"),
        r(F.min(F.col("x")[0])).alias("min_x"), r(F.max(F.col("x")[0])).alias("max_x"), F.count_if(F.col("x")[0].isNull()).alias("missing"))


@query("d02_leakage_audit", SQL_P + "SELECT block, count(DISTINCT sample_id % 4 // 3) AS n_splits FROM pool GROUP BY block HAVING count(DISTINCT sample_id % 4 // 3) > 1")
def _(spark, d):
    rows = pool(spark, d).withColumn("split", F.floor((F.col("sample_id") % 4) / 3))
    return K.groups_crossing(rows, "block", "split")


DUP = f"r AS (SELECT l_orderkey AS sample_id, l_linenumber AS part, l_suppkey % 20 AS block, sha256({row_text('l_quantity::BIGINT', 'l_linestatus', 'l_returnflag', 'l_discount')}) AS h FROM lineitem)"


def dup_rows(spark, d):
    from terraloom.functions.hashing import row_digest
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("part"), (F.col("l_suppkey") % 20).alias("block"),
        row_digest(F.col("l_quantity").cast("bigint"), "l_linestatus", "l_returnflag", "l_discount").alias("h"))


@query("d03_duplicate_audit", f"""WITH {DUP}
  SELECT 'duplicate_keys' AS check_name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM r GROUP BY sample_id, part HAVING count(*) > 1) UNION ALL
  SELECT 'duplicate_features', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY h HAVING count(*) > 1) UNION ALL
  SELECT 'features_crossing_blocks', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM r GROUP BY h HAVING count(DISTINCT block) > 1)""")
def _(spark, d):
    return K.duplicate_audit(dup_rows(spark, d), ["sample_id", "part"], "h", "block")


@query("d43_draw_summary", with_ctes(POOL, FIRSTS, f"""dr AS (SELECT class_id, block, sample_id, sha256({row_text('sample_id')}) AS h FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY k > 1, h, sample_id) AS n FROM f) WHERE n <= 250)""") + f"""
  SELECT class_id, count(DISTINCT block) AS n_blocks, count(*) AS n_rows, sha256(concat_ws(':', count(*), {', '.join(f"sum(CAST(('0x' || substr(h, {1 + 12 * i}, 12)) AS UBIGINT)::HUGEINT)" for i in range(5))})) AS digest FROM dr GROUP BY class_id""")
def _(spark, d):
    draw = S.blocks_first(pool(spark, d), ["class_id"], "block", "sample_id", 250, 6)
    return S.draw_summary(draw, ["class_id"], "block", "sample_id")


@query("k01_manifest_contract", with_ctes(SAMPLES) + """SELECT 'unique_key' AS check_name, count(*) = count(DISTINCT sample_id) AS ok, count(*) - count(DISTINCT sample_id) AS observed FROM samples UNION ALL
  SELECT 'block_disjoint', coalesce(max(n), 0) <= 1, count(*) FILTER (n > 1) FROM (SELECT count(DISTINCT split) AS n FROM samples GROUP BY region, block) UNION ALL
  SELECT 'binary_classes', count(*) FILTER (class_id NOT IN (0, 1)) = 0, count(*) FILTER (class_id NOT IN (0, 1)) FROM samples UNION ALL
  SELECT 'region_matches_split', count(*) FILTER ((region = 'source') <> starts_with(split, 'source_')) = 0, count(*) FILTER ((region = 'source') <> starts_with(split, 'source_')) FROM samples""")
def _(spark, d):
    return K.manifest_contract(samples(spark, d))


@query("k03_draw_contract", with_ctes(POOL, FIRSTS, f"""dr AS (SELECT class_id, block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY k, {sql_md5("concat_ws(':', 6, 'block', block)")}, sample_id) AS n FROM f) WHERE n <= 250)""") + """
  SELECT 'size' AS check_name, count(*) = 500 AS ok, count(*) AS observed FROM dr UNION ALL SELECT 'unique', count(*) = count(DISTINCT sample_id), count(DISTINCT sample_id) FROM dr UNION ALL
  SELECT 'balanced', CAST(sum(class_id) AS BIGINT) * 2 = count(*), CAST(sum(class_id) AS BIGINT) FROM dr UNION ALL SELECT 'pool_only', count(*) = 0, count(*) FROM dr WHERE sample_id NOT IN (SELECT sample_id FROM pool)""")
def _(spark, d):
    rows = pool(spark, d)
    draw = S.balanced_draw(rows, "distributed", "class_id", "block", "sample_id", 500, 6)
    return K.draw_contract(draw, rows, "sample_id", "class_id", 500)


@query("c22_semi_join_blocks", with_ctes(POOL, "chosen AS (SELECT DISTINCT block FROM pool WHERE p > 0.98e0)") + "SELECT sample_id, block IN (SELECT block FROM chosen) AS tuned FROM pool")
def _(spark, d):
    rows = pool(spark, d)
    chosen = rows.where(F.col("p") > 0.98).select("block").distinct()
    kept = rows.join(chosen, "block", "left_semi").select("sample_id", F.lit(True).alias("tuned"))
    return kept.unionByName(rows.join(chosen, "block", "left_anti").select("sample_id", F.lit(False).alias("tuned")))


@query("c03_anti_join", with_ctes(POOL, FIRSTS) + "SELECT sample_id FROM f WHERE k > 1")
def _(spark, d):
    rows = pool(spark, d)
    return rows.join(S.one_per_block(rows, ["class_id"], "block", "sample_id", 6).select("sample_id"), "sample_id", "left_anti").select("sample_id")


@query("s02_first_per_key", SQL_P + "SELECT block, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY sample_id) AS k FROM pool) WHERE k = 1")
def _(spark, d):
    return S.first_per_group(pool(spark, d), ["block"], F.col("sample_id"), "sample_id").withColumnRenamed("_first", "sample_id")


@query("b03_split_selection", with_ctes(SAMPLES) + "SELECT split, sample_id FROM samples WHERE region = 'target'")
def _(spark, d):
    return K.nonempty_splits(samples(spark, d).where("region = 'target'"), "split", ["target_pool", "target_val"]).select("split", "sample_id")


@query("f01_multi_key_ranking", with_ctes(POOL, "b AS (SELECT block, count(*) AS n, CAST(sum(class_id) AS BIGINT) AS pos FROM pool GROUP BY block)") + "SELECT block, n, pos FROM b ORDER BY pos DESC, n, block LIMIT 10")
def _(spark, d):
    return pool(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("class_id").alias("pos")).orderBy(F.desc("pos"), "n", "block").limit(10)


@query("f02_top_three_per_class", SQL_P + f"SELECT class_id, sample_id, {R('p', 9)} AS p FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY -p, sample_id) AS k FROM pool) WHERE k <= 3")
def _(spark, d):
    return top_rows(pool(spark, d), ["class_id"], -F.col("p"), F.col("sample_id"), 3).select("class_id", "sample_id", r("p", 9).alias("p"))


@query("f03_good_and_bad_exemplar", with_ctes(POOL, f"b AS (SELECT block, {R('avg(p)')} AS m, count(*) AS n FROM pool GROUP BY block)") + """
  SELECT 'bad' AS kind, block FROM (SELECT block FROM b ORDER BY m DESC, n DESC, block DESC LIMIT 1) UNION ALL SELECT 'good', block FROM (SELECT block FROM b ORDER BY m, n, block LIMIT 1)""")
def _(spark, d):
    b = pool(spark, d).groupBy("block").agg(r(F.avg("p")).alias("m"), F.count(F.lit(1)).alias("n"))
    key = F.struct("m", "n", "block")
    ends = b.agg(F.max_by("block", key).alias("bad"), F.min_by("block", key).alias("good"))
    return ends.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("block")) for k in ("bad", "good")])).alias("e")).select("e.*")


@query("f04_row_major_order_check", with_ctes(GRID20, "k AS (SELECT row, col, row_number() OVER (ORDER BY row, col) - 1 AS pos FROM grid20)") + "SELECT count(*) AS n, count(*) FILTER (pos <> row * 150 + col) AS misplaced, count(*) FILTER (pos = row * 150 + col) = count(*) AS exact_order FROM k")
def _(spark, d):
    ranked = ranked_rows(grid20(spark, d).select("row", "col"), [], F.col("row"), F.col("col"), "pos")
    wrong = F.col("pos") - 1 != F.col("row") * 150 + F.col("col")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("misplaced"), (F.count_if(wrong) == 0).alias("exact_order"))

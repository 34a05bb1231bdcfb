"""Joins, aggregations, windows and set operations of the traffic pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import feature_family, road_level
from ..functions.geometry import length
from ..functions.numbers import drop_missing, half_even, lenient_double, lenient_long
from ..functions.text import clean_text, max_speed, max_speed_whole
from ..operators import relational as R
from ..operators.resolve import TYPE_NAMES, in_order, poi_columns, with_default
from . import fixtures as X
from .fixtures import sql
from .registry import query


@query(sql("mean_obs") + "SELECT osm_id, aadt_obs FROM mean_obs")
def aadt_mean_by_road(spark, d):
    return R.mean_by_key(X.observations(spark, d))


@query(
    sql("roads", "mean_obs")
    + r"""SELECT road_id, aadt_obs, TRY_CAST(nullif(regexp_extract(maxspeed, '\d+\.?\d*'), '') AS DOUBLE) AS maxspeed_num,
        CASE WHEN type IN ('motorway','trunk_link','primary') THEN 'Level_1' WHEN type IN ('secondary','tertiary_link') THEN 'Level_2'
             WHEN type IN ('residential','service') THEN 'Level_3' ELSE 'Level_4' END AS type_level,
        sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length_m
    FROM roads LEFT JOIN mean_obs USING (osm_id)"""
)
def roads_left_aadt(spark, d):
    joined = R.attach_mean(X.roads(spark, d), X.observations(spark, d))
    return joined.select("road_id", "aadt_obs", max_speed(F.col("maxspeed")).alias("maxspeed_num"), road_level(F.col("type")).alias("type_level"), length(F.col("pts")).alias("length_m"))


@query(sql("roads", "obs") + "SELECT road_id, aadt FROM roads LEFT JOIN obs USING (osm_id)")
def roads_obs_left_multi(spark, d):
    return X.roads(spark, d).join(X.observations(spark, d), "osm_id", "left").select("road_id", "aadt")


@query(sql("roads", "obs") + "SELECT road_id, aadt FROM roads JOIN obs USING (osm_id)")
def roads_obs_inner(spark, d):
    return X.roads(spark, d).join(X.observations(spark, d), "osm_id").select("road_id", "aadt")


@query(sql("roads", "obs") + "SELECT road_id, name FROM roads WHERE osm_id IN (SELECT osm_id FROM obs)")
def roads_semi(spark, d):
    return X.roads(spark, d).join(X.observations(spark, d), "osm_id", "left_semi").select("road_id", "name")


@query(sql("roads", "obs") + "SELECT road_id, name FROM roads WHERE osm_id NOT IN (SELECT osm_id FROM obs)")
def roads_anti(spark, d):
    return X.roads(spark, d).join(X.observations(spark, d), "osm_id", "left_anti").select("road_id", "name")


@query("""SELECT event_id, event_type, user_id FROM events e WHERE NOT EXISTS (
    SELECT 1 FROM events m WHERE m.event_id % 3 = 0 AND m.event_type IS NOT DISTINCT FROM e.event_type AND m.user_id IS NOT DISTINCT FROM e.user_id
        AND (m.event_id % 7) IS NOT DISTINCT FROM (e.event_id % 7))""")
def unmatched_triple_anti(spark, d):
    events = X.read(spark, d, "events").withColumn("k", F.col("event_id") % 7)
    return R.unmatched(events, events.filter("event_id % 3 = 0"), ["event_type", "user_id", "k"]).select("event_id", "event_type", "user_id")


@query(sql("roads", "sheet") + """, named AS (SELECT rownum, lower(trim(replace(road_name, chr(8203), ''))) AS k, aadt FROM sheet WHERE road_name IS NOT NULL)
    SELECT n.rownum, n.aadt, r.road_id FROM named n LEFT JOIN (SELECT 'road  ' || (['click','error','purchase','signup','view'])[road_id % 5 + 1] || ' ' || (road_id // 10 + 2) AS k,
        road_id FROM roads) r USING (k)""")
def name_left_join(spark, d):
    sheet = X.count_sheet(spark, d).filter("road_name is not null").select("rownum", "aadt", clean_text(F.col("road_name")).alias("name_key"))
    # two roads share a name
    name = F.concat(F.lit("Road  "), X.pick(X.EVENT_TYPES, F.col("road_id") % 5), F.lit(" "), F.expr("road_id div 10 + 2").cast("string"))
    names = X.roads(spark, d).select("road_id", clean_text(name).alias("name_key"))
    return sheet.join(names, "name_key", "left").select("rownum", "aadt", "road_id")


@query(sql("roads") + """SELECT road_id, CASE WHEN type IN ('motorway','trunk_link','primary') THEN 'Level_1' WHEN type IN ('secondary','tertiary_link') THEN 'Level_2'
    WHEN type IN ('residential','service') THEN 'Level_3' ELSE 'Level_4' END AS type_level FROM roads""")
def type_level(spark, d):
    return X.roads(spark, d).select("road_id", road_level(F.col("type")).alias("type_level"))


@query(sql("roads") + """SELECT (row_number() OVER (ORDER BY road_id // 2, road_id % 2))::BIGINT AS segment_id, road_id // 2 AS osm_id,
    count(*) OVER (PARTITION BY road_id // 2) > 1 AS is_split FROM roads""")
def split_flags(spark, d):
    parts = X.paired_roads(spark, d).select("osm_id", F.posexplode("parts").alias("part", "pts"))
    return R.with_split_flag(R.dense_id(parts, ["osm_id", "part"], "segment_id", 1)).select(F.col("segment_id").cast("long").alias("segment_id"), "osm_id", "is_split")


@query("""WITH f AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'dens100_food_kmp2' WHEN 1 THEN 'front20_total' WHEN 2 THEN 'dist_food_m' WHEN 3 THEN 'type_primary'
        WHEN 4 THEN 'population' WHEN 5 THEN 'maxspeed_num' ELSE 'road_density' END AS feature, p_size::DOUBLE AS importance FROM part)
    SELECT CASE WHEN feature LIKE 'dens%' THEN 'poi_density' WHEN feature LIKE 'front20%' THEN 'poi_frontage' WHEN feature LIKE 'dist%' THEN 'poi_distance'
        WHEN feature LIKE 'type%' THEN 'roadtype(onehot)' WHEN feature = 'maxspeed_num' THEN 'maxspeed' ELSE feature END AS family, sum(importance) AS importance
    FROM f GROUP BY 1 ORDER BY 2 DESC, 1""")
def importance_family(spark, d):
    names = ("dens100_food_kmp2", "front20_total", "dist_food_m", "type_primary", "population", "maxspeed_num", "road_density")
    table = X.read(spark, d, "part").select(X.pick(names, F.col("p_partkey") % 7).alias("feature"), F.col("p_size").cast("double").alias("importance"))
    return table.groupBy(feature_family(F.col("feature")).alias("family")).agg(F.sum("importance").alias("importance")).orderBy(F.col("importance").desc(), "family")


@query(sql("obs") + "SELECT osm_id // 4 AS node_id, round(avg(aadt - 25000), 6) AS resid FROM obs WHERE aadt IS NOT NULL GROUP BY 1")
def node_residual_mean(spark, d):
    rows = drop_missing(X.observations(spark, d), ["aadt"]).select(F.expr("osm_id div 4").alias("node_id"), (F.col("aadt") - 25000).alias("r"))
    return rows.groupBy("node_id").agg(F.round(F.avg("r"), 6).alias("resid"))


@query(sql("obs") + "SELECT min(aadt) AS low, max(aadt) AS high, count(DISTINCT aadt) AS n_values, count(aadt) AS n FROM obs")
def aadt_profile(spark, d):
    return X.observations(spark, d).agg(F.min("aadt").alias("low"), F.max("aadt").alias("high"), F.count_distinct("aadt").alias("n_values"), F.count("aadt").alias("n"))


@query(sql("mean_obs") + """, p AS (SELECT aadt_obs AS y, 20000 + (osm_id % 100) * 100.0::DOUBLE AS p FROM mean_obs), m AS (SELECT *, avg(y) OVER () AS a FROM p)
    SELECT round(1 - sum((y - p) * (y - p)) / sum((y - a) * (y - a)), 8) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, count(*) AS n FROM m""")
def fit_metrics(spark, d):
    from ..operators.models import metrics

    mean = R.mean_by_key(X.observations(spark, d)).withColumn("p", 20000 + (F.col("osm_id") % 100) * 100.0)
    return metrics(mean, "aadt_obs", "p").select(F.round("r2", 8).alias("r2"), F.round("rmse", 4).alias("rmse"), "n")


@query("""WITH s AS (SELECT avg(p_size::DOUBLE) AS a, stddev_pop(p_size::DOUBLE) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS e FROM part)
    SELECT p_partkey AS road_id, round((p_size - a) / b, 6) AS size_z, round((p_retailprice - c) / e, 6) AS price_z FROM part, s""")
def scale_features(spark, d):
    from ..operators.models import standardise

    part = X.read(spark, d, "part").select(F.col("p_partkey").alias("road_id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    out = standardise(part, ["size", "price"])
    return out.select("road_id", F.round("size_z", 6).alias("size_z"), F.round("price_z", 6).alias("price_z"))


@query(sql("sheet") + """, f AS (SELECT file, rownum, aadt, last_value(road_name IGNORE NULLS) OVER w AS road_name, last_value(latlon IGNORE NULLS) OVER w AS latlon
        FROM sheet WINDOW w AS (PARTITION BY file ORDER BY rownum ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT file, rownum, road_name, latlon, aadt FROM f WHERE aadt IS NOT NULL""")
def ffill_names(spark, d):
    filled = R.forward_fill(X.count_sheet(spark, d), ["road_name", "latlon"], "rownum", "file")
    return filled.filter("aadt is not null").select("file", "rownum", "road_name", "latlon", "aadt")


_IMPORTANCE = "SELECT p_type || '_' || (p_size % 10) AS feature, sum(p_size)::DOUBLE AS importance FROM part GROUP BY 1"


def _importances(spark, d):
    return X.read(spark, d, "part").groupBy(F.concat("p_type", F.lit("_"), (F.col("p_size") % 10).cast("string")).alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))


@query(f"""WITH i AS ({_IMPORTANCE}), t AS (SELECT *, importance / sum(importance) OVER () AS share FROM i),
    c AS (SELECT *, sum(share) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cum FROM t)
    SELECT feature, round(cum, 6) AS cum, cum <= 0.95 OR importance >= 800 AS keep FROM c""")
def importance_cum_prune(spark, d):
    return R.keep_important(_importances(spark, d), "importance", "feature", 0.95, 800.0).select("feature", F.round("cum", 6).alias("cum"), "keep")


@query(f"""WITH i AS ({_IMPORTANCE}) SELECT feature, round(importance / sum(importance) OVER (), 10) AS share FROM i""")
def coef_share(spark, d):
    return R.running_share(_importances(spark, d), "importance", "feature").select("feature", F.round("share", 10).alias("share"))


_HASH = "((k + 42) * 1103515245 + 12345) % 2147483648 * 69069 % 2147483647"


@query(f"""WITH s AS (SELECT c_custkey AS k, c_nationkey * 5 + c_custkey % 2 AS c FROM customer),
    r AS (SELECT k, c, row_number() OVER (PARTITION BY c ORDER BY {_HASH}, k) AS n, count(*) OVER (PARTITION BY c) AS m FROM s)
    SELECT k AS road_id, c::BIGINT AS cluster, m >= 5 AND n <= greatest(1, round_even(0.2::DOUBLE * m, 0)) AS is_test FROM r""")
def stratified_split(spark, d):
    items = X.read(spark, d, "customer").select(F.col("c_custkey").alias("road_id"), (F.col("c_nationkey") * 5 + F.col("c_custkey") % 2).cast("long").alias("cluster"))
    return R.stratified_sample(items, "cluster", "road_id")


@query(f"SELECT c_custkey AS road_id, ({_HASH.replace('k ', 'c_custkey ')}) % 100 < 20 AS is_test FROM customer")
def hash_split(spark, d):
    from ..operators.models import hash_split as split

    return split(X.read(spark, d, "customer").select(F.col("c_custkey").alias("road_id")), "road_id", 0.2)


@query("""WITH n AS (SELECT s_suppkey, s_acctbal AS r, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier),
    c AS (SELECT count(*) AS n FROM supplier), t AS (SELECT greatest(1, (n * (n - 1) // 2) // 5000) AS step FROM c)
    SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, 0.5::DOUBLE * (a.r - b.r) * (a.r - b.r) AS gamma FROM n a JOIN n b ON b.i > a.i, t
    WHERE (b.i - a.i - 1) % step = 0 ORDER BY a.i, b.i LIMIT 5000""")
def pair_thinning(spark, d):
    items = X.read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("r"))
    pairs = R.thinned_pairs(items, "s_suppkey", ["r"])
    return pairs.select("i", "j", (0.5 * (F.col("r_i") - F.col("r_j")) * (F.col("r_i") - F.col("r_j"))).alias("gamma"))


@query("SELECT p_partkey AS road_id, p_retailprice AS importance FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def top30(spark, d):
    return X.read(spark, d, "part").select(F.col("p_partkey").alias("road_id"), F.col("p_retailprice").alias("importance")).orderBy(F.col("importance").desc(), "road_id").limit(30)


@query(sql("obs") + "SELECT DISTINCT osm_id FROM obs ORDER BY 1")
def distinct_ids_sorted(spark, d):
    return X.observations(spark, d).select("osm_id").distinct().orderBy("osm_id")


@query(sql("roads", "mean_obs") + """SELECT road_id, round_even(aadt_obs, 0)::BIGINT AS aadt, 'observed' AS src FROM roads JOIN mean_obs USING (osm_id)
    UNION ALL SELECT road_id, round_even(x1 * 3.5::DOUBLE + y1 / 3, 0)::BIGINT, 'predicted' FROM roads WHERE osm_id NOT IN (SELECT osm_id FROM mean_obs)""")
def union_obs_pred(spark, d):
    roads, mean = X.roads(spark, d), R.mean_by_key(X.observations(spark, d))
    seen = roads.join(mean, "osm_id").select("road_id", half_even(F.col("aadt_obs")).alias("aadt"), F.lit("observed").alias("src"))
    start = F.element_at("pts", 1)
    rest = roads.join(mean, "osm_id", "left_anti").select("road_id", half_even(start["x"] * 3.5 + start["y"] / 3).alias("aadt"), F.lit("predicted").alias("src"))
    return seen.unionByName(rest)


@query(sql("sheet") + "SELECT file, count(*) AS n, sum(rownum)::BIGINT AS rows_sum FROM (SELECT * FROM sheet WHERE rownum % 2 = 0 UNION ALL SELECT * FROM sheet WHERE rownum % 2 = 1) GROUP BY file")
def sheet_union(spark, d):
    sheet = X.count_sheet(spark, d)
    both = X.union_all([sheet.filter("rownum % 2 = 0"), sheet.filter("rownum % 2 = 1").drop("latlon")])
    return both.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("rownum").alias("rows_sum"))


@query(sql("poi") + """SELECT poi_id, coalesce(amenity IN ('cafe','bank','bus_stop'), FALSE) OR coalesce(shop = 'Books', FALSE) AS hit FROM poi""")
def tag_overlap(spark, d):
    from ..operators.resolve import tags_overlap

    wanted = F.array(*map(F.lit, ("cafe", "bank", "bus_stop", "Books")))
    return X.poi(spark, d).select("poi_id", tags_overlap(F.array("amenity", "shop", "tourism"), wanted).alias("hit"))


@query(sql("roads") + "SELECT road_id, coalesce(type, 'unknown') AS roadtype, 0.0::DOUBLE AS density FROM roads")
def roadtype_default(spark, d):
    out = with_default(X.roads(spark, d), TYPE_NAMES, "roadtype", "unknown")
    return with_default(out, ("road_dens", "density"), "density", 0.0).select("road_id", "roadtype", "density")


@query("""SELECT p_partkey AS road_id, (p_size + p_partkey % 5)::DOUBLE AS front20_sum FROM part""")
def poi_prefix_select(spark, d):
    from ..functions.numbers import row_sum

    wide = X.read(spark, d, "part").select(F.col("p_partkey").alias("road_id"), F.col("p_size").alias("front20_food"), (F.col("p_partkey") % 5).alias("front20_retail"), F.lit(9).alias("other_food"))
    names = in_order(poi_columns(wide.columns), poi_columns(wide.columns))
    return wide.select("road_id", row_sum(wide, names).alias("front20_sum"))


@query(sql("roads", "mean_obs") + r"""SELECT road_id, coalesce(TRY_CAST(nullif(regexp_extract(maxspeed, '\d+'), '') AS DOUBLE), 0) AS maxspeed_num, coalesce(type, 'unknown') AS type,
    road_id::DOUBLE AS id_double, TRY_CAST(maxspeed AS DOUBLE) AS bad_cast FROM roads WHERE osm_id IN (SELECT osm_id FROM mean_obs)""")
def road_features_cast(spark, d):
    kept = X.roads(spark, d).join(R.mean_by_key(X.observations(spark, d)), "osm_id", "left_semi")
    return kept.select("road_id", max_speed_whole(F.col("maxspeed")).alias("maxspeed_num"), F.coalesce("type", F.lit("unknown")).alias("type"), F.col("road_id").cast("double").alias("id_double"), lenient_double(F.col("maxspeed")).alias("bad_cast"))


@query("""WITH a AS (SELECT p_partkey AS k, 1.0::DOUBLE + p_size / 10.0::DOUBLE AS area FROM part), c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT k AS road_id, round(coalesce(n, 0) / area, 8) AS density FROM a LEFT JOIN c USING (k)""")
def density_area_keyed(spark, d):
    area = X.read(spark, d, "part").select(F.col("p_partkey").alias("road_id"), (1.0 + F.col("p_size") / 10.0).alias("area"))
    counts = X.read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("road_id")).agg(F.count(F.lit(1)).alias("n"))
    return area.join(counts, "road_id", "left").select("road_id", F.round(F.coalesce("n", F.lit(0)) / F.col("area"), 8).alias("density"))


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id || '.5' END AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id::VARCHAR END AS b FROM events)
    SELECT event_id, TRY_CAST(a AS DOUBLE) AS a, TRY_CAST(b AS BIGINT) AS b FROM t WHERE TRY_CAST(a AS DOUBLE) IS NOT NULL AND b IS NOT NULL""")
def lenient_cast(spark, d):
    k = F.col("event_id")
    rows = X.read(spark, d, "events").select(
        "event_id", F.when(k % 5 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("a"), F.when(k % 3 != 0, k.cast("string")).alias("b")
    )
    return drop_missing(rows.select("event_id", lenient_double(F.col("a")).alias("a"), lenient_long(F.col("b")).alias("b")), ["a", "b"])


@query(sql("roads") + """SELECT (row_number() OVER (ORDER BY road_id))::BIGINT - 1 AS seg_id, road_id FROM roads""")
def surrogate_ids(spark, d):
    return R.dense_id(X.roads(spark, d).select("road_id"), ["road_id"]).select(F.col("seg_id").cast("long").alias("seg_id"), "road_id")


@query(sql("mean_obs") + f"""SELECT CASE WHEN ({_HASH.replace('k ', 'osm_id ')}) % 100 < 20 THEN 'test' ELSE 'train' END AS part, osm_id AS _join_id, aadt_obs AS y_true, aadt_obs * 0.5 AS y_pred_reg FROM mean_obs""")
def train_test_report(spark, d):
    from ..operators.models import hash_split as split

    rows = split(R.mean_by_key(X.observations(spark, d)), "osm_id", 0.2)
    one = lambda flag, name: rows.filter(flag).select(F.lit(name).alias("part"), F.col("osm_id").alias("_join_id"), F.col("aadt_obs").alias("y_true"), (F.col("aadt_obs") * 0.5).alias("y_pred_reg"))
    return one(F.col("is_test"), "test").unionByName(one(~F.col("is_test"), "train"))

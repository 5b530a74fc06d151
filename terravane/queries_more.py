"""More queries: augmentations, encoder inputs, surveys, tasks, co-registration features, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions import text as tx
from terravane.operators import augment, cloud, embed, extra, funnel, labels, match, probe, raster, splits
from terravane.plans import tasks, views
from terravane.queries import _PK, _embeddings, _matched, _neighbours, _rounded, query
from terravane.queries_extra import _GRID, _grid
from terravane.sources import tables as src
from terravane.streaming import windows

KEY = views.POINT_KEY
_TEXT_KEY = "concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _chance(seed: int, what: str, key: str) -> str:
    """SQL of augment.chance."""
    return f"(CAST('0x' || substr(md5(concat_ws('/', '{seed}:{what}', {key})), 1, 13) AS BIGINT) / 4503599627370496.0e0)"


# surveys and tasks

_TYPES = ("click", "error", "purchase", "signup", "view")
_EFFORT = "SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS effort FROM events GROUP BY user_id"


@query(
    f"WITH f AS ({_EFFORT}), n AS (SELECT user_id, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}' AND value > 20) AS {t}" for t in _TYPES)
    + " FROM events GROUP BY user_id) SELECT user_id, "
    + ", ".join(f"CAST(coalesce({t}, 0) > 0 AS INT) AS occ__{t}, round(100.0e0 * coalesce({t}, 0) / effort, 6) AS rate__{t}" for t in _TYPES)
    + " FROM f LEFT JOIN n USING (user_id)"
)
def rate_matrix(spark, sf):
    e = views.table(spark, sf, "events")
    effort = e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("effort"))
    seen = e.filter("value > 20").groupBy("user_id", "event_type").agg(F.count("*").alias("n_events"))
    return _rounded(labels.rate_matrix(seen, effort, "user_id", "event_type", list(_TYPES)))


@query(
    "WITH y AS (SELECT user_id, month(ts) AS m, user_id % 7 AS region, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}' AND value > 40) AS {t}" for t in _TYPES)
    + " FROM events GROUP BY ALL) SELECT user_id, max(region) AS region, count(DISTINCT m) AS n_years, CAST(min(m) AS INT) AS first_year, CAST(max(m) AS INT) AS last_year, "
    + ", ".join(f"CAST(max({t}) > 0 AS INT) AS pres__{t}" for t in _TYPES)
    + " FROM y GROUP BY user_id"
)
def year_pooled_presence(spark, sf):
    e = views.table(spark, sf, "events").filter("value IS NOT NULL").select("user_id", F.month("ts").alias("m"), (F.col("user_id") % 7).alias("region"), "event_type", "value")
    counts = e.groupBy("user_id", "m", "region").agg(*(F.count_if((F.col("event_type") == t) & (F.col("value") > 40)).alias(t) for t in _TYPES), F.lit(0).alias("never"))
    return labels.pooled_presence(counts, "user_id", "m", [*_TYPES, "never"], ["region"])


@query("""WITH t AS (SELECT l_orderkey % 200 AS plot, sum(3.14159e0 * (l_quantity/2) * (l_quantity/2)) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT p.plot, round(s / nullif(p.ha, 0), 4) AS basal_area FROM (SELECT DISTINCT o_orderkey % 210 AS plot, CAST(o_orderkey % 210 % 9 AS DOUBLE) AS ha FROM orders) p LEFT JOIN t USING (plot)""")
def basal_area(spark, sf):
    trees = views.table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select((F.col("l_orderkey") % 200).alias("plot"), "l_quantity")
    plots = views.table(spark, sf, "orders").selectExpr("o_orderkey % 210 AS plot", "CAST(o_orderkey % 210 % 9 AS DOUBLE) AS ha").distinct()
    return labels.basal_area(trees, plots, "plot", "l_quantity", "ha").select("plot", F.round("basal_area", 4).alias("basal_area"))


@query("""WITH u AS (SELECT is_test, unnest(list_transform(v[1:8], lambda x: greatest(x, 0))) AS x, unnest(range(1, 9)) AS i FROM v_emb)
SELECT 's' || i AS species, is_test, count(*) FILTER (x > 0) AS n, round(avg(CAST(x > 0 AS DOUBLE)), 9) AS prevalence, round(avg(x), 9) AS mean_rate FROM u GROUP BY i, is_test""")
def species_prevalence(spark, sf):
    e = _embeddings(spark, sf).select("is_test", F.transform(F.slice("embedding", 1, 8), lambda x: F.greatest(x.cast("double"), F.lit(0.0))).alias("rates"))
    return _rounded(labels.prevalence(e, "rates", "is_test", [f"s{i}" for i in range(1, 9)]), 9)


@query("""SELECT c_nationkey AS grp, arg_min(c_custkey, {'p': CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, 's': c_mktsegment, 'k': c_custkey}) AS site FROM customer GROUP BY 1""")
def priority_sites(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), "c_mktsegment", F.col("c_custkey").alias("site"))
    return labels.by_priority(c, ["grp"], "c_mktsegment", ["MACHINERY", "BUILDING"], "site").select("grp", "site")


@query("""SELECT c_custkey, code, CASE WHEN code IS NOT NULL THEN CASE WHEN c_custkey % 3 = 0 THEN 'final' WHEN c_custkey % 3 = 1 THEN 'field' ELSE 'name' END END AS code_source, code IS NOT NULL AND code IN (SELECT 'N' || n_nationkey FROM nation) AS resolved FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'N' || c_nationkey WHEN 1 THEN 'X' || c_nationkey ELSE (SELECT 'N' || n_nationkey FROM nation WHERE n_nationkey = c_nationkey + 3) END AS code FROM customer)""")
def community_resolution(spark, sf):
    c = views.table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN concat('N', c_nationkey) END AS a", "CASE WHEN c_custkey % 3 = 1 THEN concat('X', c_nationkey) END AS b", "c_nationkey + 3 AS k")
    n = views.table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_nationkey").alias("key"), F.concat(F.upper("n_name"), F.lit(" [Provisional]")).alias("name"))
    named = c.join(views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("said")), "k", "left")
    return extra.resolved_community(named, [("a", "final"), ("b", "field")], "said", "name", n, "code", "name").select("c_custkey", "code", "code_source", "resolved")


@query("""WITH s AS (SELECT site_id, lat, lon, label, site_id % 2 = 1 AS is_test, year + site_id % 3 AS a, year + 6 AS b FROM v_sites WHERE label IS NOT NULL AND site_id % 5 <> 0)
SELECT lat, lon, (a + b)/2.0e0 AS year, CAST(least(greatest(round_even((a + b)/2.0e0, 0), 2008), 2016) AS INT) AS emb_year, is_test, label FROM s""")
def task_frame(spark, sf):
    s = views.sites(spark, sf).selectExpr("*", "site_id % 2 = 1 AS is_test", "year + site_id % 3 AS a", "year + 6 AS b", "site_id % 5 AS part")
    spec = tasks.Spec("segments", "multiclass", "sites", ("label",), rows="part in [1, 2, 3, 4] and label.notna()", year=("a", "b"))
    return spec.frame(s, "lat", "lon", "is_test", [], 2008, 2016)


@query(
    "WITH c AS (SELECT user_id, event_type, value, CAST(month(ts) AS DOUBLE) AS m FROM events WHERE value > 30) SELECT CAST(user_id AS DOUBLE) AS lat, 0.0e0 - user_id AS lon, round(avg(m), 6) AS year, CAST(least(greatest(round_even(avg(m), 0), 1), 2) AS INT) AS emb_year, user_id % 2 = 1 AS is_test, "
    + ", ".join(f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS INT) AS {t}" for t in _TYPES)
    + " FROM c GROUP BY user_id"
)
def site_task_frame(spark, sf):
    e = views.table(spark, sf, "events").selectExpr("user_id", "event_type", "value - 30 AS count", "month(ts) AS year", "CAST(user_id AS DOUBLE) AS lat", "-CAST(user_id AS DOUBLE) AS lon", "user_id % 2 = 1 AS is_test")
    spec = tasks.Spec("occurrence", "multilabel", "events", site="user_id", pair=("event_type", "count"))
    return _rounded(spec.frame(e, "lat", "lon", "is_test", [], 1, 2))


_NN = """d AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, list_cosine_similarity(q.v, r.v) AS cosine FROM v_emb q JOIN v_emb r ON q.is_test AND NOT r.is_test),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, row_id) AS k FROM d),
w AS (SELECT n.query_id, greatest(cosine, 0) + 1e-6 AS w, CASE WHEN e.vec_id % 7 <> 0 THEN CAST(e.label % 2 = 0 AS INT) END AS a, CAST(e.label < 4 AS INT) AS b FROM n JOIN v_emb e ON e.vec_id = n.row_id WHERE k <= 5)"""


@query(f"""WITH {_NN} SELECT query_id, 'a' AS target, round(coalesce(sum(w * a), 0) / greatest(coalesce(sum(w) FILTER (a IS NOT NULL), 0), 1e-12), 6) AS predicted FROM w GROUP BY query_id
UNION ALL SELECT query_id, 'b', round(sum(w * b) / sum(w), 6) FROM w GROUP BY query_id""")
def knn_presence(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), F.expr("CASE WHEN vec_id % 7 <> 0 THEN CAST(label % 2 = 0 AS INT) END").alias("a"), (F.col("label") < 4).cast("int").alias("b"))
    return _rounded(embed.knn_presence(_neighbours(spark, sf), rows, "query_id", "row_id", ["a", "b"]))


# point clouds: features, statistics, samples


def _returns(spark, sf):
    return views.points(spark, sf).withColumn("number_of_returns", F.expr("CAST(l_linenumber % 4 - 1 AS INT)"))


_OF = "greatest(l_linenumber % 4 - 1, 1)"


@query(f"""WITH g AS (SELECT cloud_id, quantile_cont(z - hag, 0.5) AS g FROM v_points GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY intensity, {_PK}) AS k, count(*) OVER (PARTITION BY cloud_id) AS n, {_OF} AS nr, least(greatest(return_number, 1), {_OF}) AS rn FROM v_points)
SELECT {_PK}, round(z - g, 6) AS z, round(least(greatest(hag, -5), 100)/30, 6) AS height, round(coalesce((k - 1)/CAST(nullif(n - 1, 0) AS DOUBLE), 0), 6) AS rank, round(rn/CAST(nr AS DOUBLE), 6) AS ratio, CAST(rn = 1 AS INT) AS first, CAST(rn = nr AS INT) AS last FROM p JOIN g USING (cloud_id)""")
def als_features(spark, sf):
    f = cloud.features(_returns(spark, sf), "cloud_id", KEY)
    return _rounded(f.select(*KEY, "z", *(F.col("features")[i].alias(n) for i, n in enumerate(("height", "rank", "ratio")) ), F.col("features")[3].cast("int").alias("first"), F.col("features")[4].cast("int").alias("last")))


_Q = list(range(5, 100, 5))


@query(
    "WITH m AS (SELECT cloud_id, avg(z) AS mz, max(z) AS top, avg(intensity) AS mi, " + ", ".join(f"quantile_cont(z, {q / 100}) AS zq{q}" for q in _Q) + " FROM v_points GROUP BY 1), "
    "e AS (SELECT cloud_id, (ln(sum(c)) - sum(c*ln(c))/sum(c))/ln(max(b) + 1) AS zentropy FROM (SELECT cloud_id, floor(z) AS b, count(*) AS c FROM v_points GROUP BY ALL) GROUP BY 1) "
    "SELECT p.cloud_id, count(*) AS n, round((max(x) - min(x)) * (max(y) - min(y)), 4) AS area, max(z) AS zmax, round(avg(z), 6) AS zmean, round(stddev_samp(z), 6) AS zsd, "
    "round(avg(pow(z - mz, 3))/pow(avg(pow(z - mz, 2)), 1.5), 6) AS zskew, round(avg(pow(z - mz, 4))/pow(avg(pow(z - mz, 2)), 2), 6) AS zkurt, round(max(zentropy), 6) AS zentropy, "
    "round(100*avg(CAST(z > mz AS DOUBLE)), 6) AS pzabovezmean, round(100*avg(CAST(z > 2 AS DOUBLE)), 6) AS pzabove2, "
    + ", ".join(f"round(max(zq{q}), 6) AS zq{q}" for q in _Q)
    + ", "
    + ", ".join(f"round(100.0e0 * count(*) FILTER (z < top AND floor(10*z/top) < {k}) / count(*) FILTER (z < top), 6) AS zpcum{k}" for k in range(1, 10))
    + ", CAST(sum(intensity) AS DOUBLE) AS itot, CAST(max(intensity) AS DOUBLE) AS imax, round(avg(intensity), 4) AS imean, round(stddev_samp(intensity), 4) AS isd, "
    "round(avg(pow(intensity - mi, 3))/pow(avg(pow(intensity - mi, 2)), 1.5), 6) AS iskew, round(avg(pow(intensity - mi, 4))/pow(avg(pow(intensity - mi, 2)), 2), 6) AS ikurt, "
    "round(100.0e0 * sum(intensity) FILTER (classification = 2) / sum(intensity), 6) AS ipground, "
    + ", ".join(f"round(100.0e0 * sum(intensity) FILTER (z <= zq{q}) / sum(intensity), 6) AS ipcumzq{q}" for q in (10, 30, 50, 70, 90))
    + ", "
    + ", ".join(f"round(100*avg(CAST(return_number = {k} AS DOUBLE)), 6) AS p{k}th" for k in range(1, 6))
    + ", round(100*avg(CAST(classification = 2 AS DOUBLE)), 6) AS pground FROM v_points p JOIN m USING (cloud_id) JOIN e USING (cloud_id) GROUP BY p.cloud_id"
)
def std_metrics_56(spark, sf):
    m = cloud.standard_metrics(views.points(spark, sf), "cloud_id")
    return _rounded(m.withColumns({c: F.round(c, 4) for c in ("area", "imean", "isd")}))


_SPOILT = "CASE WHEN cloud_id % 7 = 1 AND l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE x END AS x, y, CASE WHEN cloud_id % 7 = 2 THEN z * 100 ELSE z END AS z, CASE WHEN cloud_id % 7 = 3 THEN CAST('Infinity' AS DOUBLE) ELSE hag END AS hag"


@query("SELECT cloud_id, CASE cloud_id % 7 WHEN 1 THEN 'non-finite coordinates' WHEN 2 THEN 'implausible elevation range' WHEN 3 THEN 'non-finite height above ground' ELSE 'ok' END AS status FROM (SELECT DISTINCT cloud_id FROM v_points)")
def cloud_validity(spark, sf):
    p = views.points(spark, sf).select("cloud_id", F.expr("CASE WHEN cloud_id % 7 = 1 AND l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) ELSE x END").alias("x"), "y", F.expr("CASE WHEN cloud_id % 7 = 2 THEN z * 100 ELSE z END").alias("z"), F.expr("CASE WHEN cloud_id % 7 = 3 THEN CAST('Infinity' AS DOUBLE) ELSE hag END").alias("hag"))
    return cloud.validity(p, "cloud_id")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('0:' || {_TEXT_KEY}), {_PK}) AS k FROM v_points WHERE classification NOT IN (7, 18) AND x*x + y*y <= 6400),
t AS (SELECT * FROM c WHERE k <= 400), m AS (SELECT cloud_id, (min(x) + max(x))/2 AS mx, (min(y) + max(y))/2 AS my, min(z) AS mz FROM t GROUP BY 1),
s AS (SELECT cloud_id, {_PK}, x - mx AS x, y - my AS y, z - mz AS z FROM t JOIN m USING (cloud_id)), l AS (SELECT cloud_id, min(x) AS lx, min(y) AS ly FROM s GROUP BY 1),
v AS (SELECT s.*, row_number() OVER (PARTITION BY cloud_id, floor((x - lx)/10), floor((y - ly)/10), floor(z/10) ORDER BY md5('1:' || {_TEXT_KEY}), {_PK}) AS n FROM s JOIN l USING (cloud_id))
SELECT cloud_id, l_orderkey, l_partkey, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM v WHERE n = 1""")
def encoder_input(spark, sf):
    p = cloud.encoder_input(views.points(spark, sf), "cloud_id", 80.0, 10.0, 400, KEY[:4])
    return _rounded(p.select("cloud_id", "l_orderkey", "l_partkey", "x", "y", "z"))


@query(f"""WITH v AS (SELECT *, CAST(floor(x/40) AS BIGINT) AS vx, CAST(floor(y/40) AS BIGINT) AS vy, CAST(floor(z/40) AS BIGINT) AS vz FROM v_points),
r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY md5('0:' || {_TEXT_KEY}), {_PK}) - 1 AS round, count(*) OVER (PARTITION BY cloud_id, vx, vy, vz) AS n, dense_rank() OVER (PARTITION BY cloud_id ORDER BY vx, vy, vz) - 1 AS inverse FROM v)
SELECT cloud_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(inverse AS INT) AS inverse, round(x - (vx + 0.5e0)*40, 6) AS dx FROM r WHERE round = 7 % n""")
def voxel_test_round(spark, sf):
    rounds = cloud.voxel_rounds(views.points(spark, sf), "cloud_id", 40, KEY[:4])
    return _rounded(cloud.voxel_round(rounds, 7).select("cloud_id", *KEY[:4], "inverse", "dx"))


@query(f"SELECT cloud_id, l_orderkey, l_partkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('4:' || {_TEXT_KEY}), {_PK}) AS k FROM v_points) WHERE k <= 50")
def thinned_points(spark, sf):
    return cloud.thinned(views.points(spark, sf), "cloud_id", 50, KEY[:4], 4).select("cloud_id", *KEY[:4])


@query(f"SELECT cloud_id, count(*) AS n, round(sum(hag), 4) AS total FROM v_points WHERE hag >= 15 OR CAST('0x' || substr(md5('6:' || {_TEXT_KEY}), 1, 8) AS BIGINT) / 4294967296.0e0 < 0.25 GROUP BY 1")
def stratified_thinned_points(spark, sf):
    p = cloud.stratified_thinned(views.points(spark, sf), 15.0, 0.25, KEY[:4], 6)
    return p.groupBy("cloud_id").agg(F.count("*").alias("n"), F.round(F.sum("hag"), 4).alias("total"))


@query("""SELECT cloud_id, l_suppkey % 4 AS instance, min(x) AS min_x, max(z) AS max_z, round(avg(y), 6) AS mean_y, count(*) AS n, CAST(dense_rank() OVER (PARTITION BY cloud_id ORDER BY l_suppkey % 4) - 1 AS INT) AS instance_no FROM v_points WHERE l_suppkey % 4 > 0 GROUP BY 1, 2""")
def cloud_instances(spark, sf):
    p = views.points(spark, sf).withColumn("instance", F.expr("nullif(l_suppkey % 4, 0)"))
    return _rounded(cloud.instances(p, "cloud_id", "instance").select("cloud_id", "instance", "min_x", "max_z", "mean_y", "n", "instance_no"))


@query("""WITH c AS (SELECT cloud_id, greatest(hag, 0) AS h, classification FROM v_points) SELECT cloud_id, round(sum(h), 4) AS h, count(*) AS n FROM c GROUP BY 1""")
def prepared_points(spark, sf):
    return cloud.pair_columns(views.points(spark, sf)).groupBy("cloud_id").agg(F.round(F.sum("hag"), 4).alias("h"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey, x, y, unnest(range(CAST(floor((x - 5)/50) AS BIGINT), CAST(floor((x + 5)/50) AS BIGINT) + 1)) AS ti FROM v_points),
u AS (SELECT *, unnest(range(CAST(floor((y - 5)/50) AS BIGINT), CAST(floor((y + 5)/50) AS BIGINT) + 1)) AS tj FROM t)
SELECT ti, tj, count(*) AS n, count(*) FILTER (floor(x/50) = ti AND floor(y/50) = tj) AS n_own FROM u GROUP BY 1, 2""")
def tiled_points(spark, sf):
    t = cloud.tiled(views.points(spark, sf), 50.0, 5.0)
    return t.groupBy("ti", "tj").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"))


@query("""SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS vx, CAST(floor(y/20) AS BIGINT) AS vy, CAST(floor(z/20) AS BIGINT) AS vz, round(avg(x), 6) AS x, max(intensity) AS intensity, avg(CAST(classification = 2 AS DOUBLE)) > 0.5 AS ground FROM v_points GROUP BY 1, 2, 3, 4""")
def voxel_pool_masks(spark, sf):
    p = views.points(spark, sf).withColumn("ground", F.col("classification") == 2)
    return _rounded(cloud.voxel_pooled(p, "cloud_id", 20, ["intensity"], ("ground",)).select("cloud_id", "vx", "vy", "vz", "x", "intensity", "ground"))


@query("SELECT cloud_id, l_orderkey, CAST(floor((x + 100)/2) AS BIGINT) AS vx, CAST(floor((y + 100)/2) AS BIGINT) AS vy, CAST(floor(z) AS BIGINT) AS vz, CAST(floor((x + 100)/2) AS BIGINT) AS hx, CAST(floor((y + 100)/2) AS BIGINT) AS hy, CAST(floor(z) AS BIGINT) AS hz FROM v_points")
def hilbert_round_trip(spark, sf):
    p = views.points(spark, sf).selectExpr("cloud_id", "l_orderkey", "CAST(FLOOR((x + 100) / 2) AS BIGINT) AS vx", "CAST(FLOOR((y + 100) / 2) AS BIGINT) AS vy", "CAST(FLOOR(z) AS BIGINT) AS vz")
    return cloud.unhilbert(cloud.hilbert(p, 7), 7).drop("hilbert")


@query("""SELECT cloud_id, l_orderkey, l_partkey, l_linenumber, (cloud_id << 21) | (l_partkey % 2097152) AS code, cloud_id AS batch, l_partkey % 2097152 AS own FROM v_points""")
def batched_codes(spark, sf):
    p = views.points(spark, sf).withColumn("code", tx.batched_code(F.col("cloud_id"), F.col("l_partkey") % 2097152, 7))
    batch, own = tx.unbatched_code(F.col("code"), 7)
    return p.select("cloud_id", "l_orderkey", "l_partkey", "l_linenumber", "code", batch.alias("batch"), own.alias("own"))


# point clouds: augmentations


@query(f"SELECT {_PK} FROM v_points WHERE {_chance(1, 'returns', 'cloud_id')} >= 0.5 OR return_number = 1")
def return_drop(spark, sf):
    return augment.returns_dropped(views.points(spark, sf), "cloud_id", 1, 0.5).select(*KEY)


@query(f"SELECT {_PK}, least(greatest(x, -50), 50) AS x, least(greatest(y, -40), 60) AS y, least(greatest(z, 5), 20) AS z FROM v_points")
def point_clip(spark, sf):
    return augment.clipped(views.points(spark, sf), (-50.0, -40.0, 5.0), (50.0, 60.0, 20.0)).select(*KEY, "x", "y", "z")


@query(f"SELECT {_PK} FROM v_points WHERE {_chance(2, 'clouds', 'cloud_id')} >= 0.5 OR {_chance(2, 'points', 'l_orderkey, l_linenumber, l_partkey, l_suppkey')} >= 0.2")
def point_dropout(spark, sf):
    return augment.dropped(views.points(spark, sf), "cloud_id", KEY[:4], 2, 0.2, 0.5).select(*KEY)


@query(f"""WITH m AS (SELECT cloud_id, (min(x) + max(x))/2 AS mx, (min(y) + max(y))/2 AS my FROM v_points GROUP BY 1),
t AS (SELECT *, CASE WHEN {_chance(3, 'turn', 'cloud_id')} < 0.75 THEN 3.141592653589793e0 * (1 + CAST(floor({_chance(3, 'angle', 'cloud_id')} * 3) AS INT)) / 2 ELSE 0 END AS t FROM m)
SELECT {_PK}, round(mx + (x - mx)*cos(t) - (y - my)*sin(t), 6) + 0.0e0 AS x, round(my + (x - mx)*sin(t) + (y - my)*cos(t), 6) + 0.0e0 AS y FROM v_points JOIN t USING (cloud_id)""")
def target_angles(spark, sf):
    return _rounded(augment.turned(views.points(spark, sf), "cloud_id", 3, [0.5, 1.0, 1.5], 0.75).select(*KEY, "x", "y"))


_NORMAL = "sqrt(-2*ln(1 - {u})) * cos(6.283185307179586e0*{v})"


def _noise(seed: int, what: str) -> str:
    key = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return _NORMAL.format(u=_chance(seed, f"{what}-1", key), v=_chance(seed, f"{what}-2", key))


@query(f"SELECT {_PK}, " + ", ".join(f"round({a} + 0.02e0*least(greatest({_noise(4, a)}/1.96e0, -1), 1), 6) AS {a}" for a in "xyz") + " FROM v_points")
def clipped_jitter(spark, sf):
    return _rounded(augment.jittered(views.points(spark, sf), KEY[:4], 4, 0.02).select(*KEY, "x", "y", "z"))


@query(f"""WITH l AS (SELECT cloud_id, min(x) AS lx, min(y) AS ly, min(z) AS lz FROM v_points GROUP BY 1)
SELECT {_PK}, round(x - lx + 0.2e0*(2*{_chance(5, 'shift-x', 'cloud_id')} - 1), 6) AS x, round(y - ly + 0.2e0*(2*{_chance(5, 'shift-y', 'cloud_id')} - 1), 6) AS y, round(z - lz, 6) AS z FROM v_points JOIN l USING (cloud_id)""")
def composed_shift(spark, sf):
    steps = [lambda p: augment.to_origin(p, "cloud_id"), lambda p: augment.shifted(p, "cloud_id", 5, (0.2, 0.2, 0.0))]
    return _rounded(augment.composed(views.points(spark, sf), steps).select(*KEY, "x", "y", "z"))


@query(f"""WITH m AS (SELECT cloud_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v_points GROUP BY 1), f AS (SELECT p.cloud_id, max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))) AS far FROM v_points p JOIN m USING (cloud_id) GROUP BY 1)
SELECT {_PK}, round((x - mx)/far, 6) AS x, round((z - mz)/far, 6) AS z FROM v_points JOIN m USING (cloud_id) JOIN f USING (cloud_id)""")
def unit_sphere(spark, sf):
    return _rounded(augment.unit_sphere(views.points(spark, sf), "cloud_id").select(*KEY, "x", "z"))


_DRAWN = f"""c AS (SELECT cloud_id, x AS cx, y AS cy, z AS cz FROM (SELECT *, count(*) OVER (PARTITION BY cloud_id) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY md5('8:' || {_TEXT_KEY}), {_PK}) AS k FROM v_points) WHERE k = 1 AND n > 300)"""


@query(f"""WITH {_DRAWN}, d AS (SELECT p.*, cx, row_number() OVER (PARTITION BY p.cloud_id ORDER BY pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2), {_PK}) AS k FROM v_points p LEFT JOIN c USING (cloud_id))
SELECT cloud_id, {_PK} FROM d WHERE cx IS NULL OR k <= 300""")
def sphere_crop(spark, sf):
    p = views.points(spark, sf)
    return augment.sphere_crop(p, "cloud_id", 300, KEY[:4], 8).select("cloud_id", *KEY)


@query(f"WITH {_DRAWN} SELECT cloud_id, {_PK} FROM v_points LEFT JOIN c USING (cloud_id) WHERE cx IS NULL OR pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2) < 900")
def cylinder_crop(spark, sf):
    return augment.radius_crop(views.points(spark, sf), "cloud_id", 300, 30.0, KEY[:4], 8).select("cloud_id", *KEY)


@query(f"SELECT {_PK}, CAST(row_number() OVER (PARTITION BY cloud_id ORDER BY md5('9:' || {_TEXT_KEY}), {_PK}) - 1 AS INT) AS place FROM v_points WHERE classification NOT IN (7, 5)")
def shuffled_points(spark, sf):
    p = augment.without_classes(views.points(spark, sf), (7, 5), "classification")
    return augment.shuffled(p, "cloud_id", KEY[:4], 9).select(*KEY, "place")


_RGB = "l_partkey % 256 AS r, l_suppkey % 200 AS g, (l_partkey + l_suppkey) % 256 AS b"


def _coloured(spark, sf):
    return views.points(spark, sf).select("*", F.expr("l_partkey % 256").alias("r"), F.expr("l_suppkey % 200").alias("g"), F.expr("(l_partkey + l_suppkey) % 256").alias("b"))


@query(f"""WITH p AS (SELECT *, {_RGB} FROM v_points), e AS (SELECT cloud_id, {", ".join(f"min({c}) AS lo{c}, max({c}) AS hi{c}" for c in "rgb")} FROM p GROUP BY 1),
q AS (SELECT p.cloud_id, {_PK}, {", ".join(f"0.7e0*{c} + 0.3e0*coalesce(({c} - lo{c})*255.0e0/nullif(hi{c} - lo{c}, 0), {c}) AS {c}" for c in "rgb")} FROM p JOIN e USING (cloud_id)),
s AS (SELECT cloud_id, {_PK}, {", ".join(f"least(greatest({c} + ({_chance(6, f'colour-{c}', 'cloud_id')} - 0.5e0)*510*0.05e0, 0), 255) AS {c}" for c in "rgb")} FROM q)
SELECT {_PK}, {", ".join(f"round({c}/127.5e0 - 1, 6) AS {c}" for c in "rgb")} FROM s""")
def colour_steps(spark, sf):
    steps = [lambda p: augment.colour_contrast(p, "cloud_id", 0.3), lambda p: augment.colour_shifted(p, "cloud_id", 6, 0.05), augment.colour_normalised]
    return _rounded(augment.composed(_coloured(spark, sf), steps).select(*KEY, "r", "g", "b"))


@query(f"""WITH p AS (SELECT *, {_RGB} FROM v_points), g AS (SELECT *, 0.2989e0*r + 0.587e0*g + 0.114e0*b AS lum FROM p),
n AS (SELECT cloud_id, {_PK}, {", ".join(f"least(greatest(CASE WHEN {_chance(7, 'grey', 'cloud_id')} < 0.4 THEN lum ELSE {c} END + {_noise(7, f'noise-{c}')}*0.005e0*255, 0), 255) AS {c}" for c in "rgb")} FROM g)
SELECT {_PK}, {", ".join(f"round(CASE WHEN {_chance(7, 'no-colour', 'cloud_id')} < 0.2 THEN 0 ELSE {c} END, 5) AS {c}" for c in "rgb")} FROM n""")
def colour_noise(spark, sf):
    steps = [lambda p: augment.grey(p, "cloud_id", 7, 0.4), lambda p: augment.colour_jittered(p, KEY[:4], 7, 0.005), lambda p: augment.colour_dropped(p, "cloud_id", 7, 0.2)]
    return _rounded(augment.composed(_coloured(spark, sf), steps).select(*KEY, "r", "g", "b"), 5)


@query("SELECT cloud_id % 3 AS part, CAST(floor(x/2) AS BIGINT) AS i, CAST(floor(y/2) AS BIGINT) AS j, count(*) AS n, round(avg(intensity), 4) AS intensity, round(avg(hag), 6) AS hag FROM v_points GROUP BY 1, 2, 3")
def mean_rasters(spark, sf):
    p = views.points(spark, sf).withColumn("part", F.col("cloud_id") % 3)
    return _rounded(cloud.mean_raster(p, ["part"], 2.0, ["intensity", "hag"]).withColumn("intensity", F.round("intensity", 4)))


@query(f"WITH q AS (SELECT cloud_id, quantile_cont(intensity, 0.02) AS lo, quantile_cont(intensity, 0.98) AS hi FROM v_points GROUP BY 1) SELECT {_PK}, round(coalesce((least(greatest(intensity, lo), hi) - lo)/nullif(hi - lo, 0), 0), 6) AS intensity FROM v_points JOIN q USING (cloud_id)")
def percentile_clip(spark, sf):
    return _rounded(cloud.held_to_percentiles(views.points(spark, sf), "cloud_id", "intensity", 0.02, 0.98).select(*KEY, "intensity"))


@query("""WITH v AS (SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS vx, CAST(floor(y/20) AS BIGINT) AS vy, CAST(floor(z/20) AS BIGINT) AS vz FROM v_points), m AS (SELECT cloud_id, min(vx) AS lx, min(vy) AS ly, max(vy) AS hy, min(vz) AS lz, max(vz) AS hz FROM v GROUP BY 1)
SELECT cloud_id, ((vx - lx)*(hy - ly + 1) + vy - ly)*(hz - lz + 1) + vz - lz AS ravel, count(*) AS n FROM v JOIN m USING (cloud_id) GROUP BY 1, 2""")
def raveled_voxels(spark, sf):
    v = views.points(spark, sf).select("cloud_id", *(F.floor(F.col(a) / 20).cast("long").alias(f"v{a}") for a in "xyz"))
    return cloud.raveled(v, "cloud_id", ["vx", "vy", "vz"]).groupBy("cloud_id", "ravel").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT * FROM (VALUES (0, 0.4e0, 1.0e0), (1, 0.05e0, 0.2e0)) t(v, lo, hi)), c AS (SELECT cloud_id, v, min(lo) AS lo, min(hi) AS hi, arg_min({{'x': x, 'y': y}}, {{'h': md5(CAST(3 + v AS VARCHAR) || ':' || {_TEXT_KEY}), 'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice}}) AS p FROM v_points, s GROUP BY ALL),
r AS (SELECT cloud_id, v, p, 100*sqrt(lo + (hi - lo)*{_chance(3, 'radius', 'v, cloud_id')}) AS r FROM c)
SELECT r.cloud_id, CAST(v AS INT) AS "view", round(max(r), 6) AS radius, least(count(*), 300) AS n FROM r JOIN v_points q ON q.cloud_id = r.cloud_id AND pow(q.x - r.p.x, 2) + pow(q.y - r.p.y, 2) <= r*r GROUP BY 1, 2""")
def random_views(spark, sf):
    v = cloud.random_views(views.points(spark, sf), "cloud_id", 100.0, [(0.4, 1.0), (0.05, 0.2)], 300, KEY[:4], 3)
    return _rounded(v.groupBy("cloud_id", "view").agg(F.max("radius").alias("radius"), F.count("*").alias("n")))


# matching and selection


@query("SELECT is_test, CAST(n AS INT) AS max_gap, count(*) FILTER (gap <= n) AS n_rows FROM (SELECT m.gap, s.is_test FROM v_matched m JOIN v_split s USING (site_id)), range(6) t(n) GROUP BY 1, 2")
def gap_counts_by_split(spark, sf):
    return match.gap_counts_by(splits.spatial_split(_matched(spark, sf), how="md5"), "is_test")


@query("""WITH v AS (SELECT cell, year, max(CASE WHEN file_id % 3 = 0 THEN size END) AS size FROM v_rasters GROUP BY 1, 2),
t AS (SELECT s.site_id, v.year, v.size, row_number() OVER (PARTITION BY s.site_id ORDER BY abs(v.year - s.year), v.year) AS k FROM v_sites s JOIN v ON s.site_id % 40 = v.cell), b AS (SELECT site_id, min(k) AS k FROM t WHERE k <= 4 AND size IS NOT NULL GROUP BY 1)
SELECT s.site_id, t.year AS found_year, round(t.size, 4) AS size, CAST(t.k AS INT) AS stage FROM v_sites s LEFT JOIN b ON b.site_id = s.site_id LEFT JOIN t ON t.site_id = b.site_id AND t.k = b.k""")
def staged_samples(spark, sf):
    r = views.rasters(spark, sf).groupBy("cell", "year").agg(F.max(F.expr("CASE WHEN file_id % 3 = 0 THEN size END")).alias("size"))
    left = views.sites(spark, sf).selectExpr("site_id", "site_id % 40 AS cell", "year")
    return match.staged_samples(left, r, "cell", "year", "size", 4).select("site_id", "found_year", F.round("size", 4).alias("size"), "stage")


@query("SELECT s.site_id AS k, o.o_totalprice AS price FROM (SELECT site_id FROM v_sites UNION ALL SELECT site_id FROM v_sites WHERE site_id % 2 = 0) s LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) o ON o.o_custkey = s.site_id")
def reindexed_rows(spark, sf):
    s = views.sites(spark, sf).select(F.col("site_id").alias("k"))
    table = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"))
    return match.reindexed(s.union(s.filter("k % 2 = 0")), table, "k")


@query("""WITH r AS (SELECT s.label, s.grp, s.site_id, m.name, coalesce(m.name IS NOT NULL AND m.gap <= 2, false) AS near FROM v_matched m JOIN v_sites s USING (site_id)), n AS (SELECT *, row_number() OVER (PARTITION BY label, grp ORDER BY near DESC, site_id) AS k FROM r)
SELECT label, count(*) AS attempts, count(name) AS covered, count(*) FILTER (near) AS near, count(*) FILTER (near AND k <= 1) AS selected FROM n GROUP BY label""")
def class_coverage(spark, sf):
    return labels.coverage_by_class(_matched(spark, sf), "label", "name", "gap", 2, "grp", 1, ["site_id"])


@query("SELECT round(avg(CAST(is_test AS DOUBLE)), 9) AS share, abs(avg(CAST(is_test AS DOUBLE)) - 0.5) > 0.05 AS off FROM v_split")
def split_share(spark, sf):
    return _rounded(splits.share_warning(splits.spatial_split(views.sites(spark, sf), how="md5")), 9)


# scalars and columns


@query("SELECT o_orderkey, lpad(CAST(o_custkey % 90 AS VARCHAR), 2, '0') || '_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '_' || CASE WHEN o_orderkey > 99 THEN CAST(o_orderkey AS VARCHAR) ELSE lpad(CAST(o_orderkey AS VARCHAR), 2, '0') END AS id FROM orders")
def padded_ids(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", tx.padded_id([F.col("o_custkey") % 90, F.col("o_orderkey") % 1000, F.col("o_orderkey")], [2, 3, 2]).alias("id"))


@query("SELECT p_partkey, regexp_replace(regexp_replace('(' || p_name || ' #' || p_brand || ')', '[^\\w.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS tag, split_part(trim(p_name), ' ', 1) AS genus FROM part")
def name_tags(spark, sf):
    raw = F.concat(F.lit("("), "p_name", F.lit(" #"), "p_brand", F.lit(")"))
    return views.table(spark, sf, "part").select("p_partkey", tx.tag(raw).alias("tag"), tx.genus(F.col("p_name")).alias("genus"))


@query("""WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE d END AS day, CASE WHEN o_orderkey % 4 <> 3 AND year(d) BETWEEN 1993 AND 1997 THEN d END AS plausible, o_orderkey % 4 <> 3 AND NOT year(d) BETWEEN 1993 AND 1997 AS bad,
 CASE WHEN o_orderkey % 4 <> 3 THEN round(least((dayofyear(d) - 1)/365.0e0, 1), 9) END AS fraction FROM t""")
def date_texts(spark, sf):
    raw = "CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') ELSE 'spring 19x' END"
    o = views.table(spark, sf, "orders").select("o_orderkey", tx.date_of(F.expr(raw)).alias("day"))
    plausible, bad = tx.plausible_date(F.col("day"), 1993, 1997)
    return o.select("o_orderkey", "day", plausible.alias("plausible"), bad.alias("bad"), F.round(tx.year_fraction(F.col("day")), 9).alias("fraction"))


@query("SELECT round(avg(CASE WHEN round_even(year + 0.5e0, 0) <> least(greatest(round_even(year + 0.5e0, 0), 2010), 2018) THEN 1.0e0 ELSE 0.0e0 END), 9) AS frac_year_clipped FROM v_sites")
def clipped_years(spark, sf):
    y = views.sites(spark, sf).select((F.col("year") + 0.5).alias("year")).withColumn("emb_year", tx.clipped_year(F.col("year"), 2010, 2018))
    return _rounded(tasks.clipped_share(y), 9)


@query("SELECT p_partkey, p_size AS size, p_brand AS brand, p_size > 20 AS big FROM part")
def meta_json(spark, sf):
    p = views.table(spark, sf, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), (F.col("p_size") > 20).alias("big"))).alias("meta"))
    return p.select("p_partkey", F.from_json("meta", "size int, brand string, big boolean").alias("m")).select("p_partkey", "m.*")


@query("SELECT vec_id, round(v[1], 6) AS v00, round(v[2], 6) AS v01, round(v[1]*v[1] + v[2]*v[2], 6) AS q, round(list_cosine_similarity(v[1:8], v[9:16]), 6) AS s FROM v_emb")
def wide_vectors(spark, sf):
    e = views.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    wide = embed.to_wide(e, "v", 16, "e_")
    both = embed.from_wide(wide.select("vec_id", "e_00", "e_01"), "e_", "pair").join(wide, "vec_id")
    half = lambda a, b: F.array(*(F.col(f"e_{i:02d}") for i in range(a, b)))
    q = F.aggregate("pair", F.lit(0.0), lambda s, x: s + x * x)
    return _rounded(both.select("vec_id", F.col("e_00").alias("v00"), F.col("e_01").alias("v01"), q.alias("q"), embed.similarity(half(0, 8), half(8, 16)).alias("s")))


@query("SELECT site_id, CAST(((CAST(floor(lat/5) AS BIGINT) + 2*CAST(floor(lon/5) AS BIGINT)) % 3 + 3) % 3 AS BIGINT) AS fold FROM v_sites")
def checkerboard_folds(spark, sf):
    return splits.folds(views.sites(spark, sf), "lat", "lon", 5, 3).select("site_id", "fold")


@query("SELECT c_custkey, CAST(c_custkey % 7 AS INT) AS share FROM customer")
def dealt_streams(spark, sf):
    return extra.dealt(views.table(spark, sf, "customer"), "c_custkey", 7).select("c_custkey", "share")


@query("""WITH k AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events), n AS (SELECT *, row_number() OVER (ORDER BY place, user_id) - 1 AS k FROM k)
SELECT event_id, k // 64 AS batch, CAST(k % 64 AS INT) AS place_in_batch FROM n""")
def round_robin_batches(spark, sf):
    from pyspark.sql import Window

    e = views.table(spark, sf, "events").select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("place"))
    return windows.round_robin(e, "user_id", "place", 64).select("event_id", "batch", "place_in_batch")


@query("""SELECT c.n_nationkey AS code FROM nation c JOIN nation p ON p.n_nationkey = c.n_nationkey // 2 WHERE c.n_nationkey % 5 = 0 AND c.n_name <> p.n_name""")
def lineage_errors(spark, sf):
    n = views.table(spark, sf, "nation")
    parent = n.select(F.col("n_nationkey").alias("p"), F.col("n_name").alias("up"))
    rows = n.join(parent, F.expr("n_nationkey div 2") == F.col("p")).select(F.col("n_nationkey").alias("code"), F.expr("CASE WHEN n_nationkey % 5 = 0 THEN p END").alias("parent"), F.col("n_name").alias("filled"))
    return extra.lineage_errors(rows, "code", "parent", "filled").select("code")


@query("SELECT p_partkey, CASE WHEN p_partkey % 40 < 30 THEN 'poor' WHEN p_size/20.0e0 <= 1 THEN 'good' WHEN p_size/20.0e0 <= 2 THEN 'fair' ELSE 'poor' END AS class FROM part")
def quality_classes(spark, sf):
    p = views.table(spark, sf, "part")
    return p.select("p_partkey", extra.quality_class(F.col("p_size") / 20.0, F.col("p_partkey") % 40).alias("class"))


@query("SELECT DISTINCT CAST(floor(lon) AS BIGINT) + a AS ci, CAST(floor(lat) AS BIGINT) + b AS cj FROM v_sites, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)")
def ring_cells(spark, sf):
    s = views.sites(spark, sf).select(geo.cell(F.col("lon"), 1.0).alias("i"), geo.cell(F.col("lat"), 1.0).alias("j"))
    return extra.ring_cells(s, 2).select("ci", "cj").distinct()


@query("""WITH s AS (SELECT unnest(range(3)) AS a, unnest(range(1, 4)) AS b), u AS (SELECT c_custkey AS u, c_acctbal AS v FROM customer), t AS (SELECT u, v/100 + u % 3 AS x1, v/50 AS y1, v/30 AS x2, u % 5 AS y2, v/10 AS x3, v/20 AS y3 FROM u)
SELECT count(*) AS n, round(sqrt(avg(pow(x1 + x2 - x3, 2) + pow(y1 + y2 - y3, 2))), 6) AS rms FROM t""")
def shift_closure(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("u"), F.col("c_acctbal").alias("v"))
    pair = lambda a, b, dx, dy: c.select("u", F.lit(a).alias("a"), F.lit(b).alias("b"), F.expr(dx).cast("double").alias("dx"), F.expr(dy).cast("double").alias("dy"))
    shifts = pair("p", "q", "v / 100 + u % 3", "v / 50").union(pair("q", "r", "v / 30", "u % 5")).union(pair("p", "r", "v / 10", "v / 20"))
    return _rounded(raster.closure(shifts, "u"))


@query("SELECT i, j, value FROM (SELECT i, j, arg_min(v, cloud_id) AS value FROM (SELECT cloud_id, i, j, CASE WHEN cloud_id % 3 <> 0 THEN round(value, 6) END AS v FROM (SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS i, CAST(floor(y/20) AS BIGINT) AS j, avg(z) AS value FROM v_points GROUP BY 1, 2, 3)) WHERE v IS NOT NULL GROUP BY i, j)")
def first_mosaic(spark, sf):
    g = _grid(spark, sf).withColumn("value", F.expr("CASE WHEN cloud_id % 3 <> 0 THEN round(value, 6) END"))
    return raster.first_mosaic(g, ["i", "j"], "cloud_id", "value")


@query(f"SELECT {_PK}, round((b - r)/greatest(b + r, 1e-3), 6) AS ndvi, round((r + g + b)/3.0e0, 6) AS luminance FROM (SELECT *, CAST(l_partkey % 256 AS DOUBLE) AS r, CAST(l_suppkey % 200 AS DOUBLE) AS g, CAST((l_partkey + l_suppkey) % 256 AS DOUBLE) AS b FROM v_points)")
def image_bands(spark, sf):
    p = _coloured(spark, sf)
    return _rounded(p.select(*KEY, raster.ndvi(F.col("b").cast("double"), F.col("r")).alias("ndvi"), raster.luminance(F.col("r"), F.col("g"), F.col("b")).alias("luminance")))


@query(f"""WITH {_GRID}, k AS (SELECT unnest(range(-2, 3)) AS a), w AS (SELECT x.a, y.a AS b, exp(-(x.a*x.a + y.a*y.a)/2.0e0) AS w FROM k x, k y)
SELECT g.cloud_id, g.i, g.j, round(sum(w * h.value)/sum(w), 6) AS value FROM g, w, g h WHERE h.cloud_id = g.cloud_id AND h.i = g.i - a AND h.j = g.j - b GROUP BY 1, 2, 3""")
def blurred_grid(spark, sf):
    return _rounded(raster.blur(_grid(spark, sf), "cloud_id", "value", 1.0, 2))


def _rasters(spark, sf):
    return cloud.rastered(views.points(spark, sf), "cloud_id", 20.0)


_RASTER = """r AS (SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS i, CAST(floor(y/20) AS BIGINT) AS j, max(z) AS dsm, max(z) - avg(CASE WHEN classification = 2 THEN z END) AS chm, avg(CASE WHEN return_number = 1 THEN intensity END) AS intensity FROM v_points WHERE classification NOT IN (7, 18) GROUP BY 1, 2, 3)"""
_LAYERS = ("height", "height_2", "height_log", "open", "reflect", "slope_i", "slope_j")


@query(f"""WITH {_RASTER}, k AS (SELECT unnest(range(-2, 3)) AS a), w AS (SELECT x.a, y.a AS b, exp(-(x.a*x.a + y.a*y.a)/(2*0.7e0*0.7e0)) AS w FROM k x, k y),
s AS (SELECT r.cloud_id, r.i, r.j, sum(w * h.dsm)/sum(w) AS d FROM r, w, r h WHERE h.cloud_id = r.cloud_id AND h.i = r.i - a AND h.j = r.j - b GROUP BY 1, 2, 3),
c AS (SELECT r.cloud_id, r.i, r.j, least(greatest(chm, 0), 60) AS c, least(greatest(intensity, 0), 4) AS reflect, (e.d - u.d)/2 AS gi, (n.d - v.d)/2 AS gj FROM r
 LEFT JOIN s u ON u.cloud_id = r.cloud_id AND u.i = r.i - 1 AND u.j = r.j LEFT JOIN s e ON e.cloud_id = r.cloud_id AND e.i = r.i + 1 AND e.j = r.j
 LEFT JOIN s v ON v.cloud_id = r.cloud_id AND v.i = r.i AND v.j = r.j - 1 LEFT JOIN s n ON n.cloud_id = r.cloud_id AND n.i = r.i AND n.j = r.j + 1),
l AS (SELECT cloud_id, i, j, CASE WHEN c IS NOT NULL THEN c END AS height, c*c/30 AS height_2, ln(1 + c) AS height_log, CAST(c < 0.5 AS DOUBLE) AS open, reflect, CASE WHEN gi IS NOT NULL THEN least(greatest(gi, -3), 3) END AS slope_i, CASE WHEN gj IS NOT NULL THEN least(greatest(gj, -3), 3) END AS slope_j FROM c),
m AS (SELECT cloud_id, {", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in _LAYERS)} FROM l GROUP BY 1)
SELECT cloud_id, i, j, {", ".join(f"round(coalesce(({x} - m_{x})/nullif(s_{x}, 0), 0), 4) AS {x}" for x in _LAYERS)} FROM l JOIN m USING (cloud_id)""")
def feature_stack(spark, sf):
    r = _rasters(spark, sf).withColumn("chm", F.when(F.col("chm").isNotNull(), F.col("chm")))
    return _rounded(raster.feature_stack(r, "cloud_id", reach=2), 4)


@query(f"""WITH {_GRID}, e AS (SELECT cloud_id, min(value) AS lo, max(value) AS hi FROM g GROUP BY 1),
b AS (SELECT cloud_id, i, j, least(coalesce(floor((value - lo)/nullif(hi - lo, 0)*8), 0), 7) AS v FROM g JOIN e USING (cloud_id)), s AS (SELECT CAST(unnest(range(-1, 2)) AS INT) AS d),
n AS (SELECT x.cloud_id, p.d AS di, q.d AS dj, x.v AS a, y.v AS b, count(*) AS c FROM b x, s p, s q, b y WHERE y.cloud_id = x.cloud_id AND y.i = x.i + p.d AND y.j = x.j + q.d GROUP BY ALL),
t AS (SELECT *, sum(c) OVER (PARTITION BY cloud_id, di, dj) AS n, sum(c) OVER (PARTITION BY cloud_id, di, dj, a) AS ca, sum(c) OVER (PARTITION BY cloud_id, di, dj, b) AS cb FROM n)
SELECT cloud_id, di, dj, round(sum(c/n*ln(c*n/(ca*cb))), 6) AS mi, CAST(max(n) AS BIGINT) AS n FROM t GROUP BY 1, 2, 3""")
def mutual_information(spark, sf):
    g = _grid(spark, sf)
    return _rounded(raster.mutual_information(g, g, "cloud_id", 1, 8))


@query(f"""WITH {_GRID}, s AS (SELECT CAST(unnest(range(-1, 2)) AS INT) AS d),
c AS (SELECT g.cloud_id, g.cloud_id % 5 AS unit, a.d AS di, b.d AS dj, corr(g.value, h.value) AS r FROM g, s a, s b, g h WHERE h.cloud_id = g.cloud_id AND h.i = g.i + a.d AND h.j = g.j + b.d GROUP BY ALL),
m AS (SELECT unit, di, dj, avg(r) AS r FROM c GROUP BY 1, 2, 3)
SELECT unit, di, dj, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(r, 12) DESC, abs(di), abs(dj), di DESC, dj DESC) AS k FROM m) WHERE k = 1""")
def pooled_shift(spark, sf):
    g = _grid(spark, sf)
    surface = raster.shift_surface(g, g, "cloud_id", 1).withColumn("unit", F.col("cloud_id") % 5)
    return _rounded(raster.pooled_peak(surface, "unit", "cloud_id")[0])


@query(f"""WITH {_GRID}, s AS (SELECT CAST(unnest(range(-1, 2)) AS INT) AS d), h AS (SELECT cloud_id, i + 1 AS i, j, 2*value + 1 AS value FROM g)
SELECT g.cloud_id, a.d AS di, b.d AS dj, count(*) AS n, round(pow(corr(g.value, h.value), 2), 5) AS r2 FROM g, s a, s b, h WHERE h.cloud_id = g.cloud_id AND h.i = g.i + a.d AND h.j = g.j + b.d GROUP BY ALL""")
def regression_surface(spark, sf):
    g = _grid(spark, sf)
    moved = g.selectExpr("cloud_id", "i + 1 AS i", "j", "2 * value + 1 AS value")
    return _rounded(raster.regression_surface(g, moved, "cloud_id", ["value"], 1, 0.0).select("cloud_id", "di", "dj", "n", "r2"), 5)


@query("""WITH s AS (SELECT grp, lat AS x, lon AS y, 1 + site_id % 3 AS w, site_id % 7 AS dx, site_id % 5 AS dy FROM v_sites), m AS (SELECT grp, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*dx)/sum(w) AS mu, sum(w*dy)/sum(w) AS mv FROM s GROUP BY grp),
c AS (SELECT s.grp, sum(w*(x-mx)*(x-mx)) AS xx, sum(w*(x-mx)*(y-my)) AS xy, sum(w*(y-my)*(y-my)) AS yy, sum(w*(x-mx)*(dx-mu)) AS xu, sum(w*(y-my)*(dx-mu)) AS yu, sum(w*(x-mx)*(dy-mv)) AS xv, sum(w*(y-my)*(dy-mv)) AS yv FROM s JOIN m USING (grp) GROUP BY s.grp),
k AS (SELECT grp, CASE WHEN flat THEN 0 ELSE (xu*yy - yu*xy)/d END AS b, CASE WHEN flat THEN 0 ELSE (yu*xx - xu*xy)/d END AS c, CASE WHEN flat THEN 0 ELSE (xv*yy - yv*xy)/d END AS e, CASE WHEN flat THEN 0 ELSE (yv*xx - xv*xy)/d END AS f FROM (SELECT *, xx*yy - xy*xy AS d, xx*yy - xy*xy <= 1e-12*(xx*yy + 1e-30) AS flat FROM c))
SELECT grp, round(mu - b*mx - c*my, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(mv - e*mx - f*my, 4) AS d, round(e, 4) AS e, round(f, 4) AS f FROM k JOIN m USING (grp)""")
def displacement_fit(spark, sf):
    s = views.sites(spark, sf).selectExpr("grp", "lat AS x", "lon AS y", "1 + site_id % 3 AS w", "site_id % 7 AS dx", "site_id % 5 AS dy")
    return _rounded(raster.fitted_field(s, "grp"), 4)


@query(f"""WITH {_GRID}, m AS (SELECT g.cloud_id, g.i, g.j, CAST(floor((i + 0.5e0) + 1.2e0 + 0.1e0*cloud_id % 3) AS BIGINT) AS si, CAST(floor((j + 0.5e0) - 0.8e0) AS BIGINT) AS sj FROM g WHERE cloud_id % 2 = 0 UNION ALL SELECT cloud_id, i, j, i, j FROM g WHERE cloud_id % 2 = 1)
SELECT m.cloud_id, m.i, m.j, round(g.value, 6) AS value FROM m LEFT JOIN g ON g.cloud_id = m.cloud_id AND g.i = si AND g.j = sj""")
def resampled_grid(spark, sf):
    g = _grid(spark, sf)
    models = g.select("cloud_id").distinct().filter("cloud_id % 2 = 0").selectExpr("cloud_id", "20 * (1.2D + 0.1D * cloud_id % 3) AS a", "0.0D AS b", "0.0D AS c", "20 * -0.8D AS d", "0.0D AS e", "CAST(NULL AS DOUBLE) AS f")
    return _rounded(raster.resampled(g, models, "cloud_id", "value", 20.0))


@query("SELECT m AS method, count(DISTINCT cloud_id) AS n, count(DISTINCT cloud_id) AS exact, 0.0e0 AS rms FROM v_points, (VALUES ('fft'), ('direct')) t(m) GROUP BY m")
def shift_methods(spark, sf):
    g = _grid(spark, sf)
    moved = g.selectExpr("cloud_id", "i + 1 AS i", "j - 2 AS j", "value")
    methods = {"fft": lambda a, b: raster.fft_shift(a, b, "cloud_id", 3), "direct": lambda a, b: raster.best_shift(raster.shift_surface(a, b, "cloud_id", 2), "cloud_id")}
    return raster.compared_methods(g, moved, "cloud_id", methods, (1, -2))


@query("""WITH p AS (SELECT label, grp, CASE WHEN site_id % 4 < 2 THEN 'train' WHEN site_id % 4 = 2 THEN 'near' ELSE 'far' END AS part FROM v_sites)
SELECT grp, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'near') AS n_near, count(*) FILTER (part = 'far') AS n_far,
 count(*) FILTER (part = 'train') >= 12 AND count(*) FILTER (part = 'near') >= 12 AND count(*) FILTER (part = 'far') >= 12 AS strict, count(*) FILTER (part = 'train') >= 12 AND count(*) FILTER (part <> 'train') >= 12 AS loose FROM p GROUP BY grp""")
def scoreable_classes(spark, sf):
    s = views.sites(spark, sf).withColumn("part", F.expr("CASE WHEN site_id % 4 < 2 THEN 'train' WHEN site_id % 4 = 2 THEN 'near' ELSE 'far' END"))
    return probe.scoreable_loosely(s, "grp", "part", "train", ["near", "far"], 12)


@query(f"""WITH {_GRID}, m AS (SELECT cloud_id, i || '_' || j AS k, i + 0.25e0*(j % 3) AS x, j + 0.5e0*(i % 2) AS y FROM g WHERE value > 27), n AS (SELECT cloud_id, i || '_' || j AS k, i + 1.25e0 AS x, j - 0.5e0 AS y FROM g WHERE value > 26.5),
d AS (SELECT m.cloud_id, m.k AS a, n.k AS b, pow(m.x - n.x, 2) + pow(m.y - n.y, 2) AS d2, n.x - m.x AS dx, n.y - m.y AS dy FROM m JOIN n ON m.cloud_id = n.cloud_id AND pow(m.x - n.x, 2) + pow(m.y - n.y, 2) <= 4),
r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, a ORDER BY d2, b) AS ka, row_number() OVER (PARTITION BY cloud_id, b ORDER BY d2, a) AS kb FROM d)
SELECT cloud_id, count(*) AS n, round(quantile_cont(dx, 0.5), 6) AS di, round(quantile_cont(dy, 0.5), 6) AS dj FROM r WHERE ka = 1 AND kb = 1 GROUP BY 1""")
def landmark_shift(spark, sf):
    g = _grid(spark, sf).withColumn("landmark", F.concat_ws("_", "i", "j"))
    a = g.filter("value > 27").selectExpr("cloud_id", "landmark", "i + 0.25D * (j % 3) AS ci", "j + 0.5D * (i % 2) AS cj")
    b = g.filter("value > 26.5").selectExpr("cloud_id", "landmark", "i + 1.25D AS ci", "j - 0.5D AS cj")
    return _rounded(raster.landmark_shift(a, b, "cloud_id", 2.0))


@query(f"""WITH {_GRID}, s AS (SELECT CAST(unnest(range(-1, 2)) AS INT) AS d), h AS (SELECT cloud_id, i, j, value*value AS value FROM g), l AS (SELECT *, CAST(CASE WHEN value >= 20 AND value < 25 THEN 0 WHEN value >= 25 AND value < 30 THEN 1 END AS INT) AS level FROM g)
SELECT l.cloud_id, level, a.d AS di, b.d AS dj, count(*) AS n, CASE WHEN stddev_pop(l.value) > 0 AND stddev_pop(h.value) > 0 THEN round(corr(l.value, h.value), 5) END AS r FROM l, s a, s b, h WHERE level IS NOT NULL AND h.cloud_id = l.cloud_id AND h.i = l.i + a.d AND h.j = l.j + b.d GROUP BY ALL""")
def height_surfaces(spark, sf):
    g = _grid(spark, sf)
    out = raster.height_surfaces(g, g.withColumn("value", F.col("value") * F.col("value")), g, "cloud_id", [20.0, 25.0, 30.0], 1)
    return _rounded(out.select("cloud_id", "level", "di", "dj", "n", "r"), 5)


@query("""WITH s AS (SELECT grp, CAST(site_id % 9 AS DOUBLE) AS h, 1 + site_id % 2 AS w, site_id % 7 AS dx, site_id % 5 AS dy FROM v_sites), m AS (SELECT grp, sum(w) AS sw, sum(w*h)/sum(w) AS mh, sum(w*dx)/sum(w) AS mx, sum(w*dy)/sum(w) AS my FROM s GROUP BY 1),
c AS (SELECT s.grp, sum(w*(h - mh)*(h - mh)) AS hh, sum(w*(h - mh)*(dx - mx)) AS hx, sum(w*(h - mh)*(dy - my)) AS hy FROM s JOIN m USING (grp) GROUP BY 1)
SELECT grp, round(mx - CASE WHEN hh > 1e-9 THEN hx/hh ELSE 0 END*mh, 5) AS dx, round(my - CASE WHEN hh > 1e-9 THEN hy/hh ELSE 0 END*mh, 5) AS dy, round(CASE WHEN hh > 1e-9 THEN hx/hh ELSE 0 END, 5) AS tx, round(CASE WHEN hh > 1e-9 THEN hy/hh ELSE 0 END, 5) AS ty FROM c JOIN m USING (grp)""")
def lean_fit(spark, sf):
    s = views.sites(spark, sf).selectExpr("grp", "CAST(site_id % 9 AS DOUBLE) AS h", "1 + site_id % 2 AS w", "site_id % 7 AS dx", "site_id % 5 AS dy")
    return _rounded(raster.fitted_lean(s, "grp"), 5)


_SUNS = [(90.0, 20.0), (0.0, 35.0)]


@query(f"""WITH {_GRID}, k AS (SELECT CAST(unnest(range(1, 4)) AS BIGINT) AS k), u AS (SELECT * FROM (VALUES (90.0e0, 20.0e0, 1, 0), (0.0e0, 35.0e0, 0, 1)) t(azimuth, elevation, si, sj)),
o AS (SELECT g.cloud_id, g.i, g.j, azimuth, elevation, max(h.value - k * tan(radians(elevation)) * 2 - g.value) AS d FROM g, k, u, g h WHERE h.cloud_id = g.cloud_id AND h.i = g.i + k*si AND h.j = g.j + k*sj GROUP BY ALL),
f AS (SELECT g.cloud_id, u.azimuth, u.elevation, greatest(coalesce(d, 0), 0) AS d, 100 - g.value AS v FROM g CROSS JOIN u LEFT JOIN o ON o.cloud_id = g.cloud_id AND o.i = g.i AND o.j = g.j AND o.azimuth = u.azimuth)
SELECT cloud_id, azimuth, elevation, round(corr(d, v), 6) AS r FROM f GROUP BY 1, 2, 3""")
def sun_fit(spark, sf):
    g = _grid(spark, sf)
    return _rounded(raster.sun_surface(g, g.withColumn("value", 100 - F.col("value")), "cloud_id", _SUNS, 2.0, 3))


_PIXELS = "l_orderkey % 4 AS file, l_partkey % 40 AS row, l_suppkey % 10 AS col"


@query(f"""WITH p AS (SELECT {_PIXELS}, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT c_custkey AS k, c_custkey % 5 AS file, CAST(c_custkey % 97 AS DOUBLE)/2 AS x, CAST(c_custkey % 389 AS DOUBLE)/2 AS y FROM customer)
SELECT s.k, s.file, CASE WHEN p.v <> 50 THEN p.v END AS v FROM s LEFT JOIN p ON p.file = s.file AND p.row = CAST(floor((200 - y)/5) AS BIGINT) AND p.col = CAST(floor((x - 2)/5) AS BIGINT) WHERE s.file < 4""")
def sampled_pixels(spark, sf):
    pixels = views.table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey % 4").alias("file"), F.expr("l_partkey % 40").alias("row"), F.expr("l_suppkey % 10").alias("col")).agg(F.max("l_quantity").cast("double").alias("v"))
    files = pixels.select("file").distinct().selectExpr("file", "2.0D AS x0", "200.0D AS y0", "5.0D AS cell", "50.0D AS nodata")
    places = views.table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_custkey % 5 AS file", "CAST(c_custkey % 97 AS DOUBLE) / 2 AS x", "CAST(c_custkey % 389 AS DOUBLE) / 2 AS y")
    return raster.sampled_pixels(pixels, files, places, "k", "file", "v")


@query(f"""WITH p AS (SELECT {_PIXELS}, CAST(max(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3), o AS (SELECT a*4.0e0 AS dx, b*4.0e0 AS dy FROM (SELECT unnest(range(-3, 4)) AS a), (SELECT unnest(range(-3, 4)) AS b) WHERE a*a*16 + b*b*16 <= 144),
s AS (SELECT c_custkey AS k, c_custkey % 4 AS file, 10 + CAST(c_custkey % 61 AS DOUBLE)/2 + dx AS x, 20 + CAST(c_custkey % 331 AS DOUBLE)/2 + dy AS y FROM customer, o)
SELECT s.k, count(CASE WHEN p.v <> 50 THEN p.v END) AS n, round(avg(CASE WHEN p.v <> 50 THEN p.v END), 6) AS mean FROM s LEFT JOIN p ON p.file = s.file AND p.row = CAST(floor((200 - y)/5) AS BIGINT) AND p.col = CAST(floor((x - 2)/5) AS BIGINT) GROUP BY 1""")
def disc_means(spark, sf):
    pixels = views.table(spark, sf, "lineitem").groupBy(F.expr("l_orderkey % 4").alias("file"), F.expr("l_partkey % 40").alias("row"), F.expr("l_suppkey % 10").alias("col")).agg(F.max("l_quantity").cast("double").alias("v"))
    files = pixels.select("file").distinct().selectExpr("file", "2.0D AS x0", "200.0D AS y0", "5.0D AS cell", "50.0D AS nodata")
    places = views.table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_custkey % 4 AS file", "10 + CAST(c_custkey % 61 AS DOUBLE) / 2 AS x", "20 + CAST(c_custkey % 331 AS DOUBLE) / 2 AS y")
    return _rounded(raster.disc_means(pixels, files, places, "k", "file", "v", 12.0))


# locations


@query("SELECT site_id, round(6378137.0e0*radians(lon), 3) AS x, round(6378137.0e0*ln(tan(pi()/4 + radians(lat)/2)), 3) AS y, printf('%.6f_%.6f_%d', lat, lon, year) AS key FROM v_sites")
def mercator_keys(spark, sf):
    s = views.sites(spark, sf)
    x, y = geo.web_mercator(F.col("lat"), F.col("lon"))
    return s.select("site_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), geo.point_key(F.col("lat"), F.col("lon"), F.col("year")).alias("key"))


@query("""WITH k AS (SELECT unnest(range(-12, 13)) AS a), o AS (SELECT x.a*50.0e0/12 AS dx, y.a*50.0e0/12 AS dy FROM k x, k y WHERE pow(x.a*50.0e0/12, 2) + pow(y.a*50.0e0/12, 2) <= 2500)
SELECT site_id, (SELECT count(*) FROM o) AS n, round(lon + (SELECT max(dx) FROM o), 6) AS far FROM v_sites""")
def disc_samples(spark, sf):
    each = views.sites(spark, sf).select("site_id", "lon", F.explode(geo.disc_offsets(50.0)).alias("o"))
    return each.groupBy("site_id").agg(F.count("*").alias("n"), F.round(F.max(F.col("lon") + F.col("o.dx")), 6).alias("far"))


@query("SELECT site_id, name, collection_year, gap, year_diff FROM v_matched WHERE name IS NOT NULL")
def nearest_in_time(spark, sf):
    return match.nearest_covering(views.sites(spark, sf), views.footprints(spark, sf), "site_id").filter("name IS NOT NULL")


@query("""WITH c AS (SELECT ordinal, w, xmin + w/2 AS lon, ymin + h/2 AS lat FROM v_footprints),
d AS (SELECT a.site_id, w, sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat)/2)) * 111320.0e0, 2) + pow((b.lat - a.lat) * 111320.0e0, 2)) AS distance, ordinal FROM v_sites a CROSS JOIN c b),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY distance, ordinal) AS k FROM d)
SELECT site_id, round(sum(w/greatest(distance, 1e-6))/sum(1/greatest(distance, 1e-6)), 6) AS w FROM r WHERE k <= 3 GROUP BY site_id""")
def inverse_distance(spark, sf):
    centres = views.footprints(spark, sf).selectExpr("ordinal", "w", "xmin + w / 2 AS lon", "ymin + h / 2 AS lat")
    return _rounded(match.weighted_nearest(views.sites(spark, sf), centres, 3, "site_id", "ordinal", "w", 100_000.0))


@query("""SELECT 'as_is' AS candidate, round(avg(CAST(lat BETWEEN 24 AND 40 AND lon BETWEEN -125 AND -90 AS DOUBLE)), 9) AS inside FROM v_sites
UNION ALL SELECT 'swapped', round(avg(CAST(lon BETWEEN 24 AND 40 AND lat BETWEEN -125 AND -90 AS DOUBLE)), 9) FROM v_sites
UNION ALL SELECT 'shifted', round(avg(CAST(lat + 3 BETWEEN 24 AND 40 AND lon - 2 BETWEEN -125 AND -90 AS DOUBLE)), 9) FROM v_sites""")
def projection_shares(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    return _rounded(funnel.projection_ranking(views.sites(spark, sf), {"as_is": (lat, lon), "swapped": (lon, lat), "shifted": (lat + 3, lon - 2)}, (-125.0, -90.0, 24.0, 40.0)), 9)


@query("SELECT 'y' AS column_name, count(*) FILTER (NOT y BETWEEN 0 AND 5000) AS n_out, round(sum(y) FILTER (y BETWEEN 0 AND 5000), 4) AS kept FROM v_sites UNION ALL SELECT 'lat', count(*) FILTER (NOT lat BETWEEN 30 AND 40), round(sum(lat) FILTER (lat BETWEEN 30 AND 40), 4) FROM v_sites")
def cleaned_bounds(spark, sf):
    df, notes = funnel.cleaned_bounds(views.sites(spark, sf), {"y": (0, 5000), "lat": (30, 40)})
    kept = df.agg(F.round(F.sum("y"), 4).alias("y"), F.round(F.sum("lat"), 4).alias("lat")).unpivot([], ["y", "lat"], "column_name", "kept")
    return notes.join(kept, "column_name")


@query("SELECT site_id, CASE WHEN site_id % 4 <> 0 THEN lat END AS q_lat, CASE WHEN site_id % 4 <> 0 THEN lon END AS q_lon FROM v_sites")
def column_families(spark, sf):
    s = views.sites(spark, sf).selectExpr("site_id", "CASE WHEN site_id % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE lat END AS q_lat", "CASE WHEN site_id % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE lon END AS q_lon", "CAST('NaN' AS DOUBLE) AS q_none", "label")
    s = funnel.drop_empty_columns(src.to_nulls(s), ["site_id"])
    return s.select("site_id", *funnel.columns_like(s, "^q_"))


@query()
def located_sites(spark, sf):
    """Sites written as eastings and northings of a lost or wrong zone, or degrees of lost sign or order, found again."""
    s = funnel.utm_of(views.sites(spark, sf)).withColumnsRenamed({"lat": "true_lat", "lon": "true_lon"})
    k = F.col("site_id") % 6
    raw = s.select("site_id", "true_lat", "true_lon", F.when(k < 3, F.col("x")).when(k == 3, F.col("y")).when(k == 4, -F.col("true_lon")).otherwise(F.col("true_lat")).alias("rx"), F.when(k < 3, F.col("y")).when(k == 3, F.col("x")).when(k == 4, F.col("true_lat")).otherwise(-F.col("true_lon")).alias("ry"), F.when(k == 1, F.lit(None)).when(k == 2, F.lit(60)).otherwise(F.col("zone")).alias("rz"))
    return _rounded(funnel.located(raw, "rx", "ry", "rz", (-124.5, -67.5, 24.5, 49.5)).select("site_id", "lat", "lon", "box_distance", "location_flags"))


# streams


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= mark""")
def closed_windows_stream(spark, sf):
    s = windows.tumbling(windows.events_stream(spark, f"{sf}/events.parquet"), "1 day", "2 days", ["event_type"])
    out = windows.closed(s, "closed")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

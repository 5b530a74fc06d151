"""Further queries: samplers, checks, small joins and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from terravane.operators import extra, match, raster
from terravane.plans import views
from terravane.queries import _matched, _rounded, query


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL AND c_nationkey = 3")
def row_query(spark, sf):
    return views.table(spark, sf, "customer").filter(extra.where("c_mktsegment in ['BUILDING', 'MACHINERY'] and c_acctbal.notna() and c_nationkey == 3")).select("c_custkey")


@query("SELECT p_partkey, round(ln(1 + (p_retailprice / 2) / nullif(p_size % 10, 0)), 6) AS v, round(p_size / nullif((p_partkey % 3) / 4.0e0, 0) - 1, 6) AS w FROM part")
def expression_column(spark, sf):
    p = extra.computed(views.table(spark, sf, "part"), "v", "(p_retailprice / 2) / (p_size % 10)", log=True)
    return _rounded(extra.computed(p, "w", "p_size / ((p_partkey % 3) / 4) - 1").select("p_partkey", "v", "w"))


@query("""SELECT c_nationkey AS package, count(*) AS n_orphans FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1""")
def orphan_counts(spark, sf):
    c = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("package"))
    return extra.orphans(c, views.table(spark, sf, "events").select(F.col("user_id").alias("k")), "k", "package")[1]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE NULL END AS code, CASE WHEN c_custkey % 3 = 0 THEN 'final' WHEN c_custkey % 3 = 1 THEN 'field' END AS code_source FROM customer""")
def code_resolution(spark, sf):
    c = views.table(spark, sf, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' END AS a", "CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS b")
    return extra.resolved_code(c, [("a", "final"), ("b", "field")]).select("c_custkey", "code", "code_source")


@query("""WITH d AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), f AS (
  SELECT c_custkey, 0 AS p, d FROM customer JOIN d ON k = c_custkey * 2 UNION ALL SELECT c_custkey, 1, d FROM customer JOIN d ON k = c_custkey),
g AS (SELECT c_custkey, p, min(d) AS s, max(d) AS e FROM f GROUP BY ALL)
SELECT c_custkey, CAST(p AS INT) AS priority, s AS start_day, e AS end_day FROM g x WHERE p = (SELECT min(p) FROM g y WHERE y.c_custkey = x.c_custkey)""")
def dates_by_name(spark, sf):
    d = views.table(spark, sf, "orders").selectExpr("o_custkey AS k", "CAST(o_orderdate AS DATE) AS start_day", "CAST(o_orderdate AS DATE) AS end_day")
    c = views.table(spark, sf, "customer").select("c_custkey")
    return extra.named_dates(c, "c_custkey", {"double": F.col("c_custkey") * 2, "own": F.col("c_custkey")}, d, "k", "start_day", "end_day")


@query("""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT 'Brand#' || s_nationkey AS q FROM supplier) WHERE starts_with(p_brand, q) OR starts_with(q, p_brand))
UNION ALL SELECT n_nationkey + 1000000000 FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE starts_with(n_name, substr(r_name, 1, 2)) OR starts_with(substr(r_name, 1, 2), n_name))""")
def prefix_match(spark, sf):
    q = views.table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("q")).distinct()
    short = views.table(spark, sf, "region").select(F.substring("r_name", 1, 2).alias("q"))
    named = extra.prefixed(views.table(spark, sf, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("p_partkey"), "n_name"), short, "n_name", "q").select("p_partkey")
    return named.union( extra.prefixed(views.table(spark, sf, "part").select("p_partkey", "p_brand"), q, "p_brand", "q").select("p_partkey"))


@query("""WITH p AS (SELECT DISTINCT cloud_id, x, y FROM v_points),
c AS (SELECT *, unnest(range(CAST(floor((x - 15.03e0)/20) AS BIGINT), CAST(floor((x + 15.03e0)/20) AS BIGINT) + 1)) AS i FROM p),
d AS (SELECT *, unnest(range(CAST(floor((y - 15.03e0)/20) AS BIGINT), CAST(floor((y + 15.03e0)/20) AS BIGINT) + 1)) AS j FROM c)
SELECT cloud_id, x, y, i, j FROM d WHERE pow(greatest(i*20 - x, x - (i + 1)*20, 0), 2) + pow(greatest(j*20 - y, y - (j + 1)*20, 0), 2) <= 15.03e0*15.03e0""")
def touched_cells(spark, sf):
    return extra.touched_cells(views.points(spark, sf).select("cloud_id", "x", "y").distinct(), "x", "y", 15.03, 20.0)


@query("""WITH f AS (SELECT ordinal, xmin + w/2 AS x, ymin + h/2 AS y FROM v_footprints),
d AS (SELECT site_id, ordinal, greatest(abs(lon - f.x), abs(lat - f.y)) AS distance FROM v_sites, f)
SELECT site_id, ordinal, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY distance, ordinal) AS k FROM d WHERE distance <= 1.02) WHERE k = 1""")
def nearest_square(spark, sf):
    f = views.footprints(spark, sf).selectExpr("ordinal", "xmin + w / 2 AS x", "ymin + h / 2 AS y")
    s = views.sites(spark, sf).selectExpr("site_id", "lon AS x", "lat AS y")
    return _rounded(extra.nearest_square(s, f, "site_id", "ordinal", 1.0))


@query("""WITH a AS (SELECT cloud_id, l_orderkey AS ka, x, y, z FROM v_points WHERE l_linenumber = 1), b AS (SELECT cloud_id, l_orderkey * 100000 + l_partkey AS kb, x, y, z FROM v_points WHERE l_linenumber <> 1),
d AS (SELECT a.cloud_id, ka, kb, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM (SELECT cloud_id, ka, min(x) AS x, min(y) AS y, min(z) AS z FROM a GROUP BY ALL) a JOIN b USING (cloud_id))
SELECT cloud_id, ka, kb, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id, ka ORDER BY d2, kb) AS k FROM d WHERE d2 <= 400) WHERE k = 1""")
def nearest_point_match(spark, sf):
    p = views.points(spark, sf)
    a = p.filter("l_linenumber = 1").groupBy("cloud_id", F.col("l_orderkey").alias("ka")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("z").alias("z"))
    b = p.filter("l_linenumber <> 1").selectExpr("cloud_id", "l_orderkey * 100000 + l_partkey AS kb", "x", "y", "z")
    return _rounded(extra.nearest_in_cell(a, b, "cloud_id", "ka", "kb", 20.0))


@query("""WITH r AS (SELECT p_partkey, sqrt(p_retailprice) AS w, sum(sqrt(p_retailprice)) OVER (ORDER BY p_partkey) AS hi FROM part), t AS (SELECT sum(w) AS total FROM r),
d AS (SELECT CAST('0x' || substr(md5('3:' || i), 1, 13) AS BIGINT) / 4503599627370496.0e0 * total AS x FROM (SELECT unnest(range(1000)) AS i), t)
SELECT p_partkey, count(*) AS n FROM r JOIN d ON x >= hi - w AND x < hi GROUP BY p_partkey""")
def weighted_sample(spark, sf):
    return extra.weighted_clusters(views.table(spark, sf, "part"), "p_partkey", F.sqrt("p_retailprice"), 1000, 3)


@query()
def location_sequence(spark, sf):
    f = views.footprints(spark, sf).orderBy("ordinal").select("name", "w", "rings").collect()  # a catalogue of tiles
    tiles = [(r.name, r.w, [[(v.x, v.y) for v in ring] for ring in r.rings]) for r in f]
    return extra.locations(spark, 500, tiles, 20261029, ([(-100.0, 40.0), (-110.0, 35.0)], 150_000.0))


@query("""WITH t AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('9:' || c_custkey), c_custkey) AS t FROM customer),
u AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY t) AS k FROM t WHERE t <= 12 AND c_acctbal > 0) SELECT c_custkey FROM u WHERE k <= 3""")
def draw_until_usable(spark, sf):
    return extra.drawn_until(views.table(spark, sf, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal") > 0, 3, 12, 9).select("c_custkey")


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INT) AS bin FROM customer")
def quantile_bins(spark, sf):
    return extra.quantile_bins(views.table(spark, sf, "customer"), "c_acctbal", 4, "c_custkey", ["c_nationkey"]).select("c_custkey", "bin")


@query("SELECT cloud_id, n, CAST(sum(n) OVER (ORDER BY cloud_id) AS BIGINT) AS offset_end FROM (SELECT cloud_id, count(*) AS n FROM v_points GROUP BY 1)")
def batch_offsets(spark, sf):
    return extra.cumulative_offsets(views.points(spark, sf).groupBy("cloud_id").agg(F.count("*").alias("n")), "cloud_id", "n")


_PLOT = """CASE p_partkey % 9 WHEN 0 THEN 'Circular' WHEN 1 THEN 'square plot' WHEN 2 THEN 'Rectangular' WHEN 3 THEN 'belt transect' WHEN 4 THEN 'observation' WHEN 5 THEN 'N/A' WHEN 6 THEN 'semi-circle' WHEN 7 THEN 'estimate' END AS s,
 CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS r, CASE WHEN p_partkey % 4 = 1 THEN p_size * {two} END AS d,
 CASE WHEN p_partkey % 4 >= 2 THEN p_size * {five} END AS a, CASE WHEN p_partkey % 4 = 2 THEN CAST(p_size - 10 AS DOUBLE) END AS b"""


@query(f"""WITH p AS (SELECT p_partkey, {_PLOT.format(two="2.0e0", five="5.0e0")} FROM part),
k AS (SELECT *, CASE WHEN s = 'semi-circle' THEN 'other' WHEN s = 'observation' THEN 'point' WHEN s = 'belt transect' THEN 'transect' WHEN s = 'Circular' THEN 'circle' WHEN s = 'square plot' THEN 'square' WHEN s = 'Rectangular' THEN 'rectangle'
  WHEN s IS NULL OR s = 'estimate' THEN 'unknown' ELSE 'other' END AS kind, coalesce(r > 100, false) OR coalesce(d > 200, false) OR coalesce(a > 200, false) OR coalesce(b > 200, false) AS bad FROM p),
v AS (SELECT p_partkey, kind, bad, CASE WHEN r > 0 AND NOT bad THEN r END AS r, CASE WHEN d > 0 AND NOT bad THEN d END AS d, CASE WHEN a > 0 AND NOT bad THEN a END AS a, CASE WHEN b > 0 AND NOT bad THEN b END AS b FROM k),
x AS (SELECT *, CASE WHEN r IS NOT NULL AND kind IN ('circle', 'unknown') THEN 'radius' WHEN d IS NOT NULL AND kind IN ('circle', 'unknown') THEN 'diameter' WHEN a IS NOT NULL AND b IS NOT NULL AND kind NOT IN ('circle', 'point') THEN 'length_x_width'
  WHEN (a IS NOT NULL OR b IS NOT NULL) AND kind = 'square' THEN 'side' WHEN r IS NOT NULL THEN 'radius' ELSE 'none' END AS basis FROM v)
SELECT p_partkey, kind AS plot_shape, basis AS plot_basis, round(CASE basis WHEN 'radius' THEN 3.141592653589793e0*r*r WHEN 'diameter' THEN 3.141592653589793e0*d*d/4 WHEN 'length_x_width' THEN a*b WHEN 'side' THEN pow(coalesce(a, b), 2) END, 5) AS plot_area,
 CASE WHEN bad THEN 'implausible_dimension_ignored' WHEN basis = 'none' THEN 'no_usable_dimensions' ELSE 'ok' END AS plot_flag FROM x""")
def plot_areas(spark, sf):
    p = views.table(spark, sf, "part").selectExpr("p_partkey", *[f"{e.strip()}" for e in _PLOT.format(two="2.0D", five="5.0D").replace(" AS s,", " AS s;").replace(" AS r,", " AS r;").replace(" AS d,", " AS d;").replace(" AS a,", " AS a;").split(";")])
    out = extra.plot_footprint(p, "s", "r", "d", "a", "b")
    return _rounded(out.select("p_partkey", "plot_shape", "plot_basis", "plot_area", "plot_flag"), 5)


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 0.5e0 WHEN 1 THEN 3.0e0 WHEN 2 THEN 15.0e0 END AS pct FROM part")
def cover_codes(spark, sf):
    p = views.table(spark, sf, "part").selectExpr("p_partkey", "CASE p_size % 4 WHEN 0 THEN '01' WHEN 1 THEN '2' WHEN 2 THEN '003' ELSE 'x' END AS c")
    return p.select("p_partkey", extra.cover_percent(F.col("c"), {"1": 0.5, "02": 3.0, "3": 15.0}).alias("pct"))


@query("""SELECT site_id, CAST(floor(lat) AS INT) * 16 + 7 * 2 + 1 AS qi FROM v_sites""")
def quad_rows(spark, sf):
    s = views.sites(spark, sf).withColumn("q", F.format_string("%02d%03d%02d_nw", F.floor("lat"), F.ceil(-F.col("lon")), (F.col("site_id") % 8) + 1))
    return s.select("site_id", extra.quad_cell(F.col("q"))[0].alias("qi"))


@query("""SELECT site_id, lat_d * 16 + (7 - (q - 1) // 8) * 2 + CAST(n AS INT) AS row_no, -lon_d * 16 - 16 + ((q - 1) % 8) * 2 + CAST(e AS INT) AS col_no FROM (
  SELECT site_id, CAST(floor(lat) AS INT) AS lat_d, CAST(floor(-lon) AS INT) AS lon_d, CAST(site_id % 64 + 1 AS INT) AS q, site_id % 2 = 0 AS n, site_id % 3 = 0 AS e FROM v_sites)""")
def quad_cells(spark, sf):
    name = "printf('%02d%03d%02d_%s%s', CAST(floor(lat) AS INT), CAST(floor(-lon) AS INT), CAST(site_id % 64 + 1 AS INT), if(site_id % 2 = 0, 'n', 's'), if(site_id % 3 = 0, 'e', 'w'))"
    row, col = extra.quad_cell(F.expr(name))
    return views.sites(spark, sf).select("site_id", row.alias("row_no"), col.alias("col_no"))


@query("""SELECT grp, CAST(sum(n) AS BIGINT) AS n, round(sum(t)/sum(n), 6) AS mean, round(CAST(sum(n) AS DOUBLE)/max(e), 6) AS coverage FROM (SELECT grp, label, count(*) AS n, sum(y) AS t, 80 AS e FROM v_sites GROUP BY ALL) GROUP BY grp""")
def partials_merged(spark, sf):
    p = views.sites(spark, sf).groupBy("grp", "label").agg(F.count("*").alias("n"), F.sum("y").alias("t")).withColumn("e", F.lit(80))
    return _rounded(extra.merged_partials(p, ["grp"], "n", "t", "e"))


@query("""WITH m AS (SELECT avg(lat) AS mx, avg(y) AS my, count(*) AS n, regr_slope(y, lat) AS b, var_pop(lat) * count(*) AS sxx FROM v_sites),
u AS (SELECT grp, sum((lat - mx) * (y - my - b * (lat - mx))) AS u FROM v_sites, m GROUP BY grp)
SELECT max(n) AS n, round(max(b), 6) AS slope, round(sqrt(sum(u*u) * count(*) / (count(*) - 1.0e0)) / max(sxx), 6) AS se FROM u, m""")
def robust_slope(spark, sf):
    return _rounded(extra.robust_slope(views.sites(spark, sf), "lat", "y", "grp"))


@query("SELECT label, count(*) AS attempts, count(name) AS covered, count(*) FILTER (gap <= 2) AS near FROM (SELECT m.*, s.label FROM v_matched m JOIN v_sites s USING (site_id)) GROUP BY label")
def coverage_funnel(spark, sf):
    return _matched(spark, sf).groupBy("label").agg(F.count("*").alias("attempts"), F.count("name").alias("covered"), F.count_if(F.col("gap") <= 2).alias("near"))


# rasters

_GRID = """g AS (SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS i, CAST(floor(y/20) AS BIGINT) AS j, avg(z) AS value FROM v_points GROUP BY 1, 2, 3)"""


def _grid(spark, sf):
    p = views.points(spark, sf)
    return p.groupBy("cloud_id", F.floor(F.col("x") / 20).cast("long").alias("i"), F.floor(F.col("y") / 20).cast("long").alias("j")).agg(F.avg("z").alias("value"))


@query(f"""WITH {_GRID} SELECT g.cloud_id, g.i, g.j, round(sqrt(pow(a.value - b.value, 2) + pow(c.value - d.value, 2))/2, 6) AS gradient FROM g
 JOIN g a ON a.cloud_id = g.cloud_id AND a.i = g.i - 1 AND a.j = g.j JOIN g b ON b.cloud_id = g.cloud_id AND b.i = g.i + 1 AND b.j = g.j
 JOIN g c ON c.cloud_id = g.cloud_id AND c.i = g.i AND c.j = g.j - 1 JOIN g d ON d.cloud_id = g.cloud_id AND d.i = g.i AND d.j = g.j + 1""")
def gradient_magnitude(spark, sf):
    return _rounded(raster.gradient(_grid(spark, sf), "cloud_id", "value"))


@query(f"""WITH {_GRID}, s AS (SELECT CAST(unnest(range(-2, 3)) AS INT) AS d), h AS (SELECT cloud_id, i + 1 AS i, j - 2 AS j, value FROM g)
SELECT g.cloud_id, a.d AS di, b.d AS dj, count(*) AS n, round(corr(g.value, h.value), 6) AS r FROM g, s a, s b, h WHERE h.cloud_id = g.cloud_id AND h.i = g.i + a.d AND h.j = g.j + b.d GROUP BY ALL""")
def shift_surface(spark, sf):
    g = _grid(spark, sf)
    moved = g.selectExpr("cloud_id", "i + 1 AS i", "j - 2 AS j", "value")
    return _rounded(raster.shift_surface(g, moved, "cloud_id", 2).select("cloud_id", "di", "dj", "n", "r"))


@query("SELECT DISTINCT cloud_id, 1::BIGINT AS di, -2::BIGINT AS dj, 1.0e0 AS r FROM v_points")
def known_shift_fft(spark, sf):
    g = _grid(spark, sf)
    moved = g.selectExpr("cloud_id", "i + 1 AS i", "j - 2 AS j", "value")
    return _rounded(raster.fft_shift(g, moved, "cloud_id", 3))


@query(f"""WITH {_GRID} SELECT cloud_id, CAST(floor(i/5.0e0) AS BIGINT) AS wi, CAST(floor(j/5.0e0) AS BIGINT) AS wj, round(sum(value*value)/sum(value), 6) AS mean, round(sum(value), 6) AS weight FROM g GROUP BY 1, 2, 3""")
def window_means(spark, sf):
    return _rounded(raster.window_means(_grid(spark, sf), "cloud_id", 5, F.col("value"), F.col("value")))


@query("""WITH o AS (SELECT DISTINCT CAST(floor(lon) AS BIGINT) AS i, CAST(floor(lat) AS BIGINT) AS j FROM v_sites),
r AS (SELECT DISTINCT i + a AS i, j + b AS j FROM o, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
p AS (SELECT name, coalesce(collection_year, 2000) AS year, CAST(unnest(range(CAST(floor(xmin) AS BIGINT), CAST(floor(xmin) AS BIGINT) + 3)) AS BIGINT) AS i, CAST(floor(ymin) AS BIGINT) AS j FROM v_footprints)
SELECT i, j, name, CAST(k AS INT) AS rank FROM (SELECT r.i, r.j, name, row_number() OVER (PARTITION BY r.i, r.j ORDER BY year DESC, name) AS k FROM r JOIN p USING (i, j)) WHERE k <= 2""")
def unit_plan(spark, sf):
    s = views.sites(spark, sf).selectExpr("lon AS x", "lat AS y")
    p = views.footprints(spark, sf).selectExpr("name", "coalesce(collection_year, 2000) AS year", "explode(sequence(CAST(floor(xmin) AS BIGINT), CAST(floor(xmin) AS BIGINT) + 2)) AS i", "CAST(floor(ymin) AS BIGINT) AS j")
    return raster.planned_units(s, 1.0, 1, p, 2)


@query("""WITH RECURSIVE e AS (SELECT a.site_id AS a, b.site_id AS b FROM v_sites a JOIN v_sites b ON a.site_id <> b.site_id AND abs(a.lat - b.lat) < 0.9
  WHERE sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat)/2)) * 111320.0e0, 2) + pow((b.lat - a.lat) * 111320.0e0, 2)) <= 90000),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS site_id, least(a, min(b)) AS component FROM r GROUP BY a""")
def revisit_components(spark, sf):
    return match.components_within(views.sites(spark, sf), 90_000.0, "site_id", "revisits").select(F.col("id").alias("site_id"), F.col("comp").alias("component"))


@query("""WITH c AS (SELECT name, xmin + w/2 AS cx, ymin + h/2 AS cy, w, h, unnest(range(CAST(floor(xmin) AS BIGINT), CAST(floor(xmin + w) AS BIGINT) + 1)) AS i, ymin FROM v_footprints),
d AS (SELECT name, cx, cy, w, h, i, unnest(range(CAST(floor(ymin) AS BIGINT), CAST(floor(ymin + h) AS BIGINT) + 1)) AS j FROM c)
SELECT name, i, j FROM d WHERE greatest(abs(i - cx), abs(i + 1 - cx))/(w/2) + greatest(abs(j - cy), abs(j + 1 - cy))/(h/2) <= 1 + 1e-9""")
def fully_covered_cells(spark, sf):
    return extra.covered_cells(views.footprints(spark, sf), "name", 1.0, 1 - 1e-9).select("name", "i", "j")


_TOP = "least(j + 1, cy + h/2*(1 - abs(x - cx)/(w/2)))"
_BOTTOM = "greatest(j, cy - h/2*(1 - abs(x - cx)/(w/2)))"


@query(f"""WITH c AS (SELECT name, xmin + w/2 AS cx, ymin + h/2 AS cy, w, h, unnest(range(CAST(floor(xmin) AS BIGINT), CAST(floor(xmin + w) AS BIGINT) + 1)) AS i, ymin FROM v_footprints),
d AS (SELECT name, cx, cy, w, h, i, unnest(range(CAST(floor(ymin) AS BIGINT), CAST(floor(ymin + h) AS BIGINT) + 1)) AS j FROM c),
b AS (SELECT *, list_sort(list_distinct(list_transform([i, i + 1, cx, cx - w/2, cx + w/2, cx - w/2*(1 - abs(j - cy)/(h/2)), cx + w/2*(1 - abs(j - cy)/(h/2)), cx - w/2*(1 - abs(j + 1 - cy)/(h/2)), cx + w/2*(1 - abs(j + 1 - cy)/(h/2))], lambda v: least(greatest(v, i), i + 1)))) AS xs FROM d),
p AS (SELECT name, i, j, cx, cy, w, h, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM b), f AS (SELECT *, greatest({_TOP} - {_BOTTOM}, 0) AS t FROM p),
s AS (SELECT a.name, a.i, a.j, sum((b.x - a.x)*(a.t + b.t)/2) AS share FROM f a JOIN f b ON a.name = b.name AND a.i = b.i AND a.j = b.j AND b.k = a.k + 1 GROUP BY 1, 2, 3)
SELECT name, i, j, round(share, 6) AS share FROM s WHERE share >= 0.25 - 1e-9""")
def half_covered_cells(spark, sf):
    return _rounded(extra.covered_cells(views.footprints(spark, sf), "name", 1.0, 0.25 - 1e-9))


@query(f"""WITH RECURSIVE {_GRID}, h AS (SELECT cloud_id, i, j, value, i * 1000 + j AS id FROM g WHERE value > 27.0e0),
e AS (SELECT a.cloud_id, a.id AS a, b.id AS b FROM h a JOIN h b ON a.cloud_id = b.cloud_id AND abs(a.i - b.i) + abs(a.j - b.j) <= 1),
r AS (SELECT cloud_id, a, b FROM e UNION SELECT r.cloud_id, r.a, e.b FROM r JOIN e ON r.cloud_id = e.cloud_id AND r.b = e.a),
c AS (SELECT cloud_id, a, min(b) AS root FROM r GROUP BY 1, 2)
SELECT c.cloud_id, arg_min(i, id) || '_' || arg_min(j, id) AS landmark, count(*) AS n, round(avg(i), 6) AS ci, round(avg(j), 6) AS cj, round(max(value), 6) AS height
FROM c JOIN h ON h.cloud_id = c.cloud_id AND h.id = c.a GROUP BY c.cloud_id, root HAVING count(*) >= 2""")
def landmark_cells(spark, sf):
    return _rounded(raster.landmarks(_grid(spark, sf), "cloud_id", "value", 27.0, 2))


@query(f"""WITH {_GRID}, k AS (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS k), o AS (SELECT g.cloud_id, g.i, g.j, max(h.value - k * tan(radians(20.0e0)) * 2 - g.value) AS d
 FROM g, k, g h WHERE h.cloud_id = g.cloud_id AND h.i = g.i + k AND h.j = g.j GROUP BY ALL)
SELECT g.cloud_id, g.i, g.j, round(greatest(coalesce(d, 0), 0), 6) AS depth FROM g LEFT JOIN o ON o.cloud_id = g.cloud_id AND o.i = g.i AND o.j = g.j""")
def shadow_depths(spark, sf):
    return _rounded(raster.shadow_depth(_grid(spark, sf), "cloud_id", 90.0, 20.0, 2.0, 5))

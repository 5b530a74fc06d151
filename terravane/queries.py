"""Every registered query of the engine's own operators, and equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions import text as tx
from terravane.operators import cloud, embed, funnel, labels, match, metrics, probe, splits
from terravane.plans import views
from terravane.runtime import ship
from terravane.sources import tables as src
from terravane.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# the derived views in SQL
_V = {
    "v_sites": """SELECT c_custkey AS site_id, 25.0e0 + ((c_custkey*7919) % 2400)/100.0e0 AS lat, -124.0e0 + ((c_custkey*104729) % 5600)/100.0e0 AS lon,
       CAST(2005 + c_custkey % 18 AS INT) AS year, c_mktsegment AS label, c_nationkey AS grp, c_acctbal AS y FROM customer""",
    "v_footprints": """SELECT s_name AS name, s_suppkey AS ordinal, -124.0e0 + (s_suppkey*37) % 50 AS xmin, 25.0e0 + (s_suppkey*13) % 20 AS ymin,
       6.0e0 + s_suppkey % 7 AS w, 5.0e0 + s_suppkey % 5 AS h, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(2008 + s_suppkey % 15 AS INT) END AS collection_year FROM supplier""",
    "v_points": """SELECT l_orderkey % 50 AS cloud_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       ((l_partkey*31 + l_linenumber*17) % 2000)/10.0e0 - 100.0e0 AS x, ((l_suppkey*53 + l_orderkey*7) % 2000)/10.0e0 - 100.0e0 AS y, l_quantity AS z, l_quantity/2.0e0 AS hag,
       CAST(FLOOR(l_extendedprice) AS BIGINT) % 65536 AS intensity, CAST(1 + l_linenumber % 3 AS INT) AS return_number,
       CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 7 END AS classification FROM lineitem""",
    "v_detections": "SELECT user_id AS deployment, event_type AS species, event_id, ts AS start_ts, value AS dur_s FROM events",
    "v_rasters": "SELECT o_orderkey AS file_id, o_custkey % 40 AS cell, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS size FROM orders",
    "v_visits": "SELECT o_orderkey AS visit_id, o_custkey AS site_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS label FROM orders",
    "v_pairs": """SELECT s.*, f.name, f.ordinal, f.collection_year FROM v_sites s JOIN v_footprints f
       ON abs(s.lon-(f.xmin+f.w/2))/(f.w/2) + abs(s.lat-(f.ymin+f.h/2))/(f.h/2) < 1 - 1e-9""",
    "v_matched": """SELECT s.site_id, s.year, m.name, m.collection_year, m.gap, m.year_diff FROM v_sites s LEFT JOIN (
       SELECT *, abs(collection_year - year) AS gap, collection_year - year AS year_diff, row_number() OVER (PARTITION BY site_id ORDER BY abs(collection_year - year), ordinal) AS k
       FROM v_pairs WHERE collection_year IS NOT NULL) m ON s.site_id = m.site_id AND m.k = 1""",
    "v_md5": """SELECT site_id, lat, lon, label, grp, CAST(FLOOR(lat/0.25e0) AS BIGINT) || '_' || CAST(FLOOR(lon/0.25e0) AS BIGINT) AS block FROM v_sites""",
    "v_split": "SELECT *, CAST('0x' || substr(md5('20261029:0.25:' || block), 1, 13) AS BIGINT) / 4503599627370496.0e0 < 0.5e0 AS is_test FROM v_md5",
    "v_emb": "SELECT vec_id, label, vec_id % 2 = 1 AS is_test, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "v_score": "SELECT vec_id, label, v[1] + 0.5e0 * v[2] AS s, round(v[3], 1) AS tied, v[4] AS p, v[1] AS truth FROM v_emb",
}


def _sql(body: str) -> str:
    """The views that body needs, before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, sql in _V.items():
            if name in text and name not in need:
                add(sql)
                need.append(name)

    add(body)
    order = [n for n in _V if n in need]
    views_ = ",\n".join(f"{n} AS ({_V[n]})" for n in order)
    body = body.strip()
    if not views_:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views_},\n{body[15:]}"
    return f"WITH {views_},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views_}\n{body}"


def query(sql: str | None = None):
    def put(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = _sql(sql)
        return fn

    return put


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return match.matched_sites(views.sites(spark, sf), views.footprints(spark, sf))


# matching


@query("SELECT name, count(*) AS n_sites, min(gap) AS least_gap FROM v_matched WHERE gap <= 3 GROUP BY name")
def product_counts(spark, sf):
    return _matched(spark, sf).filter("gap <= 3").groupBy("name").agg(F.count("*").alias("n_sites"), F.min("gap").alias("least_gap"))


@query("SELECT site_id, name, collection_year, gap, year_diff FROM v_matched")
def match_nearest_year(spark, sf):
    return _matched(spark, sf).select("site_id", "name", "collection_year", "gap", "year_diff")


@query("SELECT site_id, name FROM v_pairs")
def covering_products(spark, sf):
    return match.covering(views.sites(spark, sf), views.footprints(spark, sf), "ordinal").select("site_id", "name")


@query("SELECT CAST(n AS INT) AS max_gap, (SELECT count(*) FROM v_matched WHERE gap <= n) AS n_rows FROM range(6) t(n)")
def gap_counts(spark, sf):
    return match.gap_counts(_matched(spark, sf))


@query("""SELECT site_id, name, collection_year, gap FROM (SELECT *, greatest(2010 - collection_year, 0) + greatest(collection_year - 2013, 0) AS gap,
  row_number() OVER (PARTITION BY site_id ORDER BY greatest(2010 - collection_year, 0) + greatest(collection_year - 2013, 0), collection_year DESC, name) AS k
  FROM v_pairs WHERE collection_year IS NOT NULL) WHERE k = 1""")
def match_window_year(spark, sf):
    pairs = match.covering(views.sites(spark, sf), views.footprints(spark, sf), "ordinal")
    return match.nearest_to_window(pairs, ["site_id"], F.col("collection_year"), 2010, 2013, ["name", "collection_year"])


@query("""SELECT s.site_id, m.year AS found_year, m.file_id FROM v_sites s LEFT JOIN (
  SELECT s.site_id, r.year, r.file_id, row_number() OVER (PARTITION BY s.site_id ORDER BY abs(r.year - s.year), r.year, r.file_id) AS k
  FROM v_sites s JOIN v_rasters r ON s.site_id % 40 = r.cell) m ON s.site_id = m.site_id AND m.k = 1""")
def year_fallback_locate(spark, sf):
    left = views.sites(spark, sf).selectExpr("site_id", "site_id % 40 AS cell", "year")
    return match.with_fallback(left, views.rasters(spark, sf), "cell", "year", ["file_id"], later=False, tie=["file_id"]).select("site_id", "found_year", "file_id")


@query("""WITH big AS (SELECT cell, year, arg_max(file_id, (size, -file_id)) AS file_id FROM v_rasters GROUP BY cell, year)
SELECT s.site_id, m.year AS found_year, m.file_id FROM v_sites s LEFT JOIN (
  SELECT s.site_id, r.year, r.file_id, row_number() OVER (PARTITION BY s.site_id ORDER BY abs(r.year - s.year), r.year DESC) AS k
  FROM v_sites s JOIN big r ON s.site_id % 40 = r.cell) m ON s.site_id = m.site_id AND m.k = 1""")
def cell_file_pick(spark, sf):
    big = labels.best_row(views.rasters(spark, sf), ["cell", "year"], ["file_id"], F.struct(-F.col("size"), F.col("file_id")))
    left = views.sites(spark, sf).selectExpr("site_id", "site_id % 40 AS cell", "year")
    return match.with_fallback(left, big, "cell", "year", ["file_id"], later=True, tie=["file_id"]).select("site_id", "found_year", "file_id")


_DIST = "sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat)/2)) * 111320.0e0, 2) + pow((b.lat - a.lat) * 111320.0e0, 2))"


@query(f"""WITH c AS (SELECT xmin + w/2 AS lon, ymin + h/2 AS lat FROM v_footprints)
SELECT a.site_id FROM v_sites a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE {_DIST} <= 60000)""")
def exclude_within_radius(spark, sf):
    centres = views.footprints(spark, sf).selectExpr("xmin + w / 2 AS lon", "ymin + h / 2 AS lat")
    return match.outside(views.sites(spark, sf), centres, 60_000.0, "site_id").select("site_id")


@query(f"SELECT a.site_id AS a_site_id, b.site_id AS b_site_id, round({_DIST}, 3) AS distance FROM v_sites a JOIN v_sites b ON a.site_id < b.site_id AND abs(a.lat - b.lat) < 1.2 WHERE {_DIST} <= 120000 AND abs(a.year - b.year) >= 1")
def revisit_pairs(spark, sf):
    pairs = match.pairs_within(views.sites(spark, sf), 120_000.0, "site_id", ["year"], digits=3).filter("abs(a_year - b_year) >= 1")
    return pairs.select("a_site_id", "b_site_id", "distance")


@query(f"""WITH c AS (SELECT ordinal, xmin + w/2 AS lon, ymin + h/2 AS lat FROM v_footprints),
d AS (SELECT a.site_id, b.ordinal, {_DIST} AS distance FROM v_sites a CROSS JOIN c b),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY distance, ordinal) AS k_rank FROM d)
SELECT site_id, ordinal, round(distance, 3) AS distance, CAST(k_rank AS INT) AS k_rank FROM r WHERE k_rank <= 3""")
def knn_spatial(spark, sf):
    centres = views.footprints(spark, sf).selectExpr("ordinal", "xmin + w / 2 AS lon", "ymin + h / 2 AS lat")
    return match.nearest_k(views.sites(spark, sf), centres, 3, "site_id", "ordinal", 100_000.0).select("site_id", "ordinal", F.round("distance", 3).alias("distance"), "k_rank")


# filters and checks

_STEPS = [("positive", "c_acctbal > 0"), ("machinery_or_building", "c_mktsegment IN ('MACHINERY', 'BUILDING')"), ("even_nation", "c_nationkey % 2 = 0"), ("below_8000", "c_acctbal < 8000")]


@query(
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT {i} AS step_no, '{'all' if not i else _STEPS[i - 1][0]}' AS step, (SELECT count(*) FROM customer WHERE {' AND '.join(p for _, p in _STEPS[:i]) or 'true'}) AS n" for i in range(len(_STEPS) + 1))
    + ") SELECT step_no, step, n, coalesce(lag(n) OVER (ORDER BY step_no) - n, 0) AS dropped FROM s"
)
def filter_funnel(spark, sf):
    return funnel.funnel(views.table(spark, sf, "customer"), [(n, F.expr(p)) for n, p in _STEPS])


@query("""WITH c AS (SELECT CASE WHEN site_id % 17 = 0 THEN NULL WHEN site_id % 13 = 0 THEN lon WHEN site_id % 19 = 0 THEN 0.0e0 ELSE lat END AS lat,
  CASE WHEN site_id % 13 = 0 THEN lat WHEN site_id % 11 = 0 AND site_id % 19 <> 0 THEN -lon WHEN site_id % 19 = 0 THEN 0.0e0 ELSE lon END AS lon FROM v_sites),
f AS (SELECT lat IS NULL OR lon IS NULL AS missing, lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS oor,
  coalesce(lat = 0 AND lon = 0, false) AS zero, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND NOT (lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50), false) AS outside,
  coalesce(lat BETWEEN -125 AND -66 AND lon BETWEEN 24 AND 50, false) AS sw, coalesce(-lon BETWEEN -125 AND -66 AND lat BETWEEN 24 AND 50, false) AS ls FROM c)
SELECT 'missing' AS check_name, count(*) FILTER (missing) AS n FROM f UNION ALL SELECT 'out_of_range', count(*) FILTER (oor) FROM f UNION ALL SELECT 'zero', count(*) FILTER (zero) FROM f
UNION ALL SELECT 'outside', count(*) FILTER (outside) FROM f UNION ALL SELECT 'swapped', count(*) FILTER (outside AND sw) FROM f UNION ALL SELECT 'lost_sign', count(*) FILTER (outside AND ls) FROM f""")
def coord_qa(spark, sf):
    return funnel.coordinate_checks(_spoilt(spark, sf), [(-125, -66, 24, 50)])


def _spoilt(spark, sf):
    return views.sites(spark, sf).selectExpr(
        "site_id",
        "CASE WHEN site_id % 17 = 0 THEN NULL WHEN site_id % 13 = 0 THEN lon WHEN site_id % 19 = 0 THEN 0.0D ELSE lat END AS lat",
        "CASE WHEN site_id % 13 = 0 THEN lat WHEN site_id % 11 = 0 AND site_id % 19 <> 0 THEN -lon WHEN site_id % 19 = 0 THEN 0.0D ELSE lon END AS lon",
    )


@query("""WITH c AS (SELECT site_id, CASE WHEN site_id % 17 = 0 THEN NULL WHEN site_id % 13 = 0 THEN lon WHEN site_id % 19 = 0 THEN 0.0e0 ELSE lat END AS y,
  CASE WHEN site_id % 13 = 0 THEN lat WHEN site_id % 11 = 0 AND site_id % 19 <> 0 THEN -lon WHEN site_id % 19 = 0 THEN 0.0e0 ELSE lon END AS x FROM v_sites),
o AS (SELECT site_id, 0 AS k, y AS lat, x AS lon, 'as_is' AS flag FROM c UNION ALL SELECT site_id, 1, x, y, 'swapped' FROM c UNION ALL SELECT site_id, 2, y, -x, 'lon_sign' FROM c
  UNION ALL SELECT site_id, 3, -y, x, 'lat_sign' FROM c UNION ALL SELECT site_id, 4, -y, -x, 'both_signs' FROM c UNION ALL SELECT site_id, 5, x, -y, 'swapped_sign' FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY greatest(24 - lat, lat - 50, 0) + greatest(-125 - lon, lon + 66, 0), k) AS n FROM o WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
SELECT c.site_id, r.lat + 0.0e0 AS lat, r.lon + 0.0e0 AS lon, coalesce(flag, 'missing') AS coord_flag FROM c LEFT JOIN r ON r.site_id = c.site_id AND n = 1""")
def coord_repair(spark, sf):
    return funnel.repaired(_spoilt(spark, sf), (-125.0, -66.0, 24.0, 50.0))


@query("""WITH s AS (SELECT p_partkey, printf('%.4f', p_retailprice) AS t FROM part)
SELECT p_partkey, length(rtrim(split_part(t, '.', 2), '0')) AS n_decimals FROM s""")
def n_decimals(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", tx.n_decimals(F.format_string("%.4f", "p_retailprice")).cast("long").alias("n_decimals"))


@query("SELECT column_name, n_null FROM (SELECT count(*) FILTER (name IS NULL) AS name, count(*) FILTER (collection_year IS NULL) AS collection_year FROM v_footprints) UNPIVOT (n_null FOR column_name IN (name, collection_year))")
def health_nulls(spark, sf):
    return funnel.health(views.footprints(spark, sf).select("ordinal", "name", "collection_year"), "ordinal").filter("column_name <> 'ordinal'").select("column_name", "n_null")


@query("SELECT site_id, CAST(CAST(FLOOR((lon + 180)/6) AS BIGINT) % 60 + 1 AS INT) AS zone FROM v_sites")
def utm_zones(spark, sf):
    return funnel.utm_of(views.sites(spark, sf)).select("site_id", "zone")


def _series(terms: list[float], inner: str) -> str:
    return " + ".join(f"({w!r}) * {inner.format(k=2 * j)}" for j, w in enumerate(terms, 1))


_N = 1 / (2 * geo.INV_F - 1)
_RADIUS = 0.9996 * geo.A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_C = 2 * _N**0.5 / (1 + _N)


@query(f"""WITH z AS (SELECT *, CAST(CAST(FLOOR((lon + 180)/6) AS BIGINT) % 60 + 1 AS INT) AS zone FROM v_sites),
t AS (SELECT *, radians(lon - (zone*6 - 183)) AS l, sinh(atanh(sin(radians(lat))) - {_C!r} * atanh({_C!r} * sin(radians(lat)))) AS t FROM z),
u AS (SELECT *, atan2(t, cos(l)) AS xi, atanh(sin(l)/sqrt(1 + t*t)) AS eta FROM t)
SELECT site_id, zone, round(500000.0e0 + {_RADIUS!r} * (eta + {_series(_ALPHA, "cos({k}*xi)*sinh({k}*eta)")}), 3) AS x, round({_RADIUS!r} * (xi + {_series(_ALPHA, "sin({k}*xi)*cosh({k}*eta)")}), 3) AS y,
 round(lat, 7) AS lat, round(lon, 7) AS lon FROM u""")
def utm_round_trip(spark, sf):
    s = funnel.utm_of(views.sites(spark, sf))
    lat, lon = geo.inverse_transverse_mercator(F.col("x"), F.col("y"), F.col("zone") * 6 - 183)
    return s.select("site_id", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


# splits


@query("SELECT site_id, block, is_test FROM v_split")
def spatial_split_md5(spark, sf):
    return splits.spatial_split(views.sites(spark, sf), how="md5").select("site_id", "block", "is_test")


@query()
def spatial_split_blake2b(spark, sf):
    return splits.spatial_split(views.sites(spark, sf)).select("site_id", "block", "is_test")


@query("SELECT site_id, CAST('0x' || substr(md5('20261029:unit:' || grp), 1, 13) AS BIGINT) / 4503599627370496.0e0 < 0.5e0 AS is_test FROM v_sites")
def unit_split_md5(spark, sf):
    return splits.unit_split(views.sites(spark, sf), "grp", how="md5").select("site_id", "is_test")


@query("SELECT label, count(*) FILTER (NOT is_test) AS train, count(*) FILTER (is_test) AS test FROM v_split GROUP BY label")
def split_report(spark, sf):
    return splits.split_report(splits.spatial_split(views.sites(spark, sf), how="md5"), "label")


@query("""WITH k AS (SELECT site_id // 3 AS u FROM v_split GROUP BY 1 HAVING min(is_test) = max(is_test)) SELECT s.site_id FROM v_split s JOIN k ON s.site_id // 3 = k.u""")
def leak_free_rows(spark, sf):
    rows = splits.spatial_split(views.sites(spark, sf), how="md5").withColumn("unit", F.expr("site_id div 3"))
    return splits.not_leaking(rows, "unit").select("site_id")


# events, labels, aggregates

_EV = """e AS (SELECT *, start_ts + to_microseconds(CAST(round(dur_s * 1000000) AS BIGINT)) AS end_ts FROM v_detections),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY deployment, species ORDER BY start_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e),
f AS (SELECT *, CASE WHEN last IS NULL OR start_ts > last + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM m)"""


@query(f"WITH {_EV} SELECT deployment, species, count(*) AS n_sequences, CAST(sum(new) AS BIGINT) AS n_events FROM f GROUP BY ALL")
def event_sessions(spark, sf):
    return labels.event_counts(views.detections(spark, sf), ["deployment", "species"], "start_ts", "dur_s", "INTERVAL 12 HOURS", "event_id")


@query(f"""WITH {_EV}, n AS (SELECT deployment, species, sum(new) AS n FROM f GROUP BY ALL), t AS (SELECT user_id AS deployment, count(DISTINCT CAST(ts AS DATE)) AS effort FROM events GROUP BY 1)
SELECT deployment, species, round(100.0e0 * n / effort, 6) AS rate FROM n JOIN t USING (deployment)""")
def encounter_rate(spark, sf):
    ev = labels.event_counts(views.detections(spark, sf), ["deployment", "species"], "start_ts", "dur_s", "INTERVAL 12 HOURS", "event_id")
    effort = views.detections(spark, sf).groupBy("deployment").agg(F.count_distinct(F.to_date("start_ts")).alias("effort"))
    return _rounded(labels.rates(ev, effort, "deployment", "species"))


@query("SELECT user_id, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS INT) AS occ__{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def occupancy_wide(spark, sf):
    return labels.occupancy(views.table(spark, sf, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT label, count(*) AS n_rows, count(DISTINCT grp) AS n_sites, count(DISTINCT CASE WHEN is_test THEN grp END) AS n_test_sites FROM v_split GROUP BY label")
def species_summary(spark, sf):
    return labels.species_summary(splits.spatial_split(views.sites(spark, sf), how="md5"), "label", "grp", "is_test")


@query("""WITH c AS (SELECT grp, name, count(*) AS n, avg(gap) AS g FROM (SELECT m.*, s.grp FROM v_matched m JOIN v_sites s USING (site_id)) WHERE name IS NOT NULL GROUP BY ALL)
SELECT grp, name, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, g, name) AS k FROM c) WHERE k = 1""")
def product_per_location(spark, sf):
    per = _matched(spark, sf).filter("name IS NOT NULL").groupBy("grp", "name").agg(F.count("*").alias("n"), F.avg("gap").alias("g"))
    return labels.best_row(per, ["grp"], ["name", "n"], F.struct(-F.col("n"), F.col("g"), F.col("name")))


@query("""WITH c AS (SELECT site_id, label, count(*) AS n FROM v_visits GROUP BY ALL) SELECT site_id, label, n FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY n DESC, label) AS k FROM c) WHERE k = 1""")
def mode_label(spark, sf):
    return labels.mode_label(views.visits(spark, sf), ["site_id"], "label")


@query("SELECT site_id, visit_id, label FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY day DESC, visit_id DESC) AS k FROM v_visits) WHERE k = 1")
def dedupe_latest(spark, sf):
    return src.latest_attempt(views.visits(spark, sf), "site_id", "day", "visit_id").select("site_id", "visit_id", "label")


@query("SELECT visit_id FROM (SELECT visit_id, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || visit_id), visit_id) AS k FROM v_visits) WHERE k <= 100")
def cap_per_group(spark, sf):
    return splits.first_n(views.visits(spark, sf), ["label"], 100, [splits.seeded_order(F.col("visit_id"), 5), "visit_id"]).select("visit_id")


@query("""WITH l AS (SELECT *, lag(label) OVER w AS was, lag(day) OVER w AS before FROM v_visits WINDOW w AS (PARTITION BY site_id ORDER BY day, visit_id)),
g AS (SELECT datediff('day', before, day)/365.25e0 AS gap, CASE WHEN label = was THEN 1.0e0 ELSE 0.0e0 END AS agree FROM l WHERE before IS NOT NULL),
b AS (SELECT CASE WHEN gap > -1 AND gap <= 0.25e0 THEN 'a_quarter' WHEN gap > 0.25e0 AND gap <= 1 THEN 'b_year' WHEN gap > 1 AND gap <= 3 THEN 'c_three' WHEN gap > 3 AND gap <= 99 THEN 'd_more' END AS gap_bin, agree FROM g)
SELECT gap_bin, count(*) AS n_pairs, round(avg(agree), 6) AS agreement FROM b GROUP BY gap_bin""")
def label_turnover_by_gap(spark, sf):
    t = labels.turnover(views.visits(spark, sf), "site_id", "day", "label", "visit_id")
    t = t.withColumn("gap_bin", labels.binned(F.col("gap_years"), [-1, 0.25, 1, 3, 99], ["a_quarter", "b_year", "c_three", "d_more"]))
    return _rounded(t.groupBy("gap_bin").agg(F.count("*").alias("n_pairs"), F.avg("agree").alias("agreement")))


@query("SELECT visit_id, datediff('day', lag(day) OVER w, day) AS days, lag(label) OVER w AS was FROM v_visits WINDOW w AS (PARTITION BY site_id ORDER BY day, visit_id) QUALIFY lag(day) OVER w IS NOT NULL")
def turnover_lag(spark, sf):
    t = labels.turnover(views.visits(spark, sf), "site_id", "day", "label", "visit_id")
    return t.select("visit_id", F.datediff("day", "before").cast("long").alias("days"), "was")


_POISSON = [0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.061313240195240384, 0.015328310048810096, 0.0030656620097620196, 0.0005109436682936699]


@query(f"""WITH l AS (SELECT site_id, label, lag(label) OVER w AS was, lag(day) OVER w AS before FROM v_visits WINDOW w AS (PARTITION BY site_id ORDER BY day, visit_id)),
s AS (SELECT site_id, sum(CASE WHEN label = was THEN 1.0e0 ELSE 0.0e0 END) AS s, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY site_id),
u AS (SELECT s, n, draw, CAST('0x' || substr(md5('7/' || site_id || '/' || draw), 1, 13) AS BIGINT) / 4503599627370496.0e0 AS u FROM s, (SELECT unnest(range(1, 201)) AS draw)),
w AS (SELECT s, n, draw, {" + ".join(f"CAST(u >= {sum(_POISSON[:k]):.17g} AS INT)" for k in range(1, 8))} AS w FROM u),
m AS (SELECT draw, sum(w * s) / sum(w * n) AS m FROM w GROUP BY draw)
SELECT CAST((SELECT sum(n) FROM s) AS BIGINT) AS n, round((SELECT sum(s) / sum(n) FROM s), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def turnover_bootstrap(spark, sf):
    t = labels.turnover(views.visits(spark, sf), "site_id", "day", "label", "visit_id")
    return _rounded(labels.bootstrap(t, "site_id", F.col("agree")), 9)


@query("""WITH s AS (SELECT o_custkey % 100 AS g, p_brand AS brand, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY q DESC, brand) AS k FROM s)
SELECT g, string_agg(brand || '=' || CAST(CAST(q AS BIGINT) AS VARCHAR), ';' ORDER BY brand) AS top FROM r WHERE k <= 5 GROUP BY g""")
def topn_map(spark, sf):
    t = views.table
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    top = labels.top_map(rows.select((F.col("o_custkey") % 100).alias("g"), F.col("p_brand").alias("brand"), "l_quantity"), ["g"], "brand", F.sum("l_quantity"), 5)
    text = F.transform(F.map_entries("top"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string")))
    return top.select("g", F.array_join(text, ";").alias("top"))


@query("SELECT coalesce(CAST(n_regionkey AS VARCHAR), 'all') AS region, coalesce(n_name, 'all') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
def rollup_report(spark, sf):
    j = views.table(spark, sf, "customer").join(views.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = j.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    return r.select(F.coalesce(F.col("n_regionkey").cast("string"), F.lit("all")).alias("region"), F.coalesce("n_name", F.lit("all")).alias("nation"), "n", "total")


@query("SELECT p_partkey, name, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR name IN (size, price))")
def unpivot_melt(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "name", "v")


@query("""SELECT 'semi' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)
UNION ALL SELECT 'anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)
UNION ALL SELECT 'union', count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)""")
def semi_anti_setops(spark, sf):
    c, o, s = (views.table(spark, sf, n) for n in ("customer", "orders", "supplier"))
    ck, ok = c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k"))
    parts = {"semi": ck.join(o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), "k", "left_semi"), "anti": ck.join(ok, "k", "left_anti"), "both": ck.intersect(ok), "except": ok.exceptAll(ck), "union": s.select("s_nationkey").union(c.select("c_nationkey")).distinct()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_events FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k""")
def full_outer_counts(spark, sf):
    a = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("a"))
    b = views.table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("b"))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.lit(0)).alias("n_orders"), F.coalesce("b", F.lit(0)).alias("n_events"))


@query("SELECT grp, string_agg(DISTINCT label, ' | ' ORDER BY label) AS label FROM v_sites GROUP BY grp")
def distinct_concat(spark, sf):
    return labels.distinct_text(views.sites(spark, sf), ["grp"], "label")


@query("""WITH t AS (SELECT n_nationkey + 100 * n_regionkey AS o, CASE WHEN n_nationkey % 6 = 0 THEN 'a' WHEN n_nationkey % 3 = 0 THEN 'b' ELSE 'c' END AS level, n_name AS name FROM nation),
w AS (SELECT *, max(CASE WHEN level = 'a' THEN o END) OVER z AS oa, max(CASE WHEN level = 'b' THEN o END) OVER z AS ob, max(CASE WHEN level = 'c' THEN o END) OVER z AS oc FROM t WINDOW z AS (ORDER BY o))
SELECT o, (SELECT name FROM t x WHERE x.o = w.oa) AS a_name, CASE WHEN oa IS NULL OR ob > oa THEN (SELECT name FROM t x WHERE x.o = w.ob) END AS b_name,
 CASE WHEN greatest(oa, ob) IS NULL OR oc > greatest(oa, ob) THEN (SELECT name FROM t x WHERE x.o = w.oc) END AS c_name FROM w""")
def taxonomy_fill_down(spark, sf):
    t = views.table(spark, sf, "nation").selectExpr("n_nationkey + 100 * n_regionkey AS o", "CASE WHEN n_nationkey % 6 = 0 THEN 'a' WHEN n_nationkey % 3 = 0 THEN 'b' ELSE 'c' END AS level", "n_name AS name")
    return labels.fill_down(t, "o", "level", "name", ["a", "b", "c"]).select("o", "a_name", "b_name", "c_name")


@query()
def hash_shards(spark, sf):
    return views.table(spark, sf, "orders").groupBy(src.shard(F.col("o_orderkey")).alias("shard")).agg(F.count("*").alias("n"))


# train statistics


@query("SELECT site_id, round(n_all / (k * CAST(n AS DOUBLE)), 9) AS weight FROM (SELECT site_id, count(*) OVER () AS n_all, count(*) OVER (PARTITION BY label) AS n, (SELECT count(DISTINCT label) FROM v_sites) AS k FROM v_sites)")
def balanced_weights(spark, sf):
    return _rounded(probe.balanced_weights(views.sites(spark, sf), "label").select("site_id", "weight"), 9)


@query("SELECT grp, count(*) FILTER (NOT is_test) AS train, count(*) FILTER (is_test) AS test FROM v_split GROUP BY grp HAVING count(*) FILTER (NOT is_test) >= 25 AND count(*) FILTER (is_test) >= 25")
def class_min_count(spark, sf):
    return probe.scoreable(splits.spatial_split(views.sites(spark, sf), how="md5"), "grp", "is_test", 25)


@query("""WITH n AS (SELECT s.site_id, s.is_test, CASE WHEN s.site_id % 7 = 0 THEN NULL ELSE c.y END AS y FROM v_split s JOIN v_sites c USING (site_id))
SELECT site_id, round(coalesce(y, (SELECT quantile_cont(y, 0.5) FROM n WHERE NOT is_test)), 6) AS y FROM n""")
def impute_train_median(spark, sf):
    s = splits.spatial_split(views.sites(spark, sf), how="md5").withColumn("y", F.when(F.col("site_id") % 7 != 0, F.col("y")))
    return _rounded(probe.imputed(s, ["y"], "is_test").select("site_id", "y"))


@query("""WITH n AS (SELECT s.site_id, s.is_test, c.y, 3.0e0 AS one FROM v_split s JOIN v_sites c USING (site_id)), t AS (SELECT avg(y) AS m, stddev_pop(y) AS d FROM n WHERE NOT is_test)
SELECT site_id, round((y - m)/d, 6) AS y, 0.0e0 AS one FROM n, t""")
def standardise_train(spark, sf):
    s = splits.spatial_split(views.sites(spark, sf), how="md5").withColumn("one", F.lit(3.0))
    return _rounded(probe.standardised(s, ["y", "one"], "is_test").select("site_id", "y", "one"))


_LOC = "SELECT lat - 37 AS a, (lon + 96)/10 AS b, y FROM v_sites"


@query(
    f"WITH t AS ({_LOC}) "
    + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(sum({'1.0e0' if a == 'one' else a} * {'1.0e0' if b == 'one' else b}), 3) AS value FROM t" for i, a in enumerate(("one", "a", "b", "y")) for j, b in enumerate(("one", "a", "b", "y")) if i <= j)
)
def ridge_gramian(spark, sf):
    s = views.sites(spark, sf).selectExpr("lat - 37 AS a", "(lon + 96) / 10 AS b", "y")
    return _rounded(probe.gramian(s, ["a", "b"], "y"), 3)


@query("""WITH t AS (SELECT grp, count(*) AS n, avg(lat) AS mx, avg(lon) AS my, avg(y) AS mz FROM v_sites GROUP BY grp),
c AS (SELECT s.grp, sum((lat-mx)*(lat-mx)) AS xx, sum((lat-mx)*(lon-my)) AS xy, sum((lon-my)*(lon-my)) AS yy, sum((lat-mx)*(s.y-mz)) AS xz, sum((lon-my)*(s.y-mz)) AS yz FROM v_sites s JOIN t USING (grp) GROUP BY s.grp)
SELECT grp, n, round((xz*yy - yz*xy)/(xx*yy - xy*xy), 4) AS slope_x, round((yz*xx - xz*xy)/(xx*yy - xy*xy), 4) AS slope_y FROM c JOIN t USING (grp)""")
def plane_fit(spark, sf):
    return _rounded(metrics.plane_fit(views.sites(spark, sf), ["grp"], "lat", "lon", "y").select("grp", "n", "slope_x", "slope_y"), 4)


# embeddings and metrics


def _embeddings(spark, sf):
    return views.table(spark, sf, "embeddings").withColumn("is_test", F.col("vec_id") % 2 == 1)


def _neighbours(spark, sf, k=5):
    e = _embeddings(spark, sf)
    return match_neighbours(e.filter("is_test"), e.filter("NOT is_test"), k)


def match_neighbours(q, r, k):
    return embed.cosine_top_k(q.withColumnRenamed("vec_id", "query_id"), r.withColumnRenamed("vec_id", "row_id"), k, "query_id", "row_id", "embedding")


_NN = """d AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, r.label, list_cosine_similarity(q.v, r.v) AS cosine FROM v_emb q JOIN v_emb r ON q.is_test AND NOT r.is_test),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, row_id) AS k FROM d)"""


@query(f"WITH {_NN} SELECT query_id, row_id, CAST(k AS INT) AS k_rank, round(cosine, 6) AS cosine FROM n WHERE k <= 5")
def cosine_topk(spark, sf):
    return _neighbours(spark, sf).select("query_id", "row_id", "k_rank", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_NN}, w AS (SELECT query_id, label, sum(greatest(cosine, 0) + 1e-6) AS w FROM n WHERE k <= 5 GROUP BY ALL)
SELECT query_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, label) AS k FROM w) WHERE k = 1""")
def knn_classify(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), "label")
    return embed.knn_votes(_neighbours(spark, sf), rows, "query_id", "row_id", "label")


@query(f"WITH {_NN} SELECT query_id, round(sum((greatest(cosine, 0) + 1e-6) * label) / sum(greatest(cosine, 0) + 1e-6), 6) AS predicted FROM n WHERE k <= 5 GROUP BY query_id")
def knn_regress(spark, sf):
    rows = _embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), "label")
    return _rounded(embed.knn_mean(_neighbours(spark, sf), rows, "query_id", "row_id", "label"))


@query("""WITH p AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS c FROM v_emb a JOIN v_emb b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, (SELECT count(*) FROM v_emb e WHERE e.label = p.label) AS n, round(avg(c), 6) AS mean_cosine FROM p GROUP BY label""")
def embedding_spread(spark, sf):
    return _rounded(embed.spread(views.table(spark, sf, "embeddings"), ["label"], "embedding"))


@query("""WITH u AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v_emb), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x*x)) AS n FROM m GROUP BY label)
SELECT label, i, round(x/n, 6) AS x FROM m JOIN n USING (label)""")
def pooled_vectors(spark, sf):
    p = embed.pooled(views.table(spark, sf, "embeddings"), ["label"], "embedding")
    return p.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


def _scores(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return views.table(spark, sf, "embeddings").withColumn("v", v).selectExpr("vec_id", "label", "v[0] + 0.5D * v[1] AS s", "round(v[2], 1) AS tied", "v[3] AS p", "v[0] AS truth")


_MC = """m AS (SELECT label AS t, CASE WHEN s > 0 THEN label ELSE (label + vec_id) % 12 END AS p FROM v_score)"""


@query(f"""WITH {_MC}, c AS (SELECT t AS c FROM m UNION SELECT p FROM m),
k AS (SELECT c, (SELECT count(*) FROM m WHERE t = c) AS a, (SELECT count(*) FROM m WHERE p = c) AS s, (SELECT count(*) FROM m WHERE t = c AND p = c) AS h FROM c)
SELECT round(CAST(sum(h) AS DOUBLE)/sum(a), 9) AS accuracy, round(avg(CASE WHEN a > 0 THEN CAST(h AS DOUBLE)/a END), 9) AS balanced_accuracy, round(avg(coalesce(2.0e0*h/(a + s), 0)), 9) AS macro_f1 FROM k""")
def metrics_multiclass(spark, sf):
    s = _scores(spark, sf).withColumn("said", F.expr("CASE WHEN s > 0 THEN label ELSE (label + vec_id) % 12 END"))
    return _rounded(metrics.multiclass(s, "label", "said"), 9)


def _binary(spark, sf):
    s = _scores(spark, sf)
    return s.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("target"), "label", "tied").withColumn("truth", (F.col("label") == F.col("target")).cast("int"))


@query("""WITH b AS (SELECT t.target, CAST(label = t.target AS INT) AS y, tied AS s FROM v_score, (SELECT CAST(unnest(range(10)) AS INT) AS target) t),
r AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY s) + (count(*) OVER (PARTITION BY target, s) - 1)/2.0e0 AS r FROM b)
SELECT target, round((sum(r) FILTER (y = 1) - sum(y)*(sum(y) + 1)/2.0e0)/(CAST(sum(y) AS DOUBLE)*(count(*) - sum(y))), 9) AS auroc FROM r GROUP BY target HAVING sum(y) > 0 AND sum(y) < count(*)""")
def metrics_auroc(spark, sf):
    return _rounded(metrics.auroc(_binary(spark, sf), "target", "truth", "tied"), 9)


@query("""WITH b AS (SELECT t.target, CAST(label = t.target AS INT) AS y, tied AS s FROM v_score, (SELECT CAST(unnest(range(10)) AS INT) AS target) t),
g AS (SELECT target, s, sum(y) AS pos, count(*) AS n FROM b GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY target ORDER BY s DESC))
SELECT target, round(sum(CAST(pos AS DOUBLE) * hits / seen)/sum(pos), 9) AS ap FROM c GROUP BY target HAVING sum(pos) > 0""")
def metrics_ap(spark, sf):
    return _rounded(metrics.average_precision(_binary(spark, sf), "target", "truth", "tied"), 9)


@query("""WITH r AS (SELECT label AS target, truth AS y, p, rank() OVER (PARTITION BY label ORDER BY truth) + (count(*) OVER (PARTITION BY label, truth) - 1)/2.0e0 AS ry, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1)/2.0e0 AS rp FROM v_score)
SELECT target, count(*) AS n, round(1 - sum((y-p)*(y-p))/(sum(y*y) - sum(y)*sum(y)/count(*)), 6) AS r2, round(sqrt(avg((y-p)*(y-p))), 6) AS rmse, round(corr(ry, rp), 6) AS spearman FROM r GROUP BY target""")
def metrics_regression(spark, sf):
    return _rounded(metrics.regression(_scores(spark, sf), "label", "truth", "p"))


@query("""WITH m AS (SELECT label, quantile_cont(s, 0.5) AS median FROM v_score GROUP BY label)
SELECT label, round(m.median, 9) AS median, round(1.4826e0 * quantile_cont(abs(s - m.median), 0.5), 9) AS spread FROM v_score JOIN m USING (label) GROUP BY label, m.median""")
def robust_spread(spark, sf):
    return _rounded(metrics.robust(_scores(spark, sf), ["label"], "s"), 9)


@query()
def ridge_probe(spark, sf):
    return probe.vector_ridge_scores(_embeddings(spark, sf), "embedding", "label", "is_test", "vec_id", 1e-3, 64)


@query()
def linear_probe_logistic(spark, sf):
    return probe.logistic_scores(_embeddings(spark, sf), "embedding", "label", "is_test", "vec_id", 1e-3)


_WAVES = embed.fourier_weights(16, 8.0, 3)


@query(f"""WITH s AS (SELECT site_id, cos(radians(lat))*cos(radians(lon)) AS x, cos(radians(lat))*sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM v_sites),
w AS (SELECT * FROM (VALUES {", ".join(f"({i}, {float(a)!r}, {float(b)!r}, {float(c)!r})" for i, (a, b, c) in enumerate(_WAVES))}) t(i, a, b, c))
SELECT site_id, CAST(i + 16*k AS INT) AS i, round(CASE k WHEN 0 THEN cos(a*x + b*y + c*z) ELSE sin(a*x + b*y + c*z) END, 6) AS feature FROM s, w, (VALUES (0), (1)) v(k)""")
def location_fourier_features(spark, sf):
    f = views.sites(spark, sf).select("site_id", embed.fourier_features(F.col("lat"), F.col("lon"), 16, 8.0, 3).alias("features"))
    return _rounded(f.select("site_id", F.posexplode("features").alias("i", "feature")))


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN floor(x*100) <> -128 THEN sign(floor(x*100)) * pow(floor(x*100)/127.5e0, 2) END)), 6) AS total FROM v_emb""")
def dequantised_sum(spark, sf):
    v = F.transform("embedding", lambda x: tx.dequantised(F.floor(x.cast("double") * 100)))
    return views.table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))), 6).alias("total"))


# point clouds

_PK = ", ".join(views.POINT_KEY)


@query(f"""WITH p AS (SELECT *, CAST(floor(x/20) AS BIGINT) AS vx, CAST(floor(y/20) AS BIGINT) AS vy, CAST(floor(z/20) AS BIGINT) AS vz FROM v_points),
r AS (SELECT *, count(*) OVER (PARTITION BY cloud_id, vx, vy, vz) AS n_voxel, row_number() OVER (PARTITION BY cloud_id, vx, vy, vz ORDER BY md5('0:' || concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)), {_PK}) AS k FROM p)
SELECT cloud_id, vx, vy, vz, n_voxel, l_orderkey, l_partkey FROM r WHERE k = 1""")
def voxel_sample(spark, sf):
    best = cloud.voxel_sample(views.points(spark, sf), "cloud_id", 20, views.POINT_KEY[:4])
    return best.select("cloud_id", "vx", "vy", "vz", "n_voxel", "l_orderkey", "l_partkey")


@query("SELECT cloud_id, CAST(floor(x/20) AS BIGINT) AS vx, CAST(floor(y/20) AS BIGINT) AS vy, CAST(floor(z/20) AS BIGINT) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, max(intensity) AS intensity, count(*) AS n FROM v_points GROUP BY 1, 2, 3, 4")
def voxel_pool(spark, sf):
    return _rounded(cloud.voxel_pooled(views.points(spark, sf), "cloud_id", 20, ["intensity"]))


_LEVEL = "CASE cloud_id % 5 WHEN 0 THEN 'QL 1' WHEN 1 THEN 'QL 2' WHEN 2 THEN 'QL 3' WHEN 3 THEN 'other' END"


@query(f"""WITH l AS (SELECT cloud_id, {_LEVEL} AS ql FROM (SELECT DISTINCT cloud_id FROM v_points)),
p AS (SELECT cloud_id, least(CAST(floor((x + 80)/20) AS BIGINT), 7) AS i, least(CAST(floor((y + 80)/20) AS BIGINT), 7) AS j, count(*) AS c FROM v_points WHERE classification NOT IN (7, 18) AND x*x + y*y <= 6400 GROUP BY ALL),
g AS (SELECT i, j, pow((i + 0.5e0)*20 - 80, 2) + pow((j + 0.5e0)*20 - 80, 2) <= 6400 AS inside FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)),
s AS (SELECT cloud_id, CAST(sum(c) AS BIGINT) AS n, count(*) FILTER (inside) AS n_full FROM p JOIN g USING (i, j) GROUP BY cloud_id),
e AS (SELECT *, CASE ql WHEN 'QL 1' THEN 8.0e0 WHEN 'QL 2' THEN 2.0e0 WHEN 'QL 3' THEN 0.5e0 ELSE 0.5e0 END * 3.141592653589793e0 * 6400 AS expected FROM l)
SELECT cloud_id, ql, coalesce(n, 0) AS n, round(expected, 6) AS expected, round(coalesce(n, 0)/expected, 6) AS density_ratio, round(CAST(coalesce(n_full, 0) AS DOUBLE)/(SELECT count(*) FROM g WHERE inside), 6) AS cell_cover,
 coalesce(n, 0)/expected < 0.5 AS is_low FROM e LEFT JOIN s USING (cloud_id)""")
def disc_qc(spark, sf):
    p = views.points(spark, sf)
    levels = p.select("cloud_id").distinct().withColumn("ql", F.expr(_LEVEL))
    return _rounded(cloud.coverage(p, levels, "cloud_id", "ql", 80.0, 20.0))


@query(f"SELECT {_PK}, round((row_number() OVER (PARTITION BY cloud_id ORDER BY intensity, {_PK}) - 1)/CAST(count(*) OVER (PARTITION BY cloud_id) - 1 AS DOUBLE), 9) AS rank01 FROM v_points")
def intensity_rank(spark, sf):
    r = cloud.intensity_rank(views.points(spark, sf), "cloud_id", views.POINT_KEY)
    return r.select(*views.POINT_KEY, F.round("rank01", 9).alias("rank01"))


@query("SELECT cloud_id, CAST(CASE WHEN l_linenumber % 4 <= 1 THEN 0 WHEN return_number = 1 THEN 1 WHEN return_number >= l_linenumber % 4 THEN 3 ELSE 2 END AS INT) AS code, count(*) AS n FROM v_points GROUP BY ALL")
def return_codes(spark, sf):
    p = views.points(spark, sf).withColumn("code", cloud.return_code(F.col("return_number"), F.col("l_linenumber") % 4))
    return p.groupBy("cloud_id", "code").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT cloud_id FROM v_points WHERE classification = 2 GROUP BY 1 HAVING count(*) >= 300),
low AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, CAST(floor(x/50) AS BIGINT), CAST(floor(y/50) AS BIGINT) ORDER BY z, {_PK}) AS k FROM v_points WHERE cloud_id NOT IN (SELECT cloud_id FROM e)),
g AS (SELECT cloud_id, z FROM v_points WHERE classification = 2 AND cloud_id IN (SELECT cloud_id FROM e) UNION ALL SELECT cloud_id, z FROM low WHERE k = 1)
SELECT cloud_id, count(*) AS n, round(avg(z), 6) AS z FROM g GROUP BY cloud_id""")
def pseudo_ground(spark, sf):
    g = cloud.pseudo_ground(views.points(spark, sf), "cloud_id", 300, 50.0, views.POINT_KEY)
    return _rounded(g.groupBy("cloud_id").agg(F.count("*").alias("n"), F.avg("z").alias("z")))


@query("""WITH m AS (SELECT cloud_id, avg(z) AS mz FROM v_points GROUP BY 1)
SELECT p.cloud_id, count(*) AS n, max(z) AS zmax, round(avg(z), 6) AS zmean, round(stddev_samp(z), 6) AS zsd, round(avg(pow(z - mz, 3))/pow(avg(pow(z - mz, 2)), 1.5), 6) AS zskew,
 round(avg(pow(z - mz, 4))/pow(avg(pow(z - mz, 2)), 2), 6) AS zkurt, round(100*avg(CAST(z > 2 AS DOUBLE)), 6) AS pzabove, round(quantile_cont(z, 0.25), 6) AS zq25, round(quantile_cont(z, 0.95), 6) AS zq95,
 round(100*avg(CAST(return_number = 1 AS DOUBLE)), 6) AS p1th, round(100*avg(CAST(classification = 2 AS DOUBLE)), 6) AS pground FROM v_points p JOIN m USING (cloud_id) GROUP BY p.cloud_id""")
def std_metrics(spark, sf):
    m = cloud.standard_metrics(views.points(spark, sf), "cloud_id")
    return _rounded(m.select("cloud_id", "n", "zmax", "zmean", "zsd", "zskew", "zkurt", F.col("pzabove2").alias("pzabove"), "zq25", "zq95", "p1th", "pground"))


@query("""WITH b AS (SELECT cloud_id, CAST(floor(z) AS BIGINT) AS b, count(*) AS c FROM v_points GROUP BY ALL)
SELECT cloud_id, round((ln(sum(c)) - sum(c*ln(c))/sum(c))/ln(max(b) + 1), 6) AS zentropy FROM b GROUP BY cloud_id""")
def height_entropy(spark, sf):
    return _rounded(cloud.height_entropy(views.points(spark, sf), "cloud_id"))


@query("""SELECT cloud_id, CAST(floor(x/25) AS BIGINT) AS i, CAST(floor(y/25) AS BIGINT) AS j, max(z) AS dsm, round(avg(CASE WHEN classification = 2 THEN z END), 6) AS dtm, round(count(*)/625.0e0, 6) AS density,
 round(avg(CASE WHEN return_number = 1 THEN intensity END), 6) AS intensity, round(max(z) - avg(CASE WHEN classification = 2 THEN z END), 6) AS chm FROM v_points WHERE classification NOT IN (7, 18) GROUP BY 1, 2, 3""")
def raster_chm_density(spark, sf):
    return _rounded(cloud.rastered(views.points(spark, sf), "cloud_id", 25.0))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((x + 100)/2) AS BIGINT) AS a, CAST(floor((y + 100)/2) AS BIGINT) AS b, CAST(floor(z) AS BIGINT) AS c FROM v_points)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(list_sum(list_transform(range(7), lambda i: ((a >> i) & 1) * (1::BIGINT << (3*i + 2)) + ((b >> i) & 1) * (1::BIGINT << (3*i + 1)) + ((c >> i) & 1) * (1::BIGINT << (3*i)))) AS BIGINT) AS code FROM v""")
def morton_code(spark, sf):
    cell = lambda e: F.floor(F.expr(e)).cast("long")
    return views.points(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", tx.morton(cell("(x + 100) / 2"), cell("(y + 100) / 2"), cell("z")).alias("code"))


@query()
def hilbert_code(spark, sf):
    p = views.points(spark, sf).selectExpr("cloud_id", "l_orderkey", "CAST(FLOOR((x + 100) / 2) AS BIGINT) AS vx", "CAST(FLOOR((y + 100) / 2) AS BIGINT) AS vy", "CAST(FLOOR(z) AS BIGINT) AS vz")
    return cloud.hilbert(p, 7)


@query()
def height_above_ground(spark, sf):
    return cloud.height_above_ground(views.points(spark, sf).select("cloud_id", "x", "y", "z", "classification"), "cloud_id", 10.0)


_HORN = {(a, b): f"max(CASE WHEN d.i = c.i + {a} AND d.j = c.j + {b} THEN d.z END)" for a in (-1, 0, 1) for b in (-1, 0, 1)}


@query(f"""WITH g AS (SELECT * FROM v_points WHERE classification = 2), n AS (SELECT cloud_id, count(*) AS n_ground FROM g GROUP BY 1),
c AS (SELECT cloud_id, CAST(floor(x/25) AS BIGINT) AS i, CAST(floor(y/25) AS BIGINT) AS j, avg(z) AS z FROM g GROUP BY 1, 2, 3),
h AS (SELECT c.cloud_id, c.i, c.j, max(c.z) AS z, count(*) AS k,
 ({_HORN[1, 1]} + 2*{_HORN[1, 0]} + {_HORN[1, -1]} - {_HORN[-1, 1]} - 2*{_HORN[-1, 0]} - {_HORN[-1, -1]})/200 AS gx,
 ({_HORN[1, 1]} + 2*{_HORN[0, 1]} + {_HORN[-1, 1]} - {_HORN[1, -1]} - 2*{_HORN[0, -1]} - {_HORN[-1, -1]})/200 AS gy,
 sum(abs(d.z - c.z))/8 AS tri, max(c.z) - (sum(d.z) - max(c.z))/8 AS tpi
 FROM c JOIN c d ON c.cloud_id = d.cloud_id AND abs(c.i - d.i) <= 1 AND abs(c.j - d.j) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9),
m AS (SELECT cloud_id, avg(z) AS elevation, max(z) - min(z) AS elevation_range, avg(degrees(atan(sqrt(gx*gx + gy*gy)))) AS slope, avg(-gy/sqrt(1 + gx*gx + gy*gy)) AS northness,
 avg(-gx/sqrt(1 + gx*gx + gy*gy)) AS eastness, avg(tri) AS tri, avg(tpi) AS tpi FROM h GROUP BY 1)
SELECT p.cloud_id, coalesce(n_ground, 0) AS n_ground, {", ".join(f"round(CASE WHEN n_ground >= 400 THEN {c} END, 6) AS {c}" for c in ("elevation", "elevation_range", "slope", "northness", "eastness", "tri", "tpi"))}
FROM (SELECT DISTINCT cloud_id FROM v_points) p LEFT JOIN n USING (cloud_id) LEFT JOIN m USING (cloud_id)""")
def terrain_metrics(spark, sf):
    return _rounded(cloud.terrain(views.points(spark, sf), "cloud_id", 25.0, 400))


@query(f"""WITH c AS (SELECT cloud_id, v, r, arg_min({{'x': x, 'y': y}}, {{'h': md5(CAST(v AS VARCHAR) || ':' || concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice}}) AS p
  FROM v_points, (VALUES (0, 80.0e0), (1, 40.0e0), (2, 40.0e0)) t(v, r) GROUP BY ALL),
d AS (SELECT c.cloud_id, c.v, count(*) AS n FROM c JOIN v_points q ON q.cloud_id = c.cloud_id AND pow(q.x - c.p.x, 2) + pow(q.y - c.p.y, 2) <= r*r GROUP BY ALL)
SELECT cloud_id, CAST(v AS INT) AS "view", least(n, 256) AS n FROM d""")
def cloud_views(spark, sf):
    return cloud.views(views.points(spark, sf), "cloud_id", [80.0, 40.0, 40.0], 256, views.POINT_KEY[:4]).groupBy("cloud_id", "view").agg(F.count("*").alias("n"))


# dates and text


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_custkey % 200 AS INT) AS e FROM orders),
m AS (SELECT *, list_transform(range(date_diff('month', date_trunc('month', s), date_trunc('month', e)) + 1), lambda i: (month(s) - 1 + i) % 12 + 1) AS ms FROM o)
SELECT o_orderkey, CASE WHEN len(list_filter(ms, lambda x: x NOT IN (6, 7, 8, 9))) = 0 THEN true WHEN len(list_filter(ms, lambda x: x NOT IN (12, 1, 2, 3))) = 0 THEN false END AS leaf_on FROM m""")
def season_label(spark, sf):
    o = views.table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS s", "date_add(CAST(o_orderdate AS DATE), CAST(o_custkey % 200 AS INT)) AS e")
    return o.select("o_orderkey", tx.leaf_on(F.col("s"), F.col("e")).alias("leaf_on"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN year(o_orderdate) WHEN o_orderkey % 3 = 1 THEN year(o_orderdate) + 1 ELSE 2000 + o_orderkey % 20 END AS INT) AS collection_year FROM orders")
def collection_year(spark, sf):
    o = views.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS s", "CASE WHEN o_orderkey % 3 = 1 THEN add_months(o_orderdate, 12) END AS e", "concat('tile_', CAST(2000 + o_orderkey % 20 AS STRING)) AS n")
    return o.select("o_orderkey", tx.collection_year(F.col("s"), F.col("e"), F.col("n")).alias("collection_year"))


@query("""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN d IS NULL THEN 'missing' WHEN abs(d) <= 45 THEN 'agrees' WHEN d > 45 THEN 'late' ELSE 'early' END AS verdict FROM t""")
def date_reconcile(spark, sf):
    j = views.table(spark, sf, "lineitem").join(views.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return j.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", labels.reconciled(d, 45).alias("verdict"))


@query("""WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - 1000000000 + 18 AS gps FROM events), t AS (SELECT user_id, to_timestamp(gps + 1000000000 - 18) AS t FROM g)
SELECT user_id, CAST(min(gps) AS BIGINT) AS first_gps, round(quantile_cont(gps, 0.5), 3) AS mid_gps, CAST(max(gps) AS BIGINT) AS last_gps FROM g GROUP BY user_id""")
def gps_dates(spark, sf):
    e = views.detections(spark, sf).select(F.col("deployment").alias("user_id"), tx.gps_seconds(F.col("start_ts")).alias("gps"))
    spans = labels.gps_spans(e, "user_id", "gps", {"first_gps": 0.0, "mid_gps": 0.5, "last_gps": 1.0})
    return spans.select("user_id", F.col("first_gps").cast("long").alias("first_gps"), F.round("mid_gps", 3).alias("mid_gps"), F.col("last_gps").cast("long").alias("last_gps"))


_RANGE_TEXT = "CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 10 AS VARCHAR) WHEN 1 THEN '<' || CAST(p_size AS VARCHAR) WHEN 2 THEN '>' || CAST(p_size AS VARCHAR) || ' %' WHEN 3 THEN 'Trace' WHEN 4 THEN 'few' WHEN 5 THEN '>' || CAST(p_size AS VARCHAR) || '-' || CAST(p_size + 4 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END"


@query("SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN p_size + 5 WHEN 1 THEN p_size/2.0e0 WHEN 2 THEN (p_size + 100)/2.0e0 WHEN 3 THEN 0.25e0 WHEN 4 THEN 0.25e0 WHEN 5 THEN p_size + 2 ELSE p_size END AS DOUBLE) AS mid FROM part")
def range_mid(spark, sf):
    return views.table(spark, sf, "part").select("p_partkey", tx.range_mid(F.expr(_RANGE_TEXT.replace("VARCHAR", "STRING"))).alias("mid"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS flag FROM part) WHERE flag <> '' GROUP BY flag")
def flag_explode(spark, sf):
    flags = tx.distinct_flags(F.regexp_replace("p_name", " ", ";"))
    return views.table(spark, sf, "part").select(F.explode(F.split(flags, ";")).alias("flag")).filter("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


_MARKED = "p_name || CASE p_partkey % 3 WHEN 0 THEN ' [Provisional]' WHEN 1 THEN ' (Provisional)' ELSE ' (other)' END"


@query(f"""WITH a AS (SELECT p_partkey, regexp_replace(replace(replace(lower({_MARKED}), '[provisional]', ''), '(provisional)', ''), '[^a-z0-9]', '', 'g') AS k FROM part),
b AS (SELECT min(p_partkey) AS first_key, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part GROUP BY 2)
SELECT p_partkey, k, first_key FROM a LEFT JOIN b USING (k)""")
def name_normalise_join(spark, sf):
    p = views.table(spark, sf, "part")
    a = p.select("p_partkey", tx.normalised(F.expr(_MARKED)).alias("k"))
    b = p.select("p_partkey", tx.normalised(F.col("p_name")).alias("k")).groupBy("k").agg(F.min("p_partkey").alias("first_key"))
    return a.join(b, "k", "left").select("p_partkey", "k", "first_key")


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s+href="([^"]*)"[^>]*>([^<]*)</a>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, regexp_extract(tag, '>([^<]*)</a>', 1) AS anchor FROM t""")
def page_links(spark, sf):
    return src.page_links(views.table(spark, sf, "pages")).select("page_id", "href", "anchor")


# streams


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_stream(spark, sf):
    s = windows.tumbling(windows.events_stream(spark, f"{sf}/events.parquet"), "1 day", "31 days", ["event_type"])
    out = windows.drained_complete(s, "tumbling")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window_stream(spark, sf):
    s = windows.session_windows(windows.events_stream(spark, f"{sf}/events.parquet"), "6 hours", "31 days", ["user_id"])
    out = windows.drained_complete(s, "sessions")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return product_counts(spark, sf)

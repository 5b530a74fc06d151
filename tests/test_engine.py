"""Ties, nulls and boundaries on hand-made tables."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions import text as tx
from terravane.operators import cloud, embed, extra, funnel, graph, labels, match, metrics, probe, raster, splits
from terravane.sources import tables as src


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


FOOT = "name string, ordinal long, collection_year int, rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"
SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
FAR = ring((100, 0), (300, 0), (300, 80), (100, 80), (100, 0))


def footprints(spark, rows):
    out = []
    for name, ordinal, year, rings in rows:
        xs, ys = [p["x"] for r in rings for p in r], [p["y"] for r in rings for p in r]
        out.append((name, ordinal, year, rings, min(xs), min(ys), max(xs), max(ys)))
    return spark.createDataFrame(out, FOOT)


def test_containment_is_strict_and_knows_holes(spark):
    f = footprints(spark, [("hole", 1, 2010, [SQUARE, HOLE]), ("two", 2, 2010, [SQUARE, FAR])])
    s = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 0.0, 2.0), (4, 4.0, 4.0), (5, 200.0, 40.0), (6, 1.0, 1.5), (7, 3.0, 1.5)], "id long, lon double, lat double")
    got = {(r.id, r.name) for r in match.covering(s, f).select("id", "name").collect()}
    assert got == {(1, "hole"), (1, "two"), (2, "two"), (5, "two"), (6, "two"), (7, "hole"), (7, "two")}


def test_nearest_in_time_ties_and_null_years(spark):
    s = spark.createDataFrame([(1, 1.0, 1.0, 2010), (2, 50.0, 50.0, 2010)], "site long, lat double, lon double, year int")
    f = footprints(spark, [("late", 5, 2012, [SQUARE]), ("early", 2, 2008, [SQUARE]), ("undated", 1, None, [SQUARE])])
    got = {r.site: (r.name, r.gap, r.year_diff) for r in match.matched_sites(s, f).collect()}
    assert got == {1: ("early", 2, -2), 2: (None, None, None)}
    only = footprints(spark, [("undated", 1, None, [SQUARE])])
    assert [r.name for r in match.matched_sites(s, only).collect()] == [None, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-60, 60), st.floats(-170, 170)), min_size=2, max_size=25), st.floats(1000, 2_000_000))
def test_grid_pairs_equal_brute_force(spark, points, radius):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, lat double, lon double")
    got = {(r.a_id, r.b_id) for r in match.pairs_within(df, radius, "id", []).collect()}
    want = set()
    for i, (a, b) in enumerate(points):
        for j, (c, d) in enumerate(points[:i]):
            dist = np.hypot((d - b) * np.cos(np.radians((a + c) / 2)) * geo.DEGREE_M, (c - a) * geo.DEGREE_M)
            if abs(dist - radius) > 1e-3 and dist <= radius:
                want.add((j, i))
            elif abs(dist - radius) <= 1e-3:
                got.discard((j, i))
    assert got == want


def test_event_gaps(spark):
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [("d", "fox", 1, t(0, 0), 300.0), ("d", "fox", 2, t(0, 1), 19 * 60.0), ("d", "fox", 3, t(0, 50), 60.0), ("d", "fox", 4, t(1, 21), 1.0)]
    df = spark.createDataFrame(rows, "d string, s string, id long, start timestamp, dur double")
    got = {r.id: r.event_no for r in labels.sessions(df, ["d", "s"], "start", "dur", "INTERVAL 30 MINUTES", "id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}
    # the third starts exactly 30 minutes after the second's end and merges; the fourth lies exactly 30 after the third's end
    later = spark.createDataFrame([*rows[:3], ("d", "fox", 4, t(1, 22), 1.0)], df.schema)
    assert {r.id: r.event_no for r in labels.sessions(later, ["d", "s"], "start", "dur", "INTERVAL 30 MINUTES", "id").collect()}[4] == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4000), st.integers(0, 600)), min_size=1, max_size=40))
def test_events_across_buckets_equal_one_pass(spark, spans):
    at = dt.datetime(2024, 3, 1, 22, 0)
    rows = [(None if i % 7 == 0 else "d", i, at + dt.timedelta(minutes=m), 60.0 * n) for i, (m, n) in enumerate(spans)]
    df = spark.createDataFrame(rows, "d string, id long, start timestamp, dur double")
    got = {r.id: r.event_no for r in labels.sessions(df, ["d"], "start", "dur", "INTERVAL 30 MINUTES", "id", bucket="hour").collect()}
    for key in (None, "d"):
        last, n = None, 0
        for _, i, s, d in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or s > last + dt.timedelta(minutes=30):
                n += 1
            last = max(last or s, s + dt.timedelta(seconds=d))
            assert got[i] == n


def test_blake_split_is_stable(spark):
    assert splits.blake_uniform("20261029:0.25:0_-400") == pytest.approx(0.03414804710745528, abs=0)
    df = spark.range(200).selectExpr("id", "id * 0.37 AS lat", "-id * 0.21 AS lon")
    full = {r.id: r.is_test for r in splits.spatial_split(df).collect()}
    half = {r.id: r.is_test for r in splits.spatial_split(df.filter("id % 2 = 0")).collect()}
    assert all(full[i] == t for i, t in half.items()) and 0.2 < sum(full.values()) / 200 < 0.8


def test_funnel_counts_equal_separate_filters(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS v")
    steps = [("known", F.col("v").isNotNull()), ("small", F.col("v") < 60), ("odd", F.col("v") % 2 == 1)]
    got = [(r.step, r.n, r.dropped) for r in funnel.funnel(df, steps).orderBy("step_no").collect()]
    counts = [100, 85, funnel.filtered(df, steps[:2]).count(), funnel.filtered(df, steps).count()]
    assert [n for _, n, _ in got] == counts and [d for *_, d in got] == [0, *(a - b for a, b in zip(counts, counts[1:], strict=False))]


def test_coordinate_repair(spark):
    df = spark.createDataFrame([(1, 40.0, -100.0), (2, -100.0, 40.0), (3, 40.0, 100.0), (4, None, 5.0)], "id long, lat double, lon double")
    got = {r.id: (r.lat, r.lon, r.coord_flag) for r in funnel.repaired(df, (-125.0, -66.0, 24.0, 50.0)).collect()}
    assert got == {1: (40, -100, "as_is"), 2: (40, -100, "swapped"), 3: (40, -100, "lon_sign"), 4: (None, None, "missing")}


def test_scores(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.5), ("a", 1, 0.5), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 1, 0.3)]
    df = spark.createDataFrame(rows, "t string, y int, s double")
    assert [(r.target, r.auroc) for r in metrics.auroc(df, "t", "y", "s").collect()] == [("a", pytest.approx(0.875))]
    flipped = metrics.auroc(df.withColumn("s", -F.col("s")), "t", "y", "s").first()
    assert flipped.auroc == pytest.approx(0.125)
    assert metrics.average_precision(df.filter("t = 'a'"), "t", "y", "s").first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    m = metrics.multiclass(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int"), "t", "p").first()
    assert (m.accuracy, m.balanced_accuracy, m.macro_f1) == (0.5, pytest.approx(0.5), pytest.approx((2 / 3 + 0.5 + 0) / 3))


def test_text_functions(spark):
    df = spark.createDataFrame([("5-15",), ("<1",), (">75%",), ("trace",), ("12",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.range_mid(F.col("t"))).collect()] == [10, 0.5, 87.5, 0.25, 12, None]
    n = spark.createDataFrame([("12.34500",), ("7",), ("7.0",), (None,)], "t string")
    assert [r[0] for r in n.select(tx.n_decimals(F.col("t"))).collect()] == [3, 0, 0, 0]
    d = spark.createDataFrame([("2020-06-10", "2020-09-03"), ("2020-12-01", "2021-03-02"), ("2020-04-01", "2020-07-01")], "a string, b string")
    assert [r[0] for r in d.select(tx.leaf_on(F.to_date("a"), F.to_date("b"))).collect()] == [True, False, None]
    f = spark.createDataFrame([("a; b;a;;c",)], "f string")
    assert f.select(tx.distinct_flags(F.col("f"))).first()[0] == "a;b;c"
    assert [r[0] for r in spark.createDataFrame([("20 m",), ("about -3.5",), ("none",)], "t string").select(tx.number_in(F.col("t"))).collect()] == [20, -3.5, None]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 1023)] * 3), min_size=1, max_size=20))
def test_curves_round_trip(spark, points):
    df = spark.createDataFrame(points, "x int, y int, z int")
    back = df.withColumn("c", tx.morton(F.col("x"), F.col("y"), F.col("z"))).select("x", "y", "z", *(c.alias(n) for n, c in zip("abd", tx.unmorton(F.col("c")), strict=True)))
    assert all((r.x, r.y, r.z) == (r.a, r.b, r.d) for r in back.collect())


def test_hilbert_visits_neighbours():
    n = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = cloud.hilbert_index(n, 3)
    assert sorted(order) == list(range(512))
    path = n[np.argsort(order)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_projections(spark):
    df = spark.createDataFrame([(180.0, 10.0), (-117.5, 34.0), (-60.0, -33.0)], "lon double, lat double")
    u = funnel.utm_of(df).collect()
    assert [r.zone for r in u] == [1, 11, 21]
    assert u[1].x == pytest.approx(453_825.9, abs=0.5)
    lat, lon = geo.inverse_transverse_mercator(F.col("x"), F.col("y"), F.col("zone") * 6 - 183)
    back = funnel.utm_of(df).filter("lat > 0").select("lat", "lon", lat.alias("a"), lon.alias("b")).collect()
    assert all(r.a == pytest.approx(r.lat, abs=1e-8) and abs((r.b - r.lon + 180) % 360 - 180) < 1e-8 for r in back)
    x, y = geo.albers(F.lit(35.0), F.lit(-75.0), 23.0, -96.0, 29.5, 45.5)
    r = df.limit(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(1_885_472.7, abs=120) and r.y == pytest.approx(1_535_925.0, abs=400)


def test_probe_statistics(spark):
    rows = [(i, float(i), 2.0, None if i % 5 == 0 else float(i * i), i % 2 == 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, c double, m double, is_test boolean")
    s = probe.standardised(df, ["a", "c"], "is_test").filter("NOT is_test").agg(F.avg("a"), F.stddev_pop("a"), F.max("c")).first()
    assert s[0] == pytest.approx(0) and s[1] == pytest.approx(1) and s[2] == 0
    mid = np.median([i * i for i in range(0, 40, 2) if i % 5])
    assert {r.m for r in probe.imputed(df, ["m"], "is_test").filter("id % 5 = 0").collect()} == {mid}
    y = df.withColumn("y", 3 * F.col("a") - 1)
    w = probe.ridge(y, ["a"], "y", 0.0)
    assert w["a"] == pytest.approx(3) and w["intercept"] == pytest.approx(-1)
    assert probe.chosen_l2(y, ["a"], "y", "id", [1.0, 1e-6]) == 1e-6


def test_weighted_mean_pooling_and_spread(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0])], "g long, v array<double>")
    got = {r.g: (r.n, r.mean_cosine) for r in embed.spread(df, ["g"], "v").collect()}
    assert got == {1: (2, pytest.approx(0)), 2: (1, None)}
    assert [round(x, 6) for x in embed.pooled(df, ["g"], "v").filter("g = 1").first().v] == [0.707107, 0.707107]


def test_cosine_blocks_equal_one_block(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(90)], "id long, v array<double>")
    q, r = df.withColumnRenamed("id", "q"), df.withColumnRenamed("id", "r")
    one = sorted(map(tuple, embed.cosine_top_k(q, r, 4, "q", "r", "v").select("q", "r", "k_rank").collect()))
    for side in (1 << 30, 0):
        old, embed.BLOCK, embed.SMALL_SIDE = (embed.BLOCK, embed.SMALL_SIDE), 17, side
        try:
            assert sorted(map(tuple, embed.cosine_top_k(q, r, 4, "q", "r", "v").select("q", "r", "k_rank").collect())) == one
            assert sorted(map(tuple, embed.cosine_top_k(q, r.filter("r < 20"), 4, "q", "r", "v").select("q", "r", "k_rank").collect())) == sorted(
                (i, j, k) for i, j, k in map(tuple, embed.cosine_top_k(q, r.filter("r < 20").repartition(3), 4, "q", "r", "v").select("q", "r", "k_rank").collect())
            )
        finally:
            embed.BLOCK, embed.SMALL_SIDE = old
    assert embed.cosine_top_k(q.limit(0), r, 4, "q", "r", "v").count() == embed.cosine_top_k(q, r.limit(0), 4, "q", "r", "v").count() == 0


def test_clouds(spark):
    rows = [(1, float(i % 10), float(i // 10), 0.1 * (i % 10) + (5 if i % 4 == 0 else 0), 5 if i % 4 == 0 else 2, i, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "cloud long, x double, y double, z double, classification int, intensity long, return_number int")
    got = cloud.height_above_ground(df, "cloud", 1.0).filter("classification = 2").agg(F.max(F.abs("hag"))).first()[0]
    assert got < 0.5
    plane = spark.createDataFrame([(1, i + 0.5, j + 0.5, 0.1 * i - 0.2 * j, 2) for i in range(8) for j in range(8)] + [(2, 0.0, 0.0, 1.0, 2)], "cloud long, x double, y double, z double, classification int")
    t = {r.cloud: r for r in cloud.terrain(plane, "cloud", 1.0, 50).collect()}
    steep = (0.1**2 + 0.2**2) ** 0.5
    assert t[1].n_ground == 64 and t[1].slope == pytest.approx(np.degrees(np.arctan(steep)))
    assert (t[1].eastness, t[1].northness) == (pytest.approx(-0.1 / (1 + steep**2) ** 0.5), pytest.approx(0.2 / (1 + steep**2) ** 0.5))
    assert t[1].tpi == pytest.approx(0) and t[1].tri > 0 and (t[2].n_ground, t[2].slope) == (1, None)
    few = cloud.height_above_ground(df.filter("classification = 5"), "cloud", 1.0, least=50, fallback=None)
    assert few.count() == 25 and few.filter("hag IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="no disc"):
        cloud.height_above_ground(df.unionByName(df.limit(1).withColumn("x", F.lit(1e9))), "cloud", 1.0).count()
    assert cloud.crop_or_keep(df, 0.1, "cloud").count() == 1
    assert cloud.crop_or_keep(df.filter("x > 3"), 0.1, "cloud").count() == 60
    assert cloud.centred(df, "cloud").agg(F.min("x"), F.max("x"), F.min("z")).first()[:2] == (-4.5, 4.5)
    assert cloud.affine(df, "cloud", 3).count() == 100
    v = cloud.views(df, "cloud", [3.0, 2.0], 10, ["intensity"])
    assert v.groupBy("view").count().filter("count > 10").count() == 0


def test_shift_recovery(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(24, 24)).cumsum(0).cumsum(1)
    rows = [("u", i, j, float(g[i, j])) for i in range(24) for j in range(24)]
    a = spark.createDataFrame(rows, "unit string, i long, j long, value double")
    b = a.selectExpr("unit", "i + 3 AS i", "j - 2 AS j", "value + 7 AS value")
    r = raster.fft_shift(a, b, "unit", 5).first()
    assert (r.di, r.dj) == (3, -2) and r.r == pytest.approx(1, abs=1e-6)
    s = raster.best_shift(raster.shift_surface(a, b, "unit", 4), "unit").first()
    assert (s.di, s.dj) == (3, -2) and abs(s.sub_i - 3) < 0.5


def test_samplers(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "k")
    drawn = extra.weighted_clusters(df, "k", F.col("k"), 4000, 5)
    assert drawn.agg(F.sum("n")).first()[0] == 4000
    assert drawn.filter("k > 50").agg(F.sum("n")).first()[0] / 4000 == pytest.approx(0.7475, abs=0.04)
    tiles = [("a", 3.0, [[(0, 0), (4, 0), (0, 4), (0, 0)]]), ("b", 1.0, [[(10, 10), (12, 10), (12, 12), (10, 12), (10, 10)], [(10.5, 10.5), (11.5, 10.5), (11.5, 11.5), (10.5, 11.5), (10.5, 10.5)]])]
    a = extra.locations(spark, 400, tiles, 3, ([(0.5, 0.5)], 30_000.0)).collect()
    assert all(r.lon + r.lat < 4 for r in a if r.name == "a") and all(max(abs(r.lon - 11), abs(r.lat - 11)) > 0.5 for r in a if r.name == "b")
    assert all(((r.lon - 0.5) ** 2 + (r.lat - 0.5) ** 2) ** 0.5 * 111_320 > 29_990 for r in a) and 0.6 < sum(r.name == "a" for r in a) / 400 < 0.9
    assert sorted(a)[:5] == sorted(extra.locations(spark, 5, tiles, 3, ([(0.5, 0.5)], 30_000.0)).collect())


def test_small_joins(spark):
    left = spark.createDataFrame([("Alpha Ridge",), ("Alp",), ("Beta",)], "a string")
    right = spark.createDataFrame([("Alpha",), ("Beta Hills North",)], "b string")
    assert sorted(r.a for r in extra.prefixed(left, right, "a", "b", 4).collect()) == ["Alpha Ridge", "Beta"]
    assert sorted(r.a for r in extra.prefixed(left, right, "a", "b").collect()) == ["Alp", "Alpha Ridge", "Beta"]
    with pytest.raises(ValueError):
        extra.assert_unique(left.union(left), ["a"])
    found, unknown = extra.member_of(left, ["a"], ["BETA", "gamma"])
    assert [r.a for r in found.collect()] == ["Beta"] and unknown == ["gamma"]
    cells = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 3.0, 4.0), (0, 1, 0.1, 0.0)], "i long, j long, dx double, dy double")
    assert [(r.i, r.j, r.ni, r.nj, r.gap) for r in extra.neighbour_gaps(cells, 1, 1.0).collect()] == [(0, 0, 1, 0, 5.0)]


def test_wkb_and_fnv(spark):
    import struct

    poly = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + struct.pack("<8d", 0, 0, 1, 0, 1, 1, 0, 0)
    multi = struct.pack("<BII", 1, 6, 2) + poly + poly
    df = spark.createDataFrame([(bytearray(poly),), (bytearray(multi),), (None,)], "g binary")
    got = [r.rings for r in extra.decoded_wkb(df, "g").collect()]
    assert [None if g is None else [len(x) for x in g] for g in got] == [[4], [4, 4], None]
    h = extra.fnv1a(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"), ["a", "b"]).collect()
    x = 14695981039346656037
    for v in (1, 2):
        x = (x * 1099511628211 % 2**64) ^ v
    assert h[0].fnv % 2**64 == x and h[0].fnv != h[1].fnv


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\n1,1.50\n2,NA\n")
    t = src.read_table(spark, str(tmp_path / "t.csv"), text=True, missing="NA")
    assert [(r.id, r.v) for r in t.collect()] == [("1", "1.50"), ("2", None)]
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"a"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert src.read_table(spark, str(tmp_path / "g.geojson")).first().name == "a"
    work = lambda d: d.withColumn("done", F.lit(True))
    out = str(tmp_path / "out.parquet")
    assert src.append_missing(spark, spark.range(3), out, "id", work) == 3
    assert src.append_missing(spark, spark.range(5), out, "id", work) == 2
    assert spark.read.parquet(out).count() == 5
    spec = src.TableSpec("t", "out.parquet", id="id", split="done")
    reg = src.Registry()
    reg.add(spec)
    reg.views(spark, str(tmp_path))
    assert spark.sql("SELECT count(*) FROM t").first()[0] == 5
    with pytest.raises(ValueError):
        reg.add(spec)
    assert src.with_provenance(spark.read.parquet(out), r"/(\w+)\.parquet/", "table_name").first().table_name == "out"
    drift = src.union_drifting([spark.range(1).toDF("id"), spark.range(1).withColumn("x", F.lit(1))])
    assert drift.columns == ["id", "x"] and drift.count() == 2
    assert "| id |" in src.markdown(spark.range(2))


def test_paged_source(spark):
    def fetch(offset, size):
        return [(i, f"row {i}") for i in range(offset, offset + size)]

    spark.dataSource.register(src.paged_source("pages_of_rows", "id long, t string", 1234, fetch))
    df = spark.read.format("pages_of_rows").load()
    assert df.count() == 1234 and df.rdd.getNumPartitions() == 3


def test_reuse_pool(spark, tmp_path):
    from terravane.streaming import windows

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.range(40).selectExpr("id % 2 AS stream", "id AS item").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream long, item long").parquet(str(tmp_path / "in"))
    rows = windows.drained(windows.reuse_pool(stream), "pool").collect()
    p = windows.ReusePool
    for s in (0, 1):
        pool, queue, draw, want = {}, [], 0, []
        for item in range(s, 40, 2):
            draw = windows.step(s, item, pool, queue, draw, want, p.SIZE, p.USES, p.DRAWS, p.WAITING)
        got = [tuple(r) for r in rows if r.stream == s]
        assert sorted(got) == sorted(want) and sum(e == "used" for _, _, e, _ in got) == 20 * p.DRAWS
        # only what reached its quota retires, and the newcomer waits until then
        assert all(n >= p.USES for _, _, e, n in got if e == "retired") and any(e == "retired" for _, _, e, _ in got)
    full = {i: 0 for i in range(8)}
    log: list = []
    windows.step(0, 99, full, [], 0, log, 8, 1000, 5, 10)
    assert 99 not in full and [e for _, _, e, _ in log] == ["fetched"] + ["used"] * 5


def test_late_rows_and_closed_windows(spark, tmp_path):
    from terravane.streaming import windows

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, event_type string, value double"
    at = str(tmp_path / "in")
    batches = [[(day(1), "a", 1.0), (day(2), "a", 1.0)], [(day(8), "a", 1.0), (day(2, 5), "a", 10.0)], [(day(8, 2), "a", 1.0)], [(day(1, 3), "a", 100.0), (day(20), "a", 1.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(at)
        __import__("time").sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = {r.window_start.day: (r.n, r.total) for r in windows.closed(windows.tumbling(stream, "1 day", "2 days", ["event_type"]), "late").collect()}
    # the last batch's row of 1 January comes when the watermark is past that day; 20 January is still open
    assert got == {1: (1, 1.0), 2: (2, 11.0), 8: (2, 2.0)}


def test_round_robin(spark):
    rows = [(s, k) for s, n in ((0, 5), (1, 3), (2, 1)) for k in range(n)]
    got = windows_rows = sorted((r.batch, r.place_in_batch, r.s, r.k) for r in __import__("terravane.streaming.windows", fromlist=["x"]).round_robin(spark.createDataFrame(rows, "s long, k long"), "s", "k", 4).collect())
    assert [(s, k) for _, _, s, k in windows_rows] == sorted(rows, key=lambda r: (r[1], r[0])) and got[4][:2] == (1, 0)


def test_fill_down_resets(spark):
    rows = [(1, "a", "A"), (2, "b", "B"), (3, "c", "C"), (4, "a", "A2"), (5, "c", "C2")]
    df = spark.createDataFrame(rows, "o long, level string, name string")
    got = {r.o: (r.a_name, r.b_name, r.c_name) for r in labels.fill_down(df, "o", "level", "name", ["a", "b", "c"]).collect()}
    assert got == {1: ("A", None, None), 2: ("A", "B", None), 3: ("A", "B", "C"), 4: ("A2", None, None), 5: ("A2", None, "C2")}


def test_sql_functions(spark):
    from terravane.functions.register import register

    assert "utm_zone" in register(spark)
    r = spark.sql("SELECT n_decimals('1.250') AS a, utm_zone(180D) AS b, block_id(0.1D, -100.1D, 0.25D) AS c, window_gap(2007, 2010, 2013) AS d, dequantised(-128D) AS e").first()
    assert tuple(r) == (2, 1, "0_-401", 3, None)


def test_curation_meets_the_contract(spark):
    from terravane.plans import curate

    raw = spark.range(300).selectExpr("id AS plot", "0.1 + (id % 37) / 10.0 AS lat", "0.1 + (id % 31) / 10.0 AS lon", "CAST(2008 + id % 9 AS INT) AS year", "CASE WHEN id % 10 = 0 THEN NULL ELSE 'oak' END AS label")
    f = footprints(spark, [("A 1", 1, 2010, [SQUARE]), ("B", 2, 2014, [SQUARE])])
    c = curate.Curation("plot", [("labelled", F.col("label").isNotNull()), ("valid", funnel.valid_coordinates(F.col("lat"), F.col("lon")))], most_gap=1, keep=["label"])
    table = c.table(raw, f)
    assert curate.contract_errors(table, "plot") == []
    counts = {r.step: r.n for r in c.counts(raw, f).collect()}
    assert counts["all"] == 300 and counts["labelled"] == 270 and counts["near_in_time"] == table.count() > 0
    assert table.filter("abs(year_diff) > 1").count() == 0 and table.first().site_id.startswith(("A_1__", "B__"))
    assert curate.contract_errors(table.drop("year"), "plot") == ["no column year"]


def test_tasks(spark):
    from terravane.plans import tasks

    rows = [(i, float(i % 7), "ab"[i % 2], i % 3 == 0, int(i % 2 == 0), int(i % 5 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, y double, label string, is_test boolean, occ__a int, occ__b int")
    every = tasks.Tasks()
    every.add(tasks.Task("cls", "multiclass", "label", rows="y < 6", least=10))
    every.add(tasks.Task("reg", "regression", "y"))
    every.add(tasks.Task("occ", "multilabel", "occ__"))
    perfect = lambda t, d: t.long(d, "id").filter("is_test").withColumn("predicted", F.col("truth"))
    got = every.run({"cls": df, "reg": df, "occ": df}, {"perfect": perfect})
    values = {(r.task, r.metric): r.value for r in got.collect()}
    assert values["cls", "balanced_accuracy"] == 1 and values["reg", "mean_r2"] == 1 and values["occ", "mean_auroc"] == 1 and values["occ", "mean_ap"] == 1
    assert tasks.summary(got, ["perfect"]).columns == ["task", "metric", "perfect", "low", "high"]
    with pytest.raises(ValueError):
        tasks.Task("x", "ranking", "y")


def test_cloud_augmentations(spark):
    rows = [(c, i, float(i % 10), float(i // 10), 0.1 * i, 2, i * 100, 1, 0.1 * i) for c in (1, 2) for i in range(100)]
    df = spark.createDataFrame(rows, "cloud long, k long, x double, y double, z double, classification int, intensity long, return_number int, hag double")
    for out in (cloud.jittered_intensity(df, "cloud", 1), cloud.tilted_height(df, "cloud", 1), cloud.elastic(df, "cloud", 4.0, 0.2, 1), cloud.features(df.withColumn("number_of_returns", F.lit(0)), "cloud", ["k"])):
        assert out.count() == 200
    e = cloud.elastic(df, "cloud", 4.0, 0.2, 1).join(df.select("cloud", "k", F.col("x").alias("x0")), ["cloud", "k"]).agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0]
    assert 0 < e < 1
    v = cloud.split_views(df, "cloud", 20.0, [2.0], ["k"])
    seen = {r.role for r in v.select("role").distinct().collect()}
    assert seen == {"context", "target"}
    assert v.groupBy("cloud", "k").agg(F.count_distinct("role").alias("n")).filter("n > 1").count() == 0


def test_components_of_chains_and_stars(spark):
    from terravane.operators.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(300, 200), (201, 300)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 180)} == {100} and got[201] == got[300] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_listing(spark, tmp_path):
    import hashlib
    import json

    from terravane.sources import listing

    (tmp_path / "a_2020.bin").write_bytes(b"12")
    (tmp_path / "b_2020.bin").write_bytes(b"1234")
    (tmp_path / "r.json").write_text(json.dumps({"unit": "u", "fits": [{"k": 1, "v": 2.5}, {"k": 2, "v": 3.5}]}))
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in listing.checksums(spark, str(tmp_path / "*.bin")).collect()}
    assert sums["a_2020.bin"] == hashlib.sha256(b"12").hexdigest()
    index = listing.file_index(listing.listed(spark, str(tmp_path / "*.bin")), "name", "bytes", {"year": F.regexp_extract("name", r"_(\d{4})", 1).try_cast("int")})
    assert [(r.year, r.name) for r in index.collect()] == [(2020, "b_2020.bin")]
    units, fits = listing.results(spark, str(tmp_path / "r.json"), "fits", "unit")
    assert units.count() == 1 and sorted((r.unit, r.k, r.v) for r in fits.collect()) == [("u", 1, 2.5), ("u", 2, 3.5)]
    assert listing.shortest(["x/long_events.csv", "x/events.csv", "x/other.txt"], "events.csv") == "x/events.csv"
    assert {r.table_name: (r.n_rows, r.n_columns) for r in listing.profile({"t": spark.range(3).toDF("id")}).collect()} == {"t": (3, 1)}


def test_calibration_cover_and_shadow(spark):
    rows = spark.createDataFrame([(1, 5.0, 5.0, "s"), (2, 15.0, 5.0, "s")], "id long, x double, y double, survey string")
    models = spark.createDataFrame([(0, 0, "s", 1.0, 0.0, 0.0, -2.0, 0.1, None)], "i long, j long, survey string, a double, b double, c double, d double, e double, f double")
    got = {r.id: (r.x, r.y, r.calibrated) for r in extra.calibrated(rows, models, 10.0, "survey").collect()}
    assert got == {1: (6.0, 3.5, True), 2: (15.0, 5.0, False)}
    f = footprints(spark, [("sq", 1, 2010, [ring((0.5, 0), (2, 0), (2, 1), (0.5, 1), (0.5, 0))])])
    assert {(r.i, r.j): r.share for r in extra.covered_cells(f, "name", 1.0, 0.01).collect()} == {(0, 0): 0.5, (1, 0): 1.0}
    ring4 = ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25))
    core = ring((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4))
    holed = footprints(spark, [("h", 1, 2010, [ring((0, 0), (2, 0), (2, 1), (0, 1), (0, 0)), ring4, core]), ("m", 2, 2010, [ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ring((4, 0), (4.5, 0), (4.5, 1), (4, 1), (4, 0))])])
    assert {(r.name, r.i): pytest.approx(r.share) for r in extra.covered_cells(holed, "name", 1.0, 0.01).filter("j = 0").collect()} == {("h", 0): 1 - 0.25 + 0.04, ("h", 1): 1.0, ("m", 0): 1.0, ("m", 4): 0.5}
    wall = spark.createDataFrame([("u", i, 0, 10.0 if i == 3 else 0.0) for i in range(6)], "unit string, i long, j long, value double")
    depth = {r.i: r.depth for r in raster.shadow_depth(wall, "unit", 90.0, 45.0, 1.0, 5).collect()}
    assert depth[2] == pytest.approx(9) and depth[0] == pytest.approx(7) and depth[4] == 0
    marks = raster.landmarks(wall.unionByName(wall.withColumn("unit", F.lit("v"))), "unit", "value", 5.0, 1)
    assert sorted((r.unit, r.n, r.height) for r in marks.collect()) == [("u", 1, 10.0), ("v", 1, 10.0)]


def test_attempts_and_blocks(spark, tmp_path):
    from terravane.operators import attempts

    def work(row):
        if row["id"] == 3:
            raise OSError("gone")
        return None if row["id"] == 4 else row["id"] * 2.0

    got = {r.id: (r.status, r.value, r.n_tries) for r in attempts.attempted(spark.range(6), "id", work, tries=2).collect()}
    assert got[3] == ("error", None, 2) and got[4] == ("empty", None, 1) and got[5] == ("ok", 10.0, 1)
    manifest = spark.createDataFrame([(1, "error", 1), (1, "ok", 2), (2, "ok", 1), (2, "error", 3), (3, "empty", 1)], "id long, status string, at long")
    assert {r.status: r.n for r in attempts.outcome(manifest, "id", "at").collect()} == {"ok": 1, "error": 1, "empty": 1}
    assert sorted(r.id for r in attempts.left_to_do(spark.range(5), manifest, "id", "at").collect()) == [0, 2, 4]
    points = spark.range(1000).selectExpr("CAST(id % 40 AS DOUBLE) AS x", "CAST(id div 40 AS DOUBLE) AS y", "id")
    src.write_blocks(points, str(tmp_path / "blocks"), 5.0, 4)
    cut = src.read_square(spark, str(tmp_path / "blocks"), 5.0, 3.0, 4.0, 12.0, 9.0)
    assert cut.count() == points.filter("x >= 3 AND x < 12 AND y >= 4 AND y < 9").count() == 45
    assert "GreaterThanOrEqual(block_i,0" in cut._jdf.queryExecution().executedPlan().toString()


def test_fallback_with_null_columns(spark):
    left = spark.createDataFrame([(1, 5, 2010, None), (2, 5, 2010, "note"), (3, 5, None, None), (4, None, 2010, "x"), (5, 6, 2010, "y")], "id long, cell long, year int, note string")
    files = spark.createDataFrame([(5, 2009, "a"), (5, 2011, "b"), (5, None, "c"), (7, 2010, "d")], "cell long, year int, file string")
    for later, want in ((True, "b"), (False, "a")):
        got = {r.id: (r.note, r.found_year, r.file) for r in match.with_fallback(left, files, "cell", "year", ["file"], later, ["file"]).collect()}
        assert got[1][2] == got[2][2] == want and got[1][0] is None and len(got) == 5
        assert got[3][2] is got[4][2] is got[5][2] is None


def test_pairs_across_the_date_line(spark):
    a = spark.createDataFrame([(1, 10.0, 179.9999), (2, 10.0, -179.9999), (3, 10.0, 0.0), (4, None, 179.9), (5, 89.9999, 10.0), (6, 89.9999, -170.0)], "id long, lat double, lon double")
    got = {(r.a_id, r.b_id) for r in match.pairs_within(a, 50.0, "id", []).collect()}
    assert got == {(1, 2), (5, 6)}
    wide = {(r.a_id, r.b_id) for r in match.pairs_within(a.filter("id < 4"), 3e7, "id", []).collect()}
    assert wide == {(1, 2), (1, 3), (2, 3)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-80, 80), st.floats(-180, 180)), min_size=2, max_size=12), st.sampled_from([1e4, 1e6, 5e6]))
def test_within_equals_brute_force(spark, places, radius):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lat double, lon double")

    def metres(p, q):
        dx = ((q[1] - p[1] + 540) % 360 - 180) * np.cos(np.radians((p[0] + q[0]) / 2))
        return np.hypot(dx, q[0] - p[0]) * 111_320.0

    got = {(r.a_id, r.b_id) for r in match.pairs_within(df, radius, "id", []).collect()}
    want = {(i, j) for i, p in enumerate(places) for j, q in enumerate(places) if i < j and metres(p, q) <= radius * (1 - 1e-9)}
    most = {(i, j) for i, p in enumerate(places) for j, q in enumerate(places) if i < j and metres(p, q) <= radius * (1 + 1e-9)}
    assert want <= got <= most


def test_neighbours_of_rows_without_coordinates(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 0.0, 179.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(7, 0.0, 1.0), (8, 0.0, -179.0), (9, None, None)], "to long, lat double, lon double")
    got = {(r.id, r.k_rank): r.to for r in match.nearest_k(left, right, 2, "id", "to", 1000.0).collect()}
    assert got == {(1, 1): 7, (1, 2): 8, (3, 1): 8, (3, 2): 7}
    assert match.nearest_k(left, right.limit(0), 2, "id", "to", 1000.0).count() == 0


def test_row_queries_and_expressions(spark):
    df = spark.createDataFrame([(1, "a == b", 4.0, 0.0), (2, "it's", 9.0, 3.0), (3, None, 8.0, 2.0)], "id long, t string, x double, y double")
    ids = lambda q: sorted(r.id for r in df.filter(extra.where(q)).collect())
    assert ids('t == "a == b"') == [1] and ids('t == "it\'s" or id in [3]') == [2, 3] and ids("t.isna()") == [3]
    v = lambda e: [r.v for r in extra.computed(df, "v", e).orderBy("id").collect()]
    assert v("(x / 2) / y") == [None, 1.5, 2.0] and v("x / (y / 2)") == [None, 6.0, 8.0] and v("x / y / 2 + 1") == [None, 2.5, 3.0]
    assert v("length('a/b') / 1.0") == [3.0] * 3


def test_locations_found_again(spark):
    from terravane.operators import funnel as fn

    lat, lon = 41.25, -105.5
    s = fn.utm_of(spark.createDataFrame([(lat, lon)], "lat double, lon double")).first()
    rows = [("plain", str(lon), str(lat), None), ("sign", str(-lon), str(lat), None), ("own", str(s.x), str(s.y), "13"), ("none", str(s.x), str(s.y), "0"), ("wrong", str(s.x), str(s.y), "11"), ("swapped", str(s.y), str(s.x), "13"), ("empty", None, "1", "13"), ("text", "n/a", "x", None)]
    df = spark.createDataFrame(rows, "id string, x string, y string, z string")
    got = {r.id: r for r in fn.located(df, "x", "y", "z", (-106.0, -105.0, 41.0, 41.5)).collect()}
    for k in ("plain", "sign", "own", "none", "wrong", "swapped"):
        assert (got[k].lat, got[k].lon) == (pytest.approx(lat, abs=1e-6), pytest.approx(lon, abs=1e-6)), k
    assert {k: got[k].location_flags for k in got} == {
        "plain": "", "sign": "lon_sign_assumed", "own": "", "none": "utm_zone_inferred", "wrong": "utm_zone_corrected", "swapped": "utm_xy_swapped", "empty": "no_coordinates", "text": "no_coordinates",
    }
    order = fn.located(spark.createDataFrame([("41.25", "80.5", "17")], "x string, y string, z string"), "x", "y", "z", (-81.0, -80.0, 41.0, 41.5)).first()
    assert (order.lat, order.lon, order.location_flags) == (41.25, -80.5, "latlon_swapped_lon_sign_assumed")


def test_smooth_rasters_and_colours(spark):
    from terravane.operators import augment

    g = np.full((6, 5), 3.0)
    assert cloud.blurred(g, 1.5) == pytest.approx(g)
    spike = np.zeros((21, 21))
    spike[10, 10] = 1.0
    b = cloud.blurred(spike, 1.5)
    assert b.sum() == pytest.approx(1) and b[10, 11] / b[10, 10] == pytest.approx(np.exp(-1 / 4.5))
    rows = [("u", i, j, 5.0 + i, None if (i, j) == (1, 1) else 2.0, None, 1.0, 10.0 * (1 + i)) for i in range(4) for j in range(4)]
    cells = spark.createDataFrame(rows, "u string, i long, j long, dsm double, dtm double, chm double, density double, intensity double")
    got = {(r.i, r.j): r for r in cloud.smooth_rasters(cells, "u").collect()}
    assert got[1, 1].dtm == pytest.approx(2) and got[3, 0].chm == pytest.approx(6) and got[0, 0].intensity == pytest.approx(10 / 25)
    df = spark.createDataFrame([(c, k, (k * 37) % 256, (k * 91) % 256, (k * 53 + 7) % 256) for c in range(3) for k in range(60)], "cloud long, k long, r int, g int, b int")
    same = augment.colour_turned(df, "cloud", 1, 0.0, 0.0).join(df.select("cloud", "k", *(F.col(c).alias(f"{c}0") for c in "rgb")), ["cloud", "k"])
    assert same.agg(*(F.max(F.abs(F.col(c) - F.col(f"{c}0"))).alias(c) for c in "rgb")).first() == pytest.approx((0, 0, 0), abs=1e-9)
    for out in (augment.colour_turned(df, "cloud", 1, 0.2, 0.3), augment.colour_scaled(df, "cloud", 1, 0.2, 0.2, 0.2)):
        assert out.filter("r < 0 OR r > 255.001 OR g < 0 OR g > 255.001 OR b < 0 OR b > 255.001").count() == 0
    one = augment.colour_scaled(df, "cloud", 1, 0.0, 0.0, 0.0).join(df.select("cloud", "k", F.col("r").alias("r0")), ["cloud", "k"])
    assert one.filter("abs(r - r0) > 1e-9").count() == 0


def test_hilbert_way_back():
    xyz = np.random.default_rng(2).integers(0, 64, (500, 3))
    assert (cloud.hilbert_coords(cloud.hilbert_index(xyz, 6), 6) == xyz).all()
    order = cloud.hilbert_coords(np.arange(512), 3)
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_fixed_values_by_group(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "b", 3)], "g long, x string, y int")
    assert sorted(tuple(r) for r in labels.unchanging(df, "g", ["x", "y"]).collect()) == [(1, "a", None), (2, "b", 3)]
    with pytest.raises(Exception, match="several values for 1"):
        labels.unchanging(df.union(spark.createDataFrame([(1, "c", None)], df.schema)), "g", ["x"]).collect()


def test_pooled_spread_and_edges(spark):
    rows = [("u", b, di, dj, 1.0 if (di, dj) == ((1, 0) if b < 9 else (-1, 1)) else 0.1 * b) for b in range(10) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    best, sd = raster.pooled_peak(spark.createDataFrame(rows, "u string, b long, di int, dj int, r double"), "u", "b")
    assert tuple(best.select("di", "dj").first()) == (1, 0) and sd.first().sd_i < 1
    grid = spark.createDataFrame([("u", i, j, float((i > 4) * 10), float(j)) for i in range(10) for j in range(10)], "u string, i long, j long, a double, b double")
    edges = raster.edge_stack(grid, "u", ["a", "b"], 1.0, 2)
    got = {(r.i, r.j): r.a for r in edges.collect()}
    assert got[5, 5] > 1 > 0 > got[2, 5] and edges.columns == ["u", "i", "j", "a", "b"]


def test_tasks_cover_the_surveyed_ones(spark):
    from terravane.plans import tasks

    assert len(tasks.SPECS) == 15 and len({t.name for t in tasks.SPECS}) == 15 and {t.kind for t in tasks.SPECS} == set(tasks.KINDS)
    named = {t.name: t for t in tasks.SPECS}
    birds = spark.createDataFrame([(1.0, 2.0, 2015, False, 0, 4, "x"), (1.0, 3.0, 2030, True, 2, 0, "y")], "lat double, lon double, year int, is_test boolean, crow int, wren int, route string")
    f = named["bbs_occurrence"].frame(birds, "lat", "lon", "is_test", ["lat", "lon", "year", "is_test", "route"])
    assert f.columns == ["lat", "lon", "year", "emb_year", "is_test", "crow", "wren"]
    assert sorted(tuple(r)[3:] for r in f.collect()) == [(2017, False, 0, 1), (2025, True, 1, 0)] and tasks.clipped_share(f).first()[0] == 1
    plots = spark.createDataFrame([(1.0, 2.0, 2018, False, 5.0, 7, "p"), (1.0, 2.0, 2018, False, 5.0, 7, None)], "lat double, lon double, year int, is_test boolean, basal_area_m2ha double, total_trees int, product_name_AWS string")
    assert named["ofo_trees"].frame(plots, "lat", "lon", "is_test", []).count() == 1


def test_small_tables_only_as_markdown(spark):
    assert src.markdown(spark.range(2)).count("|") == 8
    with pytest.raises(ValueError):
        src.markdown(spark.range(5), most=4)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from terravane import runtime

    sc = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *_: None), master="spark://host:7077")
    with pytest.raises(ValueError):
        runtime.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None)))


def test_collapse_of_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)) * [3, 1, 1, 0.1, 0.1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = embed.collapse(df, "v", 5)
    p = np.clip(np.linalg.eigvalsh(np.cov(x.T, bias=True)), 0, None)
    p = p / p.sum()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = (u @ u.T)[np.triu_indices(80, 1)]
    assert got["n"] == 80 and got["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert got["mean_sd"] == pytest.approx(x.std(0).mean()) and got["mean_cosine"] == pytest.approx(cosines.mean())


def test_shards_and_splits_against_their_hashes(spark):
    import hashlib
    import zlib

    rows = spark.range(200).withColumn("s", src.shard(F.col("id"))).collect()
    assert all(r.s == zlib.crc32(str(r.id).encode()) % 256 for r in rows)
    sites = spark.createDataFrame([(i, 25 + i * 0.37, -120 + i * 0.61) for i in range(60)], "id long, lat double, lon double")
    for r in splits.spatial_split(sites).collect():
        key = f"{splits.SEED}:{splits.DEGREES}:{r.block}".encode()
        assert r.is_test == (int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "big") / 2**64 < splits.FRACTION)
    grouped = splits.spatial_split(sites.withColumn("g", F.col("id") % 7), group="g").groupBy("g").agg(F.count_distinct("block").alias("n")).collect()
    assert {r.n for r in grouped} == {1}


def test_ridge_of_vectors_equals_the_closed_form(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(120, 4)), rng.normal(size=120)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3 == 0) for i in range(120)], "id long, v array<double>, y double, t boolean")
    got = {r.id: r.predicted for r in probe.vector_ridge_scores(df, "v", "y", "t", "id", 0.1, 4).collect()}
    ins = np.arange(120) % 3 > 0
    a = np.column_stack([np.ones(ins.sum()), x[ins]])
    w = np.linalg.solve(a.T @ a + np.diag([0.0] + [0.1 * ins.sum()] * 4), a.T @ y[ins])
    assert got == {i: pytest.approx(w[0] + x[i] @ w[1:]) for i in range(0, 120, 3)}


def test_sigmoid_scores(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 3))
    rows = [(i, x[i].tolist(), i % 3 == 0, int(x[i, 0] > 0.5), int(x[i, 1] > 0) if i % 5 else None, 0) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, v array<double>, t boolean, a int, b int, never int")
    got = probe.sigmoid_scores(df, "v", ["a", "b", "never"], "t", "id", 1e-3)
    assert got.count() == 240 and got.filter("target = 'never' AND predicted <> 0").count() == 0
    auc = {r.target: r.auroc for r in metrics.auroc(got.filter("truth IS NOT NULL"), "target", "truth", "predicted").collect()}
    assert auc["a"] > 0.97 and auc["b"] > 0.97


def test_walks(spark):
    from terravane.sources import walks

    pages = {None: ([1, 2], "a"), "a": ([3], "b"), "b": ([4, 5], None)}
    assert walks.cursor_walk(pages.__getitem__, 100.0) == ([1, 2, 3, 4, 5], walks.Report(True, 3, 5, None))
    times = iter([0.0, 1.0, 11.0])
    rows, report = walks.cursor_walk(pages.__getitem__, 10.0, clock=lambda: next(times))
    assert rows == [1, 2, 3] and report == walks.Report(False, 2, 3, "b")
    assert walks.cursor_walk(pages.__getitem__, 10.0, start=report.cursor)[0] == [4, 5]
    failures = [OSError(), OSError()]

    def unsteady(cursor):
        if failures:
            raise failures.pop()
        return pages[cursor]

    assert walks.cursor_walk(unsteady, 100.0, pause=lambda _: None)[1].complete
    with pytest.raises(OSError):
        walks.cursor_walk(lambda _: (_ for _ in ()).throw(OSError("gone")), 1.0, pause=lambda _: None)
    listing = {None: {"contents": [{"key": "p/a", "bytes": 3}], "folders": ["p/x/"], "next": "t"}, "t": {"contents": [{"key": "p/b", "bytes": "4"}], "folders": ["p/x/", "p/y/"]}}
    df, folders, report = walks.listed_objects(spark, lambda _, token: listing[token], "p/")
    assert sorted(tuple(r) for r in df.collect()) == [("p/a", 3), ("p/b", 4)] and folders == ["p/x/", "p/y/"] and report.complete


def test_sheets(spark, tmp_path):
    import zipfile

    from terravane.sources import walks

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>va</t></r><r><t>lue</t></r></si><si><t>oak &amp; elm</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3"><v>2.5</v></c></row><row r="4"><c r="C4" t="b"><v>1</v></c><c r="AA4" t="inlineStr"><is><t>far</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    cells = walks.read_sheets(spark, str(tmp_path / "*.xlsx"), "one")
    assert sorted((r.row, r.column, r.text) for r in cells.collect()) == [(0, 0, "name"), (0, 2, "value"), (2, 0, "oak & elm"), (2, 2, "2.5"), (3, 2, "true"), (3, 26, "far")]
    assert sorted(tuple(r) for r in walks.sheet_table(cells).collect()) == [(2, "oak & elm", "2.5"), (3, None, "true")]
    assert walks.read_sheets(spark, str(tmp_path / "*.xlsx"), "two").count() == 0


def test_csv_with_several_texts_for_no_value(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name,v\n1,NA,2.50\n2,x, N/A \n3,-,\n")
    typed = src.read_table(spark, str(tmp_path / "t.csv"), missing=src.MISSING)
    assert [tuple(r) for r in typed.orderBy("id").collect()] == [(1.0, None, 2.5), (2.0, "x", None), (3.0, None, None)]
    assert [tuple(r) for r in src.read_table(spark, str(tmp_path / "t.csv"), text=True, missing=src.MISSING).orderBy("id").collect()][0] == ("1", None, "2.50")


def test_regression_search_finds_a_shift(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 16, 16)).cumsum(1)
    rows = [("u", i, j, float(a[i, j]), float(b[i, j])) for i in range(16) for j in range(16)]
    stack = spark.createDataFrame(rows, "u string, i long, j long, a double, b double")
    target = stack.selectExpr("u", "i - 1 AS i", "j + 2 AS j", "2 * a - 3 * b + 5 AS value")
    best = raster.regression_surface(stack, target, "u", ["a", "b"], 2, 0.0).orderBy(F.desc("r2")).first()
    assert (best.di, best.dj) == (-1, 2) and best.r2 == pytest.approx(1)
    field = spark.createDataFrame([("u", float(x), float(y), 1 + 0.1 * x - 0.2 * y, -2 + 0.3 * y, 1.0 + x) for x in range(4) for y in range(4)], "u string, x double, y double, dx double, dy double, w double")
    assert tuple(raster.fitted_field(field, "u").first())[1:] == pytest.approx((1, 0.1, -0.2, -2, 0, 0.3))
    line = field.filter("x = y")
    flat = raster.fitted_field(line, "u").first()
    assert (flat.b, flat.c) == (0, 0)


def test_constant_sides_have_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 5.0), (3, 1.0, 2.0), (3, 2.0, 4.0), (3, None, 9.0)], "g int, a double, b double")
    got = {r.g: r.c for r in df.groupBy("g").agg(tx.correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got == {1: None, 2: None, 3: pytest.approx(1)}
    flat = spark.createDataFrame([("u", i, j, 1.0) for i in range(3) for j in range(3)], "u string, i long, j long, value double")
    assert raster.best_shift(raster.shift_surface(flat, flat, "u", 1), "u").count() == 0


def test_a_flat_surface_has_no_slopes(spark):
    flat = spark.range(100).selectExpr("0 AS u", "id div 10 AS i", "id % 10 AS j", "47.3D AS dsm", "CAST(id AS DOUBLE) AS chm", "1.0D AS intensity")
    got = raster.feature_stack(flat, "u", reach=2).filter("i BETWEEN 1 AND 8 AND j BETWEEN 1 AND 8").collect()
    assert len(got) == 64 and {(r.slope_i, r.slope_j) for r in got} == {(0.0, 0.0)}


def test_discs_are_not_broadcast_and_spots_are_looked_up_once(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 4.0), (1, 0, 1, 8.0), (1, 1, 0, 9.0)], "file long, row long, col long, v double")
    files = spark.createDataFrame([(1, 0.0, 10.0, 5.0, 9.0)], "file long, x0 double, y0 double, cell double, nodata double")
    places = spark.createDataFrame([(1, 1, 2.0, 8.0), (2, 1, 2.0, 8.0), (2, 1, 2.0, 3.0), (3, 1, None, 8.0), (4, 2, 2.0, 8.0), (5, 1, 900.0, 8.0)], "k long, file long, x double, y double")
    found = raster.disc_means(pixels, files, places, "k", "file", "v", 4.0)
    # offsets of 4 around (2, 8): itself, left (outside), right, up (outside) and down (no data)
    assert {r.k: (r.n, r.mean) for r in found.collect()} == {1: (2, 6.0), 2: (3, 16 / 3), 3: (0, None), 5: (0, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate explode") :]
    assert "Join Inner" in below[: below.index("LogicalRDD")]  # the files are joined before there are many rows


def test_neighbours_of_places_that_many_rows_share(spark):
    spots = [(0.0, 0.0), (0.0, 1.0), (3.0, 0.5), (20.0, 20.0)]
    left = [(i, *spots[i % 4]) for i in range(40)] + [(100, float("nan"), 1.0), (101, 1.0, float("inf")), (7, 0.0, 0.9)]
    right = [(i, *[(0.0, 0.5), (0.0, -0.5), (40.0, 0.0)][i % 3]) for i in range(300)] + [(900, float("nan"), 0.0)]
    frames = spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "to long, lat double, lon double")
    seen = []
    keep, match.within = match.within, lambda a, b, radius: seen.append((a.count(), b.count())) or keep(a, b, radius)
    try:
        got = match.nearest_k(*frames, 3, "id", "to", 50_000.0).collect()
    finally:
        match.within = keep
    want = {}
    for i, a, b in left:
        near = sorted((round(float(np.hypot((d - b) * np.cos(np.radians((a + c) / 2)), c - a) * geo.DEGREE_M), 6), t) for t, c, d in right) if np.isfinite(a + b) else []
        want[i] = sorted(want.get(i, []) + [n for n in near if n[0] == n[0]])[:3]
    assert {(r.id, r.k_rank): (round(r.distance, 6), r.to) for r in got} == {(i, k): n for i, ns in want.items() for k, n in enumerate(ns, 1)}
    assert seen[0] == (5, 9)  # five places, and three rows for each of three


def test_weighted_means_of_places_that_many_rows_share(spark):
    left = spark.createDataFrame([(i, 0.0, float(i % 2)) for i in range(20)] + [(99, float("nan"), 0.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(i, 0.0, -1.0 if i % 2 else 3.0, float(i)) for i in range(40)], "to long, lat double, lon double, v double")
    near = match.nearest_k(left, right, 2, "id", "to", 10_000.0)
    got = {r.id: round(r.v, 9) for r in match.inverse_distance(near, right, "id", "to", "v").collect()}
    assert got == {i: 0.5 if i % 2 else 2.0 for i in range(20)}


def test_weighted_means_are_made_once_for_each_place(spark, monkeypatch):
    spots = [(0.0, 0.0), (0.0, 1.0), (3.0, 0.5), (20.0, 20.0)]
    rows = [(i, *spots[i % 4]) for i in range(40)] + [(7, 0.0, 0.9), (8, 0.0, 0.0), (None, 0.0, 0.0), (None, 3.0, 0.5), (99, float("nan"), 0.0)]
    left = spark.createDataFrame(rows, "id long, lat double, lon double")
    right = spark.createDataFrame([(i, *[(0.0, 0.5), (0.0, -0.5), (40.0, 0.0)][i % 3], float(i % 7)) for i in range(60)], "to long, lat double, lon double, v double")
    want = {r.id: round(r.v, 9) for r in match.inverse_distance(match.nearest_k(left, right, 3, "id", "to", 50_000.0), right, "id", "to", "v").collect()}
    weighed = []
    mean = match.inverse_distance
    monkeypatch.setattr(match, "inverse_distance", lambda near, *a: weighed.append(near.count()) or mean(near, *a))
    got = match.weighted_nearest(left, right, 3, "id", "to", "v", 50_000.0).collect()
    assert len(got) == len(want) == 41 and {r.id: round(r.v, 9) for r in got} == want
    assert weighed == [15, 9]  # three for each of five places, and for each key with several rows
    assert match.weighted_nearest(left, right.limit(0), 3, "id", "to", "v", 50_000.0).count() == 0


def test_pairs_and_links_of_places_that_many_rows_share(spark):
    spots = [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (9.0, 9.0), (float("nan"), 0.0), (None, 1.0), (30.0, 30.0)]
    rows = [(i, *spots[i % 5], i % 3) for i in range(60)] + [(60, *spots[5], 0), (61, *spots[6], 0), (3, *spots[6], 1)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, y int")
    want = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and b[1] is not None and (d := np.hypot((b[2] - a[2]) * np.cos(np.radians((a[1] + b[1]) / 2)), b[1] - a[1]) * geo.DEGREE_M) <= 60_000:
                want.append((a[0], a[3], b[0], b[3], round(float(d), 1)))
    got = match.pairs_within(df, 60_000.0, "id", ["y"], digits=1)
    assert sorted((r.a_id, r.a_y, r.b_id, r.b_y, r.distance) for r in got.collect()) == sorted(want)
    sought = []
    keep, graph.components = graph.components, lambda links, name: sought.append(links.count()) or keep(links, name)
    try:
        found = match.components_within(df, 60_000.0, "id")
    finally:
        graph.components = keep
    assert sought[0] < 10 < len(want)
    reach = {}
    for a, _, b, _, _ in want:
        joined = reach.get(a, {a}) | reach.get(b, {b})
        reach |= dict.fromkeys(joined, joined)
    assert sorted((r.id, r.comp) for r in found.collect()) == sorted((i, min(x)) for i, x in reach.items())


def test_distances_are_the_same_both_ways(spark):
    df = spark.range(20000).selectExpr("25 + id * 7919 % 2400 / 100.0D AS a", "-124 + id * 104729 % 5600 / 100.0D AS b", "25 + id * 31 % 2400 / 100.0D AS c", "-124 + id * 17 % 5600 / 100.0D AS d")
    there, back = geo.metres(F.col("a"), F.col("b"), F.col("c"), F.col("d")), geo.metres(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    assert df.filter(there != back).count() == 0


def test_shapes_and_places_that_many_rows_share_meet_once(spark):
    f = footprints(spark, [(f"n{i}", i, None if i == 0 else 2000 + i % 7, [SQUARE, HOLE] if i % 2 else [SQUARE]) for i in range(30)])
    rows = [(i, *[(0.5, 0.5), (1.5, 1.5), (9.0, 9.0), (None, 1.0), (float("nan"), 1.0)][i % 5], None if i == 50 else 2003 + i % 3) for i in range(51)]
    s = spark.createDataFrame(rows, "id long, lat double, lon double, year int")
    met = []
    keep, match.cut = match.cut, lambda df, name, by=None: met.append((name, (out := match_cut(df, name, by)).count())) or out
    match_cut = keep
    try:
        got = match.covering(s, f).select("id", "name", "year", "ordinal").collect()
        best = match.nearest_covering(s, f, "id").collect()
    finally:
        match.cut = keep
    want = [(i, n) for i, a, _, _ in rows for n in range(30) if a == 0.5 or a == 1.5 and n % 2 == 0]
    assert sorted((r.id, r.ordinal) for r in got) == want and all(r.name == f"n{r.ordinal}" for r in got)
    assert met[:3] == [("shape", 2), ("spot", 5), ("covering", 3)]
    near = {}
    for i, n in want:
        if n:
            y, c = rows[i][3], 2000 + n % 7
            near[i] = min(near.get(i, (99, 99)), (abs(c - y) if y else 0, n))
    assert {(r.id, r.gap, r.name) for r in best} == {(i, g if rows[i][3] else None, f"n{n}") for i, (g, n) in near.items()}


def test_nearest_points_of_positions_that_many_share(spark):
    rng = np.random.default_rng(3)
    spots = [tuple(float(v) for v in p) for p in rng.integers(-300, 300, (120, 3)) / 10]
    left = [(i % 2, i, *spots[i % 40]) for i in range(200)] + [(0, 900, None, 0.0, 0.0), (1, 901, float("nan"), 0.0, 0.0), (1, 902, 5e6, 0.0, 0.0), (None, 903, 0.0, 0.0, 0.0), (0, 4, *spots[50])]
    right = [(i % 3, i, *spots[30 + i % 90]) for i in range(900)] + [(1, 2000, 5e6 + 9.0, 0.0, 0.0), (1, 2001, float("nan"), 0.0, 0.0), (0, 2002, None, 0.0, 0.0)]
    a = spark.createDataFrame(left, "u long, ka long, x double, y double, z double")
    b = spark.createDataFrame(right, "u long, kb long, x double, y double, z double")
    made = []
    keep, extra.cut = extra.cut, lambda df, name, by=None: made.append((name, (out := keep(df, name, by)).count())) or out
    try:
        got = extra.nearest_in_cell(a, b, "u", "ka", "kb", 9.0).collect()
    finally:
        extra.cut = keep
    want = {}
    for u, k, *p in left:
        if u is not None and p[0] is not None:
            near = [((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2, kb) for v, kb, *q in right if v == u and q[0] is not None]
            near = [n for n in near if n[0] <= 81.0]
            if near:
                want[u, k] = min(want.get((u, k), (1e9, 0)), min(near))
    assert {(r.u, r.ka): (r.d2, r.kb) for r in got} == want and len(got) == len(want)
    sizes = dict(reversed(made))
    assert sizes["nearest-right"] <= 3 * 90 + 1 and sizes["nearest-rest"] <= 2 * 40 + 3 and len(made) > 4

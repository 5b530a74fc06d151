"""Counted filters, coordinate checks and repairs, schema health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geo

#: Longitude and latitude bounds, named.
Box = tuple[float, float, float, float]


def filtered(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows for which every step holds; null counts as not."""
    for _, p in steps:
        df = df.filter(p)
    return df


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step_no, step, n, dropped): rows left after each step, all counted in one pass."""
    keep, counts = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, p) in enumerate(steps, 1):
        keep = keep & F.coalesce(p, F.lit(False))
        counts.append(F.count_if(keep).alias(f"n{i}"))
    names = ["all", *(n for n, _ in steps)]
    rows = ", ".join(f"{i}, '{n}', n{i}" for i, n in enumerate(names))
    out = df.agg(*counts).select(F.expr(f"stack({len(names)}, {rows}) AS (step_no, step, n)"))
    before = F.lag("n").over(Window.orderBy("step_no"))  # one row for each step
    return out.withColumn("dropped", F.coalesce(before - F.col("n"), F.lit(0)).cast("long"))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def coordinate_checks(df: DataFrame, boxes: list[Box], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(check_name, n): missing, out of range, at zero, outside all boxes, and of these: swapped or with a lost sign."""
    y, x = F.col(lat), F.col(lon)
    inside = lambda a, b: F.coalesce(_any([b.between(w, e) & a.between(s, n) for w, e, s, n in boxes]), F.lit(False))
    there = y.isNotNull() & x.isNotNull()
    outside = there & valid_coordinates(y, x) & ~inside(y, x)
    checks = {
        "missing": ~there,
        "out_of_range": there & ~(y.between(-90, 90) & x.between(-180, 180)),
        "zero": there & (y == 0) & (x == 0),
        "outside": outside,
        "swapped": outside & inside(x, y),
        "lost_sign": outside & inside(y, -x),
    }
    counts = df.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    return counts.unpivot([], list(checks), "check_name", "n")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def repaired(df: DataFrame, box: Box, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with lat and lon replaced by the candidate (as is, swapped, sign of either or both changed) nearest to box, and a flag."""
    w, e, s, n = box
    y, x = F.col(lat), F.col(lon)
    away = lambda a, b: F.greatest(F.lit(s) - a, a - F.lit(n), F.lit(0.0)) + F.greatest(F.lit(w) - b, b - F.lit(e), F.lit(0.0))
    tried = [("as_is", y, x), ("swapped", x, y), ("lon_sign", y, -x), ("lat_sign", -y, x), ("both_signs", -y, -x), ("swapped_sign", x, -y)]
    options = F.array(*(F.struct(away(a, b).alias("away"), F.lit(i).alias("rank"), a.cast("double").alias("lat"), b.cast("double").alias("lon"), F.lit(flag).alias("flag")) for i, (flag, a, b) in enumerate(tried)))
    ok = F.filter(options, lambda o: o["lat"].between(-90, 90) & o["lon"].between(-180, 180))
    best = F.try_element_at(F.array_sort(ok), F.lit(1))
    return df.withColumn("_best", best).withColumn(lat, F.col("_best.lat")).withColumn(lon, F.col("_best.lon")).withColumn("coord_flag", F.coalesce("_best.flag", F.lit("missing"))).drop("_best")


def located(df: DataFrame, x: str, y: str, zone: str, box: Box | None, near: float = 0.25) -> DataFrame:
    """df with lat, lon, box_distance (degrees) and location_flags, from raw coordinates of unknown order, sign and zone.

    Coordinates within the range of degrees are tried as given, with the longitude's sign lost, and in the other
    order; others are eastings and northings (in that order, unless the first is over a million), put through their
    own zone and, if that is missing or leads further than near from the box, through every zone that the box
    touches and the next. The candidate nearest to the box is taken, the first of equals."""
    w, e, s, n = box or (-180.0, -60.0, 17.0, 72.0)
    a, b = F.col(x).try_cast("double"), F.col(y).try_cast("double")
    swap = F.coalesce((a > 1_000_000) & (b < 1_000_000), F.lit(False))
    a, b = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    own = F.col(zone).try_cast("double")
    own = F.when(own.between(1, 60), own.cast("int"))
    degrees = (F.abs(a) <= 180) & (F.abs(b) <= 90)
    away = lambda lat, lon: F.sqrt(F.pow(F.greatest(F.lit(w) - lon, lon - F.lit(e), F.lit(0.0)), F.lit(2)) + F.pow(F.greatest(F.lit(s) - lat, lat - F.lit(n), F.lit(0.0)), F.lit(2)))

    def option(rank: Column, ok: Column, lat: Column, lon: Column, flag: Column) -> Column:
        return F.when(ok, F.struct(F.round(away(lat, lon), 9).alias("d"), rank.alias("rank"), lat.alias("lat"), lon.alias("lon"), flag.alias("flag")))

    at = lambda k, ok, lat, lon, flag: option(F.lit(k), ok, lat, lon, F.lit(flag))
    plain = F.array(at(0, degrees, b, a, ""), at(1, degrees & (a >= 17) & (F.abs(b) <= 72), b, -a, "lon_sign_assumed"), at(2, degrees & (F.abs(a) < 72) & (F.abs(b) > 60), F.abs(a), -F.abs(b), "latlon_swapped_lon_sign_assumed"))
    # the row's own zone first, then those around the box: one expression for all, however many they are
    zones = [z for z in range(int((w + 180) // 6), int((e + 180) // 6) + 3) if 1 <= z <= 60] if box else []
    flag = F.when(own.isNull(), "utm_zone_inferred").otherwise("utm_zone_corrected")
    place = lambda z: F.struct(z.alias("z"), *(c.alias(n) for c, n in zip(geo.inverse_transverse_mercator(a, b, z * 6 - 183), ("lat", "lon"), strict=True)))
    df = df.withColumn("_grid", F.when(~degrees, F.transform(F.filter(F.array(own, *map(F.lit, zones)), lambda z: z.isNotNull()), place)))
    good = own.isNotNull() & F.coalesce(away(F.col("_grid")[0]["lat"], F.col("_grid")[0]["lon"]) <= near, F.lit(False))
    grid = F.transform(F.coalesce("_grid", F.array()), lambda g, i: option(i, F.when(own.isNull(), True).otherwise((i == 0) | (~good & (g["z"] != own))), g["lat"], g["lon"], F.when((i == 0) & own.isNotNull(), F.lit("")).otherwise(flag)))
    tried = F.array_sort(F.filter(F.concat(plain, grid), lambda o: o.isNotNull()))
    metres = ~degrees
    out = df.withColumn("_best", F.try_element_at(tried, F.lit(1)))
    flags = [F.when(a.isNull() | b.isNull(), "no_coordinates"), F.when(swap, "utm_xy_swapped"), F.nullif(F.col("_best.flag"), F.lit("")), F.when(metres & F.col("_best").isNull(), "utm_zone_missing"), F.when(F.col("_best.d") > near, "outside_box")]
    return out.withColumns({"lat": F.col("_best.lat"), "lon": F.col("_best.lon"), "box_distance": F.col("_best.d"), "location_flags": F.array_join(F.array_compact(F.array(*flags)), ";")}).drop("_best", "_grid")


def projection_ranking(df: DataFrame, candidates: dict[str, tuple[Column, Column]], box: Box) -> DataFrame:
    """(candidate, inside): the share of rows that each candidate's latitude and longitude put into box, in one pass."""
    w, e, s, n = box
    shares = df.agg(*(F.avg((lat.between(s, n) & lon.between(w, e)).cast("double")).alias(c) for c, (lat, lon) in candidates.items()))
    return shares.unpivot([], list(candidates), "candidate", "inside")


def cleaned_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Values out of bounds as nulls, and how many there were of each column."""
    bad = {c: ~F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
    notes = df.agg(*(F.count_if(b).alias(c) for c, b in bad.items())).unpivot([], list(bounds), "column_name", "n_out")
    return df.withColumns({c: F.when(~b, F.col(c)) for c, b in bad.items()}), notes


def health(df: DataFrame, key: str) -> DataFrame:
    """(column_name, n_null, n_distinct) of every column and the key's repeats; never fails."""
    counts = df.agg(*(F.struct(F.count_if(F.col(c).isNull()).alias("n_null"), F.approx_count_distinct(c).alias("n_distinct")).alias(c) for c in df.columns if c != key), F.struct((F.count("*") - F.count_distinct(key)).alias("n_null"), F.count_distinct(key).alias("n_distinct")).alias(key))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.n_null"), F.col(f"{c}.n_distinct")) for c in df.columns))).alias("c")).select("c.*")


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of a column family."""
    import re

    return [c for c in df.columns if re.search(pattern, c)]


def drop_empty_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Without columns that have no value at all, in one aggregation."""
    rest = [c for c in df.columns if c not in keep]
    n = df.agg(*(F.count(c).alias(c) for c in rest)).first() if rest else {}
    return df.select(*(c for c in df.columns if c in keep or n[c]))


def utm_of(df: DataFrame) -> DataFrame:
    """df with zone, easting and northing."""
    zone = geo.utm_zone(F.col("lon"))
    x, y = geo.transverse_mercator(F.col("lat"), F.col("lon"), zone * 6 - 183)
    return df.withColumns({"zone": zone, "x": x, "y": F.when(F.col("lat") < 0, y + 10_000_000).otherwise(y)})

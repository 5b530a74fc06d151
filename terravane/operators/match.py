"""Joins in space and time, all as equi-joins on grid keys.

A polygon, a radius or a neighbourhood becomes a set of grid cells; the join is on the cell, and the exact
predicate is a residual. So no plan has a nested loop, and the grid's cells are the unit of partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import graph
from terravane.runtime import cut, discard

#: Cells along a polygon's longer side, at most about, before a coarser grid is used for it.
CELLS = 8


def covering(sites: DataFrame, footprints: DataFrame, key: str = "ordinal", x: str = "lon", y: str = "lat") -> DataFrame:
    """All pairs of a site and a footprint (key, rings, xmin, ymin, xmax, ymax) that strictly contains it.

    Different places are held against different shapes, each once, and written; the sites and footprints that have them
    are joined to what was found. Each shape is cut into cells of a grid whose cell grows with it (a power of two), and
    each place looks itself up in every grid in use, of which there are as many as doublings from a cell to the largest
    box. Only numbers and boxes are cut into cells and joined; what the box lets through meets the rings by number, once
    for each pair."""
    numbered = lambda df, name: cut(df.distinct().withColumn(name, F.monotonically_increasing_id()), name.strip("_"))
    box = ["xmin", "ymin", "xmax", "ymax"]
    shapes = numbered(footprints.select(*(F.col(c).cast("double").alias(f"_{c}") for c in box), F.col("rings").alias("_rings")), "_shape")
    spots = numbered(sites.select(F.col(x).alias("_x"), F.col(y).alias("_y")), "_spot")
    side = F.greatest(F.col("_xmax") - F.col("_xmin"), F.col("_ymax") - F.col("_ymin"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-9)) / CELLS))).cast("int")
    f = shapes.drop("_rings").withColumn("_level", level).withColumn("_size", F.pow(F.lit(2.0), F.col("_level")))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.col("_size")).cast("long"), F.floor(F.col(hi) / F.col("_size")).cast("long"))
    f = f.withColumn("_i", F.explode(span("_xmin", "_xmax"))).withColumn("_j", F.explode(span("_ymin", "_ymax"))).drop("_size")
    used = shapes.agg(F.collect_set(level)).scalar()  # found as the join runs, not while it is planned
    s = spots.withColumn("_levels", used).withColumn("_level", F.explode("_levels")).drop("_levels")
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    s = s.withColumn("_i", at("_x")).withColumn("_j", at("_y"))
    inside = (F.col("_x") >= F.col("_xmin")) & (F.col("_x") <= F.col("_xmax")) & (F.col("_y") >= F.col("_ymin")) & (F.col("_y") <= F.col("_ymax"))
    near = s.join(f, ["_level", "_i", "_j"]).filter(inside).select("_spot", "_x", "_y", "_shape")
    near = near.join(shapes.select("_shape", "_rings"), "_shape").filter(geo.contains(F.col("_rings"), F.col("_x"), F.col("_y"))).select("_spot", "_shape")
    found = cut(near, "covering")
    own = sites.join(spots, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y"))).select(*(sites[c] for c in sites.columns), "_spot")
    same = (F.col("rings") == F.col("_rings")) & reduce(lambda a, b: a & b, (F.col(c).cast("double") == F.col(f"_{c}") for c in box))
    made = footprints.join(shapes, same).select(*(footprints[c] for c in footprints.columns), "_shape")
    return own.join(found, "_spot").join(made, "_shape").drop("_spot", "_shape")


def nearest_in_time(pairs: DataFrame, by: list[str], year: Column, target: Column, keep: list[str], tie: Column) -> DataFrame:
    """For each key, the candidate with the least gap to the target year; tie is the next criterion. Null years never match."""
    gap = F.abs(year - target)
    picked = pairs.filter(year.isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*keep, gap.alias("gap"), (year - target).alias("year_diff")), F.struct(gap, tie)).alias("m"))
    return picked.select(*by, "m.*")


def nearest_covering(sites: DataFrame, footprints: DataFrame, key: str) -> DataFrame:
    """(key, name, collection_year, gap, year_diff): each site's covering footprint nearest in time, ties to the least ordinal;
    sites without one are left out.

    Of a place's footprints of one year only that with the least ordinal (unique) can be nearest, so these are found
    first, by place, and then compared once for each place and year."""
    dated = footprints.filter(F.col("collection_year").isNotNull())
    spots = sites.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    pairs = covering(spots, dated.drop("name"), "ordinal", "_lon", "_lat")
    least = pairs.groupBy("_lat", "_lon", "collection_year").agg(F.min("ordinal").alias("ordinal"))
    named = least.join(dated.select("ordinal", "name"), "ordinal")
    keys = sites.select("lat", "lon", "year").distinct()
    each = keys.join(named, (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")))
    best = nearest_in_time(each.drop("_lat", "_lon"), ["lat", "lon", "year"], F.col("collection_year"), F.col("year"), ["name", "collection_year"], F.col("ordinal"))
    best = best.withColumnsRenamed({"lat": "_lat", "lon": "_lon", "year": "_year"})
    same = (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")) & F.col("year").eqNullSafe(F.col("_year"))
    return sites.select(key, "lat", "lon", "year").join(best, same).select(key, "name", "collection_year", "gap", "year_diff")


def nearest_to_window(pairs: DataFrame, by: list[str], year: Column, low: int, high: int, keep: list[str]) -> DataFrame:
    """As above with the gap to a window of years, ties to the latest year and then by keep."""
    gap = F.greatest(F.lit(low) - year, F.lit(0)) + F.greatest(year - F.lit(high), F.lit(0))
    picked = pairs.filter(year.isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*keep, gap.alias("gap")), F.struct(gap, -year, *keep)).alias("m"))
    return picked.select(*by, "m.*")


def via_distinct(df: DataFrame, keys: list[str], fn) -> DataFrame:
    """Join df back to what fn makes of its distinct keys: costly lookups run once for each key."""
    found = fn(df.select(*keys).distinct())
    return df.join(found, keys, "left")


def matched_sites(sites: DataFrame, footprints: DataFrame) -> DataFrame:
    """Every site with its product nearest in time (or nulls), looked up once for each location and year.

    A footprint's ordinal, unique and below 2**40, breaks ties; footprints without a year never match."""

    dated = footprints.filter(F.col("collection_year").isNotNull())

    def lookup(keys: DataFrame) -> DataFrame:
        # gap and ordinal in one long: a hash aggregation with partial minima, where a struct would need sorts
        gap = F.abs(F.col("collection_year") - F.col("year"))
        code = F.shiftleft(gap.cast("long"), 40).bitwiseOR(F.col("ordinal").cast("long"))
        best = covering(keys, dated.drop("name"), "ordinal").groupBy("lat", "lon", "year").agg(F.min(code).alias("_code"))
        best = best.withColumn("ordinal", F.col("_code").bitwiseAND((1 << 40) - 1))
        named = best.join(dated.select(F.col("ordinal").cast("long"), "name", "collection_year"), "ordinal")
        return named.select("lat", "lon", "year", "name", "collection_year", gap.alias("gap"), (F.col("collection_year") - F.col("year")).alias("year_diff"))

    return via_distinct(sites, ["lat", "lon", "year"], lookup)


def gap_counts(matched: DataFrame, most: int = 5) -> DataFrame:
    """How many rows have a gap of at most 0, 1, ... years: one pass."""
    counts = matched.agg(*(F.count_if(F.col("gap") <= n).alias(f"n{n}") for n in range(most + 1)))
    return counts.select(F.expr(f"stack({most + 1}, " + ", ".join(f"{n}, n{n}" for n in range(most + 1)) + ") AS (max_gap, n_rows)"))


def gap_counts_by(matched: DataFrame, by: str, most: int = 5) -> DataFrame:
    """(by, max_gap, n_rows): as gap_counts for each value of a column, in one pass."""
    counts = matched.groupBy(by).agg(*(F.count_if(F.col("gap") <= n).alias(f"n{n}") for n in range(most + 1)))
    return counts.select(by, F.expr(f"stack({most + 1}, " + ", ".join(f"{n}, n{n}" for n in range(most + 1)) + ") AS (max_gap, n_rows)"))


def staged_samples(left: DataFrame, right: DataFrame, key: str, year: str, value: str, passes: int) -> DataFrame:
    """left with found_year, value and stage: right's nearest year of the key whose value is valid, of the first so many
    years by distance (the earlier of two); stage counts the years tried, and is null where none is valid."""
    keys = left.select(key, year).distinct()
    r = right.select(F.col(key).alias("_key"), F.col(year).alias("_year"), F.col(value).alias("_value"))
    near = keys.join(r, F.col(key) == F.col("_key"))
    w = Window.partitionBy(key, year).orderBy(F.abs(F.col("_year") - F.col(year)), "_year")  # one row for each year of a key
    tried = near.withColumn("stage", F.row_number().over(w)).filter(F.col("stage") <= passes).filter("_value IS NOT NULL")
    best = tried.groupBy(key, year).agg(F.min_by(F.struct(F.col("_year").alias("found_year"), F.col("_value").alias(value), "stage"), "stage").alias("m"))
    best = best.select(F.col(key).alias("_key"), F.col(year).alias("_at"), "m.*")
    return left.join(best, (F.col(key) == F.col("_key")) & (F.col(year) == F.col("_at")), "left").drop("_key", "_at")


def reindexed(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row of table for each row of keys, in nulls where it has none; of a key that repeats in table, its least row."""
    rest = [c for c in table.columns if c != key]
    own = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("_r"))
    return keys.select(key).join(own, key, "left").select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def with_fallback(left: DataFrame, right: DataFrame, key: str, year: str, keep: list[str], later: bool, tie: list[str]) -> DataFrame:
    """For each row of left, right's row of the same key nearest in year, else null; ties to the later or earlier year.

    Looked up once for each key and year, and joined back on these alone, so null columns beside them do not matter."""
    r = right.select(F.col(key).alias("_key"), F.col(year).alias("_year"), *(F.col(c).alias(f"_keep_{c}") for c in keep), *(F.col(c).alias(f"_tie_{c}") for c in tie))
    gap = F.abs(F.col("_year") - F.col(year))
    order = F.struct(gap, -F.col("_year") if later else F.col("_year"), *(f"_tie_{c}" for c in tie))
    found = F.struct(F.col("_year").alias("found_year"), *(F.col(f"_keep_{c}").alias(c) for c in keep))
    keys = left.select(key, year).distinct()
    best = keys.join(r.filter("_year IS NOT NULL"), F.col(key) == F.col("_key")).groupBy(key, year).agg(F.min_by(found, order).alias("m"))
    return left.join(best.select(F.col(key).alias("_key"), F.col(year).alias("_year"), "m.*"), (F.col(key) == F.col("_key")) & (F.col(year) == F.col("_year")), "left").drop("_key", "_year")


def _columns(row: Column, radius: float) -> Column:
    """How many columns the globe has at a row: whole ones, the narrowest that a row's neighbours may need or wider."""
    reach = (F.abs(row) + 3) * radius / geo.DEGREE_M
    width = radius / (geo.DEGREE_M * F.greatest(F.cos(F.radians(F.least(reach, F.lit(90.0)))), F.lit(1e-9)))
    return F.greatest(F.floor(360 / width), F.lit(1)).cast("long")


def within(left: DataFrame, right: DataFrame, radius: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs with an equirectangular distance of at most radius metres; right's columns must not clash but lat, lon.

    Columns of the grid wrap at 180 degrees. Rows without a coordinate pair with nothing."""
    place = lambda c: F.col(c) * geo.DEGREE_M / radius
    column = lambda c: F.floor(F.pmod(F.col(c) + 180, F.lit(360.0)) / 360 * _columns(F.col("_row"), radius)).cast("long")
    r = right.withColumnsRenamed({lat: "_lat", lon: "_lon"}).filter("_lat IS NOT NULL AND _lon IS NOT NULL")
    r = r.withColumn("_row", F.floor(place("_lat")).cast("long")).withColumn("_col", column("_lon"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    s = s.withColumn("_row", F.floor(place(lat)).cast("long")).withColumn("_row", F.explode(F.transform(near, lambda d: F.col("_row") + d)))
    around = F.array_distinct(F.transform(near, lambda d: F.pmod(column(lon) + d, _columns(F.col("_row"), radius))))
    s = s.withColumn("_col", F.explode(around))
    pairs = s.join(r, ["_row", "_col"]).withColumn("distance", geo.metres(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon")))
    return pairs.filter(F.col("distance") <= radius).drop("_row", "_col")


def outside(left: DataFrame, right: DataFrame, radius: float, key: str) -> DataFrame:
    """left's rows with no row of right within radius."""
    near = within(left.select(key, "lat", "lon"), right.select("lat", "lon"), radius).select(key).distinct()
    return left.join(near, key, "left_anti")


def pairs_within(df: DataFrame, radius: float, key: str, keep: list[str], digits: int | None = None) -> DataFrame:
    """Each pair of different rows within radius once: (a_*, b_*, distance), with a's key below b's.

    Different places are compared, and distances rounded, once; what rows a pair of places has is then joined to it."""
    there = df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    spots = cut(there.select("lat", "lon").distinct().withColumn("_at", F.monotonically_increasing_id()), "spots")
    near = within(spots.withColumnRenamed("_at", "_a"), spots.withColumnRenamed("_at", "_b"), radius).filter("_a <= _b")
    near = near.select("_a", "_b", F.col("distance") if digits is None else F.round("distance", digits).alias("distance"))
    rows = there.join(spots, ["lat", "lon"])
    named = lambda n: rows.select(F.col("_at").alias(f"_{n}"), F.col(key).alias(f"_k{n}"), *(F.col(c).alias(f"_{n}_{c}") for c in keep))
    both = near.join(named("a"), "_a").join(named("b"), "_b").filter(F.when(F.col("_a") == F.col("_b"), F.col("_ka") < F.col("_kb")).otherwise(F.col("_ka") != F.col("_kb")))
    first = F.col("_ka") < F.col("_kb")
    side = lambda n, m: [F.when(first, F.col(f"_k{n}")).otherwise(F.col(f"_k{m}")), *(F.when(first, F.col(f"_{n}_{c}")).otherwise(F.col(f"_{m}_{c}")) for c in keep)]
    names = [key, *keep]
    return both.select(*(v.alias(f"a_{c}") for v, c in zip(side("a", "b"), names, strict=True)), *(v.alias(f"b_{c}") for v, c in zip(side("b", "a"), names, strict=True)), "distance")


def components_within(df: DataFrame, radius: float, key: str, name: str = "near") -> DataFrame:
    """(id, comp): the connected components of all pairs of different keys within radius, rows without a pair left out.

    A place's rows are linked with each other, so its least key stands for them: components are sought among these
    (and keys that several places share), and the others join theirs at last."""
    there = df.filter("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon", key)
    spots = cut(there.groupBy("lat", "lon").agg(F.min(key).alias("_least")), f"{name}-spots")
    far = within(spots.withColumnRenamed("_least", "a"), spots.withColumnRenamed("_least", "b"), radius).filter("a < b").select("a", "b")
    own = there.join(spots, ["lat", "lon"]).filter(geo.metres(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon")) <= radius)  # not for NaN
    own = cut(own.filter(F.col(key) != F.col("_least")).select(F.col("_least").alias("a"), F.col(key).alias("b")).distinct(), f"{name}-own")
    shared = own.groupBy("b").agg(F.count("*").alias("n")).filter("n > 1").select("b").union(spots.select(F.col("_least").alias("b")))
    found = graph.components(far.union(own.join(shared, "b", "left_semi").select("a", "b")).distinct(), name)
    rooted = own.join(found.withColumnRenamed("id", "a"), "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    return found.union(rooted.select("a", "comp")).union(rooted.select("b", "comp")).distinct()


def nearest_k(left: DataFrame, right: DataFrame, k: int, key: str, to: str, start: float) -> DataFrame:
    """The k nearest rows of right (lat, lon, to) for each row of left: (key, to, distance, k_rank), ties by to.

    Both sides are searched by their different places: each place of left once, and of a place of right only the k
    least rows, as no others can be among the nearest. Neighbours are sought within a radius (start, or less where
    right is dense) that grows fourfold for the places that have too few yet; a place with k within the radius has its
    nearest. What a round settles is written, so no round is run again; rows without finite coordinates have no
    neighbour. Once the radius passes what separates left from right, all have theirs."""
    rows = left.filter(FINITE).select(key, "lat", "lon")
    near = _nearest_places(rows, right, k, to, start)
    if near is None:
        return rows.limit(0).join(right.limit(0).select(to)).select(key, to, F.lit(0.0).alias("distance"), F.lit(0).alias("k_rank"))
    ranks = F.row_number().over(_by([key], "distance", to))  # anew, as a key may have several rows
    return rows.join(near, ["lat", "lon"]).withColumn("k_rank", ranks).filter(F.col("k_rank") <= k).select(key, to, "distance", "k_rank")


#: Rows whose coordinates are finite; false for NaN as well.
FINITE = "abs(lat) < double('inf') AND abs(lon) < double('inf')"


def _nearest_places(rows: DataFrame, right: DataFrame, k: int, to: str, start: float) -> DataFrame | None:
    """(lat, lon, to, distance): the k nearest rows of right for each different place of rows; None if either has none.

    A round writes what it found and counts whom that settles; the next leaves those out as it runs."""
    right = right.filter(FINITE).select("lat", "lon", to).withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(to)))
    right = cut(right.filter(F.col("_n") <= k).drop("_n"), "nearest-of")
    rest = cut(rows.select("lat", "lon").distinct(), "nearest-places")
    box = [F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon"), F.count("*")]
    ends = [d.agg(*box).first() for d in (rest, right)]
    if not ends[0][4] or not ends[1][4]:
        discard(rest, right)
        return None
    tall = max(e[1] for e in ends) - min(e[0] for e in ends)
    farthest = 1.01 * geo.DEGREE_M * (tall**2 + 180.0**2) ** 0.5
    # a disc of that radius holds 4 k rows of right, were they spread evenly
    low, high, west, east, n = ends[1]
    even = geo.DEGREE_M * ((high - low) * (east - west) * 4 * k / (3.14 * n)) ** 0.5
    total, left, radius, parts = min(k, n), ends[0][4], min(start, max(even, start / 64)), []
    while True:
        order = F.row_number().over(_by(["lat", "lon"], "distance", to))
        ranked = within(rest, right, radius).withColumn("k_rank", order).filter(F.col("k_rank") <= k)
        ranked = cut(ranked.select("lat", "lon", to, "distance", "k_rank"), "nearest")
        if radius >= farthest:
            parts.append(ranked.drop("k_rank"))
            break
        enough = ranked.filter(F.col("k_rank") == total).select("lat", "lon")
        settled = enough.count()
        left -= settled
        parts.append(ranked.join(enough, ["lat", "lon"], "left_semi").drop("k_rank") if left else ranked.drop("k_rank"))
        if not left:
            break
        if settled:
            rest = rest.join(enough, ["lat", "lon"], "left_anti")
        radius *= 4
    return reduce(DataFrame.union, parts)


def _by(keys: list[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def inverse_distance(near: DataFrame, values: DataFrame, key: str, to: str, value: str) -> DataFrame:
    """Inverse-distance weighted mean of value over the neighbours of each key."""
    w = 1 / F.greatest(F.col("distance"), F.lit(1e-6))
    return near.join(values.select(to, value), to).groupBy(key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def weighted_nearest(left: DataFrame, right: DataFrame, k: int, key: str, to: str, value: str, start: float) -> DataFrame:
    """(key, value): inverse_distance over nearest_k; keys without a neighbour are left out.

    The mean is made once for each place and joined to the rows there; only keys with several rows are ranked anew."""
    rows = left.filter(FINITE).select(key, "lat", "lon")
    near = _nearest_places(rows, right, k, to, start)
    if near is None:
        return rows.select(key).limit(0).join(right.limit(0).select(value)).select(key, F.lit(0.0).alias(value))
    near = cut(near, "nearest-places-of")
    repeated = cut(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(F.col(key).alias("_key")), "repeated")
    means = inverse_distance(near.withColumn("_at", F.struct("lat", "lon")), right, "_at", to, value).select("_at.lat", "_at.lon", value)
    if repeated.isEmpty():
        return rows.join(means, ["lat", "lon"]).select(key, value)
    same = F.col(key).eqNullSafe(F.col("_key"))
    once = rows.join(repeated, same, "left_anti").join(means, ["lat", "lon"]).select(key, value)
    ranks = F.row_number().over(_by([key], "distance", to))
    again = rows.join(repeated, same, "left_semi").join(near, ["lat", "lon"]).withColumn("k_rank", ranks).filter(F.col("k_rank") <= k)
    return once.union(inverse_distance(again, right, key, to, value))

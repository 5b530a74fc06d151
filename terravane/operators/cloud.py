"""Point clouds as long tables: one row for each point, grouped by cloud."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.operators.splits import seeded_order

# fixed values: classification codes
NOISE = (7, 18)
GROUND = 2
#: Cells of the ground grid of one cloud, at most.
MOST_CELLS = 1 << 24


def clean(points: DataFrame) -> DataFrame:
    """Without noise classes."""
    return points.filter(~F.col("classification").isin(*NOISE))


def crop(points: DataFrame, radius: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    dx, dy = F.col("x") - x0, F.col("y") - y0
    return points.filter(dx * dx + dy * dy <= radius * radius)


def crop_or_keep(points: DataFrame, radius: float, by: str) -> DataFrame:
    """Each cloud's points within radius of the origin; a cloud with none stays as it is."""
    inside = F.col("x") * F.col("x") + F.col("y") * F.col("y") <= radius * radius
    some = points.filter(inside).select(by).distinct().withColumn("_some", F.lit(True))
    return points.join(some, by, "left").filter(inside | F.col("_some").isNull()).drop("_some")


def voxel(size: float, *axes: str) -> list[Column]:
    return [F.floor(F.col(a) / size).cast("long").alias(f"v{a}") for a in axes]


def voxel_sample(points: DataFrame, by: str, size: float, key: list[str], seed: int = 0) -> DataFrame:
    """One point of each voxel: the one that comes first in a seeded order."""
    p = points.withColumns({f"v{a}": F.floor(F.col(a) / size).cast("long") for a in ("x", "y", "z")})
    order = F.struct(seeded_order(F.concat_ws("/", *key), seed), *key)
    return p.groupBy(by, "vx", "vy", "vz").agg(F.min_by(F.struct(*points.columns), order).alias("p"), F.count("*").alias("n_voxel")).select("p.*", "vx", "vy", "vz", "n_voxel")


def voxel_pooled(points: DataFrame, by: str, size: float, features: list[str], masks: tuple[str, ...] = ()) -> DataFrame:
    """Mean position and greatest features of each voxel; a mask holds where it does for more than half of the points."""
    means = [F.avg(a).alias(a) for a in ("x", "y", "z")]
    half = [(F.avg(F.col(m).cast("double")) > 0.5).alias(m) for m in masks]
    return points.groupBy(by, *voxel(size, "x", "y", "z")).agg(*means, *(F.max(f).alias(f) for f in features), *half, F.count("*").alias("n"))


def thinned(points: DataFrame, by: str, most: int, key: list[str], seed: int = 0) -> DataFrame:
    """At most so many points of each cloud, in a seeded order."""
    w = Window.partitionBy(by).orderBy(seeded_order(F.concat_ws("/", *key), seed), *key)
    return points.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def stratified_thinned(points: DataFrame, height: float, share: float, key: list[str], seed: int = 0) -> DataFrame:
    """All points at or above height, and about that share of the others."""
    u = F.conv(F.substring(seeded_order(F.concat_ws("/", *key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return points.filter((F.col("hag") >= height) | (u < share))


def intensity_rank(points: DataFrame, by: str, key: list[str]) -> DataFrame:
    """points with rank01: place of the intensity within the cloud, from 0 to 1."""
    w = Window.partitionBy(by)
    n = F.count("*").over(w)
    return points.withColumn("rank01", F.coalesce(F.try_divide(F.row_number().over(w.orderBy("intensity", *key)) - 1, n - 1), F.lit(0.0)))


def return_code(number: Column, of: Column) -> Column:
    """0 only, 1 first, 2 between, 3 last."""
    return F.when(of <= 1, 0).when(number == 1, 1).when(number >= of, 3).otherwise(2)


def pseudo_ground(points: DataFrame, by: str, least: int, size: float, key: list[str]) -> DataFrame:
    """Ground points of each cloud; a cloud with fewer than least gets the lowest point of each column instead."""
    ground = points.filter(F.col("classification") == GROUND)
    enough = ground.groupBy(by).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(by)
    low = points.join(enough, by, "left_anti").groupBy(by, *voxel(size, "x", "y")).agg(F.min_by(F.struct(*points.columns), F.struct("z", *key)).alias("p")).select("p.*")
    return ground.join(enough, by, "left_semi").select(points.columns).unionByName(low.select(points.columns))


# fixed values: least density of each quality level, points for a square metre
QUALITY_DENSITY = {"QL 0": 8.0, "QL 1": 8.0, "QL 2": 2.0, "QL 3": 0.5}
UNKNOWN_DENSITY = 0.5


def coverage(points: DataFrame, levels: DataFrame, by: str, level: str, radius: float = 50.0, cell: float = 5.0, low: float = 0.5) -> DataFrame:
    """(by, level, n, expected, density_ratio, cell_cover, is_low) of each cloud of levels (by, level): points in the
    disc against what its quality level promises, and the share of the disc's cells that hold any.

    A cell counts if its centre lies in the disc; a cloud is low by its density alone; one without points has none."""
    side = int(-(-2 * radius // cell))
    centre = lambda k: (k + 0.5) * cell - radius
    cells_in = sum(centre(i) ** 2 + centre(j) ** 2 <= radius * radius for i in range(side) for j in range(side))
    place = lambda c: F.least(F.floor((F.col(c) + radius) / cell), F.lit(side - 1))
    p = crop(clean(points), radius).select(by, place("x").alias("i"), place("y").alias("j"))
    inside = centre(F.col("i")) ** 2 + centre(F.col("j")) ** 2 <= radius * radius
    cells = p.groupBy(by, "i", "j").agg(F.count("*").alias("c")).groupBy(by).agg(F.sum("c").alias("n"), F.count_if(inside).alias("full"))
    density = F.lit(UNKNOWN_DENSITY)
    for name, least in QUALITY_DENSITY.items():
        density = F.when(F.col(level) == name, least).otherwise(density)
    n, expected = F.coalesce("n", F.lit(0)), density * (3.141592653589793 * radius * radius)
    out = levels.select(by, level).join(cells, by, "left")
    return out.select(by, level, n.alias("n"), expected.alias("expected"), (n / expected).alias("density_ratio"), (F.coalesce("full", F.lit(0)) / F.lit(cells_in)).alias("cell_cover"), (n / expected < low).alias("is_low"))


def standard_metrics(points: DataFrame, by: str, above: float = 2.0, dz: float = 1.0) -> DataFrame:
    """The 56 height, intensity and return statistics of each cloud; z is a height above ground.

    Moments are population moments (standard deviations of samples), kurtosis not in excess; quantiles interpolate
    linearly; zpcum1 to 9 are the cumulated shares of the lower tenths of [0, zmax) among all ten; ipcumzq are
    shares of intensity up to a height quantile; area is that of the box. Two aggregations: what needs no other
    statistic, and what lies above or below those of the first."""
    z, i = F.col("z").cast("double"), F.col("intensity").cast("double")
    share = lambda c: 100 * F.avg(c.cast("double"))
    quantiles = [q / 100 for q in range(5, 100, 5)]
    tops = [10, 30, 50, 70, 90]
    first = points.groupBy(by).agg(
        F.count("*").alias("n"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"),
        F.max(z).alias("zmax"), F.avg(z).alias("zmean"), F.stddev_samp(z).alias("zsd"), F.skewness(z).alias("zskew"), (F.kurtosis(z) + 3).alias("zkurt"),
        share(z > F.lit(above)).alias(f"pzabove{above:g}"), F.percentile(z, F.array(*map(F.lit, quantiles))).alias("_q"),
        F.sum(i).alias("itot"), F.max(i).alias("imax"), F.avg(i).alias("imean"), F.stddev_samp(i).alias("isd"), F.skewness(i).alias("iskew"), (F.kurtosis(i) + 3).alias("ikurt"),
        (100 * F.try_divide(F.sum(F.when(F.col("classification") == GROUND, i).otherwise(0.0)), F.sum(i))).alias("ipground"),
        *(share(F.col("return_number") == k).alias(f"p{k}th") for k in range(1, 6)), share(F.col("classification") == GROUND).alias("pground"),
    )
    own = points.select(by, "z", "intensity").join(first.select(by, "zmean", "zmax", "itot", "_q"), by)
    tenth = F.when((F.col("zmax") > 0) & (z >= 0) & (z < F.col("zmax")), F.floor(10 * z / F.col("zmax")))
    below = lambda k: F.count_if(tenth < k)
    upto = lambda q: F.sum(F.when(z <= F.col("_q")[q // 5 - 1], i).otherwise(0.0))
    second = own.groupBy(by).agg(
        share(z > F.col("zmean")).alias("pzabovezmean"),
        *((100 * F.coalesce(F.try_divide(below(k), below(10)), F.lit(0.0))).alias(f"zpcum{k}") for k in range(1, 10)),
        *((100 * F.try_divide(upto(q), F.first("itot"))).alias(f"ipcumzq{q}") for q in tops),
    )
    every = first.join(second, by).join(height_entropy(points, by, dz), by)
    return every.select("*", *(F.col("_q")[k].alias(f"zq{round(q * 100)}") for k, q in enumerate(quantiles))).drop("_q")


def height_entropy(points: DataFrame, by: str, bin_size: float = 1.0) -> DataFrame:
    """(by, zentropy): entropy of the heights' bins over the log of how many bins reach the top."""
    bins = points.groupBy(by, F.floor(F.col("z") / bin_size).alias("b")).agg(F.count("*").alias("c"))
    sums = bins.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), (F.max("b") + 1).alias("k"))
    return sums.select(by, F.try_divide(F.log("n") - F.col("s") / F.col("n"), F.when(F.col("k") > 1, F.log("k"))).alias("zentropy"))


def rastered(points: DataFrame, by: str, cell: float) -> DataFrame:
    """(by, i, j, dsm, dtm, chm, density, intensity) of each cell: highest point, mean ground, their difference, points for unit area, mean first-return intensity."""
    ground, first = F.col("classification") == GROUND, F.col("return_number") == 1
    cells = clean(points).groupBy(by, F.floor(F.col("x") / cell).cast("long").alias("i"), F.floor(F.col("y") / cell).cast("long").alias("j"))
    out = cells.agg(F.max("z").alias("dsm"), F.avg(F.when(ground, F.col("z"))).alias("dtm"), (F.count("*") / (cell * cell)).alias("density"), F.avg(F.when(first, F.col("intensity"))).alias("intensity"))
    return out.withColumn("chm", F.col("dsm") - F.col("dtm"))


def mean_raster(points: DataFrame, by: list[str], cell: float, values: list[str]) -> DataFrame:
    """(by, i, j, n, a mean for each value) of each cell: one aggregation, whatever the points' order or chunks."""
    cells = points.groupBy(*by, F.floor(F.col("x") / cell).cast("long").alias("i"), F.floor(F.col("y") / cell).cast("long").alias("j"))
    return cells.agg(F.count("*").alias("n"), *(F.avg(v).alias(v) for v in values))


def held_to_percentiles(points: DataFrame, by: str, value: str, low: float, high: float) -> DataFrame:
    """points with value held between two of its quantiles in each cloud, scaled from 0 to 1; 0 where they are equal."""
    ends = points.groupBy(by).agg(F.percentile(value, F.lit(low)).alias("_lo"), F.percentile(value, F.lit(high)).alias("_hi"))
    scaled = F.try_divide(F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi")) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return points.join(ends, by).withColumn(value, F.coalesce(scaled, F.lit(0.0))).drop("_lo", "_hi")


def raveled(points: DataFrame, by: str, axes: list[str], out: str = "ravel") -> DataFrame:
    """points with one number for each cell of integer axes: its place in the box of its cloud's cells, last axis first."""
    ends = points.groupBy(by).agg(*(f(a).alias(f"_{n}{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))))
    number = F.lit(0).cast("long")
    for a in axes:
        number = number * (F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1) + F.col(a) - F.col(f"_lo{a}")
    return points.join(ends, by).withColumn(out, number).drop(*(f"_{n}{a}" for a in axes for n in ("lo", "hi")))


def random_views(points: DataFrame, by: str, widest: float, scales: list[tuple[float, float]], most: int, key: list[str], seed: int = 0) -> DataFrame:
    """Views of each cloud as views() draws them, with radius widest * sqrt(u), u drawn between each view's two scales."""
    from terravane.functions.text import md5_uniform

    picks = [F.min_by(F.struct("x", "y"), F.struct(seeded_order(F.concat_ws("/", *key), seed + i), *key)).alias(f"c{i}") for i in range(len(scales))]
    u = lambda i: md5_uniform(F.concat_ws("/", F.lit(f"{seed}:radius"), F.lit(str(i)), F.col(by).cast("string")))
    radius = [widest * F.sqrt(lo + (hi - lo) * u(i)) for i, (lo, hi) in enumerate(scales)]
    each = F.array(*(F.struct(F.col(f"c{i}.x").alias("x"), F.col(f"c{i}.y").alias("y"), r.alias("r")) for i, r in enumerate(radius)))
    centres = points.groupBy(by).agg(*picks).select(by, F.posexplode(each).alias("view", "c"))
    d2 = (F.col("x") - F.col("c.x")) ** 2 + (F.col("y") - F.col("c.y")) ** 2
    near = points.join(centres, by).withColumn("radius", F.col("c.r")).withColumn("_d", d2).filter(F.col("_d") <= F.col("radius") ** 2)
    w = Window.partitionBy(by, "view").orderBy("_d", *key)
    return near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", "_d", "c")


def filled(grid: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Cells without a value take the mean of known neighbours, ring by ring."""
    g = grid.copy()
    for _ in range(rounds):
        gap = np.isnan(g)
        if not gap.any() or gap.all():
            break
        p = np.pad(g, 1, constant_values=np.nan)
        near = np.stack([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
        n = (~np.isnan(near)).sum(0)
        g = np.where(gap & (n > 0), np.nansum(near, 0) / np.maximum(n, 1), g)
    return g


def blurred(grid: np.ndarray, sigma: float, reach: float = 4.0) -> np.ndarray:
    """A Gaussian blur with mirrored edges, by rows and columns."""
    n = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        p = np.pad(grid, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        grid = sum(w[k] * np.take(p, range(k, k + grid.shape[axis]), axis) for k in range(2 * n + 1))
    return grid


def smooth_rasters(cells: DataFrame, by: str, sigma: float = 1.5) -> DataFrame:
    """What rastered made, with the terrain filled from its neighbours and blurred, canopy heights at least 0, and
    intensities over the unit's median. A unit is one tile of bounded extent, so it fits a task."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        i, j = (p[c] - p[c].min() for c in "ij")
        g = np.full((int(i.max()) + 1, int(j.max()) + 1), np.nan)
        g[i, j] = p["dtm"]
        if np.isfinite(g).any():
            g = blurred(filled(g), sigma)
        dtm = g[i, j]
        middle = np.nanmedian(p["intensity"]) if p["intensity"].notna().any() else 0.0
        return p.assign(dtm=dtm, chm=np.clip(p["dsm"] - dtm, 0, None), intensity=p["intensity"] / middle if middle > 0 else p["intensity"])

    return cells.groupBy(by).applyInPandas(one, cells.schema)


def tiled(points: DataFrame, tile: float, pad: float) -> DataFrame:
    """points with each tile (ti, tj) that they lie in or within pad of, and whether they are its own."""
    near = lambda c: F.explode(F.sequence(F.floor((F.col(c) - pad) / tile).cast("long"), F.floor((F.col(c) + pad) / tile).cast("long")))
    out = points.withColumn("ti", near("x")).withColumn("tj", near("y"))
    return out.withColumn("own", (F.floor(F.col("x") / tile) == F.col("ti")) & (F.floor(F.col("y") / tile) == F.col("tj")))


def _bilinear(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between cell centres; x and y in cells."""
    u, v = np.clip(x - 0.5, 0, g.shape[0] - 1), np.clip(y - 0.5, 0, g.shape[1] - 1)
    i, j = np.minimum(u.astype(int), max(g.shape[0] - 2, 0)), np.minimum(v.astype(int), max(g.shape[1] - 2, 0))
    i2, j2 = np.minimum(i + 1, g.shape[0] - 1), np.minimum(j + 1, g.shape[1] - 1)
    a, b = u - i, v - j
    return (1 - a) * (1 - b) * g[i, j] + a * (1 - b) * g[i2, j] + (1 - a) * b * g[i, j2] + a * b * g[i2, j2]


def height_above_ground(points: DataFrame, by: str, cell: float = 1.0, least: int = 10, fallback: float | None = 2.0) -> DataFrame:
    """points with hag: height over the mean ground of each cell, gaps filled and values between centres interpolated.

    A cloud is one disc of bounded extent, so it fits a task; a cloud with fewer than least ground points uses the
    lowest point of each column of fallback cells, or has no heights where fallback is None. The grid holds the
    cells between the outermost ground points, whose number is bounded by MOST_CELLS; a cloud beyond is an error."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (p[c].to_numpy(float) for c in "xyz")
        ground = p["classification"].to_numpy() == GROUND
        if ground.sum() < least and fallback is None:
            return p.assign(hag=np.nan)
        if ground.sum() < least:
            key = np.floor(x / fallback).astype(int) * 1_000_003 + np.floor(y / fallback).astype(int)
            order = np.lexsort((z, key))
            ground = np.zeros(len(p), bool)
            ground[order[np.unique(key[order], return_index=True)[1]]] = True
        x0, y0 = np.floor(x.min() / cell) * cell, np.floor(y.min() / cell) * cell
        i, j = ((x - x0) / cell).astype(int), ((y - y0) / cell).astype(int)
        if (int(i.max()) + 1) * (int(j.max()) + 1) > MOST_CELLS:
            raise ValueError(f"a cloud spans {x.max() - x.min():.0f} by {y.max() - y.min():.0f}: no disc")
        total, n = np.zeros((i.max() + 1, j.max() + 1)), np.zeros((i.max() + 1, j.max() + 1))
        np.add.at(total, (i[ground], j[ground]), z[ground])
        np.add.at(n, (i[ground], j[ground]), 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            g = filled(np.where(n > 0, total / n, np.nan))
        return p.assign(hag=z - _bilinear(g, (x - x0) / cell, (y - y0) / cell))

    fields = [f for f in points.schema.fields if f.name != "hag"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", hag double"
    return points.drop("hag").groupBy(by).applyInPandas(one, schema).withColumn("hag", F.when(~F.isnan("hag"), F.col("hag")))


def terrain(points: DataFrame, by: str, cell: float = 2.0, least: int = 50) -> DataFrame:
    """(by, n_ground, elevation, elevation_range, slope, northness, eastness, tri, tpi) of each cloud's ground; nulls below least.

    The surface is the mean ground height of each cell; slopes follow Horn's weights over a cell's eight neighbours,
    northness and eastness are those of the downhill direction times the sine of the slope, tri is the mean
    difference from the neighbours and tpi that from their mean. Means are over cells with all eight. A triangulated
    surface is approximated by cells, without filling."""
    ground = points.filter(F.col("classification") == GROUND)
    n = ground.groupBy(by).agg(F.count("*").alias("n_ground"))
    grid = ground.groupBy(by, F.floor(F.col("x") / cell).cast("long").alias("i"), F.floor(F.col("y") / cell).cast("long").alias("j")).agg(F.avg("z").alias("z"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    sent = grid.withColumn("a", F.explode(step)).withColumn("b", F.explode(step))
    at = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("z"))).alias(f"z{a + 1}{b + 1}")
    # a cell sends its height to all cells around it: a is where it lies as seen from there
    cells = sent.groupBy(by, (F.col("i") - F.col("a")).alias("i"), (F.col("j") - F.col("b")).alias("j")).agg(F.count("*").alias("k"), *(at(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1))).filter("k = 9")
    gx = F.expr("(z22 + 2 * z21 + z20) - (z02 + 2 * z01 + z00)") / (8 * cell)
    gy = F.expr("(z22 + 2 * z12 + z02) - (z20 + 2 * z10 + z00)") / (8 * cell)
    steep = gx * gx + gy * gy
    around = [f"z{a}{b}" for a in range(3) for b in range(3) if (a, b) != (1, 1)]
    tri = sum((F.abs(F.col(c) - F.col("z11")) for c in around), F.lit(0.0)) / 8
    tpi = F.col("z11") - sum((F.col(c) for c in around), F.lit(0.0)) / 8
    per = cells.select(by, F.col("z11").alias("z"), F.degrees(F.atan(F.sqrt(steep))).alias("slope"), (-gy / F.sqrt(1 + steep)).alias("northness"), (-gx / F.sqrt(1 + steep)).alias("eastness"), tri.alias("tri"), tpi.alias("tpi"))
    means = per.groupBy(by).agg(F.avg("z").alias("elevation"), (F.max("z") - F.min("z")).alias("elevation_range"), *(F.avg(c).alias(c) for c in ("slope", "northness", "eastness", "tri", "tpi")))
    every = points.select(by).distinct().join(n, by, "left").join(means, by, "left").withColumn("n_ground", F.coalesce("n_ground", F.lit(0)))
    return every.select(by, "n_ground", *(F.when(F.col("n_ground") >= least, F.col(c)).alias(c) for c in means.columns[1:]))


def affine(points: DataFrame, by: str, seed: int, turn: bool = True, scale: tuple[float, float] = (0.9, 1.1), jitter: float = 0.0, flip: bool = False) -> DataFrame:
    """Each cloud turned, scaled, flipped and jittered by numbers that depend on its id and the seed."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(by)), F.lit(1 << 40)) / float(1 << 40)
    t = 2 * 3.141592653589793 * u(1) if turn else F.lit(0.0)
    s = scale[0] + (scale[1] - scale[0]) * u(2)
    sx = F.when(u(3) < 0.5, -1.0).otherwise(1.0) if flip else F.lit(1.0)
    noise = lambda k: jitter * (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(by), "x", "y", "z"), F.lit(1 << 40)) / float(1 << 40) - 0.5) * 2
    x, y = F.col("x") * sx, F.col("y")
    return points.withColumns({"x": s * (x * F.cos(t) - y * F.sin(t)) + noise(4), "y": s * (x * F.sin(t) + y * F.cos(t)) + noise(5), "z": s * F.col("z") + noise(6)})


def centred(points: DataFrame, by: str) -> DataFrame:
    """Shifted so that each cloud's box is centred in x and y and stands on z = 0."""
    box = points.groupBy(by).agg(((F.min("x") + F.max("x")) / 2).alias("_x"), ((F.min("y") + F.max("y")) / 2).alias("_y"), F.min("z").alias("_z"))
    return points.join(box, by).withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y"), "z": F.col("z") - F.col("_z")}).drop("_x", "_y", "_z")


def views(points: DataFrame, by: str, radii: list[float], most: int, key: list[str], seed: int = 0) -> DataFrame:
    """Views of each cloud: around a centre point drawn by seed, the nearest points within each radius, at most so many."""
    picks = [F.min_by(F.struct("x", "y"), F.struct(seeded_order(F.concat_ws("/", *key), seed + i), *key)).alias(f"c{i}") for i in range(len(radii))]
    centres = points.groupBy(by).agg(*picks).select(by, F.posexplode(F.array(*(F.struct(F.col(f"c{i}.x").alias("x"), F.col(f"c{i}.y").alias("y"), F.lit(float(r)).alias("r")) for i, r in enumerate(radii)))).alias("view", "c"))
    d2 = (F.col("x") - F.col("c.x")) ** 2 + (F.col("y") - F.col("c.y")) ** 2
    near = points.join(centres, by).withColumn("_d", d2).filter(F.col("_d") <= F.col("c.r") ** 2)
    w = Window.partitionBy(by, "view").orderBy("_d", *key)
    return near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n", "_d", "c")


def instances(points: DataFrame, by: str, instance: str) -> DataFrame:
    """Box, size and centroid of each instance, relabelled from 0 within its cloud."""
    boxes = points.filter(F.col(instance).isNotNull()).groupBy(by, instance).agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("min_", F.min), ("max_", F.max), ("mean_", F.avg))), F.count("*").alias("n"))
    return boxes.withColumn("instance_no", F.dense_rank().over(Window.partitionBy(by).orderBy(instance)) - 1)


def hilbert(points: DataFrame, bits: int, out: str = "hilbert") -> DataFrame:
    """points with the Hilbert index of integer columns vx, vy, vz below 2**bits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{out: hilbert_index(p[["vx", "vy", "vz"]].to_numpy(), bits)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + f", {out} long"
    return points.mapInPandas(run, schema)


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Skilling's transform: coordinates to their transposed index, whose bits are then interleaved."""
    x = [coords[:, i].astype(np.int64).copy() for i in range(coords.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) > 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0], x[i] = x[0] ^ t, x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b) & 1
    return out


def hilbert_coords(index: np.ndarray, bits: int, axes: int = 3) -> np.ndarray:
    """The coordinates of Hilbert indexes: the way back of hilbert_index."""
    x = [np.zeros(len(index), np.int64) for _ in range(axes)]
    for k in range(bits * axes):
        place = bits * axes - 1 - k
        x[k % axes] |= (index.astype(np.int64) >> place & 1) << (place // axes)
    t = x[-1] >> 1
    for i in range(axes - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q != 1 << bits:
        p = q - 1
        for i in range(axes - 1, -1, -1):
            high = (x[i] & q) > 0
            x[0], same = np.where(high, x[0] ^ p, x[0]), np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0], x[i] = x[0] ^ same, x[i] ^ same
        q <<= 1
    return np.stack(x, 1)


def unhilbert(points: DataFrame, bits: int, index: str = "hilbert") -> DataFrame:
    """points with the integer coordinates hx, hy, hz of a Hilbert index."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            xyz = hilbert_coords(p[index].to_numpy(), bits)
            yield p.assign(hx=xyz[:, 0], hy=xyz[:, 1], hz=xyz[:, 2])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", hx long, hy long, hz long"
    return points.mapInPandas(run, schema)


def jittered_intensity(points: DataFrame, by: str, seed: int, gamma: float = 0.2, gain: float = 0.2) -> DataFrame:
    """Intensities (0 to 65,535) of each cloud under a gamma and a gain that depend on its id and the seed."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(by)), F.lit(1 << 40)) / float(1 << 40) * 2 - 1
    v = F.pow(F.col("intensity") / 65535.0, 1 + gamma * u(1)) * (1 + gain * u(2))
    return points.withColumn("intensity", F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 65535).cast("long"))


def tilted_height(points: DataFrame, by: str, seed: int, most: float = 0.5, radius: float = 100.0) -> DataFrame:
    """Heights plus a smooth plane for each cloud, of at most so many metres at radius."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(by)), F.lit(1 << 40)) / float(1 << 40) * 2 - 1
    return points.withColumn("hag", F.col("hag") + most * (u(1) * F.col("x") + u(2) * F.col("y")) / (2 * radius))


def features(points: DataFrame, by: str, key: list[str]) -> DataFrame:
    """points with z over the cloud's ground and a feature array: height above ground (clipped to -5 to 100, over 30),
    intensity rank, return number over returns, whether first, whether last.

    The ground is the median of z - hag over all points; returns count at least 1, and a number is clipped to them."""
    ground = points.groupBy(by).agg(F.percentile(F.col("z") - F.col("hag"), F.lit(0.5)).alias("_g"))
    p = intensity_rank(points, by, key).join(ground, by)
    of = F.greatest(F.col("number_of_returns"), F.lit(1))
    number = F.least(F.greatest(F.col("return_number"), F.lit(1)), of)
    height = F.least(F.greatest(F.col("hag"), F.lit(-5.0)), F.lit(100.0)) / 30
    array = F.array(height, F.col("rank01"), number / of, (number == 1).cast("double"), (number == of).cast("double"))
    return p.withColumns({"z": F.col("z") - F.col("_g"), "features": array}).drop("_g", "rank01")


def pair_columns(points: DataFrame) -> DataFrame:
    """Points as the statistics want them: heights at least 0, plain numbers."""
    return points.withColumns({"hag": F.greatest(F.col("hag").cast("double"), F.lit(0.0)), "intensity": F.col("intensity").cast("double"), "return_number": F.col("return_number").cast("int"), "classification": F.col("classification").cast("int")})


def validity(points: DataFrame, by: str, most: float = 3000.0) -> DataFrame:
    """(by, status): ok, or what is wrong: non-finite coordinates, an implausible range of heights, non-finite heights above ground."""
    odd = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    sums = points.groupBy(by).agg(F.max(odd("x") | odd("y") | odd("z")).alias("a"), (F.max("z") - F.min("z") > most).alias("b"), F.max(odd("hag")).alias("c"))
    return sums.select(by, F.when(F.col("a"), "non-finite coordinates").when(F.col("b"), "implausible elevation range").when(F.col("c"), "non-finite height above ground").otherwise("ok").alias("status"))


def encoder_input(points: DataFrame, by: str, radius: float, size: float, most: int, key: list[str], seed: int = 0) -> DataFrame:
    """Points as an encoder takes them: cropped, without noise, at most so many, centred, one for each voxel of the box's corner."""
    p = centred(thinned(crop(clean(points), radius), by, most, key, seed), by)
    low = p.groupBy(by).agg(F.min("x").alias("_x"), F.min("y").alias("_y"))  # z begins at 0
    p = p.join(low, by).withColumns({"vx": F.floor((F.col("x") - F.col("_x")) / size).cast("long"), "vy": F.floor((F.col("y") - F.col("_y")) / size).cast("long"), "vz": F.floor(F.col("z") / size).cast("long")}).drop("_x", "_y")
    order = F.struct(seeded_order(F.concat_ws("/", *key), seed + 1), *key)
    return p.groupBy(by, "vx", "vy", "vz").agg(F.min_by(F.struct(*points.columns), order).alias("p")).select("p.*")


def voxel_rounds(points: DataFrame, by: str, size: float, key: list[str], seed: int = 0) -> DataFrame:
    """points with their voxel (vx, vy, vz), displacement from its centre and round: round k holds the point of rank k
    mod n of each voxel of n, in a seeded order, so the rounds together hold every point; inverse is the voxel's number in the cloud."""
    p = points.withColumns({f"v{a}": F.floor(F.col(a) / size).cast("long") for a in ("x", "y", "z")})
    w = Window.partitionBy(by, "vx", "vy", "vz")
    rank = F.row_number().over(w.orderBy(seeded_order(F.concat_ws("/", *key), seed), *key)) - 1
    p = p.withColumns({"round": rank, "n_voxel": F.count("*").over(w)}).withColumns({f"d{a}": F.col(a) - (F.col(f"v{a}") + 0.5) * size for a in ("x", "y", "z")})
    numbers = p.select(by, "vx", "vy", "vz").distinct().withColumn("inverse", F.row_number().over(Window.partitionBy(by).orderBy("vx", "vy", "vz")) - 1)
    return p.join(numbers, [by, "vx", "vy", "vz"])


def voxel_round(rounds: DataFrame, k: int) -> DataFrame:
    """One point of each voxel: the one whose turn it is in round k."""
    return rounds.filter(F.col("round") == k % F.col("n_voxel"))


def elastic(points: DataFrame, by: str, cell: float, size: float, seed: int) -> DataFrame:
    """Points moved by smoothed noise on a grid of cells, interpolated between its nodes; a cloud fits a task."""

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        xyz = p[["x", "y", "z"]].to_numpy(float)
        low = xyz.min(0)
        shape = (np.floor((xyz.max(0) - low) / cell).astype(int) + 4).tolist()
        rng = np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(str(key[0]).encode())]))
        noise = rng.normal(size=(*shape, 3))
        for axis in range(3):  # a box filter, twice along each axis
            for _ in range(2):
                noise = (np.roll(noise, 1, axis) + noise + np.roll(noise, -1, axis)) / 3
        at = (xyz - low) / cell + 1
        i = np.floor(at).astype(int)
        f = at - i
        moved = np.zeros_like(xyz)
        for a in (0, 1):
            for b in (0, 1):
                for c in (0, 1):
                    w = (f[:, 0] if a else 1 - f[:, 0]) * (f[:, 1] if b else 1 - f[:, 1]) * (f[:, 2] if c else 1 - f[:, 2])
                    moved += w[:, None] * noise[i[:, 0] + a, i[:, 1] + b, i[:, 2] + c]
        xyz = xyz + size * moved
        return p.assign(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])

    return points.groupBy(by).applyInPandas(one, points.schema)


def split_views(points: DataFrame, by: str, context: float, targets: list[float], key: list[str], seed: int = 0) -> DataFrame:
    """Views of each cloud with role 'context' (points of the wide view that no target covers) or 'target'."""
    every = views(points, by, [context, *targets], 1 << 30, key, seed)
    target = every.filter(F.col("view") > 0)
    covered = target.select(by, *key).distinct()
    left = every.filter(F.col("view") == 0).join(covered, [by, *key], "left_anti")
    return left.withColumn("role", F.lit("context")).unionByName(target.withColumn("role", F.lit("target")))

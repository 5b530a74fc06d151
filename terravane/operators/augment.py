"""Augmentations of point clouds: crops, drops, shuffles, rotations and colours.

Chances come from the MD5 of (seed, what is drawn, cloud or point), so a result depends on the seed and the rows
alone. Colours are columns r, g and b from 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.text import md5_uniform
from terravane.operators.splits import seeded_order

COLOURS = ("r", "g", "b")


def chance(seed: int, what: str, *columns: str) -> Column:
    """A number in [0, 1) for each value of the columns."""
    return md5_uniform(F.concat_ws("/", F.lit(f"{seed}:{what}"), *(F.col(c).cast("string") for c in columns)))


def _normal(seed: int, what: str, *columns: str) -> Column:
    u, v = chance(seed, f"{what}-1", *columns), chance(seed, f"{what}-2", *columns)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(6.283185307179586 * v)


def first_returns(points: DataFrame) -> DataFrame:
    return points.filter(F.col("return_number") == 1)


def returns_dropped(points: DataFrame, by: str, seed: int, p: float) -> DataFrame:
    """Of a share p of the clouds, first returns only."""
    return points.filter((chance(seed, "returns", by) >= p) | (F.col("return_number") == 1))


def clipped(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Coordinates held within a box."""
    return points.withColumns({a: F.least(F.greatest(F.col(a), F.lit(lo)), F.lit(hi)) for a, lo, hi in zip("xyz", low, high, strict=True)})


def dropped(points: DataFrame, by: str, key: list[str], seed: int, ratio: float, p: float) -> DataFrame:
    """Of a share p of the clouds, points without about that ratio."""
    return points.filter((chance(seed, "clouds", by) >= p) | (chance(seed, "points", *key) >= ratio))


def _centre(points: DataFrame, by: str) -> DataFrame:
    return points.groupBy(by).agg(((F.min("x") + F.max("x")) / 2).alias("_x"), ((F.min("y") + F.max("y")) / 2).alias("_y"))


def turned(points: DataFrame, by: str, seed: int, angles: list[float], p: float) -> DataFrame:
    """Of a share p of the clouds, each turned about its box's centre by one of the angles (in half turns), drawn by its id."""
    pick = F.floor(chance(seed, "angle", by) * len(angles)).cast("int")
    t = F.when(chance(seed, "turn", by) < p, F.get(F.array(*(F.lit(3.141592653589793 * a) for a in angles)), pick)).otherwise(0.0)
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    out = points.join(_centre(points, by), by).withColumn("_t", t)
    return out.withColumns({"x": F.col("_x") + dx * F.cos("_t") - dy * F.sin("_t"), "y": F.col("_y") + dx * F.sin("_t") + dy * F.cos("_t")}).drop("_x", "_y", "_t")


def jittered(points: DataFrame, key: list[str], seed: int, scale: float) -> DataFrame:
    """Coordinates moved by normal noise, held to its central 95 % and scaled to at most scale."""
    moved = {a: F.col(a) + scale * F.least(F.greatest(_normal(seed, a, *key) / 1.96, F.lit(-1.0)), F.lit(1.0)) for a in "xyz"}
    return points.withColumns(moved)


def shifted(points: DataFrame, by: str, seed: int, most: tuple[float, float, float]) -> DataFrame:
    """Each cloud moved by up to so much along each axis."""
    return points.withColumns({a: F.col(a) + m * (2 * chance(seed, f"shift-{a}", by) - 1) for a, m in zip("xyz", most, strict=True)})


def to_origin(points: DataFrame, by: str) -> DataFrame:
    """Each cloud with its least coordinates at 0."""
    low = points.groupBy(by).agg(*(F.min(a).alias(f"_{a}") for a in "xyz"))
    return points.join(low, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z")


def unit_sphere(points: DataFrame, by: str) -> DataFrame:
    """Each cloud centred on its mean and scaled into the unit sphere."""
    mean = points.groupBy(by).agg(*(F.avg(a).alias(f"_{a}") for a in "xyz"))
    moved = points.join(mean, by).withColumns({a: F.col(a) - F.col(f"_{a}") for a in "xyz"}).drop("_x", "_y", "_z")
    far = moved.groupBy(by).agg(F.max(F.sqrt(sum((F.col(a) * F.col(a) for a in "xyz"), F.lit(0.0)))).alias("_m"))
    return moved.join(far, by).withColumns({a: F.coalesce(F.try_divide(a, "_m"), F.lit(0.0)) for a in "xyz"}).drop("_m")


def _large(points: DataFrame, by: str, most: int, key: list[str], seed: int) -> DataFrame:
    """points with the centre (_cx, _cy, _cz) that is drawn for each cloud of more than so many, else null."""
    first = F.min_by(F.struct("x", "y", "z"), F.struct(seeded_order(F.concat_ws("/", *key), seed), *key))
    centre = points.groupBy(by).agg(F.count("*").alias("_n"), first.alias("_c")).filter(F.col("_n") > most)
    return points.join(centre.select(by, *(F.col(f"_c.{a}").alias(f"_c{a}") for a in "xyz")), by, "left")


def _apart() -> Column:
    return sum(((F.col(a) - F.col(f"_c{a}")) * (F.col(a) - F.col(f"_c{a}")) for a in "xyz"), F.lit(0.0))


def sphere_crop(points: DataFrame, by: str, most: int, key: list[str], seed: int = 0) -> DataFrame:
    """Of each cloud of more than so many points, those nearest to a drawn point; other clouds whole."""
    p = _large(points, by, most, key, seed)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(_apart(), *key))
    return p.withColumn("_k", F.when(F.col("_cx").isNotNull(), rank)).filter(F.col("_k").isNull() | (F.col("_k") <= most)).drop("_k", "_cx", "_cy", "_cz")


def radius_crop(points: DataFrame, by: str, most: int, radius: float, key: list[str], seed: int = 0) -> DataFrame:
    """Of each cloud of more than so many points, those less than radius from a drawn point; other clouds whole."""
    p = _large(points, by, most, key, seed)
    return p.filter(F.col("_cx").isNull() | (_apart() < radius * radius)).drop("_cx", "_cy", "_cz")


def shuffled(points: DataFrame, by: str, key: list[str], seed: int = 0) -> DataFrame:
    """points with place: a random order of each cloud, from 0."""
    w = Window.partitionBy(by).orderBy(seeded_order(F.concat_ws("/", *key), seed), *key)
    return points.withColumn("place", F.row_number().over(w) - 1)


def without_classes(points: DataFrame, classes: tuple[int, ...] = (0, 1), column: str = "segment") -> DataFrame:
    """Points whose class is none of these; points without one go too."""
    return points.filter(~F.col(column).isin(*classes))


def colour_normalised(points: DataFrame) -> DataFrame:
    """Colours from -1 to 1."""
    return points.withColumns({c: F.col(c) / 127.5 - 1 for c in COLOURS})


def colour_contrast(points: DataFrame, by: str, blend: float) -> DataFrame:
    """Colours mixed with what they are when each cloud's range is stretched to all of 0 to 255; a flat channel stays."""
    ends = points.groupBy(by).agg(*(f(c).alias(f"_{n}{c}") for c in COLOURS for n, f in (("lo", F.min), ("hi", F.max))))
    stretch = lambda c: F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * 255, F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.col(c).cast("double"))
    return points.join(ends, by).withColumns({c: (1 - blend) * F.col(c) + blend * stretch(c) for c in COLOURS}).drop(*(f"_{n}{c}" for c in COLOURS for n in ("lo", "hi")))


def _held(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))


def colour_shifted(points: DataFrame, by: str, seed: int, ratio: float) -> DataFrame:
    """Each cloud's channels moved by up to that ratio of 255."""
    return points.withColumns({c: _held(F.col(c) + (chance(seed, f"colour-{c}", by) - 0.5) * 510 * ratio) for c in COLOURS})


def colour_jittered(points: DataFrame, key: list[str], seed: int, sd: float) -> DataFrame:
    """Normal noise of sd times 255 on every point and channel."""
    return points.withColumns({c: _held(F.col(c) + _normal(seed, f"noise-{c}", *key) * sd * 255) for c in COLOURS})


def grey(points: DataFrame, by: str, seed: int, p: float) -> DataFrame:
    """Of a share p of the clouds, every channel the point's luminance."""
    y = 0.2989 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return points.withColumns({c: F.when(chance(seed, "grey", by) < p, y).otherwise(F.col(c).cast("double")) for c in COLOURS})


def colour_scaled(points: DataFrame, by: str, seed: int, brightness: float, contrast: float, saturation: float) -> DataFrame:
    """Each cloud's brightness, contrast (about its mean luminance) and saturation times 1 plus or minus up to so much."""
    factor = lambda what, most: 1 + most * (2 * chance(seed, what, by) - 1)
    y = 0.2989 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    lit = points.withColumns({c: _held(F.col(c) * factor("brightness", brightness)) for c in COLOURS})
    mean = lit.groupBy(by).agg(F.avg(y).alias("_y"))
    c1 = factor("contrast", contrast)
    lit = lit.join(mean, by).withColumns({c: _held(F.col("_y") + c1 * (F.col(c) - F.col("_y"))) for c in COLOURS}).drop("_y")
    s1 = factor("saturation", saturation)
    return lit.withColumns({c: _held(y + s1 * (F.col(c) - y)) for c in COLOURS})


def colour_turned(points: DataFrame, by: str, seed: int, hue: float, saturation: float) -> DataFrame:
    """Each cloud's hue moved by up to that part of the circle, its saturation scaled by 1 plus or minus up to so much."""
    r, g, b = (F.col(c) / 255.0 for c in COLOURS)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    part = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    p = points.withColumns({"_h": F.pmod(part + hue * (2 * chance(seed, "hue", by) - 1), F.lit(1.0)), "_s": F.least(F.coalesce(F.try_divide(span, top), F.lit(0.0)) * (1 + saturation * (2 * chance(seed, "saturation", by) - 1)), F.lit(1.0)), "_v": top})

    def channel(n: int) -> Column:
        k = F.pmod(n + F.col("_h") * 6, F.lit(6.0))
        return 255 * F.col("_v") * (1 - F.col("_s") * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))

    return p.withColumns({"r": channel(5), "g": channel(3), "b": channel(1)}).drop("_h", "_s", "_v")


def colour_dropped(points: DataFrame, by: str, seed: int, p: float) -> DataFrame:
    """Of a share p of the clouds, no colour."""
    return points.withColumns({c: F.when(chance(seed, "no-colour", by) < p, 0.0).otherwise(F.col(c).cast("double")) for c in COLOURS})


def composed(points: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after the other, as one plan."""
    return reduce(lambda df, step: df.transform(step), steps, points)


def collected(points: DataFrame, keep: list[str], features: list[str]) -> DataFrame:
    """The columns that an encoder wants, and its features as one array, with the offset of each point's cloud left to batching."""
    return points.select(*keep, F.array(*(F.col(f).cast("double") for f in features)).alias("feat"))

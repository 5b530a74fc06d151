"""Rasters as long tables (unit, i, j, value), and shift searches between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.text import correlation
from terravane.runtime import cut


def ndvi(nir: Column, red: Column) -> Column:
    return (nir - red) / F.greatest(nir + red, F.lit(1e-3))


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return (red + green + blue) / 3


def gradient(grid: DataFrame, by: str, value: str) -> DataFrame:
    """(by, i, j, gradient): magnitude of central differences, where both neighbours of both axes are known; blur first."""
    shifted = lambda di, dj, n: grid.select(by, (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col(value).alias(n))
    out = grid.select(by, "i", "j")
    for di, dj, n in ((1, 0, "a"), (-1, 0, "b"), (0, 1, "c"), (0, -1, "d")):
        out = out.join(shifted(di, dj, n), [by, "i", "j"])
    return out.select(by, "i", "j", (F.sqrt((F.col("a") - F.col("b")) ** 2 + (F.col("c") - F.col("d")) ** 2) / 2).alias("gradient"))


def blur(grid: DataFrame, by: str, value: str, sigma: float, reach: int) -> DataFrame:
    """(by, i, j, value): Gaussian means over the known cells within reach: each cell sends its weight to those around it.

    The mean of equal values is that value, without the sums' rounding, so that a flat unit stays flat."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    sent = grid.filter(F.col(value).isNotNull()).select(by, "i", "j", F.col(value).cast("double").alias("v")).withColumn("a", F.explode(step)).withColumn("b", F.explode(step))
    w = F.exp(-(F.col("a") * F.col("a") + F.col("b") * F.col("b")) / (2 * sigma * sigma))
    means = sent.groupBy(by, (F.col("i") + F.col("a")).alias("i"), (F.col("j") + F.col("b")).alias("j")).agg(F.when(F.min("v") == F.max("v"), F.min("v")).otherwise(F.sum(w * F.col("v")) / F.sum(w)).alias(value))
    return grid.select(by, "i", "j").join(means, [by, "i", "j"], "left")


def standardised(grid: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Each unit's layers with mean 0 and deviation 1; a missing or constant value is 0."""
    stats = grid.groupBy(by).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = {v: F.coalesce(F.try_divide(F.col(v) - F.col(f"m_{v}"), F.nullif(F.col(f"s_{v}"), F.lit(0.0))), F.lit(0.0)) for v in values}
    return grid.join(stats, by).withColumns(z).drop(*(f"{n}_{v}" for v in values for n in "ms"))


def feature_stack(rasters: DataFrame, by: str, sigma: float = 0.7, reach: int = 3) -> DataFrame:
    """(by, i, j and layers): canopy height, its square over 30, log and ground flag, intensity, both slopes of the
    blurred surface (at most 3), each standardised within its unit."""
    soft = blur(rasters, by, "dsm", sigma, reach)
    side = lambda di, dj, n: soft.select(by, (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("dsm").alias(n))
    out = rasters.select(by, "i", "j", "chm", "intensity")
    for di, dj, n in ((1, 0, "w"), (-1, 0, "e"), (0, 1, "s"), (0, -1, "n")):
        out = out.join(side(di, dj, n), [by, "i", "j"], "left")
    c = F.least(F.greatest(F.col("chm"), F.lit(0.0)), F.lit(60.0))
    held = lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(-3.0)), F.lit(3.0)))
    layers = {"height": c, "height_2": c * c / 30, "height_log": F.log1p(c), "open": (c < 0.5).cast("double"), "reflect": F.least(F.greatest(F.col("intensity"), F.lit(0.0)), F.lit(4.0)), "slope_i": held((F.col("e") - F.col("w")) / 2), "slope_j": held((F.col("n") - F.col("s")) / 2)}
    return standardised(out.select(by, "i", "j", *(v.alias(k) for k, v in layers.items())), by, list(layers))


def edge_stack(rasters: DataFrame, by: str, layers: list[str], sigma: float = 1.0, reach: int = 4) -> DataFrame:
    """(by, i, j and layers): gradient magnitudes of blurred layers, held to their 99.5th percentile within the unit, standardised."""
    out = None
    for layer in layers:
        g = gradient(blur(rasters, by, layer, sigma, reach), by, layer).withColumnRenamed("gradient", layer)
        top = g.groupBy(by).agg(F.percentile(layer, F.lit(0.995)).alias("_top"))
        g = g.join(top, by).withColumn(layer, F.least(layer, "_top")).drop("_top")
        out = g if out is None else out.join(g, [by, "i", "j"], "full")
    return standardised(out, by, layers)


def mutual_information(left: DataFrame, right: DataFrame, by: str, reach: int, bins: int = 16) -> DataFrame:
    """(by, di, dj, mi, n): mutual information of values in bins of equal width between each side's extremes, for all small shifts."""

    def binned(d: DataFrame, name: str) -> DataFrame:
        ends = d.groupBy(by).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0))
        return d.join(ends, by).select(by, "i", "j", F.least(place, F.lit(bins - 1)).cast("int").alias(name))

    step = F.sequence(F.lit(-reach), F.lit(reach))
    moved = binned(left, "a").withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    moved = moved.select(by, "di", "dj", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "a")
    joint = moved.join(binned(right, "b"), [by, "i", "j"]).groupBy(by, "di", "dj", "a", "b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(by, "di", "dj")  # at most bins squared rows for a shift
    joint = joint.withColumns({"n": F.sum("c").over(w), "ca": F.sum("c").over(w.partitionBy(by, "di", "dj", "a")), "cb": F.sum("c").over(w.partitionBy(by, "di", "dj", "b"))})
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))
    return joint.groupBy(by, "di", "dj").agg(F.sum(term).alias("mi"), F.max("n").alias("n"))


def regression_surface(stack: DataFrame, target: DataFrame, by: str, layers: list[str], reach: int, l2: float = 1e-3) -> DataFrame:
    """(by, di, dj, r2, n): how much of target (value) at (i + di, j + dj) a linear model of the layers at (i, j) explains, for all small shifts.

    Sums of products come from one aggregation; each shift's small system is solved in a task."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    moved = stack.select(by, "i", "j", *layers).withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    moved = moved.select(by, "di", "dj", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(layers)))
    both = moved.join(target.select(by, "i", "j", F.col("value").cast("double").alias("_y")), [by, "i", "j"])
    terms = [F.lit(1.0), *(F.col(f"_x{k}") for k in range(len(layers))), F.col("_y")]
    m = len(terms)
    sums = both.groupBy(by, "di", "dj").agg(*(F.sum(terms[a] * terms[b]).alias(f"g{a}_{b}") for a in range(m) for b in range(a, m)))

    def solve(parts):
        for p in parts:
            out = []
            for r in p.to_dict("records"):
                g = np.array([[r[f"g{min(a, b)}_{max(a, b)}"] for b in range(m)] for a in range(m)])
                n = g[0, 0]
                w = np.linalg.solve(g[:-1, :-1] + np.diag([0.0] + [l2 * n] * (m - 2)), g[:-1, -1])
                spread = g[-1, -1] - g[0, -1] ** 2 / n
                left = g[-1, -1] - 2 * w @ g[:-1, -1] + w @ g[:-1, :-1] @ w
                out.append((r[by], r["di"], r["dj"], 1 - left / spread if spread > 1e-12 else None, int(n)))
            yield pd.DataFrame(out, columns=[by, "di", "dj", "r2", "n"])

    kind = stack.schema[by].dataType.simpleString()
    return sums.mapInPandas(solve, f"{by} {kind}, di int, dj int, r2 double, n long")


def fitted_field(shifts: DataFrame, by: str) -> DataFrame:
    """(by, a to f): the displacement dx = a + b x + c y, dy = d + e x + f y of least weighted squares over matched places
    (x, y, dx, dy, w); a constant one where places lie on a line. One aggregation, then a closed form."""
    s = lambda e: F.sum(F.expr(e))
    mean = shifts.groupBy(by).agg(s("w").alias("sw"), *((s(f"w * {c}") / s("w")).alias(f"m{c}") for c in ("x", "y", "dx", "dy")))
    near = shifts.join(mean, by).selectExpr(by, "w AS _w", "x - mx AS _x", "y - my AS _y", "dx - mdx AS _u", "dy - mdy AS _v")
    sums = near.groupBy(by).agg(*(s(f"_w * _{a} * _{b}").alias(f"{a}{b}") for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")))
    d = F.expr("xx * yy - xy * xy")
    flat = d <= F.expr("1e-12 * (xx * yy + 1e-30)")
    part = lambda e: F.when(flat, 0.0).otherwise(F.try_divide(F.expr(e), d))
    both = sums.join(mean, by).withColumns({"b": part("xu * yy - yu * xy"), "c": part("yu * xx - xu * xy"), "e": part("xv * yy - yv * xy"), "f": part("yv * xx - xv * xy")})
    return both.selectExpr(by, "mdx - b * mx - c * my AS a", "b", "c", "mdy - e * mx - f * my AS d", "e", "f")


def resampled(grid: DataFrame, models: DataFrame, by: str, value: str, cell: float) -> DataFrame:
    """(by, i, j, value): each cell's value at the place where its displacement leads, by the nearest cell; null outside."""
    from terravane.operators.extra import displaced

    x, y = (F.col("i") + 0.5) * cell, (F.col("j") + 0.5) * cell
    to_x, to_y = displaced(x, y, F.col("_m"))
    moved = grid.select(by, "i", "j").join(models.select(by, F.struct("a", "b", "c", "d", "e", "f").alias("_m")), by, "left")
    moved = moved.select(by, "i", "j", F.floor(to_x / cell).cast("long").alias("si"), F.floor(to_y / cell).cast("long").alias("sj"))
    return moved.join(grid.select(by, F.col("i").alias("si"), F.col("j").alias("sj"), value), [by, "si", "sj"], "left").select(by, "i", "j", value)


def compared_methods(left: DataFrame, right: DataFrame, by: str, methods: dict, truth: tuple[int, int]) -> DataFrame:
    """(method, n, exact, rms): how often and how far each method's shift (by, di, dj) misses a known one."""
    out = None
    for name, method in methods.items():
        found = method(left, right).select("di", "dj")
        miss = F.pow(F.col("di") - truth[0], F.lit(2)) + F.pow(F.col("dj") - truth[1], F.lit(2))
        one = found.agg(F.count("*").alias("n"), F.count_if(miss == 0).alias("exact"), F.sqrt(F.avg(miss)).alias("rms")).select(F.lit(name).alias("method"), "n", "exact", "rms")
        out = one if out is None else out.unionByName(one)
    return out


def pooled_peak(surfaces: DataFrame, by: str, block: str, draws: int = 200, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(by, di, dj, r: surfaces averaged over blocks and their best shift; by, sd_i, sd_j: its spread when blocks are drawn anew).

    A draw weights each block by a Poisson(1) number from its hash, so no list of blocks is gathered."""
    known = surfaces.filter(F.col("r").isNotNull())
    best = lambda d, keys: d.groupBy(*keys).agg(F.max_by(F.struct("di", "dj", "r"), F.struct(F.round("r", 12), -F.abs("di"), -F.abs("dj"), "di", "dj")).alias("m")).select(*keys, "m.*")
    mean = known.groupBy(by, "di", "dj").agg(F.avg("r").alias("r"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(block).cast("string"), F.col("draw")), F.lit(1 << 40)) / float(1 << 40)
    weight, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += p
        weight = weight + (u >= total).cast("int")
        p /= k
    drawn = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight).filter("w > 0")
    means = drawn.groupBy(by, "draw", "di", "dj").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"))
    sd = best(means, [by, "draw"]).groupBy(by).agg(F.stddev_samp("di").alias("sd_i"), F.stddev_samp("dj").alias("sd_j"))
    return best(mean, [by]), sd


def shift_surface(left: DataFrame, right: DataFrame, by: str, reach: int) -> DataFrame:
    """(by, di, dj, r, n): correlation of left (i, j) with right (i + di, j + dj) over cells that both have, for all small shifts."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    moved = left.select(by, "i", "j", F.col("value").alias("a")).withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    moved = moved.select(by, "di", "dj", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"), "a")
    both = moved.join(right.select(by, "i", "j", F.col("value").alias("b")), [by, "i", "j"])
    return both.groupBy(by, "di", "dj").agg(correlation(F.col("a"), F.col("b")).alias("r"), F.count("*").alias("n"))


def best_shift(surface: DataFrame, by: str) -> DataFrame:
    """(by, di, dj, r, sub_i, sub_j): the best whole shift, refined by a parabola through its neighbours."""
    top = surface.filter(F.col("r").isNotNull()).groupBy(by).agg(F.max_by(F.struct("di", "dj", "r"), F.struct("r", -F.abs("di"), -F.abs("dj"), "di", "dj")).alias("m")).select(by, "m.*")
    around = lambda a, b, n: surface.select(by, (F.col("di") - a).alias("di"), (F.col("dj") - b).alias("dj"), F.col("r").alias(n))
    for a, b, n in ((1, 0, "up"), (-1, 0, "down"), (0, 1, "right"), (0, -1, "left")):
        top = top.join(around(a, b, n), [by, "di", "dj"], "left")
    sub = lambda hi, lo: F.coalesce(F.try_divide(F.col(hi) - F.col(lo), 2 * (2 * F.col("r") - F.col(hi) - F.col(lo))), F.lit(0.0))
    return top.select(by, "di", "dj", "r", (F.col("di") + sub("up", "down")).alias("sub_i"), (F.col("dj") + sub("right", "left")).alias("sub_j"))


def fft_shift(left: DataFrame, right: DataFrame, by: str, reach: int) -> DataFrame:
    """(by, di, dj, r) by masked normalised cross-correlation over all shifts at once; a unit is one raster tile and fits a task."""

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[by, "di", "dj", "r"])
        i0, j0 = min(a.i.min(), b.i.min()), min(a.j.min(), b.j.min())
        shape = (int(max(a.i.max(), b.i.max()) - i0) + 1 + reach, int(max(a.j.max(), b.j.max()) - j0) + 1 + reach)
        grids = []
        for d in (a, b):
            v, m = np.zeros(shape), np.zeros(shape)
            m[d.i - i0, d.j - j0] = 1
            v[d.i - i0, d.j - j0] = d["value"] - d["value"].mean()
            grids += [np.fft.rfft2(x) for x in (v, m, v * v)]
        va, ma, qa, vb, mb, qb = grids
        back = lambda x, y: np.fft.irfft2(np.conj(x) * y, shape)
        n = np.maximum(np.round(back(ma, mb)), 1)
        sa, sb, ab, aa, bb = back(va, mb), back(ma, vb), back(va, vb), back(qa, mb), back(ma, qb)
        spread = np.clip(aa - sa * sa / n, 1e-12, None) * np.clip(bb - sb * sb / n, 1e-12, None)
        r = (ab - sa * sb / n) / np.sqrt(spread)
        rows = [(di, dj, float(r[di % shape[0], dj % shape[1]])) for di in range(-reach, reach + 1) for dj in range(-reach, reach + 1)]
        di, dj, best = max(rows, key=lambda t: (round(t[2], 12), -abs(t[0]), -abs(t[1]), t[0], t[1]))
        return pd.DataFrame({by: [key[0]], "di": [di], "dj": [dj], "r": [best]})

    kind = left.schema[by].dataType.simpleString()
    left, right = (d.select(by, "i", "j", "value").toDF(by, "i", "j", "value") for d in (left, right))  # sides of one lineage stay apart
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(one, f"{by} {kind}, di long, dj long, r double")


def window_means(grid: DataFrame, by: str, size: int, value: Column, weight: Column) -> DataFrame:
    """(by, wi, wj, mean, weight): weighted means over square windows."""
    w = grid.groupBy(by, F.floor(F.col("i") / size).cast("long").alias("wi"), F.floor(F.col("j") / size).cast("long").alias("wj"))
    return w.agg(F.try_divide(F.sum(weight * value), F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"))


def closure(shifts: DataFrame, unit: str) -> DataFrame:
    """(n, rms): of three surveys' pairwise shifts of a unit, a to b plus b to c against a to c."""
    ab = shifts.select(unit, F.col("a"), F.col("b"), F.col("dx").alias("x1"), F.col("dy").alias("y1"))
    bc = shifts.select(unit, F.col("a").alias("b"), F.col("b").alias("c"), F.col("dx").alias("x2"), F.col("dy").alias("y2"))
    ac = shifts.select(unit, F.col("a"), F.col("b").alias("c"), F.col("dx").alias("x3"), F.col("dy").alias("y3"))
    loops = ab.join(bc, [unit, "b"]).join(ac, [unit, "a", "c"])
    miss = (F.col("x1") + F.col("x2") - F.col("x3")) ** 2 + (F.col("y1") + F.col("y2") - F.col("y3")) ** 2
    return loops.agg(F.count("*").alias("n"), F.sqrt(F.avg(miss)).alias("rms"))


def planned_units(points: DataFrame, cell: float, k: int, products: DataFrame, newest: int) -> DataFrame:
    """(i, j, name, rank): cells within k of any point, with the newest products of the cell."""
    own = points.select(F.floor(F.col("x") / cell).cast("long").alias("i"), F.floor(F.col("y") / cell).cast("long").alias("j")).distinct()
    step = F.sequence(F.lit(-k), F.lit(k))
    ring = own.withColumn("di", F.explode(step)).withColumn("dj", F.explode(step)).select((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).distinct()
    w = Window.partitionBy("i", "j").orderBy(F.desc("year"), "name")
    return ring.join(products, ["i", "j"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= newest).select("i", "j", "name", "rank")


def first_mosaic(layers: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The first known value of each cell in layer order."""
    return layers.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(value, order).alias(value))


def shadow_depth(dsm: DataFrame, by: str, sun_azimuth: float, sun_elevation: float, cell: float, reach: int) -> DataFrame:
    """(by, i, j, depth): how far each cell lies below the ray from the sun over the cells towards it, at least 0.

    Rays step one cell at a time, so a cell meets reach others: an equi-join on shifted cells, then a maximum."""
    step_i, step_j = float(np.sin(np.radians(sun_azimuth))), float(np.cos(np.radians(sun_azimuth)))
    drop = float(np.tan(np.radians(sun_elevation))) * cell
    k = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    rays = dsm.select(by, "i", "j", F.col("value").alias("own"), k.alias("k"))
    rays = rays.withColumns({"ti": F.round(F.col("i") + F.col("k") * step_i).cast("long"), "tj": F.round(F.col("j") + F.col("k") * step_j).cast("long")})
    other = dsm.select(by, F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("value").alias("high"))
    over = rays.join(other, [by, "ti", "tj"]).groupBy(by, "i", "j").agg(F.max(F.col("high") - F.col("k") * drop - F.col("own")).alias("depth"))
    return dsm.select(by, "i", "j").join(over, [by, "i", "j"], "left").select(by, "i", "j", F.greatest(F.coalesce("depth", F.lit(0.0)), F.lit(0.0)).alias("depth"))


def landmarks(grid: DataFrame, by: str, value: str, above: float, least: int) -> DataFrame:
    """(by, landmark, n, ci, cj, height): connected cells (four neighbours) of at least so many that rise above a level.

    Cells are vertices of a graph; components come from label rounds. A landmark is named by its least cell."""
    from terravane.operators.graph import components

    high = grid.filter(F.col(value) > above).select(by, "i", "j", F.col(value).alias("v"))
    # numbered as they are written: any unit and any cell, without an order over all
    high = cut(high.withColumn("id", F.monotonically_increasing_id()), "landmark-cells")
    edges = None
    for di, dj in ((1, 0), (0, 1)):
        shifted = high.select(by, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("id").alias("b"))
        one = high.select(by, "i", "j", F.col("id").alias("a")).join(shifted, [by, "i", "j"]).select("a", "b")
        edges = one if edges is None else edges.union(one)
    labelled = high.join(components(edges, "landmarks"), "id", "left").withColumn("landmark", F.coalesce("comp", "id"))
    sums = labelled.groupBy(by, "landmark").agg(F.min(F.struct("i", "j")).alias("first"), F.count("*").alias("n"), F.avg("i").alias("ci"), F.avg("j").alias("cj"), F.max("v").alias("height"))
    return sums.filter(F.col("n") >= least).select(by, F.concat_ws("_", "first.i", "first.j").alias("landmark"), "n", "ci", "cj", "height")


def landmark_shift(left: DataFrame, right: DataFrame, by: str, reach: float) -> DataFrame:
    """(by, n, di, dj): the median displacement of landmarks (by, landmark, ci, cj) of two surfaces that are each other's
    nearest within reach."""
    from terravane.operators.extra import nearest_in_cell

    flat = lambda d, k: d.select(by, F.col("landmark").alias(k), F.col("ci").alias("x"), F.col("cj").alias("y"), F.lit(0.0).alias("z"))
    a, b = flat(left, "a"), flat(right, "b")
    there, back = nearest_in_cell(a, b, by, "a", "b", reach).select(by, "a", "b"), nearest_in_cell(b, a, by, "b", "a", reach).select(by, "a", "b")
    mutual = there.join(back, [by, "a", "b"])
    both = mutual.join(a.select(by, "a", F.col("x").alias("x1"), F.col("y").alias("y1")), [by, "a"]).join(b.select(by, "b", F.col("x").alias("x2"), F.col("y").alias("y2")), [by, "b"])
    return both.groupBy(by).agg(F.count("*").alias("n"), F.percentile(F.col("x2") - F.col("x1"), F.lit(0.5)).alias("di"), F.percentile(F.col("y2") - F.col("y1"), F.lit(0.5)).alias("dj"))


def height_surfaces(left: DataFrame, right: DataFrame, heights: DataFrame, by: str, edges: list[float], reach: int) -> DataFrame:
    """(by, level, di, dj, r, n): a shift surface for each class of height (i, j, value): edges[k] <= height < edges[k + 1]."""
    level = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        level = F.when((F.col("_h") >= lo) & (F.col("_h") < hi), k).otherwise(level)
    classed = left.join(heights.select(by, "i", "j", F.col("value").alias("_h")), [by, "i", "j"]).withColumn("level", level).filter("level IS NOT NULL")
    key = F.concat_ws("/", F.col(by).cast("string"), F.col("level").cast("string"))
    levels = classed.select(by, "level").distinct().withColumn("_k", key)
    own = classed.select(key.alias("_k"), "i", "j", "value")
    # right is copied for each class of its unit: as many as there are edges
    other = right.join(levels, by).select("_k", "i", "j", "value")
    return shift_surface(own, other, "_k", reach).join(levels, "_k").select(by, "level", "di", "dj", "r", "n")


def fitted_lean(shifts: DataFrame, by: str) -> DataFrame:
    """(by, dx, dy, tx, ty): displacement as a shift of the ground and a lean with height, dx + tx h and dy + ty h, of least
    weighted squares over (h, dx, dy, w); no lean where all heights are one."""
    s = lambda e: F.sum(F.expr(e))
    m = shifts.groupBy(by).agg(s("w").alias("sw"), s("w * h").alias("sh"), s("w * h * h").alias("shh"), s("w * dx").alias("sx"), s("w * dy").alias("sy"), s("w * h * dx").alias("shx"), s("w * h * dy").alias("shy"))
    spread = F.expr("shh - sh * sh / sw")
    flat = spread <= F.expr("1e-12 * (shh + 1e-30)")
    lean = lambda c: F.when(flat, 0.0).otherwise(F.try_divide(F.expr(f"sh{c} - sh * s{c} / sw"), spread))
    return m.withColumns({"tx": lean("x"), "ty": lean("y")}).selectExpr(by, "sx / sw - tx * sh / sw AS dx", "sy / sw - ty * sh / sw AS dy", "tx", "ty")


def sun_surface(dsm: DataFrame, image: DataFrame, by: str, suns: list[tuple[float, float]], cell: float, reach: int) -> DataFrame:
    """(by, azimuth, elevation, r): how the image (value) goes with the depth of shadow under each sun; a fit takes the least r.

    All suns are one join: a cell's rays carry the sun's number."""
    steps = [(float(np.sin(np.radians(a))), float(np.cos(np.radians(a))), float(np.tan(np.radians(e))) * cell, float(a), float(e)) for a, e in suns]
    sun = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(d).alias("drop")) for i, (x, y, d, _, _) in enumerate(steps))))
    own = dsm.select(by, "i", "j", F.col("value").alias("_own")).withColumn("s", sun)
    rays = own.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    rays = rays.select(by, "i", "j", "_own", "s", "n", F.round(F.col("i") + F.col("n") * F.col("s.x")).cast("long").alias("ti"), F.round(F.col("j") + F.col("n") * F.col("s.y")).cast("long").alias("tj"))
    high = dsm.select(by, F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("value").alias("_high"))
    over = rays.join(high, [by, "ti", "tj"]).groupBy(by, "i", "j", F.col("s.k").alias("k")).agg(F.max(F.col("_high") - F.col("n") * F.col("s.drop") - F.col("_own")).alias("_d"))
    depth = own.select(by, "i", "j", F.col("s.k").alias("k")).join(over, [by, "i", "j", "k"], "left").withColumn("_d", F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0)))
    r = depth.join(image.select(by, "i", "j", F.col("value").alias("_v")), [by, "i", "j"]).groupBy(by, "k").agg(correlation(F.col("_d"), F.col("_v")).alias("r"))
    named = lambda n: F.get(F.array(*(F.lit(t[n]) for t in steps)), F.col("k"))
    return r.select(by, named(3).alias("azimuth"), named(4).alias("elevation"), "r")


def sampled_pixels(pixels: DataFrame, files: DataFrame, places: DataFrame, key: str, file: str, value: str) -> DataFrame:
    """(key, file, value): the value (file, row, col) of the pixel that each place (key, file, x, y) lies in, by the file's
    origin and cell (file, x0, y0, cell, nodata: rows count down from y0); null outside or where it is nodata.

    Places that share a pixel read it once."""
    at = places.join(files, file).withColumns({"row": F.floor((F.col("y0") - F.col("y")) / F.col("cell")).cast("long"), "col": F.floor((F.col("x") - F.col("x0")) / F.col("cell")).cast("long")})
    wanted = at.select(file, "row", "col").distinct()
    found = pixels.join(wanted, [file, "row", "col"]).select(file, "row", "col", value)
    return at.join(found, [file, "row", "col"], "left").select(key, file, F.when(~F.col(value).eqNullSafe(F.col("nodata")), F.col(value)).alias(value))


def disc_means(pixels: DataFrame, files: DataFrame, places: DataFrame, key: str, file: str, value: str, radius: float, least: float = 4.0, most: float = 40.0) -> DataFrame:
    """(key, n, mean): the mean of the valid pixels at the offsets of a disc around each place, n of them.

    Each different spot (file, x, y) is looked up once. Its offsets are made after the join with the files, as the left
    side of an outer join with the pixels, so that the many rows they make, of which the planner knows nothing, are not
    broadcast."""
    from terravane.functions.geo import disc_offsets

    own = files.select(F.col(file), "x0", "y0", "cell", "nodata")
    spots = places.select(file, "x", "y").distinct().join(own, file).withColumn("_o", F.explode(disc_offsets(radius, least, most)))
    at = lambda way, size: F.floor(way / F.col(size)).cast("long")
    spots = spots.select(F.col(file).alias("_file"), F.col("x").alias("_x"), F.col("y").alias("_y"), "nodata", at(F.col("y0") - (F.col("y") + F.col("_o.dy")), "cell").alias("_row"), at(F.col("x") + F.col("_o.dx") - F.col("x0"), "cell").alias("_col"))
    there = spots.join(pixels.select(file, "row", "col", value), (F.col("_file") == F.col(file)) & (F.col("_row") == F.col("row")) & (F.col("_col") == F.col("col")), "left")
    valid = F.when(~F.col(value).eqNullSafe(F.col("nodata")), F.col(value))
    sums = there.groupBy("_file", "_x", "_y").agg(F.count(valid).alias("_n"), F.sum(valid).alias("_sum"))
    same = (F.col(file) == F.col("_file")) & F.col("x").eqNullSafe(F.col("_x")) & F.col("y").eqNullSafe(F.col("_y"))
    found = places.select(key, file, "x", "y").join(sums, same)
    return found.groupBy(key).agg(F.sum("_n").alias("n"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("mean"))

"""Smaller joins, samplers and checks of the curation pipelines."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions.text import md5_uniform, normalised
from terravane.operators.splits import seeded_order
from terravane.runtime import cut, discard


_QUOTED = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""")


def _outside_quotes(text: str, rewrite) -> str:
    """text with what lies outside quotes rewritten; double-quoted parts become SQL strings, whatever they hold."""
    out = []
    for i, part in enumerate(_QUOTED.split(text)):
        out.append(rewrite(part) if i % 2 == 0 else "'" + part[1:-1].replace("'", "\\'") + "'" if part[0] == '"' else part)
    return "".join(out)


def where(text: str) -> Column:
    """A row query of the data-frame dialect as a predicate: x.notna(), x.isna(), in [..], ==, and, or."""

    def sql(t: str) -> str:
        t = re.sub(r"(\w+)\.notna\(\)", r"(\1 IS NOT NULL)", t)
        t = re.sub(r"(\w+)\.isna\(\)", r"(\1 IS NULL)", t)
        return re.sub(r"\bin\s*\[", "IN (", t).replace("]", ")").replace("==", "=")

    return F.expr(_outside_quotes(text, sql))


def _divisors(text: str) -> str:
    """An expression whose divisions give null for a divisor 0: what follows each / outside quotes, up to its end, in nullif(.., 0)."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c in "'\"":
            end = text.index(c, at + 1) + 1
            out.append(text[at:end])
            at = end
        elif c == "/":
            end = at + 1
            while end < len(text) and text[end] in " +-":
                end += 1
            while end < len(text) and (text[end].isalnum() or text[end] in "_.`"):
                end += 1
            if end < len(text) and text[end] == "(":
                depth = 0
                while True:
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                    end += 1
                    if not depth:
                        break
            out.append(f"/ nullif({_divisors(text[at + 1 : end])}, 0)")
            at = end
        else:
            out.append(c)
            at += 1
    return "".join(out)


def computed(df: DataFrame, name: str, expression: str, log: bool = False) -> DataFrame:
    """df with an expression column; a zero divisor gives null, at any depth; log takes log(1 + x)."""
    value = F.expr(_divisors(expression))
    return df.withColumn(name, F.log1p(value) if log else value)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, if no key repeats: one aggregation, no list of keys."""
    bad = df.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"{keys} repeat: {bad}")
    return df


def orphans(children: DataFrame, parents: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Children with a parent, and how many without there were in each package."""
    known = parents.select(key).distinct()
    return children.join(known, key, "left_semi"), children.join(known, key, "left_anti").groupBy(by).agg(F.count("*").alias("n_orphans"))


def resolved_code(df: DataFrame, sources: list[tuple[str, str]]) -> DataFrame:
    """df with code, the first source column with a value, and code_source, its name."""
    code = F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c, _ in sources))
    source = None
    for c, name in reversed(sources):
        has = F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
        source = F.when(has, F.lit(name)) if source is None else F.when(has, F.lit(name)).otherwise(source)
    return df.withColumns({"code": code, "code_source": source})


def resolved_community(df: DataFrame, sources: list[tuple[str, str]], name: str, by_name: str, catalogue: DataFrame, code: str, title: str) -> DataFrame:
    """df with code, code_source and resolved: the first code given, else that of the catalogue's row (the least code)
    whose title is the same name but for case, marks and blanks; resolved if the catalogue has the code."""
    titles = catalogue.select(normalised(F.col(title)).alias("_k"), F.col(code).alias("_code")).groupBy("_k").agg(F.min("_code").alias("_named"))
    known = catalogue.select(F.col(code).alias("_known")).distinct()
    own = resolved_code(df.withColumn("_k", normalised(F.col(name))).join(titles, "_k", "left"), [*sources, ("_named", by_name)])
    return own.join(known, F.col("code") == F.col("_known"), "left").withColumn("resolved", F.col("_known").isNotNull()).drop("_k", "_named", "_known")


def named_dates(items: DataFrame, item: str, names: dict[str, Column], dates: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """Earliest start and latest end of the dates found under an item's names, by the first kind of name that finds any."""
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("priority"), c.alias("key")) for i, c in enumerate(names.values()))))
    found = items.select(item, keys.alias("k")).select(item, "k.*").join(dates.withColumnRenamed(name, "key"), "key")
    per = found.groupBy(item, "priority").agg(F.min(start).alias(start), F.max(end).alias(end))
    return per.groupBy(item).agg(F.min_by(F.struct("priority", start, end), "priority").alias("m")).select(item, "m.*")


def prefixed(left: DataFrame, right: DataFrame, name: str, other: str, least: int = 1) -> DataFrame:
    """left's rows whose name starts with one of right's, or the other way round: an equi-join on the shorter one.

    Every length that occurs on the other side gives one prefix of a name; lengths are few. Names shorter than least
    match nothing; by default only empty ones."""
    lengths = lambda df, c: sorted(r[0] for r in df.filter(F.length(c) >= least).select(F.length(c)).distinct().collect())
    a, b = lengths(left, name), lengths(right, other)
    cut = lambda c, ns: F.explode(F.transform(F.filter(F.array(*map(F.lit, ns)) if ns else F.array().cast("array<int>"), lambda n: n <= F.length(c)), lambda n: F.substring(F.col(c), F.lit(1), n)))
    longer = left.withColumn("_p", cut(name, b)).join(right.select(F.col(other).alias("_p")).distinct(), "_p", "left_semi").drop("_p")
    shorter = left.join(right.select(cut(other, a).alias(name)).distinct(), name, "left_semi").select(left.columns)
    return longer.unionByName(shorter).distinct()


def member_of(df: DataFrame, columns: list[str], wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with one of wanted in any of the columns, whatever the case; and the wanted values that occur in none."""
    low = [w.lower() for w in wanted]
    hit = None
    for c in columns:
        one = F.lower(F.trim(F.col(c))).isin(low)
        hit = one if hit is None else hit | one
    there = df.select(F.explode(F.array(*(F.lower(F.trim(F.col(c))) for c in columns))).alias("v")).filter(F.col("v").isin(low)).distinct()
    known = {r.v for r in there.collect()}  # at most as many as wanted
    return df.filter(F.coalesce(hit, F.lit(False))), [w for w in wanted if w.lower() not in known]


def touched_cells(df: DataFrame, x: str, y: str, radius: float, cell: float) -> DataFrame:
    """df with each cell (i, j) of a grid that the disc around a row touches."""
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / cell).cast("long"), F.floor((F.col(c) + radius) / cell).cast("long"))
    out = df.withColumn("i", F.explode(span(x))).withColumn("j", F.explode(span(y)))
    away = lambda c, k: F.greatest(F.col(k) * cell - F.col(c), F.col(c) - (F.col(k) + 1) * cell, F.lit(0.0))
    return out.filter(away(x, "i") ** 2 + away(y, "j") ** 2 <= radius * radius)


def nearest_square(left: DataFrame, right: DataFrame, key: str, to: str, half: float, slack: float = 1.02) -> DataFrame:
    """For each row of left the square of right (centre x, y) nearest in the larger coordinate difference, if the point lies within half * slack."""
    reach = half * slack
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r = right.select(F.col(to), F.col("x").alias("_x"), F.col("y").alias("_y")).withColumns({"_i": F.floor(F.col("_x") / reach), "_j": F.floor(F.col("_y") / reach)})
    s = left.withColumn("_i", F.explode(F.transform(near, lambda d: F.floor(F.col("x") / reach) + d))).withColumn("_j", F.explode(F.transform(near, lambda d: F.floor(F.col("y") / reach) + d)))
    far = F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y")))
    pairs = s.join(r, ["_i", "_j"]).withColumn("distance", far).filter(F.col("distance") <= reach)
    return pairs.groupBy(key).agg(F.min_by(F.struct(to, "distance"), F.struct("distance", to)).alias("m")).select(key, "m.*")


def nearest_in_cell(left: DataFrame, right: DataFrame, by: str, key: str, to: str, radius: float) -> DataFrame:
    """For each point of left the nearest of right in the same batch element within radius, in three dimensions; ties to
    the least of right.

    Different positions are searched, each once, among the least points of right's different positions. The search begins
    with a radius about that of one point of right, and grows twofold, up to radius, for positions without one within it;
    a position with one has its nearest. What a round settles is written. A cell is two radii wide, so that a position
    looks itself up in two cells of each axis."""
    axes = ("x", "y", "z")
    left = cut(left.select(by, key, *axes), "nearest-left")
    r = right.groupBy(by, *(F.col(a).alias(f"_{a}") for a in axes)).agg(F.min(to).alias(to))
    r = cut(r.dropna(subset=[by, "_x", "_y", "_z"]), "nearest-right")
    rest = cut(left.select(by, *axes).distinct().dropna(), "nearest-rest")
    size = r.select(by, *(F.floor(F.col(f"_{a}") / radius).alias(f"_c{a}") for a in axes)).groupBy(by, *(f"_c{a}" for a in axes)).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]  # that a point shares its cell with
    reach = radius / 2.0 ** max(0, math.ceil(math.log2(size or 1) / 3))
    d2 = sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in axes), F.lit(0.0))
    parts = []
    while True:
        at = lambda c, wide=reach: F.floor(c / (2 * wide)).cast("long")
        number = lambda cells: F.xxhash64(by, *cells)  # noqa: E731  # cells that share a number only cost comparisons
        s = rest
        for a in axes:
            off = reach * (1 + 1e-9) + F.abs(F.col(a)) * 1e-15  # beyond what rounding takes away
            s = s.withColumn(f"_c{a}", F.explode(F.sequence(at(F.col(a) - off), at(F.col(a) + off))))
        s = s.select(by, *axes, number([f"_c{a}" for a in axes]).alias("_cell"))
        there = r.withColumn("_cell", number([at(F.col(f"_{a}")) for a in axes]))
        pairs = s.join(there, [by, "_cell"]).withColumn("d2", d2).filter(F.col("d2") <= reach * reach)
        found = cut(pairs.groupBy(by, *axes).agg(F.min(F.struct("d2", to)).alias("_m")), "nearest-found")
        parts.append(found)
        if reach >= radius:
            break
        left_over = cut(rest.join(found, [by, *axes], "left_anti"), "nearest-rest")
        discard(rest)
        rest = left_over
        if rest.isEmpty():
            break
        reach = min(radius, 2 * reach)
    discard(r, rest)
    best = left.join(reduce(DataFrame.union, parts), [by, *axes])
    return best.groupBy(by, key).agg(F.min("_m").alias("_m")).select(by, key, F.col(f"_m.{to}").alias(to), "_m.d2")


def ring_cells(df: DataFrame, k: int) -> DataFrame:
    """df with every cell (ci, cj) within k of its own (i, j)."""
    step = F.sequence(F.lit(-k), F.lit(k))
    return df.withColumn("ci", F.explode(F.transform(step, lambda d: F.col("i") + d))).withColumn("cj", F.explode(F.transform(step, lambda d: F.col("j") + d)))


def neighbour_gaps(cells: DataFrame, stride: int, most: float) -> DataFrame:
    """(i, j, ni, nj, gap): neighbouring cells, right and up, whose displacement differs by more than most."""
    step = F.explode(F.array(F.struct(F.lit(stride).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(stride).alias("b"))))
    a = cells.withColumn("s", step).select("i", "j", "dx", "dy", (F.col("i") + F.col("s.a")).alias("ni"), (F.col("j") + F.col("s.b")).alias("nj"))
    b = cells.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("dx").alias("ndx"), F.col("dy").alias("ndy"))
    gap = F.sqrt((F.col("dx") - F.col("ndx")) ** 2 + (F.col("dy") - F.col("ndy")) ** 2)
    return a.join(b, ["ni", "nj"]).withColumn("gap", gap).filter(F.col("gap") > most).select("i", "j", "ni", "nj", "gap")


def weighted_clusters(df: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """(key, n): how many of n draws with replacement fall on each row, with chance in proportion to weight.

    Draw k is a number from the MD5 of 'seed:k' in [0, 1), times the total: the row whose stretch of the running
    total holds it. Keys fall into buckets of their own value, as many as a bucket has rows, and buckets into groups,
    so no task orders all rows; a draw finds its group, its bucket and its row by equi-joins on stretches of the
    total, of which there are as many as draws."""
    d = df.select(F.col(key).alias("k"), weight.cast("double").alias("w")).filter("w > 0")
    size = d.agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.min("k").alias("lo"), F.max("k").alias("hi")).first()
    if not size.n:
        return d.select(F.col("k").alias(key), F.lit(0).cast("long").alias("n"))
    buckets = max(1, min(1 << 16, int(size.n**0.5)))
    step = (size.hi - size.lo) // buckets + 1
    d = d.withColumn("b", F.floor((F.col("k") - size.lo) / step))
    sums = d.groupBy("b").agg(F.sum("w").alias("s"))
    starts = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))  # at most 2**16 buckets
    run = F.sum("w").over(Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    rows = d.withColumn("run", run).join(F.broadcast(starts), "b").withColumns({"hi": F.col("before") + F.col("run"), "lo": F.col("before") + F.col("run") - F.col("w")})
    draws = df.sparkSession.range(n).withColumn("at", md5_uniform(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))) * F.lit(size.total))
    slot = lambda c: F.floor(F.col(c) / size.total * n).cast("long")
    rows = rows.withColumn("slot", F.explode(F.sequence(slot("lo"), slot("hi"))))  # rows + n in all
    hits = draws.withColumn("slot", slot("at")).join(rows, "slot").filter("at >= lo AND at < hi")
    return hits.groupBy(F.col("k").alias(key)).agg(F.count("*").alias("n"))


def locations(spark: SparkSession, n: int, tiles: list[tuple[str, float, list[list[tuple[float, float]]]]], seed: int, away: tuple[list[tuple[float, float]], float] | None = None) -> DataFrame:
    """(i, name, lon, lat): item i depends on the seed and i alone.

    A tile (name, weight, rings) is drawn by weight and a place in its box until one lies inside the tile; a place
    within a distance in metres of one of the places (lon, lat) in away is drawn anew, tile and all. Tiles and places
    to keep away from are sent to the tasks."""
    from terravane.functions import geo

    names = [t[0] for t in tiles]
    weights = np.cumsum([t[1] for t in tiles]) / sum(t[1] for t in tiles)
    rings = [[np.array(r, float) for r in t[2]] for t in tiles]
    boxes = [(*np.concatenate(r).min(0), *np.concatenate(r).max(0)) for r in rings]
    far = np.array(away[0], float).reshape(-1, 2) if away else np.zeros((0, 2))

    def inside(t: int, p: np.ndarray) -> np.ndarray:
        odd = np.zeros(len(p), int)
        for r in rings[t]:
            for (x1, y1), (x2, y2) in zip(r, r[1:], strict=False):
                over = (y1 > p[:, 1]) != (y2 > p[:, 1])
                if y1 != y2:
                    odd += over & (p[:, 0] < (x2 - x1) * (p[:, 1] - y1) / (y2 - y1) + x1)
        return odd % 2 == 1

    def close(p: np.ndarray) -> bool:
        dx = (far[:, 0] - p[0]) * np.cos(np.radians((far[:, 1] + p[1]) / 2)) * geo.DEGREE_M
        return bool((np.hypot(dx, (far[:, 1] - p[1]) * geo.DEGREE_M) <= away[1]).any()) if len(far) else False

    def one(i: int) -> tuple[str, float, float]:
        rng = np.random.Generator(np.random.Philox(key=[seed, i]))
        for _ in range(1000):
            t = min(int(np.searchsorted(weights, rng.random(), side="right")), len(names) - 1)
            x0, y0, x1, y1 = boxes[t]
            for _ in range(20):
                p = np.column_stack([rng.uniform(x0, x1, 64), rng.uniform(y0, y1, 64)])
                ok = np.flatnonzero(inside(t, p))
                if len(ok):
                    break
            else:
                continue
            if not close(p[ok[0]]):
                return names[t], float(p[ok[0], 0]), float(p[ok[0], 1])
        raise ValueError(f"no place found for item {i}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [one(int(i)) for i in p["id"]]
            yield pd.DataFrame({"i": p["id"], "name": [f[0] for f in found], "lon": [f[1] for f in found], "lat": [f[2] for f in found]})

    return spark.range(n).mapInPandas(run, "i long, name string, lon double, lat double")


def drawn_until(df: DataFrame, by: str, key: str, usable: Column, n: int, tries: int, seed: int) -> DataFrame:
    """Of each group, the first n usable rows among its first tries rows in a seeded order."""
    w = Window.partitionBy(by).orderBy(seeded_order(F.col(key), seed), key)
    tried = df.withColumn("_t", F.row_number().over(w)).filter(F.col("_t") <= tries).filter(usable)
    return tried.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy("_t"))).filter(F.col("_k") <= n).drop("_t", "_k")


def dealt(df: DataFrame, number: str, n: int) -> DataFrame:
    """df with share, 0 to n - 1: share g has the numbers g, g + n, g + 2n and so on."""
    return df.withColumn("share", F.pmod(F.col(number), F.lit(n)).cast("int"))


def quantile_bins(df: DataFrame, value: str, k: int, key: str, by: list[str]) -> DataFrame:
    """df with bin, 1 to k, of equal counts within each group; ties by key."""
    return df.withColumn("bin", F.ntile(k).over(Window.partitionBy(*by).orderBy(value, key)))


def cumulative_offsets(sizes: DataFrame, key: str, size: str, width: int = 1024) -> DataFrame:
    """(key, size, offset_end) of a table with one row for each batch element, whose keys are whole numbers.

    Keys fall into buckets of width; the window over all rows sees one for each bucket."""
    rows = sizes.withColumn("_b", F.floor(F.col(key) / width))
    per = rows.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = per.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(size).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, "_b").withColumn("offset_end", own + F.col("_before")).drop("_b", "_before")


def lineage_errors(df: DataFrame, code: str, parent: str, filled: str) -> DataFrame:
    """Rows whose filled ancestor is not the row of their parent's code."""
    up = df.select(F.col(code).alias(parent), F.col(filled).alias("_own"))
    return df.join(up, parent, "left").filter(F.col(parent).isNotNull() & ~F.col("_own").eqNullSafe(F.col(filled)))


def cover_percent(code: Column, table: dict[str, float]) -> Column:
    """The percentage of a cover code, also written with leading zeros or without."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    c = F.trim(code)
    return F.coalesce(F.try_element_at(lookup, c), F.try_element_at(lookup, F.regexp_replace(c, "^0+(?=.)", "")), F.try_element_at(lookup, F.lpad(c, 2, "0")))


# fixed values: what a raw shape may say, by the shape meant; later ones win
SHAPES = {"rectangle": "rect|quickplot|belt|recatng", "square": "square", "circle": "circ", "transect": "transect|linear|lineear|strip", "point": "obs"}
ODD_SHAPES = "irregular|oval|triangle|crescent|banana|boot|amoeba|pac man|semi|half|shaped"
NO_SHAPES = ["", "na", "#n/a", "other", "estimate"]


def plot_footprint(df: DataFrame, shape: str, radius: str, diameter: str, length: str, width: str) -> DataFrame:
    """df with plot_shape, plot_area (square metres), plot_basis and plot_flag.

    A dimension over 100 (radius) or 200 is a typing error, and then none of the row's is used, nor are any that are
    not positive. Areas come from radius, diameter, length by width, one side of a square, or a radius of any shape,
    the first that fits the shape."""
    low = F.lower(F.coalesce(F.col(shape), F.lit("")))
    kind = F.lit("unknown")
    for name, pattern in SHAPES.items():
        kind = F.when(low.rlike(pattern), name).otherwise(kind)
    kind = F.when((kind == "unknown") & ~low.isin(NO_SHAPES), "other").otherwise(kind)
    kind = F.when(low.rlike(ODD_SHAPES), "other").otherwise(kind)
    over = lambda c, most: F.coalesce(F.col(c) > most, F.lit(False))
    bad = over(radius, 100) | over(diameter, 200) | over(length, 200) | over(width, 200)
    r, d, a, b = (F.when((F.col(c) > 0) & ~bad, F.col(c).cast("double")) for c in (radius, diameter, length, width))
    round_, pi = kind.isin("circle", "unknown"), 3.141592653589793
    ways = [
        (r.isNotNull() & round_, pi * r * r, "radius"),
        (d.isNotNull() & round_, pi * (d / 2) * (d / 2), "diameter"),
        (a.isNotNull() & b.isNotNull() & ~kind.isin("circle", "point"), a * b, "length_x_width"),
        ((a.isNotNull() | b.isNotNull()) & (kind == "square"), F.coalesce(a, b) * F.coalesce(a, b), "side"),
        (r.isNotNull(), pi * r * r, "radius"),
    ]
    area, basis = F.lit(None).cast("double"), F.lit("none")
    for fits, value, name in reversed(ways):
        area, basis = F.when(fits, value).otherwise(area), F.when(fits, name).otherwise(basis)
    flag = F.when(bad, "implausible_dimension_ignored").when(area.isNull(), "no_usable_dimensions").otherwise("ok")
    return df.withColumns({"plot_shape": kind, "plot_area": area, "plot_basis": basis, "plot_flag": flag})


def quad_cell(name: Column) -> tuple[Column, Column]:
    """Rows and columns (1/16 degree) of a quarter quad named by its degree, number and quarter: '4112345_nw' is 41 N, 123 W, quad 45."""
    lat, lon = F.regexp_extract(name, r"(\d{2})(\d{3})(\d{2})_([ns][ew])", 1).try_cast("int"), F.regexp_extract(name, r"(\d{2})(\d{3})(\d{2})_([ns][ew])", 2).try_cast("int")
    quad, quarter = F.regexp_extract(name, r"(\d{2})(\d{3})(\d{2})_([ns][ew])", 3).try_cast("int"), F.regexp_extract(name, r"(\d{2})(\d{3})(\d{2})_([ns][ew])", 4)
    row, col = F.floor((quad - 1) / 8), F.pmod(quad - 1, F.lit(8))  # quads count from the north-west corner
    north, east = F.when(quarter.startswith("n"), 1).otherwise(0), F.when(quarter.endswith("e"), 1).otherwise(0)
    return (lat * 16 + (7 - row) * 2 + north).cast("int"), (-lon * 16 - 16 + col * 2 + east).cast("int")


def displaced(x: Column, y: Column, model: Column) -> tuple[Column, Column]:
    """x and y moved by a displacement (a, b, c, d, e, f): dx = a + b x + c y, dy = d + e x + f y; missing terms are 0."""
    t = lambda k: F.coalesce(model[k], F.lit(0.0))
    return x + t("a") + t("b") * x + t("c") * y, y + t("d") + t("e") * x + t("f") * y


def quality_class(residual: Column, n: Column, good: float = 1.0, fair: float = 2.0, least: int = 30) -> Column:
    return F.when((n < least) | residual.isNull(), "poor").when(residual <= good, "good").when(residual <= fair, "fair").otherwise("poor")


def fnv1a(df: DataFrame, columns: list[str], out: str = "fnv") -> DataFrame:
    """df with the 64-bit FNV-1a hash of integer columns, as a signed number."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h = np.full(len(p), 14695981039346656037, np.uint64)
            for c in columns:
                h = (h * np.uint64(1099511628211)) ^ p[c].to_numpy(np.int64).view(np.uint64)
            yield p.assign(**{out: h.view(np.int64)})

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} long")


def decoded_wkb(df: DataFrame, wkb: str, out: str = "rings") -> DataFrame:
    """df with the rings of a well-known-binary polygon or multipolygon, and a point as a ring of one."""
    import struct

    def parse(b: bytes) -> list:
        def read(at: int) -> tuple[list, int]:
            order = "<" if b[at] == 1 else ">"
            (kind,) = struct.unpack_from(f"{order}I", b, at + 1)
            at += 5
            if kind == 1:
                return [[dict(zip("xy", struct.unpack_from(f"{order}2d", b, at), strict=True))]], at + 16
            (n,) = struct.unpack_from(f"{order}I", b, at)
            at += 4
            rings: list = []
            for _ in range(n):
                if kind == 6:
                    more, at = read(at)
                    rings += more
                else:
                    (m,) = struct.unpack_from(f"{order}I", b, at)
                    v = struct.unpack_from(f"{order}{2 * m}d", b, at + 4)
                    at += 4 + 16 * m
                    rings.append([{"x": v[2 * i], "y": v[2 * i + 1]} for i in range(m)])
            return rings, at

        return read(0)[0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(**{out: [None if v is None else parse(bytes(v)) for v in p[wkb]]})

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} array<array<struct<x:double,y:double>>>")


def merged_partials(df: DataFrame, by: list[str], n: str, total: str, expected: str) -> DataFrame:
    """Partial counts and sums merged: (by, n, mean, coverage)."""
    sums = df.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(total).alias("t"), F.max(expected).alias("e"))
    return sums.select(*by, "n", F.try_divide("t", "n").alias("mean"), F.try_divide("n", "e").alias("coverage"))


def robust_slope(df: DataFrame, x: str, y: str, cluster: str) -> DataFrame:
    """(n, slope, se): least-squares slope with a standard error robust to clusters, from sums by cluster."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = known.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.count("*").alias("n"), (F.covar_pop(x, y) / F.var_pop(x)).alias("slope"), (F.var_pop(x) * F.count("*")).alias("sxx"))
    score = (F.col(x) - F.col("mx")) * (F.col(y) - F.col("my") - F.col("slope") * (F.col(x) - F.col("mx")))
    per = known.crossJoin(F.broadcast(m)).groupBy(cluster).agg(F.sum(score).alias("u"), F.first("n").alias("n"), F.first("slope").alias("slope"), F.first("sxx").alias("sxx"))  # m is one row
    return per.agg(F.first("n").alias("n"), F.first("slope").alias("slope"), (F.sqrt(F.sum(F.col("u") ** 2) * F.count("*") / (F.count("*") - 1)) / F.first("sxx")).alias("se"))


def calibrated(rows: DataFrame, models: DataFrame, cell: float, survey: str) -> DataFrame:
    """rows (x, y, survey) moved by the displacement of their cell and survey; rows without one stay, with calibrated false."""
    own = rows.withColumns({"i": F.floor(F.col("x") / cell).cast("long"), "j": F.floor(F.col("y") / cell).cast("long")})
    joined = own.join(models.select("i", "j", survey, F.struct("a", "b", "c", "d", "e", "f").alias("_m")), ["i", "j", survey], "left")
    x, y = displaced(F.col("x"), F.col("y"), F.col("_m"))
    has = F.col("_m").isNotNull()
    return joined.withColumns({"x": F.when(has, x).otherwise(F.col("x")), "y": F.when(has, y).otherwise(F.col("y")), "calibrated": has}).drop("_m")


def covered_cells(polygons: DataFrame, key: str, cell: float, least: float) -> DataFrame:
    """(key, i, j, share): grid cells of which a polygon or multipolygon covers at least that share (clipped exactly).

    A ring inside an odd number of other rings is a hole and counts against the cell; rings do not cross."""

    def clip(ring: list[tuple[float, float]], axis: int, at: float, above: bool) -> list[tuple[float, float]]:
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = ((v[axis] >= at) if above else (v[axis] <= at) for v in (p, q))
            if a:
                out.append(p)
            if a != b:
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        return out

    def area(ring: list[tuple[float, float]]) -> float:
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0

    def inside(point: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
        (x, y), odd = point, False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    def signed(rings) -> list[tuple[int, list[tuple[float, float]]]]:
        own = [[(float(v["x"]), float(v["y"])) for v in r][:-1] for r in rings]
        return [(-1 if sum(inside(r[0], o) for o in own if o is not r) % 2 else 1, r) for r in own if len(r) > 2]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows, known = [], {}
            for k, rings, i, j in zip(p[key], p["rings"], p["i"], p["j"], strict=True):
                if k not in known:
                    known = {k: signed(rings)}  # a polygon's cells come one after the other
                share = 0.0
                for sign, r in known[k]:
                    for axis, n in ((0, i), (1, j)):
                        r = clip(clip(r, axis, n * cell, True), axis, (n + 1) * cell, False) if r else r
                    share += sign * area(r) / (cell * cell)
                if share >= least:
                    rows.append((k, i, j, share))
            yield pd.DataFrame(rows, columns=[key, "i", "j", "share"])

    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell).cast("long"), F.floor(F.col(hi) / cell).cast("long"))
    cells = polygons.select(key, "rings", F.explode(span("xmin", "xmax")).alias("i"), "ymin", "ymax").withColumn("j", F.explode(span("ymin", "ymax")))
    return cells.select(key, "rings", "i", "j").mapInPandas(run, f"{key} {polygons.schema[key].dataType.simpleString()}, i long, j long, share double")

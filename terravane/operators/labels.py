"""Label engineering: events, rates, occupancy, taxonomy, turnover, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.text import md5_uniform


def _carried(df: DataFrame, keys: list[str], value: Column, how, name: str) -> DataFrame:
    """df with how(value) over all earlier buckets of its keys: buckets are aggregated first, so the window sees one row for each."""
    per = df.groupBy(*keys, "_bucket").agg(value.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(per.select(*keys, "_bucket", how("_v").over(w).alias(name)), [*keys, "_bucket"])


def _new_events(df: DataFrame, by: list[str], start: str, seconds: str, gap: str, tie: str, bucket: str) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(by))]  # null keys meet in joins as a text
    df = df.withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for k, c in zip(keys, by, strict=True)})
    df = df.withColumn("_end", F.timestamp_micros((F.unix_micros(start) + F.round(F.col(seconds) * 1_000_000)).cast("long"))).withColumn("_bucket", F.date_trunc(bucket, start))
    df = _carried(df, keys, F.max("_end"), F.max, "_earlier")
    w = Window.partitionBy(*keys, "_bucket").orderBy(start, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.max("_end").over(w), F.col("_earlier"))
    return df.withColumn("_new", F.coalesce((F.col(start) > last + F.expr(gap)).cast("int"), F.lit(1)))


def sessions(df: DataFrame, by: list[str], start: str, seconds: str, gap: str, tie: str, bucket: str = "day") -> DataFrame:
    """df with event_no: a new event begins where a start lies more than gap after every earlier end of its group.

    Groups are cut into buckets of time, whose ends and counts are carried on, so a group of any size is many
    tasks' work; rows without a start are left out."""
    columns = df.columns
    new = _new_events(df.filter(F.col(start).isNotNull()), by, start, seconds, gap, tie, bucket)
    keys = [f"_k{i}" for i in range(len(by))]
    new = _carried(new, keys, F.sum("_new"), F.sum, "_before")
    w = Window.partitionBy(*keys, "_bucket").orderBy(start, tie).rowsBetween(Window.unboundedPreceding, 0)
    return new.select(*columns, (F.sum("_new").over(w) + F.coalesce("_before", F.lit(0))).alias("event_no"))


def event_counts(df: DataFrame, by: list[str], start: str, seconds: str, gap: str, tie: str, bucket: str = "day") -> DataFrame:
    """(by, n_sequences, n_events)."""
    new = _new_events(df.filter(F.col(start).isNotNull()), by, start, seconds, gap, tie, bucket)
    return new.groupBy(*by).agg(F.count("*").alias("n_sequences"), F.sum("_new").alias("n_events"))


def rates(events: DataFrame, effort: DataFrame, unit: str, species: str) -> DataFrame:
    """Events for 100 units of effort, pooled: 100 * sum(n_events) / effort."""
    per = events.groupBy(unit, species).agg(F.sum("n_events").alias("n"))
    return per.join(effort, unit).select(unit, species, F.try_divide(100 * F.col("n"), F.col("effort")).alias("rate"))


def occupancy(df: DataFrame, by: str, species: str, values: list, prefix: str = "occ__") -> DataFrame:
    """A 0/1 column for each of the given species."""
    wide = df.groupBy(by).pivot(species, values).agg(F.lit(1))
    return wide.select(by, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("int").alias(prefix + str(v).lower().replace(" ", "_").replace("#", "_")) for v in values))


def species_summary(df: DataFrame, species: str, site: str, is_test: str) -> DataFrame:
    return df.groupBy(species).agg(F.count("*").alias("n_rows"), F.count_distinct(site).alias("n_sites"), F.count_distinct(F.when(F.col(is_test), F.col(site))).alias("n_test_sites"))


def mode_label(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most common label of each group, the least on ties; nulls don't vote."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("n"))


def best_row(df: DataFrame, by: list[str], keep: list[str], order: Column) -> DataFrame:
    """The row of each group that comes first in order."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*keep), order).alias("r")).select(*by, "r.*")


def distinct_text(df: DataFrame, by: list[str], column: str, sep: str = " | ") -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(F.col(column).cast("string"))), sep).alias(column))


def turnover(visits: DataFrame, site: str, day: str, label: str, tie: str) -> DataFrame:
    """Each visit with its predecessor at the site: gap in years, and whether the label stayed (null if either is missing)."""
    w = Window.partitionBy(site).orderBy(day, tie)
    out = visits.withColumn("was", F.lag(label).over(w)).withColumn("before", F.lag(day).over(w)).filter(F.col("before").isNotNull())
    return out.withColumn("gap_years", F.datediff(day, "before") / 365.25).withColumn("agree", (F.col(label) == F.col("was")).cast("int"))


def binned(value: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed bins: names[i] for edges[i] < value <= edges[i + 1]; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges, edges[1:], names, strict=False))):
        out = F.when((value > lo) & (value <= hi), F.lit(name)).otherwise(out)
    return out


def coverage_by_class(attempts: DataFrame, label: str, covered: str, gap: str, most: int, by: str, cap: int, order: list) -> DataFrame:
    """(label, attempts, covered, near, selected): rows of each class, those with a product, those within so many years,
    and those of these that remain when each of by has at most cap, the first in order."""
    near = F.coalesce(F.col(covered).isNotNull() & (F.col(gap) <= most), F.lit(False))
    w = Window.partitionBy(label, by).orderBy(F.desc("_near"), *order)
    rows = attempts.withColumn("_near", near).withColumn("_n", F.row_number().over(w))
    return rows.groupBy(label).agg(F.count("*").alias("attempts"), F.count(covered).alias("covered"), F.count_if("_near").alias("near"), F.count_if(F.col("_near") & (F.col("_n") <= cap)).alias("selected"))


def reconciled(days: Column, tolerance: int) -> Column:
    """What a gap of days between two sources of one date means."""
    return F.when(days.isNull(), "missing").when(F.abs(days) <= tolerance, "agrees").when(days > tolerance, "late").otherwise("early")


def gps_spans(df: DataFrame, by: str, gps: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): quantiles of adjusted GPS seconds (seconds of GPS time less 10**9)."""
    return df.groupBy(by).agg(*(F.percentile(gps, F.lit(q)).alias(n) for n, q in shares.items()))


def fill_down(df: DataFrame, order: str, level: str, name: str, levels: list[str], width: int = 4096) -> DataFrame:
    """Depth-first rows (order: whole numbers) with a column for each level: ancestors carried down, deeper levels cleared at each step up.

    A level's value is the last one seen unless a row of a higher level came after it. Rows fall into buckets of
    order; the window over all of them sees one row for each bucket."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    df = df.withColumn("_b", F.floor(F.col(order) / width))
    own = lambda i: F.max(F.when(rank == i, F.struct(F.col(order).alias("o"), F.col(name).alias("v"))))
    reset = lambda i: F.max(F.when(rank < i, F.col(order)))
    many = range(1, len(levels) + 1)
    per = df.groupBy("_b").agg(*(own(i).alias(f"_o{i}") for i in many), *(reset(i).alias(f"_r{i}") for i in many))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_b", *(F.max(f"_{c}{i}").over(w).alias(f"_{c}{i}") for i in many for c in "or"))
    inner = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(before, "_b")
    for i, n in enumerate(levels, 1):
        last, cleared = F.coalesce(own(i).over(inner), F.col(f"_o{i}")), F.coalesce(reset(i).over(inner), F.col(f"_r{i}"))
        df = df.withColumn(f"{n}_name", F.when(cleared.isNull() | (last["o"] > cleared), last["v"]))
    return df.drop("_b", *(f"_{c}{i}" for i in many for c in "or"))


def rate_matrix(events: DataFrame, effort: DataFrame, unit: str, species: str, values: list) -> DataFrame:
    """A row for each unit of effort with occ__ and rate__ columns: 100 * events / effort, 0 where a species was never seen."""
    wide = events.groupBy(unit).pivot(species, values).agg(F.sum("n_events"))
    column = lambda v: str(v).replace(" ", "_")
    out = effort.join(wide, unit, "left")
    n = {v: F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values}
    return out.select(unit, *((n[v] > 0).cast("int").alias(f"occ__{column(v)}") for v in values), *(F.try_divide(100 * n[v], F.col("effort")).alias(f"rate__{column(v)}") for v in values))


def unchanging(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, columns): the one value of each group's columns; groups with two are an error, found in the same aggregation."""
    ends = df.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))
    message = F.concat(F.lit("several values for "), F.col(by).cast("string"))
    return ends.select(by, *(F.when(same, F.col(f"lo_{c}")).otherwise(F.raise_error(message)).alias(c) for c in columns))


def pooled_presence(df: DataFrame, by: str, year: str, species: list[str], fixed: list[str]) -> DataFrame:
    """(by, fixed, n_years, first_year, last_year, pres__ columns) over all years of each unit: present if ever counted.

    Species that no unit has get no column: their totals are one row."""
    units = df.groupBy(by).agg(F.count_distinct(year).alias("n_years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), *(F.coalesce((F.max(s) > 0).cast("int"), F.lit(0)).alias(f"pres__{s}") for s in species))
    some = units.agg(*(F.max(f"pres__{s}").alias(s) for s in species)).first()
    return unchanging(df, by, fixed).join(units, by).drop(*(f"pres__{s}" for s in species if not some[s]))


def basal_area(trees: DataFrame, plots: DataFrame, plot: str, diameter: str, hectares: str) -> DataFrame:
    """plots with basal_area: stem cross-sections in a plot over its area; null without trees. Pi is 3.14159, as published labels have it."""
    sums = trees.groupBy(plot).agg(F.sum(3.14159 * (F.col(diameter) / 2) * (F.col(diameter) / 2)).alias("_s"))
    return plots.join(sums, plot, "left").withColumn("basal_area", F.try_divide(F.col("_s"), F.col(hectares))).drop("_s")


def prevalence(df: DataFrame, rates: str, split: str, names: list[str]) -> DataFrame:
    """(species, split, n, prevalence, mean_rate) of an array column of rates with one entry for each species."""
    each = df.select(split, F.posexplode(rates).alias("_i", "_v"))
    sums = each.groupBy(split, "_i").agg(F.count_if(F.col("_v") > 0).alias("n"), F.avg((F.col("_v") > 0).cast("double")).alias("prevalence"), F.avg("_v").alias("mean_rate"))
    return sums.select(F.try_element_at(F.array(*map(F.lit, names)), (F.col("_i") + 1).cast("int")).alias("species"), split, "n", "prevalence", "mean_rate")


def by_priority(df: DataFrame, by: list[str], source: str, order: list[str], tie: str) -> DataFrame:
    """One row of each group: that of the source named first in order, sources not named last by name."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    rank = F.struct(F.when(place > 0, place).otherwise(len(order) + 1), F.col(source), F.col(tie))
    keep = [c for c in df.columns if c not in by]
    return best_row(df, by, keep, rank)


def top_map(df: DataFrame, by: list[str], key: str, value: Column, n: int) -> DataFrame:
    """A map of the n keys with the largest value, by key on ties."""
    sums = df.groupBy(*by, key).agg(value.alias("_v"))
    w = Window.partitionBy(*by).orderBy(F.desc("_v"), key)
    top = sums.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return top.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col("_v"))))).alias("top"))


def bootstrap(df: DataFrame, cluster: str, value: Column, draws: int = 200, seed: int = 7) -> DataFrame:
    """(n, mean, low, high): a mean with a 95 % interval over clusters.

    Clusters are summed first; each draw weights a cluster by a Poisson(1) number made from its hash, so draws
    are sums over partial aggregates and no cluster list is gathered."""
    sums = df.filter(value.isNotNull()).groupBy(cluster).agg(F.sum(value.cast("double")).alias("s"), F.count("*").alias("n"))
    u = md5_uniform(F.concat_ws("/", F.lit(str(seed)), F.col(cluster).cast("string"), F.col("draw").cast("string")))
    weight, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total += p
        weight = weight + (u >= total).cast("int")
        p /= k
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return sums.agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean")).crossJoin(ends)  # one row each

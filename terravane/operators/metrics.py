"""Exact scores over long tables of (row, target, truth, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.text import correlation

from terravane.runtime import cut


def multiclass(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(accuracy, balanced_accuracy, macro_f1): recall over true classes, F1 over all classes with 0 for 0/0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))  # classes squared
    per = (
        cells.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x"))
        .groupBy("x.c")
        .agg(F.sum("x.actual").alias("actual"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    )
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("said")), F.lit(0.0))
    return per.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg(F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def _by_score(df: DataFrame, target: str, truth: str, score: str) -> DataFrame:
    """Positives and rows of each distinct score, summed before any window sees them."""
    return df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(target).alias("target"), F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.count("*").alias("n"))


def _before(rows: DataFrame, sums: list[str], descending: bool = False) -> DataFrame:
    """rows (target, s, ...) with before_x for each x of sums: its total over the target's rows before this one by s.

    A target's scores are cut at approximate percentiles; the buckets' totals are carried on and the window inside
    a bucket does the rest, so a single target is the work of a hundred tasks. The cuts don't affect the result."""
    cuts = F.percentile_approx("s", F.array(*(F.lit(i / 100) for i in range(1, 100))), 2000)
    bounds = cut(rows.groupBy("target").agg(cuts.alias("_cuts")), "score-cuts")  # written: both readers below must see the same cuts
    rows = rows.join(bounds, "target").withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("s")))).drop("_cuts")
    order = F.desc if descending else F.asc
    carry = Window.partitionBy("target").orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("target", "_bucket").orderBy(order("s")).rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("target", "_bucket").agg(*(F.sum(x).alias(f"_t_{x}") for x in sums))
    per = per.select("target", "_bucket", *(F.coalesce(F.sum(f"_t_{x}").over(carry), F.lit(0)).alias(f"_c_{x}") for x in sums))
    rows = rows.join(per, ["target", "_bucket"])
    return rows.withColumns({f"before_{x}": F.col(f"_c_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})


def auroc(df: DataFrame, target: str, truth: str, score: str) -> DataFrame:
    """(target, auroc) by the rank sum with average ranks for ties; targets with one class only are skipped."""
    ranked = _before(_by_score(df, target, truth, score), ["n"])
    sums = ranked.groupBy("target").agg(F.sum(F.col("pos") * (F.col("before_n") + (F.col("n") + 1) / 2)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return sums.filter("p > 0 AND q > 0").select("target", ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auroc"))


def average_precision(df: DataFrame, target: str, truth: str, score: str) -> DataFrame:
    """(target, ap): the sum over distinct scores, from the highest, of recall gained times precision."""
    ranked = _before(_by_score(df, target, truth, score), ["pos", "n"], descending=True)
    hits, seen = F.col("before_pos") + F.col("pos"), F.col("before_n") + F.col("n")
    sums = ranked.groupBy("target").agg(F.sum(F.col("pos") * hits / seen).alias("a"), F.sum("pos").alias("p"))
    return sums.filter("p > 0").select("target", (F.col("a") / F.col("p")).alias("ap"))


def _ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(target, value, out): the average rank of each distinct value within its target."""
    counts = df.groupBy("target", F.col(value).alias("s")).agg(F.count("*").alias("n"))
    return _before(counts, ["n"]).select("target", F.col("s").alias(value), (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))


def regression(df: DataFrame, target: str, truth: str, predicted: str) -> DataFrame:
    """(target, n, r2, rmse, spearman) over rows where both are known."""
    known = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(F.col(target).alias("target"), F.col(truth).cast("double").alias("y"), F.col(predicted).cast("double").alias("p"))
    y, p = F.col("y"), F.col("p")
    ranked = known.join(_ranks(known, "y", "ry"), ["target", "y"]).join(_ranks(known, "p", "rp"), ["target", "p"])
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count("*")
    return ranked.groupBy("target").agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum((y - p) * (y - p)), total)).alias("r2"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), correlation(F.col("ry"), F.col("rp")).alias("spearman")
    )


def robust(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, spread): the exact median and 1.4826 times the median deviation from it."""
    mid = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    away = df.join(mid, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return away.groupBy(*by, "median").agg((1.4826 * F.percentile("_d", F.lit(0.5))).alias("spread"))


def plane_terms(x: Column, y: Column, z: Column) -> list[Column]:
    """The sums that a plane fit needs."""
    names = {"n": F.lit(1), "sx": x, "sy": y, "sz": z, "sxx": x * x, "sxy": x * y, "syy": y * y, "sxz": x * z, "syz": y * z, "szz": z * z}
    return [F.sum(c.cast("double")).alias(k) for k, c in names.items()]


def plane_fit(df: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """(by, n, slope_x, slope_y, offset, sd): least squares z = offset + slope_x x + slope_y y by centred moments."""
    m = df.groupBy(*by).agg(*plane_terms(F.col(x), F.col(y), F.col(z)))
    c = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    m = m.withColumns({"cxx": c("sx", "sx", "sxx"), "cxy": c("sx", "sy", "sxy"), "cyy": c("sy", "sy", "syy"), "cxz": c("sx", "sz", "sxz"), "cyz": c("sy", "sz", "syz"), "czz": c("sz", "sz", "szz")})
    det = F.expr("cxx * cyy - cxy * cxy")
    m = m.withColumns({"slope_x": F.try_divide(F.expr("cxz * cyy - cyz * cxy"), det), "slope_y": F.try_divide(F.expr("cyz * cxx - cxz * cxy"), det)})
    m = m.withColumn("offset", F.expr("(sz - slope_x * sx - slope_y * sy) / n"))
    rss = F.greatest(F.expr("czz - slope_x * cxz - slope_y * cyz"), F.lit(0.0))
    return m.select(*by, F.col("n").cast("long").alias("n"), "slope_x", "slope_y", "offset", F.when(F.col("n") > 3, F.sqrt(rss / (F.col("n") - 3))).alias("sd"))

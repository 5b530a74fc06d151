"""URL rules by host-suffix and path-prefix expressions.

Each url expands into the expressions host suffix (whole labels) + path prefix. Which suffixes (by number of
labels) and prefixes (by length) can occur in a rule is read from the rules, so no expression is missed and
none is made in vain. Expressions meet the rules on the first bytes of their SHA-256; full digests confirm the
match, and of a url's confirmed rules the one with the longest host + path wins (then the longer host; then
block over allow). Urls that no rule fits get the default verdict.

The rules' side is sent to every task only while it is small; beyond that the join shuffles, with the url side
reduced to different (host, path) pairs first, so a hot page counts once.

Rules say allow or block: any other verdict is an error, as a page must not pass by a word that nothing reads.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; an empty rule
table allows all; repeated rules count once; repeated rows each get a row; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a digest that expressions are joined on.
PREFIX = 4
#: Rules that may be sent to every task.
SMALL = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rules: (host, path, verdict)."""
    if odd := rules.filter("NOT coalesce(verdict IN ('allow', 'block'), false)").select("verdict").distinct().limit(3).collect():
        raise ValueError(f"rules say allow or block, not {[r.verdict for r in odd]}")
    rules = rules.filter("host IS NOT NULL AND host <> '' AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"digest": _digest(F.col("host"), F.col("path")), "labels": F.size(F.split("host", r"\.")), "chars": F.length("path")})
    # the shapes that rules have: bounded by the labels of a host and the characters of a path
    shapes = rules.groupBy().agg(F.collect_set("labels").alias("l"), F.collect_set("chars").alias("c"), F.count("*").alias("n")).first()
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes.n:
        return at.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    few = shapes.n <= SMALL
    labels = F.split("host", r"\.")
    suffix = lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k))
    prefix = lambda k: F.substring(F.col("path"), F.lit(1), k)
    hosts = F.filter(F.array(*map(F.lit, sorted(shapes.l))), lambda k: k <= F.size(labels))
    paths = F.filter(F.array(*map(F.lit, sorted(shapes.c))), lambda k: k <= F.length("path"))
    made = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _digest(suffix(h), prefix(p)))))
    short = lambda d: F.substring(d, 1, 2 * PREFIX)
    side = rules.select(short(F.col("digest")).alias("short"), F.col("digest").alias("whole"), (F.length("host") + F.length("path")).cast("long").alias("size"), F.length("host").cast("long").alias("hosts"), F.col("verdict").eqNullSafe("block").cast("long").alias("block"))
    # precedence in one long, so that the best rule is a hash aggregation; its lengths say what of the url it is made of
    code = F.shiftleft("size", 32).bitwiseOR(F.shiftleft("hosts", 1)).bitwiseOR(F.col("block"))
    if few:
        own = at.withColumn("n", F.monotonically_increasing_id()).withColumn("digest", F.explode_outer(made)).withColumn("short", short(F.col("digest")))
        best = own.join(F.broadcast(side), "short", "left").groupBy("n", "page_id", "host", "path").agg(F.max(F.when(F.col("whole") == F.col("digest"), code)).alias("code"))
    else:
        each = at.select("host", "path").distinct().withColumn("digest", F.explode(made)).withColumn("short", short(F.col("digest")))
        found = each.join(side, "short").filter("whole = digest").groupBy("host", "path").agg(F.max(code).alias("code"))
        best = at.join(found, ["host", "path"], "left")
    hosts, size = F.shiftright("code", 1).bitwiseAND((1 << 31) - 1).cast("int"), F.shiftright("code", 32).cast("int")
    rule = F.when(F.col("code").isNotNull(), F.concat(F.right("host", hosts), F.left("path", size - hosts)))
    verdict = F.when(F.col("code").isNull(), default).when(F.col("code").bitwiseAND(1) == 1, "block").otherwise("allow")
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

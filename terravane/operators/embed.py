"""Embedding tables: pooling, spread, neighbours, random features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.text import dot, unit

#: Rows of a block of queries or of candidates.
BLOCK = 2048


def to_wide(df: DataFrame, vector: str, n: int, prefix: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != vector), *(F.col(vector)[i].alias(f"{prefix}{i:02d}") for i in range(n)))


def from_wide(df: DataFrame, prefix: str, vector: str) -> DataFrame:
    own = sorted(c for c in df.columns if c.startswith(prefix))
    return df.select(*(c for c in df.columns if c not in own), F.array(*own).alias(vector))


def pooled(df: DataFrame, by: list[str], vector: str, valid: Column | None = None) -> DataFrame:
    """The unit vector along the mean of each group's valid vectors."""
    if valid is not None:
        df = df.filter(valid)
    each = df.select(*by, F.posexplode(vector).alias("_i", "_v"))
    means = each.groupBy(*by, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(unit(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])).alias(vector))


def spread(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, n, mean_cosine): the mean cosine of a group's pairs, from one sum: (|sum u|^2 - n) / (n (n - 1))."""
    each = df.select(*by, unit(F.col(vector)).alias("_u")).filter(F.col("_u").isNotNull())
    sums = each.select(*by, F.posexplode("_u").alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("_s"), F.count("*").alias("n"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_q")).select(*by, "n", F.try_divide(F.col("_q") - F.col("n"), F.col("n") * (F.col("n") - 1)).alias("mean_cosine"))


#: Bytes of the vectors of one side that may be sent to every task.
SMALL_SIDE = 64 << 20


def _best(k: int):
    """The k most similar rows for each query: one matrix product of two blocks."""

    def run(ids: np.ndarray, a: np.ndarray, rows: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        if not len(ids) or not len(rows):
            return pd.DataFrame({"qid": [], "rid": [], "cosine": []}).astype({"qid": "int64", "rid": "int64"})
        with np.errstate(invalid="ignore", divide="ignore"):
            sim = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        at = np.argsort(-np.round(sim, 12), axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"qid": np.repeat(ids, at.shape[1]), "rid": rows[at].ravel(), "cosine": np.take_along_axis(sim, at, 1).ravel()}).dropna()

    return run


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str) -> DataFrame:
    """(query_id, row_id, cosine, k_rank): each query's k most similar rows, ties by row_id.

    If one side has at most SMALL_SIDE bytes (and it is the stated query set or the index that is small), it goes to
    every task and the other is never shuffled. Otherwise both sides are dealt into blocks and each pair of blocks is
    one matrix product that keeps k rows for each query. Memory is two blocks, whatever the sizes."""
    q = queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    r = rows.select(F.col(row_id).alias("rid"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    (nq, bq), (nr, br) = (d.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("v") + 8), F.lit(0))).first() for d in (q, r))
    best = _best(k)
    stack = lambda d: np.stack(d["v"].to_numpy()).astype(float) if len(d) else np.zeros((0, 1))
    schema = "qid long, rid long, cosine double"
    if min(bq, br) <= SMALL_SIDE:
        fixed = (q if bq <= br else r).toPandas().sort_values("qid" if bq <= br else "rid")
        shared = queries.sparkSession.sparkContext.broadcast((fixed.iloc[:, 0].to_numpy(), stack(fixed)))

        def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = shared.value
            for p in parts:
                for i in range(0, len(ids), BLOCK):  # a product of bounded blocks
                    if bq <= br:
                        p = p.sort_values("rid")
                        yield best(ids[i : i + BLOCK], vectors[i : i + BLOCK], p["rid"].to_numpy(), stack(p))
                    else:
                        yield best(p["qid"].to_numpy(), stack(p), ids[i : i + BLOCK], vectors[i : i + BLOCK])

        parts = (r if bq <= br else q).mapInPandas(near, schema)
    else:
        cq, cr = max(1, -(-nq // BLOCK)), max(1, -(-nr // BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(cq))).withColumn("rb", every(cr))
        right = r.withColumn("rb", F.pmod(F.xxhash64("rid"), F.lit(cr))).withColumn("qb", every(cq))

        def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("rid")
            return best(a["qid"].to_numpy(), stack(a), b["rid"].to_numpy(), stack(b))

        parts = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(pair, schema)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 12)), "rid")
    top = parts.withColumn("k_rank", F.row_number().over(w)).filter(F.col("k_rank") <= k)
    return top.select(F.col("qid").alias(query_id), F.col("rid").alias(row_id), "cosine", "k_rank")


def knn_votes(near: DataFrame, labels: DataFrame, query_id: str, row_id: str, label: str) -> DataFrame:
    """(query_id, predicted): the label with the most weight (cosine, at least 0, + 1e-6), the least on ties; missing labels don't vote."""
    w = F.greatest(F.col("cosine"), F.lit(0.0)) + 1e-6
    votes = near.join(labels.select(row_id, label), row_id).filter(F.col(label).isNotNull()).groupBy(query_id, label).agg(F.sum(w).alias("w"))
    return votes.groupBy(query_id).agg(F.min_by(label, F.struct(-F.round("w", 9), F.col(label))).alias("predicted"))


def knn_mean(near: DataFrame, values: DataFrame, query_id: str, row_id: str, value: str) -> DataFrame:
    """(query_id, predicted): the weighted mean over neighbours whose value is known."""
    w = F.greatest(F.col("cosine"), F.lit(0.0)) + 1e-6
    known = near.join(values.select(row_id, value), row_id).filter(F.col(value).isNotNull())
    return known.groupBy(query_id).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("predicted"))


def knn_presence(near: DataFrame, labels: DataFrame, query_id: str, row_id: str, targets: list[str]) -> DataFrame:
    """(query_id, target, predicted): for each 0/1 column the weighted share of neighbours that have it, those whose
    label is missing left out of both sums."""
    w = F.greatest(F.col("cosine"), F.lit(0.0)) + 1e-6
    joined = near.join(labels.select(row_id, *targets), row_id)
    known = lambda t: F.sum(F.when(F.col(t).isNotNull(), w))
    shares = joined.groupBy(query_id).agg(*((F.coalesce(F.sum(w * F.col(t)), F.lit(0.0)) / F.greatest(F.coalesce(known(t), F.lit(0.0)), F.lit(1e-12))).alias(t) for t in targets))
    return shares.unpivot(query_id, targets, "target", "predicted")


def fourier_weights(n: int, scale: float, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, scale, (n, 3))


def fourier_features(lat: Column, lon: Column, n: int, scale: float, seed: int) -> Column:
    """2n random Fourier features of a location on the unit sphere."""
    w = fourier_weights(n, scale, seed)
    a, b = F.radians(lat), F.radians(lon)
    xyz = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
    angles = [sum((float(c) * x for c, x in zip(row, xyz, strict=True)), F.lit(0.0)) for row in w]
    return F.array(*(F.cos(t) for t in angles), *(F.sin(t) for t in angles))


def collapse(df: DataFrame, vector: str, dim: int) -> dict[str, float]:
    """Effective rank, mean standard deviation and mean cosine of a table of vectors, from its moments (dim x dim)."""

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, u, g = 0, np.zeros(dim), np.zeros(dim), np.zeros((dim, dim))
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy()).astype(float)
                unit_ = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                n, s, u, g = n + len(x), s + x.sum(0), u + unit_.sum(0), g + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "u": [u.tolist()], "g": [g.ravel().tolist()]})

    rows = df.select(F.col(vector).alias("v")).filter(F.col("v").isNotNull()).mapInPandas(moments, "n long, s array<double>, u array<double>, g array<double>").collect()  # one row for each partition
    n = sum(r.n for r in rows)
    mean = np.sum([r.s for r in rows], 0) / n
    cov = np.sum([r.g for r in rows], 0).reshape(dim, dim) / n - np.outer(mean, mean)
    p = np.clip(np.linalg.eigvalsh(cov), 0, None)
    p = p[p > 0] / p.sum()
    whole = np.sum([r.u for r in rows], 0)
    cosine = float((whole @ whole - n) / (n * (n - 1))) if n > 1 else None
    return {"n": n, "mean_cosine": cosine, "effective_rank": float(np.exp(-(p * np.log(p)).sum())), "mean_sd": float(np.sqrt(np.clip(np.diag(cov), 0, None)).mean())}


def similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

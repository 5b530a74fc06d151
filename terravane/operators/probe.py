"""Linear probes: train statistics, weights, ridge by normal equations, logistic fits, selection by folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.operators.splits import seeded_order


def imputed(df: DataFrame, columns: list[str], is_test: str) -> DataFrame:
    """Nulls replaced by the column's exact median over train rows; a column without a train value stays."""
    mid = df.filter(~F.col(is_test)).agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in columns)).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(mid[c])) for c in columns if mid[c] is not None})


def standardised(df: DataFrame, columns: list[str], is_test: str) -> DataFrame:
    """Less the train mean, over the train population deviation; a constant column's deviation counts as 1."""
    stats = df.filter(~F.col(is_test)).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns})


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight = n / (classes * n_class); counts are aggregated and sent back, one row for each class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(counts.crossJoin(F.broadcast(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")  # total is one row


def scoreable(df: DataFrame, label: str, is_test: str, least: int) -> DataFrame:
    """(label, train, test) of the classes with at least so many rows on both sides."""
    return df.groupBy(label).agg(F.count_if(~F.col(is_test)).alias("train"), F.count_if(is_test).alias("test")).filter((F.col("train") >= least) & (F.col("test") >= least))


def scoreable_loosely(df: DataFrame, label: str, part: str, train: str, tests: list[str], least: int) -> DataFrame:
    """(label, n_train, n_<test> of each test part, strict, loose): whether a class has enough rows in train and in each test part, or in all of them together."""
    n = df.groupBy(label).agg(F.count_if(F.col(part) == train).alias("n_train"), *(F.count_if(F.col(part) == t).alias(f"n_{t}") for t in tests))
    own = F.col("n_train") >= least
    each, total = own, F.lit(0)
    for t in tests:
        each, total = each & (F.col(f"n_{t}") >= least), total + F.col(f"n_{t}")
    return n.withColumns({"strict": each, "loose": own & (total >= least)})


def gramian(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(i, j, value) of X'X and X'y for [1, features, target], upper triangle, in one aggregation."""
    terms = {"one": F.lit(1.0), **{f: F.col(f).cast("double") for f in features}, target: F.col(target).cast("double")}
    names = list(terms)
    sums = df.agg(*(F.sum(terms[a] * terms[b]).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))
    rows = [f"'{a}', '{b}', g{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return sums.select(F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (i, j, value)"))


def ridge(df: DataFrame, features: list[str], target: str, l2: float) -> dict[str, float]:
    """Coefficients of mean squared error / 2 + l2 / 2 |w|^2, the intercept free."""
    names = ["one", *features, target]
    g = np.zeros((len(names),) * 2)
    for r in gramian(df.dropna(subset=[*features, target]), features, target).collect():
        i, j = names.index(r.i), names.index(r.j)
        g[i, j] = g[j, i] = r.value or 0.0
    n, d = g[0, 0], len(features)
    penalty = np.diag([0.0] + [l2 * n] * d)
    w = np.linalg.solve(g[:-1, :-1] + penalty, g[:-1, -1])
    return dict(zip(["intercept", *features], w.tolist(), strict=True))


def vector_ridge_scores(df: DataFrame, vector: str, target: str, is_test: str, key: str, l2: float, dim: int) -> DataFrame:
    """(key, y, predicted) on test rows of a ridge fitted on train rows' vectors: moments by partition, one small solve."""
    from collections.abc import Iterator

    import pandas as pd

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((dim + 2, dim + 2))
        for p in parts:
            if len(p):
                x = np.column_stack([np.ones(len(p)), np.stack(p["v"].to_numpy()).astype(float), p["y"].to_numpy(float)])
                g += x.T @ x
        yield pd.DataFrame({"g": [g.ravel().tolist()]})

    rows = df.select(F.col(vector).alias("v"), F.col(target).cast("double").alias("y"), is_test, key).filter("v IS NOT NULL AND y IS NOT NULL")
    g = np.sum([r.g for r in rows.filter(~F.col(is_test)).select("v", "y").mapInPandas(moments, "g array<double>").collect()], 0).reshape(dim + 2, dim + 2)
    w = np.linalg.solve(g[:-1, :-1] + np.diag([0.0] + [l2 * g[0, 0]] * dim), g[:-1, -1])
    coef = F.array(*map(F.lit, w[1:].tolist()))
    predicted = F.aggregate(F.zip_with("v", coef, lambda a, b: a.cast("double") * b), F.lit(float(w[0])), lambda s, x: s + x)
    return rows.filter(is_test).select(key, "y", predicted.alias("predicted"))


def logistic_scores(df: DataFrame, vector: str, label: str, is_test: str, key: str, l2: float) -> DataFrame:
    """(key, label, predicted) on test rows of a class-weighted softmax fit."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = balanced_weights(df.filter(F.col(label).isNotNull()), label).withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double")))).withColumn("label", F.col(label).cast("double"))
    fit = LogisticRegression(regParam=l2, weightCol="weight", standardization=False, maxIter=100).fit(rows.filter(~F.col(is_test)))
    return fit.transform(rows.filter(is_test)).select(key, F.col(label).alias("truth"), F.col("prediction").cast(df.schema[label].dataType).alias("predicted"))


def sigmoid_scores(df: DataFrame, vector: str, targets: list[str], is_test: str, key: str, l2: float) -> DataFrame:
    """(key, target, truth, predicted) on test rows: for each 0/1 column its own fit, both classes of the same weight.

    Rows whose label is missing are left out of that column's fit; a column with one class only in train predicts its share."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, is_test, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), *targets)
    train = rows.filter(~F.col(is_test))
    counts = train.agg(*(f.alias(f"{n}_{t}") for t in targets for n, f in (("n", F.count(t)), ("p", F.sum(t))))).first()
    out = None
    for t in targets:
        n, p = counts[f"n_{t}"], counts[f"p_{t}"] or 0
        test = rows.filter(is_test)
        if 0 < p < n:
            own = train.filter(F.col(t).isNotNull()).withColumns({"label": F.col(t).cast("double"), "w": F.when(F.col(t) == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))})
            fit = LogisticRegression(regParam=l2, weightCol="w", standardization=False, maxIter=100).fit(own.select("features", "label", "w"))
            score = vector_to_array("probability")[1]
            one = fit.transform(test).select(key, F.lit(t).alias("target"), F.col(t).alias("truth"), score.alias("predicted"))
        else:
            one = test.select(key, F.lit(t).alias("target"), F.col(t).alias("truth"), F.lit(p / n if n else 0.0).alias("predicted"))
        out = one if out is None else out.unionByName(one)
    return out


def chosen_l2(df: DataFrame, features: list[str], target: str, key: str, grid: list[float], k: int = 3, seed: int = 11) -> float:
    """The penalty with the least mean squared error over hash folds, the stronger on ties."""
    fold = F.pmod(F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("long"), F.lit(k))
    df = df.withColumn("_fold", fold)
    losses = {}
    for l2 in grid:
        loss = 0.0
        for i in range(k):
            w = ridge(df.filter(F.col("_fold") != i), features, target, l2)
            p = sum((F.col(f) * w[f] for f in features), F.lit(w["intercept"]))
            loss += df.filter(F.col("_fold") == i).agg(F.avg((F.col(target) - p) ** 2)).first()[0] or 0.0
        losses[l2] = loss
    return min(grid, key=lambda v: (round(losses[v], 12), -v))

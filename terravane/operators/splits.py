"""Stable hold-outs: whether a block or unit is test depends on its id and the seed alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.functions.text import md5_uniform

# fixed values of the split protocol
SEED, DEGREES, FRACTION = 20261029, 0.25, 0.5


def blake_uniform(key: str) -> float:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") / 2.0**64


def _blake(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(u=b["key"].map(blake_uniform))


def uniform(df: DataFrame, key: Column, how: str = "blake2b") -> DataFrame:
    """df with u in [0, 1) from key; blake2b runs once for each distinct key and is joined back."""
    if how == "md5":
        return df.withColumn("u", md5_uniform(key))
    keyed = df.withColumn("key", key)
    found = keyed.select("key").distinct().mapInPandas(_blake, "key string, u double")
    return keyed.join(found, "key", "left").drop("key")


def spatial_split(df: DataFrame, group: str | None = None, degrees: float = DEGREES, fraction: float = FRACTION, seed: int = SEED, how: str = "blake2b") -> DataFrame:
    """df with block and is_test; rows of a group go with the block of its mean location."""
    lat, lon = F.col("lat"), F.col("lon")
    if group:
        # sums from partial aggregates, then a join: a window would put a group into one task
        means = df.groupBy(group).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
        df = df.join(means, group, "left")
        lat, lon = F.col("_lat"), F.col("_lon")
    df = df.withColumn("block", geo.block_id(lat, lon, degrees)).drop("_lat", "_lon")
    return uniform(df, F.concat(F.lit(f"{seed}:{degrees}:"), "block"), how).withColumn("is_test", F.col("u") < fraction).drop("u")


def unit_split(df: DataFrame, unit: str, fraction: float = FRACTION, seed: int = SEED, how: str = "blake2b") -> DataFrame:
    """df with is_test; whole units on one side."""
    return uniform(df, F.concat(F.lit(f"{seed}:unit:"), F.col(unit).cast("string")), how).withColumn("is_test", F.col("u") < fraction).drop("u")


def share_warning(df: DataFrame, fraction: float = FRACTION, slack: float = 0.05) -> DataFrame:
    """(share, off): the test share of a split's rows, and whether it misses the fraction by more than slack."""
    return df.agg(F.avg(F.col("is_test").cast("double")).alias("share")).withColumn("off", F.abs(F.col("share") - fraction) > slack)


def split_report(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class in train and test."""
    return df.groupBy(label).agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test"))


def folds(df: DataFrame, row: str, col: str, window: int, k: int) -> DataFrame:
    """Checkerboard folds over a grid of windows."""
    return df.withColumn("fold", F.pmod(F.floor(F.col(row) / window) + 2 * F.floor(F.col(col) / window), F.lit(k)))


def not_leaking(df: DataFrame, unit: str, is_test: str = "is_test") -> DataFrame:
    """Rows whose unit lies on one side only."""
    sides = df.groupBy(unit).agg(F.min(is_test).alias("_lo"), F.max(is_test).alias("_hi")).filter(F.col("_lo") == F.col("_hi")).select(unit)
    return df.join(sides, unit, "left_semi")


def first_n(df: DataFrame, by: list[str], n: int, order: list) -> DataFrame:
    """At most n rows of each group, in order (Spark prunes groups before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def seeded_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that depends on key and seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))

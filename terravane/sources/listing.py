"""Files as rows: candidates, profiles, checksums, indexes by name, nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shortest(paths: list[str], suffix: str) -> str | None:
    """The shortest path with a suffix, the first in order on ties."""
    return min((p for p in paths if p.lower().endswith(suffix.lower())), key=lambda p: (len(p), p), default=None)


def listed(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, name, bytes, modified) of the files that a pattern matches; contents are not read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of the files that a pattern matches."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_index(files: DataFrame, name: str, size: str, key: dict[str, Column]) -> DataFrame:
    """The largest file of each key read from the names, by name on ties; names that give no key are left out."""
    keyed = files.withColumns(key)
    for k in key:
        keyed = keyed.filter(F.col(k).isNotNull())
    return keyed.groupBy(*key).agg(F.max_by(F.struct(name, size), F.struct(size, name)).alias("f")).select(*key, "f.*")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_columns): one count for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.union(one)
    return out


def results(spark: SparkSession, pattern: str, items: str, key: str) -> tuple[DataFrame, DataFrame]:
    """JSON results as two tables: one row for each file, and one for each of its nested items, without repeats."""
    raw = spark.read.json(pattern)
    units = raw.drop(items).dropDuplicates([key])
    return units, raw.select(key, F.explode(items).alias("i")).select(key, "i.*").distinct()

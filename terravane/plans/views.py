"""Derived views over the star-schema tables: sites, footprints, points, detections, rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS site_id",
        "25.0D + ((c_custkey * 7919) % 2400) / 100.0D AS lat",
        "-124.0D + ((c_custkey * 104729) % 5600) / 100.0D AS lon",
        "CAST(2005 + c_custkey % 18 AS INT) AS year",
        "c_mktsegment AS label",
        "c_nationkey AS grp",
        "c_acctbal AS y",
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diamonds as closed rings, with their bounding boxes."""
    f = table(spark, sf_dir, "supplier").selectExpr(
        "s_name AS name",
        "s_suppkey AS ordinal",
        "-124.0D + (s_suppkey * 37) % 50 AS xmin",
        "25.0D + (s_suppkey * 13) % 20 AS ymin",
        "6.0D + s_suppkey % 7 AS w",
        "5.0D + s_suppkey % 5 AS h",
        "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(2008 + s_suppkey % 15 AS INT) END AS collection_year",
    )
    corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    ring = F.array(corner("xmin", "ymin + h / 2"), corner("xmin + w / 2", "ymin"), corner("xmin + w", "ymin + h / 2"), corner("xmin + w / 2", "ymin + h"), corner("xmin", "ymin + h / 2"))
    return f.withColumns({"rings": F.array(ring), "xmax": F.expr("xmin + w"), "ymax": F.expr("ymin + h")})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 50 AS cloud_id",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "((l_partkey * 31 + l_linenumber * 17) % 2000) / 10.0D - 100.0D AS x",
        "((l_suppkey * 53 + l_orderkey * 7) % 2000) / 10.0D - 100.0D AS y",
        "l_quantity AS z",
        "l_quantity / 2.0D AS hag",
        "CAST(FLOOR(l_extendedprice) AS BIGINT) % 65536 AS intensity",
        "CAST(1 + l_linenumber % 3 AS INT) AS return_number",
        "CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 7 END AS classification",
    )


#: The columns that order points without ties.
POINT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("deployment"), F.col("event_type").alias("species"), "event_id", F.col("ts").cast("timestamp").alias("start_ts"), F.col("value").alias("dur_s")
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each order: a cell, a year and a size."""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS file_id", "o_custkey % 40 AS cell", "year(o_orderdate) AS year", "o_totalprice AS size")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS visit_id", "o_custkey AS site_id", "CAST(o_orderdate AS DATE) AS day", "o_orderpriority AS label")

"""SQL functions of the engine, as SQL-bodied temporary functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and arguments, result type, body.
FUNCTIONS = [
    ("n_decimals(s STRING)", "INT", r"length(regexp_replace(coalesce(split_part(s, '.', 2), ''), '0+$', ''))"),
    ("utm_zone(lon DOUBLE)", "INT", "CAST(floor((lon + 180) / 6) % 60 + 1 AS INT)"),
    ("block_id(lat DOUBLE, lon DOUBLE, degrees DOUBLE)", "STRING", "concat(CAST(CAST(floor(lat / degrees) AS BIGINT) AS STRING), '_', CAST(CAST(floor(lon / degrees) AS BIGINT) AS STRING))"),
    ("md5_uniform(k STRING)", "DOUBLE", "CAST(conv(substr(md5(k), 1, 13), 16, 10) AS BIGINT) / 4503599627370496.0D"),
    ("dequantised(v DOUBLE)", "DOUBLE", "CASE WHEN v <> -128 THEN sign(v) * pow(v / 127.5D, 2) END"),
    ("valid_coordinates(lat DOUBLE, lon DOUBLE)", "BOOLEAN", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"),
    ("window_gap(y INT, low INT, high INT)", "INT", "greatest(low - y, 0) + greatest(y - high, 0)"),
    ("metres(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)", "DOUBLE", "sqrt(pow((lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) * 111320.0D, 2) + pow((lat2 - lat1) * 111320.0D, 2))"),
]


def register(spark: SparkSession) -> list[str]:
    """Create them in the session; their names."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.partition("(")[0] for s, *_ in FUNCTIONS]

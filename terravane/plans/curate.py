"""A located table from raw rows to a matched, split evaluation table, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import funnel, match, splits

#: Columns that every evaluation table has, and their types.
CONTRACT = {"lat": "double", "lon": "double", "year": "int", "is_test": "boolean", "product_name": "string", "collection_year": "int", "year_diff": "int", "site_id": "string"}


@dataclass
class Curation:
    """How a table becomes an evaluation table."""

    key: str
    steps: list[tuple[str, Column]]
    most_gap: int = 3
    group: str | None = None
    hash: str = "blake2b"
    keep: list[str] = field(default_factory=list)

    def counts(self, raw: DataFrame, footprints: DataFrame) -> DataFrame:
        """(step_no, step, n, dropped) of the filters and of the match, from one pass over matched rows."""
        matched = self._matched(raw, footprints)
        return funnel.funnel(matched, [*self.steps, ("covered", F.col("name").isNotNull()), ("near_in_time", F.col("gap") <= self.most_gap)])

    def _matched(self, raw: DataFrame, footprints: DataFrame) -> DataFrame:
        return match.matched_sites(raw, footprints)

    def table(self, raw: DataFrame, footprints: DataFrame) -> DataFrame:
        """The evaluation table: filtered before the match, so that the join sees only rows that may stay."""
        rows = funnel.filtered(raw, self.steps)
        matched = self._matched(rows, footprints).filter((F.col("name").isNotNull()) & (F.col("gap") <= self.most_gap))
        out = splits.spatial_split(matched, group=self.group, how=self.hash)
        out = out.withColumn("site_id", geo.site_id(F.col("name"), F.col("lat"), F.col("lon"))).withColumnRenamed("name", "product_name")
        return out.select(self.key, *self.keep, *(F.col(c).cast(t).alias(c) for c, t in CONTRACT.items()))


def contract_errors(df: DataFrame, key: str) -> list[str]:
    """What an evaluation table lacks: columns, types, unique keys, values, and splits that hold both sides."""
    types, errors = dict(df.dtypes), []
    for c, t in CONTRACT.items():
        if c not in types:
            errors.append(f"no column {c}")
        elif types[c] != t:
            errors.append(f"{c} is {types[c]}, not {t}")
    if errors:
        return errors
    n = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.count_if(F.col("is_test")).alias("test"), F.count_if(~funnel.valid_coordinates(F.col("lat"), F.col("lon"))).alias("off"), F.max(F.abs("year_diff")).alias("gap")).first()
    checks = {"keys repeat or are null": n.keys != n.n, "a side of the split is empty": n.n > 0 and n.test in (0, n.n), "coordinates are out of range": n.off > 0}
    return [message for message, wrong in checks.items() if wrong]

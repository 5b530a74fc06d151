"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.runtime import cut, discard


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, comp): each vertex of the edges (a, b) with the least id it reaches.

    Labels move to the least of a vertex's neighbours' labels and then jump along labels; every round is
    written, so lineage stays short and lost executors cost no more than a round. A hub's neighbours are joined,
    never collected."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), f"{name}-0")
    i = 0
    while True:
        i += 1
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        low = labels.join(seen, "id").select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        new = cut(low.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "was"), f"{name}-{i}")
        done = new.filter("comp <> was").isEmpty()
        discard(labels)
        labels = new
        if done:
            discard(both)
            out = labels.select("id", "comp")
            out._terravane_path = labels._terravane_path  # so that discard() finds it
            return out

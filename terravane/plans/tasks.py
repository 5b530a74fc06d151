"""Evaluation tasks: what is predicted, from which rows, and how it is scored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.text import clipped_year
from terravane.operators import metrics, probe
from terravane.operators.extra import where

KINDS = ("multiclass", "multilabel", "regression")


@dataclass(frozen=True)
class Task:
    """A task over a table with is_test: label is the class, the 0/1 columns' prefix, or the target."""

    name: str
    kind: str
    label: str
    rows: str = ""
    least: int = 20
    description: str = ""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.kind} is none of {KINDS}")

    def select(self, table: DataFrame) -> DataFrame:
        """Its rows: those of the row query, with classes that both sides have often enough."""
        df = table.filter(where(self.rows)) if self.rows else table
        if self.kind != "multiclass":
            return df
        return df.join(probe.scoreable(df, self.label, "is_test", self.least).select(self.label), self.label, "left_semi")

    def long(self, table: DataFrame, key: str) -> DataFrame:
        """(key, target, truth): for a multilabel task one row for each label column."""
        if self.kind == "multilabel":
            own = [c for c in table.columns if c.startswith(self.label)]
            return table.unpivot([key, "is_test"], own, "target", "truth")
        return table.select(key, "is_test", F.lit(self.name).alias("target"), F.col(self.label).alias("truth"))

    def score(self, predictions: DataFrame) -> DataFrame:
        """(task, metric, value) from (target, truth, predicted)."""
        if self.kind == "multiclass":
            m = metrics.multiclass(predictions, "truth", "predicted")
        elif self.kind == "multilabel":
            a = metrics.auroc(predictions, "target", "truth", "predicted").agg(F.avg("auroc").alias("mean_auroc"), F.count("*").cast("double").alias("n_targets"))
            m = a.crossJoin(metrics.average_precision(predictions, "target", "truth", "predicted").agg(F.avg("ap").alias("mean_ap")))  # one row each
        else:
            m = metrics.regression(predictions, "target", "truth", "predicted").agg(F.avg("r2").alias("mean_r2"), F.avg("rmse").alias("mean_rmse"), F.avg("spearman").alias("mean_spearman"))
        return m.unpivot([], m.columns, "metric", "value").select(F.lit(self.name).alias("task"), "metric", "value")


# fixed values: the classification, occurrence and regression tasks by table, label columns, row query
_LEVELS = ("formation", "division", "macrogroup", "group")
_RANGELAND = ["TotalFoliarCover", "BareSoilCover", "AH_ShrubCover", "AH_SagebrushCover", "AH_GrassCover", "AH_ForbCover", "FH_TreeCover", "AH_InvasiveCover", "AH_PJCover", "Hgt_Woody_Avg", "Hgt_Herbaceous_Avg", "NumSpp_Total"]
_MATCHED = "product_name_AWS.notna()"
_PUBLISHED = "split in ['train', 'test']"


@dataclass(frozen=True)
class Spec:
    """Where a task's rows and labels come from: a registry table, a row query, and label columns (or a prefix, or all but some)."""

    name: str
    kind: str
    table: str
    labels: tuple[str, ...] = ()
    prefix: str = ""
    rows: str = ""
    year: tuple[str, ...] = ("year",)
    site: str = ""
    pair: tuple[str, str] = ("", "")

    def columns(self, table: DataFrame, known: list[str]) -> list[str]:
        """The label columns of a table: those named, those of the prefix, or all that are not known ones."""
        if self.labels:
            return list(self.labels)
        return [c for c in table.columns if c.startswith(self.prefix)] if self.prefix else [c for c in table.columns if c not in known]

    def frame(self, table: DataFrame, lat: str, lon: str, is_test: str, known: list[str], first: int = 2017, last: int = 2025) -> DataFrame:
        """(key columns lat, lon, year, emb_year, is_test, then the labels: label, a 0/1 column for each species, or targets).

        A site task has one row for each site with the mean year of its rows and the species ever counted there."""
        df = table.filter(where(self.rows)) if self.rows else table
        year = sum((F.col(c).cast("double") for c in self.year), F.lit(0.0)) / len(self.year)
        if self.site:
            species, count = self.pair
            df = df.filter(F.col(count) > 0)
            names = sorted(r[0] for r in df.select(species).filter(F.col(species).isNotNull()).distinct().collect())  # species of a table
            wide = df.groupBy(self.site).pivot(species, names).agg(F.lit(1))
            own = df.groupBy(self.site).agg(F.min(lat).alias(lat), F.min(lon).alias(lon), F.avg(year).alias("year"), F.min(is_test).alias(is_test))
            df = own.join(wide, self.site).select(lat, lon, "year", is_test, *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names))
            return self._shaped(df, lat, lon, F.col("year"), is_test, [F.col(f"`{n}`").alias(n) for n in names], first, last)
        own = self.columns(df, known)
        if self.kind == "multiclass":
            df = df.filter(F.col(own[0]).isNotNull())
            return self._shaped(df, lat, lon, year, is_test, [F.col(own[0]).cast("string").alias("label")], first, last)
        if self.kind == "multilabel":
            cut = len(self.prefix)
            return self._shaped(df, lat, lon, year, is_test, [(F.col(f"`{c}`") > 0).cast("int").alias(c[cut:]) for c in own], first, last)
        return self._shaped(df, lat, lon, year, is_test, [F.col(f"`{c}`") for c in own], first, last)

    @staticmethod
    def _shaped(df: DataFrame, lat: str, lon: str, year, is_test: str, labels: list, first: int, last: int) -> DataFrame:
        emb = clipped_year(year, first, last)
        return df.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), year.alias("year"), emb.alias("emb_year"), F.col(is_test).cast("boolean").alias("is_test"), *labels)


def clipped_share(frame: DataFrame) -> DataFrame:
    """(frac_year_clipped): how many rows of a task's frame have a year outside the years that there is data of."""
    return frame.agg(F.avg((F.bround("year") != F.col("emb_year")).cast("double")).alias("frac_year_clipped"))


SPECS = [
    Spec("nlcd", "multiclass", "nlcd", ("nlcd_class",), rows="balanced_subset"),
    Spec("lfrdb_ecosys", "multiclass", "lfrdb", ("ecosys",)),
    Spec("lfrdb_nvc_group", "multiclass", "lfrdb", ("nvc_group",)),
    *(Spec(f"nps_vmi_{n}", "multiclass", "nps_vmi", (f"nvc_{n}",), rows=_MATCHED) for n in ("macrogroup", "group")),
    *(Spec(f"vegbench_{n}", "multiclass", "vegbench", (f"survey_{n}",), rows=_PUBLISHED) for n in _LEVELS),
    Spec("bbs_occurrence", "multilabel", "bbs"),
    Spec("butterflies_occurrence", "multilabel", "butterflies", site="EAGLE_site_index", pair=("Reported species name", "count")),
    Spec("snapshot_usa_occurrence", "multilabel", "snapshot_usa", prefix="occ__", year=("first_year", "last_year")),
    Spec("satbird_winter_occupancy", "multilabel", "satbird_winter", prefix="occ__", rows=_PUBLISHED),
    Spec("blm_aim", "regression", "blm_aim", tuple(_RANGELAND)),
    Spec("ofo_trees", "regression", "ofo_trees", ("basal_area_m2ha", "total_trees"), rows=_MATCHED),
]


class Tasks:
    """Tasks by name, and the models that can be run on them."""

    def __init__(self) -> None:
        self.tasks: dict[str, Task] = {}

    def add(self, task: Task) -> Task:
        if task.name in self.tasks:
            raise ValueError(f"{task.name} is registered already")
        self.tasks[task.name] = task
        return task

    def run(self, tables: dict[str, DataFrame], models: dict[str, Callable[[Task, DataFrame], DataFrame]]) -> DataFrame:
        """(model, task, metric, value) of every model on every task with a table."""
        out = None
        for name, task in self.tasks.items():
            if name in tables:
                rows = task.select(tables[name])
                for model, fit in models.items():
                    one = task.score(fit(task, rows)).select(F.lit(model).alias("model"), "task", "metric", "value")
                    out = one if out is None else out.unionByName(one)
        return out


def summary(results: DataFrame, models: list[str]) -> DataFrame:
    """(task, metric, a column for each model, low, high)."""
    wide = results.groupBy("task", "metric").pivot("model", models).agg(F.first("value"))
    ends = results.groupBy("task", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return wide.join(ends, ["task", "metric"]).orderBy("task", "metric")

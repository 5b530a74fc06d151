"""Table scans by suffix, registered tables, provenance, resumable sinks, paged sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


# fixed values: texts that stand for no value
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "#N/A", "-")


def read_table(spark: SparkSession, path: str, text: bool = False, missing: str | tuple[str, ...] = ()) -> DataFrame:
    """A table by its suffix: parquet, json lines, geojson, else csv with a header (as text, where decimals matter).

    Values of a csv that are among missing are null, whichever of them they are; types are then inferred from the rest."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith(".geojson"):
        features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
        return features.select("f.properties.*", F.col("f.geometry").alias("geometry"))
    if low.endswith((".json", ".jsonl", ".ndjson")):
        return spark.read.json(path)
    raw = spark.read.option("header", True).option("inferSchema", not text and not missing).csv(path)
    if not missing:
        return raw
    missing = (missing,) if isinstance(missing, str) else missing
    known = raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*missing), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    if text:
        return known
    numeric = known.agg(*(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in known.columns)).first()
    return known.select(*(F.col(f"`{c}`").cast("double").alias(c) if numeric[c] else F.col(f"`{c}`") for c in known.columns))


@dataclass
class TableSpec:
    """A registered table and the roles of its columns."""

    name: str
    path: str
    id: str
    lat: str | None = None
    lon: str | None = None
    year: str | None = None
    split: str | None = None
    test_values: tuple = (True,)
    notes: str = ""
    columns: tuple[str, ...] = field(default_factory=tuple)

    def read(self, spark: SparkSession, root: str = "", columns: list[str] | None = None) -> DataFrame:
        df = read_table(spark, f"{root}/{self.path}" if root else self.path)
        wanted = columns or list(self.columns)
        return df.select(*wanted) if wanted else df

    def is_test(self) -> Column:
        return F.col(self.split).isin(*self.test_values) if self.split else F.lit(None).cast("boolean")


class Registry:
    """Tables by name; views() makes each a temporary view."""

    def __init__(self) -> None:
        self.tables: dict[str, TableSpec] = {}

    def add(self, spec: TableSpec) -> None:
        if spec.name in self.tables:
            raise ValueError(f"{spec.name} is registered already")
        self.tables[spec.name] = spec

    def views(self, spark: SparkSession, root: str) -> None:
        for name, spec in self.tables.items():
            spec.read(spark, root).createOrReplaceTempView(name)


def with_provenance(df: DataFrame, pattern: str, column: str) -> DataFrame:
    """df with the part of each row's file path that the pattern's group matches."""
    return df.withColumn(column, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def to_nulls(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def union_drifting(parts: list[DataFrame]) -> DataFrame:
    """Tables of different columns, by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest_attempt(manifest: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in manifest.columns if c != key]
    return manifest.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("m")).select(key, "m.*")


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Do work on the rows whose key the table at path lacks, and append; how many there were."""
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    todo = rows.join(done, key, "left_anti") if done is not None else rows
    n = todo.count()
    if n:
        work(todo).write.mode("append").parquet(path)
    return n


def shard(key: Column, n: int = 256) -> Column:
    """The shard of an id: its CRC-32 modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, anchor): links of raw pages, by pattern."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("position", "tag"))
    return each.select("page_id", "position", F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), F.regexp_extract("tag", r">([^<]*)</a>", 1).alias("anchor"))


class _Page(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class _PagedReader(DataSourceReader):
    def __init__(self, total: int, size: int, tries: int, fetch: Callable[[int, int], list[tuple]]):
        self.total, self.size, self.tries, self.fetch = total, size, tries, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Page(o, min(self.size, self.total - o)) for o in range(0, self.total, self.size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import time

        for attempt in range(self.tries):
            try:
                yield from self.fetch(partition.offset, partition.size)
                return
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(0.1 * 2**attempt)


def paged_source(name: str, schema: str, total: int, fetch: Callable[[int, int], list[tuple]], size: int = 500, tries: int = 3) -> type[DataSource]:
    """A data source whose partitions are the pages that fetch(offset, size) returns, each tried again on failure."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return _PagedReader(total, size, tries, fetch)

    return Paged


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a markdown table; one of more rows than most is an error, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no small table")
    line = lambda v: "| " + " | ".join("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in v) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def write_blocks(points: DataFrame, path: str, cell: float, files: int = 8) -> None:
    """Points clustered by square block, so that a square's cut reads the row groups of its blocks alone."""
    own = points.withColumns({"block_i": F.floor(F.col("x") / cell).cast("long"), "block_j": F.floor(F.col("y") / cell).cast("long")})
    own.repartitionByRange(files, "block_i", "block_j").sortWithinPartitions("block_i", "block_j").write.mode("overwrite").parquet(path)


def read_square(spark: SparkSession, path: str, cell: float, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points of a square: blocks by pushed-down bounds, then the exact edges."""
    bound = lambda v: int(v // cell)
    rows = spark.read.parquet(path).filter(F.col("block_i").between(bound(x0), bound(x1)) & F.col("block_j").between(bound(y0), bound(y1)))
    return rows.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).drop("block_i", "block_j")

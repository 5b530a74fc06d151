"""Session helpers: a session for tests and benches, and folders that every executor sees."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session with the settings the engine expects (UTC, adaptive plans)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Arrow functions import it there."""
    sc = spark.sparkContext
    if getattr(sc, "_terravane_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    at = os.path.join(tempfile.mkdtemp(), f"{_PACKAGE.name}.zip")
    Path(at).write_bytes(packed.getvalue())
    sc.addPyFile(at)
    sc._terravane_shipped = True


def arrow_limits(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Bound the Arrow batches that Python workers get, in rows and bytes, so that long texts stay within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a folder of this machine on a local master (tests), else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = getattr(sc, "_terravane_shared", None)
        if not found:
            found = sc._terravane_shared = "file://" + tempfile.mkdtemp(prefix="terravane-")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost no rerun."""
    spark = df.sparkSession
    at = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._terravane_path = at
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing reads them any more; other tables are left alone."""
    for t in tables:
        if at := getattr(t, "_terravane_path", None):
            remove(t.sparkSession, at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

"""Streams: session and tumbling windows, and a bounded pool that reuses items."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from terravane.runtime import remove, scratch, ship


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file-source stream of an events table; event time as a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    # a single file's folder holds other tables, so the name is a glob
    source = spark.readStream.schema(schema).option("pathGlobFilter", name) if name.endswith(".parquet") else spark.readStream.schema(schema)
    return source.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def session_windows(stream: DataFrame, gap: str, late: str, by: list[str]) -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))
    return w.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream has made of all that is there now, from a table in the shared folder."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    spark.conf.set("spark.sql.streaming.metricsEnabled", "false")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, state)
    return spark.read.schema(stream.schema).parquet(out)


def closed(stream: DataFrame, name: str) -> DataFrame:
    """The windows that the watermark has closed, in append mode: state holds open windows only, and rows later than
    the watermark are dropped."""
    return drained(stream, name, "append")


def drained_complete(stream: DataFrame, name: str) -> DataFrame:
    """As drained, with every group that is still open: each batch replaces the table, and state holds all groups, so
    for results that stay small; closed() is bounded by the watermark."""
    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, state)
    return spark.read.schema(stream.schema).parquet(out)


def step(stream: int, item: int, pool: dict[int, int], queue: list[int], draw: int, out: list, size: int, uses: int, draws: int, waiting: int) -> int:
    """One arrival: pool and queue are changed, events are added to out; the number of draws so far."""
    if len(queue) >= waiting:
        out.append((stream, item, "refused", 0))
        return draw
    out.append((stream, item, "fetched", 0))
    queue.append(item)
    for _ in range(draws):
        while queue and len(pool) < size:
            pool[queue.pop(0)] = 0
        while queue and (spent := [i for i, n in pool.items() if n >= uses]):
            gone = max(spent, key=lambda i: (pool[i], -i))
            out.append((stream, gone, "retired", pool.pop(gone)))
            pool[queue.pop(0)] = 0
        held = sorted(pool)
        one = held[zlib.crc32(f"{stream}/{draw}".encode()) % len(held)]
        pool[one] += 1
        draw += 1
        out.append((stream, one, "used", pool[one]))
    return draw


def round_robin(samples: DataFrame, stream: str, place: str, size: int) -> DataFrame:
    """samples with batch and place_in_batch: the streams' samples in turn, size to a batch.

    A sample's turn is its place in its stream, then its stream: a rank from both columns alone, carried over buckets
    of turns, so no task orders all samples."""
    turns = samples.groupBy(F.col(place).alias("_turn")).agg(F.count("*").alias("_n"))
    bucket = F.floor(F.col("_turn") / 1024)
    w = Window.partitionBy("_b").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_b", bucket).withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    per = turns.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = per.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each 1,024 turns
    starts = turns.join(before.select("_b", "_before"), "_b").select(F.col("_turn").alias(place), (F.col("_in") + F.col("_before")).alias("_start"))
    number = F.col("_start") + F.row_number().over(Window.partitionBy(place).orderBy(stream)) - 1
    out = samples.join(starts, place).withColumn("_k", number)
    return out.withColumns({"batch": F.floor(F.col("_k") / size).cast("long"), "place_in_batch": (F.col("_k") % size).cast("int")}).drop("_k", "_start")


class ReusePool(StatefulProcessor):
    """A pool of at most SIZE items for each stream. Arrivals fill it or wait in order; an item retires only once it has
    been used USES times, the most used first, and only if another waits. Each arrival lets DRAWS items be used, drawn
    by a hash of the stream and the draw's number; at most WAITING items wait, and later ones are refused."""

    SIZE, USES, DRAWS, WAITING = 8, 24, 24, 1024

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.uses = handle.getMapState("uses", "item long", "n int")
        self.waiting = handle.getMapState("waiting", "place long", "item long")
        self.drawn = handle.getValueState("drawn", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pool = {k[0]: v[0] for k, v in self.uses.iterator()}
        queue = [v[0] for _, v in sorted((k[0], v) for k, v in self.waiting.iterator())]
        draw = self.drawn.get()[0] if self.drawn.exists() else 0
        out = []
        for part in rows:
            for item in sorted(part["item"].tolist()):
                draw = step(key[0], item, pool, queue, draw, out, self.SIZE, self.USES, self.DRAWS, self.WAITING)
        self.uses.clear()
        self.waiting.clear()
        for item, n in pool.items():
            self.uses.updateValue((item,), (n,))
        for place, item in enumerate(queue):
            self.waiting.updateValue((place,), (item,))
        self.drawn.update((draw,))
        yield pd.DataFrame(out, columns=["stream", "item", "event", "n"])

    def close(self) -> None:
        pass


def reuse_pool(stream: DataFrame) -> DataFrame:
    """(stream, item, event, n) log of a pool for each stream id; needs the RocksDB state store."""
    ship(stream.sparkSession)
    return stream.groupBy("stream").transformWithStateInPandas(ReusePool(), "stream long, item long, event string, n int", "Append", "None")

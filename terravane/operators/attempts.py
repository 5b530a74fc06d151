"""Work that may fail for single rows: a status instead of an exception, and what is left to do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.sources.tables import latest_attempt


def attempted(df: DataFrame, key: str, fn: Callable[[dict], float | None], tries: int = 1) -> DataFrame:
    """(key, status, value, error, seconds, n_tries): fn of each row; 'ok', 'empty' for None, or 'error' after so many tries."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for p in parts:
            rows = []
            for row in p.to_dict("records"):
                start, error, value, n = time.perf_counter(), None, None, 0
                for n in range(1, tries + 1):
                    try:
                        value, error = fn(row), None
                        break
                    except Exception as e:  # the row's status says so
                        error = f"{type(e).__name__}: {e}"[:500]
                status = "error" if error else "empty" if value is None else "ok"
                rows.append((row[key], status, value, error, time.perf_counter() - start, n))
            yield pd.DataFrame(rows, columns=[key, "status", "value", "error", "seconds", "n_tries"]).astype({"value": "float64"})

    return df.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, status string, value double, error string, seconds double, n_tries int")


def outcome(manifest: DataFrame, key: str, at: str) -> DataFrame:
    """(status, n) over the latest attempt of each key."""
    return latest_attempt(manifest, key, at, "status").groupBy("status").agg(F.count("*").alias("n"))


def left_to_do(rows: DataFrame, manifest: DataFrame, key: str, at: str, final: tuple[str, ...] = ("ok", "empty")) -> DataFrame:
    """Rows whose latest attempt is missing or not final."""
    done = latest_attempt(manifest, key, at, "status").filter(F.col("status").isin(*final)).select(key)
    return rows.join(done, key, "left_anti")

"""Tables that are built once and guarded by the configuration they were built with."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.lanes import exists


class StaleCache(ValueError):
    pass


def _sidecar(spark: SparkSession, path: str) -> dict | None:
    side = f"{path}.regime"
    if not exists(spark, side):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(side).collect()))  # one line


def build_or_load(spark: SparkSession, path: str, regime: Mapping[str, object], build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; built if it is absent, refused if it was built under another regime."""
    if exists(spark, path):
        known = _sidecar(spark, path)
        if known is not None and known != dict(regime):
            raise StaleCache(f"{path} was built with {known}, not {dict(regime)}")
        return spark.read.parquet(path)
    build().write.parquet(path)
    spark.createDataFrame([(json.dumps(dict(regime), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.regime")
    return spark.read.parquet(path)


def fill_missing(spark: SparkSession, path: str, keys: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache at ``path`` after what it lacked of ``keys`` was computed and appended."""
    missing = keys.select(key).distinct()
    if exists(spark, path):
        missing = missing.join(spark.read.parquet(path).select(key), key, "left_anti")
    compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def registry_counts(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(dataset, cached): rows of each cached table, counted from file footers; null where there is none."""
    rows = [(name, spark.read.parquet(path).count() if exists(spark, path) else None) for name, path in sorted(tables.items())]
    return spark.createDataFrame(rows, "dataset string, cached long").orderBy(F.col("dataset"))

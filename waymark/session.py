"""Settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Turns off the reuse of a union's partitioning.

    Seen on 4.1.2: where both sides of a join group one union of equally partitioned frames by its key, groups come
    out several times. Without the setting the union is simply shuffled like any other input.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark

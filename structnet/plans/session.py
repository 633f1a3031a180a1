"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let adaptive execution hash-join where every partition is small.

    The radius join copies points into cells, so its sort is the larger part
    of a sort-merge join. With this setting Spark looks at the shuffled
    sizes: if all partitions of one side stay below the limit it builds hash
    tables, otherwise it sorts and can spill.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark

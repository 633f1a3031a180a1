"""Written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _new_path(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    return f"{folder.rstrip('/')}/structnet-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of the session and read it back.

    For tables that several later steps use: they are computed once, survive
    the loss of executors, and the planner knows their real size. The folder
    is ``spark.checkpoint.dir``, or if that is unset one in the warehouse; all
    executors share both.
    """
    spark = df.sparkSession
    path = _new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Staged:
    """A table that is written part by part, each part by a job of its own."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.path, self.parts = spark, _new_path(spark), 0
        self.schema = spark.createDataFrame([], schema).schema

    def add(self, rows: DataFrame) -> None:
        rows.select(*self.schema.names).write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def table(self) -> DataFrame:
        if not self.parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/part={k}" for k in range(self.parts)))

"""Shared helpers: the text column, Arrow batches, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space; other bytes stay.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text``, null texts as empty ones; any other column is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def text_rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Row by row, so that only one long text is a Python object at a time."""
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in columns), strict=True):
            yield tuple(x.as_py() for x in row)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Output batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_rows(df: DataFrame, f: Callable[..., Iterator[tuple]], columns: list[str], ddl: str, arrow: pa.Schema, size: int = 2000) -> DataFrame:
    """``mapInArrow`` of a generator that takes an iterator of row tuples and gives row tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(f(text_rows(batches, *columns)), arrow, size)

    return df.select(*columns).mapInArrow(run, ddl)


def signed(x: int) -> int:
    """An unsigned 64-bit number as Spark holds it."""
    return x - (1 << 64) if x >> 63 else x


def text_hash(text: str) -> int:
    """What ``xxhash64`` of Spark gives for a text."""
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` named by ``kept(doc_id, text_hash)``, one of each, with all their columns. A null id names rows without one."""
    names = ["__llm_none", "__llm_id", "__llm_hash"]
    parts = lambda text_hash: [F.isnull("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), text_hash]
    kept = kept.select(*(c.alias(n) for c, n in zip(parts(F.col("text_hash")), names, strict=True)))
    rows = docs.withColumns(dict(zip(names, parts(F.xxhash64(F.coalesce("text", F.lit("")))), strict=True))).join(kept, names, "left_semi")
    return rows.dropDuplicates(names).select(*(f"`{c}`" for c in docs.columns))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all shuffle partitions, for small rows that much work follows from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared checkpoint folder, so that a lost executor costs no earlier work.

    The folder is the session's ``spark.checkpoint.dir``; only if that is unset, one beside the warehouse is taken.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(at)
    return df.checkpoint(eager=True)


#: Rows of a few longs that are worth a task.
TASK_ROWS = 20_000


def written_rows(df: DataFrame) -> DataFrame:
    """As :func:`written`, for rows of a few longs. A small table is read by few tasks, each of which would leave files of its own in every shuffle."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out.coalesce(max(1, -(-seen.get["n"] // TASK_ROWS)))

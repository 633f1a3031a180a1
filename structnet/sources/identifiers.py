"""Which structure id a file gets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.functions import rules


def valid_ids(headers: DataFrame) -> DataFrame:
    """Distinct upper-case four-character ids of sequence headers (column ``header``, no ``>``)."""
    first = F.substring_index(F.regexp_extract("header", r"^(\S+)", 1), "_", 1)
    return headers.select(F.upper(first).alias("pdb_id")).filter(F.length("pdb_id") == 4).distinct()


def resolve_ids(files: DataFrame, content_ids: DataFrame, valid: DataFrame) -> DataFrame:
    """Add ``pdb_id``: from the name, else from the content, else the upper-case stem.

    The first two count only if they are valid ids. ``files`` has
    ``source, file_path``, ``content_ids`` has ``source, content_id``. Files
    without an id join on a key of their own, which no id equals because of
    its blanks, so they are not gathered under the null key.
    """
    path = F.col("file_path")
    key = lambda c: F.coalesce(c, F.concat(F.lit("no id "), F.col("source")))
    named = valid.select(F.col("pdb_id").alias("_name_id"), F.lit(True).alias("_name_ok"))
    inside = valid.select(F.col("pdb_id").alias("_content_id"), F.lit(True).alias("_content_ok"))
    short = F.when(F.length("content_id") == 4, F.col("content_id"))
    return (files.withColumn("_name_id", key(rules.id_from_name(path)))
            .join(content_ids.select("source", short.alias("_content_id")), "source", "left")
            .withColumn("_content_id", key(F.col("_content_id")))
            .join(named, "_name_id", "left").join(inside, "_content_id", "left")
            .withColumn("pdb_id", F.coalesce(F.when(F.col("_name_ok"), F.col("_name_id")),
                                             F.when(F.col("_content_ok"), F.col("_content_id")),
                                             F.upper(rules.stem(path))))
            .select(*files.columns, "pdb_id"))

"""Lookup files: cross-references, protein names and sequence headers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structnet.functions import rules
from structnet.operators.dedup import last_wins
from structnet.sources.manifest import file_order, scanned_path


def row_order() -> Column:
    """Orders the rows of a lookup, also of one that is a folder of parts: by file name, then within the file."""
    return F.struct(scanned_path().alias("path"), file_order().alias("row"))


def read_xref(spark: SparkSession, path: str, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``map_key, uniprot_id`` of a tab-separated file; short rows are skipped, the last row of a key wins.

    ``keep`` may leave out keys that nobody asks for, before the last row of each is looked for.
    """
    fields = F.split("value", "\t")
    rows = (spark.read.text(path).select(row_order().alias("at"), fields.alias("f"))
            .filter(F.size("f") >= 3)
            .select("at", rules.lookup_key(F.trim(F.col("f")[0]), F.trim(F.col("f")[1])).alias("map_key"),
                    F.trim(F.regexp_replace(F.col("f")[2], "\r", "")).alias("uniprot_id")))
    return last_wins(keep(rows), ["map_key"], ["at"], ["uniprot_id"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``at, header`` (without ``>``) and ``sequence``."""
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    records = (spark.read.option("lineSep", "\n>").text(path)
               .select(row_order().alias("at"), text.alias("text")).filter("text <> ''"))
    rest = F.regexp_extract("text", r"(?s)^[^\n]*\n(.*)$", 1)
    return records.select("at", F.rtrim(F.substring_index("text", "\n", 1)).alias("header"),
                          F.regexp_replace(rest, r"\s", "").alias("sequence"))


def malformed_names(records: DataFrame) -> DataFrame:
    """Headers of protein records without accession or description, which have no name to give."""
    accession, name = _name_fields()
    return records.filter(accession.isNull() | name.isNull()).select("header")


def _name_fields() -> tuple[Column, Column]:
    accession = F.try_element_at(F.split(F.regexp_extract("header", r"^(\S+)", 1), r"\|"), F.lit(2))
    return accession, F.when(F.col("header").contains(" "), F.regexp_extract("header", r"^[^ ]* (.*)$", 1))


def protein_names(records: DataFrame, strict: bool = False) -> DataFrame:
    """``uniprot_id, protein_name, sequence`` of records ``>db|ACC|entry description``; last wins.

    The name is the whole description. A header without accession or
    description is listed by :func:`malformed_names`, or stops the job if ``strict``.
    """
    accession, name = _name_fields()
    rows = records.select("at", accession.alias("uniprot_id"), name.alias("protein_name"), "sequence", "header")
    malformed = F.col("uniprot_id").isNull() | F.col("protein_name").isNull()
    if strict:
        problem = F.raise_error(F.concat(F.lit("malformed header: "), F.col("header"))).cast("string")
        rows = rows.withColumn("uniprot_id", F.when(malformed, problem).otherwise(F.col("uniprot_id")))
    else:
        rows = rows.filter(~malformed)
    return last_wins(rows, ["uniprot_id"], ["at"], ["protein_name", "sequence"])


def sequence_headers(records: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``map_key, info, sequence`` of records ``>id_chain info``; last wins, ``keep`` as in :func:`read_xref`.

    Only ids with exactly one underscore make a key; other records are left out.
    """
    parts = F.split(F.regexp_extract("header", r"^(\S+)", 1), "_")
    info = F.trim(F.regexp_replace(F.regexp_replace("header", r"^\S+", ""), r"\s+", " "))
    rows = (records.withColumn("p", parts).filter(F.size("p") == 2)
            .select("at", rules.lookup_key(F.col("p")[0], F.col("p")[1]).alias("map_key"),
                    info.alias("info"), "sequence"))
    return last_wins(keep(rows), ["map_key"], ["at"], ["info", "sequence"])

"""The list of structure files of a run."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from structnet.functions import rules

#: Listed files that one scan takes. Their names travel through the driver, one batch at a time.
BATCH_FILES = 10_000


def file_order() -> Column:
    """Orders the rows of one scanned file, over all its splits.

    Splits may be planned in any order, but within a split rows are read in
    sequence, so the split's start decides first.
    """
    return F.struct(F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def path_key(path: Column) -> Column:
    """A path and the URI Spark reports for it map to the same text."""
    local = F.regexp_replace(path, r"^file:/*(?=/)", "")
    here = F.concat(F.lit(os.getcwd().rstrip("/") + "/"), local)
    return F.when(local.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)"), local).otherwise(here)


def scanned_path(uri: str = "_metadata.file_path") -> Column:
    """``path_key`` of the file a row was read from (the URI is percent-encoded)."""
    return path_key(F.url_decode(F.regexp_replace(uri, r"\+", "%2B")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file_ord, file_path, source`` of a CSV with a ``file_path`` column; duplicates stay.

    ``file_ord`` orders the rows: file (a folder of files counts as one manifest, in name order), split, row. It is a struct, so
    neither the number of files nor their size is limited.
    """
    table = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if "file_path" not in table.columns:
        raise ValueError("the manifest must have a 'file_path' column")
    uri = F.col("_metadata.file_path")
    rows = table.select(uri.alias("uri"), file_order().alias("at"), "file_path")
    # The files are few beside their rows, and Spark sees how few.
    places = spark.createDataFrame(list(enumerate(sorted(_bare(f) for f in table.inputFiles()))), "file int, key string")
    return (rows.withColumn("key", F.regexp_replace("uri", _SCHEME, "/")).join(places, "key")
            .select(F.struct("file", "at.block", "at.row").alias("file_ord"), "file_path", path_key(F.col("file_path")).alias("source")))


_SCHEME = "^file:/*"


def _bare(uri: str) -> str:
    return re.sub(_SCHEME, "/", uri)


def structure_files(manifest: DataFrame) -> DataFrame:
    """Manifest rows with a structure file suffix."""
    return manifest.filter(rules.has_suffix(F.col("file_path")))


# --- listed files -----------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Batch:
    """Some of the listed files: the folders they are in and their names."""

    folders: list[str]
    names: list[str]
    listed: list[str]


def batches(files: DataFrame, size: int = BATCH_FILES) -> Iterator[Batch]:
    """The distinct files of a manifest by folder and name, at most ``size`` at a time on the driver."""
    parts = F.regexp_extract("source", r"^(.*/)([^/]*)$", 1), F.regexp_extract("source", r"^(.*/)([^/]*)$", 2)
    rows = files.where("source IS NOT NULL").select(parts[0].alias("folder"), parts[1].alias("name")).distinct().sort("folder", "name")
    for _, some in groupby(enumerate(rows.toLocalIterator()), lambda r: r[0] // size):
        found = [r for _, r in some]
        yield Batch(list(dict.fromkeys(r.folder for r in found)), list(dict.fromkeys(r.name for r in found)), [r.folder + r.name for r in found])


def name_filter(names: Iterable[str]) -> str:
    """A path filter that lets exactly these file names pass."""
    return "{" + ",".join(re.sub(r"([\\{}\[\],*?])", r"\\\1", n) for n in names) + "}"


def read_listed(spark: SparkSession, batch: Batch, suffixes: tuple[str, ...], line_separator: str) -> DataFrame | None:
    """Text rows of the batch's files that have one of the ``suffixes``, None if there are none.

    Folders are listed, but only files of the batch are opened; folders and files that do not exist are left out. A name
    that is listed in one folder of the batch and lies unlisted in another is kept out by its path.
    """
    names = [n for n in batch.names if n.lower().endswith(suffixes)]
    if not names:
        return None
    reader = spark.read.option("lineSep", line_separator).option("pathGlobFilter", name_filter(names))
    try:
        rows = reader.text(batch.folders)
    except AnalysisException:
        folders = [f for f in batch.folders if _readable(spark, f)]
        if not folders:
            return None
        rows = reader.text(folders)
    # Paths are made once per file, not once per line. The files are those that the driver plans to read.
    files = spark.createDataFrame([(f, _bare(f)) for f in rows.inputFiles()], "uri string, key string").select("key", scanned_path("uri").alias("source"))
    if len(batch.folders) > 1:
        files = files.join(spark.createDataFrame([(p,) for p in batch.listed], "source string"), "source", "left_semi")
    rows = rows.select(F.regexp_replace("_metadata.file_path", _SCHEME, "/").alias("key"), file_order().alias("at"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))
    return rows.join(F.broadcast(files), "key").select("source", "at", "value")


def _readable(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.format("binaryFile").load(folder).schema
    except AnalysisException:
        return False
    return True

"""Structure-like inputs derived from the driver tables (see FIXTURES.md).

A part is a structure, a line number a chain, a line item an atom. All
frames are lazy projections and joins over the whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=64)  # a read lists the folder and opens a footer; once per session is enough
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdb_id(key: str = "l_partkey") -> Column:
    k = F.col(key)
    return (F.when((k % 10 == 9) | (k >= 10000), F.concat(F.lit("MODEL"), k.cast("string")))
            .otherwise(F.lpad(k.cast("string"), 4, "0")))


def chain_name() -> Column:
    return F.char(64 + F.col("l_linenumber"))


def map_key() -> Column:
    return F.concat(F.lower(pdb_id()), F.lit("_"), chain_name())


def accession(n: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(n.cast("string"), 5, "0"))


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
            .select(F.col("l_partkey").alias("source"), F.col("l_partkey").alias("file_ord"),
                    pdb_id().alias("pdb_id"))
            .withColumn("file_path", F.concat(F.lit("/structures/"), F.lower("pdb_id"), F.lit(".pdb"))))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw atom rows, hydrogens included, coordinates integer-valued."""
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    amino = F.element_at(F.array(*map(F.lit, ["ALA", "GLY", "LEU", "SER"])), (supp % 4 + 1).cast("int"))
    fifth = F.when(supp % 2 == 0, "VAL").otherwise("HOH")
    base = F.when(supp % 2 == 0, "DA").otherwise("DT")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"), F.lit(1).alias("model"), chain_name().alias("chain_id"),
        F.col("l_quantity").cast("int").alias("residue_number"), F.lit("").alias("insertion_code"),
        F.when(line <= 4, amino).when(line == 5, fifth).otherwise(base).alias("residue_name"),
        F.when(F.col("l_returnflag") == "A", "CA").when(F.col("l_returnflag") == "N", "N").otherwise("C")
        .alias("atom_name"),
        F.when(supp % 10 == 0, "H").otherwise("C").alias("element"),
        F.round("l_quantity").alias("x"), F.round(F.col("l_discount") * 100).alias("y"),
        F.round(F.col("l_tax") * 100).alias("z"), line.alias("atom_pos"), F.year("l_shipdate").cast("string").alias("year"), supp.alias("supplier"))


def xref_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per key; the last by (ord, sub_ord) counts, and is empty for chains from D on and for some others."""
    found = accession(F.col("l_suppkey") % 60)
    return (table(spark, sf_dir, "lineitem")
            .select(map_key().alias("map_key"),
                    F.when((F.col("l_linenumber") > 3) | (F.col("l_returnflag") == "R"), "").otherwise(found).alias("uniprot_id"),
                    F.col("l_orderkey").alias("ord"), F.col("l_suppkey").alias("sub_ord"),
                    F.col("l_returnflag").alias("flag")))


def name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of accessions 1 to 50; others that occur have none."""
    return table(spark, sf_dir, "part").select(
        accession(F.col("p_size")).alias("uniprot_id"), F.col("p_name").alias("protein_name"),
        F.col("p_partkey").alias("ord"))


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence header records; the last by (ord, sub_ord, length) counts.

    Chains from G on and those of two part types have keys that no chain looks up.
    """
    kind = F.when(F.col("l_linenumber") <= 5, "protein").otherwise("na")
    length = F.col("l_quantity").cast("int")
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    other = (F.col("l_linenumber") > 6) | F.col("p_type").isin("ECONOMY", "PROMO")
    return (table(spark, sf_dir, "lineitem").join(named, "l_partkey")
            .select(F.concat(map_key(), F.when(other, "x").otherwise("")).alias("map_key"),
                    F.concat(F.lit("mol:"), kind, F.lit(" length:"), length.cast("string"), F.lit(" "), "p_name")
                    .alias("info"),
                    F.col("l_orderkey").alias("ord"), F.col("l_suppkey").alias("sub_ord"), length.alias("length")))


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits; only those of chains D and E have a score above zero."""
    return (table(spark, sf_dir, "lineitem")
            .select(F.col("l_partkey").alias("file_ord"), F.concat_ws(":", pdb_id(), chain_name()).alias("unique_chain_id"),
                    F.concat(F.lit("Q"), F.lpad((F.col("l_suppkey") % 40).cast("string"), 5, "0")).alias("hit_id"),
                    F.when(F.col("l_linenumber").isin(4, 5), F.col("l_extendedprice")).otherwise(0.0).alias("score")))


#: The letters of the sequences below.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part a structure's sequence, a residue of one of 20 kinds per line item, and its ``relative``, if it has residues:
    where the flag is R another residue, and some residues of line 7 missing.

    Line items are spread before they are gathered: gathering them where they are read would sort them all there, and few are of one part.
    """
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"]
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", *order).repartition("l_partkey")
    held = rows.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("items"))

    def text(items: Column, number: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(items, lambda r: F.substring(F.lit(RESIDUES), (number(r) % 20).cast("int") + 1, 1)), "")

    kept = F.filter("items", lambda r: ~((r["l_linenumber"] == 7) & (r["l_returnflag"] == "N")))
    other = text(kept, lambda r: F.when(r["l_returnflag"] == "R", r["l_suppkey"] + 7).otherwise(r["l_suppkey"]))
    return held.select("l_partkey", text(F.col("items"), lambda r: r["l_suppkey"]).alias("sequence"), F.when(F.size(kept) > 0, other).alias("relative"))


def structure_sequences(both: DataFrame) -> DataFrame:
    """A sequence per structure, from :func:`sequences`."""
    return both.select(F.col("l_partkey").alias("file_ord"), "sequence")


def protein_sequences(both: DataFrame) -> DataFrame:
    """Relatives of those sequences."""
    name = F.concat(F.lit("Q"), F.lpad(F.col("l_partkey").cast("string"), 7, "0"))
    return both.where("relative IS NOT NULL").select(name.alias("uniprot_id"), F.col("relative").alias("sequence"))


def written_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Structure files made of all line items, one for each year: ``source, file_path, file_ord``.

    ``kind`` is ``pdb`` (each line number a model) or ``cif``. They lie in the session's shared folder.
    """
    item, text = F.col, F.format_string
    at = atoms(spark, sf_dir).select("chain_id", "residue_number", "residue_name", "atom_name", "element", "x", "y", "z", item("atom_pos").alias("model"), "year")
    head = at.select("year").distinct()
    name = F.substring("year", 2, 3)
    if kind == "pdb":
        line = text("ATOM  %5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s", F.lit(1), "atom_name", "residue_name", "chain_id", "residue_number", "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
        starts = [head.select("year", F.lit(-1).alias("model"), F.lit(0).alias("ord"), text("HEADER    LINE ITEMS                              01-JAN-00   9%s", name).alias("line")),
                  at.select("year", "model").distinct().select("year", "model", F.lit(0).alias("ord"), text("MODEL     %4d", "model").alias("line"))]
    else:
        line = text("ATOM %s \"%s'\" %s %s %d %.3f %.3f %.3f %d", "element", "atom_name", "residue_name", "chain_id", "residue_number", "x", "y", "z", "model")
        items = ["group_PDB", "type_symbol", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
        top = ["_audit.revision 1", "loop_", "_note.text", "'ATOM not one'", "_struct.title", ";loop_", "_atom_site.id", "ATOM is text", ";", "loop_", *(f"_atom_site.{i}" for i in items)]
        lines = F.posexplode(F.concat(F.array(F.concat(F.lit("data_9"), name)), F.array(*map(F.lit, top)))).alias("ord", "line")
        starts = [head.select("year", F.lit(-1).alias("model"), lines), head.select("year", F.lit(99).alias("model"), F.posexplode(F.array(F.lit("_cell.length_a 1.0"), F.lit("data_SECOND"))).alias("ord", "line"))]
    rows = at.select("year", "model", F.lit(1).alias("ord"), line.alias("line"))
    for start in starts:
        rows = rows.unionByName(start)
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged"
    folder = f"{shared.rstrip('/')}/structnet-files-{uuid.uuid4().hex}"
    ordered = rows.repartition("year").sortWithinPartitions("year", "model", "ord", "line")
    # Lines without quotes or separators: the CSV writer can name the suffix, which the text writer cannot.
    plain = {"header": "false", "quote": "", "sep": "\u0001", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "extension": kind}
    ordered.select("year", "line").write.partitionBy("year").options(**plain).csv(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("source"))
    return files.select("source", F.col("source").alias("file_path"), F.col("source").alias("file_ord"))

"""Names, types and accessions of chains from lookup tables and search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators.keys import key_hash

#: Column of a lookup that holds the hash of its key, if last-wins kept it (``spread``).
KEY_HASH = "map_hash"


def wanted(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Lookup rows (``map_key, ...``) whose key some chain has, for lookups far larger than the chains.

    Taken before last-wins, so nothing else of the lookup is aggregated. Where the keys are few they are broadcast, and the lookup is filtered
    as it is read; otherwise both sides are spread by key, which last-wins then finds done.
    """
    keys = chains.select(rules.lookup_key(F.col("pdb_id"), F.col("chain_id")).alias("map_key")).distinct()
    return rows.join(keys, "map_key", "left_semi")


def annotate(chains: DataFrame, xref: DataFrame, names: DataFrame, seqres: DataFrame) -> DataFrame:
    """Add ``molecule_name, molecule_type, uniprot_id``.

    Order of preference: cross-reference (only for ids of four characters,
    an empty accession is a miss) with its protein name, then the sequence
    header, then ``Unknown``.

    Names join the cross-reference, not the chains: there every accession
    is present, while many chains have none and would meet in one null key.
    Lookups are joined by the hash of their key and the key.
    """
    def hashed(lookup: DataFrame) -> DataFrame:
        return lookup if KEY_HASH in lookup.columns else lookup.withColumn(KEY_HASH, key_hash("map_key"))

    known = (hashed(xref).filter(F.col("uniprot_id") != "")
             .join(names.select("uniprot_id", "protein_name"), "uniprot_id", "left")
             .select(KEY_HASH, "map_key", "uniprot_id",
                     F.coalesce("protein_name", F.lit(K.UNKNOWN_PROTEIN)).alias("protein_name")))
    headers = hashed(seqres).select(KEY_HASH, "map_key", "info")
    keyed = hashed(chains.withColumn("map_key", rules.lookup_key(F.col("pdb_id"), F.col("chain_id"))))
    joined = keyed.join(known, [KEY_HASH, "map_key"], "left").join(headers, [KEY_HASH, "map_key"], "left")

    hit = (F.length("pdb_id") == 4) & F.col("uniprot_id").isNotNull()
    header = F.col("info").isNotNull()
    return joined.select(
        *chains.columns,
        F.when(hit, F.col("protein_name")).when(header, rules.clean_header(F.col("info")))
        .otherwise(K.UNKNOWN).alias("molecule_name"),
        F.when(hit, K.PROTEIN).when(header, rules.header_type(F.col("info")))
        .otherwise(K.UNKNOWN).alias("molecule_type"),
        F.when(hit, F.col("uniprot_id")).alias("uniprot_id"))


def _is_candidate():
    no_accession = F.coalesce("uniprot_id", F.lit(K.UNKNOWN)) == K.UNKNOWN
    return no_accession & ~(F.coalesce("molecule_type", F.lit("")) == K.NUCLEIC)


def search_candidates(annotated: DataFrame) -> DataFrame:
    """Chains without accession that are not nucleic acids."""
    return annotated.filter(_is_candidate())


def best_hits(hits: DataFrame, key: list[str], least: float) -> DataFrame:
    """One ``hit_id`` per key: the best ``score`` of at least ``least``, ties by id. Lower ones are dropped before the aggregate, which sorts its rows."""
    best = hits.filter(F.col("score") >= least).groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("rank"), "hit_id")).alias("best"))
    return best.filter(F.col("best.rank") <= -least).select(*key, F.col("best.hit_id").alias("hit_id"))


def apply_hits(annotated: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """Update the candidates by the result of a similarity search.

    ``hits`` has the columns of ``key`` and ``hit_id``, at most one row per
    key. A hit sets accession, name and type. A miss keeps the name and takes
    its type from the residues (``all_amino``).
    """
    joined = annotated.join(hits.select(*key, "hit_id"), key, "left")
    candidate = _is_candidate()
    hit = candidate & F.col("hit_id").isNotNull()
    updated = {
        "uniprot_id": F.when(hit, F.col("hit_id")).otherwise(F.col("uniprot_id")),
        "molecule_name": F.when(hit, F.concat(F.lit(K.MATCH_NAME_PREFIX), F.col("hit_id")))
        .otherwise(F.col("molecule_name")),
        "molecule_type": F.when(hit, K.PROTEIN)
        .when(candidate, F.when(F.col("all_amino"), K.PROTEIN).otherwise(K.NUCLEIC))
        .otherwise(F.col("molecule_type")),
    }
    return joined.select(*[updated[c].alias(c) if c in updated else F.col(c) for c in annotated.columns])


def preview(annotated: DataFrame) -> DataFrame:
    """Chains of the first structure of the manifest."""
    first = annotated.agg(F.min("file_ord").alias("file_ord"))
    return (annotated.join(F.broadcast(first), "file_ord", "left_semi")  # a single row
            .select("pdb_id", "chain_id", "molecule_name", "molecule_type", "uniprot_id"))

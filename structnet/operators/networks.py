"""Node and edge tables of the chain and protein networks.

All networks live in two tables with a ``network`` column; there is no loop
over structures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators.dedup import first_wins, last_wins
from structnet.operators.keys import hash_join

EDGE_COLUMNS = ["network", "source", "target", "all_atoms_count", "interaction"]
NODE_COLUMNS = ["network", "id", "name", "tooltip", "color_group", "molecule_name"]
PROTEIN_NODE_COLUMNS = [*NODE_COLUMNS, "label"]


# --- chains ---------------------------------------------------------------

def _edges(interactions: DataFrame, network: Column, source: str, target: str) -> DataFrame:
    return (interactions.filter(F.col("all_atoms_count") > 0)
            .select(network.alias("network"), F.col(source).alias("source"), F.col(target).alias("target"),
                    "all_atoms_count", F.lit(K.EDGE_LABEL).alias("interaction")))


def chain_edges(interactions: DataFrame) -> DataFrame:
    """One network per structure id, the text of ``chain_a`` before its colon."""
    title = F.concat(F.lit(K.CHAIN_NETWORK_PREFIX), F.substring_index("chain_a", ":", 1))
    return _edges(interactions, title, "chain_a", "chain_b")


def combined_chain_edges(interactions: DataFrame) -> DataFrame:
    return _edges(interactions, F.lit(K.COMBINED_CHAIN_NETWORK), "chain_a", "chain_b")


def _chain_nodes(chains: DataFrame, network: Column) -> DataFrame:
    tooltip = F.coalesce("molecule_name", F.lit(K.UNKNOWN))
    return chains.select(network.alias("network"), F.col("unique_chain_id").alias("id"),
                         F.col("unique_chain_id").alias("name"), tooltip.alias("tooltip"),
                         F.coalesce("molecule_type", F.lit(K.UNKNOWN)).alias("color_group"), tooltip.alias("molecule_name"))


def nonempty(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the networks that have an edge; others are not built."""
    return hash_join(nodes, edges.select("network").distinct(), ["network"], "left_semi")


def chain_nodes(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """All chains, isolated ones too, of the first structure of each id with edges."""
    first = chains.groupBy("pdb_id").agg(F.min("file_ord").alias("file_ord"))
    shown = chains.join(first, ["file_ord", "pdb_id"], "left_semi")  # the sort compares numbers
    title = F.concat(F.lit(K.CHAIN_NETWORK_PREFIX), F.col("pdb_id"))
    return nonempty(_chain_nodes(shown, title), edges)


def combined_chain_nodes(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """All chains of all structures, if there is any edge at all."""
    any_edge = edges.select(F.lit(True).alias("any")).limit(1)
    nodes = _chain_nodes(chains, F.lit(K.COMBINED_CHAIN_NETWORK))
    return nodes.withColumn("any", F.lit(True)).join(F.broadcast(any_edge), "any", "left_semi").drop("any")


def edge_endpoints(edges: DataFrame) -> DataFrame:
    """Node rows of networks that come without node data: the distinct endpoints."""
    ends = edges.select("network", F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.select("network", "id", F.col("id").alias("name"), F.lit(K.UNKNOWN).alias("tooltip"))


# --- proteins -------------------------------------------------------------

_LISTED = ["file_ord", "chain_pos"]


def _with_accession(chains: DataFrame) -> DataFrame:
    return chains.filter(F.coalesce("uniprot_id", F.lit("")) != "")


def chain_to_protein(chains: DataFrame) -> DataFrame:
    """Accession per ``unique_chain_id``, the last chain of a name wins."""
    return last_wins(_with_accession(chains), ["unique_chain_id"], _LISTED, ["uniprot_id"])


def protein_summary(chains: DataFrame) -> DataFrame:
    """Per accession: number of structures, color group and last name.

    The color group is the structure id if there is only one, else ``Multi``.
    """
    several = F.min("pdb_id") != F.max("pdb_id")
    last_name = F.max_by(F.struct("molecule_name"), F.struct(*_LISTED))
    return (_with_accession(chains).groupBy("uniprot_id")
            .agg(F.when(several, K.MULTI).otherwise(F.min("pdb_id")).alias("color_group"),
                 last_name.alias("last"))
            .select("uniprot_id", "color_group", F.col("last.molecule_name").alias("molecule_name")))


def structures_per_protein(chains: DataFrame) -> DataFrame:
    """The distinct structures of every accession, as rows."""
    return _with_accession(chains).select("uniprot_id", "pdb_id").distinct()


def protein_pairs(interactions: DataFrame, chains: DataFrame, per_structure: bool = True,
                  agg: str = "first") -> DataFrame:
    """Chain contacts lifted to accessions, one row per pair (and structure).

    Pairs with a missing or equal accession are dropped. The first
    interaction of a pair, by structure and chain order, gives orientation
    and count; ``agg`` = ``sum`` or ``max`` changes the count only.
    """
    lookup = chain_to_protein(chains)

    def ids(tag: str) -> DataFrame:
        return lookup.select(F.col("unique_chain_id").alias(f"chain_{tag}"), F.col("uniprot_id").alias(f"uniprot_{tag}"))

    met = hash_join(interactions.filter(F.col("all_atoms_count") > 0), ids("a"), ["chain_a"])
    lifted = (hash_join(met, ids("b"), ["chain_b"])
              .filter(F.col("uniprot_a") != F.col("uniprot_b"))
              .withColumn("low", F.least("uniprot_a", "uniprot_b"))
              .withColumn("high", F.greatest("uniprot_a", "uniprot_b"))
              .withColumn("pdb_id", F.substring_index("chain_a", ":", 1)))
    keys = ["pdb_id", "low", "high"] if per_structure else ["low", "high"]
    order = ["file_ord", "chain_pos_a", "chain_pos_b"]
    if agg == "first":
        pairs = first_wins(lifted, keys, order, ["uniprot_a", "uniprot_b", "all_atoms_count"])
    else:
        total = {"sum": F.sum, "max": F.max}[agg]("all_atoms_count").alias("all_atoms_count")
        pairs = (lifted.groupBy(*keys)
                 .agg(F.min_by(F.struct("uniprot_a", "uniprot_b"), F.struct(*order)).alias("f"), total)
                 .select(*keys, "f.*", "all_atoms_count"))
    return pairs.drop("low", "high")


def protein_edges(pairs: DataFrame) -> DataFrame:
    """One network per structure, from ``protein_pairs(per_structure=True)``."""
    title = F.concat(F.lit(K.PROTEIN_NETWORK_PREFIX), F.col("pdb_id"))
    return _edges(pairs, title, "uniprot_a", "uniprot_b")


def combined_protein_edges(pairs: DataFrame) -> DataFrame:
    """All pairs in one network; per-structure pairs stay parallel edges."""
    return _edges(pairs, F.lit(K.COMBINED_PROTEIN_NETWORK), "uniprot_a", "uniprot_b")


def protein_nodes(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """Distinct endpoints with color group and name (the id if there is none)."""
    ends = edges.select("network", F.explode(F.array("source", "target")).alias("id")).distinct()
    summary = protein_summary(chains).withColumnRenamed("uniprot_id", "id")
    return ends.join(summary, "id", "left").select(
        "network", "id", F.col("id").alias("name"),
        F.coalesce("molecule_name", "id").alias("tooltip"),
        F.coalesce("color_group", F.lit(K.MULTI)).alias("color_group"),
        F.coalesce("molecule_name", "id").alias("molecule_name"), F.col("id").alias("label"))

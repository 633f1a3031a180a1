"""From atom rows to chains, residues and sequences.

Atom rows have the columns ``source, model, chain_id, residue_number,
insertion_code, residue_name, atom_name, element, x, y, z, atom_pos``.
``source`` identifies the file, ``model`` and ``atom_pos`` are any orderable
values that increase in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators.dedup import first_wins

_PLACE = ["file_ord", "chain_pos"]
CHAIN_KEY = ["source", "model", "chain_id"]
RESIDUE_KEY = [*CHAIN_KEY, "residue_number", "insertion_code", "residue_name"]


def heavy_atoms(atoms: DataFrame) -> DataFrame:
    """Drop hydrogens, upper-case residue names, trim chain names.

    Everything else stays: all models, alternate positions, hetero groups and
    waters. A residue that had only hydrogens has no row left.
    """
    return (atoms.filter(rules.is_heavy(F.col("element")))
            .withColumn("residue_name", F.upper("residue_name"))
            .withColumn("chain_id", F.trim("chain_id")))


def chain_table(atoms: DataFrame) -> DataFrame:
    """One row per valid chain of ``heavy_atoms``, from a single aggregate.

    A chain is valid if any of its residues is a polymer residue; it then
    keeps all its residues. ``all_amino`` answers the residue-based type rule.
    """
    name = F.col("residue_name")
    return (atoms.groupBy(*CHAIN_KEY)
            .agg(F.min("atom_pos").alias("first_pos"), F.count("*").alias("n_atoms"),
                 F.bool_or(rules.is_polymer(name)).alias("valid"),
                 F.bool_and(rules.is_amino_acid(name)).alias("all_amino"))
            .filter("valid").drop("valid"))


def place_chains(chains: DataFrame, structures: DataFrame, position: Column | None = None) -> DataFrame:
    """Attach ``file_ord, file_path, pdb_id`` and the composite chain id.

    A file listed twice in the manifest gives its chains twice. ``chain_pos``
    orders the chains of one file over all its models. ``source_atoms``, from ``n_atoms``, is the size of the file; its
    window is spread as the join is, and holds a row per chain.
    """
    position = F.struct("model", "first_pos") if position is None else position
    if "n_atoms" in chains.columns:
        chains = chains.withColumn("source_atoms", F.sum("n_atoms").over(Window.partitionBy("source")))
    return (chains.join(structures.select("source", "file_ord", "file_path", "pdb_id"), "source")
            .withColumn("chain_pos", position)
            .withColumn("unique_chain_id", rules.unique_chain_id(F.col("pdb_id"), F.col("chain_id"))))


def first_model(chains: DataFrame) -> DataFrame:
    """Keep the chains of the first model of each file."""
    first = chains.groupBy("source").agg(F.min("model").alias("model"))
    return chains.join(first, ["source", "model"], "left_semi")


def chain_atoms(atoms: DataFrame, chains: DataFrame, *columns: str) -> DataFrame:
    """Atoms of the given chains with ``file_ord``, ``chain_pos`` and more chain columns.

    This one join drops the atoms of invalid chains and labels the others.
    """
    wanted = chains.select(*CHAIN_KEY, "file_ord", "chain_pos", *columns)
    return atoms.join(wanted, CHAIN_KEY)


def residues(atoms: DataFrame) -> DataFrame:
    """One row per residue, ``residue_pos`` being its first position."""
    return atoms.groupBy(*RESIDUE_KEY).agg(F.min("atom_pos").alias("residue_pos"))


def classify_chains(atoms: DataFrame) -> DataFrame:
    """Molecule type by residues alone: a single water makes a chain nucleic."""
    return (atoms.groupBy(*CHAIN_KEY)
            .agg(F.count("residue_name").alias("n"),
                 F.bool_and(rules.is_amino_acid(F.col("residue_name"))).alias("amino"))
            .select(*CHAIN_KEY, rules.type_from_residues(F.col("n"), F.col("amino")).alias("molecule_type")))


def chain_sequences(atoms: DataFrame, block: Column | None = None) -> DataFrame:
    """One-letter sequence of every chain, residues in file order.

    ``block`` is an optional non-decreasing function of the residue position.
    Sequences are then joined per block first and blocks per chain after, so
    a very long chain is put together by many tasks.
    """
    order = ["residue_pos", "residue_number", "insertion_code", "residue_name"]
    block = F.lit(0) if block is None else block
    letters = residues(atoms).select(
        *CHAIN_KEY, block.alias("block"),
        F.struct(*order, rules.one_letter(F.col("residue_name")).alias("letter")).alias("r"))
    parts = (letters.groupBy(*CHAIN_KEY, "block").agg(F.collect_list("r").alias("rs"))
             .select(*CHAIN_KEY, F.struct("block", F.array_join(
                 F.transform(F.sort_array("rs"), lambda r: r["letter"]), "").alias("text")).alias("p")))
    return (parts.groupBy(*CHAIN_KEY).agg(F.collect_list("p").alias("ps"))
            .select(*CHAIN_KEY, F.array_join(
                F.transform(F.sort_array("ps"), lambda p: p["text"]), "").alias("sequence")))


def nest(atoms: DataFrame, segment: Column) -> DataFrame:
    """Nested view: one row per chain segment with ``residues: array<struct<..., atoms>>``.

    ``segment`` cuts a chain at residue borders (a function of residue
    columns), so that a row stays small however large the chain is.
    """
    atom = F.struct("atom_pos", "atom_name", "x", "y", "z")
    per_residue = (atoms.groupBy(*RESIDUE_KEY)
                   .agg(F.min("atom_pos").alias("residue_pos"),
                        F.sort_array(F.collect_list(atom)).alias("atoms")))
    residue = F.struct("residue_pos", "residue_number", "insertion_code", "residue_name", "atoms")
    return (per_residue.groupBy(*CHAIN_KEY, segment.alias("segment"))
            .agg(F.sort_array(F.collect_list(residue)).alias("residues")))


def unnest(nested: DataFrame) -> DataFrame:
    """Back to one row per atom with the residue label used in contact lists."""
    return (nested.select(*CHAIN_KEY, F.explode("residues").alias("r"))
            .select(*CHAIN_KEY, rules.residue_label(F.col("r.residue_number"), F.col("r.residue_name"))
                    .alias("residue"), F.explode("r.atoms").alias("a"))
            .select(*CHAIN_KEY, "residue", "a.atom_name", "a.x", "a.y", "a.z"))


def select_atoms(atoms: DataFrame, kind: str) -> DataFrame:
    """``ca``: atoms named CA (a calcium ion too); ``all_atoms``: all; else none."""
    if kind == "ca":
        return atoms.filter(F.col("atom_name") == "CA")
    return atoms if kind == "all_atoms" else atoms.limit(0)


def first_occurrence(chains: DataFrame) -> DataFrame:
    """Where the coordinates of a ``unique_chain_id`` come from in compat mode."""
    return first_wins(chains, ["unique_chain_id"], _PLACE, _PLACE)


def first_of_name(chains: DataFrame) -> DataFrame:
    """The chains that :func:`first_occurrence` names, with all their columns."""
    others = [c for c in chains.columns if c != "unique_chain_id"]
    return first_wins(chains.filter("unique_chain_id IS NOT NULL"), ["unique_chain_id"], _PLACE, others).select(*chains.columns)

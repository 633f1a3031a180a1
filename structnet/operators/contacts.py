"""Which chains touch, and through which atoms.

The pair table of a structure is never built on the way to the contacts:
the radius join finds the touching pairs, and the rules on molecule types
run on the few rows that it returns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators.chains import chain_atoms, first_of_name
from structnet.operators.keys import hash_join, key_hash
from structnet.operators.spatial import HELD, XYZ, merge_points, radius_counts, radius_pair_count, radius_pairs
from structnet.operators.staging import stage

INTERACTION_COLUMNS = ["file_ord", "file_path", "pdb_id", "chain_pos_a", "chain_pos_b", "chain_a", "chain_b",
                       "all_atoms_count", "interaction_type"]


def chain_pairs(chains: DataFrame) -> DataFrame:
    """Unordered pairs of chains with different names, per structure, in list order.

    This is the listing itself, for reports; the contact search does not use it.
    """
    def side(tag: str) -> DataFrame:
        named = {"chain_pos": f"chain_pos_{tag}", "chain_id": f"chain_id_{tag}",
                 "unique_chain_id": f"chain_{tag}", "molecule_type": f"molecule_type_{tag}"}
        present = [c for c in named if c in chains.columns]
        return chains.select("file_ord", *[F.col(c).alias(named[c]) for c in present])

    return (side("a").join(side("b"), "file_ord")
            .filter((F.col("chain_pos_a") < F.col("chain_pos_b")) & (F.col("chain_id_a") != F.col("chain_id_b"))))


def typed_pairs(chains: DataFrame) -> DataFrame:
    """``chain_pairs`` with the interaction type; pairs with an unknown side are gone."""
    kind = rules.interaction_type(F.col("molecule_type_a"), F.col("molecule_type_b"))
    return chain_pairs(chains).withColumn("interaction_type", kind).filter("interaction_type IS NOT NULL")


#: Structures of at most so many atoms meet without cells, which there cost more copies than they save comparisons.
SMALL = 256


def _sized(chains: DataFrame) -> tuple[DataFrame, str | None]:
    """Chains with the column ``whole``, which marks those of small structures, if their sizes are known."""
    if "source_atoms" not in chains.columns:
        return chains, None
    return chains.withColumn("whole", F.coalesce(F.col("source_atoms") <= SMALL, F.lit(False))), "whole"


def _kinds(chains: DataFrame) -> list[bool]:
    """Whether there are chains of small structures (True) and of others (False); nothing if their sizes are not known."""
    rows, whole = _sized(chains)
    return [] if whole is None else [row.whole for row in rows.select(whole).distinct().collect()]  # at most two


def _by_size(chains: DataFrame, of: Callable[[DataFrame, bool], DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """``of(chains, small)`` for the chains of small structures and for the others, if their sizes are known.

    The chains (or ``asked``, of which they are a part), which a run stages, are asked first which kinds there are, so that
    no atom is read for a kind that is not.
    """
    rows, whole = _sized(chains)
    if whole is None:
        return of(chains, False)
    kinds = _kinds(chains if asked is None else asked)
    parts = [of(rows.filter(F.col(whole) if small else ~F.col(whole)).drop(whole), small) for small in (True, False) if small in kinds]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts or [of(chains, False)])[0]


def contact_points(located: DataFrame, chain: Sequence[str] = ("file_ord", "chain_pos"), small: bool = False) -> DataFrame:
    """Coinciding atoms of a chain as one row, with the numbers ``atoms`` and ``ca_atoms``.

    ``nucleic`` marks the atoms of nucleic acid chains, if ``located`` has types; ``whole`` is kept if it is there. With ``small``
    each atom is a row: merging would cost a shuffle of its own.
    """
    types = [(F.col("molecule_type") == K.NUCLEIC).alias("nucleic")] if "molecule_type" in located.columns else []
    marked = located.select(*chain, *(["whole"] if "whole" in located.columns else []), *types, "atom_name", *XYZ)
    keys = [c for c in marked.columns if c != "atom_name"]
    weights = {"atoms": F.lit(True), "ca_atoms": F.col("atom_name") == "CA"}
    if small:
        return marked.dropna(subset=list(XYZ)).select(*keys, *[F.coalesce(w, F.lit(False)).cast("long").alias(n) for n, w in weights.items()])
    return merge_points(marked, keys, **weights)


def ca_contact_counts(points: DataFrame, radius: float = K.CA_RADIUS, small: bool = False, group: Sequence[str] = ("file_ord",)) -> DataFrame:
    """Pairs of C-alpha atoms within ``radius`` per pair of chains without nucleic acid."""
    ca = points.filter((F.col("ca_atoms") > 0) & ~F.col("nucleic"))
    return radius_pair_count(ca, radius, group, "chain_pos", name="ca_count", weight="ca_atoms", small=small)


def all_atom_counts(points: DataFrame, radius: float = K.ALL_ATOMS_RADIUS, small: bool = False) -> DataFrame:
    """Pairs of heavy atoms within ``radius`` per pair of chains."""
    return radius_pair_count(points, radius, ["file_ord"], "chain_pos", name="all_atoms_count", weight="atoms", small=small)


def chain_interactions(atoms: DataFrame, chains: DataFrame, ca_radius: float = K.CA_RADIUS,
                       all_atoms_radius: float = K.ALL_ATOMS_RADIUS,
                       min_ca_pairs: int = K.MIN_CA_PAIRS, crowded: int | None = None, more: Sequence[str] = ()) -> DataFrame:
    """Touching chains per structure with their atom contact count.

    A pair with a nucleic acid needs one atom contact. Any other pair needs
    ``min_ca_pairs`` close C-alpha pairs as well. ``chains`` holds one model
    per file. ``crowded`` as in ``spatial.radius_counts``. ``more`` lists further columns: ``ca_count``, or the ends' types as ``type_a, type_b``.
    """
    known = _known(chains)
    levels = {"all_atoms_count": (all_atoms_radius, F.col("atoms")), "ca_count": (ca_radius, F.when(~F.col("nucleic"), F.col("ca_atoms")))}
    only_small = _kinds(known) == [True]

    def found(some: DataFrame, small: bool, held: bool = False) -> DataFrame:
        points = contact_points(chain_atoms(atoms, some, "molecule_type"), small=small or held)
        return radius_counts(points, ["file_ord"], "chain_pos", levels, crowded=crowded, small=small, held=held).filter("all_atoms_count > 0")

    def counted(some: DataFrame, small: bool) -> DataFrame:
        if small or "source_atoms" not in some.columns:
            return found(some, small)
        holds = F.coalesce(F.col("source_atoms") <= HELD, F.lit(False))
        kinds = [row.held for row in some.select(holds.alias("held")).distinct().collect()]  # at most two
        parts = [found(some.filter(holds if held else ~holds), False, held) for held in (True, False) if held in kinds]
        return reduce(DataFrame.unionByName, parts) if parts else found(some, False)

    return ((_by_source(atoms, known, levels) if only_small else _with_ends(_by_size(known, counted), known))
            .filter((F.col("name_a") != F.col("name_b")) & (_nucleic() | (F.col("ca_count") >= min_ca_pairs)))
            .withColumn("interaction_type", rules.interaction_type(F.col("type_a"), F.col("type_b")))
            .select(*INTERACTION_COLUMNS, *more))


def gated(interactions: DataFrame, min_ca_pairs: int) -> DataFrame:
    """Those of ``chain_interactions(..., more=["ca_count", "type_a", "type_b"])`` that pass a higher gate as well."""
    return interactions.filter(_nucleic() | (F.col("ca_count") >= min_ca_pairs)).select(*INTERACTION_COLUMNS)


def _known(chains: DataFrame) -> DataFrame:
    return chains.filter(F.coalesce("molecule_type", F.lit(K.UNKNOWN)) != K.UNKNOWN)


def _nucleic() -> Column:
    return (F.col("type_a") == K.NUCLEIC) | (F.col("type_b") == K.NUCLEIC)


def _with_ends(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Names and types of both chains of each pair; the structure's own columns once."""
    def ends(tag: str, *more: str) -> DataFrame:
        named = {"chain_pos": f"chain_pos_{tag}", "chain_id": f"name_{tag}", "unique_chain_id": f"chain_{tag}",
                 "molecule_type": f"type_{tag}"}
        return chains.select("file_ord", *more, *[F.col(c).alias(n) for c, n in named.items()])

    return pairs.join(ends("a", "file_path", "pdb_id"), ["file_ord", "chain_pos_a"]).join(ends("b"), ["file_ord", "chain_pos_b"])


def _by_source(atoms: DataFrame, chains: DataFrame, levels: dict[str, tuple[float, Column]]) -> DataFrame:
    """What ``radius_counts`` and :func:`_with_ends` give, where all structures are small.

    Atoms are shuffled once, by file: there they meet the list of its chains, each other, and the list again, which has the ends' names.
    A list holds no more chains than a small structure has atoms, for each time that the file is listed. With large files beside
    them this would send a file's atoms to one task, so those keep to the joins by chain.
    """
    def listed(*columns: str) -> DataFrame:
        return chains.groupBy("source").agg(F.collect_list(F.struct("file_ord", "chain_pos", *columns)).alias("_chains"))

    own = F.struct(F.col("model"), F.col("chain_id"))
    placed = (atoms.select("source", own.alias("_own"), "atom_name", *XYZ).join(listed("model", "chain_id", "molecule_type"), "source")
              .select("source", "_own", "atom_name", *XYZ, F.explode("_chains").alias("_c"))
              .where((F.col("_own.model") == F.col("_c.model")) & (F.col("_own.chain_id") == F.col("_c.chain_id")))
              .select("source", "_c.file_ord", "_c.chain_pos", "_c.molecule_type", "atom_name", *XYZ))
    group = ["source", "file_ord"]
    points = contact_points(placed, [*group, "chain_pos"], small=True)
    met = radius_counts(points, group, "chain_pos", levels, small=True).filter("all_atoms_count > 0")
    counts = [*group, "chain_pos_a", "chain_pos_b", *levels]
    met = met.join(listed("file_path", "pdb_id", "chain_id", "unique_chain_id", "molecule_type"), "source")
    for tag in "ab":
        more = ["file_path", "pdb_id"] if tag == "a" else []
        named = {"chain_id": f"name_{tag}", "unique_chain_id": f"chain_{tag}", "molecule_type": f"type_{tag}"}
        met = (met.select(*counts, "_chains", F.explode("_chains").alias("_c"))
               .where((F.col("_c.file_ord") == F.col("file_ord")) & (F.col("_c.chain_pos") == F.col(f"chain_pos_{tag}")))
               .select(*counts, "_chains", *[f"_c.{c}" for c in more], *[F.col(f"_c.{c}").alias(n) for c, n in named.items()]))
        counts = [c for c in met.columns if c != "_chains"]
    return met.drop("_chains", "source")


def structure_contacts(atoms: DataFrame, chains: DataFrame, ca_radius: float = K.CA_RADIUS, radius: float = K.EXPORT_RADIUS,
                       min_ca_pairs: int = K.MIN_CA_PAIRS, all_atoms_radius: float = K.ALL_ATOMS_RADIUS) -> DataFrame:
    """Every close atom pair of the touching chains of each structure, one row each, as :func:`atom_contacts` lists them.

    For structures whose chain names are their own, which all are unless models or files are merged (compat). No contact is counted
    first: the gate is a join of C-alpha atoms alone, and cuts down the pairs of one join of all atoms. A small structure gets its list of
    close chains before its atoms meet, so no atom pair is shuffled.
    """
    group = ["file_ord", "pdb_id"]
    pair = ["file_ord", "chain_pos_a", "chain_pos_b"]
    label = rules.residue_label(F.col("residue_number"), F.col("residue_name"))
    carry = ["chain_id", "molecule_type", "uniprot_id", "residue", "atom_name"]

    def found(some: DataFrame, small: bool) -> DataFrame:
        located = (chain_atoms(atoms, some, "pdb_id", "molecule_type", "uniprot_id").withColumn("residue", label)
                   .select("file_ord", "pdb_id", "chain_pos", *carry, *XYZ).dropna(subset=list(XYZ)))
        points = contact_points(located, [*group, "chain_pos"], small)
        gate = ca_contact_counts(points, ca_radius, small, group).filter(F.col("ca_count") >= min_ca_pairs)
        if small:
            ends = F.struct("chain_pos_a", "chain_pos_b")
            lists = gate.groupBy(*group).agg(F.collect_list(ends).alias("close"))

            def passes(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
                close = F.coalesce(F.array_contains("close", F.struct(a("chain_pos").alias("chain_pos_a"), b("chain_pos").alias("chain_pos_b"))), F.lit(False))
                return (a("chain_id") != b("chain_id")) & ((a("molecule_type") == K.NUCLEIC) | (b("molecule_type") == K.NUCLEIC) | close)

            met = radius_pairs(located, radius, group, "chain_pos", carry, where=passes, small=True, known=lists)
        else:
            met = radius_pairs(located, radius, group, "chain_pos", carry).filter("chain_id_a <> chain_id_b")
        near = met = met.withColumnsRenamed({"molecule_type_a": "type_a", "molecule_type_b": "type_b"})
        if not small:
            met = near.join(gate.select(*pair, F.lit(True).alias("close")), pair, "left").filter(_nucleic() | F.col("close"))
        if all_atoms_radius < radius:  # a pair that only meets beyond the radius of interactions is none
            met = met.join(near.filter(F.col("d2") <= all_atoms_radius ** 2).select(*pair).distinct(), pair, "left_semi")
        return met

    met = _by_size(_known(chains), found)
    return met.select(
        F.col("pdb_id").alias("PDB_ID"), F.col("chain_id_a").alias("Chain_A"), F.col("residue_a").alias("Residue_A"), F.col("atom_name_a").alias("Atom_A"),
        F.col("chain_id_b").alias("Chain_B"), F.col("residue_b").alias("Residue_B"), F.col("atom_name_b").alias("Atom_B"),
        rules.round2(F.sqrt("d2")).alias("Distance"), F.col("uniprot_id_a").alias("UniProt_A"), F.col("uniprot_id_b").alias("UniProt_B"),
        rules.interaction_type(F.col("type_a"), F.col("type_b")).alias("Interaction_Type"))


def chain_interactions_compat(atoms: DataFrame, chains: DataFrame, ca_radius: float = K.CA_RADIUS,
                              all_atoms_radius: float = K.ALL_ATOMS_RADIUS,
                              min_ca_pairs: int = K.MIN_CA_PAIRS) -> DataFrame:
    """``chain_interactions`` with geometry keyed by ``unique_chain_id``.

    Every model and every file with the same id repeats the pair rows, all
    with the coordinates of the first chain of that name. ``chains`` holds
    all models. Geometry is joined once per name; the repeats come from a
    join of the touching names with the chain occurrences.
    """
    first = first_of_name(chains)
    if "n_atoms" in chains.columns:  # of all files with the id
        first = stage(first.withColumn("source_atoms", F.sum("n_atoms").over(Window.partitionBy(key_hash("pdb_id"), "pdb_id"))))
    levels = {"all_atoms_count": (all_atoms_radius, F.col("atoms")), "ca_count": (ca_radius, F.col("ca_atoms"))}

    def counts(some: DataFrame, small: bool) -> DataFrame:
        group = ["id_hash", "pdb_id"]
        located = chain_atoms(atoms, some.withColumn("id_hash", key_hash("pdb_id")), "unique_chain_id", *group)
        points = contact_points(located, [*group, "unique_chain_id"], small)
        return radius_counts(points, group, "unique_chain_id", levels, small=small).filter("all_atoms_count > 0").drop("id_hash")

    counted = (_by_size(first, counts)
               .withColumnsRenamed({"unique_chain_id_a": "name_1", "unique_chain_id_b": "name_2"}))

    def occurrence(tag: str) -> DataFrame:
        return chains.select("file_ord", "file_path", F.col("unique_chain_id").alias(f"name_{tag}"),
                             F.col("chain_pos").alias(f"pos_{tag}"), F.col("molecule_type").alias(f"type_{tag}"))

    met = (hash_join(counted, occurrence("1"), ["name_1"])
           .join(occurrence("2").drop("file_path"), ["file_ord", "name_2"]))
    forward = F.col("pos_1") < F.col("pos_2")

    def pick(left: str, right: str) -> Column:
        return F.when(forward, F.col(left)).otherwise(F.col(right))

    kind = rules.interaction_type(F.col("type_1"), F.col("type_2"))
    nucleic = (F.col("type_1") == K.NUCLEIC) | (F.col("type_2") == K.NUCLEIC)
    return (met.withColumn("interaction_type", kind)
            .filter(F.col("interaction_type").isNotNull() & (nucleic | (F.col("ca_count") >= min_ca_pairs)))
            .withColumn("chain_pos_a", pick("pos_1", "pos_2")).withColumn("chain_pos_b", pick("pos_2", "pos_1"))
            .withColumn("chain_a", pick("name_1", "name_2")).withColumn("chain_b", pick("name_2", "name_1"))
            .select(*INTERACTION_COLUMNS))


def interactions_by_id(structures: DataFrame, interactions: DataFrame) -> DataFrame:
    """The interactions each structure exports: its own."""
    own = structures.select("file_ord", F.col("pdb_id").alias("structure_id"))
    return interactions.join(own, "file_ord")


def interactions_by_prefix(structures: DataFrame, interactions: DataFrame) -> DataFrame:
    """Compat: every interaction whose ``chain_a`` *starts with* the structure's id.

    Written as an equi-join on the prefixes of ``chain_a``. Only prefixes as
    long as some id are made; the distinct id lengths are few, since an id is
    part of a file name.
    """
    ids = structures.select(F.col("file_ord"), F.col("pdb_id").alias("structure_id"))
    lengths = ids.select(F.length("structure_id").alias("n")).distinct()
    sized = (interactions.drop("file_ord")
             .withColumn("n", F.explode(F.sequence(F.lit(1), F.length("chain_a"))))
             .join(F.broadcast(lengths), "n")  # at most 255 rows, the longest file name
             .withColumn("structure_id", F.expr("left(chain_a, n)")).drop("n"))
    return sized.join(ids, "structure_id")


def atom_contacts(atoms: DataFrame, chains: DataFrame, selected: DataFrame,
                  radius: float = K.EXPORT_RADIUS, with_order: bool = False) -> DataFrame:
    """Every close atom pair of the selected interactions, one row each.

    ``selected`` comes from ``interactions_by_id`` or ``interactions_by_prefix``.
    Within a structure a chain name stands for the atoms of its last chain
    and the annotation of its first. Interactions on names the structure does
    not have give no rows. Only atoms of chains that take part are joined.

    ``with_order`` keeps the columns that sort the rows like a listing by
    interaction, atom of b, atom of a.
    """
    part = selected.select(
        "file_ord", F.col("structure_id").alias("pdb_id"), "interaction_type",
        F.element_at(F.split("chain_a", ":"), 2).alias("chain_id_a"),
        F.element_at(F.split("chain_b", ":"), 2).alias("chain_id_b"))
    names = part.select("file_ord", F.explode(F.array("chain_id_a", "chain_id_b")).alias("chain_id")).distinct()
    per_name = (chains.groupBy("file_ord", "chain_id")
                .agg(F.max("chain_pos").alias("chain_pos"),
                     F.min_by(F.struct("uniprot_id"), "chain_pos").alias("first"))
                .join(names, ["file_ord", "chain_id"], "left_semi")
                .select("file_ord", "chain_id", "chain_pos", F.col("first.uniprot_id").alias("uniprot_id")))
    shown = chains.drop("uniprot_id").join(per_name, ["file_ord", "chain_id", "chain_pos"])
    label = rules.residue_label(F.col("residue_number"), F.col("residue_name"))
    carry = ["residue", "atom_name", "uniprot_id", *(["atom_pos"] if with_order else [])]

    def met(some: DataFrame, small: bool) -> DataFrame:
        located = chain_atoms(atoms, some, "uniprot_id").withColumn("residue", label).select("file_ord", "chain_id", *carry, *XYZ)
        return radius_pairs(located, radius, ["file_ord"], "chain_id", carry, small=small)

    near = _by_size(shown, met, asked=chains)
    keyed = (part.withColumn("low", F.least("chain_id_a", "chain_id_b"))
             .withColumn("high", F.greatest("chain_id_a", "chain_id_b"))
             .withColumn("forward", F.col("chain_id_a") < F.col("chain_id_b"))
             .withColumnsRenamed({"chain_id_a": "Chain_A", "chain_id_b": "Chain_B"}))
    pairs = near.withColumnsRenamed({"chain_id_a": "low", "chain_id_b": "high"})

    def pick(column: str, this: str, other: str) -> Column:
        return F.when(F.col("forward"), F.col(f"{column}_{this}")).otherwise(F.col(f"{column}_{other}"))

    order = [F.col("file_ord"), pick("atom_pos", "b", "a").alias("order_b"),
             pick("atom_pos", "a", "b").alias("order_a")] if with_order else []
    return pairs.join(keyed, ["file_ord", "low", "high"]).select(
        F.col("pdb_id").alias("PDB_ID"),
        "Chain_A", pick("residue", "a", "b").alias("Residue_A"), pick("atom_name", "a", "b").alias("Atom_A"),
        "Chain_B", pick("residue", "b", "a").alias("Residue_B"), pick("atom_name", "b", "a").alias("Atom_B"),
        rules.round2(F.sqrt("d2")).alias("Distance"),
        pick("uniprot_id", "a", "b").alias("UniProt_A"), pick("uniprot_id", "b", "a").alias("UniProt_B"),
        F.col("interaction_type").alias("Interaction_Type"), *order)

"""The registered queries: library operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fixtures as fx
from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators import annotate as an
from structnet.operators import chains as ch
from structnet.operators import coloring, contacts, networks, search, similarity, spatial
from structnet.operators.dedup import last_wins
from structnet.operators.staging import stage
from structnet.plans.pipeline import read_structures
from structnet.sources import identifiers, sinks
from structnet.sources import structures as st
from structnet.sources.manifest import structure_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- shared inputs --------------------------------------------------------

CHAIN_ID_COLUMNS = ["file_ord", "pdb_id", "chain_pos", "chain_id", "unique_chain_id"]


def heavy(spark, sf_dir):
    return ch.heavy_atoms(fx.atoms(spark, sf_dir))


def chains(spark, sf_dir, atoms=None):
    atoms = heavy(spark, sf_dir) if atoms is None else atoms
    return ch.place_chains(ch.chain_table(atoms), fx.structures(spark, sf_dir), F.col("first_pos"))


def xref(spark, sf_dir, spread=None):
    return last_wins(fx.xref_rows(spark, sf_dir), ["map_key"], ["ord", "sub_ord", "flag"], ["uniprot_id"], spread)


def names(spark, sf_dir):
    return last_wins(fx.name_rows(spark, sf_dir), ["uniprot_id"], ["ord"], ["protein_name"])


def seqres(spark, sf_dir, spread=None):
    return last_wins(fx.header_rows(spark, sf_dir), ["map_key"], ["ord", "sub_ord", "length"], ["info"], spread)


def hits(spark, sf_dir):
    return an.best_hits(fx.hit_rows(spark, sf_dir), ["file_ord", "unique_chain_id"], 90000)


def annotated(spark, sf_dir, atoms=None):
    return an.annotate(chains(spark, sf_dir, atoms), xref(spark, sf_dir, an.KEY_HASH), names(spark, sf_dir), seqres(spark, sf_dir, an.KEY_HASH))


def final(spark, sf_dir, atoms=None):
    return an.apply_hits(annotated(spark, sf_dir, atoms), hits(spark, sf_dir), ["file_ord", "unique_chain_id"])


def annotated_atoms(spark, sf_dir):
    """Atoms and annotated chains. The chains are staged, as a run stages them: every step reads them, each with columns of its own."""
    atoms = heavy(spark, sf_dir)
    return atoms, stage(final(spark, sf_dir, atoms))


def located(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    return ch.chain_atoms(atoms, all_chains, "molecule_type")


def interactions(spark, sf_dir):
    return contacts.chain_interactions(*annotated_atoms(spark, sf_dir))


# --- sources --------------------------------------------------------------

@query
def extension_filter(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.filter(rules.has_suffix(F.col("url"), [".html", ".htm"]))


@query
def valid_id_set(spark, sf_dir):
    return identifiers.valid_ids(fx.header_rows(spark, sf_dir).select(F.concat_ws(" ", "map_key", "info").alias("header")))


@query
def resolve_id(spark, sf_dir):
    files = fx.structures(spark, sf_dir).select("source", "file_path")
    content = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("content_id"))
    return identifiers.resolve_ids(files, content, valid_id_set(spark, sf_dir))


@query
def pdb_records(spark, sf_dir):
    """Atoms written as fixed-column lines and read back by the scan's parser."""
    at = fx.atoms(spark, sf_dir)
    line = F.format_string("ATOM  %5d  %-3s %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
                           F.lit(1), "atom_name", "residue_name", "chain_id", "residue_number", "x", "y", "z",
                           F.lit(1.0), F.lit(0.0), "element")
    fields = st.pdb_fields(F.col("line"))
    return at.select("source", line.alias("line")).select(
        "source", *[fields[c].alias(c) for c in
                    ["chain_id", "residue_number", "residue_name", "atom_name", "element", "x", "y", "z"]])


@query
def cif_records(spark, sf_dir):
    """Atoms written as loop rows, names quoted, and read back by the scan's tokens."""
    at = fx.atoms(spark, sf_dir)
    line = F.format_string("ATOM %s \"%s'\" '%s' %s %d %.3f %.3f %.3f", "element", "atom_name", "residue_name",
                           "chain_id", "residue_number", "x", "y", "z")
    t = F.col("t")
    return at.select("source", st.cif_tokens(line).alias("t")).select(
        "source", t[1].alias("element"), t[2].alias("atom_name"), t[3].alias("residue_name"), t[4].alias("chain_id"),
        t[5].cast("int").alias("residue_number"), t[6].cast("double").alias("x"), t[7].cast("double").alias("y"),
        t[8].cast("double").alias("z"))


def _scanned(spark, sf_dir, kind):
    """Atoms and ids that the scan gives for files written from all line items."""
    return read_structures(spark, fx.written_files(spark, sf_dir, kind))


def _scan(spark, sf_dir, kind):
    atoms, ids = _scanned(spark, sf_dir, kind)
    return atoms.join(ids, "source").select("content_id", "chain_id", "residue_number", "residue_name", "atom_name", "element", "x", "y", "z")


@query
def pdb_scan(spark, sf_dir):
    """PDB files of several models, read back."""
    return _scan(spark, sf_dir, "pdb")


@query
def cif_scan(spark, sf_dir):
    """mmCIF files whose atom loop follows other loops and text fields, read back."""
    return _scan(spark, sf_dir, "cif")


@query
def content_ids(spark, sf_dir):
    """Ids inside the files of both kinds with their number of atoms and models."""
    parts = [atoms.join(ids, "source").groupBy("content_id").agg(F.count("*").alias("n_atoms"), F.countDistinct("model").alias("n_models")).withColumn("kind", F.lit(kind))
             for kind in ("pdb", "cif") for atoms, ids in [_scanned(spark, sf_dir, kind)]]
    return parts[0].unionByName(parts[1])


@query
def rejected_files(spark, sf_dir):
    """Why pages and files that are not there give no structure, beside files that do."""
    files = fx.written_files(spark, sf_dir, "cif")
    pages = fx.table(spark, sf_dir, "pages")
    name = F.concat(F.lit("/nowhere/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".cif").otherwise(".html"))
    manifest = files.unionByName(pages.select(name.alias("source"), name.alias("file_path"), name.alias("file_ord")))
    atoms, _ = read_structures(spark, structure_files(manifest))
    return st.rejected_files(manifest, atoms).select("file_path", "reason")


@query
def xref_last_wins(spark, sf_dir):
    return xref(spark, sf_dir)


@query
def protein_name_last_wins(spark, sf_dir):
    return names(spark, sf_dir)


@query
def seqres_last_wins(spark, sf_dir):
    return seqres(spark, sf_dir)


# --- atoms and chains -----------------------------------------------------

@query
def heavy_atoms(spark, sf_dir):
    return heavy(spark, sf_dir).select(F.col("source").alias("file_ord"), "chain_id", "residue_number",
                                       "residue_name", "atom_name", "x", "y", "z")


@query
def valid_chains(spark, sf_dir):
    return chains(spark, sf_dir).select(*CHAIN_ID_COLUMNS)


def _nested(spark, sf_dir):
    return ch.nest(heavy(spark, sf_dir), F.floor(F.col("residue_number") / 16))


@query
def nest_chain(spark, sf_dir):
    """Nested rows, shown as text: residues with their atom names."""
    shown = F.transform("residues", lambda r: F.concat(
        r["residue_number"].cast("string"), F.lit(":"), r["residue_name"], F.lit("["),
        F.array_join(F.array_sort(F.transform(r["atoms"], lambda a: a["atom_name"])), ","), F.lit("]")))
    return _nested(spark, sf_dir).select(
        F.col("source").alias("file_ord"), "chain_id", "segment", F.size("residues").alias("n_residues"),
        F.array_join(shown, ";").alias("nested"))


@query
def unnest_chain(spark, sf_dir):
    return ch.unnest(_nested(spark, sf_dir)).select(F.col("source").alias("file_ord"), "chain_id", "residue",
                                                    "atom_name", "x", "y", "z")


@query
def chain_sequence(spark, sf_dir):
    return ch.chain_sequences(heavy(spark, sf_dir).withColumn("atom_pos", F.col("residue_number")), F.floor(F.col("residue_pos") / 16)).select(F.col("source").alias("file_ord"), "chain_id", "sequence")


@query
def classify_chain(spark, sf_dir):
    return ch.classify_chains(heavy(spark, sf_dir)).select(F.col("source").alias("file_ord"), "chain_id",
                                                           "molecule_type")


@query
def first_occurrence(spark, sf_dir):
    """Chains seen once per order: the first order that has a chain name gives its geometry."""
    seen = fx.table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", fx.pdb_id(), fx.chain_name()).alias("unique_chain_id"),
        F.col("l_orderkey").alias("file_ord"), F.col("l_suppkey").alias("chain_pos"))
    return ch.first_occurrence(seen)


# --- annotation -----------------------------------------------------------

ANNOTATION = [*CHAIN_ID_COLUMNS, "molecule_name", "molecule_type", "uniprot_id"]


@query
def clean_header(spark, sf_dir):
    info = F.col("info")
    return seqres(spark, sf_dir).select("map_key", rules.clean_header(info).alias("molecule_name"),
                                        rules.header_type(info).alias("molecule_type"))


@query
def annotate_chains(spark, sf_dir):
    return annotated(spark, sf_dir).select(*ANNOTATION)


@query
def annotate_wanted(spark, sf_dir):
    """The same annotation from lookups that are cut down to the chains' keys first."""
    rows = chains(spark, sf_dir)
    cross = last_wins(an.wanted(fx.xref_rows(spark, sf_dir), rows), ["map_key"], ["ord", "sub_ord", "flag"], ["uniprot_id"])
    headers = last_wins(an.wanted(fx.header_rows(spark, sf_dir), rows), ["map_key"], ["ord", "sub_ord", "length"], ["info"])
    return an.annotate(rows, cross, names(spark, sf_dir), headers).select(*ANNOTATION)


@query
def annotation_preview(spark, sf_dir):
    return an.preview(annotated(spark, sf_dir))


@query
def search_candidates(spark, sf_dir):
    return an.search_candidates(annotated(spark, sf_dir)).select(*CHAIN_ID_COLUMNS, "molecule_type")


@query
def annotate_final(spark, sf_dir):
    return final(spark, sf_dir).select(*ANNOTATION)


@query
def best_match(spark, sf_dir):
    """The document that holds the largest share of a benchmark item's five-word runs."""
    items = fx.table(spark, sf_dir, "benchmark").select("item_id", "text")
    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity.best_matches(items, documents, "item_id", "doc_id", "text", similarity.word_shingles, 0.3)


@query
def search_hits(spark, sf_dir):
    """The best eight relatives of every structure's sequence."""
    both = stage(fx.sequences(spark, sf_dir))
    return search.scored_hits(fx.structure_sequences(both), fx.protein_sequences(both), "file_ord", "uniprot_id")


@query
def annotate_by_search(spark, sf_dir):
    """Annotation whose hits come from the search: every chain without accession is looked up by its structure's sequence."""
    rows = stage(annotated(spark, sf_dir))  # the search is a job of its own
    both = stage(fx.sequences(spark, sf_dir))
    wanted = fx.structure_sequences(both).join(an.search_candidates(rows).select("file_ord"), "file_ord", "left_semi")  # once per structure
    found = search.first_hits(search.scored_hits(wanted, fx.protein_sequences(both), "file_ord", "uniprot_id"), "file_ord")
    return an.apply_hits(rows, found, ["file_ord"]).select(*ANNOTATION)


# --- contacts -------------------------------------------------------------

@query
def chain_pairs(spark, sf_dir):
    return contacts.chain_pairs(chains(spark, sf_dir)).select("file_ord", "chain_a", "chain_b")


@query
def interaction_type(spark, sf_dir):
    return contacts.typed_pairs(final(spark, sf_dir)).select("file_ord", "chain_a", "chain_b", "interaction_type")


@query
def radius_pair_count(spark, sf_dir):
    points = heavy(spark, sf_dir).select(F.col("source").alias("file_ord"), F.col("atom_pos").alias("chain_pos"),
                                         "x", "y", "z")
    return spatial.radius_pair_count(points, 5.0, ["file_ord"], "chain_pos")


@query
def ca_contact_count(spark, sf_dir):
    points = contacts.contact_points(located(spark, sf_dir))
    return contacts.ca_contact_counts(points).select("file_ord", "chain_pos_a", "chain_pos_b", "ca_count")


@query
def all_atom_count(spark, sf_dir):
    points = contacts.contact_points(located(spark, sf_dir))
    return contacts.all_atom_counts(points).select("file_ord", "chain_pos_a", "chain_pos_b", "all_atoms_count")


@query
def chain_interactions(spark, sf_dir):
    return interactions(spark, sf_dir).select("file_path", "chain_a", "chain_b", "all_atoms_count", "interaction_type")


@query
def chain_interactions_compat(spark, sf_dir):
    """Geometry by chain name: the same rows, since names occur once here."""
    found = contacts.chain_interactions_compat(*annotated_atoms(spark, sf_dir))
    return found.select("file_path", "chain_a", "chain_b", "all_atoms_count", "interaction_type")


@query
def compat_repeats(spark, sf_dir):
    """Compat where names repeat: every ten structures share an id, and each pair has the coordinates of the first."""
    atoms = heavy(spark, sf_dir)
    shared = fx.structures(spark, sf_dir).withColumn("pdb_id", F.concat(F.lit("R"), F.floor(F.col("file_ord") / 10).cast("string")))
    placed = ch.place_chains(ch.chain_table(atoms), shared, F.col("first_pos"))
    typed = placed.withColumn("molecule_type", F.when(F.col("all_amino"), K.PROTEIN).otherwise(K.NUCLEIC))
    found = contacts.chain_interactions_compat(atoms, typed, min_ca_pairs=2)
    return found.select("file_ord", "chain_a", "chain_b", "all_atoms_count", "interaction_type")


@query
def prefix_join(spark, sf_dir):
    selected = contacts.interactions_by_prefix(fx.structures(spark, sf_dir), interactions(spark, sf_dir))
    return selected.select("structure_id", "chain_a", "chain_b", "all_atoms_count")


@query
def atom_contacts(spark, sf_dir):
    return contacts.structure_contacts(*annotated_atoms(spark, sf_dir))


@query
def selected_contacts(spark, sf_dir):
    """The same listing by way of a table of interactions, as an export by structure id goes."""
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    selected = contacts.interactions_by_id(fx.structures(spark, sf_dir), contacts.chain_interactions(atoms, all_chains))
    return contacts.atom_contacts(atoms, all_chains, selected)


# --- networks -------------------------------------------------------------

def _chain_network(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    edges = networks.chain_edges(stage(contacts.chain_interactions(atoms, all_chains)))  # nodes need the edges too
    return networks.chain_nodes(all_chains, edges).select(*networks.NODE_COLUMNS), edges


@query
def chain_edges(spark, sf_dir):
    return networks.chain_edges(interactions(spark, sf_dir))


@query
def chain_nodes(spark, sf_dir):
    return _chain_network(spark, sf_dir)[0]


@query
def combined_chain_network(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    edges = networks.combined_chain_edges(stage(contacts.chain_interactions(atoms, all_chains)))
    nodes = networks.combined_chain_nodes(all_chains, edges).select(*networks.NODE_COLUMNS)
    empty = F.lit(None).cast("string")
    return (nodes.select("network", F.lit("node").alias("kind"), "id", "tooltip", "color_group",
                         empty.alias("target"), F.lit(None).cast("long").alias("all_atoms_count"))
            .unionByName(edges.select("network", F.lit("edge").alias("kind"), F.col("source").alias("id"),
                                      empty.alias("tooltip"), empty.alias("color_group"), "target",
                                      "all_atoms_count")))


@query
def edge_endpoints(spark, sf_dir):
    return networks.edge_endpoints(chain_edges(spark, sf_dir))


@query
def nonempty_networks(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    edges = networks.chain_edges(contacts.chain_interactions(atoms, all_chains))
    every = all_chains.select(
        F.concat(F.lit("Chain_Interaction_Network_"), "pdb_id").alias("network"), F.col("unique_chain_id").alias("id"))
    return networks.nonempty(every, edges).groupBy("network").agg(F.count("id").alias("n_nodes"))


@query
def chain_to_protein(spark, sf_dir):
    return networks.chain_to_protein(final(spark, sf_dir))


@query
def protein_color_group(spark, sf_dir):
    return networks.protein_summary(final(spark, sf_dir)).select("uniprot_id", "color_group")


@query
def structures_per_protein(spark, sf_dir):
    return networks.structures_per_protein(final(spark, sf_dir))


def _loose_interactions(atoms, all_chains):
    """A gate of one C-alpha pair, since the chains here have few atoms and hardly any pair has ten."""
    return contacts.chain_interactions(atoms, all_chains, min_ca_pairs=1)


def _both_gates(atoms, all_chains):
    """Interactions behind the usual gate and behind that of one pair, from one contact search."""
    loose = stage(contacts.chain_interactions(atoms, all_chains, min_ca_pairs=1, more=["ca_count", "type_a", "type_b"]))
    return contacts.gated(loose, K.MIN_CA_PAIRS), loose.select(*contacts.INTERACTION_COLUMNS)


def _pairs(spark, sf_dir, per_structure=True, agg="first"):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    return networks.protein_pairs(_loose_interactions(atoms, all_chains), all_chains, per_structure, agg)


@query
def protein_edges(spark, sf_dir):
    return networks.protein_edges(_pairs(spark, sf_dir))


@query
def crowded_protein_edges(spark, sf_dir):
    """Protein networks behind the gate of ten C-alpha pairs: a supplier's items are one structure of seven large chains."""
    atoms = heavy(spark, sf_dir).withColumn("source", F.col("supplier"))
    table = ch.chain_table(atoms)
    files = table.select("source").distinct().select("source", F.col("source").alias("file_ord"), F.concat(F.lit("S"), F.col("source").cast("string")).alias("pdb_id"), F.lit("").alias("file_path"))
    rows = stage(ch.place_chains(table, files, F.col("first_pos")).withColumns({  # asked for their sizes, and used by several steps
        "molecule_type": F.when(F.col("all_amino"), K.PROTEIN).otherwise(K.NUCLEIC), "molecule_name": F.col("chain_id"),
        "uniprot_id": F.when(F.col("chain_pos") <= 6, fx.accession((F.col("file_ord") + 3 * F.col("chain_pos")) % 20))}))
    return networks.protein_edges(networks.protein_pairs(contacts.chain_interactions(atoms, rows, crowded=64), rows))


@query
def protein_edges_sum(spark, sf_dir):
    return networks.protein_edges(_pairs(spark, sf_dir, agg="sum"))


@query
def protein_nodes(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    found = _loose_interactions(atoms, all_chains)
    return networks.protein_nodes(networks.protein_edges(networks.protein_pairs(found, all_chains)), all_chains)


@query
def combined_protein_network(spark, sf_dir):
    """One edge per pair."""
    return networks.combined_protein_edges(_pairs(spark, sf_dir, per_structure=False))


@query
def combined_protein_network_parallel(spark, sf_dir):
    """One edge per structure and pair."""
    return networks.combined_protein_edges(_pairs(spark, sf_dir))


@query
def combined_protein_nodes(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    found = _loose_interactions(atoms, all_chains)
    pairs = networks.protein_pairs(found, all_chains, per_structure=False)
    return networks.protein_nodes(networks.combined_protein_edges(pairs), all_chains)


@query
def color_assignment(spark, sf_dir):
    """Group colors of the chain networks and of both kinds of protein network."""
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    strict, loose = _both_gates(atoms, all_chains)
    edges = networks.chain_edges(strict)
    nodes = networks.chain_nodes(all_chains, edges)
    pairs = networks.protein_pairs(loose, all_chains)
    single = networks.protein_nodes(networks.protein_edges(pairs), all_chains)
    combined = networks.protein_nodes(networks.combined_protein_edges(pairs), all_chains)
    groups = [n.select("network", "color_group") for n in (nodes, single, combined)]
    return coloring.color_assignment(groups[0].unionByName(groups[1]).unionByName(groups[2]))


@query
def structure_colors(spark, sf_dir):
    """All structures of the collection as the groups of one network."""
    groups = fx.structures(spark, sf_dir).select(F.lit("Combined_Protein_Network").alias("network"),
                                                 F.col("pdb_id").alias("color_group"))
    return coloring.color_assignment(groups)


@query
def style_name(spark, sf_dir):
    atoms, all_chains = annotated_atoms(spark, sf_dir)
    strict, loose = _both_gates(atoms, all_chains)
    chain, pairs = networks.chain_edges(strict), networks.protein_pairs(loose, all_chains)
    edges = [e.select("network") for e in
             (chain, networks.protein_edges(pairs), networks.combined_protein_edges(pairs))]
    return coloring.style_names(edges[0].unionByName(edges[1]).unionByName(edges[2]))


@query
def graph_json(spark, sf_dir):
    return sinks.graph_lines(*_chain_network(spark, sf_dir))

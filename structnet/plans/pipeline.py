"""The whole run, from a manifest to network tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from structnet.operators import annotate as an
from structnet.operators import chains as ch
from structnet.operators import contacts, networks, search
from structnet.operators.staging import Staged, stage
from structnet.plans.options import Options
from structnet.plans.session import tune
from structnet.sources import identifiers, lookups, sinks, structures
from structnet.sources.manifest import BATCH_FILES, batches, read_manifest, structure_files


def read_structures(spark: SparkSession, files: DataFrame, compat: bool = False, batch_files: int = BATCH_FILES) -> tuple[DataFrame, DataFrame]:
    """Raw atoms and content ids of the listed files, as tables that are written batch by batch."""
    atoms, ids = Staged(spark, _EMPTY_ATOMS), Staged(spark, "source string, content_id string")
    for batch in batches(files, batch_files):
        records, lines = structures.scan_pdb(spark, batch), structures.scan_cif(spark, batch)
        if records is not None:
            atoms.add(structures.pdb_atoms(records, stage(structures.pdb_splits(records))))
            ids.add(structures.pdb_header_ids(records))
        if lines is not None:
            splits = stage(structures.cif_splits(lines))
            atoms.add(structures.cif_atoms(lines, splits))
            ids.add(structures.cif_content_ids(splits, compat))
    return atoms.table(), ids.table()


_EMPTY_ATOMS = ("source string, model struct<block:bigint,row:bigint>, chain_id string, residue_number int, "
                "insertion_code string, residue_name string, atom_name string, element string, "
                "x double, y double, z double, atom_pos struct<block:bigint,row:bigint,line:bigint>")


def search_hits(atoms: DataFrame, annotated: DataFrame, proteins: DataFrame, k: int, expect: float, best: int) -> DataFrame:
    """Best protein per chain that has no accession: ``file_ord, chain_pos, hit_id``."""
    candidates = an.search_candidates(annotated).select(*ch.CHAIN_KEY, "file_ord", "chain_pos")
    searched = atoms.join(candidates.select(*ch.CHAIN_KEY).distinct(), ch.CHAIN_KEY, "left_semi")
    at = F.col("residue_pos")
    block = F.struct(at["block"], F.floor(at["row"] / 4096), F.floor(at["line"] / 4096))
    sequences = ch.chain_sequences(searched, block)
    queries = candidates.join(sequences, ch.CHAIN_KEY).select(F.struct("file_ord", "chain_pos").alias("query_id"),
                                                              "sequence")
    found = search.scored_hits(queries, proteins, "query_id", "uniprot_id", k=k, expect=expect, best=best)
    return search.first_hits(found, "query_id").select("query_id.file_ord", "query_id.chain_pos", "hit_id")


def run(spark: SparkSession, options: Options, hits: DataFrame | None = None) -> dict[str, DataFrame]:
    """All requested products as DataFrames.

    ``hits`` (``file_ord, chain_pos, hit_id``) replaces the built-in search,
    for results of an external one.
    """
    o = options
    tune(spark)
    manifest = read_manifest(spark, o.manifest)
    files = structure_files(manifest)
    raw, content_ids = read_structures(spark, files, o.compat)
    atoms = ch.heavy_atoms(structures.readable_atoms(raw))

    records = lookups.read_fasta(spark, o.sequence_headers)
    listed = identifiers.resolve_ids(files, content_ids, identifiers.valid_ids(records))
    chains = ch.chain_table(atoms)
    if o.first_model_only:
        chains = ch.first_model(chains)
    chains = ch.place_chains(chains, listed)
    if not o.compat:  # every model is a structure of its own, whose chains meet only each other
        chains = chains.withColumn("file_ord", F.struct("file_ord", "model"))

    names = lookups.read_fasta(spark, o.protein_names)
    proteins = lookups.protein_names(names)
    keep = lambda rows: an.wanted(rows, chains)
    annotated = stage(an.annotate(chains, lookups.read_xref(spark, o.cross_reference, keep), proteins,
                                  lookups.sequence_headers(records, keep)))
    if hits is None and o.search:
        hits = search_hits(atoms, annotated, proteins, o.search_kmer, o.search_expect, o.search_targets)
    if hits is None:
        hits = annotated.select("file_ord", "chain_pos", F.lit(None).cast("string").alias("hit_id")).limit(0)
    chains = stage(an.apply_hits(annotated, hits, ["file_ord", "chain_pos"]))

    find = contacts.chain_interactions_compat if o.compat else contacts.chain_interactions
    interactions = stage(find(atoms, chains, o.ca_radius, o.all_atoms_radius, o.min_ca_pairs))
    products = {"rejected": structures.rejected_files(manifest, raw), "skipped_atoms": structures.skipped_atoms(raw), "chains": chains, "interactions": interactions,
                "preview": an.preview(chains), "malformed_names": lookups.malformed_names(names)}

    if o.detailed_contacts:
        placed = chains.select("file_ord", "pdb_id").distinct()
        if o.compat:
            selected = contacts.interactions_by_prefix(placed, interactions)
            products["contacts"] = contacts.atom_contacts(atoms, chains, selected, o.export_radius)
        else:
            products["contacts"] = contacts.structure_contacts(atoms, chains, o.ca_radius, o.export_radius, o.min_ca_pairs, o.all_atoms_radius)
        products["contact_counts"] = sinks.contact_counts(placed, products["contacts"])
    if o.chain_per_structure:
        edges = networks.chain_edges(interactions)
        products["chain_edges"], products["chain_nodes"] = edges, networks.chain_nodes(chains, edges)
    if o.combined_chain_network:
        edges = networks.combined_chain_edges(interactions)
        products["combined_chain_edges"] = edges
        products["combined_chain_nodes"] = networks.combined_chain_nodes(chains, edges)
    if o.protein_per_structure or o.combined_protein_network:
        pairs = networks.protein_pairs(interactions, chains, o.protein_per_structure)
        if o.protein_per_structure:
            edges = networks.protein_edges(pairs)
            products["protein_edges"], products["protein_nodes"] = edges, networks.protein_nodes(edges, chains)
        if o.combined_protein_network:
            edges = networks.combined_protein_edges(pairs)
            products["combined_protein_edges"] = edges
            products["combined_protein_nodes"] = networks.protein_nodes(edges, chains)
    return products


def write(products: dict[str, DataFrame], options: Options, run_id: str | None = None, graph_json: bool = True) -> str:
    """Write the products under ``<output>/<run_id>`` and return that path."""
    path = f"{options.output.rstrip('/')}/{run_id or sinks.new_run_id()}"
    if "contacts" in products:
        sinks.write_contacts(products["contacts"], path, options.folder_per_structure)
    for name in ("chain", "combined_chain", "protein", "combined_protein"):
        if f"{name}_edges" in products:
            nodes, edges = products[f"{name}_nodes"], products[f"{name}_edges"]
            sinks.write_network(nodes, edges, path, f"{name}_network")
            if graph_json:
                sinks.write_graph_json(nodes, edges, path, f"{name}_network")
    for name in sorted({"rejected", "skipped_atoms", "malformed_names", "contact_counts"} & set(products)):
        flat = products[name].select(*(F.to_json(c).alias(c) if isinstance(f.dataType, StructType) else F.col(c) for c, f in zip(products[name].columns, products[name].schema, strict=True)))
        flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return path

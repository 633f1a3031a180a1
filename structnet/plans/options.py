"""What a run reads, how it decides, and which products it builds."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from structnet.functions import constants as K


@dataclass(frozen=True)
class Options:
    manifest: str
    sequence_headers: str
    protein_names: str
    cross_reference: str
    output: str
    ca_radius: float = K.CA_RADIUS
    all_atoms_radius: float = K.ALL_ATOMS_RADIUS
    export_radius: float = K.EXPORT_RADIUS
    min_ca_pairs: int = K.MIN_CA_PAIRS
    chain_per_structure: bool = True
    combined_chain_network: bool = True
    protein_per_structure: bool = True
    combined_protein_network: bool = True
    detailed_contacts: bool = True
    search: bool = True
    search_kmer: int = 5
    search_expect: float = 1e-5
    search_targets: int = 8
    first_model_only: bool = False
    folder_per_structure: bool = False
    compat: bool = False

    @classmethod
    def from_json(cls, path: str) -> Options:
        """Read the usual ``config.json``.

        Text that is not JSON raises ``ValueError``. A missing file counts as
        an empty one, and the first missing key raises ``KeyError``.
        """
        file = Path(path)
        config = json.loads(file.read_text()) if file.exists() else {}
        networks, radii = config["networks"], config["distance_thresholds"]
        return cls(
            manifest=config["input_csv_path"], sequence_headers=config["pdb_fasta_path"],
            protein_names=config["uniprot_fasta_path"], cross_reference=config["sifts_tsv_path"],
            output=config["output_path"], ca_radius=radii["ca_radius"], all_atoms_radius=radii["all_atoms_radius"],
            chain_per_structure=networks["chain_per_pdb"],
            combined_chain_network=networks["combined_chain_network"],
            protein_per_structure=networks["protein_per_pdb"],
            combined_protein_network=networks["combined_protein_network"],
            detailed_contacts=config.get("export_detailed_interactions", False))

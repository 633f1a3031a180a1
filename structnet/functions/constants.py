"""Values that results depend on."""

# Residue names that make a chain valid.
AMINO_ACIDS = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU",
    "LYS", "MET", "PHE", "PRO", "PYL", "SEC", "SER", "THR", "TRP", "TYR", "VAL",
)
RNA_RESIDUES = ("A", "C", "G", "I", "U")
DNA_RESIDUES = ("DA", "DC", "DG", "DI", "DT")
POLYMER_RESIDUES = AMINO_ACIDS + RNA_RESIDUES + DNA_RESIDUES

# IUPAC one-letter codes of the 20 standard amino acids.
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C",
    "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P",
    "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
UNKNOWN_LETTER = "X"

# Elements left out of every geometric step.
HYDROGENS = ("H", "D")

# Structure file suffixes.
STRUCTURE_SUFFIXES = (".pdb", ".cif", ".mmcif")

# Molecule types and names.
PROTEIN = "Protein"
NUCLEIC = "Nucleic Acid"
UNKNOWN = "Unknown"
UNKNOWN_PROTEIN = "Unknown Protein"
MATCH_NAME_PREFIX = "Matched UniProt: "

# Thresholds of the contact search.
CA_RADIUS = 15.0
ALL_ATOMS_RADIUS = 5.0
EXPORT_RADIUS = 5.0
MIN_CA_PAIRS = 10

# Network titles, edge label and color group.
CHAIN_NETWORK_PREFIX = "Chain_Interaction_Network_"
COMBINED_CHAIN_NETWORK = "Combined_Network"
PROTEIN_NETWORK_PREFIX = "Protein_Network_"
COMBINED_PROTEIN_NETWORK = "Combined_Protein_Network"
EDGE_LABEL = "interacts_with"
MULTI = "Multi"

# The public 20-color categorical palette "tab20", and the color of MULTI.
PALETTE = (
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c",
    "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f",
    "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
)
MULTI_COLOR = "#d62728"

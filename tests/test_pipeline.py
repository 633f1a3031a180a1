"""The whole run on small files, checked against plain Python over the same text."""

import csv
import itertools
import json
import math

import pytest

from samples import write_inputs
from structnet.plans.options import Options
from structnet.plans.pipeline import run, write
from structnet.sources import sinks


def parse(path):
    """Chains of a PDB file as (model, name, atoms), hydrogens left out."""
    models, model, current = [], 0, {}
    for line in path.read_text().splitlines():
        if line.startswith("MODEL"):
            model += 1
        if line[:6] in ("ATOM  ", "HETATM") and line[76:78].strip() not in ("H", "D"):
            key = (model, line[21])
            if key not in current:
                current[key] = []
                models.append(key)
            current[key].append((line[17:20].strip(), int(line[22:26]), line[12:16].strip(),
                                 tuple(float(line[a:a + 8]) for a in (30, 38, 46))))
    return [(m, c, current[m, c]) for m, c in models]


def close(a, b, r):
    return [(p, q) for q in b for p in a if math.dist(p[3], q[3]) <= r]


@pytest.fixture(scope="module")
def setup(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    paths = write_inputs(folder / "in")
    return folder, paths


@pytest.fixture(scope="module")
def products(spark, setup):
    folder, paths = setup
    options = Options(output=str(folder / "out"), **paths)
    return options, run(spark, options)


def test_annotation(products):
    _, p = products
    got = {r.unique_chain_id: (r.molecule_name, r.molecule_type, r.uniprot_id) for r in p["chains"].collect()}
    assert got == {
        "1ABC:A": ("Second protein OS=Test GN=two", "Protein", "P00002"),
        "1ABC:B": ("Unknown Protein", "Protein", "P00003"),
        "3DEF:A": ("Second protein OS=Test GN=two", "Protein", "P00002"),
        "3DEF:C": ("Matched UniProt: P00009", "Protein", "P00009"),
        "TWO_MODELS:A": ("Matched UniProt: P00009", "Protein", "P00009"),
        "TWO_MODELS:B": ("Matched UniProt: P00009", "Protein", "P00009"),
        "2XYZ:N": ("DNA strand", "Nucleic Acid", None),
        "2XYZ:P": ("Unknown", "Protein", None)}


def test_rejected(products):
    _, p = products
    got = {r.file_path.rsplit("/", 1)[1]: r.reason for r in p["rejected"].collect()}
    assert got == {"notes.txt": "suffix", "x.pdb.gz": "suffix", "broken.pdb": "unreadable coordinates",
                   "missing.pdb": "missing, unreadable or without atoms",
                   "empty.pdb": "missing, unreadable or without atoms"}


def test_interactions(products, setup):
    _, p = products
    folder, _ = setup
    got = {(r.chain_a, r.chain_b): (r.all_atoms_count, r.interaction_type) for r in p["interactions"].collect()}
    want = {}
    for name, pdb_id in (("1abc", "1ABC"), ("model1", "3DEF"), ("two_models", "TWO_MODELS")):
        chains = [c for c in parse(folder / "in" / f"{name}.pdb") if c[0] <= 1]
        for (_, a, x), (_, b, y) in itertools.combinations(chains, 2):
            ca = close([t for t in x if t[2] == "CA"], [t for t in y if t[2] == "CA"], 15.0)
            n = len(close(x, y, 5.0))
            if len(ca) >= 10 and n:
                want[f"{pdb_id}:{a}", f"{pdb_id}:{b}"] = (n, "Protein-Protein")
    assert len(want) == 3
    dna = [(3.0 * i, 0.0, 0.0) for i in range(5)]
    protein = [(3.0 * i, 3.5, 0.0) for i in range(5)]
    want["2XYZ:N", "2XYZ:P"] = (sum(math.dist(a, b) <= 5 for a in dna for b in protein), "Protein-Nucleic Acid")
    assert got == want


def test_contacts(products, setup):
    _, p = products
    folder, _ = setup
    got = sorted(tuple(r) for r in p["contacts"].filter("PDB_ID = '1ABC'").collect())
    (_, _, a), (_, _, b) = parse(folder / "in" / "1abc.pdb")
    want = sorted(("1ABC", "A", f"{x[1]}:{x[0]}", x[2], "B", f"{y[1]}:{y[0]}", y[2],
                   round(math.dist(x[3], y[3]), 2), "P00002", "P00003", "Protein-Protein") for x, y in close(a, b, 5.0))
    assert got == want and len(got) > 20


def test_protein_networks(products):
    _, p = products
    got = sorted((r.network, r.source, r.target) for r in p["protein_edges"].collect())
    assert got == [("Protein_Network_1ABC", "P00002", "P00003"), ("Protein_Network_3DEF", "P00002", "P00009")]
    groups = {r.id: r.color_group for r in p["combined_protein_nodes"].collect()}
    assert groups == {"P00002": "Multi", "P00003": "1ABC", "P00009": "Multi"}
    # Two files have the id 2XYZ and one has two models: all chains are in the combined network, the first file's in the single one.
    assert p["combined_chain_nodes"].count() == 11 and p["chain_nodes"].count() == 8


def test_written_run(products):
    options, p = products
    path = write(p, options, "run-1")
    assert path.endswith("/out/run-1") and write(p, options, "run-1") == path  # once more replaces all
    import pathlib
    folder = pathlib.Path(path)
    lines = [row for f in (folder / "detailed_interactions").glob("part-*.csv") for row in csv.DictReader(f.open())]
    assert len(lines) == p["contacts"].count()
    own = [r for r in lines if r["PDB_ID"] == "2XYZ"]
    assert own and own[0]["UniProt_A"] == "" and own[0]["Interaction_Type"] == "Protein-Nucleic Acid"
    assert list(own[0]) == ["PDB_ID", "Chain_A", "Residue_A", "Atom_A", "Chain_B", "Residue_B", "Atom_B", "Distance",
                            "UniProt_A", "UniProt_B", "Interaction_Type"]
    documents = [json.loads(x) for f in (folder / "chain_network" / "graph_json" / "documents").glob("part-*") for x in f.read_text().splitlines()]
    by_name = {d["data"]["name"]: d["elements"] for d in documents}
    assert set(by_name) == {r.network for r in p["chain_edges"].select("network").collect()}
    nodes = {n["data"]["id"]: n["data"] for n in by_name["Chain_Interaction_Network_1ABC"]["nodes"]}
    assert set(nodes) == {"1ABC:A", "1ABC:B"} and nodes["1ABC:B"]["molecule_name"] == "Unknown Protein"
    protein = [json.loads(x) for f in (folder / "combined_protein_network" / "graph_json" / "documents").glob("part-*") for x in f.read_text().splitlines()]
    assert {n["data"]["label"] for d in protein for n in d["elements"]["nodes"]} == {"P00002", "P00003", "P00009"}
    counts = {r["PDB_ID"]: int(r["n_contacts"]) for f in (folder / "contact_counts").glob("part-*.csv") for r in csv.DictReader(f.open())}
    assert counts["1ABC"] == sum(r["PDB_ID"] == "1ABC" for r in lines) and set(counts) == {"1ABC", "3DEF", "2XYZ", "TWO_MODELS"}


def test_written_networks_by_size(spark, tmp_path):
    """Small networks share files, a large one is a folder whose files are one document."""
    edges = [(f"N{i:03}", f"a{j}", f"b{j}", 1, "interacts_with") for i in range(60) for j in range(3 if i else 400)]
    nodes = sorted({(n, x) for n, a, b, *_ in edges for x in (a, b)})
    e = spark.createDataFrame(edges, "network string, source string, target string, all_atoms_count long, interaction string")
    n = spark.createDataFrame([(k, x, x, "t", "g", "m") for k, x in nodes], "network string, id string, name string, tooltip string, color_group string, molecule_name string")
    sinks.write_graph_json(n, e, str(tmp_path), "net", whole_lines=100)
    files = list((tmp_path / "net" / "graph_json" / "documents").glob("part-*"))
    documents = [json.loads(x) for f in files for x in f.read_text().splitlines()]
    assert len(files) <= 8 and sorted(d["data"]["name"] for d in documents) == [f"N{i:03}" for i in range(1, 60)]
    large = list((tmp_path / "net" / "graph_json" / "large").iterdir())
    folder, = (f for f in large if f.is_dir())
    whole = json.loads("".join(f.read_text() for f in sorted(folder.glob("part-*"))))
    assert folder.name == "network=N000" and len(whole["elements"]["edges"]) == 400 and len(whole["elements"]["nodes"]) == 800


def test_structures_without_contacts_are_counted(spark):
    structures = spark.createDataFrame([("A",), ("B",), ("B",)], "pdb_id string")
    contacts = spark.createDataFrame([("A",), ("A",)], "PDB_ID string")
    assert {tuple(r) for r in sinks.contact_counts(structures, contacts).collect()} == {("A", 2), ("B", 0)}


def test_compat_models_and_toggles(spark, setup):
    """m models give m * m rows per pair, all with the geometry of the first."""
    folder, paths = setup
    options = Options(output=str(folder / "out"), compat=True, search=False, combined_chain_network=False,
                      protein_per_structure=False, detailed_contacts=False, **paths)
    p = run(spark, options)
    assert not {"contacts", "combined_chain_edges", "protein_edges"} & set(p) and "combined_protein_edges" in p
    rows = p["interactions"].filter("pdb_id = 'TWO_MODELS'").collect()
    (_, _, a), (_, _, b) = parse(folder / "in" / "two_models.pdb")[:2]
    n = len(close(a, b, 5.0))
    assert sorted((r.chain_a, r.chain_b, r.all_atoms_count) for r in rows) == [
        ("TWO_MODELS:A", "TWO_MODELS:B", n)] * 3 + [("TWO_MODELS:B", "TWO_MODELS:A", n)]


def test_compat_contacts_use_the_last_model(spark, setup):
    """Contacts come from the last chain of a name; here the second model has none."""
    folder, paths = setup
    manifest = folder / "in" / "models.csv"
    manifest.write_text(f"file_path\n{folder}/in/two_models.pdb\n{folder}/in/1abc.pdb\n")
    inputs = {**paths, "manifest": str(manifest)}
    strict = run(spark, Options(output="", compat=True, search=False, **inputs))["contacts"]
    assert {r.PDB_ID for r in strict.collect()} == {"1ABC"}
    default = run(spark, Options(output="", search=False, **inputs))["contacts"]
    assert {r.PDB_ID for r in default.collect()} == {"1ABC", "TWO_MODELS"}


def test_water_flips_unmatched_protein(spark, setup):
    """Without accession and hit the residues decide, and a water makes a chain nucleic."""
    folder, paths = setup
    manifest = folder / "in" / "unlisted.csv"
    text = (folder / "in" / "1abc.pdb").read_text()
    (folder / "in" / "own.pdb").write_text(text.replace("HEADER", "REMARK"))
    manifest.write_text(f"file_path\n{folder}/in/own.pdb\n{folder}/in/own.pdb\n")
    options = Options(output="", search=False, **{**paths, "manifest": str(manifest)})
    p = run(spark, options)
    kinds = sorted((r.unique_chain_id, r.molecule_type) for r in p["chains"].collect())
    assert kinds == [("OWN:A", "Protein")] * 2 + [("OWN:B", "Nucleic Acid")] * 2
    assert p["interactions"].count() == 2 and {r.interaction_type for r in p["interactions"].collect()} == {
        "Protein-Nucleic Acid"}


def test_options(tmp_path):
    good = {"input_csv_path": "m", "pdb_fasta_path": "s", "uniprot_fasta_path": "n", "sifts_tsv_path": "x",
            "output_path": "o", "networks": {"chain_per_pdb": True, "combined_chain_network": False,
                                             "protein_per_pdb": True, "combined_protein_network": True},
            "distance_thresholds": {"ca_radius": 12.0, "all_atoms_radius": 4.0}}
    path = tmp_path / "config.json"
    path.write_text(json.dumps(good))
    options = Options.from_json(str(path))
    assert options.ca_radius == 12.0 and not options.combined_chain_network and not options.detailed_contacts
    path.write_text("{")
    with pytest.raises(ValueError):
        Options.from_json(str(path))
    with pytest.raises(KeyError):
        Options.from_json(str(tmp_path / "none.json"))

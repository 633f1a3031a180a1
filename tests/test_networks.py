import json

from pyspark.sql import functions as F

from structnet.operators import coloring, contacts, networks
from structnet.operators.chains import select_atoms
from structnet.operators.dedup import first_wins, last_wins
from structnet.sources import sinks

CHAINS = ("file_ord long, pdb_id string, chain_pos int, unique_chain_id string, molecule_name string, "
          "molecule_type string, uniprot_id string")
INTERACTIONS = ("file_ord long, chain_pos_a int, chain_pos_b int, chain_a string, chain_b string, "
                "all_atoms_count long")


def chains(spark):
    return spark.createDataFrame([
        (1, "1ABC", 0, "1ABC:A", "one", "Protein", "P1"), (1, "1ABC", 1, "1ABC:B", "two", "Protein", "P2"),
        (1, "1ABC", 2, "1ABC:C", "two", "Protein", "P2"), (1, "1ABC", 3, "1ABC:D", None, "Nucleic Acid", None),
        (2, "2XYZ", 0, "2XYZ:A", "uno", "Protein", "P1"), (2, "2XYZ", 1, "2XYZ:B", "three", "Protein", "P3"),
        (3, "3DEF", 0, "3DEF:A", "alone", "Protein", "P4"), (4, "1ABC", 0, "1ABC:A", "again", "Protein", "P9"),
    ], CHAINS)


def interactions(spark):
    return spark.createDataFrame([
        (1, 0, 2, "1ABC:A", "1ABC:C", 7), (1, 0, 1, "1ABC:A", "1ABC:B", 5), (1, 1, 2, "1ABC:B", "1ABC:C", 9),
        (1, 1, 3, "1ABC:B", "1ABC:D", 2), (2, 0, 1, "2XYZ:A", "2XYZ:B", 4), (5, 0, 1, "2XYZ:B", "2XYZ:A", 8),
        (2, 0, 1, "2XYZ:A", "2XYZ:B", 0),
    ], INTERACTIONS)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_protein_edges(spark):
    pairs = networks.protein_pairs(interactions(spark), chains(spark))
    # The last chain named 1ABC:A has accession P9; the first interaction of a pair gives the count.
    assert rows(networks.protein_edges(pairs), "network", "source", "target", "all_atoms_count") == [
        ("Protein_Network_1ABC", "P9", "P2", 5), ("Protein_Network_2XYZ", "P1", "P3", 4)]
    summed = networks.protein_pairs(interactions(spark), chains(spark), agg="sum")
    assert rows(summed, "uniprot_a", "uniprot_b", "all_atoms_count") == [("P1", "P3", 12), ("P9", "P2", 12)]
    largest = networks.protein_pairs(interactions(spark), chains(spark), per_structure=False, agg="max")
    assert rows(largest, "uniprot_a", "uniprot_b", "all_atoms_count") == [("P1", "P3", 8), ("P9", "P2", 7)]


def test_color_groups_and_nodes(spark):
    summary = networks.protein_summary(chains(spark))
    assert rows(summary, "uniprot_id", "color_group", "molecule_name") == [
        ("P1", "Multi", "uno"), ("P2", "1ABC", "two"), ("P3", "2XYZ", "three"), ("P4", "3DEF", "alone"),
        ("P9", "1ABC", "again")]
    edges = spark.createDataFrame([("n", "P1", "P7", 1, "x")], "network string, source string, target string, "
                                  "all_atoms_count long, interaction string")
    assert rows(networks.protein_nodes(edges, chains(spark)), "id", "tooltip", "color_group") == [
        ("P1", "uno", "Multi"), ("P7", "P7", "Multi")]


def test_chain_networks(spark):
    edges = networks.chain_edges(interactions(spark))
    nodes = networks.chain_nodes(chains(spark), edges)
    assert edges.count() == 6
    assert rows(nodes, "network", "id", "tooltip") == [
        ("Chain_Interaction_Network_1ABC", "1ABC:A", "one"), ("Chain_Interaction_Network_1ABC", "1ABC:B", "two"),
        ("Chain_Interaction_Network_1ABC", "1ABC:C", "two"), ("Chain_Interaction_Network_1ABC", "1ABC:D", "Unknown"),
        ("Chain_Interaction_Network_2XYZ", "2XYZ:A", "uno"), ("Chain_Interaction_Network_2XYZ", "2XYZ:B", "three")]
    assert networks.combined_chain_nodes(chains(spark), edges).count() == 8
    assert networks.combined_chain_nodes(chains(spark), edges.limit(0)).count() == 0


def test_colors(spark):
    nodes = spark.createDataFrame(
        [("Combined_Protein_Network", g) for g in ("B", "A", "C", "Multi", "A")] + [("Protein_Network_A", "Multi"),
                                                                                   ("Protein_Network_A", "A")],
        "network string, color_group string")
    assert rows(coloring.color_assignment(nodes), "network", "color_group", "color") == [
        ("Combined_Protein_Network", "A", "#1f77b4"), ("Combined_Protein_Network", "B", "#8c564b"),
        ("Combined_Protein_Network", "C", "#9edae5"), ("Combined_Protein_Network", "Multi", "#d62728"),
        ("Protein_Network_A", "A", "#1f77b4")]


def test_ranks_over_many_slices(spark):
    names = spark.range(5000).select((F.col("id") % 2).cast("string").alias("p"),
                                     F.lpad((5000 - F.col("id")).cast("string"), 5, "0").alias("v")).repartition(16)
    got = coloring.ranked(names, "p", "v").orderBy("p", "v").collect()
    assert [r["index"] for r in got] == list(range(2500)) * 2 and {r.n for r in got} == {2500}


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("k", 2, None), ("l", 1, None)], "k string, o int, v string")
    for d in (df, df.repartition(5), df.orderBy(F.desc("o"))):
        assert rows(first_wins(d, ["k"], ["o"], ["v"]).fillna("-"), "k", "v") == [("k", "a"), ("l", "-")]
        assert rows(last_wins(d, ["k"], ["o"], ["v"]).fillna("-"), "k", "v") == [("k", "c"), ("l", "-")]


def test_prefix_selection(spark):
    """An id that starts another id takes its interactions too."""
    structures = spark.createDataFrame([(1, "MODEL1"), (2, "MODEL12"), (3, "X")], "file_ord long, pdb_id string")
    found = spark.createDataFrame([(2, "MODEL12:A", "MODEL12:B"), (1, "MODEL1:A", "MODEL1:B")],
                                  "file_ord long, chain_a string, chain_b string")
    assert rows(contacts.interactions_by_prefix(structures, found), "structure_id", "chain_a") == [
        ("MODEL1", "MODEL12:A"), ("MODEL1", "MODEL1:A"), ("MODEL12", "MODEL12:A")]
    assert rows(contacts.interactions_by_id(structures, found), "structure_id", "chain_a") == [
        ("MODEL1", "MODEL1:A"), ("MODEL12", "MODEL12:A")]


def test_atom_selection(spark):
    """A calcium ion is named like a C-alpha atom and passes as one."""
    atoms = spark.createDataFrame([("CA", "C"), ("CA", "CA"), ("CB", "C")], "atom_name string, element string")
    assert [select_atoms(atoms, kind).count() for kind in ("ca", "all_atoms", "other")] == [2, 3, 0]


def test_graph_json(spark, tmp_path):
    edges = networks.combined_protein_edges(spark.createDataFrame(
        [("P1", 'P"2', 3), ("P1", 'P"2', 3), ("P2", "P3", 1)],
        "uniprot_a string, uniprot_b string, all_atoms_count long"))
    nodes = networks.protein_nodes(edges, chains(spark))
    sinks.write_graph_json(nodes, edges, str(tmp_path), "g", whole_lines=2)
    folder = tmp_path / "g" / "graph_json" / "large" / "network=Combined_Protein_Network"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    graph = json.loads(text)
    assert graph["data"] == {"name": "Combined_Protein_Network"}
    assert [n["data"]["id"] for n in graph["elements"]["nodes"]] == ['P"2', "P1", "P2", "P3"]
    assert [e["data"]["all_atoms_count"] for e in graph["elements"]["edges"]] == [3, 3, 1]

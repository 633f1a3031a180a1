"""What the contact queries read and shuffle, and small groups against cells."""

import random

import pytest
from pyspark.sql import functions as F

import workload
from structnet.operators import annotate, chains, contacts, keys, spatial
from structnet.operators.dedup import first_wins, last_wins

SF = "/root/testdata/sf0.001"


def scans(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("l_linenumber:int")


@pytest.mark.parametrize("name", ["chain_interactions", "chain_nodes", "protein_nodes", "prefix_join", "combined_protein_network", "selected_contacts", "atom_contacts"])
def test_chains_are_annotated_once(spark, name):
    """Lookups are read when the chains are staged; what is left reads the line items for atoms and structures only."""
    assert scans(workload.queries()[name](spark, SF)) <= 3


def test_small_structures_are_shuffled_once(spark):
    """The points of a small structure are one array: no join of points with points."""
    plan = workload.queries()["chain_interactions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "_cell_x" not in plan


@pytest.mark.parametrize("radius", [1.0, 5.0])
def test_small_groups_give_what_cells_give(spark, radius):
    draw = random.Random(4)
    rows = [(g, draw.randrange(4), *(float(draw.randrange(12)) if draw.random() < 0.97 else None for _ in "xyz"), draw.randrange(3)) for g in (1, 2, None) for _ in range(60)]
    points = spark.createDataFrame(rows, "g int, m int, x double, y double, z double, w long")
    levels = {"n": (radius, F.lit(1)), "k": (2 * radius, F.col("w"))}
    counts = [sorted(spatial.radius_counts(points, ["g"], "m", levels, small=small).collect()) for small in (False, True)]
    pairs = [sorted(spatial.radius_pairs(points, radius, ["g"], "m", ["w"], small=small).collect()) for small in (False, True)]
    assert counts[0] == counts[1] and pairs[0] == pairs[1] and counts[0] and pairs[0]


def test_low_hits_are_dropped_before_the_aggregate(spark):
    """A hit without a score does not hide a good one."""
    rows = [(1, "A", None), (1, "B", 95.0), (1, "C", 99.0), (2, "D", 89.0), (3, "E", None), (4, "G", 90.0), (4, "F", 90.0)]
    found = annotate.best_hits(spark.createDataFrame(rows, "k int, hit_id string, score double"), ["k"], 90)
    assert sorted(map(tuple, found.collect())) == [(1, "C"), (4, "F")]


def test_rows_that_tie_go_by_their_values(spark):
    rows = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, None, "c"), (2, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, last_wins(rows, ["k"], ["o"], ["v"]).collect())) == [(1, "b"), (2, None)]
    assert sorted(map(tuple, first_wins(rows, ["k"], ["o"], ["v"]).collect())) == [(1, "z"), (2, "c")]


def test_style_names_search_contacts_once(spark):
    """Both gates read the staged interactions."""
    plan = workload.queries()["style_name"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "_cell_x" not in plan


def test_gate_comes_before_the_atom_pairs(spark):
    """Small structures get the list of their close chains while they are one row each, so that no pair is joined."""
    plan = workload.queries()["atom_contacts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_whole") < plan.index("Join LeftOuter")


def spreads(df) -> list[str]:
    """Keys of every exchange by hash, the first one first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in plan.split("\n") if "hashpartitioning(" in line]


@pytest.mark.parametrize("name", ["annotate_chains", "xref_last_wins", "seqres_last_wins"])
def test_lookup_keys_sort_by_their_hash(spark, name):
    """Keys share their first bytes, so a sort by the key alone compares whole rows; the hash goes first wherever a lookup is spread."""
    keyed = [s for s in spreads(workload.queries()[name](spark, SF)) if "map_key" in s]
    assert 0 < len(keyed) <= 3 and not any(s.startswith("map_key#") for s in keyed)


@pytest.mark.parametrize("name", ["combined_chain_network", "chain_nodes", "protein_nodes", "combined_protein_nodes", "combined_protein_network_parallel"])
def test_atoms_of_small_structures_are_spread_by_file(spark, name, monkeypatch):
    """Where all structures are small, their atoms meet the chains by file and stay there: no join by chain."""
    found = []
    whole = contacts._by_source
    monkeypatch.setattr(contacts, "_by_source", lambda *a: found.append(whole(*a)) or found[-1])
    workload.queries()[name](spark, SF)
    spread = [s for s in spreads(found[0]) if not s.startswith("source#")]
    assert len(found) == 1 and not spread


def test_by_file_gives_what_by_chain_gives(spark, monkeypatch):
    """A file of two models that is listed twice, equal chain names, an unknown chain, atoms without coordinates or of no chain."""
    draw = random.Random(7)
    place = [(s, m, c) for s in (1, 2) for m in (1, 2) for c in "ABC"]
    rows = [(*draw.choice(place), draw.choice(["CA", "N", None]), *(float(draw.randrange(9)) if draw.random() < 0.97 else None for _ in "xyz")) for _ in range(300)]
    rows += [(2, 1, "HOH", "CA", 1.0, 1.0, 1.0), (3, 1, "A", "CA", 1.0, 1.0, 1.0), (1, 1, None, "CA", 1.0, 1.0, 1.0)]
    atoms = spark.createDataFrame(rows, "source long, model int, chain_id string, atom_name string, x double, y double, z double")
    kinds = {"A": "Protein", "B": "Nucleic Acid", "C": "Protein"}
    listed = [(s, m, c, f"{f}:{m}", m * 10 + ord(c), kinds[c] if (s, m, c) != (1, 2, "C") else "Unknown", f"/{f}", f"I{s}", f"I{s}:{c}", 250)
              for s, m, c in place for f in ((s, s + 10) if s == 1 else (s,))]
    chains = spark.createDataFrame(listed, "source long, model int, chain_id string, file_ord string, chain_pos int, molecule_type string, file_path string, pdb_id string, unique_chain_id string, source_atoms long")
    more = ["ca_count", "type_a", "type_b"]
    by_file = contacts.chain_interactions(atoms, chains, min_ca_pairs=1, more=more)
    by_chain = contacts.chain_interactions(atoms, chains.drop("source_atoms"), min_ca_pairs=1, more=more)
    assert by_file.columns == by_chain.columns and sorted(by_file.collect()) == sorted(by_chain.collect()) and by_file.count() > 10


def test_names_of_the_first_chain(spark):
    rows = [(2, 1, "X:A", "late"), (1, 5, "X:A", "second"), (1, 4, "X:A", None), (3, 1, "Y:A", "own"), (4, 1, None, "none")]
    found = chains.first_of_name(spark.createDataFrame(rows, "file_ord int, chain_pos int, unique_chain_id string, v string"))
    assert sorted(map(tuple, found.collect())) == [(1, 4, "X:A", None), (3, 1, "Y:A", "own")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hash_join_is_a_join(spark, how):
    a = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), (None, 1, 3), ("y", None, 4)], "k string, n int, v int")
    b = spark.createDataFrame([("x", 1, 7), ("x", 1, 8), (None, 1, 9)], "k string, n int, w int")
    got, want = keys.hash_join(a, b, ["k", "n"], how), a.join(b, ["k", "n"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("radius", [1.0, 5.0])
def test_held_groups_give_what_cells_give(spark, monkeypatch, radius):
    """Members that are structs, no group or member, missing coordinates and weights, groups of one point, several blocks of distances."""
    monkeypatch.setattr(spatial, "_AT_ONCE", 700)
    draw = random.Random(6)
    rows = [(g, h, (draw.randrange(3), draw.randrange(2)) if draw.random() < 0.97 else None, *(draw.randrange(24) / 2 if draw.random() < 0.97 else None for _ in "xyz"), draw.choice([None, 0, 1, 2]))
            for g, h, n in ((1, "a", 150), (1, "b", 90), (2, "a", 1), (3, None, 20), (None, "a", 20)) for _ in range(n)]
    points = spark.createDataFrame(rows, "g int, h string, m struct<p: int, q: int>, x double, y double, z double, w long")
    levels = {"n": (radius, F.lit(1)), "k": (2 * radius, F.col("w"))}
    cells, held = [spatial.radius_counts(points, ["g", "h"], "m", levels, **more) for more in ({"crowded": 16}, {"held": True})]
    assert cells.dtypes == held.dtypes
    assert sorted(cells.collect()) == sorted(held.collect()) and held.count() > 20
    assert spatial.radius_counts(points.limit(0), ["g", "h"], "m", levels, held=True).collect() == []


def test_crowded_structures_are_one_row(spark):
    """A supplier's items are shuffled as points, not once for each cell that they are near to, and pairs of points are no rows."""
    plan = workload.crowded_protein_edges(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell_x" not in plan and "_whole" in plan and "MapInArrow" in plan


def test_structures_of_all_sizes(spark, monkeypatch):
    """Small, held and large structures side by side give what cells give for all."""
    draw = random.Random(8)
    rows = [(f"f{s}", 1, "ABC"[i % 3], i, "", "ALA", "CA" if i % 2 else "C", "C", *(float(draw.randrange(20)) for _ in "xyz"), i) for s, n in enumerate((40, 90, 300)) for i in range(n)]
    atoms = spark.createDataFrame(rows, "source string, model int, chain_id string, residue_number int, insertion_code string, residue_name string, atom_name string, element string, x double, y double, z double, atom_pos int")
    files = spark.createDataFrame([(f"f{s}", s, f"/f{s}", f"F{s}") for s in range(3)], "source string, file_ord int, file_path string, pdb_id string")
    placed = chains.place_chains(chains.chain_table(atoms), files).withColumn("molecule_type", F.lit("Protein"))
    monkeypatch.setattr(contacts, "SMALL", 50)
    monkeypatch.setattr(contacts, "HELD", 100)
    found = contacts.chain_interactions(atoms, placed, crowded=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_cell_x" in plan and "MapInArrow" in plan
    want = contacts.chain_interactions(atoms, placed.drop("source_atoms"))
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() == 9

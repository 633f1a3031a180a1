import itertools
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import workload
from structnet.operators import chains as ch
from structnet.operators import contacts, spatial

COLUMNS = "g string, m int, x double, y double, z double"


def brute(points, r):
    found = Counter()
    for (g, m, *p), (h, n, *q) in itertools.permutations(points, 2):
        if g == h and m < n and (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= r * r:
            found[g, m, n] += 1
    return dict(found)


def counted(spark, points, r, **more):
    df = spark.createDataFrame(points, COLUMNS)
    got = spatial.radius_pair_count(df, r, ["g"], "m", **more).collect()
    return {(x.g, x.m_a, x.m_b): x.n_pairs for x in got}


@pytest.mark.parametrize("factor", [1.0, 2.0, 4.0, 16.0])
def test_random_points(spark, factor):
    rng = np.random.default_rng(7)
    xyz = rng.uniform(-20, 20, (240, 3)).tolist()
    points = [(f"g{i % 2}", i % 5, *p) for i, p in enumerate(xyz)]
    assert counted(spark, points, 5.0, cell_factor=factor) == brute(points, 5.0)


grid = st.integers(-12, 12).map(lambda i: i * 2.5)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 3), grid, grid, grid), max_size=25))
def test_borders_and_copies(spark, points):
    """Coordinates on cell borders, distances exactly at the radius, negative values, copies, empty sides."""
    assert counted(spark, points, 5.0) == brute(points, 5.0)


def test_rounding_at_the_radius(spark):
    """Distances that equal the radius only after rounding stay in."""
    steps = [0.1 * i for i in range(-40, 41)]
    points = [("g", 1, s, 0.0, 0.0) for s in steps] + [("g", 2, s + 0.3, 0.0, 0.0) for s in steps]
    for r in (0.1, 0.3, 0.7):
        assert counted(spark, points, r) == brute(points, r)


def test_one_group_with_one_dense_cell(spark):
    """A third of the points in one place: merged before the join, counts complete."""
    points = [("g", i % 2, 1.0, 1.0, 1.0) for i in range(3000)] + [("g", i % 2, 10.0 * i, 0.0, 0.0) for i in range(200)]
    df = spark.createDataFrame(points, COLUMNS)
    merged = spatial.merge_points(df, ["g", "m", "x", "y", "z"], n=F.lit(True))
    assert merged.count() == 202
    assert counted(spark, points, 2.0)["g", 0, 1] == brute([p for p in points if p[2] < 5], 2.0)["g", 0, 1]


@pytest.mark.parametrize("crowded", [None, 1, 5, 40])
def test_crowded_cells_are_cut(spark, crowded):
    """Sparse and packed groups, points on the borders of cells and parts: counts of two radii do not depend on the cut."""
    rng = np.random.default_rng(11)
    packed = np.round(rng.normal(0, 4, (300, 3)), 1).tolist()
    lattice = [[2.5 * i, 2.5 * j, -2.5 * k] for i in range(5) for j in range(5) for k in range(5)]
    sparse = rng.uniform(-200, 200, (100, 3)).tolist()
    points = [(g, i % 4, *map(float, p)) for g, some in (("packed", packed), ("lattice", lattice), ("sparse", sparse)) for i, p in enumerate(some)]
    df = spark.createDataFrame(points, COLUMNS)
    levels = {"near": (2.5, F.lit(1)), "far": (7.5, F.when(F.col("x") > 0, 1))}
    got = spatial.radius_counts(df, ["g"], "m", levels, crowded=crowded).collect()
    near, far = brute(points, 2.5), brute([p for p in points if p[2] > 0], 7.5)
    assert {(r.g, r.m_a, r.m_b): (r.near, r.far) for r in got} == {k: (near.get(k, 0), far.get(k, 0)) for k in {*near, *far}}


def test_cuts_bound_the_largest_part(spark):
    """A packed cell is spread over parts that hold few points, a sparse one stays whole."""
    rng = np.random.default_rng(5)
    points = [("g", i % 3, *map(float, p)) for i, p in enumerate(rng.uniform(0, 19.9, (4000, 3)).tolist())] + [("h", 1, 1.0, 1.0, 1.0), ("h", 2, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(points, COLUMNS).select("g", F.lit(0).alias("level"), *(F.col(c).alias(f"{c}_b") for c in "xyz"), *(F.floor(F.col(c) / 20).alias(f"_cell_{c}") for c in "xyz"), F.lit(5.0).alias("reach"))
    spread = df.withColumnsRenamed({f"{c}_b": f"{c}_a" for c in "xyz"})
    keys = ["g", "level", "_cell_x", "_cell_y", "_cell_z"]
    home, _, parts = spatial._cut(df, spread, keys, spatial.XYZ, keys[2:], {"n": (5.0, F.lit(1))}, 4.0, 100)
    sizes = {(r.g, r["count"]) for r in home.groupBy(*keys, *parts).count().collect()}
    assert max(n for g, n in sizes if g == "g") < 130 and ("h", 2) in sizes


@pytest.mark.parametrize("crowded", [None, 5])
def test_small_groups_meet_in_one_cell(spark, crowded):
    """Counts and pairs do not depend on which groups are whole; a whole group's points are one row on each side."""
    rng = np.random.default_rng(13)
    points = [(g, i % 4, *map(float, p)) for g, width in (("a", 8), ("b", 40), ("c", 300)) for i, p in enumerate(np.round(rng.uniform(-width, width, (80, 3)), 1).tolist())]
    df = spark.createDataFrame(points, COLUMNS)
    levels = {"near": (2.5, F.lit(1)), "far": (7.5, F.when(F.col("x") > 0, 1))}
    near, far = brute(points, 2.5), brute([p for p in points if p[2] > 0], 7.5)
    for some in (["a"], ["a", "c"], ["a", "b", "c"]):
        flagged = df.withColumn("whole", F.col("g").isin(some))
        got = spatial.radius_counts(flagged, ["g"], "m", levels, crowded=crowded, whole="whole").collect()
        assert {(r.g, r.m_a, r.m_b): (r.near, r.far) for r in got} == {k: (near.get(k, 0), far.get(k, 0)) for k in {*near, *far}}
        pairs = spatial.radius_pair_count(flagged, 7.5, ["g"], "m", whole="whole").collect()
        assert {(r.g, r.m_a, r.m_b): r.n_pairs for r in pairs} == brute(points, 7.5)


def test_small_structures_are_not_copied(spark):
    """The chains of a structure know its size, and a small structure's atoms are shuffled once a side, not once a cell and radius."""
    atoms, rows = workload.annotated_atoms(spark, "/root/testdata/sf0.001")
    sizes = rows.groupBy("file_ord").agg(F.max("source_atoms").alias("size"), F.sum("n_atoms").alias("n"))
    assert sizes.where("size <> n").count() == 0 and sizes.count() > 0
    points = contacts.contact_points(ch.chain_atoms(atoms, contacts._sized(rows)[0], "molecule_type", "whole"))
    assert points.where("whole").count() == points.join(sizes.where(F.col("size") <= contacts.SMALL), "file_ord").count() > 0
    plan = contacts.chain_interactions(atoms, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "whole" in plan


def test_partitioning_does_not_matter(spark):
    rng = np.random.default_rng(3)
    points = [("g", i % 3, *p) for i, p in enumerate(rng.uniform(0, 30, (90, 3)).tolist())]
    df = spark.createDataFrame(points, COLUMNS)
    results = [sorted(map(tuple, spatial.radius_pair_count(d, 6.0, ["g"], "m").collect()))
               for d in (df.repartition(7), df.coalesce(1), df.orderBy(F.desc("x")))]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("name", ["radius_pair_count", "chain_interactions",
                                  "atom_contacts", "prefix_join", "best_match"])
def test_no_nested_loops(spark, name):
    plan = workload.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = workload.radius_pair_count(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.split("ReadSchema")[1] and "l_extendedprice" not in plan.split("ReadSchema")[1]

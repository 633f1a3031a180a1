import pytest
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("path, suffix, stem", [
    ("/a/1abc.pdb", ".pdb", "1abc"), ("/a/1abc.PDB", ".PDB", "1abc"), ("x.pdb.gz", ".gz", "x"), (".pdb", "", ""),
    ("/a.b/c", "", "c"), ("/a/..x.cif", ".cif", ""), ("/a/b.c.mmcif", ".mmcif", "b")])
def test_paths(spark, path, suffix, stem):
    assert value(spark, rules.suffix(F.lit(path))) == suffix
    assert value(spark, rules.stem(F.lit(path))) == stem


@pytest.mark.parametrize("a, b, expected", [
    ("Protein", "Protein", "Protein-Protein"), ("Protein", "Nucleic Acid", "Protein-Nucleic Acid"),
    ("Nucleic Acid", "Protein", "Protein-Nucleic Acid"), ("Nucleic Acid", "Nucleic Acid", "Nucleic Acid-Nucleic Acid"),
    ("Unknown", "Protein", None), ("UNKNOWN", "Protein", "Unknown"), ("UNKNOWN", "UNKNOWN", "Unknown"),
    ("UNKNOWN", "Nucleic Acid", "Nucleic Acid-Nucleic Acid"), (None, "Protein", None)])
def test_interaction_type(spark, a, b, expected):
    assert value(spark, rules.interaction_type(F.lit(a).cast("string"), F.lit(b))) == expected


@pytest.mark.parametrize("d, expected", [(0.125, 0.12), (0.375, 0.38), (4.999, 5.0), (1.005, 1.0)])
def test_round_half_even(spark, d, expected):
    assert value(spark, rules.round2(F.lit(d))) == expected


def test_headers_and_labels(spark):
    info = F.lit("mol:protein length:141  HEMOGLOBIN (ALPHA CHAIN)")
    assert value(spark, rules.clean_header(info)) == "HEMOGLOBIN (ALPHA CHAIN)"
    assert value(spark, rules.header_type(info)) == "Protein"
    assert value(spark, rules.header_type(F.lit("mol:na length:3 X"))) == "Nucleic Acid"
    assert value(spark, rules.residue_label(F.lit(None).cast("int"), F.lit("ALA"))) == "?:ALA"
    assert value(spark, rules.one_letter(F.lit("SEC"))) == "X" and value(spark, rules.one_letter(F.lit("TRP"))) == "W"


@pytest.mark.parametrize("title, style", [
    ("Chain_Interaction_Network_1ABC", "p_Chain_Style"), ("Combined_Network", "p_Protein_Style"),
    ("Protein_Network_1ABC", "p_Protein_Style"), ("Combined_Protein_Network", "p_Protein_Combined_Style")])
def test_style(spark, title, style):
    assert value(spark, rules.style_name(F.lit(title), "p")) == style


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 21, 50])
def test_palette(spark, n):
    """The i-th of n evenly spaced positions in [0, 1], the last one on the last color."""
    got = [r[0] for r in spark.range(n).select(rules.palette_color(F.col("id"), F.lit(n))).collect()]
    step = 1 / max(n - 1, 1)
    want = [K.PALETTE[min(int((1.0 if n > 1 and i == n - 1 else i * step) * 20), 19)] for i in range(n)]
    assert sorted(got) == sorted(want)


def test_large_residue_numbers(spark):
    from structnet.sources.structures import residue_number

    shown = {"   7": 7, "-12": -12, "9999": 9999, "A000": 10000, "A00A": 10010, "ZZZZ": 1223055, "a000": 1223056, "zzzz": 2436111, "": None, "1?": None}
    rows = spark.createDataFrame(list(shown.items()), "field string, n int").selectExpr("trim(field) AS field", "n")
    assert all(r.n == r.found for r in rows.select("n", residue_number(rows["field"]).alias("found")).collect())


def test_points_keep_null_labels(spark):
    from structnet.operators.spatial import radius_pair_count

    points = spark.createDataFrame([(1, 1, None, 0.0, 0.0, 0.0), (1, 2, None, 1.0, 0.0, 0.0), (1, 3, "c", None, 0.0, 0.0)],
                                   "g int, m int, label string, x double, y double, z double")
    assert [r.n_pairs for r in radius_pair_count(points, 2.0, ["g"], "m", ["label"]).collect()] == [1]

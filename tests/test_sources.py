import pytest
from pyspark.sql import functions as F

from samples import cif_row, loop_rows, pdb_line, write_inputs
from structnet.operators import annotate
from structnet.operators import chains as ch
from structnet.sources import identifiers, lookups, structures
from structnet.plans.pipeline import read_structures
from structnet.sources.manifest import Batch, batches, name_filter, read_manifest, structure_files


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("in put+dir")
    return folder, write_inputs(folder)


def whole(folder, *names):
    """All files of a folder, or some, as a batch."""
    names = list(names) or [f.name for f in folder.iterdir()]
    return Batch([f"{folder}/"], names, [f"{folder}/{n}" for n in names])


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_manifest_order_and_suffix(spark, inputs):
    folder, paths = inputs
    manifest = read_manifest(spark, paths["manifest"])
    names = [r.file_path.rsplit("/", 1)[1] for r in manifest.orderBy("file_ord").collect()]
    assert names[:3] == ["1abc.pdb", "notes.txt", "model1.pdb"] and len(names) == 11
    kept = {r.file_path.rsplit("/", 1)[1] for r in structure_files(manifest).collect()}
    assert "x.pdb.gz" not in kept and "notes.txt" not in kept and "nucleic.cif" in kept


def test_manifest_of_several_files(spark, tmp_path):
    """Every row has a number of its own, file by file, whatever the splits are."""
    folder = tmp_path / "part s+1"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.csv").write_text("file_path\n" + "".join(f"/d/{k}-{i:03}.pdb\n" for i in range(1 if k == 1 else 200)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (size, "2048"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got = read_manifest(spark, str(folder)).select("file_ord", "file_path").collect()
        assert len({r.file_ord for r in got}) == 401
        assert [r.file_path for r in sorted(got)] == sorted(r.file_path for r in got)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_manifest_needs_column(spark, tmp_path):
    (tmp_path / "m.csv").write_text("path\na.pdb\n")
    with pytest.raises(ValueError):
        read_manifest(spark, str(tmp_path / "m.csv"))


def test_missing_files_and_folders_are_left_out(spark, inputs, tmp_path):
    folder, _ = inputs
    (tmp_path / "m.csv").write_text(f"file_path\n/nowhere/1abc.pdb\n{folder}/1abc.pdb\n{folder}/gone.pdb\n")
    found, = batches(read_manifest(spark, str(tmp_path / "m.csv")))
    assert found.folders == ["/nowhere/", f"{folder}/"] and found.names == ["1abc.pdb", "gone.pdb"]
    chunks = structures.scan_pdb(spark, found)
    assert {r.source for r in chunks.select("source").collect()} == {f"{folder}/1abc.pdb"}
    assert structures.scan_cif(spark, found) is None
    assert structures.scan_pdb(spark, Batch(["/nowhere/"], ["1abc.pdb"], ["/nowhere/1abc.pdb"])) is None


ODD_NAMES = ["a b+c%.pdb", "x{1,2}.pdb", "[y]*?.PDB", "back\\slash.pdb", "z,.pdb", "plain.pdb"]


def test_only_listed_files_are_opened(spark, tmp_path):
    """Ten listed files in folders of two thousand: ten are scanned, names with special characters included."""
    line = pdb_line(1, "CA", "ALA", "A", 1, 1, 2, 3)
    for sub in ("p", "q+r s"):
        (tmp_path / sub).mkdir()
        for i in range(1000):
            (tmp_path / sub / f"f{i}.pdb").write_text(line + "\n")
    for n in ODD_NAMES:
        (tmp_path / "p" / n).write_text(line + "\n")
    listed = [tmp_path / "p" / n for n in ODD_NAMES] + [tmp_path / "p" / "f3.pdb", tmp_path / "p" / "f7.pdb", tmp_path / "q+r s" / "f3.pdb", tmp_path / "q+r s" / "f9.pdb"]
    quoted = "".join('"%s"\n' % p for p in listed)
    (tmp_path / "m.csv").write_text("file_path\n" + quoted)
    manifest = structure_files(read_manifest(spark, str(tmp_path / "m.csv")))
    one = [b for b in batches(manifest) for _ in b.folders]
    assert len(one) == 2 and len(one[0].listed) == 10
    chunks = structures.scan_pdb(spark, one[0])
    assert len(chunks.inputFiles()) <= 12 and {r.source for r in chunks.select("source").collect()} == set(map(str, listed))
    single = structures.scan_pdb(spark, whole(tmp_path / "p", *ODD_NAMES))
    assert len(single.inputFiles()) == len(ODD_NAMES)
    atoms, _ = read_structures(spark, manifest, batch_files=3)  # four batches
    assert {r.source for r in atoms.collect()} == set(map(str, listed)) and atoms.count() == 10
    assert name_filter(["a,b"]) == r"{a\,b}"


def test_many_manifest_files(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for k in range(1100):
        (folder / f"part-{k:05}.csv").write_text(f"file_path\n/d/{k:05}.pdb\n")
    got = read_manifest(spark, str(folder)).orderBy("file_ord").collect()
    assert [r.file_path for r in got] == [f"/d/{k:05}.pdb" for k in range(1100)]


def test_pdb_scan(spark, inputs):
    folder, paths = inputs
    chunks = structures.scan_pdb(spark, whole(folder))
    atoms = structures.pdb_atoms(chunks).filter(F.col("source").endswith("/1abc.pdb"))
    assert atoms.count() == 50 and ch.heavy_atoms(atoms).count() == 49
    first = atoms.orderBy("atom_pos").first()
    assert (first.atom_name, first.residue_name, first.chain_id, first.residue_number, first.x) == ("CA", "ALA", "A", 1, 0.0)
    assert first.source == f"{folder}/1abc.pdb"
    models = structures.pdb_atoms(chunks).filter(F.col("source").endswith("two_models.pdb"))
    assert models.select("model").distinct().count() == 2
    table = ch.chain_table(models)
    assert table.count() == 4
    kept = ch.first_model(table)
    placed = ch.chain_atoms(models, ch.place_chains(kept, models.select(
        "source", F.lit(1).alias("file_ord"), F.lit("p").alias("file_path"), F.lit("ID").alias("pdb_id")).distinct()))
    assert placed.agg(F.max("y")).first()[0] == 4.0
    water = ch.chain_table(structures.pdb_atoms(chunks).filter(F.col("source").endswith("water_only.pdb")))
    assert water.count() == 0


@pytest.mark.parametrize("padded, element", [(" CA ", "C"), ("CA  ", "CA"), ("1HB ", "H"), ("HG11", "H"),
                                             ("C210", "C"), (" D  ", "D"), ("FE  ", "FE"), ("H1  ", "H")])
def test_guessed_element(spark, padded, element):
    assert spark.range(1).select(structures.guessed_element(F.lit(padded))).first()[0] == element


def test_cif_scan(spark, inputs):
    folder, _ = inputs
    lines = structures.scan_cif(spark, whole(folder))
    splits = structures.cif_splits(lines)
    atoms = structures.cif_atoms(lines).filter(F.col("source").endswith("nucleic.cif"))
    assert atoms.count() == 11
    got = {tuple(r) for r in rows(ch.heavy_atoms(atoms), "chain_id", "atom_name", "residue_name")}
    assert got == {("N", "C1'", "DA"), ("P", "CA", "ALA")}
    normal, strict = structures.cif_content_ids(splits), structures.cif_content_ids(splits, compat=True)
    by_file = {r.source.rsplit("/", 1)[1]: r.content_id for r in normal.collect()}
    assert by_file == {"nucleic.cif": "2XYZ", "comment_first.cif": "2XYZ"}
    assert {r.source.rsplit("/", 1)[1] for r in strict.collect()} == {"nucleic.cif"}


def test_cif_tokens(spark):
    line = """ATOM 1 "O5'" 'a b' 'it's' . "x"y" """
    assert spark.range(1).select(structures.cif_tokens(F.lit(line))).first()[0] == [
        "ATOM", "1", "O5'", "a b", "it's", ".", 'x"y']


def test_identifiers(spark, inputs):
    folder, paths = inputs
    valid = identifiers.valid_ids(lookups.read_fasta(spark, paths["sequence_headers"]))
    assert {r.pdb_id for r in valid.collect()} == {"1ABC", "2XYZ", "3DEF", "NOID"}
    files = structure_files(read_manifest(spark, paths["manifest"]))
    content = (structures.pdb_header_ids(structures.scan_pdb(spark, whole(folder)))
               .unionByName(structures.cif_content_ids(structures.cif_splits(structures.scan_cif(spark, whole(folder))))))
    found = {r.file_path.rsplit("/", 1)[1]: r.pdb_id for r in identifiers.resolve_ids(files, content, valid).collect()}
    assert found == {"1abc.pdb": "1ABC", "model1.pdb": "3DEF", "broken.pdb": "BROKEN", "nucleic.cif": "2XYZ",
                     "missing.pdb": "MISSING", "water_only.pdb": "WATER_ONLY", "empty.pdb": "EMPTY",
                     "two_models.pdb": "TWO_MODELS", "comment_first.cif": "2XYZ"}


def test_stem_uses_first_dot(spark):
    files = spark.createDataFrame([("a", "/d/1abc.v2.pdb"), ("b", "/d/9zzz.pdb")], "source string, file_path string")
    content = spark.createDataFrame([("b", "TOOLONG")], "source string, content_id string")
    valid = spark.createDataFrame([("1ABC",)], "pdb_id string")
    got = {r.source: r.pdb_id for r in identifiers.resolve_ids(files, content, valid).collect()}
    assert got == {"a": "1ABC", "b": "9ZZZ"}


def test_lookups(spark, inputs):
    _, paths = inputs
    xref = {r.map_key: r.uniprot_id for r in lookups.read_xref(spark, paths["cross_reference"]).collect()}
    assert xref == {"pdb_CHAIN": "SP_PRIMARY", "1abc_A": "P00002", "1abc_B": "P00003", "3def_A": "P00002"}
    records = lookups.read_fasta(spark, paths["protein_names"])
    names = {r.uniprot_id: (r.protein_name, r.sequence) for r in lookups.protein_names(records).collect()}
    assert names == {"P00001": ("New name", "MKT"), "P00002": ("Second protein OS=Test GN=two", "MKTAGL"),
                     "P00009": ("Straight chain", "AGLSVKEDFYWM")}
    with pytest.raises(Exception, match="malformed header"):
        lookups.protein_names(records, strict=True).collect()
    headers = {r.map_key: (r.info, r.sequence) for r in
               lookups.sequence_headers(lookups.read_fasta(spark, paths["sequence_headers"])).collect()}
    assert headers == {"1abc_A": ("mol:protein length:12 CHAIN A", "AGLSVKEDFYWM"),
                       "2xyz_N": ("mol:na length:5 DNA strand", "AAAAA"),
                       "3def_C": ("mol:protein length:12 thing", "AGLSV")}


def test_rows_keep_file_order_over_splits(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text("".join(f"1abc\tA\tP{i:05d}\n" for i in range(3000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        assert lookups.read_xref(spark, str(path)).first().uniprot_id == "P02999"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def cif_text(name, n):
    """A file with a long loop, text fields that hold what looks like loops, and a second data block."""
    own = [cif_row(i + 1, "C", "CA" if i % 2 else "\"C1'\"", "ALA", "X", "P", i + 1, i, 2 * i, 3) for i in range(n)]
    fake = [cif_row(900 + i, "C", "CB", "TRP", "X", "Z", i + 1, 0, 0, 0) for i in range(30)]
    text = ["_struct.title", ";a title", "loop_", "_atom_site.id", *fake, "data_9BAD", ";"]
    first = loop_rows([], "data_" + name).split("\n")
    cut = first.index("#", first.index("_atom_site.group_PDB"))
    lines = [*first[:4 - 1], *text, "# _entry.id   9BAD", *first[3:cut], *own, "", *own[:1], *first[cut:], *text, *loop_rows(fake, "data_SECOND").split("\n")]
    return "\n".join(lines) + "\n", n + 1


@pytest.mark.parametrize("split", [None, 64, 97, 300, 1000])
def test_cif_loops_cross_splits(spark, tmp_path, split):
    """The atoms do not depend on where the text is cut: in headers, rows, or text fields."""
    want = {}
    for k in range(3):
        text, n = cif_text(f"{k}XYZ", 40 + 30 * k)
        (tmp_path / f"f{k}.cif").write_text(text)
        want[f"{k}XYZ"] = n
    (tmp_path / "none.cif").write_text("data_NONE\n_entry.id NONE\n;text\n;\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = structures.scan_cif(spark, whole(tmp_path))
        assert not split or lines.select("source", "at.block").distinct().count() > 4
        splits = structures.cif_splits(lines)
        atoms = structures.cif_atoms(lines, splits)
        ids = {r.source: r.content_id for r in structures.cif_content_ids(splits).collect()}
        got = {}
        for r in atoms.collect():
            got.setdefault(ids[r.source], []).append(r)
        assert {k: len(v) for k, v in got.items()} == want and set(ids.values()) == {*want, "NONE"}
        for found in got.values():
            found = sorted(found, key=lambda r: r.atom_pos)
            assert [r.x for r in found] == [*map(float, range(len(found) - 1)), 0.0]
            assert {(r.chain_id, r.residue_name, r.z) for r in found} == {("P", "ALA", 3.0)} and {r.atom_name for r in found} == {"CA", "C1'"}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_one_bad_atom_costs_one_atom(spark, tmp_path):
    lines = [pdb_line(i, "CA", "ALA", "A", i, i, 0, 0) for i in range(1, 9)]
    lines[3] = lines[3][:30] + "    ?   " + lines[3][38:]
    (tmp_path / "some.pdb").write_text("\n".join(lines) + "\n")
    (tmp_path / "none.pdb").write_text(lines[3] + "\n")
    (tmp_path / "m.csv").write_text(f"file_path\n{tmp_path}/some.pdb\n{tmp_path}/none.pdb\n{tmp_path}/gone.pdb\n{tmp_path}/a.txt\n\"\"\n")
    manifest = read_manifest(spark, str(tmp_path / "m.csv"))
    atoms, _ = read_structures(spark, structure_files(manifest))
    assert structures.readable_atoms(atoms).count() == 7
    assert {r.source.rsplit("/", 1)[1]: r.n_atoms for r in structures.skipped_atoms(atoms).collect()} == {"some.pdb": 1, "none.pdb": 1}
    got = [r.reason for r in structures.rejected_files(manifest, atoms).orderBy("file_ord").collect()]
    assert got == ["unreadable coordinates", "missing, unreadable or without atoms", "suffix", "suffix"]


def test_lookups_are_cut_down_before_last_wins(spark, tmp_path):
    """Only keys that some chain has are aggregated, with the same rows for these as from the whole lookup."""
    rows = "".join(f"{i % 9999:04}\tA\tP{i:06}\n" for i in range(30_000))
    (tmp_path / "x.tsv").write_text(rows)
    chains = spark.createDataFrame([("0007", "A"), ("0007", "A"), ("9998", "a"), ("NOPE", "B"), (None, "A")], "pdb_id string, chain_id string")
    whole = {r.map_key: r.uniprot_id for r in lookups.read_xref(spark, str(tmp_path / "x.tsv")).collect()}
    cut = lookups.read_xref(spark, str(tmp_path / "x.tsv"), lambda r: annotate.wanted(r, chains))
    assert {r.map_key: r.uniprot_id for r in cut.collect()} == {k: whole[k] for k in ("0007_A", "9998_A")}
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Aggregate" in x or "LeftSemi" in x]
    assert "Aggregate" in lines[0] and "LeftSemi" in lines[1], plan  # the join lies below the aggregate of the lookup


def test_cif_columns_are_not_looked_up_by_row(spark):
    """Two loops with columns in another order, rows that are too short: the same cells, without a search of names in each row."""
    text = ["data_X", "loop_", "_atom_site.Cartn_x", "_atom_site.type_symbol", "_atom_site.auth_asym_id", "1.5 c A", "2.5 .", "?", "#",
            "loop_", "_atom_site.label_asym_id", "_atom_site.Cartn_x", "B 3.5"]
    rows = [("/x.cif", (0, i), line) for i, line in enumerate(text)]
    lines = spark.createDataFrame(rows, "source string, at struct<block:long,row:long>, value string").coalesce(1)
    atoms = structures.cif_atoms(lines)
    assert sorted((r.chain_id, r.element, r.x) for r in atoms.collect() if r.x) == [("", "", 2.5), ("A", "C", 1.5), ("B", "", 3.5)]
    assert "array_position" not in atoms._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_pdb_model_is_many_rows(spark, tmp_path):
    """Rows are lines, however many atoms a model has, and models that go over several splits keep their number."""
    line = pdb_line(1, "CA", "ALA", "A", 1, 1, 2, 3)
    models = [["HEADER", line, line], *[[f"MODEL     {n:4}", *[line] * n, "ENDMDL"] for n in (200, 1, 300)]]
    for name, rest in (("a", models), ("b", models[1:])):
        (tmp_path / f"{name}.pdb").write_text("\r\n".join(x for m in rest for x in m) + "\r\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        lines = structures.scan_pdb(spark, whole(tmp_path))
        assert lines.select(F.max(F.length(lines.columns[-1]))).first()[0] == 78
        assert structures.pdb_splits(lines).count() > 20
        atoms = structures.pdb_atoms(lines)
        assert len({(r.source, r.atom_pos) for r in atoms.collect()}) == 1004
        found = {n: [r["count"] for r in atoms.filter(F.col("source").endswith(f"{n}.pdb")).groupBy("model").count().orderBy("model").collect()] for n in "ab"}
        assert found == {"a": [2, 200, 1, 300], "b": [200, 1, 300]}
        assert structures.pdb_header_ids(lines).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

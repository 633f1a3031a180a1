"""Atom rows from PDB and mmCIF files.

Both scans read text that Spark can split, so a large file is read by many
tasks, and both give the atom columns of ``operators.chains``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structnet.functions import rules
from structnet.sources.manifest import Batch, read_listed

ATOM_COLUMNS = ["source", "model", "chain_id", "residue_number", "insertion_code", "residue_name",
                "atom_name", "element", "x", "y", "z", "atom_pos"]
PDB_SUFFIXES, CIF_SUFFIXES = (".pdb",), (".cif", ".mmcif")


# --- PDB ------------------------------------------------------------------

def scan_pdb(spark: SparkSession, batch: Batch) -> DataFrame | None:
    """Lines of the batch's PDB files with their position: ``source, at, value``; None if it has no such file.

    A row is a line, so neither the number of models nor the size of one matters. A task holds whole splits, each in order.
    """
    return read_listed(spark, batch, PDB_SUFFIXES, "\n")


def guessed_element(padded_name: Column) -> Column:
    """Element from the four name columns, for files without element columns.

    A blank or digit first leaves one letter; four letters that start with H
    or D are hydrogens; otherwise the first two columns are the symbol.
    """
    name = F.upper(F.rpad(padded_name, 4, " "))
    first = F.substring(name, 1, 1)
    return (F.when(first.rlike("[ 0-9]"), F.substring(name, 2, 1))
            .when(F.substring(name, 2, 1).rlike("[0-9]"), first)
            .when((F.substring(name, 4, 1) != " ") & first.isin("H", "D"), first)
            .otherwise(F.trim(F.substring(name, 1, 2))))


def residue_number(field: Column) -> Column:
    """A four-column residue number. From 10000 on, files count in base 36: A000 to ZZZZ, then a000 to zzzz."""
    step = 36 ** 3
    base = F.conv(field, 36, 10).try_cast("int") - 10 * step + 10000
    return (F.when(field.rlike("^[A-Z][0-9A-Z]{3}$"), base).when(field.rlike("^[a-z][0-9a-z]{3}$"), base + 26 * step)
            .otherwise(field.try_cast("int")))


def pdb_fields(line: Column) -> dict[str, Column]:
    """The columns of an ``ATOM`` / ``HETATM`` line."""
    def cut(start: int, length: int) -> Column:
        return F.trim(F.substring(line, start, length))

    symbol = F.upper(cut(77, 2))
    return {
        "chain_id": cut(21, 2),
        "residue_number": residue_number(cut(23, 4)),
        "insertion_code": cut(27, 1),
        "residue_name": cut(18, 3),
        "atom_name": cut(13, 4),
        "element": F.when(symbol.rlike("[A-Z]"), symbol).otherwise(guessed_element(F.substring(line, 13, 4))),
        "x": cut(31, 8).try_cast("double"),
        "y": cut(39, 8).try_cast("double"),
        "z": cut(47, 8).try_cast("double"),
    }


def _starts_model() -> Column:
    return F.startswith("value", F.lit("MODEL "))


def pdb_splits(lines: DataFrame) -> DataFrame:
    """One row per split of a file: ``source, block, before``, the number of ``MODEL`` lines before the split."""
    own = lines.groupBy("source", F.col("at.block").alias("block")).agg(F.count_if(_starts_model()).alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("source", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("before"))


_NUMBERED = pa.schema([("source", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("number", pa.int64()), ("value", pa.string())])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines but those that start a model, with the number of such lines before them in their split."""
    key, seen = None, 0
    for now, part in _splits(batches):
        if now != key:
            key, seen = now, 0
        starts = pc.starts_with(part.column("value"), "MODEL ").to_numpy(zero_copy_only=False)
        number = seen + np.cumsum(starts)
        seen = int(number[-1])
        rows = [*(part.column(c) for c in ("source", "block", "row")), pa.array(number, pa.int64()), part.column("value")]
        yield pa.RecordBatch.from_arrays(rows, schema=_NUMBERED).filter(pa.array(~starts))


def pdb_atoms(lines: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """The atom records. ``model`` counts the ``MODEL`` lines of the file before them, so it is 0 where there are none.

    ``splits`` is :func:`pdb_splits` of the same lines.
    """
    splits = pdb_splits(lines) if splits is None else splits
    record = F.upper(F.substring("value", 1, 6)).isin("ATOM", "ATOM  ", "HETATM")
    flat = lines.filter(record | _starts_model()).select("source", F.col("at.block").alias("block"), F.col("at.row").alias("row"), "value")
    found = flat.mapInArrow(_numbered, "source string, block long, row long, number long, value string")
    rows = found.join(F.broadcast(splits), ["source", "block"])  # as many as the scan has splits, which the driver plans one by one
    none = F.lit(0).cast("long")
    return rows.select(
        "source", F.struct(none.alias("block"), (F.col("before") + F.col("number")).alias("row")).alias("model"),
        *[c.alias(n) for n, c in pdb_fields(F.col("value")).items()],
        F.struct("block", "row", none.alias("line")).alias("atom_pos")
    ).select(*ATOM_COLUMNS)


def pdb_header_ids(lines: DataFrame) -> DataFrame:
    """Per file the last token of its first ``HEADER`` line, upper case."""
    found = F.regexp_extract("value", r"(?m)^HEADER.*?(\S+)[ \t]*$", 1)
    return (lines.filter(F.startswith("value", F.lit("HEADER"))).withColumn("found", F.upper(found)).filter("found <> ''")
            .groupBy("source").agg(F.min_by("found", "at").alias("content_id")))


# --- mmCIF ----------------------------------------------------------------

def scan_cif(spark: SparkSession, batch: Batch) -> DataFrame | None:
    """Lines with their position: ``source, at, value``. A task holds whole splits, each in order."""
    return read_listed(spark, batch, CIF_SUFFIXES, "\n")


def cif_tokens(line: Column) -> Column:
    """Tokens of a CIF line; quotes end only before a blank, so ``'a'b'`` is one token."""
    pattern = F.lit(r"""('(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|\S+)""")
    tokens = F.regexp_extract_all(line, pattern, 1)
    return F.transform(tokens, lambda t: F.regexp_replace(t, r"""^(['"])(.*)\1$""", "$2"))


_MARKER = r"^(#|_|loop_|data_|save_)"
_STATE = "struct<outside: int, closes: boolean, items: array<string>, blocks: int>"


class _Marks:
    """What the lines of a batch are, in Arrow: marks, text borders, and the parity of text borders before each line."""

    def __init__(self, batch: pa.RecordBatch, odd: int) -> None:
        value = batch.column("value")
        lower = pc.utf8_lower(value)
        self.border = pc.starts_with(value, ";").to_numpy(zero_copy_only=False)
        self.parity = (odd + np.cumsum(self.border) - self.border) % 2
        self.odd = int((odd + self.border.sum()) % 2)
        self.mark = pc.match_substring_regex(lower, _MARKER).to_numpy(zero_copy_only=False) & ~self.border
        self.header = pc.starts_with(lower, "_atom_site.").to_numpy(zero_copy_only=False) & self.mark
        self.value, self.lower = value, lower


class _Loop:
    """Where a split stands in its file, if ``outside`` text fields at the first parity of borders: the item names of an
    atom loop that is open, whether something closed the one from before, and the data blocks begun."""

    def __init__(self) -> None:
        self.items: list[str] = []
        self.closes, self.blocks = False, 0

    def mark(self, line: str) -> None:
        if line.startswith("_atom_site.") and self.blocks <= 1:
            self.items.append(line.split()[0].removeprefix("_atom_site."))
            return
        self.items, self.closes = [], True
        self.blocks += line.startswith("data_")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of rows of one split; a task reads its splits one after the other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("source"), batch.column("block").to_numpy()
        change = np.flatnonzero((block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            yield (path[int(a)].as_py(), int(block[a])), batch.slice(int(a), int(b - a))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split, for both answers to whether it begins in a text field: how it ends, and the first id that it names."""
    key, odd, loops, ids, first = None, 0, [], [], None
    rows: list[tuple] = []

    def close() -> None:
        if key is not None:
            states = [{"outside": (odd + s) % 2, "closes": loop.closes, "items": loop.items, "blocks": loop.blocks} for s, loop in enumerate(loops)]
            rows.append((*key, *states, ids[0] if ids else None, first))

    for now, part in _splits(batches):
        if now != key:
            close()
            key, odd, loops, ids, first = now, 0, [_Loop(), _Loop()], [], None
        if first is None:
            first = _content_id(part.column("value")[0].as_py()) or ""
        marks = _Marks(part, odd)
        odd = marks.odd
        for i in np.flatnonzero(marks.mark).tolist():  # few beside the rows
            loops[marks.parity[i]].mark(marks.lower[i].as_py())
        if not ids:
            named = np.flatnonzero(pc.match_substring_regex(marks.value, "^[dD][aA][tT][aA]_|_entry[.]id").to_numpy(zero_copy_only=False))
            ids = [_content_id(marks.value[int(i)].as_py()) for i in named[:1]]
    close()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SUMMARY, strict=True)], schema=_SUMMARY)


def _content_id(line: str) -> str | None:
    if line.lower().startswith("data_"):
        return line[5:].strip().upper()
    return line.split()[-1].upper() if "_entry.id" in line and line.split() else None


_STATE_TYPE = pa.struct([("outside", pa.int32()), ("closes", pa.bool_()), ("items", pa.list_(pa.string())), ("blocks", pa.int32())])
_SUMMARY = pa.schema([("source", pa.string()), ("block", pa.int64()), ("even", _STATE_TYPE), ("odd", _STATE_TYPE), ("named", pa.string()), ("first_line", pa.string())])


def cif_splits(lines: DataFrame) -> DataFrame:
    """One row per split of a file: ``source, block, parity, blocks, items, named, first_line``, from one reading of the text.

    ``parity`` tells which of the split's lines, by the number of text borders before them, are outside text fields,
    ``blocks`` counts the data blocks begun before, and ``items`` are the columns of the atom loop that is open where the
    split begins. They are carried from split to split: each was summed up for either beginning, and a file's summaries, as many as it has splits, are gone through in order.
    """
    flat = lines.select("source", F.col("at.block").alias("block"), "value")
    own = flat.mapInArrow(_summaries, f"source string, block long, even {_STATE}, odd {_STATE}, named string, first_line string")
    files = own.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("block", "even", "odd", "named", "first_line"))).alias("splits"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("parity"), none.alias("items"), F.lit(0).alias("blocks"),
                     F.array().cast("array<struct<block:bigint,parity:int,blocks:int,items:array<string>,named:string,first_line:string>>").alias("done"))

    def step(state: Column, split: Column) -> Column:
        own = F.when(state["parity"] == 0, split["even"]).otherwise(split["odd"])
        first_block = state["blocks"] + own["blocks"] <= 1
        items = F.concat(F.when(own["closes"], none).otherwise(state["items"]), own["items"])
        done = F.struct(split["block"].alias("block"), state["parity"].alias("parity"), state["blocks"].alias("blocks"), state["items"].alias("items"),
                        split["named"].alias("named"), split["first_line"].alias("first_line"))
        return F.struct(own["outside"].alias("parity"), F.when(first_block, items).otherwise(none).alias("items"),
                        (state["blocks"] + own["blocks"]).alias("blocks"), F.concat(state["done"], F.array(done)).alias("done"))

    return files.select("source", F.explode(F.aggregate("splits", start, step)["done"]).alias("s")).select("source", "s.*")


_FOUND = pa.schema([("source", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("parity", pa.int32()), ("more_blocks", pa.int32()), ("items", pa.list_(pa.string())), ("value", pa.string())])


def _loop_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that are rows of an atom loop if their parity is the one outside text fields. ``items`` is null before
    the split's first mark, where the loop from before goes on."""
    key, odd, loops = None, 0, []
    for now, part in _splits(batches):
        if now != key:
            key, odd, loops = now, 0, [None, None]
        marks = _Marks(part, odd)
        odd = marks.odd
        data = ~marks.mark & ~marks.border & pc.match_substring_regex(marks.value, r"\S").to_numpy(zero_copy_only=False)
        for parity in (0, 1):
            here = marks.parity == parity
            at = np.flatnonzero(marks.mark & here)
            for a, b in zip([-1, *at.tolist()], [*at.tolist(), part.num_rows], strict=True):
                if a >= 0:
                    line = marks.lower[a].as_py()
                    if loops[parity] is None:
                        loops[parity] = _Loop()
                        loops[parity].items = [_BEFORE]
                    loops[parity].mark(line)
                items = None if loops[parity] is None else loops[parity].items
                rows = np.flatnonzero(data[a + 1:b] & here[a + 1:b]) + a + 1 if items is None or items else ()
                if len(rows):
                    some = part.take(pa.array(rows))
                    shared = pa.array([items], pa.list_(pa.string())).take(pa.array(np.zeros(len(rows), np.int32)))
                    yield pa.RecordBatch.from_arrays([some.column("source"), some.column("block"), some.column("row"), pa.array(np.full(len(rows), parity, np.int32)),
                                                        pa.array(np.full(len(rows), loops[parity].blocks if loops[parity] else 0, np.int32)), shared, some.column("value")], schema=_FOUND)


#: The columns that are read, lower-cased as the marks are.
_ITEMS = ["pdbx_pdb_model_num", "auth_asym_id", "label_asym_id", "auth_seq_id", "label_seq_id", "pdbx_pdb_ins_code", "label_comp_id", "auth_comp_id",
          "label_atom_id", "auth_atom_id", "type_symbol", "cartn_x", "cartn_y", "cartn_z"]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The read columns of rows of tokens. Their places are looked up once for each list of names in a batch, not once a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, tokens = batch.column("names").dictionary_encode(), batch.column("tokens")
        lists = [n.split("\n") for n in names.dictionary.to_pylist()]
        places = np.array([[own.index(n) if n in own else -1 for n in _ITEMS] for own in lists])[names.indices.to_numpy()]
        starts = tokens.offsets.to_numpy()
        cells = []
        for at in places.T:
            missing = (at < 0) | (at >= starts[1:] - starts[:-1])
            cell = tokens.values.take(pa.array(starts[:-1] + at, mask=missing))
            cells.append(pc.if_else(pc.is_in(cell, value_set=pa.array([".", "?"], cell.type)), pa.scalar(None, cell.type), cell))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "block", "row")), *cells], ["source", "block", "row", *_ITEMS])


#: Stands for the items of the loop that was open where the split began.
_BEFORE = "..."


def cif_atoms(lines: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Rows of the atom loop; ``auth_`` chain and number, ``label_`` names, each with the other as fallback.

    ``splits`` is :func:`cif_splits` of the same lines. The text is read once more, and rows meet what is carried into
    their split by (source, block), so that a large file is as many keys as it has splits. Only the first data block of a
    file counts, and lines within text fields are no rows.
    """
    splits = cif_splits(lines) if splits is None else splits
    flat = lines.select("source", F.col("at.block").alias("block"), F.col("at.row").alias("row"), "value")
    found = flat.mapInArrow(_loop_rows, "source string, block long, row long, parity int, more_blocks int, items array<string>, value string")
    before = splits.select("source", "block", "parity", "blocks", F.col("items").alias("before"))
    goes_on = F.get("items", F.lit(0)) == _BEFORE
    own = F.when(F.col("items").isNull(), F.col("before")).when(goes_on, F.concat("before", F.slice("items", 2, 1000))).otherwise(F.col("items"))
    rows = found.join(before, ["source", "block", "parity"]).withColumn("items", own).filter((F.size("items") > 0) & (F.col("blocks") + F.col("more_blocks") <= 1))
    shown = rows.select("source", "block", "row", F.concat_ws("\n", "items").alias("names"), cif_tokens(F.col("value")).alias("tokens"))
    rows = shown.mapInArrow(_cells, "source string, block long, row long, " + ", ".join(f"{n} string" for n in _ITEMS))

    def item(*names: str) -> Column:
        return F.coalesce(*names)

    number = F.coalesce(item("pdbx_pdb_model_num").try_cast("long"), F.lit(1).cast("long"))
    return rows.select(
        "source", F.struct(F.lit(0).cast("long").alias("block"), number.alias("row")).alias("model"),
        F.coalesce(item("auth_asym_id", "label_asym_id"), F.lit("")).alias("chain_id"),
        item("auth_seq_id", "label_seq_id").try_cast("int").alias("residue_number"),
        F.coalesce(item("pdbx_pdb_ins_code"), F.lit("")).alias("insertion_code"),
        item("label_comp_id", "auth_comp_id").alias("residue_name"),
        item("label_atom_id", "auth_atom_id").alias("atom_name"),
        F.upper(F.coalesce(item("type_symbol"), F.lit(""))).alias("element"),
        *[item(f"cartn_{c}").try_cast("double").alias(c) for c in "xyz"],
        F.struct("block", "row", F.lit(0).cast("long").alias("line")).alias("atom_pos"),
    ).select(*ATOM_COLUMNS)


def cif_content_ids(splits: DataFrame, compat: bool = False) -> DataFrame:
    """Per file the id of its first ``data_`` or ``_entry.id`` line, upper case, from :func:`cif_splits`.

    With ``compat`` only the very first line of the file counts.
    """
    found = F.nullif("first_line", F.lit("")) if compat else F.col("named")
    rows = splits.where("block = 0") if compat else splits
    return (rows.withColumn("found", found).filter("found IS NOT NULL")
            .groupBy("source").agg(F.min_by("found", "block").alias("content_id")))


# --- both -----------------------------------------------------------------

def readable_atoms(atoms: DataFrame) -> DataFrame:
    """Atoms with all coordinates. An atom without is left out by itself and listed by :func:`skipped_atoms`."""
    return atoms.dropna(subset=["x", "y", "z"])


def skipped_atoms(atoms: DataFrame) -> DataFrame:
    """``source, n_atoms, first_pos`` of the atoms without a readable coordinate, per file that has some."""
    return (atoms.filter("x IS NULL OR y IS NULL OR z IS NULL").groupBy("source")
            .agg(F.count("*").alias("n_atoms"), F.min("atom_pos").alias("first_pos")))


def rejected_files(manifest: DataFrame, atoms: DataFrame) -> DataFrame:
    """``file_ord, file_path, reason`` of the manifest rows that give no structure; the run goes on without them."""
    readable = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    found = atoms.groupBy("source").agg(F.bool_or(readable).alias("found"))
    reason = (F.when(~F.coalesce(rules.has_suffix(F.col("file_path")), F.lit(False)), "suffix")
              .when(F.col("found").isNull(), "missing, unreadable or without atoms")
              .when(~F.col("found"), "unreadable coordinates"))
    return (manifest.join(found, "source", "left")
            .withColumn("reason", reason).filter("reason IS NOT NULL").select("file_ord", "file_path", "reason"))

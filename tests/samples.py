"""Small structure files, written by rule so that contacts are easy to count by hand."""

from __future__ import annotations

PROTEIN_NAMES = ["ALA", "GLY", "LEU", "SER", "VAL", "LYS", "GLU", "ASP", "PHE", "TYR", "TRP", "MET"]


def pdb_line(serial, name, residue, chain, number, x, y, z, element="C", record="ATOM", code=" "):
    return (f"{record:<6}{serial:>5} {name:^4} {residue:>3} {chain:1}{number:>4}{code:1}   "
            f"{x:8.3f}{y:8.3f}{z:8.3f}{1.0:6.2f}{0.0:6.2f}          {element:>2}")


def backbone(chain, y, n=12, names=PROTEIN_NAMES, start=1, serial=1):
    """A straight chain along x with CA and C atoms 1.5 apart in z, residues 3 apart."""
    lines = []
    for i in range(n):
        for j, (name, z) in enumerate((("CA", 0.0), ("C", 1.5))):
            lines.append(pdb_line(serial + 2 * i + j, name, names[i % len(names)], chain, start + i, 3.0 * i, y, z))
    return lines


def loop_rows(rows, first_line="data_2XYZ"):
    items = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id",
             "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id",
             "pdbx_PDB_model_num"]
    return "\n".join([first_line, "#", "_entry.id   2XYZ", "loop_", "_pdbx_note.text", "'ATOM not one'", "#", "loop_",
                      *[f"_atom_site.{i}" for i in items], *rows, "#", "_cell.length_a 1.0", ""])


def cif_row(serial, symbol, atom, residue, label, chain, number, x, y, z, model=1):
    return (f"ATOM {serial} {symbol} {atom} . {residue} {label} {number} ? {x:.3f} {y:.3f} {z:.3f} "
            f"{number} {chain} {model}")


def write_inputs(folder):
    """Structure files, lookups and a manifest; returns the paths by name."""
    folder.mkdir(parents=True, exist_ok=True)
    two = backbone("A", 0.0) + backbone("B", 4.0, serial=101)
    extra = [pdb_line(900, "O", "HOH", "B", 201, 50, 50, 50, "O", "HETATM"),
             pdb_line(901, "HA", "ALA", "A", 1, 0.0, 4.0, 0.0, "H")]
    files = {
        "1abc.pdb": ["HEADER    TRANSPORT                               13-DEC-97   1ABC", *two, *extra, "END"],
        "model1.pdb": ["HEADER    TRANSPORT                               13-DEC-97   3DEF   ",
                       *backbone("A", 0.0), *backbone("C", 4.5, serial=101)],
        "two_models.pdb": ["MODEL        1", *two, "ENDMDL", "MODEL        2",
                           *backbone("A", 0.0), *backbone("B", 90.0, serial=101), "ENDMDL"],
        "water_only.pdb": [pdb_line(1, "O", "HOH", "A", 1, 0, 0, 0, "O", "HETATM")],
        "broken.pdb": [pdb_line(1, "CA", "ALA", "A", 1, 0, 0, 0)[:40]],
        "empty.pdb": ["REMARK nothing here"],
        "notes.txt": two, "x.pdb.gz": two,
    }
    for name, lines in files.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    dna = [cif_row(i + 1, "C", '"C1\'"', "DA", "X", "N", i + 1, 3.0 * i, 0, 0) for i in range(5)]
    protein = [cif_row(20 + i, "C", "CA", "ALA", "Y", "P", i + 1, 3.0 * i, 3.5, 0) for i in range(5)]
    hydrogen = [cif_row(40, "H", "HA", "ALA", "Y", "P", 1, 0, 1, 0)]
    (folder / "nucleic.cif").write_text(loop_rows(dna + protein + hydrogen))
    (folder / "comment_first.cif").write_text("#\n" + loop_rows(protein))
    (folder / "sifts.tsv").write_text("# comment\nPDB\tCHAIN\tSP_PRIMARY\n1abc\tA\tP00001\t1\n1abc\ta\tP00002\t1\n"
                                      "short\trow\n1ABC\tB\tP00003\n3def\tA\tP00002\n")
    (folder / "seqres.fasta").write_text(
        ">1abc_A mol:protein length:12  first\nAGLS\n>1abc_A mol:protein length:12  CHAIN   A\nAGLSVKED\nFYWM\n"
        ">noid\nAAAA\n>a_b_c x\nAA\n>2xyz_N mol:na length:5  DNA strand\nAAAAA\n>3def_C mol:protein length:12 thing\nAGLSV\n"
        ">1abc\nAAA\n")
    (folder / "names.fasta").write_text(
        ">sp|P00001|ONE_X Old name\nMKT\n>sp|P00002|TWO_X Second protein OS=Test GN=two\nMKT\nAGL\n"
        ">nobar Nothing\nAAA\n>sp|P00009|NINE_X Straight chain\nAGLSVKEDFYWM\n>sp|P00001|ONE_X New name\nMKT\n")
    manifest = folder / "manifest.csv"
    names = ["1abc.pdb", "notes.txt", "model1.pdb", "broken.pdb", "nucleic.cif", "missing.pdb", "x.pdb.gz",
             "water_only.pdb", "empty.pdb", "two_models.pdb", "comment_first.cif"]
    manifest.write_text("number,file_path\n" + "".join(f"{i},{folder / n}\n" for i, n in enumerate(names)))
    return {"manifest": str(manifest), "sequence_headers": str(folder / "seqres.fasta"),
            "protein_names": str(folder / "names.fasta"), "cross_reference": str(folder / "sifts.tsv")}

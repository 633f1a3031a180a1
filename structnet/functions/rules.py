"""Per-row rules, all built from Spark's own functions so they stay in codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from structnet.functions import constants as K


# --- file names -----------------------------------------------------------

def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; leading dots of a name start no suffix."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    """File name before its *first* dot."""
    return F.substring_index(basename(path), ".", 1)


def has_suffix(path: Column, allowed: Iterable[str] = K.STRUCTURE_SUFFIXES) -> Column:
    return F.lower(suffix(path)).isin(*allowed)


def id_from_name(path: Column) -> Column:
    """Upper-case id when the stem looks like a structure id, else NULL."""
    name = stem(path)
    return F.when(name.rlike(r"^[0-9][A-Za-z0-9]{3}$"), F.upper(name))


# --- sequence headers -----------------------------------------------------

def clean_header(info: Column) -> Column:
    without_type = F.regexp_replace(info, r"mol:\w+\s*", "")
    return F.trim(F.regexp_replace(without_type, r"length:\d+\s*", ""))


def header_type(info: Column) -> Column:
    return F.when(info.contains("mol:protein"), K.PROTEIN).otherwise(K.NUCLEIC)


def lookup_key(pdb_id: Column, chain_id: Column) -> Column:
    """``lower(id)_UPPER(chain)``; NULL chain or id gives NULL."""
    return F.concat(F.lower(pdb_id), F.lit("_"), F.upper(chain_id))


# --- residues and atoms ---------------------------------------------------

def is_heavy(element: Column) -> Column:
    return ~F.coalesce(element, F.lit("")).isin(*K.HYDROGENS)


def is_amino_acid(residue_name: Column) -> Column:
    return F.trim(residue_name).isin(*K.AMINO_ACIDS)


def is_polymer(residue_name: Column) -> Column:
    return residue_name.isin(*K.POLYMER_RESIDUES)


def one_letter(residue_name: Column) -> Column:
    """One-letter code; anything but the 20 standard residues is ``X``."""
    table = F.create_map(*[F.lit(v) for pair in K.ONE_LETTER.items() for v in pair])
    return F.coalesce(table[residue_name], F.lit(K.UNKNOWN_LETTER))


def residue_label(number: Column, name: Column) -> Column:
    return F.concat(F.coalesce(number.cast("string"), F.lit("?")), F.lit(":"), name)


# --- chains and interactions ----------------------------------------------

def unique_chain_id(pdb_id: Column, chain_id: Column) -> Column:
    return F.concat_ws(":", pdb_id, chain_id)


def type_from_residues(n_residues: Column, all_amino: Column) -> Column:
    return (F.when(n_residues == 0, K.UNKNOWN)
            .when(all_amino, K.PROTEIN)
            .otherwise(K.NUCLEIC))


def interaction_type(type_a: Column, type_b: Column) -> Column:
    """Label of a pair of molecule types; NULL means the pair is not considered.

    Only the literal ``Unknown`` (or a missing type) removes a pair. Other
    unexpected literals label it ``Unknown`` and keep it.
    """
    a = F.coalesce(type_a, F.lit(K.UNKNOWN))
    b = F.coalesce(type_b, F.lit(K.UNKNOWN))
    proteins = F.when(a == K.PROTEIN, 1).otherwise(0) + F.when(b == K.PROTEIN, 1).otherwise(0)
    nucleic = (a == K.NUCLEIC) | (b == K.NUCLEIC)
    return (F.when((a == K.UNKNOWN) | (b == K.UNKNOWN), F.lit(None).cast("string"))
            .when(proteins == 2, f"{K.PROTEIN}-{K.PROTEIN}")
            .when(nucleic & (proteins == 1), f"{K.PROTEIN}-{K.NUCLEIC}")
            .when(nucleic, f"{K.NUCLEIC}-{K.NUCLEIC}")
            .otherwise(K.UNKNOWN))


def round2(distance: Column) -> Column:
    """Two decimals, halves to even (``F.round`` takes halves up)."""
    return F.rint(distance * 100) / 100


# --- graph styling --------------------------------------------------------

def style_name(title: Column, prefix: str = "structnet") -> Column:
    """Style family of a network title.

    A title with ``Chain`` gets the chain style even when combined, and
    ``Combined_Network`` names neither, so it gets the protein style.
    """
    combined = title.contains("Protein") & F.lower(title).contains("combined")
    return F.concat(
        F.lit(prefix),
        F.when(title.contains("Chain"), "_Chain_Style")
        .when(combined, "_Protein_Combined_Style")
        .otherwise("_Protein_Style"))


def palette_color(index: Column, n: Column) -> Column:
    """The ``index``-th (from 0) of ``n`` colors spread evenly over the palette."""
    size = len(K.PALETTE)
    step = F.lit(1.0) / F.greatest(n - 1, F.lit(1))
    spread = F.when(index == n - 1, F.lit(size)).otherwise(F.floor(index * step * size))
    spread = F.when(n == 1, F.lit(0)).otherwise(spread)
    slot = F.least(spread, F.lit(size - 1)).cast("int")
    return F.array(*[F.lit(c) for c in K.PALETTE])[slot]

"""First-wins and last-wins per key.

Written as aggregates, not ``row_number`` windows: partial aggregation
leaves one row per key and map task before the shuffle, so a key that holds
a large share of the rows costs no more than any other. Buffers that hold text
are aggregated by sorting, so a hash goes before the keys (``operators.keys``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structnet.operators.keys import key_hash


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], pick, spread: str | None) -> DataFrame:
    """One buffer holds the order and the values, so rows that tie go by their values."""
    kept = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    picked = df.groupBy(key_hash(*keys).alias(spread or "_hash"), *keys).agg(pick(kept).alias("_kept"))
    return picked.select(*([spread] if spread else []), *keys, *[F.col(f"_kept.v{i}").alias(c) for i, c in enumerate(values)])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], spread: str | None = None) -> DataFrame:
    """One row per key: the values of the row that is last by ``order``.

    ``spread`` names a column that keeps the hash of the keys: a join by it and the keys finds the rows spread and sorted.
    """
    return _pick(df, keys, order, values, F.max, spread)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], spread: str | None = None) -> DataFrame:
    """One row per key: the values of the row that is first by ``order``."""
    return _pick(df, keys, order, values, F.min, spread)

"""Radius join: pairs of points of one group that lie within a distance.

The join is an equi-join on (group, grid cell). One side stays in its home
cell, the other is copied into every cell its search cube touches, so each
pair meets exactly once, and a pair of points is compared only if it is
close. Work per point follows the local density, not the size of the group:
one group may hold any share of the rows, its cells are spread over tasks.

The cell edge is ``cell_factor * radius``. A small factor compares fewer
pairs but copies more: about ``(1 + 2/factor)**3`` cells per point, 3.4 at
the default of 4, against 27 at 1.

Small groups cost less without cells: the points of such a group are shuffled once, as one array, and meet inside that
row, whatever the number of radii. Groups of up to ``HELD`` points are counted in Arrow from such rows, a block of distances at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

XYZ = ("x", "y", "z")

# The search cube is widened by this share, so that rounding in the cell
# arithmetic never loses a pair that the exact distance test accepts.
_SLACK = 1e-6


def radius_pairs(points: DataFrame, radius: float, group: Sequence[str], member: str,
                 carry: Sequence[str] = (), coords: Sequence[str] = XYZ,
                 where: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
                 cell_factor: float = 4.0, whole: str | None = None, small: bool = False, known: DataFrame | None = None) -> DataFrame:
    """All pairs of one ``group`` with distance <= ``radius`` and member_a < member_b.

    The result has the group columns, ``<c>_a`` / ``<c>_b`` for the member and
    each column of ``carry``, and the squared distance ``d2``. ``where`` gets
    two column lookups (side a, side b) and returns a further condition.
    ``whole`` names a column, constant within a group, that is true where the group fits a row; with ``small`` all groups do.
    ``known``, with ``small`` only, has the group columns and others that ``where`` may use, at most one row per group.
    """
    if whole:
        return _by_size(points, whole, lambda some, small: radius_pairs(some, radius, group, member, carry, coords, where, cell_factor, small=small))
    edge = radius * cell_factor
    reach = radius * (1 + _SLACK)
    cells = [f"_cell_{c}" for c in coords]
    columns = [member, *carry, *coords]

    def side(tag: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{tag}") for c in columns]

    home = points.select(*group, *side("b"), *[F.floor(F.col(c) / edge).alias(g) for c, g in zip(coords, cells)])
    spread = points.select(*group, *side("a"))
    for c, g in zip(coords, cells):
        at = F.col(f"{c}_a")
        spread = spread.withColumn(g, F.explode(F.sequence(F.floor((at - reach) / edge), F.floor((at + reach) / edge))))

    a = lambda c: F.col(f"{c}_a")
    b = lambda c: F.col(f"{c}_b")
    d2 = reduce(lambda s, t: s + t, [(a(c) - b(c)) * (a(c) - b(c)) for c in coords])
    keep = (a(member) < b(member)) & (d2 <= radius * radius)
    if where is not None:
        keep = keep & where(a, b)
    met = _inside(points, group, columns, known) if small else spread.join(home, [*group, *cells])
    return met.filter(keep).select(*group, *[f"{c}_{t}" for t in "ab" for c in [member, *carry]], d2.alias("d2"))


def _by_size(points: DataFrame, whole: str, of: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    small = F.coalesce(F.col(whole), F.lit(False))
    return of(points.filter(small), True).unionByName(of(points.filter(~small), False))


def _inside(points: DataFrame, group: Sequence[str], columns: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Every two points of each small group, with ``<c>_a`` and ``<c>_b`` for each of ``columns``. The group is one row in between.

    The columns of ``known`` come along, joined while the group is one row.
    """
    held = points.dropna(subset=list(group)).groupBy(*group).agg(F.collect_list(F.struct(*columns)).alias("_whole"))
    more = [] if known is None else [c for c in known.columns if c not in group]
    held = held if known is None else held.join(known, list(group), "left")
    both = held.select(*group, *more, "_whole", F.explode("_whole").alias("_a")).select(*group, *more, "_a", F.explode("_whole").alias("_b"))
    return both.select(*group, *more, *[F.col(f"_{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in columns])


def radius_pair_count(points: DataFrame, radius: float, group: Sequence[str], member: str,
                      carry: Sequence[str] = (), coords: Sequence[str] = XYZ,
                      where=None, cell_factor: float = 4.0, name: str = "n_pairs",
                      weight: str | None = None, whole: str | None = None, small: bool = False) -> DataFrame:
    """Number of close point pairs per (group, member_a, member_b); zero counts are absent.

    ``carry`` columns must be constant within a member. Points of a member
    that coincide are merged into one weighted point before the join, unless
    the input comes merged, with its multiplicity in the column ``weight``.
    """
    if weight is None:
        weight = "_weight"
        points = merge_points(points, [*group, *([whole] if whole else []), member, *carry, *coords], coords, **{weight: F.lit(True)})
    pairs = radius_pairs(points, radius, group, member, [*carry, weight], coords, where, cell_factor, whole, small)
    keys = [*group, *[f"{c}_{t}" for t in "ab" for c in [member, *carry]]]
    return pairs.groupBy(*keys).agg(F.sum(F.col(f"{weight}_a") * F.col(f"{weight}_b")).alias(name))


#: Cells are halved at most so often along each side, which takes them from four radii to one.
_DEEPEST = 2


def radius_counts(points: DataFrame, group: Sequence[str], member: str, levels: dict[str, tuple[float, Column]],
                  coords: Sequence[str] = XYZ, cell_factor: float = 4.0, crowded: int | None = None, whole: str | None = None, small: bool = False,
                  held: bool = False) -> DataFrame:
    """Close point pairs per (group, member_a, member_b), counted for several radii by one cell join.

    ``levels`` maps a result column to a radius and the weight that a point has there; points with a weight of NULL or 0
    take no part. Every level has cells of its own size, which are part of the key, so all levels share one exchange for
    each side and one aggregate. Pairs that are close at no level are absent; a level's count is 0 where it has none.

    With ``crowded``, cells of more points are cut in 8 or 64 parts by a count of all cells, so that the comparisons per point and the
    largest part follow the density: sparse regions keep few copies, packed ones compare few points. The cut changes no result.

    ``whole`` names a column, constant within a group, that is true where the group fits a row; with ``small`` all groups do. There all
    levels are counted at once, without cells. With ``held`` no group has more than ``HELD`` points, and pairs of points are no rows.
    """
    if whole:
        return _by_size(points, whole, lambda some, small: radius_counts(some, group, member, levels, coords, cell_factor, crowded, small=small))
    cells = [f"_cell_{c}" for c in coords]
    weights = [f"weight_{i}" for i in range(len(levels))]
    parts = [F.struct(F.lit(i).alias("level"), F.lit(radius * cell_factor).alias("edge"), F.lit(radius * (1 + _SLACK)).alias("reach"))
             for i, (radius, _) in enumerate(levels.values())]
    present = [F.coalesce(weight.cast("long"), F.lit(0).cast("long")).alias(w) for (_, weight), w in zip(levels.values(), weights)]
    columns = [member, *coords, *weights]
    weighed = points.dropna(subset=list(coords)).select(*group, member, *coords, *present)
    if held:
        return _held_counts(weighed.where(reduce(lambda s, t: s | t, [F.col(w) > 0 for w in weights])), group, member, {n: r for n, (r, _) in levels.items()}, coords, weights)
    takes = reduce(lambda s, t: s | t, [(F.col("level") == i) & (F.col(w) > 0) for i, w in enumerate(weights)])
    rows = weighed.select(*group, *columns, F.explode(F.array(*parts)).alias("_l")).select(*group, *columns, "_l.*").where(takes)

    def side(tag: str) -> list[Column]:
        return [F.col(c).alias(f"{c}_{tag}") for c in columns]

    home = rows.select(*group, "level", *side("b"), *[F.floor(F.col(c) / F.col("edge")).alias(g) for c, g in zip(coords, cells)])
    spread = rows.select(*group, "level", "edge", "reach", *side("a"))
    for c, g in zip(coords, cells):
        at = F.col(f"{c}_a")
        spread = spread.withColumn(g, F.explode(F.sequence(F.floor((at - F.col("reach")) / F.col("edge")), F.floor((at + F.col("reach")) / F.col("edge")))))
    keys = [*group, "level", *cells]
    if crowded is not None:
        home, spread, parts = _cut(home, spread, keys, coords, cells, levels, cell_factor, crowded)
        keys += parts
    d2 = reduce(lambda s, t: s + t, [(F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in coords])
    near = [(d2 <= radius * radius) & (F.col(f"{w}_a") > 0) & (F.col(f"{w}_b") > 0) for (radius, _), w in zip(levels.values(), weights)]

    if small:
        met = _inside(weighed.where(reduce(lambda s, t: s | t, [F.col(w) > 0 for w in weights])), group, columns)
    else:
        met, near = spread.drop("edge", "reach").join(home, keys), [(F.col("level") == i) & c for i, c in enumerate(near)]
    met = met.filter((F.col(f"{member}_a") < F.col(f"{member}_b")) & reduce(lambda s, t: s | t, near))
    return met.groupBy(*group, f"{member}_a", f"{member}_b").agg(
        *[F.sum(F.when(c, F.col(f"{w}_a") * F.col(f"{w}_b")).otherwise(0)).alias(name) for c, w, name in zip(near, weights, levels)])


#: Points of a group that is counted as one row, and distances that are computed at a time.
HELD, _AT_ONCE = 2048, 1 << 16


def _close(at: np.ndarray, who: np.ndarray, weights: Sequence[np.ndarray], radii: Sequence[float], members: int) -> np.ndarray:
    """Sums of weight products of close points by (radius, member, member)."""
    out = np.zeros((len(radii), members, members), np.int64)
    for level, (radius, weight) in enumerate(zip(radii, weights, strict=True)):
        some = np.flatnonzero(weight > 0)
        own = np.zeros((len(some), members))
        own[np.arange(len(some)), who[some]] = weight[some]
        step = max(1, _AT_ONCE // max(1, len(some)))
        for a in range(0, len(some), step):
            rows = slice(a, a + step)
            d2 = reduce(lambda s, t: s + t, [(c[rows, None] - c[None, :]) ** 2 for c in at[:, some]])
            out[level] += np.rint(own[rows].T @ ((d2 <= radius * radius).astype(float) @ own)).astype(np.int64)
    return out


def _held_counts(points: DataFrame, group: Sequence[str], member: str, radii: dict[str, float], coords: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """:func:`radius_counts` where each group is one row, whose members are numbered in their order."""
    spread = points.dropna(subset=[*group, member]).repartition(*group)  # gathered where they are, all points would be sorted before
    held = spread.groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias("_members"), F.collect_list(F.struct(member, *coords, *weights)).alias("_whole"))
    number = F.transform("_whole", lambda p: F.array_position("_members", p[member]))
    shown = held.select(*group, "_members", number.alias("_who"), *[F.col(f"_whole.{c}").cast("array<double>").alias(f"_{c}") for c in coords], *[F.col(f"_whole.{w}").alias(f"_{w}") for w in weights])
    kept, found = [*group, "_members"], ["_a", "_b", *[f"_n{i}" for i in range(len(radii))]]
    arrays, reach = [c for c in shown.columns if c not in kept], list(radii.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in arrays}
            sizes = np.diff(batch.column("_members").offsets.to_numpy())
            pairs = []
            for i, size in enumerate(sizes.tolist()):
                own = {c: values[starts[i]:starts[i + 1]] for c, (starts, values) in flat.items()}
                counts = _close(np.array([own[f"_{c}"] for c in coords]), own["_who"] - 1, [own[f"_{w}"] for w in weights], reach, size)
                a, b = np.nonzero(np.triu(counts.any(0), 1))
                pairs.append(np.array([a + 1, b + 1, *counts[:, a, b]], np.int64))
            ends = pa.array(np.cumsum([0, *[x.shape[1] for x in pairs]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.concatenate(pairs, axis=1) if pairs else np.zeros((len(found), 0), np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *lists], [*kept, *found])

    schema = T.StructType([*shown.select(*kept).schema.fields, *[T.StructField(c, T.ArrayType(T.LongType())) for c in found]])
    met = shown.mapInArrow(run, schema).select(*kept, F.explode(F.arrays_zip(*found)).alias("_p"))

    def end(column: str) -> Column:
        return F.get("_members", (F.col(f"_p.{column}") - 1).cast("int"))

    return met.select(*group, end("_a").alias(f"{member}_a"), end("_b").alias(f"{member}_b"), *[F.col(f"_p._n{i}").alias(n) for i, n in enumerate(radii)])


def _cut(home: DataFrame, spread: DataFrame, keys: list[str], coords: Sequence[str], cells: list[str],
         levels: dict[str, tuple[float, Column]], cell_factor: float, crowded: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the part of the cell that a point is in, or that its search cube touches."""
    depth = F.least(F.ceil(F.log(F.col("count") / crowded) / F.log(F.lit(8.0))), F.lit(_DEEPEST)).cast("int")
    packed = home.groupBy(*keys).count().where(F.col("count") > crowded).select(*keys, F.pow(F.lit(2.0), depth).alias("_cuts"))
    cuts = F.coalesce("_cuts", F.lit(1.0))
    edge = F.get(F.array(*[F.lit(radius * cell_factor) for radius, _ in levels.values()]), F.col("level"))
    parts = [f"_part_{c}" for c in coords]

    def part(at: Column, cell: str) -> Column:  # grows with the place, so what is close never falls outside the cube's parts
        return F.least(F.greatest(F.floor((at - F.col(cell) * edge) * cuts / edge), F.lit(0)), cuts - 1).cast("int")

    home = home.join(packed, keys, "left").withColumns({p: part(F.col(f"{c}_b"), g) for p, c, g in zip(parts, coords, cells)}).drop("_cuts")
    spread = spread.join(packed, keys, "left")
    for p, c, g in zip(parts, coords, cells):
        at = F.col(f"{c}_a")
        spread = spread.withColumn(p, F.explode(F.sequence(part(at - F.col("reach"), g), part(at + F.col("reach"), g))))
    return home, spread.drop("_cuts"), parts


def merge_points(points: DataFrame, keys: Sequence[str], coords: Sequence[str] = XYZ, **weights: Column) -> DataFrame:
    """One row per distinct ``keys``, each weight counting the rows on which its condition holds.

    Points without a coordinate are close to nothing and left out; any other key may be NULL.
    """
    return (points.dropna(subset=list(coords)).groupBy(*keys)
            .agg(*[F.count_if(condition).alias(name) for name, condition in weights.items()]))

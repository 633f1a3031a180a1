"""Colors of the node groups of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structnet.functions import constants as K
from structnet.functions import rules
from structnet.operators.staging import stage


def ranked(rows: DataFrame, partition: str, order: str) -> DataFrame:
    """``rows`` with ``index`` (from 0) and ``n`` per ``partition`` by ``order``; pairs are distinct.

    A window would bring a whole partition into one task, and the combined
    network is one partition. Here a range sort spreads the rows, and counts
    per sorted slice turn positions in a slice into ranks. The sorted rows
    are staged, so that both uses see the same slices.
    """
    position = F.monotonically_increasing_id()
    in_slice = F.lit((1 << 33) - 1)
    slices = stage(
        rows.select(partition, order).sort(partition, order)
        .select(partition, order, F.shiftright(position, 33).alias("slice"),
                position.bitwiseAND(in_slice).alias("offset")))
    per_slice = slices.groupBy(partition, "slice").agg(F.count(F.lit(1)).alias("rows"),
                                                       F.min("offset").alias("start"))
    # A window group here holds one row per slice, so at most as many as there are shuffle partitions.
    by_slice = Window.partitionBy(partition).orderBy("slice")
    before = F.coalesce(F.sum("rows").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_slice.select(partition, "slice", (before - F.col("start")).alias("shift"),
                              F.sum("rows").over(Window.partitionBy(partition)).alias("n"))
    return (slices.join(starts, [partition, "slice"])
            .select(partition, order, (F.col("offset") + F.col("shift")).alias("index"), "n"))


def color_assignment(nodes: DataFrame) -> DataFrame:
    """``network, color_group, color`` for every group of every network.

    Groups other than ``Multi`` take evenly spaced palette colors in sorted
    order. ``Multi`` has a color in the combined protein network only.
    """
    groups = nodes.select("network", "color_group").filter(F.col("color_group").isNotNull()).distinct()
    base = ranked(groups.filter(F.col("color_group") != K.MULTI), "network", "color_group")
    title = F.col("network")
    multi = groups.filter((F.col("color_group") == K.MULTI) & title.contains("Protein")
                          & F.lower(title).contains("combined"))
    return (base.select("network", "color_group", rules.palette_color(F.col("index"), F.col("n")).alias("color"))
            .unionByName(multi.select("network", "color_group", F.lit(K.MULTI_COLOR).alias("color"))))


def style_names(edges: DataFrame, prefix: str = "structnet") -> DataFrame:
    networks = edges.select("network").distinct()
    return networks.select("network", rules.style_name(F.col("network"), prefix).alias("style_name"))

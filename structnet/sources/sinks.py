"""What a run leaves behind.

Every run writes under ``<output>/<run_id>``: contacts as CSV, networks as Parquet tables sorted by network, and on
demand each network as graph JSON. How many files there are follows from the amount of data, not from the number of
structures or networks, and a run that is repeated under the same id replaces what it had written.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_run_id() -> str:
    return datetime.now().strftime("%Y-%m-%d_%H-%M-%S")


def contact_counts(structures: DataFrame, contacts: DataFrame) -> DataFrame:
    """``PDB_ID, n_contacts`` of every structure, 0 for one without contacts."""
    counted = contacts.groupBy("PDB_ID").agg(F.count("*").alias("n_contacts"))
    listed = structures.select(F.col("pdb_id").alias("PDB_ID")).distinct()
    return listed.join(counted, "PDB_ID", "left").select("PDB_ID", F.coalesce("n_contacts", F.lit(0).cast("long")).alias("n_contacts"))


def write_contacts(contacts: DataFrame, run_path: str, per_structure: bool = False) -> None:
    """CSV sorted by structure, or one folder for each; a missing accession is an empty cell."""
    rows = _sorted(contacts, "PDB_ID")
    if per_structure:
        rows = contacts.withColumn("structure", F.col("PDB_ID")).hint("rebalance", "structure")
    writer = rows.write.mode("overwrite").option("header", True).option("emptyValue", "")
    (writer.partitionBy("structure") if per_structure else writer).csv(f"{run_path}/detailed_interactions")


def write_network(nodes: DataFrame, edges: DataFrame, run_path: str, name: str) -> None:
    """Rows of a network lie together, and the files' statistics tell which hold it."""
    _sorted(nodes, "network", "id").write.mode("overwrite").parquet(f"{run_path}/{name}/nodes")
    _sorted(edges, "network", "source", "target").write.mode("overwrite").parquet(f"{run_path}/{name}/edges")


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Networks as lines of Cytoscape.js JSON: ``network, part, key, line``.

    The lines of a network, sorted by ``part, key``, are one JSON document. A
    network is never gathered into one value. A node id occurs once, parallel
    edges are kept and numbered.
    """
    networks = edges.select("network").distinct()

    def fixed(part: int, text: Column) -> DataFrame:
        return networks.select("network", F.lit(part).alias("part"), F.lit("").alias("key"), text.alias("line"))

    head = F.concat(F.lit('{"data":'), F.to_json(F.struct(F.col("network").alias("name"))),
                    F.lit(',"elements":{"nodes":['))
    node_data = F.struct("id", "name", "tooltip", "color_group", *(c for c in ("molecule_name", "label") if c in nodes.columns))
    node_rows = (nodes.groupBy("network", "id").agg(F.min(node_data).alias("data"))
                 .select("network", F.lit(1).alias("part"), F.col("id").alias("key"),
                         F.to_json(F.struct("data")).alias("line")))
    edge_data = F.struct("source", "target", "interaction", "all_atoms_count")
    edge_rows = (edges.groupBy("network", edge_data.alias("data")).agg(F.count(F.lit(1)).alias("n"))
                 .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
                 .select("network", F.lit(3).alias("part"),
                         F.concat_ws(" ", "data.source", "data.target", "data.all_atoms_count", "copy").alias("key"),
                         F.to_json(F.struct("data")).alias("line")))
    return (fixed(0, head).unionByName(_with_commas(node_rows))
            .unionByName(fixed(2, F.lit('],"edges":['))).unionByName(_with_commas(edge_rows))
            .unionByName(fixed(4, F.lit("]}}"))))


def _with_commas(rows: DataFrame) -> DataFrame:
    """A comma before every line but the first of its network; keys are distinct."""
    first = rows.groupBy("network").agg(F.min("key").alias("key")).withColumn("lead", F.lit(""))
    return (rows.join(first, ["network", "key"], "left")
            .select("network", "part", "key", F.concat(F.coalesce("lead", F.lit(",")), "line").alias("line")))


#: Lines of a network up to which its document is put together in one row.
WHOLE_LINES = 50_000


def write_graph_json(nodes: DataFrame, edges: DataFrame, run_path: str, name: str, whole_lines: int = WHOLE_LINES) -> None:
    """Under ``documents`` one line of text per network, which is its whole document; under ``large`` a folder for each network of
    more than ``whole_lines`` lines, whose part files in name order are one document.

    So small networks share files, and no large one is gathered into a row.
    """
    keys = ["network", "part", "key"]
    sizes = nodes.groupBy("network").count().union(edges.groupBy("network").count()).groupBy("network").agg(F.sum("count").alias("n"))
    large = sizes.where(F.col("n") > whole_lines).select("network")
    lines = graph_lines(nodes, edges)
    pieces = F.sort_array(F.collect_list(F.struct("part", "key", "line")))
    small = (lines.join(large, "network", "left_anti").groupBy("network")
             .agg(F.array_join(F.transform(pieces, lambda p: p["line"]), "").alias("document")))
    _sorted(small, "network").select("document").write.mode("overwrite").text(f"{run_path}/{name}/graph_json/documents")
    (lines.join(large, "network", "left_semi").repartitionByRange(*keys).sortWithinPartitions(*keys)
     .select("network", "line").write.mode("overwrite").partitionBy("network").text(f"{run_path}/{name}/graph_json/large"))

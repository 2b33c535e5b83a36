"""Reading, checking, keeping and writing graph tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.storagelevel import StorageLevel

from kgweave.functions.columns import narrow_types, shown
from kgweave.functions.sizing import PUSHED_IDS, as_seeds
from kgweave.model import EDGE_COLUMNS, NODE_COLUMNS, Graph, Subgraph


def read_nodes(
    spark: SparkSession,
    source: str,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """The whole node table from files, a catalog table or a JDBC database."""
    return require_schema(_read(spark, source, format, options), NODE_COLUMNS)


def read_edges(
    spark: SparkSession,
    source: str,
    format: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    return require_schema(_read(spark, source, format, options), EDGE_COLUMNS)


def _read(spark, source, format, options) -> DataFrame:
    if format == "table":
        return spark.table(source)
    reader = spark.read.format(format).options(**dict(options or {}))
    if format == "jdbc":
        return reader.option("dbtable", source).load()
    return reader.load(source)


def jdbc_options(
    url: str,
    key: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_size: int = 10_000,
    **connection: str,
) -> dict[str, str]:
    """Options for a JDBC scan split on ``key`` into parallel range reads."""
    return {
        "url": url,
        "partitionColumn": key,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
        **connection,
    }


def load_graph(
    nodes: DataFrame, edges: DataFrame, narrow: bool = False, unique: bool = True
) -> Graph:
    """Checked graph; ``narrow`` stores 64-bit numbers in 32 bits.

    ``unique`` keeps the first row of every node id, as lookups by id take it;
    pass False for tables known to have one row per id and save the shuffle.
    """
    nodes = require_schema(nodes, NODE_COLUMNS)
    edges = require_schema(edges, EDGE_COLUMNS)
    if unique:
        nodes = dedupe_nodes(nodes)
    if narrow:
        nodes, edges = narrow_types(nodes), narrow_types(edges)
    return Graph(nodes, edges)


def require_schema(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(
            f"table lacks required columns {missing}; it has {df.columns}"
        )
    return df


def dedupe_nodes(
    nodes: DataFrame, order_by: Iterable[str | Column] = ("label", "name")
) -> DataFrame:
    """First row per ``node_id``; ranks are cut to one before the shuffle.

    Rows equal in ``order_by`` are told apart by their other columns, so the
    choice does not depend on the order of the input.
    """
    order_by = list(order_by)
    rest = [
        F.to_json(F.struct(f.name)) if isinstance(f.dataType, (MapType, VariantType)) else F.col(f.name)
        for f in nodes.schema
        if f.name not in (*(c for c in order_by if isinstance(c, str)), "node_id")
    ]
    first = Window.partitionBy("node_id").orderBy(*order_by, *rest)
    return (
        nodes.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def snapshot(graph: Graph, path: str | None = None) -> Graph:
    """Load once, reuse: in executor storage, or as parquet under ``path``.

    The parquet form survives the application and the loss of executors.
    """
    if path is None:
        keep = StorageLevel.MEMORY_AND_DISK
        return Graph(graph.nodes.persist(keep), graph.edges.persist(keep))
    spark = graph.nodes.sparkSession
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    return Graph(
        spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    )


# Per table of a snapshot, the keys its rows are ranged by.
LAYOUTS = {
    "nodes": ("node_id",),
    "edges_by_source": ("source_node_id", "target_node_id"),
    "edges_by_target": ("target_node_id", "source_node_id"),
}


def snapshot_tables(graph: Graph, name: str, buckets: int, path: str | None = None) -> None:
    """Catalog tables ordered by the join keys, for repeated extraction.

    Nodes are ranged by their id, edges once by the source and once by the
    target, each with the other end: a file holds a narrow range of keys, and a
    hub's edges spread over as many files as their share asks for.  Beside each
    table stands one of its files with the least and the largest key of each, by
    which ``lookup`` finds the files to open.  With ``path`` the data lie there.
    """
    spark = graph.nodes.sparkSession
    for suffix, keys in LAYOUTS.items():
        df = graph.nodes if suffix == "nodes" else graph.edges
        ordered = df.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
        _save_table(ordered, f"{name}_{suffix}", path)
        files = spark.table(f"{name}_{suffix}").groupBy(
            F.col("_metadata.file_path").alias("file")
        ).agg(F.min(keys[0]).alias("least"), F.max(keys[0]).alias("largest"))
        # One row per file.
        _save_table(files.coalesce(1), f"{name}_{suffix}_files", path)


def _save_table(df: DataFrame, name: str, path: str | None) -> None:
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", f"{path}/{name}")
    writer.saveAsTable(name)


def lookup(spark: SparkSession, name: str, suffix: str, seeds) -> DataFrame:
    """Rows of a snapshot's table whose first key is a seed, from the files that may hold one.

    Up to PUSHED_IDS seeds, files are chosen by their least and largest keys and
    no other is opened; more seeds meet the whole table.
    """
    key = LAYOUTS[suffix][0]
    rows = spark.table(f"{name}_{suffix}")
    seeds = as_seeds(spark, seeds)
    if seeds.values is None or len(seeds.values) > PUSHED_IDS:
        return seeds.keep(rows, key)
    between = (F.col("seed_id") >= F.col("least")) & (F.col("seed_id") <= F.col("largest"))
    # A few seeds against one row per file.
    held = spark.table(f"{name}_{suffix}_files").join(F.broadcast(seeds.ids), between, "left_semi")
    files = [row["file"] for row in held.select("file").collect()]
    if not files:
        return rows.filter(F.lit(False))
    return seeds.keep(spark.read.schema(rows.schema).parquet(*files), key)


def lookup_incident(spark: SparkSession, name: str, seeds) -> DataFrame:
    """Edges of a snapshot with a seed at either end, each row once."""
    seeds = as_seeds(spark, seeds)
    leaving = lookup(spark, name, "edges_by_source", seeds)
    entering = lookup(spark, name, "edges_by_target", seeds)
    seen = F.col("source_node_id") == F.col("seed_id")
    fresh = entering.join(seeds.ids, seen, "left_anti")
    return leaving.unionByName(fresh)


VIS_VERTEX = ("id", "label", "group", "title", "color", "size")
VIS_EDGE = ("from", "to", "label", "title")


def vis_vertices(vertices: DataFrame) -> DataFrame:
    """Vertex list for a viewer; attributes the view does not set stay null."""
    return vertices.select(
        *(
            shown(F.col(c)).alias(c)
            if c in ("id", "label") and c in vertices.columns
            else F.col(c)
            if c in vertices.columns
            else F.lit(None).cast("int" if c == "size" else "string").alias(c)
            for c in VIS_VERTEX
        )
    )


def vis_edges(edges: DataFrame) -> DataFrame:
    title = F.col("title") if "title" in edges.columns else F.lit(None).cast("string")
    return edges.select(
        shown(F.col("source")).alias("from"),
        shown(F.col("target")).alias("to"),
        shown(F.col("label")).alias("label"),
        title.alias("title"),
    )


def export_vis(subgraph: Subgraph, path: str, format: str = "json") -> None:
    """Write the node list and the edge list of a subgraph for a viewer."""
    vis_vertices(subgraph.vertices).write.mode("overwrite").format(format).save(
        f"{path}/vertices"
    )
    vis_edges(subgraph.edges).write.mode("overwrite").format(format).save(
        f"{path}/edges"
    )

"""Graphs derived from the star-schema tables.

* supply: regions, nations, customers, suppliers, parts and orders with the
  foreign keys as edges; ``node_id = key * 8 + kind``.
* activity: customers, with every event as an edge between its user and the
  customer named by the event's ``k`` property: parallel edges, mutual pairs
  and self-loops on few hubs.
* review: documents that carry a quality label, and the sources and languages
  of all documents: dangling edges on both sides, null and blank labels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.model import Graph

# The id kinds of the supply graph.
KINDS = {
    "Region": 0,
    "Nation": 1,
    "Customer": 2,
    "Supplier": 3,
    "Part": 4,
    "Order": 5,
}


# The columns the graphs are made of; stating them spares a schema read per
# table and prunes the scans.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_returnflag string",
    "events": "user_id bigint, event_type string, props string",
    "documents": "doc_id bigint, lang string, source string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


# Per kind of node: table, key, name and properties.
SUPPLY_NODES = {
    "Region": ("region", "r_regionkey", "r_name", "cast(null AS string)"),
    "Nation": ("nation", "n_nationkey", "n_name", "cast(null AS string)"),
    "Customer": (
        "customer",
        "c_custkey",
        "c_name",
        """concat('{"segment":"', c_mktsegment, '"}')""",
    ),
    "Supplier": ("supplier", "s_suppkey", "s_name", "cast(null AS string)"),
    "Part": (
        "part",
        "p_partkey",
        "p_name",
        """concat('{"brand":"', p_brand, '","type":"', p_type, '"}')""",
    ),
    "Order": (
        "orders",
        "o_orderkey",
        "concat('Order#', cast(o_orderkey AS string))",
        """concat('{"status":"', o_orderstatus, '"}')""",
    ),
}
# Per kind of edge: table, source and target as (kind, key), relation.
SUPPLY_EDGES = [
    ("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "'in_region'"),
    ("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "'lives_in'"),
    ("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "'based_in'"),
    ("orders", ("Order", "o_orderkey"), ("Customer", "o_custkey"), "'placed_by'"),
    (
        "lineitem",
        ("Supplier", "l_suppkey"),
        ("Part", "l_partkey"),
        "concat('supplies_', lower(l_returnflag))",
    ),
]


def _id(label: str, key: str) -> str:
    return f"cast({key} AS bigint) * 8 + {KINDS[label]}"


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(
        [
            _read(spark, sf_dir, table).selectExpr(
                f"{_id(label, key)} AS node_id",
                f"'{label}' AS label",
                f"{name} AS name",
                f"{properties} AS properties",
            )
            for label, (table, key, name, properties) in SUPPLY_NODES.items()
        ]
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(
        [
            _read(spark, sf_dir, table).selectExpr(
                f"{_id(*source)} AS source_node_id",
                f"{_id(*target)} AS target_node_id",
                f"{relation} AS relation_type",
            )
            for table, source, target, relation in SUPPLY_EDGES
        ]
    )


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(supply_nodes(spark, sf_dir), supply_edges(spark, sf_dir))


def activity_graph(spark: SparkSession, sf_dir: str) -> Graph:
    customers = _read(spark, sf_dir, "customer")
    events = _read(spark, sf_dir, "events")
    nodes = customers.select(
        F.col("c_custkey").alias("node_id"),
        F.col("c_mktsegment").alias("label"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("properties"),
    )
    edges = events.select(
        F.col("user_id").alias("source_node_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("target_node_id"),
        F.col("event_type").alias("relation_type"),
    )
    return Graph(nodes, edges)


def review_graph(spark: SparkSession, sf_dir: str) -> Graph:
    documents = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels")
    doc = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    label = (
        F.when(F.col("toxic") == 1, F.lit(None).cast("string"))
        .when(F.col("quality") == 1, F.lit("Good"))
        .otherwise(F.lit(" "))
    )
    nodes = _union(
        [
            labels.select(doc.alias("node_id"), label.alias("label"), doc.alias("name")),
            documents.select(
                F.col("source").alias("node_id"),
                F.lit("nan").alias("label"),
                F.col("source").alias("name"),
            ).distinct(),
            documents.select(
                F.col("lang").alias("node_id"),
                F.lit("Language").alias("label"),
                F.col("lang").alias("name"),
            ).distinct(),
        ]
    )
    edges = _union(
        [
            documents.select(
                F.col("source").alias("source_node_id"),
                doc.alias("target_node_id"),
                F.lit("lists").alias("relation_type"),
            ),
            documents.select(
                doc.alias("source_node_id"),
                F.col("lang").alias("target_node_id"),
                F.lit("written_in").alias("relation_type"),
            ),
        ]
    )
    return Graph(nodes, edges)

"""Counts, degrees and category metrics.

Everything that groups by a node or a label is pre-aggregated on the map side;
no group is ever gathered as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.sizing import as_seeds
from kgweave.model import BOTH, INCOMING, OUTGOING
from kgweave.operators.joins import touching
from kgweave.operators.select import filter_label


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total_nodes"))


def count_edges(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("total_edges"))


def label_histogram(nodes: DataFrame) -> DataFrame:
    """Nodes per label, ascending label, null label dropped."""
    return category_size(nodes).orderBy("label")


def category_size(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.count("*").alias("node_count"))
    )


def _ends(edges: DataFrame) -> DataFrame:
    """One row per edge end, with the end's side and a self-loop mark."""
    loop = (F.col("source_node_id") == F.col("target_node_id")).cast("int")
    return edges.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("source_node_id").alias("node_id"),
                    F.lit(1).alias("leaves"),
                    F.coalesce(loop, F.lit(0)).alias("loops"),
                ),
                F.struct(
                    F.col("target_node_id").alias("node_id"),
                    F.lit(0).alias("leaves"),
                    F.lit(0).alias("loops"),
                ),
            )
        )
    ).filter(F.col("node_id").isNotNull())


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree by id; null where the id has no edge on that side."""
    counted = _ends(edges).groupBy("node_id").agg(
        F.sum("leaves").alias("_out"), F.count("*").alias("_all")
    )
    return counted.select(
        "node_id",
        F.nullif(F.col("_out"), F.lit(0)).alias("out_degree"),
        F.nullif(F.col("_all") - F.col("_out"), F.lit(0)).alias("in_degree"),
    )


def two_sided_degree(edges: DataFrame) -> DataFrame:
    """Out plus in, null when either side is missing."""
    return degrees(edges).select(
        "node_id", (F.col("out_degree") + F.col("in_degree")).alias("degree")
    )


def total_degree(edges: DataFrame) -> DataFrame:
    zero = F.lit(0)
    return degrees(edges).select(
        "node_id",
        (F.coalesce("out_degree", zero) + F.coalesce("in_degree", zero)).alias("degree"),
    )


def edge_count(
    edges: DataFrame, seeds, direction: str | None = BOTH, small: bool | None = None
) -> DataFrame:
    """Edge rows per seed; a self-loop counts once, no direction counts 0."""
    seeds = as_seeds(edges.sparkSession, seeds, small)
    counted = {
        OUTGOING: F.sum("leaves"),
        INCOMING: F.count("*") - F.sum("leaves"),
        BOTH: F.count("*") - F.sum("loops"),
    }.get(direction)
    if counted is None:
        return seeds.ids.select("seed_id", F.lit(0).cast("bigint").alias("edge_count"))
    near = seeds.prune(edges, "source_node_id", "target_node_id")
    per_node = (
        seeds.restrict(_ends(near), "node_id")
        .groupBy("node_id")
        .agg(counted.alias("_count"))
    )
    return seeds.ids.join(
        per_node, F.col("seed_id") == F.col("node_id"), "left"
    ).select("seed_id", F.coalesce("_count", F.lit(0)).alias("edge_count"))


def edge_counts(edges: DataFrame, seeds, small: bool | None = None) -> DataFrame:
    """All three directions per seed from one pass over the edges."""
    seeds = as_seeds(edges.sparkSession, seeds, small)
    near = seeds.prune(edges, "source_node_id", "target_node_id")
    per_node = (
        seeds.restrict(_ends(near), "node_id")
        .groupBy("node_id")
        .agg(
            F.sum("leaves").alias("_out"),
            (F.count("*") - F.sum("leaves")).alias("_in"),
            (F.count("*") - F.sum("loops")).alias("_both"),
        )
    )
    zero = F.lit(0)
    return seeds.ids.join(
        per_node, F.col("seed_id") == F.col("node_id"), "left"
    ).select(
        "seed_id",
        F.coalesce("_out", zero).alias("outgoing"),
        F.coalesce("_in", zero).alias("incoming"),
        F.coalesce("_both", zero).alias("both"),
    )


def subgraph_size(vertices: DataFrame) -> DataFrame:
    return vertices.agg(F.countDistinct("id").alias("subgraph_size"))


def distinct_names(nodes: DataFrame) -> DataFrame:
    return nodes.select("name").distinct()


def distinct_terms(nodes: DataFrame) -> DataFrame:
    return nodes.select("name", "label").distinct()


def category_connections(
    nodes: DataFrame, edges: DataFrame, label: str | None = None
) -> DataFrame:
    """Edge rows touching each category, each edge once per category."""
    if label is not None:
        touched = touching(edges, filter_label(nodes, label).select("node_id"))
        return touched.agg(F.count("*").alias("connections")).select(
            F.lit(label).alias("label"), "connections"
        )
    return category_metrics(nodes, edges).select("label", "connections")


def category_metrics(
    nodes: DataFrame, edges: DataFrame, labels: list[str] | None = None
) -> DataFrame:
    """Per label: its nodes, edge rows touching it, and the vertices of its
    subgraph (its nodes and their neighbours).

    One pass: each edge tells both of its categories about the other end, and
    the distinct ``(label, vertex)`` pairs are counted last.  The joins with
    the nodes feed other keys, so a hub's partition can be split; after them a
    big label is spread over its vertices until the final map-side combined
    sums.
    """
    known = nodes.select("node_id", "label")
    ends = edges.select("source_node_id", "target_node_id")
    if labels is not None:
        members = as_seeds(nodes.sparkSession, known.filter(F.col("label").isin(*labels)))
        ends = members.restrict(ends, "source_node_id", "target_node_id")
    for end in ("source", "target"):
        side = known.select(
            F.col("node_id").alias(f"_{end}"),
            F.col("label").alias(f"_{end}_label"),
        )
        ends = ends.join(side, F.col(f"{end}_node_id") == F.col(f"_{end}"), "left")

    def touch(own: str, other: str, connections):
        return F.struct(
            F.col(f"_{own}_label").alias("label"),
            F.col(f"_{other}").alias("id"),
            connections.alias("connections"),
            F.lit(0).alias("member"),
        )

    inside = F.col("_source_label").eqNullSafe(F.col("_target_label"))
    touches = ends.select(
        F.inline(
            F.array(
                touch("source", "target", F.lit(1)),
                touch("target", "source", F.when(inside, 0).otherwise(1)),
            )
        )
    )
    members = known.select(
        "label",
        F.col("node_id").alias("id"),
        F.lit(0).alias("connections"),
        F.lit(1).alias("member"),
    )
    rows = touches.unionByName(members).filter(F.col("label").isNotNull())
    if labels is not None:
        rows = rows.filter(F.col("label").isin(*labels))
    per_vertex = rows.groupBy("label", "id").agg(
        F.sum("connections").alias("_connections"), F.sum("member").alias("_member")
    )
    # A dangling end has a null id: its edge counts, its vertex does not.
    found = per_vertex.groupBy("label").agg(
        F.sum("_member").alias("node_count"),
        F.sum("_connections").alias("connections"),
        F.count("id").alias("subgraph_size"),
    )
    if labels is None:
        return found
    # A wanted label without nodes counts nothing.
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(labels)], "label string")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("node_count", "connections", "subgraph_size")}
    return wanted.join(found, "label", "left").select("label", *zero.values())

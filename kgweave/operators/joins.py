"""Joins between edges, nodes and seed sets.

All are equi-joins without hints on tables that grow with the data: Catalyst
and AQE choose broadcast by measured size and split skewed partitions of the
sort-merge form.  None of them feeds an aggregate on its own join key, so a
hub's partition can always be split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.functions.sizing import as_seeds
from kgweave.model import BOTH, INCOMING, OUTGOING, check_direction


def lookup(nodes: DataFrame, prefix: str) -> DataFrame:
    """Node columns renamed with a prefix, ready to join on ``<prefix>_id``."""
    return nodes.select(
        F.col("node_id").alias(f"{prefix}_id"),
        F.col("label").alias(f"{prefix}_label"),
        F.col("name").alias(f"{prefix}_name"),
    )


def join_target(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge with its target's label and name; dangling edges drop out."""
    ends = lookup(nodes, "target")
    return edges.join(ends, F.col("target_node_id") == F.col("target_id")).drop(
        "target_id"
    )


def join_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = lookup(nodes, "source")
    return edges.join(ends, F.col("source_node_id") == F.col("source_id")).drop(
        "source_id"
    )


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint outside the node table, once per missing side."""
    ids = nodes.select("node_id")
    sides = [
        edges.join(ids, F.col(f"{side}_node_id") == F.col("node_id"), "left_anti")
        .withColumn("missing_side", F.lit(side))
        for side in ("source", "target")
    ]
    return reduce(DataFrame.unionByName, sides)


def touching(edges: DataFrame, ids, small: bool | None = None) -> DataFrame:
    """Edges whose source or target is in the id set, each edge row once.

    An OR in a join condition plans as a nested loop; two flagged equi-joins
    against the distinct ids give the same rows.
    """
    seeds = as_seeds(edges.sparkSession, ids, small)
    flagged = seeds.restrict(edges, "source_node_id", "target_node_id")
    if seeds.small:
        return flagged
    for end in ("source", "target"):
        hits = seeds.ids.select(
            F.col("seed_id").alias(f"_{end}"), F.lit(True).alias(f"_hit_{end}")
        )
        flagged = flagged.join(hits, F.col(f"{end}_node_id") == F.col(f"_{end}"), "left")
    hit = F.col("_hit_source").isNotNull() | F.col("_hit_target").isNotNull()
    return flagged.filter(hit).select(*edges.columns)


def semi_ids(nodes: DataFrame, ids, small: bool | None = None) -> DataFrame:
    """Nodes whose id is in the set."""
    seeds = as_seeds(nodes.sparkSession, ids, small)
    return seeds.keep(nodes, "node_id")


def seed_names(edges: DataFrame, nodes: DataFrame, side: str = "source") -> DataFrame:
    """Edges with the name of the node on the given side."""
    names = nodes.select(F.col("node_id").alias("_seed"), F.col("name").alias("seed_name"))
    return edges.join(names, F.col(f"{side}_node_id") == F.col("_seed")).drop("_seed")


def near_ends(direction: str) -> tuple[str, ...]:
    """The edge columns that hold the end an edge is seen from."""
    outgoing = ("source_node_id",) if direction in (OUTGOING, BOTH) else ()
    incoming = ("target_node_id",) if direction in (INCOMING, BOTH) else ()
    return outgoing + incoming


def half_edges(edges: DataFrame, direction: str, *extra: str) -> DataFrame:
    """Edges seen from one end: ``(a, b, phase, source, target, relation)``.

    ``a`` is the end the edge is seen from and ``b`` the other one; phase 0 is
    outgoing from ``a``, phase 1 incoming.  Both directions come from a single
    scan.
    """
    check_direction(direction)
    views = []
    ends = ("source_node_id", "target_node_id")
    if direction in (OUTGOING, BOTH):
        views.append((*ends, 0))
    if direction in (INCOMING, BOTH):
        views.append((*reversed(ends), 1))
    carried = [
        F.col("source_node_id").alias("source"),
        F.col("target_node_id").alias("target"),
        F.col("relation_type").alias("relation"),
        *(F.col(c) for c in extra),
    ]
    if len(views) == 1:
        a, b, phase = views[0]
        return edges.select(
            F.col(a).alias("a"), F.col(b).alias("b"), F.lit(phase).alias("phase"), *carried
        )
    seen = F.array(
        *(
            F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(p).alias("phase"))
            for a, b, p in views
        )
    )
    return edges.select(F.inline(seen), *carried)

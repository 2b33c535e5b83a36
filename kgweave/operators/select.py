"""Projections, filters and lookups over the node and edge tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.columns import (
    is_blank,
    properties_or_empty,
    shown,
)
from kgweave.functions.sizing import as_seeds, measured_keys
from kgweave.model import ALL, BOTH, NODE_ORDER, OUTGOING, check_direction
from kgweave.operators.joins import touching


def list_labels(nodes: DataFrame, mode: str = "clean") -> DataFrame:
    """Distinct labels, ascending.

    ``raw`` keeps a null label, ``non_null`` drops it, ``clean`` also drops
    blank labels and the text ``nan``.
    """
    labels = nodes.select("label").distinct()
    if mode == "non_null":
        labels = labels.filter(F.col("label").isNotNull())
    elif mode == "clean":
        labels = labels.filter(~is_blank(F.col("label")) & (F.col("label") != "nan"))
    elif mode != "raw":
        raise ValueError(f"unknown mode {mode!r}")
    return sorted_values(labels, "label")


def sorted_values(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(column)


def filter_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes if label == ALL else nodes.filter(F.col("label") == label)


def list_names(nodes: DataFrame, label: str) -> DataFrame:
    names = filter_label(nodes, label).select("name").distinct()
    return sorted_values(names.filter(F.col("name").isNotNull()), "name")


def names_by_label(nodes: DataFrame) -> DataFrame:
    """Per label its row count and its distinct names, one row per name.

    Names stay rows: one label may hold a third of all names, and an array of
    them would be one cell built by one task.  A label none of whose nodes has a
    name keeps one row, with a null name.
    """
    per_name = (
        nodes.filter(F.col("label").isNotNull())
        .groupBy("label", "name")
        .agg(F.count("*").alias("_rows"))
    )
    sizes = per_name.groupBy("label").agg(F.sum("_rows").alias("node_count"))
    named = per_name.filter(F.col("name").isNotNull()).select("label", "name")
    return sizes.join(named, "label", "left").select("label", "node_count", "name")


def find_node(
    nodes: DataFrame,
    wanted: DataFrame,
    order_by: Iterable[str] = NODE_ORDER,
    small: bool | None = None,
) -> DataFrame:
    """First node per wanted ``(label, name)``; pairs without a node drop out."""
    return _first_per_key(nodes, wanted, ["label", "name"], order_by, small, "inner")


def find_node_by_name(
    nodes: DataFrame,
    names: DataFrame,
    order_by: Iterable[str] = NODE_ORDER,
    small: bool | None = None,
) -> DataFrame:
    """First node with each name in the whole table, label ignored.

    Every wanted name comes back; ``found`` tells whether it has a node.
    """
    rows = _first_per_key(nodes, names, ["name"], order_by, small, "left")
    return rows.withColumn("found", F.col("node_id").isNotNull())


def _first_per_key(nodes, wanted, keys, order_by, small, how) -> DataFrame:
    wanted = wanted.select(*keys)
    if small is None:
        wanted, small, _ = measured_keys(wanted)
    else:
        wanted = wanted.distinct()
    # A name may be shared by a third of all nodes: aggregate with map-side
    # combine before the wanted keys are met on the shuffle.
    rows = nodes.join(F.broadcast(wanted), keys, "left_semi") if small else nodes
    others = [c for c in nodes.columns if c not in keys]
    first = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct(*order_by)).alias("_first")
    )
    return wanted.join(first, keys, how).select(*keys, "_first.*")


def find_node_by_id(nodes: DataFrame, ids, small: bool | None = None) -> DataFrame:
    seeds = as_seeds(nodes.sparkSession, ids, small)
    return seeds.keep(nodes, "node_id")


def node_properties(nodes: DataFrame, ids=None, small: bool | None = None) -> DataFrame:
    """JSON properties of the chosen nodes (all without ``ids``)."""
    chosen = nodes if ids is None else find_node_by_id(nodes, ids, small)
    properties = (
        properties_or_empty(F.col("properties"))
        if "properties" in nodes.columns
        else F.lit("{}")
    )
    return chosen.select("node_id", properties.alias("properties"))


def incident_edges(
    edges: DataFrame, seeds, direction: str = BOTH, small: bool | None = None
) -> DataFrame:
    """Edges leaving, entering or touching the seeds, each row once."""
    check_direction(direction)
    seeds = as_seeds(edges.sparkSession, seeds, small)
    if direction == BOTH:
        return touching(edges, seeds)
    key = "source_node_id" if direction == OUTGOING else "target_node_id"
    return seeds.keep(edges, key)


def nonblank(questions: DataFrame, column: str = "question") -> DataFrame:
    return questions.filter(~is_blank(F.col(column)))


def vertex_title(category_view: bool) -> Column:
    name = shown(F.col("name"))
    if not category_view:
        return name
    return F.concat(name, F.lit(" ("), shown(F.col("label")), F.lit(")"))


def vertex_columns(nodes: DataFrame, category_view: bool = False) -> DataFrame:
    """``(id, label, group, title)``; category views title ``name (label)``."""
    label = shown(F.col("label"))
    return nodes.select(
        F.col("node_id").alias("id"),
        label.alias("label"),
        label.alias("group"),
        vertex_title(category_view).alias("title"),
    )


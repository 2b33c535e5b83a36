"""First-k operators.

Every per-group cut is a ``row_number() <= k`` window, which Spark applies per
map task before the shuffle (WindowGroupLimit): a hub ships k rows per task,
not all its edges.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgweave.functions.sizing import as_seeds, bounded
from kgweave.model import BOTH, EDGE_ORDER, NODE_ORDER
from kgweave.operators.joins import half_edges, near_ends, semi_ids
from kgweave.operators.select import filter_label
from kgweave.operators.stats import two_sided_degree

# Names that the edge columns carry in half edges.
HALF_NAMES = dict(zip(EDGE_ORDER, ("source", "target", "relation")))


def first_per_group(df: DataFrame, keys: list[str], order_by, k: int, rank: str = "rank"):
    window = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_nodes(
    nodes: DataFrame, n: int = 15, order_by: Iterable[str] = NODE_ORDER
) -> DataFrame:
    return nodes.orderBy(*order_by).limit(n)


def first_edges_per_node(
    edges: DataFrame,
    k: int = 10,
    direction: str = BOTH,
    seeds=None,
    order_by: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> DataFrame:
    """First k edges per node and side: half-edge columns plus ``rank``.

    The cut comes before any lookup of the other end, so dangling edges use up
    the budget.  Small seed sets thin the edges before they are ranked; large
    ones are met after the cut, when no node has more than k rows left.
    """
    order_by = tuple(order_by)
    extra = [c for c in order_by if c not in EDGE_ORDER]
    if seeds is None:
        half = half_edges(edges, direction, *extra)
        near = None
    else:
        near = as_seeds(edges.sparkSession, seeds, small)
        thinned = near.prune(edges, *near_ends(direction))
        half = near.restrict(half_edges(thinned, direction, *extra), "a")
    # Seen from one end, the default order is that of the other end.
    order = [HALF_NAMES.get(c, c) for c in order_by]
    if order_by == EDGE_ORDER:
        order = ["b", "relation"]
    ranked = first_per_group(
        half.filter(F.col("a").isNotNull()), ["a", "phase"], order, k
    ).drop(*extra)
    if near is None or near.small or near.pushable:
        return ranked
    return near.keep(ranked, "a")


def most_connected_ids(edges: DataFrame, n: int = 15) -> DataFrame:
    """Ids of the n largest two-sided degrees, one-sided ids last."""
    return (
        two_sided_degree(edges)
        .orderBy(F.col("degree").desc_nulls_last(), "node_id")
        .limit(n)
    )


def most_connected(nodes: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """Nodes of the n most connected ids; an id without a node drops out."""
    ids, held = bounded(most_connected_ids(edges, n), n)
    return semi_ids(nodes, held or ids)


def examples_per_label(
    nodes: DataFrame, k: int = 3, order_by: Iterable[str] = NODE_ORDER
) -> DataFrame:
    labelled = nodes.filter(F.col("label").isNotNull())
    return first_per_group(labelled, ["label"], order_by, k)


def category_sample(
    nodes: DataFrame, label: str, k: int = 5, order_by: Iterable[str] = NODE_ORDER
) -> DataFrame:
    """First k nodes of a label, or of the whole table for "All"."""
    return first_nodes(filter_label(nodes, label), k, order_by)



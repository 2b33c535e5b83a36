"""Neighbourhood and category subgraphs.

Edges are first collapsed to a simple digraph by a group over both ends, which
spreads a hub over its neighbours.  Where each seed has a subgraph of its own,
an edge is then seen from its seed end and looked up at the other one.  Where
all seeds share one graph, it stays one row: both ends are looked up once, with
a flag that says which of them is a seed, and what two seeds would write to it
is decided within the row.  Either way no join feeds a group on its own key, so
AQE may split a hub's partition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.columns import shown
from kgweave.functions.sizing import Seeds, as_seeds, hinted
from kgweave.model import (
    ALL,
    BOTH,
    EDGE_ORDER,
    NODE_ORDER,
    Subgraph,
    check_direction,
)
from kgweave.operators.joins import half_edges, near_ends
from kgweave.operators.select import filter_label, vertex_columns

# Vertex styles of the category view.
SEED_COLOR, SEED_SIZE = "#FF6B6B", 40
OUT_COLOR = "#ADD8E6"
IN_COLOR = "#90EE90"
INSIDE_COLOR = "#FFB6C1"


def simple_digraph(
    edges: DataFrame, order_by: Iterable[str | Column] = EDGE_ORDER
) -> DataFrame:
    """One edge per ordered pair; the last in order keeps its attributes."""
    ends = ["source_node_id", "target_node_id"]
    order_by = list(order_by)
    attributes = [c for c in edges.columns if c not in ends]
    if attributes == ["relation_type"] and order_by == list(EDGE_ORDER):
        # Within a pair the default order is the order of the relation itself.
        return edges.groupBy(*ends).agg(F.max("relation_type").alias("relation_type"))
    # Ties in the order are decided by the attributes themselves.
    last = F.max_by(F.struct(*attributes), F.struct(*order_by, *attributes))
    return edges.groupBy(*ends).agg(last.alias("_last")).select(*ends, "_last.*")


def merge_vertices(
    touches: DataFrame, priority: Iterable[str], keep: Iterable[str] = ()
) -> DataFrame:
    """One vertex per id from its touches.

    Attributes of the touch with the highest priority win; those in ``keep``
    are not rewritten by touches that leave them null.
    """
    priority, keep = list(priority), list(keep)
    attributes = [c for c in touches.columns if c not in ("id", *priority, *keep)]
    last = F.max_by(F.struct(*attributes), F.struct(*priority)).alias("_last")
    kept = [F.max(c).alias(c) for c in keep]
    return touches.groupBy("id").agg(last, *kept).select("id", "_last.*", *keep)


def _collapsed(
    edges: DataFrame,
    seeds: Seeds,
    direction: str,
    order_by: Iterable[str],
    reverse_incoming: bool = False,
) -> DataFrame:
    """Half edges ``(a, b, phase, source, target, relation)`` of the simple
    digraph, each edge once per seed that sees it.

    Small seed sets have already thinned them to the seeds' edges.
    """
    near = seeds.restrict(edges, *near_ends(direction))
    keep = list(dict.fromkeys([*EDGE_ORDER, *order_by]))
    simple = simple_digraph(near.select(*keep), order_by)
    half = half_edges(simple, direction)
    if direction == BOTH:
        # The other end of a kept edge need not be a seed.
        half = seeds.restrict(half, "a")
    half = half.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    if not reverse_incoming:
        # A self-loop is seen twice from the same end: keep the outgoing view.
        loop = (F.col("a") == F.col("b")) & (F.col("phase") == 1)
        return half.filter(~loop) if direction == BOTH else half
    # Opposite edges between two nodes fall together; the incoming one wins.
    last = F.max_by(F.struct("relation", "phase"), "phase").alias("_last")
    return (
        half.groupBy("a", "b")
        .agg(last)
        .select("a", "b", "_last.*", F.col("a").alias("source"), F.col("b").alias("target"))
    )


def _seed_nodes(nodes: DataFrame, seeds: Seeds) -> DataFrame:
    return seeds.keep(nodes.select("node_id", "label", "name"), "node_id")


def _neighbours(edges: DataFrame, seeds: Seeds, direction: str) -> DataFrame:
    """Distinct pairs of a node ``a`` and another node ``b`` next to it."""
    near = seeds.prune(edges, *near_ends(direction))
    pairs = seeds.restrict(half_edges(near, direction).select("a", "b"), "a")
    return pairs.filter(F.col("a") != F.col("b")).distinct()


def _from_seeds(collapsed: DataFrame, seeded: DataFrame, small: bool) -> DataFrame:
    """Half edges whose near end is a seed that exists as a node."""
    ids = seeded.select(F.col("node_id").alias("a"))
    return collapsed.join(hinted(ids, small), "a", "left_semi")


def _far_ends(half: DataFrame, nodes: DataFrame) -> DataFrame:
    """Half edges with the far node's label and name; dangling ones drop out."""
    far = nodes.select(
        F.col("node_id").alias("b"),
        F.col("label").alias("far_label"),
        F.col("name").alias("far_name"),
    )
    return half.join(far, "b")


def _simple_near(edges: DataFrame, seeds: Seeds, direction: str, order_by: Iterable[str]) -> DataFrame:
    """The simple digraph, of a small seed set only the edges that it sees."""
    keep = list(dict.fromkeys([*EDGE_ORDER, *order_by]))
    near = seeds.restrict(edges, *near_ends(direction))
    return simple_digraph(near.select(*keep), order_by)


def _between(simple: DataFrame, ends: DataFrame) -> DataFrame:
    """Edges with the columns of ``ends`` (node_id, ...) for the source (s_) and
    the target (t_); dangling edges drop out."""
    for side, prefix in (("source", "s_"), ("target", "t_")):
        found = ends.select(*(F.col(c).alias(prefix + c) for c in ends.columns))
        simple = simple.join(found, F.col(f"{side}_node_id") == F.col(f"{prefix}node_id"))
    return simple


def _flagged(nodes: DataFrame, seeds: Seeds, *columns: str) -> DataFrame:
    """Nodes with ``seed``: whether the node is one."""
    ids = seeds.ids.select("seed_id", F.lit(True).alias("seed"))
    return nodes.join(
        hinted(ids, seeds.small), F.col("node_id") == F.col("seed_id"), "left"
    ).select("node_id", *columns, F.coalesce("seed", F.lit(False)).alias("seed"))


def _seen(direction: str) -> Column:
    """Whether a seed sees the edge in this direction, by the flags of its ends."""
    ends = {"source_node_id": F.col("s_seed"), "target_node_id": F.col("t_seed")}
    hit = F.lit(False)
    for end in near_ends(direction):
        hit = hit | ends[end]
    return hit


def ego(
    nodes: DataFrame,
    edges: DataFrame,
    seeds,
    direction: str = BOTH,
    reverse_incoming: bool = False,
    order_by: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> Subgraph:
    """One-hop neighbourhood of every seed, each a subgraph of its own.

    Rows carry ``seed_id``.  Edges are titled with the neighbour's name.  With
    ``reverse_incoming`` an incoming edge is stored from the seed outwards and
    overwrites an outgoing one to the same neighbour.
    """
    check_direction(direction)
    seeds = as_seeds(nodes.sparkSession, seeds, small)
    seeded = _seed_nodes(nodes, seeds)
    half = _from_seeds(
        _collapsed(edges, seeds, direction, order_by, reverse_incoming),
        seeded,
        seeds.small,
    )
    ego_edges = _far_ends(half, nodes).select(
        F.col("a").alias("seed_id"),
        "source",
        "target",
        shown(F.col("relation")).alias("label"),
        shown(F.col("far_name")).alias("title"),
    )
    # Distinct already: pairs leave out the seed itself, which is added once.
    members = (
        _from_seeds(_neighbours(edges, seeds, direction), seeded, seeds.small)
        .select(F.col("a").alias("seed_id"), F.col("b").alias("node_id"))
        .unionByName(seeded.select(F.col("node_id").alias("seed_id"), "node_id"))
    )
    vertices = members.join(nodes, "node_id")
    return Subgraph(
        vertices.select(
            "seed_id",
            F.col("node_id").alias("id"),
            shown(F.col("label")).alias("label"),
            shown(F.col("label")).alias("group"),
            shown(F.col("name")).alias("title"),
        ),
        ego_edges,
    )


def ego_multi(
    nodes: DataFrame,
    edges: DataFrame,
    seeds,
    direction: str = BOTH,
    order_by: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> Subgraph:
    """Union of the one-hop neighbourhoods of all seeds, as one graph."""
    check_direction(direction)
    seeds = as_seeds(nodes.sparkSession, seeds, small)
    seeded = _seed_nodes(nodes, seeds)
    simple = _simple_near(edges, seeds, direction, order_by)
    merged = (
        _between(simple, _flagged(nodes, seeds))
        .filter(_seen(direction))
        .select(
            F.col("source_node_id").alias("source"),
            F.col("target_node_id").alias("target"),
            shown(F.col("relation_type")).alias("label"),
        )
    )
    members = (
        _from_seeds(_neighbours(edges, seeds, direction), seeded, seeds.small)
        .select(F.col("b").alias("node_id"))
        .unionByName(seeded.select("node_id"))
        .distinct()
    )
    vertices = nodes.join(members, "node_id", "left_semi")
    return Subgraph(
        vertices.select(
            F.col("node_id").alias("id"),
            shown(F.col("label")).alias("label"),
            shown(F.col("name")).alias("title"),
        ),
        merged,
    )


def category_graph(
    nodes: DataFrame,
    edges: DataFrame,
    label: str,
    styled: bool = False,
    node_order: Iterable[str] = NODE_ORDER,
    edge_order: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> Subgraph:
    """All nodes of a label with their neighbours both ways.

    "All" is the whole graph.  An edge between two nodes of the label is
    written from both; the write from the later node wins, incoming after
    outgoing.  Plain edge titles name the other end; styled ones read
    ``relation: source → target`` and vertices get a colour and a size.
    """
    order = list(node_order)
    members = filter_label(nodes, label)
    if small is None and label == ALL:
        small = False
    seeds = as_seeds(nodes.sparkSession, members, small)
    inside = F.lit(True) if label == ALL else F.coalesce(F.col("label") == label, F.lit(False))
    ends = nodes.select(
        "node_id", "name", F.struct(*order).alias("order"), inside.alias("seed")
    )
    between = _between(_simple_near(edges, seeds, BOTH, edge_order), ends).filter(_seen(BOTH))
    # The later of two seeds wrote last; one seed alone wrote the edge.
    by_source = F.col("s_seed") & (~F.col("t_seed") | (F.col("s_order") > F.col("t_order")))
    near, far = shown(F.col("s_name")), shown(F.col("t_name"))
    relation = shown(F.col("relation_type"))
    if styled:
        title = F.concat(relation, F.lit(": "), near, F.lit(" → "), far)
    else:
        title = F.when(by_source, far).otherwise(near)
    graph_edges = between.select(
        F.col("source_node_id").alias("source"),
        F.col("target_node_id").alias("target"),
        relation.alias("label"),
        title.alias("title"),
    )
    seed_order = members.select(
        F.col("node_id").alias("a"), F.struct(*order).alias("seed_order")
    )
    thinned = seeds.prune(edges, "source_node_id", "target_node_id")
    touches = half_edges(thinned, BOTH).select("a", "b", "phase").join(seed_order, "a")
    vertices = _category_vertices(nodes, touches, members, label, styled)
    return Subgraph(vertices, graph_edges)


def _category_vertices(nodes, half, members, label, styled) -> DataFrame:
    # Touches are merged per vertex before the nodes are looked up, so a hub
    # reaches the join as one row.
    touches = half.select(
        F.col("b").alias("id"),
        F.col("phase").alias("touched"),
        "seed_order",
        "phase",
        F.lit(None).cast("int").alias("size"),
    )
    seeds = members.select(
        F.col("node_id").alias("id"),
        F.lit(None).cast("int").alias("touched"),
        F.lit(None).cast(touches.schema["seed_order"].dataType).alias("seed_order"),
        F.lit(-1).alias("phase"),
        F.lit(SEED_SIZE).alias("size"),
    )
    merged = merge_vertices(
        seeds.unionByName(touches), ["seed_order", "phase"], keep=["size"]
    )
    looked_up = nodes.join(merged, nodes["node_id"] == merged["id"]).drop("id")
    columns = vertex_columns(looked_up, category_view=True)
    if not styled:
        return columns
    return looked_up.select(
        F.col("node_id").alias("id"),
        shown(F.col("label")).alias("label"),
        shown(F.col("label")).alias("group"),
        F.concat(
            shown(F.col("name")), F.lit(" ("), shown(F.col("label")), F.lit(")")
        ).alias("title"),
        vertex_color(label).alias("color"),
        "size",
    )


def vertex_color(label: str) -> Column:
    """Colour by the last touch: none, inside the label, outgoing, incoming.

    With "All" no node's label equals the selected one, so touched vertices
    are coloured by direction.
    """
    return (
        F.when(F.col("touched").isNull(), SEED_COLOR)
        .when(F.col("label") == label, INSIDE_COLOR)
        .when(F.col("touched") == 0, OUT_COLOR)
        .otherwise(IN_COLOR)
    )

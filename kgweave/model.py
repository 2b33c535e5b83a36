"""Data model shared by all operators: columns, order keys, directions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

NODE_COLUMNS = ("node_id", "label", "name")
EDGE_COLUMNS = ("source_node_id", "target_node_id", "relation_type")

# Row order is part of the semantics of every first-k, first-match and
# last-write operator.  These are the defaults of their ``order_by`` argument.
NODE_ORDER = ("node_id",)
EDGE_ORDER = ("source_node_id", "target_node_id", "relation_type")

OUTGOING = "Outgoing"
INCOMING = "Incoming"
BOTH = "Both"
DIRECTIONS = (OUTGOING, INCOMING, BOTH)

# The pseudo label that stands for the whole node table.
ALL = "All"


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


class Subgraph(NamedTuple):
    vertices: DataFrame
    edges: DataFrame


def check_direction(direction: str) -> str:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, got {direction!r}")
    return direction

"""Set-based property-graph analytics on PySpark.

A graph is two DataFrames, nodes and edges.  Every operator takes DataFrames
and returns DataFrames; "the selected node" is a set of seeds and "the
question" is a column of a questions table, so one call serves one row or a
billion.
"""

from kgweave.model import (
    BOTH,
    EDGE_ORDER,
    INCOMING,
    NODE_ORDER,
    OUTGOING,
    Graph,
    Subgraph,
)

__all__ = [
    "BOTH",
    "EDGE_ORDER",
    "INCOMING",
    "NODE_ORDER",
    "OUTGOING",
    "Graph",
    "Subgraph",
]

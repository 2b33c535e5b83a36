"""Graph facts as text: node, category and whole-graph summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.columns import has_properties, ordered_lines, shown
from kgweave.functions.sizing import (
    PUSHED_IDS,
    as_seeds,
    bounded,
    hinted,
    measured,
    measured_keys,
)
from kgweave.model import ALL, BOTH, EDGE_ORDER, NODE_ORDER, OUTGOING
from kgweave.operators.select import find_node_by_name
from kgweave.operators.stats import label_histogram
from kgweave.operators.topk import (
    examples_per_label,
    first_edges_per_node,
    first_nodes,
    most_connected,
)

# Section headers and sentences of the two summary styles.
FULL = {
    "outgoing": "\nOutgoing Relationships:",
    "incoming": "\nIncoming Relationships:",
    "properties": "\nNode Properties: ",
    "missing": "Node '{}' not found in the knowledge graph.",
}
COMPACT = {
    "outgoing": "\nOutgoing:",
    "incoming": "\nIncoming:",
    "properties": None,
    "missing": "Node '{}' not found.",
}
STYLES = {"full": FULL, "compact": COMPACT}
RULE = "-" * 40
ALL_HEADING = "Sample nodes from entire graph:\n"
LABEL_HEADING = "Nodes in '{}' category:\n"
GRAPH_HEADING = "COMPLETE KNOWLEDGE GRAPH:"
RELATIONS_HEADING = "\nKEY RELATIONSHIPS:"


def filled(template: str, value: Column) -> Column:
    """A template with one ``{}`` slot as a column."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def node_summary(
    nodes: DataFrame,
    edges: DataFrame,
    seeds,
    k: int = 10,
    style: str = "full",
    order_by: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> DataFrame:
    """``(node_id, summary)`` per seed that exists.

    A header line, then up to k outgoing and up to k incoming relations.  A
    section header stands when the node has any edge on that side, even when
    no listed neighbour exists.  Each text has at most 2k + 4 lines.
    """
    seeds = as_seeds(nodes.sparkSession, seeds, small)
    texts = STYLES[style]
    top = first_edges_per_node(edges, k, BOTH, seeds, order_by)
    far = nodes.select(
        F.col("node_id").alias("b"),
        F.col("label").alias("far_label"),
        F.col("name").alias("far_name"),
        F.lit(True).alias("exists"),
    )
    outgoing = F.col("phase") == 0
    header = F.when(
        F.col("rank") == 1, F.when(outgoing, texts["outgoing"]).otherwise(texts["incoming"])
    )
    relation = F.when(
        F.col("exists"),
        F.concat(
            F.when(outgoing, "  → ").otherwise("  ← "),
            shown(F.col("far_name")),
            F.lit(" ("),
            shown(F.col("far_label")),
            F.lit(") via '"),
            shown(F.col("relation")),
            F.lit("'"),
        ),
    )
    sections = (
        top.join(far, "b", "left")
        .select("a", "phase", "rank", F.concat_ws("\n", header, relation).alias("line"))
        .filter(F.col("line") != "")
        .groupBy("a")
        .agg(
            ordered_lines([F.col("phase"), F.col("rank")], F.col("line")).alias(
                "sections"
            )
        )
    )
    head = F.concat(
        F.lit("Node: "),
        shown(F.col("name")),
        F.lit(" (Type: "),
        shown(F.col("label")),
        F.lit(")"),
    )
    tail = F.lit(None).cast("string")
    if texts["properties"] and "properties" in nodes.columns:
        properties = F.col("properties")
        tail = F.when(
            has_properties(properties), F.concat(F.lit(texts["properties"]), properties)
        )
    return (
        seeds.keep(nodes, "node_id")
        .join(sections, F.col("node_id") == F.col("a"), "left")
        .select("node_id", F.concat_ws("\n", head, "sections", tail).alias("summary"))
    )


def node_summary_by_name(
    nodes: DataFrame,
    edges: DataFrame,
    names: DataFrame | list[str],
    k: int = 10,
    style: str = "full",
    node_order: Iterable[str] = NODE_ORDER,
    edge_order: Iterable[str] = EDGE_ORDER,
    small: bool | None = None,
) -> DataFrame:
    """``(name, summary)`` of the first node with each name.

    ``names`` is a list, or a DataFrame with ``name``.  An unknown name gets the
    not-found sentence.
    """
    if isinstance(names, DataFrame):
        names = names.select("name")
    else:
        spark, small = nodes.sparkSession, len(names) <= PUSHED_IDS
        names = spark.createDataFrame([(name,) for name in names], "name string")
    if small is None:
        names, small, _ = measured_keys(names)
    first = find_node_by_name(nodes, names, node_order, small).select("name", "node_id")
    held = None
    if small:
        # One row per name at most, so few names have few nodes.
        first, _, held = measured(first)
    texts = node_summary(nodes, edges, held or first, k, style, edge_order)
    missing = filled(STYLES[style]["missing"], shown(F.col("name")))
    return first.join(texts, "node_id", "left").select(
        "name", F.coalesce("summary", missing).alias("summary")
    )


def _sampled_texts(nodes, edges, sample, held, by, k, style, edge_order) -> DataFrame:
    """The sample's rows with the text of each node; ``held`` if few.

    ``by="name"`` looks the text up by the node's name, so a repeated name
    repeats the text of its first node.
    """
    if by == "id":
        texts = node_summary(nodes, edges, held or sample, k, style, edge_order)
        return sample.join(texts, "node_id")
    if by == "name":
        texts = node_summary_by_name(
            nodes, edges, sample, k, style, edge_order=edge_order
        )
        return sample.join(texts, "name")
    raise ValueError(f"unknown lookup {by!r}")


def category_summary(
    nodes: DataFrame,
    edges: DataFrame,
    labels: DataFrame | list[str] | None = None,
    max_nodes: int = 5,
    k: int = 3,
    by: str = "id",
    node_order: Iterable[str] = NODE_ORDER,
    edge_order: Iterable[str] = EDGE_ORDER,
) -> DataFrame:
    """``(label, summary)``: the first nodes of each category with relations.

    ``labels`` is a list, or a DataFrame with ``label``; "All" samples the
    whole table and a label without nodes gets its heading only.  Without
    ``labels`` every non-null label is summarised.  Each text has max_nodes
    node texts.
    """
    order = list(node_order)
    if labels is None:
        wanted, members = None, nodes
    elif isinstance(labels, DataFrame):
        wanted = labels.select("label").filter(F.col("label").isNotNull())
        wanted, small, _ = measured_keys(wanted)
        members = nodes.join(hinted(wanted, small), "label", "left_semi")
    else:
        wanted = nodes.sparkSession.createDataFrame(
            [(label,) for label in dict.fromkeys(labels)], "label string"
        )
        members = nodes.filter(F.col("label").isin(*labels))

    def picked(rows: DataFrame, category: Column) -> DataFrame:
        return rows.select(
            category.alias("category"), "node_id", "name", F.struct(*order).alias("pos")
        )

    sample = picked(examples_per_label(members, max_nodes, order), F.col("label"))
    if wanted is not None:
        whole = wanted.filter(F.col("label") == ALL)
        rows = first_nodes(nodes, max_nodes, order).withColumn("_all", F.lit(ALL))
        rows = rows.join(whole.select(F.col("label").alias("_all")), "_all", "left_semi")
        sample = sample.filter(F.col("category") != ALL).unionByName(
            picked(rows, F.col("_all"))
        )
    # A few labels' samples are read once; nothing bounds the number of labels.
    sample, _, held = measured(sample)
    texts = _sampled_texts(nodes, edges, sample, held, by, k, "full", edge_order)
    body = (
        texts.groupBy(F.col("category").alias("label"))
        .agg(
            ordered_lines(
                [F.col("pos")], F.concat(F.col("summary"), F.lit("\n" + RULE))
            ).alias("body")
        )
    )
    if wanted is not None:
        body = wanted.join(body, "label", "left")
    heading = F.when(F.col("label") == ALL, ALL_HEADING).otherwise(
        filled(LABEL_HEADING, F.col("label"))
    )
    return body.select("label", F.concat_ws("\n", heading, "body").alias("summary"))


def graph_summary_lines(
    nodes: DataFrame,
    edges: DataFrame,
    examples: int = 3,
    per_node: int = 2,
    node_order: Iterable[str] = NODE_ORDER,
    edge_order: Iterable[str] = EDGE_ORDER,
) -> DataFrame:
    """The whole-graph summary as rows ``(section, label, pos, rank, line)``.

    Section 0 counts the nodes of each label; section 1 shows the first
    outgoing edges of the first nodes of each label.
    """
    order = list(node_order)
    counts = label_histogram(nodes).select(
        F.lit(0).alias("section"),
        "label",
        F.lit(0).alias("pos"),
        F.lit(0).alias("rank"),
        F.concat(
            F.lit("- "),
            "label",
            F.lit(": "),
            F.col("node_count").cast("string"),
            F.lit(" nodes"),
        ).alias("line"),
    )
    picked = examples_per_label(nodes, examples, order).select(
        "node_id", "label", "name", F.col("rank").alias("pos")
    )
    picked, small, held = measured(picked)
    top = first_edges_per_node(edges, per_node, OUTGOING, held or picked, edge_order)
    far = nodes.select(
        F.col("node_id").alias("b"),
        F.col("label").alias("far_label"),
        F.col("name").alias("far_name"),
    )
    relations = (
        top.join(hinted(picked, small), F.col("a") == F.col("node_id"))
        .join(far, "b")
        .select(
            F.lit(1).alias("section"),
            "label",
            "pos",
            "rank",
            F.concat(
                F.lit("  "),
                shown(F.col("name")),
                F.lit(" ("),
                F.col("label"),
                F.lit(") → "),
                shown(F.col("far_name")),
                F.lit(" ("),
                shown(F.col("far_label")),
                F.lit(") via '"),
                shown(F.col("relation")),
                F.lit("'"),
            ).alias("line"),
        )
    )
    return counts.unionByName(relations)


def graph_summary_text(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """The whole-graph summary as one text, ``(summary)``.

    Its length grows with the number of labels only; see
    ``graph_summary_lines`` for the distributed form.
    """
    lines = graph_summary_lines(nodes, edges, **options)
    # A label's lines are put together by its own task; only the last step sees all labels.
    texts = lines.groupBy("section", "label").agg(
        ordered_lines([F.col("pos"), F.col("rank")], F.col("line")).alias("text")
    )

    def section(number: int) -> Column:
        here = F.when(F.col("section") == number, F.struct("label", "text"))
        ordered = F.array_sort(F.collect_list(here))
        return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")

    def block(body: Column) -> Column:
        return F.when(body != "", body)

    return texts.agg(section(0).alias("counts"), section(1).alias("relations")).select(
        F.concat_ws(
            "\n",
            F.lit(GRAPH_HEADING),
            block(F.col("counts")),
            F.lit(RELATIONS_HEADING),
            block(F.col("relations")),
        ).alias("summary")
    )


def sampled_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    strategy: str = "first",
    n: int = 15,
    node_order: Iterable[str] = NODE_ORDER,
) -> DataFrame:
    """At most n nodes: the first ones, or the most connected ones."""
    if strategy == "first":
        return first_nodes(nodes, n, node_order)
    if strategy == "most_connected":
        return most_connected(nodes, edges, n)
    raise ValueError(f"unknown strategy {strategy!r}")


def sample_context(
    nodes: DataFrame,
    edges: DataFrame,
    strategy: str = "first",
    n: int = 15,
    k: int = 5,
    by: str = "id",
    node_order: Iterable[str] = NODE_ORDER,
    edge_order: Iterable[str] = EDGE_ORDER,
) -> DataFrame:
    """One text, ``(context)``: compact summaries of n nodes, blank-line apart."""
    order = list(node_order)
    sample = sampled_nodes(nodes, edges, strategy, n, order).select(
        "node_id", "name", F.struct(*order).alias("pos")
    )
    sample, held = bounded(sample, n)
    rows = _sampled_texts(nodes, edges, sample, held, by, k, "compact", edge_order)
    return rows.agg(
        ordered_lines([F.col("pos")], F.col("summary"), "\n\n").alias("context")
    )

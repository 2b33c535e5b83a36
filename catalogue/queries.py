"""One query per operator over the driver tables, for checks and benches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.functions.columns import narrow_types, ordered_lines, to_native
from kgweave.functions.sizing import one_row
from kgweave.model import ALL, BOTH, INCOMING, OUTGOING, Graph
from kgweave.operators import chat, extract, joins, mentions, select, stats, topk
from kgweave.plans import prompts, summaries
from kgweave.sources import graphs, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def on_graph(read: Callable[[SparkSession, str], Graph]):
    """Register a query whose function takes a graph."""

    def register(build: Callable[[Graph], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(read(spark, sf_dir))
        return build

    return register


supply = on_graph(graphs.supply_graph)
activity = on_graph(graphs.activity_graph)
review = on_graph(graphs.review_graph)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kgweave-{spark.sparkContext.applicationId}/{name}"


def labelled(graph: Graph, *labels: str) -> DataFrame:
    return graph.nodes.filter(F.col("label").isin(*labels))


# --- tables and types -------------------------------------------------------


@supply
def kg_nodes(g):
    return tables.load_graph(*g).nodes


@supply
def kg_edges(g):
    return tables.load_graph(*g).edges


@query
def narrow_types_lineitem(spark, sf_dir):
    return narrow_types(table(spark, sf_dir, "lineitem"))


@review
def to_native_review(g):
    return to_native(g.nodes)


@query
def to_native_customer(spark, sf_dir):
    return to_native(table(spark, sf_dir, "customer"))


@query
def dedupe_nodes(spark, sf_dir):
    """Supplier rows as every line item states them, one kept per id."""
    stated = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 8 + 3).alias("node_id"),
        F.lit("Supplier").alias("label"),
        F.concat("l_linestatus", F.lit("/"), F.col("l_partkey").cast("string")).alias(
            "name"
        ),
    )
    return tables.dedupe_nodes(stated)


@supply
def export_vis(g):
    """Vertices and edges, written as JSON and read back."""
    spark = g.nodes.sparkSession
    path = shared_folder(spark, "export-vis")
    tables.export_vis(extract.category_graph(*g, "Nation", styled=True), path)
    edges = spark.read.schema("`from` string, `to` string, label string, title string").json(f"{path}/edges")
    vertices = spark.read.schema("id string, label string, `group` string, title string, color string, size int").json(f"{path}/vertices")
    return edges.unionByName(vertices, allowMissingColumns=True)


@activity
def snapshot(g):
    """Nodes and edges, written as parquet and read back."""
    kept = tables.snapshot(g, shared_folder(g.nodes.sparkSession, "snapshot"))
    return kept.edges.unionByName(kept.nodes, allowMissingColumns=True)


@supply
def read_tables(g):
    """Written as files and read through the readers, every column as it is."""
    path = shared_folder(g.nodes.sparkSession, "read-tables")
    tables.snapshot(g, path)
    spark = g.nodes.sparkSession
    nodes, edges = tables.read_nodes(spark, f"{path}/nodes"), tables.read_edges(spark, f"{path}/edges")
    return edges.unionByName(nodes, allowMissingColumns=True)


@supply
def snapshot_lookup(g):
    """Edges of the nations from tables ranged by the join keys, by the files that may hold them."""
    spark = g.nodes.sparkSession
    name = f"kg_{uuid.uuid4().hex[:12]}"
    tables.snapshot_tables(g, name, 16, shared_folder(spark, "snapshot-tables"))
    return tables.lookup_incident(spark, name, labelled(g, "Nation"))


@supply
def vis_vertices(g):
    return tables.vis_vertices(extract.category_graph(*g, "Nation", True).vertices)


# --- selection --------------------------------------------------------------


@review
def labels_raw(g):
    return select.list_labels(g.nodes, "raw")


@review
def labels_non_null(g):
    return select.list_labels(g.nodes, "non_null")


@review
def labels_clean(g):
    return select.list_labels(g.nodes, "clean")


@supply
def filter_label(g):
    return select.filter_label(g.nodes, "Customer")


@review
def filter_label_all(g):
    return select.filter_label(g.nodes, ALL)


@supply
def names_in_label(g):
    return select.list_names(g.nodes, "Part")


@supply
def names_by_label(g):
    return select.names_by_label(g.nodes)


@review
def names_by_label_unnamed(g):
    """Documents without a name, so that whole labels have none."""
    unnamed = F.when(F.col("name").startswith("doc"), F.lit(None)).otherwise(F.col("name"))
    return select.names_by_label(g.nodes.withColumn("name", unnamed))


@query
def find_node(spark, sf_dir):
    nodes = graphs.supply_nodes(spark, sf_dir)
    wanted = nodes.filter(F.col("label").isin("Part", "Supplier")).select("label", "name")
    return select.find_node(nodes, wanted)


@query
def find_by_name(spark, sf_dir):
    """Part names and part brands; no node is named like a brand."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.explode(F.array("p_name", "p_brand")).alias("name"))
    return select.find_node_by_name(graphs.supply_nodes(spark, sf_dir), names)


@query
def find_by_id(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") * 8 + 4).alias("node_id")
    )
    return select.find_node_by_id(graphs.supply_nodes(spark, sf_dir), sold)


@supply
def properties_of_label(g):
    return select.node_properties(g.nodes, labelled(g, "Part", "Supplier"))


@supply
def incident_edges_out(g):
    return select.incident_edges(g.edges, labelled(g, "Supplier"), OUTGOING)


@supply
def incident_edges_in(g):
    return select.incident_edges(g.edges, labelled(g, "Nation"), INCOMING)


@activity
def incident_edges_both(g):
    return select.incident_edges(g.edges, labelled(g, "BUILDING"), BOTH)


@review
def nonblank(g):
    return select.nonblank(
        g.nodes.select("node_id", F.col("label").alias("question"))
    )


@review
def vertex_columns(g):
    return select.vertex_columns(g.nodes)


@review
def vertex_columns_category(g):
    return select.vertex_columns(g.nodes, category_view=True)


# --- joins ------------------------------------------------------------------


@review
def join_target(g):
    return joins.join_target(g.edges, g.nodes)


@supply
def join_source(g):
    return joins.join_source(g.edges, g.nodes)


@review
def dangling_edges(g):
    return joins.dangling_edges(g.edges, g.nodes)


@supply
def touching(g):
    return joins.touching(g.edges, labelled(g, "Nation"))


@activity
def semi_ids(g):
    active = g.edges.select(F.col("source_node_id").alias("node_id"))
    return joins.semi_ids(g.nodes, active)


@activity
def seed_names(g):
    return joins.seed_names(g.edges, g.nodes)


# --- counts -----------------------------------------------------------------


@supply
def count_nodes(g):
    return stats.count_nodes(g.nodes)


@supply
def count_edges(g):
    return stats.count_edges(g.edges)


@review
def label_histogram(g):
    return stats.label_histogram(g.nodes)


@supply
def category_size(g):
    return stats.category_size(g.nodes)


@activity
def edge_count_by_direction(g):
    return stats.edge_counts(g.edges, g.nodes)


@activity
def edge_count_both(g):
    return stats.edge_count(g.edges, g.nodes, BOTH)


@activity
def edge_count_no_direction(g):
    return stats.edge_count(g.edges, g.nodes, None)


@supply
def category_connections(g):
    return stats.category_connections(*g)


@activity
def category_connections_one(g):
    return stats.category_connections(*g, "BUILDING")


@supply
def category_metrics(g):
    return stats.category_metrics(*g)


@review
def category_metrics_dangling(g):
    return stats.category_metrics(*g)


@supply
def category_metrics_absent(g):
    """Two labels of the graph and one that no node has."""
    return stats.category_metrics(*g, ["Nation", "Planet", "Region"])


@supply
def subgraph_size(g):
    return stats.subgraph_size(extract.category_graph(*g, "Nation").vertices)


@activity
def degrees(g):
    return stats.degrees(g.edges)


@supply
def two_sided_degree(g):
    return stats.two_sided_degree(g.edges)


@supply
def total_degree(g):
    return stats.total_degree(g.edges)


@supply
def distinct_names(g):
    return stats.distinct_names(g.nodes)


@supply
def distinct_terms(g):
    return stats.distinct_terms(g.nodes)


@activity
def category_metrics_one(g):
    return stats.category_metrics(*g, ["BUILDING"])


# --- extraction -------------------------------------------------------------


@activity
def both_directions(g):
    return joins.half_edges(g.edges, BOTH)


@activity
def merge_vertices(g):
    """Per customer the last event that touched it, and its largest source."""
    touches = joins.half_edges(g.edges, BOTH).select(
        F.col("b").alias("id"),
        "relation",
        F.col("phase").alias("side"),
        F.struct(F.col("a"), F.col("phase"), F.col("relation")).alias("rank"),
        "source",
    )
    return extract.merge_vertices(touches, ["rank"], ["source"])


@supply
def simple_digraph(g):
    return extract.simple_digraph(g.edges)


@activity
def ego_out(g):
    return extract.ego(*g, labelled(g, "BUILDING"), OUTGOING).edges


@activity
def ego_in(g):
    return extract.ego(*g, labelled(g, "BUILDING"), INCOMING).edges


@activity
def ego_both(g):
    return extract.ego(*g, labelled(g, "BUILDING"), BOTH).edges


@activity
def ego_repeated_ids(g):
    """Every node twice, the second time under a later name: loading keeps the first."""
    again = g.nodes.withColumn("name", F.concat(F.lit("~"), "name"))
    loaded = tables.load_graph(g.nodes.unionByName(again), g.edges)
    return extract.ego(*loaded, labelled(g, "BUILDING"), BOTH).edges


@activity
def ego_both_vertices(g):
    return extract.ego(*g, labelled(g, "BUILDING"), BOTH).vertices


@activity
def ego_both_reversed(g):
    return extract.ego(*g, labelled(g, "BUILDING"), BOTH, True).edges


@activity
def ego_every_node(g):
    """Every node a seed: the plan for seed sets too large to broadcast."""
    return extract.ego(*g, g.nodes, BOTH, small=False).edges


@activity
def ego_multi_edges(g):
    return extract.ego_multi(*g, labelled(g, "BUILDING")).edges


@activity
def ego_multi_vertices(g):
    return extract.ego_multi(*g, labelled(g, "BUILDING")).vertices


@supply
def category_graph_nodes(g):
    return extract.category_graph(*g, "Supplier").vertices


@supply
def category_graph_edges(g):
    return extract.category_graph(*g, "Supplier").edges


@activity
def category_graph_inside(g):
    """Edges inside the category: the later seed writes the title."""
    return extract.category_graph(*g, "BUILDING").edges


@activity
def category_graph_all(g):
    return extract.category_graph(*g, ALL).edges


@activity
def category_graph_styled(g):
    return extract.category_graph(*g, "BUILDING", styled=True).edges


@activity
def category_styles(g):
    return extract.category_graph(*g, "BUILDING", styled=True).vertices


@activity
def category_styles_all(g):
    return extract.category_graph(*g, ALL, styled=True).vertices


# --- first k ----------------------------------------------------------------


@supply
def first_nodes(g):
    return topk.first_nodes(g.nodes, 15)


@supply
def first_edges_per_node(g):
    return topk.first_edges_per_node(g.edges, 5)


@supply
def most_connected(g):
    return topk.most_connected(*g, 15)


@supply
def examples_per_label(g):
    return topk.examples_per_label(g.nodes, 3)


@supply
def category_sample(g):
    return topk.category_sample(g.nodes, "Part", 5)


@supply
def category_sample_all(g):
    return topk.category_sample(g.nodes, ALL, 5)


# --- summaries --------------------------------------------------------------


@supply
def text_lines(g):
    """The relations of each node's first edges, in order, on one line."""
    top = topk.first_edges_per_node(g.edges, 5, OUTGOING)
    lines = ordered_lines([F.col("rank")], F.col("relation"), ", ")
    return top.groupBy("a").agg(lines.alias("relations"))


@supply
def node_summary(g):
    return summaries.node_summary(*g, g.nodes)


@supply
def node_summary_repeated_ids(g):
    again = g.nodes.withColumn("name", F.concat(F.lit("~"), "name"))
    loaded = tables.load_graph(g.nodes.unionByName(again), g.edges)
    return summaries.node_summary(*loaded, loaded.nodes)


@supply
def node_summary_compact(g):
    return summaries.node_summary(*g, labelled(g, "Supplier"), 5, "compact")


@review
def node_summary_dangling(g):
    return summaries.node_summary(*g, g.nodes)


@query
def node_summary_by_name(spark, sf_dir):
    g = graphs.supply_graph(spark, sf_dir)
    part = table(spark, sf_dir, "part")
    names = part.select(F.explode(F.array("p_name", "p_brand")).alias("name"))
    return summaries.node_summary_by_name(*g, names)


@supply
def category_summary(g):
    return summaries.category_summary(*g)


@supply
def category_summary_by_name(g):
    return summaries.category_summary(*g, [ALL, "Part", "Planet"], by="name")


@supply
def graph_summary_lines(g):
    return summaries.graph_summary_lines(*g)


@supply
def graph_summary_text(g):
    return summaries.graph_summary_text(*g)


@supply
def sample_context_first(g):
    return summaries.sample_context(*g, "first")


@supply
def sample_context_connected(g):
    return summaries.sample_context(*g, "most_connected", by="name")


# --- conversations ----------------------------------------------------------


@query
def history_last5(spark, sf_dir):
    return chat.format_history(table(spark, sf_dir, "conversations"))


@query
def last_turns_8(spark, sf_dir):
    return chat.last_turns(table(spark, sf_dir, "conversations"), 8)


@query
def last_turns_5(spark, sf_dir):
    return chat.last_turns(table(spark, sf_dir, "conversations"), 5)


@query
def last_turns_all(spark, sf_dir):
    return chat.last_turns(table(spark, sf_dir, "conversations"), None)


@query
def append_turns(spark, sf_dir):
    """Every benchmark item asked in the conversation of its number."""
    new = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("conv_id"),
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("step"), F.lit("user").alias("role"), F.col("text")),
                F.struct(F.lit(2).alias("step"), F.lit("ai").alias("role"), F.lit("ok").alias("text")),
            )
        ),
    )
    return chat.append_turns(table(spark, sf_dir, "conversations"), new)


@query
def clear_history(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    return chat.clear_history(conv, conv.filter(F.col("role") == "system"))


@query
def previous_turns(spark, sf_dir):
    return chat.previous_turns(table(spark, sf_dir, "conversations"))


# --- prompts, requests, responses -------------------------------------------


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message of each conversation, asked while looking at the
    customer of the same number, at a category, or at nothing, as when there is
    no such customer."""
    conv = table(spark, sf_dir, "conversations")
    newest = conv.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question"),
        F.max("turn").alias("last"),
        F.max((F.col("role") == "system").cast("int")).alias("system"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("conv_id"), F.col("c_name")
    )
    view = (
        F.when(F.col("system") == 1, F.lit(None).cast("string"))
        .when(F.col("last") > 4, "category")
        .otherwise("node")
    )
    selected = F.when(view == "node", F.col("c_name")).when(
        view == "category", F.when(F.col("last") > 5, "Supplier").otherwise("Nation")
    )
    return select.nonblank(newest).join(customer, "conv_id", "left").select(
        F.col("conv_id").alias("question_id"),
        (F.col("conv_id") * 8 + 2).alias("seed_id"),
        "question",
        view.alias("view"),
        selected.alias("selected"),
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the history of their conversation."""
    history = chat.format_history(table(spark, sf_dir, "conversations"))
    return questions(spark, sf_dir).join(
        history.withColumnRenamed("conv_id", "question_id"), "question_id"
    )


@activity
def stats_context(g):
    return prompts.stats_context(*g, g.nodes)


@supply
def category_stats_context(g):
    return prompts.category_stats_context(*g)


@query
def context_for(spark, sf_dir):
    return prompts.context_for(
        questions(spark, sf_dir), *graphs.supply_graph(spark, sf_dir)
    )


@query
def prompts_stats(spark, sf_dir):
    g = graphs.supply_graph(spark, sf_dir)
    return prompts.build_prompt(prompts.stats_for(asked(spark, sf_dir), *g), "stats")


@query
def prompts_grounded(spark, sf_dir):
    g = graphs.supply_graph(spark, sf_dir)
    context = prompts.context_for(questions(spark, sf_dir), *g)
    facts = asked(spark, sf_dir).join(context, "question_id").select(
        "*",
        F.coalesce("view", F.lit("none")).alias("direction"),
        one_row(stats.count_nodes(g.nodes)).alias("total_nodes"),
        one_row(stats.count_edges(g.edges)).alias("total_edges"),
    )
    return prompts.build_prompt(facts, "grounded")


@query
def prompts_hybrid(spark, sf_dir):
    g = graphs.supply_graph(spark, sf_dir)
    asks = questions(spark, sf_dir)
    facts = asks.join(prompts.context_for(asks, *g), "question_id")
    return prompts.build_prompt(facts, "hybrid")


@query
def prompts_overview(spark, sf_dir):
    g = graphs.supply_graph(spark, sf_dir)
    facts = questions(spark, sf_dir).select(
        "*",
        one_row(summaries.graph_summary_text(*g)).alias("summary"),
        prompts.focus_line(F.col("view"), F.col("selected")).alias("focus"),
    )
    return prompts.build_prompt(facts, "overview")


def _sampled_prompts(spark, sf_dir, template):
    g = graphs.supply_graph(spark, sf_dir)
    facts = asked(spark, sf_dir).select(
        "*", one_row(summaries.sample_context(*g)).alias("context")
    )
    return prompts.build_prompt(facts, template)


@query
def prompts_plain(spark, sf_dir):
    return _sampled_prompts(spark, sf_dir, "plain")


@query
def prompts_examples(spark, sf_dir):
    return _sampled_prompts(spark, sf_dir, "examples")


@query
def prompts_strict(spark, sf_dir):
    return _sampled_prompts(spark, sf_dir, "strict")


def _payload(spark, sf_dir, preset):
    conv = table(spark, sf_dir, "conversations")
    texts = conv.select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("question_id"),
        F.col("text").alias("prompt"),
    )
    return prompts.request_payload(texts, preset)


@query
def request_payload_sampled(spark, sf_dir):
    return _payload(spark, sf_dir, "sampled")


@query
def request_payload_factual(spark, sf_dir):
    return _payload(spark, sf_dir, "factual")


@query
def request_payload_short(spark, sf_dir):
    return _payload(spark, sf_dir, "short")


@query
def request_payload_long(spark, sf_dir):
    return _payload(spark, sf_dir, "long")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message as a response; its turn decides the shape of the body."""
    text = F.col("text")
    generated = F.struct(text.alias("generated_text"))
    message = F.struct(F.struct(text.alias("content")).alias("message"))
    shapes = [
        F.to_json(F.array(generated)),
        F.to_json(generated),
        F.to_json(F.struct(F.array(message).alias("choices"))),
        F.to_json(F.struct(text.alias("z"))),
        F.lit("[]"),
        F.lit('[{"generated_text":""}]'),
        text,
    ]
    body = F.when(F.col("turn") == 0, shapes[0])
    for turn, shape in enumerate(shapes[1:], 1):
        body = body.when(F.col("turn") == turn, shape)
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("request_id"),
        F.when(F.col("turn") == 6, 503).otherwise(200).alias("status"),
        body.otherwise(F.to_json(F.array(generated))).alias("body"),
    )


@query
def parse_response_early(spark, sf_dir):
    return prompts.parse_response(responses(spark, sf_dir), "early")


@query
def parse_response_strict(spark, sf_dir):
    return prompts.parse_response(responses(spark, sf_dir), "strict")


@query
def parse_response_compact(spark, sf_dir):
    return prompts.parse_response(responses(spark, sf_dir), "compact")


# --- mentions and enrichment ------------------------------------------------


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per part naming it and its suppliers, and all messages."""
    part = table(spark, sf_dir, "part")
    lineitem = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier")
    sold = (
        lineitem.select("l_partkey", "l_suppkey")
        .distinct()
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_partkey")
        .agg(F.array_join(F.array_sort(F.collect_list("s_name")), ", ").alias("names"))
    )
    sentences = part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select(
        (F.col("p_partkey") * 2).alias("answer_id"),
        F.upper(
            F.concat(F.col("names"), F.lit(" ship the "), F.col("p_name"), F.lit("."))
        ).alias("answer"),
    )
    messages = table(spark, sf_dir, "conversations").select(
        ((F.col("conv_id") * 8 + F.col("turn")) * 2 + 1).alias("answer_id"),
        F.col("text").alias("answer"),
    )
    return sentences.unionByName(messages)


def _mentions(spark, sf_dir, mode):
    return mentions.mention_table(
        answers(spark, sf_dir),
        graphs.supply_nodes(spark, sf_dir),
        mode,
        "answer_id",
        "answer",
    )


@query
def mention_table(spark, sf_dir):
    return _mentions(spark, sf_dir, "terms")


@query
def mention_table_names(spark, sf_dir):
    return _mentions(spark, sf_dir, "names").select("answer_id", "name", "first_id")


@query
def mention_table_documents(spark, sf_dir):
    """Document texts against the graph of sources and languages: short names
    that are everywhere."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), "text"
    )
    nodes = graphs.review_graph(spark, sf_dir).nodes.withColumn(
        "node_id", F.xxhash64("node_id")
    )
    found = mentions.mention_table(documents, nodes)
    return found.select("text_id", "name", "label")


@query
def enrich_answers(spark, sf_dir):
    return prompts.enrich_answers(
        answers(spark, sf_dir), graphs.supply_nodes(spark, sf_dir)
    )


@query
def enrich_answers_names(spark, sf_dir):
    return prompts.enrich_answers(
        answers(spark, sf_dir), graphs.supply_nodes(spark, sf_dir), "names"
    )

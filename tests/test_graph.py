"""Hand graph: parallel and mutual edges, a self-loop, dangling ends, repeated
and missing names, blank labels, an isolated node."""

import pytest
from pyspark.sql import functions as F

from kgweave.operators import extract, joins, select, stats, topk

PERSONS = [1, 2, 3, 8]


def test_labels(nodes):
    def listed(mode):
        return [r["label"] for r in select.list_labels(nodes, mode).collect()]

    assert listed("clean") == ["Company", "Language", "Person"]
    assert listed("non_null") == [" ", "Company", "Language", "Person", "nan"]
    assert listed("raw") == [None, " ", "Company", "Language", "Person", "nan"]


def test_filters_and_names(nodes, rows):
    assert select.filter_label(nodes, "All").count() == 12
    assert rows(select.filter_label(nodes, "Language"), "node_id") == [(7,), (9,)]
    assert rows(select.list_names(nodes, "Language")) == [("Java",)]
    assert ("Person", 4, "Dot") in rows(select.names_by_label(nodes))
    # A null name counts as a row of its label but is not a name.
    assert ("Language", 2, "Java") in rows(select.names_by_label(nodes))


@pytest.mark.parametrize("small", [True, False, None])
def test_find_by_name(spark, nodes, rows, small):
    names = spark.createDataFrame([("Ann",), ("Zoe",)], "name string")
    found = select.find_node_by_name(nodes, names, small=small)
    assert rows(found, "name", "node_id", "found") == [
        ("Ann", 1, True),
        ("Zoe", None, False),
    ]
    pairs = spark.createDataFrame([("Company", "Ann"), ("Person", "Zoe")], "label string, name string")
    assert rows(select.find_node(nodes, pairs, small=small), "node_id") == [(6,)]


def test_find_by_id_and_properties(nodes, rows):
    assert rows(select.find_node_by_id(nodes, [3, 77]), "name") == [("Cy",)]
    assert rows(select.node_properties(nodes, [1, 2, 3])) == [
        (1, '{"age":"30"}'),
        (2, "{}"),
        (3, "{}"),
    ]
    bare = nodes.drop("properties")
    assert rows(select.node_properties(bare, [1])) == [(1, "{}")]


def test_nonblank(spark, rows):
    asked = spark.createDataFrame(
        [(1, "why"), (2, " \t\n"), (3, ""), (4, None), (5, "　")], "id int, question string"
    )
    assert rows(select.nonblank(asked), "id") == [(1,)]


def test_joins(nodes, edges, rows):
    assert joins.join_target(edges, nodes).count() == 13
    assert joins.join_source(edges, nodes).count() == 13
    assert rows(joins.dangling_edges(edges, nodes)) == [
        (3, 99, "uses", "target"),
        (98, 3, "ghost", "source"),
    ]
    assert joins.seed_names(edges, nodes).filter("seed_name = 'Ann'").count() == 4


@pytest.mark.parametrize("small", [True, False, None])
def test_touching(nodes, edges, small):
    persons = nodes.filter("label = 'Person'")
    assert joins.touching(edges, persons, small).count() == 11
    assert select.incident_edges(edges, persons, "Outgoing", small).count() == 8
    assert select.incident_edges(edges, persons, "Incoming", small).count() == 6


def test_degrees(edges, rows):
    two = dict(rows(stats.two_sided_degree(edges)))
    assert {k: v for k, v in two.items() if v} == {1: 6, 2: 5, 4: 5, 3: 3, 5: 2}
    assert {k for k, v in two.items() if v is None} == {6, 7, 9, 10, 98, 99}
    total = dict(rows(stats.total_degree(edges)))
    assert total[7] == 2 and total[98] == 1


@pytest.mark.parametrize("small", [True, False, None])
def test_edge_counts(nodes, edges, rows, small):
    counted = rows(stats.edge_counts(edges, nodes.filter("label = 'Person'"), small))
    assert counted == [(1, 3, 3, 6), (2, 3, 2, 4), (3, 2, 1, 3), (8, 0, 0, 0)]
    assert rows(stats.edge_count(edges, [2], "Both")) == [(2, 4)]
    assert rows(stats.edge_count(edges, [2], "Incoming")) == [(2, 2)]
    assert rows(stats.edge_count(edges, [2], "Outgoing")) == [(2, 3)]
    assert rows(stats.edge_count(edges, [2], None)) == [(2, 0)]


def test_category_metrics(nodes, edges, rows):
    metrics = {r[0]: r[1:] for r in rows(stats.category_metrics(nodes, edges))}
    assert metrics["Person"] == (4, 11, 8)
    assert metrics["Company"] == (3, 7, 7)
    assert metrics["Language"] == (2, 3, 5)
    assert rows(stats.category_connections(nodes, edges, "Person")) == [("Person", 11)]


def test_simple_digraph(edges, rows):
    simple = rows(extract.simple_digraph(edges))
    assert len(simple) == 13
    assert (1, 4, "works_at") in simple


def test_simple_digraph_keeps_attributes(spark, rows):
    edges = spark.createDataFrame(
        [(1, 2, "b", 1, "x"), (1, 2, "a", 2, "y")],
        "source_node_id int, target_node_id int, relation_type string, at int, note string",
    )
    assert rows(extract.simple_digraph(edges, ["at"])) == [(1, 2, "a", 2, "y")]
    assert rows(extract.simple_digraph(edges)) == [(1, 2, "b", 1, "x")]


EGO = {
    (1, "Outgoing"): ({1, 2, 4}, {(1, 2, "knows"), (1, 4, "works_at")}),
    (1, "Incoming"): (
        {1, 2, 4, 10},
        {(2, 1, "knows"), (4, 1, "employs"), (10, 1, "sees")},
    ),
    (2, "Both"): (
        {1, 2, 5},
        {(1, 2, "knows"), (2, 1, "knows"), (2, 2, "likes"), (2, 5, "works_at")},
    ),
    (3, "Both"): ({3, 7}, {(3, 7, "uses")}),
    (8, "Both"): ({8}, set()),
}


@pytest.mark.parametrize("small", [True, False, None])
@pytest.mark.parametrize("seed, direction", EGO)
def test_ego(nodes, edges, seed, direction, small):
    seeds = nodes.filter(F.col("node_id") == seed)
    graph = extract.ego(nodes, edges, seeds, direction, small=small)
    vertices, wanted = EGO[seed, direction]
    assert sorted(r["id"] for r in graph.vertices.collect()) == sorted(vertices)
    found = [(r["source"], r["target"], r["label"]) for r in graph.edges.collect()]
    assert sorted(found) == sorted(wanted)


@pytest.mark.parametrize("small", [True, False, None])
def test_ego_reversed(nodes, edges, rows, small):
    seeds = nodes.filter("node_id = 1")
    graph = extract.ego(nodes, edges, seeds, "Both", True, small=small)
    assert rows(graph.edges, "source", "target", "label", "title") == [
        (1, 10, "sees", "Nil"),
        (1, 2, "knows", "Bob"),
        (1, 4, "employs", "Acme"),
    ]


def test_ego_of_unknown_seed_is_empty(nodes, edges):
    graph = extract.ego(nodes, edges, [98, 99])
    assert graph.vertices.count() == graph.edges.count() == 0


@pytest.mark.parametrize("small", [True, False, None])
def test_ego_multi(nodes, edges, rows, small):
    graph = extract.ego_multi(nodes, edges, nodes.filter("label = 'Person'"), small=small)
    ids = [r["id"] for r in graph.vertices.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 7, 8, 10]
    assert rows(graph.edges) == [
        (1, 2, "knows"),
        (1, 4, "works_at"),
        (10, 1, "sees"),
        (2, 1, "knows"),
        (2, 2, "likes"),
        (2, 5, "works_at"),
        (3, 7, "uses"),
        (4, 1, "employs"),
    ]


@pytest.mark.parametrize("small", [True, False, None])
def test_category_styles(nodes, edges, small):
    graph = extract.category_graph(nodes, edges, "Person", styled=True, small=small)
    style = {r["id"]: (r["color"], r["size"]) for r in graph.vertices.collect()}
    assert style == {
        1: ("#FFB6C1", 40),
        2: ("#FFB6C1", 40),
        3: ("#FF6B6B", 40),
        8: ("#FF6B6B", 40),
        5: ("#ADD8E6", None),
        7: ("#ADD8E6", None),
        4: ("#90EE90", None),
        10: ("#90EE90", None),
    }
    titles = {(r["source"], r["target"]): r["title"] for r in graph.edges.collect()}
    assert titles[4, 1] == "employs: Acme → Ann"
    assert titles[1, 2] == "knows: Ann → Bob"


def test_category_titles_name_the_later_writer(nodes, edges):
    graph = extract.category_graph(nodes, edges, "Person")
    titles = {(r["source"], r["target"]): r["title"] for r in graph.edges.collect()}
    # 2 is the later seed: it wrote both edges between 1 and 2, naming 1.
    assert titles[1, 2] == titles[2, 1] == "Ann"
    assert titles[3, 7] == "Java"
    # Seeds in order of their properties: null (2, 8) first, then 1, then 3.
    other = extract.category_graph(
        nodes, edges, "Person", node_order=["properties", "node_id"]
    )
    titles = {(r["source"], r["target"]): r["title"] for r in other.edges.collect()}
    assert titles[1, 2] == titles[2, 1] == "Bob"


def test_category_all_is_the_whole_graph(nodes, edges):
    graph = extract.category_graph(nodes, edges, "All", styled=True)
    assert graph.vertices.count() == 12
    assert graph.edges.count() == 11
    colors = {r["id"]: r["color"] for r in graph.vertices.collect()}
    assert colors[8] == "#FF6B6B" and "#FFB6C1" not in colors.values()


def test_subgraph_size(nodes, edges, rows):
    graph = extract.category_graph(nodes, edges, "Person")
    assert rows(stats.subgraph_size(graph.vertices)) == [(8,)]


@pytest.mark.parametrize("small", [True, False, None])
def test_first_edges_cut_before_lookup(nodes, edges, rows, small):
    seeds = nodes.filter("node_id IN (1, 3)")
    cut = topk.first_edges_per_node(edges, 2, "Both", seeds, small=small)
    assert rows(cut, "a", "phase", "source", "target", "relation") == [
        (1, 0, 1, 2, "knows"),
        (1, 0, 1, 4, "founded"),
        (1, 1, 2, 1, "knows"),
        (1, 1, 4, 1, "employs"),
        (3, 0, 3, 7, "uses"),
        (3, 0, 3, 99, "uses"),
        (3, 1, 98, 3, "ghost"),
    ]


def test_first_nodes_and_samples(nodes, edges, rows):
    assert rows(topk.first_nodes(nodes, 2), "node_id") == [(1,), (2,)]
    assert rows(topk.most_connected(nodes, edges, 3), "node_id") == [(1,), (2,), (4,)]
    assert rows(topk.examples_per_label(nodes, 1), "node_id") == [
        (1,),
        (11,),
        (12,),
        (4,),
        (7,),
    ]
    assert rows(topk.category_sample(nodes, "Company", 2), "node_id") == [(4,), (5,)]
    assert rows(topk.category_sample(nodes, "All", 1), "node_id") == [(1,)]


def test_most_connected_may_lack_a_node(nodes, edges):
    # All eleven ids with edges, two of which are no nodes.
    assert topk.most_connected(nodes, edges, 11).count() == 9


def test_direction_is_checked(nodes, edges):
    with pytest.raises(ValueError, match="direction"):
        extract.ego(nodes, edges, [1], "Sideways")


def test_text_ids_are_quoted(spark, rows):
    names = ["it's", 'a "b"', "back\\slash", "new\nline"]
    nodes = spark.createDataFrame(
        [(n, "L", n) for n in names], "node_id string, label string, name string"
    )
    edges = spark.createDataFrame(
        [(a, b, "to") for a, b in zip(names, names[1:])],
        "source_node_id string, target_node_id string, relation_type string",
    )
    assert joins.touching(edges, names).count() == 3
    for name in names:
        graph = extract.ego(nodes, edges, nodes.filter(F.col("name") == name))
        found = {r["id"] for r in graph.vertices.collect()}
        i = names.index(name)
        assert found == set(names[max(i - 1, 0) : i + 2])

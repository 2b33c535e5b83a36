"""Random graphs against plain Python, and invariances."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgweave.operators import extract, stats, topk
from kgweave.plans import summaries

few = settings(
    max_examples=6,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
edge_lists = st.lists(
    st.tuples(st.integers(0, 6), st.integers(0, 6), st.sampled_from("abc")), max_size=25
)
SCHEMA = "source_node_id bigint, target_node_id bigint, relation_type string"


def graph(spark, triples):
    nodes = spark.range(5).select(
        F.col("id").alias("node_id"),
        F.when(F.col("id") < 3, "Low").otherwise("High").alias("label"),
        F.concat(F.lit("n"), "id").alias("name"),
    )
    return nodes, spark.createDataFrame(triples, SCHEMA)


@few
@given(edge_lists)
def test_edge_counts(spark, triples):
    nodes, edges = graph(spark, triples)
    for row in stats.edge_counts(edges, nodes).collect():
        i = row["seed_id"]
        assert row["outgoing"] == sum(u == i for u, _, _ in triples)
        assert row["incoming"] == sum(v == i for _, v, _ in triples)
        assert row["both"] == sum(i in (u, v) for u, v, _ in triples)
    out = stats.degrees(edges).agg(F.sum("out_degree")).first()[0]
    assert (out or 0) == len(triples)


@few
@given(edge_lists, st.booleans())
def test_ego(spark, triples, small):
    nodes, edges = graph(spark, triples)
    both, out, into = (
        {
            (r["seed_id"], r["source"], r["target"]): r["label"]
            for r in extract.ego(nodes, edges, nodes, d, small=small).edges.collect()
        }
        for d in ("Both", "Outgoing", "Incoming")
    )
    assert both == out | into
    last = {}
    for u, v, r in sorted(triples):
        if u < 5 and v < 5:
            last[u, v] = r
    assert both == {(i, *e): r for e, r in last.items() for i in set(e)}


@few
@given(edge_lists, st.booleans())
def test_category_graph(spark, triples, small):
    """Replays the writes one by one: seeds in order, outgoing before incoming."""
    nodes, edges = graph(spark, triples)
    edge_title, color = {}, {i: "#FF6B6B" for i in range(3)}
    for seed in range(3):
        for phase, end in ((0, 1), (1, 0)):
            for triple in sorted(t for t in triples if t[phase] == seed):
                other = triple[end]
                if other >= 5:
                    continue
                inside = other < 3
                color[other] = "#FFB6C1" if inside else ("#ADD8E6", "#90EE90")[phase]
                u, v, r = triple
                edge_title[u, v] = (r, f"{r}: n{u} → n{v}")
    found = extract.category_graph(nodes, edges, "Low", styled=True, small=small)
    assert color == {r["id"]: r["color"] for r in found.vertices.collect()}
    assert edge_title == {
        (r["source"], r["target"]): (r["label"], r["title"]) for r in found.edges.collect()
    }


@few
@given(edge_lists)
def test_partitioning_does_not_matter(spark, triples):
    nodes, edges = graph(spark, triples)
    spread = edges.repartition(5), nodes.repartition(3)

    def results(n, e):
        yield sorted(map(tuple, summaries.node_summary(n, e, n, 2).collect()))
        yield sorted(map(tuple, topk.most_connected_ids(e, 3).collect()), key=repr)
        yield sorted(map(tuple, stats.category_metrics(n, e).collect()))

    assert list(results(nodes, edges)) == list(results(spread[1], spread[0]))

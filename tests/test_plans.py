"""What the plans look like, and that hubs are split."""

import re

import pytest
from pyspark.sql import functions as F

from kgweave.functions import sizing
from kgweave.operators import extract, joins, mentions, select, stats, topk
from kgweave.plans import prompts, summaries


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(nodes, edges):
    seeds = nodes.filter("label = 'Person'")
    texts = nodes.select(F.col("node_id").alias("text_id"), F.col("name").alias("text"))
    for small in (True, False):
        yield extract.ego(nodes, edges, seeds, small=small).edges
        yield extract.ego(nodes, edges, seeds, small=small).vertices
        yield extract.ego(nodes, edges, seeds, "Both", True, small=small).edges
        yield extract.ego_multi(nodes, edges, seeds, small=small).edges
        yield extract.ego_multi(nodes, edges, seeds, small=small).vertices
        yield extract.category_graph(nodes, edges, "Person", True, small=small).edges
        yield extract.category_graph(nodes, edges, "Person", True, small=small).vertices
        yield joins.touching(edges, seeds, small)
        yield topk.first_edges_per_node(edges, 3, seeds=seeds, small=small)
        yield summaries.node_summary(nodes, edges, seeds, small=small)
        yield stats.edge_counts(edges, seeds, small)
        yield select.find_node_by_name(nodes, nodes.select("name"), small=small)
    yield stats.category_metrics(nodes, edges)
    yield joins.dangling_edges(edges, nodes)
    yield summaries.graph_summary_lines(nodes, edges)
    yield mentions.mention_table(texts, nodes)
    yield prompts.stats_context(nodes, edges, seeds)


def test_no_pairwise_joins(nodes, edges):
    for df in operators(nodes, edges):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


def test_cuts_come_before_the_shuffle(nodes, edges):
    for df in (
        topk.first_edges_per_node(edges, 3),
        topk.examples_per_label(nodes, 3),
    ):
        plan = plan_of(df)
        assert re.search(r"WindowGroupLimit .*Partial", plan)
        assert re.search(r"WindowGroupLimit .*Final", plan)
    assert "TakeOrderedAndProject" in plan_of(topk.first_nodes(nodes, 3))


def test_only_small_sets_are_broadcast(spark, nodes, edges, monkeypatch):
    """With automatic broadcast off, what is left is what we asked for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(sizing, "PUSHED_IDS", 1)
    try:
        seeds = nodes.filter("label = 'Person'")
        assert "BroadcastHashJoin" in plan_of(joins.touching(edges, seeds))
        monkeypatch.setattr(sizing, "SMALL_ROWS", 3)
        assert "Broadcast" not in plan_of(joins.touching(edges, seeds))
        assert "Broadcast" not in plan_of(extract.ego(nodes, edges, seeds).edges)
        monkeypatch.setattr(sizing, "SMALL_ROWS", 100)
        monkeypatch.setattr(sizing, "SMALL_BYTES", 3)
        names = nodes.select("name")
        assert "Broadcast" not in plan_of(select.find_node_by_name(nodes, names))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tiny_sets_reach_the_scan(spark, nodes, edges, tmp_path):
    edges.write.parquet(f"{tmp_path}/e")
    stored = spark.read.parquet(f"{tmp_path}/e")
    found = joins.touching(stored, nodes.filter("name = 'Bob'"))
    scan = plan_of(found)
    assert "Or(In(source_node_id, [2])" in scan or "EqualTo(source_node_id,2)" in scan
    assert found.count() == 4


def test_properties_are_read_only_when_shown(spark, nodes, edges, tmp_path):
    nodes.write.parquet(f"{tmp_path}/n")
    stored = spark.read.parquet(f"{tmp_path}/n")
    graph = extract.ego(stored, edges, [1])
    assert "properties#" not in plan_of(graph.edges)
    assert "properties#" not in plan_of(graph.vertices)
    assert "properties#" in plan_of(summaries.node_summary(stored, edges, [1]))


@pytest.fixture(scope="module")
def hub(spark):
    """A third of the edges leave one node, a third enter another; a third of
    the nodes share a label and a name."""
    ids = spark.range(0, 120_000, 1, 8)
    edges = ids.select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9973).cast("bigint").alias("source_node_id"),
        F.when(F.col("id") % 3 == 1, 1).otherwise(F.col("id") * 7 % 9973).cast("bigint").alias("target_node_id"),
        F.concat(F.lit("r"), F.col("id") % 5).alias("relation_type"),
    )
    shared = F.col("id") % 3 == 0
    nodes = spark.range(0, 9973, 1, 4).select(
        F.col("id").alias("node_id"),
        F.when(shared, "Hot").otherwise(F.concat(F.lit("L"), F.col("id") % 50)).alias("label"),
        F.when(shared, "same").otherwise(F.concat(F.lit("name "), F.col("id"))).alias("name"),
    )
    return nodes, edges


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "48k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


def test_hubs_are_split(spark, hub):
    nodes, edges = hub
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        for df in (
            joins.join_target(edges, nodes),
            joins.join_source(edges, nodes),
            joins.touching(edges, nodes, small=False),
            stats.category_metrics(nodes, edges),
            extract.category_graph(nodes, edges, "Hot", small=False).vertices,
        ):
            df.toArrow()
            assert "skew=true" in plan_of(df), plan_of(df)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_names_are_split(spark, hub):
    """A third of all texts mention one name: its pairs are dealt over several tasks."""
    nodes, _ = hub
    answers = spark.range(0, 30_000, 1, 8).select(
        F.col("id").alias("answer_id"),
        F.when(F.col("id") % 3 == 0, "the SAME").when(F.col("id") % 3 == 1, "nothing").otherwise(F.concat(F.lit("a name "), F.col("id") % 90)).alias("answer"),
    )
    before = {key: spark.conf.get(key, None) for key in SKEW}
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        enriched = prompts.enrich_answers(answers, nodes)
        hot = enriched.filter(F.contains("answer", F.lit("• **same**"))).count()
        assert hot == 10_000
        enriched.toArrow()
        assert "skew=true" in plan_of(enriched), plan_of(enriched)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_category_edges_are_met_once(nodes, edges):
    """Each end is looked up once, and nothing is grouped after the lookups."""
    for df in (
        extract.category_graph(nodes, edges, "Person", small=False).edges,
        extract.ego_multi(nodes, edges, nodes.filter("label = 'Person'"), small=False).edges,
    ):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("Aggregate")]
        assert plan.count("Aggregate") - plan.count("Aggregate [seed_id") <= 1, plan
        assert above.count("Join") == 2, plan


def test_large_seed_sets_cut_edges_before_the_shuffle(spark, monkeypatch):
    """Beyond what is broadcast, a bitmap of the seeds keeps few other edges."""
    monkeypatch.setattr(sizing, "PUSHED_IDS", 10)
    monkeypatch.setattr(sizing, "SMALL_ROWS", 100)
    edges = spark.range(60_000).select(
        F.col("id").alias("source_node_id"), (F.col("id") * 7 % 60_000).alias("target_node_id"), F.lit("r").alias("relation_type")
    )
    for every in (20, 5):
        ids = spark.range(0, 60_000, every).withColumnRenamed("id", "node_id")
        seeds = sizing.as_seeds(spark, ids)
        assert not seeds.small and seeds.rows == 60_000 // every
        sifted = seeds.restrict(edges, "source_node_id", "target_node_id")
        wanted = edges.filter(f"source_node_id % {every} = 0 OR target_node_id % {every} = 0")
        assert wanted.exceptAll(sifted).count() == 0
        assert sifted.count() - wanted.count() < (60_000 - wanted.count()) / 5
        found = joins.touching(edges, ids)
        assert found.count() == wanted.count() and found.exceptAll(wanted).count() == 0
        counts = stats.edge_counts(edges, ids).agg(F.sum("outgoing"), F.sum("incoming")).first()
        assert tuple(counts) == (60_000 // every, 60_000 // every)


def test_a_bitmap_stays_with_the_edges_and_in_order(spark, monkeypatch):
    """The tables that meet the seeds by their ids do not get the bitmap too."""
    monkeypatch.setattr(sizing, "PUSHED_IDS", 10)
    monkeypatch.setattr(sizing, "SMALL_ROWS", 100)
    nodes = spark.range(3000).selectExpr("id AS node_id", "'L' AS label", "concat('n', id) AS name")
    edges = spark.range(3000).selectExpr("id AS source_node_id", "id * 7 % 3000 AS target_node_id", "'r' AS relation_type")
    texts = summaries.node_summary(nodes, edges, nodes)
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery") == 1
    assert texts.count() == 3000
    places = [0, 63, 64, 65_535, 65_536, 200_000, 262_143]
    slots = spark.createDataFrame([(p,) for p in places], "slot bigint")
    words = sizing.bit_words(slots, 1 << 18).first()["words"]
    assert [i * 64 + b for i, w in enumerate(words) for b in range(64) if w >> b & 1] == places


def test_a_large_sample_stays_in_the_plan(spark, hub):
    nodes, edges = hub
    few, many = (topk.most_connected(nodes, edges, n) for n in (50, 3000))
    assert "Limit" not in plan_of(few) and "Limit" in plan_of(many) or "TakeOrdered" in plan_of(many)
    assert few.exceptAll(many).count() == 0
    ranked = topk.most_connected_ids(edges, 3000)
    assert many.count() == nodes.join(ranked, "node_id").count()
    text = summaries.sample_context(nodes, edges, "most_connected", 2000).first()["context"]
    assert text.count("Node: ") == topk.most_connected(nodes, edges, 2000).count()


def test_large_and_small_plans_agree_on_hubs(hub):
    nodes, edges = hub
    seeds = nodes.filter("node_id < 2000")

    def same(build):
        small, large = (build(flag) for flag in (True, False))
        assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0

    same(lambda flag: extract.ego(nodes, edges, seeds, small=flag).edges)
    same(lambda flag: extract.ego(nodes, edges, seeds, small=flag).vertices)
    same(lambda flag: topk.first_edges_per_node(edges, 10, seeds=seeds, small=flag))
    same(lambda flag: stats.edge_counts(edges, seeds, flag))
    same(lambda flag: extract.category_graph(nodes, edges, "Hot", True, small=flag).edges)
    same(lambda flag: joins.touching(edges, seeds, flag))

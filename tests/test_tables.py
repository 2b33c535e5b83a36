import json
import os

import pytest
from conftest import NODES
from pyspark.sql import functions as F

from kgweave.functions.columns import narrow_types, to_native
from kgweave.model import Graph
from kgweave.operators import extract, joins
from kgweave.sources import tables


def test_narrow_types(spark):
    df = spark.range(1).select(
        F.lit(7).cast("bigint").alias("a"),
        F.lit(16777217.0).alias("b"),
        F.lit("x").alias("c"),
        F.lit(None).cast("bigint").alias("d"),
    )
    narrow = narrow_types(df)
    assert [t for _, t in narrow.dtypes] == ["int", "float", "string", "int"]
    assert tuple(narrow.first()) == (7, 16777216.0, "x", None)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_narrowing_never_wraps(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.range(1).select(F.lit(2**31).cast("bigint").alias("a"))
        with pytest.raises(Exception, match="exceeds 32 bits"):
            narrow_types(df).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_to_native(spark):
    df = spark.range(1).select(
        F.lit(5).alias("a"),
        F.lit(float("nan")).alias("b"),
        F.lit(None).cast("string").alias("c"),
        F.lit(2.5).alias("d"),
    )
    assert tuple(to_native(df).first()) == ("5", "", "", "2.5")
    assert tuple(to_native(df, "a").first())[0] == "5"


def test_required_columns(nodes, edges):
    with pytest.raises(ValueError, match="relation_type"):
        tables.load_graph(nodes, edges.drop("relation_type"))
    graph = tables.load_graph(nodes.withColumn("extra", F.lit(1)), edges, narrow=True)
    assert dict(graph.nodes.dtypes)["node_id"] == "int"
    assert "extra" in graph.nodes.columns


def test_read_files_and_tables(spark, nodes, edges, tmp_path):
    nodes.write.parquet(f"{tmp_path}/n")
    edges.write.json(f"{tmp_path}/e")
    assert tables.read_nodes(spark, f"{tmp_path}/n").count() == 12
    assert tables.read_edges(spark, f"{tmp_path}/e", "json").count() == 14
    nodes.createOrReplaceTempView("some_nodes")
    assert tables.read_nodes(spark, "some_nodes", "table").count() == 12
    with pytest.raises(ValueError, match="required columns"):
        tables.read_edges(spark, f"{tmp_path}/n")


def test_jdbc_scan_is_split():
    options = tables.jdbc_options("jdbc:x", "node_id", 0, 1000, 64, user="u")
    assert options["partitionColumn"] == "node_id"
    assert options["numPartitions"] == "64" and options["user"] == "u"


def test_dedupe(spark, rows):
    df = spark.createDataFrame(
        [(1, "B", "b"), (1, "A", "z"), (2, "C", "c")], "node_id int, label string, name string"
    )
    assert rows(tables.dedupe_nodes(df)) == [(1, "A", "z"), (2, "C", "c")]
    assert rows(tables.dedupe_nodes(df, ["name"])) == [(1, "B", "b"), (2, "C", "c")]


def test_snapshot(nodes, edges, tmp_path):
    kept = tables.snapshot(Graph(nodes, edges))
    assert kept.nodes.storageLevel.useMemory
    kept.nodes.unpersist(), kept.edges.unpersist()
    stored = tables.snapshot(Graph(nodes, edges), str(tmp_path))
    assert stored.edges.count() == 14


def test_a_hub_spreads_over_the_files_of_a_table(spark):
    edges = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("source_node_id"),
        (F.col("id") * 31 % 9001).alias("target_node_id"),
        F.lit("r").alias("relation_type"),
    )
    nodes = spark.createDataFrame(NODES, "node_id bigint, label string, name string, properties string")
    tables.snapshot_tables(Graph(nodes, edges), "kg", 9)
    by_source = spark.table("kg_edges_by_source")
    assert by_source.count() == 9000
    sizes = by_source.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes < 2 * 9000 / 9


def test_lookups_open_few_files(spark, tmp_path):
    edges = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("source_node_id"),
        (F.col("id") * 31 % 9001).alias("target_node_id"),
        F.lit("r").alias("relation_type"),
    )
    nodes = spark.createDataFrame(NODES, "node_id bigint, label string, name string, properties string")
    tables.snapshot_tables(Graph(nodes, edges), "ranged", 9, str(tmp_path))
    for seeds in ([100], [100, 8000], [7], [-5], []):
        found = tables.lookup(spark, "ranged", "edges_by_source", seeds)
        assert found.exceptAll(edges.filter(F.col("source_node_id").isin(seeds))).count() == 0
        assert found.count() == edges.filter(F.col("source_node_id").isin(seeds)).count()
        if seeds and seeds[0] == 100:
            # A seed lies in one range, or in two if it is a border.
            assert len(found.inputFiles()) <= 2 * len(seeds) < 9
    seeds = spark.createDataFrame([(7,), (31,), (8000,)], "node_id bigint")
    both = tables.lookup_incident(spark, "ranged", seeds)
    want = edges.filter("source_node_id IN (7, 31, 8000) OR target_node_id IN (7, 31, 8000)")
    assert both.exceptAll(want).count() == want.exceptAll(both).count() == 0
    many = spark.range(0, 4000, 2).withColumnRenamed("id", "node_id")
    large = tables.lookup(spark, "ranged", "edges_by_target", many)
    assert large.count() == edges.filter("target_node_id < 4000 AND target_node_id % 2 = 0").count()


def test_dedupe_does_not_depend_on_input_order(spark):
    rows = [(1, "A", "a", p) for p in ("x", "y", "z", None)]
    made = lambda order: tables.dedupe_nodes(
        spark.createDataFrame(order, "node_id bigint, label string, name string, properties string").coalesce(1)
    ).collect()
    assert made(rows) == made(rows[::-1])


def test_export(nodes, edges, tmp_path):
    graph = extract.category_graph(nodes, edges, "Person", styled=True)
    tables.export_vis(graph, str(tmp_path))

    def records(part):
        folder = f"{tmp_path}/{part}"
        files = [f for f in os.listdir(folder) if f.endswith(".json")]
        lines = [line for f in files for line in open(f"{folder}/{f}", encoding="utf-8")]
        return [json.loads(line) for line in lines]

    vertices = {r["id"]: r for r in records("vertices")}
    assert vertices["1"] == {
        "id": "1",
        "label": "Person",
        "group": "Person",
        "title": "Ann (Person)",
        "color": "#FFB6C1",
        "size": 40,
    }
    assert len(records("edges")) == 8
    assert {"from", "to", "label", "title"} == set(records("edges")[0])
    plain = extract.ego_multi(nodes, edges, [1])
    tables.export_vis(plain, f"{tmp_path}/plain", "parquet")

"""Seed sets of every id type on every path, and results that must not lose rows."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from kgweave.functions.sizing import is_small
from kgweave.operators import extract, joins, select, stats
from kgweave.operators.mentions import mention_table

IDS = {
    "date": [datetime.date(2020, 1, d) for d in (1, 2, 3)],
    "timestamp": [datetime.datetime(2020, 1, 1, 2, 3, s, 456) for s in (1, 2, 3)],
    "timestamp_ntz": [datetime.datetime(2020, 1, 1, 2, 3, s, 456) for s in (1, 2, 3)],
    "binary": [bytearray(b) for b in (b"\x00a", b"b'", b"\xff")],
    "decimal(20,3)": [decimal.Decimal(x) for x in ("1.500", "2.000", "12345678901234567.125")],
    "string": ["it's", "back\\slash", "é\n\""],
    "double": [1.5, 2.0, 1e300],
    "boolean": [True, False, None],
}


@pytest.mark.parametrize("kind", IDS)
def test_ids_of_every_type(spark, kind):
    a, b, c = IDS[kind]
    edges = spark.createDataFrame([(a, b, "x"), (b, c, "y"), (c, c, "z")], f"source_node_id {kind}, target_node_id {kind}, relation_type string")
    seeds = spark.createDataFrame([(a,)], f"node_id {kind}")
    found = [
        sorted(r.relation_type for r in joins.touching(edges, seeds, small).collect())
        for small in (None, True, False)
    ]
    assert found[0] == found[1] == found[2] and "x" in found[0]


def test_every_column_type_weighs(spark):
    heavy = spark.range(40).select(F.array(F.lit("x" * 500_000)).alias("a"))
    assert not is_small(heavy) and not is_small(heavy.select(F.col("a")[0].cast("binary")))
    assert is_small(spark.range(1000))


def test_measuring_needs_no_limit(spark):
    measured = spark.range(10).selectExpr("cast(id as string) AS t").agg(F.count("*"))
    assert "Limit" not in measured._jdf.queryExecution().executedPlan().toString()


def test_labels_without_names_stay(spark):
    nodes = spark.createDataFrame([(1, "A", None), (2, "A", None), (3, "B", "b")], "node_id int, label string, name string")
    assert sorted(map(tuple, select.names_by_label(nodes).collect())) == [("A", 2, None), ("B", 1, "b")]


def test_absent_labels_count_nothing(nodes, edges):
    rows = stats.category_metrics(nodes, edges, ["Planet", "Language"]).collect()
    assert {r.label: r.node_count for r in rows} == {"Planet": 0, "Language": 2}


def test_long_names_are_not_broadcast(spark):
    nodes = spark.range(3000).selectExpr("id AS node_id", "'L' AS label", "repeat(cast(id as string), 6000) AS name")
    edges = spark.range(2999).selectExpr("id AS source_node_id", "id + 1 AS target_node_id", "'r' AS relation_type")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = extract.category_graph(nodes, edges, "L").edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    sent = [below for line, below in zip(lines, lines[1:], strict=False) if "BroadcastExchange" in line]
    assert not any("near_name" in below or "name" in below for below in sent)


def test_ties_of_parallel_edges(spark):
    rows = [(1, 2, "r", x) for x in ("a", "b", "c")]
    made = lambda order: extract.simple_digraph(
        spark.createDataFrame(order, "source_node_id int, target_node_id int, relation_type string, note string").coalesce(1)
    ).collect()
    assert made(rows) == made(rows[::-1])


def test_names_longer_than_the_cut(spark):
    long = "Long name " + "ab" * 700
    nodes = spark.createDataFrame(
        [(1, "L", long), (2, "L", long + "!"), (3, "L", "x" * 64), (4, "L", "x" * 65), (5, "L", "ab")], "node_id int, label string, name string"
    )
    texts = spark.createDataFrame(
        [(1, f"see {long.upper()} here"), (2, "y" + "X" * 64 + "y"), (3, "z" + "x" * 65), (4, long[:-2]), (5, None)], "text_id int, text string"
    )
    names = {r.node_id: r.name.lower() for r in nodes.collect()}
    want = sorted((t.text_id, n) for t in texts.collect() for n, name in names.items() if t.text and name in t.text.lower())
    got = sorted((r.text_id, r.first_id) for r in mention_table(texts, nodes).collect())
    assert got == want

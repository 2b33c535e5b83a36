import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

NODES = [
    (1, "Person", "Ann", '{"age":"30"}'),
    (2, "Person", "Bob", None),
    (3, "Person", "Cy", "{}"),
    (4, "Company", "Acme", '{"city":"Oslo"}'),
    (5, "Company", "Beta", None),
    (6, "Company", "Ann", None),
    (7, "Language", "Java", None),
    (8, "Person", "Dot", None),
    (9, "Language", None, None),
    (10, None, "Nil", None),
    (11, " ", "Blank", None),
    (12, "nan", "Nan", None),
]
EDGES = [
    (1, 4, "works_at"),
    (1, 4, "founded"),
    (4, 1, "employs"),
    (1, 2, "knows"),
    (2, 1, "knows"),
    (2, 5, "works_at"),
    (2, 2, "likes"),
    (3, 7, "uses"),
    (3, 99, "uses"),
    (98, 3, "ghost"),
    (5, 4, "owns"),
    (6, 7, "uses"),
    (4, 9, "uses"),
    (10, 1, "sees"),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("kgweave-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="kgweave-wh-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def nodes(spark):
    return spark.createDataFrame(
        NODES, "node_id bigint, label string, name string, properties string"
    ).repartition(3)


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(
        EDGES, "source_node_id bigint, target_node_id bigint, relation_type string"
    ).repartition(3)


@pytest.fixture
def rows():
    def sorted_rows(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return sorted_rows

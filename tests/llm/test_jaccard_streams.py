"""The Jaccard join in small pieces: rows of one token over many batches, counts sent on early, tight bitmaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgweave.llm import jaccard_join
from test_operators import classes


@pytest.fixture
def small(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def rows_of_families(seed):
    rng = random.Random(seed)
    boiler = [f"b{i}" for i in range(40)]
    rows = []
    for family in range(6):
        body = [f"f{family}w{i}" for i in range(rng.randint(4, 70))]
        for _ in range(7):
            w = list(body)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.random()}"
            rows.append(w + (boiler if family % 2 else []))
    rows += [[f"z{rng.random()}" for _ in range(15)] + boiler for _ in range(40)]  # a passage in common, and too little else
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", range(2))
def test_small_batches(spark, small, seed):
    data = rows_of_families(seed)
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(6)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_classes(df).collect()) == sorted(classes(data))


def test_counts_of_shared_tokens(spark, small):
    """What a set shares in its prefix with any other, counted plainly; equal sets would count more than once."""
    data = [(i, text) for i, text in enumerate(sorted({text for _, text in rows_of_families(3)}))]
    df = spark.createDataFrame(data, "doc_id int, text string").repartition(9)
    got = {r.key: r.shared for r in jaccard_join._first_order(df, 5, 75).collect()}
    prefixes = {}
    for _, text in data:
        raw = text.encode()
        s = jaccard_join._Sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)
        if len(s.token):
            n = int(s.n[0])
            size = n - -(-n * 75 // 100) + max(1, n // jaccard_join.EXTRA)
            prefixes[int(s.sig[0]) & 0x7FFFFFFF] = set(s.token[:size].tolist())
    want = {}
    for key, mine in prefixes.items():
        shared = sum(any(t in other for k, other in prefixes.items() if k != key) for t in mine)
        if shared:
            want[key] = shared
    assert got == want


def test_bitmaps_bound_what_two_sets_share(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        n = rng.randint(1, 400)
        toks = rng.sample(range(-1 << 40, 1 << 40), n) if i % 3 else [*range(rng.randint(1, 30), 400)]
        rows.append((i, len(toks) + rng.randint(0, 5), i, toks[:2], toks))
    records = spark.createDataFrame(rows, "sig bigint, n int, comp bigint, pre_a array<bigint>, toks array<bigint>")
    one = jaccard_join._with_bits(records)
    two = one.select(F.col("sig").alias("other"), F.col("n").alias("m"), F.col("k").alias("p_k"), *(F.col(f"w{i}").alias(f"p_w{i}") for i in range(jaccard_join.WORDS)))
    passed = {(r.sig, r.other) for r in one.crossJoin(two).filter(jaccard_join._may_overlap(75)).collect()}
    for a, n, _, _, x in rows:
        for b, m, _, _, y in rows:
            common = len(set(x) & set(y))
            if 100 * common >= 75 * (n + m - common):
                assert (a, b) in passed
    assert len(passed) < len(rows) ** 2 / 2

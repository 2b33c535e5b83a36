"""The whole pipeline on the smallest tables against a plain version of all its stages."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kgweave.llm import quality_rules
from kgweave.llm.oracle import ORACLE
from kgweave.llm.queries import token_file
from test_quality_limits import fences, ratios

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def by_quality(rows):
    """Fewer documents than a group needs: the cutoffs are those of all."""
    assert len(rows) <= quality_rules.MIN_ROWS
    limits = fences([ratios(r["text"] or "") for r in rows])
    kept = []
    for r in rows:
        w = words(r["text"] or "")
        seen, again = {}, set()
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                again.update(j for i in at for j in range(i, i + 8))
        fine = len(w) >= 20 and 100 * len(again) <= 30 * len(w)
        if fine and all(x <= limit for x, limit in zip(ratios(r["text"] or ""), limits, strict=True)):
            kept.append(r)
    return kept


def by_likeness(rows):
    """The least id of each component; sets are never empty here."""
    sets = []
    for r in rows:
        w = words(r["text"].translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k]["doc_id"])
                least[b] = a
    return [r for i, r in enumerate(rows) if root(i) == i]


def by_benchmark(rows):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    windows = set()
    for text in pq.read_table(f"{DATA}/benchmark.parquet")["text"].to_pylist():
        w = cut(text)
        if w:
            size = min(len(w), 10)
            windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    sizes = {len(x) for x in windows}
    return [r for r in rows if not any(tuple(w[i : i + n]) in windows for w in [cut(r["text"])] for n in sizes for i in range(len(w) - n + 1))]


def by_weight(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows))
    drawn = dict(con.execute(f"SELECT doc_id, kept FROM ({ORACLE['op10_raking']})").fetchall())
    return [r for r in rows if drawn[r["doc_id"]]]


def in_tokens(rows):
    library = Tokenizer.from_file(token_file())
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"], add_special_tokens=False).ids + [0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def plain():
    stages, rows = [], pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    for stage in (by_quality, by_likeness, by_benchmark, by_weight):
        rows = stage(rows)
        stages.append(rows)
    return stages


def test_run(spark, plain):
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == in_tokens(plain[-1])


def test_every_stage(spark, plain):
    """Each stage takes a part of what the one before kept, and returns the columns of documents."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(r["doc_id"] for r in want), name
        assert 0 < len(want) < before or name == "jaccard_join"
        before = len(want)
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in want], docs.schema)


ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (None, "no id " + " ".join(f"w{i}" for i in range(40)), "en", "a", 1),
    (3, " ".join(f"x{i}" for i in range(60)), "en", "a", 1),
    (3, " ".join(f"x{i}" for i in range(60)), "en", "a", 1),
    (4, " ".join(f"y{i % 9000}z{i}" for i in range(30_000)), "de", "b", 1),
]


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    extra = [(*row, "x", True) for row in ODD]
    for rows in (extra, []):
        wide = spark.createDataFrame(rows, schema + ", n_words string, kept boolean")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, wide, DATA)
            found = out.collect()
            assert len(found) <= len(rows), name
            if name == "quality_rules":
                assert len([r for r in found if r.doc_id == 3]) == (2 if rows else 0)
            if name == "jaccard_join":
                assert len([r for r in found if r.doc_id == 3]) == (1 if rows else 0)
            if name == "token_orc":
                assert len(found) == len(rows)

"""ContextMixing.java says what the array operations say, and texts meet the table in packed lists."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from kgweave.llm import context_mixing as mixing
from kgweave.llm.common import Scratch

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def varints(*numbers):
    out = bytearray()
    for x in numbers:
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def packed(pairs, counts):
    steps = np.diff(pairs, prepend=0).tolist()
    return varints(*(x for pair in zip(steps, counts.tolist(), strict=True) for x in pair))


def test_scores_as_the_arrays_do(spark):
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcde fgh.,AZ\xc3\xa9") for _ in range(n)) for n in (2500, 0, 1, 7, 900, 40, 3100, 64, 1300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    # Of the pairs that the texts need, some are broadcast, some told, and some contexts are new.
    key, count = (np.concatenate(x) for x in zip(*[np.unique(p, return_counts=True) for p in mixing.Symbols(data, offsets).pairs()], strict=True))
    lot = np.random.RandomState(1).randint(0, 10, key.max() % 1000 + 1000)[(key >> 9) % 997]
    hot, told = lot < 3, (lot >= 3) & (lot < 9)
    told &= np.random.RandomState(2).rand(len(key)) < 0.8  # symbols that a known context has not seen
    code = mixing.prefix_code(np.bincount(data, minlength=257))
    want = mixing.code_bits(mixing.Decisions(data, offsets, code), mixing.Exact((key[hot], count[hot]), (key[told], count[told])))
    held = zlib.compress(np.concatenate((np.diff(key[hot], prepend=0), count[hot])).astype("<i8").tobytes())
    score = mixing._java(
        spark, "Score", "binary", spark.sparkContext._jsc.broadcast(held), "a test's", mixing._code_bytes(code), mixing.RATE, mixing.REFINE_RATE, mixing.START, mixing.LEAST_P
    )
    half = told & (key >> 9 & 1 == 1), told & (key >> 9 & 1 == 0)
    row = (bytearray(data.tobytes()), bytearray(offsets.astype("<i8").tobytes()), [bytearray(packed(key[h], count[h])) for h in half])
    frame = spark.createDataFrame([row, (*row[:2], None)], "data binary, offsets binary, lists array<binary>").coalesce(1)
    got, untold = (np.frombuffer(r.bits, "<f8") for r in frame.select(score("data", "offsets", "lists").alias("bits")).collect())
    # A decision near the border of two cells of the map may go to either.
    assert np.allclose(got, want, rtol=1e-4)
    want = mixing.code_bits(mixing.Decisions(data, offsets, code), mixing.Exact((key[hot], count[hot])))
    assert np.allclose(untold, want, rtol=1e-4)


def documents(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abcdE é") for _ in range(rng.choice([0, 3, 80, 400])))) for i in range(70)]
    return spark.createDataFrame([*rows, (None, "abc"), (3, None), rows[5], rows[5]], "doc_id int, text string").repartition(3)


def test_table_does_not_depend_on_batches(spark, monkeypatch):
    docs = documents(spark)

    def counted(docs):
        return {(r.context, r.total, tuple(sorted((s.symbol, s.n) for s in r.seen))) for r in mixing.count_contexts(docs).collect()}

    want = counted(docs)
    texts = [(r.text or "").translate(LOWER).encode() for r in docs.collect() if not mixing.held_out(r.doc_id)]
    symbols = mixing.Symbols(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    plain = {}
    for pairs in symbols.pairs():
        for pair, n in zip(*np.unique(pairs, return_counts=True), strict=True):
            plain.setdefault(int(pair >> 9), []).append((int(pair & 511), int(n)))
    assert want == {(k, sum(n for _, n in v), tuple(sorted(v))) for k, v in plain.items()}
    monkeypatch.setattr(mixing, "ASK_BYTES", 300)
    monkeypatch.setattr(mixing, "BATCH_ROWS", 4)
    monkeypatch.setattr(mixing, "ODDS_PAIRS", 7)
    batches = mixing.pack(docs)
    assert batches.count() > 20 and batches.select(F.max(F.size("ids"))).first()[0] <= 4
    assert counted(docs) == want


def test_contexts_travel_in_lists(spark, monkeypatch):
    """A row per batch and bucket, not per context (before: an array that was exploded), and the same scores with many batches and rounds."""
    docs = documents(spark)
    want = sorted((r.doc_id is None, r.doc_id, r.score, r.base_score, r.n_known) for r in mixing.score_documents(docs).collect() if r.doc_id is not None)
    saved, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.update({name: save(self, df, name)}) or saved[name])
    for name, value in {"ASK_BYTES": 400, "BATCH_ROWS": 9, "ROUND_BYTES": 3000, "BUCKET_BYTES": 200, "HOT_PAIRS": 50}.items():
        monkeypatch.setattr(mixing, name, value)
    pairs = []
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: pairs.append(saved["pairs"].count()))
    rows = mixing.score_documents(docs).collect()
    assert len(rows) == docs.count()
    got = sorted((r.doc_id is None, r.doc_id, r.score, r.base_score, r.n_known) for r in rows if r.doc_id is not None)
    assert [(a[1], a[4]) for a in got] == [(b[1], b[4]) for b in want]
    assert np.allclose([a[2:4] for a in got], [b[2:4] for b in want], rtol=1e-6)
    assert 0 < pairs[0] <= max(mixing.BUCKETS, 100)

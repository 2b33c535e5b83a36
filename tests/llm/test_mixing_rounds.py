"""What scoring puts on disk: sums of the highest order, and batches told some at a time."""

import math
import random

import numpy as np
import pyarrow as pa

from kgweave.llm import context_mixing as mixing
from kgweave.llm.common import Scratch


def chunk(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.cumsum([0, *map(len, texts)])


def test_batches_are_told_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    want = {r.doc_id: r.score for r in mixing.score_documents(docs).collect()}
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    monkeypatch.setattr(mixing, "HOT_PAIRS", 500)
    monkeypatch.setattr(mixing, "ROUND_BYTES", 4000)
    monkeypatch.setattr(mixing, "LONG_BYTES", 256)  # all go to batches that tasks share
    monkeypatch.setattr(mixing, "POOL_BYTES", 2000)
    got = {r.doc_id: r.score for r in mixing.score_documents(docs).collect()}
    assert saved.count("own") == 3
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-6) for i in got)


def test_tasks_share_batches_of_long_texts(monkeypatch):
    monkeypatch.setattr(mixing, "LONG_BYTES", 100)
    texts = pa.array(["x" * n for n in (450, 420, 150, 99, 5, 0)])
    one, two = (list(mixing._dealt(texts, part, 0, {2: 1, 0: 1})) for part in (0, 1))
    assert [x[:2] for x in one] == [(0, 2), (2, 3), (3, 6)] == [x[:2] for x in two]
    assert [a[2] == b[2] for a, b in zip(one, two, strict=True)] == [True, True, False]
    assert len({x[2] for x in one + two}) == 4


def test_odds_against_counting():
    texts = [b"abracadabra", b"abrab", b"", b"zebra abra"]
    data, offsets = chunk(texts)
    code = mixing.prefix_code(np.bincount(data, minlength=257))
    key, count = (np.concatenate(x) for x in zip(*[np.unique(p, return_counts=True) for p in mixing.Symbols(data, offsets).pairs()], strict=True))
    seen = mixing.Decisions(*chunk([b"abrazz", b"abra"]), code)
    table, where, whole = mixing.Exact((key[::2], count[::2]), (key[:0], count[:0])).laid_out(seen)
    held = dict(zip(key[::2].tolist(), count[::2].tolist(), strict=True))
    got = table[where]
    at = 0
    for place, (*pairs,) in enumerate(zip(*seen.pairs(), strict=True)):
        symbol = int(seen.now[place])
        for step in range(code.length[symbol]):
            known = 0
            for i, pair in enumerate(pairs):
                n = [0, 0]
                for s in range(257):
                    if code.length[s] > step and (code.node[s, : step + 1] == code.node[symbol, : step + 1]).all():
                        n[code.bit[s, step]] += held.get(int(pair) >> 9 << 9 | s, 0)
                known += sum(n) > 0
                want = min(max(math.log((n[1] + 0.1) / (n[0] + 0.1)), -9), 9) if sum(n) else 0
                assert math.isclose(got[at, i], want, rel_tol=1e-6)
            assert (got[at, 5], got[at, 6]) == (code.bit[symbol, step], known)
            at += 1
    assert at == seen.total and not whole.any()


def test_documents_of_known_inputs_run_apart(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (900, 0, 7, 1200, 64)]
    data, offsets = chunk(texts)
    code = mixing.prefix_code(np.bincount(data, minlength=257))
    key, count = (np.concatenate(x) for x in zip(*[np.unique(p, return_counts=True) for p in mixing.Symbols(*chunk(texts[1:])).pairs()], strict=True))
    one = mixing.code_bits(mixing.Decisions(data, offsets, code), mixing.Exact((key, count)))
    monkeypatch.setattr(mixing, "FEW", 0)
    two = mixing.code_bits(mixing.Decisions(data, offsets, code), mixing.Exact((key, count)))
    assert np.allclose(one, two, rtol=1e-6)

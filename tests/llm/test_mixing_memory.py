"""Scoring holds its text and one window's decisions, not all decisions nor the table spread over nodes."""

import tracemalloc

import numpy as np

from kgweave.llm import context_mixing as mixing


def chunk(sizes, seed=3):
    rng = np.random.RandomState(seed)
    data = rng.choice(np.frombuffer(b"abcdefghijklmnop .,\xc3", np.uint8), sum(sizes))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    keys = [np.unique(pairs, return_counts=True) for pairs in mixing.Symbols(data, offsets).pairs()]
    key, count = (np.concatenate(x) for x in zip(*keys, strict=True))
    some = np.random.RandomState(seed).rand(len(key)) < 0.7
    code = mixing.prefix_code(np.bincount(data, minlength=257))
    return data, offsets, code, mixing.Exact((key[some], count[some]), (key[:0], count[:0]))


def test_memory_of_scoring():
    data, offsets, code, exact = chunk([1000] * 400)
    tracemalloc.start()
    mixing.code_bits(mixing.Decisions(data, offsets, code), exact)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 450 * len(data)  # 380; 611 with all decisions of a chunk laid out


def test_slices_and_lane_groups_do_not_matter(monkeypatch):
    data, offsets, code, exact = chunk([300, 0, 7, 1200, 1, 64, 500, 3])
    want = mixing.code_bits(mixing.Decisions(data, offsets, code), exact)
    monkeypatch.setattr(mixing, "ODDS_PAIRS", 50)
    monkeypatch.setattr(mixing, "LANES", 3)
    assert np.allclose(mixing.code_bits(mixing.Decisions(data, offsets, code), exact), want, rtol=1e-6)


def test_pairs_are_numbered():
    data, offsets, *_ = chunk([300, 0, 7, 1200])
    symbols = mixing.Symbols(data, offsets)
    for (pair, number), pairs in zip(symbols.numbered(), symbols.pairs(), strict=True):
        assert len(np.unique(pair)) == len(pair) and (pair[number] == pairs).all()

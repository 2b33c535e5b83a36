"""What texts ask the table of contexts for, and that their order does not matter to them."""

import numpy as np
import pyarrow as pa

from kgweave.llm import context_mixing as mixing


def test_contexts_are_distinct_and_in_order():
    texts = [b"abcabcabc", b"", b"zz\xff Abc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    contexts = mixing.Symbols(data, offsets).contexts()
    assert (np.diff(contexts) > 0).all()
    want = set()
    for text in texts:
        row = [0] * max(mixing.ORDERS) + list(text.lower()) + [mixing.END]
        for at in range(max(mixing.ORDERS), len(row)):
            for k in mixing.ORDERS:
                want.add(sum(row[at - j] << (8 * (j - 1)) for j in range(1, k + 1)) | k << 48)
    assert set(contexts.tolist()) == want


def test_texts_of_like_length_run_together():
    texts = pa.array(["ccc", None, "a", "bb", ""])
    assert mixing._by_length(texts).to_pylist() == [1, 4, 2, 3, 0]

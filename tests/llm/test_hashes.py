"""Texts that collide in every polynomial hash modulo 2^64 are told apart."""

import collections
import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgweave.llm import common, quality_rules, suffix_dedup, token_orc
from kgweave.llm.queries import token_file


def signs(n, letters):
    """Letters by the parity of the ones in their places, and the same swapped."""
    one = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans(letters, letters[::-1]))


def test_spans():
    for n in (5, 8, 9, 64, 65, 2048, 4096):
        one, two = signs(n, "ab")
        data = np.frombuffer((one + two + one.upper()).encode(), np.uint8)
        start = np.arange(3) * n
        a, b, c = common.span_hashes(data, start, start + n).tolist()
        assert len({a, b, c}) == 3
        assert common.span_hashes(data, start, start + n, fold=True)[2] == a
    data = np.frombuffer(b"abcabc abcabc\0 " * 30, np.uint8)
    spans = [(i, j) for i in range(60) for j in range(i, min(i + 80, len(data)))]
    start, end = np.array(spans).T
    seen = collections.defaultdict(set)
    for h, i, j in zip(common.span_hashes(data, start, end).tolist(), start, end, strict=True):
        seen[h].add(data[i:j].tobytes())
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len({data[i:j].tobytes() for i, j in spans})
    assert len(common.span_hashes(data, start[:0], end[:0])) == 0


def test_token_ids(spark, tmp_path):
    texts = [x for n in (2048, 4096) for x in signs(n, "ab")] + [" ".join(signs(2048, "xy"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    token_orc.write_tokens(docs, f"{tmp_path}/t", token_file())
    library = Tokenizer.from_file(token_file())
    for r in token_orc.read_tokens(spark, f"{tmp_path}/t").collect():
        assert r.ids[:-1] == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_duplicate_lines_and_repeats(spark):
    # Every second letter is one that both texts have there.
    rng = random.Random(7)
    shared = [rng.choice("cdefghij") for _ in range(4096)]
    one, two = ("".join(x + y for x, y in zip(t, shared, strict=True)) for t in signs(4096, "ab"))
    rows = [(1, f"{one}\n{two}", "en", "a"), (2, one[:3000] + "#" + one[:3000], "en", "a"), (3, two, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    assert {r.doc_id: r.n_dup_lines for r in quality_rules.quality_rules(docs).collect()} == {1: 0, 2: 0, 3: 0}
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id int, text string")
    counts = collections.Counter(t[i : i + 400] for t in (one, two) for i in range(len(t) - 399))
    assert max(counts.values()) == 1
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: (0, hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, one), (2, two))}


def test_files_with_another_split_rule(spark, tmp_path):
    """A tokenizer whose rule is not the byte-level one goes through the library."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some Words, and MORE words.", "it's", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    token_orc.write_tokens(docs, f"{tmp_path}/t", path)
    library = Tokenizer.from_file(path)
    got = token_orc.with_crc32(token_orc.read_tokens(spark, f"{tmp_path}/t")).filter(F.col("doc_id") >= 0).collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())

"""Piece encoding against the library: ids, decoded texts, spans, and its own normalisation."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from kgweave.llm import piece_encoding
from kgweave.llm.common import text_chunks
from kgweave.llm.queries import LLM_QUERIES, piece_file

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_file())


def odd_texts(n=300):
    rng = random.Random(13)
    fixed = ["", " ", "  a  b\n\tc ", "▁ a▁b", "a\r\n\0b", "é ﬁ ① ​ x", "<s>hi</s>", "𝕏𝕐 中文字 😀😀", "x" * 3000, "   " * 500, "word " * 60_000]
    return fixed + ["".join(rng.choice(" ab\n▁é中😀\tﬁ\x00Ａ㎞") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_spans_and_texts_are_the_librarys(spark, library):
    texts = odd_texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, None, None, None), (7, texts[7], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, starts int").repartition(4)
    found = piece_encoding.encode_documents(docs, piece_file())
    got = found.collect()
    assert len(got) == len(rows) and [r.ids for r in got if r.doc_id is None] == [[1, 2]]
    assert len([r for r in got if r.doc_id == 7]) == 2
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert r.ids == library.encode(text, add_bos=True, add_eos=True)
        pieces = library.encode(text, return_type="proto").pieces
        assert list(zip(r.starts, r.ends, strict=True))[1:-1] == [(p.begin, p.end) for p in pieces]
        size = len(text.encode())
        assert (r.starts[0], r.ends[0], r.starts[-1], r.ends[-1]) == (0, 0, size, size)
        assert all(a == b for a, b in zip(r.ends, r.starts[1:], strict=False))  # the spans tile the text
    decoded = {r.doc_id: r.text for r in piece_encoding.decode_documents(found, piece_file()).collect()}
    assert all(decoded[i] == library.decode(library.encode(t, add_bos=True, add_eos=True)) for i, t in enumerate(texts))


def test_query(spark, library):
    rows = pq.read_table(f"{DATA}/documents.parquet")
    want = {}
    for i, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = LLM_QUERIES["op13_piece_encoding"](spark, DATA).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert piece_encoding.encode_documents(none, piece_file()).count() == 0
    assert piece_encoding.encoding_digests(none, piece_file()).count() == 0
    assert piece_encoding.decode_documents(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), piece_file()).collect()[0].text is None


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("spaces", [True, False])
@pytest.mark.parametrize("escape", [True, False])
def test_compiled_map_against_the_library(prefix, spaces, escape):
    """A public rule with thousands of keys, some of several characters."""
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=prefix, remove_extra_whitespaces=spaces, escape_whitespaces=escape)
    blob = dict(piece_encoding.fields(rule.serialized_normalizer_spec()))[2]
    own = piece_encoding.Normalizer(blob, prefix, spaces, escape)
    texts = [*odd_texts(200)[:-201], *odd_texts(200)[11:], "ｶﾞ　 x㎞ é ﷺ ½", " 　 　", "１２３ ＡＢＣ  ﬃ ", "한글 각"]
    for _, _, data, offsets in text_chunks(pa.array(texts)):
        out, edges, source, until = own.run(data, offsets)
        for i, text in enumerate(texts):
            mine = out[edges[i] : edges[i + 1]]
            want, places = rule.Normalize(text, with_offsets=True)
            assert mine.tobytes().decode() == want
            if want:
                width = np.cumsum([0, *(len(c.encode()) for c in text)])
                begins = np.flatnonzero((mine & 0xC0) != 0x80)
                assert [*source[edges[i] : edges[i + 1]][begins].tolist(), int(until[i])] == width[places].tolist()


def test_models_of_other_kinds_are_refused(tmp_path):
    data = open(piece_file(), "rb").read()
    unigram = b"".join(
        piece_encoding._field(k, b"".join(piece_encoding._field(n, 1 if n == 3 else x) for n, x in piece_encoding.fields(v) if n in (1, 3)) if k == 2 else v)
        for k, v in piece_encoding.fields(data)
    )
    (tmp_path / "other.model").write_bytes(unigram)
    with pytest.raises(ValueError, match="BPE"):
        piece_encoding.PieceModel(str(tmp_path / "other.model"))

"""Encoding with a piece model, every piece traced to the bytes of the text it came from.

A text is normalised by the model's compiled character map: at each character the
longest prefix that the map's double-array trie holds is replaced by the map's string,
other characters stay.  White space is then collapsed, marked and prefixed as the model
says.  Each normalised byte keeps the offset of its source, so that the pieces, laid end
to end over the normalised text, project to byte spans of the original.

The library then cuts the normalised text into pieces, by the same model with its
normalisation switched off.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kgweave.llm.common import text_chunks

#: Field numbers and types of a model file, and the mark of white space.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_TEXT, _KIND, _NORMAL, _USER, _BYTE = 1, 3, 1, 4, 6
_MODEL_TYPE, _BPE = 3, 2
_MAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE = 2, 3, 4, 5
MARK = "▁"

#: Bytes of text that a task normalises at a time; a longer text is held whole.
CHUNK_BYTES = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _field(number: int, value: int | bytes) -> bytes:
    def varint(x: int) -> bytes:
        return bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie, then its strings.

    A unit of the trie holds a label in its low byte, a flag for "a key ends here" in
    bit 8, and the offset of its children above, scaled by bit 9.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.strings = blob[4 + size :]
        units = self.units
        self.offset = (units >> 10) << ((units & 512) >> 6)
        self.label = units & (1 << 31 | 255)
        self.ends = (units >> 8 & 1).astype(bool)

    def string(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(0, value)]

    def matches(self, data: np.ndarray, at: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length (0: none) and value of the longest key that starts at each place before its limit."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.full(len(at), self.offset[0])
        step = 0
        while len(live):
            inside = at[live] + step < limit[live]
            live, node = live[inside], node[inside]
            byte = data[at[live] + step].astype(np.int64)
            node = node ^ byte
            found = node < len(self.units)
            found[found] = self.label[node[found]] == byte[found]
            live, node = live[found], node[found]
            step += 1
            ends = self.ends[node]
            node = node ^ self.offset[node]
            length[live[ends]] = step
            value[live[ends]] = self.units[node[ends]] & ((1 << 31) - 1)
        return length, value


class Normalizer:
    """The model's normalisation of many texts at once, with the source of each byte."""

    def __init__(self, blob: bytes, dummy_prefix: bool, remove_spaces: bool, escape: bool):
        self.map = CharacterMap(blob) if blob else None
        self.dummy_prefix, self.remove_spaces, self.escape = dummy_prefix, remove_spaces, escape

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes, their offsets per text, the source (byte of its text) of each, and each text's end of source."""
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        begins = (data & 0xC0) != 0x80
        # Each byte's source is the first byte of its character.
        source = np.maximum.accumulate(np.where(begins, np.arange(len(data)), 0)) - offsets[doc]
        until = sizes.copy()
        if self.map is not None:
            data, doc, source = self._mapped(data, offsets, doc, source)
        if self.remove_spaces:
            space = data == 32
            again = np.empty(len(data), bool)
            again[:1] = True
            again[1:] = (doc[1:] != doc[:-1]) | space[:-1]
            keep = ~(space & again)
            data, doc, source = data[keep], doc[keep], source[keep]
            last = np.ones(len(data), bool)
            last[:-1] = doc[1:] != doc[:-1]
            drop = last & (data == 32)
            until[doc[drop]] = source[drop]
            data, doc, source = data[~drop], doc[~drop], source[~drop]
        mark = np.frombuffer(MARK.encode() if self.escape else b" ", np.uint8)
        times = np.where(data == 32, len(mark), 1)
        first = np.ones(len(data), bool)
        first[1:] = doc[1:] != doc[:-1]
        if self.dummy_prefix:
            times[first] += len(mark)
        ends = np.cumsum(times)
        out = np.repeat(data, times)
        spaces = ends[data == 32] - len(mark)
        starts = (ends - times)[first] if self.dummy_prefix else np.zeros(0, np.int64)
        for place in (spaces, starts):
            for k, byte in enumerate(mark):
                out[place + k] = byte
        edges = np.concatenate(([0], np.cumsum(np.bincount(doc, times, len(sizes)).astype(np.int64))))
        return out, edges, np.repeat(source, times), until

    def _mapped(self, data, offsets, doc, source):
        at = np.flatnonzero((data & 0xC0) != 0x80)
        length, value = self.map.matches(data, at, offsets[doc[at] + 1])
        met = np.flatnonzero(length)
        taken, free = [], 0
        for k in met.tolist():
            if at[k] >= free:
                taken.append(k)
                free = at[k] + length[k]
        if not taken:
            return data, doc, source
        strings = [self.map.string(v) for v in value[taken].tolist()]
        starts, widths = at[taken], length[taken]
        # One unit for each replaced run and each byte outside of them.
        gone = np.zeros(len(data) + 1, np.int64)
        np.add.at(gone, starts, 1)
        np.add.at(gone, starts + widths, -1)
        unit = np.flatnonzero((np.cumsum(gone[:-1]) == 0) | np.isin(np.arange(len(data)), starts))
        replaced = np.searchsorted(unit, starts)
        times = np.ones(len(unit), np.int64)
        times[replaced] = [len(s) for s in strings]
        out = np.repeat(data[unit], times)
        begins = (np.cumsum(times) - times)[replaced]
        for begin, text in zip(begins.tolist(), strings, strict=True):
            out[begin : begin + len(text)] = np.frombuffer(text, np.uint8)
        return out, np.repeat(doc[unit], times), np.repeat(source[unit], times)


class PieceModel:
    """A BPE piece model with byte fallback, read from its file."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        parts = list(fields(model))
        pieces = [dict(fields(p)) for number, p in parts if number == _PIECE]
        kinds = np.array([p.get(_KIND, _NORMAL) for p in pieces])
        texts = [p[_TEXT].decode() for p in pieces]
        if dict(fields(next(p for number, p in parts if number == _TRAINER))).get(_MODEL_TYPE) != _BPE:
            raise ValueError(f"{path}: not a BPE model")
        if (kinds == _USER).any() or (kinds == _BYTE).sum() != 256:
            raise ValueError(f"{path}: models with user-defined pieces or without byte fallback are not supported")
        #: Normalised bytes of each piece; control pieces have none.
        self.bytes = np.array([len(t.encode()) if kind == _NORMAL else int(kind == _BYTE) for t, kind in zip(texts, kinds, strict=True)])
        spec = dict(fields(next(p for number, p in parts if number == _NORMALIZER)))
        self.normalizer = Normalizer(spec.get(_MAP, b""), *(bool(spec.get(k, 1)) for k in (_DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE)))
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # The same pieces for text that is normalised already.
        plain = b"".join(_field(k, v) for k, v in ((1, b"identity"), (_MAP, b""), (_DUMMY_PREFIX, 0), (_REMOVE_SPACES, 0), (_ESCAPE, 0)))
        self.ready = sentencepiece.SentencePieceProcessor(model_proto=b"".join(_field(k, plain if k == _NORMALIZER else v) for k, v in parts))
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text its ids, and the byte span [start, end) of each id in the text.

        The begin id spans nothing at 0, the end id nothing at the text's end.  A piece
        that is some bytes of one source character spans nothing until that character's
        last byte, whose piece spans it whole.
        """
        out, edges, source, until = self.normalizer.run(data, offsets)
        texts = [out[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, ids in enumerate(self.ready.encode(texts, num_threads=1, return_type="numpy")):
            places = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.bytes[ids], out=places[1:])
            if places[-1] != edges[i + 1] - edges[i]:
                raise ValueError("pieces do not cover the normalised text")
            projected = np.append(source[edges[i] : edges[i + 1]], until[i])[places]
            size = offsets[i + 1] - offsets[i]
            starts, ends = np.concatenate(([0], projected[:-1], [size])), np.concatenate(([0], projected[1:], [size]))
            yield np.concatenate(([self.begin], ids, [self.end])).astype("<u4"), starts, ends


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str):
    def run(batches):
        model = piece_model(path)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                found = list(model.encode(data, offsets))
                edges = pa.array(np.concatenate(([0], np.cumsum([len(ids) for ids, _, _ in found]))), pa.int32())
                flat = [np.concatenate([row[k] for row in found]).astype(np.int32) for k in range(3)]
                lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], names=["doc_id", "ids", "starts", "ends"])

    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, starts, ends of every document: `docs` (doc_id, text) in, other columns left out.

    ids are the library's, with begin and end ids; starts and ends are byte offsets in
    the text's UTF-8, [start, end) for each id, together covering the text but for white
    space that the model drops.  Null text is empty and, like an empty one, has begin and
    end ids only.  Rows stay rows: repeated ones and null doc_ids too; an empty table
    gives an empty table.  A task holds CHUNK_BYTES of text and a longer text whole (some
    30 bytes for each of its bytes).  `model` is a BPE model file with byte fallback.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode(model), f"doc_id {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id, text from `tokens` (doc_id, ids) by the library; null ids give null text."""

    def run(batches):
        decode = piece_model(model).library.decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def encoding_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, and lowercase sha-256 of ids, of byte spans (start and end in turn) and of the decoded text.

    Integers are hashed as little-endian 32-bit ones.  Rows as in `encode_documents`.
    """

    def digests(batches):
        pieces = piece_model(model)
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                rows = []
                for ids, starts, ends in pieces.encode(data, offsets):
                    spans = np.stack((starts, ends), 1).astype("<u4").tobytes()
                    text = pieces.library.decode(ids.tolist()).encode()
                    rows.append((len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.tobytes(), spans, text))))
                columns = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, spans_sha256 string, decoded_sha256 string")

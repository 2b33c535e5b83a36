"""Token ids of documents in ORC files, and reading them back.

The format: a folder with `tokens/`, ORC files in ascending (doc_id, text hash,
text) order over the whole folder, and `manifest/`, one row per file with its
number of ids and the ids before it.  Columns of a file: `part`, `doc_id`,
`local_start` (ids before the document in its file), `n_tokens`, `ids`
(array<int>, the end id included).  ORC stores the integers run-length encoded
and bit-packed; each stripe has row indexes of min and max, and a Bloom filter
on doc_id, so that a lookup by doc_id skips files, stripes and row groups by
metadata, and a scan reads stripes in parallel.

Words repeat, so a task encodes each distinct piece of text once: pieces are cut
as the tokenizer's own split rule cuts them, gathered by hash and compared in full,
looked up in a bounded table, and only new ones go through the tokenizer's model.  A
file with another split rule goes through the library as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgweave.llm.common import mix, prefix_hash

END_ID = 0
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
#: Code points that a task holds as number arrays at a time.
CHUNK_CHARS = 1 << 19
#: Distinct pieces remembered by a worker; then it starts anew.
REMEMBERED = 400_000

_LETTER, _NUMBER, _OTHER, _BLANK = 0, 1, 2, 3
#: Unicode's white space.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for code in range(0x110000):
        first = unicodedata.category(chr(code))[0]
        if first == "L":
            kinds[code] = _LETTER
        elif first == "N":
            kinds[code] = _NUMBER
    kinds[_BLANKS] = _BLANK
    return kinds


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Token ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        #: Whether `_starts` is the file's split rule.
        self.plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kinds = _kinds()
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def _learn(self, piece: str) -> int:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        k = len(self.known)
        if k == len(self.first):
            self.first, self.count = np.resize(self.first, 2 * k), np.resize(self.count, 2 * k)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[piece] = k
        return k

    def _starts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """First code point of every piece: runs of one kind, a single blank going with what follows."""
        n = len(codes)
        kind = self.kinds[codes]
        opens = np.zeros(n + 1, bool)
        opens[edges] = True
        opens = opens[:n]
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= opens
        blank = kind == _BLANK
        led = np.zeros(n, bool)  # a plain space stands before, in the same text
        led[1:] = (codes[:-1] == 32) & ~opens[1:]
        ends = np.zeros(n, bool)  # the next code point is of the same text and not blank
        ends[:-1] = ~blank[1:] & ~opens[1:]
        return np.flatnonzero(np.where(blank, change | ends, change & ~led))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            # Contractions and special tokens have split rules of their own.
            if not self.plain or "'" in text or any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                plain.append(i)
        if not plain:
            return out
        joined = "".join([texts[i] for i in plain])
        edges = np.concatenate(([0], np.cumsum([len(texts[i]) for i in plain])))
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(codes):
            for i in plain:
                out[i] = np.zeros(0, np.int32)
            return out
        if len(self.known) > REMEMBERED:
            self._forget()
        start = self._starts(codes, edges)
        end = np.append(start[1:], len(codes))
        at, which = _alike(codes, start, end)
        known = self.known
        pieces = [joined[s:e] for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        rows = np.array([known[piece] if piece in known else self._learn(piece) for piece in pieces], np.int64)[which]
        counts = self.count[rows]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(self.first[rows] - total[:-1], counts) + np.arange(total[-1])]
        cut = total[np.searchsorted(start, edges)]
        for j, i in enumerate(plain):
            out[i] = ids[cut[j] : cut[j + 1]]
        return out


def _alike(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One piece of each kind, and the kind of every piece: of equal pieces by hash if they are equal in full."""
    sums, inverse = prefix_hash(mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    _, at, which = np.unique((sums[end] - sums[start]) * inverse[start], return_index=True, return_inverse=True)
    size = end - start
    if (size == size[at][which]).all():
        shift = np.repeat(start[at][which] - start, size)
        if (codes == codes[np.arange(len(codes)) + shift]).all():
            return at, which
    # Some differ: every piece stands for itself.
    return np.arange(len(start)), np.arange(len(start))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > CHUNK_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _encode_partition(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32)
        for batch in batches:
            at = 0
            for group in _groups([t or "" for t in batch.column(1).to_pylist()]):
                ids = [x for found in encoder(path).encode(group) for x in (found, end)]
                sizes = np.array([len(x) for x in ids[::2]], np.int64) + 1
                edges = np.concatenate(([0], np.cumsum(sizes)))
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = [
                    pa.array(np.full(len(group), part, np.int32)),
                    batch.column(0).slice(at, len(group)),
                    pa.array(edges[:-1] + before),
                    pa.array(sizes),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                at += len(group)
                before += int(edges[-1])

    return run


def token_schema(doc_id: str = "bigint") -> str:
    return f"part int, doc_id {doc_id}, local_start bigint, n_tokens bigint, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write `docs` (doc_id, text) as token ids into the folder `path`.

    Null text is empty: the end id alone.  A null doc_id comes first.  Repeated
    doc_ids and repeated rows stay rows of their own, ordered by text hash and
    text.  An empty table writes empty files.  Other columns are not written.
    """
    key = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = key.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    schema = token_schema(docs.schema["doc_id"].dataType.simpleString())
    (
        ordered.mapInArrow(_encode_partition(tokenizer, end_id), schema)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(f"{path}/tokens")
    )
    spark = docs.sparkSession
    sizes = spark.read.schema(schema).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row per file: the only window without a partition key.
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.withColumn("part_start", F.coalesce(before, F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, doc_id: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids; a predicate on doc_id prunes by the files' metadata."""
    rows = spark.read.schema(token_schema(doc_id)).orc(f"{path}/tokens")
    if where is not None:
        rows = rows.filter(where)
    manifest = spark.read.schema("part int, part_tokens bigint, part_start bigint").orc(f"{path}/manifest")
    return rows.join(manifest.drop("part_tokens"), "part", "left").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            edges = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))
            crc = [zlib.crc32(flat[edges[i] : edges[i + 1]].data) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")

"""What the operators share: reading tables, scratch tables, words and their hashes."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as number arrays at a time; one longer text is held whole.
CHUNK_BYTES = 2 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kgweave-{spark.sparkContext.applicationId}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive executors.

    `drop` deletes those of a name that no later step reads; what the result itself
    reads stays until the application's folder is cleared.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.written: dict[str, list[str]] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at, schema = self.path(name), df.schema
        df.write.option("compression", "zstd").parquet(at)
        self.written.setdefault(name, []).append(at)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(at)

    def save_large(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """`save` for rows of some MB: few are held at a time, and each value of `by` has files of its own."""
        at, schema = self.path(name), df.schema
        sizes = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1}
        df.write.options(compression="zstd", **sizes).partitionBy(by).parquet(at)
        self.written.setdefault(name, []).append(at)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(at)

    def release(self) -> None:
        """Let the driver forget finished shuffles, so that their files go from the executors' disks."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.written.pop(name, []):
                fs, at = _fs(self.spark, path)
                fs.delete(at, True)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def text_key(*columns: Column) -> Column:
    """64 bits of the columns' content; nulls count as a value of their own."""
    return F.xxhash64(*[F.struct(c.isNull(), c) for c in columns])


# --- words of UTF-8 text, many documents at a time -------------------------------------------

#: The white space of the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_EXACT = np.random.RandomState(20240607).randint(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of a public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and inverse powers: (sums[e] - sums[s]) * inverse[s] hashes codes[s:e].

    For candidates only: runs of 1,024 codes and more can collide by design.
    """
    power, inverse = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[:-1], out=sums[1:])
    return sums, inverse


#: Spans up to so many bytes are hashed together, eight bytes a round; longer ones by the library.
SHORT_SPAN = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; `fold` lower-cases A-Z.

    Not a polynomial: modulo 2^64 there are texts that collide in any of those.
    """
    if fold:
        data = _FOLD[data]
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x51_7C_C1_B7_27_22_0A_95))
    if not len(size):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    long = size > SHORT_SPAN
    live, done = np.flatnonzero((size > 0) & ~long), 0
    while len(live):
        rest = size[live] - done
        piece = eight[start[live] + done]
        short = rest < 8
        piece[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[live] = mix((out[live] ^ piece) * np.uint64(_BASE) + np.uint64(done + 1))
        live, done = live[rest > 8], done + 8
    if long.any():
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


class Words:
    """Words of consecutive documents: `doc` (index in the chunk), `start`, `end` (bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | first[1:n]
        last = inside
        last[:-1] &= ~inside[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.docs = len(offsets) - 1
        self.per_doc = np.bincount(self.doc, minlength=self.docs)

    def hashes(self, fold: bool) -> np.ndarray:
        """A 64-bit hash per word; `fold` lower-cases A-Z."""
        return span_hashes(self.data, self.start, self.end, fold)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words of one document, and the index of their first word."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total *= np.uint64(_BASE)
        total += hashes[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and end row, bytes and offsets of runs of rows of about `size` bytes; null is empty."""
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, where, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    where = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + size, "right")) - 1)
        yield lo, hi, data[where[lo] : where[hi]], where[lo : hi + 1] - where[lo]
        lo = hi


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """v, comp: the smallest vertex reachable over `links` (a, b), for every vertex with a link.

    Contraction: every component hooks onto its smallest neighbour, pointers are
    halved until they rest, links are relabelled and inner ones dropped.  Each
    round at least halves the components that still have links; nothing but row
    counts comes to the driver.
    """
    pairs = links.select("a", "b")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.save(both.filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = scratch.save(edges.select(F.col("a").alias("v"), F.col("a").alias("comp")).distinct(), "labels")
    while edges.take(1):
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        up = scratch.save(low.select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "parents")
        while True:
            over = up.select(F.col("v").alias("w"), F.col("p").alias("pp"))
            jumped = up.join(over, F.col("p") == F.col("w"), "left").select("v", F.coalesce("pp", "p").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            held = scratch.save(jumped, "jumped")
            up = held.select("v", "p")
            if not held.filter("moved").take(1):
                break
        root = up.select(F.col("v").alias("c"), F.col("p").alias("root"))
        labels = scratch.save(
            labels.join(root, F.col("comp") == F.col("c"), "left").select("v", F.coalesce("root", "comp").alias("comp")), "labels"
        )
        ra, rb = root.withColumnsRenamed({"c": "a", "root": "ra"}), root.withColumnsRenamed({"c": "b", "root": "rb"})
        moved = edges.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = scratch.save(moved.filter(F.col("a") != F.col("b")).distinct(), "edges")
    scratch.drop("edges", "parents", "jumped")
    return labels

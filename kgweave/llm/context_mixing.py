"""Language-model scores by online logistic context mixing.

Text is a sequence of binary decisions: each byte (and the end of the text) is
coded by the prefix code of the training bytes' frequencies, about four decisions
a byte.  For each decision, predictors of several orders look up their context
(the last 1 to 6 bytes and the place in the code) and give the log odds seen in
training.  A mixer adds them by weights, which a gate picks
by how many orders know their context; after each decision the weights move along
the coding loss.  The mix is refined by an adaptive map from its log odds to the
rate of ones seen since.  Mixer and map start anew with each document and last to
its end, and a score does not depend on what else a task holds.

The table is learned from all training documents and grows with them: it holds, for
every context of every order, how often each symbol followed it, exactly (six bytes
and the order fit a key, so nothing is hashed together).  The most frequent contexts
(at most HOT_PAIRS counts) are broadcast; documents ask in batches, and a batch's
other distinct contexts go to the table's buckets as one packed list each, some batches a
round, so that no row is made of a context or a count.  Beside it stands an add-0.1
unigram model over words, exact: common words (at most COMMON, broadcast) are counted in
place, the rest by a join.

The loops over bytes are ContextMixing.java: counting, asking, answering, odds and mixer.
`code_bits` says the same as array operations over a chunk, and is what the tests hold
the Java code against.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch, Words, text_chunks
from kgweave.llm.jvm import java_function

ORDERS = (1, 2, 3, 4, 6)
#: A hashed table in place of the exact one, for callers of code_bits that bring their own odds.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
#: Bits of a symbol behind its context in a packed key.
SYMBOL_BITS = 9
#: (context, symbol) counts that are broadcast, at most; the others are joined.
HOT_PAIRS = 1 << 21
#: Contexts are dealt to a bucket for so many bytes of text, and to so many at least.
BUCKET_BYTES = 4 << 20
BUCKETS = 32
#: Decisions laid out at a time, of so many steps at least, and lanes that run side by side.
WINDOW = 1 << 17
STEPS = 64
LANES = 4096
#: Documents that are not worth two runs.
FEW = 512
#: Asked pairs whose odds are found at a time.
ODDS_PAIRS = 1 << 17
RATE, REFINE_RATE, START = 0.01, 0.02, 0.3
LEAST_P = 1 / 65536
COMMON = 65_536
FOLDS = 10
END = 256
#: The hash of the end token, beside those of words.
END_TOKEN = 1
#: Bytes of text whose words are held at a time while it is scored.
SCORE_BYTES = 1 << 19
#: Documents of so many bytes, by doublings of it, run beside those of other tasks, about POOL_BYTES together.
LONG_BYTES = 1 << 14
POOL_BYTES = 2 << 20
#: Bytes and number of texts that are counted, ask the table (each context once) and are scored together.
ASK_BYTES = 12 << 20
BATCH_ROWS = 1 << 16
#: Texts, and what their batches are told, are shuffled in rounds of so many bytes of text or in ROUNDS, so that not all of it lies on disk at once.
ROUND_BYTES = 1 << 29
ROUNDS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: object) -> bool:
    """Whether crc32 of the id as text (null: empty) leaves no remainder by FOLDS."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


# --- the prefix code ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Code:
    """Per symbol: number of decisions, and node and bit of each (rows padded)."""

    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @cached_property
    def rank(self) -> np.ndarray:
        """Symbols' places in the order of their codes: those under one node stand together, its zeros first."""
        return np.argsort(np.lexsort(self.bit.T[::-1]))

    @cached_property
    def split(self) -> np.ndarray:
        """By node, the least rank behind its one."""
        ones = (self.bit > 0) & (np.arange(self.bit.shape[1]) < self.length[:, None])
        least = np.full(len(self.length), len(self.length))
        np.minimum.at(least, self.node[ones], np.broadcast_to(self.rank[:, None], ones.shape)[ones])
        return least


def prefix_code(counts: np.ndarray) -> Code:
    """The optimal prefix code of 257 symbols; unseen ones count as seen a little."""
    heap = [(max(float(c), 0.01), i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    fresh = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[2]], parent[b[2]] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths = []
    for symbol in range(len(counts)):
        path, at = [], symbol
        while at in parent:
            at, bit = parent[at]
            path.append((at - len(counts), bit))
        paths.append(path[::-1])
    longest = max(map(len, paths))
    node, bit = np.zeros((len(counts), longest), np.uint32), np.zeros((len(counts), longest), np.uint8)
    for symbol, path in enumerate(paths):
        node[symbol, : len(path)], bit[symbol, : len(path)] = zip(*path, strict=True)
    return Code(np.array(list(map(len, paths)), np.int64), node, bit)


# --- decisions and their contexts --------------------------------------------------------------


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of `x` in order; `x` is sorted in place."""
    x.sort()
    return x[_leads(x)]


def _leads(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.append(True, x[1:] != x[:-1])[: len(x)]


_SIX = (1 << 48) - 1


def _newest_lowest(x: np.ndarray, k: int) -> np.ndarray:
    """`k` bytes in the opposite order."""
    return (x << (64 - 8 * k)).byteswap() & ((1 << (8 * k)) - 1)


def _orders(last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: the distinct pairs that follow from those of the highest order, packed and sorted, and which of them each gives.

    `last` is sorted by symbol and then by the bytes before it from the last on, so that
    equal pairs of any order stand together.
    """
    for k in ORDERS:
        some = last >> (8 * (max(ORDERS) - k))
        lead = _leads(some)
        some = some[lead]
        context = _newest_lowest(some & ((1 << (8 * k)) - 1), k) | (k << 48)
        pair = (context << SYMBOL_BITS) | (some >> (8 * k))
        order = np.argsort(pair)
        place = np.empty(len(pair), np.int32)
        place[order] = np.arange(len(pair), dtype=np.int32)
        yield pair[order], place[np.cumsum(lead) - 1]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


class Symbols:
    """All symbols of a chunk's documents, each text between zeros and its end symbol."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        docs, pad = len(offsets) - 1, max(ORDERS)
        sizes = np.diff(offsets) + 1
        # Each text stands after zeros, so that no context reaches into another, and before its end symbol.
        self.starts = offsets[:-1] + np.arange(docs) * (pad + 1) + pad
        self.coded = np.arange(len(data) + docs) + np.repeat(np.arange(1, docs + 1) * pad, sizes)
        ends = np.cumsum(sizes) - 1
        text = np.ones(len(self.coded), bool)
        text[ends] = False
        self.now = np.full(len(self.coded), END, np.uint16)
        self.now[text] = _LOWER[data]

    @cached_property
    def symbols(self) -> np.ndarray:
        """The symbols between their zeros."""
        out = np.zeros(len(self.coded) + len(self.starts) * max(ORDERS), np.uint16)
        out[self.coded] = self.now
        return out

    def _before(self, newest_first: bool) -> np.ndarray:
        """The six bytes before each symbol as one number, the last byte lowest or, `newest_first`, highest."""
        # An end is before no symbol: as a byte it becomes zero.
        held = np.zeros(len(self.coded) + len(self.starts) * max(ORDERS) + 16, np.uint8)
        held[self.coded + 8] = self.now.astype(np.uint8)
        if newest_first:
            eight = np.ndarray((len(held) - 7,), "<i8", held, strides=(1,))[self.coded + 2]
        else:
            eight = np.ndarray((len(held) - 7,), ">i8", held, strides=(1,))[self.coded].astype(np.int64)
        eight &= _SIX
        return eight

    def last_pairs(self) -> np.ndarray:
        """Each symbol behind the highest order and its last bytes: from these the pairs of the others follow."""
        pairs = self._before(False)
        pairs |= max(ORDERS) << 48
        pairs <<= SYMBOL_BITS
        pairs |= self.now
        return pairs

    def pairs(self) -> Iterator[np.ndarray]:
        """By order: each symbol behind its order and its last bytes, packed into 60 bits."""
        context = self._before(False)
        for k in ORDERS:
            yield (((context & ((1 << (8 * k)) - 1)) | (k << 48)) << SYMBOL_BITS) | self.now

    def contexts(self) -> np.ndarray:
        """Distinct contexts in order; those of one order stand before those of the next."""
        last, out = _distinct(self._before(True)), []
        for k in ORDERS:
            some = last >> (8 * (max(ORDERS) - k))
            out.append(np.sort(_newest_lowest(some[_leads(some)], k) | (k << 48)))
        return np.concatenate(out)

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the highest order, as the symbol and the bytes before it, the last first, and which of them each symbol's is."""
        key = self._before(True)
        key |= self.now.astype(np.int64) << 48
        order = np.argsort(key)
        key = key[order]
        lead = _leads(key)
        number = np.empty(len(key), np.int32)
        number[order] = np.cumsum(lead, dtype=np.int32) - np.int32(1)
        return key[lead], number

    def numbered(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By order: the distinct pairs, and which of them each symbol's is."""
        last, number = self.ordered()
        for pair, which in _orders(last):
            yield pair, which[number]


class Decisions(Symbols):
    """All decisions of a chunk's documents: bit, first decision of each document, and slots by order.

    Kept by symbol; what has a row per decision is made when asked for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, code: Code):
        super().__init__(data, offsets)
        total = np.concatenate(([0], np.cumsum(code.length[self.now])))
        self.code, self.begin, self.total = code, total[:-1], int(total[-1])
        self.first = np.concatenate((total[np.searchsorted(self.coded, self.starts)], total[-1:]))

    @cached_property
    def place(self) -> np.ndarray:
        # Code rows one after the other: a decision's place is its symbol's row plus its step.
        rows = self.now.astype(np.int64) * self.code.node.shape[1]
        return np.arange(self.total) - np.repeat(self.begin - rows, self.code.length[self.now])

    @property
    def bit(self) -> np.ndarray:
        return self.code.bit.ravel()[self.place]

    def slots(self) -> Iterator[np.ndarray]:
        owner = np.repeat(np.arange(len(self.now), dtype=np.int32), self.code.length[self.now])
        node = (self.code.node.ravel() * np.uint32(0x9E3779B1))[self.place]
        back = (self.symbols.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        context = np.zeros(len(self.coded), np.uint32)
        for k in range(1, max(ORDERS) + 1):
            context = _scatter(context + back[self.coded - k] + np.uint32(k))
            if k in ORDERS:
                slot = context[owner]
                slot ^= node
                slot *= np.uint32(0x9E3779B1)
                slot >>= np.uint32(32 - SLOT_BITS)
                yield slot


# --- training ----------------------------------------------------------------------------------


def _train_rows(ids: pa.Array) -> np.ndarray:
    return np.array([not held_out(i) for i in ids.to_pylist()], bool)


def _only(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pa.array(_train_rows(batch.column("doc_id"))))


def _sizes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _length_class(size: np.ndarray) -> np.ndarray:
    """Doublings of LONG_BYTES below each size; -1 for shorter ones."""
    return np.maximum(np.frexp(size / LONG_BYTES)[1].astype(np.int64) - 1, -1)


def count_symbols(docs: DataFrame) -> DataFrame:
    """kind, token, count over the training documents: words (kind 0) and bytes (kind 1); bytes of all by class of length (kind 2)."""

    def run(batches):
        for batch in batches:
            size = _sizes(batch.column("text"))
            kinds, which = np.unique(_length_class(size), return_inverse=True)
            long = np.bincount(which, size, len(kinds)).astype(np.int64)
            batch = _only(batch)
            tokens, bytes_ = [np.full(batch.num_rows, END_TOKEN, np.uint64)], np.zeros(257, np.int64)
            bytes_[END] = batch.num_rows
            for *_, data, offsets in text_chunks(batch.column("text")):
                tokens.append(Words(data, offsets).hashes(fold=True))
                bytes_[:256] += np.bincount(_LOWER[data], minlength=256)
            token, count = np.unique(np.concatenate(tokens), return_counts=True)
            kind = np.repeat(np.arange(3, dtype=np.int32), (len(token), 257, len(kinds)))
            token = np.concatenate((token.view(np.int64), np.arange(257), kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(token), pa.array(np.concatenate((count, bytes_, long)))], names=["kind", "token", "count"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind int, token bigint, count bigint")
    return rows.groupBy("kind", "token").agg(F.sum("count").alias("count"))


def _code_bytes(code: Code) -> bytes:
    """The code as ContextMixing.java reads it."""
    parts = [code.node.shape[1]], code.length, code.rank, code.split[code.node].ravel(), code.bit.ravel()
    return np.concatenate(parts).astype("<i4").tobytes()


def _java(spark: SparkSession, name: str, returns: str, *args: object) -> Callable[..., Column]:
    return java_function(spark, "ContextMixing.java", f"kgweave.llm.ContextMixing${name}", returns, *args)


def pack(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """Texts in batches of about ASK_BYTES: batch, round, ids, bytes and offsets (longs) of the texts, and a byte for each to learn from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    most_bytes, most_rows = ASK_BYTES, BATCH_ROWS

    def row(held, name):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = batch.column("doc_id")
        ((*_, data, offsets),) = text_chunks(batch.column("text"), 1 << 62)
        columns = {
            "batch": pa.array([name], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "data": pa.array([data.tobytes()], pa.binary()),
            "offsets": pa.array([offsets.tobytes()], pa.binary()),
            "train": pa.array([_train_rows(ids).astype(np.uint8).tobytes()], pa.binary()),
            "round": pa.array([zlib.crc32(name.to_bytes(8, "little")) % rounds], pa.int32()),
        }
        return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    def run(batches):
        name, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
        for lot in batches:
            for batch in (lot.slice(lo, most_rows) for lo in range(0, lot.num_rows, most_rows)):
                for lo, hi, data, _ in text_chunks(batch.column("text"), most_bytes):
                    if held and (size + len(data) > most_bytes or rows + hi - lo > most_rows):
                        yield row(held, name)
                        name, held, size, rows = name + 1, [], 0, 0
                    # What is less than a batch waits for more texts.
                    held.append(batch.slice(lo, hi - lo))
                    size, rows = size + len(data), rows + hi - lo
        if held:
            yield row(held, name)

    return docs.select("doc_id", "text").mapInArrow(run, f"batch bigint, ids array<{kind}>, data binary, offsets binary, train binary, round int")


def count_pairs(batches: DataFrame, buckets: int, scratch: Scratch) -> DataFrame:
    """bucket, pairs, counts: how often each symbol followed each context in the training documents, sorted (longs).

    A batch counts pairs of the highest order, and those of the others as sums of them; all
    pairs of a context lie in its bucket.
    """
    count = _java(batches.sparkSession, "Count", "array<binary>", buckets)
    merge = _java(batches.sparkSession, "Merge", "struct<pairs: binary, counts: binary>")
    lists = batches.select(count("data", "offsets", "train").alias("lists")).select(F.posexplode("lists").alias("bucket", "list"))
    some = lists.filter(F.length("list") > 0).repartition("bucket").groupBy("bucket").agg(F.collect_list("list").alias("lists"))
    return scratch.save(some.select("bucket", merge("lists").alias("all")).select("bucket", "all.pairs", "all.counts"), "pairs")


def list_contexts(table: DataFrame) -> DataFrame:
    """context, total, seen: the rows of `count_pairs` context by context."""

    def run(batches):
        for batch in batches:
            for pairs, counts in zip(batch.column("pairs"), batch.column("counts"), strict=True):
                pairs, counts = (np.frombuffer(x.as_buffer(), np.int64) for x in (pairs, counts))
                edges = np.append(np.flatnonzero(_leads(pairs >> SYMBOL_BITS)), len(pairs))
                for lo in range(0, len(edges) - 1, ODDS_PAIRS):
                    lead = edges[lo : lo + ODDS_PAIRS + 1]
                    key, n, lead = pairs[lead[0] : lead[-1]], counts[lead[0] : lead[-1]], lead - lead[0]
                    symbol = (key & ((1 << SYMBOL_BITS) - 1)).astype(np.int16)
                    seen = pa.StructArray.from_arrays([pa.array(symbol), pa.array(n)], names=["symbol", "n"])
                    lists = pa.ListArray.from_arrays(pa.array(lead, pa.int32()), seen)
                    yield pa.RecordBatch.from_arrays([pa.array(key[lead[:-1]] >> SYMBOL_BITS), pa.array(np.add.reduceat(n, lead[:-1])), lists], names=["context", "total", "seen"])

    return table.select("pairs", "counts").mapInArrow(run, "context bigint, total bigint, seen array<struct<symbol: smallint, n: bigint>>")


def count_contexts(docs: DataFrame, code: Code | None = None, scratch: Scratch | None = None) -> DataFrame:
    """context, total, seen: how often each symbol followed each context in the training documents.

    Whole symbols are counted, so no `code` is needed.
    """
    return list_contexts(count_pairs(pack(docs), BUCKETS, scratch or Scratch(docs.sparkSession, "mixing")))


def hot_contexts(contexts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted packed keys and counts of the most frequent contexts, at most HOT_PAIRS of them."""
    level = F.floor(F.log2("total") * 8)
    sizes = contexts.groupBy(level.alias("level")).agg(F.sum(F.size("seen")).alias("pairs")).orderBy(F.desc("level")).collect()  # 8 rows a doubling
    least, room = None, HOT_PAIRS
    for row in sizes:
        room -= row["pairs"]
        if room < 0:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = contexts.filter(level >= F.lit(least)).select("context", F.inline("seen")).toArrow()
    key = (found["context"].to_numpy() << SYMBOL_BITS) | found["symbol"].to_numpy()
    order = np.argsort(key)
    return key[order], found["n"].to_numpy()[order]


# --- scoring -----------------------------------------------------------------------------------

_CENTRES = np.arange(-8, 8.5, 0.5).astype(np.float32)
_HALF = np.float32(0.5)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def ranked(table: tuple[np.ndarray, np.ndarray], code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys and counts by context and rank, sorted, and the counts' running sums."""
    keys, counts = table
    keys = ((keys >> SYMBOL_BITS) << SYMBOL_BITS) | code.rank[keys & ((1 << SYMBOL_BITS) - 1)]
    order = np.argsort(keys)
    return keys[order], np.concatenate(([0], np.cumsum(counts[order])))


def _odds(ones, zeros):
    return np.clip(np.log((ones + 0.1) / (zeros + 0.1)), -9, 9).astype(np.float32)


class Exact:
    """Log odds of decisions from counts of (context, symbol), in tables of packed keys that share no context.

    `ready` are tables that `ranked` has made.
    """

    def __init__(self, *tables: tuple[np.ndarray, np.ndarray], ready: tuple[tuple[np.ndarray, np.ndarray], ...] = ()):
        self.tables, self.ready = tables, list(ready)

    def _of_pairs(self, pairs: np.ndarray, code: Code, value: np.ndarray) -> None:
        """Of sorted distinct pairs, one value per step of each; those where no training document came by are left."""
        self.ready += [ranked(t, code) for t in self.tables]
        self.tables = ()
        done = 0
        for lo in range(0, len(pairs), ODDS_PAIRS):
            pair = pairs[lo : lo + ODDS_PAIRS]
            contexts, symbol = pair >> SYMBOL_BITS, pair & ((1 << SYMBOL_BITS) - 1)
            lead = _leads(contexts)
            owner = np.cumsum(lead) - 1
            met = contexts[lead] << SYMBOL_BITS
            size = code.length[symbol]
            first = done + np.cumsum(size) - size
            done += int(size.sum())
            for keys, sums in self.ready:
                low, high = np.searchsorted(keys, met), np.searchsorted(keys, met + (1 << SYMBOL_BITS))
                some = np.flatnonzero((high > low)[owner])
                if len(some):
                    self._of_table(keys, sums, low[owner[some]], high[owner[some]], contexts[some] << SYMBOL_BITS, symbol[some], size[some], first[some], code, value)

    def _of_table(self, keys, sums, a, b, context, symbol, size, first, code: Code, value: np.ndarray) -> None:
        """`_of_pairs` for pairs whose contexts stand at `a` to `b` of a table."""
        width, splits, bits = code.node.shape[1], code.split[code.node].ravel(), code.bit.ravel()
        rank, step, alone = code.rank[symbol], 0, []
        # Counts under a node stand together: from step to step, those before or after the split stay.
        while len(size):
            # Nothing but the symbol itself is left: all further steps are alike.
            at = keys[a] & ((1 << SYMBOL_BITS) - 1)
            one = (b - a == 1) & (at == rank)
            alone.append((first[one] + step, size[one] - step, symbol[one] * width + step, (sums[b] - sums[a])[one]))
            symbol, context, size, first, rank, a, b, at = (x[~one] for x in (symbol, context, size, first, rank, a, b, at))
            place = symbol * width + step
            split = splits[place]
            middle = np.where(at >= split, a, b)
            more = np.flatnonzero(b - a > 1)
            middle[more] = np.searchsorted(keys, context[more] | split[more])
            low, mid, high = sums[a], sums[middle], sums[b]
            value[first + step] = _odds(high - mid, mid - low)
            bit = bits[place] > 0
            a, b = np.where(bit, middle, a), np.where(bit, b, middle)
            step += 1
            keep = (size > step) & (b > a)
            symbol, context, size, first, rank, a, b = (x[keep] for x in (symbol, context, size, first, rank, a, b))
        first, size, place, n = map(np.concatenate, zip(*alone, strict=True))
        more = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ones, zeros = _odds(n, 0), _odds(0, n)
        bit = bits[np.repeat(place, size) + more] > 0
        value[np.repeat(first, size) + more] = np.where(bit, np.repeat(ones, size), np.repeat(zeros, size))

    def laid_out(self, seen: Decisions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row per decision of each distinct pair of the highest order, the decisions' rows, and which documents know all inputs."""
        code = seen.code
        last, number = seen.ordered()
        size = code.length[last >> 48]
        base = np.cumsum(size) - size
        rows = int(size.sum())
        kind = np.int32 if max(rows, seen.total) < 1 << 31 else np.int64
        step = np.arange(rows, dtype=kind)
        step -= np.repeat(base.astype(kind), size)
        at = np.repeat(((last >> 48) * code.bit.shape[1]).astype(kind), size)
        at += step
        table = _table(rows, code.bit.ravel().take(at))
        del at
        for i, (pair, which) in enumerate(_orders(last)):
            sizes = code.length[pair & ((1 << SYMBOL_BITS) - 1)]
            value = np.full(sizes.sum(), np.nan, np.float32)
            self._of_pairs(pair, code, value)
            at = np.repeat((np.cumsum(sizes) - sizes).astype(kind)[which], size)
            at += step
            _fill(table, i, value.take(at))
        del at, step, value, pair, which, last
        known = np.minimum.reduceat(table[:-1, len(ORDERS) + 1], base) == len(ORDERS) if rows else np.zeros(0, bool)
        whole = np.logical_and.reduceat(known[number], np.searchsorted(seen.coded, seen.starts)) if rows else known
        first = base.astype(kind)[number]
        del number
        first -= seen.begin.astype(kind)
        where = np.repeat(first, code.length[seen.now])
        del first
        for lo in range(0, seen.total, WINDOW):
            some = where[lo : lo + WINDOW]
            some += np.arange(lo, lo + len(some), dtype=kind)
        return table, where, whole


def _table(rows: int, bit: np.ndarray) -> np.ndarray:
    """Rows of decisions: an input per order, the bit, and how many inputs are known; the last row stands for none."""
    k = len(ORDERS)
    out = np.zeros((rows + 1, 8 * -(-(k + 2) // 8)), np.float32)
    out[:rows, k] = bit
    out[rows, k] = -1
    return out


def _fill(table: np.ndarray, i: int, value: np.ndarray) -> None:
    """An order's values; an unknown one adds nothing."""
    known = ~np.isnan(value)
    table[:-1, len(ORDERS) + 1] += known
    value[~known] = 0
    table[:-1, i] = value


def code_bits(seen: Decisions, odds: np.ndarray | Exact) -> np.ndarray:
    """The plain form of ContextMixing.Score: bits that the mixed model spends on each document of the chunk, by exact odds or odds per slot.

    Each document is a lane from its first decision to its last, the longest lane
    first; step t of all lanes that reach it is one set of array operations.  Only
    the steps of a window are laid out as decisions, of at most LANES lanes.
    Documents with no unknown input (all training documents) use one set of weights
    and run apart from the others.
    """
    if isinstance(odds, Exact):
        table, where, whole = odds.laid_out(seen)
    else:
        table, where = _table(seen.total, seen.bit), np.arange(seen.total)
        for i, slot in enumerate(seen.slots()):
            _fill(table, i, odds.take(slot))
        whole = np.minimum.reduceat(table[:-1, len(ORDERS) + 1], seen.first[:-1]) == len(ORDERS)
    firsts, sizes = seen.first[:-1], np.diff(seen.first)
    del seen  # large, and not needed any more
    out = np.empty(len(sizes))
    if not len(sizes):
        return out
    # Few documents cost less side by side, for a step of an array takes its time however short it is.
    runs = ((_run_known, np.flatnonzero(whole)), (_run_gated, np.flatnonzero(~whole)))
    if len(sizes) < FEW and not whole.all():
        runs = ((_run_gated, np.arange(len(sizes))),)
    for run, docs in runs:
        order = docs[np.argsort(-sizes[docs], kind="stable")]
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            out[lanes] = run(table, where, firsts[lanes], sizes[lanes])
    return out


def _windows(table: np.ndarray, where: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table by step and lane, some steps of all lanes that reach them at a time; after a lane's end, the last row."""
    wide = table.view(f"V{table.itemsize * table.shape[1]}")[:, 0]
    none, t = len(table) - 1, 0
    while t < sizes[0]:
        live = int(np.searchsorted(-sizes, -t))
        steps = min(max(STEPS, WINDOW // live), int(sizes[0]) - t)
        at = np.arange(steps)[:, None] + (first[:live] + t)
        short = int(np.searchsorted(-sizes, -(t + steps), "right"))
        over = np.arange(steps)[:, None] >= sizes[short:live] - t
        at = where.take(at, mode="clip").astype(np.int64, copy=False)
        at[:, short:][over] = none
        yield wide.take(at, mode="clip").view(np.float32).reshape(steps, live, -1)
        t += steps


def _spent(chance: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bits that lanes spend in a window; a bit under 0 is none."""
    np.clip(chance, LEAST_P, 1 - LEAST_P, out=chance)
    right = np.where(bit > 0, chance, 1 - chance)
    right[bit < 0] = 1
    return -np.log2(right).sum(axis=0, dtype=np.float64)


def _run_known(table: np.ndarray, where: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`code_bits` of documents by their first decisions and sizes, the longest first; all their inputs are known."""
    n, k = len(sizes), len(ORDERS)
    w = np.full((k, n), START, np.float32)
    refine = np.tile(_squash(_CENTRES), n)
    spent = np.zeros(n)
    add, subtract, multiply, rint, least, most = np.add, np.subtract, np.multiply, np.rint, np.minimum, np.maximum
    for rows in _windows(table, where, first, sizes):
        live = rows.shape[1]
        xs = np.ascontiguousarray(rows.transpose(0, 2, 1)[:, : k + 1])
        w = np.ascontiguousarray(w[:, :live])
        cells = np.arange(live) * len(_CENTRES) + 16
        chance = np.empty((len(xs), live), np.float32)
        parts, cell = np.empty((k, live), np.float32), np.empty(live, np.int64)
        one, rate, faster, two, low, high = (np.full(live, x, np.float32) for x in (1, RATE, REFINE_RATE, 2, -16, 16))
        dot, p, by = np.empty((3, live), np.float32)
        part = list(parts)
        for x, out in zip(xs, chance, strict=True):
            bit, x = x[k], x[:k]
            multiply(w, x, parts)
            add(part[0], part[4], dot)
            add(dot, part[1], dot)
            add(part[2], part[3], p)
            add(dot, p, dot)
            np.negative(dot, p)
            np.exp(p, p)
            add(p, one, p)
            np.reciprocal(p, p)
            subtract(bit, p, by)
            multiply(by, rate, by)
            multiply(x, by, x)
            add(w, x, w)
            # The nearest cell of the adaptive map.
            multiply(dot, two, dot)
            rint(dot, dot)
            most(dot, low, dot)
            least(dot, high, dot)
            cell[...] = dot
            add(cell, cells, cell)
            refine.take(cell, None, by, "clip")
            add(p, by, out)
            subtract(bit, by, p)
            multiply(p, faster, p)
            add(p, by, p)
            refine[cell] = p
        chance *= _HALF
        spent[:live] += _spent(chance, xs[:, k])
    return spent


def _run_gated(table: np.ndarray, where: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """`_run_known` with a set of weights for each number of known inputs."""
    n, k = len(sizes), len(ORDERS)
    weights = np.full((n * (k + 1), k), START, np.float32)
    held = weights.view(f"V{weights.itemsize * k}")[:, 0]  # a row is put back as one value
    refine = np.tile(_squash(_CENTRES), n)
    spent = np.zeros(n)
    add, subtract, multiply, rint, least, most = np.add, np.subtract, np.multiply, np.rint, np.minimum, np.maximum
    for rows in _windows(table, where, first, sizes):
        live = rows.shape[1]
        xs, now = np.ascontiguousarray(rows[:, :, :k]), np.ascontiguousarray(rows[:, :, k])
        cells = np.arange(live) * len(_CENTRES) + 16
        gate = rows[:, :, k + 1].astype(np.int64) + np.arange(live) * (k + 1)
        chance = np.empty_like(now)
        w, dot, p, by = np.empty((live, k), np.float32), *np.empty((3, live), np.float32)
        one, rate, faster, two, low, high = (np.full(live, x, np.float32) for x in (1, RATE, REFINE_RATE, 2, -16, 16))
        put, cell = w.view(held.dtype)[:, 0], np.empty(live, np.int64)
        for x, bit, row, out in zip(xs, now, gate, chance, strict=True):
            weights.take(row, 0, w, "clip")
            np.einsum("ij,ij->i", w, x, out=dot)
            np.negative(dot, p)
            np.exp(p, p)
            add(p, one, p)
            np.reciprocal(p, p)
            subtract(bit, p, by)
            multiply(by, rate, by)
            multiply(x, by[:, None], x)
            add(w, x, w)
            held[row] = put
            multiply(dot, two, dot)
            rint(dot, dot)
            most(dot, low, dot)
            least(dot, high, dot)
            cell[...] = dot
            add(cell, cells, cell)
            refine.take(cell, None, by, "clip")
            add(p, by, out)
            subtract(bit, by, p)
            multiply(p, faster, p)
            add(p, by, p)
            refine[cell] = p
        chance *= _HALF
        spent[:live] += _spent(chance, now)
    return spent


def _key(ids: pa.Array, words: Words, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray, lo: int) -> np.ndarray:
    """64 bits of each document's id and bytes."""
    from kgweave.llm.common import mix, span_hashes

    texts = span_hashes(data, offsets[:-1], offsets[1:])
    names = np.array([zlib.crc32(str(i).encode()) for i in ids.slice(lo, words.docs).to_pylist()], np.uint64)
    return mix(texts + names * np.uint64(0x9E3779B97F4A7C15))


def _by_length(texts: pa.Array) -> pa.Array:
    """Places of the texts, the shortest first: texts that run side by side should end together."""
    return pa.array(np.argsort(_sizes(texts), kind="stable"))


def _dealt(texts: pa.Array, part: int, number: int, pools: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """First and end row and name of each batch of texts, the longest text first.

    A task has few long texts: they go to batches that tasks share, one of the `pools` of their class of length.
    """
    classes = _length_class(_sizes(texts))
    edges = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])[: len(classes)]).tolist()
    for first, end in zip(edges, [*edges[1:], len(classes)], strict=True):
        k = int(classes[first])
        for i, (lo, hi, *_) in enumerate(text_chunks(texts.slice(first, end - first), ASK_BYTES if k < 0 else POOL_BYTES)):
            name = part << 32 | (number + i) if k < 0 else -1 - (k << 32 | (part + number + i) % pools[k])
            yield first + lo, first + hi, name


def score_documents(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the documents that are not held out, scores all.  A-Z are lower
    case to both models.  Null text is empty: its end alone is scored.  A null
    doc_id hashes as the empty text.  Repeated rows count each time they occur and
    get one score each.  With nothing to learn from, all words are unknown and all
    contexts new.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    plain = docs.select("doc_id", "text")
    counted = scratch.save(count_symbols(plain), "counts")
    counts = counted.filter("kind = 0").select("token", "count")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    seen_bytes = np.zeros(257, np.int64)
    for row in counted.filter("kind = 1").collect():  # 257 rows
        seen_bytes[row["token"]] = row["count"]
    code = prefix_code(seen_bytes)
    size = sum(row["count"] for row in counted.filter("kind = 2").collect())  # a row a doubling
    rounds = min(ROUNDS, max(1, -(-size // ROUND_BYTES)))
    buckets = max(BUCKETS, -(-size // BUCKET_BYTES))
    # At most COMMON rows, and HOT_PAIRS counts.
    common = counts.orderBy(F.desc("count"), "token").limit(COMMON).toPandas()
    common = common.sort_values("token")
    tokens = spark.sparkContext.broadcast((common["token"].to_numpy(), common["count"].to_numpy(np.int64)))
    batches = scratch.save_large(pack(plain, rounds), "batches", "round")
    table = count_pairs(batches, buckets, scratch)
    key, n = hot_contexts(list_contexts(table))
    hot = spark.sparkContext._jsc.broadcast(zlib.compress(np.concatenate((np.diff(key, prepend=0), n)).astype("<i8").tobytes(), 1))
    name = uuid.uuid4().hex
    ask = _java(spark, "Ask", "array<binary>", buckets, hot, name, _code_bytes(code))
    tell = _java(spark, "Tell", "array<struct<batch: bigint, list: binary>>")
    score = _java(spark, "Score", "binary", hot, name, _code_bytes(code), RATE, REFINE_RATE, START, LEAST_P)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def lookup(hashes):
        names, values = tokens.value
        at = np.searchsorted(names, hashes.view(np.int64))
        at[at == len(names)] = 0
        found = names[at] == hashes.view(np.int64) if len(names) else np.zeros(len(hashes), bool)
        return found, values[at] if len(names) else np.zeros(len(hashes), np.int64)

    def rows(ids, texts, bits):
        """What is known of a batch's documents, and the rare words of each."""
        for lo, hi, data, offsets in text_chunks(texts, SCORE_BYTES):
            words = Words(data, offsets)
            hashes = words.hashes(fold=True)
            key = _key(ids, words, hashes, data, offsets, lo)
            # The end token is of this chunk's every document.
            every = np.append(hashes, np.array([END_TOKEN], np.uint64))
            found, c = lookup(every)
            logs = np.where(found, np.log10(c + 0.1), 0.0)
            base = np.bincount(words.doc, logs[:-1], words.docs) + logs[-1] + (0 if found[-1] else np.log10(0.1))
            known = np.bincount(words.doc, found[:-1], words.docs).astype(np.int64) + int(found[-1])
            held = np.array([held_out(i) for i in ids.slice(lo, hi - lo).to_pylist()], bool)
            h, d = hashes[~found[:-1]], words.doc[~found[:-1]]
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            lead = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[: len(h)])
            times = np.diff(np.append(lead, len(h)))
            ends = np.concatenate(([0], np.cumsum(np.bincount(d[lead], minlength=words.docs))))
            rare = pa.StructArray.from_arrays([pa.array(h[lead].view(np.int64)), pa.array(times.astype(np.int32))], names=["token", "times"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
            columns = [key.view(np.int64), held, words.per_doc + 1, known, base, bits[lo:hi], np.diff(offsets)]
            names = ["doc_id", "k", "held_out", "n_tokens", "known", "base", "bits", "n_bytes", "rare"]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, columns), rare], names=names)

    def whole(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, offsets, bits = (batch.column(c)[i].as_buffer() for c in ("data", "offsets", "bits"))
                where = pa.py_buffer(np.frombuffer(offsets, np.int64).astype(np.int32))
                ids = batch.column("ids")[i].values
                yield from rows(ids, pa.Array.from_buffers(pa.binary(), len(ids), [None, where, data]), np.frombuffer(bits, np.float64))

    owns = []
    for k in range(rounds):
        some = batches.filter(F.col("round") == k)
        asks = some.select("batch", ask("data", "offsets").alias("asks")).select("batch", F.posexplode("asks").alias("bucket", "asks"))
        asked = asks.filter(F.length("asks") > 0).repartition("bucket").groupBy("bucket").agg(F.collect_list(F.struct("batch", "asks")).alias("asks"))
        told = asked.join(table, "bucket").select(tell("pairs", "counts", "asks").alias("told")).select(F.inline("told"))
        heard = told.repartition("batch").groupBy("batch").agg(F.collect_list("list").alias("lists"))
        scored = some.join(heard, "batch", "left").select("ids", "data", "offsets", score("data", "offsets", "lists").alias("bits"))
        found = scored.mapInArrow(
            whole,
            f"doc_id {kind}, k bigint, held_out boolean, n_tokens bigint, known bigint, base double, bits double, n_bytes bigint, rare array<struct<token: bigint, times: int>>",
        )
        owns.append(scratch.save(found, "own"))
    own = reduce(DataFrame.unionByName, owns)
    scratch.drop("batches", "pairs")
    met = own.select("k", F.inline("rare")).join(counts.withColumnRenamed("count", "c"), "token", "left")
    more = met.groupBy("k").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"),
    )
    # Equal rows have asked together.
    copies = own.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    joined = own.join(more, "k", "left").join(copies, "k")
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce(F.col("rest_known") / F.col("copies"), F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rest") / F.col("copies"), F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        F.try_divide("bits", "n_bytes").alias("bits_per_byte"),
    )

"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if it lies in a string of `width` bytes that also starts elsewhere.

1. *Anchors.*  In every ANCHOR_SPAN consecutive grams of GRAM bytes the smallest
   hash is an anchor; equal strings have equal anchors at equal places.  A window
   can only repeat if all its anchors occur elsewhere, so one shuffle of anchors
   leaves the few windows worth sorting.  What repeats within a batch is settled
   there, and an anchor sends one row per batch at most.
2. *Shards.*  The windows left go, with their bytes, to the shard of the smallest
   gram in them: equal windows meet.  Runs of windows with one smallest gram
   travel as one piece.
3. *Induced sorting.*  A shard's pieces are sorted as suffixes: LMS substrings are
   sorted by induction, named, and the string of names is ranked (its own
   recursion doubles ranks until they are unique or reach past `width`); then
   the L and S suffixes are induced from the sorted LMS suffixes.  The priority
   queues hold (position, common prefix with the one before) by first byte, and
   spill to disk; common prefixes follow the tuples through the induction as range
   minima.  A window with a common prefix of `width` with either neighbour repeats.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import _EXACT, Scratch, mix, prefix_hash, span_hashes, text_chunks

WIDTH = 400
GRAM = 64
ANCHOR_SPAN = 96
#: Bytes of pieces that are sorted together; one shard group larger than this is sorted alone.
SHARD_BYTES = 1 << 19
#: Tuples that the queues of one sort hold in memory; more go to disk.
QUEUE_TUPLES = 1 << 22
_TILE = 1 << 20
_FAR = np.int32(1 << 30)


# --- grams, anchors, windows -------------------------------------------------------------------


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every `span` consecutive values."""
    n = len(values)
    if n < span:
        return values[:0]
    blocks = -(-n // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def _smallest_at(grams: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest (first among equals) of every `span` consecutive grams."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    out = []
    last = len(grams) - span + 1
    for lo in range(0, last, _TILE):
        part = grams[lo : min(last, lo + _TILE) + span - 1]
        keyed = (part & np.uint64(0xFFFFFFFFFFC00000)) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_min(keyed, span) & np.uint64(0x3FFFFF)).astype(np.int64) + lo)
    return np.concatenate(out)


def _grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums, inverse = prefix_hash(_EXACT[data])
    return mix((sums[GRAM:] - sums[:n]) * inverse[:n])


def _anchors(grams: np.ndarray) -> np.ndarray:
    return np.unique(_smallest_at(grams, ANCHOR_SPAN))


def _text_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return mix(span_hashes(data, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, k (hash of the text), n_bytes, whole (sha256 of the text)."""

    def run(batches):
        for batch in batches:
            keys, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for *_, data, offsets in text_chunks(batch.column("text")):
                keys.append(_text_keys(data, offsets))
                sizes.append(np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), batch.column("whole")], names=["doc_id", "k", "n_bytes", "whole"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("whole"))
    return plain.mapInArrow(run, f"doc_id {kind}, k bigint, n_bytes bigint, whole string")


def repeated_anchors(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k, places: the places of each distinct text's anchors that occur elsewhere too."""

    def send(batches):
        for batch in batches:
            token, key, place = [], [], []
            for *_, data, offsets in text_chunks(batch.column(0)):
                keys = _text_keys(data, offsets)
                for d in np.flatnonzero(np.diff(offsets) >= width):
                    grams = _grams(data[offsets[d] : offsets[d + 1]])
                    at = _anchors(grams)
                    token.append(grams[at])
                    key.append(np.full(len(at), keys[d]))
                    place.append(at)
            if not token:
                continue
            token, key, place = np.concatenate(token), np.concatenate(key), np.concatenate(place)
            order = np.lexsort((place, key, token))
            token, key, place = token[order].view(np.int64), key[order], place[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
            token, key, place = token[new], key[new], place[new]
            lead = np.ones(len(token), bool)
            lead[1:] = token[1:] != token[:-1]
            run = np.cumsum(lead) - 1
            many = np.bincount(run)[run] > 1
            # kind 0: one occurrence; 1: a token with several here; 2: settled (token is no longer needed).
            kinds = np.where(many, 1, 0)[lead]
            out = [(token[lead], key[lead], place[lead], kinds), (key[many], key[many], place[many], np.full(int(many.sum()), 2))]
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32)), pa.array(columns[3].astype(np.int8))], names=["token", "k", "place", "kind"])

    def meet(batches):
        parts = [[b.column(i).to_numpy() for i in range(4)] for b in batches]
        if not parts:
            return
        token, key, place, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
        settled = kind == 2
        done_key, done_place = key[settled], place[settled]
        token, key, place, kind = token[~settled], key[~settled], place[~settled], kind[~settled]
        order = np.lexsort((place, key, token))
        token, key, place, kind = token[order], key[order], place[order], kind[order]
        lead = np.ones(len(token), bool)
        lead[1:] = token[1:] != token[:-1]
        new = lead.copy()
        new[1:] |= (key[1:] != key[:-1]) | (place[1:] != place[:-1])
        run = np.cumsum(lead) - 1
        weight = np.bincount(run, weights=np.where(kind == 1, 2, new)) if len(run) else np.zeros(0)
        hit = (weight[run] > 1) & (kind == 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((done_key, key[hit]))), pa.array(np.concatenate((done_place, place[hit])))], names=["k", "place"])

    sent = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(send, "token bigint, k bigint, place int, kind byte").repartition("token")
    return sent.mapInArrow(meet, "k bigint, place int").groupBy("k").agg(F.collect_set("place").alias("places"))


def _pieces(data: np.ndarray, places: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(smallest gram, first start, starts) of runs of windows whose anchors all repeat."""
    grams = _grams(data)
    n = len(data) - width + 1
    if n <= 0:
        return []
    # Only anchors chosen wholly inside a window are sure to be chosen in its copies.
    chosen = _smallest_at(grams, ANCHOR_SPAN)
    again = np.zeros(len(grams), bool)
    again[places] = True
    alone = np.concatenate(([0], np.cumsum(~again[chosen])))
    span = width - GRAM + 1
    inside = span - ANCHOR_SPAN + 1
    open_ = alone[inside : inside + n] == alone[:n]
    small = _smallest_at(grams, span)
    starts = np.flatnonzero(open_)
    if not len(starts):
        return []
    edge = np.ones(len(starts), bool)
    edge[1:] = (starts[1:] != starts[:-1] + 1) | (small[starts[1:]] != small[starts[:-1]])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(starts)))
    return list(zip(grams[small[starts[first]]].view(np.int64).tolist(), starts[first].tolist(), count.tolist(), strict=True))


def shard_pieces(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """gram, k, at, starts, piece for every run of windows left of `texts` (k, text, places)."""

    def run(batches):
        for batch in batches:
            keys, places = batch.column("k").to_pylist(), batch.column("places")
            rows = []
            size = 0
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                same = _text_keys(data, offsets)
                for d in range(hi - lo):
                    if same[d] != keys[lo + d]:
                        continue
                    own = data[offsets[d] : offsets[d + 1]]
                    for gram, at, count in _pieces(own, places[lo + d].values.to_numpy(), width):
                        piece = own[at : at + count + width - 1].tobytes()
                        rows.append((gram, keys[lo + d], at, count, piece))
                        size += len(piece)
                    if size > 4 << 20:
                        yield _piece_batch(rows)
                        rows, size = [], 0
            if rows:
                yield _piece_batch(rows)

    return texts.select("k", "text", "places").mapInArrow(run, "gram bigint, k bigint, at int, starts int, piece binary")


def _piece_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "k", "at", "starts", "piece"])


# --- induced sorting ---------------------------------------------------------------------------


class Buckets:
    """Priority queues by first symbol: tuples (position, common prefix) leave in the order they came.

    Tuples beyond `limit` in memory are appended to one file per bucket.
    """

    def __init__(self, symbols: int, folder: str | None, limit: int = QUEUE_TUPLES):
        self.held: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.size, self.folder, self.limit = 0, folder, limit

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.held[symbol].append(tuples)
        self.size += len(tuples)
        if self.size > self.limit:
            self._spill()

    def _file(self, symbol: int) -> str:
        self.folder = self.folder or tempfile.mkdtemp(prefix="queue-")
        return os.path.join(self.folder, str(symbol))

    def _spill(self) -> None:
        for symbol, chunks in enumerate(self.held):
            if chunks:
                with open(self._file(symbol), "ab") as out:
                    np.concatenate(chunks).tofile(out)
                self.held[symbol] = []
        self.size = 0

    def pop(self, symbol: int) -> np.ndarray:
        chunks = self.held[symbol]
        self.held[symbol] = []
        self.size -= sum(map(len, chunks))
        if self.folder and os.path.exists(self._file(symbol)):
            chunks = [np.fromfile(self._file(symbol), np.int32).reshape(-1, 2), *chunks]
            os.remove(self._file(symbol))
        return np.concatenate(chunks) if chunks else np.zeros((0, 2), np.int32)

    def close(self) -> None:
        if self.folder:
            for name in os.listdir(self.folder):
                os.remove(os.path.join(self.folder, name))
            os.rmdir(self.folder)


class _Induction:
    """One direction of induction over `text`: scanned suffixes push their left neighbours."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, symbols: int):
        self.text, self.wanted = text, wanted
        self.queue = Buckets(symbols, None)
        # Minimum of the common prefixes scanned since the last push, by target symbol.
        self.since = np.zeros(symbols, np.int32)
        self.pushed = np.zeros(symbols, bool)

    def scan(self, tuples: np.ndarray, here: int) -> np.ndarray:
        """Scan tuples in order; returns those that fall into the bucket `here` itself."""
        pos, lcp = tuples[:, 0], tuples[:, 1]
        left = pos - 1
        index = np.flatnonzero((left >= 0) & self.wanted[left])
        target = self.text[left[index]]
        order = np.argsort(target, kind="stable")
        index, target = index[order], target[order]
        if len(index):
            lead = np.ones(len(index), bool)
            lead[1:] = target[1:] != target[:-1]
            begin = np.zeros(len(index), np.int64)
            begin[1:] = np.where(lead[1:], 0, index[:-1] + 1)
            cuts = np.empty(2 * len(index), np.int64)
            cuts[::2], cuts[1::2] = begin, index + 1
            low = np.minimum.reduceat(np.append(lcp, _FAR), cuts)[::2].astype(np.int32)
            low[lead] = np.minimum(low[lead], self.since[target[lead]])
            value = np.where(lead & ~self.pushed[target], 0, low + 1).astype(np.int32)
            fresh = np.stack((left[index].astype(np.int32), value), axis=1)
        whole = lcp.min() if len(lcp) else _FAR
        self.since = np.minimum(self.since, whole)
        own = np.zeros((0, 2), np.int32)
        if len(index):
            first = np.flatnonzero(lead)
            last = np.append(first[1:], len(index)) - 1
            tail = np.minimum.accumulate(np.append(lcp, _FAR)[::-1])[::-1]
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                symbol = int(target[a])
                self.since[symbol] = tail[index[b] + 1]
                self.pushed[symbol] = True
                if symbol == here:
                    own = fresh[a : b + 1]
                else:
                    self.queue.push(symbol, fresh[a : b + 1])
        return own

    def drain(self, symbol: int) -> np.ndarray:
        """All tuples of a bucket in order, scanning them on the way."""
        out = []
        now = self.queue.pop(symbol)
        while len(now):
            out.append(now)
            now = self.scan(now, symbol)
        return np.concatenate(out) if out else np.zeros((0, 2), np.int32)


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the one to their right); the last is S."""
    n = len(text)
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(text[1:].astype(np.int32) - text[:-1].astype(np.int32))
    less[-1] = 1
    # Equal neighbours take the type of the next unequal one.
    place = np.where(less != 0, np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return less[following] > 0


def _induce(text: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, runs: np.ndarray, symbols: int) -> list[np.ndarray]:
    """All suffixes in order with common prefixes, one array per bucket, from LMS tuples in order."""
    by_symbol = np.searchsorted(text[seeds[:, 0]], np.arange(symbols + 1))
    forward = _Induction(text, ~s_type, symbols)
    larger = []
    for symbol in range(symbols):
        items = forward.drain(symbol)
        larger.append(items)
        own = seeds[by_symbol[symbol] : by_symbol[symbol + 1]].copy()
        if len(own):
            own[0, 1] = min(runs[items[-1, 0]], runs[own[0, 0]]) if len(items) else 0
            forward.scan(own, -1)
    forward.queue.close()
    backward = _Induction(text, s_type, symbols)
    out: list[np.ndarray] = [np.zeros((0, 2), np.int32)] * symbols
    # The end of the text is the least suffix and induces from its own bucket.
    backward.queue.push(0, np.array([[len(text) - 1, 0]], np.int32))
    for symbol in range(symbols - 1, -1, -1):
        # Each tuple's value is its common prefix with the one scanned before, the next larger.
        smaller = backward.drain(symbol)
        items = larger[symbol]
        if len(items):
            seam = min(runs[items[-1, 0]], runs[smaller[-1, 0]]) if len(smaller) else 0
            down = items[::-1].copy()
            down[1:, 1] = items[:0:-1, 1]
            down[0, 1] = seam
            backward.scan(down, -1)
        else:
            seam = 0
        up = smaller[::-1].copy()
        if len(up):
            up[1:, 1] = smaller[:0:-1, 1]
            up[0, 1] = seam
        out[symbol] = np.concatenate((items, up))
        backward.since[:] = 0  # the next bucket's first symbol differs
    backward.queue.close()
    return out


def sorted_suffixes(text: np.ndarray, symbols: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order and common prefixes with the one before, right up to `width`.

    `text` ends with its only 0.  Suffixes equal in their first `width` symbols may stand in any order.
    """
    n = len(text)
    s_type = _types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    runs = (change[np.searchsorted(change, np.arange(n))] - np.arange(n) + 1).astype(np.int32)
    if len(lms) < 2:
        names = order = np.zeros(len(lms), np.int64)
        levels = [names]
    else:
        # LMS substrings in order, by induction from LMS suffixes known by first symbol only.
        rough = lms[np.argsort(text[lms], kind="stable")]
        seeds = np.stack((rough, np.zeros(len(rough), np.int64)), axis=1).astype(np.int32)
        placed = np.concatenate(_induce(text, s_type, seeds, runs, symbols))[:, 0]
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ranked = placed[is_lms[placed]]
        index = np.searchsorted(lms, ranked)
        end = np.append(lms[1:] + 1, n)
        sums, inverse = prefix_hash(mix(text.astype(np.uint64) + np.uint64(77)))
        whole = mix((sums[end] - sums[lms]) * inverse[lms]) + (end - lms).astype(np.uint64)
        sorted_names = np.concatenate(([0], np.cumsum(whole[index[1:]] != whole[index[:-1]])))
        names = np.empty(len(lms), np.int64)
        names[index] = sorted_names
        # The string of names: ranks double until unique or past `width`.
        levels, step = [names], 1
        while levels[-1].max() + 1 < len(lms) and step < width:
            rank = levels[-1]
            ahead = np.zeros(len(lms), np.int64)
            ahead[:-step] = rank[step:] + 1
            key = rank * (len(lms) + 1) + ahead
            _, fresh = np.unique(key, return_inverse=True)
            levels.append(fresh)
            step *= 2
        order = np.argsort(levels[-1], kind="stable")
    seeds = np.stack((lms[order], _common(text, lms, levels, order, width)), axis=1).astype(np.int32)
    both = np.concatenate(_induce(text, s_type, seeds, runs, symbols))
    return both[:, 0], both[:, 1]


def _common(text: np.ndarray, lms: np.ndarray, levels: list[np.ndarray], order: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of LMS suffixes that follow each other in `order`."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    first = lms[a]
    m = len(lms)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = (a < m) & (b < m)
        same = inside & (rank[np.minimum(a, m - 1)] == rank[np.minimum(b, m - 1)])
        a, b = np.where(same, a + (1 << k), a), np.where(same, b + (1 << k), b)
    at = np.append(lms, len(text))
    x, y = at[np.minimum(a, m)], at[np.minimum(b, m)]
    got = x - first
    live = np.flatnonzero((got < width) & (x < len(text)) & (y < len(text)))
    while len(live):
        live = live[text[x[live] + got[live] - (x[live] - first[live])] == text[y[live] + got[live] - (x[live] - first[live])]]
        got[live] += 1
        live = live[(got[live] < width) & (first[live] + got[live] < len(text)) & (y[live] + got[live] - (x[live] - first[live]) < len(text))]
    out[1:] = got
    return out


def repeated_windows(pieces: list[bytes], starts: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """Per piece, the starts (below its number of starts) of strings of `width` that another start has too."""
    sizes = np.array([len(p) + 1 for p in pieces])
    first = np.cumsum(sizes) - sizes
    text = np.empty(int(sizes.sum()) + 1, np.int16)
    text[:-1] = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    text += 2
    text[first + sizes - 1] = 1  # between pieces
    text[-1] = 0
    pos, lcp = sorted_suffixes(text, 258, width)
    again = lcp >= width
    again[:-1] |= again[1:]
    hit = np.zeros(len(text), bool)
    hit[pos[again]] = True
    return [np.flatnonzero(hit[f : f + s]) for f, s in zip(first.tolist(), starts, strict=True)]


def sort_shards(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """k, first, last: runs of starts of repeated windows, from `pieces` as of shard_pieces."""

    def run(batches):
        # (gram, piece) -> number of starts, and (k, at) of each place that has the piece.
        distinct: dict[tuple[int, bytes], tuple[int, list[tuple[int, int]]]] = {}

        def done():
            # Windows of one piece differ (they stand differently to its gram), equal pieces
            # repeat each other, and a gram with one distinct piece has nothing to compare.
            many = Counter(gram for gram, _ in distinct)
            sortable = [key for key in distinct if many[key[0]] > 1]
            found = {}
            if sortable:
                starts = [distinct[key][0] for key in sortable]
                found = dict(zip(sortable, repeated_windows([piece for _, piece in sortable], starts, width), strict=True))
            out = []
            for key, (count, same) in distinct.items():
                hit = np.arange(count) if len(same) > 1 else found.get(key, ())
                if not len(hit):
                    continue
                cut = np.flatnonzero(np.diff(hit) > 1)
                lo, hi = hit[np.append(0, cut + 1)].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()
                for k, at in same:
                    out.extend((k, at + x, at + y) for x, y in zip(lo, hi, strict=True))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["k", "first", "last"])

        size, last = 0, None
        for batch in batches:
            for gram, k, at, count, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD_BYTES and gram != last:
                    yield done()
                    distinct.clear()
                    size = 0
                last = gram
                held = distinct.get((gram, piece))
                if held is None:
                    distinct[gram, piece] = (count, [(k, at)])
                    size += len(piece)
                else:
                    held[1].append((k, at))
        if distinct:
            yield done()

    by_gram = pieces.repartition("gram").sortWithinPartitions("gram")
    return by_gram.mapInArrow(run, "k bigint, first int, last int")


def _cut(text: bytes, runs: list[tuple[int, int]], width: int) -> tuple[int, int, str]:
    """Bytes removed, maximal runs of them, sha256 of the rest."""
    kept, spans, removed, at, end = hashlib.sha256(), 0, 0, 0, -1
    for first, last in sorted(runs):
        if first > end:
            kept.update(text[at:first])
            spans += 1
            removed += last + width - first
        elif last + width > end:
            removed += last + width - end
        end = max(end, last + width)
        at = end
    kept.update(text[at:])
    return removed, spans, kept.hexdigest()


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; texts under `width` bytes lose nothing.  Equal texts of
    `width` bytes or more are repeats of each other and go whole, repeated rows
    included.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    plain = docs.select("doc_id", "text")
    keyed = scratch.save(with_keys(plain), "keys")
    groups = scratch.save(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("d")), "groups")
    marked = scratch.save(repeated_anchors(plain, width).join(groups.select("k", "d"), "k"), "marked")
    texts = plain.join(marked, F.col("doc_id").eqNullSafe(F.col("d"))).select("k", "text", "places")
    texts = scratch.save(texts, "texts")
    scratch.drop("marked")
    runs = sort_shards(scratch.save(shard_pieces(texts, width), "pieces"), width)
    runs = scratch.save(runs.groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    scratch.drop("pieces")

    def cut(batches):
        for batch in batches:
            texts_, lists, keys = batch.column("text"), batch.column("runs").to_pylist(), batch.column("k").to_pylist()
            rows = []
            for text, own, k in zip(texts_.to_pylist(), lists, keys, strict=True):
                data = (text or "").encode()
                edges = np.array([0, len(data)], np.int64)
                if _text_keys(np.frombuffer(data, np.uint8), edges)[0] == k:
                    rows.append((k, *_cut(data, [(r["first"], r["last"]) for r in own], width)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "removed", "spans", "rest"])

    found = texts.select("k", "text").join(runs, "k").mapInArrow(cut, "k bigint, removed bigint, spans bigint, rest string")
    found = scratch.save(found.dropDuplicates(["k"]), "cut")
    joined = keyed.join(groups.select("k", "copies"), "k").join(found, "k", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= width)
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(none)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )

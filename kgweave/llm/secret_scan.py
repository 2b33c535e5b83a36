r"""Secrets in texts: fixed patterns, and strings that test as random.

Patterns find assignments, access keys and long hex strings.  Everything else is
found by randomness.  A candidate is a maximal run of [A-Za-z0-9+/_-] of at least
MIN_LENGTH characters (with up to two `=`).  Its encoding is inferred as the
smallest alphabet that holds it; a run that no alphabet holds, or that fails the
tests below, is cut at `/` and `+` or at `-` and `_`, and its parts are candidates.  Under "drawn at random from that alphabet"
three tests give p-values:

* chi-squared of the symbol counts against uniformity;
* runs: the number of times neighbouring symbols change halves of the alphabet;
* serial correlation of neighbouring symbols' places in the alphabet.

Fisher's method combines them.  Short strings pass such tests for lack of
evidence, so a decision needs the length.  Candidates are pooled by encoding and
length class over all documents, as histograms of the combined p-value (a bounded
table, merged from all tasks).  Each bin of p of each pool is decided for itself by
its local false-discovery rate, the share of natural strings among its candidates:

* random strings fall into bins as p-values do; how strings of prose of that length
  fall is found by running all three tests on drawn ones, continued as an
  exponential where drawn ones are few;
* the numbers of random and natural strings are fitted to the histogram of the pool
  and, by half, its neighbours in length; at least NATURAL of them count as natural;
* what a bin holds beyond the fit's random strings and chance is natural too.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch

#: The base patterns, their kinds in order, and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}={{0,2}}")
FDR = 0.01
#: Least share of natural strings in a pool, strings of prose drawn per pool, and their length at most.
NATURAL, DRAWN, DRAWN_LENGTH = 0.1, 4000, 256
BINS = 60
BIN_WIDTH = 0.5  # of -ln p
#: Alphabets, smallest first.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = [(name, frozenset(letters)) for name, letters in ALPHABETS.items()]
_PLACE = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
#: Share of each symbol class in words of prose, for the power of the chi-squared test:
#: English letter frequencies in percent, rounded, from a to z.
PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_tail(x: float, df: float) -> float:
    """P(X > x), by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    c = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c))


def encoding(text: str) -> str | None:
    """The smallest alphabet that holds all of `text` (padding aside)."""
    used = set(text.rstrip("="))
    return next((name for name, letters in _SETS if used <= letters), None)


def batteries(places: np.ndarray, m: int) -> tuple[list[float], list[float], list[float]]:
    """p-values of uniformity, runs and serial correlation of each row of places in an alphabet of m."""
    rows, n = places.shape
    counts = np.bincount((places + np.arange(rows)[:, None] * m).ravel(), minlength=rows * m).reshape(rows, m)
    x = ((counts - n / m) ** 2).sum(axis=1) * m / n
    # Sparse counts spread wider than chi-squared's variance tells: scale to the exact one.
    variance = 2 * (m - 1) * (1 - 1 / n)
    df = 2 * (m - 1) ** 2 / variance
    uniform = [chi_squared_tail(v, df) for v in (x * df / (m - 1)).tolist()]
    high = places >= m // 2
    changes = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    rate = 2 * (m // 2) * (m - m // 2) / (m * m)
    z = (abs(changes - (n - 1) * rate) - 0.5) / math.sqrt(max((n - 1) * rate * (1 - rate), 1e-9))
    runs = [min(1.0, 2 * _normal_tail(max(v, 0.0))) for v in z.tolist()]
    centred = places - (m - 1) / 2
    spread = (m * m - 1) / 12
    r = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / (spread * math.sqrt(n - 1))
    serial = [min(1.0, 2 * _normal_tail(abs(v))) for v in r.tolist()]
    return uniform, runs, serial


def battery(text: str, name: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under randomness."""
    places = np.array([[_PLACE[name][c] for c in text.rstrip("=")]])
    return tuple(p[0] for p in batteries(places, len(ALPHABETS[name])))


def combined(p: tuple[float, ...]) -> float:
    """Fisher's method for three p-values: the tail of chi-squared with 6 degrees of freedom."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-half) * (1 + half + half * half / 2)


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-math.log(max(p, 1e-300)) / BIN_WIDTH))


@functools.cache
def prose_bins(name: str, length: int) -> np.ndarray:
    """Chance of each bin of p for strings of prose of this length, by all three tests."""
    letters = ALPHABETS[name]
    share = np.array([PROSE[ord(c) - 97] if c.isalpha() else 0.05 for c in letters.lower()])
    if name in ("base62", "base64", "base64url"):
        share = np.where([c.isupper() for c in letters], share * 0.05, share)
    m, n = len(letters), min(length, DRAWN_LENGTH)
    drawn = np.random.RandomState(n * 64 + m).choice(m, (DRAWN, n), p=share / share.sum())
    bins = np.array([p_bin(combined(p)) for p in zip(*batteries(drawn, m), strict=True)])
    count = np.bincount(bins, minlength=BINS).astype(float)
    # Below the first bins with some thirty strings each the logarithm goes on as a line.
    enough = np.flatnonzero(count >= 30)
    if len(enough) and enough[0] > 0:
        a = enough[0]
        b = min(a + 4, int(enough[-1]))
        slope = max(0.25, math.log(count[b] / count[a]) / (b - a)) if b > a else 0.25
        below = np.arange(a)
        count[below] = np.maximum(count[below], count[a] * np.exp(-slope * (a - below)))
    return count / count.sum()


def length_class(length: int) -> int:
    """Classes of about a fifth of an octave; class_length gives the least length of one."""
    return int(math.log2(length) * 5)


def class_length(k: int) -> int:
    return math.ceil(2 ** (k / 5))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            out.append((m.start(), m.end(), "assign"))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_LEAST:
            out.append((m.start(), m.end(), "access"))
    for m in HEX.finditer(text):
        out.append((m.start(), m.end(), "hex"))
    return out


def _joined(spans: Iterator[tuple[int, int, str]]) -> str:
    order = {kind: i for i, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


_CUTS = tuple((re.compile(rf"[^{re.escape(c)}]{{{MIN_LENGTH},}}"), frozenset(c)) for c in ("/+", "-_"))


def parts(text: str, start: int) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p) of a run, or of the parts at its separators if it does not pass as a whole.

    Of several ways to cut, the one with the largest p is taken; the largest of c uniform
    numbers is below x with probability x^c, so its parts' p are raised to the power c.
    """
    size = len(text.rstrip("="))
    name = encoding(text) if size >= MIN_LENGTH else None
    whole = [(start, start + len(text), name, combined(battery(text, name)))] if name else []
    if whole and whole[0][3] >= FDR:
        return whole
    ways = []
    for cut, separators in _CUTS:
        if not separators.isdisjoint(text):
            found = [x for m in cut.finditer(text) for x in parts(m[0], start + m.start())]
            if found:
                ways.append(found)
    if not ways:
        return whole
    best = max(ways, key=lambda found: max(x[3] for x in found))
    return [(s, e, name, p ** len(ways)) for s, e, name, p in best]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, encoding, length class, bin of p) of the runs, or of their parts, outside of the base spans."""
    out = []
    taken = sorted((s, e) for s, e, _ in taken)
    first = 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while first < len(taken) and taken[first][1] <= at:
            first += 1
        rests, near = [], first
        while near < len(taken) and taken[near][0] < end:
            rests.append((at, taken[near][0]))
            at = max(at, taken[near][1])
            near += 1
        for s, e in [*rests, (at, end)]:
            if e - s >= MIN_LENGTH:
                for start, stop, name, p in parts(text[s:e], s):
                    out.append((start, stop, name, length_class(len(text[start:stop].rstrip("="))), p_bin(p)))
    return out


SCANNED = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base string, "
    "found array<struct<start:int,end:int,encoding:string,size:int,bin:int>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and the candidates with their test results."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text) if text else []
                line = _joined(spans)
                kinds = [k for *_, k in spans]
                found = candidates(text, spans) if text else []
                rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(line.encode()).hexdigest(), line, found))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("size", pa.int32()), ("bin", pa.int32())])
            found = [[dict(zip(("start", "end", "encoding", "size", "bin"), x, strict=True)) for x in row] for row in columns[5]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()), pa.array(found, pa.list_(item))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCANNED}")


def local_rates(counts: np.ndarray, near: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """By bin, the share of natural strings; `near` is the histogram that the numbers are fitted to."""
    edges = np.exp(-BIN_WIDTH * np.arange(BINS + 1))
    edges[-1] = 0
    chance = edges[:-1] - edges[1:]
    # Natural strings unlike prose: anywhere where random ones hardly are.
    other = (np.arange(BINS) >= 20) / (BINS - 20)
    kinds = np.stack((chance, prose, other))
    share = np.full(3, 1 / 3)
    for _ in range(200):
        part = share[:, None] * kinds
        part = part / np.maximum(part.sum(axis=0), 1e-300) * near
        share = part.sum(axis=1) / near.sum()
    natural = max(share[1], NATURAL)
    random = min(share[0], 1 - NATURAL)
    rate = natural * prose / np.maximum(natural * prose + random * chance, 1e-300)
    expected = random * counts.sum() * chance
    # More than chance gives in any of the bins but with probability FDR (Bernstein's bound of a Poisson count).
    t = math.log(BINS / FDR)
    excess = counts - expected - np.sqrt(2 * t * expected) - t / 3
    return np.maximum(rate, np.where(counts > 0, excess / np.maximum(counts, 1), 0))


def decisions(histogram: list[tuple[str, int, int, int]], fdr: float = FDR) -> dict[tuple[str, int], int]:
    """From (encoding, length class, bin, count): the first dismissed bin of each pool that gives findings."""
    pools: dict[tuple[str, int], np.ndarray] = {}
    for name, size, place, count in histogram:
        pools.setdefault((name, size), np.zeros(BINS, np.int64))[place] += count
    out = {}
    for (name, size), counts in pools.items():
        near = counts + 0.5 * sum(pools.get((name, size + d), np.zeros(BINS)) for d in (-1, 1))
        good = local_rates(counts, near, prose_bins(name, class_length(size))) <= fdr
        cut = BINS if good.all() else int(np.argmin(good))
        if cut:
            out[name, size] = cut
    return out


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, end exclusive, sorted by start and
    kind.  Null or empty texts have none.  Repeated rows are scanned again and
    count again in the pools.  An empty table gives an empty table.  A very long text
    is held whole by its task.  Other columns are not read.
    """
    scanned = Scratch(docs.sparkSession, "secrets").save(scan(docs), "scanned")
    found = scanned.select(F.inline("found")).groupBy("encoding", "size", "bin").count()
    # At most encodings x length classes x bins rows.
    cuts = decisions([(r["encoding"], r["size"], r["bin"], r["count"]) for r in found.collect()], fdr)
    limits = F.create_map(*[F.lit(v) for (name, size), cut in sorted(cuts.items()) for v in (f"{name}/{size}", cut)]) if cuts else None

    def random(x):
        if limits is None:
            return F.lit(False)
        return x["bin"] < F.coalesce(limits[F.concat_ws("/", x["encoding"], x["size"].cast("string"))], F.lit(0))

    chosen = scanned.withColumn("random", F.filter("found", random))
    item = lambda kind, start, end: F.struct(start.cast("int").alias("s"), kind.alias("k"), end.cast("int").alias("e"))
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: item(F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]), F.split(x, ":")[1], F.split(x, ":")[2]),
    )
    more = F.transform("random", lambda x: item(F.lit(len(KINDS)).cast("bigint"), x["start"], x["end"]))
    names = F.array(*map(F.lit, KINDS))
    line = F.transform(F.array_sort(F.concat(base, more)), lambda x: F.concat_ws(":", F.element_at(names, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string")))
    return chosen.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(line, ",").alias("spans"), F.size("random").cast("bigint").alias("n_random"))

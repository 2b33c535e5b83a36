"""Quality rules whose cutoffs are quantiles of each language and source.

Fixed cutoffs fit one language and one kind of page.  Here every ratio of a
document is held against its own group: a KLL sketch of each ratio is built per
(language, source) in one aggregation, partial on the map side and merged after
the shuffle; sketches of sources merge again into the sketch of their language,
and those into one of the whole corpus.  A group with fewer than `min_rows`
documents takes its cutoffs from its language, a small language from the corpus.
The cutoffs are joined back by group and filter.

A cutoff is an outer fence, upper quartile + `reach` * (upper - lower quartile),
but never nearer than the rule's `margin` to the upper `tail` quantile, so that a
group of nearly equal documents does not reject its own harmless members, and never
beyond `ceiling`, so that a source of nothing but junk does not declare junk normal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch, Words, span_hashes, text_chunks, windows

#: The symbols counted by the base rule, [#*$%&|<>].
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
#: Words in a window of the repeated-words rule.
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """A ratio's name, numerator, denominator and the bounds of its adaptive cutoff."""

    ratio: str
    above: str
    below: str
    margin: float
    ceiling: float


#: One-sided rules: larger is worse.
RULES = (
    Rule("symbol_ratio", "n_symbols", "n_words", 0.10, 0.35),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", 0.35, 0.60),
    Rule("word_length", "word_chars", "n_words", 3.0, 20.0),
)
REACH, TAIL, MIN_ROWS, SKETCH_K = 3.0, 0.90, 200, 400


def _measure_chunk(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words = Words(data, offsets)
    docs, doc = words.docs, words.doc
    where = offsets[:-1]
    empty = offsets[1:] == where

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[offsets[1:]] - total[where]

    # Code points in words: the first bytes of UTF-8 sequences outside white space.
    lead = (data & 0xC0) != 0x80
    sums = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    chars = np.bincount(doc, sums[words.end] - sums[words.start], docs).astype(np.int64)
    symbols = per_doc(_SYMBOL[data])

    hashes = words.hashes(fold=False)
    # Words in 8-word windows that the document holds twice or more.
    shingles, at = windows(hashes, doc, WINDOW)
    again = np.zeros(len(hashes) + 1, np.int64)
    if len(shingles):
        order = np.lexsort((shingles, doc[at]))
        s, d = shingles[order], doc[at][order]
        same = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        np.add.at(again, found, 1)
        np.add.at(again, found + WINDOW, -1)
    covered = np.cumsum(again[:-1]) > 0
    repeated = np.bincount(doc[covered], minlength=docs)

    # Lines with a word, as spans between line feeds; equal bytes, equal hash.
    feed = np.flatnonzero(data == 10)
    begin = np.union1d(where[~empty], feed + 1)
    begin = begin[begin < len(data)]
    end = np.minimum(
        np.concatenate((feed, [len(data)]))[np.searchsorted(feed, begin)],
        offsets[np.searchsorted(offsets, begin, "right")],
    )
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[has], end[has]
    owner = np.searchsorted(offsets, begin, "right") - 1
    line = span_hashes(data, begin, end)
    order = np.lexsort((line, owner))
    s, d = line[order], owner[order]
    dup = np.bincount(d[1:][(s[1:] == s[:-1]) & (d[1:] == d[:-1])], minlength=docs)
    return [words.per_doc, chars, symbols, dup, repeated, np.bincount(owner, minlength=docs)]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every input column, and the counts of MEASURES of the whole text (null: all zero).

    Input columns of those names are replaced.  Order and repetition of rows do
    not matter; each row is measured alone.
    """
    plain = docs.drop(*MEASURES)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"{m} bigint" for m in MEASURES)])

    def run(batches):
        for batch in batches:
            parts = [_measure_chunk(data, offsets) for *_, data, offsets in text_chunks(batch.column(text))]
            counts = [np.concatenate([p[i] for p in parts] or [np.zeros(0)]).astype(np.int64) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts)], names=[*batch.schema.names, *MEASURES])

    return plain.mapInArrow(run, schema)


def base_failed(measured: DataFrame) -> DataFrame:
    """Adds base_failed: under 20 words, or over 30 % of them in repeated windows."""
    few = F.col("n_words") < 20
    return measured.withColumn("base_failed", few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _ratio(rule: Rule):
    return F.coalesce(F.try_divide(F.col(rule.above).cast("double"), F.col(rule.below)), F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): document count and one KLL sketch per ratio."""
    return measured.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.kll_sketch_agg_double(_ratio(r), F.lit(SKETCH_K)).alias(r.ratio) for r in RULES],
    )


def _merged(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        *[F.kll_merge_agg_double(F.col(r.ratio), F.lit(SKETCH_K)).alias(r.ratio) for r in RULES],
    )


def _fences(parts: DataFrame, prefix: str) -> DataFrame:
    def fence(rule: Rule):
        q = lambda x: F.kll_sketch_get_quantile_double(F.col(rule.ratio), F.lit(x))
        outer = q(0.75) + REACH * (q(0.75) - q(0.25))
        return F.least(F.greatest(outer, q(TAIL) + F.lit(rule.margin)), F.lit(rule.ceiling)).alias(f"{prefix}{rule.ratio}")

    keys = [c for c in ("lang", "source") if c in parts.columns]
    return parts.select(*keys, F.col("rows").alias(f"{prefix}rows"), *[fence(r) for r in RULES])


def thresholds(parts: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Per (lang, source) the cutoffs limit_<ratio>, from the smallest group with `min_rows`.

    `parts` is read more than once: pass a written table.
    """
    by_lang = _merged(parts, "lang")
    own, lang = _fences(parts, "own_"), _fences(by_lang, "lang_")
    whole = _fences(_merged(by_lang).filter("rows > 0"), "all_").first() or {f"all_{r.ratio}": None for r in RULES}
    joined = own.join(lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    return joined.select(
        "lang",
        "source",
        *[
            F.when(F.col("own_rows") >= min_rows, F.col(f"own_{r.ratio}"))
            .when(F.col("lang_rows") >= min_rows, F.col(f"lang_{r.ratio}"))
            .otherwise(F.lit(whole[f"all_{r.ratio}"]).cast("double"))
            .alias(f"limit_{r.ratio}")
            for r in RULES
        ],
    )


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed, limit_<ratio> and kept: no base failure, no ratio beyond its limit.

    Null languages and sources are groups like any other.
    """
    named = limits.withColumnsRenamed({"lang": "limit_lang", "source": "limit_source"})
    on = F.col("lang").eqNullSafe(F.col("limit_lang")) & F.col("source").eqNullSafe(F.col("limit_source"))
    joined = base_failed(measured).join(named, on, "left").drop("limit_lang", "limit_source")
    fine = F.lit(True)
    for r in RULES:
        fine &= F.coalesce(_ratio(r) <= F.col(f"limit_{r.ratio}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine)


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """`docs` (text, lang, source and any other columns) with counts, limits and verdict.

    Null or empty text: no words, rejected by the base rule.  Repeated rows and
    ties: each row is judged alone.  An empty table gives an empty table.
    Columns named like an output are replaced.
    """
    clash = {"base_failed", "kept", *(f"limit_{r.ratio}" for r in RULES), "limit_lang", "limit_source"}
    plain = docs.drop(*(clash & set(docs.columns)))
    narrow = measure(plain.select("text", "lang", "source"))
    parts = Scratch(docs.sparkSession, "quality").save(sketches(narrow), "sketches")
    return judge(measure(plain), thresholds(parts, min_rows))

"""Node names that occur in texts: an exact, case-insensitive substring join.

A substring condition alone plans as a nested loop over all pairs.  Here texts
are cut into overlapping pieces; a name occurs in the text exactly when it is a
prefix of what follows some start in a piece.  Only starts whose first characters
begin a name go on.  Where names have few beginnings, one expression that spells
them finds these starts; else the first characters at all starts come from one
pass over the piece, and a bitmap of fixed size that is a constant of the plan
tells which begin a name.  What follows is cut to the lengths that names with that
beginning have, and the resulting candidate strings meet the names in an equi-join.  Names longer than
LONG characters are met by their first LONG, and such a pair is then verified
against the whole text, so the work does not grow with the longest name.  Neither
long texts nor many names with a common beginning gather in one group.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.functions.columns import strip
from kgweave.functions.sizing import has_bit

ANCHOR = 4  # characters at most that identify the beginning of a name
BUCKETS = 1 << 16  # bits of the bitmap, and rows of the broadcast table at most
LONG = 64  # characters of a name that are looked for; the rest is verified
CUTS = (1 << 15, 1 << 9)  # text cut sizes, in characters
SPELLED = 1 << 11  # beginnings of names that are spelled out at most
SPELLED_PER_WORD = 1 << 4  # of them under one word of the bitmap
# Up to so many characters from every start, found in one pass; a start is never
# the second half of a surrogate pair.
GRAMS = r"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{0,{}}}))"


def name_terms(nodes: DataFrame, mode: str = "terms") -> DataFrame:
    """``(name, label, first_id, key)``: what to look for and how to show it.

    ``terms``: distinct name and label, names stripped, blank names left out.
    ``names``: distinct names as they are.
    """
    if mode == "terms":
        named = nodes.filter(F.col("name").isNotNull())
        terms = named.groupBy("name", "label").agg(F.min("node_id").alias("first_id"))
        terms = terms.withColumn("name", strip(F.col("name")))
        terms = terms.withColumn("key", F.lower("name"))
        return terms.filter(F.col("key") != "")
    if mode == "names":
        named = nodes.filter(F.col("name").isNotNull())
        terms = named.groupBy("name").agg(F.min("node_id").alias("first_id"))
        return terms.select(
            "name",
            F.lit(None).cast("string").alias("label"),
            "first_id",
            F.lower("name").alias("key"),
        )
    raise ValueError(f"unknown mode {mode!r}")


def mention_table(
    texts: DataFrame,
    nodes: DataFrame,
    mode: str = "terms",
    text_id: str = "text_id",
    text: str = "text",
) -> DataFrame:
    """``(text_id, name, label, first_id)`` for every name in every text."""
    terms = name_terms(nodes, mode)
    texts = texts.select(text_id, text)
    shape = _shape(nodes, mode)
    found = _candidates(texts, shape, text_id, text)
    met = found.join(terms.withColumn("head", F.left("key", F.lit(LONG))), "head")
    picked = [text_id, "name", "label", "first_id"]
    if not shape.long:
        return met.select(*picked)
    whole = texts.select(F.col(text_id).alias("_id"), F.lower(text).alias("_text"))
    holds = (F.col(text_id) == F.col("_id")) & F.contains("_text", "key")
    long = met.filter(F.length("key") > LONG).join(whole, holds, "left_semi")
    return met.filter(F.length("key") <= LONG).select(*picked).unionByName(long.select(*picked))


class Shape(NamedTuple):
    """What the texts must know of the names before they meet them."""

    anchors: DataFrame  # bucket and the lengths of the names that begin there, at most BUCKETS rows
    sizes: list[int]  # how many characters names begin with: at most ANCHOR + 1 numbers
    width: int  # the longest head
    long: bool  # whether any name is longer than its head
    words: Column  # bitmap of the buckets in use
    starts: str | None  # an expression that holds where a name may begin, if beginnings are few


def _shape(nodes: DataFrame, mode: str) -> Shape:
    """One look at the names: a few numbers and a bitmap of fixed size come back."""
    name = strip(F.col("name")) if mode == "terms" else F.col("name")
    keys = nodes.filter(F.col("name").isNotNull()).select(F.lower(name).alias("key"))
    if mode == "terms":
        keys = keys.filter(F.col("key") != "")
    sized = keys.select("key", F.length("key").alias("whole"), F.least(F.length("key"), F.lit(LONG)).alias("n"))
    sized = sized.withColumn("size", F.least("n", F.lit(ANCHOR)))
    bucketed = sized.select(
        _bucket("key", F.lit(1), F.col("size")).alias("bucket"), "size", "n", "whole", F.left("key", "size").alias("first")
    )
    anchors = bucketed.groupBy("bucket").agg(F.collect_set("n").alias("lengths"))
    word = F.shiftright("bucket", 6).alias("word")
    used = bucketed.groupBy(word).agg(
        F.expr("bit_or(shiftleft(1L, cast(bucket & 63 AS int)))").alias("bits"),
        F.collect_set("size").alias("sizes"),
        F.max("n").alias("width"),
        F.max("whole").alias("whole"),
        F.collect_set("first").alias("firsts"),
    )
    used = used.withColumn("firsts", F.when(F.size("firsts") <= SPELLED_PER_WORD, F.col("firsts")))
    rows = used.collect()  # BUCKETS / 64 rows at most
    firsts = None if any(r["firsts"] is None for r in rows) else [first for r in rows for first in r["firsts"]]
    bits = dict.fromkeys(range(BUCKETS // 64), 0) | {r["word"]: r["bits"] for r in rows}
    return Shape(
        anchors,
        sorted({size for r in rows for size in r["sizes"]}),
        max((r["width"] for r in rows), default=0),
        any(r["whole"] > LONG for r in rows),
        F.from_json(F.lit(json.dumps(list(bits.values()))), "array<bigint>"),
        None if firsts is None or "" in firsts or not 0 < len(firsts) <= SPELLED else _spelled(firsts),
    )


def _spelled(firsts: list[str]) -> str:
    """An expression for any of the texts, by their characters from left to right."""
    after: dict[str, list[str]] = {}
    for first in firsts:
        after.setdefault(first[0], []).append(first[1:])
    # Characters with the same continuation stand in one class.
    same: dict[str, list[str]] = {}
    for character, rest in after.items():
        same.setdefault("" if "" in rest else _spelled(rest), []).append(f"\\x{{{ord(character):X}}}")
    return "(?:" + "|".join(f"[{''.join(sorted(c))}]{rest}" for rest, c in sorted(same.items())) + ")"


def _candidates(texts, shape: Shape, text_id, text) -> DataFrame:
    """Distinct ``(text_id, head)``: tails cut to the length of some name's head."""
    tails = (
        _spread(texts, text_id)
        .select(text_id, F.lower(text).alias("tail"))
        .filter(F.col("tail").isNotNull())
    )
    # Cutting in steps keeps the work linear in the length of a text: finding
    # the n-th character of a string takes n steps.
    for step in CUTS:
        tails = _cut(tails, text_id, step, shape.width)

    if shape.starts is None:
        hits = _all_starts(tails, text_id, shape)
    else:
        # A start past a piece's span is met in the next piece too, with as much behind it or more.
        here = f"(?s)(?={shape.starts})(?=(.{{0,{shape.width}}}))"
        hits = tails.select(text_id, F.explode(F.regexp_extract_all("tail", F.lit(here), 1)).alias("tail"))
    sizes = F.array(*(F.lit(size) for size in shape.sizes or [0]))
    matched = (
        hits.select("*", F.explode(sizes).alias("size"))
        .withColumn("bucket", _bucket("tail", F.lit(1), F.col("size")))
        .join(F.broadcast(shape.anchors), "bucket")
        .select(text_id, "tail", "lengths")
    )
    return (
        matched.select(text_id, "tail", F.explode("lengths").alias("n"))
        .filter(F.length("tail") >= F.col("n"))
        .select(text_id, F.left("tail", "n").alias("head"))
        .distinct()
    )


def _all_starts(tails: DataFrame, text_id: str, shape: Shape) -> DataFrame:
    """What follows each start whose first characters have their bit set."""

    def begins(size: int) -> Column:
        """Whether some name may begin with so many characters here."""
        enough = F.length("gram") >= size
        return enough & has_bit(shape.words, _bucket("gram", F.lit(1), F.lit(size)))

    hit = F.lit(False)
    for size in shape.sizes:
        hit = hit | begins(size)
    grams = F.regexp_extract_all("tail", F.lit(GRAMS.format(max(shape.sizes, default=1))), 1)
    hits = tails.select(text_id, "tail", "span", F.posexplode(grams).alias("at", "gram"))
    hits = hits.filter((F.col("at") < F.greatest("span", F.lit(1))) & hit)
    return hits.select(text_id, F.substring("tail", F.col("at") + 1, F.lit(shape.width)).alias("tail"))


def _spread(texts: DataFrame, text_id: str) -> DataFrame:
    """Texts in as many partitions as there are cores, if they are small enough.

    Each text byte grows into many rows, so a scan of fewer splits than cores
    leaves most of them idle.  By the plan's own size estimate, a partition never
    gets more than a scan's split would hold; texts of unknown or larger size are
    left as they are.
    """
    spark = texts.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return texts.repartition(cores, text_id) if size < cores * split else texts


def _bucket(text: str, start: Column, size: Column) -> Column:
    """Bucket of ``size`` characters from ``start``, apart for each size."""
    beginning = F.substring(text, start, size)
    return F.xxhash64(beginning, size).bitwiseAND(F.lit(BUCKETS - 1))


def _cut(tails: DataFrame, text_id: str, step: int, width: int) -> DataFrame:
    """Pieces that start every ``step`` characters and overlap by the width.

    A piece is longer than its step; the next cut starts only within its
    ``span``, so every position of the text starts exactly one tail.
    """
    span = F.length("tail") if step == CUTS[0] else F.col("span")
    starts = F.sequence(F.lit(0), F.greatest(span - 1, F.lit(0)), F.lit(step))
    pieces = tails.select(text_id, "tail", span.alias("whole"), F.explode(starts).alias("start"))
    return pieces.select(
        text_id,
        F.substring("tail", F.col("start") + 1, F.lit(width + step - 1)).alias("tail"),
        F.least(F.lit(step), F.col("whole") - F.col("start")).alias("span"),
    )

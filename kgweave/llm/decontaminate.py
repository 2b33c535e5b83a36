"""Benchmark decontamination by a prefix-filtered set join.

A window (10 consecutive words of an item; an item of fewer is one window) is
contained in a document only if all its shingles are.  With containment 1 the
necessary prefix of a window's shingles, ordered by rarity, is its single rarest
one.  So documents are joined on that one shingle per window; where it stands in
both gives the only place the window can have (positional bound), which must lie
within the document (length bound); there the words are compared one by one.

One scan of the documents finds shingles that some item has, by a bitmap of at
most 2^21 bits whatever the size of the benchmark, and keeps with each the words
around it.  All else works on these.  A window one of whose shingles was found
nowhere cannot occur and is dropped before the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch

WINDOW = 10
SHINGLE = 3
MAX_BITS = 1 << 21
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _shingle(array: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(array, at + i) for i in range(size)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id and the words (`win`) of each of its windows."""
    w = F.col("w")
    last = F.greatest(F.size(w) - window, F.lit(0))
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size(w) > 0)
    at = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return at.select("item_id", F.slice(w, F.col("at") + 1, F.lit(window)).alias("win"))


def _window_shingles(wins: DataFrame) -> DataFrame:
    """win_id, win, off, size, hash: every shingle of every window."""
    size = F.least(F.size("win"), F.lit(SHINGLE))
    at = wins.select("win_id", "win", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("win") - size)).alias("off"))
    by_size = reduce(
        lambda rest, k: F.when(F.col("size") == k, _shingle(F.col("win"), F.col("off"), k)).otherwise(rest),
        range(1, SHINGLE + 1),
        F.lit(None).cast("bigint"),
    )
    return at.withColumn("hash", by_size)


def _bitmap(shingles: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit words with a bit set per shingle, and its number of bits less one.

    At most MAX_BITS / 64 rows come to the driver, whatever the benchmark's size.
    """
    count = shingles.agg(F.approx_count_distinct("hash")).first()[0]
    bits = 1024
    while bits < min(MAX_BITS, 16 * count):
        bits *= 2
    slot = F.col("hash").bitwiseAND(bits - 1)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    cells = (
        shingles.select(slot.alias("slot"))
        .groupBy(F.expr("cast(slot div 64 as int)").alias("cell"))
        .agg(F.bit_or(one).alias("bits"))
        .collect()
    )
    held = [0] * (bits // 64)
    for row in cells:
        held[row["cell"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>"), bits - 1


def _held(value: Column, bitmap: Column, mask: int) -> Column:
    """Whether the bit of a hash is set."""
    slot = value.bitwiseAND(mask)
    cell = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return F.expr("1L").bitwiseAND(F.call_function("shiftright", cell, slot.bitwiseAND(63).cast("int"))) == 1


def scan_documents(docs: DataFrame, bitmap: Column, mask: int, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """doc_id, k (text hash), n_words and the found shingles: pos, hash, first (word of `near`), near."""
    w = F.col("w")

    def found(size: int) -> Column:
        places = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        hashed = F.transform(places, lambda i: F.struct(i.alias("pos"), _shingle(w, i, size).alias("hash")))

        first = lambda x: F.greatest(x["pos"] - (window - size), F.lit(0))
        return F.transform(
            F.filter(hashed, lambda x: _held(x["hash"], bitmap, mask)),
            lambda x: F.struct(
                x["pos"].alias("pos"),
                x["hash"].alias("hash"),
                first(x).alias("first"),
                F.slice(w, first(x) + 1, x["pos"] - first(x) + window).alias("near"),
            ),
        )

    split = docs.select("doc_id", F.xxhash64("text").alias("k"), words(F.col("text")).alias("w"))
    return split.select("doc_id", "k", F.size(w).cast("bigint").alias("n_words"), F.concat(*map(found, sizes)).alias("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, k, n_words, n_hit, n_items, items_sha256, contaminated.

    k is the hash of the text: a repeated doc_id with another text is another
    document, a repeated row gets its result again.  Null or empty texts have no
    words and no hits; null or empty items no windows; an item without id counts
    under the empty name.  Other columns are not read.  Any length of text is
    taken whole.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    wins = item_windows(benchmark, window)
    by_item = scratch.save(wins.withColumn("win_id", F.xxhash64(F.size("win"), "win")), "windows")
    distinct = by_item.groupBy("win_id", "win").agg(F.count(F.lit(1)).alias("n"))
    shingles = scratch.save(_window_shingles(distinct), "shingles")
    bitmap, mask = _bitmap(shingles)
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect()) or [SHINGLE]
    scanned = scratch.save(scan_documents(docs, bitmap, mask, sizes, window), "scan")

    hits = scanned.filter(F.size("found") > 0).select("doc_id", "k", "n_words", F.inline("found"))
    seen = hits.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    # The rarest shingle of each window all of whose shingles occur.
    rarest = (
        shingles.join(seen, "hash", "left")
        .groupBy("win_id", "win")
        .agg(
            F.min(F.struct("df", "hash", "off")).alias("low"),
            F.count(F.when(F.col("df").isNull(), 1)).alias("absent"),
        )
        .filter(F.col("absent") == 0)
        .select("win_id", "win", F.col("low.hash").alias("hash"), F.col("low.off").alias("off"))
    )
    rarest = scratch.save(rarest, "rarest")
    # Most shingles found are common ones: only those that some window is met by are shuffled.
    met, met_mask = _bitmap(rarest)
    hits = hits.filter(_held(F.col("hash"), met, met_mask))
    start = F.col("pos") - F.col("off")
    length = F.size("win")
    matches = (
        hits.join(rarest, "hash")
        .filter((start >= 0) & (start + length <= F.col("n_words")))
        .filter(F.slice("near", start - F.col("first") + 1, length) == F.col("win"))
        .select("doc_id", "k", start.alias("s"), (start + length).alias("e"), "win_id", "win")
    )
    matches = scratch.save(matches, "matches")
    key = ["doc_id", "k"]
    spans = matches.groupBy(*key, "s").agg(F.max("e").alias("e"))
    before = F.max("e").over(Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("before", F.lit(0))))
    covered = spans.withColumn("before", before).groupBy(*key).agg(F.sum(new).alias("n_hit"))
    items = (
        matches.select(*key, "win_id", "win").distinct()
        .join(by_item, ["win_id", "win"])
        .select(*key, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
        .distinct()
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    )
    mine = covered.join(items.withColumnsRenamed({"doc_id": "d", "k": "t"}), _same("doc_id", "d", "k", "t")).drop("d", "t")
    mine = mine.withColumnsRenamed({"doc_id": "d", "k": "t"})
    return (
        scanned.drop("found")
        .join(mine, _same("doc_id", "d", "k", "t"), "left")
        .select(
            "doc_id",
            "k",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def _same(*pairs: str) -> Column:
    a, b, c, d = map(F.col, pairs)
    return a.eqNullSafe(b) & c.eqNullSafe(d)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs`, all columns, without the documents that hold a window of the benchmark."""
    hit = decontaminate(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_k")), "left_anti")

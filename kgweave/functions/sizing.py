"""Seed sets and the size check that decides whether they may be broadcast.

At scale the edge table is the expensive side: shuffling it to meet a handful
of seeds costs a full pass over the network.  A seed set is therefore broadcast
when, and only when, it was seen to be small; a larger one goes through the
operator's shuffle plan, which pre-aggregates before it meets the seeds.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_ROWS = 500_000
SMALL_BYTES = 16 * 1024 * 1024
# Seed sets up to this many ids become a literal predicate on the scan.
PUSHED_IDS = 1_000
# A larger set cuts rows by a bitmap before they are shuffled: so many bits per
# seed, and no more bits than these (16 MB), beyond which it would keep too much.
BITS_PER_SEED = 8
MOST_BITS = 1 << 27
# Words of a bitmap that are put in order by one task.
CHUNK_WORDS = 1 << 10


def _width(field: T.StructField) -> Column:
    """Bytes of a value of varying size; values of fixed size weigh little."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    if isinstance(field.dataType, T.VariantType):
        return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
    return F.lit(8)


class Size(NamedTuple):
    rows: int
    bytes: int

    @property
    def small(self) -> bool:
        return self.rows <= SMALL_ROWS and self.bytes <= SMALL_BYTES


def size_of(df: DataFrame) -> Size:
    """Rows, and bytes of their values.

    One job without a limit: each task sends two numbers, which are summed.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    return Size(*df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first())


def is_small(df: DataFrame) -> bool:
    """True when ``df`` has at most SMALL_ROWS rows and SMALL_BYTES of values."""
    return size_of(df).small


def hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _literal(value, kind: T.DataType) -> str | None:
    """SQL text of a constant of type ``kind``; None if the type has none.

    Texts go as the hex of their UTF-8, so no session setting for escapes
    matters; times as counts since the epoch, so no time zone does.
    """
    if isinstance(kind, T.StringType):
        return f"decode(X'{value.encode().hex()}', 'utf-8')"
    if isinstance(kind, T.BinaryType):
        return f"X'{bytes(value).hex()}'"
    if isinstance(kind, T.DateType):
        return f"date_from_unix_date({(value - datetime.date(1970, 1, 1)).days})"
    if isinstance(kind, T.TimestampType):
        zone = datetime.timezone.utc
        since = (value if value.tzinfo else value.astimezone()) - datetime.datetime(1970, 1, 1, tzinfo=zone)
        return f"timestamp_micros({since // datetime.timedelta(microseconds=1)})"
    if isinstance(kind, T.TimestampNTZType):
        return f"CAST('{value.isoformat(sep=' ')}' AS TIMESTAMP_NTZ)"
    if isinstance(kind, T.BooleanType):
        return str(value).upper()
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.FloatType, T.DoubleType)):
        return f"CAST('{value}' AS {kind.simpleString()})"
    return None


class Seeds(NamedTuple):
    """Distinct, non-null seed ids in column ``seed_id``; ``rows`` if counted."""

    ids: DataFrame
    small: bool
    values: tuple | None = None
    rows: int | None = None

    @property
    def pushable(self) -> bool:
        if self.values is None or len(self.values) > PUSHED_IDS:
            return False
        kind = self.ids.schema["seed_id"].dataType
        return all(_literal(v, kind) is not None for v in self.values[:1])

    def restrict(self, df: DataFrame, *keys: str) -> DataFrame:
        """Early reduction: drop rows none of whose keys is a seed.

        Only applied where it is free of a shuffle.  A set too large to be sent
        whole leaves some other rows: its bitmap holds hashes of the ids.  The
        operator's final join with the seeds drops them.
        """
        if self.pushable:
            return self.prune(df, *keys)
        if not self.small:
            return self._sift(df, *keys)
        if len(keys) == 1:
            return self.keep(df, keys[0])
        hit = F.lit(False)
        for i, key in enumerate(keys):
            flags = self.ids.select(F.col("seed_id").alias(f"_id{i}"))
            df = df.join(F.broadcast(flags), F.col(key) == F.col(f"_id{i}"), "left")
            hit = hit | F.col(f"_id{i}").isNotNull()
        return df.filter(hit).drop(*(f"_id{i}" for i in range(len(keys))))

    def _sift(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows one of whose keys has its bit set; all rows if the set is too large or uncounted."""
        bits = 1 << max((self.rows or 0) * BITS_PER_SEED - 1, 1 << 16).bit_length()
        if self.rows is None or bits > MOST_BITS:
            return df
        words = one_row(bitmap(self.ids, "seed_id", bits))
        hit = F.lit(False)
        for key in keys:
            hit = hit | has_bit(words, slot(key, bits))
        # A predicate on one key alone is inferred for every table that meets the key, and
        # the driver holds its words once per scan.  A bit is never null, so a second
        # column changes no row but ties the predicate to this table.
        others = [c for c in df.columns if c not in keys]
        return df.filter(F.coalesce(hit, *(F.col(f"`{c}`").isNull() for c in others[:1])))

    def prune(self, df: DataFrame, *keys: str) -> DataFrame:
        """``restrict`` by the predicate that a scan can evaluate, if any.

        For rows that meet the seeds again before their first shuffle.
        """
        if not self.pushable:
            return df
        # One parsed text: a call per id would cost more than the query.
        kind = self.ids.schema["seed_id"].dataType
        ids = ", ".join(_literal(v, kind) for v in self.values) or "NULL"
        return df.filter(" OR ".join(f"`{key}` IN ({ids})" for key in keys))

    def keep(self, df: DataFrame, key: str) -> DataFrame:
        """Rows whose key is a seed."""
        if self.pushable:
            return self.restrict(df, key)
        ids = hinted(self.ids, self.small)
        return df.join(ids, F.col(key) == F.col("seed_id"), "left_semi")


class Pinned(NamedTuple):
    """A few rows held as a local table: computed once, and of known size."""

    df: DataFrame
    rows: pa.Table


def pinned(df: DataFrame, bound: int) -> Pinned:
    """The rows of a DataFrame that holds at most ``bound`` of them."""
    rows = df.limit(bound).toArrow()
    return Pinned(df.sparkSession.createDataFrame(rows, df.schema), rows)


def bounded(df: DataFrame, bound: int) -> tuple[DataFrame, Pinned | Seeds]:
    """A table of at most ``bound`` rows with ``node_id``, and its ids as seeds.

    Very few rows are held; otherwise the limit stays a step of the plan and no
    row comes to the driver.
    """
    if bound <= PUSHED_IDS:
        held = pinned(df, bound)
        return held.df, held
    fixed = not isinstance(df.schema["node_id"].dataType, (T.StringType, T.BinaryType))
    small = fixed and bound <= min(SMALL_ROWS, SMALL_BYTES // 8)
    return df, as_seeds(df.sparkSession, df, small)


def measured(df: DataFrame) -> tuple[DataFrame, bool, Pinned | None]:
    """A table, whether it may be broadcast, and its rows when very few."""
    held = pinned(df, PUSHED_IDS + 1)
    if held.rows.num_rows <= PUSHED_IDS:
        return held.df, True, held
    return df, is_small(df), None


def measured_keys(df: DataFrame) -> tuple[DataFrame, bool, Pinned | None]:
    """The same for the distinct rows of a key table."""
    keys, size, held = _sized_keys(df)
    return keys, held is not None or size.small, held


def _sized_keys(df: DataFrame) -> tuple[DataFrame, Size | None, Pinned | None]:
    """Distinct rows, and either their size or, when very few, the rows.

    The plain rows are looked at first: reading a few stops early, and when
    they are few so are the distinct ones.  Only a long table pays for a
    distinct count, once.
    """
    held = pinned(df, PUSHED_IDS + 1)
    if held.rows.num_rows <= PUSHED_IDS:
        rows = held.rows.group_by(held.rows.column_names).aggregate([])
        held = Pinned(df.sparkSession.createDataFrame(rows, df.schema), rows)
        return held.df, None, held
    keys = df.distinct()
    return keys, size_of(keys), None


def as_seeds(
    spark: SparkSession,
    seeds: DataFrame | Iterable | Pinned | Seeds,
    small: bool | None = None,
) -> Seeds:
    """Seeds from a list of ids or from a DataFrame with ``node_id``.

    ``small`` states what is known of the size; None means measure.
    """
    if isinstance(seeds, Seeds):
        return seeds
    if isinstance(seeds, Pinned):
        return as_seeds(spark, seeds.rows.column("node_id").to_pylist())
    if isinstance(seeds, DataFrame):
        ids = seeds.select(F.col("node_id").alias("seed_id")).filter(
            F.col("seed_id").isNotNull()
        )
        if small is not None:
            return Seeds(ids.distinct(), small)
        ids, size, held = _sized_keys(ids)
        if held is None:
            return Seeds(ids, size.small, rows=size.rows)
        return Seeds(ids, True, tuple(held.rows.column("seed_id").to_pylist()))
    values = tuple(dict.fromkeys(v for v in seeds if v is not None))
    column = pa.array(values) if values else pa.array([], pa.int64())
    ids = spark.createDataFrame(pa.table({"seed_id": column}))
    return Seeds(ids, len(values) <= SMALL_ROWS and column.nbytes <= SMALL_BYTES, values)


def slot(key: str, bits: int) -> Column:
    """The bit of a key's hash."""
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))


def bitmap(df: DataFrame, key: str, bits: int) -> DataFrame:
    """One row: ``bits`` bits as an array of 64-bit words, those of the keys' hashes set."""
    return bit_words(df.select(slot(key, bits).alias("slot")), bits)


def bit_words(slots: DataFrame, bits: int) -> DataFrame:
    """One row: ``bits`` bits as an array of 64-bit words, those of ``slot`` set.

    Words are put together before they meet, and their number is fixed.  They meet as
    chunks in order, so the last task holds a few arrays and no row per word.
    """
    used = slots.select(
        F.shiftright("slot", 6).alias("word"),
        F.expr("shiftleft(1L, cast(slot & 63 AS int))").alias("bits"),
    )
    none = slots.sparkSession.range(bits // 64).select(
        F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits")
    )
    words = used.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunk = F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    chunks = words.groupBy(chunk).agg(F.transform(ordered, lambda x: x["bits"]).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "part")))
    return chunks.agg(F.flatten(F.transform(ordered, lambda x: x["part"])).alias("words"))


def has_bit(words: Column, place: Column) -> Column:
    word = F.get(words, F.shiftright(place, 6).cast("int"))
    one = F.lit(1).cast("bigint")
    mask = F.call_function("shiftleft", one, place.bitwiseAND(F.lit(63)).cast("int"))
    return word.bitwiseAND(mask) != 0


def one_row(df: DataFrame) -> Column:
    """The only value of a one-row, one-column DataFrame, as a column."""
    return df.scalar()

"""Column-level helpers: type narrowing, null rendering, whitespace, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(2**31), 2**31 - 1

# The characters that a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)


def narrow_types(df: DataFrame) -> DataFrame:
    """64-bit integers to 32-bit, 64-bit floats to 32-bit, in one projection.

    A value outside the 32-bit range raises, whatever the session's ANSI mode.
    """
    return df.select(*(_narrow(field) for field in df.schema.fields))


def _narrow(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.LongType):
        overflow = F.raise_error(
            F.concat(F.lit(f"{field.name} exceeds 32 bits: "), col.cast("string"))
        ).cast("int")
        fits = col.isNull() | col.between(INT_MIN, INT_MAX)
        return F.when(fits, col.cast("int")).otherwise(overflow).alias(field.name)
    if isinstance(field.dataType, T.DoubleType):
        return col.cast("float").alias(field.name)
    return col


def to_native(df: DataFrame, *names: str) -> DataFrame:
    """Render columns as text, null and NaN as the empty string.

    Without names every column is rendered.
    """
    wanted = set(names or df.columns)
    return df.select(
        *(
            _native(field) if field.name in wanted else F.col(f"`{field.name}`")
            for field in df.schema.fields
        )
    )


def _native(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    text = col.cast("string")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        text = F.when(~F.isnan(col), text)
    return F.coalesce(text, F.lit("")).alias(field.name)


def shown(col: Column) -> Column:
    """Text of a column inside a line, null as the empty string."""
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col) == "", F.lit(True))


def properties_or_empty(properties: Column) -> Column:
    """JSON text of the properties; absent and empty values become ``{}``."""
    return F.when(has_properties(properties), properties).otherwise(F.lit("{}"))


def has_properties(properties: Column) -> Column:
    # JSON texts that decode to something empty.
    empty = ("", "{}", "[]", "null", '""', "0", "false")
    return ~strip(F.coalesce(properties, F.lit(""))).isin(*empty)


def ordered_lines(order: list[Column], line: Column, separator: str = "\n") -> Column:
    """Aggregate: lines of a group joined in order.

    For groups whose size is bounded by the operator's own k.
    """
    keys = [key.alias(f"k{i}") for i, key in enumerate(order)]
    collected = F.array_sort(F.collect_list(F.struct(*keys, line.alias("line"))))
    return F.array_join(F.transform(collected, lambda x: x["line"]), separator)

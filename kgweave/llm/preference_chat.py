"""Preference pairs: one prompt from the shared turns, two masked completions.

Chosen and rejected conversations of one pair are ordered by turn, their longest
common prefix of turns is found, rendered once as the prompt, and what follows in
each is rendered as its completion.  Loss falls on assistant turns only: each
completion comes with the character spans [start, end) of those turns' text and
end marks.  Built-in expressions only; the one shuffle brings a conversation's
turns together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the template, and what a mark inside a text becomes.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ESCAPED = "< |"
LEARNED = "assistant"
UNKNOWN = "unknown"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and `turns`: array of (role, text) by turn number, then role, then text.

    A null role is "unknown", a null text empty, a null turn number comes first.
    """
    one = F.struct("turn", F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(turn["role"], F.lit(OPEN), F.lit(ESCAPED)), F.lit(CLOSE))


def _body(turn: Column) -> Column:
    return F.concat(F.replace(turn["text"], F.lit(OPEN), F.lit(ESCAPED)), F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _spans(turns: Column) -> Column:
    """Spans of the learned turns in the rendered text, as an array of (start, end)."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(seen: Column, turn: Column) -> Column:
        begin = (seen["at"] + F.length(_head(turn))).cast("bigint")
        end = (begin + F.length(_body(turn))).cast("bigint")
        grown = F.array_append(seen["spans"], F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == LEARNED, grown).otherwise(seen["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda seen: seen["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    shorter = F.least(F.size(a), F.size(b))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    apart = F.array_position(F.transform(places, lambda i: F.get(a, i) == F.get(b, i)), F.lit(False))
    return F.when(apart > 0, apart - 1).otherwise(shorter).cast("bigint")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """`pairs` (chosen, rejected: arrays of (role, text); any other columns) as prompt and completions.

    Adds n_prompt_turns, prompt, and for each side its completion, its spans and
    identical (nothing to prefer).  A null side is an empty conversation.  Pairs
    without a common turn have an empty prompt; repeated pairs stay.
    Columns named like an output are replaced.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = {s: F.coalesce(F.col(s), none) for s in ("chosen", "rejected")}
    found = pairs.withColumns(sides).withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda s: F.slice(s, F.col("n_prompt_turns").cast("int") + 1, F.greatest(F.size(s), F.lit(1)))
    cut = found.withColumns({"prompt": _render(F.slice("chosen", F.lit(1), F.col("n_prompt_turns").cast("int"))), "chosen": rest("chosen"), "rejected": rest("rejected")})
    return cut.withColumns(
        {
            "identical": (F.size("chosen") == 0) & (F.size("rejected") == 0),
            "chosen": _render(F.col("chosen")),
            "chosen_spans": _spans(F.col("chosen")),
            "rejected": _render(F.col("rejected")),
            "rejected_spans": _spans(F.col("rejected")),
        }
    )


def borrowed_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations: conv_id, chosen, rejected.

    Chosen is the conversation.  Rejected is the same up to its last assistant
    turn, which is replaced by the last assistant turn of the conversation with
    the next id; where there is none, rejected ends before it.  A conversation
    without an assistant turn is its own rejected.
    """
    whole = conversations(turns)
    places = F.transform("turns", lambda t, i: F.when(t["role"] == LEARNED, i).otherwise(F.lit(-1)))
    told = whole.withColumn("last", F.coalesce(F.array_max(places), F.lit(-1)))
    lent = told.filter("last >= 0").select((F.col("conv_id") - 1).alias("to"), F.get("turns", F.col("last")).alias("reply"))
    both = told.join(lent, F.col("conv_id") == F.col("to"), "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    before = F.when(F.col("last") > 0, F.slice("turns", F.lit(1), F.greatest(F.col("last"), F.lit(0)))).otherwise(none)
    rejected = F.concat(before, F.when(F.col("reply").isNotNull(), F.array("reply")).otherwise(none))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("last") < 0, F.col("turns")).otherwise(rejected).alias("rejected"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")

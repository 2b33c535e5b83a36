"""Mixing sources to target weights by iterative proportional fitting.

The documents are counted once into cells (source, language, topic) with their
tokens.  Each cell has a factor, at first the share of tokens wanted overall.
Raking scales the factors in turn so that the tokens expected from each source,
then from each language, then from each topic meet their targets; rounds repeat.
A document is drawn with its cell's factor as probability, at most 1, and the
expected tokens are counted with that limit, so what a cell at its limit cannot
give is asked of the others.  The draw is a hash of the id: it repeats.

Built-in expressions only.  All rounds work on cells: sums are combined before
they are shuffled, joins are on margins, and each step of a round is written once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgweave.llm.common import Scratch

DIMS = ("source", "lang", "topic")
#: Share of all tokens to keep, and per dimension the power that flattens its shares.
BUDGET = 0.7
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.9}
ROUNDS = 12
MOST = 1e6
#: Hex digits of the draw.
DIGITS = 13
#: The words of the token count.
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def form_topic(text: Column, words: Column | None = None) -> Column:
    """A topic by the form of a text: list, caps or prose; `words` is its `n_tokens` where that is at hand."""
    # One byte each, and no pattern that matches at every other character.
    bars = 8 * (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("|"), F.lit(""))))
    return (
        F.when(text.isNull(), "none")
        .when(bars >= (n_tokens(text) if words is None else words), F.when(F.length(text) > 0, "list").otherwise("none"))
        .when(F.upper(text) == text, "caps")
        .otherwise("prose")
    )


def _described(docs: DataFrame, topic: Column | None) -> DataFrame:
    text = F.col("text")
    # Words are counted once: the topic reads their number.
    counted = docs.withColumn("n_tokens", n_tokens(text))
    return counted.withColumns(
        {
            "topic": F.coalesce(form_topic(text, F.col("n_tokens")) if topic is None else topic, F.lit("")),
            "_source": F.coalesce("source", F.lit("")),
            "_lang": F.coalesce("lang", F.lit("")),
        }
    )


def cell_counts(described: DataFrame) -> DataFrame:
    """source, lang, topic, tokens, docs"""
    keyed = described.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), "topic")
    return keyed.agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def flattened_targets(cells: DataFrame, flatten: Mapping[str, float] = FLATTEN) -> dict[str, DataFrame]:
    """Per dimension (value, weight): its tokens to a power below 1, so that small values gain."""
    return {d: cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(flatten[d])).alias("weight")) for d in DIMS}


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], scratch: Scratch, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """`cells` with factor, raked to `targets` ((value, weight) per dimension, any scale).

    A value without a weight gets none of its dimension's tokens.  A dimension
    whose weights sum to nothing is not raked.  A factor counts as 1 at most and is
    held at MOST, where a value has too few tokens for its target; `margin_errors`
    says which targets stay unmet.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    goals = {}
    for d, weights in targets.items():
        whole = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        if whole > 0:
            wanted = weights.select(F.col("value").alias(d), (F.col("weight") / whole * (budget * total)).alias("goal"))
            goals[d] = scratch.save(wanted, f"goal-{d}")
    here = cells.withColumn("factor", F.lit(float(budget)))
    for _ in range(rounds):
        for d, goal in goals.items():
            expected = here.groupBy(d).agg(F.sum(F.col("tokens") * F.least(F.col("factor"), F.lit(1.0))).alias("expected"))
            ratio = expected.join(goal, d, "left").select(
                d, F.when(F.col("expected") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("expected")).otherwise(1.0).alias("ratio")
            )
            here = here.join(ratio, d).withColumn("factor", F.least(F.col("factor") * F.col("ratio"), F.lit(MOST)))
            # A step reads the one before twice: unwritten, a round's plan would hold each eight times.
            here = scratch.save(here.select(*DIMS, "tokens", "docs", "factor"), "cells")
    return here


def margin_errors(raked: DataFrame, targets: Mapping[str, DataFrame], budget: float = BUDGET) -> DataFrame:
    """dimension, value, goal, expected, error: how far each margin of `rake`'s result is from its target, in shares of the goal.

    Rounds are fixed, and a factor counts as 1 at most, so a target above what a value
    has cannot be met; this says by how much.  A value without a goal has a null error.
    """
    total = raked.agg(F.coalesce(F.sum("tokens"), F.lit(0.0))).first()[0]
    out = []
    for d, weights in targets.items():
        whole = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        expected = raked.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.least("factor", F.lit(1.0))).alias("expected"))
        goal = weights.select("value", (F.col("weight") / F.lit(whole or 1.0) * (budget * total)).alias("goal"))
        both = expected.join(goal, "value", "full").select(F.lit(d).alias("dimension"), "value", "goal", F.coalesce("expected", F.lit(0.0)).alias("expected"))
        out.append(both.withColumn("error", F.try_divide(F.col("expected") - F.col("goal"), F.col("goal"))))
    return reduce(DataFrame.unionByName, out)


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id's hash; a null id is the empty text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def mix_to_targets(
    docs: DataFrame,
    topic: Column | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    seed: str = "mix",
) -> DataFrame:
    """`docs` (doc_id, text, source, lang, any others) with topic, n_tokens, probability and kept.

    Null sources and languages are the group "".  Null and empty texts have no
    tokens; they are drawn with their cell like the rest.  Rows with one doc_id
    share their draw.  An empty table stays empty; columns named like an output
    are replaced.
    """
    plain = docs.drop(*({"topic", "n_tokens", "probability", "kept", "_source", "_lang"} & set(docs.columns)))
    scratch = Scratch(docs.sparkSession, "raking")
    described = _described(plain, topic)
    cells = scratch.save(cell_counts(described), "counts")
    raked = rake(cells, targets or flattened_targets(cells), scratch, budget, rounds)
    chance = raked.select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", F.least("factor", F.lit(1.0)).alias("probability")
    )
    joined = described.join(chance, ["_source", "_lang", "topic"], "left")
    return joined.withColumn("kept", draw(F.col("doc_id"), seed) < F.col("probability")).select(
        *plain.columns, "topic", "n_tokens", "probability", "kept"
    )

"""The plans of raking's steps stay small, however many dimensions there are."""

import re

from kgweave.llm import raking
from kgweave.llm.common import Scratch


def test_a_step_reads_the_one_before_twice(spark):
    plans = []

    class Watched(Scratch):
        def save(self, df, name):
            plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
            return super().save(df, name)

    rows = [(s, t, p, float(10 + i), i) for i, (s, t, p) in enumerate([("a", "x", "q"), ("a", "y", "r"), ("b", "x", "r"), ("b", "y", "q")])]
    scratch = Watched(spark, "raking-plan")
    cells = scratch.save(spark.createDataFrame(rows, "source string, lang string, topic string, tokens double, docs bigint"), "counts")
    raked = raking.rake(cells, raking.flattened_targets(cells), scratch, rounds=2)
    assert raked.count() == 4
    # The step before, twice, and the step's goals.
    assert max(plan.count("Relation") for name, plan in plans if name == "cells") == 3


def test_words_are_counted_once_a_pass_and_bars_without_a_pattern(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "web")], "doc_id int, text string, lang string, source string")
    described = raking._described(docs, None)
    for df in (described, raking.cell_counts(described)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract_all(") + plan.count("regexp_count(") == 1
        assert "regexp_replace(" not in plan


def test_topics_and_counts(spark):
    texts = {1: "a|b c d e f g h i j", 2: "a|b|c|d", 3: "|", 4: "", 5: " \t\n", 6: None, 7: "ABC DEF 1", 8: "Abc", 9: "é|日本 x", 10: "a b\x0bc", 11: "É!"}
    docs = spark.createDataFrame([(i, t, "en", "web") for i, t in texts.items()], "doc_id int, text string, lang string, source string")
    got = {r.doc_id: (r.topic, r.n_tokens) for r in raking._described(docs, None).collect()}

    def plain(text):
        if text is None:
            return "none", 0
        n = len(re.findall(raking.WORD, text))
        if 8 * text.count("|") >= n:
            return "list" if text else "none", n
        return "caps" if text.upper() == text else "prose", n

    assert got == {i: plain(t) for i, t in texts.items()}

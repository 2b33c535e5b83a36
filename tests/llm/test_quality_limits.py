"""Cutoffs and verdicts of the quality rules against quantiles of sorted values."""

import collections
import math
import random
import re

from kgweave.llm import quality_rules


def quantile(values, q):
    values = sorted(values)
    return values[max(math.ceil(q * len(values)) - 1, 0)]


def ratios(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        len(re.findall(r"[#*$%&|<>]", text)) / len(words) if words else 0.0,
        (len(lines) - len(set(lines))) / len(lines) if lines else 0.0,
        sum(map(len, words)) / len(words) if words else 0.0,
    )


def fences(values):
    out = []
    for rule, column in zip(quality_rules.RULES, zip(*values, strict=True), strict=True):
        low, high, tail = (quantile(column, q) for q in (0.25, 0.75, quality_rules.TAIL))
        out.append(min(max(high + quality_rules.REACH * (high - low), tail + rule.margin), rule.ceiling))
    return out


def test_limits_and_verdicts(spark):
    """Sketches of this size hold every value, so they must agree with sorting."""
    rng = random.Random(21)
    rows = []
    for lang, source, n, share, length in (("en", "web", 90, 0.02, 5), ("en", "code", 80, 0.3, 7), ("de", "web", 70, 0.0, 14), ("de", "tiny", 10, 0.9, 3), (None, None, 12, 0.1, 5)):
        for _ in range(n):
            words = []
            for k in range(rng.randint(25, 60)):
                word = f"{k}" + "x" * max(1, round(rng.gauss(length, 2)))
                words.append(word + "#" * (rng.random() < share * rng.random() * 2))
                if rng.random() < 0.1:
                    words.append("\nagain again\n")
            rows.append((len(rows), " ".join(words), lang, source))
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").repartition(5)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, min_rows=60).collect()}
    groups = collections.defaultdict(list)
    for i, text, lang, source in rows:
        for key in ((lang, source), lang, "all"):
            groups[key].append(ratios(text))
    decided = 0
    for i, text, lang, source in rows:
        key = next(k for k in ((lang, source), lang, "all") if k == "all" or len(groups[k]) >= 60)
        limits, mine = fences(groups[key]), ratios(text)
        r = got[i]
        names = [f"limit_{rule.ratio}" for rule in quality_rules.RULES]
        assert all(math.isclose(r[name], limit, abs_tol=1e-9) for name, limit in zip(names, limits, strict=True))
        fine = all(x <= limit for x, limit in zip(mine, limits, strict=True))
        assert r.kept == (fine and not r.base_failed)
        decided += not fine
    assert 0 < decided < len(rows) / 2
    assert len({tuple(got[i][f"limit_{rule.ratio}"] for rule in quality_rules.RULES) for i in got}) >= 4

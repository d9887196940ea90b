"""The one-scan rules against a regex per category and per pattern."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions.text import category_regex, found, rule_trie, rules
from tarmac.operators.complaints import tag
from tests.test_plans import _plan

FILL = ["and", "xdelay", "delayé", "re", "nobag", "flight", "cancelled", "no", "not", "lost", "wi", "fi", "-", ".", ",", "é"]


def random_texts(rule_set, n, seed):
    """Texts of the patterns' own words, joined and prolonged in every way."""
    rng = np.random.default_rng(seed)
    words = [re.sub(r"\\w[*+]", rng.choice(["", "s", "ed", "ing"]), p[2:-2]).replace("?", "")
             for _, patterns in rule_set for p in patterns]
    parts = [w for x in words for w in x.split()] + words + FILL
    seps = [" ", " ", " ", "  ", "-", ", ", "", "\n"]
    out = []
    for _ in range(n):
        k = rng.integers(0, 9)
        text = "".join(str(rng.choice(parts)) + str(rng.choice(["", "", "", "s", "d"])) + str(rng.choice(seps))
                       for _ in range(k))
        out.append(text.title() if rng.random() < 0.2 else text)
    return out + ["", None, "lost baggage", "no refund pending", "Refund Pending refunds", "wifi wi-fi", "deniedd denied"]


def brute(text, rule_set):
    t = (text or "").lower()
    category = next((c for c, ps in rule_set if any(re.search(p, t) for p in ps)), "Other")
    hits = {m.group(0) for _, ps in rule_set for p in ps if (m := re.search(p, t))}
    return category, sorted(hits)


@pytest.mark.parametrize("name", ["dashboard", "notebook"])
def test_one_scan_equals_a_regex_per_pattern(spark, name):
    rule_set = rules(name)
    texts = random_texts(rule_set, 1500, 4)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    for r in tag(df, text="t", rule_set=rule_set).collect():
        assert (r.category, r.matched_keywords) == brute(r.t, rule_set), r.t


def test_the_trie_writes_common_beginnings_once():
    trie = rule_trie([("a", [r"\bflight cancell\w*\b", r"\bflight delayed\b", r"\bflight\b"])])
    assert trie.count("f") == 1 and re.findall(rf"\b(?=({trie}))", "flight, flight cancelled") == ["flight", "flight cancelled"]
    with pytest.raises(ValueError):
        rule_trie([("a", ["delay"])])


def test_the_text_is_read_by_one_expression(spark):
    df = spark.createDataFrame([("late bag",)], "t string").repartition(2).select("t")
    plan = tag(df, text="t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert not re.search(r"RLIKE\(lower|lower\(t#\d+\) RLIKE|regexp_substr\(lower", plan, re.I)

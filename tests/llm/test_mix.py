"""Shares, caps and the emission at integer crossings."""

import math
from collections import Counter

import pytest

from logothek.llm.mix import mixed, plan, shares

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3)]


def sized(spark, hot=900):
    rows = [(i, "a", 100 + i % 37) for i in range(hot)] + [(10_000 + i, "b", 50) for i in range(300)] + [(20_000 + i, "c", 80 + i) for i in range(40)] + [(30_000 + i, "other", 10) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long"), rows


def test_emission_is_systematic(spark):
    df, rows = sized(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    got = [(r.doc_id, r.source, r.copy_no) for r in mixed(df, targets).collect()]
    have = Counter()
    for _, s, n in rows:
        have[s] += n
    e = plan(dict(have), {s: w for s, w, _ in TARGETS}, {s: m for s, _, m in TARGETS})
    times = Counter(d for d, _, _ in got)
    for d, s, _ in rows:
        want = e.get(s, 0)
        assert math.floor(want) <= times[d] <= math.ceil(want)
    assert max(c for _, _, c in got) <= 4 and not any(s == "other" for _, s, _ in got)
    rep = {r.source: r for r in shares(df, mixed(df, targets), targets).collect()}
    assert rep["none"].actual_share == 0
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert rep[s].actual_share == pytest.approx(w / 0.9, abs=0.01)


def test_caps_by_water_filling():
    e = plan({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 5, "b": 2}, total=120)
    assert e == {"a": 1.0, "b": 2.0}
    assert plan({}, {"a": 1.0}, {"a": 1}) == {}


def test_empty(spark):
    df, _ = sized(spark)
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mixed(df.limit(0), targets).count() == 0

"""The automaton against a plain rewriting of each text."""

import unicodedata as ud
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logothek.llm import consistent as c

ALIKE = {x: g.split() for g in c.LOOK_ALIKE for x in g.split()}


def plain(s, order):
    """Brute force: remove, replace and compose code point by code point, then settle each word's alphabet."""
    s = "".join("" if c.invisible(x) else " " if x.isspace() else c.APOSTROPHE if x in c.APOSTROPHES else c.ordinary(x) for x in s)
    out = []
    for w in s.split():
        w = ud.normalize("NFC", w)
        n = Counter(a for x in w if (a := c.alphabet(x)))
        if len(n) > 1:
            most = sorted(n, key=lambda k: (-n[k], order[k]))[0]
            parts = []
            for x in ud.normalize("NFD", w):
                if (a := c.alphabet(x)) and a != most:
                    x = next((y for y in ALIKE.get(x, ()) if c.alphabet(y) == most), x)
                parts.append(x)
            w = ud.normalize("NFC", "".join(parts))
        out.append(w)
    return " ".join(out)


PIECES = [*"αοερτνυγκχabopvuyаокрсі0９'᾿’ʼ.  µ", "́", "̓", "ͅ", "​", "\xad", " ", "﻿", "ά", "ά", "á", "ό", "ﬁ", "ᾧ", "ὧ", "Ａ"]
FREQ = Counter("".join(PIECES) + "αβγδεάέήίόύώἀἁἐἡὀῃῆῖῦῳῶῷ" * 3)
REWRITER = c.Rewriter(*c.rules(FREQ), tuple(sorted(FREQ)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_text_is_rewritten_as_by_brute_force(s):
    got = REWRITER.text(s)
    assert got == plain(s, REWRITER.order)
    assert REWRITER.array(pa.array([s, None, got])).to_pylist() == [got, None, got]


def test_cases(spark):
    rows = spark.createDataFrame(
        [(1, "λόγος"), (2, "λόγος"), (3, "λόγoς"), (4, "λόγος​"), (5, None), (6, ""), (7, "  ​"), (8, "δ'"), (9, "ａｂ１"), (10, "α  β"), (11, "λόγος" * 4000), (12, "λόγoς" * 4000), (2, "λόγος")],
        "row_id long, form string",
    ).withColumn("text", F.lit("clash"))
    got = {(r.row_id, r.form): r.consistent_text for r in c.consistent_texts(rows, text="form").collect()}
    assert {got[k] for k in got if k[0] < 5} == {"λόγος"}
    assert [got[k] for k in got if k[0] in (5, 6, 7)] == [None, "", ""]
    assert got[8, "δ'"] == "δ’" and got[9, "ａｂ１"] == "ab1" and got[10, "α  β"] == "α β"
    assert got[12, "λόγoς" * 4000] == "λόγος" * 4000
    bad = [r.row_id for r in c.inconsistent_rows(rows, text="form").collect()]
    assert sorted(bad) == [3, 4, 7, 8, 9, 10, 12]
    assert c.consistent_texts(rows.limit(0), text="form").count() == 0


def test_classes_are_transitive():
    classes = c.look_alike_classes("oοо９ϐ")
    o = next(v for v in classes.values() if "o" in v)
    assert {"o", "ο", "о"} <= o
    assert any({"９", "9"} <= v for v in classes.values())


def test_frequency_decides_between_letters_of_one_alphabet():
    groups = (*c.LOOK_ALIKE, "I l ı")
    for freq, want in (({"I": 5, "l": 9, "ı": 1, "a": 2}, "l"), ({"I": 9, "l": 5, "ı": 1, "a": 2}, "I"), ({"I": 1, "l": 2, "ı": 3, "a": 2}, "ı")):
        r = c.Rewriter(*c.rules(freq, groups), tuple(freq))
        assert r.text("aIlı a") == f"a{want * 3} a"
        assert r.array(pa.array(["Ia", f"{want}a"])).to_pylist() == [f"{want}a"] * 2


def test_one_evaluation(spark):
    rows = spark.createDataFrame([(1, "λόγoς")], "row_id long, form string")
    plan = c.inconsistent_rows(rows, text="form").select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan

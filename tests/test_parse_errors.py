"""The least-cost parse against trying all edits, and each defined case."""

import itertools
import re
import time

from pyspark.sql import functions as F

from logothek.operators.parse_errors import _FREE, failures, fields_of, least_edits, loaded, parse

CODES = {i: frozenset("nv-") for i in range(1, 10)}


def brute(s, columns, most):
    """Least number of inserted or deleted quotes and tabs, by breadth first search over strings."""
    def any_ok(x):
        return bool(_FREE.fullmatch(x))

    front, seen, any_cost = {s}, {s}, None
    for cost in range(most + 1):
        if any_cost is None and any(map(any_ok, front)):
            any_cost = cost
        if any(any_ok(x) and len(fields_of(x)) == columns for x in front):
            return any_cost, cost
        nxt = set()
        for x in front:
            for i in range(len(x) + 1):
                nxt |= {x[:i] + c + x[i:] for c in '"\t'}
                if i < len(x) and x[i] in '"\t':
                    nxt.add(x[:i] + x[i + 1 :])
        front = nxt - seen
        seen |= nxt


def test_least_edits_as_by_brute_force():
    for n in range(1, 6):
        for p in itertools.product('a"\t', repeat=n):
            s = "".join(p)
            any_cost, cost, edits = least_edits(s, 3)
            assert (any_cost, cost) == brute(s, 3, 5), repr(s)
            assert len(edits) == cost and mended(s, edits), repr(s)


def mended(s, edits):
    """Whether the edits give a well-formed record of three fields."""
    by = {}
    for e in edits:
        (what, name), at = e.split("@")[0].split(), int(e.split("@")[1])
        by.setdefault(at, []).append((what, "\t" if name == "tab" else '"'))
    out = []
    for i in range(len(s) + 1):
        out += [c for what, c in by.get(i, ()) if what == "insert"]
        if i < len(s) and not any(what == "delete" and c == s[i] for what, c in by.get(i, ())):
            out.append(s[i])
    x = "".join(out)
    return bool(_FREE.fullmatch(x)) and len(fields_of(x)) == 3


def test_edits_of_the_corpus(spark):
    """Every failing record of the smallest tables is mended by its edits, and none by fewer."""
    d = "/root/testdata/sf0.001"
    records, tags = spark.read.parquet(f"{d}/lingann_gs_medievalgreek.parquet"), spark.read.parquet(f"{d}/morph_tags.parquet")
    raw = {r.line_id: r.raw for r in records.collect()}
    rows = failures(records, tags).where("reason <> 'value'").collect()
    assert rows
    for r in rows:
        s = raw[r.line_id].removeprefix("\ufeff").removesuffix("\r")
        assert mended(s, r.edits), repr(s)
        short = "".join(c[0] if c[0] in '"\t' else "x" for c in re.findall(r'\t|"|[^\t"]+', s))
        assert len(r.edits) == brute(short, 3, 4)[1], repr(s)


def test_many_stray_quotes():
    s = 'x"' * 6400 + "\tn--------\tb"
    start = time.process_time()
    any_cost, cost, edits = least_edits(s, 3)
    assert any_cost > 0 and cost == len(edits) and mended(s, edits)
    assert time.process_time() - start < 2


def test_clean_records_are_not_parsed(spark):
    df = spark.createDataFrame([(1, "a\tn--------\tb")], "line_id long, raw string")
    tags = spark.createDataFrame([(i, c) for i in range(1, 10) for c in 'n-]^\\"'], "slot int, code string")
    for f in (failures, loaded):
        plan = f(df, tags)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in loaded(df, tags).collect()] == [(1, "a", "n--------", "b")]

def test_reasons():
    ok = "λόγου\tn--------\tλόγος"
    cases = {
        ok: ("row", None), "﻿" + ok + "\r": ("row", None), None: ("break", None), " \t ": ("break", None), "": ("break", None),
        '"a\tb"\tn--------\t"x""y"': ("row", None), '"a\tn--------\tb': ("error", "quoting"), '"a"b\tn--------\tc': ("error", "quoting"), 'a"\tn--------\tc': ("error", "quoting"),
        "a\tn--------": ("error", "columns"), "a\tn--------\tb\tc": ("error", "columns"), "a\tn-------\tb": ("error", "value"), "a\tq--------\tb": ("error", "value"),
        " \tn--------\tb": ("error", "value"), "a�\tn--------\tb": ("error", "value"), "a\tn--------\tb\x07": ("error", "value"), "\tn--------\tb": ("error", "value"),
        '"a\n"\tn--------\tb': ("row", None),
    }
    for s, want in cases.items():
        p = parse(s, CODES)
        assert (p["kind"], p["reason"]) == want, repr(s)
    p = parse('"a\tb"\tn--------\t"x""y"', CODES)
    assert (p["form"], p["lemma"]) == ("a\tb", 'x"y')


def test_tables(spark):
    long = "α" * 200_000
    rows = [(1, "a\tn--------\tb"), (2, 'a"'), (2, 'a"'), (3, None), (4, f"{long}\tn--------\t{long}"), (5, f'"{long}"x' + '"' * 9)]
    df = spark.createDataFrame(rows, "line_id long, raw string").withColumn("reason", F.lit("clash")).withColumn("parsed", F.lit(1))
    tags = spark.createDataFrame([(i, c) for i in range(1, 10) for c in "n-"] + [(None, "x"), (1, None)], "slot int, code string")
    assert sorted((r.line_id, r.reason) for r in failures(df, tags).collect()) == [(2, "quoting"), (2, "quoting"), (5, "quoting")]
    assert sorted(r.line_id for r in loaded(df, tags).collect()) == [1, 4]
    assert failures(df.limit(0), tags).count() == 0 and loaded(df.limit(0), tags).count() == 0

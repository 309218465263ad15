"""Held-out accuracy of the induced rules, the exported SQL against the rules, and each defined case."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logothek.llm import quality as q

from labelled import LABELLED


def predicted(rules, x):
    out, left = np.full(len(x), "prose", dtype="<U5"), np.ones(len(x), bool)
    for label, rule in rules:
        m = left & q.covers(rule, x)
        out[m], left = label, left & ~m
    return out


@pytest.fixture(scope="module")
def rules(spark):
    return q.learned_rules()


def test_held_out(spark, rules):
    x, y = q.labelled_features(spark, 160, seed=99)
    assert (predicted(rules, x) == y).mean() > 0.96
    assert {label for label, _ in rules} == set(q.LABELS)


def test_sql_is_the_rule_list(spark, rules):
    rows = [(i, s) for i, (_, lines) in enumerate(q.labelled_documents(40, seed=5)) for s in lines if s.strip()]
    df = q.with_features(spark.createDataFrame(rows, "doc_id long, s string").withColumn("tabs", F.lit(0))).withColumn("k", q.line_kind(rules)).toPandas()
    assert (predicted(rules, df[q.NAMES].to_numpy(float)) == df["k"].to_numpy(str)).all()


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test data")
def test_checked_by_reading(spark, rules):
    """Precision and recall of each kind on documents whose kind was checked by reading; see the note there."""
    truth = {i: k for k, ids in LABELLED.items() for i in ids}
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(*truth))
    got = {r.doc_id: r.kind for r in q.not_prose(docs, rules).collect()}
    assert len(truth) >= 200
    for kind in q.LABELS:
        want, found = {i for i, k in truth.items() if k == kind}, {i for i, k in got.items() if k == kind}
        assert len(want & found) >= 0.98 * len(want) and len(want & found) >= 0.98 * len(found), (kind, want ^ found)
    assert not set(got) & set(LABELLED["blank"])


def srt(lines):
    return "".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{s}\n\n" for i, s in enumerate(lines))


def test_documents(spark, rules):
    talk = ["I don't know what you mean.", "Where did you put the lamp?", "- Come with me, Zuro.", "[sighs]", "WE ARE ALL LATE, BUT NOBODY SAYS IT"]
    rows = [
        (1, srt(talk)), (2, srt(["- two lamps", "• rope", "* onions"])), (3, srt(["Zuro  12  14.50  03:21", "Mava  7  3.10  11:09"])), (4, srt(["c3 9f 01 aa 7b", "a0 11 fe 3c"])),
        (5, None), (6, ""), (7, " \n \r\n"), (8, "WEBVTT\n\n00:01.000 --> 00:02.000\n"), (9, "{10}{20}" + "|".join(talk) + "\n{30}{40}- rope"), (10, srt(talk * 3000)), (11, srt(["- rope", "- soap", *talk[:2]])), (1, srt(talk)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit("clash")).withColumn("kind", F.lit("clash"))
    assert {(r.doc_id, r.kind) for r in q.not_prose(df, rules).collect()} == {(2, "list"), (3, "table"), (4, "junk")}
    stats = {r.doc_id: r for r in q.document_statistics(df, rules).collect()}
    assert len(stats) == 11 and stats[1].n_lines == 10 and stats[9].n_lines == 6 and stats[10].n_lines == 15_000
    assert all(stats[i].kind is None and stats[i].n_lines == 0 and stats[i].mean_word_length is None for i in (5, 6, 7, 8))
    assert stats[11].kind == "prose" and 0 < stats[1].common_share < 1
    assert q.not_prose(df.limit(0), rules).count() == 0 and q.document_statistics(df.limit(0), rules).count() == 0

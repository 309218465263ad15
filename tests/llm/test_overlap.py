"""The prefix-filter join against comparing all pairs."""

import random

from logothek.llm import overlap
from logothek.llm.overlap import fold, folded_pairs, overlap_pairs, overlap_report


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 6 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_pairs_as_by_brute_force(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("αβγ") for _ in range(rnd.randint(4, 9))) for _ in range(60)]

    def edit(w):
        i = rnd.randrange(len(w) + 1)
        return rnd.choice([w, w[:i] + "α" + w[i:], w[:i] + w[i + 1 :], w.upper(), f"({w})", w])

    data = [(i, rnd.choice([edit(rnd.choice(words)), None, "", " ", "()"]) if rnd.random() < 0.1 else edit(rnd.choice(words)), rnd.choice(["λα", "λβ", "ΛΑ", None, ""]), rnd.choice(["train", "train", "dev", "test", "other", None]), rnd.choice(["ag", None])) for i in range(900)]
    data += [(1000 + i, words[0], "λα", "train", "ag") for i in range(300)]  # a group of copies with a quarter of the rows
    df = spark.createDataFrame(data, "pair_id long, form string, lemma string, split string, source string")
    found = overlap_pairs(df)
    got = sorted((r.eval_id, r.train_id) for r in found.collect())
    f = [(i, fold(a or ""), fold(b or ""), s) for i, a, b, s, _ in data]
    ev, tr = [x for x in f if x[3] in ("dev", "test") and x[1] and x[2]], [x for x in f if x[3] == "train" and x[1] and x[2]]
    want = sorted((e[0], t[0]) for e in ev for t in tr if e[2] == t[2] and near(e[1], t[1]))
    assert got == want and want
    rep = overlap_report(df, found).collect()
    assert sum(r.n_pairs for r in rep) == len(want)
    assert sum(r.n_rows for r in rep) == sum(x[3] in ("dev", "test") for x in data)


def test_empty_and_fold(spark):
    df = spark.createDataFrame([], "pair_id long, form string, lemma string, split string, source string")
    assert overlap_pairs(df).count() == 0
    assert fold("«Λόγος·»") == "λογοσ" and fold("  ") == "" and fold("ᾧ") == "ω"


def test_prefixes_and_plan(spark):
    rank = overlap.bucket_ranks(spark.createDataFrame([("αααα",), ("αααβ",)], "form string"))
    row, gram, at = overlap.prefix_rows(["αααααααα", "αβ"], rank)
    assert row.tolist() == [0, 0, 0, 1] and len(set(gram.tolist())) >= 2 and max(at.tolist()) <= 8
    df = spark.createDataFrame([(1, "λόγος", "λόγος", "train", "ag")], "pair_id long, form string, lemma string, split string, source string")
    plan = folded_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_long_forms(spark):
    long = "αβγδ" * 5000
    df = spark.createDataFrame([(1, long, "λ", "train", "ag"), (2, long[:-1], "λ", "dev", "ag"), (3, long + "γγ", "λ", "test", "ag")], "pair_id long, form string, lemma string, split string, source string")
    assert [(r.eval_id, r.train_id, r.exact) for r in overlap_pairs(df).collect()] == [(2, 1, False)]

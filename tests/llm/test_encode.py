"""Tree reduction against encoding at once, and the round trip."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from logothek.llm.encode import MonoidEncoder, counted_rows, encoded, encoder, ids_lists, text_column


def test_any_leaf_gives_the_same_ids():
    e, rnd = encoder(), random.Random(3)
    for _ in range(3000):
        s = "".join(rnd.choice("ab1я一。! \n\t\r é́.'s<>|-λ’　​😀A¼²") for _ in range(rnd.randint(0, 80)))
        m = MonoidEncoder(e.base, e.decode_bytes, leaf=rnd.randint(2, 9), window=rnd.randint(1, 9))
        assert m.encode(s).tolist() == e.base(s).tolist() if s else not len(m.encode(s)), repr(s)
        assert m.decode(m.encode(s)) == s


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a" * 30_000), (5, "The end. " * 9000), (6, "<|endoftext|>"), (6, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in encoded(df).collect()]
    base = encoder().base
    assert sorted(got) == sorted((i, base(t).tolist() if t else []) for i, t in rows)
    assert sorted(r.t for r in encoded(df).select(text_column(F.col("ids")).alias("t")).collect()) == sorted(t or "" for _, t in rows)
    sized = counted_rows(df.select("doc_id", "text"))
    assert sorted((r.doc_id, r.n_tokens) for r in sized.collect()) == sorted((i, len(base(t))) for i, t in rows if t)
    plan = sized.where("n_tokens > 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    assert encoded(df.limit(0)).count() == 0


def test_slices_are_bounded():
    texts = pa.array(["one two three", None, "", "four five six seven"] * 50)
    parts = list(ids_lists(texts, encoder(), slice_ids=20))
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[-1][1] == len(texts)
    assert max(len(p[2].flatten()) for p in parts) < 20 + 5
    assert [x for p in parts for x in p[2].to_pylist()] == [encoder().encode(t.as_py()).tolist() for t in texts]


def test_text_without_cuts_is_encoded_about_once():
    calls = []
    e = encoder()
    m = MonoidEncoder(lambda s: calls.append(len(s)) or e.base(s), leaf=64)
    s = "ab" * 4000
    assert m.encode(s).tolist() == e.base(s).tolist() and sum(calls) == len(s)
    calls.clear()
    s = "ab" * 4000 + " and then. " * 2000
    assert m.encode(s).tolist() == e.base(s).tolist() and sum(calls) < 5 * len(s)

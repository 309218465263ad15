"""Branch and bound against trying all choices."""

import itertools
import random
from datetime import datetime

from logothek.llm.survivors import Bundle, Dependency, survivors

SCHEMA = "row_id long, k string, a string, b string, c string, trust int, at timestamp, text string"


def brute(rows, deps):
    out = {}
    groups = {}
    for r in rows:
        if r[1] and r[1].strip():
            groups.setdefault(r[1], []).append(r)
    rank = lambda r: (-(r[5] or 0), -(r[6].timestamp() if r[6] else -1e18), r[0])
    for k, rs in groups.items():
        if len(rs) < 2:
            continue
        rs = sorted(rs, key=rank)
        cands = []
        for fields in ((2, 3), (4,)):
            best = {}
            for r in rs:
                v = tuple(r[f] for f in fields)
                if None not in v and v not in best:
                    best[v] = r[5] or 0
            cands.append([(t, i, v) for i, (v, t) in enumerate(best.items())])
        det = {}
        if deps:
            for r in rs:
                if r[2] is not None and r[4] is not None:
                    det.setdefault(r[2], r[4])
        best = None
        for x, y in itertools.product([*cands[0], None], [*cands[1], None]):
            if deps and x and y and det.get(x[2][0], y[2][0]) != y[2][0]:
                continue
            v = ((x[0] if x else 0) + (y[0] if y else 0), -(x[1] if x else 1 << 62), -(y[1] if y else 1 << 62))
            if best is None or v > best[0]:
                best = (v, x, y)
        x, y = best[1], best[2]
        out[k] = (min(r[0] for r in rs), len(rs), *(x[2] if x else (None, None)), y[2][0] if y else None)
    return out


def rows(seed, n=160, keys=25):
    rnd = random.Random(seed)
    pick = lambda x: rnd.choice(x)
    return [(i, pick([*(f"k{j}" for j in range(keys)), "hot", "hot", "hot", "", None]), pick("pqr") if rnd.random() > 0.2 else None, pick("xy"), pick("uvw") if rnd.random() > 0.2 else None, pick([0, 10, 10, 30, 50, None]), pick([None, datetime(2020, 1, 1), datetime(2021, 1, 1)]), "extra") for i in range(n)]


BUNDLES = [Bundle("one", ("a", "b")), Bundle("two", ("c",))]


def got(df):
    return {r.k: (r.group_id, r.n_records, r.a, r.b, r.c) for r in df.collect()}


def test_without_dependencies(spark):
    data = rows(1)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(survivors(df, ["k"], BUNDLES, "trust", "at", "row_id")) == brute(data, False)


def test_with_dependency_and_small_levels(spark):
    data = rows(2)
    df = spark.createDataFrame(data, SCHEMA)
    assert got(survivors(df, ["k"], BUNDLES, "trust", "at", "row_id", [Dependency("a", "c")], level=1)) == brute(data, True)


def test_empty(spark):
    assert survivors(spark.createDataFrame([], SCHEMA), ["k"], BUNDLES, "trust", "at", "row_id").count() == 0


def test_dependency_in_a_hot_group(spark):
    # one group has nearly all rows and hundreds of values that no source determines: they are pruned to the best
    rnd = random.Random(4)
    data = [(i, "hot", rnd.choice("pq") if i < 6 else None, "x", f"v{i}" if i % 7 else "w", rnd.choice([10, 30]), datetime(2020, 1, 1), "") for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(survivors(df, ["k"], BUNDLES, "trust", "at", "row_id", [Dependency("a", "c")], level=2)) == brute(data, True)


def test_lexicon_without_broadcast(spark, monkeypatch):
    """The same survivors when no side is small enough to be broadcast: ids and keys joined by shuffle, hot ones salted."""
    from logothek.llm.survivors import Dependency as D
    from logothek.llm.survivors import lexicon_survivors
    from logothek.operators import skew

    rnd = random.Random(8)
    lookup = [(i, rnd.choice(["a", "b", "c", "hot", "hot", "hot", " ", "", None]), rnd.choice([1, 2, 3, 9, None, 1, 1]), rnd.choice(["x", " X", "y", "?", None]), rnd.choice(["all", "el"]), rnd.choice([None, datetime(2020, 1, 1), datetime(2021, 1, 1)])) for i in range(400)]
    tables = (
        spark.createDataFrame(lookup, "row_id long, form string, lemma_id long, src string, lang string, updated_at timestamp"), spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        spark.createDataFrame([("x", 9), ("Y", 5)], "src string, trust int"),
    )
    for deps in ((), (D("src", "lemma_id"),)):
        want = sorted(map(tuple, lexicon_survivors(*tables, dependencies=deps).collect()))
        monkeypatch.setattr(skew, "small_enough", lambda df, limit=0: False)
        assert sorted(map(tuple, lexicon_survivors(*tables, dependencies=deps).collect())) == want and len(want) >= 8
        monkeypatch.undo()

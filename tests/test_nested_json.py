"""Structural indexing against walking parsed objects."""

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logothek.operators.nested_json import NODES, Index, entry_table, field_table, node_rows, node_tags, nodes


def brute(i, s):
    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                p = (path + "." if path else "") + k
                if k in NODES:
                    for n, y in enumerate(x if isinstance(x, list) else [x]):
                        if y is not None:
                            q = f"{p}[{n}]"
                            tags = y.get("tags") if isinstance(y, dict) else None
                            tags = tags if isinstance(tags, list) else [tags]
                            kept = [(i, q, m, t) for m, t in enumerate(tags) if t is not None]
                            yield from kept or [(i, q, -1, "")]
                            yield from walk(y, q)
                elif isinstance(x, list):
                    for n, y in enumerate(x):
                        yield from walk(y, f"{p}[{n}]")
                else:
                    yield from walk(x, p)
        elif isinstance(v, list):
            for n, y in enumerate(v):
                yield from walk(y, f"{path}[{n}]")

    yield from walk(json.loads(s), "")


WORDS = st.text(alphabet='aé"\\{}[]:, \n\tλ😀', max_size=6)
TAGS = st.none() | WORDS | st.lists(st.none() | WORDS, max_size=3)
TREE = st.recursive(
    st.none() | WORDS | st.integers() | st.booleans(),
    lambda x: st.lists(x, max_size=3)
    | st.dictionaries(st.sampled_from(["word", "inflection", "table", "x\"y", ""]), x, max_size=3)
    | st.fixed_dictionaries({}, optional={"forms": st.none() | WORDS | st.dictionaries(st.sampled_from(["form", "z"]), x, max_size=2) | st.lists(st.none() | WORDS | st.fixed_dictionaries({}, optional={"tags": TAGS, "senses": x.filter(lambda v: not isinstance(v, (int, bool, list)))}), max_size=3), "tags": TAGS}),
    max_leaves=14,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "entry", "senses"]), TREE, max_size=2), max_size=4), st.booleans(), st.booleans())
def test_as_by_walking(objects, ascii_only, spaced):
    texts = [json.dumps(o, ensure_ascii=ascii_only, separators=(", ", " : ") if spaced else (",", ":")) for o in objects]
    rows, ok = node_rows(pa.array(range(len(texts)), pa.int64()), [t.encode() for t in texts])
    got = []
    for e, p, ns, ts in zip(*(rows[c].to_pylist() for c in ("entry_id", "node_path", "tag_nos", "tags")), strict=True):
        got += [(e, p, n, t) for n, t in zip(ns, ts, strict=True)] or [(e, p, -1, "")]
    assert all(ok)
    assert sorted(got) == sorted(x for i, s in enumerate(texts) for x in brute(i, s))


def refuse(_):
    raise ValueError


def well_formed(s):
    try:
        return isinstance(json.loads(s, parse_constant=refuse), (dict, list))
    except ValueError:
        return False


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(TREE, st.integers(0, 400), st.sampled_from(['"', "{", "}", "[", "]", ",", ":", "\\", "1", " ", "x", "-", "null", "", "\x01", "\n"]), st.integers(0, 2)), max_size=5))
def test_well_formed_as_the_library_says(cases):
    texts = []
    for tree, at, piece, drop in cases:
        s = json.dumps(tree, ensure_ascii=False)
        at %= len(s) + 1
        texts.append(s[:at] + piece + s[at + drop :])
    assert Index([t.encode() for t in texts]).ok.tolist() == [well_formed(t) for t in texts]


def test_tables(spark):
    deep = '{"forms":[{"tags":"t","forms":' * 300 + "null" + "}]}" * 300
    rows = [
        (1, '{"word":"w","forms":[null,{"form":"f","tags":["x",null,"y"],"forms":"g"},"bare"],"senses":{"glosses":["gl"],"tags":null}}'),
        (2, None), (3, ""), (4, '{"forms":["a"'), (5, '{"forms":["a]}'), (6, deep), (1, '{"forms":[]}'), (7, '{"forms":"' + "α" * 300_000 + '"}'),
    ]
    df = spark.createDataFrame(rows, "entry_id long, entry_json string").withColumn("tags", F.lit("clash"))
    found = nodes(df)
    tags = [tuple(r) for r in node_tags(found).collect()]
    assert sorted(t for t in tags if t[0] == 1) == [(1, "forms[1]", 0, "x"), (1, "forms[1]", 2, "y"), (1, "forms[1].forms[0]", -1, ""), (1, "forms[2]", -1, ""), (1, "senses[0]", -1, "")]
    assert sum(t[0] == 6 for t in tags) == 599 and not any(t[0] in (2, 3, 4, 5) for t in tags)
    forms = {(r.entry_id, r.node_path): (r.parent_path, r.position, r.text) for r in field_table(found, "forms").where("entry_id = 1").collect()}
    assert forms == {(1, "forms[1]"): ("", 1, "f"), (1, "forms[1].forms[0]"): ("forms[1]", 0, "g"), (1, "forms[2]"): ("", 2, "bare")}
    assert field_table(found, "senses").where("entry_id = 1").first().text == "gl"
    ok = sorted((r.entry_id, r.ok) for r in entry_table(df).collect())
    assert ok == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True)]
    assert nodes(df.limit(0)).count() == 0

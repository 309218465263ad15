"""Queries over whole inputs against word-at-a-time Python, on small tables with capitals, other letters and rare words."""

import re
import unicodedata as ud
from collections import Counter

import pytest

from logothek.operators import fuzzy as Z
from logothek.plans.registry import queries

HEADS = {1: "λόγος", 2: "Ἀθηναῖος", 3: "λύω", 4: "Ὀδυσσεύς", 5: "δι’ ὅλου", 6: "homo", 7: "λόγoς", 8: "ἀλλά"}
LOOKUP = [("λόγος", 1), ("λόγου", 1), ("λόγον", 1), ("Ἀθηναῖος", 2), ("ἀθηναίου", 2), ("ἔλυσα", 3), ("λύω", 3), ("ὀδυσσεύς", 4), ("ἀλλά", 8), ("λύεις", 3)]
PAIRS = [("Λόγος", "λόγος"), ("ΛΌΓΟΥ", "λόγος"), ("ΟΔΥΣΣΕΥΣ", "Ὀδυσσεύς"), ("λόγον", "λόγος"), ("Ἔλυσα", "λύω"), ("λύεις", "λύω"), ("Ξένος", "ξένος")]


def bare(s):
    return ud.normalize("NFC", "".join(c for c in ud.normalize("NFD", s.lower()) if ud.category(c) != "Mn"))


def key(s):
    return bare(s).replace("ς", "σ")


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write([(i, f, k, "grc", "all") for i, (f, k) in enumerate(LOOKUP)], "row_id long, form string, lemma_id long, src string, lang string", "lookup")
    write([(k, t, "noun") for k, t in HEADS.items()], "id long, text string, pos string", "lemmas")
    write([(i, f, m, "noun", ["x"], "dev", "ag") for i, (f, m) in enumerate(PAIRS)], "pair_id long, form string, lemma string, pos string, tags array<string>, split string, source string", "lemmapairdataset")
    return d


def rows(spark, small, name):
    return queries()[name](spark, small).collect()


def test_capitals(spark, small):
    table = {f: HEADS[k] for f, k in LOOKUP}

    def one(w):  # accents kept, then dropped; no grave or breathing differs here
        mono = lambda s: ud.normalize("NFC", "".join("́" if c in "̀͂" else c for c in ud.normalize("NFD", s) if c not in "̓̔̄̆ͅ"))
        return next((table[k] for k in (w, w.lower(), mono(w.lower()), bare(w)) if k in table), None)

    want = {f: one(f) for f, _ in PAIRS}
    assert {r.word: r.lemma for r in rows(spark, small, "cascade_lookup")} == want
    assert want["ΛΌΓΟΥ"] == want["Λόγος"] == "λόγος"
    total = [r for r in rows(spark, small, "accuracy_rollup") if r.split is None and r.source is None]
    right = sum((want[f] or "").strip().lower() == m.strip().lower() for f, m in PAIRS)
    assert [(r.n, r.strict) for r in total] == [(len(PAIRS), round(100 * right / len(PAIRS), 2))]
    assert {r.word: r.stripped for r in rows(spark, small, "normalisation_keys")}["Ἔλυσα"] == "Ελυσα"
    for name in ("language_of_form", "pos_override"):
        assert {r.word for r in rows(spark, small, name)} == {f for f, _ in PAIRS}
    assert {f for f, _ in PAIRS} <= {r.key for r in rows(spark, small, "key_fan_out")}
    assert {r.word for r in rows(spark, small, "particle_strip")} >= {"Λόγοςγε", "Ἔλυσαπερ"}
    for name in ("elision_expand", "compound_split", "elision_pairs", "accuracy_by_frequency", "accuracy_with_equivalents"):
        rows(spark, small, name)


def test_headwords_of_any_letters(spark, small):
    keys = {key(t) for t in HEADS.values()}
    assert {"homo", "δι’ ολου", "λογoσ"} <= keys
    near = {(r.q, r.key, r.ed) for r in rows(spark, small, "spell_ed1")}
    qs = {r.q for r in rows(spark, small, "spell_staged")}
    assert {q for q, _, _ in near} <= qs
    assert {(q, k, n) for q in qs for k in keys if (n := Z.damerau(q, k)) <= 1} == near
    assert {"homo", "δι’ ολου", "λογoσ"} <= {k for _, k, _ in near} and {k for _, k, _ in near} == {k for k in keys if len(k) >= 4}
    ranges = [("α", "αδ"), ("κρ", "γ"), ("μ", "ξ"), ("ω", "ω")]
    assert {(r.key, r.lo, r.hi) for r in rows(spark, small, "range_join")} == {(k, a, b) for k in keys for a, b in ranges if min(a, b) < k < max(a, b)}
    assert {"homo", "δι’ ὅλου"} <= {r.form for r in rows(spark, small, "spelling_suggestions")}
    assert {"homo", "δι’ ὅλου"} <= {r.form for r in rows(spark, small, "ocr_suggestions")}
    assert [r.n for r in rows(spark, small, "typo_recovery")] == [sum(len(k) >= 4 for k in keys)]


def test_signatures_of_the_lexicon(spark, small):
    forms = {}
    for f, k in LOOKUP:
        forms.setdefault(HEADS[k], set()).add(f)
    want = {}
    for lemma, fs in forms.items():
        n = next((i for i, x in enumerate(zip(*fs)) if len(set(x)) > 1), min(map(len, fs)))
        stem = min(fs)[:n]
        want[lemma] = (stem, "|".join(sorted(f[n:] for f in fs)))
    got = rows(spark, small, "suffix_signatures")
    assert {r.lemma: (r.stem, r.signature) for r in got} == want and len(got) == len(want)
    assert {r.lemma for r in got if r.flag is not None} == {k for k, (_, s) in want.items() if sum(s == t for _, t in want.values()) > 1}


def test_model_of_all_words(spark, tmp_path):
    texts = ["a b c. a b c. a b d.", "a b rare word\nonce only", "", None]
    spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sents = [["<s>", *x.split(), "</s>"] for t in texts if t for x in t.replace("\n", ".").split(".") if x.split()]
    bi = Counter(p for x in sents for p in zip(x, x[1:]))
    tri = Counter(p for x in sents for p in zip(x, x[1:], x[2:]))
    got = {(r.w1, r.w2): r.n for r in rows(spark, str(tmp_path), "lm_bigrams")}
    assert got == bi and got["rare", "word"] == 1
    assert {(r.w1, r.w2, r.w3): r.n for r in rows(spark, str(tmp_path), "lm_trigrams")} == {k: n for k, n in tri.items() if bi[k[:2]] >= 3}
    assert ("a", "b", "rare") in tri and [r.n_unknown for r in rows(spark, str(tmp_path), "oov_share")] == [0]


def test_chains_of_the_lexicon(spark, tmp_path):
    heads = {1: "λύω", 2: "ἔλυον", 3: "α", 4: "β", 5: "γ"}
    lookup = [("λύω", 1), ("ἔλυον", 1), ("ἐλύομεν", 2), ("α", 4), ("β", 3), ("δ", 5)]
    spark.createDataFrame([(i, f, k, "grc", "all") for i, (f, k) in enumerate(lookup)], "row_id long, form string, lemma_id long, src string, lang string").coalesce(1).write.parquet(f"{tmp_path}/lookup.parquet")
    spark.createDataFrame(list(heads.items()), "id long, text string").coalesce(1).write.parquet(f"{tmp_path}/lemmas.parquet")
    got = {r.form: r.lemma for r in rows(spark, str(tmp_path), "chains_resolved")}
    assert got == {"λύω": "λύω", "ἔλυον": "λύω", "ἐλύομεν": "λύω", "δ": "γ"}


def test_closed_words_of_the_tables(spark, tmp_path):
    spark.createDataFrame([(1, "Τὴν", 1, "grc", "all"), (2, "τοὔνομα", 1, "grc", "all"), (3, "", 1, "grc", "all"), (4, None, 1, "grc", "all")], "row_id long, form string, lemma_id long, src string, lang string").coalesce(1).write.parquet(f"{tmp_path}/lookup.parquet")
    spark.createDataFrame([(1, "ἡμῶν", "ἐγώ"), (2, "τούνομα", "ὄνομα"), (3, "ξένος", "ξένος")], "pair_id long, form string, lemma string").coalesce(1).write.parquet(f"{tmp_path}/lemmapairdataset.parquet")
    got = {r.word: r.lemma for r in rows(spark, str(tmp_path), "closed_class")}
    assert {k: got[k] for k in ("Τὴν", "τοὔνομα", "ἡμῶν", "τούνομα", "ξένος")} == {"Τὴν": "ὁ", "τοὔνομα": None, "ἡμῶν": "ἐγώ", "τούνομα": None, "ξένος": None}
    assert {r.word: r.lemma for r in rows(spark, str(tmp_path), "crasis")}["τοὔνομα"] == "ὄνομα"


def test_conventions_and_equals(spark, small, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(2, "Ἀθηνᾶ"), (3, "Ἀθήνα"), (4, "βιος"), (5, "βίος"), (7, "λόγoς"), (9, "Ἥρα")], "id long, text string", "lemmas")
    write([(1, "ἀθήνας", 3, "grc", "all"), (2, "βίου", 5, "el", "all"), (3, "λόγου", 7, "grc", "all"), (4, "ἀθήνας", 3, "grc", "grc"), (5, "ἀθήνας", 9, "el", "el")], "row_id long, form string, lemma_id long, src string, lang string", "lookup")
    write([(1, "λόγου", "λόγος", "dev", "ag"), (2, "ἀθήνας", "Ἥρα", "dev", "ag")], "pair_id long, form string, lemma string, split string, source string", "lemmapairdataset")
    assert {r.lemma: r.preferred for r in rows(spark, str(tmp_path), "convention_map")} == {"Ἀθηνᾶ": "Ἀθήνα", "βίος": "βιος"}
    assert [tuple(r) for r in rows(spark, str(tmp_path), "accuracy_with_equivalents")] == [("dev", 2, 1)]


def joins(df):
    """The joins of a query as they ran, with their keys."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [(kind, re.sub(r"#\d+L?", "", on)) for kind, on in re.findall(r"(BroadcastHashJoin|SortMergeJoin) \[([^\]]*)\]", plan)]


@pytest.fixture(scope="session")
def many(spark, tmp_path_factory):
    """Headwords enough that no string of deletions is hot, forms and words; small files all."""
    d = str(tmp_path_factory.mktemp("many"))
    words = ["".join("αβγδεικλ"[(i * m >> 5) % 8] for m in (7, 11, 13, 31, 37, 61, 67, 127)) + "οσ" for i in range(400)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write([(i, t, "noun") for i, t in enumerate(words)], "id long, text string, pos string", "lemmas")
    write([(i, t, i, "grc", "all") for i, t in enumerate(words)], "row_id long, form string, lemma_id long, src string, lang string", "lookup")
    write([(i, t, t, "noun", ["x"], "dev", "ag") for i, t in enumerate(words)], "pair_id long, form string, lemma string, pos string, tags array<string>, split string, source string", "lemmapairdataset")
    return d


def test_strings_of_deletions_are_not_broadcast(spark, many):
    """However small the file of the headwords, the strings made of them don't pass through the driver."""
    assert [k for k, on in joins(queries()["spell_staged"](spark, many)) if "_salt" in on] == ["SortMergeJoin"]


def test_respellings_are_not_broadcast(spark, many):
    """However small the file of the words, their respellings don't pass through the driver."""
    found = joins(queries()["respelt"](spark, many))
    assert [k for k, on in found if on == "form"] == ["SortMergeJoin"] * 2


@pytest.mark.parametrize("name", ["spelling_suggestions", "ocr_suggestions", "typo_recovery"])
def test_suggestions_are_not_broadcast(spark, many, name):
    """However small the file of the headwords, neither the strings of deletions nor words or forms pass through the driver."""
    found = joins(queries()[name](spark, many))
    assert [k for k, on in found if "_salt" in on] == ["SortMergeJoin"]
    assert [k for k, on in found if on in ("q", "key")] == ["SortMergeJoin"] * 2


def test_strings_of_deletions_are_counted_in_parts(spark, many):
    """Hot ones are told without a group for each of the strings, of which there are some 70 for a headword."""
    plan = queries()["ocr_suggestions"](spark, many)._jdf.queryExecution().sparkPlan().toString()
    grouped = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan)}
    assert "_d" not in grouped and "_part" in grouped


def test_recovery_broadcasts_no_suggestions(spark, many):
    """However few they are by the planner's count, the suggestions don't pass through the driver."""
    assert [k for k, _ in joins(queries()["typo_recovery"](spark, many)) if k != "SortMergeJoin"] == []

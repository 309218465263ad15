"""Set-at-a-time operators against word-at-a-time Python, skew helpers, lexicon invariants."""

import random
import unicodedata as ud

from pyspark.sql import functions as F

from logothek.functions import tables as G
from logothek.operators import frequency as Q
from logothek.operators import fuzzy as Z
from logothek.operators import lexicon as L
from logothek.operators import morphology as Y
from logothek.operators import resolve as R
from logothek.operators.order import ranked, running_sum
from logothek.operators.skew import hot_keys, salted_join, small_enough


def strip(s):
    return ud.normalize("NFC", "".join(c for c in ud.normalize("NFD", s) if ud.category(c) != "Mn"))


def mono(s):
    return ud.normalize("NFC", "".join("́" if c in "̀͂" else c for c in ud.normalize("NFD", s) if c not in "̓̔̄̆ͅ"))


def acute(s):
    return ud.normalize("NFC", ud.normalize("NFD", s).replace("̀", "́"))


AG = {"λόγος": "λόγος", "λόγου": "λόγος", "ἀλλά": "ἀλλά", "κατά": "κατά", "ἔλυσα": "λύω", "λύω": "λύω", "ὅδε": "ὅδε", "τότε": "τότε", "γραφη": "γράφω", "εἰς": "εἰς", "καταγράφω": "καταγράφω", "καταγραφω": "καταγράφω", "ὥσ": "ὡς", "λυκα": "λύω"}
EL = {"λόγος": "λόγος", "γράφει": "γράφω", "γραφει": "γράφω", "το": "το", "ηλιε": "ήλιος", "γραφω": "γράφω"}
ALL = {**EL, **AG}
WORDS = ["λόγος", "Λόγος", "ΛΌΓΟΥ", "λόγὸς", "ἀλλ’", "καθ’", "ὅπερ", "λόγοσπερ", "ἐλυκα", "λελυκα", "ακρογραφει", "12", "τοὔνομα", "κἀγώ", "ξένον", "", "το", "τὸ", "καταγράφει", "Γράφει", "λόγου"]


def one(word):
    """The cascade for a single word."""
    def look(w, table):
        low = w.lower()
        for i, k in enumerate((w, low, acute(w), acute(w).lower(), mono(low), strip(low))):
            hit = table.get(k)
            if hit and not (i >= 4 and len(k) <= 2 and hit == k):
                return hit
        return None

    poly = any(c in "̓̔̄̆̀͂ͅ" for c in ud.normalize("NFD", word))
    return (look(word, AG) if poly else None) or look(word, ALL)


def lexicon(spark):
    return spark.createDataFrame([("ag", *x) for x in AG.items()] + [("all", *x) for x in ALL.items()], "tbl string, form string, lemma string")


def words(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, *WORDS, None]], "word string").withColumn("lemma", F.lit("clash"))


def test_cascade(spark):
    got = {r.word: r.lemma for r in R.cascade(words(spark), lexicon(spark)).collect()}
    assert got == {w: one(w) for w in WORDS if w}


def test_lemmatised(spark):
    freq = spark.createDataFrame([("κατα", 9)], "key string, n long")
    rows = R.lemmatised(words(spark), lexicon(spark), freq).collect()
    got = {r.word: (r.lemma, r.source) for r in rows}
    assert len(rows) == len(set(WORDS)) + 1 and got[None] == (None, "identity") and got[""] == ("", "identity")
    assert got["ἀλλ’"] == ("ἀλλά", "elision") and got["καθ’"] == ("κατά", "elision") and got["12"] == ("12", "digit")
    assert got["τοὔνομα"] == ("ὄνομα", "crasis") and got["λόγοσπερ"] == ("λόγος", "particle") and got["ξένον"] == ("ξένον", "identity")
    assert got["ἐλυκα"] == ("λύω", "verb_morphology") and got["λελυκα"] == ("λύω", "verb_morphology") and got["ακρογραφει"] == ("ακρογραφω", "compound")
    assert got["καταγράφει"] == ("καταγράφω", "prefix")
    heavy = R.lemmatised(spark.createDataFrame([("γραφοιει",), ("κατεγραφω",), ("ξξξξξξξ",)], "word string"), lexicon(spark), freq, respell="byzantine")
    got_heavy = {r.word: (r.lemma, r.source) for r in heavy.collect()}
    assert got_heavy["ξξξξξξξ"] == ("ξξξξξξξ", "identity")
    assert [(r.word, r.lemma, r.cand) for r in R.heavy_repairs(spark.createDataFrame([("γραφοι",), ("γραφηε",)], "word string"), spark.createDataFrame([("all", "γραφει", "γράφω")], "tbl string, form string, lemma string")).collect()] == [("γραφοι", "γράφω", "γραφει")]
    again = R.lemmatised(words(spark), lexicon(spark), freq, resolve_articles=True, convention=spark.createDataFrame([("λόγος", "λ")], "lemma string, preferred string"))
    got = {r.word: (r.lemma, r.source) for r in again.collect()}
    assert got["τὸ"] == ("ὁ", "article") and got["λόγου"] == ("λ", "lookup")
    assert R.lemmatised(words(spark).limit(0), lexicon(spark), freq).count() == 0


def test_candidates_and_agreement(spark):
    freq = spark.createDataFrame([], "key string, n long")
    c = R.candidates(words(spark), lexicon(spark), freq)
    rows = c.collect()
    assert {r.word for r in rows} == {w for w in WORDS if w} and all(r.rank >= 1 for r in rows)
    cand = spark.createDataFrame([("x", "λόγος", 1), ("x", "γραφη", 2)], "word string, lemma string, rank int")
    toks = spark.createDataFrame([(1, 0, "τὴν"), (1, 1, "x"), (2, 0, "x")], "sent_id int, pos int, word string")
    got = {(r.sent_id, r.lemma): r["rank"] for r in R.agreeing(cand, toks).collect()}
    assert got == {(1, "γραφη"): 1, (1, "λόγος"): 2, (2, "λόγος"): 1, (2, "γραφη"): 2}


def test_closed_class(spark):
    df = spark.createDataFrame([("τὴν",), ("Του",), ("ἡμῶν",), ("στη",), ("λόγος",), (None,)], "w string")
    got = [tuple(r) for r in df.select(R.closed_class(F.col("w")), R.closed_class(F.col("w"), True)).collect()]
    assert got == [("ὁ", "ὁ"), ("ὁ", "ο"), ("ἐγώ", None), (None, "σε"), (None, None), (None, None)]
    assert len(G.CRASIS) == 40


def test_within(spark):
    rnd = random.Random(2)
    keys = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    qs = keys[:25]
    k = spark.createDataFrame([(x,) for x in dict.fromkeys(keys)], "key string")
    q = spark.createDataFrame([(x,) for x in dict.fromkeys(qs)], "q string")
    for n in (1, 2):
        got = {(r.q, r.key, r.ed) for r in Z.within(q, k, n).collect()}
        assert got == {(a, b, d) for a in qs for b in keys if (d := Z.damerau(a, b)) <= n}


def test_suggestions(spark):
    forms = spark.createDataFrame([("ἄνθρωπος", 5), ("άνθρωπος", 9), ("ἄνθρωποι", 1)], "form string, n long")
    w = spark.createDataFrame([("ἄνθρωπς",), ("ανθρωπς",)], "word string")
    got = {(r.word, r.form): (r.distance, r["rank"]) for r in Z.suggestions(w, forms).collect()}
    assert ("ἄνθρωπς", "άνθρωπος") not in got and got["ἄνθρωπς", "ἄνθρωπος"] == (1, 1) and ("ανθρωπς", "άνθρωπος") in got
    assert Z.suggestions(w, forms, keep=forms.limit(1)).count() == 2
    assert Z.suggestions(w.limit(0), forms).count() == 0


def test_salted_join(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).alias("k"))
    big = big.unionByName(spark.createDataFrame([(9001, None)], "id long, k long"))
    other = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, -1), (None, 0)], "k long, v long"))
    hot = hot_keys(big, ["k"]).collect()
    assert [r.k for r in hot] == [7] and hot[0]["_salts"] > 50
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, salted_join(big, other, ["k"], "id", how).select("id", "k").collect()), key=str)
        b = sorted(map(tuple, big.join(other, "k", how).select("id", "k").collect()), key=str)
        assert a == b
    assert small_enough(big, 3001) and not small_enough(big, 3000)
    assert salted_join(big.limit(0), other, ["k"], "id").count() == 0


def test_salted_join_of_made_rows(spark):
    """Parts of the hashes are hot, not keys; rows are those of the plain join."""
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(600)] + [(-1, None), (-2, None)], "id int, k string")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, salted_join(big, other, ["k"], "id", how, made=True).collect()), key=str)
        assert a == sorted(map(tuple, big.join(other, ["k"], how).collect()), key=str)
    assert salted_join(big.limit(0), other, ["k"], "id", made=True).count() == 0


def test_within_hashes_that_meet_by_chance(spark, monkeypatch):
    words = ["λογος", "λογοσ", "νομος", "νοος", "ος", "α", "αβ", "βα"]
    q, k = spark.createDataFrame([(w,) for w in words[:5]], "q string"), spark.createDataFrame([(w,) for w in words], "key string")
    real = F.xxhash64
    monkeypatch.setattr(Z.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    got = [(r.q, r.key, r.ed) for r in Z.within(q, k, 2).collect()]
    assert sorted(got) == sorted((a, b, n) for a in words[:5] for b in words if (n := Z.damerau(a, b)) <= 2)


def test_ranked(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") % 11).alias("o"))
    got = {r.id: r["rank"] for r in ranked(df, "g", ["o", "id"], 6).collect()}
    rows, want, at = sorted(df.collect(), key=lambda r: (r.g, r.o, r.id)), {}, {}
    for r in rows:
        want[r.id] = at.get(r.g, 0)
        at[r.g] = want[r.id] + 1
    assert got == want


def test_merges(spark):
    t = lambda d: spark.createDataFrame(list(d.items()), "form string, lemma string")
    ag, el = t({"a": "a", "b": "b", "c": "x", "Έ": "ε"}), t({"a": "y", "b": "z", "d": "d", "Έ": "Έ"})
    got = {r.form: (r.lemma, r.src) for r in L.combined(ag, el, spark.createDataFrame([("b",)], "form string")).collect()}
    assert got == {"a": ("y", "el"), "b": ("b", "grc"), "c": ("x", "grc"), "d": ("d", "el"), "Έ": ("Έ", "el")}
    assert {r.form for r in L.deltas(el, t({k: v[0] for k, v in got.items()})).collect()} == {"b"}
    chains = t({"a": "b", "b": "c", "c": "c", "p": "q", "q": "p", "z": "w", "w": "v", "h": "h"})
    assert {r.form: r.lemma for r in L.chains_resolved(chains).collect()} == {"a": "c", "b": "c", "c": "c", "h": "h", "w": "v"}


def test_paradigms(spark):
    keys = [r.key for r in Y.verb_grid(spark).collect()]
    assert len(keys) == len(set(keys)) == 1436 and Y.nominal_grid(spark).count() == 15 and Y.nominal_grid(spark, True).count() == 45
    assert {"active_aorist_indicative_1sg", "middle_aorist_subjunctive_3pl", "active_aorist_infinitive", "active_aorist_participle_nom_m_sg", "mediopassive_future_perfect_indicative_3du"} <= set(keys)
    assert not any(k.endswith("_1du") or "imperative_1" in k or "imperfect_subjunctive" in k for k in keys)
    lemmas = [("λόγος", "NOUN"), ("λύω", "VERB"), ("x", "NOUN"), ("ὁδός", "NOUN"), ("καλός", "ADJ"), ("φιλέω", "VERB"), ("χώρα", "NOUN"), ("δῶρον", "NOUN"), ("τέχνη", "NOUN")]
    gen = {(r.lemma, r.key): r.form for r in Y.template(spark, spark.createDataFrame(lemmas, "lemma string, kind string")).collect()}
    want = {
        ("λόγος", "genitive_sg"): "λόγου", ("λόγος", "nominative_sg"): "λόγος", ("λύω", "active_present_indicative_3pl"): "λύουσι(ν)", ("λύω", "active_present_infinitive"): "λύειν", ("λύω", "active_present_optative_3du"): "λύοίτην",
        ("χώρα", "genitive_sg"): "χώρας", ("δῶρον", "nominative_pl"): "δῶρα", ("τέχνη", "dative_sg"): "τέχνῃ", ("καλός", "nominative_m_sg"): "καλός", ("καλός", "genitive_f_sg"): "καλης", ("ὁδός", "genitive_sg"): "ὁδόςου",
    }
    assert {k: gen.get(k) for k in want} == want and not any(k[0] in ("x", "φιλέω") for k in gen)
    tags = spark.createDataFrame([(["plural", "genitive", "masculine"], False), (["plural", "genitive", "masculine"], True), ([], False), (None, False), (["third-person", "singular", "indicative", "aorist", "mediopassive", "passive"], False), (["participle", "active", "present", "feminine"], False), (["imperative", "active", "present", "first-person", "singular"], False)], "t array<string>, a boolean")
    assert [r[0] for r in tags.select(F.coalesce(Y.verb_key(F.col("t")), Y.nominal_key(F.col("t"), F.col("a")))).collect()] == ["genitive_pl", "genitive_m_pl", None, None, "middle_aorist_indicative_3sg", "active_present_participle_nom_f_sg", None]


def test_augments_and_best_forms(spark):
    yes = [("ἔλυσα", "λύω"), ("ἔλυσας", "λύω"), ("ἐλύσαμεν", "λύω"), ("ἔπαυσαν", "παύω"), ("ἔγραψε", "γράφω"), ("ἔλυον", "λύω"), ("ἤκουσα", "ἀκούω"), ("ἤθελον", "ἐθέλω")]
    no = [("λῦσε", "λύω"), ("λῦε", "λύω"), ("παῦσαν", "παύω"), ("λύω", "λύω"), ("ἀκούω", "ἀκούω"), ("ἐθέλω", "ἐθέλω"), ("", "λύω"), ("ἔλυσα", ""), (None, "λύω")]
    df = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "form string, lemma string, want boolean")
    assert df.where(Y.augmented(F.col("form"), F.col("lemma")) != F.col("want")).count() == 0
    past, present = "active_aorist_indicative_3sg", "active_present_indicative_3sg"
    rows = [("λύω", past, "λῦσε", 1), ("λύω", past, "ἔλυσε", 1), ("λύω", present, "λύει", 1), ("λύω", present, "λῦει", 1), ("λύω", present, "λυει", 9), ("εἰμί", present, "ἐστίν", 2), ("εἰμί", present, "ἐστί", 2), ("εἰμί", present, "ἐστ’", 9), ("x", "k", "α", 1), ("x", "k", "β", 1)]
    best = Y.best_form(spark.createDataFrame(rows, "lemma string, key string, form string, n long"), ["lemma", "key"], lemma=F.col("lemma"), cell=F.col("key"))
    assert {(r.lemma, r.key): r.form for r in best.collect()} == {("λύω", past): "ἔλυσε", ("λύω", present): "λῦει", ("εἰμί", present): "ἐστί", ("x", "k"): "β"}


def test_synthesised_moods(spark):
    none = (None, None)
    rows = [("λύω", "λύσω", None, "ἐλύθην", "λέλυκα", "λέλυμαι"), ("γράφω", None, "ἔγραψα", "ἐγράφην", "γέγραφα", None), ("πίπτω", None, "ἔπεσα", None, *none), ("μένω", "μενῶ", "ἔμεινα", None, *none), ("φιλέω", "φιλήσω", None, None, *none), ("ἀκούω", None, "ἤκουσα", None, "ἀκήκοα", None), ("δίδωμι", None, None, None, *none)]
    verbs = spark.createDataFrame(rows, "lemma string, fut string, aor string, aor_p string, pf string, pf_mp string")
    att = spark.createDataFrame([("λύω", "active_present_subjunctive_2sg")], "lemma string, key string")
    got = {(r.lemma, r.key): r.form for r in Y.synthesised(verbs, att).collect()}
    want = {
        ("λύω", "active_present_subjunctive_3pl"): "λύωσι(ν)", ("λύω", "active_present_imperative_3sg"): "λυέτω", ("λύω", "active_present_infinitive"): "λύειν", ("λύω", "active_aorist_imperative_3pl"): "λυσάντων",
        ("λύω", "active_aorist_infinitive"): "λύσαι", ("γράφω", "active_aorist_subjunctive_1sg"): "γράψω", ("γράφω", "active_aorist_imperative_3sg"): "γραψάτω", ("λύω", "middle_present_optative_1sg"): "λυοίμην",
        ("λύω", "middle_aorist_imperative_2sg"): "λύσαι", ("λύω", "passive_aorist_subjunctive_1sg"): "λυθῶ", ("λύω", "passive_aorist_imperative_3pl"): "λυθέντων", ("λύω", "passive_aorist_imperative_2sg"): "λύθητι",
        ("λύω", "passive_aorist_infinitive"): "λυθῆναι", ("ἀκούω", "active_aorist_subjunctive_1sg"): "ἀκούσω",
        ("λύω", "active_present_participle_nom_m_sg"): "λύων", ("λύω", "active_present_participle_gen_f_sg"): "λυούσης", ("λύω", "active_present_participle_gen_n_pl"): "λυόντων", ("λύω", "active_future_participle_acc_m_sg"): "λύσοντα",
        ("λύω", "active_aorist_participle_nom_m_sg"): "λύσας", ("λύω", "passive_aorist_participle_nom_f_sg"): "λυθεῖσα", ("λύω", "active_perfect_participle_nom_m_sg"): "λελυκώς", ("λύω", "middle_perfect_participle_nom_m_sg"): "λελυμένος",
        ("λύω", "middle_present_participle_nom_m_sg"): "λυόμενος", ("λύω", "middle_present_participle_gen_m_sg"): "λυομένου", ("λύω", "passive_future_participle_nom_n_pl"): "λυθησόμενα", ("γράφω", "active_perfect_participle_nom_m_sg"): "γεγραφώς",
        ("ἀκούω", "active_perfect_participle_nom_m_sg"): None,
    }
    assert {k: got.get(k) for k in want} == want
    assert ("λύω", "active_present_subjunctive_2sg") not in got and not any(k[0] in ("φιλέω", "δίδωμι") for k in got)
    assert not any(m in ("πίπτω", "μένω") and "aorist" in k for m, k in got) and not any(m == "γράφω" and k.startswith("passive") for m, k in got)


def test_particles_and_deictic_iota(spark):
    lex = spark.createDataFrame([("all", "τοῦτο", "οὗτος"), ("all", "ταυτη", "οὗτος"), ("all", "ὅς", "ὅς"), ("all", "λόγοσ", "x"), ("all", "λόγος", "λόγος")], "tbl string, form string, lemma string")
    w = spark.createDataFrame([(x,) for x in ("τουτοΐ", "ταυτηί", "ὅσπερ", "ΛΌΓΟΣΓΕ", "λόγοιί")], "word string")
    got = {r.word: (r.lemma, r.cand) for r in R.rule_hits(w, lex, {5: R.particle_candidates}).collect()}
    assert got == {"ταυτηί": ("οὗτος", "ταυτη"), "ὅσπερ": ("ὅς", "ὅς"), "ΛΌΓΟΣΓΕ": ("x", "λόγοσ")}


def test_parts_of_speech(spark):
    cand = [("σκέψει", "σκέπτομαι", 1), ("αυτού", "αυτού", 1), ("αυτού", "Αυτού", 2), ("ἦν", "εἰμί", 1), ("ἦν", "ἠμί", 2), ("ὅ", "ὅς", 1), ("ὅ", "ὁ", 2), ("καλά", "καλά", 1), ("καλά", "καλός", 2), ("πᾶς", "πᾶς", 1), ("πᾶς", "πᾷς", 2)]
    table = [("σκέψει", "NOUN", "σκέψις"), ("αυτού", "PRON", "αυτός"), ("ἦν", "VERB", "ημι"), ("ὅ", "DET", "ὁ"), ("πᾶς", "VERB", "πάσχω"), ("ξένον", "NOUN", "ξένος")]
    words_ = [("σκέψει", "NOUN"), ("αυτού", "PRON"), ("ἦν", "VERB"), ("ὅ", "DET"), ("ὅ", "PRON"), ("καλά", "ADJ"), ("ἦν", "NOUN"), ("ξένον", "NOUN")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    fixed = df([("καλά", "ADJ", "καλός")], "word string, pos string, lemma string")
    got = {(r.word, r.pos): (r.lemma, r.rule) for r in R.by_pos(df(words_, "word string, pos string"), df(cand, "word string, lemma string, rank int"), df(table, "form string, pos string, lemma string"), fixed).collect()}
    assert got == {
        ("σκέψει", "NOUN"): ("σκέψις", "sole"), ("αυτού", "PRON"): ("αυτός", "self"), ("ἦν", "VERB"): ("ἠμί", "stripped"), ("ὅ", "DET"): ("ὁ", "exact"), ("ὅ", "PRON"): ("ὅς", "top"),
        ("καλά", "ADJ"): ("καλός", "repaired"), ("ἦν", "NOUN"): ("εἰμί", "top"), ("ξένον", "NOUN"): ("ξένον", "top"),
    }


def test_conventions(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    groups = df([(1, 1, "ἥλιος"), (1, 2, "ἠέλιος"), (2, 3, "βίος"), (2, 4, "βίοτος"), (3, 5, "ἠέλιος"), (3, 6, "χ"), (4, 7, "μόνος")], "group_id long, ord long, lemma string")
    heads = df([("ήλιος",), ("βίοτος",), ("δώρο",), ("τιμώ",), ("λύση",)], "form string")
    old = df([("δῶρον",), ("τιμάω",), ("λύσις",), ("ποιέω",), ("ἥλιος",)], "lemma string")
    over = df([("z", "ω")], "lemma string, preferred string")
    got = {r.lemma: r.preferred for r in R.convention_map(groups, heads, over, monotonic=True, ancient=old).collect()}
    assert got == {"ἥλιος": "ήλιος", "ἠέλιος": "ήλιος", "βίος": "βίοτος", "χ": "ἠέλιος", "δῶρον": "δώρο", "τιμάω": "τιμώ", "λύσις": "λύση", "z": "ω"}
    plain = {r.lemma: r.preferred for r in R.convention_map(groups, heads).collect()}
    assert plain == {"ἠέλιος": "ἥλιος", "βίος": "βίοτος", "χ": "ἠέλιος"}
    shown = {r.lemma: r.shown for r in R.conventional(old, df(list(got.items()), "lemma string, preferred string"), True).collect()}
    assert shown["ποιέω"] == "ποιέω" and shown["δῶρον"] == "δώρο" and shown["ἥλιος"] == "ήλιος"
    adj = df([("δεινός",), ("ἀληθής",), ("ἡδύς",)], "form string")
    led = R.adjective_headwords(df([(x,) for x in ("δεινῶς", "δεινόν", "ἀληθῶς", "ἡδέως", "φῶς", "ὡς", "δῶρον")], "lemma string"), df([("φῶς",)], "form string"), adj)
    assert {r.lemma: r.headword for r in led.collect()} == {"δεινῶς": "δεινός", "δεινόν": "δεινός", "ἀληθῶς": "ἀληθής", "ἡδέως": "ἡδέως", "φῶς": "φῶς", "ὡς": "ὡς", "δῶρον": "δῶρον"}


def test_declined_by_class(spark):
    nouns = spark.createDataFrame([("λόγος", "m", "λόγου"), ("νόμος", "m", "νόμου"), ("δῶρον", "n", "δώρου"), ("x", "m", "y")], "lemma string, gender string, genitive string")
    forms = spark.createDataFrame([("λόγος", f) for f in ("λόγος", "λόγου", "λόγε", "λόγοις")] + [("νόμος", "νόμῳ"), ("νόμος", "θεός")], "lemma string, form string")
    got = {}
    for r in Y.declined_by_class(nouns, forms).collect():
        got.setdefault((r.lemma, r.exemplar), set()).add(r.form)
    assert got == {("λόγος", "λόγος"): {"λογος", "λογου", "λογε", "λογοις"}, ("νόμος", "λόγος"): {"νομος", "νομου", "νομε", "νομοις"}}


def test_training_mix(spark):
    rows = [(i, f"f{i % 40}", "l", "verb" if i % 2 else "noun", ["aorist"] if i % 3 == 0 else None, ("variety", "modern", "ancient")[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "pair_id long, form string, lemma string, pos string, tags array<string>, pool string")
    every = Q.training_mix(df, 10_000).collect()
    assert len({r.pair_id for r in every}) == 40 and all(r.copy_no == 1 or r.pool == "ancient" for r in every)
    some = Q.training_mix(df, 30)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, Q.training_mix(df.repartition(7), 30).collect()))
    n = spark.createDataFrame([(["pluperfect", "perfect"], "verb"), (["future-perfect", "perfect"], "verb"), (["aorist"], "noun"), (None, "verb"), (["aorist"], None)], "t array<string>, p string")
    assert [r[0] for r in n.select(Q.copies_by_tense(F.col("p"), F.col("t"))).collect()] == [7, 3, 1, 1, 1]
    sample = {r.pair_id for r in Q.hash_sample(df, "pair_id", 15).collect()}
    assert len(sample) == 15 and sample == {r.pair_id for r in Q.hash_sample(df.coalesce(1), "pair_id", 15).collect()} and Q.hash_sample(df, "pair_id", 999).count() == 120


def test_running_sums(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([None, 1, 5, -2])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    for g in ("g", None):
        got = {r.id: r.s for r in running_sum(df, g, ["id"], "v", "s", 5).collect()}
        at, want = {}, {}
        for i, k, v in rows:
            k = k if g else 0
            at[k] = want[i] = at.get(k, 0) + (v or 0)
        assert got == want
    assert running_sum(df.limit(0), "g", ["id"], "v").count() == 0


def test_self_map_repair(spark):
    rows = [("περιέχει", "VERB", "περιέχει", False, 1), ("περιέχει", "VERB", "περιέχω", False, 2), ("παλαιολιθικής", "ADJ", "παλαιολιθική", False, 1), ("καλά", "ADV", "καλά", False, 1), ("καλά", "ADV", "καλός", False, 2), ("x", None, "x", False, 1), ("x", None, "Ξένος", True, 2)]
    df = spark.createDataFrame(rows, "word string, pos string, lemma string, proper boolean, rank int")
    got = {r.word: r.lemma for r in R.repaired_self_maps(df, spark.createDataFrame([("παλαιολιθικός",)], "form string")).collect()}
    assert got == {"περιέχει": "περιέχω", "παλαιολιθικής": "παλαιολιθικός", "καλά": "καλά", "x": "x"}

"""Keys against Python's Unicode database, and the golden rows of each text function."""

import unicodedata as ud

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.functions import udfs as U
from logothek.operators.fuzzy import Pattern, damerau, weighted


def nfc(s):
    return ud.normalize("NFC", s)


def strip(s):
    return nfc("".join(c for c in ud.normalize("NFD", s) if ud.category(c) != "Mn"))


def test_keys(spark):
    words = ["ἄνθρωπος", "ΟΔΟΣ", "ὣς", "τοὔνομα", "ᾧ", "Ῥόδος", "ἀλλ̓", "μῆνιν", "", None, "αὐτὸν", "Çedilla", "ё", "ἀγᾱθός", "εἰς-άγω"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    c = F.col("w")
    rows = df.select("w", T.strip_accents(c).alias("s"), T.monotonic(c).alias("m"), T.grave_to_acute(c).alias("a"), T.key(c).alias("k"), T.sort_key(c).alias("o")).collect()
    for r in rows:
        if r.w is None:
            assert r.s is None and r.k is None
            continue
        assert r.s == strip(r.w)
        d = ud.normalize("NFD", r.w)
        assert nfc(r.m) == nfc("".join("́" if x in "̀͂" else x for x in d if x not in "̓̔̄̆ͅ"))
        assert r.a == nfc(d.replace("̀", "́"))
        assert r.k == strip(r.w.lower()).replace("ς", "σ")
        assert r.o == strip(r.w.lower().replace("-", ""))


def test_predicates(spark):
    df = spark.createDataFrame([("λόγος",), ("",), ("abc",), ("λόγoς",), ("Λόγος",), ("«Λόγος",)], "w string")
    c = F.col("w")
    got = [tuple(r) for r in df.select(T.all_greek(c), T.any_greek(c), T.pure_greek(c), T.capitalised(c)).collect()]
    assert got == [(True, True, True, False), (True, False, False, False), (False, False, False, False), (False, True, False, False), (True, True, True, True), (False, True, False, True)]


def test_sanitised():
    assert U.sanitised("̓αγω") == "ἀγω" and U.sanitised("᾿εγω") == "ἐγω" and U.sanitised("") == ""
    assert U.sanitised("̓γω") == "᾽γω" and U.sanitised("̓ἀγω") == "ἀγω"
    assert U.sanitised("ἀλλ̓") == "ἀλλ᾽" and U.sanitised("̓") == ""


def test_sentences():
    assert U.sentences("Ἦλθε. Εἶδε; Ναί!! Τέλος") == ["Ἦλθε.", "Εἶδε;", "Ναί!!", "Τέλος"]
    assert U.sentences("ο Α. Παπάς π.χ. ήρθε. Μετά") == ["ο Α. Παπάς π.χ. ήρθε.", "Μετά"]
    assert U.sentences("«Έλα. Φύγε.» είπε. Ναι.") == ["«Έλα. Φύγε.» είπε.", "Ναι."]
    assert U.sentences("  ") == []


def test_beta_code():
    assert U.from_beta("mh=nin") == "μῆνιν" and U.from_beta("*)axilh=os") == "Ἀχιλῆος" and U.from_beta("lo/gos") == "λόγος"
    assert U.from_beta("a)ll)") == "ἀλλ’" and U.from_beta("tw=|") == "τῷ"


def test_spellings():
    got = dict(U.spellings("ιμερα", "byzantine"))
    assert {"ημερα", "ειμερα", "οιμερα", "υμερα"} <= set(got) and "ιμερα" not in got
    assert abs(got["ημερα"] - 0.1) < 1e-9
    assert all(c not in dict(U.spellings("φως", "hellenistic")) for c in ("πως",)) and "πως" in dict(U.spellings("φως", "byzantine"))
    assert U.spellings("", "byzantine") == [] and U.spellings("ω", "nowhere") == U.spellings("ω", "all")
    assert U.dialect_spellings("θάλασσα", "koine") == ["θάλαττα"] and U.dialect_spellings("κως", "ionic") == ["πως"]
    assert U.dialect_spellings("ἡμέρη", "ionic") == ["ἡμέρα"] and U.dialect_spellings("φιλέει", "ionic") == [] and "φιλουμεν" in U.dialect_spellings("φιλεομεν", "ionic")
    assert U.dialect_spellings("μάτηρ", "doric") == ["μήτηρ"] and U.dialect_spellings("ὀ", "aeolic") == ["ὁ"] and U.dialect_spellings("", "auto") == []


def test_char_roles():
    assert U.char_roles("λύω", "ἔλυσα") == ["prefix", "stem", "stem", "ending", "ending"]
    assert U.char_roles("λόγος", "λόγου") == ["stem", "stem", "stem", "stem", "ending"]
    assert U.char_roles("abc", "") == [] and U.char_roles("", "ab") == ["changed", "changed"]


def test_weighted():
    assert weighted("λόγος", "λογος") == 0.1 and weighted("ο", "o") == 0.1 and weighted("α", "а") == 0.0 and weighted("", "ab") == 2.0
    assert weighted("θεός", "δεός") == 0.5 and weighted("abc", "abd") == 1.0


def edits1(w, letters="abc"):
    s = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    return {a + b[1:] for a, b in s if b} | {a + b[1] + b[0] + b[2:] for a, b in s if len(b) > 1} | {a + c + b[1:] for a, b in s if b for c in letters} | {a + c + b for a, b in s for c in letters}


@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_damerau(a, b):
    e1 = edits1(a)
    want = 0 if a == b else 1 if b in e1 else 2 if any(b in edits1(x) for x in e1) else 3
    got = damerau(a, b)
    assert (got == want) if want < 3 else got > 2


def test_patterns():
    import re

    p = Pattern("κ.*[αο]ς")
    assert (p.least, p.fixed, p.prefix) == (4, False, "κ") and re.match(p.regex, "κριος") and not re.match(p.regex, "ος")
    try:
        Pattern("a[b")
        raise AssertionError
    except ValueError:
        pass

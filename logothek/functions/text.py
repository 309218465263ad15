"""Normalisation keys and tokenisers as column expressions, all within code generation.

Canonical decompositions map each affected code point of the scripts in use to one code point, so ``translate`` with
tables made from the Unicode database gives the keys exactly on composed text; loose marks are removed by pattern. The
expressions never fail on null (null stays null) or empty texts (empty stays empty).
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{M}]+"
GREEK_RANGES = r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}"
#: Marks dropped, and marks made acute, in the monotonic key.
DROPPED = "̓̔̄̆ͅ"
MADE_ACUTE = "̀͂"


def _table(change: Callable[[str], str], ranges: tuple[tuple[int, int], ...]) -> tuple[str, str]:
    a, b = [], []
    for lo, hi in ranges:
        for c in map(chr, range(lo, hi)):
            d = change(c)
            if d != c and len(d) == 1:
                a.append(c)
                b.append(d)
    return "".join(a), "".join(b)


def _nfc(s: str) -> str:
    return ud.normalize("NFC", s)


def _strip(s: str) -> str:
    return _nfc("".join(c for c in ud.normalize("NFD", s) if ud.category(c) != "Mn"))


def _monotonic(s: str) -> str:
    return _nfc("".join("́" if c in MADE_ACUTE else c for c in ud.normalize("NFD", s) if c not in DROPPED))


def _acute(s: str) -> str:
    return _nfc(ud.normalize("NFD", s).replace("̀", "́"))


def _plain_length(s: str) -> str:
    return _nfc(ud.normalize("NFD", s).replace("̄", "").replace("̆", ""))


_GREEK = ((0x370, 0x400), (0x1F00, 0x2000))
STRIP = _table(_strip, ((0xC0, 0x250), *_GREEK, (0x400, 0x530), (0x1E00, 0x1F00)))
MONOTONIC = _table(_monotonic, _GREEK)
ACUTE = _table(_acute, _GREEK)
LENGTH = _table(_plain_length, _GREEK)


def strip_accents(c: Column) -> Column:
    """Without accents, breathings and other marks."""
    return F.regexp_replace(F.translate(c, *STRIP), r"\p{Mn}+", "")


def monotonic(c: Column) -> Column:
    """Monotonic form of composed text: one accent, no breathing, subscript or length."""
    return F.translate(F.translate(c, *MONOTONIC), MADE_ACUTE + DROPPED, "́́")


def grave_to_acute(c: Column) -> Column:
    return F.translate(F.translate(c, *ACUTE), "̀", "́")


def strip_length(c: Column) -> Column:
    """Without macrons and breves."""
    return F.regexp_replace(F.translate(c, *LENGTH), "[̄̆]", "")


def fold_sigma(c: Column) -> Column:
    return F.translate(c, "ς", "σ")


def key(c: Column) -> Column:
    """Lower case, without marks, final sigma as sigma: the key under which spellings of a word meet. Plain ASCII is lowered only."""
    low = F.lower(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), fold_sigma(strip_accents(low))).otherwise(low)


def sort_key(c: Column) -> Column:
    """The order of headwords: lower case, without hyphens and marks."""
    return strip_accents(F.lower(F.replace(c, F.lit("-"), F.lit(""))))


def outer_trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def words(c: Column) -> Column:
    """Runs of letters and marks, in order."""
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def all_greek(c: Column) -> Column:
    """Nothing but Greek letters and marks; true of the empty text."""
    return c.rlike(rf"^[{GREEK_RANGES}\x{{0300}}-\x{{036F}}]*$")


def any_greek(c: Column) -> Column:
    return c.rlike(f"[{GREEK_RANGES}]")


def pure_greek(c: Column) -> Column:
    """One or more Greek letters and nothing else, loose marks included."""
    return c.rlike(f"^[{GREEK_RANGES}]+$")


def capitalised(c: Column) -> Column:
    """The first letter, if any, is a capital."""
    return c.rlike(r"^[^\p{L}]*\p{Lu}")


def noise(c: Column) -> Column:
    """Links, tags, handles, tokens with digits or Latin letters, and single characters."""
    return (F.length(c) <= 1) | c.rlike(r"https?:|www\.|[#@0-9A-Za-z]")


def _bodies(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def polytonic_share(c: Column) -> Column:
    """Share of Greek code points that only polytonic text has."""
    return _bodies(c, r"[\x{1F00}-\x{1FFF}]") / F.greatest(_bodies(c, f"[{GREEK_RANGES}]"), F.lit(1))


def metadata_line(c: Column) -> Column:
    """More Latin than Greek letters, and more than three of them."""
    latin = _bodies(c, "[A-Za-z]")
    return (latin > _bodies(c, f"[{GREEK_RANGES}]")) & (latin > 3)


def _with(marks: str) -> str:
    """Composed Greek letters that have one of some marks."""
    return "".join(chr(c) for a, b in _GREEK for c in range(a, b) if set(ud.normalize("NFD", chr(c))[1:]) & set(marks))


def _on(bases: str) -> str:
    """Letters on some bases, with any marks."""
    return bases + "".join(chr(c) for a, b in _GREEK for c in range(a, b) if len(ud.normalize("NFD", chr(c))) > 1 and ud.normalize("NFD", chr(c))[0] in bases)


ACUTES, GRAVES, CIRCUMFLEXES, BREATHINGS = _with("́"), _with("̀"), _with("͂"), _with("̓̔")
VOWELS = _on("αεηιουωΑΕΗΙΟΥΩ")
#: Composed letters and loose marks that only polytonic writing has.
POLYTONIC = r"\x{1F00}-\x{1FFF}" + "".join(c for c in _with("̀͂̓̔ͅ") if ord(c) < 0x1F00) + "̀͂̓̔ͅ"
# Marks at the end of an elided word, and Latin capitals that look like Greek ones.
ELISION_GLYPHS = "'’ʼ᾽ʹ"
LATIN_CAPITALS, GREEK_CAPITALS = "ABEZHIKMNOPTXY", "ΑΒΕΖΗΙΚΜΝΟΡΤΧΥ"


def has_breathing(c: Column) -> Column:
    return c.rlike(f"[{BREATHINGS}̓̔]")


def has_accent(c: Column) -> Column:
    return c.rlike(f"[{ACUTES}{GRAVES}{CIRCUMFLEXES}́̀͂]")


def has_polytonic(c: Column) -> Column:
    return c.rlike(f"[{POLYTONIC}]")


def canonical_elision(c: Column) -> Column:
    """One glyph for the elision at the end of a word."""
    return F.regexp_replace(c, f"[{ELISION_GLYPHS}]$", "᾽")


def lower_initial(c: Column) -> Column:
    """The first letter in lower case, the others as they are."""
    first = F.regexp_extract(c, r"^[^\p{L}]*\p{L}", 0)
    return F.concat(F.lower(first), F.substring(c, F.length(first) + 1, F.greatest(F.length(c), F.lit(1))))


def last_vowel(c: Column) -> Column:
    """The plain lower-case vowel at the end of a word, null if it ends otherwise."""
    return F.nullif(F.regexp_extract(strip_accents(F.lower(c)), "[αεηιουω]$", 0), F.lit(""))


def greek_initial(c: Column) -> Column:
    """A Latin capital at the start as the Greek one it looks like."""
    return F.concat(F.translate(F.substring(c, 1, 1), LATIN_CAPITALS, GREEK_CAPITALS), F.substring(c, F.lit(2), F.greatest(F.length(c), F.lit(1))))


def multi_word(c: Column) -> Column:
    return outer_trim(c).contains(" ")


def lacuna(c: Column) -> Column:
    """Brackets and question marks of an edition."""
    return c.rlike(r"[\[\]?]")


#: Words of running Greek text: elided ones too, and such as begin with a Latin capital.
GREEK_WORD = rf"[{LATIN_CAPITALS}]?[{GREEK_RANGES}]+(?:['ʼ᾽᾿’ι][{GREEK_RANGES}]*)*|['ʼ᾽᾿’ι][{GREEK_RANGES}]+"


def running_sentences(c: Column) -> Column:
    """Sentences of a text as arrays of Greek words: lines of editors left out, cut at . ; · ! and ?, empty ones dropped."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~metadata_line(x))
    parts = F.split(F.array_join(lines, " "), "[.;·!?]")
    words_ = F.transform(parts, lambda x: F.transform(F.regexp_extract_all(x, F.lit(GREEK_WORD), 0), greek_initial))
    return F.filter(words_, lambda x: F.size(x) > 0)


def paragraph_sentences(c: Column) -> Column:
    """Sentences of composed text, cut at blank lines and at . ; · ! and ?, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"\n{2,}|[.;·!?]"), outer_trim), lambda x: F.length(x) > 0)


def of_register(rows: DataFrame, year: str, text: str, least_words: int = 20, least_share: float = 0.4) -> DataFrame:
    """Rows whose year is modern and doesn't count back, and whose text has enough Greek words and among them polytonic ones."""
    w = F.regexp_extract_all(text, F.lit(f"[{GREEK_RANGES}]+"), 0)
    n, p = F.size(w), F.size(F.filter(w, lambda x: x.rlike(r"[\x{1F00}-\x{1FFF}]")))
    dated = F.col(year).rlike(r"\b(?:18|19|20)\d\d\b") & ~F.col(year).contains("π.Χ")
    return rows.where(dated & (n >= least_words) & (p >= least_share * n))


def skipped_tag(c: Column) -> Column:
    """Tags of what is no word: by the universal names, or by a first code u."""
    return c.isin("PUNCT", "NUM", "X", "SYM") | c.startswith("u")


def hash_dev(c: Column, per_10000: int = 200, seed: str = "4242:") -> Column:
    """Whether a key belongs to the held-out part: a fixed share by the first 32 bits of an MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), c.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(10000)) < per_10000


@F.arrow_udf(StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Composed form; needed once, where text comes in."""
    return pa.array([None if x is None else _nfc(x) for x in s.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfd(s: pa.Array) -> pa.Array:
    return pa.array([None if x is None else ud.normalize("NFD", x) for x in s.to_pylist()], pa.string())

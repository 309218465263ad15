"""Text functions that built-in expressions can't tell, as Arrow functions over whole batches; null stays null."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Spellings that were pronounced alike (written, meant), with how likely their confusion is in the
# archaic, hellenistic, late antique and byzantine periods.
VOWELS_ALIKE = (
    ("ι", "ει", (0.1, 0.7, 0.9, 0.95)), ("ι", "η", (0.0, 0.15, 0.5, 0.9)), ("ι", "οι", (0.0, 0.05, 0.2, 0.7)), ("ι", "υ", (0.0, 0.0, 0.1, 0.4)), ("η", "ει", (0.0, 0.15, 0.4, 0.7)), ("οι", "ει", (0.0, 0.05, 0.15, 0.5)),
    ("υ", "οι", (0.0, 0.1, 0.3, 0.4)), ("ε", "αι", (0.0, 0.5, 0.7, 0.8)), ("αι", "ε", (0.0, 0.5, 0.7, 0.8)), ("ο", "ω", (0.0, 0.3, 0.6, 0.7)), ("ω", "ο", (0.0, 0.3, 0.6, 0.7)),
)
CONSONANTS_ALIKE = (
    ("β", "υ", (0.0, 0.1, 0.5, 0.7)), ("π", "φ", (0.0, 0.0, 0.2, 0.5)), ("φ", "π", (0.0, 0.0, 0.2, 0.5)), ("τ", "θ", (0.0, 0.0, 0.15, 0.4)), ("θ", "τ", (0.0, 0.0, 0.15, 0.4)), ("κ", "χ", (0.0, 0.0, 0.15, 0.4)), ("χ", "κ", (0.0, 0.0, 0.15, 0.4)),
    ("λ", "λλ", (0.0, 0.15, 0.3, 0.5)), ("ν", "νν", (0.0, 0.15, 0.3, 0.5)), ("σ", "σσ", (0.0, 0.15, 0.25, 0.4)), ("ρ", "ρρ", (0.0, 0.1, 0.15, 0.3)), ("τ", "ττ", (0.0, 0.1, 0.15, 0.3)), ("κ", "κκ", (0.0, 0.1, 0.15, 0.3)), ("π", "ππ", (0.0, 0.1, 0.15, 0.3)),
)
SUBSCRIPT_LOST = (0.0, 0.3, 0.7, 0.9)
PERIODS = ("archaic_epigraphic", "hellenistic", "late_antique", "byzantine")
SUBSCRIPT = dict(zip("αάᾶὰηήῆὴωώῶὼ", "ᾳᾴᾷᾲῃῄῇῂῳῴῷῲ", strict=True))
# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = frozenset({
    "κ", "π.χ", "κλπ", "δηλ", "βλ", "σ", "σελ", "αρ", "τ", "κ.ά", "κ.τ.λ", "κ.λπ", "εκ", "αι",
    "cf", "v", "sq", "al", "sc", "l.c", "s.v", "q.v", "e.g", "i.e", "etc",
})
# Ionic and Doric words with their Attic counterparts.
IONIC_WORDS = {
    "κῶς": "πῶς", "ὅκου": "ὅπου", "κοῖος": "ποῖος", "κότε": "πότε", "κότερος": "πότερος", "κόσος": "πόσος", "κόθεν": "πόθεν", "κοῦ": "ποῦ", "κόσε": "πόσε", "ὁκόσος": "ὁπόσος", "ὅκως": "ὅπως",
    "μοῦνος": "μόνος", "μούνη": "μόνη", "μοῦνον": "μόνον", "ξεῖνος": "ξένος", "ξείνη": "ξένη", "ξεῖνον": "ξένον", "κεῖνος": "ἐκεῖνος", "κείνη": "ἐκείνη", "κεῖνο": "ἐκεῖνο", "κείνου": "ἐκείνου",
    "κείνῳ": "ἐκείνῳ", "κείνων": "ἐκείνων", "εἵνεκα": "ἕνεκα", "εἵνεκεν": "ἕνεκεν",
}
DORIC_WORDS = {"ποτί": "πρός", "τύ": "σύ", "τύν": "σέ", "Ἀθάνα": "Ἀθήνη", "Ἀθαναία": "Ἀθηναία"}
CONTRACTED = (("εε", "ει"), ("εο", "ου"), ("εω", "ω"))
# Letters and marks of Beta Code.
BETA = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω", strict=True))
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "|": "ͅ", "+": "̈"}
PSILI, DASIA, KORONIS = "̓", "̔", "᾽"
SPACING = {"᾿": PSILI, "῾": DASIA, PSILI: PSILI, DASIA: DASIA}


def _marks(c: str) -> set[str]:
    return {x for x in ud.normalize("NFD", c) if ud.category(x) == "Mn"}


def _nfc(s: str) -> str:
    return ud.normalize("NFC", s)


def sanitised(s: str) -> str:
    """A breathing before the first letter goes onto it, or becomes a koronis before a letter that takes none; one at the end becomes a koronis, or goes if it is there already."""
    if s and s[0] in SPACING:
        mark, rest = SPACING[s[0]], s[1:]
        if rest:
            joined = _nfc(rest[0] + mark)
            if len(joined) == len(_nfc(rest[0])):
                rest = joined + rest[1:]
            elif mark not in _marks(rest[0]):
                rest = KORONIS + rest
        s = rest
    if s and s[-1] in (PSILI, DASIA):
        before = s[-2:-1]
        s = s[:-1] + (KORONIS if before and not _marks(before) & {PSILI, DASIA} else "")
    return _nfc(s)


def sentences(text: str) -> list[str]:
    """Sentences by . ; · and ! outside quotes; no end after abbreviations, single capitals and stops within a word. A straight quote only opens."""
    text = " ".join(text.split())
    out, start, depth, i = [], 0, 0, 0
    while i < len(text):
        c = text[i]
        if c in '"«“‘':
            depth += 1
        elif c in "»”’":
            depth = max(0, depth - 1)
        elif c in ".;·!" and not depth:
            token = text[start:i].rsplit(" ", 1)[-1]
            inside = i + 1 < len(text) and text[i + 1] not in ' "«“‘»”’'
            if c != "." or not (inside or token.lower() in ABBREVIATIONS or (len(token) == 1 and token.isupper())):
                while i + 1 < len(text) and text[i + 1] in ".;·!":
                    i += 1
                out.append(text[start : i + 1].strip())
                start = i + 1
        i += 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def from_beta(s: str) -> str:
    """Beta Code as Unicode: ``*`` makes a capital, whose marks stand before it; sigma is final at the end of a word."""
    out, capital, waiting = [], False, ""
    for c in s.lower():
        if c == "*":
            capital = True
        elif c in BETA_MARKS:
            if capital:
                waiting += BETA_MARKS[c]
            else:
                out.append(BETA_MARKS[c])
        elif c in BETA:
            g = BETA[c]
            out.append((g.upper() if capital else g) + waiting)
            capital, waiting = False, ""
        else:
            out.append(c)
    text = re.sub("σ(?![\\wͰ-Ͽἀ-῿̀-ͯ'’])", "ς", "".join(out))
    return _nfc(re.sub("([βγδζθκλμνξπρστφχψ])̓$", "\\1’", text))


def spellings(token: str, period: str = "all", most: int = 50, least: float = 0.1) -> list[tuple[str, float]]:
    """Spellings a token may stand for, with a cost: one lost subscript or one confusion undone, in one place, either way.

    Consonants count in late antique and byzantine texts only. An unknown period is as ``all``: the greatest weight of any
    period, 0.7 at most. Rules go by falling weight, and none is begun once ``most`` spellings are found.
    """
    at = PERIODS.index(period) if period in PERIODS else None
    weigh = lambda w: w[at] if at is not None else min(0.7, max(w))
    cost: dict[str, float] = {}
    if (w := weigh(SUBSCRIPT_LOST)) >= least:
        for i, c in enumerate(token):
            if c in SUBSCRIPT:
                cost[token[:i] + SUBSCRIPT[c] + token[i + 1 :]] = 1 - w
    for table in (VOWELS_ALIKE, CONSONANTS_ALIKE if period in ("late_antique", "byzantine") else ()):
        for a, b, ws in sorted(table, key=lambda r: -weigh(r[2])):
            if (w := weigh(ws)) < least or len(cost) >= most:
                continue
            for x, y in ((a, b), (b, a)):
                i = token.find(x)
                while i >= 0:
                    cost.setdefault(token[:i] + y + token[i + len(x) :], 1 - w)
                    i = token.find(x, i + 1)
    cost.pop(token, None)
    return sorted(cost.items(), key=lambda p: p[1])[:most]


def _bare(s: str) -> str:
    return _nfc("".join(c for c in ud.normalize("NFD", s) if ud.category(c) != "Mn"))


def _swapped(c: str, a: str, b: str) -> str | None:
    """A letter whose base is ``a`` with base ``b`` and the same marks, else null."""
    d = ud.normalize("NFD", c)
    return _nfc(b + d[1:]) if d[0] == a else None


def _each(token: str, a: str, b: str) -> list[str]:
    """The token with one occurrence of a as b, for each occurrence."""
    return [token[:i] + b + token[i + len(a) :] for i in range(len(token) - len(a) + 1) if token.startswith(a, i)]


def dialect_spellings(token: str, dialect: str = "auto") -> list[str]:
    """Attic spellings a dialect's form may stand for, in the order Ionic, Doric, Aeolic, common; ``auto`` tries all.

    Ionic: known words, η after ε, ι, ρ as α with its marks, contractions, σσ as ττ, ρσ as ρρ. Doric: known words, the last
    α as η. Aeolic: a smooth breathing as rough. Common: σσ as ττ and back. An unknown dialect is an error.
    """
    if dialect not in ("ionic", "doric", "aeolic", "koine", "auto"):
        raise ValueError(f"unknown dialect {dialect!r}")
    out: list[str] = []
    on = lambda d: dialect in (d, "auto")
    known = lambda words: [v if w == token else v.lower() if w.lower() == token.lower() else _bare(v.lower()) for w, v in words.items() if token in (w, _bare(w.lower())) or token.lower() == w.lower()]
    if on("ionic"):
        out += known(IONIC_WORDS)
        out += [token[:i] + x + token[i + 1 :] for i, c in enumerate(token) if i and _bare(token[i - 1].lower()) in ("ε", "ι", "ρ") and (x := _swapped(c, "η", "α"))]
        for a, b in (*CONTRACTED, ("σσ", "ττ"), ("ρσ", "ρρ")):
            out += _each(token, a, b)
    if on("doric"):
        out += known(DORIC_WORDS)
        out += [token[:i] + x + token[i + 1 :] for i in range(len(token) - 1, -1, -1) if (x := _swapped(token[i], "α", "η"))][:1]
    if on("aeolic") and token and PSILI in ud.normalize("NFD", token[0]):
        out.append(_nfc(ud.normalize("NFD", token[0]).replace(PSILI, DASIA)) + token[1:])
    if on("koine"):
        out += _each(token, "σσ", "ττ") + _each(token, "ττ", "σσ")
    return [x for x in dict.fromkeys(out) if x != token]


def char_roles(lemma: str, form: str) -> list[str]:
    """The role of each letter of a form against its lemma: prefix, stem, changed or ending, by a longest common subsequence without marks."""
    bare = lambda s: ["".join(x for x in ud.normalize("NFD", c) if ud.category(x) != "Mn") for c in _nfc(s).lower()]
    a, b = bare(lemma), bare(form)
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
    common, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            common.append(j)
            i, j = i + 1, j + 1
        elif n[i + 1][j] >= n[i][j + 1]:
            i += 1
        else:
            j += 1
    if not common:
        return ["changed"] * len(b)
    return ["stem" if k in set(common) else "prefix" if k < common[0] else "ending" if k > common[-1] else "changed" for k in range(len(b))]


def _column(f: Callable, kind, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def column(s: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in s.to_pylist()], arrow)

    return column


sanitise = _column(sanitised, StringType(), pa.string())
segment = _column(sentences, ArrayType(StringType()), pa.list_(pa.string()))
beta_code = _column(from_beta, StringType(), pa.string())
dialect_candidates = _column(dialect_spellings, ArrayType(StringType()), pa.list_(pa.string()))


def spelling_candidates(period: str = "all"):
    """A function from a token column to an array of (cand, cost)."""
    kind = ArrayType(StructType([StructField("cand", StringType()), StructField("cost", DoubleType())]))
    return _column(lambda x: [{"cand": c, "cost": round(w, 6)} for c, w in spellings(x, period)], kind, pa.list_(pa.struct([("cand", pa.string()), ("cost", pa.float64())])))


@F.arrow_udf(ArrayType(StringType()))
def roles(lemma: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array([None if a is None or b is None else char_roles(a, b) for a, b in zip(lemma.to_pylist(), form.to_pylist(), strict=True)], pa.list_(pa.string()))

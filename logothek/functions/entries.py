"""Principal parts out of the head of a dictionary's verb entry, as an Arrow function over whole batches.

The text is read twice in step: as it is, and with each letter in lower case without its marks, so that patterns are plain and
forms come out as they are written. A part is named by its label, the voice given with it and the section it stands in.
"""

from __future__ import annotations

import re
import unicodedata as ud

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# Labels of tenses, voices, sections, and words between a label and its form.
TENSES = {"fut": "fut", "aor": "aor", "pf": "pf", "perf": "pf", "plpf": "plpf", "plupf": "plpf", "impf": "impf", "imperf": "impf"}
SKIPPED = ("ου", "ουκ", "ουχ", "μη", "μηκ", "η", "και", "δε", "γαρ", "τε", "νυν", "μεν", "ουδε", "μηδε", "οτι", "ως", "πως", "ινα", "οπως", "ην")
TAGS = ("ep", "ion", "att", "dor", "aeol", "hom", "hdt", "hp", "pi", "lat")
#: The part that a tense is in each voice; other combinations have none.
PARTS = {
    "act": {"fut": "fut", "aor": "aor", "pf": "pf", "plpf": "plpf", "impf": "impf"},
    "med": {"fut": "fut_med", "aor": "aor_med", "pf": "pf_mp"},
    "pass": {"fut": "fut_p", "aor": "aor_p", "pf": "pf_mp"},
    "mp": {"fut": "fut_med", "aor": "aor_p", "pf": "pf_mp"},
}
#: Endings that a form of each part may have.
ENDINGS = {
    "fut": ("ω", "ουμαι", "ουμι", "εμαι", "ομαι"), "aor": ("α", "ν"), "aor1": ("α", "ν"), "aor2": ("ον", "ομην"), "pf": ("α",), "plpf": ("ν", "ει"), "impf": ("ν",),
    "fut_med": ("μαι", "μην"), "aor_med": ("μαι", "μην"), "fut_p": ("ομαι",), "aor_p": ("ν",), "pf_mp": ("μαι", "ται"),
}

_G = "Ͱ-Ͽἀ-῿̀-ͯ"
_LABEL = re.compile(rf"(?<![a-z{_G}])(fut|aor|pf|perf|plpf|plupf|impf|imperf)\.\s*(?:([12])\s*)?(m\.\s*/\s*p\.|m/p\.|m\.|p\.|mid\.|pass\.)?")
_SECTION = re.compile(r"(?::|—|:-)\s*(?:—\s*)?(med\.\s+and\s+pass|mediopass|med|pass|mid)")
_SKIP = rf"(?:\s*(?:(?:{'|'.join(TAGS)})(?![a-z])[.,]*|(?:{'|'.join(w for w in SKIPPED if len(w) > 2)})(?![{_G}-])[.,]*|[{_G}]{{1,2}}(?![{_G}-])))"
_FORM = re.compile(rf"{_SKIP}{{0,3}}\s*(?!(?:{'|'.join(SKIPPED)})(?![{_G}]))([{_G}]{{3,}})(?![{_G}-])")
_PASSIVE = re.compile(rf"(?<![{_G}-])[{_G}]*θην(?![{_G}-])")


def _plain(s: str) -> str:
    """Each letter in lower case without marks, at its place."""
    return "".join(c if ud.category(c) == "Mn" else (ud.normalize("NFD", c)[0].lower() + c)[0] for c in s)


def _fits(part: str, word: str) -> bool:
    return re.sub("[̀-ͯ]", "", word).endswith(ENDINGS[part])


def principal_parts_of(text: str, headword: str) -> dict[str, str]:
    """Principal parts by name; the first form of each counts, and the aorist is the second or the first if none is plain."""
    s = ud.normalize("NFC", text)
    s = re.sub(r"^\s*\[[^\]]*\]\s*,?\s*", "", s)
    s = re.sub(r"^\s*\*\*[^*]+\*\*\s*", "", s)
    s = re.sub(rf"^\s*{re.escape(ud.normalize('NFC', headword))}\s*,?\s*", "", s)
    low = _plain(s)
    marks = [(0, "act"), *((m.start(), "pass" if m.group(1).startswith("pass") else "med") for m in _SECTION.finditer(low)), (len(low), "")]
    out: dict[str, str] = {}
    for (a, section), (b, _) in zip(marks, marks[1:]):
        labels = list(_LABEL.finditer(low, a, b))
        for k, m in enumerate(labels):
            given = (m.group(3) or "").replace(" ", "")
            voice = ("mp" if "m" in given and "p" in given else "pass" if given.startswith("p") else "med") if given else section
            tense = TENSES[m.group(1)]
            part = PARTS[voice].get(tense)
            if part == "aor" and m.group(2):
                part += m.group(2)
            form = _FORM.match(low, m.end(), b)
            if part is None or form is None or not _fits(part, form.group(1)):
                continue
            out.setdefault(part, s[form.start(1) : form.end(1)])
            if section != "act" and tense == "aor" and part != "aor_p" and "aor_p" not in out:
                # a passive aorist without a label, after the middle one
                end = labels[k + 1].start() if k + 1 < len(labels) else b
                rest = low[m.end() : end].split("\n\n")[0]
                open_ = re.sub(r"\([^()]*\)?", lambda x: " " * len(x.group()), rest)
                if found := _PASSIVE.search(open_):
                    out["aor_p"] = s[m.end() + found.start() : m.end() + found.end()]
    if "aor" not in out and (aorist := out.get("aor2", out.get("aor1"))):
        out["aor"] = aorist
    return {k: ud.normalize("NFC", v) for k, v in out.items()}


@F.arrow_udf(MapType(StringType(), StringType()))
def principal_parts(text: pa.Array, headword: pa.Array) -> pa.Array:
    """The principal parts of a column of entry heads; an empty map if none is found, null for null."""
    rows = [None if t is None or h is None else list(principal_parts_of(t, h).items()) for t, h in zip(text.to_pylist(), headword.to_pylist(), strict=True)]
    return pa.array(rows, pa.map_(pa.string(), pa.string()))

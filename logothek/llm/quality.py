"""Statistics of each document's text, and whether it is dialogue prose or a list, a table or junk.

Documents are taken apart into lines of cue text; each line gets features by built-in expressions, and an ordered rule
list names its kind. The rules are induced by incremental reduced-error pruning: rules for one class at a time, rarest
first, are grown condition by condition on two thirds of the labelled lines, pruned from the end on the other third, and
kept while they are right more often than not. The learned thresholds are written out as one SQL CASE expression, which
is all that runs on the corpus. A document is of a kind if more than half of its lines are.

The tables hold no labels, so the labelled documents are composed here (``labelled_documents``): prose of common and
invented words in five languages with capitals, missing punctuation, recognition errors, wrong encodings, sound
descriptions and adverts, against lists, tables and junk of several makes. Their number is bounded by ``DOCUMENTS``.

Defined results: null, empty and blank texts, and texts without a line of cue text, have no kind and statistics of 0 (the
ratios null); rows of one id are taken together as one document; texts of any length are read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.session import spread

#: Bound of the labelled sample: documents composed for training.
DOCUMENTS = 480
LABELS = ("junk", "table", "list")  # in this order rules are learned; prose is what no rule names

# Frequent words of the five languages.
COMMON = {
    "en": "the you i to a and it is was we that do not of in your what did he she my me at on for are have with this be there all she who said they will would has had but from so if no yes",
    "el": "να το την και με δεν θα που τι ότι στο η τον μου σε είναι ήταν ο της του στη στην στον μας σας από για ναι όχι πού πώς αλλά αν θέλω έχει έχω",
    "fr": "de la que le et je tu pas vous nous est les des une un il elle ne en ce qui dans pour sur avec au plus mais où oui non ça mon ton son qu c n l d j",
    "de": "ich du nicht das ist und die der wir hat sie mir zu in ein eine es dem den mit auf für war dass wenn aber was wo ja nein mein dein hast sind",
    "es": "de la que no el y en es lo un por qué se con te me una los las del al su para está pero si sí yo tú mi hay muy donde dónde",
}
COMMON_WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
# How the sign of a frame cue, a time line, a numbered line and mark-up look.
FRAME = r"^\{\d+\}\{\d*\}"
TIME = r"^\s*(?:\d+:)+\d+[.,]\d+\s*-+>\s*(?:\d+:)+\d+[.,]\d+.*"
MARKUP = r"</?(?:i|b|u|s|font|c|v|ruby|rt)(?:[ .=][^>]*)?>|\{\\[^}]*\}"

#: What a line must have not to be blank.
VISIBLE = r"[^\s\p{Z}\x{FEFF}\x{200B}-\x{200F}\x{2060}]"

FEATURES = {
    "len": "length(s)",
    "letters": "length(s) - length(regexp_replace(s, '\\\\p{L}', ''))",
    "digits": "length(s) - length(regexp_replace(s, '[0-9]', ''))",
    "spaces": "length(s) - length(replace(s, ' ', ''))",
    "words": "regexp_count(s, '\\\\p{L}+')",
    "titled": "regexp_count(s, '\\\\p{Lu}(?<!\\\\p{L}.)\\\\p{Ll}+')",
    "cells": "regexp_count(s, '[0-9](?<![^\\\\s|;,].)[0-9.:,]*(?![^\\\\s|;,])')",
    "signs": "regexp_count(s, '[!-/:-@\\\\[-`{-~¬°]')",
    "figures": "regexp_count(s, '[\\u2190-\\u2bff\\ufffd]')",
    "marks": "regexp_count(s, '[\\u0080-\\u00bf]')",
    "commas": "length(s) - length(replace(s, ',', ''))",
    "consonants": "regexp_count(s, '[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ](?<!\\\\p{L}.)[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]+(?!\\\\p{L})')",
    "pairs": "regexp_count(s, '[0-9a-f](?<!\\\\S.)[0-9a-f](?!\\\\S)')",
    "jumps": "regexp_count(s, '[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]')",
    "bullet": "CAST(s RLIKE '^(?:[-–—•*·] |[0-9]+[.)] )' AS INT)",
    "ended": "CAST(s RLIKE '[.!?;…:♪\\\\])»*][\\\"”]?$' AS INT)",
    "dots": "CAST(s RLIKE '[.]{3}|…' AS INT)",
    "common": None,
}
RATIOS = {
    "letter_share": "letters / greatest(len, 1)",
    "sign_share": "signs / greatest(len - spaces, 1)",
    "figure_share": "figures / greatest(len - spaces, 1)",
    "cell_share": "cells / greatest(spaces + 1, 1)",
    "title_share": "titled / greatest(words, 1)",
    "consonant_share": "consonants / greatest(words, 1)",
    "pair_share": "pairs / greatest(spaces + 1, 1)",
    "token_len": "(len - spaces) / (spaces + 1)",
    "jump_share": "jumps / greatest(len, 1)",
    "common_share": "common / greatest(words, 1)",
    "words_per_part": "words / (commas + 1)",
}
NAMES = [*FEATURES, *RATIOS]


def cue_lines(documents: DataFrame, text: str = "text", heads: bool = False) -> DataFrame:
    """(doc_id, s, tabs): the lines of cue text, trimmed and without mark-up; numbers, times, blank lines and headers are left out.

    heads: adds a row of no line for each document, with the length of its text in ``n_chars``, from the same reading.
    """
    t = F.expr(f"concat('\n', replace(trim(LEADING '\ufeff' FROM `{text}`), '\r', ''))")
    t = F.regexp_replace(t, r"\n[ \t]*[0-9]+[ \t]*(?=\n[ \t]*(?:[0-9]+:)+[0-9]+[.,][0-9]+[ \t]*-+>)", "")
    s, head = F.col("s"), F.col("s").isNull()
    cut = F.split(t, "\n")
    if heads:
        cut = F.concat(F.coalesce(cut, F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    own = documents.select("doc_id", text) if heads else documents.where(F.length(text) > 0).select("doc_id", text)
    lines = spread(own).select("doc_id", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.posexplode(cut).alias("i", "s"))
    lines = lines.where(head | ((F.length("s") > 0) & ~(s.contains("->") & s.rlike(TIME)) & ~((F.col("i") == 1) & s.rlike(r"^[ \t]*WEBVTT"))))
    frame = s.startswith("{") & s.rlike(FRAME)
    parts = lines.select("doc_id", "n_chars", F.explode(F.when(frame, F.split(F.regexp_replace("s", FRAME, ""), r"\|")).otherwise(F.array("s"))).alias("s"))
    plain = F.when(s.rlike("[<{]"), F.regexp_replace("s", MARKUP, "")).otherwise(s)
    keep = ["doc_id", F.when(head, F.col("n_chars")).alias("n_chars")] if heads else ["doc_id"]
    trimmed = parts.select(*keep, F.trim(F.replace(plain, F.lit("\t"), F.lit(" "))).alias("s"), s.contains("\t").cast("int").alias("tabs"))
    return trimmed.where(head | s.rlike(VISIBLE))


def with_features(lines: DataFrame) -> DataFrame:
    """Lines with a column for each feature, by built-in expressions alone."""
    common = F.size(F.filter(F.split(F.lower("s"), r"[^\p{L}]+"), lambda w: w.isin(*COMMON_WORDS))).alias("common")
    plain = lines.select("*", *[F.expr(e).cast("int").alias(k) for k, e in FEATURES.items() if e], common)
    return plain.select("*", *[F.expr(e).cast("double").alias(k) for k, e in RATIOS.items()])


# --- induction -------------------------------------------------------------------------------------------------------


def covers(rule: list[tuple[int, str, float]], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, op, t in rule:
        hit &= (x[:, j] <= t) if op == "<=" else (x[:, j] >= t)
    return hit


def grow(x: np.ndarray, y: np.ndarray, most: int = 6) -> list[tuple[int, str, float]]:
    """Conditions added by greatest information gain until no negative is covered."""
    rule: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while (hit & ~y).any() and len(rule) < most:
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        before, best = np.log2(p / (p + n)) if p else 0, (1e-9, None)
        for j in range(x.shape[1]):
            col = x[hit, j]
            for t in np.unique(np.quantile(col, np.linspace(0.01, 0.99, 41), method="nearest")):
                for op in ("<=", ">="):
                    m = (col <= t) if op == "<=" else (col >= t)
                    a = int((m & y[hit]).sum())
                    if a and not m.all():
                        gain = a * (np.log2(a / int(m.sum())) - before)
                        if gain > best[0]:
                            best = (gain, (j, op, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = covers(rule, x)
    return rule


def prune(rule: list, x: np.ndarray, y: np.ndarray) -> list:
    """Drop final conditions while (p - n) / (p + n) on held-out lines doesn't fall."""
    def worth(r: list) -> float:
        m = covers(r, x)
        p, n = int((m & y).sum()), int((m & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def induce(x: np.ndarray, labels: np.ndarray, seed: int = 7) -> list[tuple[str, list[tuple[int, str, float]]]]:
    """An ordered rule list over LABELS; what no rule covers is prose."""
    rnd, out = np.random.default_rng(seed), []
    left = np.ones(len(x), bool)
    for label in LABELS:
        while True:
            at = np.flatnonzero(left)
            y = labels[at] == label
            if y.sum() < 8:
                break
            third = rnd.random(len(at)) < 1 / 3
            rule = prune(grow(x[at][~third], y[~third]), x[at][third], y[third])
            m = covers(rule, x[at][third])
            if not rule or not m.any() or (m & ~y[third]).sum() * 2 > m.sum():
                break
            out.append((label, rule))
            left[at[covers(rule, x[at])]] = False
    return out


def case_sql(rules: list[tuple[str, list[tuple[int, str, float]]]]) -> str:
    """The rule list as a SQL CASE expression over the feature columns."""
    whens = [f"WHEN {' AND '.join(f'`{NAMES[j]}` {op} {t!r}D' for j, op, t in rule)} THEN '{label}'" for label, rule in rules]
    return "CASE " + " ".join([*whens, "ELSE 'prose' END"])


# --- labelled documents ----------------------------------------------------------------------------------------------


def labelled_documents(n: int = DOCUMENTS, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(kind, lines of cue text) of n composed documents, a third prose."""
    r = random.Random(seed)
    latin = ("b c d f g l m n p r s t v br st tr ch".split(), "a e i o u ai ou".split())
    greek = ("β γ δ κ λ μ ν π ρ σ τ φ χ στ".split(), "α ε η ι ο υ ω ά έ ή ί ό ου αι".split())

    def word(lang: str) -> str:
        c, v = greek if lang == "el" else latin
        return "".join(r.choice(c) + r.choice(v) for _ in range(r.randint(1, 4))) + r.choice(["", "", "ς" if lang == "el" else r.choice("nrst")])

    def name() -> str:
        return word("en").capitalize()

    def sentence(lang: str) -> str:
        k = r.randint(2, 11)
        common = COMMON[lang].split()
        ws = [r.choice(common) if r.random() < 0.55 else word(lang) for _ in range(k)]
        if r.random() < 0.25:
            ws.insert(r.randrange(len(ws) + 1), name())
        s = " ".join(ws)
        if k > 4 and r.random() < 0.3:
            i = r.randint(1, len(ws) - 1)
            s = " ".join(ws[:i]) + ", " + " ".join(ws[i:])
        return s[0].upper() + s[1:] + r.choice([".", ".", ".", "?" if lang != "el" else ";", "!", "..."])

    def prose(lang: str, m: int) -> list[str]:
        out, style = [], r.choice(["plain", "plain", "plain", "caps", "bare", "ocr", "utf8", "utf8twice", "cp", "lost"])
        while len(out) < m:
            s = sentence(lang)
            if r.random() < 0.3:
                s += " " + sentence(lang)
            s = r.choice(["", "", "", "- ", "♪ ", f"{name().upper()}: ", f"[{word(lang)}] ", f"*{word(lang)} {word(lang)}* "]) + s
            if r.random() < 0.12:
                s = r.choice([f"[{word(lang)}]", f"({word(lang)} {word(lang)})".upper(), f"*{word(lang)}*", f"www.{word('en')}.example", f"{sentence(lang)[:-1]} www.{word('en')}.example", f"{word(lang).capitalize()}: {word(lang)} {word('en')}", f"{sentence(lang)[:-1]}: {word('en')}.example"])
            if style == "caps":
                s = s.upper()
            elif style == "bare":
                s = "".join(c for c in s if c not in ".!?;:")
            elif style == "ocr":
                s = "".join(r.choice({"l": "I", "i": "l", "o": "0", "h": "li", "e": "c"}.get(c, c)) if r.random() < 0.2 else c for c in s)
            elif style == "utf8":
                s = s.encode().decode("latin-1")
            elif style == "utf8twice":
                s = s.encode().decode("latin-1").encode().decode("latin-1")
            elif style == "cp":
                s = s.encode("cp1253", "replace").decode("latin-1") if lang == "el" else s.encode("latin-1", "replace").decode("cp1253", "replace")
            elif style == "lost":
                s = "".join("�" if ord(c) > 127 and r.random() < 0.5 else c for c in s) if lang != "el" else s
            if len(s) > 34 and r.random() < 0.5 and (i := s.find(" ", len(s) // 2)) > 0:
                out += [s[:i], s[i + 1 :]]
            else:
                out.append(s)
        return out[:m]

    def listing(lang: str, m: int) -> list[str]:
        item = lambda: " ".join(word(lang) for _ in range(r.randint(1, 3)))
        role = [word(lang).capitalize() + r.choice(["", " " + word(lang)]) for _ in range(5)]
        make = r.choice([
            lambda i: f"{r.choice('-–•*')} {item()}", lambda i: f"{i + 1}) {item()}", lambda i: f"{i + 1:02d}. {name()} {name()}", lambda i: f"{name()} {name()}",
            lambda i: f"{r.choice(role)} {r.choice(['', '... ', '.... '])}{name()} {name()}", lambda i: f"{r.choice(role)}: {name()} {name()}", lambda i: f"{item()}, {item()}, {name()}", lambda i: f"{i + 1}. {item()}", lambda i: item(),
        ])
        return [make(i) for i in range(m)]

    def tabular(m: int) -> list[str]:
        cols = [r.choice(["int", "dec", "time", "big"]) for _ in range(r.randint(2, 5))]
        cell = {"int": lambda: str(r.randint(1, 99)), "dec": lambda: f"{r.uniform(1, 1500):.2f}", "time": lambda: f"{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", "big": lambda: str(r.randint(100, 9999))}
        head, tail = r.random() < 0.75, r.random() < 0.3
        sep = r.choice(["  ", "    ", "\t", ";", " | ", "|"])
        rows = []
        for _ in range(m):
            cells = [cell[c]() for c in cols]
            cells = [name()] * head + cells + [name()] * tail
            s = sep.join(cells)
            rows.append(f"| {s} |" if sep == " | " else s)
        return rows

    def junk(m: int) -> list[str]:
        mix = "".join(r.sample(string.ascii_letters + string.digits + "!?%&@(){}", r.randint(0, 5)))
        make = r.choice([
            lambda: " ".join(f"{r.randrange(256):02x}" for _ in range(r.randint(3, 16))), lambda: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(r.randint(12, 56))),
            lambda: " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(1, 7))) for _ in range(r.randint(2, 6))), lambda: "".join(r.choice("!#*+-./:;<=>\\^_`|~¬°, 'l1" + mix) for _ in range(r.randint(8, 32))),
            lambda: "".join(r.choice([chr(r.randint(0x2500, 0x25FF)), chr(r.randint(0xA0, 0x17F)), chr(r.randint(0x3B1, 0x3C9))]) for _ in range(r.randint(8, 50))), lambda: r.choice("♪□#.?�=~") * r.randint(4, 40) + r.choice(["", " ��"]),
            lambda: " ".join("".join(r.choice(string.ascii_letters + string.digits + "#$%&@") for _ in range(r.randint(2, 9))) for _ in range(r.randint(2, 6))),
        ])
        return [make() for _ in range(m)]

    out = []
    for k in range(n):
        lang, m = r.choice(list(COMMON)), r.randint(6, 18)
        kind = ("prose", "prose", "list", "table", "junk")[k % 5]
        out.append((kind, {"prose": lambda: prose(lang, m), "list": lambda: listing(lang, m), "table": lambda: tabular(m), "junk": lambda: junk(m)}[kind]()))
    return out


def labelled_features(spark: SparkSession, n: int = DOCUMENTS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features, by the very expressions that run on the corpus, and labels of the lines of labelled documents."""
    rows = [(i, kind, s.strip().replace("\t", " "), int("\t" in s)) for i, (kind, lines) in enumerate(labelled_documents(n, seed)) for s in lines if s.strip()]
    df = with_features(spark.createDataFrame(rows, "doc_id long, kind string, s string, tabs int"))
    pdf = df.select("kind", *NAMES).toPandas()
    return pdf[NAMES].to_numpy(float), pdf["kind"].to_numpy(str)


@lru_cache(1)
def _learned(n: int, seed: int) -> tuple:
    x, y = labelled_features(SparkSession.getActiveSession(), n, seed)
    return tuple((label, tuple(rule)) for label, rule in induce(x, y))


def learned_rules(n: int = DOCUMENTS, seed: int = 11) -> list:
    """The rule list, learned once in a process."""
    return [(label, list(rule)) for label, rule in _learned(n, seed)]


# --- application -----------------------------------------------------------------------------------------------------


def line_kind(rules: list | None = None) -> Column:
    return F.expr(case_sql(learned_rules() if rules is None else rules))


def document_statistics(documents: DataFrame, rules: list | None = None) -> DataFrame:
    """One row for each document id: counts, ratios and ``kind`` (null without cue text); lines and lengths come from one reading."""
    lines = with_features(cue_lines(documents, heads=True)).withColumn("line_kind", F.when(F.col("s").isNotNull(), line_kind(rules)))
    n = lambda k: F.sum((F.col("line_kind") == k).cast("long")).alias(f"n_{k}")
    sums = lines.groupBy("doc_id").agg(
        F.sum("n_chars").alias("n_chars"), F.count("s").alias("n_lines"), F.sum("words").alias("n_words"), F.sum("letters").alias("n_letters"), F.sum("len").alias("n_line_chars"), F.sum(F.col("len") - F.col("letters") - F.col("digits") - F.col("spaces")).alias("n_symbols"),
        F.sum("digits").alias("n_digits"), F.sum("ended").alias("n_ended"), F.sum("common").alias("n_common"), *map(n, LABELS),
    )
    kind = F.when(F.col("n_lines") > 0, F.expr("CASE WHEN 2 * n_list > n_lines THEN 'list' WHEN 2 * n_table > n_lines THEN 'table' WHEN 2 * n_junk > n_lines THEN 'junk' ELSE 'prose' END"))
    ratio = lambda a, b, name: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6).alias(name)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return sums.select(
        "doc_id", "n_chars", "n_lines", zero("n_words"), ratio("n_letters", "n_words", "mean_word_length"), ratio("n_symbols", "n_line_chars", "symbol_ratio"), ratio("n_digits", "n_line_chars", "digit_ratio"),
        ratio("n_ended", "n_lines", "ended_share"), ratio("n_common", "n_words", "common_share"), *map(zero, ("n_list", "n_table", "n_junk")), kind.alias("kind"),
    )


def not_prose(documents: DataFrame, rules: list | None = None) -> DataFrame:
    """(doc_id, kind) of the documents of which more than half of the lines are list, table or junk."""
    lines = with_features(cue_lines(documents)).select("doc_id", line_kind(rules).alias("k"))
    n = lines.groupBy("doc_id").agg(F.count("*").alias("n"), *[F.sum((F.col("k") == k).cast("long")).alias(k) for k in LABELS])
    kind = F.expr("CASE WHEN 2 * list > n THEN 'list' WHEN 2 * `table` > n THEN 'table' WHEN 2 * junk > n THEN 'junk' END")
    return n.select("doc_id", kind.alias("kind")).where("kind IS NOT NULL")

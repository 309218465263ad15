"""Fuzzy search: spelling suggestions, patterns, key ranges and weighted distances."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from logothek.functions import text as T
from logothek.functions.tables import OCR_PAIRS
from logothek.operators.skew import salted_join


def deletes(c: Column, depth: int = 1) -> Column:
    """The string and all strings that up to ``depth`` deletions of one character make of it."""
    one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    out = F.array(c)
    level = F.array(c)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.array_union(out, level)
    return out


def damerau(a: str, b: str, most: int = 1 << 30) -> int:
    """Least number of insertions, deletions, replacements and swaps of neighbours, edits between swapped letters allowed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    big = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[big] * (len(b) + 2)] + [[big, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [big, i], 0
        prev = d[i]
        for j, y in enumerate(b, 1):
            k = last.get(y, 0)
            cost = x != y
            row.append(min(prev[j] + cost, row[j] + 1, prev[j + 1] + 1, d[k][seen] + (i - k - 1) + 1 + (j - seen - 1)))
            if not cost:
                seen = j
        last[x] = i
        d.append(row)
    return d[-1][-1]


def swapped(a: Column, b: Column) -> Column:
    """Whether a swap of two neighbours makes the one of the other."""
    cut = lambda i, j: F.substring(a, i, j)
    one = lambda i: F.concat(cut(F.lit(1), i - 1), cut(i + 1, F.lit(1)), cut(i, F.lit(1)), cut(i + 2, F.length(a))) == b
    return (F.length(a) == F.length(b)) & (F.length(a) >= 2) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), one)


def edits(pairs: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """``pairs`` within ``most`` edits, with ``ed``, swaps of neighbours counted as one edit.

    A swap is two plain edits, so the plain distance, a built-in, is at most twice as large; where it is at most 2 it tells
    the result. Only what is left goes through Python.
    """
    plain = F.levenshtein(a, b, 2 * most)
    near = pairs.withColumn("_p", plain).where(F.col("_p") >= 0)
    told = F.when(F.col("_p") <= 1, F.col("_p")).when(F.col("_p") == 2, F.when(swapped(F.col(a), F.col(b)), 1).otherwise(2))
    near = near.withColumn("ed", told).drop("_p")
    if most < 2:
        return near.where(F.col("ed") <= most)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, i, j = (batch.schema.get_field_index(c) for c in ("ed", a, b))
            ed = batch.column(k)
            rest = pc.is_null(ed)
            if ed.null_count:
                own = [damerau(x, y) for x, y in zip(batch.column(i).filter(rest).to_pylist(), batch.column(j).filter(rest).to_pylist(), strict=True)]
                ed = pc.replace_with_mask(ed, rest, pa.array(own, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], ed], batch.schema.names).filter(pc.less_equal(ed, most))

    return near.mapInArrow(fill, near.schema)


def within(queries: DataFrame, keys: DataFrame, distance: int) -> DataFrame:
    """(q, key, ed): all keys within ``distance`` edits of each query; an exact join on shared deletions, then verified.

    queries: distinct ``q``; keys: distinct ``key``. Two strings that are n edits apart share a string that up to n
    deletions make of either, a swap of neighbours being one deletion on each side. The strings meet by their hashes, which
    are smaller; what meets by chance isn't near, and is left out with the rest.
    """
    made = lambda df, c: df.select(c, F.explode(deletes(F.col(c), distance)).alias("_d")).select(c, F.xxhash64("_d").alias("_d"))
    a, b = made(queries, "q"), made(keys, "key")
    met = salted_join(b, a, ["_d"], salt_by="key", made=True).where(F.abs(F.length("q") - F.length("key")) <= distance)
    return edits(met.select("q", "key").distinct(), "q", "key", distance)


def spelling_hits(words: DataFrame, keys: DataFrame, max_distance: int = 2, enough: int = 3) -> DataFrame:
    """(q, key, ed): keys within one edit, and within two for words that found fewer than ``enough``; one search for both."""
    hits = within(words.select("q").distinct(), keys, max_distance)
    if max_distance < 2:
        return hits
    near = F.count_if(F.col("ed") <= 1).over(Window.partitionBy("q"))
    return hits.withColumn("_near", near).where((F.col("ed") <= 1) | (F.col("_near") < enough)).drop("_near")


def has_breathing(c: Column) -> Column:
    letters = "".join(chr(x) for x in range(0x1F00, 0x2000) if set(ud.normalize("NFD", chr(x))) & {"̓", "̔"})
    return c.rlike(f"[{letters}̓̔]")


def suggestions(words: DataFrame, forms: DataFrame, max_distance: int = 2, ocr: bool = False, keep: DataFrame | None = None) -> DataFrame:
    """(word, form, distance, rank): forms whose key is near that of the word.

    In order of the distance of keys, then of the full forms (weighted if ``ocr``), then frequency, then form. For a word
    with a breathing, forms without one are left out at each distance at which others have one. forms: (form, n).
    ``keep``: (form) the only forms to suggest, as the headwords of a dictionary.
    """
    w = words.select("word").distinct().withColumn("q", T.strip_accents(F.lower("word")))
    f = forms.select("form", "n").withColumn("key", T.strip_accents(F.lower("form")))
    hits = spelling_hits(w, f.select("key").distinct(), max_distance)
    # words and forms may be many, too, for a small file
    j = w.join(hits.hint("merge"), "q").join(f.hint("merge"), "key").withColumn("sd", F.levenshtein("q", "key"))
    full = ocr_distance(F.lower("word"), F.lower("form")) if ocr else F.levenshtein(F.lower("word"), F.lower("form")).cast("double")
    j = j.withColumn("fd", full).withColumn("_b", has_breathing(F.col("form")))
    j = j.withColumn("_any", F.bool_or("_b").over(Window.partitionBy("word", "sd"))).where(~has_breathing(F.col("word")) | F.col("_b") | ~F.col("_any"))
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("sd", "fd", F.desc("n"), "form")))
    if keep is not None:
        ranked = ranked.join(keep.select("form").distinct(), "form", "left_semi")
    return ranked.select("word", "form", F.col("sd").alias("distance"), "rank")


@lru_cache(1)
def _costs() -> dict[tuple[str, str], float]:
    return {p: c for a, b, c in OCR_PAIRS for p in ((a, b), (b, a))}


def weighted(a: str, b: str) -> float:
    """Edit distance over letters and marks apart: marks cost a tenth, confusable letters what their pair costs."""
    costs = _costs()
    x, y = sorted((ud.normalize("NFD", a), ud.normalize("NFD", b)), key=len, reverse=True)
    if not y:
        return float(len(x))
    mark = [bool(ud.combining(c)) for c in y]
    gap = [0.1 if m else 1.0 for m in mark]
    prev = [0.0]
    for g in gap:
        prev.append(prev[-1] + g)
    for c in x:
        m = bool(ud.combining(c))
        own = 0.1 if m else 1.0
        row = [prev[0] + own]
        for j, e in enumerate(y):
            swap = 0.0 if c == e else 0.1 if m and mark[j] else costs.get((c, e), 1.0)
            row.append(min(row[j] + gap[j], prev[j + 1] + own, prev[j] + swap))
        prev = row
    return prev[-1]


@F.arrow_udf(DoubleType())
def ocr_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else weighted(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


class Pattern:
    """A search pattern: ``.`` one letter, ``*`` any number, ``[..]`` one of a class; letters match without accents."""

    def __init__(self, pattern: str) -> None:
        p = ud.normalize("NFC", "".join(c for c in ud.normalize("NFD", pattern.lower()) if ud.category(c) != "Mn"))
        parts = re.findall(r"\[[^\]]*\]|.", p)
        if any(x == "[" for x in parts):
            raise ValueError(f"a class that doesn't end in {pattern!r}")
        letter = "[α-ωϊϋ]"
        self.regex = "^" + "".join({".": letter, "*": letter + "*"}.get(x, x if x[0] == "[" else re.escape(x)) for x in parts) + "$"
        self.least = sum(x != "*" for x in parts)
        self.fixed = "*" not in parts
        self.prefix = re.match(r"[^.*\[]*", p).group()

    def matches(self, key: Column) -> Column:
        """The filter: length and prefix, which reach the scan, before the pattern itself."""
        n = F.length(key)
        c = (n == self.least) if self.fixed else (n >= self.least)
        if self.prefix:
            c = c & key.startswith(self.prefix)
        return c & key.rlike(self.regex)


def found(index: DataFrame, pattern: str, limit: int = 20) -> DataFrame:
    """The best entries of an index (stripped, form, lemma, score) that match, by score, then length, then key."""
    return index.where(Pattern(pattern).matches(F.col("stripped"))).orderBy(F.desc("score"), F.length("stripped"), "stripped").limit(limit)


def pattern_index(lexicon: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """(stripped, form, lemma, score): of the entries of a form without marks the one whose lemma has most such forms, 500 more for headwords.

    An entry is a headword if it is its lemma but for case and marks. Ties go to the smallest form, then lemma. freq: (key, n)
    replaces the score by the corpus count, keeping the 500 for scores that had them. lexicon: (form, lemma).
    """
    keyed = lexicon.select(T.strip_accents(F.lower("form")).alias("stripped"), "form", "lemma").distinct()
    fan = keyed.groupBy("lemma").agg(F.count_distinct("stripped").alias("fan"))
    head = F.col("stripped") == T.strip_accents(F.lower("lemma"))
    e = keyed.join(fan, "lemma").withColumn("score", F.col("fan") + F.when(head, 500).otherwise(0))
    best = e.groupBy("stripped").agg(F.min(F.struct((-F.col("score")).alias("s"), "form", "lemma")).alias("m")).select("stripped", F.col("m.form").alias("form"), F.col("m.lemma").alias("lemma"), (-F.col("m.s")).alias("score"))
    if freq is None:
        return best
    j = best.join(freq.select(F.col("key").alias("stripped"), "n"), "stripped", "left")
    return j.select("stripped", "form", "lemma", F.when(F.col("n").isNull(), F.col("score")).otherwise(F.col("n") + F.when(F.col("score") >= 500, 500).otherwise(0)).alias("score"))


def in_ranges(keys: DataFrame, ranges: DataFrame, key: str = "key", salts: int = 16) -> DataFrame:
    """Keys with each open range (lo, hi) they lie in; bounds in the wrong order are swapped.

    Ranges are cut into bins by the first character of their keys, so the join has an equality to shuffle by, and the keys of
    a bin are spread over ``salts`` parts.
    """
    r = ranges.select("*", F.least("lo", "hi").alias("_a"), F.greatest("lo", "hi").alias("_b"))
    r = r.withColumn("_bin", F.explode(F.sequence(F.ascii(F.substring("_a", 1, 1)), F.ascii(F.substring("_b", 1, 1))))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    k = keys.withColumn("_bin", F.ascii(F.substring(key, 1, 1))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return k.join(r, ["_bin", "_salt"]).where((F.col(key) > F.col("_a")) & (F.col(key) < F.col("_b"))).drop("_bin", "_salt", "_a", "_b")


def typos(words: DataFrame, word: str = "word", letters: str = "αβγδεζηθικλμνξοπρστυφχψω") -> DataFrame:
    """(word, typo): one misspelling of each word, chosen by its hash: a letter dropped, doubled, replaced or swapped."""
    c, n = F.col(word), F.length(word)
    h = F.abs(F.xxhash64(c))
    at = (F.pmod(h, F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    pre, ch, post = F.substring(c, F.lit(1), at - 1), F.substring(c, at, F.lit(1)), F.substring(c, at + 1, n)
    new = F.substring(F.lit(letters), (F.pmod(F.shiftright(h, 8), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    kind = F.pmod(F.shiftright(h, 20), F.lit(4))
    typo = F.when(kind == 0, F.concat(pre, post)).when(kind == 1, F.concat(pre, ch, ch, post)).when(kind == 2, F.concat(pre, new, post)).otherwise(F.concat(pre, F.substring(post, 1, 1), ch, F.substring(post, F.lit(2), n)))
    return words.where(n >= 2).select(word, typo.alias("typo"))

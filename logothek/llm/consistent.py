"""One consistent form for texts that look the same.

Strings and code points that look alike form classes: a look-alike pair, a canonical or compatibility equivalence, an
invisible character and the empty string. The pairs are closed transitively by union-find. Of each class and alphabet
the admissible member (composed, ordinary, visible) that is most frequent in the corpus stands for all. Texts are
rewritten by one Aho-Corasick automaton over all members, leftmost longest match first; the alphabet of a word is that
of most of its letters.

Defined results: a null text stays null, an empty one stays empty, one of invisible characters and white space becomes
empty; repeated rows are rewritten alike; a letter with no look-alike in the alphabet of its word stays; of two alphabets
with equally many letters in a word the one more frequent in the corpus wins, and of equally frequent ones the first of
G, L, C. Texts of any length are rewritten whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Letters of the Latin, Greek and Cyrillic alphabets that look alike.
LOOK_ALIKE = (
    "A Α А", "B Β В", "C С", "E Ε Е", "H Η Н", "I Ι І", "J Ј", "K Κ К", "M Μ М", "N Ν", "O Ο О", "P Ρ Р", "S Ѕ",
    "T Τ Т", "X Χ Х", "Y Υ Ү", "Z Ζ", "a α а", "c с", "e е", "h һ", "i ι і", "j ј", "k κ к", "o ο о", "p ρ р", "s ѕ",
    "u υ", "v ν", "x χ х", "y γ у",
)
# Marks that stand for an apostrophe or an elision.
APOSTROPHES = "'`´ʹʼ՚᾽᾿‘’‛′＇"
APOSTROPHE = "’"
# Marks of no width outside the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵⠀ㅤﾠ"
ALPHABETS = {"G": "GREEK", "L": "LATIN", "C": "CYRILLIC"}
SCRIPT_RANGES = ((0x41, 0x250), (0x370, 0x400), (0x400, 0x530), (0x1E00, 0x1F00), (0x1F00, 0x2000))


@functools.lru_cache(1 << 16)
def alphabet(ch: str) -> str | None:
    """The alphabet of a letter, None for other characters."""
    if ud.category(ch)[0] != "L":
        return None
    name = ud.name(ch, "")
    return next((k for k, v in ALPHABETS.items() if name.startswith(v)), None)


@functools.lru_cache(1 << 16)
def invisible(ch: str) -> bool:
    """Format and control characters that are no white space, variation selectors and fillers."""
    return ch in INVISIBLE or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or (ud.category(ch) in ("Cf", "Cc") and not ch.isspace())


@functools.lru_cache(1 << 16)
def ordinary(s: str) -> str:
    """Composed form in ordinary variants."""
    if s in APOSTROPHES:
        return s
    plain = ud.normalize("NFC", ud.normalize("NFKC", s))
    return ud.normalize("NFC", s) if " " in plain and s != " " else plain


class UnionFind:
    """Disjoint sets of strings with path halving."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def spellings(composed: str) -> Iterator[str]:
    """Strings that are canonically equal to a composed letter: every prefix of its marks composed, the rest apart."""
    parts = ud.normalize("NFD", composed)
    for k in range(1, len(parts) + 1):
        yield ud.normalize("NFC", parts[:k]) + parts[k:]


def look_alike_classes(observed: Iterable[str], look_alike: Iterable[str] = LOOK_ALIKE) -> dict[str, set[str]]:
    """Classes of more than one member over the observed code points and the letters of the three alphabets.

    look_alike: groups of letters that look alike, each a string of letters with spaces between; letters of one alphabet may
    stand in one group, as the capital I and the small l, and then the frequency decides between them.
    """
    sets, observed = UnionFind(), set(observed)
    bases: dict[str, list[str]] = {}
    for group in look_alike:
        letters = group.split()
        for x in letters:
            bases[x] = letters
            sets.union(letters[0], x)
    known = {chr(c) for a, b in SCRIPT_RANGES for c in range(a, b) if alphabet(chr(c))}
    for ch in sorted(observed | known):
        if invisible(ch):
            sets.union("", ch)
        elif ch.isspace():
            sets.union(" ", ch)
        elif ch in APOSTROPHES:
            sets.union(APOSTROPHE, ch)
        else:
            if (plain := ordinary(ch)) != ch and not plain.isspace():
                sets.union(plain, ch)
            parts = ud.normalize("NFD", ch)
            if len(parts) > 1:
                for s in spellings(ch):
                    sets.union(ch, s)
                for other in bases.get(parts[0], ()):  # the same marks on a letter that looks like the base
                    if other != parts[0]:
                        for s in spellings(other + parts[1:]):
                            sets.union(ch, s)
    out: dict[str, set[str]] = {}
    for x in list(sets.parent):
        out.setdefault(sets.find(x), set()).add(x)
    return {k: v for k, v in out.items() if len(v) > 1}


def script_of(s: str) -> str | None:
    return alphabet(s[0]) if s else None


def rules(freq: dict[str, int], look_alike: Iterable[str] = LOOK_ALIKE) -> tuple[tuple[tuple[str, str | None, str, tuple[tuple[str, str], ...]], ...], tuple[str, ...]]:
    """Rewrite rules of a corpus: (member, its alphabet, its own representative, representatives by alphabet), and the order of alphabets."""
    weight = lambda s: min((freq.get(c, 0) for c in s), default=0)
    out = []
    for members in look_alike_classes(freq, look_alike).values():
        if "" in members:
            out += [(m, None, "", ()) for m in members if m]
            continue
        if " " in members or APOSTROPHE in members:
            rep = " " if " " in members else APOSTROPHE
            out += [(m, None, rep, ()) for m in members]
            continue
        by: dict[str | None, list[str]] = {}
        for m in members:
            if ordinary(m) == m:
                by.setdefault(script_of(m), []).append(m)
        best = {k: min(v, key=lambda s: (-weight(s), len(s), s)) for k, v in by.items()}
        reps = tuple(sorted((k, v) for k, v in best.items() if k))
        for m in members:
            own = script_of(ordinary(m))
            out.append((m, own, best.get(own) or ordinary(m), reps))
    totals = {k: 0 for k in ALPHABETS}
    for c, n in freq.items():
        if (a := alphabet(c)) in totals:
            totals[a] += n
    return tuple(sorted(out, key=lambda r: r[0])), tuple(sorted(totals, key=lambda k: -totals[k]))


class Rewriter:
    """Rewrites texts to their consistent form by the rules of a corpus."""

    def __init__(self, table: tuple, order: tuple[str, ...], observed: Iterable[str]) -> None:
        self.order = {k: i for i, k in enumerate(order)}
        self.automaton = ahocorasick.Automaton()
        self.first = {ord(m): rep for m, own, rep, reps in table if len(m) == 1 and rep in ("", " ")}
        clean: dict[str | None, set[str]] = {None: set(), "G": set(), "L": set(), "C": set()}
        changed = set()
        for m, own, rep, reps in table:
            if rep in ("", " "):
                changed.add(m)
                continue
            if sum(alphabet(c) is not None for c in rep) > 1:  # a ligature: its letters count one by one
                if len(m) == 1:
                    self.first[ord(m)] = rep
                    changed.add(m)
                continue
            self.automaton.add_word(m, (len(m), own, rep, dict(reps)))
            if len(m) == 1 and rep != m:
                changed.add(m)
        self.automaton.make_automaton()
        for ch in observed:
            if ch not in changed and not ch.isspace() and not invisible(ch) and ud.category(ch)[0] != "M" and ordinary(ch) == ch:
                clean[alphabet(ch)].add(ch)
        common = "".join(map(re.escape, sorted(clean[None])))
        words = [f"[{common}{''.join(sorted(clean[k]))}]+" for k in ALPHABETS if clean[k]] or ([f"[{common}]+"] if common else ["[^\\x00-\\x{10ffff}]"])
        one = "(?:" + "|".join(words) + ")"
        self.clean = f"^{one}(?: {one})*$"

    def word(self, w: str) -> str:
        hits = list(self.automaton.iter_long(w))
        pieces, at = [], 0
        count: dict[str, int] = {}
        for end, (n, own, rep, reps) in hits:
            start = end - n + 1
            for c in w[at:start]:
                pieces.append((c, alphabet(c), None))
            pieces.append((rep, own, reps))
            at = end + 1
        for c in w[at:]:
            pieces.append((c, alphabet(c), None))
        for _, own, _ in pieces:
            if own:
                count[own] = count.get(own, 0) + 1
        if len(count) < 2:
            return "".join(p[0] for p in pieces)
        most = min(count, key=lambda k: (-count[k], self.order[k]))
        return "".join(reps.get(most, rep) if own and reps else rep for rep, own, reps in pieces)

    def text(self, s: str) -> str:
        return ud.normalize("NFC", " ".join(self.word(w) for w in s.translate(self.first).split()))

    def array(self, texts: pa.Array) -> pa.Array:
        """The consistent forms of an array of texts; those made of clean words are passed through by one vectorised match."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.string())
        same = pc.fill_null(pc.match_substring_regex(texts, self.clean), False)
        todo = np.flatnonzero(~same.to_numpy(zero_copy_only=False))
        if not len(todo):
            return texts
        idx = pa.array(todo)
        fixed = pa.array([None if s is None else self.text(s) for s in texts.take(idx).to_pylist()], pa.string())
        mask = np.zeros(len(texts), bool)
        mask[todo] = True
        return pc.replace_with_mask(texts, pa.array(mask), fixed)


@functools.lru_cache(4)
def rewriter(table: tuple, order: tuple[str, ...], observed: tuple[str, ...]) -> Rewriter:
    """One automaton for a Python worker and set of rules."""
    return Rewriter(table, order, observed)


def code_point_counts(texts: DataFrame) -> dict[str, int]:
    """How often each code point occurs in a frame's only column, over all rows; at most as many entries as Unicode has code points."""
    (name,) = texts.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, np.int64)
        for b in batches:
            joined = "".join(pc.fill_null(b.column(0), "").to_pylist())
            n = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
            seen[: len(n)] += n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["cp", "n"])

    rows = texts.select(F.col(name).cast("string")).mapInArrow(count, "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {chr(r.cp): r.n for r in rows}


class Consistent:
    """Gives the consistent form by the rules of a corpus: of a column when called, of an Arrow array by ``array``."""

    def __init__(self, freq: dict[str, int], look_alike: tuple[str, ...] = LOOK_ALIKE) -> None:
        self.table, self.order = rules(freq, look_alike)
        self.observed = tuple(sorted(freq))

    def array(self, texts: pa.Array) -> pa.Array:
        return rewriter(self.table, self.order, self.observed).array(texts)

    def __call__(self, text: Column) -> Column:
        array = self.array

        @F.arrow_udf("string")
        def consistent(s: pa.Array) -> pa.Array:
            return array(s)

        return consistent(text)


    def replaced(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with their consistent texts in the place of a text column; null texts and those that become empty are left out."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.schema.get_field_index(text)
                new = self.array(b.column(k))
                columns = [*b.columns[:k], new, *b.columns[k + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, b.schema.names).filter(pc.greater(pc.fill_null(pc.utf8_length(new), 0), 0))

        return rows.mapInArrow(emit, rows.schema)


def consistent_column(texts: DataFrame, look_alike: tuple[str, ...] = LOOK_ALIKE) -> Consistent:
    """What gives consistent forms by the classes and frequencies of all texts of ``texts``; counting them is one job, run at once."""
    return Consistent(code_point_counts(texts), look_alike)


def named_texts(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, row_key, text) of several tables, each given as (name, frame, key column, text column)."""
    parts = [df.select(F.lit(name).alias("tbl"), F.col(f"`{key}`").cast("long").alias("row_key"), F.col(f"`{text}`").alias("text")) for name, df, key, text in tables]
    return functools.reduce(DataFrame.unionByName, parts)


def consistent_texts(rows: DataFrame, consistent: Consistent | None = None, text: str = "text") -> DataFrame:
    """``rows`` with a column ``consistent_text``; other columns are kept, a column of that name is replaced.

    consistent: by default that of the texts themselves.
    """
    consistent = consistent or consistent_column(rows.select(F.col(f"`{text}`").alias("t")))
    return rows.withColumn("consistent_text", consistent(F.col(f"`{text}`")))


def inconsistent_rows(rows: DataFrame, consistent: Consistent | None = None, text: str = "text") -> DataFrame:
    """The rows whose text is not in its consistent form, with ``consistent_text``; null and empty texts are none.

    Each text is rewritten once: rows are compared and dropped where they are rewritten.
    """
    consistent = consistent or consistent_column(rows.select(F.col(f"`{text}`").alias("t")))
    rows = rows.drop("consistent_text")
    schema = StructType([*rows.schema.fields, StructField("consistent_text", StringType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            new = consistent.array(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, new], [*b.schema.names, "consistent_text"]).filter(pc.not_equal(texts, new))

    return rows.where(F.length(F.col(f"`{text}`")) > 0).mapInArrow(emit, schema)

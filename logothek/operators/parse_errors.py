"""Delimited records that may be malformed: valid rows are loaded, the others come out with the reason.

A record is parsed at the least cost. The parser has the states field start, unquoted, quoted and quote seen, and counts
fields; reading a character as the grammar allows is free, and inserting or deleting a quote or a delimiter costs one.
Dynamic programming over (position, state, fields) takes one (min, +) product for each symbol: for every kind of symbol a
matrix holds the least cost of getting from one state to another by any insertions before it and by reading or deleting
it. Runs of ordinary characters count as one symbol, so time is linear in the quotes and delimiters of a record. From the
cheapest ways to end:

* ``quoting``: no well-formed record of any number of fields is free,
* ``columns``: one of exactly the wanted number of fields is not,
* ``value``: the free parse has fields that are not valid.

Records without a quote that one pattern proves valid cost nothing and are loaded as they are by built-in matching; only
the others are parsed one by one.

Defined results: a null record, or one of white space only, is a break, neither loaded nor an error; a byte order mark at
the start and one carriage return at the end belong to the file; fields are kept unaltered; carriage returns within a
quoted field count as line breaks; records of any length are parsed whole; repeated records each count; an empty table
gives empty results; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, UNQUOTED, QUOTED, SEEN = range(4)
TAB, QUOTE, OTHER = "\t", '"', "x"
NAMES = {TAB: "tab", QUOTE: "quote"}
FAR = 1 << 30
_FREE = re.compile(r'(?:"(?:[^"]++|"")*+"|[^"\t]*+)(?:\t(?:"(?:[^"]++|"")*+"|[^"\t]*+))*+')
_FIELD = re.compile(r'\t("(?:[^"]++|"")*+"|[^"\t]*+)')


def step(state: int, fields: int, c: str, most: int) -> tuple[int, int] | None:
    """What reading c leads to at no cost, None if the grammar forbids it."""
    if state == QUOTED:
        return (SEEN if c == QUOTE else QUOTED), fields
    if c == TAB:
        return START, min(fields + 1, most)
    if c == QUOTE:
        return (QUOTED, fields) if state in (START, SEEN) else None
    return (UNQUOTED, fields) if state in (START, UNQUOTED) else None


def compressed(record: str) -> list[tuple[str, int]]:
    """Symbols of a record with their offsets: tabs, quotes and runs of anything else."""
    return [(m.group()[0] if m.group()[0] in "\t\"" else OTHER, m.start()) for m in re.finditer(r'\t|"|[^\t"]+', record)]


@lru_cache(8)
def moves(columns: int) -> tuple[dict[str, np.ndarray], dict[tuple[str, int, int], tuple[str, ...]]]:
    """For each kind of symbol, and '' for the end: the matrix of least costs between states, and the edits of each move.

    A state is numbered 4 * (fields - 1) + state of the field; more than ``columns`` fields count as one more.
    """
    most = columns + 1
    states = [(state, fields) for fields in range(1, most + 1) for state in range(4)]
    number = {x: i for i, x in enumerate(states)}
    # by insertions alone
    inserts: dict[tuple[int, int], tuple[str, ...]] = {}
    for i in range(len(states)):
        front = {i: ()}
        while front:
            for j, edits in front.items():
                inserts[i, j] = edits
            following: dict[int, tuple[str, ...]] = {}
            for j, edits in front.items():
                for c in (QUOTE, TAB):
                    to = step(*states[j], c, most)
                    if to and (i, number[to]) not in inserts:
                        following.setdefault(number[to], (*edits, f"insert {NAMES[c]}"))
            front = following
    edits_of = {("", i, j): edits for (i, j), edits in inserts.items()}
    for c in (TAB, QUOTE, OTHER):
        for (i, j), edits in inserts.items():
            ways = [(number[to], edits)] if (to := step(*states[j], c, most)) else []
            if c != OTHER:
                ways.append((j, (*edits, f"delete {NAMES[c]}")))
            for k, way in ways:
                if (c, i, k) not in edits_of or len(way) < len(edits_of[c, i, k]):
                    edits_of[c, i, k] = way
    cost = {c: np.full((len(states), len(states)), FAR, np.int64) for c in (TAB, QUOTE, OTHER, "")}
    for (c, i, j), edits in edits_of.items():
        cost[c][i, j] = len(edits)
    return cost, edits_of


def least_edits(record: str, columns: int) -> tuple[int, int, list[str]]:
    """Least cost of any well-formed record, of one with ``columns`` fields, and the edits of the latter.

    An edit is ``insert quote@7`` or ``delete tab@3``, with the offset in the record.
    """
    symbols = [*compressed(record), ("", len(record))]
    cost, edits_of = moves(columns)
    table = np.full((len(symbols) + 1, len(cost[""])), FAR, np.int64)
    table[0, START] = 0
    for n, (c, _) in enumerate(symbols):
        (table[n][:, None] + cost[c]).min(0, out=table[n + 1])
    ends = [(int(table[-1, i]), i) for i in range(table.shape[1]) if i % 4 != QUOTED]
    least, at = min(x for x in ends if x[1] // 4 + 1 == columns)
    edits: list[str] = []
    for n in range(len(symbols) - 1, -1, -1):
        c, offset = symbols[n]
        before = int(np.argmin(table[n] + cost[c][:, at]))
        edits += [f"{e}@{offset}" for e in reversed(edits_of[c, before, at])]
        at = before
    return min(ends)[0], least, edits[::-1]


def fields_of(record: str) -> list[str] | None:
    """The fields of a record that parses at no cost (layer 0 alone), else None."""
    if '"' not in record:
        return record.split("\t")
    if not _FREE.fullmatch(record):
        return None
    return [f[1:-1].replace('""', '"') if f[:1] == '"' else f for f in _FIELD.findall("\t" + record)]


@lru_cache(1 << 14)
def _bad_character(c: str) -> bool:
    return c == "�" or (ud.category(c) == "Cc" and c not in "\t\n\r")


def text_ok(s: str) -> bool:
    """Something other than white space, without replacement or control characters."""
    return not s.isspace() and s != "" and not any(map(_bad_character, set(s)))


def tag_ok(tag: str, codes: dict[int, frozenset[str]]) -> bool:
    return len(tag) == len(codes) and all(c in codes[i] for i, c in enumerate(tag, 1))


def parse(record: str | None, codes: dict[int, frozenset[str]], columns: int = 3, edits: bool = True) -> dict:
    """One record: kind ``break``, ``row`` or ``error``, the reason, the three fields and the edits that would mend it.

    edits: whether the edits and the reason of a failure are wanted.
    """
    out = dict.fromkeys(("kind", "reason", "form", "pos", "lemma", "edits"))
    s = (record or "").removeprefix("﻿").removesuffix("\r")
    if not s or s.isspace():
        return out | {"kind": "break"}
    fields = fields_of(s)
    if fields is None or len(fields) != columns:
        if not edits:
            return out | {"kind": "error"}
        any_cost, _, needed = least_edits(s, columns)
        return out | {"kind": "error", "reason": "quoting" if any_cost else "columns", "edits": needed}
    form, pos, lemma = fields
    if not (text_ok(form) and text_ok(lemma) and tag_ok(pos, codes)):
        return out | {"kind": "error", "reason": "value", "edits": []}
    return out | {"kind": "row", "form": form, "pos": pos, "lemma": lemma}


def valid_codes(morph_tags: DataFrame, slots: int = 9) -> dict[int, frozenset[str]]:
    """The codes valid at each slot: single characters, so no more than Unicode has a slot."""
    rows = morph_tags.where(F.col("slot").between(1, slots) & (F.length("code") == 1)).select("slot", "code").distinct().collect()
    return {i: frozenset(r.code for r in rows if r.slot == i) for i in range(1, slots + 1)}


def clean_pattern(codes: dict[int, frozenset[str]]) -> str:
    """Matches only valid records, and most of them: no quote, no control character, a letter or digit in form and lemma."""
    text = r'[^"\t\p{Cc}\x{FFFD}]*[\p{L}\p{N}][^"\t\p{Cc}\x{FFFD}]*'
    tag = "".join("[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(codes[i] - {'"'})) + "]" if codes[i] - {'"'} else r"[^\x{0}-\x{10FFFF}]" for i in sorted(codes))
    return rf"^\x{{FEFF}}?({text})\t({tag})\t({text})\r?\z"


def loaded(records: DataFrame, morph_tags: DataFrame, raw: str = "raw") -> DataFrame:
    """(line_id, form, pos, lemma) of the valid records."""
    codes = valid_codes(morph_tags)
    pattern = clean_pattern(codes)
    for name in ("form", "pos", "lemma"):
        pattern = re.sub(r"\((?!\?)", f"(?P<{name}>", pattern, count=1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.columns
            clean = pc.extract_regex(texts.cast(pa.string()), pattern)
            is_clean = clean.is_valid()
            yield pa.RecordBatch.from_arrays([ids.filter(is_clean), *clean.filter(is_clean).flatten()], ["line_id", "form", "pos", "lemma"])
            rest = pc.invert(is_clean)
            rows = [(i, p["form"], p["pos"], p["lemma"]) for i, s in zip(ids.filter(rest).to_pylist(), texts.filter(rest).to_pylist(), strict=True) if (p := parse(s, codes, edits=False))["kind"] == "row"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["line_id", "form", "pos", "lemma"])

    return records.select(F.col("line_id").cast("long"), F.col(f"`{raw}`").alias("raw")).mapInArrow(emit, "line_id long, form string, pos string, lemma string")


def failures(records: DataFrame, morph_tags: DataFrame, raw: str = "raw") -> DataFrame:
    """(line_id, reason, edits) of the records that fail."""
    codes = valid_codes(morph_tags)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p["reason"], p["edits"]) for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (p := parse(s, codes))["kind"] == "error"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(pa.string())), strict=True)], ["line_id", "reason", "edits"])

    suspect = records.select(F.col("line_id").cast("long"), F.col(f"`{raw}`").alias("raw")).where(F.col("raw").isNotNull() & ~F.col("raw").rlike(clean_pattern(codes)))
    return suspect.mapInArrow(emit, "line_id long, reason string, edits array<string>")

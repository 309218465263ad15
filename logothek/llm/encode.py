"""Encoding of texts with a public byte-level tokenizer, as a reduction over a monoid of encoded spans.

A text is cut in halves down to leaves, each leaf is encoded on its own, and neighbours are joined up the tree. At a
join only a window around the border is encoded again. It grows on either side until it ends at a safe cut: a position
at which a pre-token of the pattern ends whatever follows, as between a letter or digit and a space or sign. No pre-token
reaches over such a position and none looks behind it, so the encoding of a text is that of the part before a safe cut
followed by that of the part after it; tokens outside the window are those of the whole text. A span without any safe
cut is one leaf, since nothing inside it is stable. Decoding concatenates the bytes of the tokens.

Ids are numbers in buffers throughout, never lists of objects; a batch of the corpus is emitted in slices of ``SLICE`` ids,
and each text is freed before the next is read, so memory is that of a batch of texts and of the longest single text.

Defined results: null and empty texts have no ids, an empty list; special tokens in a text are ordinary text; texts of
any length are encoded whole; repeated texts have equal ids; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from logothek.session import spread

#: Folder of the vocabulary files; a parameter, never copied.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pattern by which the vocabulary's tokenizer splits text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf.
LEAF = 4096
#: Characters by which a window begins to grow.
WINDOW = 64
#: Ids of one emitted batch.
SLICE = 1 << 20
#: Letters and digits whose kind is the same in every version of Unicode, and signs that begin no contraction.
_LETTER, _SIGN = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яぁ-ゖァ-ヺ一-鿿가-힣", r"!-&(-/:-@\[-`{-~"
SAFE = re.compile(rf"[{_LETTER}](?=[\s0-9{_SIGN}'、。！，？])|[0-9](?=[\s{_LETTER}{_SIGN}'])|[{_SIGN}](?=[\s0-9{_LETTER}])")
NO_IDS = np.zeros(0, np.int32)


@dataclass(frozen=True)
class Span:
    """A piece of text and its ids: an element of the monoid. The text is kept as a place in the whole."""

    start: int
    end: int
    ids: np.ndarray


class MonoidEncoder:
    """Encodes by tree reduction; ``base`` gives the ids of a text as numbers of 32 bits."""

    def __init__(self, base, decode_bytes=None, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.base, self.decode_bytes, self.leaf, self.window = base, decode_bytes, max(2, leaf), max(1, window)

    def cut_before(self, s: str, start: int, end: int) -> int:
        """The last safe cut of s[start:end], ``start`` if it has none; the window doubles until there is one."""
        w = self.window
        while True:
            a, at = max(start, end - w), -1
            for m in SAFE.finditer(s, a, end):
                at = m.end() if m.end() < end else at
            if at > 0 or a == start:
                return max(at, start)
            w *= 2

    def cut_after(self, s: str, start: int, end: int) -> int:
        """The first safe cut of s[start:end], ``end`` if it has none."""
        m = SAFE.search(s, start, end)
        return m.end() if m and m.end() < end else end

    def join(self, s: str, left: Span, right: Span) -> Span:
        if left.start == left.end or right.start == right.end:
            return right if left.start == left.end else left
        a, b = self.cut_before(s, left.start, left.end), self.cut_after(s, right.start, right.end)
        n_tail, n_head = len(self.base(s[a : left.end])), len(self.base(s[right.start : b]))
        return Span(left.start, right.end, np.concatenate((left.ids[: len(left.ids) - n_tail], self.base(s[a:b]), right.ids[n_head:])))

    def span(self, s: str, start: int, end: int) -> Span:
        if end - start <= self.leaf or self.cut_after(s, start, end) == end:
            return Span(start, end, self.base(s[start:end]) if end > start else NO_IDS)
        half = (start + end) // 2
        return self.join(s, self.span(s, start, half), self.span(s, half, end))

    def encode(self, s: str | None) -> np.ndarray:
        return self.span(s, 0, len(s)).ids if s else NO_IDS

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no text, as in a list cut within a character, become U+FFFD."""

        def up(a: int, b: int) -> bytes:
            return self.decode_bytes(ids[a:b]) if b - a <= self.leaf else up(a, (a + b) // 2) + up((a + b) // 2, b)

        return up(0, len(ids)).decode("utf-8", "replace")


@functools.lru_cache(4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF, window: int = WINDOW) -> MonoidEncoder:
    """The encoder of a vocabulary, once for each Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def base(s: str) -> np.ndarray:
        return own.encode_to_numpy(s, disallowed_special=()).view(np.int32)

    return MonoidEncoder(base, own.decode_bytes, leaf, window)


def ids_lists(texts: pa.Array, e: MonoidEncoder, slice_ids: int = SLICE) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, past the last row, list array of ids) over consecutive rows, in slices of ``slice_ids`` ids or little more."""
    first, held, ends = 0, [], [0]
    for i in range(len(texts)):
        ids = e.encode(texts[i].as_py())
        held.append(ids)
        ends.append(ends[-1] + len(ids))
        if ends[-1] >= slice_ids or i + 1 == len(texts):
            yield first, i + 1, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held)))
            first, held, ends = i + 1, [], [0]


def encoded_rows(rows: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """``rows`` with ``ids`` in the place of the text column."""
    keep = [f for f in rows.schema.fields if f.name != text]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder, leaf)
        for b in batches:
            others = b.select([f.name for f in keep])
            for i, j, ids in ids_lists(b.column(b.schema.get_field_index(text)), e):
                yield pa.RecordBatch.from_arrays([*others.slice(i, j - i).columns, ids], [*others.schema.names, "ids"])

    return rows.mapInArrow(emit, StructType([*keep, StructField("ids", ArrayType(IntegerType()))]))


def counted_rows(rows: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf: int = LEAF) -> DataFrame:
    """``rows`` that have tokens, with ``n_tokens`` in the place of the text column; each text is encoded once."""
    keep = [f for f in rows.schema.fields if f.name != text]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, folder, leaf)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            n = np.fromiter((len(e.encode(texts[i].as_py())) for i in range(len(texts))), np.int64, len(texts))
            whole = b.select([f.name for f in keep])
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(n)], [*whole.schema.names, "n_tokens"]).filter(pa.array(n > 0))

    return rows.mapInArrow(emit, StructType([*keep, StructField("n_tokens", LongType())]))


def text_column(ids: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The text of a column of id lists; null for null."""

    @F.arrow_udf("string")
    def text(s: pa.Array) -> pa.Array:
        e = encoder(name, folder)
        return pa.array((e.decode(s[i].values.to_pylist()) if s[i].is_valid else None for i in range(len(s))), pa.string())

    return text(ids)


def encoded(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encoded_rows(spread(documents.select("doc_id", "text")), "text", name, folder)

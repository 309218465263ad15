"""Records of evaluation splits that recur, exactly or almost, in the training split.

Two records overlap if their lemmas are equal and their forms are equal or, both of six or more characters, one edit
apart. Compared are folded texts: the consistent form without case, accents and other marks, final sigma as sigma,
without signs at either end.

The join is an exact prefix-filter join. Texts are first collapsed to distinct (lemma, form) classes, so copies are
never compared with each other. A form has the bigrams of its text between two end marks, each standing for its hash
bucket; one edit destroys at most two of them, so two forms one edit apart share one of the three rarest bigrams of
either (forms too short for an edit: the rarest one), at positions that differ by one at most. Rarity is the rank of the
bucket by its occurrences over all classes, an exact global order however bigrams collide; among equal bigrams the one
further left comes first, which an edit doesn't change. Evaluation prefixes are the index; training prefixes probe it by
(lemma, bigram) with the length and position filters; what is left is verified.

Each text is folded once and the classes are written once; bigrams and prefixes of a batch are computed as arrays. A
(lemma, bigram) that many probes hold is salted, within the lemmas that are hot themselves.

Defined results: null, empty and blank forms or lemmas, and such as have no letter or digit, match nothing; repeated rows
give one pair for each pair of rows; an empty split gives no pair; pairs within a split are never reported; forms of any
length are compared whole.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logothek.operators import skew
from logothek.session import checkpointed

#: Buckets of the bigram counts: what is sent to every task has this many numbers, whatever the corpus.
BUCKETS = 1 << 16
#: Characters a form must have to match with one edit.
MIN_NEAR = 6


class _Unmarked(dict):
    """Translation that drops marks and makes final sigma a sigma, filled in as characters are met."""

    def __missing__(self, cp: int) -> int | None:
        to = None if ud.category(chr(cp))[0] == "M" else ord("σ") if chr(cp) == "ς" else cp
        self[cp] = to
        return to


_UNMARKED = _Unmarked()


def fold(s: str) -> str:
    """A consistent text without case, marks, final sigma and outer signs; '' if nothing is left."""
    s = ud.normalize("NFC", ud.normalize("NFD", s).lower().translate(_UNMARKED))
    a, b = 0, len(s)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return s[a:b]


def bigrams(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all bigrams between end marks: the number of the form, the position in it, and the bucket."""
    cp = np.frombuffer("".join(f"\x02{f}\x03" for f in forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, forms), np.int64, len(forms)) + 2
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(forms)), sizes)
    last = np.zeros(len(cp), bool)
    last[ends - 1] = True
    at = np.flatnonzero(~last)
    mixed = (cp[at] * np.uint64(0x9E3779B1)) ^ ((cp[at + 1] * np.uint64(0x85EBCA6B)) >> np.uint64(7))
    return row[at], at - (ends - sizes)[row[at]], (mixed % np.uint64(BUCKETS)).astype(np.int64)


def prefix_rows(forms: list[str], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rarest bigrams by which every partner of a form is found: the number of the form, the rank, the position.

    rank: of each bucket, its place in the order from rare to frequent.
    """
    row, at, bucket = bigrams(forms)
    r = rank[bucket]
    order = np.lexsort((at, r, row))
    row, at, r = row[order], at[order], r[order]
    first = np.searchsorted(row, np.arange(len(forms)))
    wanted = np.where(np.fromiter(map(len, forms), np.int64, len(forms)) >= MIN_NEAR, 3, 1)
    keep = np.arange(len(row)) - first[row] < wanted[row]
    return row[keep], r[keep], at[keep]


def bucket_ranks(classes: DataFrame) -> np.ndarray:
    """Buckets in the order of their occurrences over the forms of all classes; BUCKETS numbers at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            if b.num_rows:
                seen += np.bincount(bigrams(b.column(0).to_pylist())[2], minlength=BUCKETS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["b", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    for r in classes.select("form").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r.b] = r.n
    rank = np.empty(BUCKETS, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
    return rank


def folded_pairs(pairs: DataFrame, consistent=None) -> DataFrame:
    """(pair_id, side, split, source, form, lemma) with folded texts; side is ``t`` for training, ``e`` for evaluation.

    consistent: its ``array`` gives the consistent forms of an Arrow array; None takes the texts for consistent. Rows that match nothing are left out.
    """
    schema = "pair_id long, side string, split string, source string, form string, lemma string"

    def folded(column: pa.Array) -> pa.Array:
        words = column.dictionary_encode()
        plain = pa.array([None if x is None else fold(x) for x in (consistent.array(words.dictionary) if consistent else words.dictionary).to_pylist()], pa.string())
        return plain.take(words.indices)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.RecordBatch.from_arrays([*b.columns[:4], folded(b.column(4)), folded(b.column(5))], b.schema.names)
            full = [pc.greater(pc.fill_null(pc.utf8_length(out.column(k)), 0), 0) for k in (4, 5)]
            yield out.filter(pc.and_(*full))

    side = F.when(F.col("split") == "train", "t").when(F.col("split").isin("dev", "test"), "e")
    rows = pairs.select(F.col("pair_id").cast("long"), side.alias("side"), "split", "source", "form", "lemma")
    return rows.where("side IS NOT NULL AND length(form) > 0 AND length(lemma) > 0").mapInArrow(emit, schema)


def prefixes(classes: DataFrame, rank: np.ndarray) -> DataFrame:
    """(lemma, gram, form, at, n): one row for each bigram of a class's prefix, with its position and the length of the form."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row, gram, at = prefix_rows(b.column(1).to_pylist(), rank)
            full = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([full.column(0), pa.array(gram, pa.int32()), full.column(1), pa.array(at, pa.int32()), pc.utf8_length(full.column(1))], ["lemma", "gram", "form", "at", "n"])

    return classes.select("lemma", "form").mapInArrow(emit, "lemma string, gram int, form string, at int, n int")


def class_links(classes: DataFrame) -> DataFrame:
    """(lemma, form_e, form_t) of all evaluation and training classes that overlap, each once.

    classes: distinct (side, lemma, form), a written table, since it is read for the counts, the index and the probes.
    """
    rank = bucket_ranks(classes)
    train = classes.where("side = 't'")
    named = lambda df, k: df.select("lemma", "gram", *[F.col(c).alias(f"{c}_{k}") for c in ("form", "at", "n")])
    index, probe = named(prefixes(classes.where("side = 'e'"), rank), "e"), named(prefixes(train, rank), "t")
    # a hot (lemma, bigram) belongs to a hot lemma: only the classes of those are counted by bigram
    hot_lemmas = skew.hot_keys(train, ["lemma"])
    hot = skew.hot_keys(prefixes(train.join(F.broadcast(hot_lemmas), "lemma", "left_semi"), rank), ["lemma", "gram"])
    near = (F.col("n_e") >= MIN_NEAR) & (F.col("n_t") >= MIN_NEAR)
    met = skew.salted_join(probe, index, ["lemma", "gram"], salt_by="form_t", hot=hot).where((F.abs(F.col("n_e") - F.col("n_t")) <= 1) & (F.abs(F.col("at_e") - F.col("at_t")) <= 1))
    same = F.col("form_e") == F.col("form_t")
    return met.where(same | (near & (F.levenshtein("form_e", "form_t", 1) >= 0))).select("lemma", "form_e", "form_t").distinct()


def overlap_pairs(pairs: DataFrame, consistent=None) -> DataFrame:
    """(eval_id, train_id, split, source, exact): every evaluation row with every training row it overlaps.

    Links are found between classes and expanded to rows by joins on the class, in which a class of many copies is salted.
    """
    rows = checkpointed(folded_pairs(pairs, consistent))
    classes = checkpointed(rows.groupBy("side", "lemma", "form").agg(F.count("*").alias("n")))
    links = class_links(classes)
    e = rows.where("side = 'e'").select("lemma", F.col("form").alias("form_e"), F.col("pair_id").alias("eval_id"), "split", "source")
    t = rows.where("side = 't'").select("lemma", F.col("form").alias("form_t"), F.col("pair_id").alias("train_id"))
    hot = lambda k: skew.hot_of_counts(classes.where(F.col("side") == k), ["lemma", "form"], "n").withColumnRenamed("form", f"form_{k}")
    hits = skew.salted_join(e, links, ["lemma", "form_e"], salt_by="eval_id", hot=hot("e"))
    # both sides of this join may hold copies: the salted one is the larger table, the training rows
    return skew.salted_join(t, hits, ["lemma", "form_t"], salt_by="train_id", hot=hot("t")).select("eval_id", "train_id", "split", "source", (F.col("form_e") == F.col("form_t")).alias("exact"))


def overlap_report(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows with an exact and with any overlap, pairs, and the share of rows that leak."""
    rows = pairs.where(F.col("split").isin("dev", "test")).groupBy("split", "source").agg(F.count("*").alias("n_rows"))
    by_row = found.groupBy("split", "source", "eval_id").agg(F.count("*").alias("k"), F.max("exact").alias("exact"))
    hits = by_row.groupBy("split", "source").agg(F.count("*").alias("n_leaked"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum("k").alias("n_pairs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = rows.alias("a").join(hits.alias("b"), F.col("a.split").eqNullSafe(F.col("b.split")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    return joined.select("a.split", "a.source", "n_rows", zero("n_leaked"), zero("n_exact"), zero("n_pairs"), F.round(F.coalesce(F.col("n_leaked"), F.lit(0)) / F.col("n_rows"), 6).alias("leak_share"))

"""Streams of texts: running and windowed counts, and lookup in a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logothek.functions import text as T


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Running counts of keys; write with output mode update or complete."""
    return texts.select(F.explode(T.words(F.col(text))).alias("raw")).groupBy(T.key(F.col("raw")).alias("key")).agg(F.count("*").alias("n"))


def windowed_counts(texts: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours", text: str = "text") -> DataFrame:
    """Counts of keys by window of event time; a window is given out once rows up to ``late`` after it can't come any more."""
    w = texts.withWatermark(time, late).select(time, F.explode(T.words(F.col(text))).alias("raw"))
    return w.groupBy(F.window(time, window).alias("w"), T.key(F.col("raw")).alias("key")).agg(F.count("*").alias("n")).select("w.start", "w.end", "key", "n")


def looked_up(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """A stream of words with the lemma of their form, then of their key: a stateless join with a static lexicon (form, lemma)."""
    exact = lexicon.select(F.col("form").alias(word), F.col("lemma").alias("_exact"))
    loose = lexicon.groupBy(T.key(F.col("form")).alias("_k")).agg(F.min("lemma").alias("_loose"))
    return words.join(exact, word, "left").join(loose, T.key(F.col(word)) == F.col("_k"), "left").withColumn("lemma", F.coalesce("_exact", "_loose")).drop("_exact", "_loose", "_k")

"""Joins that stay balanced when one key holds a large share of all rows.

A key is hot when it holds more than 1/SHARE of a table's rows, so there can be at most SHARE hot keys, whatever the
size of the table: that bound is what lets the list of hot keys be broadcast. Hot rows get a salt, the rows they meet on
the other side are repeated once for each salt, and the union of all salts is the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/SHARE of the rows is hot; SHARE also bounds the number of hot keys.
SHARE = 256
#: Most rows of a broadcast side, some 100 bytes each in memory; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Keys of made rows are counted in as many parts by hash, so that counting them takes next to no memory, however many they are.
PARTS = 4096


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a side has at most ``limit`` rows; reads no more than limit + 1 of them."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def hot_of_counts(counts: DataFrame, keys: list[str], n: str = "_n", share: int = SHARE) -> DataFrame:
    """Hot keys, with the number of salts each gets, of a table of counts by key; at most ``share`` rows."""
    total = counts.agg(F.sum(n).alias("_total"))
    return (
        counts.join(F.broadcast(total), F.col(n) * share > F.col("_total"))
        .select(*keys, F.ceil(F.col(n) * share / F.col("_total")).cast("int").alias("_salts"))
    )


def hot_keys(df: DataFrame, keys: list[str], share: int = SHARE) -> DataFrame:
    """Keys with more than 1/share of the rows and the number of salts each gets (at most ``share`` rows).

    Null keys never match and so are never hot. An empty table has no hot key.
    """
    return hot_of_counts(df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_n", share)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salt_by: str, how: str = "inner", share: int = SHARE, hot: DataFrame | None = None, made: bool = False) -> DataFrame:
    """Equi-join of ``big``, whose keys may be skewed, with ``other``.

    big: skewed side; ``salt_by`` is a column of it that tells its rows apart and spreads the rows of a hot key.
    how: inner, left, left_semi or left_anti. Columns of the two sides other than the keys must differ in name.
    hot: the hot keys and their salts if they are known, at most some hundred rows; else ``big`` is counted.
    made: rows are made of far fewer ones, so the planner, which takes them for as large as those, may broadcast neither side;
    hot are then whole parts of the keys' hashes, and ``hot`` isn't taken.
    Rows with null keys match nothing; repeated rows join as often as they occur.
    """
    by = keys
    if made:
        part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
        by, big, other = ["_part"], big.withColumn("_part", part), other.withColumn("_part", part)
        hot = hot_keys(big.dropna(subset=keys), by, share)
    hot = F.broadcast(hot_keys(big, keys, share) if hot is None else hot)
    left = big.join(hot, by, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts", "_part")
    right = (
        other.join(hot, by, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        .drop("_salts", "_part")
    )
    return left.join(right.hint("merge") if made else right, [*keys, "_salt"], how).drop("_salt")

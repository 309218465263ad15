"""Scoring predictions at several levels of strictness, and summaries of ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logothek.functions import text as T


def levels(pred: Column, gold: Column) -> dict[str, Column]:
    """Whether a prediction is right exactly, in monotonic form and without marks, after trimming and lower-casing."""
    p, g = T.outer_trim(F.lower(pred)), T.outer_trim(F.lower(gold))
    return {"strict": p == g, "monotonic": T.monotonic(p) == T.monotonic(g), "stripped": T.fold_sigma(T.strip_accents(p)) == T.fold_sigma(T.strip_accents(g))}


def accuracy(scored: DataFrame, by: list[list[str]], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Percentages by grouping sets: rows and share right at each level; a null prediction is wrong."""
    names = sorted({c for s in by for c in s})
    flags = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in levels(F.col(pred), F.col(gold)).items()}
    rows = scored.select(*names, *[v.alias(f"_{k}") for k, v in flags.items()])
    return rows.groupingSets(by, *names).agg(F.count("*").alias("n"), *[F.round(F.avg(f"_{k}") * 100, 2).alias(k) for k in flags])


def with_equivalents(scored: DataFrame, groups: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """``scored`` with ``equiv``: right without marks, or a prediction and a gold lemma that share a group.

    groups: (group_id, lemma), of any size; a lemma of two groups is equal to the members of both, not they to each other.
    One of the two must be a member as it is written, the other without case and marks. The groups of the two lemmas are
    intersected, so no pairs of a group's members are made.
    """
    of = groups.select("lemma", "group_id").distinct()
    bare = lambda c: T.fold_sigma(T.strip_accents(T.outer_trim(F.lower(c))))
    loose = of.select(bare(F.col("lemma")).alias("_b"), "group_id").distinct()
    pairs = scored.select(pred, gold).dropna().distinct()
    hits = []
    for exact, other in ((gold, pred), (pred, gold)):
        of_exact = pairs.join(of.withColumnRenamed("lemma", exact), exact).withColumn("_b", bare(F.col(other)))
        hits.append(of_exact.join(loose, ["_b", "group_id"], "left_semi").select(pred, gold))
    p = hits[0].unionByName(hits[1]).distinct().withColumn("_e", F.lit(True))
    right = levels(F.col(pred), F.col(gold))["stripped"]
    return scored.join(p, [pred, gold], "left").withColumn("equiv", F.coalesce(right, F.lit(False)) | F.col("_e").isNotNull()).drop("_e")


def percentile_by_index(values: DataFrame, column: str, q: list[float]) -> DataFrame:
    """(q, column): the values at the positions floor(n * q) of the sorted list, not interpolated.

    From counts of distinct values, put in order over all tasks; only the sums of the tasks come to the driver.
    """
    from logothek.operators.order import running_sum

    c = running_sum(values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("k")), None, [column], "k")
    total = F.broadcast(c.agg(F.max("running").alias("_n")))
    at = F.explode(F.array(*map(F.lit, q))).alias("q")
    pos = F.least(F.floor(F.col("_n") * F.col("q")), F.col("_n") - 1)
    return c.crossJoin(total).select(column, "k", "running", "_n", at).where((pos >= F.col("running") - F.col("k")) & (pos < F.col("running"))).select("q", column)

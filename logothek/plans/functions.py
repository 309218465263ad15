"""Queries of the vectorised text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import udfs as U
from logothek.operators import fuzzy as Z
from logothek.plans import lexicon as PL
from logothek.plans.registry import query
from logothek.session import table


@query("sanitised_forms")
def sanitised_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon forms that sanitising changes."""
    return PL.lex(spark, d).select("row_id", "form", U.sanitise(F.col("form")).alias("sanitised")).where("form <> sanitised")


@query("sentence_counts")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = U.segment(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"))


@query("spelling_variants")
def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Headwords, and as they are seldom confused such with ω for ο, with the headwords that byzantine confusions make of them."""
    h = PL.two(spark, d)[2].select(F.col("form").alias("word"))
    w = h.unionByName(h.select(F.replace("word", F.lit("ο"), F.lit("ω")).alias("word"))).distinct()
    v = w.select("word", F.explode(U.spelling_candidates("byzantine")(F.col("word"))).alias("x")).select("word", "x.cand", "x.cost")
    return v.join(h.select(F.col("word").alias("cand")).distinct(), "cand", "left_semi").select("word", "cand", "cost")


@query("dialect_variants")
def dialect_variants(spark: SparkSession, d: str) -> DataFrame:
    return PL.two(spark, d)[2].select(F.col("form").alias("word"), F.explode(U.dialect_candidates(F.col("form"))).alias("cand"))


@query("char_roles")
def char_roles(spark: SparkSession, d: str) -> DataFrame:
    return PL.pairs(spark, d).select("pair_id", F.concat_ws(",", U.roles(F.col("lemma"), F.col("form"))).alias("roles"))


@query("ocr_distances")
def ocr_distances(spark: SparkSession, d: str) -> DataFrame:
    return PL.pairs(spark, d).select("pair_id", F.round(Z.ocr_distance("form", "lemma"), 6).alias("distance"))

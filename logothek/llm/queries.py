"""Queries of the training-data operators over the tables of a data directory, and their SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.llm import consistent as cons
from logothek.llm import encode, mix, overlap, quality, survivors
from logothek.session import table


def named(spark: SparkSession, d: str) -> DataFrame:
    return cons.named_texts([("lookup", table(spark, d, "lookup"), "row_id", "form"), ("lemmas", table(spark, d, "lemmas"), "id", "text"), ("lemmapairdataset", table(spark, d, "lemmapairdataset"), "pair_id", "lemma")])


def consistent(spark: SparkSession, d: str) -> cons.Consistent:
    """The consistent form of all queries: one table of frequencies over every form, headword and lemma."""
    pairs = table(spark, d, "lemmapairdataset").select(F.explode(F.array("form", "lemma")).alias("t"))
    return cons.consistent_column(table(spark, d, "lookup").select(F.col("form").alias("t")).union(table(spark, d, "lemmas").select("text")).union(pairs))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = survivors.lexicon_survivors(table(spark, d, "lookup"), table(spark, d, "lemmas"), table(spark, d, "lexicon_sources"), consistent(spark, d))
    return rows.select("group_id", F.coalesce("lemma_id", F.lit(-1).cast("long")).alias("lemma_id"), F.coalesce("src", F.lit("")).alias("src"))


def p1_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Survivors of equally written forms in which a source stands with no other lemma than its own best record has.

    ``src`` determines ``lemma_id``, so a group whose best source and best lemma disagree branches.
    """
    rows = survivors.lexicon_survivors(table(spark, d, "lookup"), table(spark, d, "lemmas"), table(spark, d, "lexicon_sources"), dependencies=[survivors.Dependency("src", "lemma_id")])
    return rows.select("group_id", "n_records", F.coalesce("lemma_id", F.lit(-1).cast("long")).alias("lemma_id"), F.coalesce("src", F.lit("")).alias("src"))


#: All choices of every group, tried out.
P1_BUNDLES = r"""
WITH labels AS (SELECT lower(regexp_replace(src, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS label, src, trust FROM lexicon_sources),
r AS (SELECT lang, form, l.row_id, CASE WHEN l.lemma_id IN (SELECT id FROM lemmas) THEN l.lemma_id END AS lemma_id, s.src AS src, coalesce(s.trust, 0) AS t,
             row_number() OVER (PARTITION BY lang, form ORDER BY coalesce(s.trust, 0) DESC, updated_at DESC NULLS LAST, row_id) AS k
      FROM lookup l LEFT JOIN labels s ON lower(regexp_replace(l.src, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) = s.label WHERE trim(form) <> '' AND trim(lang) <> ''),
g AS (SELECT lang, form, min(row_id) AS group_id, count(*) AS n_records FROM r GROUP BY lang, form HAVING count(*) > 1),
a AS (SELECT lang, form, lemma_id, max(t) AS t, min(k) AS k FROM r WHERE lemma_id IS NOT NULL GROUP BY lang, form, lemma_id UNION ALL SELECT lang, form, NULL, 0, 1::BIGINT << 60 FROM g),
b AS (SELECT lang, form, src, max(t) AS t, min(k) AS k FROM r WHERE src IS NOT NULL GROUP BY lang, form, src UNION ALL SELECT lang, form, NULL, 0, 1::BIGINT << 60 FROM g),
det AS (SELECT lang, form, src, arg_min(lemma_id, k) AS own FROM r WHERE src IS NOT NULL AND lemma_id IS NOT NULL GROUP BY lang, form, src),
tried AS (SELECT g.group_id, g.n_records, a.lemma_id, b.src, row_number() OVER (PARTITION BY g.group_id ORDER BY a.t + b.t DESC, a.k, b.k) AS o
      FROM g JOIN a USING (lang, form) JOIN b USING (lang, form) LEFT JOIN det ON det.lang = g.lang AND det.form = g.form AND det.src = b.src
      WHERE a.lemma_id IS NULL OR det.own IS NULL OR det.own = a.lemma_id)
SELECT group_id, n_records, coalesce(lemma_id, -1) AS lemma_id, coalesce(src, '') AS src FROM tried WHERE o = 1
"""


def pair_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "lemmapairdataset"), consistent(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_overlaps(spark, d).select(F.least("eval_id", "train_id").alias("pair_id_a"), F.greatest("eval_id", "train_id").alias("pair_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "lemmapairdataset"), pair_overlaps(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return cons.inconsistent_rows(named(spark, d), consistent(spark, d)).select("tbl", "row_key")


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    return cons.consistent_texts(named(spark, d), consistent(spark, d)).select("tbl", "row_key", "consistent_text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the text its ids decode to ('' for null)."""
    return encode.encoded(table(spark, d, "documents")).select("doc_id", encode.text_column(F.col("ids")).alias("text"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mix.mixed(mix.sizes(table(spark, d, "documents"), targets), targets)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    sized = mix.sizes(table(spark, d, "documents"), targets)
    return mix.shares(sized, mix.mixed(sized, targets), targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_bundles, p2_found, p2_report, p4_found, p4_texts, p6_ids, p6_round_trip, p7_selection, p7_shares, p8_found, p8_statistics)}


def oracle_sql() -> dict[str, str]:
    return {"p1_bundles": P1_BUNDLES, "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}

"""Sinks: bucketed and partitioned lexicon tables, text formats, and the spelling dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon_table(rows: DataFrame, name: str, buckets: int = 64) -> None:
    """A table partitioned by ``lang``, bucketed and sorted by ``form``, so that joins on the form need no shuffle; statistics are computed."""
    rows.write.mode("overwrite").partitionBy("lang").bucketBy(buckets, "form").sortBy("form").saveAsTable(name)
    rows.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS form")


def parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sorted_tsv(rows: DataFrame, path: str, *by: str) -> None:
    """Gzipped tab-separated files, in order over all files."""
    rows.orderBy(*by).write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def spelling_dictionary(signatures: DataFrame, path: str) -> None:
    """Lines ``stem/flag`` of the lemmas and ``SFX flag`` rules of a dictionary for spelling checkers, in two folders of text files.

    signatures: (lemma, stem, signature, flag) of ``operators.frequency.suffix_signatures``.
    """
    entry = F.when(F.col("flag").isNull(), F.col("lemma")).otherwise(F.concat_ws("/", "stem", F.col("flag").cast("string")))
    signatures.select(entry.alias("value")).distinct().orderBy("value").write.mode("overwrite").text(f"{path}/dic")
    rules = signatures.where("flag IS NOT NULL").select("flag", F.explode(F.split("signature", r"\|")).alias("suffix")).distinct()
    rules.select(F.concat_ws(" ", F.lit("SFX"), F.col("flag").cast("string"), F.lit("0"), F.when(F.col("suffix") == "", "0").otherwise(F.col("suffix")), F.lit(".")).alias("value")).orderBy("value").write.mode("overwrite").text(f"{path}/aff")


def paradigms(rows: DataFrame, path: str) -> None:
    """One JSON object for each lemma and dialect, with a map from cells to forms. rows: (lemma, dialect, key, form), one for each cell."""
    cells = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "form"))))  # a verb has some thousand cells at most
    rows.groupBy("lemma", "dialect").agg(cells.alias("cells")).write.mode("overwrite").json(path)


def corpora(sentences: DataFrame, path: str, dev: str = "dev") -> None:
    """Sentences in a folder for each corpus and part, training or held out, and a folder of their counts. sentences: (corpus, sent_id, framed, n, dev)."""
    parts = sentences.withColumn("part", F.when(F.col(dev), "dev").otherwise("train"))
    parts.drop(dev).write.mode("overwrite").partitionBy("corpus", "part").parquet(f"{path}/sentences")
    parts.groupBy("corpus", "part").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_tokens")).write.mode("overwrite").json(f"{path}/stats")

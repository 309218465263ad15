"""Readers of treebanks, corpora and lexica into flat DataFrames. Malformed lines are left out unless said otherwise."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logothek.functions.text import any_greek, lacuna, outer_trim, polytonic_share, strip_length
from logothek.functions.udfs import beta_code

CONLLU = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines of text files, numbered within each file; a file is read by one task."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return raw.withColumn("value", F.regexp_replace("value", "\r$", ""))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_no, line_no, id..misc): words of CoNLL-U files; comments, ranges, empty nodes and lines of fewer than four columns are left out."""
    rows = lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("sent_no", F.sum((F.trim("value") == "").cast("int")).over(w))
    cols = F.split("value", "\t")
    kept = rows.where(~F.col("value").startswith("#") & (F.size(cols) >= 4) & ~F.get(cols, F.lit(0)).rlike("[-.]"))
    return kept.select("file", "sent_no", "line_no", *[F.get(cols, F.lit(i)).alias(c) for i, c in enumerate(CONLLU)])


def treebank_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, pos, form, lemma, postag): words of XML treebanks of sentence and word elements; files that don't parse are left out."""
    schema = "_id string, word array<struct<_form:string,_lemma:string,_postag:string>>"
    s = spark.read.format("xml").option("rowTag", "sentence").option("mode", "DROPMALFORMED").schema(schema).load(path)
    return s.select(F.col("_id").alias("sent_id"), F.posexplode("word").alias("pos", "w")).select("sent_id", "pos", F.col("w._form").alias("form"), F.col("w._lemma").alias("lemma"), F.col("w._postag").alias("postag"))


def diorisis_xml(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, pos, form, lemma, tag): words of XML texts whose forms are in Beta Code."""
    schema = "_id string, word array<struct<_form:string,lemma:struct<_entry:string,_POS:string>>>"
    s = spark.read.format("xml").option("rowTag", "sentence").option("mode", "DROPMALFORMED").schema(schema).load(path)
    w = s.select(F.col("_id").alias("sent_id"), F.posexplode("word").alias("pos", "w"))
    return w.select("sent_id", "pos", beta_code(F.col("w._form")).alias("form"), F.col("w.lemma._entry").alias("lemma"), F.col("w.lemma._POS").alias("tag"))


def tagged_words(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, form, tag, lemma): elements with attributes word, tag and lemma, in files that are no well-formed XML."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rx = r'word="([^"]*)"[^>]*?tag="([^"]*)"[^>]*?lemma="([^"]*)"'
    zipped = F.arrays_zip(*[F.regexp_extract_all("value", F.lit(rx), F.lit(i)).alias(n) for i, n in ((1, "form"), (2, "tag"), (3, "lemma"))])
    return t.select("file", F.posexplode(zipped).alias("pos", "x")).select("file", "pos", "x.form", "x.tag", "x.lemma")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, pos, form, gold): two-column gold sets in which a blank line ends a sentence."""
    rows = lines(spark, path)
    w = Window.partitionBy("file").orderBy("line_no")
    cols = F.split("value", "\t")
    rows = rows.withColumn("sent_id", F.sum((F.trim("value") == "").cast("int")).over(w)).where(F.size(cols) >= 2)
    return rows.select("file", F.col("sent_id").cast("int").alias("sent_id"), F.row_number().over(Window.partitionBy("file", "sent_id").orderBy("line_no")).alias("pos"), cols[0].alias("form"), cols[1].alias("gold"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dictionary dump of one JSON object a line; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(form, lemma) of a JSON object used as a map."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("form", "lemma"))


def zipped_verticals(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, line_no, token): first column of the lines between <w ...> and </w> of the members of zip files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(BytesIO(c)) as z:
                    for name in sorted(z.namelist()):
                        inside, rows = False, []
                        for i, raw in enumerate(z.open(name)):
                            s = raw.decode("utf-8", "replace").rstrip("\r\n")
                            if s.startswith("<w"):
                                inside = True
                            elif s.startswith("</w"):
                                inside = False
                            elif inside and s and not s.startswith("<"):
                                rows.append((p, name, i, s.split("\t")[0]))
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "member", "line_no", "token"])

    return files.mapInArrow(unzip, "file string, member string, line_no long, token string")


def agdt_features(postag) -> dict:
    """Features of a nine-place tag as columns: class, person, number, tense, mood, voice, gender, case, degree; a dash is null."""
    names = ("pos", "person", "number", "tense", "mood", "voice", "gender", "case", "degree")
    return {n: F.nullif(F.nullif(F.substring(postag, i, 1), F.lit("-")), F.lit("")).alias(n) for i, n in enumerate(names, 1)}


def running_text(spark: SparkSession, path: str, least: float = 0.05) -> DataFrame:
    """(file, value, share, polytonic): whole text files with their share of polytonic letters; ``corpus.txt``, which repeats the others, is left out."""
    t = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    t = t.where(~F.col("file").rlike(r"(^|/)corpus\.txt$")).withColumn("share", polytonic_share(F.col("value")))
    return t.withColumn("polytonic", F.col("share") >= least)


def gold_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, pos, form, tag, gold): three-column gold sets; blank lines end sentences, empty forms and signs (tag u...) are left out."""
    rows = lines(spark, path)
    cols = F.split("value", "\t")
    rows = rows.withColumn("sent_id", F.sum((F.trim("value") == "").cast("int")).over(Window.partitionBy("file").orderBy("line_no")))
    kept = rows.where((F.size(cols) >= 3) & (F.trim(cols[0]) != "") & ~cols[1].startswith("u"))
    return kept.select("file", F.col("sent_id").cast("int").alias("sent_id"), F.row_number().over(Window.partitionBy("file", "sent_id").orderBy("line_no")).alias("pos"), cols[0].alias("form"), cols[1].alias("tag"), cols[2].alias("gold"))


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(tok, n): lists of a word and its count on each line, tabs or spaces between; other lines are left out."""
    v = F.trim("value")
    rx = r"^(\S+)\s+(\d+)$"
    return spark.read.text(path).where(v.rlike(rx)).select(F.regexp_extract(v, rx, 1).alias("tok"), F.regexp_extract(v, rx, 2).cast("long").alias("n"))


def ngram_counts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(w1..wn, n): packed counts of n-grams of word numbers, tab-separated, plain or gzipped; malformed lines are left out."""
    names = [f"w{k + 1}" for k in range(n)]
    schema = ", ".join([*(f"{c} int" for c in names), "n long"])
    return spark.read.schema(schema).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def papyri_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, orig, reg, lemma_orig, lemma_reg, postag): words of papyri as written and as regularised; signs, words without a Greek letter and such with brackets are left out."""
    schema = "_orig_form string, _form_reg string, _lemma_orig string, _lemma_reg string, _postag_reg string"
    w = spark.read.format("xml").option("rowTag", "word").option("mode", "DROPMALFORMED").schema(schema).load(path)
    named = w.select(F.col("_metadata.file_path").alias("file"), *[F.coalesce(f"_{a}", F.lit("")).alias(b) for a, b in (("orig_form", "orig"), ("form_reg", "reg"), ("lemma_orig", "lemma_orig"), ("lemma_reg", "lemma_reg"), ("postag_reg", "postag"))])
    return named.where(~F.col("postag").startswith("u") & any_greek(F.col("orig")) & ~lacuna(F.col("orig")))


def dictionary_xml(spark: SparkSession, path: str) -> DataFrame:
    """(headword, gender, text): entries of TEI dictionaries, well-formed or not as a whole: the word of ``orth`` and the text after it.

    Elements are found by pattern, so a file without a root, or with a broken entry, gives all others. The headword is the
    first word without signs, Latin letters, macrons and breves; the gender that of an article near the start.
    """
    t = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), 1)).alias("e"))
    orth = F.regexp_extract("e", r"(?s)<orth\b[^>]*>(.*?)</orth>", 1)
    word = strip_length(F.regexp_replace(F.regexp_extract(outer_trim(orth), r"^[^,\s]*", 0), r"^[\p{P}\p{Zs}]+|[\p{P}\p{Zs}]+$|[A-Za-z]", ""))
    after = F.regexp_replace(F.regexp_replace("e", r"(?s)^.*?</orth>", ""), r"<[^>]*>", "")
    article = F.regexp_extract(F.substring(after, 1, 60), r"(?:^|[,\s])(ὁ|ἡ|τό|τὸ|τά)(?:[,\s.]|$)", 1)
    gender = F.when(article == "ὁ", "m").when(article == "ἡ", "f").when(article != "", "n")
    return t.select(word.alias("headword"), gender.alias("gender"), outer_trim(after).alias("text")).where((F.length("headword") >= 2) & any_greek(F.col("headword")))


def larger(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two copies of a table the one with more rows, the first if they have equally many; counts both."""
    return b if b.count() > a.count() else a


# Names of features in the strings of a morphology, by axis, and the tags they stand for.
MORPHOLOGY = (
    {"masc": "masculine", "masc/neut": "masculine", "fem": "feminine", "neut": "neuter"},
    {"sg": "singular", "pl": "plural", "dual": "dual"},
    {"nom": "nominative", "gen": "genitive", "dat": "dative", "acc": "accusative", "voc": "vocative", "nom/voc/acc": "nominative", "nom/voc": "nominative", "nom/acc": "nominative", "gen/dat": "genitive"},
    {"pres": "present", "imperf": "imperfect", "aor": "aorist", "fut": "future", "perf": "perfect", "plup": "pluperfect"},
    {"ind": "indicative", "subj": "subjunctive", "opt": "optative", "imperat": "imperative", "inf": "infinitive", "part": "participle"},
    {"act": "active", "mid": "middle", "pass": "passive", "mp": "middle"},
    {"1st": "first-person", "2nd": "second-person", "3rd": "third-person"},
)


def morphology_tags(c: Column) -> Column:
    """Tags of a string such as ``pres subj act 1st sg (attic epic)``: the first of each axis, in the order of the axes; what is in brackets is left out.

    Null and empty strings have no tags.
    """
    parts = F.split(F.trim(F.lower(F.regexp_replace(c, r"(?s)\(.*", ""))), r"\s+")

    def first(axis: dict[str, str]) -> Column:
        named = F.create_map(*[x for k, v in axis.items() for x in (F.lit(k), F.lit(v))])
        return F.try_element_at(named, F.get(F.filter(parts, lambda p: p.isin(*axis)), F.lit(0)))

    return F.array_compact(F.array(*map(first, MORPHOLOGY)))

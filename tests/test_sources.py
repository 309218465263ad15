"""Readers and writers over small files, streams over a folder."""

import gzip
import zipfile

from pyspark.sql import functions as F

from logothek import streaming
from logothek.operators.frequency import suffix_signatures
from logothek.sources import readers as S
from logothek.sources import writers as W


def test_readers(spark, tmp_path):
    p = tmp_path / "a.conllu"
    p.write_text("# sent_id = 1\n1\tμῆνιν\tμῆνις\tNOUN\t_\tCase=Acc\t2\tobj\t_\t_\n1-2\tx\t_\t_\n2\tἄειδε\tἀείδω\tVERB\n\n# c\n1\tθεά\tθεά\tNOUN\n1.1\te\te\tX\nbad line\n")
    rows = S.conllu(spark, str(p)).orderBy("line_no").collect()
    assert [(r.sent_no, r.form, r.upos) for r in rows] == [(0, "μῆνιν", "NOUN"), (0, "ἄειδε", "VERB"), (1, "θεά", "NOUN")]
    p = tmp_path / "t.xml"
    p.write_text('<text><sentence id="s1"><word form="μῆνιν" lemma="μῆνις" postag="n-s---fa-"/><word form="." lemma="." postag="u--------"/></sentence></text>')
    rows = S.treebank_xml(spark, str(p)).select("form", *S.agdt_features(F.col("postag")).values()).collect()
    assert rows[0].form == "μῆνιν" and rows[0]["case"] == "a" and rows[0].tense is None and rows[1].pos == "u"
    p = tmp_path / "d.xml"
    p.write_text('<text><sentence id="1"><word form="mh=nin"><lemma entry="μῆνις" POS="noun"/></word></sentence></text>')
    assert S.diorisis_xml(spark, str(p)).first().asDict() == {"sent_id": "1", "pos": 0, "form": "μῆνιν", "lemma": "μῆνις", "tag": "noun"}
    p = tmp_path / "h.txt"
    p.write_text('<t id=1 word="το" tag="At" lemma="ο"><t word="α" tag="x" lemma="α"')
    assert [(r.pos, r.form, r.lemma) for r in S.tagged_words(spark, str(p)).collect()] == [(0, "το", "ο"), (1, "α", "α")]
    p = tmp_path / "g.tsv"
    p.write_text("a\tA\nb\tB\n\nc\tC\nshort\n")
    assert [(r.sent_id, r.pos, r.form, r.gold) for r in S.gold(spark, str(p)).orderBy("sent_id", "pos").collect()] == [(0, 1, "a", "A"), (0, 2, "b", "B"), (1, 1, "c", "C")]
    p = tmp_path / "m.json"
    p.write_text('{"a": "b", "c": "d"}')
    assert {(r.form, r.lemma) for r in S.json_map(spark, str(p)).collect()} == {("a", "b"), ("c", "d")}
    p = tmp_path / "l.jsonl"
    p.write_text('{"word": "a"}\nnot json\n{"word": "b"}\n')
    assert [r.word for r in S.json_lines(spark, str(p), "word string").collect()] == ["a", "b"]
    with zipfile.ZipFile(tmp_path / "v.zip", "w") as z:
        z.writestr("x.vert", "skip\n<w id=1>\nμῆνιν\tN\n</w>\nno\n<w>\nθεά\n</w>\n")
    assert [r.token for r in S.zipped_verticals(spark, str(tmp_path / "v.zip")).collect()] == ["μῆνιν", "θεά"]


def test_more_readers(spark, tmp_path):
    d = tmp_path / "texts"
    d.mkdir()
    for name, text in (("a.txt", "ἐν ἀρχῇ ἦν ὁ λόγος"), ("b.txt", "στην αρχή ήταν ο λόγος"), ("corpus.txt", "ἐν"), ("c.md", "ἐν")):
        (d / name).write_text(text)
    assert {r.file.rsplit("/", 1)[1]: r.polytonic for r in S.running_text(spark, str(d)).collect()} == {"a.txt": True, "b.txt": False}
    p = tmp_path / "g3.tsv"
    p.write_text("a\tn---\tA\n.\tu---\t.\nb\tv---\tB\n\n \tn\tx\nc\tn---\tC\nshort\tn\n")
    assert [(r.sent_id, r.pos, r.form, r.tag, r.gold) for r in S.gold_tagged(spark, str(p)).orderBy("sent_id", "pos").collect()] == [(0, 1, "a", "n---", "A"), (0, 2, "b", "v---", "B"), (1, 1, "c", "n---", "C")]
    p = tmp_path / "w.txt"
    p.write_text("και 12\nτο\t3\nbad\n")
    assert {(r.tok, r.n) for r in S.word_counts(spark, str(p)).collect()} == {("και", 12), ("το", 3)}
    with gzip.open(tmp_path / "bi.tsv.gz", "wt") as f:
        f.write("4\t5\t9\nx\t1\t2\n4\t6\t1\n")
    assert sorted(map(tuple, S.ngram_counts(spark, str(tmp_path / "bi.tsv.gz"), 2).collect())) == [(4, 5, 9), (4, 6, 1)]
    p = tmp_path / "pap.xml"
    p.write_text('<t><word orig_form="ἔγραψα" form_reg="ἔγραψα" lemma_reg="γράφω" postag_reg="v1saia---"/><word orig_form="ἔγ[ρ]" postag_reg="v"/><word orig_form="." postag_reg="u"/><word orig_form="abc"/></t>')
    assert [(r.orig, r.lemma_reg, r.lemma_orig) for r in S.papyri_xml(spark, str(p)).collect()] == [("ἔγραψα", "γράφω", "")]
    p = tmp_path / "dict.xml"
    p.write_text('<entry><orth>ἀββᾶς, ᾶ</orth>, ὁ, <b>father</b></entry><entry><orth>x</orth> no</entry><entry><orth>-ῡλη.</orth>, ἡ book</entry><entry><broken')
    assert [(r.headword, r.gender, r.text) for r in S.dictionary_xml(spark, str(p)).collect()] == [("ἀββᾶς", "m", ", ὁ, father"), ("υλη", "f", ", ἡ book")]
    a, b = spark.range(3), spark.range(5)
    assert S.larger(a, b) is b and S.larger(a, a.limit(3)) is a


def test_morphology_strings(spark):
    df = spark.createDataFrame([("masc acc pl",), ("pres subj act 1st sg (attic fem epic)",), ("indeclform (particle)",), ("nom/voc/acc neut dual",), ("",), (None,)], "m string")
    got = [r[0] for r in df.select(S.morphology_tags(F.col("m"))).collect()]
    assert got == [["masculine", "plural", "accusative"], ["singular", "present", "subjunctive", "active", "first-person"], [], ["neuter", "dual", "nominative"], [], []]


def test_more_writers(spark, tmp_path):
    rows = spark.createDataFrame([("λύω", "", "active_present_infinitive", "λύειν"), ("λύω", "", "active_aorist_indicative_1sg", "ἔλυσα"), ("λύω", "epic", "active_aorist_indicative_3sg", "λῦσε")], "lemma string, dialect string, key string, form string")
    W.paradigms(rows, str(tmp_path / "p"))
    got = {(r.lemma, r.dialect): r.cells for r in spark.read.schema("lemma string, dialect string, cells map<string,string>").json(str(tmp_path / "p")).collect()}
    assert got["λύω", ""] == {"active_present_infinitive": "λύειν", "active_aorist_indicative_1sg": "ἔλυσα"} and len(got) == 2
    s = spark.createDataFrame([("a", "1", "<s> x </s>", 3, True), ("a", "2", "<s> y </s>", 3, False), ("b", "b:1", "<s> y </s>", 3, False)], "corpus string, sent_id string, framed string, n long, dev boolean")
    W.corpora(s, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c/sentences")).where("corpus = 'a' AND part = 'dev'").count() == 1
    assert {(r.corpus, r.part, r.n_sentences) for r in spark.read.json(str(tmp_path / "c/stats")).collect()} == {("a", "dev", 1), ("a", "train", 1), ("b", "train", 1)}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("λόγος", "λόγος", "grc"), ("λόγου", "λόγος", "grc"), ("το", "ο", "el")], "form string, lemma string, lang string")
    W.lexicon_table(rows, "lexicon_test", 4)
    assert spark.table("lexicon_test").where("lang = 'grc'").count() == 2
    spark.sql("DROP TABLE lexicon_test")
    W.sorted_tsv(rows, str(tmp_path / "tsv"), "form")
    text = "".join(gzip.open(f, "rt").read() for f in sorted((tmp_path / "tsv").glob("*.gz")))
    assert text.splitlines()[0].startswith("λόγος\t")
    forms = spark.createDataFrame([("a", "ab1"), ("a", "ab2"), ("b", "cd1"), ("b", "cd2"), ("e", "x")], "lemma string, form string")
    W.spelling_dictionary(suffix_signatures(forms), str(tmp_path / "sp"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sp/dic")).collect()] == ["ab/1000", "cd/1000", "e"]
    assert [r.value for r in spark.read.text(str(tmp_path / "sp/aff")).collect()] == ["SFX 1000 0 1 .", "SFX 1000 0 2 ."]
    W.parquet(rows, str(tmp_path / "pq"), "lang")
    W.json_rows(rows, str(tmp_path / "js"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == spark.read.json(str(tmp_path / "js")).count() == 3


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("το το Τό", "2024-01-01 00:10:00"), (None, "2024-01-01 00:20:00"), ("λόγος", "2024-01-01 09:00:00")], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert {r.key: r.n for r in run(streaming.token_counts(read()), "counts", "complete")} == {"το": 3, "λογοσ": 1}
    assert {(r.key, r.n) for r in run(streaming.windowed_counts(read(), "ts"), "windows", "update")} >= {("το", 3), ("λογοσ", 1)}
    lex = spark.createDataFrame([("το", "ο"), ("λόγος", "λόγος")], "form string, lemma string")
    got = run(streaming.looked_up(read().select(F.col("text").alias("word")), lex), "words", "append")
    assert {(r.word, r.lemma) for r in got} == {("το το Τό", None), (None, None), ("λόγος", "λόγος")}

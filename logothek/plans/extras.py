"""Smaller steps of the lexicon build and the corpus readers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.functions.tables import ARTICLES
from logothek.operators import frequency as Q
from logothek.operators import lexicon as L
from logothek.operators.order import ranked, running_sum
from logothek.plans import lexicon as PL
from logothek.plans import resolving as PR
from logothek.plans.registry import query
from logothek.plans.training import PARSED_SQL, p3_rows
from logothek.session import table
from logothek.sources.readers import agdt_features

def key_fan_out(rows: DataFrame) -> DataFrame:
    """(key, lemma): every key a form is to be found under (as is, lower, monotonic, stripped), of the lemma of best rank.

    rows: (form, lemma, rank). A derived key ranks after all forms that are written so.
    """
    c = F.col("form")
    low = F.lower(c)
    keys = F.array_distinct(F.array(c, low, T.monotonic(low), T.strip_accents(low)))
    x = rows.select("lemma", "rank", F.posexplode(keys).alias("o", "key"))
    return x.groupBy("key").agg(F.min(F.struct((F.col("o") > 0).alias("a"), "rank", "lemma")).alias("m")).select("key", F.col("m.lemma").alias("lemma"))


_FAN = f"[form, {PL.LOWER.format('form')}, {PR.MONO.replace('{0}', PL.LOWER).format('form')}, {PL.BARE.format('form')}]"


@query("key_fan_out", f"""WITH f AS (SELECT lemma, pair_id AS rank, {_FAN} AS ks FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0),
k AS (SELECT lemma, rank, unnest(ks) AS key, generate_subscripts(ks, 1) > 1 AS a FROM f) SELECT key, first(lemma ORDER BY a, rank, lemma) AS lemma FROM k GROUP BY key""")
def key_fan_out_query(spark: SparkSession, d: str) -> DataFrame:
    return key_fan_out(PL.pairs(spark, d).select("form", "lemma", F.col("pair_id").alias("rank")))


@query("optional_endings", "SELECT DISTINCT unnest(CASE WHEN regexp_full_match(f, '.+\\(.+\\)') THEN [regexp_extract(f, '^(.+)\\(', 1), regexp_extract(f, '^(.+)\\(', 1) || regexp_extract(f, '\\((.+)\\)$', 1)] ELSE [f] END) AS form FROM (SELECT text || '(ν)' AS f FROM lemmas WHERE length(text) > 0 UNION ALL SELECT text FROM lemmas WHERE length(text) > 0)")
def optional_endings(spark: SparkSession, d: str) -> DataFrame:
    """Forms with an ending in brackets as two forms each; here headwords with a bracketed nu, and without."""
    t = table(spark, d, "lemmas").where(F.length("text") > 0).select(F.explode(F.array(F.concat("text", F.lit("(ν)")), F.col("text"))).alias("f"))
    base, end = F.regexp_extract("f", r"^(.+)\(", 1), F.regexp_extract("f", r"\((.+)\)$", 1)
    return t.select(F.explode(F.when(F.col("f").rlike(r"^.+\(.+\)$"), F.array(base, F.concat(base, end))).otherwise(F.array("f"))).alias("form")).distinct()


def year_of(c: Column) -> Column:
    """The first number of three or four digits of a text as a year, before the common era if the text says so; null if there is none."""
    y = F.nullif(F.regexp_extract(c, r"([0-9]{3,4})", 1), F.lit("")).cast("int")
    return F.when(c.rlike(r"(?i)b\.?c|π\.?χ"), -y).otherwise(y)


def period_of(year: Column) -> Column:
    return F.when(year < -300, "archaic").when(year < 1, "hellenistic").when(year < 600, "late_antique").when(year < 1500, "byzantine").when(year.isNotNull(), "modern")


@query("year_periods", """WITH y AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)b\\.?c|π\\.?χ') THEN -nullif(regexp_extract(text, '([0-9]{3,4})', 1), '')::INT ELSE nullif(regexp_extract(text, '([0-9]{3,4})', 1), '')::INT END AS year FROM documents WHERE text IS NOT NULL)
SELECT doc_id, year, CASE WHEN year < -300 THEN 'archaic' WHEN year < 1 THEN 'hellenistic' WHEN year < 600 THEN 'late_antique' WHEN year < 1500 THEN 'byzantine' WHEN year IS NOT NULL THEN 'modern' END AS period FROM y""")
def year_periods(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", year_of(F.col("text")).alias("year"))
    return y.withColumn("period", period_of(F.col("year")))


@query("tag_features", PARSED_SQL + "SELECT line_id, " + ", ".join(f"nullif(pos[{i}], '-') AS \"{n}\"" for i, n in enumerate(("pos", "person", "number", "tense", "mood", "voice", "gender", "case", "degree"), 1)) + " FROM judged WHERE quotes_ok AND len(f) = 3 AND valid")
def tag_features(spark: SparkSession, d: str) -> DataFrame:
    return p3_rows(spark, d).select("line_id", *agdt_features(F.col("pos")).values())




@query("without_article_maps", f"WITH {PL.LEX} SELECT row_id FROM lex WHERE NOT (strip_accents(lower(form)) IN (SELECT strip_accents(a) FROM (VALUES {', '.join(f'({PR.q(a)})' for a in ARTICLES)}) AS t(a)) AND strip_accents(lower(lemma)) = 'ο' AND lemma <> strip_accents(lemma))")
def without_article_maps(spark: SparkSession, d: str) -> DataFrame:
    """Entries but for articles led to the polytonic article."""
    bare = sorted({T._strip(a) for a in ARTICLES})
    f, m = T.strip_accents(F.lower("form")), F.col("lemma")
    return PL.lex(spark, d).where(~(f.isin(*bare) & (T.strip_accents(F.lower(m)) == "ο") & (m != T.strip_accents(m)))).select("row_id")


@query("language_of_form", f"""WITH {PL.TABLES}, {PR.WORDS}, k AS (SELECT word, unnest({PR.KEYS.format('word')}) AS x FROM w), s AS (SELECT form, 'el' AS src, 0 AS t FROM el UNION ALL SELECT form, 'grc', 1 FROM ag)
SELECT w.word, coalesce(h.src, '') AS lang FROM w LEFT JOIN (SELECT word, first(src ORDER BY k.x.v, t) AS src FROM k JOIN s ON s.form = k.x.key GROUP BY word) h USING (word)""")
def language_of_form(spark: SparkSession, d: str) -> DataFrame:
    """The table that has a word under its first key: the modern one before the ancient."""
    ag, el, _ = PL.two(spark, d)
    s = el.select("form", F.lit(0).alias("t"), F.lit("el").alias("src")).unionByName(ag.select("form", F.lit(1).alias("t"), F.lit("grc").alias("src")))
    w = PR.words(spark, d)
    k = PR.R.keyed(w, "word", ["word"])
    hit = k.join(s, "form").groupBy("word").agg(F.min(F.struct("v", "t", "src")).alias("m"))
    return w.join(hit, "word", "left").select("word", F.coalesce("m.src", F.lit("")).alias("lang"))


_COPIES = "1 + CASE WHEN pos = 'verb' THEN " + " + ".join(f"coalesce(list_has_any(tags, [{', '.join(repr(t) for t in g)}]), FALSE)::INT * {k}" for g, k in ((["aorist"], 2), (["perfect", "future-perfect"], 2), (["pluperfect"], 4), (["future"], 2), (["imperfect"], 1))) + " ELSE 0 END"


@query("oversampled_pairs", f"SELECT pair_id, unnest(range(1, {_COPIES} + 1)) AS copy_no FROM lemmapairdataset WHERE split = 'train' AND length(form) > 0 AND length(lemma) > 0")
def oversampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Training pairs with verbs of rare tenses repeated."""
    n = Q.copies_by_tense(F.col("pos"), F.col("tags"))
    return PL.pairs(spark, d).where("split = 'train'").select("pair_id", F.explode(F.sequence(F.lit(1), n)).alias("copy_no")).withColumn("copy_no", F.col("copy_no").cast("long"))


_POOL = "CASE source WHEN 'med' THEN 'variety' WHEN 'mg' THEN 'modern' ELSE 'ancient' END"
_BUDGET = 1000


@query("training_mix", f"""WITH p AS (SELECT *, {_POOL} AS pool, CASE source WHEN 'med' THEN 0 WHEN 'mg' THEN 1 ELSE 2 END AS o FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 AND split = 'train'),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY form, lemma ORDER BY o, pair_id) = 1), r AS (SELECT pair_id, pool, unnest(range(1, CASE WHEN pool = 'ancient' THEN {_COPIES} ELSE 1 END + 1)) AS copy_no FROM f),
n AS (SELECT count(*) AS whole, {_BUDGET} - count(*) FILTER (pool = 'variety') AS rest FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(pair_id || ':' || copy_no), pair_id || ':' || copy_no) AS i FROM r)
SELECT pair_id, copy_no, pool FROM k, n WHERE whole <= {_BUDGET} OR pool = 'variety' OR i <= greatest(rest, 0) // 2 + CASE pool WHEN 'modern' THEN greatest(rest, 0) % 2 ELSE 0 END""")
def training_mix(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of 1000 training pairs: all medieval ones, the rest in halves of ancient and modern ones, by hash."""
    pool = F.when(F.col("source") == "med", "variety").when(F.col("source") == "mg", "modern").otherwise("ancient")
    m = Q.training_mix(PL.pairs(spark, d).where("split = 'train'").withColumn("pool", pool), _BUDGET)
    return m.select("pair_id", F.col("copy_no").cast("long").alias("copy_no"), "pool")


@query("line_sentences", "WITH b AS (SELECT line_id, file_name, raw IS NULL OR regexp_full_match(raw, '[\\s\\x{FEFF}]*') AS brk FROM lingann_gs_medievalgreek) SELECT line_id, file_name, sum(brk::INT) OVER (PARTITION BY file_name ORDER BY line_id)::BIGINT AS sent_id FROM b QUALIFY NOT brk")
def line_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence of each record: the breaks before it in its file."""
    brk = F.col("raw").isNull() | F.col("raw").rlike(r"^[\s\x{FEFF}]*$")
    b = table(spark, d, "lingann_gs_medievalgreek").select("line_id", "file_name", brk.cast("long").alias("brk"))
    return running_sum(b, "file_name", ["line_id"], "brk", "sent_id").where("brk = 0").select("line_id", "file_name", "sent_id")


@query("previous_forms", PARSED_SQL + "SELECT line_id, form, lag(form) OVER (PARTITION BY file_name ORDER BY line_id) AS before FROM judged JOIN (SELECT line_id, file_name FROM lingann_gs_medievalgreek) USING (line_id) WHERE quotes_ok AND len(f) = 3 AND valid")
def previous_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each form with the one before it in its file, by a join on the place in the file."""
    rows = p3_rows(spark, d).join(table(spark, d, "lingann_gs_medievalgreek").select("line_id", "file_name"), "line_id")
    placed = ranked(rows.select("file_name", "line_id", "form"), "file_name", ["line_id"])
    before = placed.select("file_name", (F.col("rank") + 1).alias("rank"), F.col("form").alias("before"))
    return placed.join(before, ["file_name", "rank"], "left").select("line_id", "form", "before")


@query("register_filter", """WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '[\\x{1F00}-\\x{1FFF}]'))) AS n_polytonic, (len(w) >= 20 AND len(list_filter(w, lambda x: regexp_matches(x, '[\\x{1F00}-\\x{1FFF}]'))) >= 0.4 * len(w)) AS passes FROM t""")
def register_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts of 20 Greek words or more, two fifths of them polytonic."""
    w = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(f"[{T.GREEK_RANGES}]+"), 0).alias("w"))
    n, p = F.size("w"), F.size(F.filter("w", lambda x: x.rlike(r"[\x{1F00}-\x{1FFF}]")))
    return w.select("doc_id", n.cast("long").alias("n_words"), p.cast("long").alias("n_polytonic"), ((n >= 20) & (p >= 0.4 * n)).alias("passes"))


@query("headword_plurals", f"WITH {PL.TABLES} SELECT DISTINCT p.form FROM lemmapairdataset p SEMI JOIN ag ON ag.form = p.form ANTI JOIN heads ON heads.form = p.form WHERE list_contains(tags, 'plural')")
def headword_plurals(spark: SparkSession, d: str) -> DataFrame:
    """Plurals that the ancient table attests and that are no headwords themselves."""
    ag, _, heads = PL.two(spark, d)
    p = table(spark, d, "lemmapairdataset").where(F.array_contains("tags", "plural")).select("form").distinct()
    return p.join(ag, "form", "left_semi").join(heads, "form", "left_anti")


@query("three_way_merge", f"""WITH {PL.LEX}, s AS (SELECT CASE WHEN src IN ('grc', 'treebank', 'grc_corpus') THEN 0 WHEN src = 'med' THEN 1 WHEN src IN ('el', 'el_corpus') THEN 2 END AS o, form, lemma, row_id FROM lex),
t AS (SELECT o, form, first(lemma ORDER BY row_id) AS lemma FROM s WHERE o IS NOT NULL GROUP BY o, form)
SELECT form, first(lemma ORDER BY {PL.SELF.format('lemma')}, o) AS lemma FROM t GROUP BY form""")
def three_way_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three tables in order; the first lemma that is no self-map wins, else the first."""
    o = F.when(F.col("src").isin("grc", "treebank", "grc_corpus"), 0).when(F.col("src") == "med", 1).when(F.col("src").isin("el", "el_corpus"), 2)
    t = L.first_by(PL.lex(spark, d).withColumn("o", o).where("o IS NOT NULL"), ["o", "form"], [F.col("row_id")], ["lemma"])
    return t.groupBy("form").agg(F.min(F.struct(L.self_map(F.col("form"), F.col("lemma")).alias("a"), "o", "lemma")).alias("m")).select("form", F.col("m.lemma").alias("lemma"))


@query("polytonic_variant", f"""WITH {PL.LEX}, p AS (SELECT row_id, form, lemma, regexp_matches(form, '[{PR.R.POLYTONIC}]') AS poly FROM lex WHERE src IN ('grc', 'treebank', 'grc_corpus')), l AS (SELECT lemma FROM p GROUP BY lemma HAVING bool_or(poly))
SELECT row_id FROM p SEMI JOIN l USING (lemma) WHERE strip_accents(form) <> form AND strip_accents(lemma) <> lemma""")
def polytonic_variant(spark: SparkSession, d: str) -> DataFrame:
    """Entries for a polytonic dictionary: form and lemma bear marks, and the lemma has a polytonic form; by semi-join."""
    p = PL.lex(spark, d).where(F.col("src").isin("grc", "treebank", "grc_corpus")).withColumn("poly", F.col("form").rlike(f"[{PR.R.POLYTONIC}]"))
    good = p.where("poly").select("lemma").distinct()
    return p.join(good, "lemma", "left_semi").where((T.strip_accents(F.col("form")) != F.col("form")) & (T.strip_accents(F.col("lemma")) != F.col("lemma"))).select("row_id")


@query("monotonic_variant", f"WITH {PL.LEX} SELECT row_id FROM lex WHERE src IN ('el', 'el_corpus', 'med') AND NOT regexp_matches(form, '[{PR.R.POLYTONIC}]')")
def monotonic_variant(spark: SparkSession, d: str) -> DataFrame:
    return PL.lex(spark, d).where(F.col("src").isin("el", "el_corpus", "med") & ~F.col("form").rlike(f"[{PR.R.POLYTONIC}]")).select("row_id")


@query("corrupt_headwords", "SELECT id, length(text) > 0 AND regexp_matches(text, '\\p{L}\\p{M}*\\p{Lu}') AND regexp_matches(text, '\\p{Ll}') AS internal_capital, length(text) > 0 AND regexp_matches(text, '[0-9\\[\\]?*]') AS odd_sign FROM lemmas WHERE text IS NOT NULL")
def corrupt_headwords(spark: SparkSession, d: str) -> DataFrame:
    """Whether a headword has a capital within, or a digit, bracket or editor's sign."""
    t = F.col("text")
    n = F.length(t) > 0
    return table(spark, d, "lemmas").where(t.isNotNull()).select("id", (n & t.rlike(r"\p{L}\p{M}*\p{Lu}") & t.rlike(r"\p{Ll}")).alias("internal_capital"), (n & t.rlike(r"[0-9\[\]?*]")).alias("odd_sign"))


@query("past_without_augment", """SELECT pair_id FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 AND list_has_all(tags, ['indicative']) AND (list_contains(tags, 'aorist') OR list_contains(tags, 'imperfect')) AND NOT regexp_matches(strip_accents(form), '^[εηωΕΗΩ]|^[αιυοΑΙΥΟ][ιυ]?[ηω]') AND NOT regexp_matches(strip_accents(lemma), '^[ηωΗΩ]')""")
def past_without_augment(spark: SparkSession, d: str) -> DataFrame:
    """Past indicatives that begin with no augmented vowel, of lemmas that don't begin with a long one: epic forms."""
    p = PL.pairs(spark, d).where(F.array_contains("tags", "indicative") & (F.array_contains("tags", "aorist") | F.array_contains("tags", "imperfect")))
    f, m = T.strip_accents(F.col("form")), T.strip_accents(F.col("lemma"))
    return p.where(~f.rlike("^[εηωΕΗΩ]|^[αιυοΑΙΥΟ][ιυ]?[ηω]") & ~m.rlike("^[ηωΗΩ]")).select("pair_id")

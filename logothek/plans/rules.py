"""Rules of the corpus readers and of the lexicon build over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import entries as E
from logothek.functions import text as T
from logothek.functions import udfs as U
from logothek.functions.tables import ARTICLES
from logothek.operators import frequency as Q
from logothek.operators import lexicon as L
from logothek.operators import morphology as Y
from logothek.operators import resolve as R
from logothek.operators.order import running_sum
from logothek.plans import corpus as PC
from logothek.plans import lexicon as PL
from logothek.plans import resolving as PR
from logothek.plans import searching as PS
from logothek.plans.registry import query
from logothek.plans.training import PARSED_SQL, p3_rows
from logothek.session import checkpointed, spread, table
from logothek.sources.readers import MORPHOLOGY, morphology_tags

PAIRS = "SELECT * FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0"
LATIN = "len(regexp_extract_all({0}, '[A-Za-z]'))"
GREEK = "len(regexp_extract_all({0}, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]'))"
POLY = f"[{T.POLYTONIC}]"


# --- sentences and corpora -------------------------------------------------------------------------------------------

_META = f"({LATIN.format('x')} > {GREEK.format('x')} AND {LATIN.format('x')} > 3)"
_WORD = T.GREEK_WORD.replace("'", "''")
_RUNNING = f"""rs AS (SELECT doc_id, list_filter(list_transform(string_split_regex(list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT {_META}), 'string_agg', ' '), '[.;·!?]'), lambda x:
  list_transform(regexp_extract_all(x, '{_WORD}'), lambda w: translate(w[1], '{T.LATIN_CAPITALS}', '{T.GREEK_CAPITALS}') || w[2:])), lambda x: len(x) > 0) AS ss FROM documents WHERE text IS NOT NULL),
rx AS (SELECT doc_id, unnest(ss) AS toks, generate_subscripts(ss, 1) - 1 AS s_no FROM rs)"""


def running(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(T.running_sentences(F.col("text"))).alias("s_no", "toks"))


@query("running_sentences", f"WITH {_RUNNING} SELECT doc_id, s_no, list_aggregate(toks, 'string_agg', ' ') AS words, regexp_matches(list_aggregate(toks, 'string_agg', ' '), '{POLY}') AS polytonic FROM rx")
def running_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Greek sentences of the documents without lines of editors, with Latin initials mended, and whether any word is polytonic."""
    words = F.array_join("toks", " ")
    return running(spark, d).select("doc_id", F.col("s_no").cast("long").alias("s_no"), words.alias("words"), T.has_polytonic(words).alias("polytonic"))


@query("paragraph_sentences", r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\n{2,}|[.;·!?]'), lambda x: regexp_replace(x, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')), lambda x: length(x) > 0)) AS n_sentences FROM documents WHERE text IS NOT NULL")
def paragraph_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    return docs.select("doc_id", F.size(T.paragraph_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("register_filter_years", f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]+') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM t WHERE NOT contains(text, 'π.Χ') AND regexp_matches(text, '\\b(?:18[0-9][0-9]|19[0-9][0-9]|20[0-9][0-9])\\b') AND len(w) >= 20 AND len(list_filter(w, lambda x: regexp_matches(x, '[\\x{{1F00}}-\\x{{1FFF}}]'))) >= {{share}} * len(w)""".replace("{share}", "0.0"))
def register_filter_years(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a modern year that don't count back, and 20 Greek words or more; the share of polytonic words is 0 here, as the documents have few."""
    return T.of_register(table(spark, d, "documents").where("text IS NOT NULL"), "text", "text", least_share=0.0).select("doc_id")


_ENDERS = (".", ";", "·", "!", "?")
_MEDIEVAL = PARSED_SQL + f"""
, brk AS (SELECT line_id, file_name, sum((raw IS NULL OR regexp_full_match(raw, '[\\s\\x{{FEFF}}]*'))::INT) OVER (PARTITION BY file_name ORDER BY line_id)::BIGINT AS sent FROM lingann_gs_medievalgreek),
mt AS (SELECT b.file_name, b.sent, j.line_id, j.form, j.pos FROM judged j JOIN brk b USING (line_id) WHERE quotes_ok AND len(f) = 3 AND valid),
mk AS (SELECT file_name, sent, line_id, CASE WHEN pos[1] = 'u' THEN '</s>' ELSE form END AS tok FROM mt WHERE CASE WHEN pos[1] = 'u' THEN trim(form) IN ({', '.join(f"'{x}'" for x in _ENDERS)}) ELSE regexp_matches(form, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]') END),
ms AS (SELECT file_name, sent, list(tok ORDER BY line_id) AS toks FROM mk GROUP BY ALL)"""


@query("corpus_sentences", _MEDIEVAL + f""", {_RUNNING}, every AS (SELECT 'documents' AS corpus, doc_id::VARCHAR || ':' || s_no AS sent_id, list_concat(['<s>'], list_concat(toks, ['</s>'])) AS toks FROM rx
  UNION ALL SELECT 'medieval', 'medieval:' || file_name || ':' || sent, list_concat(['<s>'], CASE WHEN list_contains(toks, '</s>') THEN toks ELSE list_concat(toks, ['</s>']) END) FROM ms)
SELECT corpus, sent_id, list_aggregate(toks, 'string_agg', ' ') AS framed, len(toks) AS n FROM every WHERE len(toks) >= 3""")
def corpus_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All corpora as framed sentences of one shape; ids are those of the first corpus, or begin with the name of the other.

    Signs that end a sentence within one are </s> too, and none is added if one was there; other signs and words without a
    Greek letter go.
    """
    brk = F.col("raw").isNull() | F.col("raw").rlike(r"^[\s\x{FEFF}]*$")
    b = table(spark, d, "lingann_gs_medievalgreek").select("line_id", "file_name", brk.cast("long").alias("brk"))
    sent = running_sum(b, "file_name", ["line_id"], "brk", "sent").select("line_id", "file_name", "sent")
    sign = T.skipped_tag(F.col("pos"))
    t = p3_rows(spark, d).join(sent, "line_id").where(F.when(sign, F.trim("form").isin(*_ENDERS)).otherwise(T.any_greek(F.col("form"))))
    t = t.select("file_name", "sent", F.struct("line_id", F.when(sign, "</s>").otherwise(F.col("form")).alias("tok")).alias("x"))
    med = t.groupBy("file_name", "sent").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["tok"]).alias("toks"))  # one sentence a row
    ended = F.when(F.array_contains("toks", "</s>"), F.col("toks")).otherwise(F.concat("toks", F.array(F.lit("</s>"))))
    own = running(spark, d).select(F.lit("documents").alias("corpus"), F.concat_ws(":", "doc_id", "s_no").alias("sent_id"), F.concat("toks", F.array(F.lit("</s>"))).alias("toks"))
    every = own.unionByName(med.select(F.lit("medieval").alias("corpus"), F.concat_ws(":", F.lit("medieval"), "file_name", "sent").alias("sent_id"), ended.alias("toks")))
    f = F.concat(F.array(F.lit("<s>")), "toks")
    return every.select("corpus", "sent_id", F.array_join(f, " ").alias("framed"), F.size(f).cast("long").alias("n")).where("n >= 3")


@query("kept_tokens", PARSED_SQL + "SELECT line_id FROM judged WHERE quotes_ok AND len(f) = 3 AND valid AND pos[1] <> 'u'")
def kept_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that are words by their tag."""
    return p3_rows(spark, d).where(~T.skipped_tag(F.col("pos"))).select("line_id")


# --- forms -----------------------------------------------------------------------------------------------------------

_LETTER = "regexp_extract(form, '^[^\\pL]*\\pL')"


@query("form_marks", f"""SELECT DISTINCT form, regexp_matches(form, '[{T.BREATHINGS}̓̔]') AS breathing, regexp_matches(form, '[{T.ACUTES}{T.GRAVES}{T.CIRCUMFLEXES}́̀͂]') AS accent, regexp_matches(form, '{POLY}') AS polytonic,
  regexp_replace(form, '[’᾽ʼ''ʹ]$', '᾽') AS elision, {PL.LOWER.format(_LETTER)} || form[length({_LETTER}) + 1:] AS lower_initial, nullif(regexp_extract({PL.BARE.format('form')}, '[αεηιουω]$'), '') AS last_vowel,
  contains(regexp_replace(form, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), ' ') AS multi_word, regexp_matches(form, '[\\[\\]?]') AS lacuna FROM lookup WHERE length(form) > 0""")
def form_marks(spark: SparkSession, d: str) -> DataFrame:
    """What marks each form of the lexicon has, and its spellings for dictionaries."""
    c = F.col("form")
    f = table(spark, d, "lookup").where(F.length("form") > 0).select("form").distinct()
    return f.select("form", T.has_breathing(c).alias("breathing"), T.has_accent(c).alias("accent"), T.has_polytonic(c).alias("polytonic"), T.canonical_elision(c).alias("elision"), T.lower_initial(c).alias("lower_initial"), T.last_vowel(c).alias("last_vowel"), T.multi_word(c).alias("multi_word"), T.lacuna(c).alias("lacuna"))


@query("extracted_pairs", f"""WITH p AS ({PAIRS}), ok AS (SELECT DISTINCT form FROM lookup)
SELECT pair_id FROM p WHERE NOT coalesce(pos = 'name' AND list_contains(tags, 'plural') AND form NOT IN (SELECT form FROM ok WHERE form IS NOT NULL), FALSE)
  AND (form = lemma OR NOT list_has_any([form, {PL.LOWER.format('form')}, {PR.MONO.format('form')}, {PL.LOWER.replace('{0}', PR.MONO).format('form')}, {PL.BARE.format('form')}], [{PR.q(*ARTICLES)}]))""")
def extracted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs but for plurals of names that the lexicon lacks, and for articles that stand among other words' forms."""
    kept = L.name_plurals_kept(PL.pairs(spark, d), table(spark, d, "lookup").where("form IS NOT NULL"))
    return L.without_leaked_articles(kept, ARTICLES).select("pair_id")


@query("polytonic_variants", f"WITH c AS (SELECT form, count(*) AS n FROM (SELECT form FROM lookup UNION ALL SELECT form FROM lemmapairdataset) WHERE length(form) > 0 GROUP BY form HAVING count(*) >= 3) SELECT {PR.MONO.format('form')} AS mono, form, n, row_number() OVER (PARTITION BY {PR.MONO.format('form')} ORDER BY n DESC, form) AS rank FROM c")
def polytonic_variants(spark: SparkSession, d: str) -> DataFrame:
    """The spellings of each monotonic form that occur three times or more in the lexicon and the pairs, most frequent first."""
    forms = table(spark, d, "lookup").select("form").unionByName(table(spark, d, "lemmapairdataset").select("form")).where(F.length("form") > 0)
    return Q.spelling_variants(Q.counts(forms, "form")).select("mono", "form", "n", "rank")


_FREQ = f"fq AS (SELECT form AS tok, count(*) AS n FROM ({PAIRS}) GROUP BY form)"
_COUNT = "coalesce((SELECT n FROM fq WHERE tok = {0}), (SELECT n FROM fq WHERE tok = {1}), (SELECT n FROM fq WHERE tok = {2}), 0)"


def _counted(source: str, column: str) -> str:
    """SQL of a relation with the count of a column, as it is, in lower case or by key."""
    return f"SELECT s.*, coalesce(a.n, b.n, c.n, 0) AS n FROM {source} s LEFT JOIN fq a ON a.tok = s.{column} LEFT JOIN fq b ON b.tok = {PL.LOWER.format('s.' + column)} LEFT JOIN fq c ON c.tok = {PL.STRIP.format('s.' + column)}"


def _pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(PL.pairs(spark, d).select(F.col("form").alias("tok")), "tok")


@query("form_counts", f"WITH {PL.LEX}, {_FREQ}, u AS (SELECT DISTINCT form FROM lex) {_counted('u', 'form')}")
def form_counts(spark: SparkSession, d: str) -> DataFrame:
    """The forms of the lexicon with their counts among the pairs, as they are, in lower case or by key."""
    return Q.with_counts(PL.lex(spark, d).select("form").distinct(), _pair_counts(spark, d))


@query("attested_lexicon", f"""WITH {PL.LEX}, {_FREQ}, u AS (SELECT DISTINCT form, lemma FROM lex), fo AS ({_counted('u', 'form')}), ul AS (SELECT DISTINCT lemma FROM lex), le AS ({_counted('ul', 'lemma')}),
kl AS (SELECT lemma FROM (SELECT lemma, n FROM fo UNION ALL SELECT lemma, n FROM le) GROUP BY lemma HAVING max(n) >= 2)
SELECT form, lemma FROM fo SEMI JOIN kl USING (lemma) WHERE regexp_matches(form, '{POLY}') OR n >= 1""")
def attested_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Forms of the lemmas that occur twice or more in any form; those without polytonic marks must occur themselves."""
    return Q.attested_forms(PL.lex(spark, d).select("form", "lemma"), _pair_counts(spark, d), 2, 1)


@query("stem_buckets", f"""WITH {PL.LEX}, {_FREQ}, u AS (SELECT DISTINCT form, lemma FROM lex), fo AS ({_counted('u', 'form')}), lo AS (SELECT lemma, min(form) AS lo, max(form) AS hi, max(n) AS n FROM fo GROUP BY lemma)
SELECT lemma, lo[1:coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(length(lo), length(hi)))] AS stem, CASE WHEN n >= 100 THEN 'C' WHEN n >= 10 THEN 'M' WHEN n >= 1 THEN 'R' ELSE 'X' END AS bucket FROM lo""")
def stem_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The stem of each lemma's forms with the best bucket of any of them; buckets rise with the count, so it is that of the greatest."""
    counted = Q.with_counts(PL.lex(spark, d).select("form", "lemma").distinct(), _pair_counts(spark, d))
    g = counted.groupBy("lemma").agg(*Q.common_prefix(F.col("form")), F.max("n").alias("n"))
    return g.select("lemma", Q.prefix_of().alias("stem"), Q.bucket(F.col("n")).alias("bucket"))


@query("holdout_lexicon", f"""WITH {PL.TABLES}, p AS ({PAIRS}), hd AS (SELECT form FROM heads UNION SELECT form FROM ag WHERE form = lemma), kn AS (SELECT form FROM hd UNION SELECT form FROM ag),
o AS (SELECT * FROM p WHERE source IS NULL OR source <> 'treebank'), nw AS (SELECT form, lemma, pair_id AS o, 0 AS late FROM o WHERE lemma IN (SELECT form FROM kn) UNION ALL SELECT lemma, lemma, pair_id, 1 FROM o WHERE lemma IN (SELECT form FROM hd))
SELECT form, lemma FROM ag UNION ALL SELECT form, first(lemma ORDER BY o, late, lemma) FROM nw WHERE form NOT IN (SELECT form FROM ag) GROUP BY form""")
def holdout_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The ancient table with the pairs of all sources but the treebank."""
    ag, _, heads = PL.two(spark, d)
    return L.held_out(ag, PL.pairs(spark, d).withColumn("o", F.col("pair_id")), heads, "source", "treebank")


@query("sanitised_lexicon")
def sanitised_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The lexicon by sanitised forms; of forms that become one the first by source and row counts."""
    rows = PL.lex(spark, d).withColumn("form", U.sanitise(F.col("form"))).withColumn("lemma", U.sanitise(F.col("lemma")))
    return L.by_priority(checkpointed(rows).where(F.length("form") > 0), PL.rank())


_VECTOR = "[" + ", ".join(f"count(*) FILTER (lang = '{x}')" for x in PC.LANGS) + "]"


@query("summed_vectors", f"""WITH {PC.TOK}, a AS (SELECT k, {_VECTOR} AS v FROM tok WHERE source = 'broadcast' GROUP BY k), b AS (SELECT k, {_VECTOR} AS v FROM tok WHERE source <> 'broadcast' GROUP BY k)
SELECT k, list_aggregate(list_transform(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE list_transform(range(1, 6), lambda i: a.v[i] + b.v[i]) END, lambda x: x::VARCHAR), 'string_agg', ',') AS v FROM a FULL JOIN b USING (k)""")
def summed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Counts by language of two corpora, the broadcasts and the rest, added up."""
    t = PC.toks(spark, d).select("k", "lang", "source")
    vector = lambda df: df.groupBy("k").agg(F.array(*[F.count_if(F.col("lang") == x) for x in PC.LANGS]).alias("v"))
    s = Q.summed_vectors(vector(t.where("source = 'broadcast'")), vector(t.where("source <> 'broadcast'")), "k", "v")
    return s.select("k", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"))


@query("majority_with_tag", f"""WITH p AS ({PAIRS}), t AS (SELECT form, lemma, pos, count(*) AS n, min(pair_id) AS o FROM p GROUP BY ALL), m AS (SELECT form, lemma, sum(n) AS k, min(o) AS f, first(pos ORDER BY n DESC, o) AS pos FROM t GROUP BY ALL)
SELECT form, first(lemma ORDER BY k DESC, f) AS lemma, first(pos ORDER BY k DESC, f) AS pos FROM m GROUP BY form""")
def majority_with_tag(spark: SparkSession, d: str) -> DataFrame:
    return L.majority_with_tag(PL.pairs(spark, d))


_LONG = "SELECT form || 'δήποτε' AS form, CASE WHEN row_id % 2 = 0 THEN form || 'δήποτε' ELSE lemma || 'δήποτε' END AS lemma FROM lex"


@query("indefinites", f"WITH {PL.LEX}, x AS (SELECT form, lemma FROM lex UNION ALL {_LONG}) SELECT DISTINCT form, 'ὁστισδήποτε' AS lemma FROM x WHERE contains(form, 'δήποτε') AND NOT starts_with(form, 'δήποτε') AND contains(lemma, 'δήποτε') AND lemma <> form")
def indefinites(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of indefinite words, over the lexicon and, as it has few, its entries with the ending added."""
    rows = PL.lex(spark, d)
    end = F.lit(L.INDEFINITE)
    made = rows.select(F.concat("form", end).alias("form"), F.when(F.col("row_id") % 2 == 0, F.concat("form", end)).otherwise(F.concat("lemma", end)).alias("lemma"))
    return L.indefinites(rows.select("form", "lemma").unionByName(made))


# --- candidates ------------------------------------------------------------------------------------------------------

_TABLE_HITS = f"""c AS (SELECT word, word AS cand FROM w), lxs AS (SELECT 'ag' AS tbl, form, lemma FROM ag), ca AS ({PR.hits('c', 'word', False).replace('JOIN lx', 'JOIN lxs lx')}), lxe AS (SELECT 'el' AS tbl, form, lemma FROM el), cb AS ({PR.hits('c', 'word', False).replace('JOIN lx', 'JOIN lxe lx')}),
th AS (SELECT word, lemma, 'ag' AS tbl FROM ca UNION ALL SELECT word, lemma, 'el' FROM cb), tl AS (SELECT 'ag' AS tbl, form, lemma FROM ag UNION ALL SELECT 'el', form, lemma FROM el),
al AS (SELECT *, CASE WHEN upper(lemma[1]) = lemma[1] THEN lower(lemma[1]) ELSE upper(lemma[1]) END || lemma[2:] AS alt FROM th),
ca2 AS (SELECT word, lemma, tbl, FALSE AS alternate FROM th UNION ALL SELECT al.word, alt, al.tbl, TRUE FROM al JOIN tl ON tl.tbl = al.tbl AND tl.form = alt AND tl.lemma = alt WHERE alt <> al.lemma)"""


def table_hits(spark: SparkSession, d: str) -> DataFrame:
    """(word, lemma, tbl, alternate): what the ancient and the modern table have for each form, other cases of the first letter included."""
    ag, el, _ = PL.two(spark, d)
    both = checkpointed(ag.select(F.lit("ag").alias("tbl"), "form", "lemma").unionByName(el.select(F.lit("el").alias("tbl"), "form", "lemma")))
    w = PR.words(spark, d).withColumn("cand", F.col("word"))
    found = lambda t: R.looked_up(w, both.where(F.col("tbl") == t).withColumn("tbl", F.lit("all")), ["word"], prefer=False).select("word", "lemma", F.lit(t).alias("tbl"))
    return R.case_alternates(found("ag").unionByName(found("el")), both)


@query("case_alternates", f"WITH {PL.TABLES}, {PR.WORDS}, {_TABLE_HITS} SELECT word, lemma, tbl, alternate FROM ca2")
def case_alternates(spark: SparkSession, d: str) -> DataFrame:
    return table_hits(spark, d)


@query("scaled_candidates", f"""WITH {PL.TABLES}, {PR.FREQ}, {PR.WORDS}, {_TABLE_HITS}, u AS (SELECT word, lemma, min(CASE tbl WHEN 'ag' THEN 0 ELSE 2 END + alternate::INT) AS o FROM ca2 GROUP BY ALL),
lg AS (SELECT u.*, ln(1 + coalesce(fr.n, 0)) AS l FROM u LEFT JOIN fr ON fr.key = {PL.STRIP.format('u.lemma')}), mx AS (SELECT *, max(l) OVER (PARTITION BY word) AS m, count(*) OVER (PARTITION BY word) AS k FROM lg),
sc AS (SELECT word, lemma, CASE WHEN k > 1 AND m > 0 THEN CASE WHEN l > 0 THEN 0.5 + 0.5 * l / m ELSE 0.55 END ELSE 1.0 END::DOUBLE AS score, regexp_matches(lemma, '^\\p{{Lu}}') AS proper, o FROM mx)
SELECT word, lemma, round(score, 6) AS score, proper, row_number() OVER (PARTITION BY word ORDER BY proper, score DESC, o, lemma) AS rank FROM sc""")
def scaled_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of both tables with scores by corpus counts, and their order."""
    o = F.when(F.col("tbl") == "ag", 0).otherwise(2) + F.col("alternate").cast("int")
    c = table_hits(spark, d).groupBy("word", "lemma").agg(F.min(o).alias("o")).select("word", "lemma", F.lit("lookup").alias("source"), F.lit(1.0).alias("score"), "o")
    s = R.scaled(c, PR.frequencies(spark, d))
    return s.select("word", "lemma", F.round("score", 6).alias("score"), "proper", F.col("rank").cast("long").alias("rank"))


# --- verbs and elision -----------------------------------------------------------------------------------------------

_B = PL.BARE.format("form")
_BL = PL.BARE.format("lemma")
_CUT = f"regexp_replace({_B}, '[’᾽ʼ''ʹ]+$', '')"
_CV = f"regexp_extract({_BL}, '([{Y.CONSONANTS}][αεηιοωυ])ιε(?:ω|ομαι)$', 1)"
_SPOILT = f"(regexp_matches(form, '{Y.CRASIS}') OR (len(regexp_extract_all(form, '{Y.ACCENT}')) = 2 AND regexp_matches(form, '{Y.LAST_ACCENT}')) OR ({_CV} <> '' AND NOT regexp_matches({_CUT}, {_CV} || 'ι[αεηιοωυ]') AND regexp_matches({_CUT}, {_CV} || '(?:η|ει|ου|ω|ε|α)')))"
_AUG = f"coalesce({_BL}[1] <> '' AND (({_B}[1] = 'ε' AND {_BL}[1] <> 'ε') OR ({_B}[1] IN ('η', 'ω') AND {_BL}[1] IN ('α', 'ε', 'ο'))), FALSE)"
_EPIC = f"""((contains(key, '_imperfect_indicative') AND NOT regexp_matches({_BL}, 'σκ(?:ω|ομαι|ον)$') AND regexp_matches({_CUT}, '{Y.ITERATIVE_END}')) OR (starts_with(key, 'passive_aorist_indicative_') AND regexp_matches({_CUT}, '{Y.MIDDLE_END}'))
  OR (regexp_matches(key, '_indicative(_|$)') AND regexp_matches(key, 'aorist|imperfect|pluperfect') AND NOT {_AUG} AND NOT regexp_matches({_BL}, '^[ηω]') AND NOT (starts_with({_BL}, 'ε') AND starts_with({_B}, 'ε'))))"""
_DIALECT = "CASE WHEN list_contains(tags, 'Attic') THEN '' ELSE coalesce(CASE list_min(list_intersect(tags, [" + ", ".join(f"'{k}'" for k in Y.DIALECTS) + "])) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Y.DIALECTS.items()) + " END, '') END"


@query("verb_paradigms", f"""WITH {PS._CELLS.replace('SELECT lemma, form, source, pos, CASE WHEN', f'SELECT lemma, form, source, pos, {_DIALECT} AS tagged, CASE WHEN', 1)}, v AS (SELECT lemma, form, vk AS key, tagged FROM ck WHERE vk IS NOT NULL), r AS (SELECT lemma, form, key, CASE WHEN tagged = '' AND {_EPIC} THEN 'epic' ELSE tagged END AS dialect FROM v WHERE NOT {_SPOILT}),
n AS (SELECT lemma, dialect, key, form, count(*) AS n FROM r GROUP BY ALL)
SELECT lemma, dialect, key, first(form ORDER BY CASE WHEN regexp_matches(form, '[{Y.RICH}̓̔͂]') THEN 0 WHEN strip_accents(form) <> form THEN 1 ELSE 2 END, regexp_matches(form, '[’᾽ʼ''ʹ]$')::INT, n DESC,
  CASE WHEN regexp_matches(key, '_indicative(_|$)') AND regexp_matches(key, 'aorist|imperfect|pluperfect') AND {_AUG} THEN 0 ELSE 1 END, length(form), form DESC) AS form FROM n GROUP BY ALL""")
def verb_paradigms(spark: SparkSession, d: str) -> DataFrame:
    """The paradigms of the verbs of the pairs by dialect."""
    return Y.verb_paradigms(PL.pairs(spark, d).where("tags IS NOT NULL").select("lemma", "form", "tags"))


_G = "’᾽ʼ''ʹ"


@query("elided_forms", f"""WITH p AS ({PAIRS}), r AS (SELECT DISTINCT lemma, form FROM (SELECT lemma, form FROM p UNION ALL SELECT lemma, form[:length(form) - 1] || '’' FROM p WHERE regexp_matches({_B}, '..[αεηιουω]$')) t0),
s AS (SELECT DISTINCT lemma, regexp_replace(form, '[{_G}]$', '᾽') AS elided FROM r WHERE regexp_matches(form, '[{_G}]$') AND length(form) > 1), sk AS (SELECT *, {PL.BARE.format('elided[:length(elided) - 1]')} AS k FROM s),
f AS (SELECT lemma, form AS "full", {_B}[:length({_B}) - 1] AS k FROM r WHERE NOT regexp_matches(form, '[{_G}]$') AND length(form) >= 2 AND regexp_matches({_B}, '[αεηιουω]$')),
m AS (SELECT "full", elided, (regexp_matches("full", '^\\p{{Lu}}') = regexp_matches(elided, '^\\p{{Lu}}'))::INT * 10 + (regexp_matches("full", '[{T.BREATHINGS}̓̔]') = regexp_matches(elided, '[{T.BREATHINGS}̓̔]'))::INT * 5 + regexp_matches(elided, '[{T.ACUTES}{T.GRAVES}{T.CIRCUMFLEXES}́̀͂]')::INT * 2 - regexp_matches(elided, '^[{_G}]')::INT * 20 AS score FROM sk JOIN f USING (lemma, k)),
fx("full", elided) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in Y.ELIDED.items())})
SELECT "full", first(elided ORDER BY score DESC, elided DESC) AS elided FROM m WHERE "full" NOT IN (SELECT "full" FROM fx) GROUP BY "full" UNION ALL SELECT * FROM fx""")
def elided_forms(spark: SparkSession, d: str) -> DataFrame:
    """Full forms with their elided ones, over the pairs and, as invented words are seldom found elided, forms with their last vowel cut."""
    p = PL.pairs(spark, d).select("lemma", "form")
    cut = p.where(T.strip_accents(F.lower("form")).rlike("..[αεηιουω]$")).select("lemma", F.concat(F.expr("substring(form, 1, length(form) - 1)"), F.lit("’")).alias("form"))
    return Y.elided_forms(p.unionByName(cut))


_HEAD = (("fut.", "active_future_indicative_1sg"), ("aor.", "active_aorist_indicative_1sg"), ("pf.", "active_perfect_indicative_1sg"), (":—Med., fut.", "middle_future_indicative_1sg"), ("aor.", "middle_aorist_indicative_1sg"), (":—Pass., fut.", "passive_future_indicative_1sg"), ("aor.", "passive_aorist_indicative_1sg"))
_NAMES = ("fut", "aor", "pf", "fut_med", "aor_med", "fut_p", "aor_p")


@query("principal_parts", f"""WITH {PS._CELLS}, v AS (SELECT lemma, vk AS key, min(form) AS form FROM ck WHERE vk IN ({', '.join(f"'{k}'" for _, k in _HEAD)}) AND regexp_full_match(nfc_normalize(form), '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]{{{{3,}}}}') GROUP BY ALL),
n AS (SELECT lemma, list_extract([{', '.join(f"'{x}'" for x in _NAMES)}], list_position([{', '.join(f"'{k}'" for _, k in _HEAD)}], key)) AS part, nfc_normalize(form) AS form, {PL.BARE.format('nfc_normalize(form)')} AS b FROM v)
SELECT lemma, part, form FROM n WHERE CASE part """.replace("{{", "{").replace("}}", "}") + " ".join(f"WHEN '{p}' THEN regexp_matches(b, '({'|'.join(E.ENDINGS[p])})$')" for p in _NAMES) + f" END AND b NOT IN ({', '.join(repr(x) for x in E.SKIPPED)})")
def principal_parts(spark: SparkSession, d: str) -> DataFrame:
    """Principal parts read out of entry heads, which are written here from the first persons of the tagged pairs as dictionaries write them."""
    c = PS.cells(spark, d).where(F.col("key").isin(*[k for _, k in _HEAD])).where(T.nfc(F.col("form")).rlike(f"^[{T.GREEK_RANGES}]{{3,}}$"))
    p = c.groupBy("lemma").agg(*[F.min(F.when(F.col("key") == k, F.col("form"))).alias(f"_{i}") for i, (_, k) in enumerate(_HEAD)])
    text = F.concat(F.lit("[ᾰ], "), *[F.coalesce(F.concat(F.lit(f"{label} Ion. "), f"_{i}", F.lit(" Hdt.1.95, etc.: ")), F.lit(label[: label.find(",") + 1] + " " if "—" in label else "")) for i, (label, _) in enumerate(_HEAD)])
    return p.select("lemma", F.explode(E.principal_parts(text, F.col("lemma"))).alias("part", "form"))


_SE = "en(kind, key, ending, accented) AS (VALUES " + ", ".join(f"('{k}', '{c}', '{e}', {'TRUE' if x else 'FALSE'})" for k, c, e, x in Y.synthetic_endings()) + ")"
_PARTS = {"fut": "active_future_indicative_1sg", "aor": "active_aorist_indicative_1sg", "aor_p": "passive_aorist_indicative_1sg", "pf": "active_perfect_indicative_1sg", "pf_mp": "middle_perfect_indicative_1sg"}


def _b(x: str) -> str:
    return PL.BARE.replace("{0}", x)


_SIGN = "CASE " + " ".join(f"WHEN regexp_matches(p, '[{k}]$') THEN '{v}'" for k, v in Y.SIGMATIC.items()) + " END"


@query("synthesised_moods", f"""WITH {PS._CELLS}, {_SE}, done AS (SELECT DISTINCT lemma, vk AS key FROM ck WHERE vk IS NOT NULL), pts AS (SELECT lemma, {', '.join(f"min(nfc_normalize(form)) FILTER (vk = '{k}') AS {n}" for n, k in _PARTS.items())} FROM ck GROUP BY lemma),
le AS (SELECT DISTINCT nfc_normalize(text) AS lemma FROM lemmas WHERE pos = 'VERB' AND length(text) > 0), v AS (SELECT le.lemma, fut, aor, aor_p, pf, pf_mp, le.lemma[:length(le.lemma) - 1] AS present, {_b('le.lemma[:length(le.lemma) - 1]')} AS p, {_b('aor')} AS a FROM le LEFT JOIN pts ON pts.lemma = le.lemma
  WHERE regexp_matches(le.lemma, '[ωώ]$') AND NOT regexp_matches({_b('le.lemma')}, '[αεο]ω$') AND length({_b('le.lemma')}) >= 2),
g AS (SELECT *, {_SIGN} AS sign, regexp_matches(p, '[αεηιουω]$') AS vow, CASE WHEN regexp_matches(a, '^ε[^αεηιουω]') THEN a[2:] WHEN starts_with(a, 'η') THEN 'α' || a[2:] WHEN starts_with(a, 'ω') THEN 'ο' || a[2:] ELSE a END AS r FROM v),
st AS (SELECT lemma, 'present' AS kind, present AS stem FROM g UNION ALL
  SELECT lemma, 'aorist', CASE WHEN regexp_matches(fut, '[ωώ]$') AND regexp_matches({_b('fut[:length(fut) - 1]')}, '[σψξ]$') THEN fut[:length(fut) - 1]
    WHEN regexp_matches(a, '[σψξ]α$') AND a[length(a) - 1] = sign AND (r[:length(r) - 2] = '' OR CASE WHEN vow THEN p ELSE p[:length(p) - 1] END IN ('', r[:length(r) - 2])) THEN CASE WHEN vow THEN present ELSE present[:length(present) - 1] END || sign END FROM g UNION ALL
  SELECT lemma, 'passive', CASE WHEN {_b('aor_p[1]')} = 'ε' AND regexp_matches({_b('aor_p[2:]')}, 'θην$') THEN aor_p[2:length(aor_p) - 2] END FROM g UNION ALL SELECT lemma, 'perfect', CASE WHEN regexp_matches({_b('pf')}, '[^αεηιουω]α$') THEN pf[:length(pf) - 1] END FROM g UNION ALL SELECT lemma, 'perfect_mp', CASE WHEN ends_with({_b('pf_mp')}, 'μαι') THEN pf_mp[:length(pf_mp) - 3] END FROM g)
SELECT s.lemma, e.key, CASE WHEN accented THEN translate(translate(stem, '{Y.TONELESS[0]}', '{Y.TONELESS[1]}'), '́̀͂', '') ELSE stem END || ending AS form FROM st s JOIN en e USING (kind) ANTI JOIN done ON done.lemma = s.lemma AND done.key = e.key WHERE stem IS NOT NULL""")
def synthesised_moods(spark: SparkSession, d: str) -> DataFrame:
    """Moods and participles of the verbs among the headwords from their principal parts, where the pairs attest none."""
    c = PS.cells(spark, d)
    parts = c.where(F.col("key").isin(*_PARTS.values())).withColumn("form", T.nfc(F.col("form"))).groupBy("lemma").agg(*[F.min(F.when(F.col("key") == k, F.col("form"))).alias(n) for n, k in _PARTS.items()])
    heads = table(spark, d, "lemmas").where("pos = 'VERB' AND length(text) > 0").select(T.nfc(F.col("text")).alias("lemma")).distinct()
    return Y.synthesised(heads.join(parts, "lemma", "left"), c.select("lemma", "key"))


@query("declined_nouns", f"""WITH {PS._CELLS}, gs AS (SELECT lemma, gen AS gender, min(form) AS genitive FROM ck WHERE vk IS NULL AND cs = 'gen' AND num = 'sg' AND gen IS NOT NULL GROUP BY ALL), {PL.LEX}, kf AS (SELECT lemma, form FROM lex UNION SELECT lemma, form FROM ck WHERE vk IS NULL),
h AS (SELECT lemma, gender, {_b('lemma')} AS h, {_b('genitive')} AS g FROM gs), hk AS (SELECT *, coalesce(list_min(list_filter(range(1, least(length(h), length(g)) + 1), lambda i: h[i] <> g[i])) - 1, least(length(h), length(g))) AS k0 FROM h WHERE length(h) > 1 AND length(g) > 0),
hs AS (SELECT *, least(CASE WHEN k0 > 1 AND regexp_matches(h[k0], '[αεηιουω]') THEN k0 - 1 ELSE k0 END, length(h) - 1) AS k FROM hk), n AS (SELECT DISTINCT lemma, gender, h[:k] AS stem, h[k + 1:] AS nom, g[k + 1:] AS gen FROM hs),
e AS (SELECT DISTINCT gender, nom, gen, n.lemma, {_b('kf.form')}[length(stem) + 1:] AS ending FROM n JOIN kf ON kf.lemma = n.lemma WHERE starts_with({_b('kf.form')}, stem)),
b AS (SELECT gender, nom, gen, first(lemma ORDER BY k DESC, lemma) AS exemplar FROM (SELECT gender, nom, gen, lemma, count(*) AS k FROM e GROUP BY ALL) GROUP BY ALL)
SELECT DISTINCT n.lemma, stem || ending AS form, exemplar FROM n JOIN b USING (gender, nom, gen) JOIN e ON e.gender = n.gender AND e.nom = n.nom AND e.gen = n.gen AND e.lemma = exemplar WHERE length(stem || ending) > 1""")
def declined_nouns(spark: SparkSession, d: str) -> DataFrame:
    """Nouns of the pairs whose genitive is attested, declined like the best known noun of their class."""
    t = F.col("tags")
    p = PL.pairs(spark, d).where(t.isNotNull() & Y.verb_key(t).isNull())
    gen = p.where(F.array_contains("tags", "genitive") & F.array_contains("tags", "singular")).withColumn("gender", Y._short(t, Y.GENDERS)).where(F.col("gender").isNotNull() & (Y._short(t, Y.CASES) == "gen") & (Y._short(t, Y.NUMBERS) == "sg"))
    nouns = gen.groupBy("lemma", "gender").agg(F.min("form").alias("genitive"))
    known = PL.lex(spark, d).select("lemma", "form").unionByName(p.select("lemma", "form")).distinct()
    return Y.declined_by_class(nouns, known)


_SHORT_NAMES = {tag: name for axis in reversed(MORPHOLOGY) for name, tag in reversed(axis.items())}


@query("morphology_tags", "WITH p AS (" + PAIRS + ") SELECT pair_id, list_aggregate(list_filter([" + ", ".join(f"list_filter(tags, lambda t: t IN ({', '.join(repr(v) for v in dict.fromkeys(a.values()))}))[1]" for a in MORPHOLOGY) + "], lambda t: t IS NOT NULL), 'string_agg', ' ') AS tags FROM p WHERE tags IS NOT NULL")
def morphology_tags_query(spark: SparkSession, d: str) -> DataFrame:
    """Tags read out of morphology strings, which are written here from the tags of the pairs with a dialect in brackets."""
    names = F.create_map(*[x for k, v in _SHORT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    text = F.concat(F.array_join(F.transform("tags", lambda t: F.coalesce(F.try_element_at(names, t), t)), " "), F.lit(" (attic epic gen pl)"))
    tags = F.array_join(morphology_tags(text), " ")
    return PL.pairs(spark, d).where("tags IS NOT NULL").select("pair_id", F.nullif(tags, F.lit("")).alias("tags"))

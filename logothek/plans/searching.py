"""Fuzzy search, scoring and paradigms over the lexicon tables, each with its SQL where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.functions import udfs as U
from logothek.operators import frequency as Q
from logothek.operators import fuzzy as Z
from logothek.operators import lexicon as L
from logothek.operators import metrics as M
from logothek.operators import morphology as Y
from logothek.operators import resolve as R
from logothek.plans import lexicon as PL
from logothek.plans import resolving as PR
from logothek.plans.registry import query
from logothek.session import table

KEY = PL.STRIP
#: The other engine's distance counts bytes, so characters of keys are led to single ones for it.
_MANY = "αβγδεζηθικλμνξοπρστυφχψω" + "’ʼµаорекс" + "".join(map(chr, (0xFEFF, 0x202F, 0x2060, 0x200B, 0x200C, 0x200D, 0x200E, 0x2009, 0x2003, 0xA0, 0xAD))) + "ｅｍｉｒｔｏｃｈｕｓａ"
_ONE = "ABCDEFGHIJKLMNOPQRSTUVWX" + "YZ0123456" + "789!#$%&()*" + "+,-./:;<=>?"
_HEADS = f"hk AS (SELECT DISTINCT {KEY.format('text')} AS key FROM lemmas WHERE length(text) > 0 AND length({KEY.format('text')}) > 0)"
_HASH = "('0x' || substr(md5(key), 1, 8))::BIGINT"
_TYPOS = f"ty AS (SELECT DISTINCT CASE {_HASH} % 3 WHEN 0 THEN substring(key, 1, p - 1) || substring(key, p + 1) WHEN 1 THEN substring(key, 1, p) || substring(key, p) ELSE substring(key, 1, p - 1) || 'ω' || substring(key, p + 1) END AS q FROM (SELECT key, {_HASH} % length(key) + 1 AS p FROM hk WHERE length(key) >= 4) t0)"
_LAT = "translate({0}, '" + _MANY + "', '" + _ONE + "')"


def head_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the headwords."""
    return table(spark, d, "lemmas").where(F.length("text") > 0).select(T.key(F.col("text")).alias("key")).where(F.length("key") > 0).distinct()


def misspelt(spark: SparkSession, d: str) -> DataFrame:
    """One misspelling of each headword of four letters or more, by its hash."""
    k = head_keys(spark, d).where(F.length("key") >= 4)
    h = F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long")
    p = (F.pmod(h, F.length("key")) + 1).cast("int")
    pre, post = F.substring(F.col("key"), F.lit(1), p - 1), F.substring(F.col("key"), p + 1, F.length("key"))
    return k.select(F.when(h % 3 == 0, F.concat(pre, post)).when(h % 3 == 1, F.concat(F.substring(F.col("key"), F.lit(1), p), F.substring(F.col("key"), p, F.length("key")))).otherwise(F.concat(pre, F.lit("ω"), post)).alias("q")).distinct()


_NEAR = f"nr AS (SELECT q, key, damerau_levenshtein({_LAT.format('q')}, {_LAT.format('key')}) AS ed FROM ty, hk WHERE abs(length(q) - length(key)) <= 2)"


@query("spell_ed1", f"WITH {_HEADS}, {_TYPOS}, {_NEAR} SELECT q, key, ed::INT AS ed FROM nr WHERE ed <= 1")
def spell_ed1(spark: SparkSession, d: str) -> DataFrame:
    return Z.within(misspelt(spark, d), head_keys(spark, d), 1)


@query("spell_staged", f"WITH {_HEADS}, {_TYPOS}, {_NEAR} SELECT q, key, ed::INT AS ed FROM nr WHERE ed <= 1 OR (ed = 2 AND q NOT IN (SELECT q FROM nr WHERE ed <= 1 GROUP BY q HAVING count(*) >= 3))")
def spell_staged(spark: SparkSession, d: str) -> DataFrame:
    """Headwords within one edit; within two for misspellings that found fewer than three."""
    return Z.spelling_hits(misspelt(spark, d), head_keys(spark, d))


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lemmas").where(F.length("text") > 0).groupBy(F.col("text").alias("form")).agg(F.count("*").alias("n"))


@query("spelling_suggestions")
def spelling_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return Z.suggestions(misspelt(spark, d).withColumnRenamed("q", "word"), _forms(spark, d))


@query("ocr_suggestions")
def ocr_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return Z.suggestions(misspelt(spark, d).withColumnRenamed("q", "word"), _forms(spark, d), ocr=True)


@query("typo_recovery")
def typo_recovery(spark: SparkSession, d: str) -> DataFrame:
    """How often the first and the first five suggestions hold the word a misspelling was made of."""
    heads = head_keys(spark, d)
    t = Z.typos(heads, "key").where(F.length("key") >= 4)
    s = Z.suggestions(t.select(F.col("typo").alias("word")).distinct(), heads.select(F.col("key").alias("form"), F.lit(1).alias("n")))
    # suggestions are many for a small file, so they aren't broadcast
    j = t.join(s.hint("merge"), (F.col("typo") == F.col("word")) & (F.col("key") == F.col("form")), "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"))


_INDEX = f"""{PL.LEX}, kd AS (SELECT DISTINCT {PL.BARE.format('form')} AS stripped, form, lemma FROM lex WHERE lang IN ('all', 'grc')), fan AS (SELECT lemma, count(DISTINCT stripped) AS fan FROM kd GROUP BY lemma),
sc AS (SELECT kd.*, fan + CASE WHEN stripped = {PL.BARE.format('lemma')} THEN 500 ELSE 0 END AS score FROM kd JOIN fan USING (lemma)),
ix AS (SELECT stripped, first(form ORDER BY score DESC, form, lemma) AS form, first(lemma ORDER BY score DESC, form, lemma) AS lemma, max(score) AS score FROM sc GROUP BY stripped)"""


@query("pattern_index", f"WITH {_INDEX} SELECT * FROM ix")
def pattern_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the forms of all varieties and of the ancient one."""
    return Z.pattern_index(PL.lex(spark, d).where(F.col("lang").isin("all", "grc")))


def _find(pattern: str) -> str:
    p = Z.Pattern(pattern)
    return f"WITH {_INDEX} SELECT * FROM ix WHERE regexp_matches(stripped, '{p.regex}') ORDER BY score DESC, length(stripped), stripped LIMIT 20"


@query("pattern_find_gap", _find("κ*ος"))
def pattern_find_gap(spark: SparkSession, d: str) -> DataFrame:
    return Z.found(pattern_index(spark, d), "κ*ος")


@query("pattern_find_class", _find("..[αο]....[ως]*"))
def pattern_find_class(spark: SparkSession, d: str) -> DataFrame:
    return Z.found(pattern_index(spark, d), "..[αο]....[ως]*")


_RANGES = [("α", "αδ"), ("κρ", "γ"), ("μ", "ξ"), ("ω", "ω")]


@query("range_join", f"WITH {_HEADS}, r(lo, hi) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _RANGES) + ") SELECT key, lo, hi FROM hk JOIN r ON key > least(lo, hi) AND key < greatest(lo, hi)")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    return Z.in_ranges(head_keys(spark, d), spark.createDataFrame(_RANGES, "lo string, hi string")).select("key", "lo", "hi")


# --- scoring ---------------------------------------------------------------------------------------------------------

_SCORED = f"""{PR.LEXICON}, {PR.WORDS}, c AS (SELECT word, word AS cand FROM w), h AS ({PR.hits('c', 'word')}),
sd AS (SELECT p.pair_id, p.split, p.source, h.lemma AS pred, p.lemma AS gold FROM lemmapairdataset p JOIN w ON w.word = p.form LEFT JOIN h ON h.word = p.form WHERE length(p.form) > 0 AND length(p.lemma) > 0)"""
_TR = f"trim({PL.LOWER})"


def scored(spark: SparkSession, d: str) -> DataFrame:
    found = R.cascade(PR.words(spark, d), PR.lexicon(spark, d)).select(F.col("word").alias("form"), F.col("lemma").alias("pred"))
    return PL.pairs(spark, d).withColumnRenamed("lemma", "gold").join(found, "form").select("pair_id", "split", "source", "form", "pred", "gold")


def _share(cond: str) -> str:
    return f"round(avg(coalesce({cond}, FALSE)::INT) * 100, 2)"


_LEVELS = f"count(*) AS n, {_share(_TR.format('pred') + ' = ' + _TR.format('gold'))} AS strict, {_share(PR.MONO.format(_TR.format('pred')) + ' = ' + PR.MONO.format(_TR.format('gold')))} AS monotonic, {_share(KEY.format('trim(pred)') + ' = ' + KEY.format('trim(gold)'))} AS stripped"


@query("accuracy_rollup", f"WITH {_SCORED} SELECT split, source, {_LEVELS} FROM sd GROUP BY GROUPING SETS ((split, source), (split), (source), ())")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return M.accuracy(scored(spark, d), [["split", "source"], ["split"], ["source"], []])


@query("accuracy_by_frequency", f"WITH {_SCORED}, f AS (SELECT gold, count(*) AS k FROM sd GROUP BY gold), b AS (SELECT sd.*, CASE WHEN k >= 10 THEN '10+' WHEN k >= 3 THEN '3-9' ELSE '1-2' END AS bin FROM sd JOIN f USING (gold)) SELECT bin, split, {_LEVELS} FROM b GROUP BY GROUPING SETS ((bin, split), (bin), ())")
def accuracy_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    f = Q.counts(s, "gold", name="k")
    b = s.join(f, "gold").withColumn("bin", F.when(F.col("k") >= 10, "10+").when(F.col("k") >= 3, "3-9").otherwise("1-2"))
    return M.accuracy(b, [["bin", "split"], ["bin"], []])


_KEY_P, _KEY_G = KEY.format("trim(pred)"), KEY.format("trim(gold)")


@query("accuracy_with_equivalents", f"""WITH {_SCORED}, g AS (SELECT DISTINCT {KEY.format('l.text')} AS group_id, h.text AS lemma FROM lemmas l JOIN lemmas h ON h.id = l.id WHERE length(l.text) > 0 UNION SELECT DISTINCT 'b' || a.lemma, b.lemma FROM lex a JOIN lex b ON a.form = b.form AND a.lang = 'el' AND b.lang = 'grc' AND a.lemma <> b.lemma UNION SELECT DISTINCT 'b' || lemma, lemma FROM lex WHERE lang = 'el')
SELECT split, count(*) AS n, count(*) FILTER (coalesce({_KEY_P} = {_KEY_G}, FALSE) OR (pred, {_KEY_G}) IN (SELECT (a.lemma, {KEY.format('trim(b.lemma)')}) FROM g a JOIN g b ON a.group_id = b.group_id) OR (gold, {_KEY_P}) IN (SELECT (a.lemma, {KEY.format('trim(b.lemma)')}) FROM g a JOIN g b ON a.group_id = b.group_id)) AS n_equiv FROM sd GROUP BY split""")
def accuracy_with_equivalents(spark: SparkSession, d: str) -> DataFrame:
    """Predictions right up to equals: headwords with one key, and modern lemmas with the ancient ones that share a form with them."""
    texts = table(spark, d, "lemmas").where("length(text) > 0").select(T.key(F.col("text")).alias("group_id"), F.col("text").alias("lemma"))
    rows = PL.lex(spark, d)
    bridged = lambda c: F.concat(F.lit("b"), c).alias("group_id")
    twins = L.bridges(rows).select(bridged("el_lemma"), F.col("grc_lemma").alias("lemma"))
    own = rows.where("lang = 'el'").select(bridged("lemma"), "lemma")
    groups = texts.unionByName(twins).unionByName(own).distinct()
    e = M.with_equivalents(scored(spark, d), groups)
    return e.groupBy("split").agg(F.count("*").alias("n"), F.count_if("equiv").alias("n_equiv"))


@query("index_percentiles", "WITH v AS (SELECT length(text) AS x FROM documents WHERE text IS NOT NULL), n AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v) SELECT q, x FROM n, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS t(q) WHERE i = least(floor(n * q), n - 1)")
def index_percentiles(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").where("text IS NOT NULL").select(F.length("text").cast("long").alias("x"))
    return M.percentile_by_index(v, "x", [0.5, 0.95, 0.99])


# --- paradigms -------------------------------------------------------------------------------------------------------


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(lemma, key, form, source, verb) of the tagged pairs that name a cell."""
    t, verb = F.col("tags"), Y.verb_key(F.col("tags"))
    key = F.coalesce(verb, Y.nominal_key(t, F.coalesce(F.col("pos") == "adj", F.lit(False))))
    return PL.pairs(spark, d).where("tags IS NOT NULL").select("lemma", key.alias("key"), "form", "source").where("key IS NOT NULL")


def _pick(axis) -> str:
    return "list_min(list_intersect(tags, [" + ", ".join(f"'{x}'" for x in axis) + "]))"


def _short(axis: dict[str, str]) -> str:
    return f"CASE {_pick(axis)} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in axis.items()) + " END"


_CELLS = f"""ct AS (SELECT lemma, form, source, pos, CASE WHEN list_contains(tags, 'mediopassive') THEN 'middle' ELSE {_pick(Y.VOICES)} END AS voice, {_pick(Y.TENSES)} AS tense, {_pick(Y.MOODS)} AS mood,
  {_short(Y.PERSONS)} AS person, {_short(Y.NUMBERS)} AS num, {_short(Y.GENDERS)} AS gen, {_pick(Y.CASES)} AS cas, {_short(Y.CASES)} AS cs FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 AND tags IS NOT NULL),
ck AS (SELECT *, CASE WHEN voice IS NOT NULL AND tense IS NOT NULL AND mood IS NOT NULL THEN CASE mood WHEN 'infinitive' THEN voice || '_' || tense || '_infinitive' WHEN 'participle' THEN voice || '_' || tense || '_participle_' || coalesce(cs, 'nom') || '_' || gen || '_' || coalesce(num, 'sg')
  ELSE CASE WHEN NOT (mood = 'imperative' AND person = '1') THEN voice || '_' || tense || '_' || mood || '_' || person || num END END END AS vk FROM ct),
ce AS (SELECT lemma, form, source, coalesce(vk, CASE WHEN coalesce(pos = 'adj', FALSE) THEN cas || '_' || gen || '_' || num ELSE cas || '_' || num END) AS key FROM ck WHERE coalesce(vk, CASE WHEN coalesce(pos = 'adj', FALSE) THEN cas || '_' || gen || '_' || num ELSE cas || '_' || num END) IS NOT NULL)"""
_ATT = f"{_CELLS}, nn AS (SELECT lemma, key, form, source, count(*) AS n FROM ce GROUP BY ALL), att AS (SELECT lemma, key, first(form ORDER BY {PL._SRC}, n DESC, form, source) AS form, first(source ORDER BY {PL._SRC}, n DESC, form, source) AS source FROM nn GROUP BY ALL)"


def source_rank() -> Column:
    return F.when(F.col("source") == "treebank", 0).when(F.col("source") == "ag", 1).when(F.col("source") == "med", 2).otherwise(3)


@query("paradigm_cells", f"WITH {_ATT} SELECT * FROM att")
def paradigm_cells(spark: SparkSession, d: str) -> DataFrame:
    return Y.attested(cells(spark, d), source_rank())


_ENDINGS = "en(kind, ending, key, suffix, cut) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in Y.template_rows()) + ")"
_BARE = PL.BARE.format("lemma")


@query("paradigm_fill", f"""WITH {_ATT}, {_ENDINGS}, le AS (SELECT DISTINCT nfc_normalize(text) AS lemma, pos AS kind FROM lemmas WHERE length(text) > 0), cl AS (SELECT lemma, kind, CASE
  WHEN kind = 'VERB' AND regexp_matches(lemma, '[ωώ]$') AND NOT regexp_matches({_BARE}, '[αεο]ω$') THEN 'ω' WHEN kind = 'NOUN' THEN CASE WHEN ends_with({_BARE}, 'α') THEN 'α' WHEN ends_with({_BARE}, 'η') THEN 'η' WHEN ends_with({_BARE}, 'ον') THEN 'ον' WHEN ends_with({_BARE}, 'ος') THEN 'ος' END
  WHEN kind = 'ADJ' AND ends_with({_BARE}, 'ος') THEN 'ος' END AS ending FROM le),
gen AS (SELECT DISTINCT lemma, key, CASE WHEN suffix IS NULL THEN lemma WHEN kind <> 'NOUN' OR ends_with({PL.LOWER.format('lemma')}, ending) THEN lemma[:length(lemma) - cut] || suffix ELSE lemma || suffix END AS form FROM cl JOIN en USING (kind, ending))
SELECT lemma, key, form, source FROM att UNION ALL SELECT g.lemma, g.key, g.form, 'template' FROM gen g ANTI JOIN att ON att.lemma = g.lemma AND att.key = g.key""")
def paradigm_fill(spark: SparkSession, d: str) -> DataFrame:
    """Attested cells, and those that a template gives the headwords of its part of speech."""
    t = table(spark, d, "lemmas").where(F.length("text") > 0)
    return Y.filled(paradigm_cells(spark, d), Y.template(spark, t.select(T.nfc(F.col("text")).alias("lemma"), F.col("pos").alias("kind"))))


@query("paradigm_sources", f"WITH {_ATT} SELECT source, count(*) AS n_cells, count(DISTINCT lemma) AS n_lemmas FROM att GROUP BY source")
def paradigm_sources(spark: SparkSession, d: str) -> DataFrame:
    return paradigm_cells(spark, d).groupBy("source").agg(F.count("*").alias("n_cells"), F.count_distinct("lemma").alias("n_lemmas"))


def _vals(name: str, columns: str, rows) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS {name}({columns})"


_VOICE = _vals("a", "voice", [(v,) for v in Y.VOICES])
_MT = lambda name, moods: _vals(name, "mood, tense", [(m, t) for m in moods for t in Y.MOODS[m]])
_NUMBER, _GENDER = _vals("f", "number", [(x,) for x in Y.NUMBERS.values()]), _vals("h", "gender", [(x,) for x in Y.GENDERS.values()])


@query("verb_grid", f"""SELECT voice, tense, mood, person, number, NULL::VARCHAR AS "case", NULL::VARCHAR AS gender, voice || '_' || tense || '_' || mood || '_' || person || number AS key FROM {_VOICE}, {_MT('b', ('indicative', 'subjunctive', 'optative', 'imperative'))}, {_vals('e', 'person', [('1',), ('2',), ('3',)])}, {_NUMBER} WHERE NOT (person = '1' AND (number = 'du' OR mood = 'imperative'))
UNION ALL SELECT voice, tense, mood, NULL, NULL, NULL, NULL, voice || '_' || tense || '_infinitive' FROM {_VOICE}, {_MT('b', ('infinitive',))}
UNION ALL SELECT voice, tense, mood, NULL, number, cas, gender, voice || '_' || tense || '_participle_' || cas || '_' || gender || '_' || number FROM {_VOICE}, {_MT('b', ('participle',))}, {_vals('c', 'cas', [(x,) for x in Y.CASES.values()])}, {_GENDER}, {_NUMBER}""")
def verb_grid(spark: SparkSession, d: str) -> DataFrame:
    return Y.verb_grid(spark)


@query("nominal_grid", f"SELECT \"case\", gender, number, \"case\" || '_' || gender || '_' || number AS key FROM {_vals('a', chr(34) + 'case' + chr(34), [(x,) for x in Y.CASES])}, {_NUMBER}, {_GENDER}")
def nominal_grid(spark: SparkSession, d: str) -> DataFrame:
    return Y.nominal_grid(spark, True)


@query("paradigm_gaps", f"WITH {_ATT}, v AS (SELECT DISTINCT lemma, split_part(key, '_', 1) AS voice FROM att WHERE regexp_matches(key, '^(active|middle|passive)_')), n AS (SELECT lemma, voice, count(*) AS k FROM (SELECT DISTINCT lemma, key, split_part(key, '_', 1) AS voice FROM att) t0 JOIN v USING (lemma, voice) GROUP BY ALL) SELECT lemma, voice, 359 - k AS n_missing FROM n")
def paradigm_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How many cells of each voice that a verb has at all are not attested."""
    grid = Y.verb_grid(spark).select("voice", "key")
    att = paradigm_cells(spark, d).join(F.broadcast(grid), "key").groupBy("lemma", "voice").agg(F.count_distinct("key").alias("k"))
    size = grid.groupBy("voice").agg(F.count("*").alias("whole"))
    return att.join(F.broadcast(size), "voice").select("lemma", "voice", (F.col("whole") - F.col("k")).alias("n_missing"))


_F0, _L0 = PL.BARE.format("form") + "[1]", PL.BARE.format("lemma") + "[1]"
_AUGMENTED = f"(({_F0} = 'ε' AND {_L0} <> 'ε') OR ({_F0} IN ('η', 'ω') AND {_L0} IN ('α', 'ε', 'ο')))"


@query("best_forms", f"""WITH {_CELLS}, n AS (SELECT lemma, key, form, count(*) AS n FROM ce GROUP BY ALL)
SELECT lemma, key, first(form ORDER BY CASE WHEN regexp_matches(form, '[{Y.RICH}̓̔͂]') THEN 0 WHEN strip_accents(form) <> form THEN 1 ELSE 2 END, regexp_matches(form, '[’᾽ʼ''ʹ]$')::INT, n DESC,
  CASE WHEN regexp_matches(key, '_indicative(_|$)') AND regexp_matches(key, 'aorist|imperfect|pluperfect') AND {_AUGMENTED} THEN 0 ELSE 1 END, length(form), form DESC) AS form FROM n GROUP BY ALL""")
def best_forms(spark: SparkSession, d: str) -> DataFrame:
    return Y.best_form(Q.counts(cells(spark, d), "lemma", "key", "form"), ["lemma", "key"], lemma=F.col("lemma"), cell=F.col("key"))


@query("movable_nu", """SELECT DISTINCT form, form || 'ν' AS with_nu FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 AND tags IS NOT NULL AND (
  (regexp_matches(strip_accents(form), '[σξψ]ι$') AND (list_has_all(tags, ['third-person', 'plural']) OR list_has_all(tags, ['third-person', 'singular']) OR list_has_all(tags, ['dative', 'plural']))) OR (ends_with(strip_accents(form), 'ε') AND list_has_all(tags, ['third-person', 'singular'])) OR strip_accents(lower(form)) IN ('εστι', 'εικοσι', 'περυσι'))""")
def movable_nu(spark: SparkSession, d: str) -> DataFrame:
    return Y.movable_nu(PL.pairs(spark, d).where("tags IS NOT NULL").select("form", "tags"))


@query("elision_pairs", f"""WITH r0 AS (SELECT lemma, form FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0), r AS (SELECT DISTINCT lemma, form, {PL.BARE.format('form')} AS k FROM (SELECT * FROM r0 UNION ALL SELECT lemma, form[:length(form) - 1] FROM r0 WHERE regexp_matches({PL.BARE.format('form')}, '..[αεοι]$')) t0),
f AS (SELECT lemma, form AS full_form, k[:length(k) - 1] AS k FROM r WHERE regexp_matches(k, '[αεοι]$')),
m AS (SELECT s.lemma, s.form AS elided, f.full_form, CASE WHEN s.form[1] = f.full_form[1] THEN 15 ELSE 0 END + CASE WHEN starts_with(f.full_form, s.form[:length(s.form) - 1]) THEN 2 ELSE 0 END AS score FROM r s JOIN f ON f.lemma = s.lemma AND f.k = s.k WHERE NOT regexp_matches(s.k, '[αεοι]$') AND length(s.k) >= 2)
SELECT lemma, elided, first(full_form ORDER BY score DESC, full_form) AS "full" FROM m GROUP BY lemma, elided""")
def elision_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Forms, and those with their last vowel cut off, as invented words are seldom found elided, with the full form."""
    p = PL.pairs(spark, d).select("lemma", "form")
    cut = p.where(T.strip_accents(F.lower("form")).rlike("..[αεοι]$")).select("lemma", F.expr("substring(form, 1, length(form) - 1)").alias("form"))
    return Y.elision_pairs(p.unionByName(cut))

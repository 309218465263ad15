"""Resolving words through the lexicon, each step with its SQL where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logothek.functions import tables as G
from logothek.functions import text as T
from logothek.operators import resolve as R
from logothek.plans import lexicon as PL
from logothek.plans.registry import query
from logothek.session import checkpointed, table


def q(*xs: str) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


LOWER, BARE = PL.LOWER, PL.BARE
MONO = "translate(translate({0}, '" + T.MONOTONIC[0] + "', '" + T.MONOTONIC[1] + "'), '" + T.MADE_ACUTE + T.DROPPED + "', '́́')"
ACUTE = "translate(translate({0}, '" + T.ACUTE[0] + "', '" + T.ACUTE[1] + "'), '̀', '́')"
WORDS = "w AS (SELECT DISTINCT form AS word FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0)"
LEXICON = f"{PL.TABLES}, lx AS (SELECT 'ag' AS tbl, form, lemma FROM ag UNION ALL SELECT 'all', coalesce(ag.form, el.form), coalesce(ag.lemma, el.lemma) FROM ag FULL JOIN el ON ag.form = el.form)"
KEYS = "[" + ", ".join("{{'v': %d, 'key': %s}}" % (i, k) for i, k in enumerate(["{0}", LOWER, ACUTE, LOWER.replace("{0}", ACUTE), MONO.replace("{0}", LOWER), BARE])) + "]"


def hits(source: str, keep: str, prefer: bool = True, guard: bool = True) -> str:
    """SQL of the first hit of each candidate (``cand``) of a relation."""
    order = f"CASE WHEN tbl = 'ag' AND regexp_matches(cand, '[{R.POLYTONIC}]') THEN 0 WHEN tbl = 'all' THEN 1 END" if prefer else "1"
    short = "AND NOT (k.x.v >= 4 AND length(lx.form) <= 2 AND lx.form = lx.lemma)" if guard else ""
    return f"""SELECT {keep}, cand, first(lemma ORDER BY t, v, lemma) AS lemma, first(v ORDER BY t, v, lemma) AS v FROM (
  SELECT {', '.join('k.' + c.strip() for c in keep.split(','))}, k.cand, lx.lemma, k.x.v AS v, {order} AS t FROM (SELECT *, unnest({KEYS.format('cand')}) AS x FROM {source}) k JOIN lx ON lx.form = k.x.key WHERE {order} IS NOT NULL {short}) GROUP BY {keep}, cand"""


def words(spark: SparkSession, d: str) -> DataFrame:
    return PL.pairs(spark, d).select(F.col("form").alias("word")).distinct()


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    ag, el, _ = PL.two(spark, d)
    both = ag.select("form", F.col("lemma").alias("a")).join(el.select("form", F.col("lemma").alias("e")), "form", "full").select(F.lit("all").alias("tbl"), "form", F.coalesce("a", "e").alias("lemma"))
    return ag.select(F.lit("ag").alias("tbl"), "form", "lemma").unionByName(both)


def frequencies(spark: SparkSession, d: str) -> DataFrame:
    return PL.pairs(spark, d).groupBy(T.key(F.col("lemma")).alias("key")).agg(F.count("*").alias("n"))


FREQ = f"fr AS (SELECT {PL.STRIP.format('lemma')} AS key, count(*) AS n FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 GROUP BY 1)"
_ALL = "WHERE length(p.form) > 0 AND length(p.lemma) > 0"


@query("cascade_lookup", f"WITH {LEXICON}, {WORDS}, c AS (SELECT word, word AS cand FROM w), h AS ({hits('c', 'word')}) SELECT w.word, h.lemma, ['exact', 'lower', 'acute', 'acute', 'mono', 'stripped'][v + 1] AS via FROM w LEFT JOIN h USING (word)")
def cascade_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.cascade(words(spark, d), lexicon(spark, d))


_SORT_K = BARE.format("replace(k, '-', '')")
_PLAIN = f"regexp_replace(translate(k, '{T.LENGTH[0]}', '{T.LENGTH[1]}'), '[̄̆]', '', 'g')"


@query("normalisation_keys", f"WITH {WORDS}, n AS (SELECT word, nfc_normalize(word) AS k FROM w) SELECT word, strip_accents(k) AS stripped, {MONO.format('k')} AS mono, {ACUTE.format('k')} AS acute, {_SORT_K} AS sort_key, {_PLAIN} AS plain_length FROM n")
def normalisation_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys of each form's composed form."""
    w = words(spark, d).select("word", T.nfc(F.col("word")).alias("k"))
    k = F.col("k")
    return w.select("word", T.strip_accents(k).alias("stripped"), T.monotonic(k).alias("mono"), T.grave_to_acute(k).alias("acute"), T.sort_key(k).alias("sort_key"), T.strip_length(k).alias("plain_length"))


_MARKS = "".join(G.ELISION_MARKS).replace("'", "''")
_VOWELS = [(v, G.VOWEL_RANK.index(v)) for v in G.VOWELS] + [(G.ACCENTED[v], G.VOWEL_RANK.index(v)) for v in G.VOWELS]


def elided(source: str) -> str:
    """SQL of all lemmas that the elided words of a relation may stand for: relations s, st, ce, lxa, he, oe."""
    return f"""{values('vw', 'vowel, vrank', _VOWELS)},
s AS (SELECT word, regexp_replace(word, '[{_MARKS}]$', '') AS stem FROM {source} WHERE regexp_matches(word, '^.+[{_MARKS}]$')),
st AS (SELECT word, stem, stem AS s FROM s UNION ALL SELECT word, stem, stem[:length(stem) - 1] || CASE right(stem, 1) WHEN 'θ' THEN 'τ' WHEN 'φ' THEN 'π' ELSE 'κ' END FROM s WHERE right(stem, 1) IN ('θ', 'φ', 'χ')),
ce AS (SELECT word, stem, vrank, vowel, s || vowel AS cand FROM st, vw), lxa AS (SELECT * FROM lx WHERE tbl = 'ag'),
he AS ({hits('ce', 'word, stem, vrank, vowel', False, False).replace('JOIN lx', 'JOIN lxa lx')}),
oe AS (SELECT word, lemma, min({{'a': CASE WHEN {BARE.format('stem')} IN ({q(*G.ELISION_STEMS)}) AND lemma IN ({q(*G.FUNCTION_LEMMAS)}) THEN 0 ELSE 1 END, 'b': regexp_matches(lemma, '^\\p{{Lu}}')::INT, 'c': -coalesce(n, 0), 'd': vrank, 'e': length(lemma), 'f': cand}}) AS o FROM he LEFT JOIN fr ON fr.key = {PL.STRIP.format('lemma')} GROUP BY word, lemma)"""


@query("elision_expand", f"""WITH {LEXICON}, {FREQ}, {WORDS}, we AS (SELECT DISTINCT word[:length(word) - 1] || '’' AS word FROM w WHERE regexp_matches(word, '..[{G.VOWELS}]$')), {elided('we')}
SELECT word, o.f AS cand, lemma, row_number() OVER (PARTITION BY word ORDER BY o, lemma) AS rank FROM oe""")
def elision_expand(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas that forms may stand for whose last vowel is cut off."""
    c = F.col("word")
    w = words(spark, d).where(c.rlike(f"..[{G.VOWELS}]$")).select(F.concat(F.expr("substring(word, 1, length(word) - 1)"), F.lit("’")).alias("word")).distinct()
    return R.elisions(w, checkpointed(lexicon(spark, d)), frequencies(spark, d)).withColumn("rank", F.col("rank").cast("long"))


def table_forms(spark: SparkSession, d: str) -> DataFrame:
    """(word): the distinct forms of the lexicon and of the pairs, and the closed words and contractions themselves."""
    forms = table(spark, d, "lookup").select("form").unionByName(table(spark, d, "lemmapairdataset").select("form"))
    closed = spark.createDataFrame([(f,) for f in _CLOSED], "form string")
    return forms.unionByName(closed).where(F.length("form") > 0).select(F.col("form").alias("word")).distinct()


_ARTICLES = q(*G.ARTICLES)
_PRONOUNS = values("pr", "form, lemma", [(f, k) for f, k in G.PRONOUNS.items()])
_CLOSED = [*dict.fromkeys([*G.ARTICLES, *G.PRONOUNS, *G.MG_CLOSED, *G.CRASIS])]
TABLE_FORMS = f"{values('cl', 'form', [(f,) for f in _CLOSED])}, w AS (SELECT DISTINCT form AS word FROM (SELECT form FROM lookup UNION ALL SELECT form FROM lemmapairdataset UNION ALL SELECT form FROM cl) t0 WHERE length(form) > 0)"
_LOW_MONO = MONO.replace("{0}", LOWER).format("word")


@query("closed_class", f"WITH {_PRONOUNS}, {TABLE_FORMS} SELECT word, CASE WHEN word IN ({_ARTICLES}) OR {LOWER.format('word')} IN ({_ARTICLES}) OR {MONO.format('word')} IN ({_ARTICLES}) OR {_LOW_MONO} IN ({_ARTICLES}) THEN 'ὁ' ELSE coalesce(a.lemma, b.lemma) END AS lemma FROM w LEFT JOIN pr a ON a.form = word LEFT JOIN pr b ON b.form = {MONO.format('word')}")
def closed_class(spark: SparkSession, d: str) -> DataFrame:
    """All forms of the tables, with the lemma of those that are articles or pronouns."""
    return table_forms(spark, d).select("word", R.closed_class(F.col("word")).alias("lemma"))


@query("crasis", f"WITH {values('cr', 'form, lemma', G.CRASIS.items())}, {TABLE_FORMS} SELECT word, coalesce(a.lemma, b.lemma) AS lemma FROM w LEFT JOIN cr a ON a.form = word LEFT JOIN cr b ON b.form = {MONO.format('word')}")
def crasis(spark: SparkSession, d: str) -> DataFrame:
    """All forms of the tables, with the lemma of those that are contractions."""
    return table_forms(spark, d).select("word", R.crasis(F.col("word")).alias("lemma"))


_SELF = f"(cand = lemma OR {BARE.format('cand')} = {BARE.format('lemma')})"


def split_parts(source: str) -> str:
    """SQL of the parts of the words of a relation after each link vowel: (word, rank, prefix, cand)."""
    return f"SELECT word, i AS rank, bare[:i] AS prefix, bare[i + 1:] AS cand FROM (SELECT word, bare, unnest(range(2, length(bare) - 2)) AS i FROM (SELECT word, {BARE.format('word')} AS bare FROM {source}) b0 WHERE length(bare) >= 6) b1 WHERE bare[i] IN ('ο', 'ι', 'υ')"


@query("compound_split", f"""WITH {LEXICON}, {WORDS}, wc AS (SELECT 'ακρο' || word AS word FROM w), c AS ({split_parts('wc')}),
h AS ({hits('c', 'word, rank, prefix')}), k AS (SELECT *, {BARE.format('lemma')} AS s FROM h)
SELECT word, prefix || s AS compound, lemma AS base_lemma, prefix, rank FROM k WHERE s <> cand AND length(s) >= 2 AND length(s) <= length(cand) + 2""")
def compound_split(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d).select(F.concat(F.lit("ακρο"), "word").alias("word"))
    return R.compounds(w, lexicon(spark, d)).withColumn("rank", F.col("rank").cast("long"))


# --- rules of one lookup, over words made for them, as invented words seldom need them -------------------------------

#: Entries of a few real words, so that rules which name words are met.
REAL = (("τουτο", "οὗτος"), ("ταυτη", "οὗτος"), ("τουτων", "οὗτος"), ("ὅς", "ὅς"))
_REAL = values("re", "form, lemma", REAL)
LEXICON_R = f"{LEXICON.replace('lx AS (', 'lx0 AS (')}, {_REAL}, lx AS (SELECT * FROM lx0 UNION ALL SELECT 'all', form, lemma FROM re)"


def lexicon_with_real(spark: SparkSession, d: str) -> DataFrame:
    return lexicon(spark, d).unionByName(spark.createDataFrame([("all", f, m) for f, m in REAL], "tbl string, form string, lemma string"))


def first_hits(candidates_: str, final: str = "SELECT word, first(lemma ORDER BY r) AS lemma, first(cand ORDER BY r) AS cand FROM h GROUP BY word", sure: str = "") -> str:
    """SQL of the first hit of each word over a relation (word, r, cand); ``sure`` filters hits."""
    return f"h AS (SELECT * FROM ({hits(candidates_, 'word, r')}) h0 {sure}) {final}"


def particle_parts(source: str) -> str:
    return f"""SELECT word, i AS r, head AS cand FROM (SELECT word, i, low[:length(low) - length(p)] AS head, bare[:length(bare) - length(p)] AS base FROM (SELECT word, {LOWER.format('word')} AS low, {BARE.format('word')} AS bare FROM {source}) w0, (VALUES ('περ', 0), ('γε', 4), ('δε', 8)) AS t(p, i) WHERE ends_with(bare, p) AND length(bare) - length(p) >= 2) c0
  UNION ALL SELECT word, 12 + j, CASE j WHEN 0 THEN bare[:length(bare) - 1] ELSE low[:length(low) - 1] END FROM (SELECT word, {LOWER.format('word')} AS low, {BARE.format('word')} AS bare FROM {source}) w1, (VALUES (0), (1)) AS t(j) WHERE ends_with(bare, 'ι') AND length(bare) > 2 AND bare[:length(bare) - 1] IN ({q(*G.DEICTIC)})"""


def particles(source: str) -> str:
    """SQL of words without particles: (word, r, cand), the cut forms, bare ones, and both with a final sigma."""
    cut = f"(SELECT word, i, low[:length(low) - length(p)] AS head, bare[:length(bare) - length(p)] AS base FROM (SELECT word, {LOWER.format('word')} AS low, {BARE.format('word')} AS bare FROM {source}) w0, (VALUES ('περ', 0), ('γε', 4), ('δε', 8)) AS t(p, i) WHERE ends_with(bare, p) AND length(bare) - length(p) >= 2)"
    return f"""{particle_parts(source)} UNION ALL SELECT word, i + 1, base FROM {cut} UNION ALL SELECT word, i + 2, regexp_replace(head, 'σ$', 'ς') FROM {cut} WHERE ends_with(head, 'σ') UNION ALL SELECT word, i + 3, regexp_replace(base, 'σ$', 'ς') FROM {cut} WHERE ends_with(base, 'σ')"""


@query("particle_strip", f"""WITH {LEXICON_R}, {WORDS}, wp AS (SELECT DISTINCT word || p AS word FROM w, (VALUES ('περ'), ('γε'), ('δε')) AS t(p) UNION SELECT unnest([{q(*(x + 'ι' for x in G.DEICTIC), 'ὅσπερ')}])),
c AS ({particles('wp')}), {first_hits('c')}""")
def particle_strip(spark: SparkSession, d: str) -> DataFrame:
    """Forms with each particle added, and demonstratives with a deictic iota, led back to a known form."""
    w = words(spark, d).select(F.explode(F.array(*[F.concat("word", F.lit(p)) for p in G.PARTICLES])).alias("word"))
    w = w.unionByName(spark.createDataFrame([(x + "ι",) for x in G.DEICTIC] + [("ὅσπερ",)], "word string")).distinct()
    return R.rule_hits(w, lexicon_with_real(spark, d), {5: R.particle_candidates}).select("word", "lemma", "cand")


def augments(source: str) -> str:
    """SQL of words without augment or reduplication: (word, r, cand)."""
    pairs, r = [], 1
    for a, originals in G.AUGMENTS:
        for o in originals:
            pairs.append((a, o, r))
            r += 1
    base = f"(SELECT word, {LOWER.format('word')} AS low, {BARE.format('word')} AS bare FROM {source})"
    return f"""SELECT word, 0 AS r, cand FROM (SELECT word, bare, regexp_replace(low, '^.\\pM*', '') AS cand FROM {base} v0) v1 WHERE length(bare) >= 4 AND starts_with(bare, 'ε') AND length(cand) >= 3
  UNION ALL SELECT word, r, o || bare[length(a) + 1:] FROM {base} v2, (VALUES {', '.join(f"('{a}', '{o}', {k})" for a, o, k in pairs)}) AS t(a, o, r) WHERE length(bare) >= 4 AND starts_with(bare, a) AND length(bare) - length(a) >= 3
  UNION ALL SELECT word, {r}, bare[3:] FROM {base} v3 WHERE length(bare) >= 5 AND bare[2] IN ('ε', 'α') AND bare[1] = bare[3] AND regexp_matches(bare, '^\\pL')"""


_PAST = "SELECT DISTINCT word FROM (SELECT unnest(['ἐ' || word, word[1] || 'ε' || word, 'ε' || word, CASE WHEN regexp_matches(word, '^[αε]') THEN 'η' || word[2:] ELSE word END]) AS word FROM w)"


@query("verb_strip", f"WITH {LEXICON}, {WORDS}, wv AS ({_PAST}), c AS ({augments('wv')}), {first_hits('c', sure=f'WHERE NOT {_SELF}')}")
def verb_strip(spark: SparkSession, d: str) -> DataFrame:
    """Forms with an augment or a reduplication put before, led back to a known form that is no lemma of itself."""
    c = F.col("word")
    past = F.array(F.concat(F.lit("ἐ"), c), F.concat(F.substring(c, 1, 1), F.lit("ε"), c), F.concat(F.lit("ε"), c), F.when(c.rlike("^[αε]"), F.concat(F.lit("η"), F.substring(c, F.lit(2), F.length(c)))).otherwise(c))
    w = words(spark, d).select(F.explode(past).alias("word")).distinct()
    return R.rule_hits(w, lexicon(spark, d), {6: R.verb_candidates}).select("word", "lemma", "cand")


def _subscripts(c: str) -> str:
    for a, b in G.IOTA_ADSCRIPT:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def repairs(source: str) -> str:
    """SQL of the light repairs of words: (word, r, cand)."""
    capital = "regexp_matches(word, '^\\p{Lu}')"
    lowered = f"CASE WHEN {capital} THEN {LOWER.format('word[1]')} || word[2:] END"
    case = lambda m: "CASE low[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END || low[2:]"
    tries = [
        "CASE WHEN ends_with(word, 'σ') THEN regexp_replace(word, 'σ$', 'ς') END", f"nullif({_subscripts('word')}, word)", "CASE WHEN contains(word, '-') THEN replace(word, '-', '') END", "lowered",
        f"nullif({_subscripts('lowered')}, word)", "CASE WHEN ends_with(lowered, 'σ') THEN regexp_replace(lowered, 'σ$', 'ς') END", case(G.SMOOTH), case(G.ROUGH),
    ]
    return f"SELECT word, x.r AS r, x.cand AS cand FROM (SELECT word, unnest([{', '.join(f'{{r: {i}, cand: {t}}}' for i, t in enumerate(tries))}]) AS x FROM (SELECT word, {LOWER.format('word')} AS low, {lowered} AS lowered FROM {source}) z0) z1 WHERE length(x.cand) > 0"


_DAMAGED = "SELECT DISTINCT word FROM (SELECT unnest([word, regexp_replace(word, 'ς$', 'σ'), word[:2] || '-' || word[3:], replace(word, 'ῳ', 'ωι'), {bare}]) AS word FROM w)".replace("{bare}", BARE.format("word"))


@query("byzantine_repair", f"WITH {LEXICON}, {WORDS}, wb AS ({_DAMAGED}), c AS ({repairs('wb')}), {first_hits('c')}")
def byzantine_repair(spark: SparkSession, d: str) -> DataFrame:
    """Forms as they are and damaged in ways of old manuscripts, led back by light repairs."""
    c = F.col("word")
    damaged = F.array(c, F.regexp_replace(c, "ς$", "σ"), F.concat(F.substring(c, 1, 2), F.lit("-"), F.substring(c, F.lit(3), F.length(c))), F.replace(c, F.lit("ῳ"), F.lit("ωι")), T.strip_accents(F.lower(c)))
    w = words(spark, d).select(F.explode(damaged).alias("word")).distinct()
    return R.rule_hits(w, lexicon(spark, d), {7: R.byzantine_candidates}).select("word", "lemma", "cand")


_BARE_PREFIXES = [(T._strip(p), i) for i, p in enumerate(G.PREFIXES)]


def prefix_hits(source: str, tag: str = "") -> str:
    """SQL relations up to pf (word, lemma, rank): words whose prefix and base lemma together are a known form."""
    return f"""pc{tag} AS (SELECT word, i AS rank, p AS prefix, bare[length(p) + 1:] AS cand FROM (SELECT word, {BARE.format('word')} AS bare FROM {source}) y0, (VALUES {', '.join(f"('{p}', {i})" for p, i in _BARE_PREFIXES)}) AS t(p, i) WHERE starts_with(bare, p) AND length(bare) > length(p) + 2),
ph{tag} AS ({hits(f'pc{tag}', 'word, rank, prefix')}), pb{tag} AS (SELECT word, rank, prefix || {BARE.format('lemma')} AS cand FROM ph{tag} WHERE {BARE.format('lemma')} <> cand AND length({BARE.format('lemma')}) >= 2),
pw{tag} AS ({hits(f'pb{tag}', 'word, rank')}), pf{tag} AS (SELECT word, first(lemma ORDER BY rank, lemma) AS lemma, min(rank) AS rank FROM pw{tag} GROUP BY word)"""


_PREFIXED = f"lx AS (SELECT * FROM lx0 UNION ALL SELECT DISTINCT 'all', 'κατα' || {BARE.format('text')}, 'κατα' || text FROM lemmas WHERE length(text) > 0)"


@query("prefix_strip", f"WITH {LEXICON.replace('lx AS (', 'lx0 AS (')}, {_PREFIXED}, {WORDS}, wx AS (SELECT DISTINCT p || word AS word FROM w, (VALUES ('κατα'), ('προσ')) AS t(p)), {prefix_hits('wx')} SELECT word, lemma, rank FROM pf")
def prefix_strip(spark: SparkSession, d: str) -> DataFrame:
    """Forms with a prefix, over a lexicon that has each headword with one of the two prefixes."""
    t = table(spark, d, "lemmas").where(F.length("text") > 0)
    made = t.select(F.lit("all").alias("tbl"), F.concat(F.lit("κατα"), T.strip_accents(F.lower("text"))).alias("form"), F.concat(F.lit("κατα"), "text").alias("lemma")).distinct()
    w = words(spark, d).select(F.explode(F.array(*[F.concat(F.lit(p), "word") for p in ("κατα", "προσ")])).alias("word")).distinct()
    return R.prefixed(w, checkpointed(lexicon(spark, d).unionByName(made)))


def _rules() -> str:
    parts = [f"SELECT word, 5 AS step, r, cand, NULL AS prefix FROM ({particles('op')}) x5", f"SELECT word, 6, r, cand, NULL FROM ({augments('op')}) x6", f"SELECT word, 7, r, cand, NULL FROM ({repairs('op')}) x7", f"SELECT word, 9, rank, cand, prefix FROM ({split_parts('op')}) x9"]
    return f"""cr9 AS ({' UNION ALL '.join(parts)}), hr AS ({hits('cr9', 'word, step, r, prefix')}),
kr AS (SELECT *, {BARE.format('lemma')} AS s FROM hr WHERE NOT (step = 6 AND {_SELF})), rl AS (SELECT word, step, first(CASE WHEN step = 9 THEN prefix || s ELSE lemma END ORDER BY r, cand, lemma) AS lemma FROM kr WHERE step <> 9 OR (s <> cand AND length(s) >= 2 AND length(s) <= length(cand) + 2) GROUP BY word, step)"""


LEMMATISED = f"""WITH {LEXICON}, {FREQ}, {WORDS}, {values('cr', 'form, lemma', G.CRASIS.items())}, cw AS (SELECT word, coalesce(a.lemma, b.lemma) AS lemma FROM w LEFT JOIN cr a ON a.form = word LEFT JOIN cr b ON b.form = {MONO.format('word')}), {elided('w')},
cp AS (SELECT word, word AS cand FROM w), hc AS ({hits('cp', 'word')}),
early AS (SELECT word, 0 AS step, word AS lemma FROM w WHERE regexp_full_match(word, '\\p{{Nd}}+') UNION ALL SELECT word, 2, lemma FROM cw WHERE lemma IS NOT NULL UNION ALL SELECT word, 3, first(lemma ORDER BY o, lemma) FROM oe GROUP BY word UNION ALL SELECT word, 4, lemma FROM hc),
op AS (SELECT word FROM w ANTI JOIN early USING (word)), {_rules()}, {prefix_hits('op')},
every AS (SELECT * FROM early UNION ALL SELECT word, step, lemma FROM rl UNION ALL SELECT word, 10, lemma FROM pf UNION ALL SELECT word, 11, word FROM w),
lem AS (SELECT word, first(lemma ORDER BY step, lemma) AS lemma, CASE min(step) """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in R.SOURCES.items()) + " END AS source FROM every GROUP BY word)"


@query("lemmatised", LEMMATISED + " SELECT * FROM lem")
def lemmatised(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct form with its lemma and the step that found it."""
    return R.lemmatised(words(spark, d), lexicon(spark, d), frequencies(spark, d))


@query("respelt")
def respelt(spark: SparkSession, d: str) -> DataFrame:
    """Forms with ω for ο, which only respelling leads back, with the lemma found."""
    w = words(spark, d).where(F.col("word").contains("ο")).select(F.replace("word", F.lit("ο"), F.lit("ω")).alias("word")).where(F.length("word") >= 6)
    return R.heavy_repairs(w, lexicon(spark, d))


@query("strategy_mix", LEMMATISED + " SELECT source, count(*) AS n FROM lem GROUP BY source")
def strategy_mix(spark: SparkSession, d: str) -> DataFrame:
    return lemmatised(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("candidates")
def candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(words(spark, d), lexicon(spark, d), frequencies(spark, d))


# --- parts of speech and conventions ---------------------------------------------------------------------------------

_POS = "CASE pos WHEN 'adj' THEN 'ADJ' WHEN 'verb' THEN 'VERB' ELSE pos END"
_PAIRS_POS = "pp AS (SELECT pair_id, form, lemma, " + _POS + " AS pos, split, source FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0)"


@query("pos_override", f"""WITH {LEXICON}, {_PAIRS_POS}, {WORDS}, c AS (SELECT word, word AS cand FROM w), p AS (SELECT DISTINCT form AS word, pos FROM pp WHERE pos IS NOT NULL),
lxs AS (SELECT 'ag' AS tbl, form, lemma FROM ag), ca AS ({hits('c', 'word', False).replace('JOIN lx', 'JOIN lxs lx')}), lxe AS (SELECT 'el' AS tbl, form, lemma FROM el), cb AS ({hits('c', 'word', False).replace('JOIN lx', 'JOIN lxe lx')}),
cn AS (SELECT word, lemma, min(rank) AS rank FROM (SELECT word, lemma, 1 AS rank FROM ca UNION ALL SELECT word, lemma, 2 FROM cb) t0 GROUP BY ALL),
pt AS (SELECT form, pos, first(lemma ORDER BY {PL._SRC}, pair_id) AS lemma FROM pp WHERE split = 'train' GROUP BY form, pos),
k AS (SELECT word, pos, unnest({KEYS.format('word')}) AS x FROM p), f AS (SELECT k.word, k.pos, first(pt.lemma ORDER BY k.x.v, pt.lemma) AS t FROM k JOIN pt ON pt.form = k.x.key AND pt.pos = k.pos GROUP BY ALL),
j AS (SELECT p.word, p.pos, f.t, cn.lemma, cn.rank, {BARE.format('cn.lemma')} AS s FROM p LEFT JOIN f ON f.word = p.word AND f.pos = p.pos LEFT JOIN cn ON cn.word = p.word),
g AS (SELECT word, pos, t, first(lemma ORDER BY rank, lemma) FILTER (lemma = t) AS same, first(lemma ORDER BY rank, lemma) FILTER (s = {BARE.format('t')}) AS near, first(lemma ORDER BY rank, lemma) FILTER (lemma IS NOT NULL) AS top, count(lemma) AS n, bool_and(s = {BARE.format('word')}) AS own FROM j GROUP BY ALL),
r AS (SELECT *, CASE WHEN same IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'stripped' WHEN t IS NOT NULL AND n = 1 THEN 'sole' WHEN t IS NOT NULL AND own THEN 'self' ELSE 'top' END AS rule FROM g)
SELECT word, pos, CASE rule WHEN 'exact' THEN same WHEN 'stripped' THEN near WHEN 'sole' THEN t WHEN 'self' THEN t ELSE coalesce(top, word) END AS lemma, rule FROM r""")
def pos_override(spark: SparkSession, d: str) -> DataFrame:
    """Forms with their part of speech: the candidates are what the ancient and the modern table have, the table is that of the training pairs."""
    from logothek.operators.lexicon import first_by

    pos = F.when(F.col("pos") == "adj", "ADJ").when(F.col("pos") == "verb", "VERB").otherwise(F.col("pos"))
    p = PL.pairs(spark, d).withColumn("pos", pos)
    src = F.when(F.col("source") == "treebank", 0).when(F.col("source") == "ag", 1).when(F.col("source") == "med", 2).otherwise(3)
    pt = first_by(p.where("split = 'train'"), ["form", "pos"], [src, F.col("pair_id")], ["lemma"])
    ag, el, _ = PL.two(spark, d)
    w = words(spark, d).withColumn("cand", F.col("word"))
    found = lambda t, k: R.looked_up(w, t.select(F.lit("all").alias("tbl"), "form", "lemma"), ["word"], prefer=False).select("word", "lemma", F.lit(k).alias("rank"))
    both = found(ag, 1).unionByName(found(el, 2)).groupBy("word", "lemma").agg(F.min("rank").alias("rank"))
    wp = p.where(F.col("pos").isNotNull()).select(F.col("form").alias("word"), "pos").distinct()
    return R.by_pos(wp, both, pt)


_GROUPS = "m AS (SELECT strip_accents(text) AS g, text AS lemma, min(id) AS ord FROM lemmas WHERE length(text) > 0 GROUP BY ALL), gs AS (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM m)"


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    """(group_id, ord, lemma): headwords that are equal but for marks, in the order of their ids."""
    m = table(spark, d, "lemmas").where(F.length("text") > 0)
    g = m.groupBy(T.strip_accents(F.col("text")).alias("g"), F.col("text").alias("lemma")).agg(F.min("id").alias("ord"))
    return g.withColumn("group_id", F.min("ord").over(Window.partitionBy("g"))).select("group_id", "ord", "lemma")


@query("convention_map", f"""WITH {PL.TABLES}, {_GROUPS}, hw AS (SELECT DISTINCT lemma AS form FROM ag),
p AS (SELECT g, first(lemma ORDER BY (lemma NOT IN (SELECT form FROM hw)), ord) AS preferred FROM gs WHERE k > 1 GROUP BY g) SELECT lemma, preferred FROM gs JOIN p USING (g) WHERE lemma <> preferred""")
def convention_map(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of one headword led to the first that the ancient table has as a lemma, else to the first."""
    return R.convention_map(_spellings(spark, d), PL.two(spark, d)[0].select(F.col("lemma").alias("form")))


_MODERN = " ".join(f"WHEN ends_with({MONO.format('lemma')}, '{a}') THEN {MONO.format('lemma')}[:length({MONO.format('lemma')}) - {len(a)}] || '{b}'" for a, b in G.MODERN_ENDINGS.items())
_MONOTONIC = f"""{PL.TABLES}, {_GROUPS}, nw AS (SELECT DISTINCT lemma, CASE {_MODERN} END AS new FROM ag), hw AS (SELECT lemma AS form FROM el UNION SELECT new FROM nw WHERE new IS NOT NULL AND length(lemma) % 2 = 0),
x AS (SELECT *, CASE WHEN lemma IN (SELECT form FROM hw) THEN 0 WHEN {MONO.format('lemma')} IN (SELECT form FROM hw) THEN 1 ELSE 2 END AS way FROM gs WHERE k > 1),
p AS (SELECT g, first(CASE way WHEN 1 THEN {MONO.format('lemma')} ELSE lemma END ORDER BY way, ord) AS preferred FROM x GROUP BY g),
by_group AS (SELECT lemma, preferred FROM gs JOIN p USING (g) WHERE lemma <> preferred),
cm AS (SELECT * FROM by_group UNION ALL SELECT lemma, new FROM nw WHERE new IN (SELECT form FROM hw) AND new <> {MONO.format('lemma')} AND lemma NOT IN (SELECT lemma FROM by_group))"""


def modern_map(spark: SparkSession, d: str) -> DataFrame:
    ag, el, _ = PL.two(spark, d)
    old = ag.select("lemma").distinct()
    # what the modern language has for ancient lemmas: its own, and, as the words are invented, the changed ones of every other length
    changed = R.convention_map(old.select(F.lit(0).alias("group_id"), F.lit(0).alias("ord"), "lemma").limit(0), _modern(old), ancient=old)
    made = changed.where(F.length("lemma") % 2 == 0).select(F.col("preferred").alias("form"))
    return R.convention_map(_spellings(spark, d), el.select(F.col("lemma").alias("form")).unionByName(made), monotonic=True, ancient=old)


def _modern(lemmas: DataFrame) -> DataFrame:
    """(form): lemmas with each of the modern endings in the place of the ancient one."""
    c = T.monotonic(F.col("lemma"))
    new = F.array(*[F.when(c.endswith(a), F.concat(F.substring(c, F.lit(1), F.length(c) - len(a)), F.lit(b))) for a, b in G.MODERN_ENDINGS.items()])
    return lemmas.select(F.explode(new).alias("form")).dropna().distinct()


@query("convention_modern", f"WITH {_MONOTONIC} SELECT lemma, preferred FROM cm")
def convention_modern(spark: SparkSession, d: str) -> DataFrame:
    """The map of a monotonic convention: groups, then endings that the modern language changes."""
    return modern_map(spark, d)


@query("lemmas_shown", f"WITH {_MONOTONIC} SELECT heads.form AS lemma, {MONO.format('coalesce(cm.preferred, heads.form)')} AS shown FROM heads LEFT JOIN cm ON cm.lemma = heads.form")
def lemmas_shown(spark: SparkSession, d: str) -> DataFrame:
    """All headwords as the monotonic convention shows them."""
    return R.conventional(PL.two(spark, d)[2].select(F.col("form").alias("lemma")), modern_map(spark, d), monotonic=True)


_STEM = BARE.format("lemma[:length(lemma) - 2]")


@query("adjective_headwords", f"""WITH hd AS (SELECT DISTINCT text AS form FROM lemmas WHERE length(text) > 0), aj AS (SELECT {BARE.format('text')} AS k, max(text) AS headword FROM lemmas WHERE pos = 'ADJ' AND length(text) > 0 GROUP BY 1),
l AS (SELECT DISTINCT lemma FROM (SELECT text AS lemma FROM lemmas UNION ALL SELECT regexp_replace(text, '..$', 'ως') FROM lemmas WHERE pos = 'ADJ' UNION ALL SELECT regexp_replace(text, '..$', 'όν') FROM lemmas WHERE pos = 'ADJ') t0 WHERE length(lemma) > 0),
t AS (SELECT lemma, i, {_STEM} || e AS k FROM l, (VALUES {', '.join(f"('ως', {i}, '{e}')" for i, e in enumerate(G.ADVERB_ENDINGS))}, {', '.join(f"('ον', {i}, '{e}')" for i, e in enumerate(G.NEUTER_ENDINGS))}) AS v(kind, i, e) WHERE lemma NOT IN (SELECT form FROM hd) AND CASE kind WHEN 'ως' THEN regexp_matches(lemma, '[ωῶ]ς$') ELSE regexp_matches(lemma, '[οό]ν$') END)
SELECT l.lemma, coalesce(b.headword, l.lemma) AS headword FROM l LEFT JOIN (SELECT t.lemma, first(aj.headword ORDER BY i) AS headword FROM t JOIN aj USING (k) GROUP BY t.lemma) b USING (lemma)""")
def adjective_headwords(spark: SparkSession, d: str) -> DataFrame:
    """Headwords, and the adverbs and neuters of the adjectives among them, led to the headword they are filed under."""
    t = table(spark, d, "lemmas")
    made = F.array(*[F.regexp_replace("text", "..$", e) for e in ("ως", "όν")])
    every = t.select(F.col("text").alias("lemma")).unionByName(t.where("pos = 'ADJ'").select(F.explode(made).alias("lemma"))).where(F.length("lemma") > 0)
    adjectives = t.where("pos = 'ADJ' AND length(text) > 0").select(F.col("text").alias("form"))
    return R.adjective_headwords(every, PL.two(spark, d)[2], adjectives)

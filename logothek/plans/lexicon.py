"""Building and merging the lexicon over ``lookup``, ``lemmas`` and ``lemmapairdataset``, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.functions.tables import MG_ARTICLES
from logothek.operators import lexicon as L
from logothek.plans.registry import query
from logothek.session import table

#: Lower case with the final sigma at the end of words, as Spark has it; the other engine's has none.
LOWER = r"lower(regexp_replace({0}, '(\pL[\pM\pC’''ʼ᾽]*)Σ([\pM\pC’''ʼ᾽]*)($|[^\pL\pM\pC’''ʼ᾽])', '\1ς\2\3', 'g'))"
BARE = f"strip_accents({LOWER})"
STRIP = "translate(strip_accents(lower({})), 'ς', 'σ')"
RANKS = {"grc": 0, "treebank": 1, "el": 2, "med": 3, "grc_corpus": 4, "el_corpus": 5}
RANK_SQL = "CASE src " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items()) + " ELSE 9 END"
LEX = "lex AS (SELECT row_id, form, text AS lemma, src, lang FROM lookup JOIN lemmas ON lemma_id = id WHERE length(form) > 0 AND length(text) > 0)"
SELF = f"(form = {{0}} OR {STRIP.format('form')} = {STRIP.format('{0}')})"
TABLES = f"""{LEX},
ag AS (SELECT form, first(lemma ORDER BY {RANK_SQL}, row_id) AS lemma FROM lex WHERE src IN ('grc', 'treebank', 'grc_corpus') GROUP BY form),
el AS (SELECT form, first(lemma ORDER BY {RANK_SQL}, row_id) AS lemma FROM lex WHERE src IN ('el', 'med', 'el_corpus') GROUP BY form),
heads AS (SELECT DISTINCT text AS form FROM lemmas WHERE length(text) > 0)"""


def rank() -> Column:
    e = F.lit(9)
    for k, v in reversed(RANKS.items()):
        e = F.when(F.col("src") == k, v).otherwise(e)
    return e


def lex(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(table(spark, d, "lookup"), table(spark, d, "lemmas"))


def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The ancient table, the modern one, and the headwords."""
    rows = lex(spark, d)
    ag = L.by_priority(rows.where(F.col("src").isin("grc", "treebank", "grc_corpus")), rank(), keep=["lemma"])
    el = L.by_priority(rows.where(F.col("src").isin("el", "med", "el_corpus")), rank(), keep=["lemma"])
    return ag, el, table(spark, d, "lemmas").where(F.length("text") > 0).select(F.col("text").alias("form")).distinct()


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lemmapairdataset").where("length(form) > 0 AND length(lemma) > 0")


@query("lexicon_entries", f"WITH {LEX} SELECT * FROM lex")
def lexicon_entries(spark: SparkSession, d: str) -> DataFrame:
    return lex(spark, d)


@query("source_priority", f"WITH {LEX} SELECT form, first(lemma ORDER BY {RANK_SQL}, row_id) AS lemma, first(src ORDER BY {RANK_SQL}, row_id) AS src FROM lex GROUP BY form")
def source_priority(spark: SparkSession, d: str) -> DataFrame:
    return L.by_priority(lex(spark, d), rank())


@query("layered_lookup", f"""WITH {LEX}, u AS (SELECT form, lang, first(lemma ORDER BY {RANK_SQL}, row_id) AS lemma FROM lex GROUP BY ALL)
SELECT p.pair_id, coalesce(o.lemma, a.lemma) AS found FROM lemmapairdataset p LEFT JOIN u o ON o.form = p.form AND o.lang = 'grc' LEFT JOIN u a ON a.form = p.form AND a.lang = 'all' WHERE length(p.form) > 0 AND length(p.lemma) > 0""")
def layered_lookup(spark: SparkSession, d: str) -> DataFrame:
    u = L.by_priority(lex(spark, d), rank(), ["form", "lang"], ["lemma"])
    return L.layered(pairs(spark, d).select("pair_id", "form"), u, "grc").select("pair_id", F.col("lemma").alias("found"))


_COMBINED = f"""{TABLES},
j AS (SELECT coalesce(ag.form, el.form) AS form, ag.lemma AS a, el.lemma AS e FROM ag FULL JOIN el ON ag.form = el.form),
c AS (SELECT form, a, CASE WHEN a IS NULL THEN e WHEN e IS NULL THEN a WHEN {SELF.format('a')} AND NOT {SELF.format('e')} THEN CASE WHEN form IN (SELECT form FROM heads) OR a IN (SELECT form FROM heads) THEN a ELSE e END
  WHEN {SELF.format('a')} AND {SELF.format('e')} AND e = form AND a <> form THEN e ELSE a END AS lemma FROM j),
merged AS (SELECT form, lemma, CASE WHEN a IS NULL THEN 'el' WHEN lemma = a THEN 'grc' ELSE 'el' END AS src FROM c)"""


@query("combined_merge", f"WITH {_COMBINED} SELECT * FROM merged")
def combined_merge(spark: SparkSession, d: str) -> DataFrame:
    return L.combined(*two(spark, d))


@query("delta_rows", f"WITH {_COMBINED} SELECT el.form, el.lemma FROM el LEFT JOIN merged m ON m.form = el.form WHERE el.lemma IS DISTINCT FROM m.lemma")
def delta_rows(spark: SparkSession, d: str) -> DataFrame:
    ag, el, heads = two(spark, d)
    return L.deltas(el, L.combined(ag, el, heads))


@query("conflict_free_append", f"""WITH {TABLES}, new AS (SELECT form, min(lemma) AS lemma FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 GROUP BY form)
SELECT * FROM el UNION ALL SELECT n.form, n.lemma FROM new n LEFT JOIN el ON el.form = n.form LEFT JOIN ag ON ag.form = n.form WHERE el.form IS NULL AND (ag.lemma IS NULL OR ag.lemma = n.lemma)""")
def conflict_free_append(spark: SparkSession, d: str) -> DataFrame:
    ag, el, _ = two(spark, d)
    return L.appended_without_conflict(el, ag, pairs(spark, d).groupBy("form").agg(F.min("lemma").alias("lemma")))


@query("headword_lemmas", f"""WITH {TABLES}, p AS (SELECT pair_id, lemma, CASE WHEN regexp_matches(lemma, '^[^\\p{{L}}]*\\p{{Lu}}') THEN lower(lemma[1]) || lemma[2:] END AS low FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0)
SELECT pair_id, CASE WHEN low IN (SELECT form FROM heads) THEN low ELSE lemma END AS lemma FROM p WHERE lemma IN (SELECT form FROM heads) OR low IN (SELECT form FROM heads)""")
def headword_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return L.headword_lemmas(pairs(spark, d).select("pair_id", "lemma"), two(spark, d)[2])


@query("confidence_tiers", f"""WITH {_COMBINED}, pa AS (SELECT DISTINCT form FROM lex WHERE src = 'grc'), pb AS (SELECT DISTINCT form FROM lex WHERE src = 'el')
SELECT m.form, m.lemma, CASE WHEN pa.form IS NOT NULL AND pb.form IS NOT NULL THEN 5 WHEN pa.form IS NOT NULL THEN 4 WHEN pb.form IS NOT NULL THEN 3 WHEN ag.lemma = el.lemma THEN 2 ELSE 1 END AS tier
FROM merged m LEFT JOIN pa ON pa.form = m.form LEFT JOIN pb ON pb.form = m.form LEFT JOIN ag ON ag.form = m.form LEFT JOIN el ON el.form = m.form""")
def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    ag, el, heads = two(spark, d)
    rows = lex(spark, d)
    return L.confidence(L.combined(ag, el, heads), rows.where("src = 'grc'"), rows.where("src = 'el'"), ag, el)


_ARTICLES = ", ".join(f"'{a}'" for a in MG_ARTICLES)


@query("self_maps_resolved", f"""WITH {TABLES}, t AS (SELECT lemma AS form, lemma FROM (SELECT DISTINCT lemma FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0)),
j AS (SELECT t.form, t.lemma, coalesce(ag.lemma, CASE WHEN h.form IS NULL THEN el.lemma END) AS target FROM t LEFT JOIN ag ON ag.form = t.form LEFT JOIN el ON el.form = t.form LEFT JOIN heads h ON h.form = t.form)
SELECT form, CASE WHEN use THEN target ELSE lemma END AS lemma, use AS resolved FROM (SELECT *, lemma = form AND form NOT IN ({_ARTICLES}) AND target IS NOT NULL AND target <> form AS use FROM j)""")
def self_maps_resolved(spark: SparkSession, d: str) -> DataFrame:
    ag, el, heads = two(spark, d)
    t = pairs(spark, d).select(F.col("lemma").alias("form"), "lemma").distinct()
    return L.resolved_self_maps(t, ag.withColumnRenamed("lemma", "target"), el.withColumnRenamed("lemma", "target"), heads)


@query("chains_resolved", f"""WITH RECURSIVE {_COMBINED}, t AS MATERIALIZED (SELECT form, lemma FROM merged),
w AS (SELECT t.form, t.lemma, s.lemma AS target, [t.form, t.lemma] AS seen, coalesce(t.lemma <> t.form AND s.lemma <> t.lemma, FALSE) AS chained, 0 AS depth FROM t LEFT JOIN t s ON s.form = t.lemma
  UNION ALL SELECT w.form, w.lemma, s.lemma, list_append(w.seen, w.target), w.chained, depth + 1 FROM w JOIN t s ON s.form = w.target WHERE w.chained AND s.lemma <> w.target AND NOT list_contains(w.seen, w.target) AND depth < 5),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY form ORDER BY depth DESC) = 1)
SELECT form, CASE WHEN chained THEN target ELSE lemma END AS lemma FROM e WHERE NOT chained OR target IN (SELECT form FROM t WHERE form = lemma)""")
def chains_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The merged lexicon with its chains led on to a headword or dropped."""
    return L.chains_resolved(L.combined(*two(spark, d)).select("form", "lemma"))


@query("spell_index", f"WITH {LEX}, o AS (SELECT form, min(coalesce(src, '')) AS src FROM lex GROUP BY form) SELECT {BARE.format('form')} AS stripped, string_agg(form || '/' || src, '|' ORDER BY form) AS forms FROM o GROUP BY 1")
def spell_index(spark: SparkSession, d: str) -> DataFrame:
    s = L.spell_index(lex(spark, d))
    return s.select("stripped", F.array_join(F.transform("forms", lambda x: F.concat(x["form"], F.lit("/"), x["src"])), "|").alias("forms"))


@query("bridges", f"WITH {LEX} SELECT DISTINCT a.lemma AS el_lemma, b.lemma AS grc_lemma FROM lex a JOIN lex b ON a.form = b.form AND a.lang = 'el' AND b.lang = 'grc' AND a.lemma <> b.lemma")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    return L.bridges(lex(spark, d))


_PAIRS = "p AS (SELECT * FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0)"


@query("majority_lemma", f"WITH {_PAIRS}, n AS (SELECT form, lemma, count(*) AS n FROM p GROUP BY ALL) SELECT form, first(lemma ORDER BY n DESC, lemma) AS lemma, max(n) AS n FROM n GROUP BY form")
def majority_lemma(spark: SparkSession, d: str) -> DataFrame:
    return L.majority(pairs(spark, d), ["form"], "lemma")


@query("ambiguous_forms", f"WITH {_PAIRS}, n AS (SELECT {STRIP.format('form')} AS form, pos, lemma, count(*) AS n FROM p GROUP BY ALL), b AS (SELECT form, pos, first(lemma ORDER BY n DESC, lemma) AS lemma FROM n GROUP BY ALL) SELECT * FROM b SEMI JOIN (SELECT form FROM b GROUP BY form HAVING count(DISTINCT lemma) >= 2) USING (form)")
def ambiguous_forms(spark: SparkSession, d: str) -> DataFrame:
    return L.ambiguous(pairs(spark, d).withColumn("form", T.key(F.col("form"))))


@query("distinct_pairs", f"WITH {_PAIRS} SELECT form, lemma, first(pos ORDER BY pair_id) AS pos, first(source ORDER BY pair_id) AS source FROM p GROUP BY form, lemma")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.first_by(pairs(spark, d), ["form", "lemma"], [F.col("pair_id")], ["pos", "source"])


_SRC = "CASE source WHEN 'treebank' THEN 0 WHEN 'ag' THEN 1 WHEN 'med' THEN 2 ELSE 3 END"


@query("pos_lookup", f"WITH {_PAIRS} SELECT form, pos, first(lemma ORDER BY {_SRC}, pair_id) AS lemma FROM p GROUP BY form, pos")
def pos_lookup(spark: SparkSession, d: str) -> DataFrame:
    src = F.when(F.col("source") == "treebank", 0).when(F.col("source") == "ag", 1).when(F.col("source") == "med", 2).otherwise(3)
    return L.first_by(pairs(spark, d), ["form", "pos"], [src, F.col("pair_id")], ["lemma"])


@query("overridden", f"WITH {TABLES}, o AS (SELECT form, min(lemma) AS lemma FROM lemmapairdataset WHERE length(form) > 0 AND length(lemma) > 0 AND split = 'dev' GROUP BY form) SELECT coalesce(ag.form, o.form) AS form, coalesce(o.lemma, ag.lemma) AS lemma FROM ag FULL JOIN o ON o.form = ag.form")
def overridden(spark: SparkSession, d: str) -> DataFrame:
    return L.overridden(two(spark, d)[0], pairs(spark, d).where("split = 'dev'").groupBy("form").agg(F.min("lemma").alias("lemma")))


@query("tag_counts", f"WITH {_PAIRS} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM p) GROUP BY tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("forms_per_lemma", f"WITH {LEX}, n AS (SELECT lemma, count(DISTINCT form) AS n FROM lex GROUP BY lemma) SELECT count(*) AS n_lemmas, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median FROM n")
def forms_per_lemma(spark: SparkSession, d: str) -> DataFrame:
    n = lex(spark, d).groupBy("lemma").agg(F.count_distinct("form").alias("n"))
    return n.agg(F.count("*").alias("n_lemmas"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"))


@query("productive_lemmas", f"WITH {LEX} SELECT DISTINCT lemma FROM lex WHERE {STRIP.format('form')} <> {STRIP.format('lemma')}")
def productive_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return lex(spark, d).where(T.key(F.col("form")) != T.key(F.col("lemma"))).select("lemma").distinct()


_SORT = BARE.replace("{0}", "replace(text, '-', '')")


@query("headwords_between", f"SELECT text AS headword, {_SORT} AS sort_key FROM (SELECT DISTINCT text FROM lemmas WHERE length(text) > 0) WHERE {_SORT} > 'γ' AND {_SORT} < 'μ'")
def headwords_between(spark: SparkSession, d: str) -> DataFrame:
    """Headwords between two keys, in the order of their keys."""
    h = table(spark, d, "lemmas").where("length(text) > 0").select(F.col("text").alias("headword")).distinct()
    k = h.withColumn("sort_key", T.sort_key(F.col("headword")))
    return k.where((F.col("sort_key") > "γ") & (F.col("sort_key") < "μ")).orderBy("sort_key", "headword")

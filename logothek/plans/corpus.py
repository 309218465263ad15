"""Corpus analytics over ``documents``: frequencies, rankings and n-gram models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.operators import frequency as Q
from logothek.operators import ngram as N
from logothek.plans import lexicon as PL
from logothek.plans.registry import query
from logothek.session import checkpointed, spread, table

LANGS = ["en", "el", "fr", "de", "es"]
GROUPS = {"broadcast": "air", "radio_cc": "air", "webrip": "net", "fansub": "net", "archive": "store", "museum": "store", "dvd_ocr": "store"}
#: Types of the vocabulary and the least count of an n-gram.
VOCAB, LEAST = 80_000, 1

K = "translate(strip_accents(lower({})), 'ς', 'σ')"
TOK = rf"""
tok AS (SELECT doc_id, lang, source, raw, {K.format('raw')} AS k FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+')) AS raw FROM documents))
"""
SENT = rf"""
sent AS (SELECT doc_id, s_no, regexp_extract_all(s, '[\p{{L}}\p{{M}}]+') AS toks FROM (
  SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS s_no FROM (SELECT doc_id, string_split_regex({K.format('text')}, '[.!?;\n]+') AS l FROM documents WHERE text IS NOT NULL)) WHERE len(regexp_extract_all(s, '[\p{{L}}\p{{M}}]+')) > 0),
words AS (SELECT doc_id, s_no, unnest(toks) AS w, generate_subscripts(toks, 1) AS pos FROM sent)
"""
LM = rf"""{SENT},
vocab AS (SELECT w, count(*) AS n FROM words GROUP BY w ORDER BY n DESC, w LIMIT {VOCAB - 4}),
seen AS (SELECT doc_id, s_no, pos, CASE WHEN v.w IS NULL THEN '<UNK>' ELSE words.w END AS w FROM words LEFT JOIN vocab v USING (w)),
frame AS (SELECT doc_id, s_no, pos, w FROM seen UNION ALL SELECT DISTINCT doc_id, s_no, 0, '<s>' FROM seen UNION ALL SELECT doc_id, s_no, max(pos) + 1, '</s>' FROM seen GROUP BY ALL),
g AS (SELECT lag(w, 2) OVER o AS w1, lag(w, 1) OVER o AS w2, w AS w3, doc_id, s_no, pos FROM frame WINDOW o AS (PARTITION BY doc_id, s_no ORDER BY pos)),
uni AS (SELECT w3 AS w1, count(*) AS n FROM g GROUP BY 1),
bi AS (SELECT w2 AS w1, w3 AS w2, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
tri AS (SELECT g.w1, g.w2, g.w3, count(*) AS n FROM g SEMI JOIN (SELECT * FROM bi WHERE n >= 3) b ON b.w1 = g.w1 AND b.w2 = g.w2 WHERE g.w1 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
u AS (SELECT w1 AS w, ln(n / (SELECT sum(n) FROM uni)) AS lp, row_number() OVER (ORDER BY n DESC, w1) AS rank FROM uni WHERE w1 NOT IN ('<PAD>', '<UNK>', '<s>', '</s>') QUALIFY rank <= 10),
b AS (SELECT x.w1, x.w2 AS w, ln(x.n / uni.n) AS lp, x.rank FROM (SELECT *, row_number() OVER (PARTITION BY w1 ORDER BY n DESC, w2) AS rank FROM bi WHERE w2 NOT IN ('<PAD>', '<UNK>', '<s>', '</s>') QUALIFY rank <= 30) x JOIN uni USING (w1)),
t AS (SELECT x.w1, x.w2, x.w3 AS w, ln(x.n / bi.n) AS lp, x.rank FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY n DESC, w3) AS rank FROM tri WHERE w3 NOT IN ('<PAD>', '<UNK>', '<s>', '</s>') QUALIFY rank <= 15) x JOIN bi ON bi.w1 = x.w1 AND bi.w2 = x.w2)
"""
PRED = rf"""{LM},
dev AS (SELECT w1, w2, w3 AS w FROM g WHERE w1 IS NOT NULL AND w3 NOT IN ('<UNK>', '</s>') AND (('0x' || substr(md5('4242:' || doc_id::VARCHAR), 1, 8))::BIGINT % 10000) < 2000),
p AS (SELECT dev.*, CASE WHEN t1.w1 IS NOT NULL THEN 'tri' WHEN b1.w1 IS NOT NULL THEN 'bi' ELSE 'uni' END AS level, b1.w1 IS NOT NULL AS has_b, tt.lp AS lt, bb.lp AS lb, uu.lp AS lu,
  CASE WHEN t1.w1 IS NOT NULL THEN tt.rank WHEN b1.w1 IS NOT NULL THEN bb.rank ELSE uu.rank END AS rank
  FROM dev LEFT JOIN (SELECT DISTINCT w1, w2 FROM t) t1 ON t1.w1 = dev.w1 AND t1.w2 = dev.w2 LEFT JOIN (SELECT DISTINCT w1 FROM b) b1 ON b1.w1 = dev.w2
  LEFT JOIN t tt ON tt.w1 = dev.w1 AND tt.w2 = dev.w2 AND tt.w = dev.w LEFT JOIN b bb ON bb.w1 = dev.w2 AND bb.w = dev.w LEFT JOIN u uu ON uu.w = dev.w)
"""


def toks(spark: SparkSession, d: str) -> DataFrame:
    return Q.tokens(spread(table(spark, d, "documents").select("doc_id", "lang", "source", "text")), "doc_id", "lang", "source").withColumn("k", T.key(F.col("raw")))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """(sent_id, doc_id, toks): sentences of the documents, cut at end signs and line breaks, as keys of words; texts are keyed whole."""
    docs = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    s = docs.select("doc_id", F.posexplode(F.split(T.key(F.col("text")), r"[.!?;\n]+")).alias("s_no", "s"))
    return s.select("doc_id", F.struct("doc_id", "s_no").alias("sent_id"), T.words(F.col("s")).alias("toks")).where(F.size("toks") > 0)


@query("token_freq_by_lang", f"WITH {TOK} SELECT k, count(*) AS total, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in LANGS) + " FROM tok GROUP BY k")
def token_freq_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return Q.pivoted(toks(spark, d), "k", "lang", LANGS)


@query("genre_vector", f"WITH {TOK} SELECT k, CASE " + " ".join(f"WHEN source = '{a}' THEN '{b}'" for a, b in GROUPS.items()) + " ELSE 'other' END AS genre, count(*) AS n FROM tok GROUP BY ALL")
def genre_vector(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(toks(spark, d).withColumn("genre", Q.rolled(F.col("source"), GROUPS)), "k", "genre")


@query("script_share", r"""SELECT doc_id, round(regexp_count / greatest(greek, 1), 6) AS poly_share, latin, greek, (latin > greek AND latin > 3) AS is_metadata FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[\x{1F00}-\x{1FFF}]')) AS regexp_count, len(regexp_extract_all(text, '[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]')) AS greek, len(regexp_extract_all(text, '[A-Za-z]')) AS latin FROM documents WHERE text IS NOT NULL)""")
def script_share(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.round(T.polytonic_share(c), 6).alias("poly_share"), F.regexp_count(c, F.lit("[A-Za-z]")).cast("long").alias("latin"), F.regexp_count(c, F.lit(f"[{T.GREEK_RANGES}]")).cast("long").alias("greek"), T.metadata_line(c).alias("is_metadata"))


@query("token_filters", f"""WITH {TOK} SELECT count(*) AS n_tokens, count(*) FILTER (regexp_full_match(raw, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]+')) AS n_pure_greek, count(*) FILTER (regexp_matches(raw, '[\\x{{0370}}-\\x{{03FF}}\\x{{1F00}}-\\x{{1FFF}}]')) AS n_any_greek,
  count(*) FILTER (regexp_matches(raw, '^[^\\p{{L}}]*\\p{{Lu}}')) AS n_capitalised, count(*) FILTER (length(raw) <= 1 OR regexp_matches(raw, 'https?:|www\\.|[#@0-9A-Za-z]')) AS n_noise, lang FROM tok GROUP BY lang""")
def token_filters(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("raw")
    return toks(spark, d).groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_if(T.pure_greek(c)).alias("n_pure_greek"), F.count_if(T.any_greek(c)).alias("n_any_greek"), F.count_if(T.capitalised(c)).alias("n_capitalised"), F.count_if(T.noise(c)).alias("n_noise"))


@query("hash_split", "SELECT doc_id, (('0x' || substr(md5('4242:' || doc_id::VARCHAR), 1, 8))::BIGINT % 10000) < 200 AS dev FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.hash_dev(F.col("doc_id")).alias("dev"))


RANK = f"WITH {TOK}, f AS (SELECT k AS lemma, translate(lower(replace(raw, 'İ', 'i̇')), 'ς', 'σ') AS lower_form, raw AS form, count(*) AS n FROM tok GROUP BY ALL)"


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(toks(spark, d).select(F.col("k").alias("lemma"), F.col("raw").alias("form")), "lemma", "form")


@query("ranked_forms", RANK + " SELECT lemma, form, n, row_number() OVER (PARTITION BY lemma ORDER BY n DESC, form) AS rank FROM f")
def ranked_forms(spark: SparkSession, d: str) -> DataFrame:
    return Q.ranked(_forms(spark, d))


@query("forms_in_order", RANK + " SELECT lemma, list(form ORDER BY n DESC, form) AS forms FROM f GROUP BY lemma")
def forms_in_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.forms_in_order(_forms(spark, d))


@query("case_dedup", RANK + " SELECT lemma, coalesce(min(form) FILTER (translate(form, 'ς', 'σ') = lower_form), first(form ORDER BY n DESC, form)) AS form, sum(n)::BIGINT AS n FROM f GROUP BY lemma, lower_form")
def case_dedup(spark: SparkSession, d: str) -> DataFrame:
    return Q.case_merged(_forms(spark, d))


@query("clean_form_freq", RANK + " SELECT lower_form AS form, max(n) AS n FROM f GROUP BY lower_form")
def clean_form_freq(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).groupBy(T.fold_sigma(F.lower("form")).alias("form")).agg(F.max("n").alias("n"))


@query("lemma_totals", RANK + " SELECT lemma, sum(n)::BIGINT AS total, count(*) AS n_forms FROM f GROUP BY lemma")
def lemma_totals(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).groupBy("lemma").agg(F.sum("n").alias("total"), F.count("*").alias("n_forms"))


@query("frequent_lemmas", RANK + " SELECT lemma, form, n FROM f SEMI JOIN (SELECT lemma FROM f GROUP BY lemma HAVING max(n) >= 20) g USING (lemma)")
def frequent_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return Q.keep_frequent_lemmas(_forms(spark, d), 20)


@query("frequency_bins", f"WITH {TOK}, c AS (SELECT k, lang, count(*) AS n FROM tok GROUP BY ALL) SELECT CASE WHEN n >= 1000 THEN '1000+' WHEN n >= 100 THEN '100-999' WHEN n >= 10 THEN '10-99' WHEN n >= 1 THEN '1-9' ELSE '0' END AS bin, lang, count(*) AS n_types, sum(n)::BIGINT AS n_tokens, grouping(lang) AS all_langs FROM c GROUP BY GROUPING SETS ((bin, lang), (bin), (lang), ())")
def frequency_bins(spark: SparkSession, d: str) -> DataFrame:
    c = Q.counts(toks(spark, d), "k", "lang").withColumn("bin", Q.frequency_bin(F.col("n")))
    return c.groupingSets([["bin", "lang"], ["bin"], ["lang"], []], "bin", "lang").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"), F.grouping("lang").cast("long").alias("all_langs"))


@query("type_buckets", f"WITH {TOK}, c AS (SELECT k, count(*) AS n FROM tok GROUP BY ALL) SELECT k, n, CASE WHEN n >= 100 THEN 'C' WHEN n >= 10 THEN 'M' WHEN n >= 1 THEN 'R' ELSE 'X' END AS bucket FROM c")
def type_buckets(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(toks(spark, d), "k").withColumn("bucket", Q.bucket(F.col("n")))


@query("fanout", f"WITH {TOK} SELECT k, count(DISTINCT raw) AS n_raw, count(DISTINCT source) AS n_sources, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY k")
def fanout(spark: SparkSession, d: str) -> DataFrame:
    return toks(spark, d).groupBy("k").agg(F.count_distinct("raw").alias("n_raw"), F.count_distinct("source").alias("n_sources"), F.count_distinct("doc_id").alias("n_docs"))


@query("most_common", f"WITH {TOK} SELECT k, count(*) AS n FROM tok GROUP BY k ORDER BY n DESC, k LIMIT 1000")
def most_common(spark: SparkSession, d: str) -> DataFrame:
    return Q.counts(toks(spark, d), "k").orderBy(F.desc("n"), "k").limit(1000)


@query("beyond_most_common", f"WITH {TOK}, c AS (SELECT k, count(*) AS n FROM tok GROUP BY k), t AS (SELECT k FROM c ORDER BY n DESC, k LIMIT 1000) SELECT c.* FROM c ANTI JOIN t USING (k)")
def beyond_most_common(spark: SparkSession, d: str) -> DataFrame:
    """Types outside the 1000 most frequent."""
    c = Q.counts(toks(spark, d), "k")
    return c.join(F.broadcast(c.orderBy(F.desc("n"), "k").limit(1000).select("k")), "k", "left_anti")


@query("merged_counts", f"WITH {TOK}, p AS (SELECT {K.format('w')} AS k, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lemma, '[\\p{{L}}\\p{{M}}]+')) AS w FROM lemmapairdataset) GROUP BY 1) SELECT k, sum(n)::BIGINT AS n FROM (SELECT k, count(*) AS n FROM tok GROUP BY k UNION ALL SELECT * FROM p) GROUP BY k")
def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    pairs = Q.tokens(table(spark, d, "lemmapairdataset"), text="lemma").select(T.key(F.col("raw")).alias("k"))
    return Q.merged(Q.counts(toks(spark, d), "k"), Q.counts(pairs, "k"), by=["k"])


@query("majority_lang", f"WITH {TOK}, c AS (SELECT k, coalesce(lang, '') AS lang, count(*) AS n FROM tok GROUP BY ALL) SELECT k, first(lang ORDER BY n DESC, lang) AS lang, max(n) AS n FROM c GROUP BY k")
def majority_lang(spark: SparkSession, d: str) -> DataFrame:
    return Q.best_by(Q.counts(toks(spark, d).withColumn("lang", F.coalesce("lang", F.lit(""))), "k", "lang"), "k", "lang", "n")


@query("suffix_signatures", f"""WITH {PL.LEX}, f AS (SELECT DISTINCT lemma, form FROM lex),
p AS (SELECT lemma, min(form) AS lo, max(form) AS hi, list(form) AS forms FROM f GROUP BY lemma),
s AS (SELECT lemma, lo[1:coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(length(lo), length(hi)))] AS stem, forms FROM p),
g AS (SELECT lemma, stem, list_aggregate(list_sort(list_transform(forms, lambda x: x[length(stem) + 1:])), 'string_agg', '|') AS signature FROM s),
n AS (SELECT signature, row_number() OVER (ORDER BY count(*) DESC, signature) + 999 AS flag FROM g GROUP BY signature HAVING count(*) >= 2)
SELECT lemma, stem, signature, flag FROM g LEFT JOIN n USING (signature)""")
def suffix_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the paradigms of the lexicon: all its lemmas with all their forms."""
    return Q.suffix_signatures(PL.lex(spark, d).select("lemma", "form"))


# --- n-gram model ----------------------------------------------------------------------------------------------------


def vocabulary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The counts of all types, and the most frequent ones, at most VOCAB rows; both checkpointed."""
    types = checkpointed(N.type_counts(sentences(spark, d)))
    return types, checkpointed(N.vocabulary(types, VOCAB))


def model(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """Vocabulary, unigrams, bigrams and pruned trigrams; the texts are read twice, for the types and for the trigrams."""
    types, vocab = vocabulary(spark, d)
    padded = checkpointed(N.padded_trigrams(sentences(spark, d), vocab))
    uni, bi, tri = N.lower_orders(padded, types, vocab)
    bi = checkpointed(bi.where(F.col("n") >= LEAST))
    return vocab, uni, bi, N.pruned_trigrams(tri, bi, LEAST)


def positions(spark: SparkSession, d: str, vocab: DataFrame) -> DataFrame:
    """Held-out positions with two words before them: a fifth of the documents, by hash."""
    dev = sentences(spark, d).where(T.hash_dev(F.col("doc_id"), 2000))
    return N.known(N.runs(dev, 3), vocab, ["w1", "w2", "w3"]).withColumnRenamed("w3", "w").where(~F.col("w").isin(N.UNK, N.EOS))


@query("lm_bigrams", f"WITH {LM} SELECT * FROM bi")
def lm_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return N.ngrams(sentences(spark, d), vocabulary(spark, d)[1], 2).where(F.col("n") >= LEAST)


@query("lm_trigrams", f"WITH {LM} SELECT * FROM tri")
def lm_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d)[3]


@query("lm_bigram_table", f"WITH {LM} SELECT w1, w, greatest(-32768, least(32767, round_even(lp * 1024, 0)))::INT AS q, rank FROM b")
def lm_bigram_table(spark: SparkSession, d: str) -> DataFrame:
    _, uni, bi, tri = model(spark, d)
    b = N.context_tables(uni, bi, tri)[1]
    return b.select("w1", "w", N.quantised(F.col("lp")).alias("q"), F.col("rank").cast("long").alias("rank"))


@query("lm_trigram_table", f"WITH {LM} SELECT w1, w2, w, round(lp, 6) AS lp, rank FROM t")
def lm_trigram_table(spark: SparkSession, d: str) -> DataFrame:
    _, uni, bi, tri = model(spark, d)
    return N.context_tables(uni, bi, tri)[2].select("w1", "w2", "w", F.round("lp", 6).alias("lp"), F.col("rank").cast("long").alias("rank"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    vocab, uni, bi, tri = model(spark, d)
    uni = checkpointed(uni)
    u, b, t = N.context_tables(uni, bi, tri)
    b, t = checkpointed(b), checkpointed(t)
    return N.backoff_score(N.ranks(positions(spark, d, vocab), u, b, t), b, uni.agg(F.sum("n").alias("total")))


@query("lm_accuracy", f"""WITH {PRED} SELECT level, count(*) AS n, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS top1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS top3, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS top5 FROM p GROUP BY ROLLUP (level)""")
def lm_accuracy(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda k: F.round(F.avg((F.coalesce("rank", F.lit(99)) <= k).cast("int")), 6).alias(f"top{k}")
    return scored(spark, d).rollup("level").agg(F.count("*").alias("n"), hit(1), hit(3), hit(5))


@query("lm_perplexity", f"""WITH {PRED}, sc AS (SELECT CASE WHEN lt IS NOT NULL THEN lt WHEN lb IS NOT NULL THEN lb + (level = 'tri')::INT * ln(0.4) WHEN lu IS NOT NULL THEN lu + ((level = 'tri')::INT + has_b::INT) * ln(0.4) ELSE ln(1.0 / (SELECT sum(n) FROM uni)) + ((level = 'tri')::INT + has_b::INT) * ln(0.4) END AS score FROM p)
SELECT count(*) AS n, round(avg(score), 5) AS mean_score, round(exp(-avg(score)), 2) AS perplexity FROM sc""")
def lm_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_score"), F.round(F.exp(-F.avg("score")), 2).alias("perplexity"))


@query("oov_share", f"WITH {LM} SELECT count(*) AS n_tokens, count(*) FILTER (w = '<UNK>') AS n_unknown, round(count(*) FILTER (w = '<UNK>') / count(*), 6) AS oov_share FROM seen")
def oov_share(spark: SparkSession, d: str) -> DataFrame:
    types, vocab = vocabulary(spark, d)
    sum_ = lambda name: F.coalesce(F.sum("n"), F.lit(0)).alias(name)
    n = types.agg(sum_("n_tokens")).crossJoin(vocab.agg(sum_("_in"))).withColumn("n_unknown", F.col("n_tokens") - F.col("_in"))
    return n.select("n_tokens", "n_unknown", F.round(F.try_divide("n_unknown", "n_tokens"), 6).alias("oov_share"))


@query("chunks", rf"WITH {SENT} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s_no, pos) - 1) // 200 AS chunk, w FROM words")
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document in chunks of 200; no sentence ends within a word, so the words of the text are those of its sentences."""
    w = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.posexplode(T.words(T.key(F.col("text")))).alias("pos", "w"))
    return w.select("doc_id", F.floor(F.col("pos") / 200).alias("chunk"), "w")

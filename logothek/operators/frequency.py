"""Token counts and what is ranked by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.operators import order


def tokens(documents: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., raw): one row for each word of each text; null and empty texts have none."""
    return documents.select(*keep, F.explode(T.words(F.col(text))).alias("raw"))


def counts(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def pivoted(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Counts of a key in all and by each of a list of values, in one pass: (key, total, n_value...)."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def rolled(c: Column, groups: dict[str, str], default: str = "other") -> Column:
    """A value's group by a literal map, ``default`` if it has none."""
    pairs = [x for k, v in groups.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def merged(*parts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Counts of several corpora added up."""
    out = parts[0].select(*by, n)
    for p in parts[1:]:
        out = out.unionByName(p.select(*by, n))
    return out.groupBy(*by).agg(F.sum(n).alias(n))


def case_merged(forms: DataFrame, lemma: str = "lemma", form: str = "form", n: str = "n") -> DataFrame:
    """Case variants of a lemma's form as one: the lower-case one if attested, else the most frequent (ties: smallest)."""
    low = T.fold_sigma(F.lower(form))
    own = F.min(F.when(T.fold_sigma(F.col(form)) == low, F.col(form))).alias("_low")
    best = F.min(F.struct((-F.col(n)).alias("a"), F.col(form).alias("b"))).alias("_best")
    g = forms.groupBy(lemma, low.alias("_key")).agg(own, F.sum(n).alias(n), best)
    return g.select(lemma, F.coalesce("_low", "_best.b").alias(form), n)


def ranked(forms: DataFrame, lemma: str = "lemma", form: str = "form", n: str = "n") -> DataFrame:
    """Forms of each lemma with their rank: most frequent first, then by form; a lemma of any size is spread over tasks."""
    placed = order.ranked(forms.withColumn("_less", -F.col(n)), lemma, ["_less", form])
    return placed.withColumn("rank", F.col("rank") + 1).drop("_less")


def forms_in_order(forms: DataFrame, lemma: str = "lemma", form: str = "form", n: str = "n") -> DataFrame:
    """(lemma, forms): each lemma's forms as an array, in the order of ``ranked``."""
    sorted_ = F.sort_array(F.collect_list(F.struct((-F.col(n)).alias("a"), F.col(form).alias("b"))))
    return forms.groupBy(lemma).agg(F.transform(sorted_, lambda x: x["b"]).alias("forms"))


def best_by(rows: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """The value of greatest score for each key; ties go to the smallest value."""
    return rows.groupBy(key).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v"))).alias("m")).select(key, F.col("m.v").alias(value), (-F.col("m.s")).alias(score))


def frequency_bin(n: Column) -> Column:
    return F.when(n >= 1000, "1000+").when(n >= 100, "100-999").when(n >= 10, "10-99").when(n >= 1, "1-9").otherwise("0")


def bucket(n: Column, common: int = 100, medium: int = 10, rare: int = 1) -> Column:
    return F.when(n >= common, "C").when(n >= medium, "M").when(n >= rare, "R").otherwise("X")


def with_counts(rows: DataFrame, freq: DataFrame, form: str = "form") -> DataFrame:
    """Counts looked up by the form, else its lower case, else its stripped key; 0 if none has one.

    freq: (tok, n) unique by tok. One join on the exploded keys instead of three.
    """
    f, i = F.col(form), F.monotonically_increasing_id()
    keyed = rows.withColumn("_i", i)
    tries = keyed.select("_i", F.posexplode(F.array_distinct(F.array(f, F.lower(f), T.key(f)))).alias("_r", "tok"))
    hits = tries.join(freq.select("tok", "n"), "tok").groupBy("_i").agg(F.min_by("n", "_r").alias("n"))
    return keyed.join(hits, "_i", "left").drop("_i").withColumn("n", F.coalesce("n", F.lit(0)))


def keep_frequent_lemmas(forms: DataFrame, least: int, lemma: str = "lemma", n: str = "n") -> DataFrame:
    """All forms of the lemmas of which at least one form has ``least`` occurrences; by semi-join, so no lemma is gathered."""
    good = forms.groupBy(lemma).agg(F.max(n).alias("_m")).where(F.col("_m") >= least)
    return forms.join(good, lemma, "left_semi")


def common_prefix(column: Column) -> list[Column]:
    """Aggregates from which the longest common prefix of a group comes: the prefix of all is that of least and greatest."""
    return [F.min(column).alias("_lo"), F.max(column).alias("_hi")]


def prefix_of(lo: str = "_lo", hi: str = "_hi") -> Column:
    n = F.least(F.length(lo), F.length(hi))
    first_off = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col(lo), i, F.lit(1)) == F.substring(F.col(hi), i, F.lit(1))), False)
    return F.when(n == 0, "").otherwise(F.substring(F.col(lo), F.lit(1), F.when(first_off == 0, n).otherwise(first_off.cast("int") - 1)))


def suffix_signatures(forms: DataFrame, lemma: str = "lemma", form: str = "form", first_flag: int = 1000) -> DataFrame:
    """(lemma, stem, signature, flag): lemmas by the sorted set of what follows their forms' common prefix.

    Signatures of two or more lemmas are numbered from ``first_flag``, most lemmas first, then by signature; others get
    null. A lemma's forms are made distinct and gathered in parts by hash before they meet in its row, so a lemma with a
    large share of the rows is worked on by several tasks.
    """
    part = F.pmod(F.xxhash64(form), F.lit(64))
    parts = forms.select(lemma, form).distinct().groupBy(lemma, part.alias("_part")).agg(*common_prefix(F.col(form)), F.collect_list(form).alias("_f"))
    stems = parts.groupBy(lemma).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.flatten(F.collect_list("_f")).alias("_f")).withColumn("stem", prefix_of())
    sig = F.concat_ws("|", F.array_sort(F.transform("_f", lambda x: F.substring(x, F.length("stem") + 1, F.length(x)))))
    rows = stems.select(lemma, "stem", sig.alias("signature"))
    shared = rows.groupBy("signature").agg(F.count("*").alias("k")).where("k >= 2")
    placed = order.ranked(shared.select("signature", (-F.col("k")).alias("_less")), None, ["_less", "signature"])
    flags = placed.select("signature", (F.col("rank") + first_flag).alias("flag"))
    return rows.join(flags, "signature", "left").select(lemma, "stem", "signature", "flag")


def attested_forms(forms: DataFrame, freq: DataFrame, least: int = 1, acute_least: int | None = None) -> DataFrame:
    """Forms (form, lemma) of the lemmas of which any form, or the lemma itself, has ``least`` occurrences.

    acute_least: forms without any polytonic mark need so many themselves. freq: (tok, n).
    """
    own = with_counts(forms.select("form", "lemma").distinct(), freq).withColumnRenamed("n", "_n")
    heads = with_counts(forms.select(F.col("lemma").alias("form")).distinct(), freq).select(F.col("form").alias("lemma"), "n")
    best = own.groupBy("lemma").agg(F.max("_n").alias("_m")).join(heads, "lemma").where(F.greatest("_m", "n") >= least).select("lemma")
    kept = own.join(best, "lemma", "left_semi")
    if acute_least is not None:
        kept = kept.where(T.has_polytonic(F.col("form")) | (F.col("_n") >= acute_least))
    return kept.select("form", "lemma")


def summed_vectors(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Two tables of count vectors of one length by key as one: summed where both have the key."""
    j = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key, "full")
    both = F.zip_with("_a", "_b", lambda x, y: x + y)
    return j.select(key, F.coalesce(both, "_a", "_b").alias(vector))


def spelling_variants(forms: DataFrame, least: int = 3) -> DataFrame:
    """(mono, form, n, rank): the polytonic spellings of each monotonic form with ``least`` occurrences, most frequent first. forms: (form, n)."""
    rows = forms.where(F.col("n") >= least).select(T.monotonic(F.col("form")).alias("mono"), "form", "n")
    return ranked(rows, lemma="mono")


def hash_sample(rows: DataFrame, key: str, size: int, seed: str = "") -> DataFrame:
    """``size`` rows by the order of the MD5 of their key, or all if they are fewer: the same rows on every engine and at every layout. Keys are distinct."""
    hashed = rows.withColumn("_md5", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    return order.ranked(hashed, None, ["_md5", key]).where(F.col("rank") < size).drop("_md5", "rank")


# Copies of training pairs beyond the first by tense.
EXTRA_COPIES = {"aorist": 2, "perfect": 2, "future-perfect": 2, "pluperfect": 4, "future": 2, "imperfect": 1}


def copies_by_tense(pos: Column, tags: Column) -> Column:
    """How often a training pair is used: verbs of rare tenses more often, by the sum of what their tags add; the two perfects add once."""
    has = lambda *t: F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, t))), F.lit(False))
    extra = F.lit(0)
    for group in (("aorist",), ("perfect", "future-perfect"), ("pluperfect",), ("future",), ("imperfect",)):
        extra = extra + F.when(has(*group), EXTRA_COPIES[group[0]]).otherwise(0)
    return F.lit(1) + F.when(pos == "verb", extra).otherwise(0)


def training_mix(pairs: DataFrame, most: int, seed: str = "") -> DataFrame:
    """(pair_id, copy_no, pool): all pairs of other varieties, and what is left of ``most`` in halves of the ancient and the modern pool.

    pairs: (pair_id, form, lemma, pos, tags, pool), pool ``variety``, ``modern`` or ``ancient``. Of equal (form, lemma) the first
    by pool in this order, then by id, counts. Ancient verbs of rare tenses are repeated before the pool is cut, by hash.
    """
    o = F.when(F.col("pool") == "variety", 0).when(F.col("pool") == "modern", 1).otherwise(2)
    first = pairs.groupBy("form", "lemma").agg(F.min(F.struct(o.alias("o"), "pair_id", "pool", "pos", "tags")).alias("m")).select("m.*")
    copies = F.when(F.col("pool") == "ancient", copies_by_tense(F.col("pos"), F.col("tags"))).otherwise(1)
    rows = first.select("pair_id", "pool", F.explode(F.sequence(F.lit(1), copies)).alias("copy_no"))
    rows = rows.withColumn("_key", F.concat_ws(":", "pair_id", "copy_no"))
    n = rows.groupBy("pool").agg(F.count("*").alias("n"))
    size = {r.pool: r.n for r in n.collect()}
    if sum(size.values()) <= most:
        return rows.select("pair_id", "copy_no", "pool")
    rest = max(0, most - size.get("variety", 0))
    part = lambda pool, k: hash_sample(rows.where(F.col("pool") == pool), "_key", k, seed)
    return rows.where("pool = 'variety'").unionByName(part("ancient", rest // 2)).unionByName(part("modern", rest - rest // 2)).select("pair_id", "copy_no", "pool")

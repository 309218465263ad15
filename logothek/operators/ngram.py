"""N-gram language models: vocabulary, counts, pruned context tables, prediction and scoring.

N-grams are taken within the arrays of framed sentences and their words looked up in the vocabulary, which is broadcast
and bounded by its size, as they are emitted: sentences are never put back together, and the only shuffle is that of the
counts, combined before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, EOS, UNK, PAD = "<s>", "</s>", "<UNK>", "<PAD>"
RESERVED = (PAD, UNK, BOS, EOS)
ALPHA = 0.4


def framed(toks: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), toks, F.array(F.lit(EOS)))


def type_counts(sentences: DataFrame) -> DataFrame:
    """(tok, n): how often each type occurs."""
    return sentences.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def vocabulary(types: DataFrame, size: int) -> DataFrame:
    """(tok, n): the ``size`` - 4 most frequent types; ties by type."""
    return types.orderBy(F.desc("n"), "tok").limit(size - len(RESERVED))


def known(rows: DataFrame, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` whose words outside the vocabulary (tok), bounded by its size and broadcast, are <UNK>; frames stay."""
    v = F.broadcast(vocab.select("tok"))
    for c in columns:
        rows = rows.join(v.withColumnRenamed("tok", "_tok"), F.col(c) == F.col("_tok"), "left")
        rows = rows.withColumn(c, F.when(F.col(c).isin(BOS, EOS, PAD) | F.col("_tok").isNotNull(), F.col(c)).otherwise(UNK)).drop("_tok")
    return rows


def _runs(framed_: Column, n: int) -> Column:
    """All runs of n successive elements of an array of at least n, as structs w1..wn: shifted copies of the array side by side."""
    size = F.size(framed_) - (n - 1)
    return F.arrays_zip(*[F.slice(framed_, k + 1, size).alias(f"w{k + 1}") for k in range(n)])


def runs(sentences: DataFrame, n: int) -> DataFrame:
    """(w1..wn): every run of n successive tokens of framed sentences."""
    f = F.col("_f")
    return sentences.select(framed(F.col("toks")).alias("_f")).where(F.size(f) >= n).select(F.explode(_runs(f, n)).alias("g")).select("g.*")


def ngrams(sentences: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """(w1..wn, n): counts of n successive tokens within framed sentences."""
    names = [f"w{k + 1}" for k in range(n)]
    return known(runs(sentences, n), vocab, names).groupBy(*names).agg(F.count("*").alias("n"))


def padded_trigrams(sentences: DataFrame, vocab: DataFrame) -> DataFrame:
    """(w1, w2, w3, n) with a pad after each sentence, so that every bigram begins one trigram: both orders from one pass."""
    names = ["w1", "w2", "w3"]
    rows = sentences.select(F.concat(framed(F.col("toks")), F.array(F.lit(PAD))).alias("_f")).select(F.explode(_runs(F.col("_f"), 3)).alias("g")).select("g.*")
    return known(rows, vocab, names).groupBy(*names).agg(F.count("*").alias("n"))


def lower_orders(padded: DataFrame, types: DataFrame, vocab: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unigrams, bigrams and trigrams (w1.., n) of padded trigrams and the counts of types; no text is read again."""
    bi = padded.groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    sentences = padded.where(F.col("w1") == BOS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    seen = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).crossJoin(vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in")))
    frame = sentences.select(F.explode(F.array(F.lit(BOS), F.lit(EOS))).alias("w1"), "n")
    uni = vocab.select(F.col("tok").alias("w1"), "n").unionByName(frame).unionByName(seen.select(F.lit(UNK).alias("w1"), (F.col("all") - F.col("in")).alias("n"))).where("n > 0")
    return uni, bi, padded.where(F.col("w3") != PAD)


def pruned_trigrams(tri: DataFrame, bi: DataFrame, least: int = 2, least_bigram: int = 3) -> DataFrame:
    """Trigrams of ``least`` occurrences whose first two words are a kept bigram of ``least_bigram``."""
    return tri.where(F.col("n") >= least).join(bi.where(F.col("n") >= least_bigram).select("w1", "w2"), ["w1", "w2"], "left_semi")


def top(rows: DataFrame, context: list[str], word: str, k: int) -> DataFrame:
    """The k most frequent continuations of each context, ties by word; two rounds spread a hot context over tasks first."""
    spread = Window.partitionBy(*context, F.pmod(F.xxhash64(word), F.lit(64))).orderBy(F.desc("n"), F.asc(word))
    whole = Window.partitionBy(*context).orderBy(F.desc("n"), F.asc(word))
    first = rows.withColumn("_r", F.row_number().over(spread)).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).drop("_r")


def context_tables(uni: DataFrame, bi: DataFrame, tri: DataFrame, k_uni: int = 10, k_bi: int = 30, k_tri: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of continuations with log-probabilities: (w, lp, rank), (w1, w, lp, rank), (w1, w2, w, lp, rank).

    Bigrams are divided by the count of w1, trigrams by that of their bigram. Reserved tokens are no continuations but
    stay in the denominators.
    """
    real = lambda c: ~F.col(c).isin(*RESERVED)
    total = uni.agg(F.sum("n").alias("total"))
    u = uni.select(F.col("w1").alias("w"), "n").where(real("w")).orderBy(F.desc("n"), "w").limit(k_uni).crossJoin(F.broadcast(total))
    u = u.select("w", F.log(F.col("n") / F.col("total")).alias("lp"), F.row_number().over(Window.orderBy(F.desc("n"), "w")).alias("rank"))
    b = top(bi.where(real("w2")), ["w1"], "w2", k_bi).join(uni.select("w1", F.col("n").alias("d")), "w1")
    b = b.select("w1", F.col("w2").alias("w"), F.log(F.col("n") / F.col("d")).alias("lp"), "rank")
    t = top(tri.where(real("w3")), ["w1", "w2"], "w3", k_tri).join(bi.select("w1", "w2", F.col("n").alias("d")), ["w1", "w2"])
    t = t.select("w1", "w2", F.col("w3").alias("w"), F.log(F.col("n") / F.col("d")).alias("lp"), "rank")
    return u, b, t


def quantised(lp: Column) -> Column:
    """Fixed-point log-probability in 1/1024, half to even, within 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(lp * 1024))).cast("int")


def predict(positions: DataFrame, b: DataFrame, t: DataFrame) -> DataFrame:
    """``positions`` (w1, w2, w, ...) with the level that has continuations (tri, bi, uni) for its context."""
    tri = t.select("w1", "w2").distinct().withColumn("_t", F.lit(True))
    bi = b.select(F.col("w1").alias("w2")).distinct().withColumn("_b", F.lit(True))
    return positions.join(tri, ["w1", "w2"], "left").join(bi, "w2", "left").withColumn("level", F.when(F.col("_t"), "tri").when(F.col("_b"), "bi").otherwise("uni")).drop("_t", "_b")


def ranks(positions: DataFrame, u: DataFrame, b: DataFrame, t: DataFrame) -> DataFrame:
    """Positions with the level used and the rank of the true word among its suggestions (null: not suggested)."""
    p = predict(positions, b, t)
    p = p.join(t.select("w1", "w2", "w", F.col("rank").alias("_rt"), F.col("lp").alias("_lt")), ["w1", "w2", "w"], "left")
    p = p.join(b.select(F.col("w1").alias("w2"), "w", F.col("rank").alias("_rb"), F.col("lp").alias("_lb")), ["w2", "w"], "left")
    p = p.join(F.broadcast(u.select("w", F.col("rank").alias("_ru"), F.col("lp").alias("_lu"))), "w", "left")
    return p.withColumn("rank", F.when(F.col("level") == "tri", F.col("_rt")).when(F.col("level") == "bi", F.col("_rb")).otherwise(F.col("_ru")))


def backoff_score(ranked: DataFrame, bi_contexts: DataFrame, total: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Stupid-backoff score of each position of ``ranks``: a level costs ln(alpha) only if it had entries but missed the word."""
    has_bi = bi_contexts.select(F.col("w1").alias("w2")).distinct().withColumn("_hb", F.lit(True))
    p = ranked.join(has_bi, "w2", "left").crossJoin(F.broadcast(total.select("total")))
    step = math.log(alpha)
    d1 = F.when(F.col("level") == "tri", 1).otherwise(0)
    d2 = d1 + F.when(F.col("_hb"), 1).otherwise(0)
    score = F.when(F.col("_lt").isNotNull(), F.col("_lt")).when(F.col("_lb").isNotNull(), F.col("_lb") + d1 * step).when(F.col("_lu").isNotNull(), F.col("_lu") + d2 * step)
    return p.withColumn("score", F.coalesce(score, F.log(F.lit(1.0) / F.col("total")) + d2 * step)).drop("_hb", "total")

"""Resolving words to lemmas: candidates with their step and rank in one relation, a join with the lexicon, the least wins.

Words are made distinct first. Lookup and elision come first; rules, splits and prefixes are tried only for the words they
miss, the rules and splits by one join together, prefixes by two. Null and empty words resolve to themselves, as do words no
step can place.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logothek.functions import tables as G
from logothek.functions import text as T
from logothek.session import checkpointed

#: Composed letters that only polytonic writing has, as a class of a pattern.
POLYTONIC = "".join(chr(c) for a, b in ((0x370, 0x400), (0x1F00, 0x2000)) for c in range(a, b) if set(ud.normalize("NFD", chr(c))) & set(T.DROPPED + T.MADE_ACUTE)) + T.DROPPED + T.MADE_ACUTE


def lookup_table(pairs: dict[str, str], c: Column) -> Column:
    """A value of a literal map, null if there is none."""
    flat = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*flat), c)



def keyed(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep..., column, v, form): the different keys that a string is looked up by, numbered in order; null strings have none.

    As it is, in lower case, with acutes for graves, both, monotonic, without marks. The last two (4 and 5) don't count in a
    lookup if they are of one or two letters and map to themselves. Each key is computed once, then those that differ from all
    before become rows, within code generation.
    """
    c = F.col(column)
    k = rows.select(*keep, *([] if column in keep else [column]), F.lower(c).alias("_1"), T.grave_to_acute(c).alias("_2"))
    k = k.select("*", F.lower("_2").alias("_3"), T.monotonic(F.col("_1")).alias("_4"), T.strip_accents(F.col("_1")).alias("_5"))
    names = [column, "_1", "_2", "_3", "_4", "_5"]
    options = []
    for i, name in enumerate(names):
        new = F.col(name).isNotNull()
        for before in names[:i]:
            new = new & (F.col(name) != F.col(before))
        options.append(F.when(new, F.struct(F.lit(i).alias("v"), F.col(name).alias("form"))))
    x = k.select(*keep, *([] if column in keep else [column]), F.explode(F.array(*options)).alias("_x")).where("_x IS NOT NULL")
    return x.select(*keep, *([] if column in keep else [column]), "_x.v", "_x.form")


def looked_up(candidates: DataFrame, lexicon: DataFrame, keep: list[str], prefer: bool = True, guard: bool = True) -> DataFrame:
    """Each candidate's first hit: (keep..., cand, lemma, tbl, v); candidates without one are left out.

    candidates: (keep..., cand). lexicon: (tbl, form, lemma) with ``ag`` and ``all`` unique by form. With ``prefer``,
    polytonic candidates are tried in ``ag`` first.
    """
    k = keyed(candidates, "cand", keep)
    order = F.when((F.col("tbl") == "ag") & F.col("cand").rlike(f"[{POLYTONIC}]"), 0).when(F.col("tbl") == "all", 1)
    hits = k.join(lexicon, "form").withColumn("_t", order if prefer else F.lit(1)).where("_t IS NOT NULL")
    if guard:
        hits = hits.where(~((F.col("v") >= 4) & (F.length("form") <= 2) & (F.col("form") == F.col("lemma"))))
    best = hits.groupBy(*keep, "cand").agg(F.min(F.struct("_t", "v", "lemma", "tbl")).alias("m"))
    return best.select(*keep, "cand", "m.lemma", "m.tbl", "m.v")


def cascade(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, lemma, via): exact, lower, acute, monotonic or stripped hit of each distinct word, null if there is none."""
    w = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct()
    found = looked_up(w.withColumn("cand", F.col("word")), lexicon, ["word"])
    via = F.element_at(F.array(*map(F.lit, ("exact", "lower", "acute", "acute", "mono", "stripped"))), F.col("v") + 1)
    return w.join(found.select("word", "lemma", via.alias("via")), "word", "left")


def closed_class(c: Column, modern: bool = False) -> Column:
    """The lemma of articles and pronouns, of modern ones if asked; null for other words."""
    low = F.lower(c)
    forms = [c, low, T.monotonic(c), T.monotonic(low)]
    article = F.lit(False)
    for f in forms:
        article = article | f.isin(*G.ARTICLES)
    article = F.when(article, G.ARTICLE)
    if modern:
        return F.coalesce(F.when(low.isin(*G.MG_ARTICLES), "ο"), lookup_table(G.MG_CLOSED, low), article)
    return F.coalesce(article, lookup_table(G.PRONOUNS, c), lookup_table(G.PRONOUNS, T.monotonic(c)))


def crasis(c: Column) -> Column:
    return F.coalesce(lookup_table(G.CRASIS, c), lookup_table(G.CRASIS, T.monotonic(c)))


def elision_stem(c: Column) -> Column:
    """The word without a mark of elision at its end, null if it has none or nothing is left; a breathing on a vowel is none."""
    marks = "".join(G.ELISION_MARKS)
    return F.when(c.rlike(f"^.+[{marks}]$"), F.regexp_replace(c, f"[{marks}]$", ""))


def elision_candidates(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem, cand, vowel, vrank): the stem, also with its last consonant de-assimilated, and each vowel."""
    vowels = [(v, G.VOWEL_RANK.index(v)) for v in G.VOWELS] + [(G.ACCENTED[v], G.VOWEL_RANK.index(v)) for v in G.VOWELS]
    stem = F.col("stem")
    last = F.expr("right(stem, 1)")
    other = F.when(last.isin(*G.DEASSIMILATED), F.concat(F.expr("substring(stem, 1, length(stem) - 1)"), lookup_table(G.DEASSIMILATED, last)))
    stems = F.filter(F.array(stem, other), lambda x: x.isNotNull())
    w = words.select(F.col(word).alias("word")).distinct().withColumn("stem", elision_stem(F.col("word"))).where(F.length("stem") > 0)
    pick = F.array(*[F.struct(F.lit(v).alias("vowel"), F.lit(r).alias("vrank")) for v, r in vowels])
    return w.select("word", "stem", F.explode(stems).alias("s")).select("word", "stem", "s", F.explode(pick).alias("p")).select("word", "stem", F.concat("s", "p.vowel").alias("cand"), "p.vowel", "p.vrank")


def elisions(words: DataFrame, lexicon: DataFrame, freq: DataFrame, word: str = "word") -> DataFrame:
    """(word, cand, lemma, rank): all lemmas an elided word may stand for, function words first, then common nouns, by frequency.

    freq: (key, n) by stripped key. Of several candidates with one lemma the first by vowel counts.
    """
    c = elision_candidates(words, word)
    hits = looked_up(c.select("word", "stem", "cand", "vrank", "vowel"), lexicon.where("tbl = 'ag'"), ["word", "stem", "vrank", "vowel"], prefer=False, guard=False)
    hits = hits.join(freq.select(F.col("key").alias("_k"), "n"), T.key(F.col("lemma")) == F.col("_k"), "left")
    function = F.when(T.strip_accents(F.lower("stem")).isin(*G.ELISION_STEMS) & F.col("lemma").isin(*G.FUNCTION_LEMMAS), 0).otherwise(1)
    order = F.struct(function.alias("a"), F.col("lemma").rlike(r"^\p{Lu}").cast("int").alias("b"), (-F.coalesce("n", F.lit(0))).alias("c"), F.col("vrank").alias("d"), F.length("lemma").alias("e"), F.col("cand").alias("f"))
    one = hits.groupBy("word", "lemma").agg(F.min(order).alias("o"))
    ordered = one.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("o", "lemma"))).alias("all"))  # at most 28 candidates a word
    return ordered.select("word", F.posexplode("all").alias("rank", "x")).select("word", F.col("x.o.f").alias("cand"), F.col("x.lemma").alias("lemma"), (F.col("rank") + 1).alias("rank"))


def _candidate(step: int, rank: Column | int, cand: Column, when: Column, not_self: bool = False, length: int = 1) -> Column:
    ok = when & (F.length(cand) >= length)
    return F.when(ok, F.struct(F.lit(step).alias("step"), (F.lit(rank) if isinstance(rank, int) else rank).cast("int").alias("r"), cand.alias("cand"), F.lit(not_self).alias("not_self")))


def particle_candidates(c: Column, low: Column, bare: Column, step: int = 5) -> list[Column]:
    """Words without an enclitic particle, and demonstratives without a deictic iota."""
    out, n = [], 0
    final = lambda x: F.regexp_replace(x, "σ$", "ς")
    for p in G.PARTICLES:
        base = F.substring(bare, F.lit(1), F.length(bare) - len(p))
        head = F.substring(low, F.lit(1), F.length(low) - len(p))
        ok = bare.endswith(p) & (F.length(base) >= 2)
        other = ok & (base != head)
        for x, when in ((head, ok), (base, other), (final(head), ok & head.endswith("σ")), (final(base), other & base.endswith("σ"))):
            out.append(_candidate(step, n, x, when))
            n += 1
    base, cut = F.substring(bare, F.lit(1), F.length(bare) - 1), F.substring(low, F.lit(1), F.length(low) - 1)
    ok = bare.endswith("ι") & (F.length(bare) > 2) & base.isin(*G.DEICTIC)
    out += [_candidate(step, n, base, ok), _candidate(step, n + 1, cut, ok & (cut != base))]
    return out


def verb_candidates(c: Column, low: Column, bare: Column, step: int = 6) -> list[Column]:
    """Words of four letters or more without syllabic or temporal augment or reduplication; hits that map to themselves don't count."""
    enough = F.length(bare) >= 4
    rest = F.regexp_replace(low, r"^.\p{Mn}*", "")
    out, n = [_candidate(step, 0, rest, enough & bare.startswith("ε"), True, 3)], 1
    for augment, originals in G.AUGMENTS:
        tail = F.substring(bare, F.lit(len(augment) + 1), F.length(bare))
        for o in originals:
            out.append(_candidate(step, n, F.concat(F.lit(o), tail), enough & bare.startswith(augment) & (F.length(tail) >= 3), True))
            n += 1
    double = (F.length(bare) >= 5) & F.substring(bare, 2, 1).isin("ε", "α") & (F.substring(bare, 1, 1) == F.substring(bare, 3, 1)) & bare.rlike(r"^\p{L}")
    out.append(_candidate(step, n, F.substring(bare, F.lit(3), F.length(bare)), double, True))
    return out


def _subscripts(c: Column) -> Column:
    for a, b in G.IOTA_ADSCRIPT:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def byzantine_candidates(c: Column, low: Column, bare: Column, step: int = 7) -> list[Column]:
    """Light repairs: final sigma, iota adscript, hyphens, lower initial, a missing breathing."""
    sigma = lambda x: F.when(x.endswith("σ"), F.regexp_replace(x, "σ$", "ς"))
    changed = lambda x, y: F.when(x != y, x)
    lowered = F.when(c.rlike(r"^\p{Lu}"), F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))
    first, rest = F.substring(low, 1, 1), F.substring(low, F.lit(2), F.length(low))
    tries = [
        sigma(c), changed(_subscripts(c), c), F.when(c.contains("-"), F.replace(c, F.lit("-"), F.lit(""))), lowered, changed(_subscripts(lowered), lowered), sigma(lowered),
        F.concat(lookup_table(G.SMOOTH, first), rest), F.concat(lookup_table(G.ROUGH, first), rest),
    ]
    return [_candidate(step, i, x, x.isNotNull()) for i, x in enumerate(tries)]


def compound_candidates(bare: Column, step: int = 9) -> Column:
    """An array of (step, r, cand, prefix): what follows each link vowel, of three letters or more, after two or more."""
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.length(bare) - 3, F.lit(2))), lambda i: (i <= F.length(bare) - 3) & F.substring(bare, i, F.lit(1)).isin(*G.LINK_VOWELS))
    return F.transform(at, lambda i: F.struct(F.lit(step).alias("step"), i.alias("r"), F.substring(bare, i + 1, F.length(bare)).alias("cand"), F.substring(bare, F.lit(1), i).alias("prefix")))


def compounds(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, compound, base_lemma, prefix, rank): splits at a link vowel whose second part is a known inflected form."""
    w = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct().select("word", T.strip_accents(F.lower("word")).alias("_bare")).where(F.length("_bare") >= 6)
    c = w.select("word", F.explode(compound_candidates(F.col("_bare"))).alias("x")).select("word", F.col("x.r").alias("rank"), F.col("x.prefix").alias("prefix"), F.col("x.cand").alias("cand"))
    hit = looked_up(c, lexicon, ["word", "rank", "prefix"]).withColumn("_s", T.strip_accents(F.lower("lemma")))
    return hit.where((F.col("_s") != F.col("cand")) & (F.length("_s") >= 2) & (F.length("_s") <= F.length("cand") + 2)).select("word", F.concat("prefix", "_s").alias("compound"), F.col("lemma").alias("base_lemma"), "prefix", "rank")


def prefixed(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, lemma, rank): words whose prefix and base lemma together are a known form; two chained lookups."""
    w = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct().withColumn("_b", T.strip_accents(F.lower("word")))
    bare = [ud.normalize("NFC", "".join(x for x in ud.normalize("NFD", p) if ud.category(x) != "Mn")) for p in G.PREFIXES]
    opts = F.array(*[F.when(F.col("_b").startswith(p) & (F.length("_b") > len(p) + 2), F.struct(F.lit(i).alias("rank"), F.lit(p).alias("prefix"))) for i, p in enumerate(bare)])
    c = w.select("word", "_b", F.explode(F.filter(opts, lambda x: x.isNotNull())).alias("x")).select("word", "x.rank", "x.prefix", F.expr("substring(_b, length(x.prefix) + 1)").alias("cand"))
    base = looked_up(c, lexicon, ["word", "rank", "prefix"]).withColumn("_s", T.strip_accents(F.lower("lemma"))).where((F.col("_s") != F.col("cand")) & (F.length("_s") >= 2))
    whole = looked_up(base.select("word", "rank", F.concat("prefix", "_s").alias("cand")), lexicon, ["word", "rank"])
    return whole.groupBy("word").agg(F.min(F.struct("rank", "lemma")).alias("m")).select("word", F.col("m.lemma").alias("lemma"), F.col("m.rank").alias("rank"))


def heavy_repairs(words: DataFrame, lexicon: DataFrame, period: str = "byzantine") -> DataFrame:
    """(word, lemma, cand): words of six letters or more, and their light repairs, respelt by the confusions of a period.

    The cheapest respelling counts whose lemma differs from it. Spellings are made in Python: give only words that all else missed.
    """
    from logothek.functions.udfs import spelling_candidates

    w = words.select("word").where(F.length(T.strip_accents(F.lower("word"))) >= 6).distinct()
    c = F.col("word")
    lowered = F.when(c.rlike(r"^\p{Lu}"), F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c))))
    bases = F.filter(F.array(c, F.when(c.endswith("σ"), F.regexp_replace(c, "σ$", "ς")), _subscripts(c), lowered), lambda x: x.isNotNull())
    b = w.select("word", F.posexplode(F.array_distinct(bases)).alias("b", "base"))
    x = b.select("word", "b", F.posexplode(spelling_candidates(period)(F.col("base"))).alias("i", "s")).select("word", (F.col("b") * 1000 + F.col("i")).alias("r"), F.col("s.cand").alias("cand"))
    # the planner takes the many spellings for the size of the words' file, and would send them whole to the driver
    hit = looked_up(x, lexicon.hint("merge"), ["word", "r"]).where(T.strip_accents(F.lower("lemma")) != T.strip_accents(F.lower("cand")))
    return hit.groupBy("word").agg(F.min(F.struct("r", "lemma", "cand")).alias("m")).select("word", "m.lemma", "m.cand")


SOURCES = {0: "digit", 1: "article", 2: "crasis", 3: "elision", 4: "lookup", 5: "particle", 6: "verb_morphology", 7: "byzantine_norm", 9: "compound", 10: "prefix", 11: "identity"}


def rule_hits(words: DataFrame, lexicon: DataFrame, steps: dict[int, Callable[[Column, Column, Column], list[Column]]], splits: bool = False) -> DataFrame:
    """(word, step, cand, lemma, compound): the first hit of each step of single-lookup rules, by one join for all of them.

    steps: by number, what gives the candidates of a word, its lower case and that without marks. splits: tries compounds, too,
    as step 9; their lemma is that of the second part, ``compound`` the whole.
    """
    w = words.select("word", F.lower("word").alias("_low"))
    w = w.select("*", T.strip_accents(F.col("_low")).alias("_bare"))
    options = [x for f in steps.values() for x in f(F.col("word"), F.col("_low"), F.col("_bare"))]
    c = w.select("word", F.explode(F.array(*options)).alias("x")).where("x IS NOT NULL").select("word", "x.*", F.lit(None).cast("string").alias("prefix"))
    if splits:
        parts = w.where(F.length("_bare") >= 6).select("word", F.explode(compound_candidates(F.col("_bare"))).alias("x"))
        c = c.unionByName(parts.select("word", "x.step", F.col("x.r").cast("int").alias("r"), "x.cand", F.lit(False).alias("not_self"), "x.prefix"))
    hit = looked_up(c, lexicon, ["word", "step", "r", "not_self", "prefix"])
    bare, own = T.strip_accents(F.lower("lemma")), T.strip_accents(F.lower("cand"))
    self_ = (F.col("cand") == F.col("lemma")) | (own == bare)
    split_ok = F.col("prefix").isNull() | ((bare != F.col("cand")) & (F.length(bare) >= 2) & (F.length(bare) <= F.length("cand") + 2))
    best = hit.where(~(F.col("not_self") & self_) & split_ok).groupBy("word", "step").agg(F.min(F.struct("r", "cand", "lemma", "prefix")).alias("m"))
    return best.select("word", "step", "m.cand", "m.lemma", F.concat("m.prefix", T.strip_accents(F.lower("m.lemma"))).alias("compound"))


def lemmatised(words: DataFrame, lexicon: DataFrame, freq: DataFrame, word: str = "word", resolve_articles: bool = False, elision_first: bool = True, convention: DataFrame | None = None, respell: str | None = None) -> DataFrame:
    """(word, lemma, source) of each distinct word.

    elision_first: the order of the batch entry point; without it a plain lookup comes before elision, as for single words.
    convention: (lemma, preferred) replaces lemmas at the end. respell: a period, by whose confusions words are respelt that
    nothing else can place. The lexicon is written once; rules are tried only for words that lookup, crasis and elision miss,
    all by one join.
    """
    lexicon = checkpointed(lexicon)
    w = words.select(F.col(word).alias("word")).distinct()
    c = F.col("word")
    literal = F.when(c.rlike(r"^\p{Nd}+$"), F.struct(F.lit(0.0).alias("step"), c.alias("lemma")))
    if resolve_articles:
        article = closed_class(c)
        literal = F.coalesce(literal, F.when(article.isNotNull(), F.struct(F.lit(1.0).alias("step"), article.alias("lemma"))))
    literal = F.coalesce(literal, F.when(crasis(c).isNotNull(), F.struct(F.lit(2.0).alias("step"), crasis(c).alias("lemma"))))
    look = 4.0 if elision_first else 2.5
    full = w.where(F.length("word") > 0)
    elided = elisions(full.where(literal.isNull()), lexicon, freq).where("rank = 1").select("word", F.lit(3.0).alias("step"), "lemma")
    plain = looked_up(full.withColumn("cand", c), lexicon, ["word"]).select("word", F.lit(look).alias("step"), "lemma")
    hit = elided.unionByName(plain).groupBy("word").agg(F.min(F.struct("step", "lemma")).alias("_h"))
    placed = checkpointed(w.join(hit, "word", "left").select("word", F.coalesce(literal, "_h").alias("m")))
    found = placed.where(F.col("m").isNotNull() | (F.length("word") == 0) | c.isNull()).select("word", F.coalesce("m", F.struct(F.lit(11.0).alias("step"), c.alias("lemma"))).alias("m"))
    open_ = placed.where(F.col("m").isNull() & (F.length("word") > 0)).select("word")
    rules = rule_hits(open_, lexicon, {5: particle_candidates, 6: verb_candidates, 7: byzantine_candidates}, splits=True)
    late = rules.select("word", F.struct(F.col("step").cast("double").alias("step"), F.coalesce("compound", "lemma").alias("lemma")).alias("m"))
    late = late.unionByName(prefixed(open_, lexicon).select("word", F.struct(F.lit(10.0).alias("step"), "lemma").alias("m")))
    late = late.unionByName(open_.select("word", F.struct(F.lit(11.0).alias("step"), c.alias("lemma")).alias("m")))
    best = found.unionByName(late.groupBy("word").agg(F.min("m").alias("m")))
    names = F.create_map(*[x for k, v in SOURCES.items() for x in (F.lit(float(look if k == 4 else k)), F.lit(v))])
    out = best.select("word", F.col("m.lemma").alias("lemma"), F.element_at(names, F.col("m.step")).alias("source"))
    if respell is not None:
        out = checkpointed(out)
        again = heavy_repairs(out.where("source = 'identity' AND length(word) > 0"), lexicon, respell).select("word", F.col("lemma").alias("_l"))
        out = out.join(again, "word", "left").select("word", F.coalesce("_l", "lemma").alias("lemma"), F.when(F.col("_l").isNotNull(), "respelt").otherwise(F.col("source")).alias("source"))
    if convention is not None:
        out = out.join(convention.select("lemma", "preferred"), "lemma", "left").select("word", F.coalesce("preferred", "lemma").alias("lemma"), "source")
    return out


SCORES = {"lookup": 1.0, "elision": 1.0, "crasis": 1.0, "article": 1.0, "digit": 1.0, "particle": 0.9, "verb_morphology": 0.85, "byzantine_norm": 0.7, "compound": 0.65, "prefix": 0.6, "identity": 0.0}


def candidates(words: DataFrame, lexicon: DataFrame, freq: DataFrame, word: str = "word") -> DataFrame:
    """(word, lemma, source, score, proper, rank): all candidates; rules and splits only for words that lookup and elision miss."""
    lexicon = checkpointed(lexicon)
    w = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct()
    c = F.col("word")
    base = looked_up(w.withColumn("cand", c), lexicon, ["word"]).select("word", "lemma", F.lit("lookup").alias("source"), F.lit(1).alias("o"))
    base = base.unionByName(elisions(w, lexicon, freq).select("word", "lemma", F.lit("elision").alias("source"), (F.col("rank") + 1).alias("o")))
    base = checkpointed(base.unionByName(w.where(crasis(c).isNotNull()).select("word", crasis(c).alias("lemma"), F.lit("crasis").alias("source"), F.lit(0).alias("o"))))
    open_ = checkpointed(w.join(base.select("word").distinct(), "word", "left_anti"))
    names = F.create_map(*[x for k, v in SOURCES.items() for x in (F.lit(k), F.lit(v))])
    rules = rule_hits(open_, lexicon, {5: particle_candidates, 6: verb_candidates, 7: byzantine_candidates}).select("word", "lemma", F.element_at(names, F.col("step")).alias("source"), (F.col("step") * 100).alias("o"))
    rules = rules.unionByName(compounds(open_, lexicon).select("word", F.col("compound").alias("lemma"), F.lit("compound").alias("source"), (F.col("rank") + 900).alias("o")))
    rules = checkpointed(rules.unionByName(prefixed(open_, lexicon).select("word", "lemma", F.lit("prefix").alias("source"), F.lit(1000).alias("o"))))
    rest = open_.join(rules.select("word").distinct(), "word", "left_anti").select("word", c.alias("lemma"), F.lit("identity").alias("source"), F.lit(2000).alias("o"))
    every = base.unionByName(rules).unionByName(rest).groupBy("word", "lemma").agg(F.min(F.struct("o", "source")).alias("m")).select("word", "lemma", "m.o", "m.source")
    score = F.element_at(F.create_map(*[x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    proper = F.col("lemma").rlike(r"^\p{Lu}")
    rows = every.select("word", "lemma", "source", score.alias("score"), proper.alias("proper"), "o")
    ordered = rows.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("proper", (-F.col("score")).alias("s"), "o", "lemma", "source", "score"))).alias("a"))
    return ordered.select("word", F.posexplode("a").alias("rank", "x")).select("word", "x.lemma", "x.source", "x.score", "x.proper", (F.col("rank") + 1).alias("rank"))


def by_pos(words: DataFrame, candidates_: DataFrame, pos_table: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """(word, pos, lemma, rule): words with their part of speech, resolved by candidates and a table of parts of speech.

    The table's lemma decides among the candidates: the candidate equal to it (``exact``), else equal without marks
    (``stripped``). If no candidate is, the table still wins over a sole candidate (``sole``) and over candidates that are
    all the word itself but for marks (``self``). Else a repaired self-map counts (``repaired``), else the first candidate
    (``top``). words: (word, pos). candidates_: (word, lemma, rank). pos_table: (form, pos, lemma). repaired: (word, pos,
    lemma). Words without a candidate stand for themselves.
    """
    bare = lambda c: T.strip_accents(F.lower(c))
    w = words.select("word", "pos").distinct()
    k = keyed(w, "word", ["word", "pos"])
    told = k.join(pos_table.select("form", "pos", F.col("lemma").alias("_p")), ["form", "pos"]).groupBy("word", "pos").agg(F.min(F.struct("v", "_p")).alias("m")).select("word", "pos", "m._p")
    j = w.join(told, ["word", "pos"], "left").join(candidates_.select("word", F.col("lemma").alias("_c"), F.col("rank").alias("_k")), "word", "left")
    first = lambda when: F.min(F.when(when, F.struct("_k", "_c")))
    g = j.groupBy("word", "pos", "_p").agg(
        first(F.col("_c") == F.col("_p")).alias("same"), first(bare("_c") == bare("_p")).alias("near"), first(F.col("_c").isNotNull()).alias("top"),
        F.count("_c").alias("n"), F.bool_and(bare("_c") == bare("word")).alias("own"),
    )
    fix = F.lit(None).cast("string")
    if repaired is not None:
        g, fix = g.join(repaired.select("word", "pos", F.col("lemma").alias("_fix")), ["word", "pos"], "left"), F.when((F.col("n") > 1) & (F.col("_fix") != F.col("top._c")), F.col("_fix"))
    p = F.col("_p")
    rule = (
        F.when(F.col("same").isNotNull(), "exact").when(F.col("near").isNotNull(), "stripped").when(p.isNotNull() & (F.col("n") == 1), "sole")
        .when(p.isNotNull() & F.col("own"), "self").when(fix.isNotNull(), "repaired").otherwise("top")
    )
    lemma = F.when(F.col("rule") == "exact", F.col("same._c")).when(F.col("rule") == "stripped", F.col("near._c")).when(F.col("rule").isin("sole", "self"), p).when(F.col("rule") == "repaired", fix).otherwise(F.coalesce("top._c", "word"))
    return g.withColumn("rule", rule).select("word", "pos", lemma.alias("lemma"), "rule")


def convention_map(groups: DataFrame, headwords: DataFrame, overrides: DataFrame | None = None, monotonic: bool = False, ancient: DataFrame | None = None) -> DataFrame:
    """(lemma, preferred): each member of a group of two or more goes to its first member that is a headword, else to its first.

    groups: (group_id, ord, lemma); later groups win over earlier ones, and overrides (lemma, preferred) over all. A
    ``monotonic`` convention also takes the first member whose monotonic form is a headword, as that form. ancient: (lemma),
    of which those in no group change their ending as the modern language does, if that gives a headword.
    """
    h = headwords.select(F.col("form").alias("lemma")).distinct().withColumn("_h", F.lit(True))
    g = groups.join(h, "lemma", "left")
    if monotonic:
        g = g.withColumn("_mono", T.monotonic(F.col("lemma"))).join(h.select(F.col("lemma").alias("_mono"), F.col("_h").alias("_hm")), "_mono", "left")
    else:
        g = g.withColumn("_mono", F.lit(None).cast("string")).withColumn("_hm", F.lit(None).cast("boolean"))
    way = F.when(F.col("_h"), 0).when(F.col("_hm"), 1).otherwise(2)
    to = F.when(F.col("_h"), F.col("lemma")).when(F.col("_hm"), F.col("_mono")).otherwise(F.col("lemma"))
    pick = g.groupBy("group_id").agg(F.min(F.struct(way.alias("a"), "ord", to.alias("to"))).alias("m"), F.count("*").alias("n")).where("n > 1").select("group_id", F.col("m.to").alias("preferred"))
    every = g.join(pick, "group_id").where("lemma <> preferred").select("lemma", "preferred", F.col("group_id").cast("long").alias("o"))
    if ancient is not None:
        c = T.monotonic(F.col("lemma"))
        new = F.lit(None).cast("string")
        for old, modern in G.MODERN_ENDINGS.items():
            new = F.coalesce(new, F.when(c.endswith(old), F.concat(F.substring(c, F.lit(1), F.length(c) - len(old)), F.lit(modern))))
        a = ancient.select("lemma").distinct().withColumn("preferred", new).join(h.select(F.col("lemma").alias("preferred")), "preferred", "left_semi")
        every = every.unionByName(a.select("lemma", "preferred", F.lit(-(1 << 63)).alias("o")))
    if overrides is not None:
        every = every.unionByName(overrides.select("lemma", "preferred", F.lit((1 << 63) - 1).alias("o")))
    return every.groupBy("lemma").agg(F.max(F.struct("o", "preferred")).alias("m")).select("lemma", F.col("m.preferred").alias("preferred"))


def adjective_headwords(lemmas: DataFrame, headwords: DataFrame, adjectives: DataFrame) -> DataFrame:
    """(lemma, headword): adverbs in -ως and neuters in -ον that are no headwords go to the adjective they belong to, others stay.

    adjectives: (form), found without marks; of several that are equal so the greatest counts.
    """
    bare = lambda c: T.strip_accents(F.lower(c))
    c = F.col("lemma")
    stem = bare(F.substring(c, F.lit(1), F.length(c) - 2))
    ends = F.when(c.rlike("[ωῶ]ς$"), F.array(*map(F.lit, G.ADVERB_ENDINGS))).when(c.rlike("[οό]ν$"), F.array(*map(F.lit, G.NEUTER_ENDINGS)))
    m = lemmas.select("lemma").distinct().join(headwords.select(F.col("form").alias("lemma")).distinct().withColumn("_h", F.lit(True)), "lemma", "left")
    tries = m.where("_h IS NULL").select("lemma", F.posexplode(F.transform(ends, lambda e: F.concat(stem, e))).alias("i", "_k"))
    a = adjectives.groupBy(bare("form").alias("_k")).agg(F.max("form").alias("headword"))
    best = tries.join(a, "_k").groupBy("lemma").agg(F.min(F.struct("i", "headword")).alias("b")).select("lemma", F.col("b.headword").alias("headword"))
    return m.join(best, "lemma", "left").select("lemma", F.coalesce("headword", "lemma").alias("headword"))


def conventional(lemmas: DataFrame, mapping: DataFrame, monotonic: bool = False) -> DataFrame:
    """(lemma, shown): lemmas by a convention's map; those of a monotonic convention are shown in monotonic writing."""
    j = lemmas.select("lemma").distinct().join(mapping.select("lemma", "preferred"), "lemma", "left")
    shown = F.coalesce("preferred", "lemma")
    return j.select("lemma", (T.monotonic(shown) if monotonic else shown).alias("shown"))


def agreeing(candidates_: DataFrame, tokens: DataFrame) -> DataFrame:
    """Candidates re-ranked by the gender of the article before the token; none is dropped or added.

    tokens: (sent_id, pos, word); candidates_: (word, lemma, rank). The gender of a lemma is that of its longest ending.
    """
    from pyspark.sql import Window

    prev = tokens.withColumn("_prev", F.lag("word").over(Window.partitionBy("sent_id").orderBy("pos")))
    flat = {f: g for g, fs in G.ARTICLE_GENDER.items() for f in fs}
    want = lookup_table(flat, F.col("_prev"))
    s = T.strip_accents(F.lower("lemma"))
    gender = F.when(s.endswith("μα"), "n").when(s.endswith("ις"), "f").when(s.endswith("ος"), "m").when(s.endswith("ηρ"), "m").when(s.endswith("ων"), "m").when(s.endswith("ας"), "m").when(s.endswith("ον"), "n").when(s.endswith("η"), "f").when(s.endswith("α"), "f")
    j = prev.join(candidates_, "word").withColumn("_m", F.when(want.isNotNull() & (gender == want), 0).otherwise(1))
    w = Window.partitionBy("sent_id", "pos").orderBy("_m", "rank")
    return j.select("sent_id", "pos", "word", "lemma", F.row_number().over(w).alias("rank"))


def repaired_self_maps(ranked: DataFrame, headwords: DataFrame) -> DataFrame:
    """(word, pos, lemma): the lemma of modern adjectives and verbs that map to themselves or to a feminine.

    ranked: (word, pos, lemma, proper, rank). For a self-map (null pos counts as both) the first other candidate that ends as
    a masculine adjective or as a verb does; for a feminine adjective the masculine, if it is a headword; else the first.
    """
    c, w, pos = F.lower("lemma"), F.col("word"), F.col("pos")
    same = lambda x: (w == x) | (T.strip_accents(F.lower(w)) == T.strip_accents(F.lower(x)))
    adjective = (pos.isNull() | (pos == "ADJ")) & c.rlike("(?:ος|ής|ύς)$")
    verb = (pos.isNull() | (pos == "VERB")) & c.rlike("(?:ω|ώ|μαι)$")
    fits = ~same(F.col("lemma")) & ~F.col("proper") & (adjective | verb)
    g = ranked.groupBy("word", "pos").agg(F.min(F.struct("rank", "lemma")).alias("t"), F.min(F.when(fits, F.struct("rank", "lemma"))).alias("o")).select("word", "pos", F.col("t.lemma").alias("top"), F.col("o.lemma").alias("other"))
    mono = T.monotonic(F.lower("top"))
    male = F.when(mono.endswith("ιά"), F.regexp_replace(mono, "ιά$", "ός")).when(mono.endswith("ια"), F.regexp_replace(mono, "ια$", "ος")).when(mono.endswith("ή") | mono.endswith("ικη"), F.regexp_replace(mono, "[ήη]$", "ός")).when(mono.endswith("η"), F.regexp_replace(mono, "η$", "ος"))
    h = headwords.select(F.col("form").alias("_m")).distinct()
    j = g.withColumn("_male", F.when((pos == "ADJ") & ~same(F.col("top")), male)).join(h, F.col("_male") == F.col("_m"), "left")
    fixed = F.when(same(F.col("top")) & (pos.isNull() | pos.isin("ADJ", "VERB")), F.col("other"))
    return j.select("word", "pos", F.coalesce(fixed, "_m", "top").alias("lemma"))


def case_alternates(hits: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``hits`` (word, lemma, tbl) and, as further rows, their lemmas with the other case of the first letter where that is a lemma of itself in the same table."""
    c = F.col("lemma")
    rest = F.substring(c, F.lit(2), F.length(c))
    first = F.substring(c, 1, 1)
    alt = F.concat(F.when(F.upper(first) == first, F.lower(first)).otherwise(F.upper(first)), rest)
    self_ = lexicon.where("form = lemma").select("tbl", F.col("form").alias("_alt")).distinct()
    other = hits.withColumn("_alt", alt).where(F.col("_alt") != c).join(self_, ["tbl", "_alt"]).select("word", F.col("_alt").alias("lemma"), "tbl")
    return hits.select("word", "lemma", "tbl", F.lit(False).alias("alternate")).unionByName(other.withColumn("alternate", F.lit(True)))


def scaled(candidates_: DataFrame, freq: DataFrame) -> DataFrame:
    """``candidates_`` (word, lemma, source, score, o) with ``score`` by corpus counts, and ``rank``.

    Of the lookup candidates of a word, if there are several and one is attested, the score is 0.5 and half the logarithm of
    its count over that of the most frequent; those not attested get 0.55. Proper names come last, then by score, then by
    ``o``. freq: (key, n) by stripped lower-case key.
    """
    from pyspark.sql import Window

    look = F.col("source") == "lookup"
    of_word = Window.partitionBy("word")
    n = F.when(look, F.coalesce("n", F.lit(0)))
    j = candidates_.join(freq.select(F.col("key").alias("_k"), "n"), T.key(F.col("lemma")) == F.col("_k"), "left").withColumn("_log", F.log1p(n))
    j = j.withColumn("_max", F.max("_log").over(of_word)).withColumn("_many", F.count("_log").over(of_word))
    score = F.when(look & (F.col("_many") > 1) & (F.col("_max") > 0), F.when(F.col("_log") > 0, 0.5 + 0.5 * F.col("_log") / F.col("_max")).otherwise(0.55)).otherwise(F.col("score"))
    proper = F.col("lemma").rlike(r"^\p{Lu}")
    j = j.select("word", "lemma", "source", score.alias("score"), proper.alias("proper"), "o")
    return j.withColumn("rank", F.row_number().over(of_word.orderBy("proper", F.desc("score"), "o", "lemma")))

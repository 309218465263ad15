"""Building a form-to-lemma lexicon from ranked sources.

Where order matters, it is explicit: a source rank and an ordinal; every pick is the least of (rank, ordinal, value), so
results don't depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logothek.functions import text as T
from logothek.functions.tables import MG_ARTICLES
from logothek.operators.skew import small_enough
from logothek.session import checkpointed


def self_map(form: Column, lemma: Column) -> Column:
    """Form and lemma are equal, or equal in lower case without marks."""
    return (form == lemma) | (T.strip_accents(F.lower(form)) == T.strip_accents(F.lower(lemma)))


def entries(lookup: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(row_id, form, lemma, src, lang): the lexicon with lemma texts; rows without form, lemma or text are left out."""
    heads = lemmas.select(F.col("id").alias("lemma_id"), F.col("text").alias("lemma"))
    rows = lookup.join(heads, "lemma_id").where((F.length("form") > 0) & (F.length("lemma") > 0))
    return rows.select("row_id", "form", "lemma", "src", "lang")


def first_by(rows: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by partial aggregation rather than a window."""
    m = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(k).alias(f"v_{k}") for k in keep]))
    return rows.groupBy(*keys).agg(m.alias("m")).select(*keys, *[F.col(f"m.v_{k}").alias(k) for k in keep])


def by_priority(rows: DataFrame, rank: Column, keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Sources appended in order of rank, a key only if no earlier source has it."""
    return first_by(rows, keys or ["form"], [rank, F.col("row_id")], keep or ["lemma", "src"])


def layered(words: DataFrame, lexicon: DataFrame, lang: str, form: str = "form") -> DataFrame:
    """``words`` with ``lemma``: of their form in the table of ``lang``, else in that of ``all``. lexicon: unique by (form, lang)."""
    own = lexicon.where(F.col("lang") == lang).select(F.col("form").alias(form), F.col("lemma").alias("_own"))
    rest = lexicon.where(F.col("lang") == "all").select(F.col("form").alias(form), F.col("lemma").alias("_all"))
    return words.join(own, form, "left").join(rest, form, "left").withColumn("lemma", F.coalesce("_own", "_all")).drop("_own", "_all")


def combined(ag: DataFrame, el: DataFrame, headwords: DataFrame) -> DataFrame:
    """Merge of two tables (form, lemma), the first preferred.

    A self-map of the first gives way to another lemma of the second, unless form or lemma is a known headword; of two
    self-maps the exact one stays.
    """
    h = headwords.select(F.col("form").alias("_h")).distinct()
    j = ag.select("form", F.col("lemma").alias("a")).join(el.select("form", F.col("lemma").alias("e")), "form", "full")
    j = j.join(h.withColumn("_hf", F.lit(True)), F.col("form") == F.col("_h"), "left").drop("_h").join(h.withColumn("_ha", F.lit(True)), F.col("a") == F.col("_h"), "left").drop("_h")
    a, e, f = F.col("a"), F.col("e"), F.col("form")
    protected = F.coalesce(F.col("_hf"), F.col("_ha"), F.lit(False))
    lemma = (
        F.when(a.isNull(), e).when(e.isNull(), a)
        .when(self_map(f, a) & ~self_map(f, e), F.when(protected, a).otherwise(e))
        .when(self_map(f, a) & self_map(f, e) & (e == f) & (a != f), e).otherwise(a)
    )
    return j.select("form", lemma.alias("lemma"), F.when(a.isNull(), "el").when(lemma == a, "grc").otherwise("el").alias("src"))


def deltas(own: DataFrame, whole: DataFrame) -> DataFrame:
    """Entries of ``own`` that ``whole`` lacks or has with another lemma."""
    w = whole.select("form", F.col("lemma").alias("_w"))
    return own.join(w, "form", "left").where(~F.col("lemma").eqNullSafe(F.col("_w"))).drop("_w")


def appended_without_conflict(el: DataFrame, snapshot: DataFrame, new: DataFrame) -> DataFrame:
    """``el`` and those of ``new`` whose form it lacks and to which ``snapshot`` has no other lemma."""
    s = snapshot.select("form", F.col("lemma").alias("_ag"))
    fresh = new.join(el.select("form"), "form", "left_anti").join(s, "form", "left").where(F.col("_ag").isNull() | (F.col("_ag") == F.col("lemma")))
    return el.select("form", "lemma").unionByName(fresh.select("form", "lemma"))


def headword_lemmas(rows: DataFrame, headwords: DataFrame) -> DataFrame:
    """Rows whose lemma is a headword, after lower-casing the first letter where only that gives one."""
    low = F.concat(F.lower(F.substring("lemma", 1, 1)), F.expr("substring(lemma, 2)"))
    h = headwords.select(F.col("form").alias("_h")).distinct()
    j = rows.withColumn("_low", F.when(T.capitalised(F.col("lemma")), low)).join(h.withColumn("_ok", F.lit(True)), F.col("lemma") == F.col("_h"), "left").drop("_h")
    j = j.join(h.withColumn("_lowok", F.lit(True)), F.col("_low") == F.col("_h"), "left").drop("_h")
    return j.withColumn("lemma", F.when(F.col("_lowok"), F.col("_low")).otherwise(F.col("lemma"))).where(F.coalesce("_lowok", "_ok", F.lit(False))).drop("_low", "_ok", "_lowok")


def confidence(whole: DataFrame, en_pages: DataFrame, el_pages: DataFrame, en: DataFrame, el: DataFrame) -> DataFrame:
    """Tiers: 5 both have a page of the form, 4 and 3 only the one or the other, 2 their tables agree on the lemma, 1 else."""
    mark = lambda df, name: df.select("form").distinct().withColumn(name, F.lit(True))
    j = whole.join(mark(en_pages, "_a"), "form", "left").join(mark(el_pages, "_b"), "form", "left")
    j = j.join(en.select("form", F.col("lemma").alias("_en")), "form", "left").join(el.select("form", F.col("lemma").alias("_el")), "form", "left")
    tier = F.when(F.col("_a") & F.col("_b"), 5).when(F.col("_a"), 4).when(F.col("_b"), 3).when(F.col("_en") == F.col("_el"), 2).otherwise(1)
    return j.select("form", "lemma", tier.alias("tier"))


def resolved_self_maps(whole: DataFrame, en_targets: DataFrame, el_targets: DataFrame, en_pages: DataFrame) -> DataFrame:
    """Self-maps replaced by what one source says the form is a form of, the other's word only if the first has no page; articles stay."""
    j = whole.join(en_targets.select("form", F.col("target").alias("_en")), "form", "left").join(el_targets.select("form", F.col("target").alias("_el")), "form", "left")
    j = j.join(en_pages.select("form").distinct().withColumn("_p", F.lit(True)), "form", "left")
    target = F.coalesce("_en", F.when(F.col("_p").isNull(), F.col("_el")))
    use = (F.col("lemma") == F.col("form")) & ~F.col("form").isin(*MG_ARTICLES) & target.isNotNull() & (target != F.col("form"))
    return j.select("form", F.when(use, target).otherwise(F.col("lemma")).alias("lemma"), use.alias("resolved"))


def chains_resolved(table: DataFrame, depth: int = 5) -> DataFrame:
    """Entries whose lemma is itself the form of another lemma are led on to a headword, at most ``depth`` steps, or dropped.

    table: (form, lemma), unique by form. The walk stops at a self-map, at an unknown form, at a cycle and at the depth.
    """
    step = checkpointed(table.select(F.col("form").alias("_f"), F.col("lemma").alias("_l")))
    side = lambda df: F.broadcast(df) if small_enough(df) else df
    # where lemmas lead: a table of lemmas, not of forms
    known = checkpointed(step.join(side(step.select(F.col("_l").alias("_f")).distinct()), "_f", "left_semi"))
    leads = side(known.select(F.col("_f").alias("lemma"), F.col("_l").alias("target")))
    first = step.select(F.col("_f").alias("form"), F.col("_l").alias("lemma")).join(leads, "lemma", "left")
    chained = F.coalesce((F.col("lemma") != F.col("form")) & F.col("target").isNotNull() & (F.col("target") != F.col("lemma")), F.lit(False))
    walk = checkpointed(first.where(chained)).withColumn("seen", F.array("form", "lemma")).withColumn("go", F.lit(True))  # few entries are chained: only they walk on
    steps = side(known)
    for _ in range(depth):
        j = walk.join(steps, F.col("target") == F.col("_f"), "left")
        moves = F.col("go") & F.col("_l").isNotNull() & (F.col("_l") != F.col("target")) & ~F.array_contains("seen", F.col("target"))
        moves = F.coalesce(moves, F.lit(False))
        walk = j.select("form", moves.alias("go"), F.when(moves, F.concat("seen", F.array("target"))).otherwise(F.col("seen")).alias("seen"), F.when(moves, F.col("_l")).otherwise(F.col("target")).alias("target"))
    heads = side(known.where(F.col("_f") == F.col("_l")).select(F.col("_f").alias("target")))
    return first.where(~chained).select("form", "lemma").unionByName(walk.join(heads, "target").select("form", F.col("target").alias("lemma")))


def spell_index(rows: DataFrame) -> DataFrame:
    """(stripped, forms): the distinct spellings of each form without case and marks, in order, each with the smallest of its sources ('' for none)."""
    one = rows.groupBy("form").agg(F.min(F.coalesce("src", F.lit(""))).alias("src"))
    g = one.select(T.strip_accents(F.lower("form")).alias("stripped"), F.struct("form", "src").alias("f"))
    return g.groupBy("stripped").agg(F.sort_array(F.collect_list("f")).alias("forms"))


def bridges(rows: DataFrame) -> DataFrame:
    """(el_lemma, grc_lemma): different lemmas that a form has in the two varieties, each pair once."""
    el = rows.where("lang = 'el'").select("form", F.col("lemma").alias("el_lemma")).distinct()
    grc = rows.where("lang = 'grc'").select("form", F.col("lemma").alias("grc_lemma")).distinct()
    return el.join(grc, "form").where("el_lemma <> grc_lemma").select("el_lemma", "grc_lemma").distinct()


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key and its count; ties go to the smallest."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def ambiguous(rows: DataFrame, form: str = "form", tag: str = "pos", lemma: str = "lemma") -> DataFrame:
    """(form, tag, lemma): the lemma of each form and tag, for forms whose tags lead to two or more different lemmas."""
    best = majority(rows, [form, tag], lemma).drop("n")
    several = best.groupBy(form).agg(F.count_distinct(lemma).alias("k")).where("k >= 2")
    return best.join(several, form, "left_semi")


def overridden(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lemmas replaced by those of a table (form, lemma) of corrections; corrections of unknown forms are added."""
    o = overrides.select("form", F.col("lemma").alias("_o"))
    return rows.select("form", "lemma").join(o, "form", "full").select("form", F.coalesce("_o", "lemma").alias("lemma"))


INDEFINITE, INDEFINITE_LEMMA = "δήποτε", "ὁστισδήποτε"


def indefinites(rows: DataFrame) -> DataFrame:
    """Corrections (form, lemma): forms with the ending -δήποτε after something, whose lemma has it too but is another word."""
    f, m = F.col("form"), F.col("lemma")
    return rows.where(f.contains(INDEFINITE) & ~f.startswith(INDEFINITE) & m.contains(INDEFINITE) & (m != f)).select("form", F.lit(INDEFINITE_LEMMA).alias("lemma")).distinct()


def held_out(base: DataFrame, rows: DataFrame, headwords: DataFrame, part: str, out: str) -> DataFrame:
    """(form, lemma): ``base`` with the forms of all parts of ``rows`` but one, where it lacks them and their lemma is known.

    rows: (form, lemma, o) and the column ``part``; the first by ``o`` of several lemmas counts. headwords: (form). Lemmas of
    rows that are headwords and no forms yet come in as forms of themselves.
    """
    heads = headwords.select("form").unionByName(base.where("form = lemma").select("form")).distinct()
    known = heads.unionByName(base.select("form")).distinct().select(F.col("form").alias("lemma"))
    other = rows.where(F.col(part).isNull() | (F.col(part) != out))
    good = other.join(known, "lemma", "left_semi").join(base.select("form"), "form", "left_anti")
    own = other.join(heads.select(F.col("form").alias("lemma")), "lemma", "left_semi").select(F.col("lemma").alias("form"), "lemma", F.col("o"), F.lit(1).alias("late")).join(base.select("form"), "form", "left_anti")
    new = good.select("form", "lemma", "o", F.lit(0).alias("late")).unionByName(own)
    first = new.groupBy("form").agg(F.min(F.struct("o", "late", "lemma")).alias("m")).select("form", F.col("m.lemma").alias("lemma"))
    return base.select("form", "lemma").unionByName(first)


def majority_with_tag(rows: DataFrame, form: str = "form", lemma: str = "lemma", tag: str = "pos", order: str = "pair_id") -> DataFrame:
    """(form, lemma, tag): the most frequent lemma of each form with its most frequent tag; ties go to what comes first by ``order``."""
    t = rows.groupBy(form, lemma, tag).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    m = t.groupBy(form, lemma).agg(F.sum("n").alias("k"), F.min("o").alias("first"), F.min(F.struct((-F.col("n")).alias("n"), "o", F.col(tag).alias("t"))).alias("m"))
    best = m.groupBy(form).agg(F.min(F.struct((-F.col("k")).alias("k"), "first", F.col(lemma).alias("l"), F.col("m.t").alias("t"))).alias("b"))
    return best.select(form, F.col("b.l").alias(lemma), F.col("b.t").alias(tag))


def name_plurals_kept(rows: DataFrame, corroborated: DataFrame) -> DataFrame:
    """Rows but for plurals of names that no other source has. rows: (form, pos, tags, ...); corroborated: (form)."""
    ok = corroborated.select("form").distinct().withColumn("_ok", F.lit(True))
    plural = F.coalesce((F.col("pos") == "name") & F.array_contains("tags", "plural"), F.lit(False))
    return rows.join(ok, "form", "left").where(~plural | F.col("_ok").isNotNull()).drop("_ok")


def without_leaked_articles(rows: DataFrame, articles: tuple[str, ...]) -> DataFrame:
    """Rows but for forms that are an article in any of their spellings and not their own lemma."""
    f = F.col("form")
    spellings = F.array(f, F.lower(f), T.monotonic(f), F.lower(T.monotonic(f)), T.strip_accents(F.lower(f)))
    return rows.where((f == F.col("lemma")) | ~F.arrays_overlap(spellings, F.array(*map(F.lit, articles))))

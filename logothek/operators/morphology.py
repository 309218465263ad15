"""Paradigms: the grid of cells, attested forms by precedence, gaps filled by templates, and forms that depend on tags.

A cell is named by a key, as ``active_aorist_indicative_1sg``, ``active_aorist_infinitive``,
``active_aorist_participle_nom_m_sg``, ``genitive_pl`` for nouns and ``dative_f_sg`` for adjectives.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logothek.functions import text as T

# Axes of the grid, and the tenses that each mood has.
VOICES = ("active", "middle", "passive", "mediopassive")
MOODS = {
    "indicative": ("present", "imperfect", "future", "aorist", "perfect", "pluperfect", "future_perfect"),
    "subjunctive": ("present", "aorist", "perfect"),
    "optative": ("present", "future", "aorist", "perfect"),
    "imperative": ("present", "aorist", "perfect"),
    "infinitive": ("present", "future", "aorist", "perfect"),
    "participle": ("present", "future", "aorist", "perfect", "future_perfect"),
}
TENSES = MOODS["indicative"]
PERSONS = {"first-person": "1", "second-person": "2", "third-person": "3"}
NUMBERS = {"singular": "sg", "plural": "pl", "dual": "du"}
GENDERS = {"masculine": "m", "feminine": "f", "neuter": "n"}
CASES = {"nominative": "nom", "genitive": "gen", "dative": "dat", "accusative": "acc", "vocative": "voc"}
PAST = ("aorist", "imperfect", "pluperfect")
# Endings of the regular classes by cell.
THEMATIC = {
    "present_indicative": {"1sg": "ω", "2sg": "εις", "3sg": "ει", "1pl": "ομεν", "2pl": "ετε", "3pl": "ουσι(ν)", "2du": "ετον", "3du": "ετον"},
    "present_subjunctive": {"1sg": "ω", "2sg": "ῃς", "3sg": "ῃ", "1pl": "ωμεν", "2pl": "ητε", "3pl": "ωσι(ν)", "2du": "ητον", "3du": "ητον"},
    "present_optative": {"1sg": "οιμι", "2sg": "οις", "3sg": "οι", "1pl": "οιμεν", "2pl": "οιτε", "3pl": "οιεν", "2du": "οιτον", "3du": "οίτην"},
    "present_imperative": {"2sg": "ε", "3sg": "έτω", "2pl": "ετε", "3pl": "όντων", "2du": "ετον", "3du": "έτων"},
}
#: In the order of the cases, for singular, plural and dual.
DECLENSIONS = {
    "α": (("α", "ας", "ᾳ", "αν", "α"), ("αι", "ῶν", "αις", "ας", "αι"), ("α", "αιν", "αιν", "α", "α")),
    "η": (("η", "ης", "ῃ", "ην", "η"), ("αι", "ῶν", "αις", "ας", "αι"), ("α", "αιν", "αιν", "α", "α")),
    "ον": (("ον", "ου", "ῳ", "ον", "ον"), ("α", "ων", "οις", "α", "α"), ("ω", "οιν", "οιν", "ω", "ω")),
    "ος": (("ος", "ου", "ῳ", "ον", "ε"), ("οι", "ων", "οις", "ους", "οι"), ("ω", "οιν", "οιν", "ω", "ω")),
}
ADJECTIVE = {"m": "ος", "f": "η", "n": "ον"}


def verb_cells() -> list[tuple]:
    """(voice, tense, mood, person, number, case, gender, key) of all cells of a verb; there is no first person dual, and no first person of the imperative."""
    ends = [(p, n) for p in PERSONS.values() for n in NUMBERS.values() if (p, n) != ("1", "du")]
    out = []
    for voice, (mood, tenses) in product(VOICES, MOODS.items()):
        for tense in tenses:
            stem = f"{voice}_{tense}_{mood}"
            if mood == "infinitive":
                out.append((voice, tense, mood, None, None, None, None, stem))
            elif mood == "participle":
                out += [(voice, tense, mood, None, n, c, g, f"{stem}_{c}_{g}_{n}") for c, g, n in product(CASES.values(), GENDERS.values(), NUMBERS.values())]
            else:
                out += [(voice, tense, mood, p, n, None, None, f"{stem}_{p}{n}") for p, n in ends if (mood, p) != ("imperative", "1")]
    return out


def verb_grid(spark: SparkSession) -> DataFrame:
    """All cells of a verb: 359 a voice."""
    return spark.createDataFrame(verb_cells(), "voice string, tense string, mood string, person string, number string, case string, gender string, key string")


def nominal_grid(spark: SparkSession, with_gender: bool = False) -> DataFrame:
    """(case, number, key) of nouns, (case, gender, number, key) of adjectives."""
    if with_gender:
        rows = [(c, g, n, f"{c}_{g}_{n}") for c, g, n in product(CASES, GENDERS.values(), NUMBERS.values())]
        return spark.createDataFrame(rows, "case string, gender string, number string, key string")
    return spark.createDataFrame([(c, n, f"{c}_{n}") for c, n in product(CASES, NUMBERS.values())], "case string, number string, key string")


def _picked(tags: Column, axis) -> Column:
    """The tag of a set that lies on an axis, the smallest of several, null if there is none."""
    return F.array_min(F.array_intersect(tags, F.array(*map(F.lit, axis))))


def _short(tags: Column, axis: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in axis.items() for x in (F.lit(k), F.lit(v))]), _picked(tags, axis))


def verb_key(tags: Column) -> Column:
    """The cell of a verb that a set of tags names, null if they don't name one fully. A participle without case or number is nominative or singular."""
    voice = F.when(F.array_contains(tags, "mediopassive"), "middle").otherwise(_picked(tags, VOICES))
    tense, mood = _picked(tags, TENSES), _picked(tags, MOODS)
    person, number, gender = _short(tags, PERSONS), _short(tags, NUMBERS), _short(tags, GENDERS)
    stem = F.concat_ws("_", voice, tense, mood)
    known = voice.isNotNull() & tense.isNotNull() & mood.isNotNull()
    part = F.concat_ws("_", stem, F.coalesce(_short(tags, CASES), F.lit("nom")), gender, F.coalesce(number, F.lit("sg")))
    finite = person.isNotNull() & number.isNotNull() & ~((mood == "imperative") & (person == "1"))
    return F.when(known, F.when(mood == "infinitive", stem).when(mood == "participle", F.when(gender.isNotNull(), part)).when(finite, F.concat_ws("_", stem, F.concat(person, number))))


def nominal_key(tags: Column, adjective: Column) -> Column:
    """The cell of a noun or adjective that a set of tags names, null if they don't name one fully."""
    case, number, gender = _picked(tags, CASES), _short(tags, NUMBERS), _short(tags, GENDERS)
    known = case.isNotNull() & number.isNotNull()
    return F.when(known & adjective & gender.isNotNull(), F.concat_ws("_", case, gender, number)).when(known & ~adjective, F.concat_ws("_", case, number))


def attested(rows: DataFrame, rank: Column) -> DataFrame:
    """(lemma, key, form, source): of each cell the form of the best source, then the most frequent, then the smallest.

    rows: (lemma, key, form, source).
    """
    n = rows.groupBy("lemma", "key", "form", "source").agg(F.count("*").alias("n")).withColumn("_r", rank)
    m = n.groupBy("lemma", "key").agg(F.min(F.struct("_r", (-F.col("n")).alias("n"), "form", "source")).alias("m"))
    return m.select("lemma", "key", "m.form", "m.source")


def template_rows() -> list[tuple]:
    """(kind, ending, key, suffix, cut): what takes the place of the last ``cut`` letters of a lemma; a null suffix keeps the lemma.

    A noun's ending is cut only if it bears no accent.
    """
    rows = [("VERB", "ω", f"active_{k}_{pn}", e, 1) for k, t in THEMATIC.items() for pn, e in t.items()] + [("VERB", "ω", "active_present_infinitive", "ειν", 1)]
    for ending, table in DECLENSIONS.items():
        rows += [("NOUN", ending, f"{c}_{n}", None if (c, n) == ("nominative", "sg") else e, len(ending)) for n, es in zip(NUMBERS.values(), table, strict=True) for c, e in zip(CASES, es, strict=True)]
    for g, ending in ADJECTIVE.items():
        rows += [("ADJ", "ος", f"{c}_{g}_{n}", None if (c, g, n) == ("nominative", "m", "sg") else e, 2) for n, es in zip(NUMBERS.values(), DECLENSIONS[ending], strict=True) for c, e in zip(CASES, es, strict=True)]
    return rows


def template(spark: SparkSession, lemmas: DataFrame) -> DataFrame:
    """(lemma, key, form): regular forms of verbs in -ω that don't contract, of nouns in -α, -η, -ος, -ον and of adjectives in -ος.

    Accents stay where the lemma has them. lemmas: (lemma, kind), of composed text, kind VERB, NOUN or ADJ.
    """
    ends = F.broadcast(spark.createDataFrame(template_rows(), "kind string, ending string, key string, suffix string, cut int"))
    c = F.col("lemma")
    bare = T.strip_accents(F.lower(c))
    noun = F.when(bare.endswith("α"), "α").when(bare.endswith("η"), "η").when(bare.endswith("ον"), "ον").when(bare.endswith("ος"), "ος")
    ending = F.when((F.col("kind") == "VERB") & c.rlike("[ωώ]$") & ~bare.rlike("[αεο]ω$"), "ω").when(F.col("kind") == "NOUN", noun).when((F.col("kind") == "ADJ") & bare.endswith("ος"), "ος")
    w = lemmas.select("lemma", "kind", ending.alias("ending")).where("ending IS NOT NULL").distinct().join(ends, ["kind", "ending"])
    cuts = (F.col("kind") != "NOUN") | F.lower(c).endswith(F.col("ending"))
    stem = F.when(cuts, F.expr("substring(lemma, 1, length(lemma) - cut)")).otherwise(c)
    return w.select("lemma", "key", F.when(F.col("suffix").isNull(), c).otherwise(F.concat(stem, "suffix")).alias("form"))


def filled(attested_: DataFrame, generated: DataFrame) -> DataFrame:
    """Attested cells, and generated ones only where none is attested, with provenance."""
    gaps = generated.join(attested_.select("lemma", "key"), ["lemma", "key"], "left_anti")
    return attested_.select("lemma", "key", "form", "source").unionByName(gaps.select("lemma", "key", "form", F.lit("template").alias("source")))


def augmented(form: Column, lemma: Column) -> Column:
    """Whether a form begins as with an augment: ε before a lemma without, or a long vowel for a short one."""
    f, m = F.substring(T.strip_accents(F.lower(form)), 1, 1), F.substring(T.strip_accents(F.lower(lemma)), 1, 1)
    return F.coalesce((m != "") & (((f == "ε") & (m != "ε")) | (f.isin("η", "ω") & m.isin("α", "ε", "ο"))), F.lit(False))


#: Composed letters with a breathing or a circumflex.
RICH = "".join(chr(c) for c in range(0x1F00, 0x2000) if set(T.ud.normalize("NFD", chr(c))) & set("̓̔͂"))


def best_form(forms: DataFrame, keys: list[str], form: str = "form", n: str = "n", lemma: Column | None = None, cell: Column | None = None) -> DataFrame:
    """The best form of each key: one with a breathing or circumflex, else with any mark, else any; none elided if others are there.

    Of those the most frequent, in a past indicative (``cell``) of a lemma the augmented, then the shortest, then the greatest.
    """
    f = F.col(form)
    kind = F.when(f.rlike(f"[{RICH}̓̔͂]"), 2).when(T.strip_accents(f) != f, 1).otherwise(0)
    past = F.lit(False)
    if cell is not None:
        for tense in PAST:
            past = past | cell.contains(tense)
        past = past & cell.rlike("_indicative(_|$)")
    augment = F.when(past, augmented(f, lemma)).otherwise(False) if lemma is not None else F.lit(False)
    worth = F.struct(kind.alias("a"), (~f.rlike("[’᾽ʼ'ʹ]$")).alias("b"), F.col(n).alias("c"), augment.alias("d"), (-F.length(f)).alias("e"), f.alias("form"))
    return forms.groupBy(*keys).agg(F.max(worth).alias("m")).select(*keys, F.col("m.form").alias(form))


# Endings of iterative imperfects after their vowel, of the middle voice, and dialects among tags.
ITERATIVE = {
    "ε": ("σκον", "σκες", "σκε", "σκεν", "σκομεν", "σκετε", "σκετον", "σκετην", "σκομην", "σκετο", "σκοντο", "σκομεθα", "σκεσθε", "σκεσθον", "σκεσθην", "σκεο", "σκευ", "σκου"),
    "α": ("σκον", "σκες", "σκε", "σκεν", "σκομεν", "σκετε", "σκετον", "σκετην", "σκομην", "σκετο", "σκοντο", "σκομεθα", "σκεσθε", "σκεο", "σκευ"),
    "ο": ("σκον", "σκες", "σκε", "σκεν", "σκομεν", "σκετε", "σκετον", "σκετην", "σκομην", "σκετο", "σκοντο", "σκομεθα", "σκεσθε"),
}
MIDDLE_ENDINGS = ("μην", "σο", "το", "μεθα", "σθε", "ντο", "σθον", "σθην")
DIALECTS = {"Homeric": "epic", "Epic": "epic", "Ionic": "ionic", "Doric": "doric", "Aeolic": "aeolic", "Koine": "koine"}
CONSONANTS = "βγδζθκλμνξπρστφχψΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"
CRASIS = f"^[{CONSONANTS}](?:[{T.BREATHINGS}]|[{T._on('αεοηω')}][{''.join(c for c in T._on('ιυ') if c in T.BREATHINGS)}])"
ACCENT = f"[{T.ACUTES}{T.GRAVES}{T.CIRCUMFLEXES}]"
LAST_ACCENT = f"[{T.ACUTES}{T.GRAVES}][^{T.VOWELS}]*$"
ITERATIVE_END = "(?:" + "|".join(v + e for v, es in ITERATIVE.items() for e in es) + ")$"
MIDDLE_END = "(?:" + "|".join(MIDDLE_ENDINGS) + ")$"


def dialect_of(tags: Column) -> Column:
    """The dialect a set of tags names, '' for Attic and for none."""
    named = F.create_map(*[x for k, v in DIALECTS.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.array_contains(tags, "Attic"), "").otherwise(F.coalesce(F.try_element_at(named, _picked(tags, DIALECTS)), F.lit("")))


def spoilt(form: Column, lemma: Column) -> Column:
    """Forms that stand for no cell: contractions of two words, hosts of an enclitic with its accent, and contract stems without their iota."""
    f = F.regexp_replace(T.strip_accents(F.lower(form)), f"[{T.ELISION_GLYPHS}]+$", "")
    cv = F.regexp_extract(T.strip_accents(F.lower(lemma)), f"([{CONSONANTS}][αεηιοωυ])ιε(?:ω|ομαι)$", 1)
    dropped = (cv != "") & ~F.regexp_like(f, F.concat(cv, F.lit("ι[αεηιοωυ]"))) & F.regexp_like(f, F.concat(cv, F.lit("(?:η|ει|ου|ω|ε|α)")))
    enclitic = (F.regexp_count(form, F.lit(ACCENT)) == 2) & form.rlike(LAST_ACCENT)
    return form.rlike(CRASIS) | enclitic | F.coalesce(dropped, F.lit(False))


def epic(form: Column, lemma: Column, cell: Column) -> Column:
    """Forms of the epic language by their look: iterative imperfects, middle endings in passive aorists, pasts without an augment that would show."""
    f, m = T.strip_accents(F.lower(form)), T.strip_accents(F.lower(lemma))
    cut = F.regexp_replace(f, f"[{T.ELISION_GLYPHS}]+$", "")
    iterative = cell.contains("_imperfect_indicative") & ~m.rlike("σκ(?:ω|ομαι|ον)$") & cut.rlike(ITERATIVE_END)
    root = cell.startswith("passive_aorist_indicative_") & cut.rlike(MIDDLE_END)
    past = cell.rlike("_indicative(_|$)") & cell.rlike("|".join(PAST))
    plain = past & ~augmented(form, lemma) & ~m.rlike("^[ηω]") & ~(m.startswith("ε") & f.startswith("ε"))
    return iterative | root | plain


def verb_paradigms(rows: DataFrame) -> DataFrame:
    """(lemma, dialect, key, form): the best form of each cell of a verb by dialect, '' for Attic. rows: (lemma, form, tags)."""
    key = verb_key(F.col("tags"))
    r = rows.select("lemma", "form", key.alias("key"), dialect_of(F.col("tags")).alias("dialect")).where("key IS NOT NULL")
    r = r.where(~spoilt(F.col("form"), F.col("lemma")))
    r = r.withColumn("dialect", F.when((F.col("dialect") == "") & epic(F.col("form"), F.col("lemma"), F.col("key")), "epic").otherwise(F.col("dialect")))
    n = r.groupBy("lemma", "dialect", "key", "form").agg(F.count("*").alias("n"))
    return best_form(n, ["lemma", "dialect", "key"], lemma=F.col("lemma"), cell=F.col("key"))


# The elided forms of the common particles.
ELIDED = {"ἀλλά": "ἀλλ᾽", "διά": "δι᾽", "ἐπί": "ἐπ᾽", "κατά": "κατ᾽", "μετά": "μετ᾽", "παρά": "παρ᾽", "ὑπό": "ὑπ᾽", "ἀπό": "ἀπ᾽", "ἀντί": "ἀντ᾽", "δέ": "δ᾽"}


def elided_forms(rows: DataFrame) -> DataFrame:
    """(full, elided): of each full form the elided form of its lemma that tracks it best, and the fixed forms of particles.

    Matched are forms of one lemma, the elided one a vowel shorter. The case of the first letter counts 10, breathings in
    both or neither 5, an accent on the elided form 2, a mark at its start -20; ties go to the greatest. rows: (lemma, form).
    """
    r = rows.select("lemma", "form").distinct()
    marked = F.col("form").rlike(f"[{T.ELISION_GLYPHS}]$")
    short = r.where(marked).select("lemma", T.canonical_elision(F.col("form")).alias("elided")).distinct()
    short = short.withColumn("k", T.strip_accents(F.lower(F.expr("substring(elided, 1, length(elided) - 1)")))).where(F.length("elided") > 1)
    whole = T.strip_accents(F.lower("form"))
    full = r.where(~marked & (F.length("form") >= 2) & whole.rlike("[αεηιουω]$")).select("lemma", F.col("form").alias("full"), F.substring(whole, F.lit(1), F.length(whole) - 1).alias("k"))
    big = lambda c: F.col(c).rlike(r"^\p{Lu}")
    score = F.when(big("full") == big("elided"), 10).otherwise(0) + F.when(T.has_breathing(F.col("full")) == T.has_breathing(F.col("elided")), 5).otherwise(0) + F.when(T.has_accent(F.col("elided")), 2).otherwise(0) - F.when(F.col("elided").rlike(f"^[{T.ELISION_GLYPHS}]"), 20).otherwise(0)
    best = short.join(full, ["lemma", "k"]).groupBy("full").agg(F.max(F.struct(score.alias("s"), "elided")).alias("m")).select("full", "m.elided")
    fixed = F.broadcast(rows.sparkSession.createDataFrame(list(ELIDED.items()), "full string, elided string"))
    return best.join(fixed, "full", "left_anti").unionByName(fixed)


def movable_nu(rows: DataFrame) -> DataFrame:
    """(form, with_nu): forms that may take a final nu: third persons and datives plural in -σι and -ξι, -ψι, third persons singular in -ε, ἐστί.

    rows: (form, tags).
    """
    f, t = F.col("form"), F.col("tags")
    has = lambda *x: F.size(F.array_intersect(t, F.array(*map(F.lit, x)))) == len(x)
    si = T.strip_accents(f).rlike("[σξψ]ι$")
    yes = (si & (has("third-person", "plural") | has("third-person", "singular") | has("dative", "plural"))) | (T.strip_accents(f).endswith("ε") & has("third-person", "singular")) | T.strip_accents(F.lower(f)).isin("εστι", "εικοσι", "περυσι")
    return rows.where(F.coalesce(yes, F.lit(False))).select("form", F.concat("form", F.lit("ν")).alias("with_nu")).distinct()


def elision_pairs(rows: DataFrame, vowels: str = "αεοι") -> DataFrame:
    """(lemma, elided, full): forms of a lemma that are another's without its last vowel, by equality on the shortened key.

    rows: (lemma, form). Scored by breathing and accent kept; of several full forms the best, then the smallest.
    """
    k = T.strip_accents(F.lower("form"))
    r = rows.select("lemma", "form", k.alias("k")).distinct()
    full = r.where(k.rlike(f"[{vowels}]$")).select("lemma", F.col("form").alias("full"), F.expr("substring(k, 1, length(k) - 1)").alias("k"))
    short = r.where(~k.rlike(f"[{vowels}]$") & (F.length("k") >= 2)).select("lemma", F.col("form").alias("elided"), "k")
    score = F.when(F.substring("elided", 1, 1) == F.substring("full", 1, 1), 15).otherwise(0) + F.when(F.expr("startswith(full, substring(elided, 1, length(elided) - 1))"), 2).otherwise(0)
    m = short.join(full, ["lemma", "k"]).groupBy("lemma", "elided").agg(F.min(F.struct((-score).alias("s"), "full")).alias("m"))
    return m.select("lemma", "elided", F.col("m.full").alias("full"))


# Endings of moods by stem, voice and mood, in the order of PERSON_NUMBERS; an ending with an accent takes that
# of the stem.
PERSON_NUMBERS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl", "2du", "3du")
SYNTHETIC = {
    ("present", "active_present_subjunctive"): ("ω", "ῃς", "ῃ", "ωμεν", "ητε", "ωσι(ν)", "ητον", "ητον"),
    ("present", "active_present_optative"): ("οιμι", "οις", "οι", "οιμεν", "οιτε", "οιεν", "οιτον", "οίτην"),
    ("present", "active_present_imperative"): (None, "ε", "έτω", None, "ετε", "όντων", "ετον", "έτων"),
    ("present", "active_present_infinitive"): ("ειν",),
    ("aorist", "active_aorist_subjunctive"): ("ω", "ῃς", "ῃ", "ωμεν", "ητε", "ωσι(ν)"),
    ("aorist", "active_aorist_optative"): ("αιμι", "αις", "αι", "αιμεν", "αιτε", "αιεν"),
    ("aorist", "active_aorist_imperative"): (None, "ον", "άτω", None, "ατε", "άντων"),
    ("aorist", "active_aorist_infinitive"): ("αι",),
    ("present", "middle_present_subjunctive"): ("ωμαι", "ῃ", "ηται", "ώμεθα", "ησθε", "ωνται"),
    ("present", "middle_present_optative"): ("οίμην", "οιο", "οιτο", "οίμεθα", "οισθε", "οιντο"),
    ("present", "middle_present_imperative"): (None, "ου", "έσθω", None, "εσθε", "έσθων"),
    ("present", "middle_present_infinitive"): ("εσθαι",),
    ("aorist", "middle_aorist_subjunctive"): ("ωμαι", "ῃ", "ηται", "ώμεθα", "ησθε", "ωνται"),
    ("aorist", "middle_aorist_optative"): ("αίμην", "αιο", "αιτο", "αίμεθα", "αισθε", "αιντο"),
    ("aorist", "middle_aorist_imperative"): (None, "αι", "άσθω", None, "ασθε", "άσθων"),
    ("aorist", "middle_aorist_infinitive"): ("ασθαι",),
    ("passive", "passive_aorist_subjunctive"): ("ῶ", "ῇς", "ῇ", "ῶμεν", "ῆτε", "ῶσι(ν)"),
    ("passive", "passive_aorist_optative"): ("είην", "είης", "είη", "εῖμεν", "εῖτε", "εῖεν", "εῖτον", "είτην"),
    ("passive", "passive_aorist_imperative"): (None, "ητι", "ήτω", None, "ητε", "έντων"),
    ("passive", "passive_aorist_infinitive"): ("ῆναι",),
}
# Participles of the third declension by stem and tense: nominative of masculine and neuter, stem of the other
# cases, genitive and dative plural, and the feminine in singular and plural; and the links and endings of those in -μενος.
THIRD = {
    ("present", "active_present"): ("ων", "ον", "οντ", "όντων", "ουσι(ν)", ("ουσᾰ", "ούσης", "ούσῃ", "ουσᾰν", "ουσᾰ"), ("ουσαι", "ουσῶν", "ούσαις", "ούσᾱς", "ουσαι")),
    ("aorist", "active_future"): ("ων", "ον", "οντ", "όντων", "ουσι(ν)", ("ουσα", "ούσης", "ούσῃ", "ουσαν", "ουσα"), ("ουσαι", "ουσῶν", "ούσαις", "ούσᾱς", "ουσαι")),
    ("aorist", "active_aorist"): ("ας", "αν", "αντ", "άντων", "ασι(ν)", ("ᾱσα", "ᾱ́σης", "ᾱ́σῃ", "ᾱσαν", "ᾱσα"), ("ᾱσαι", "ᾱσῶν", "ᾱ́σαις", "ᾱ́σᾱς", "ᾱσαι")),
    ("passive", "passive_aorist"): ("είς", "έν", "έντ", "έντων", "εῖσι(ν)", ("εῖσα", "είσης", "είσῃ", "εῖσαν", "εῖσα"), ("εῖσαι", "εισῶν", "είσαις", "είσᾱς", "εῖσαι")),
    ("perfect", "active_perfect"): ("ώς", "ός", "ότ", "ότων", "όσι(ν)", ("υῖα", "υίᾱς", "υίᾳ", "υῖαν", "υῖα"), ("υῖαι", "υιῶν", "υίαις", "υίᾱς", "υῖαι")),
}
MENOS = {
    ("present", "middle_present"): ("όμεν", "ομέν"), ("aorist", "middle_future"): ("όμεν", "ομέν"), ("passive", "passive_future"): ("ησόμεν", "ησομέν"), ("aorist", "middle_aorist"): ("άμεν", "αμέν"),
    ("perfect_mp", "middle_perfect"): ("μέν", "μέν"),
}
MENOS_ENDINGS = {
    "m": (("ος", "ου", "ῳ", "ον", "ε"), ("οι", "ων", "οις", "ους", "οι")), "f": (("η", "ης", "ῃ", "ην", "η"), ("αι", "ων", "αις", "ᾱς", "αι")), "n": (("ον", "ου", "ῳ", "ον", "ον"), ("α", "ων", "οις", "α", "α")),
}
SHORT = ("ος", "ον", "ε", "οι", "α", "αι")
#: The consonant of a sigmatic aorist by the end of the present stem.
SIGMATIC = {"πβφ": "ψ", "κγχ": "ξ", "τδθνζαεηιουω": "σ"}
TONELESS = T._table(lambda c: T.ud.normalize("NFC", "".join(x for x in T.ud.normalize("NFD", c) if x not in "́̀͂")), T._GREEK)


def participle_endings() -> list[tuple]:
    """(stem kind, key, ending) of participles in singular and plural. The accent of those in -μενος stands before the link if the ending is short."""
    rows = []
    for (kind, cell), (nom, neuter, stem, gen, dat, *feminine) in THIRD.items():
        oblique = {"gen": f"{stem}ος", "dat": f"{stem}ι"}
        table = {
            "m": ((nom, oblique["gen"], oblique["dat"], f"{stem}α", nom), (f"{stem}ες", gen, dat, f"{stem}ας", f"{stem}ες")),
            "n": ((neuter, oblique["gen"], oblique["dat"], neuter, neuter), (f"{stem}α", gen, dat, f"{stem}α", f"{stem}α")),
            "f": feminine,
        }
        rows += [(kind, f"{cell}_participle_{c}_{g}_{n}", e) for g, numbers in table.items() for n, es in zip(("sg", "pl"), numbers, strict=True) for c, e in zip(CASES.values(), es, strict=True)]
    for (kind, cell), (short, long) in MENOS.items():
        rows += [(kind, f"{cell}_participle_{c}_{g}_{n}", (short if e in SHORT else long) + e) for g, numbers in MENOS_ENDINGS.items() for n, es in zip(("sg", "pl"), numbers, strict=True) for c, e in zip(CASES.values(), es, strict=True)]
    return rows


def synthetic_endings() -> list[tuple]:
    """(stem kind, key, ending, whether the ending bears the accent) of moods, infinitives and participles."""
    rows = participle_endings()
    for (kind, cell), endings in SYNTHETIC.items():
        for pn, e in zip(PERSON_NUMBERS, endings, strict=False):
            if e is not None:
                rows.append((kind, cell if cell.endswith("infinitive") else f"{cell}_{pn}", e))
    return [(*r, bool(set(T.ud.normalize("NFD", r[2])) & set("́̀͂"))) for r in rows]


def stems(verbs: DataFrame) -> DataFrame:
    """(lemma, kind, stem) of plain verbs in -ω: the present stem of the lemma, the sigmatic aorist stem and the stem of the passive aorist.

    And those of the perfect, of consonants only, and of its middle. verbs: (lemma, fut, aor, aor_p, pf, pf_mp), composed; parts that are not known are null. The aorist stem is that of the future, else
    the present stem with the consonant of the aorist, if that is the regular one and the rest of the aorist is the present's.
    """
    bare = lambda c: T.strip_accents(F.lower(c))
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    last = lambda c: F.substring(c, -1, 1)
    lemma = F.col("lemma")
    v = verbs.where(lemma.rlike("[ωώ]$") & ~bare(lemma).rlike("[αεο]ω$") & (F.length(bare(lemma)) >= 2))
    v = v.select("lemma", "fut", "aor", "aor_p", "pf", "pf_mp", cut(lemma, 1).alias("present"), bare(cut(lemma, 1)).alias("_p"), bare("aor").alias("_a"))
    future = F.when(F.col("fut").rlike("[ωώ]$") & last(bare(cut(F.col("fut"), 1))).isin("σ", "ψ", "ξ"), cut(F.col("fut"), 1))
    end = last(F.col("_p"))
    sign = F.lit(None).cast("string")
    for letters, c in SIGMATIC.items():
        sign = F.when(end.isin(*letters), c).otherwise(sign)
    vowel = end.isin(*"αεηιουω")
    a = F.col("_a")
    root = F.when(a.rlike("^ε[^αεηιουω]"), F.substring(a, F.lit(2), F.length(a))).when(a.startswith("η"), F.concat(F.lit("α"), F.substring(a, F.lit(2), F.length(a)))).when(a.startswith("ω"), F.concat(F.lit("ο"), F.substring(a, F.lit(2), F.length(a)))).otherwise(a)
    root, own = cut(root, 2), F.when(vowel, F.col("_p")).otherwise(cut(F.col("_p"), 1))
    regular = a.rlike("[σψξ]α$") & (F.substring(a, -2, 1) == sign) & ((root == "") | (own == "") | (root == own))
    grafted = F.when(regular, F.concat(F.when(vowel, F.col("present")).otherwise(cut(F.col("present"), 1)), sign))
    body = F.when(bare(F.substring("aor_p", 1, 1)) == "ε", F.substring("aor_p", F.lit(2), F.length("aor_p")))
    passive = F.when(bare(body).rlike("θην$"), cut(body, 2))
    perfect = F.when(bare("pf").rlike("[^αεηιουω]α$"), cut(F.col("pf"), 1))
    middle = F.when(bare("pf_mp").endswith("μαι"), cut(F.col("pf_mp"), 3))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("stem")) for k, c in (("present", F.col("present")), ("aorist", F.coalesce(future, grafted)), ("passive", passive), ("perfect", perfect), ("perfect_mp", middle))])
    return v.select("lemma", F.explode(named).alias("x")).select("lemma", "x.kind", "x.stem").where("stem IS NOT NULL")


def synthesised(verbs: DataFrame, attested_: DataFrame) -> DataFrame:
    """(lemma, key, form): regular moods, infinitives and participles of the three voices for the cells that are not attested. attested_: (lemma, key)."""
    ends = F.broadcast(verbs.sparkSession.createDataFrame(synthetic_endings(), "kind string, key string, ending string, accented boolean"))
    toneless = F.translate(F.translate(F.col("stem"), *TONELESS), "́̀͂", "")
    forms = stems(verbs).join(ends, "kind").select("lemma", "key", F.concat(F.when(F.col("accented"), toneless).otherwise(F.col("stem")), "ending").alias("form"))
    return forms.join(attested_.select("lemma", "key").distinct(), ["lemma", "key"], "left_anti")


def declined_by_class(nouns: DataFrame, forms: DataFrame) -> DataFrame:
    """(lemma, form, exemplar): nouns declined like the noun of their class of which most forms are known, without marks.

    A class is the gender with the endings of nominative and genitive after the stem both share, less a last vowel. nouns:
    (lemma, gender, genitive); forms: (lemma, form) known. The exemplar's forms give their endings after its stem; of several
    with equally many the smallest counts.
    """
    from logothek.operators.frequency import prefix_of

    bare = lambda c: T.strip_accents(F.lower(c))
    after = lambda c, n: F.substring(F.col(c), F.col(n) + 1, F.length(c))
    n = nouns.select("lemma", "gender", bare("lemma").alias("_h"), bare("genitive").alias("_g")).where("length(_h) > 1 AND length(_g) > 0")
    n = n.withColumn("_s", prefix_of("_h", "_g"))
    k = F.when((F.length("_s") > 1) & F.substring("_s", -1, 1).isin(*"αεηιουω"), F.length("_s") - 1).otherwise(F.length("_s"))
    n = n.withColumn("_k", F.least(k, F.length("_h") - 1))
    n = n.select("lemma", "gender", F.substring(F.col("_h"), F.lit(1), F.col("_k")).alias("stem"), after("_h", "_k").alias("nom"), after("_g", "_k").alias("gen")).distinct()
    cls = ["gender", "nom", "gen"]
    ends = n.join(forms.select("lemma", bare("form").alias("_f")).distinct(), "lemma").where(F.col("_f").startswith(F.col("stem")))
    ends = ends.select(*cls, "lemma", F.expr("substring(_f, length(stem) + 1)").alias("ending")).distinct()
    best = ends.groupBy(*cls, "lemma").agg(F.count("*").alias("n")).groupBy(*cls).agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("m")).select(*cls, F.col("m.lemma").alias("exemplar"))
    table = ends.join(best.withColumnRenamed("exemplar", "lemma"), [*cls, "lemma"]).select(*cls, F.col("lemma").alias("exemplar"), "ending")
    return n.join(table, cls).select("lemma", F.concat("stem", "ending").alias("form"), "exemplar").where(F.length("form") > 1).distinct()

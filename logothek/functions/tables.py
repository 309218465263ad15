"""Fixed values of Greek: closed word classes, crasis, prefixes, marks and correspondences of letters."""

# Marks of elision, and vowels to try in their place.
ELISION_MARKS = ("̓", "’", "ʼ", "'", "᾽", "ʹ", "᾿")
VOWELS = "αεοιηυω"
ACCENTED = {"α": "ά", "ε": "έ", "ι": "ί", "ο": "ό", "η": "ή", "υ": "ύ", "ω": "ώ"}
DEASSIMILATED = {"θ": "τ", "φ": "π", "χ": "κ"}
VOWEL_RANK = "εαοιηυω"
ELISION_STEMS = ("αλλ", "μετ", "παρ", "κατ", "δι", "απ", "επ", "υπ", "αφ", "εφ", "υφ", "μηδ", "ουδ", "αντ", "περ", "καθ", "μεθ", "ανθ")
FUNCTION_LEMMAS = ("ἀλλά", "μετά", "παρά", "κατά", "διά", "ἀπό", "ἐπί", "ὑπό", "μηδέ", "οὐδέ", "ἀντί", "περί", "δέ", "γε", "τε", "ἄρα", "ἔτι")

# Forms of the articles and pronouns.
ARTICLE = "ὁ"
ARTICLES = (
    "ὁ", "ἡ", "τό", "τοῦ", "τῆς", "τῶν", "τόν", "τήν", "τά", "τοῖς", "ταῖς", "τῷ", "τῇ", "τούς", "τάς", "τοῖν", "ταῖν", "οἱ", "αἱ", "τώ",
    "τὸ", "τοὺς", "τὰ", "τὸν", "τὴν", "τὰς", "αἵ", "οἵ", "ο", "η", "το", "του", "της", "των", "τον", "την", "τα", "τους", "τοις", "οι", "αι", "τω", "ται",
)
MG_ARTICLES = ("ο", "η", "το", "τον", "την", "του", "της", "τα", "τους", "τις", "των", "τη", "οι")
PRONOUNS = {
    "μοι": "ἐγώ", "μοί": "ἐγώ", "μου": "ἐγώ", "με": "ἐγώ", "ἐμοί": "ἐγώ", "ἐμοῦ": "ἐγώ", "ἐμέ": "ἐγώ", "ἡμεῖς": "ἐγώ", "ἡμῶν": "ἐγώ", "ἡμῖν": "ἐγώ", "ἡμᾶς": "ἐγώ",
    "σοι": "σύ", "σοί": "σύ", "σου": "σύ", "σε": "σύ", "σοῦ": "σύ", "ὑμεῖς": "σύ", "ὑμῶν": "σύ", "ὑμῖν": "σύ", "ὑμᾶς": "σύ",
}
MG_CLOSED = {
    "στη": "σε", "στην": "σε", "στο": "σε", "στον": "σε", "στου": "σε", "στους": "σε", "στις": "σε", "στα": "σε", "στης": "σε", "στων": "σε",
    "ένα": "ένας", "μία": "ένας", "μια": "ένας", "ενός": "ένας", "μίας": "ένας", "μιας": "ένας",
    "είναι": "είμαι", "ήταν": "είμαι", "ήμουν": "είμαι", "ήσουν": "είμαι", "ήμαστε": "είμαι", "ήσαστε": "είμαι",
    "έχει": "έχω", "είχε": "έχω", "έχουν": "έχω", "είχαν": "έχω", "έχεις": "έχω", "είχες": "έχω", "έχουμε": "έχω", "είχαμε": "έχω",
    "αυτό": "αυτός", "αυτόν": "αυτός", "αυτήν": "αυτός", "αυτού": "αυτός", "αυτής": "αυτός", "αυτών": "αυτός", "αυτούς": "αυτός", "αυτές": "αυτός", "αυτοί": "αυτός", "αυτά": "αυτός",
}

# Endings of ancient lemmas and what the modern language has for them, and endings of the adjectives that
# adverbs and neuters are filed under.
MODERN_ENDINGS = {"ον": "ο", "σις": "ση", "ξις": "ξη", "ψις": "ψη", "έω": "ώ", "άω": "ώ", "όω": "ώ"}
ADVERB_ENDINGS = ("ος", "ης", "υς", "ων", "ις")
NEUTER_ENDINGS = ("ος", "ης")

# Contractions of two words, with the lemma of the one that counts.
CRASIS = {
    "τοὔνομα": "ὄνομα", "τοὔνεκα": "τοὔνεκα", "τοὐναντίον": "ἐναντίος", "τοὐμόν": "ἐμός", "τοὐμπαλιν": "ἔμπαλιν", "τἀργύριον": "ἀργύριον", "τἀδικήματα": "ἀδίκημα",
    "τἀναγκαῖα": "ἀναγκαῖος", "τἀνδρός": "ἀνήρ", "τἀνδρί": "ἀνήρ", "τἆλλα": "ἄλλος", "τἀκεῖ": "ἐκεῖ", "τὠνόματα": "ὄνομα", "τὠυτό": "αὐτός", "ταὐτός": "αὐτός", "ταὐτά": "αὐτός", "θάτερα": "ἕτερος",
    "κἀγώ": "ἐγώ", "κἀγαθός": "ἀγαθός", "κἀκ": "ἐκ", "κἀν": "ἐν", "κἄν": "ἄν", "κἀκείνων": "ἐκεῖνος", "κἀκεῖθεν": "ἐκεῖθεν", "κἀνταῦθα": "ἐνταῦθα", "κεἰς": "εἰς", "κᾷτα": "εἶτα", "καὐτός": "αὐτός",
    "αὑτή": "αὐτός", "αὑτοῦ": "αὐτός", "οὑκ": "ἐκ", "ἁνήρ": "ἀνήρ", "ὡνήρ": "ἀνήρ", "ὦνερ": "ἀνήρ", "ἅνδρες": "ἀνήρ", "ἇνδρες": "ἀνήρ", "ὧνδρες": "ἀνήρ", "ὦνδρες": "ἀνήρ", "ὤριστος": "ἄριστος", "μεντἄν": "ἄν",
}

# Particles at the end of words, stems that take a deictic iota, prefixes, augments, link vowels.
PARTICLES = ("περ", "γε", "δε")
DEICTIC = (
    "τουτο", "τουτω", "τουτοισ", "τουτου", "τουτων", "τουτοι", "ταυτη", "ταυτα", "ταυτησ", "ταυτων", "ταυται", "ταυταισ",
    "τουτουσ", "τουτοισι", "ταυτασ", "ταυτησι", "τοδ", "τηδ", "τωδ", "τονδ", "τηνδ", "ενθαδ",
)
PREFIXES = ("ἀντι", "ἐπι", "ὑπερ", "παρα", "κατα", "ἀπο", "μετα", "περι", "προσ", "ἀνα", "δια", "ὑπο", "ἐξ", "ἐκ", "εἰσ", "εἰς", "συν", "συμ", "συγ", "συλ", "ἐν", "προ")
AUGMENTS = (("η", ("ε", "α")), ("ω", ("ο",)), ("ηυ", ("ευ",)), ("ει", ("ε",)), ("ηι", ("αι",)))
LINK_VOWELS = "οιυ"
ARTICLE_GENDER = {
    "m": ("ὁ", "τοῦ", "τῷ", "τόν", "οἱ", "τῶν", "τοῖς", "τούς", "τὸν", "τοὺς"),
    "f": ("ἡ", "τῆς", "τῇ", "τήν", "αἱ", "ταῖς", "τάς", "τὴν", "τὰς"),
    "n": ("τό", "τά", "τὸ", "τὰ"),
}

# Iota written after the vowel it belongs under.
IOTA_ADSCRIPT = (("ωι", "ῳ"), ("ηι", "ῃ"), ("ῶι", "ῷ"), ("ῆι", "ῇ"), ("ώι", "ῴ"), ("ήι", "ῄ"), ("ὼι", "ῲ"), ("ὴι", "ῂ"))
SMOOTH = dict(zip("αεηιουω", "ἀἐἠἰὀὐὠ", strict=True))
ROUGH = dict(zip("αεηιουω", "ἁἑἡἱὁὑὡ", strict=True))

# Letters that recognition of print confuses, with the cost of taking one for the other.
OCR_PAIRS = (
    ("ο", "o", 0.1), ("Ο", "O", 0.1), ("ρ", "p", 0.1), ("Ρ", "P", 0.1), ("ν", "v", 0.1), ("Ν", "N", 0.1), ("τ", "t", 0.1), ("Τ", "T", 0.1), ("κ", "k", 0.1), ("Κ", "K", 0.1),
    ("α", "a", 0.1), ("Α", "A", 0.1), ("η", "n", 0.2), ("Η", "H", 0.1), ("ε", "e", 0.1), ("Ε", "E", 0.1), ("ι", "i", 0.1), ("υ", "u", 0.1), ("Υ", "Y", 0.1), ("χ", "x", 0.1),
    ("Χ", "X", 0.1), ("ω", "w", 0.2), ("β", "B", 0.2), ("γ", "y", 0.3), ("δ", "d", 0.3), ("ο", "о", 0.0), ("α", "а", 0.0), ("ε", "е", 0.0), ("υ", "у", 0.0), ("κ", "к", 0.0),
    ("ρ", "р", 0.0), ("ο", "σ", 0.5), ("θ", "δ", 0.5), ("η", "π", 0.5), ("ν", "μ", 0.7), ("ρ", "β", 0.7), ("ι", "ΐ", 0.3), ("υ", "ΰ", 0.3), ("1", "I", 0.1), ("1", "l", 0.1),
    ("ψ", "J", 0.2), ("ψ", "j", 0.2), ("υ", "J", 0.3), ("υ", "j", 0.3), ("ὑ", "J", 0.2), ("ὑ", "j", 0.2), ("θ", "Q", 0.3), ("θ", "q", 0.3), ("σ", "Q", 0.3), ("σ", "q", 0.3),
)

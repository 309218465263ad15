"""Principal parts of real entry heads; the texts are quotations from a public dictionary, shortened."""

from pyspark.sql import functions as F

from logothek.functions.entries import principal_parts, principal_parts_of

HEADS = {
    "γράφω": (
        "[ᾰ], fut. -ψω Hdt.1.95, etc.: aor. ἔγραψα, Ep. γράψα Il.17.599: pf. γέγραφα Cratin.124; later γεγράφηκα:—Med., fut. γράψομαι Ar. etc. (but in pass. sense, Gal.): aor. ἐγραψάμην Ar.V.894, etc.:—Pass., fut. γρᾰφήσομαι Hp.Acut.26; aor. ἐγράφην [ᾰ], Hdt.4.91; ἐγράφθην SIG57.5: pf. γέγραμμαι",
        {"aor": "ἔγραψα", "pf": "γέγραφα", "fut_med": "γράψομαι", "aor_med": "ἐγραψάμην", "fut_p": "γρᾰφήσομαι", "aor_p": "ἐγράφην", "pf_mp": "γέγραμμαι"},
    ),
    "λείπω": (
        "impf. ἐλείπον ἔλειπον Il.19.288: fut. λείψω 18.11: aor. 1 ἔλειψα, part. λείψας Ar.Fr.965: writers use aor. 2 ἔλῐπον Il.2.35: pf. λέλοιπα Od.14.134: plpf. ἐλελοίπειν (Att. -η):—Med., in compds.: aor. 2 ἐλιπόμην Hdt.1.186:—Pass., fut. Med. in pass. sense λείψομαι etc.: aor. ἐλείφθην, λείφθην: pf. λέλειμμαι: plpf. ἐλελείμμην",
        {"impf": "ἐλείπον", "fut": "λείψω", "aor1": "ἔλειψα", "aor2": "ἔλῐπον", "pf": "λέλοιπα", "plpf": "ἐλελοίπειν", "aor_med": "ἐλιπόμην", "aor_p": "ἐλείφθην", "pf_mp": "λέλειμμαι", "aor": "ἔλῐπον"},
    ),
    "παύω": (
        "Il.19.67, etc.: Ion. impf. παύεσκον Od.22.315: fut. παύσω Il.1.207; Ep. inf. παυσέμεν (κατα-) 7.36: aor. ἔπαυσα 15.15: pf. πέπαυκα D.20.70:—Med. and Pass., Ion. impf. παυέσκετο: fut. παύσομαι; παυσθήσομαι (v.l. παυθ-) Th.1.81: aor. ἐπαυσάμην Il.14.260; ἐπαύθην, Ep. παύθην, Hes.Th.533 (v.l. παυσθῇ); ἐπαύσθην : pf. πέπαυμαι",
        {"impf": "παύεσκον", "fut": "παύσω", "aor": "ἔπαυσα", "pf": "πέπαυκα", "fut_med": "παύσομαι", "aor_med": "ἐπαυσάμην", "aor_p": "ἐπαύθην", "pf_mp": "πέπαυμαι"},
    ),
    "ἀκούω": (
        "ἀκούω: Ep. impf. ἄκουον Il.12.442: fut. ἀκούσομαι (Act. ἀκούσω first in Hyp.: aor. ἤκουσα, Ep. ἄκουσα: pf. ἀκήκοα: plpf. ἀκηκόειν:—rare in Med., pres.: Ep. impf. ἀκούετο: aor. ἠκουσάμην Mosch.3.119:—Pass., fut. ἀκουσθήσομαι: aor. ἠκούσθην: pf. ἤκουσμαι: plpf. ἤκουστο",
        None,
    ),
    "λύω": ("poet. imper. λῦθι Pi.Fr.85: fut. λύσω but λῦτο 24.1 (at beginning of line, v.l. λύτο); λύντο 1 ῡ always:", {"fut": "λύσω"}),
    "ἔρχομαι": ("impf. οὐκ ἠρχόμην: fut. Ion. ἐλεύσομαι: aor. πέμ-πω", {"impf": "ἠρχόμην", "fut": "ἐλεύσομαι"}),
    "ποιέω": ("Dor. ποιϝέω IG4.800, ἐποίϝηh' (= ἐποίησε Ἀργεῖος SIG5 (vi B.C.)", {}),
}


def test_heads():
    for word, (text, want) in HEADS.items():
        got = principal_parts_of(text, word)
        if want is not None:
            assert got == want, word
    got = principal_parts_of(HEADS["ἀκούω"][0], "ἀκούω")
    assert (got["impf"], got["fut"], got["aor_p"], got["fut_p"], got["pf_mp"]) == ("ἄκουον", "ἀκούσομαι", "ἠκούσθην", "ἀκουσθήσομαι", "ἤκουσμαι")
    assert principal_parts_of("", "λύω") == {} and principal_parts_of("fut. " * 5000 + "λύσω", "λύω") == {"fut": "λύσω"}


def test_column(spark):
    df = spark.createDataFrame([("λύω", "fut. λύσω"), ("x", None), ("y", "")], "w string, t string")
    assert [r[0] for r in df.select(principal_parts(F.col("t"), F.col("w"))).collect()] == [{"fut": "λύσω"}, None, {}]

"""Segmentation, qualifiers and sections of single statements."""

from pyspark.sql import functions as F

from scoreloom.functions import concepts as C
from scoreloom.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_sentences(spark):
    cases = {
        "Residual height is 6 mm. The ridge is thin.": ["Residual height is 6 mm.", "The ridge is thin."],
        "Tooth n. 48 is impacted. No lesion.": ["Tooth n. 48 is impacted.", "No lesion."],
        "Width 4,5 mm; height 12.5 mm.": ["Width 4.5 mm", "height 12.5 mm."],
        "- first item. second": ["first item. second"],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, text, T.sentences) == want
    assert one(spark, None, T.sentences) == []


def test_phrases(spark):
    assert one(spark, "The sinus is clear, and the canal is regular.", T.phrases) == ["The sinus is clear.", "the canal is regular."]
    # a part without a verb can't stand alone
    assert one(spark, "The canals are regular, and the lingual course.", T.phrases) == ["The canals are regular, and the lingual course."]
    assert one(spark, "Normal.", T.phrases) == []


def test_keys_and_rendering(spark):
    assert one(spark, "Tooth 36 is impacted!", T.canonical) == "tooth # is impacted"
    assert one(spark, "Tooth 36", lambda c: T.canonical(c, False)) == "tooth n36"
    assert one(spark, "straße", T.canonical) == "strasse"
    assert one(spark, "the canal", T.capitalize_first) == "The canal"
    assert one(spark, "2 the canal", T.capitalize_first) == "2 the canal"
    assert not one(spark, "Clinical follow-up is recommended.", T.is_verifiable)
    assert one(spark, "p12", T.group_of) == "P" and one(spark, "123", T.group_of) == "UNKNOWN"
    assert not one(spark, "It has a crown", T.is_well_formed) and not one(spark, "apex of the root)", T.is_well_formed)
    assert not one(spark, "Lesion at tooth 36", T.is_generic) and one(spark, "No lesion is seen", T.is_generic)


def test_qualifiers(spark):
    assert one(spark, "Teeth 16, 17 and 26 are restored", C.teeth) == [16, 17, 26]
    assert one(spark, "tooth 99: see 36", C.teeth) == []  # a named number, though not a valid one, stops the bare search
    assert one(spark, "1.2 cm wide, 4,5 mm high", C.measurements) == [12.0, 4.5]
    assert one(spark, "Left and right canals", C.laterality) == "bilateral"


def test_mentions(spark):
    def said(text):
        return {m["concept"]: m["polarity"] for m in one(spark, text, C.mentions)}

    assert said("The maxilla is partially included in the scan and is not assessable.")["coverage_maxilla"] == "present"
    assert said("The condyles are not included in the volume.")["coverage_condyle"] == "absent"
    assert said("Absence of teeth 36 and 46.")["missing_tooth"] == "present"
    assert said("No periapical lesion.")["periapical_lesion"] == "absent"
    assert said("Possible cyst of the maxilla.")["cyst"] == "uncertain"
    assert one(spark, "Maxillary sinus is clear.", C.section) == "sinus" and one(spark, "Nothing here.", C.section) == "other"
    assert len(C.CONCEPTS) == 60

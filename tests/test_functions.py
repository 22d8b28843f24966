from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, spans, text, values


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "start", "end", "form"),
    [
        ("ש לשטרות (1491)", 1491, 1491, "seleucid_era"),
        ("תתק לשטרות", 588, 588, "seleucid_era"),
        ("תתקא לשטרות", 1589, 1589, "seleucid_era"),
        ("1542-1620", 1542, 1620, "gregorian_range"),
        ("ca. 1542-ca. 1620", 1542, 1620, "english_approximate"),
        ("ca. 1500", 1500, 1500, "english_approximate"),
        ("15th century", 1401, 1500, "english_century"),
        ("14th-15th cent.", 1301, 1500, "english_century"),
        ("1450 בערך", 1450, 1450, "hebrew_approximate"),
        ("נפטר 1450", None, 1450, "hebrew_approximate"),
        ("המאה הי״ז", 1601, 1700, "hebrew_century"),
        ("3000", None, None, None),
        ("1540-.", 1540, None, "gregorian_open"),
        ("1540?", 1540, 1540, "gregorian_single"),
        ("1234", 1234, 1234, "gregorian_single"),
        ('תשפ"ו', 2026, 2026, "standalone_hebrew_year"),
        ('תרצ"ה (1935)', 1935, 1935, "publication_hebrew_year"),
    ],
)
def test_dates(spark, said, start, end, form):
    r = one(spark, dates.resolve(F.lit(said)))
    assert (r["year_start"], r["year_end"], r["source_format"]) == (start, end, form) if form else r is None


@pytest.mark.parametrize("said", ["", None, "no date"])
def test_no_date(spark, said):
    assert one(spark, dates.resolve(F.lit(said).cast("string"))) is None


def test_person_dates(spark):
    p = one(spark, dates.person_dates(F.lit("1540-")))
    assert (p["birth_year"], p["death_year"], p["active_year"]) == (1540, None, None)
    assert one(spark, dates.person_dates(F.lit("15th century")))["active_year"] == 1450


def test_gematria_round_trip(spark):
    df = spark.range(1, 50_001).select("id", dates.letters(F.col("id")).alias("l"))
    assert df.where(~dates.gematria(F.col("l")).eqNullSafe(F.col("id").cast("int"))).count() == 0
    assert one(spark, dates.letters(F.lit(15))) == "טו"
    assert one(spark, dates.gematria(F.lit("abc"))) is None


def test_overlap(spark):
    n = F.lit(None).cast("int")
    assert one(spark, dates.overlap(F.lit(1540), F.lit(1620), F.lit(1543), F.lit(1630)))
    assert not one(spark, dates.overlap(F.lit(1540), F.lit(1620), F.lit(1200), F.lit(1260)))
    assert one(spark, dates.overlap(F.lit(1540), F.lit(1620), n, n))


def test_keys(spark):
    assert one(spark, text.name_key(F.lit("Émile  Zola, (x)"))) == "emile zola x"
    assert one(spark, text.name_key(F.lit(None).cast("string"))) == ""
    assert one(spark, text.place_key(F.lit("Haïfa (Israel)"))) == "haifa"
    assert one(spark, text.slug(F.lit("Émile Zola - x"))) == "Emile_Zola_x"
    assert one(spark, text.control_key(F.lit('"990 "'))) == "990"


def test_slots_keep_empty_places(spark):
    assert one(spark, text.split_slots(F.lit("a;;b"))) == ["a", "", "b"]
    assert one(spark, text.split_slots(F.lit("a|;b|"))) == ["a", ";b", ""]
    assert one(spark, text.split_values(F.lit('"a";;b'))) == ["a", "b"]
    assert one(spark, text.align(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")))) is None


def test_titles(spark):
    assert one(spark, text.title_core(F.lit("על חלק ספר  הזהר ;."))) == "ספר הזהר"
    assert one(spark, text.title_variants(F.lit("Title."))) == ["Title.", "Title"]
    assert tuple(one(spark, text.split_title(F.lit("Main : rest / x")))) == ("Main", "rest / x")


def test_trigrams(spark):
    assert one(spark, text.trigrams(F.lit("Cat"))) == ["  c", " ca", "cat", "at "]
    assert one(spark, text.trigrams(F.lit(""))) == []


def test_headings(spark):
    assert one(spark, text.heading_matches(F.lit("Cohen, Moshe"), F.lit("Kohen, Mosheh")))
    assert not one(spark, text.heading_matches(F.lit("Cohen, Moshe"), F.lit("Levi, David")))


def test_values(spark):
    assert one(spark, values.loose_number(F.lit(" 1,234.5"))) == 1234.5
    assert one(spark, values.loose_number(F.lit("x"))) is None
    assert not one(spark, values.valid_point(F.lit(0.0), F.lit(0.0)))
    assert tuple(one(spark, values.wkt_point(F.lit("Point(35.2 31.7)")))) == (35.2, 31.7)
    assert tuple(one(spark, values.dimensions(F.lit("21 x 15.5 cm")))) == (210.0, 155.0)
    assert one(spark, values.same_quantity(F.lit("+11"), F.lit("11.0")))
    got = values.patch_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.create_map(F.lit(0), F.lit("z")), F.array(F.lit(1)), F.array(F.lit("n")))
    assert one(spark, got) == ["z", "c", "n"]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("[2], 160 leaves", (162, "leaf", 0)),
        ("2 כרכים (160, 210 דף)", (370, "leaf", 2)),
        ("XII, 40 pages", (52, "page", 0)),
        ("קס דף", (160, "leaf", 0)),
        ("160 דף (חסר)", (160, "leaf", 0)),
        ("דף 2א-2ב", None),
        ("12 columns", None),
        ("כ\"ד, 8 דפים", (32, "leaf", 0)),
        ("2 ו-30 עלים", (32, "leaf", 0)),
        ("xii, [3], 200 pp. ; 20 cm", (215, "page", 0)),
        ("folios 3-5", None),
        ("leaf 12", None),
        ("about 12 pages (8 missing)", (12, "page", 0)),
        ("leaves", None),
        ("", None),
    ],
)
def test_extent(spark, said, want):
    x = one(spark, spans.extent(F.lit(said)))
    assert (tuple(x) if x else None) == want


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("ספרד", ["topic"]),
        ("ירושלים", ["place"]),
        ("Genesis", ["book of the bible"]),
        ("TPP", ["topic", "capitals only"]),
        ("משה?", ["marked as uncertain"]),
        ("ABC", ["capitals only"]),
        ("נח", ["too few letters"]),
        ("רות", ["book of the bible"]),
        ("", ["no text"]),
        (None, ["no text"]),
        ("משה ממנטובה", []),
        ("Moshe", []),
    ],
)
def test_person_doubts(spark, name, want):
    assert one(spark, spans.person_doubts(F.lit(name).cast("string"))) == want


def test_person_in_a_subject_heading(spark):
    assert one(spark, spans.person_doubts(F.lit("Moshe"), F.lit("נושא נוסף: "))) == ["in a subject heading"]


@pytest.mark.parametrize(("said", "want"), [("XIV", 14), ("mcmxcix", 1999), ("IV.", 4), ("A", None), ("", None)])
def test_roman(spark, said, want):
    assert one(spark, spans.roman(F.lit(said))) == want

"""Years, year ranges, calendars and gematria as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# fixed values: the numbers that Hebrew letters stand for
LETTERS = {
    "א": 1, "ב": 2, "ג": 3, "ד": 4, "ה": 5, "ו": 6, "ז": 7, "ח": 8, "ט": 9,
    "י": 10, "כ": 20, "ך": 20, "ל": 30, "מ": 40, "ם": 40, "נ": 50, "ן": 50,
    "ס": 60, "ע": 70, "פ": 80, "ף": 80, "צ": 90, "ץ": 90, "ק": 100, "ר": 200,
    "ש": 300, "ת": 400,
}
GERESH = "׳"
MARKS = r"[\"'״״׳]"
LARGEST = 50_000
CALENDAR_OFFSET = 3_760
SELEUCID = "לשטרות"
SELEUCID_OFFSET = 312
LIFESPAN = 120
COPYING_ROLES = ("scribe", "transcriber", "copyist")
TOLERANCE = 5


def _sum(text: Column) -> Column:
    """Sum of the letters of a text without marks; null if it has any other character."""
    table = F.create_map(*(F.lit(x) for kv in LETTERS.items() for x in kv))
    letters = F.filter(F.split(F.regexp_replace(text, MARKS, ""), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda a, x: a + F.try_element_at(table, x))


def gematria(c: Column) -> Column:
    """Number that letters stand for, 1 to 50,000; letters before a geresh count thousands. Digits are read as they are."""

    def value(t: Column) -> Column:
        high, low = F.split(t, GERESH, 2)[0], F.regexp_extract(t, f"^[^{GERESH}]*{GERESH}(.*)$", 1)
        digits = t.try_cast("int")
        return F.when(t == "", None).when(t.rlike(r"^\d+$"), digits).when(F.contains(t, F.lit(GERESH)), _sum(high) * 1000 + F.coalesce(_sum(low), F.lit(0))).otherwise(_sum(t))

    n = let(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "'", GERESH), value)
    return let(n, lambda v: F.when(v.between(1, LARGEST), v))


def letters(n: Column) -> Column:
    """Letters of a number from 1 to 50,000, with geresh after thousands and gershayim before the last of several letters."""
    hundreds = "".join(x for x in "תשרק")

    def below_1000(m: Column) -> Column:
        high = F.concat(F.repeat(F.lit("ת"), (m / 400).cast("int")), F.when(m % 400 >= 100, F.substring(F.lit(hundreds[::-1]), ((m % 400) / 100).cast("int"), F.lit(1))).otherwise(""))
        tens = F.when(m % 100 >= 10, F.substring(F.lit("יכלמנסעפצ"), ((m % 100) / 10).cast("int"), F.lit(1))).otherwise("")
        ones = F.when(m % 10 >= 1, F.substring(F.lit("אבגדהוזחט"), m % 10, F.lit(1))).otherwise("")
        body = F.concat(high, tens, ones)
        marked = F.when(F.length(body) >= 2, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit("״"), F.right(body, F.lit(1)))).otherwise(body)
        return F.when(m == 15, "טו").when(m == 16, "טז").otherwise(marked)

    thousands = F.when(n >= 1000, F.concat(below_1000((n / 1000).cast("int")), F.lit(GERESH))).otherwise("")
    return F.when(n.between(1, LARGEST), F.concat(thousands, below_1000((n % 1000).cast("int"))))


def to_common_era(hebrew_year: Column) -> Column:
    return F.when(hebrew_year.between(5_001, 5_999), hebrew_year - CALENDAR_OFFSET)


def to_hebrew_year(year: Column) -> Column:
    y = year + CALENDAR_OFFSET
    return F.when((year > 100) & (year < 2_100) & y.between(5_001, 5_999), y)


def letters_to_year(c: Column) -> Column:
    """Common-era year of abbreviated Hebrew year letters."""
    return let(gematria(c), lambda n: to_common_era(F.when(n.between(1, 999), n + 5_000).otherwise(n)))


def century_range(century: Column, bce: Column | None = None) -> Column:
    """First and last year of a century; those before the common era are negative."""
    ahead = F.struct(((century - 1) * 100).alias("year_start"), (century * 100 - 1).alias("year_end"))
    back = F.struct((-century * 100 + 1).alias("year_start"), (-(century - 1) * 100).alias("year_end"))
    return ahead if bce is None else F.when(bce, back).otherwise(ahead)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = TOLERANCE) -> Column:
    """Whether two year ranges may overlap: a side without any year rules nothing out, a missing
    bound is a lifespan away from the other one."""
    lo = lambda s, e: F.coalesce(s, e - LIFESPAN)
    hi = lambda s, e: F.coalesce(e, s + LIFESPAN)
    unknown = (a_start.isNull() & a_end.isNull()) | (b_start.isNull() & b_end.isNull())
    return unknown | ((lo(a_start, a_end) - tolerance <= hi(b_start, b_end)) & (lo(b_start, b_end) - tolerance <= hi(a_start, a_end)))


Y, C, DASH = r"(\d{3,4})", r"(\d{1,2})", r"\s*[-–]\s*"
ORDINAL, ABOUT, HEBREW_NUMERAL = C + "(?:st|nd|rd|th)", r"(?:approximately|approx\.?|ca\.?)\s*", r"([א-ת\"'״׳]{1,5})"
ABOUT_HEBREW, DIED, BORN, ACTIVE, CENTURY = "בערך", "נפטר", "נולד", "(?:פעל|פעיל)", r"מאה\s+ה-?"


@dataclass(frozen=True)
class Form:
    """One way to write a date. ``start`` and ``end`` are groups of ``pattern`` (0: open); ``unit`` is what they count. The text has ``needs`` and
    lacks ``lacks``; ``about`` says that it is approximate, or the pattern that says so. ``plausible``: years from 101 to 2099 only."""

    name: str
    pattern: str
    start: int = 1
    end: int = 1
    unit: str = "year"
    about: bool | str = True
    needs: str = ""
    lacks: str = "$^"
    plausible: bool = False


# fixed values: the names of the forms; the most specific come first
FORMS = (
    Form("seleucid_era", rf"\({Y}\)", about=False, needs=SELEUCID),
    Form("seleucid_era", rf"([א-ת\"'״׳]+)\s*{SELEUCID}", unit="seleucid year", plausible=True),
    Form("publication_hebrew_year", rf"\({Y}\)", about=False, needs="[א-ת]"),
    Form("hebrew_approximate", rf"{Y}\s*{ABOUT_HEBREW}{DASH}{Y}", end=2),
    Form("hebrew_approximate", rf"{ABOUT_HEBREW}\s*{Y}{DASH}{Y}", end=2),
    Form("hebrew_approximate", rf"{DIED}\s+{Y}", start=0, about=ABOUT_HEBREW),
    Form("hebrew_approximate", rf"{BORN}\s+{Y}", end=0, about=ABOUT_HEBREW),
    Form("hebrew_approximate", rf"{Y}\s*{ABOUT_HEBREW}"),
    Form("hebrew_active", rf"{ACTIVE}\s+ב?{CENTURY}{C}{DASH}{C}", end=2, unit="century"),
    Form("hebrew_active", rf"{ACTIVE}\s+ב?{CENTURY}{C}", unit="century"),
    Form("hebrew_active", rf"{ACTIVE}\s+ב?{CENTURY}{HEBREW_NUMERAL}", unit="century in letters"),
    Form("hebrew_active", rf"{ACTIVE}\s+{Y}"),
    Form("hebrew_century", rf"{CENTURY}{C}{DASH}{C}", end=2, unit="century"),
    Form("hebrew_century", rf"{CENTURY}{C}", unit="century"),
    Form("hebrew_century", rf"{CENTURY}{HEBREW_NUMERAL}", unit="century in letters"),
    Form("english_approximate", rf"(?i){ABOUT}{Y}{DASH}{ABOUT}{Y}", end=2),
    Form("english_approximate", rf"(?i)(?:ca\.?|c\.)\s*{Y}"),
    Form("english_century", rf"(?i){ORDINAL}{DASH}{ORDINAL}\s*cent", end=2, unit="century"),
    Form("english_century", rf"(?i){ORDINAL}\s*cent", unit="century"),
    Form("gregorian_uncertain_range", rf"{Y}\s*\??{DASH}\??\s*{Y}", end=2, needs=r"\?"),
    Form("gregorian_open", rf"{Y}{DASH}[. ]*$", end=0, about=False),
    Form("gregorian_range", rf"{Y}{DASH}{Y}", end=2, about=False, lacks=r"\?", plausible=True),
    Form("gregorian_single", r"\b(\d{4})\b", about=r"[?\[]", plausible=True),
    Form("standalone_hebrew_year", r"(?s)^(.*[א-ת].*[א-ת].*)$", unit="letters of a year", plausible=True),
)
ACTIVITY = ("hebrew_century", "english_century", "hebrew_active")
LAST_CENTURY = 25
LEAST_YEAR_LETTERS = 50


def _bounds(c: Column, unit: str) -> tuple[Column, Column]:
    """First and last year of what one group of a form says, null where that cannot be."""
    if unit.startswith("century"):
        n = _sum(c) if unit == "century in letters" else c.try_cast("int")
        n = F.when(n.between(1, LAST_CENTURY), n) if unit == "century in letters" else n
        return (n - 1) * 100 + 1, n * 100
    if unit == "seleucid year":
        n = _sum(c)
        year = n + F.when(F.regexp_replace(c, MARKS, "").startswith("א") | (n > 900), 1000).otherwise(0) - SELEUCID_OFFSET
    elif unit == "letters of a year":
        n = _sum(F.regexp_replace(c, "[^א-ת]", ""))
        year = F.when(n >= LEAST_YEAR_LETTERS, n + 5_000 - CALENDAR_OFFSET)
    else:
        year = c.try_cast("int")
    return year, year


def _as_form(t: Column, form: Form) -> Column:
    """Range of a text in one form, else null."""
    group = lambda i: F.regexp_extract(t, form.pattern, i)
    none = F.lit(None).cast("int")
    start = _bounds(group(form.start), form.unit)[0].cast("int") if form.start else none
    end = _bounds(group(form.end), form.unit)[1].cast("int") if form.end else none
    ok = t.rlike(form.pattern) & t.rlike(form.needs) & ~t.rlike(form.lacks)
    about = t.rlike(form.about) if isinstance(form.about, str) else F.lit(form.about)
    found = F.struct(start.alias("year_start"), end.alias("year_end"), about.alias("approximate"), F.lit(form.name).alias("source_format"))

    def checked(r: Column) -> Column:
        known = [r[k].isNotNull() & (r[k].between(101, 2099) if form.plausible else F.lit(True)) for k, i in (("year_start", form.start), ("year_end", form.end)) if i]
        return F.when(known[0] & known[-1], r)

    return F.when(ok, let(found, checked))


def resolve(c: Column) -> Column:
    """Year range of a date string, by the first of ``FORMS`` that fits; null when none does."""
    return let(F.trim(F.coalesce(c, F.lit(""))), lambda t: F.coalesce(*(_as_form(t, form) for form in FORMS)))


def person_dates(c: Column) -> Column:
    """Birth, death and active year: equal bounds or a century are a time of activity (a century's middle)."""

    def parts(r: Column) -> Column:
        active = F.coalesce(r["source_format"].isin(*ACTIVITY) | (r["year_start"] == r["year_end"]), F.lit(False))
        middle = F.floor((r["year_start"] + r["year_end"]) / 2).cast("int")
        return F.struct(F.when(~active, r["year_start"]).alias("birth_year"), F.when(~active, r["year_end"]).alias("death_year"), F.when(active, middle).alias("active_year"))

    return let(resolve(c), parts)


def date_conflict(role: Column, year: Column, birth: Column, death: Column) -> Column:
    """Why a person cannot belong to a manuscript of a year, else null."""
    return (
        F.when(birth > year + 5, "born_after")
        .when(F.lower(role).isin(*COPYING_ROLES) & (death < year - 80), "copyist_died_before")
        .when(birth.isNull() & (death > year + 120), "death_too_late")
    )


def wikibase_time(year: Column) -> Column:
    """Time string and precision (9: year) of a year."""
    sign = F.when(year < 0, "-").otherwise("+")
    return F.struct(F.concat(sign, F.lpad(F.abs(year).cast("string"), 4, "0"), F.lit("-00-00T00:00:00Z")).alias("time"), F.lit(9).alias("precision"))


def slot(ts: Column, hours: int = 8) -> Column:
    """Day and number of the slot of so many hours that a time falls in."""
    return F.struct(F.to_date(ts).alias("bucket"), F.floor(F.hour(ts) / hours).cast("int").alias("slot"))

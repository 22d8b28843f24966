"""The year of a manuscript from its catalogue date and colophon, and the year that a date in a text stands for.

A catalogue date is a struct of ``year``, ``start``, ``end``, ``form``, ``text`` and ``bce``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import dates
from quire.functions.let import let

WIDE, NEAR = 99, 100
#: Forms of dates that are centuries, a year in brackets that a cataloguer gives, digits that are not sure, a year's letters, and letters of thousands.
CENTURIES = ("HebrewCentury", "Century", "HebrewGematriaCentury")
EQUAL_YEAR, UNSURE = r"\[=\s*(\d{4})\s*\]", r"\d\[\d\]\d{2}"
YEAR_LETTERS, THOUSANDS = "(?:[במל]['׳]?)?[א-ת]{1,4}[\"'״][א-ת]", "^[במל]['׳]"
YEAR_WORD, CENSOR = r"^[במל]?שנת\s+", "צנזור"
WINDOW = 24


def plausible(year: Column) -> Column:
    """The year if it is one of the common era that can be meant, or any before it."""
    return F.when((year < 0) | ((year > 100) & (year < 2100)), year)


def first_year(text: Column) -> Column:
    """The first run of three or four digits in a text, if it is a plausible year."""
    return plausible(F.nullif(F.regexp_extract(text, r"\b(\d{3,4})\b", 1), F.lit("")).cast("int"))


def is_imprecise(date: Column) -> Column:
    """A century, or a range of a hundred years or more."""
    wide = plausible(date["end"]) - plausible(date["start"]) >= WIDE
    return F.coalesce(date["form"].isin(*CENTURIES), F.lit(False)) | F.coalesce(wide, F.lit(False))


def within(year: Column, date: Column) -> Column:
    """Whether a year agrees with a date: inside its range, else within a hundred years of its year, else always."""
    start, end, one = (plausible(date[c]) for c in ("start", "end", "year"))
    return F.when(start.isNotNull() & end.isNotNull(), year.between(start, end)).when(one.isNotNull(), F.abs(one - year) <= NEAR).otherwise(True)


def production_year(date: Column, colophon: Column) -> Column:
    """An exact year of the catalogue; of an imprecise date a colophon's year that agrees with it, else a year written in it that agrees, else its year if that lies before the common era; and without
    any of these the colophon's year. The start of a century is never taken for a year."""

    def chosen(d: Column) -> Column:
        written = first_year(d["text"])
        early = F.when(F.coalesce(d["bce"], F.lit(False)) & (d["year"] < 0), d["year"])
        vague = F.coalesce(F.when(within(written, d), written), F.when(written.isNull() | ~within(written, d), early))
        exact = F.coalesce(plausible(d["year"]), plausible(d["start"]), written)
        own = plausible(colophon)
        return F.when(is_imprecise(d) & own.isNotNull() & within(own, d), own).otherwise(F.coalesce(F.when(is_imprecise(d), vague).otherwise(exact), own))

    return let(date, chosen)


def _plain_quotes(text: Column) -> Column:
    return F.translate(F.regexp_replace(text, '""', '"'), "״׳", "\"'")


def year_of_span(span: Column, notes: Column, production: Column) -> Column:
    """Year of a date in a text: given in brackets in it, or in the record's ``notes`` right after it; the manuscript's year for unsure digits of a censor; its digits; its letters, unless they have
    letters of thousands; else the year of a date that has one year only. Letters and unsure digits that give no year end the search."""

    def found(t: Column) -> Column:
        core = F.trim(F.regexp_replace(t, YEAR_WORD, ""))
        bracket = lambda c: F.nullif(F.regexp_extract(c, EQUAL_YEAR, 1), F.lit("")).cast("int")
        plain, corpus = _plain_quotes(core), _plain_quotes(notes)
        at = F.call_function("locate", plain, corpus)
        beside = F.when((plain != "") & (at > 0), bracket(F.substr(corpus, at, F.length(plain) + WINDOW)))
        censor = F.when(t.rlike(UNSURE) & notes.rlike(CENSOR) & notes.rlike(UNSURE), production)
        token = F.regexp_extract(core, YEAR_LETTERS, 0)
        lettered = F.when(~token.rlike(THOUSANDS), plausible(dates.letters_to_year(token)))
        one = let(dates.resolve(core), lambda r: F.when(r["year_start"] == r["year_end"], F.when(r["year_start"].between(101, 2099), r["year_start"])))
        last = F.when(token != "", lettered).when(~core.rlike(UNSURE), one)
        return F.when(t != "", F.coalesce(bracket(t), beside, censor, first_year(core), last))

    return let(F.regexp_replace(F.trim(F.coalesce(span, F.lit(""))), r"^[.,;:]+|[.,;:]+$", ""), found)

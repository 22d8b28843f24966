"""String and identity normalisation as column expressions.

Null and empty are the same to all of these: a null gives an empty key.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NIQQUD = r"[֑-ׇ]"
HEBREW = r"֐-׿"
SLOT_MARK = "␟"

# fixed values: prefixes that a catalogue puts before a work's title
TITLE_PREFIXES = ("תפסיל", "חלק", "פרק", "מאת", "על", "ב", "ל", "מ", "ה", "ו", "כולל")


@F.pandas_udf(StringType())
def nfd(s: pd.Series) -> pd.Series:
    """Canonical decomposition: the one text step that Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFD", x))


def nz(c: Column) -> Column:
    """Null for a blank value."""
    return F.nullif(F.trim(c), F.lit(""))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _bare(c: Column) -> Column:
    return F.regexp_replace(nfd(c), r"\p{Mn}", "")


def name_key(c: Column) -> Column:
    """Key of a person or work name: no vowel points, accents or punctuation but hyphens, one space, lower case."""
    kept = F.regexp_replace(_bare(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), NIQQUD, "")), rf"(?U)[^\w\s{HEBREW}-]", "")
    return F.lower(_squeeze(kept))


def place_key(c: Column) -> Column:
    """As ``name_key``, without a last part in parentheses; apostrophes stay."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)\s*$", "")
    return F.lower(_squeeze(F.regexp_replace(_bare(F.regexp_replace(plain, NIQQUD, "")), r"(?U)[^\w\s\-']", "")))


def label_key(c: Column) -> Column:
    """Key by which labels of several sources meet: no accents, lower case, one space."""
    return F.lower(_squeeze(_bare(F.coalesce(c, F.lit("")))))


def plain_key(c: Column) -> Column:
    """Lower case, punctuation as space: no accents are touched, so no Python is needed."""
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "))


def slug(c: Column) -> Column:
    """Last part of a minted URI; case is kept."""
    words = F.regexp_replace(_bare(F.trim(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(words, r"(?U)[-\s]+", "_"), "^_+|_+$", "")


def mint(kind: str, c: Column, base: str = "urn:quire:") -> Column:
    return F.concat(F.lit(f"{base}{kind}_"), slug(c))


def entity_text(c: Column) -> Column:
    """Text of a found entity without quotes around it; a last ' stays after a Hebrew letter, where it marks a short form."""
    t = _squeeze(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"""^["'“”„]+|["“”]+$""", ""), rf"(?<![{HEBREW}])'+$", ""))


def split_slots(c: Column) -> Column:
    """Slots by the first delimiter there is (slot mark, bar, semicolon). Empty slots stay: their place has a meaning."""
    t = F.coalesce(c, F.lit(""))
    cut = lambda mark: F.transform(F.split(t, mark, -1), lambda x: F.trim(x))
    return F.when(F.contains(t, F.lit(SLOT_MARK)), cut(SLOT_MARK)).when(F.contains(t, F.lit("|")), cut(r"\|")).when(F.contains(t, F.lit(";")), cut(";")).otherwise(F.array(F.trim(t)))


def split_values(c: Column) -> Column:
    """Values of a cell, unquoted, without empty ones."""
    parts = F.transform(split_slots(c), lambda x: F.regexp_replace(x, r'^"(.*)"$', "$1"))
    return F.filter(parts, lambda x: F.trim(x) != "")


def align(names: Column, values: Column) -> Column:
    """Pairs of two lists of equal length, else null: a list of another length cannot be aligned and needs review."""
    return F.when(F.size(names) == F.size(values), F.arrays_zip(names.alias("name"), values.alias("value")))


def control_key(c: Column) -> Column:
    """Control number without quotes and spaces around it."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[\"' ]+|[\"' ]+$", "")


def title_core(c: Column) -> Column:
    """Title without catalogue prefixes, however many, and without closing punctuation."""
    prefix = "^(?:(?:" + "|".join(TITLE_PREFIXES) + r")\s+)+"
    return _squeeze(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), prefix, ""), r"[.,;:\s]+$", ""))


def title_variants(c: Column, more: Column | None = None) -> Column:
    """Distinct variants of a title of at least three characters, in order: as given, its core, then those in ``more``."""
    own = F.array(F.trim(F.coalesce(c, F.lit(""))), title_core(c))
    every = own if more is None else F.concat(own, F.flatten(F.transform(more, lambda x: F.array(F.trim(x), title_core(x)))))
    long = F.filter(every, lambda x: F.length(x) >= 3)
    return F.filter(long, lambda x, i: F.array_position(F.transform(long, F.lower), F.lower(x)) == i + 1)


def split_title(c: Column) -> Column:
    """Main title and rest at the first ' : ' or ' / '."""
    return F.struct(F.trim(F.regexp_extract(c, r"^(.*?)(?:\s+[:/]\s+.*)?$", 1)).alias("title"), nz(F.regexp_extract(c, r"^.*?\s+[:/]\s+(.*)$", 1)).alias("rest"))


def label_language(c: Column) -> Column:
    """``en`` with Latin letters and no Hebrew ones, or over twice as many Latin as Hebrew; else ``he``."""
    hebrew, latin = F.regexp_count(c, F.lit(r"[א-ת]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(((hebrew == 0) & (latin > 0)) | (latin > 2 * hebrew), "en").otherwise("he")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each word with two blanks before and one after it."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+", " "), " "), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def within_distance(a: Column, b: Column, k: int) -> Column:
    """Levenshtein distance of at most ``k`` (``levenshtein`` with a limit says -1 beyond it)."""
    return F.levenshtein(a, b, k).between(0, k)


def heading_matches(a: Column, b: Column) -> Column:
    """Whole headings within two edits, or surnames within one and given names within one."""
    part = lambda c, i: F.trim(F.get(F.split(plain_key_commas(c), ","), F.lit(i)))
    both = F.contains(a, F.lit(",")) & F.contains(b, F.lit(","))
    return within_distance(plain_key(a), plain_key(b), 2) | (both & within_distance(part(a, 0), part(b, 0), 1) & within_distance(part(a, 1), part(b, 1), 1))


def plain_key_commas(c: Column) -> Column:
    return _squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s,]", " "))


def names_overlap(a: Column, b: Column) -> Column:
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


def local_name(uri: Column) -> Column:
    """What follows the last ``#``, else the last ``/``."""
    return F.when(F.contains(uri, F.lit("#")), F.substring_index(uri, "#", -1)).otherwise(F.substring_index(uri, "/", -1))


def qid(c: Column) -> Column:
    return nz(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), r"\b(Q[1-9]\d*)\b", 1))


def viaf(c: Column) -> Column:
    return nz(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:viaf/|^)(\d{3,22})\b", 1))


def isni(c: Column) -> Column:
    digits = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^0-9X]", "")
    return F.when(digits.rlike(r"^\d{15}[\dX]$"), digits)


def lccn(c: Column) -> Column:
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return nz(F.regexp_extract(t, r"^([a-z]{0,3}\d{8,10})$", 1))


def is_inverted_name(c: Column) -> Column:
    """``Surname, Given`` with a word on both sides."""
    return F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*\w[\w\s'\"-]*,\s*\w")

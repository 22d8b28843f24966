"""Evaluation of a person match: guards that reject, doubt or comment, and the confidence that is left.

Guards are rows of one table. A rejection takes all identifiers away; of several the last in the table's order is the reason, but a name that is no person's is judged on
nothing else. All is columns, so a table of any number of matches is one pass without a shuffle; a cluster that two names of a record share is found
by ``resolve`` and given as ``over_merged``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import dates, values

MODERN = 1900
LEAST_LETTERS = 4
SHORT_LETTERS = 12

#: Words that stand where a name is not known, and headings of translations.
PLACEHOLDERS = ("anonymous", "מחבר אלמוני", "פלוני", "אלמוני", "n.n.", " nn", "nn ")
REFERENCES = ("אונקלוס", "עונקלוס", "תרגום אונקלוס", "יונתן בן עוזיאל")
#: Two letters with a quotation mark, and two initials with full stops.
ABBREVIATION, INITIALS = '^[א-ת]"[א-ת]$', r"^[A-Za-zא-ת]\.[\s,]*[A-Za-zא-ת]\.?$"

REJECTS, DOUBTS, TELLS = "rejects", "doubts", "tells"


def _tokens(name: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.trim(name), r"[,;:.]+$", ""))
    return F.filter(F.split(plain, r"[\s,]+"), lambda t: t != "")


def is_placeholder(name: Column) -> Column:
    """Too few letters for a name, an abbreviation, initials, or a word for an unknown person. Null and empty names are placeholders."""
    said = F.trim(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(said, "[,;:]+$", "")
    few = F.length(F.regexp_replace(said, "[^A-Za-zא-ת]", "")) < LEAST_LETTERS
    word = F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda w: F.contains(F.lower(said), w))
    return few | bare.rlike(ABBREVIATION) | bare.rlike(INITIALS) | word


def is_reference(name: Column) -> Column:
    """A heading of a translation or its tradition, which is no person of a manuscript."""
    key = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", ""), "[,;:]+$", "")), r"\s+", " ")
    tokens = _tokens(key)
    return key.isin(*REFERENCES) | ((F.size(tokens) == 1) & F.get(tokens, F.lit(0)).isin(*REFERENCES[:2]))


def is_short_homonym(name: Column, latin: Column, *, authority: Column, dated: Column, tag: Column, personalities: Column, overlap: Column) -> Column:
    """A name of one token, or of two with few Hebrew letters, that met a heading of three tokens or more. A personality's own heading makes it good if its
    dates overlap or it is the only one; so do dates in the record that overlap."""
    n = F.size(_tokens(name))
    letters = F.length(F.regexp_replace(name, "[^֐-׿]", ""))
    short = (n <= 1) | ((n == 2) & (letters <= SHORT_LETTERS))
    own = authority & (tag == "100") & (overlap | (personalities <= 1))
    return short & (F.coalesce(F.size(_tokens(latin)), F.lit(0)) > 2) & ~own & ~(dated & overlap)


@dataclass(frozen=True)
class Guard:
    name: str
    kind: str
    holds: Column


def _has(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _flag(rows: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)


def guards_of(rows: DataFrame) -> list[Guard]:
    """The guards, in the order in which they are told; of the rejecting ones a later reason takes the place of an earlier one."""
    born, died, year = F.col("born"), F.col("died"), F.col("year")
    tag = F.col("tag") if "tag" in rows.columns else F.lit("")
    personalities = F.coalesce("personalities", F.lit(0)) if "personalities" in rows.columns else F.lit(0)
    rejected_before = (died < born) | (F.coalesce(born >= MODERN, F.lit(False)) & ~F.coalesce(year >= MODERN, F.lit(False)))
    authority = _has("authority_id") & ~F.coalesce(rejected_before, F.lit(False))
    return [
        Guard("placeholder_name", REJECTS, is_placeholder(F.col("name"))),
        Guard("non_person_heading", REJECTS, is_reference(F.col("name"))),
        Guard("biographical_inconsistency", REJECTS, died < born),
        Guard("modern_person", REJECTS, (born >= MODERN) & ~F.coalesce(year >= MODERN, F.lit(False))),
        Guard("date_conflict", REJECTS, dates.date_conflict(F.col("role"), year, born, died).isNotNull()),
        Guard("short_name_homonym", DOUBTS, is_short_homonym(F.col("name"), F.col("latin"), authority=authority, dated=_flag(rows, "dated"), tag=F.coalesce(tag, F.lit("")), personalities=personalities, overlap=_flag(rows, "overlap"))),
        Guard("over_merged", DOUBTS, _flag(rows, "over_merged")),
        Guard("disagrees", TELLS, _flag(rows, "disagrees")),
        Guard("confirms", TELLS, _flag(rows, "confirms")),
        Guard("has_item", TELLS, _flag(rows, "has_item")),
        Guard("conflict", DOUBTS, _flag(rows, "conflict")),
    ]


def evaluated(rows: DataFrame) -> DataFrame:
    """Adds ``flags``, ``reason`` (null where nothing rejects), ``confidence`` and ``matched`` to matches, and takes their identifiers away where they must not be used.

    ``rows``: ``name, role, year, authority_id, cluster_id, item_id, latin, born, died`` and, where known, ``tag, personalities, overlap, dated, over_merged, disagrees, confirms, has_item,
    conflict``. A rejection takes all identifiers; an over-merged cluster takes the cluster's and the item's, and keeps the authority's.
    """
    guards = guards_of(rows)
    holds = {g.name: F.coalesce(g.holds, F.lit(False)) for g in guards}
    no_person = holds["placeholder_name"] | holds["non_person_heading"]
    only = F.when(holds["placeholder_name"], F.array(F.lit("placeholder_name"))).otherwise(F.array(F.lit("non_person_heading")))
    later = F.array_compact(F.array(*(F.when(holds[g.name], F.lit(g.name)) for g in guards[2:])))
    flags = F.when(no_person, only).otherwise(later)
    rejecting = F.array(*(F.lit(g.name) for g in guards if g.kind == REJECTS))
    marked = rows.withColumn("flags", flags)
    reasons = F.filter("flags", lambda f: F.array_contains(rejecting, f))
    marked = marked.withColumn("reason", F.try_element_at(reasons, F.lit(-1)))
    told = lambda name: F.array_contains("flags", name)
    early = told("biographical_inconsistency") | told("modern_person")
    number = lambda c: c.cast("int")
    sources = number(_has("authority_id") & ~early) + number(_has("cluster_id") & F.col("reason").isNull()) + number(told("has_item"))
    concern = F.col("reason").isNotNull() | told("short_name_homonym")
    level = values.confidence(sources, _has("latin"), concern=concern, conflict=told("conflict"), over_merged=told("over_merged"), disagrees=told("disagrees"), confirms=told("confirms"))
    kept = F.col("reason").isNull()
    alone = kept & ~told("over_merged")
    ids = {"authority_id": kept, "cluster_id": alone, "item_id": alone}
    columns = [F.when(ids[c], F.col(c)).alias(c) if c in ids else F.col(c) for c in rows.columns]
    return marked.withColumn("confidence", level).select(*columns, "flags", "reason", "confidence", (F.col("confidence") == "high").alias("matched"))

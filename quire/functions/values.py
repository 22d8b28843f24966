"""Numbers, coordinates, confidence, JSON and document helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")


def loose_number(c: Column) -> Column:
    """Number of a cell without its thousands commas, null where it is none."""
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double")


def valid_point(lat: Column, lon: Column) -> Column:
    """In range, and not the origin."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((F.abs(lat) < 1e-9) & (F.abs(lon) < 1e-9)), F.lit(False))


def plausible_point(lat: Column, lon: Column) -> Column:
    """As ``valid_point``, with a hundredth of a degree around the origin ruled out."""
    return valid_point(lat, lon) & ~((F.abs(lat) < 0.01) & (F.abs(lon) < 0.01))


def wkt_point(c: Column) -> Column:
    """Longitude and latitude of ``Point(lon lat)``."""
    of = lambda i: F.regexp_extract(c, r"(?i)^\s*point\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$", i).try_cast("double")
    return F.struct(of(1).alias("lon"), of(2).alias("lat"))


def confidence(
    sources: Column, latin: Column, *, concern: Column | bool = False, conflict: Column | bool = False, over_merged: Column | bool = False, disagrees: Column | bool = False, confirms: Column | bool = False
) -> Column:
    """Two agreeing sources and a Latin name are high, any source medium, none low.

    Any ``concern`` of a guard makes it low, and so does a conflict between sources or an over-merged cluster; low stays low. Of the
    rest, a disagreement takes one step away, and a confirmation makes medium high.
    """
    c = lambda x: F.coalesce(x if isinstance(x, Column) else F.lit(x), F.lit(False))
    base = F.when(c(concern), "low").when((sources >= 2) & c(latin), "high").when(sources >= 1, "medium").otherwise("low")
    return F.when(c(conflict) | c(over_merged) | (base == "low"), "low").when(c(disagrees), F.when(base == "high", "medium").otherwise("low")).when(c(confirms), "high").otherwise(base)


def step_down(level: Column, by: Column) -> Column:
    ranks = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(1), (ranks - by)).cast("int"))


def same_quantity(a: Column, b: Column) -> Column:
    """``+11`` and ``11.0`` are one quantity."""
    return F.regexp_replace(a, r"^\+", "").try_cast("decimal(38,10)").eqNullSafe(F.regexp_replace(b, r"^\+", "").try_cast("decimal(38,10)"))


def dimensions(c: Column) -> Column:
    """Height and width in millimetres of ``a x b mm`` or ``cm``."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm)"
    scale = F.when(F.lower(F.regexp_extract(c, pattern, 3)) == "cm", 10).otherwise(1)
    of = lambda i: F.regexp_extract(c, pattern, i).try_cast("double") * scale
    return F.struct(of(1).alias("height_mm"), of(2).alias("width_mm"))


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON; give them in the order of their names."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def display_label(labels: Column, fallback: Column) -> Column:
    """English, else Hebrew, else the first by language, else the id."""
    return F.coalesce(F.try_element_at(labels, F.lit("en")), F.try_element_at(labels, F.lit("he")), F.try_element_at(labels, F.array_min(F.map_keys(labels))), fallback)


def patch_map(base: Column, patch: Column) -> Column:
    """Map with the patch's entries over its own; a null in the patch deletes."""
    empty = F.expr("map()").cast("map<string,string>")
    b, p = F.coalesce(base, empty), F.coalesce(patch, empty)
    kept = F.map_filter(b, lambda k, v: ~F.map_contains_key(p, k))
    return F.map_filter(F.map_concat(kept, p), lambda k, v: v.isNotNull())


def patch_list(items: Column, edits: Column, removed: Column, added: Column) -> Column:
    """List with edits by position, then removals (both count original positions), then additions at the end."""
    edited = F.transform(items, lambda x, i: F.coalesce(F.try_element_at(edits, i), x))
    kept = F.filter(edited, lambda x, i: ~F.array_contains(removed, i))
    return F.concat(kept, added)


def first_of_each(items: Column) -> Column:
    """Distinct items by their lower-cased value, the first of each, in order."""
    return F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)

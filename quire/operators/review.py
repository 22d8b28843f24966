"""Review of found entities and verdicts, graph views, and joins across name spaces and scripts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: form of the link of a field in another script, and the parts of it that are read
LINK = r"^(\d{3})-(\d{2})/\((.)\)?$"
LINKED_CODES = ("a", "b", "c", "e", "k")


def entity_filter(*, source: str | None = None, kind: str | None = None, role: str | None = None, approved: bool | None = None, search: str | None = None) -> Column:
    """Condition on a list of found entities. A corrected type or role (``effective_…``) counts instead of the found one;
    the search looks into text and control number, in any case. What is not given rules nothing out."""
    corrected = lambda c: F.coalesce(F.nullif(F.col(f"effective_{c}"), F.lit("")), F.col(c))
    has = lambda c, x: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(x))
    needle = (search or "").strip().lower()
    asked = [
        F.col("source") == source if source else None,
        corrected("type") == kind if kind else None,
        corrected("role") == role if role else None,
        F.coalesce("approved", F.lit(False)) == F.lit(approved) if approved is not None else None,
        has("text", needle) | has("control_number", needle) if needle else None,
    ]
    return reduce(and_, [x for x in asked if x is not None], F.lit(True))


def compact_verdicts(verdicts: DataFrame, *, failures_only: bool = False) -> DataFrame:
    """Verdicts with the ``results`` that did not pass, and ``pass_count``. Rows without results go; with
    ``failures_only`` so do those without a failure."""
    live = verdicts.where(F.size("results") > 0)
    if failures_only:
        live = live.where(F.exists("results", lambda r: r["state"] == "fail"))
    passed = F.size(F.filter("results", lambda r: r["state"] == "pass"))
    return live.withColumn("pass_count", passed).withColumn("results", F.filter("results", lambda r: r["state"] != "pass"))


def overall(*axes: Column) -> Column:
    """``fail`` if any axis says no, else ``partial`` if any does, else ``full``: unknown and not applicable count as yes."""
    said = F.transform(F.array(*axes), lambda a: F.lower(F.trim(F.coalesce(a, F.lit("")))))
    return F.when(F.array_contains(said, "no"), "fail").when(F.array_contains(said, "partial"), "partial").otherwise("full")


def lifespans(persons: DataFrame, matches: DataFrame) -> DataFrame:
    """``uri, birth_year, death_year`` of persons (``uri, label``) that a match names by its matched name, else by its own
    text, in any case. The last match of high confidence counts, without one the first match (by ``ord``); matches without a year never do.
    A label of several persons goes to the smallest uri."""
    named = persons.where("label is not null").groupBy(F.lower("label").alias("_label")).agg(F.min("uri").alias("uri"))
    dated = matches.where("birth_year is not null or death_year is not null")
    by = lambda c, to: named.select(F.col("_label").alias(c), F.col("uri").alias(to))
    keyed = dated.withColumn("_a", F.lower("matched_name")).withColumn("_b", F.lower("entity_text"))
    found = keyed.join(by("_a", "_u"), "_a", "left").join(by("_b", "_v"), "_b", "left").withColumn("uri", F.coalesce("_u", "_v")).where("uri is not null")
    years = F.struct("birth_year", "death_year")
    sure = F.when(F.col("confidence") == "high", F.col("ord"))
    best = found.groupBy("uri").agg(F.coalesce(F.max_by(years, sure), F.min_by(years, "ord")).alias("y"))
    return best.select("uri", "y.birth_year", "y.death_year")


def canonical_uri(uri: Column, namespaces: list[str]) -> Column:
    """The first name space in place of whichever of them the uri starts with."""
    moved = lambda ns: F.concat(F.lit(namespaces[0]), F.substr(uri, F.lit(len(ns) + 1)))
    return reduce(lambda rest, ns: F.when(F.startswith(uri, F.lit(ns)), moved(ns)).otherwise(rest), reversed(namespaces), uri)


def known_in(entities: DataFrame, live: DataFrame, namespaces: list[str]) -> DataFrame:
    """Entities whose ``raw_uri`` is a ``uri`` of ``live``, in the same or another of the name spaces."""
    keys = live.select(canonical_uri(F.col("uri"), namespaces).alias("_uri")).distinct()
    return entities.join(keys, canonical_uri(F.col("raw_uri"), namespaces) == F.col("_uri"), "left_semi")


def visible(
    nodes: DataFrame, edges: DataFrame, *, query: str = "", types: tuple[str, ...] = (), predicates: tuple[str, ...] = (),
    focus: DataFrame | None = None, within: DataFrame | None = None, selected: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ids of the nodes and edges that a graph view shows.

    The query is looked for in a node's ``haystack`` and in the label of an edge, which then shows both its ends.
    ``focus`` (``id``) adds what is one step away; ``within`` (``id``) is a neighbourhood worked out before. With
    ``predicates``, nodes that lose all their edges go. The selected node always stays.
    """
    label = F.coalesce(F.nullif("predicate_label", F.lit("")), F.col("predicate"), F.lit(""))
    ends = lambda e: e.select(F.explode(F.array("source", "target")).alias("id"))
    needle = query.strip().lower()
    shown = nodes.where(F.col("type").isin(*types)) if types else nodes
    shown = shown.select("id", "haystack")
    if needle:
        hits = nodes.where(F.contains(F.lower("haystack"), F.lit(needle))).select("id").union(ends(edges.where(F.contains(F.lower(label), F.lit(needle)))))
        shown = shown.join(hits.distinct(), "id", "left_semi")
    if focus is not None:
        at = lambda side: edges.join(focus.select(F.col("id").alias(side)).distinct(), side, "left_semi").select("source", "target")
        shown = shown.join(focus.select("id").union(ends(at("source"))).union(ends(at("target"))).distinct(), "id", "left_semi")
    if within is not None:
        shown = shown.join(within.select("id").distinct(), "id", "left_semi")
    kept = shown.select("id")
    one = nodes.sparkSession.createDataFrame([(selected,)], "id string") if selected is not None else None
    if one is not None:
        kept = kept.union(one)
    kept = kept.distinct()
    lines = edges.where(label.isin(*predicates)) if predicates else edges
    for side in ("source", "target"):
        lines = lines.join(kept.select(F.col("id").alias(side)), side, "left_semi")
    if predicates:
        reached = ends(lines) if one is None else ends(lines).union(one)
        kept = kept.join(reached.distinct(), "id", "left_semi")
    return kept, lines.select("id")


def linked_fields(records: DataFrame) -> DataFrame:
    """``control_number, linked_tag, script, subfields`` of every field 880 whose ``$6`` names the field that it
    mirrors in another script. A link that cannot be read is left out, not guessed."""
    each = records.select("control_number", F.explode(F.filter("occurrences", lambda x: x["tag"] == "880")).alias("x"))
    first = lambda code: F.get(F.filter("x.subfields", lambda s: (s["code"] == code) & (F.trim(s["value"]) != "")), F.lit(0))["value"]
    part = lambda i: F.regexp_extract(F.trim(first("6")), LINK, i)
    said = F.map_filter(F.create_map(*(x for c in LINKED_CODES for x in (F.lit(c), first(c)))), lambda k, v: v.isNotNull())
    out = each.select("control_number", part(1).alias("linked_tag"), part(3).alias("script"), said.alias("subfields"))
    return out.where((F.col("linked_tag") != "") & (F.size("subfields") > 0))

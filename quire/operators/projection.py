"""From field instances to typed records and triples, by a mapping table instead of a handler per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what the common fields of a catalogue record say (tag, subfield, property, kind of the value)
FIELDS = (
    ("001", "", "control_number", "literal"),
    ("041", "a", "language", "literal"),
    ("100", "a", "author", "person"),
    ("110", "a", "corporate_author", "corporate"),
    ("245", "a", "title", "literal"),
    ("245", "b", "subtitle", "literal"),
    ("246", "a", "variant_title", "literal"),
    ("260", "a", "place", "place"),
    ("260", "c", "date", "literal"),
    ("300", "a", "extent", "literal"),
    ("300", "c", "dimensions", "literal"),
    ("500", "a", "note", "literal"),
    ("505", "a", "contents", "literal"),
    ("520", "a", "summary", "literal"),
    ("561", "a", "provenance", "literal"),
    ("650", "a", "subject", "concept"),
    ("651", "a", "place_subject", "place"),
    ("655", "a", "genre", "concept"),
    ("700", "a", "contributor", "person"),
    ("710", "a", "corporate_contributor", "corporate"),
    ("751", "a", "related_place", "place"),
    ("856", "u", "digital_copy", "literal"),
)


def mapping(spark: SparkSession) -> DataFrame:
    """The fields as literals, whose size Spark knows: rows of a Python list count as of any size, and records would be sorted by tag to meet them."""
    rows = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("tag", "code", "property", "kind"), row, strict=True))) for row in FIELDS))
    return spark.range(1).select(F.inline(rows))


def values_of(records: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``control_number, property, kind, ord, value``: one row per mapped subfield, without blank ones, in the order of the record.

    The mapping is a table of a row per field kind, which Spark sends to the records if it is small.
    """
    each = records.select("control_number", F.posexplode("occurrences").alias("ord", "x"))
    subs = each.select("control_number", "ord", "x.tag", F.explode_outer("x.subfields").alias("s"), "x.data")
    flat = subs.select("control_number", "ord", "tag", F.coalesce("s.code", F.lit("")).alias("code"), F.trim(F.coalesce("s.value", "data")).alias("value")).where("value <> ''")
    return flat.join(table if table is not None else mapping(records.sparkSession), ["tag", "code"]).select("control_number", "property", "kind", "ord", "value")


def documents_of(values: DataFrame) -> DataFrame:
    """One row per record: a map from property to its distinct values, in order."""
    listed = values.groupBy("control_number", "property").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])).alias("v"))
    return listed.groupBy("control_number").agg(F.map_from_entries(F.collect_list(F.struct("property", "v"))).alias("fields"))


def triples_of(values: DataFrame, mint: Column | None = None) -> DataFrame:
    """Triples of records: literals as they are, entities as minted resources with a type and a label."""
    uri = mint if mint is not None else F.concat(F.col("kind"), F.lit(":"), F.lower(F.regexp_replace("value", r"(?U)[^\w]+", "_")))
    s = F.concat(F.lit("record:"), "control_number")
    linked = F.col("kind") != "literal"
    triple = lambda a, p, o, kind: F.struct(a.alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    plain = F.array(triple(s, F.col("property"), F.col("value"), "literal"))
    entity = F.array(triple(s, F.col("property"), uri, "uri"), triple(uri, F.lit("type"), F.col("kind"), "uri"), triple(uri, F.lit("label"), F.col("value"), "literal"))
    return values.select(F.explode(F.when(linked, entity).otherwise(plain)).alias("t")).select("t.*").distinct()


def guard(rows: DataFrame, guards: list[tuple[str, Column, str]], level: str = "confidence") -> DataFrame:
    """Rows with the ``flags`` of all guards that hold and the lowest of their levels. Every guard sees the columns as they
    came, so applying the guards again changes nothing."""
    ranks = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    holds = lambda c: F.coalesce(c, F.lit(False))
    flags = F.array_compact(F.array(*(F.when(holds(c), F.lit(name)) for name, c, _ in guards)))
    lowest = F.least(F.array_position(ranks, F.col(level)), *(F.when(holds(c), F.array_position(ranks, F.lit(to))) for _, c, to in guards))
    return rows.select(*(c for c in rows.columns if c != level), flags.alias("flags"), F.element_at(ranks, lowest.cast("int")).alias(level))


def merge_fields(rows: DataFrame, key: str, fields: list[str], source: str, priority: str) -> DataFrame:
    """One row per key: each field from the source of best priority (smallest, then by name) that has it, and that source."""
    best = [F.min(F.when(F.col(f).isNotNull(), F.struct(priority, source, f))).alias(f"_{f}") for f in fields]
    merged = rows.groupBy(key).agg(*best)
    return merged.select(key, *(F.col(f"_{f}.{f}").alias(f) for f in fields), *(F.col(f"_{f}.{source}").alias(f"{f}_source") for f in fields))


def fold_spans(records: DataFrame, spans: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Records with the approved spans found in their notes as an array in order: those approved, or not rejected and of enough
    confidence, each text once."""
    good = spans.where(F.coalesce("approved", F.lit(False)) | (~F.coalesce("rejected", F.lit(False)) & (F.col("confidence") >= least)))
    first = good.groupBy("record", "type", F.lower("text").alias("_t")).agg(F.min_by("text", "start").alias("text"), F.min("start").alias("start"))
    listed = first.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "type", "text"))), lambda x: F.concat(x["type"], F.lit(":"), x["text"])).alias("entities"))
    return records.join(listed, "record", "left")

"""Items with statements, ranks, qualifiers and references as triples, and the statements that cannot be said so.

A statement has a node of its own, named by its item and its content; a reference's node is named by its content alone, so equal references of any items are one node. Direct triples are
those of the best rank of a property, never of a deprecated statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import XSD

#: Ranks, and the forms of property and item ids.
RANKS = {"preferred": "PreferredRank", "normal": "NormalRank", "deprecated": "DeprecatedRank"}
PROPERTY, ITEM = r"^P[1-9]\d*$", r"^Q[1-9]\d*$"
ENTITY = "http://www.wikidata.org/entity/"
SNAKS = "array<struct<property:string,value:string>>"

def _triple(s: Column, p: Column, o: Column, kind: Column | str, datatype: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    typed = datatype if datatype is not None else F.lit(None)
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), F.lit(None).cast("string").alias("o_lang"), typed.cast("string").alias("o_datatype"))


def _said(s: Column, p: Column, value: Column) -> Column:
    """Triple of a value: an item, a whole number or decimal as it is typed, or text."""
    item = value.rlike(ITEM)
    return _triple(s, p, F.when(item, F.concat(F.lit(ENTITY), value)).otherwise(value), F.when(item, "uri").otherwise("literal"))


def refusals(statements: DataFrame) -> Column:
    """Why a statement cannot be exported: its property, its rank, or a qualifier or reference without a property or value."""
    bad = lambda x: ~F.coalesce(x["property"].rlike(PROPERTY), F.lit(False)) | F.coalesce(x["value"] == "", F.lit(True))
    some = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(~some(F.col("property").rlike(PROPERTY)), "property"),
        F.when(~some(F.coalesce("rank", F.lit("normal")).isin(*RANKS)), "rank"),
        F.when(some(F.exists("qualifiers", bad)), "qualifier"),
        F.when(some(F.exists("references", lambda block: F.exists(block, bad))), "reference"),
    ))


def item_graph(items: DataFrame, statements: DataFrame, *, base: str = ENTITY) -> tuple[DataFrame, DataFrame]:
    """Triples of items (``id, labels, descriptions``: maps by language) and statements (``id, property, value, number, rank, qualifiers, references``), and the refused
    statements with their ``reasons``.

    ``number`` is a value that is a number (a double, written as ``xsd:integer`` where it is whole), and null for others; ``rank`` is ``normal`` where null; ``qualifiers`` and each of ``references`` are lists of
    property and value. Statements without a value are left out, empty reference blocks too. An id that is an address is taken as it is.
    """
    subject = F.when(F.startswith("id", F.lit("http")), F.col("id")).otherwise(F.concat(F.lit(base), "id"))
    named = items.where("id <> ''").select(subject.alias("s"), "labels", "descriptions")
    told = [named.select("s", F.lit(p).alias("p"), F.explode(c).alias("lang", "text")).where("text <> ''") for c, p in (("labels", "rdfs:label"), ("descriptions", "schema:description"))]
    words = told[0].unionByName(told[1]).select("s", "p", F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"), F.lit(None).cast("string").alias("o_datatype"))

    checked = statements.where("id <> '' and (value <> '' or number is not null)").withColumn("reasons", refusals(statements))
    good = checked.where(F.size("reasons") == 0).withColumn("rank", F.coalesce("rank", F.lit("normal"))).withColumn("s", subject)
    none = F.expr(f"cast(array() as {SNAKS})")
    plain = good.withColumn("qualifiers", F.coalesce("qualifiers", none)).withColumn("references", F.filter(F.coalesce("references", F.expr(f"cast(array() as array<{SNAKS}>)")), lambda b: F.size(b) > 0))
    # equal statements are one before they are spelled out: a node's own triples need no shuffle then. A number goes through it as text, so that -0.0 stays what it is
    said = plain.select("s", "property", "value", F.col("number").cast("string").alias("number"), "rank", "qualifiers", "references").distinct()
    good = said.withColumn("number", F.col("number").cast("double"))
    content = F.to_json(F.struct("property", "value", "number", "rank", "qualifiers", "references"))
    good = good.withColumn("node", F.concat(F.lit("s:"), F.sha1(F.concat_ws("\n", "s", content).cast("binary"))))
    rank_of = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))
    whole = F.col("number") == F.floor("number")
    amount = F.when(whole, F.floor("number").cast("string")).otherwise(F.col("number").cast("string"))
    main = lambda s, p: F.when(F.col("number").isNotNull(), _triple(s, p, amount, "literal", datatype=F.concat(F.lit(XSD), F.when(whole, "integer").otherwise("double")))).otherwise(_said(s, p, F.col("value")))
    at = lambda ns: F.concat(F.lit(ns), F.col("property"))
    block_node = lambda b: F.concat(F.lit("r:"), F.sha1(F.to_json(b).cast("binary")))
    snaks = lambda node, ns, xs: F.transform(xs, lambda x: _said(node, F.concat(F.lit(ns), x["property"]), x["value"]))
    node = F.col("node")
    own = F.array(_triple(F.col("s"), at("p:"), node, "uri"), main(node, at("ps:")), _triple(node, F.lit("wikibase:rank"), F.concat(F.lit("wikibase:"), F.try_element_at(rank_of, F.col("rank"))), "uri"))
    derived = F.transform("references", lambda b: _triple(node, F.lit("prov:wasDerivedFrom"), block_node(b), "uri"))
    full = good.select(F.explode(F.concat(own, F.array_distinct(F.concat(snaks(node, "pq:", F.col("qualifiers")), derived)))).alias("t")).select("t.*")
    blocks = plain.select(F.explode("references").alias("b"))
    sourced = blocks.select(F.explode(snaks(block_node(F.col("b")), "pr:", F.col("b"))).alias("t")).select("t.*").distinct()

    level = F.when(F.col("rank") == "preferred", 2).when(F.col("rank") == "normal", 1).otherwise(0)
    spoken = F.when(F.col("number").isNull(), F.col("value")).alias("value")  # what the triple says: a number hides the value
    ranked = plain.select("s", "property", spoken, "number", level.alias("level")).where("level > 0").groupBy("s", "property", "value", "number").agg(F.max("level").alias("level"))
    best = ranked.groupBy("s", "property").agg(F.max("level").alias("best"))
    direct = ranked.join(best, ["s", "property"]).where("level = best").select(main(F.col("s"), at("wdt:")).alias("t")).select("t.*")
    return words.distinct().unionByName(full).unionByName(sourced).unionByName(direct), checked.where(F.size("reasons") > 0)

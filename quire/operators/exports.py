"""Exports of extractions, histories and graphs, and details of one node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import events, graphs


def ordered_export(rows: DataFrame, order: list[str], *, approved_only: bool = False) -> DataFrame:
    """Rows of an extraction or of authority matches in the order of their record and place; only approved ones on request."""
    chosen = rows.where(F.coalesce("approved", F.lit(False))) if approved_only else rows
    return chosen.orderBy(*order)


def folded_items(history: DataFrame) -> DataFrame:
    """``entity_id, rev, fields``: the state of each entity after its newest event, patches folded into it."""
    return events.states_at(history).withColumnRenamed("state", "fields")


def project_export(rows: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Rows of all kinds of entities as JSON documents: ``entity_type, entity_id, value``."""
    chosen = rows.where(F.col("entity_type").isin(*types)) if types else rows
    rest = [c for c in rows.columns if c != "entity_type"]
    return chosen.select("entity_type", "entity_id", F.to_json(F.struct(*rest)).alias("value"))


def graph_elements(nodes: DataFrame, edges: DataFrame, *, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, label, type, must, degree``) that a drawing shows, must-show ones first, and the edges (``id, source, target, predicate``) between them."""
    shown = nodes.join(graphs.viewport(nodes, edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("predicate").alias("label")), budget=most).select("id"), "id", "left_semi")
    ids = shown.select("id")
    for side in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return shown.select("id", "label", "type"), edges.select("id", "source", "target", "predicate")


def node_detail(triples: DataFrame, node: str) -> DataFrame:
    """``part, predicate, value`` of one node: its types, its literals, the resources it points to and those that point to it."""
    mine, at = triples.where(F.col("s") == node), triples.where((F.col("o") == node) & (F.col("o_kind") == "uri"))
    part = F.when(F.col("p") == "type", "type").when(F.col("o_kind") == "uri", "outgoing").otherwise("property")
    return mine.select(part.alias("part"), F.col("p").alias("predicate"), F.col("o").alias("value")).union(at.select(F.lit("incoming"), "p", "s")).distinct()


def roles_of(triples: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``entity, role, subject``: who is in which role where, by the predicates that mean a role."""
    table = F.create_map(*(F.lit(x) for kv in roles.items() for x in kv))
    rows = triples.where((F.col("o_kind") == "uri") & F.col("p").isin(*roles))
    return rows.select(F.col("o").alias("entity"), F.try_element_at(table, F.col("p")).alias("role"), F.col("s").alias("subject")).distinct()


def people_by_role(*sources: DataFrame) -> DataFrame:
    """``role, n``: people of each role over several sources (``key, role``), each once."""
    every = sources[0].select("key", "role")
    for s in sources[1:]:
        every = every.union(s.select("key", "role"))
    return every.where("key is not null").groupBy("role").agg(F.count_distinct("key").alias("n"))


def dataset_info(rows: DataFrame, order: str, sample: int = 5) -> DataFrame:
    """``n_rows, n_columns`` and ``sample``, the first rows by ``order`` as JSON."""
    first = rows.orderBy(order).limit(sample).select(F.col(order).alias("k"), F.to_json(F.struct(*rows.columns)).alias("row"))  # a report of few rows
    said = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("sample"))
    return said.withColumn("n_rows", F.lit(rows.count())).withColumn("n_columns", F.lit(len(rows.columns)))


def top(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The most frequent values of a column, ties by value."""
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def place_coordinates(places: DataFrame, matches: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``place, lat, lon``: the first valid point (by ``ord``) of the matches of a place (``place, ord, lat, lon``). Only a place that no match names is looked up in the
    gazetteer; one whose matches have no valid point has none."""
    from quire.functions.values import valid_point

    ok = valid_point(F.col("lat"), F.col("lon"))
    best = matches.groupBy("place").agg(F.min_by(F.struct("lat", "lon"), F.when(ok, F.col("ord"))).alias("m"), F.count_if(ok).alias("n"))
    known = gazetteer.select("place", F.struct("lat", "lon").alias("g"))
    joined = places.join(best, "place", "left").join(known, "place", "left")
    point = F.when(F.col("n").isNull(), F.col("g")).when(F.col("n") > 0, F.col("m"))
    return joined.select("place", point["lat"].alias("lat"), point["lon"].alias("lon"))


def place_confidence(*found: Column) -> Column:
    """``high`` where two sources have the place, ``medium`` where one has, else ``low``."""
    n = sum((F.coalesce(x, F.lit(False)).cast("int") for x in found), F.lit(0))
    return F.when(n >= 2, "high").when(n == 1, "medium").otherwise("low")

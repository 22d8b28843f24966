"""Entity resolution: merging across sources, collisions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components

PRECEDENCE = ("qid", "cn", "viaf", "nli", "label", "raw")


def merge_sources(entities: DataFrame, *, key: str = "entity_id") -> DataFrame:
    """Clusters of entities that share a strong key (``qid``, ``cn``, ``viaf``, ``nli``), or a label key where neither has a strong one.

    ``entities`` has the key, ``source`` and a column for each kind of ``PRECEDENCE`` (null or empty: none; ``raw`` is used when nothing else is there).
    Returns each entity with ``cluster``, the smallest entity of it, and ``cluster_key``, its best key by precedence.
    Entities meet at their keys, not in pairs, so a key that many share costs one edge each.
    """
    has = lambda k: F.coalesce(F.col(k), F.lit("")) != ""
    strong = has("qid") | has("cn") | has("viaf") | has("nli")
    made = [F.when(has(k), F.concat(F.lit(f"{k}:"), F.col(k))) for k in PRECEDENCE[:4]]
    made += [F.when(~strong & has("label"), F.concat(F.lit("label:"), F.col("label"))), F.when(~strong & ~has("label") & has("raw"), F.concat(F.lit("raw:"), F.col("raw")))]
    keys = entities.select(key, F.posexplode(F.array(*made)).alias("rank", "k")).where("k is not null")
    first = keys.groupBy("k").agg(F.min(key).alias("first"))
    parts = connected_components(keys.join(first, "k").select(F.col(key).alias("a"), F.col("first").alias("b")))
    joined = entities.join(parts.withColumnRenamed("node", key), key, "left").withColumn("cluster", F.coalesce("component", key)).drop("component")
    best = keys.join(joined.select(key, "cluster"), key).groupBy("cluster").agg(F.min_by("k", F.struct("rank", "k")).alias("cluster_key"))
    return joined.join(best, "cluster", "left")


def cluster_summary(merged: DataFrame) -> DataFrame:
    """Clusters and sources: distinct clusters of each type in all and from each source."""
    types = merged.groupBy("cluster").agg(F.mode("entity_type", True).alias("entity_type"), F.collect_set("source").alias("sources"))
    per_source = types.select("cluster", "entity_type", F.explode("sources").alias("source")).groupBy("entity_type", "source").agg(F.count(F.lit(1)).alias("n"))
    total = types.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).select("entity_type", F.lit("all").alias("source"), "n")
    return total.unionByName(per_source)


def collisions(rows: DataFrame, by: list[str], distinct: str) -> DataFrame:
    """Groups that hold more than one value of a column: ids given to several names, and the like."""
    return rows.groupBy(*by).agg(F.count_distinct(distinct).alias("n")).where("n > 1")


def duplicate_groups(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Groups of several rows with equal keys: size and smallest member. Null keys make no group."""
    present = rows.dropna(subset=by)
    return present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def unambiguous(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose ``a`` has no other ``b`` and whose ``b`` has no other ``a``."""
    d = pairs.select(a, b).distinct()
    many = lambda x, y: d.groupBy(x).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(x)
    return d.join(many(a, b), a, "left_anti").join(many(b, a), b, "left_anti")


def dangling(rows: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """Rows whose reference has no target; a null reference dangles from nothing and is left out."""
    return rows.where(F.col(on).isNotNull()).join(target, on, "left_anti")


def gate_evidence(rows: DataFrame) -> DataFrame:
    """Evidence (``subject``, ``kind``, ``id``, ``source``), one row for each id: a kind with several ids keeps them all, unaccepted."""
    once = rows.groupBy("subject", "kind", "id").agg(F.min("source").alias("source"))
    several = once.groupBy("subject", "kind").agg((F.count(F.lit(1)) > 1).alias("conflict"))
    return once.join(several, ["subject", "kind"]).select("subject", "kind", "id", "source", (~F.col("conflict")).alias("accepted"), F.when(F.col("conflict"), "conflicting candidates").otherwise("").alias("reason"))

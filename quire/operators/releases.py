"""Digests of releases: a hash tree over ranges of keys, so that equal releases agree and a change is found without reading all of both.

An entity's digest is that of its canonical JSON. Entities fall into leaves by the hash of their key, so leaves are the same whatever the partitions are; leaves are hashed into
``FAN`` parents each, up to one root, with the release's own metadata on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.values import canonical_hash
from quire.sources.shared import written

FAN, LEVELS = 16, 4
#: Fixed value: names the form of the digest.
VERSION = "quire-release-1"


def entity_digests(entities: DataFrame, key: str) -> DataFrame:
    """``key``, ``digest`` of all columns of each entity."""
    return entities.select(F.col(key).cast("string").alias("key"), canonical_hash(*(F.col(c) for c in sorted(entities.columns))).alias("digest"))


def tree(digests: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """``level`` (0: the root), ``node``, ``digest`` of the hash tree over ``key, digest`` rows; empty nodes are not in it. Keys that are repeated count each.

    A leaf is a bag: the sums of two halves of its entities' digests, so no leaf is gathered or sorted, however many entities it has.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(FAN**levels))
    own = F.sha2(F.concat_ws("\x1f", "key", "digest"), 256)
    half = lambda at: F.sum(F.conv(F.substring(own, at, 15), 16, 10).cast("decimal(38,0)"))
    leaf = F.sha2(F.concat_ws("|", half(1).cast("string"), half(16).cast("string"), F.count(F.lit(1)).cast("string")), 256)
    now = written(digests.groupBy(place.alias("node")).agg(leaf.alias("digest")).withColumn("level", F.lit(levels)), "leaves")
    out = now
    for level in range(levels - 1, -1, -1):
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat((x["node"] % FAN).cast("string"), F.lit(":"), x["digest"])), ",")
        now = now.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sha2(listed, 256).alias("digest")).withColumn("level", F.lit(level))  # FAN children at most
        out = out.unionByName(now)
    return out.select("level", "node", "digest")


def release_digest(nodes: DataFrame, metadata: dict[str, str]) -> str:
    """The digest of a release: of the version of the form, its metadata (length before each part) and the root of its tree."""
    root = nodes.where("level = 0").first()
    parts = [VERSION, *(x for kv in sorted(metadata.items()) for x in kv), root["digest"] if root else ""]
    said = "".join(f"{len(x.encode())}:{x}" for x in parts)
    return nodes.sparkSession.range(1).select(F.sha2(F.lit(said), 256)).first()[0]


def changed(a: DataFrame, b: DataFrame, tree_a: DataFrame, tree_b: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """``key``, ``change`` (``added``, ``removed``, ``changed``) between two releases (``key, digest``). Only entities of leaves whose digests differ are compared."""
    side = lambda t, name: t.where(F.col("level") == levels).select("node", F.col("digest").alias(name))
    apart = side(tree_a, "x").join(side(tree_b, "y"), "node", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("node")
    apart = written(apart, "apart")
    some = lambda d, name: d.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(FAN**levels))).join(apart, "node", "left_semi").select("key", F.col("digest").alias(name))
    both = some(a, "x").join(some(b, "y"), "key", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("key", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))

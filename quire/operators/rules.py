"""Rules over entities, and overrides of item documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.values import patch_map


def evaluate(rows: DataFrame, key: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """``key, rule, state`` of every rule for every row, in one pass. A rule is its id, when it is relevant, and when it
    passes; a null in either is an error."""
    state = lambda relevant, ok: F.when(relevant.isNull(), "error").when(~relevant, "not_relevant").when(ok.isNull(), "error").when(ok, "pass").otherwise("fail")
    each = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), state(relevant, ok).alias("state")) for rule, relevant, ok in rules))).alias("x")
    return rows.select(key, each).select(key, "x.rule", "x.state")


def tallies(states: DataFrame) -> DataFrame:
    """How many rows are in each state of each rule."""
    return states.groupBy("rule").agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("pass", "fail", "error", "not_relevant")))


def merge_states(stored: DataFrame, fresh: DataFrame, owned: list[str], key: str) -> DataFrame:
    """Stored states with those of the owned rules replaced by fresh ones."""
    return stored.where(~F.col("rule").isin(owned)).unionByName(fresh.where(F.col("rule").isin(owned)).select(*stored.columns))


def apply_overrides(items: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Items with the label patches of their overrides (a null deletes); items without one are unchanged."""
    patch = overrides.select(key, F.col("labels").alias("_patch"))
    joined = items.join(patch, key, "left")
    return joined.withColumn("labels", F.when(F.col("_patch").isNull(), F.col("labels")).otherwise(patch_map(F.col("labels"), F.col("_patch")))).drop("_patch")


def truthy(statements: DataFrame, key: str) -> DataFrame:
    """Statements of best rank of each item and property: the preferred ones, else the normal ones; deprecated ones never."""
    live = statements.where(F.col("rank").isin("preferred", "normal"))
    best = live.groupBy(key, "property").agg(F.max(F.col("rank") == "preferred").alias("_preferred"))
    return live.join(best, [key, "property"]).where((F.col("rank") == "preferred") == F.col("_preferred")).drop("_preferred")

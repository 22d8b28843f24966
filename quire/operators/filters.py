"""Filters over records, facts and ad-hoc datasets."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 200


def any_contains(items: Column, needles: list[str]) -> Column:
    """Whether any item contains any of the needles, in any case. No needles rule nothing out."""
    if not needles:
        return F.lit(True)
    return F.exists(F.coalesce(items, F.array().cast("array<string>")), lambda x: reduce(or_, [F.contains(F.lower(x), F.lit(n.lower())) for n in needles]))


def years_overlap(start: Column, end: Column, lo: int | None, hi: int | None) -> Column:
    """Interval filter: a missing bound on either side rules nothing out."""
    return F.coalesce(start <= F.lit(hi), F.lit(True)) & F.coalesce(end >= F.lit(lo), F.lit(True))


def columns_match(wanted: dict[str, list[str]]) -> Column:
    """One of the values of each column: OR within a column, AND across columns."""
    return reduce(and_, [F.col(c).cast("string").isin(values) for c, values in wanted.items()], F.lit(True))


def cell(df: DataFrame, name: str) -> Column:
    """A dataset's cell: text of at most 200 characters, empty where the column is missing or null."""
    return F.coalesce(F.substring(F.col(name).cast("string"), 1, CELL), F.lit("")) if name in df.columns else F.lit("")


def dataset_select(df: DataFrame, column: str, op: str, value: str | list[str]) -> DataFrame:
    """Rows whose cell equals, contains (any case) or is one of a value. Any other operation raises ``ValueError``."""
    c = cell(df, column)
    if op == "eq":
        return df.where(c == F.lit(value))
    if op == "contains":
        return df.where(F.contains(F.lower(c), F.lit(str(value).lower())))
    if op == "in":
        return df.where(c.isin([str(v) for v in value]))
    raise ValueError(f"unknown operation {op!r}")


def dataset_search(df: DataFrame, needle: str) -> DataFrame:
    """Rows with the needle in any cell, in any case."""
    return df.where(F.exists(F.array(*(cell(df, c) for c in df.columns)), lambda x: F.contains(F.lower(x), F.lit(needle.lower()))))


def dataset_distinct(df: DataFrame, column: str, limit: int = 25) -> DataFrame:
    """Values of a column with counts, most frequent first, then by value."""
    return df.groupBy(cell(df, column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def dataset_agg(df: DataFrame, column: str) -> DataFrame:
    """Cells that are not empty, and minimum, maximum, sum and mean of those that are numbers (commas removed)."""
    c = cell(df, column)
    x = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")
    return df.agg(F.count_if(c != "").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.sum(x), 4).alias("sum"), F.round(F.avg(x), 6).alias("avg"))


def with_all_facts(facts: DataFrame, wanted: list[tuple[str, str]], *, key: str = "id", limit: int = 500) -> DataFrame:
    """Keys that have every wanted ``(property, value)`` fact, by key. Repeated facts count once."""
    hit = reduce(or_, [(F.col("property") == p) & (F.col("value") == v) for p, v in wanted])
    found = facts.where(hit).groupBy(key).agg(F.count_distinct("property", "value").alias("n"))
    return found.where(F.col("n") == len(set(wanted))).select(key).orderBy(key).limit(limit)


def auto_approve(rows: DataFrame, *, levels: list[str], sources: list[str], kinds: list[str], least_sources: int = 1) -> DataFrame:
    """Rows a rule would approve: not yet approved, no blocking flag, and confidence, source and kind in the rule's lists."""
    ok = ~F.coalesce("approved", F.lit(False)) & ~F.exists("flags", lambda f: F.startswith(f, F.lit("block:")))
    return rows.where(ok & F.col("confidence").isin(levels) & F.arrays_overlap("sources", F.array(*map(F.lit, sources))) & F.col("kind").isin(kinds) & (F.size("sources") >= least_sources))

"""Pages, latest rows per key and bounded top lists."""

from __future__ import annotations

import base64
import binascii

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
MOST = 200


def encode_cursor(sort_value: str, key: str) -> str:
    return base64.urlsafe_b64encode(f"{sort_value}{SEPARATOR}{key}".encode()).decode()


def decode_cursor(cursor: str | None) -> tuple[str, str] | None:
    """Sort value and key of a cursor; None for none or a bad one, which means the first page."""
    try:
        value, mark, key = base64.urlsafe_b64decode((cursor or "").encode()).decode().partition(SEPARATOR)
    except (binascii.Error, UnicodeDecodeError):
        return None
    return (value, key) if mark else None


def keyset_page(rows: DataFrame, sort: str, key: str, *, after: tuple | None = None, limit: int = 50, descending: bool = False) -> DataFrame:
    """The next rows by ``(sort, key)`` after a position, one more than the limit to show that there are more.

    The position is a predicate on the sort column, so sorted files are skipped by their statistics; only the page is sorted (top-k).
    """
    s, k, n = F.col(sort), F.col(key), max(1, min(limit, MOST)) + 1
    if after is not None:
        value, last = F.lit(after[0]).cast(rows.schema[sort].dataType), F.lit(after[1]).cast(rows.schema[key].dataType)
        beyond = (s < value) if descending else (s > value)
        rows = rows.where(beyond | ((s == value) & ((k < last) if descending else (k > last))))
    order = [F.desc(sort), F.desc(key)] if descending else [F.asc(sort), F.asc(key)]
    return rows.orderBy(*order).limit(n)


def offset_page(rows: DataFrame, sort: str, key: str, *, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """Rows of a page by position; nulls come last ascending and first descending."""
    order = F.desc_nulls_first(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(order, key).offset(offset).limit(max(1, min(limit, MOST)))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. Partial aggregation before the shuffle: a hot key sends one row per task."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def by_priority(rows: DataFrame, by: list[str], role: str, priority: Column, order: str) -> DataFrame:
    """One row per key: its role of highest priority (then first by order), and its other roles by name."""
    best = rows.groupBy(*by).agg(F.max_by(role, F.struct(priority, -F.col(order))).alias("role"), F.collect_set(role).alias("roles"))
    return best.select(*by, "role", F.array_join(F.array_sort(F.array_except("roles", F.array("role"))), ",").alias("alt_roles"))


def top_with_mandatory(rows: DataFrame, mandatory: Column, score: str, key: str, budget: int) -> DataFrame:
    """All mandatory rows, and the best of the others by score as far as the budget goes."""
    n = rows.where(mandatory).count()
    rest = rows.where(~mandatory).orderBy(F.desc(score), key).limit(max(0, budget - n))
    return rows.where(mandatory).unionByName(rest)


def ordinals(rows: DataFrame, key: str) -> DataFrame:
    """Position of each row by its key, from 1, without gathering the rows in one task: range partitions are
    numbered on their own and shifted by the sizes of those before them."""
    from quire.sources.shared import written

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ordinals")
    inside = ranged.withColumn("_n", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = inside.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return inside.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("_start") + F.col("_n") + 1).select(*rows.columns, "ordinal")

"""Exact nearest rows by tiled matrix products.

Queries and rows form tiles of bounded size; every tile of queries meets every shard of rows once, as one matrix product in a task. A cell of that grid hands on
each query's best rows only, and these lists are merged as a tree, ``MERGE`` at a time.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

K = 10
SCALE = 1024
SHARD_BYTES, TILE_BYTES = 16 << 20, 8 << 20
PRODUCT_QUERIES = 256
MERGE = 16
EXACT = 2.0**53
LONG = 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``, floats as they are and other numbers as doubles.

    Rows without an id, with a null vector or a null or non-finite component are left out. Of rows that share an id, the least vector counts.
    """
    kept = F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("v")).where("vec_id is not null and v is not null")
    finite = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return finite.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors of one tile as doubles, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def products(queries: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of the scaled, floored components, exactly: as doubles where no sum can reach 2**53, else in Python's integers, held to the ends of a long."""
    with np.errstate(over="ignore"):
        a, b = np.floor(queries * scale), np.floor(rows * scale)
    bound = lambda m: float(np.abs(m).max(initial=0.0))
    if bound(a) * bound(b) * max(1, a.shape[1]) < EXACT:
        return a @ b.T
    integers = lambda m: [[math.floor(Fraction(x) * scale) for x in r] for r in m.tolist()]
    right = integers(rows)
    return np.array([[max(-LONG, min(LONG, sum(map(operator.mul, q, r)))) for r in right] for q in integers(queries)], np.int64)


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of one row of scores, largest first, ties by place."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.argsort(-scores[some], kind="stable")][:k]


_FOUND = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("top", pa.list_(pa.struct([("minus", pa.int64()), ("vec_id", pa.int64())])))])
FOUND = "query_id long, shard int, top array<struct<minus:long,vec_id:long>>"


def _cell(dim: int, k: int, scale: int, query_tiles: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ``k`` best rows of one shard for each query of one tile, the query's own row left out. Scores are negated, so that lists sort best first."""

    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        rows = rows.sort_by("vec_id")  # ties go to the smaller id: the earlier place
        ids, matrix = rows["vec_id"].to_numpy(), _matrix(rows["v"], dim)
        asked, wanted = queries["query_id"].to_numpy(), _matrix(queries["q"], dim)
        found = []
        for at in range(0, len(asked), PRODUCT_QUERIES):
            for query, scores in zip(asked[at : at + PRODUCT_QUERIES].tolist(), products(wanted[at : at + PRODUCT_QUERIES], matrix, scale), strict=True):
                top = [i for i in best_of(scores, k + 1).tolist() if ids[i] != query][:k]
                found.append([{"minus": -int(scores[i]), "vec_id": int(ids[i])} for i in top])
        shard = np.full(len(asked), key[0].as_py() // query_tiles, np.int32)
        return pa.Table.from_arrays([pa.array(asked, pa.int64()), pa.array(shard), pa.array(found, _FOUND.field("top").type)], schema=_FOUND)

    return run


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """One list of the ``k`` best for each ``query_id``, from one for each shard: ``MERGE`` lists become one, until there is one."""
    best = lambda tops: F.slice(F.array_sort(tops), 1, k)
    while shards > 1:
        shards = math.ceil(shards / MERGE)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / MERGE).cast("int").alias("shard")).agg(best(F.flatten(F.collect_list("top"))).alias("top"))
    return lists.select("query_id", "top")


def search(vectors: DataFrame, queries: DataFrame, *, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """For each row of ``queries`` its ``k`` rows of ``vectors`` with the largest inner product of the scaled, floored components.

    ``queries`` holds rows of ``vectors``. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` long. A query's own id is no candidate, copies of
    its vector are. Ties go to the smaller id; fewer than ``k`` candidates are all returned. Rows without an id, with a null vector or null or non-finite components take no part, a zero or
    empty vector does; of rows that share an id the least vector counts; vectors of different lengths are compared as if filled up with zeros. Scores beyond a long are
    those of its ends. An empty table gives an empty result.
    """
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    asked = written(rows.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")
    width = 8 * max(1, size["dim"] or 0)
    shards, tiles = (max(1, math.ceil(n * width / room)) for n, room in ((size["n"], shard_bytes), (asked.count(), tile_bytes)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("shard") * tiles + F.col("tile")).alias("cell")
    left = asked.withColumn("tile", part("query_id", tiles)).select("*", spread(shards).alias("shard")).select(cell, "query_id", "q")
    right = rows.withColumn("shard", part("vec_id", shards)).select("*", spread(tiles).alias("tile")).select(cell, "vec_id", "v")
    lists = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(size["dim"] or 0, k, scale, tiles), FOUND)
    tops = merged(written(lists, "lists"), shards, k)
    return tops.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))

"""Nearest neighbours by a permutation index.

A vector is represented by its pivots in order of nearness. Each of its ``prefix`` nearest
pivots gets a posting (row and rank) in the pivot's inverted file. A query
walks the files of its own ``prefix`` nearest pivots, which adds up the footrule
distance between the two orders (a pivot that one of them has not posted counts as its next rank), and the nearest by footrule are ranked again by their exact
inner product.

Rows are dealt into blocks of bounded size, each with inverted files of its own, which are written once and searched by every block of queries. A block passes on
``DEPTH`` rows for each neighbour asked for and a fixed share of its rows to the exact ranking. Equal vectors
share one entry.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

K = 20
PIVOTS = 384
PREFIX = 128
DEPTH = 10
SHARE = 0.08
LIST_BLOCK, QUERY_BLOCK = 8_192, 4_096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part: an id, and a vector of finite components that are not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def _matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    """Vectors of one batch, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim), dtype)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim).astype(dtype)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _pivots(classes: DataFrame, dim: int, m: int) -> np.ndarray:
    """Unit vectors of a hash sample of ``m`` distinct vectors: the bounded sample that the index is fitted on."""
    rows = classes.select("cid", "v").orderBy(F.xxhash64("cid"), "cid").limit(m).collect()
    p = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        p[i, : len(r["v"])] = r["v"]
    return (p / np.linalg.norm(p, axis=1, keepdims=True)).astype(np.float32)


def _posted(entries: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """Adds ``posted``: the nearest pivots of each vector, nearest first, as 16-bit numbers."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                v = _matrix(part.column(1), pivots.shape[1])
                s = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) @ pivots.T
                order = np.argsort(-s, axis=1, kind="stable")[:, :prefix].astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in order], pa.binary())], names=["cid", "v", "posted"])

    return entries.select("cid", "v").mapInArrow(tidy(run), "cid long, v array<double>, posted binary")


_FOUND = pa.schema([("qid", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())])


def _orders(column, prefix: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), prefix)


class InvertedFiles:
    """For each pivot the rows that posted it, and the rank that it has there."""

    def __init__(self, n: int, prefix: int, starts: np.ndarray, rows: np.ndarray, ranks: np.ndarray):
        self.n, self.prefix, self.starts, self.rows, self.ranks = n, prefix, starts, rows, ranks
        self.kind = np.uint16 if prefix < 360 else np.uint32  # holds the sum of all ranks
        self.open: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, orders: np.ndarray, pivots: int) -> InvertedFiles:
        n, prefix = orders.shape
        by_pivot = np.argsort(orders, axis=None, kind="stable")
        starts = np.searchsorted(orders.ravel()[by_pivot], np.arange(pivots + 1))
        return cls(n, prefix, starts.astype("<i8"), (by_pivot // prefix).astype("<i4"), (by_pivot % prefix).astype("<u2"))

    def _file(self, pivot: int) -> np.ndarray:
        """What each row of the block adds to the nearness for this pivot: the places from its rank to the end of the prefix."""
        if pivot not in self.open:
            some = slice(self.starts[pivot], self.starts[pivot + 1])
            self.open[pivot] = np.zeros(self.n, self.kind)
            self.open[pivot][self.rows[some]] = self.prefix - self.ranks[some]
        return self.open[pivot]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of each row's order to one order. Without a shared pivot it is ``prefix * (prefix + 1)``; a pivot shared at ranks a and b
        takes ``2 * (prefix - max(a, b))`` off that, which is twice the smaller of what the two add."""
        near, one = np.zeros(self.n, self.kind), np.empty(self.n, self.kind)
        for rank, pivot in enumerate(order.tolist()):
            np.minimum(self._file(pivot), self.kind(self.prefix - rank), out=one)
            near += one
        return self.prefix * (self.prefix + 1) - 2 * near.astype(np.int64)


_INDEX = "block int, n int, cids binary, vectors binary, starts binary, rows binary, ranks binary"


def _index_block(dim: int, pivots: int, prefix: int):
    """One row for a block of the index: its ids, vectors and inverted files."""

    def run(key, entries):
        files = InvertedFiles.of(_orders(entries["posted"], prefix), pivots)
        vectors = _matrix(entries["v"], dim).astype("<f8")
        parts = [entries["cid"].to_numpy().astype("<i8"), vectors, files.starts, files.rows, files.ranks]
        names = ["block", "n", "cids", "vectors", "starts", "rows", "ranks"]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([files.n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=names)

    return run


def _search_cell(dim: int, prefix: int, k: int, depth: int, share: float):
    """Searches one block of the index for one block of queries: the ``k`` best of each query by exact score."""

    def run(key, queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return _FOUND.empty_table()
        block = index.to_pylist()[0]
        cids, ev = np.frombuffer(block["cids"], "<i8"), np.frombuffer(block["vectors"], "<f8").reshape(block["n"], dim)
        files = InvertedFiles(block["n"], prefix, np.frombuffer(block["starts"], "<i8"), np.frombuffer(block["rows"], "<i4"), np.frombuffer(block["ranks"], "<u2"))
        n = depth + math.ceil(share * len(cids))
        qv, orders, qids = _matrix(queries["qv"], dim), _orders(queries["q_posted"], prefix), queries["qid"].to_numpy()
        out = []
        for j in range(len(qids)):
            near = np.argpartition(files.footrule(orders[j]), n - 1)[:n] if n < len(cids) else np.arange(len(cids))
            score = (ev[near] * qv[j]).sum(1)
            top = np.lexsort((cids[near], -score))[:k]
            out.append((np.full(len(top), qids[j]), cids[near[top]], score[top]))
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_FOUND)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, depth: int = DEPTH, share: float = SHARE) -> DataFrame:
    """For each row of ``queries`` its ``k`` nearest rows of ``vectors``, by largest inner product.

    ``queries`` holds rows of ``vectors`` (a column ``vec_id``). Returns ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``. A query's own row is no candidate, copies of its vector are. Equal scores are ordered by ``vec_id``.
    Rows without an id, with a null or zero vector or null or non-finite components take no part; repeated rows with equal id
    and vector count once; vectors of different lengths are compared as if filled up with zeros. All candidates are returned
    where there are fewer than ``k``. An empty table gives an empty result.
    """
    rows = usable(vectors)
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k + 1)
    classes = written(few.groupBy("v").agg(F.min("vec_id").alias("cid"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").distinct()
    asked = written(asked.join(classes.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("qid")), "queries")
    sample = _pivots(classes, size["dim"], pivots)
    prefix = max(1, min(prefix, len(sample)))
    posted = written(_posted(classes, sample, prefix), "posted")

    distinct = asked.select(F.col("qid").alias("cid")).distinct()
    row_blocks = math.ceil(size["n"] / LIST_BLOCK)
    query_blocks = max(1, math.ceil(distinct.count() / QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    asks = posted.join(distinct, "cid", "left_semi").select(F.col("cid").alias("qid"), F.col("v").alias("qv"), F.col("posted").alias("q_posted"), part(query_blocks).alias("q_block"), spread(row_blocks).alias("row_block"))
    index = written(posted.withColumn("block", part(row_blocks)).groupBy("block").applyInArrow(_index_block(size["dim"], len(sample), prefix), _INDEX), "index")
    cell = lambda r, q: F.col(r) * query_blocks + F.col(q)
    left = asks.select(cell("row_block", "q_block").alias("cell"), "qid", "qv", "q_posted")
    right = index.withColumn("query_block", spread(query_blocks)).select(cell("block", "query_block").alias("cell"), *index.columns)
    run = _search_cell(size["dim"], prefix, k + 1, depth * k, share)
    found = written(left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, "qid long, cid long, score double"), "found")

    # the k + 1 best vectors hold the k + 1 best rows: one of them may be the query's own
    top = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    near = found.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k + 1)
    by_row = asked.join(near, "qid").join(classes.select("cid", "ids"), "cid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return by_row.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact deduplication by deterministic block naming.

Each normalised text is cut into fixed-size blocks. All blocks of the corpus are
range-sorted and numbered, so equal blocks share one integer name. Names of
neighbouring blocks are then paired, the pairs sorted and numbered again, until
each text has one name. A name stands for one content only: no hash can collide.

Rows are ordered by content and then by document, so a block that a third of the
corpus shares spreads over as many sort partitions as any other third. The driver
sees two digests of 32 bytes per sort partition, never a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NUMBER, Scratch, numbered, shuffle_partitions, sliced, text_bytes, tidy, written

WHITESPACE = b" \t\n\x0b\f\r"
BLOCK_BYTES = 4096
ABSENT = -1

_KEPT = np.ones(256, bool)
_KEPT[list(WHITESPACE)] = False
_BLOCKS = pa.schema([("doc_id", pa.int64()), ("_row", pa.decimal128(38, 0)), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("n_blocks", pa.int32()), ("pos", pa.int32()), ("_digest", pa.binary()), ("_block", pa.binary())])
CUT = f"doc_id long, _row {NUMBER}, n_chars long, text_sha256 string, n_blocks int, pos int, _digest binary, _block binary"


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Normalised texts in blocks, each with its 128-bit digest; the first block of a text carries the text's length and digest."""
    digest = lambda block: hashlib.blake2b(block, digest_size=16).digest()
    for part in sliced(batches, 2):
        data, offsets = text_bytes(part.column(2))
        kept = _KEPT[data]
        norm = data[kept].tobytes()
        cuts = np.concatenate(([0], np.cumsum(kept)))[offsets].tolist()
        chars = pc.fill_null(pc.utf8_length(part.column(2)), 0).to_pylist()
        out = []
        for i, (doc_id, row) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
            text = norm[cuts[i] : cuts[i + 1]]
            n = max(1, -(-len(text) // block_bytes))
            blocks = [text[k * block_bytes : (k + 1) * block_bytes] for k in range(n)]
            out.append((doc_id, row, chars[i], hashlib.sha256(text).hexdigest(), n, 0, digest(blocks[0]), blocks[0]))
            out += ((doc_id, row, None, None, n, k, digest(blocks[k]), blocks[k]) for k in range(1, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


def _edge_key(values: tuple) -> bytes:
    """Digest of the keys of one row."""
    parts = [v if isinstance(v, bytes) else repr(v).encode() for v in values]
    return hashlib.sha256(b"".join(len(p).to_bytes(8, "little") + p for p in parts)).digest()


def _number_runs(batches: Iterator[pa.RecordBatch], keys: list[str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal keys in one sorted partition; show a digest of the keys of its first and last row."""
    part, rank, last = TaskContext.get().partitionId(), -1, None
    held: pa.RecordBatch | None = None

    def out(b: pa.RecordBatch, is_last: bool) -> pa.RecordBatch:
        nonlocal rank, last
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        n = b.num_rows
        new = pa.array([last is None or last != tuple(c[0].as_py() for c in cols)])
        if n > 1:
            differs = [pc.not_equal(c[1:], c[:-1]) for c in cols]
            step = differs[0]
            for d in differs[1:]:
                step = pc.or_(step, d)
            new = pa.concat_arrays([new, step])
        ranks = pc.add(pc.cumulative_sum(new.cast(pa.int64())), pa.scalar(rank, pa.int64()))
        first = rank == -1
        rank, last = ranks[-1].as_py(), tuple(c[n - 1].as_py() for c in cols)
        edge = {0} if first else set()
        edge |= {n - 1} if is_last else set()
        shown = pa.array([_edge_key(tuple(c[i].as_py() for c in cols)) if i in edge else None for i in range(n)], pa.binary()) if edge else pa.nulls(n, pa.binary())
        marks = pa.array([(1 if first and i == 0 else 0) + (2 if is_last and i == n - 1 else 0) for i in range(n)] if edge else [0] * n, pa.int32())
        return pa.RecordBatch.from_arrays(
            [*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array([part] * n, pa.int32()), ranks, marks, shown],
            names=[*keep, "_part", "_rank", "_edge", "_edge_key"],
        )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held is not None:
            yield out(held, False)
        held = batch
    if held is not None:
        yield out(held, True)


def name_by_order(df: DataFrame, keys: list[str], ties: list[str], tag: str = "names", ranged: list[str] | None = None) -> DataFrame:
    """Replace the ``keys`` of each row by ``name``, their dense rank in the whole table.

    Keys must not be null. ``ties`` only order rows of equal keys, so that equal keys may
    span sort partitions. Columns other than the keys are kept. The result is read from a
    written table.

    ``ranged`` are the leading keys that deal rows to partitions, where later keys are long: a digest of at least 128 bits of all keys.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in keys]
    order = [*keys, *ties]
    dealt = df.repartitionByRange(shuffle_partitions(spark), *(ranged or keys), *ties).sortWithinPartitions(*order)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "_part int, _rank long, _edge int, _edge_key binary"])
    ranked = written(dealt.mapInArrow(tidy(lambda it: _number_runs(it, keys, keep)), schema), tag)

    edges = sorted(((r["_part"], r["_edge"], r["_rank"], r["_edge_key"]) for r in ranked.where("_edge > 0").select("_part", "_edge", "_rank", "_edge_key").collect()), key=lambda e: (e[0], e[2], e[1]))
    first = {p: key for p, e, _, key in edges if e & 1}
    last = {p: (rank, key) for p, e, rank, key in edges if e & 2}
    offsets, base, before = [], 0, None
    for p in sorted(first):
        if before is not None and before == first[p]:
            base -= 1
        offsets.append((p, base))
        base, before = base + last[p][0] + 1, last[p][1]
    table = spark.createDataFrame(offsets or [(0, 0)], "_part int, _base long")
    return ranked.join(F.broadcast(table), "_part").select(*keep, (F.col("_rank") + F.col("_base")).alias("name"))


def text_identities(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id``, ``_row`` (a number of the row: ``row_col``, if given), ``n_chars`` (code points of the original
    text), ``text_sha256``, and the collision-free identity ``(level, name)`` of its text.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``.
    Null counts as empty. Rows may repeat ids, ids may be null, other columns are ignored.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id().cast(NUMBER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), number.alias("_row"), F.col(text_col).alias("text"))
    # written, so that texts are cut once and not again for the range bounds
    blocks = written(rows.mapInArrow(tidy(lambda it: _cut(it, block_bytes)), CUT), "cut")
    named = name_by_order(blocks, ["_digest", "_block"], ["_row", "pos"], "blocks", ranged=["_digest"])
    heads = named.where("pos = 0").select("doc_id", "_row", "n_chars", "text_sha256", "n_blocks", "name")
    done = heads.where("n_blocks = 1").select("doc_id", "_row", "n_chars", "text_sha256", F.lit(0).alias("level"), "name")

    most = named.agg(F.max("n_blocks")).first()[0] or 1
    current, level, width, finished = named.where("n_blocks > 1").select("_row", "n_blocks", "pos", "name"), 0, 1, []
    while width < most:
        level, width = level + 1, width * 2
        pairs = current.groupBy("_row", "n_blocks", (F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("_left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(ABSENT)).alias("_right"),
        )
        current = name_by_order(pairs.withColumnRenamed("half", "pos"), ["_left", "_right"], ["_row", "pos"], "pairs")
        finished.append(current.where(F.col("n_blocks") <= width).select("_row", F.lit(level).alias("level"), "name"))
        current = current.where(F.col("n_blocks") > width)
    if not finished:
        return done
    long_names = finished[0]
    for more in finished[1:]:
        long_names = long_names.unionByName(more)
    longs = heads.where("n_blocks > 1").drop("name").join(long_names, "_row")
    return done.unionByName(longs.select(*done.columns))


def exact_groups(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row with its group of equal texts.

    ``keep_id`` is the id of the row that stays: the most code points in the original text,
    then the smallest id (null ids last). ``kept`` marks exactly one row of each group, also when ids
    repeat. An empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as scratch:  # blocks and names go once there are identities
        ids = scratch.keep(text_identities(docs, **kw), "identities")
    rank = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    # written, so that the join has a plain shuffle on both sides and a hot group can be split
    groups = written(ids.groupBy("level", "name").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
        "n_chars",
        "_row",
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` of which one of each group of equal texts stays, that of ``exact_groups``; all columns unchanged.

    Rows count each for itself, whatever their ids: a row goes only if another with its text stays.
    """
    rows, number = numbered(docs)
    dropped = exact_groups(rows, row_col=number).where("not kept").select(F.col("_row").alias("_dropped"))
    return rows.join(dropped, rows[number] == dropped["_dropped"], "left_anti").drop(number)

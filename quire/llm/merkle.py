"""Merkle manifest of a table: one hash tree for each group of rows, and one over the groups' roots.

Nodes are numbered in their tree, and ``BLOCK`` consecutive ones form an ordered array. Higher-order functions collapse such an array ``HEIGHT`` levels
up inside one row; the roots of the blocks are the nodes of the next pass, until a tree is one block. Proofs go down the same blocks: a block's path to the root is
worked out once and its nodes add the levels within it. A tree of a third of all rows is as many blocks as its size asks for, dealt by number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import placed_in_groups, written

FAN, HEIGHT = 16, 2
BLOCK = FAN**HEIGHT


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _levels(nodes: Column, count: Column) -> Column:
    """The digests of one block and of each level above it, up to the block's root or the tree's if that is nearer (``count``: nodes of the tree)."""
    heights = F.filter(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda h: count > F.pow(F.lit(float(FAN)), h))
    runs = lambda below: F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
    above = lambda below: F.transform(runs(below), lambda r: F.sha2(F.array_join(F.slice(below, r * FAN + 1, FAN), ""), 256))
    return F.aggregate(heights, F.array(nodes), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _steps(levels: Column, at: Column) -> Column:
    """Siblings of the node at place ``at`` of a block, to the left and to the right, on every level within the block."""

    def step(level: Column, height: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(FAN)), height)).cast("int")
        left = place % FAN
        return F.struct(
            F.array_join(F.slice(level, place - left + 1, left), "").alias("left"),
            F.array_join(F.slice(level, place + 2, FAN - 1 - left), "").alias("right"),
        )

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _blocks(placed: DataFrame, tag: str) -> DataFrame:
    """One row per block: ``tree``, ``block``, ``count``, ``nodes`` in order, ``levels``, ``root``."""
    node = F.struct("pos", *(c for c in placed.columns if c not in ("tree", "pos", "count")))
    block = placed.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("count").alias("count"), F.array_sort(F.collect_list(node)).alias("nodes"))
    block = block.withColumn("levels", _levels(F.transform("nodes", lambda x: x["digest"]), F.col("count")))
    return written(block.withColumn("root", F.element_at(F.element_at("levels", -1), 1)), tag)


def _grown(placed: DataFrame) -> list[DataFrame]:
    """Blocks of every pass, from the leaves up to where each tree is one block."""
    passes = [_blocks(placed, "blocks")]
    while (passes[-1].agg(F.max("count")).first()[0] or 0) > BLOCK:
        nodes = passes[-1].where(F.col("count") > BLOCK).select("tree", F.col("root").alias("digest"), F.col("block").alias("pos"), F.ceil(F.col("count") / BLOCK).alias("count"))
        passes.append(_blocks(nodes, "blocks"))
    return passes


def _roots(passes: list[DataFrame]) -> DataFrame:
    """``tree`` and ``root`` of each tree."""
    done = [p.where(F.col("count") <= BLOCK).select("tree", "root") for p in passes]
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def _paths(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf (``tree``, ``node``) with its ``path`` and the other columns of ``above``, which has a row and the rest of the path for each tree."""
    kept = [c for c in above.columns if c not in ("tree", "path")]
    lower: DataFrame | None = None
    for blocks in reversed(passes):
        ends = blocks.where(F.col("count") <= BLOCK).select("tree", "block").join(above, "tree")
        up = ends if lower is None else ends.unionByName(lower.select("tree", F.col("node.pos").alias("block"), "path", *kept))
        within = F.transform("nodes", lambda x, i: F.struct(x.alias("node"), _steps(F.col("levels"), i).alias("steps")))
        each = blocks.select("tree", "block", within.alias("within"))
        rows = each.join(up, ["tree", "block"]).select("tree", "path", *kept, F.explode("within").alias("x"))
        lower = rows.select("tree", F.col("x.node").alias("node"), F.concat("x.steps", "path").alias("path"), *kept)
    return lower


@dataclass
class Manifest:
    """Written tables of blocks for each pass, of the groups' trees and of the tree over them."""

    groups: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def subroots(self) -> DataFrame:
        """``tree`` and ``subroot``: the root of each group."""
        return _roots(self.groups).withColumnRenamed("root", "subroot")

    def proofs(self) -> DataFrame:
        """One row per leaf: ``leaf``, the columns it was given, ``subroot``, ``root``, ``path``."""
        steps = "array<struct<left:string,right:string>>"
        start = _roots(self.top).select("tree", "root", F.array().cast(steps).alias("path"))
        tops = _paths(self.top, start).select(F.col("node.name").alias("tree"), F.col("node.digest").alias("subroot"), "root", "path")
        rows = _paths(self.groups, written(tops, "tops"))
        return rows.select(F.col("node.digest").alias("leaf"), "node.item.*", "subroot", "root", "path")


def manifest(leaves: DataFrame, *, group: str, order: list[str]) -> Manifest:
    """Manifest of ``leaves``: a column ``digest`` and any others, which proofs give back.

    Leaves of a ``group`` ascend by ``order`` (null first); of equal ones the smaller digest goes first. Groups ascend by the bytes of their UTF-8 text,
    null first, and null is not the empty text. Repeated rows are leaves of their own. An empty table has no root.
    """
    # a tree's name puts null first and apart from every text
    name = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(order)]
    rows = leaves.select(name.alias("tree"), *keys, "digest", F.struct(*(c for c in leaves.columns if c != "digest")).alias("item"))
    # the last column of the order keeps a repeated row from being one key of the ranges
    rows = written(rows.withColumn("_copy", F.monotonically_increasing_id()), "leaves")
    placed = placed_in_groups(rows, "tree", [f"key{i}" for i in range(len(order))] + ["digest", "_copy"])
    groups = _grown(placed.select("tree", "digest", "item", "pos", "count"))
    tops = _roots(groups).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    top = _grown(placed_in_groups(tops, "tree", ["name"]))
    root = _roots(top).first()
    return Manifest(groups, top, root["root"] if root else None)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 5


def leaf(row: dict[str, Column]) -> Column:
    """Digest of one document."""
    return digest(*(field(row[c]) for c in FIELDS))


def document_proofs(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by source, and every document's proof checked against the root.

    A document whose id has a CRC-32 that ``TAMPER_EVERY`` divides is checked as if its text had been lower-cased (A to Z only). Returns ``doc_id``, ``leaf``, ``subroot``,
    ``root``, ``proof_sha256``, ``folded_root``, ``verified``. Null columns count as ``-``, an empty text as ``0:``; a null id comes first and is not tampered with; repeated ids are
    ordered by their leaves. Other columns are not read. An empty table gives an empty result.
    """
    row = {c: F.col(c) for c in FIELDS}
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    other = F.when(hit, leaf(row | {"text": F.translate("text", upper, upper.lower())}))
    leaves = docs.select("doc_id", "source", leaf(row).alias("digest"), other.alias("tampered"))
    checked = manifest(leaves, group="source", order=["doc_id"]).proofs()
    checked = checked.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return checked.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Line deduplication by pairwise alignment.

Documents are aligned by patience diff, and common blocks of aligned lines go from the later document (larger id). The result is that of
aligning all pairs, but only those are aligned that can add to it. A block holds a window, a shortest run of lines with enough characters, that
both documents have, so documents are found through the hashes of their windows. Each is aligned with the first document that has
a window; where lines of the window stay, with further holders, in batches that grow ``rare`` times a round, until the lines are gone or all
earlier holders were asked. Of documents with the same lines only the first takes part: the others go whole. The work of a window that patience never
aligns still grows with the square of its holders. Lines and texts are told apart by 128 bits of a digest; a task aligns one pair of documents at a time.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

RARE = 8
MIN_CHARS = 48


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, whose second parts increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _nth(lines: list) -> list[tuple]:
    seen: Counter = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal lines in ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        anchors = _increasing([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place])
        if not anchors:  # no line is unique in both: the n-th occurrences of a line are taken for each other
            nth = dict(zip(_nth(b[b0:b1]), range(b0, b1), strict=True))
            anchors = _increasing([(i, nth[x]) for i, x in enumerate(_nth(a[a0:a1]), a0) if x in nth])
        if not anchors:
            continue
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            stack.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(set(out))


def common_blocks(a: list, b: list, sizes_b: list[int], min_chars: int) -> list[int]:
    """Positions in ``b`` of the blocks it has in common with ``a``, of ``min_chars`` characters at least."""
    out: list[int] = []
    block: list[int] = []
    last = None

    def close() -> None:
        if sum(sizes_b[j] for j in block) >= min_chars:
            out.extend(block)

    for i, j in patience(a, b):
        if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
            close()
            block = []
        block.append(j)
        last = (i, j)
    close()
    return out


def _aligned(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            doc, text_hash, a, b, sizes = (c[i].as_py() for c in batch.columns)
            out += [(doc, text_hash, j) for j in common_blocks(a, b, sizes, min_chars)]
        ids, hashes, at = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(at, pa.int32())], names=["doc_id", "th", "at"])


def windows(h: list[bytes], n: list[int], min_chars: int) -> set[tuple[int, int, int]]:
    """Hash, first and last position of the shortest runs of ``min_chars`` characters from each line on and up to each line.

    Every line of a run that is long enough lies in one of these windows within the run.
    """
    ends = [0, *accumulate(n)]
    spans = set()
    for p in range(len(h)):
        q = bisect_left(ends, ends[p] + min_chars, p + 1) - 1
        if q < len(h):
            spans.add((p, q))
        q = bisect_right(ends, ends[p + 1] - min_chars, 0, p + 1) - 1
        if q >= 0:
            spans.add((q, p))
    key = lambda run: int.from_bytes(hashlib.blake2b(b"".join(run), digest_size=8).digest(), "little", signed=True)
    return {(key(h[p : q + 1]), p, q) for p, q in spans}


def _windows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    names, kinds = ["d", "th", "g", "p", "q"], [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()]
    for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = [(d, th, *w) for d, th, h, n in rows for w in windows(h, n, min_chars)]
        columns = zip(*out, strict=True) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def repeated_lines(docs: DataFrame, *, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``th`` (digest of the text) and ``drop``: the line numbers (from 0) to delete, for documents that lose lines."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("th"), F.split(text, "\n").alias("raw"))
    numbered = F.transform("raw", lambda x, i: F.struct(i.alias("at"), _digest(F.trim(x)).alias("h"), F.length(F.trim(x)).alias("n")))
    same = F.md5(F.array_join(F.filter(F.transform("raw", lambda x: F.trim(x)), lambda x: F.length(x) > 0), "\n"))
    lines = keyed.select("doc_id", "th", same.alias("same"), F.filter(numbered, lambda x: x["n"] > 0).alias("lines")).where(F.size("lines") > 0)
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "th")
    cut = lines.select(key.alias("k"), "same", F.col("lines.at").alias("at"), F.col("lines.h").alias("h"), F.col("lines.n").alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    table = written(cut.withColumn("total", total).where(F.col("total") >= min_chars).dropDuplicates(["k"]), "lines")
    # written, so that the join has a plain shuffle on both sides and a hot group can be split
    firsts = written(table.groupBy("same").agg(F.min("k").alias("first")), "firsts")
    table = written(table.join(firsts, "same").select("k", "at", "h", "n", (F.col("k") != F.col("first")).alias("copy")), "lines")
    alone = table.where("not copy")

    spans = alone.select("k.d", "k.th", "h", "n").mapInArrow(tidy(lambda it: _windows(it, min_chars)), "d long, th binary, g long, p int, q int")
    spans = written(spans.select(F.struct("d", "th").alias("k"), "g", "p", "q"), "windows")
    holders = written(spans.select("g", "k").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.min("k").alias("first")).where("df > 1"), "holders")
    shared = written(spans.join(holders, "g"), "shared")

    side = lambda name: alone.select(F.col("k").alias(name), F.col("h").alias(f"h_{name}"), F.col("n").alias(f"n_{name}"))

    def aligned(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("b"), "b").join(side("a").select("a", "h_a"), "a")
        texts = both.select(F.col("b.d").alias("doc_id"), F.col("b.th").alias("th"), "h_a", "h_b", "n_b")
        found = texts.mapInArrow(tidy(lambda it: _aligned(it, min_chars)), "doc_id long, th binary, at int")
        return written(found.groupBy(F.struct(F.col("doc_id").alias("d"), "th").alias("k")).agg(F.collect_set("at").alias("places")), "gone")

    left = shared.where("k <> first")
    gone = aligned(left.select(F.col("first").alias("a"), F.col("k").alias("b")).distinct())
    lo, hi = 0, rare
    turn = F.floor(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) * F.col("df") / (1 << 30))  # of a holder, 0 to df - 1
    left = left.where("df > 2")
    while True:
        stays = F.exists(F.sequence("p", "q"), lambda x: ~F.array_contains(F.coalesce("places", F.array().cast("array<int>")), x))
        left = written(left.join(gone, "k", "left").where(stays).select("g", "k", "p", "q", "df"), "left")
        if left.isEmpty():
            break
        asked = shared.where((turn >= lo) & (turn < hi) & (F.col("k") != F.col("first"))).select("g", F.col("k").alias("a")).distinct()
        more = aligned(left.select("g", F.col("k").alias("b")).distinct().join(asked, "g").where("a < b").select("a", "b").distinct())
        gone = written(gone.union(more).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "gone")
        left, lo, hi = left.where(F.col("df") > hi), hi, hi * max(rare, 2)

    drop = F.transform("places", lambda i: F.get("at", i))
    some = gone.join(alone.select("k", "at"), "k").select("k", drop.alias("drop"))
    lost = some.union(table.where("copy").select("k", F.col("at").alias("drop")))
    return lost.select(F.when(F.col("k.d") > -(1 << 63), F.col("k.d")).alias("doc_id"), "k.th", "drop")


def drop_repeated_lines(docs: DataFrame, *, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of ``docs``, their ``text`` without the lines of common blocks, and ``_dropped``, the number of these.

    Lines are compared without spaces at their ends; blank lines never count and stay. A later document has the larger ``doc_id`` (null ids are
    the smallest, texts of one id go by their hash). Rows that repeat an id and a text are one document and are
    treated alike. A null text stays null. An empty table gives an empty result.
    """
    marks = written(repeated_lines(docs, rare=rare, min_chars=min_chars), "repeats")
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["doc_id"]) & (_digest(text) == marks["th"]), "left")
    left = F.array_join(F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(marks["drop"], i)), "\n")
    kept = F.when(marks["drop"].isNull(), docs["text"]).otherwise(left)
    others = [c for c in docs.columns if c != "_dropped"]
    return joined.select(*(kept.alias("text") if c == "text" else docs[c] for c in others), F.coalesce(F.size(marks["drop"]), F.lit(0)).alias("_dropped"))


def line_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines`` and ``n_dropped``, and the length and digest of the text that stays, for every row."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    stays = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.size(F.split(stays, "\n")) + F.col("_dropped")).cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.length(stays).cast("long").alias("n_chars"), F.sha2(F.encode(stays, "UTF-8"), 256).alias("text_sha256"))

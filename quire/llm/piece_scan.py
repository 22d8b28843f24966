"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A sequence of pieces is the BPE encoding of a text exactly if every two neighbours are the encoding of
their own concatenation. So the best path over positions, where a step between two neighbours
scores the piece's score if they fit and minus infinity if not, is the encoding, and it can be found from both
ends. A giant document is cut into chunks. A chunk turns each possible state at its left
boundary (the piece that reaches up to it or over it) into scores of the states at its right boundary: a
matrix. Matrices of neighbouring chunks combine by max-plus products, in any grouping: pairs of neighbours, level by level, up to one matrix for each
run of chunks; down the same levels follow the states that the best path takes at the boundaries, and every chunk is then traced back on its own.

No piece reaches over the start of a word, so a boundary there has one state, and chunks are cut there if a word starts
nearby. Only words longer than a chunk need larger matrices. What is left of a chunk between word starts is
encoded by the library, each distinct word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, tidy, written

SPACE = "▁"
GIANT = 32_768
CHUNK = 8_192
LOOKBACK = 1_024
CACHE_WORDS = 100_000
FITS = 1 << 17
NONE = float("-inf")


class Pieces:
    """A BPE model without normalisation whose pieces start, but never continue, with a space mark."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.lib.get_piece_size()
        special = [self.lib.is_unknown(i) or self.lib.is_control(i) or self.lib.is_byte(i) or self.lib.is_unused(i) for i in range(n)]
        self.ids = {self.lib.id_to_piece(i): i for i in range(n) if not special[i]}
        self.scores = [self.lib.get_score(i) for i in range(n)]
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of the model reaches over the start of a word")
        self.cache: dict[str, bytes] = {}
        self.byte_id = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.x = self.ids["x"]

    # ordinary texts

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, equal to the library's own."""
        if not text:
            return b""
        words = text.replace(SPACE, " ").split(" ")
        if "" in words:
            return np.array(self.lib.encode(text, num_threads=1), "<u4").tobytes()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in set(words) if w not in self.cache]
        for w, ids in zip(new, self.lib.encode(new, num_threads=1) if new else [], strict=True):
            self.cache[w] = np.array(ids, "<u4").tobytes()
        return b"".join(map(self.cache.__getitem__, words))

    def encode_marked(self, text: str) -> bytes:
        """Ids of whole words of a marked text, from the mark in front of the first."""
        return self.encode(text[1:]) if text.strip(SPACE) else np.array(_spaces(self, len(text)), "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: bytes, first: bool = True) -> str:
        """Text of ids; ``first`` is false for a chunk that does not begin its document."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return self.lib.decode(tokens) if first else self.lib.decode([self.x, *tokens])[1:]

    # max-plus scan

    def score(self, piece: str) -> float:
        i = self.ids.get(piece)
        return self.scores[i] if i is not None else 0.0

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode()]

    def merge(self, text: str) -> list[str]:
        """The BPE encoding of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.scores[j] > best:
                    best, at = self.scores[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @lru_cache(maxsize=FITS)  # noqa: B019  one object in each worker
    def fit(self, a: str, b: str) -> bool:
        return self.merge(a + b) == [a, b]

    @lru_cache(maxsize=FITS)  # noqa: B019
    def whole(self, piece: str) -> bool:
        """Whether the encoding of this text is one piece."""
        return self.merge(piece) == [piece]

    def starting(self, text: str, at: int, end: int) -> Iterator[int]:
        """Ends of the pieces that start at ``at``. Any single character is a piece."""
        yield at + 1
        for e in range(at + 2, min(at + self.longest, end) + 1):
            if text[at:e] in self.ids and self.whole(text[at:e]):
                yield e

    def states(self, text: str, b: int) -> list[tuple[int, int]]:
        """Spans of the pieces that may reach up to or over position ``b``."""
        return [(a, e) for a in range(max(0, b - self.longest), b) for e in self.starting(text, a, len(text)) if e >= b]

    def paths(self, text: str, start: tuple[int, int] | int, end: int) -> dict[int, tuple[int, float, int]]:
        """Best path from a state (or a word start) through ``text`` up to ``end``: for each position that a
        piece ends at, the start of that piece, the score, and the position before."""
        at = start if isinstance(start, int) else start[1]
        reach: dict[int, tuple[int, float, int]] = {at: (-1 if isinstance(start, int) else start[0], 0.0, -1)}
        for pos in range(at, end):
            if pos not in reach:
                continue
            before, score, _ = reach[pos]
            last = text[before:pos] if before >= 0 else None
            for e in self.starting(text, pos, len(text)):
                piece = text[pos:e]
                if last is None or self.fit(last, piece):
                    s = score + self.score(piece)
                    if e not in reach or s > reach[e][1]:
                        reach[e] = (pos, s, pos)
        return reach


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def marked(text: str) -> str:
    """The text as the model sees it: spaces as marks, one more in front."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def cuts(text: str, chunk: int = CHUNK, lookback: int = LOOKBACK) -> list[tuple[int, bool]]:
    """Boundaries of the chunks of a marked text and whether each is the start of a word. A run of spaces is never cut."""
    out = [(0, True)]
    for b in range(chunk, len(text), chunk):
        j = text.rfind(SPACE, max(out[-1][0] + 1, b - lookback), b + 1)
        if j >= 0:
            k = len(text[:j].rstrip(SPACE))
            if k > out[-1][0]:
                out.append((k, True))
        elif b > out[-1][0]:
            out.append((b, False))
    return [*out, (len(text), True)]


def _spaces(p: Pieces, n: int) -> list[int]:
    """A run of space marks that nothing joins: the longest pieces first, from the left."""
    return p.lib.encode(" " * (n - 1), num_threads=1) if n > 1 else [p.ids[SPACE]] * n


def word_starts(text: str, lo: int, hi: int) -> tuple[int, int]:
    """First and last start of a word in a range, or -1."""
    first = lo
    while (first := text.find(SPACE, first, hi)) >= 0 and first > 0 and text[first - 1] == SPACE:
        first += 1
    last = text.rfind(SPACE, lo, hi)
    if last >= 0:
        last = len(text[:last].rstrip(SPACE))
        last = last if last >= lo else -1
    return (first, last) if first >= 0 and last >= first else (-1, -1)


class Chunk:
    """Part ``lo`` to ``hi`` of a marked text with some of what surrounds it."""

    def __init__(self, p: Pieces, text: str, lo: int, hi: int, left_open: bool, right_open: bool):
        self.p, self.text, self.lo, self.hi, self.left_open, self.right_open = p, text, lo, hi, left_open, right_open
        first, last = word_starts(text, lo, hi) if left_open or right_open else (lo, lo)
        self.first = (first if first >= 0 else -1) if left_open else lo
        self.last = (last if last >= 0 else -1) if right_open else hi
        self.left = p.states(text, lo) if left_open else [None]
        self.right = p.states(text, hi) if right_open else [None]

    def _middle(self) -> bytes:
        """The words between the first and the last start of a word, by the library."""
        return self.p.encode_marked(self.text[self.first : self.last]) if self.last > self.first >= 0 else b""

    def _head(self) -> tuple[int, int]:
        """Marks in front of the last word, and where its path starts: at the last mark."""
        n = len(self.text) - self.last - len(self.text[self.last :].lstrip(SPACE))
        return n, self.last + max(0, n - 1)

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.left), len(self.right)), NONE)
        whole = self.first < 0 or self.last < 0
        tail = None if not self.right_open or whole else self.p.paths(self.text, self._head()[1], self.hi)
        for i, state in enumerate(self.left):
            if not self.left_open:
                lead = 0.0
            else:
                stop = self.hi if whole else self.first
                if state[1] > stop:
                    reach = {}
                else:
                    reach = self.p.paths(self.text, state, stop)
                if not whole or not self.right_open:
                    if stop not in reach:
                        continue
                    lead = reach[stop][1]
                else:
                    for j, (a, e) in enumerate(self.right):
                        if e in reach and reach[e][0] == a:
                            out[i, j] = reach[e][1]
                        elif (a, e) == state:
                            out[i, j] = 0.0
                    continue
            if not self.right_open:
                out[i, 0] = lead
                continue
            for j, (a, e) in enumerate(self.right):
                if e in tail and tail[e][0] == a:
                    out[i, j] = lead + tail[e][1]
        return out

    def trace(self, i: int, j: int) -> bytes:
        """Ids of the pieces that start in the chunk, given the states at its boundaries."""
        p, whole = self.p, self.first < 0 or self.last < 0

        def back(reach: dict, e: int) -> list[str]:
            out = []
            while reach[e][2] >= 0:
                out.append(self.text[reach[e][0] : e])
                e = reach[e][2]
            return out[::-1]

        ids: list[int] = []
        if self.left_open:
            stop = self.hi if whole else self.first
            end = stop if not (whole and self.right_open) else self.right[j][1]
            if not (whole and self.right_open and self.right[j] == self.left[i]):
                for piece in back(p.paths(self.text, self.left[i], stop), end):
                    ids += p.piece_ids(piece)
            if whole:
                return np.array(ids, "<u4").tobytes()
        out = np.array(ids, "<u4").tobytes() + self._middle()
        if self.right_open:
            n, at = self._head()
            pieces = back(p.paths(self.text, at, self.hi), self.right[j][1])
            lone = pieces and pieces[0] == SPACE
            tail = _spaces(p, n if lone else n - 1)
            for piece in pieces[1:] if lone else pieces:
                tail += p.piece_ids(piece)
            out += np.array(tail, "<u4").tobytes()
        return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def between(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """State at the boundary of two neighbours on the best path from state ``i`` through both to state ``j``."""
    return int(np.argmax(a[i] + b[:, j]))


_CHUNK = pa.schema([("doc_row", pa.int64()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("segment", pa.int32()), ("k", pa.int32()), ("left_open", pa.bool_()), ("right_open", pa.bool_()), ("text", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])


def _chunk_rows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Chunks of giant texts, each with as much of its surroundings as its boundaries need."""
    pad = 64
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = marked(text)
            at = cuts(s, chunk)
            segment, first = 0, 0
            for k in range(len(at) - 1):
                (lo, closed), (hi, closed_right) = at[k], at[k + 1]
                if closed:
                    segment, first = segment + 1, k
                a, b = max(0, lo - pad) if not closed else lo, min(len(s), hi + pad) if not closed_right else hi
                yield pa.RecordBatch.from_pylist([{"doc_row": row, "chunk": k, "n_chunks": len(at) - 1, "segment": segment, "k": k - first, "left_open": not closed, "right_open": not closed_right, "text": s[a:b], "lo": lo - a, "hi": hi - a}], _CHUNK)


def _transfers(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    p = _pieces(model)
    kinds = pa.schema([("ids", pa.binary()), ("matrix", pa.binary()), ("n_left", pa.int32()), ("n_right", pa.int32())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if not (r["left_open"] or r["right_open"]):
                rows.append({"ids": p.encode_marked(r["text"])})
            else:
                m = Chunk(p, r["text"], r["lo"], r["hi"], r["left_open"], r["right_open"]).matrix()
                rows.append({"matrix": m.astype("<f8").tobytes(), "n_left": m.shape[0], "n_right": m.shape[1]})
        yield pa.RecordBatch.from_arrays([*batch.columns, *pa.Table.from_pylist(rows, kinds).combine_chunks().to_batches()[0].columns], names=[*batch.schema.names, *kinds.names])


def _matrix(x: dict) -> np.ndarray:
    return np.frombuffer(x["matrix"], "<f8").reshape(x["n_left"], x["n_right"])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each pair of neighbours; one without a right neighbour stays."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            m = _matrix(r["l"]) if r["r"] is None else combine(_matrix(r["l"]), _matrix(r["r"]))
            yield pa.RecordBatch.from_pylist([{"doc_row": r["doc_row"], "segment": r["segment"], "k": r["half"], "matrix": m.astype("<f8").tobytes(), "n_left": m.shape[0], "n_right": m.shape[1]}], _MATRIX)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at both boundaries of each neighbour, given those of the pair."""
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            r = batch.slice(n, 1).to_pylist()[0]
            at, k, i, j = {"doc_row": r["doc_row"], "segment": r["segment"]}, 2 * r["half"], r["i"], r["j"]
            if r["r"] is None:
                rows.append(at | {"k": k, "i": i, "j": j})
            else:
                m = between(_matrix(r["l"]), _matrix(r["r"]), i, j)
                rows += [at | {"k": k, "i": i, "j": m}, at | {"k": k + 1, "i": m, "j": j}]
        yield pa.RecordBatch.from_pylist(rows, _STATE)


_MATRIX = pa.schema([("doc_row", pa.int64()), ("segment", pa.int32()), ("k", pa.int32()), ("matrix", pa.binary()), ("n_left", pa.int32()), ("n_right", pa.int32())])
_STATE = pa.schema([("doc_row", pa.int64()), ("segment", pa.int32()), ("k", pa.int32()), ("i", pa.int32()), ("j", pa.int32())])


def boundary_states(matrices: DataFrame) -> DataFrame:
    """States ``i`` and ``j`` at the boundaries of each chunk ``k`` of a run (``doc_row``, ``segment``) on its best path.

    Up: matrices of neighbours ``2 n`` and ``2 n + 1`` combine to one, until a run has one. Down: of the two states of a
    pair and its two matrices follows the state between them. A task holds one pair at a time, whatever the length of a run.
    """
    side = lambda odd: F.max(F.when(F.col("k") % 2 == odd, F.struct("matrix", "n_left", "n_right")))
    current, levels = matrices.select(*_MATRIX.names), []
    while (current.agg(F.max("k")).first()[0] or 0) > 0:
        pairs = current.groupBy("doc_row", "segment", F.floor(F.col("k") / 2).cast("int").alias("half")).agg(side(0).alias("l"), side(1).alias("r"))
        levels.append(written(pairs, "pairs"))
        current = written(levels[-1].mapInArrow(_combined, "doc_row long, segment int, k int, matrix binary, n_left int, n_right int"), "combined")
    states = current.select("doc_row", "segment", "k", F.lit(0).alias("i"), F.lit(0).alias("j"))
    for pairs in levels[::-1]:
        known = states.withColumnRenamed("k", "half")
        states = written(pairs.join(known, ["doc_row", "segment", "half"]).mapInArrow(_states, "doc_row long, segment int, k int, i int, j int"), "states")
    return states


def _traced(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    p = _pieces(model)
    for batch in batches:
        got = [Chunk(p, r["text"], r["lo"], r["hi"], r["left_open"], r["right_open"]).trace(r["i"], r["j"]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(got, pa.binary())], names=["doc_row", "chunk", "n_chunks", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: str, position: int) -> Iterator[pa.RecordBatch]:
    """Adds ``text``, decoded from ``ids``; column ``position`` says which chunk it is."""
    p = _pieces(model)
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        texts = [p.decode(ids, first=k == 0) for ids, k in zip(batch.column(at).to_pylist(), batch.column(position).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])


def encode_giants(giants: DataFrame, *, model: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_row``, ``chunk``, ``n_chunks``, ``ids`` of the chunks of ``giants`` (``doc_row``, ``text``)."""
    plain = "doc_row long, chunk int, n_chunks int, segment int, k int, left_open boolean, right_open boolean, text string, lo int, hi int"
    parts = giants.mapInArrow(lambda it: _chunk_rows(it, chunk), plain)
    parts = parts.repartition(F.col("doc_row"), F.col("chunk"))  # one document's chunks go to many tasks
    moved = written(parts.mapInArrow(lambda it: _transfers(it, model), plain + ", ids binary, matrix binary, n_left int, n_right int"), "transfers")
    closed = moved.where("ids is not null").select("doc_row", "chunk", "n_chunks", "ids")
    opened = moved.where("ids is null")
    states = boundary_states(opened)
    traced = opened.join(states, ["doc_row", "segment", "k"]).select("doc_row", "chunk", "n_chunks", "text", "lo", "hi", "left_open", "right_open", "i", "j")
    return closed.unionByName(traced.mapInArrow(lambda it: _traced(it, model), "doc_row long, chunk int, n_chunks int, ids binary"))


def encode(docs: DataFrame, *, model: str, giant: int = GIANT, chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every row with ``ids`` (little-endian unsigned 32-bit) and ``decoded``, the text read back from them.

    ``keep`` names no column ``ids`` or ``decoded``. The ids are those of the library for the whole text. A null text counts as empty and has no ids. Texts over ``giant``
    characters are cut into chunks of about ``chunk``. Rows may repeat; other columns are ignored. An empty table gives an empty result.
    """
    keep = keep or ["doc_id"]
    kept = T.StructType([docs.schema[c] for c in keep])
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce("text", F.lit("")).alias("text"))
    out = T.StructType([T.StructField("kept", kept), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model)
        for part in sliced(batches, 1):
            ids = p.encode_many(part.column(1).to_pylist())
            texts = p.lib.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["kept", "ids", "decoded"])

    short = rows.where(F.length("text") <= giant).mapInArrow(tidy(ordinary), out)
    long = written(rows.where(F.length("text") > giant).withColumn("doc_row", F.monotonically_increasing_id()), "giants")
    if long.isEmpty():
        return short.select("kept.*", "ids", "decoded")
    coded = encode_giants(long.select("doc_row", "text"), model=model, chunk=chunk)
    read = coded.mapInArrow(lambda it: _decoded(it, model, 1), "doc_row long, chunk int, n_chunks int, ids binary, text string")
    whole = read.groupBy("doc_row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids", "text"))).alias("c"))
    whole = whole.select("doc_row", F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.array_join(F.transform("c", lambda x: x["text"]), "").alias("decoded"))
    return short.unionByName(long.join(whole, "doc_row").select("kept", "ids", "decoded")).select("kept.*", "ids", "decoded")


def encode_digests(docs: DataFrame, *, model: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32``, and of the decoded text ``n_chars`` and ``text_sha256``."""
    out = encode(docs, model=model)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("text_sha256"))


def tokens(docs: DataFrame, *, model: str) -> DataFrame:
    """Every row of ``docs`` with ``tokens`` (its ids as an array), ``n_tokens`` and ``n_chars`` (length of the decoded text) in place of
    ``text``. Columns of these names, ``ids`` and ``decoded`` in ``docs`` are left out."""
    keep = [c for c in docs.columns if c not in ("text", "ids", "decoded", "tokens", "n_tokens", "n_chars")]
    coded = encode(docs, model=model, keep=keep).select(*keep, "ids", F.length("decoded").cast("long").alias("n_chars"))
    out = T.StructType([*(coded.schema[c] for c in keep), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_chars", T.LongType())])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 2).to_pylist()
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists, batch.column(batch.num_columns - 1)], names=out.names)

    return coded.mapInArrow(arrays, out).withColumn("n_tokens", F.size("tokens"))

"""Language identification with n-gram filters that hold a bitmask of languages per slot.

A bit-sliced Bloom filter keeps a word per slot (several for over 64 languages), one bit per language. The AND of the
slots of an n-gram has the bits of all languages whose filter contains the n-gram, so two
lookups answer every language at once. Per document and language the hits are
counted, corrected for the filter's false positives and compared.

N-grams are runs of four UTF-8 bytes of the lower-cased text, all ASCII characters but
letters taken as spaces. They are exact 32-bit keys before they enter the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, mix64, sliced, text_bytes, tidy

GRAM = 4
FIT_ROWS = 20_000
GRAMS_PER_LANG = 6_000
SLOTS_LOG2 = 17
PROBES = 2
MAX_LANGS = 1024

_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one batch of texts as 32-bit keys, and the row of each. Texts are framed by spaces;
    n-grams with two spaces side by side or across texts are left out."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    framed = pc.binary_join_element_wise(pa.scalar(""), pc.utf8_lower(pc.fill_null(column, "")), pa.scalar(""), " ")
    data, offsets = text_bytes(framed)
    if len(data) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    b = _CLASS[data]
    n = len(b) - GRAM + 1
    keys = b[:n].astype(np.uint32)
    for i in range(1, GRAM):
        keys |= b[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    space = b == 0x20
    double = space[:-1] & space[1:]
    ok = ~double[:n]
    for i in range(1, GRAM - 1):
        ok &= ~double[i : n + i]
    for i in range(1, GRAM):  # those that reach over the end of a text
        starts = offsets[1:-1] - i
        ok[starts[(starts >= 0) & (starts < n)]] = False
    at = np.flatnonzero(ok)
    return keys[at], np.searchsorted(offsets, at, "right") - 1


@dataclass(frozen=True)
class LangFilter:
    """``table``: words of language bits for each slot (slots by words). ``false_positive``: per language."""

    langs: tuple[str, ...]
    table: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix64(keys.astype(np.uint64) + GOLDEN)
        return [((h >> np.uint64(bits * i)) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def build(cls, members: dict[str, list[int]], bits: int = SLOTS_LOG2) -> LangFilter:
        langs = tuple(sorted(members))
        if len(langs) > MAX_LANGS:
            raise ValueError(f"over {MAX_LANGS} languages")
        width = next((w for w in (8, 16, 32) if len(langs) <= w), 64)
        table = np.zeros((1 << bits, max(1, -(-len(langs) // width))), f"u{width // 8}")
        for i, lang in enumerate(langs):
            for slot in cls.slots(np.array(members[lang], np.uint32), bits):
                table[slot, i // width] |= table.dtype.type(1 << i % width)
        fill = np.array([cls.bit(table, i).mean() for i in range(len(langs))])
        return cls(langs, table, fill**PROBES)

    @staticmethod
    def bit(words: np.ndarray, i: int) -> np.ndarray:
        """Whether each row of words has the bit of language ``i``."""
        width = words.dtype.itemsize * 8
        return (words[:, i // width] >> words.dtype.type(i % width)) & words.dtype.type(1)

    def scores(self, column) -> np.ndarray:
        """Corrected share of each text's n-grams that each language has: rows by languages, 0 to 1."""
        keys, rows = grams(column)
        bits = int(np.log2(len(self.table)))
        first, *more = self.slots(keys, bits)
        mask = self.table[first]
        for slot in more:
            mask &= self.table[slot]
        n = len(column)
        total = np.bincount(rows, minlength=n)
        out = np.zeros((n, len(self.langs)))
        for i in range(len(self.langs)):
            hits = np.bincount(rows[self.bit(mask, i).astype(bool)], minlength=n)
            f = self.false_positive[i]
            out[:, i] = np.clip((hits - total * f) / np.maximum(total, 1) / max(1 - f, 1e-9), 0, 1)
        return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: in how many texts each n-gram occurs, and the texts."""
    for batch in sliced(batches, 1):
        langs = batch.column(0).to_pylist()
        keys, rows = grams(batch.column(1))
        both = np.unique(rows.astype(np.uint64) << np.uint64(32) | keys.astype(np.uint64))
        row_lang = np.array([hash_id for hash_id in _codes(langs)], np.uint64)
        names = sorted(set(langs))
        coded = row_lang[(both >> np.uint64(32)).astype(np.int64)] << np.uint64(32) | (both & np.uint64(0xFFFFFFFF))
        found, counts = np.unique(coded, return_counts=True)
        lang = pa.DictionaryArray.from_arrays(pa.array((found >> np.uint64(32)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
        yield pa.RecordBatch.from_arrays([lang, pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
        sizes = [(x, langs.count(x)) for x in names]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sizes], pa.string()), pa.array([-1] * len(sizes), pa.int64()), pa.array([k for _, k in sizes], pa.int64())], names=["lang", "gram", "n"])


def _codes(langs: list[str]) -> list[int]:
    names = {x: i for i, x in enumerate(sorted(set(langs)))}
    return [names[x] for x in langs]


def fit(train: DataFrame, *, fit_rows: int = FIT_ROWS, grams_per_lang: int = GRAMS_PER_LANG, slots_log2: int = SLOTS_LOG2) -> LangFilter:
    """Learn a filter from ``text`` and ``lang``; rows with a null in either take no part.

    At most about ``fit_rows`` rows are used, and whole texts of those. When there are more, each language has an equal share of
    ``fit_rows``: an even hash sample over its rows, or all of them if they are fewer. A language's filter has its ``grams_per_lang`` most widespread n-grams that are at
    least half as frequent in it as in any other language.
    """
    rows = train.where("lang is not null and text is not null").select("lang", "text", "_pick")
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(per_lang) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if sum(per_lang.values()) > fit_rows:
        share = fit_rows / len(per_lang)
        below = F.create_map(*(F.lit(x) for lang, n in per_lang.items() for x in (lang, min(1.0, share / n))))
        rows = rows.where(F.col("_pick") < F.element_at(below, F.col("lang")))
    counts = rows.select("lang", "text").mapInArrow(tidy(_count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = counts.where("gram >= 0").join(F.broadcast(counts.where("gram = -1").select("lang", F.col("n").alias("texts"))), "lang").withColumn("p", F.col("n") / F.col("texts"))
    best = shares.groupBy("gram").agg(F.max("p").alias("p_max"))
    top = Window.partitionBy("lang").orderBy(F.desc("p"), "gram")
    chosen = shares.join(best, "gram").where("n >= 2 and p >= 0.5 * p_max").withColumn("_rank", F.row_number().over(top)).where(F.col("_rank") <= grams_per_lang)
    members: dict[str, list[int]] = {r["lang"]: [] for r in counts.where("gram = -1").select("lang").collect()}
    for r in chosen.select("lang", "gram").collect():  # grams_per_lang rows for each language at most
        members[r["lang"]].append(r["gram"])
    return LangFilter.build(members, slots_log2)


def predict(docs: DataFrame, model: LangFilter, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``, the share of known n-grams.

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Equal scores go to
    the first language by name.
    """
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, len(keep)):
            text, letters = part.column(len(keep)), part.column(len(keep) + 1).to_numpy(zero_copy_only=False)
            names = np.array([*model.langs, "und"], object)
            if model.langs:
                s = model.scores(text)
                best = np.where(letters, s.argmax(1), len(model.langs))
                score = np.where(letters, s.max(1), 0.0)
            else:
                best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    return rows.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))


def fold(id_col: str = "doc_id"):
    """Remainder by three of the id's CRC; fold 1 is held out of learning."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those out of fold 1. ``_pick`` (0 to 1, from the id) only draws the bounded sample."""
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    return docs.where(F.coalesce(fold() != 1, F.lit(False))).select("text", "lang", pick.alias("_pick"))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row of ``docs``, learned from its other folds."""
    model = fit(training_rows(docs))
    flagged = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return predict(flagged, model, keep=["doc_id", "held_out"])


def drop_unidentified(docs: DataFrame, *, min_score: float = 0.05) -> DataFrame:
    """Rows of ``docs`` in a language that the filter knows: ``lang_pred`` is not ``und`` and at least
    ``min_score`` of the n-grams are known. All columns unchanged.

    Without a labelled row to learn from (``lang`` and ``text`` not null, out of fold 1) no text can be told from another: all rows with a letter stay.
    """
    model = fit(training_rows(docs))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, at):
            text = part.column(at)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            yield part.filter(pa.array(letters & (model.scores(text).max(1) >= min_score)))

    return docs.mapInArrow(tidy(run), docs.schema)

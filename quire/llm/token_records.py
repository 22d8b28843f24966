"""Token ids as length-delimited binary records with masked checksums and an offset index.

A shard file is ``HEADER`` and then, for each sequence, its byte length (u64), the masked
CRC of those eight bytes, the payload and the masked CRC of the payload. A payload is a
flag (1: the id is not null), the document id (i64) and the token ids. The index beside
it has one row per record: id flag, id, offset, length in tokens. Readers
may take records of a shard in any order through the index.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_dir, null_text_as_empty, open_fs, shuffle_partitions

MAGIC = b"QREC1"
INDEX = np.dtype([("has_id", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u4")])
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<Bq")
CACHE_WORDS = 600_000
READ_BYTES = 8 << 20
SEGMENT = 1 << 23
INDEX_ROWS = 1 << 16


class ChecksumError(ValueError):
    """A record's length or payload does not match its checksum."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """Payload of the record at ``at`` and the offset after it. Raises ``ChecksumError``."""
    n, crc = FRAME.unpack_from(data, at)
    if masked_crc(bytes(data[at : at + 8])) != crc:
        raise ChecksumError(f"length at {at}")
    at += FRAME.size
    payload = bytes(data[at : at + n])
    if len(payload) < n or masked_crc(payload) != struct.unpack_from("<I", data, at + n)[0]:
        raise ChecksumError(f"payload at {at}")
    return payload, at + n + 4


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at spaces, which are left out."""
    at = 0
    while 0 <= (cut := text.find(" ", at + size)):
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Recent:
    """A cache of bounded size: two halves, of which the older goes when the newer is full. What is used often is always in the newer one."""

    def __init__(self, size: int):
        self.half, self.new, self.old = max(1, size // 2), {}, {}

    def turn(self) -> None:
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}

    def get(self, key: str) -> bytes | None:
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.new[key] = got
        return got


class WordEncoder:
    """Encodes texts with a tokenizer file, each distinct space-delimited word once.

    Only for tokenizers whose pre-tokenizer never joins text across a space or line feed. Words go to the library as they are, so its special
    tokens are found as in whole texts. Where the file's steps are composition, lower case, a split pattern and bytes, a
    plain word (printable, no letter beyond Latin, nothing to compose) is split by that pattern here, and the library's model encodes each distinct part once.
    ``cache_words`` bounds each of the two caches; words that are rare leave them, which costs time only. Texts are
    taken in segments, so no list holds all words of a long one.
    """

    PLAIN_STEPS = {"NFC", "Replace", "Lowercase"}
    LAST_PLAIN = "\u024f"

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache, self.parts = Recent(cache_words), Recent(cache_words)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.pattern = self._split_pattern(spec)
        self.bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False)

    def _split_pattern(self, spec: dict) -> regex.Pattern | None:
        """The pattern whose matches are the parts that the model encodes, if the file's steps are as described."""
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if {x["type"] for x in steps} != self.PLAIN_STEPS or any(x.get("pattern") != {"Regex": "\\s+"} for x in steps if x["type"] == "Replace"):
            return None
        if [x["type"] for x in before] != ["Split", "ByteLevel"] or before[1]["add_prefix_space"] or before[1]["use_regex"]:
            return None
        split = before[0]
        if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"] or spec["model"].get("continuing_subword_prefix"):
            return None
        return regex.compile(split["pattern"]["Regex"])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        parts = [(i, part) for i, text in enumerate(texts) for part in segments(text)]
        out: list[list[bytes]] = [[] for _ in texts]
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= SEGMENT):
                size, end = size + len(parts[end][1]), end + 1
            for (i, _), ids in zip(parts[at:end], self._together([x for _, x in parts[at:end]]), strict=True):
                out[i].append(ids)
            at = end
        return [b"".join(x) for x in out]

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of a bounded size in all. Only their distinct words leave Arrow."""
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        ids = pa.array(self._words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        _, ends, data = ids.buffers()
        cut = np.frombuffer(ends, np.int64, len(ids) + 1, ids.offset * 8)[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[i:j]) for i, j in zip(cut, cut[1:], strict=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        self.cache.turn()
        self.parts.turn()
        known, odd = self.cache.new, []
        for word in words:
            if word not in known:
                ids = self.cache.old.get(word)
                if ids is None:
                    ids = self._plain(word)
                if ids is None:
                    odd.append(word)
                else:
                    known[word] = ids
        for i in range(0, len(odd), 1024):
            part = odd[i : i + 1024]
            for word, enc in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = np.array(enc.ids, self.dtype).tobytes()
        return list(map(known.__getitem__, words))

    def _plain(self, word: str) -> bytes | None:
        """Ids of a plain word, None for others."""
        if self.pattern is None or not word.isprintable():
            return None
        low = word.lower()
        if not low.isascii() and max(low) > self.LAST_PLAIN:
            return None
        if low.isalpha():
            return self._part(low)
        if any(t in word for t in self.added):
            return None
        return b"".join(map(self._part, self.pattern.findall(low)))

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            text = part if part.isascii() else self.bytes_as_text.pre_tokenize_str(part)[0][0]
            got = self.parts.new[part] = struct.pack(f"<{len(tokens := self.tokenizer.model.tokenize(text))}{self.code}", *(t.id for t in tokens))
        return got


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _encoded(batch: pa.RecordBatch, encoder: WordEncoder) -> Iterator[tuple[int | None, bytes]]:
    """Ids of each row, of rows of a bounded size in all at a time."""
    sizes, at = pc.binary_length(batch.column(1)).to_pylist(), 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= SEGMENT):
            size, end = size + sizes[end], end + 1
        yield from zip(batch.column(0)[at:end].to_pylist(), encoder.encode(batch.column(1)[at:end].to_pylist()), strict=True)
        at = end


def _write_shard(batches: Iterator[pa.RecordBatch], out: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
    fs, root = open_fs(out)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"  # a retried task writes another file; the manifest names the one that counts
    end = np.array([end_id], encoder.dtype).tobytes()
    n_records, n_tokens, at = 0, 0, 0
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as sink, fs.open_output_stream(f"{root}/{name}.idx") as index_sink:
        sink.write(MAGIC + bytes([encoder.dtype.itemsize]))
        at = len(MAGIC) + 1
        for batch in batches:
            index = []
            for doc_id, data in _encoded(batch, encoder):
                record = frame(HEAD.pack(doc_id is not None, doc_id or 0) + data + end)
                n = len(data) // encoder.dtype.itemsize + 1
                index.append((doc_id is not None, doc_id or 0, at, n))
                at, n_tokens = at + len(record), n_tokens + n
                sink.write(record)
            index_sink.write(np.array(index, INDEX).tobytes())
            n_records += len(index)
    yield pa.RecordBatch.from_pylist([{"shard": part, "name": name, "n_records": n_records, "n_tokens": n_tokens, "n_bytes": at}])


def write_token_records(docs: DataFrame, out: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Encode whole texts and write them as record shards in ascending id order; returns ``out``.

    Null texts count as empty and give the end id alone; null ids come first; rows that repeat an id stay
    separate records. Every shard is written by one task under a name of that attempt;
    ``manifest`` (Parquet) lists the shards of the attempts that counted.
    """
    rows = null_text_as_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    ranged = rows.repartitionByRange(shards or shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    made = ranged.mapInArrow(lambda it: _write_shard(it, out, tokenizer, end_id), "shard long, name string, n_records long, n_tokens long, n_bytes long")
    made.write.parquet(f"{out}/manifest")
    return out


def _read_index(fs, root: str, name: str, first: int = 0, n: int = INDEX_ROWS) -> np.ndarray:
    """At most ``n`` rows of a shard's index from row ``first`` on."""
    with fs.open_input_file(f"{root}/{name}.idx") as f:
        f.seek(first * INDEX.itemsize)
        return np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


def _read_shards(batches: Iterator[pa.RecordBatch], out: str) -> Iterator[pa.RecordBatch]:
    fs, root = open_fs(out)
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary())])
    for batch in batches:
        for shard in batch.to_pylist():
            at = shard["start"]
            with fs.open_input_file(f"{root}/{shard['name']}.rec") as f:
                head = f.read(len(MAGIC) + 1)
                if head[: len(MAGIC)] != MAGIC:
                    raise ChecksumError(f"{shard['name']} is no record shard")
                dtype = np.dtype(f"<u{head[-1]}")
                for row in range(0, shard["n_records"], INDEX_ROWS):
                    index = _read_index(fs, root, shard["name"], row, INDEX_ROWS + 1)
                    end = shard["n_bytes"] if len(index) <= INDEX_ROWS else int(index["offset"][-1])
                    index = index[:INDEX_ROWS]
                    ends = np.append(index["offset"][1:].astype(np.int64), end)
                    i = 0
                    while i < len(index):
                        first = int(index["offset"][i])
                        j = max(i + 1, int(np.searchsorted(ends, first + READ_BYTES, "right")))
                        f.seek(first)
                        data, pos, rows = f.read(int(ends[j - 1]) - first), 0, []
                        for _ in range(i, j):
                            payload, pos = unframe(data, pos)
                            has_id, doc_id = HEAD.unpack_from(payload)
                            tokens = np.frombuffer(payload, dtype, offset=HEAD.size).astype("<u4")
                            rows.append({"doc_id": doc_id if has_id else None, "start": at, "n_tokens": len(tokens), "tokens": tokens.tobytes()})
                            at += len(tokens)
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        i = j


def read_token_records(spark: SparkSession, out: str) -> DataFrame:
    """Records of all shards, checksums verified: ``doc_id``, ``start`` (ids of all records before
    it), ``n_tokens`` and ``tokens`` (little-endian unsigned 32-bit integers)."""
    manifest = spark.read.schema("shard long, name string, n_records long, n_tokens long, n_bytes long").parquet(f"{out}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard only
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return starts.repartition(shuffle_partitions(spark), "shard").mapInArrow(lambda it: _read_shards(it, out), "doc_id long, start long, n_tokens long, tokens binary")


def read_at(out: str, name: str, i: int) -> tuple[int | None, np.ndarray]:
    """Record ``i`` of one shard through its index alone: what a shuffled reader does."""
    fs, root = open_fs(out)
    row = _read_index(fs, root, name, i, 1)[0]
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        width = f.read(len(MAGIC) + 1)[-1]
        f.seek(int(row["offset"]))
        payload, _ = unframe(f.read(FRAME.size + HEAD.size + int(row["n_tokens"]) * width + 4))
    has_id, doc_id = HEAD.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=HEAD.size)


def token_record_digests(docs: DataFrame, *, tokenizer: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write the records of ``docs``, read them back and return one digest row per document."""
    spark = docs.sparkSession
    out = write_token_records(docs, out or new_dir(spark, "tokens"), tokenizer=tokenizer, end_id=end_id)
    return read_token_records(spark, out).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))

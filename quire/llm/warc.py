"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every record is its own gzip member, so a member that fails its checks costs that member alone. The reader then looks for
the next member (or, in plain files and inside members, the next version line), goes on there and
reports the bytes in between as a quarantined gap. A member with many records, as other writers make them, is read up to its damage. Whatever the size of a
file, a member, a gap or a record, the reader holds one record of ``WHOLE_BYTES`` or one member of ``HELD_BYTES`` at most; longer records are
read in pieces, and their size and digest are given without their payload. Records of other versions than 0.17, 0.18, 1.0 and 1.1 are gaps.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, open_fs, shuffle_partitions, written

REVISIT_BYTES = 1000
ROLL_BYTES = 256 << 20
WINDOW = 1 << 20
HELD_BYTES = 16 << 20
WHOLE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
MANIFEST = "file string, n_records long, n_bytes long"
READ = "file string, offset long, length long, kind string, record_type string, record_id string, uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class Damaged(ValueError):
    """A gzip member or record that fails a check."""


# writing


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None) -> str:
    return f"<urn:quire:page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, *, date: str) -> bytes:
    """One record, uncompressed. A revisit has the digest and size of the payload, but no payload."""
    revisit = refers_to is not None
    block = HTTP_HEAD % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.insert(4, f"WARC-Target-URI: {_clean(uri)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, wbits=31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], out: str, date: str) -> Iterator[pa.RecordBatch]:
    fs, root = open_fs(out)
    fs.create_dir(root, recursive=True)
    sink, file, n, size = None, "", 0, 0
    done = []
    for batch in batches:
        for page_id, uri, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sink is None or size > ROLL_BYTES:
                if sink is not None:
                    sink.close()
                    done.append((file, n, size))
                file, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                sink = fs.open_output_stream(f"{root}/{file}", compression=None)
            member = gzip_member(make_record(page_id, uri, (html or "").encode(), digest, refers_to, date=date))
            sink.write(member)
            n, size = n + 1, size + len(member)
    if sink is not None:
        sink.close()
        done.append((file, n, size))
    yield pa.RecordBatch.from_pylist([{"file": f, "n_records": n, "n_bytes": s} for f, n, s in done], pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))


def write_warc(pages: DataFrame, out: str, *, date: str = "2000-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> str:
    """One record for each row of ``pages`` (``page_id``, ``url``, ``html``); returns ``out``.

    Of rows with equal payloads of at least ``revisit_bytes`` the one with the largest id is the response
    and the others revisit it. A null html is an empty payload, a null url is left out. Rows that repeat an id and a
    payload are alike; null ids are smaller than any other. Other columns are ignored. ``manifest`` (Parquet) lists the files of
    the task attempts that counted.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.sha2(F.encode(html, "UTF-8"), 256).alias("same"), F.octet_length(html).alias("size"))
    light = rows.where(F.col("size") >= revisit_bytes).select("page_id", "same")
    groups = light.groupBy("same").agg(F.max("page_id").alias("first"), F.min(F.coalesce("page_id", F.lit(-(1 << 63)))).alias("_least"))
    groups = written(groups.where("first > _least").drop("_least"), "payloads")  # a join with the aggregation's own shuffle could not split a hot payload
    later = light.join(groups, "same").where("not (page_id <=> first)").select(F.col("page_id").alias("_id"), F.col("same").alias("_same"), "first").distinct()
    made = rows.join(later, rows["page_id"].eqNullSafe(later["_id"]) & (rows["same"] == later["_same"]), "left").select("page_id", "url", "html", "digest", "first")
    made.mapInArrow(lambda it: _write(it, out, date), MANIFEST).write.parquet(f"{out}/manifest")
    return out


# reading


def _find(read_at: Callable[[int, int], bytes], pos: int, size: int, mark: bytes) -> int:
    """Where ``mark`` next begins at or after ``pos``, else the end, ``size``."""
    while pos < size:
        at = read_at(pos, WINDOW + len(mark)).find(mark)
        if at >= 0:
            return pos + at
        pos += WINDOW
    return size


class Inflated:
    """Forward reader of the unpacked bytes of the member at ``pos``; ``failed`` once a check fails or the file ends inside the member."""

    def __init__(self, read_at: Callable[[int, int], bytes], pos: int):
        self.read_at, self.pos, self.at = read_at, pos, pos
        self.z, self.start, self.buffer = zlib.decompressobj(31), 0, bytearray()
        self.failed = False

    @property
    def done(self) -> bool:
        return self.failed or self.z.eof

    @property
    def used(self) -> int:
        return self.at - self.pos - len(self.z.unused_data)

    def _more(self) -> None:
        data = self.read_at(self.at, 1 << 16)
        if not data:
            self.failed = True
            return
        before = self.z.copy()
        try:
            self.buffer += self.z.decompress(data)
            self.at += len(data)
        except zlib.error:
            self.failed, self.z = True, before
            for i in range(len(data)):  # what comes before the damage
                try:
                    self.buffer += self.z.decompress(data[i : i + 1])
                except zlib.error:
                    break

    def read(self, pos: int, n: int) -> bytes:
        """``n`` bytes at ``pos``. What lies before is given up; the rare read that goes back to it unpacks the member again."""
        if pos < self.start:
            self.__init__(self.read_at, self.pos)
        while not self.done and self.start + len(self.buffer) < pos + n:
            self._forget(pos)
            self._more()
        self._forget(pos)
        return bytes(self.buffer[max(0, pos - self.start) : max(0, pos - self.start) + n])

    def _forget(self, pos: int) -> None:
        if pos - self.start > WINDOW:
            old = min(pos - self.start, len(self.buffer))
            del self.buffer[:old]
            self.start += old

    def to_end(self, most: int) -> bool:
        """Unpacks the rest; whether all of it, ``most`` bytes at most, is held."""
        whole = self.start == 0
        while not self.done:
            self._more()
            if len(self.buffer) > most:
                self.start, whole = self.start + len(self.buffer), False
                self.buffer.clear()
        return whole


class Long(NamedTuple):
    """What is known of a block that is too long to be held: of its payload the size and SHA-1."""

    payload_bytes: int
    payload_sha1: str


def _long_block(read_at: Callable[[int, int], bytes], pos: int, length: int) -> tuple[Long, str]:
    """The block at ``pos`` in pieces, and its own SHA-1; raises ``Damaged`` if it is cut off."""
    whole, payload, size, tail = hashlib.sha1(), None, 0, b""
    for at in range(0, length, WINDOW):
        data = read_at(pos + at, min(WINDOW, length - at))
        if len(data) < min(WINDOW, length - at):
            raise Damaged("record ends early")
        whole.update(data)
        if payload is None:
            head, mark, rest = (tail + data).partition(b"\r\n\r\n")
            tail = head[-3:]
            if not mark:
                continue
            payload, data = hashlib.sha1(), rest
        payload.update(data)
        size += len(data)
    return Long(size, (payload or hashlib.sha1()).hexdigest()), whole.hexdigest()


def one_record(read_at: Callable[[int, int], bytes], pos: int, size: int) -> tuple[dict[str, str], bytes | Long, int]:
    """Headers, block and length of the record at ``pos`` of ``size`` bytes; raises ``Damaged``."""
    head, n = b"", 1 << 12
    while (end := head.find(b"\r\n\r\n")) < 0:
        head = read_at(pos, n)
        if not VERSION.match(head[:11]) or (len(head) < n and b"\r\n\r\n" not in head) or n > WINDOW << 4:
            raise Damaged("no header")
        n *= 4
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a name")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    length, start = int(fields["content-length"]), pos + end + 4
    if start + length + 4 > size:
        raise Damaged("record ends early")
    if length > WHOLE_BYTES:
        block, digest = _long_block(read_at, start, length)
        mark = read_at(start + length, 4)
    else:
        block = read_at(start, length + 4)
        block, mark, digest = block[:length], block[length:], None
    if mark != b"\r\n\r\n":
        raise Damaged("no end mark")
    wanted = hex_digest(fields.get("warc-block-digest"))
    if wanted and (digest or hashlib.sha1(block).hexdigest()) != wanted:
        raise Damaged("digest")
    return fields, block, end + 4 + length + 4


def hex_digest(value: str | None) -> str | None:
    """Lower-case hex of a SHA-1 header value, which may be in hex or base 32; None for any other."""
    kind, _, digest = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", digest):
        return digest.lower()
    try:
        return base64.b32decode(digest.upper()).hex() if len(digest) == 32 else None
    except binascii.Error:
        return None


Item = tuple[int, int, dict[str, str] | None, bytes | Long]


def _records(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Item]:
    """Records one after the other; where one fails, the bytes up to the next version line with a whole record are a gap."""
    pos, bad = 0, None
    while pos < size:
        try:
            fields, block, used = one_record(read_at, pos, size)
        except Damaged:
            bad = pos if bad is None else bad
            pos = _find(read_at, pos + 1, size, b"WARC/1.")
            continue
        if bad is not None:
            yield bad, pos - bad, None, b""
            bad = None
        yield pos, used, fields, block
        pos += used
    if bad is not None:
        yield bad, pos - bad, None, b""


def _member(read_at: Callable[[int, int], bytes], pos: int) -> tuple[int, bool, Iterator[Item]]:
    """Length of the member at ``pos``, whether it fails a check, and its records and gaps."""
    first = Inflated(read_at, pos)
    if first.to_end(HELD_BYTES):
        data = bytes(first.buffer)
        return first.used, first.failed, _records(lambda p, n: data[p : p + n], len(data))
    return first.used, first.failed, _records(Inflated(read_at, pos).read, first.start + len(first.buffer))


def salvage(read_at: Callable[[int, int], bytes], size: int) -> Iterator[Item]:
    """``offset``, ``length``, headers and block of all records of one archive; no headers: a quarantined gap.

    Offsets and lengths are those of the file. In a gzip file they are those of the member, also where damage is inside a member that could be
    unpacked. Of a member that fails a check the records before the damage are taken as well, but not one that nothing follows, and the
    bytes up to the next sound member are a gap.
    """
    if read_at(0, 2) != MEMBER[:2] and _find(read_at, 0, size, b"WARC/1.") <= _find(read_at, 0, size, MEMBER):
        yield from _records(read_at, size)
        return

    pos, bad = 0, None
    while pos < size:
        used, failed, items = _member(read_at, pos) if read_at(pos, len(MEMBER)) == MEMBER else (0, True, iter(()))
        if failed:
            bad = pos if bad is None else bad
            end = _find(read_at, pos + 1, size, MEMBER)
            held = None  # a record is taken once something follows it: the member's own check covers the last one
            for item in items:
                if held is not None and held[2] is not None:
                    yield pos, end - pos, *held[2:]
                held = item
            pos = end
            continue
        if bad is not None:
            yield bad, pos - bad, None, b""
            bad = None
        for item in items:
            yield pos, used, *item[2:]
        pos += used
    if bad is not None:
        yield bad, size - bad, None, b""


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _read(batches: Iterator[pa.RecordBatch], out: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    fs, root = open_fs(out)
    kinds = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for file in batch.column(0).to_pylist():
            with fs.open_input_file(f"{root}/{file}") as f:

                def read_at(pos: int, n: int, f=f) -> bytes:
                    f.seek(pos)
                    return f.read(n)

                rows, held = [], 0
                for offset, length, fields, block in salvage(read_at, f.size()):
                    row = {"file": file, "offset": offset, "length": length, "kind": "gap" if fields is None else "record"}
                    if fields is not None:
                        row |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
                        if row["record_type"] == "revisit":
                            size = fields.get("x-payload-bytes", "")  # of this writer; other archives do not say
                            row |= {"payload_bytes": int(size) if re.fullmatch(r"\d{1,18}", size) else None, "payload_digest": hex_digest(fields.get("warc-payload-digest"))}
                        elif isinstance(block, Long):
                            row |= {"payload_bytes": block.payload_bytes, "payload_digest": block.payload_sha1}
                        else:
                            payload = http_payload(block)
                            row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload if with_payload else None}
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if held > 8 << 20 or len(rows) >= 1024:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)


def read_warc(spark: SparkSession, out: str, *, files: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``kind``) of the archives in folder ``out``: those of its manifest, or ``files`` (a column ``file``)."""
    names = files if files is not None else spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return names.select("file").repartition(shuffle_partitions(spark), "file").mapInArrow(lambda it: _read(it, out, with_payload), READ)


def page_records(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and returns one row per record."""
    spark = pages.sparkSession
    out = write_warc(pages, out or new_dir(spark, "warc"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, ':page:(-?[0-9]*)>', 1), '') as bigint)")
    return read_warc(spark, out, with_payload=False).where("kind = 'record'").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))

"""Each dealt operator against a brute-force version, and the defined results of its edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import block_naming, chat, langid, line_dedup, mixing, near_dup, permutation_index, piece_scan, queries, token_records, warc

from ..compare import same_as_sql
from ..conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = DOCS + ", _row long, node string, part int, _slot string, _id int, ids string, name string, _dropped string, kept string"
WORDS = queries.tokenizer_path("word_bpe_49k.json")
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing column names."""
    long = "alpha beta gamma delta epsilon " * 3000
    texts = [(1, "a b c d e f g"), (2, "a  b c d e f g"), (3, None), (4, ""), (5, long), (6, long), (6, long), (None, "no id here at all"), (7, "a b c d e f g"), (7, "other text of the same id"), (8, " \n\t "), (9, "中文 ünï\n\n#"), (None, None)]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 2}", None, k, "n", k, "s", k, "i", "x", "d", "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    same_as_sql(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name])


# 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_nearest(rows, k=20):
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q in (i for i in ok if i % 20 == 0):
        best = sorted(((-float(ok[q] @ ok[i]), i) for i in ok if i != q))[:k]
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    return out


def test_permutation_index_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist(), None) for i in range(60)] + [(i, [1.0] * 8, 1) for i in range(60, 100)]
    rows += [(100, None, 1), (120, [0.0] * 8, 1), (140, [float("nan")] * 8, 1), (160, [None] * 8, 1), (180, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 1), rows[3]]
    df = vectors(spark, rows)
    got = permutation_index.nearest(df, df.where("vec_id % 20 = 0")).collect()
    want = brute_nearest(dict.fromkeys(map(repr, rows)) and [r for k, r in {repr(r): r for r in rows}.items()])
    score = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, n) for q, n, _ in want}
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows[:100]}
    assert all(abs(score[q, n] - by_id[q] @ by_id[i]) < 1e-9 for q, n, i in want)


def test_permutation_index_few_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1)])
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in permutation_index.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    none = vectors(spark, [])
    assert permutation_index.nearest(none, none).count() == 0


def test_permutation_index_recall(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in df.collect()]
    want = {(q, i) for q, _, i in brute_nearest(rows)}
    got = {(r["query_id"], r["vec_id"]) for r in permutation_index.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(6)
    pivots, prefix = 30, 9
    orders = np.array([rng.permutation(pivots)[:prefix] for _ in range(40)]).astype("<u2")
    files = permutation_index.InvertedFiles.of(orders, pivots)
    rank = lambda o: {p: r for r, p in enumerate(o)}
    for q in orders[:10]:
        want = [sum(abs(rank(q).get(p, prefix) - rank(o).get(p, prefix)) for p in range(pivots)) for o in orders]
        assert files.footrule(q).tolist() == want


def test_recall_does_not_fall_on_larger_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(2400, 64)).astype(np.float32))]
    df = vectors(spark, rows)
    want = {(q, i) for q, _, i in brute_nearest(rows)}
    got = {(r["query_id"], r["vec_id"]) for r in permutation_index.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_scores_are_those_of_double_vectors(spark):
    df = spark.createDataFrame([(0, [1e39, 0.1]), (20, [0.1, 1 / 3]), (1, [1e-3, 0.7])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in permutation_index.nearest(df, df.where("vec_id % 20 = 0")).collect()}
    assert got[20, 1] == 0.1 * 1e-3 + (1 / 3) * 0.7 and got[0, 20] == 1e39 * 0.1 + 0.1 * (1 / 3)


# 2


def test_token_records_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = odd_rows(spark)
    t = Tokenizer.from_file(WORDS)
    out = token_records.write_token_records(docs, f"file://{tmp_path}/r", tokenizer=WORDS, end_id=1)
    got = token_records.read_token_records(spark, out).orderBy("start").collect()
    want = sorted(((r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0], str(x[1])))
    have = sorted(((r["doc_id"], np.frombuffer(r["tokens"], "<u4").tolist()) for r in got), key=lambda x: (x[0] is not None, x[0], str(x[1])))
    assert have == want
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    shard = spark.read.parquet(f"{out}/manifest").where("n_records > 1").first()
    _, ids = token_records.read_at(out, shard["name"], 1)
    assert ids[-1] == 1


def test_token_records_empty_and_special(spark):
    assert token_records.token_record_digests(empty(spark), tokenizer=WORDS).count() == 0
    e = token_records.WordEncoder(WORDS)
    for s in ("don't İstanbul Σίσυφος ς", "<|endoftext|>x <|startoftext|> y", "a b\x1fc d", "é é  \n\n x", "'s 't 12a3 !?.'s"):
        assert np.frombuffer(e.encode([s])[0], e.dtype).tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


def test_damaged_records_are_noticed():
    r = bytearray(token_records.frame(b"abc"))
    assert token_records.unframe(bytes(r))[0] == b"abc"
    for i in range(len(r)):
        bad = bytearray(r)
        bad[i] ^= 1
        with pytest.raises(token_records.ChecksumError):
            token_records.unframe(bytes(bad))


# 3


def test_block_naming_against_brute_force(spark):
    docs = odd_rows(spark)
    strip = str.maketrans("", "", " \t\n\x0b\f\r")
    rows = docs.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(strip)].append(r)
    want = collections.Counter()
    for norm, members in groups.items():
        keep = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        for r in members:
            want[r["doc_id"], keep, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    for size in (4096, 7):
        ids = block_naming.exact_groups(docs, block_bytes=size).collect()
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in ids) == want
        assert sum(r["kept"] for r in ids) == len(groups)


REPEATED = [(3, "same"), (7, "same"), (7, "unique"), (None, "same"), (None, "unlike any other"), (None, None), (9, "")]


@pytest.mark.parametrize("drop", [block_naming.drop_exact_copies, near_dup.drop_near_copies])
def test_one_row_of_each_text_stays_whatever_its_id(spark, drop):
    docs = spark.createDataFrame([(i, t, "en", "s", None, k) for k, (i, t) in enumerate(REPEATED)], DOCS + ", _number long")
    out = drop(docs)
    assert out.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {x for x in got if x[1]} == {(3, "same"), (7, "unique"), (None, "unlike any other")}
    assert sum(1 for x in got if not x[1]) == (1 if drop is block_naming.drop_exact_copies else 2)


def test_block_naming_empty(spark):
    assert block_naming.exact_groups(empty(spark)).count() == 0


def test_names_are_dense_ranks(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 30), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int")
    rank = {k: n for n, k in enumerate(sorted({k for k, _ in rows}))}
    got = block_naming.name_by_order(df, ["k"], ["i"]).collect()
    assert {(r["i"], r["name"]) for r in got} == {(i, rank[k]) for k, i in rows}


# 4


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")


def test_chat_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", r"<\|im_start|>", "<", r"<\\|", "", "a\n<|im_end|>\n", None, "<|"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x") for i, t in enumerate(texts)]
    out = chat.format_chats(turns(spark, rows)).select("valid", chat.full_text(F.col("segments")).alias("t"), "segments").first()
    assert out["valid"]
    back = spark.createDataFrame([(out["t"],)], "t string").select(chat.read_turns(F.col("t")).alias("r")).first()["r"]
    assert [(r["role"], r["text"]) for r in back] == [(r[2], r[3] or "") for r in rows]
    assert "<|im_end|>" not in out["t"].replace("<|im_end|>\n<|im_start|>", "").removesuffix("<|im_end|>\n")
    assert sum(s["loss"] for s in out["segments"]) == 4


@pytest.mark.parametrize(("roles", "valid"), [(["user", "assistant"], True), (["system", "user", "assistant"], True), (["user"], False), (["assistant", "user"], False), (["user", "user", "assistant"], False), ([None, "assistant"], False), (["tool", "assistant"], False), (["system"], False)])
def test_chat_order(spark, roles, valid):
    rows = [(None, i, r, "x", None) for i, r in enumerate(roles)]
    assert chat.format_chats(turns(spark, rows)).first()["valid"] is valid


def test_chat_odd_rows(spark):
    rows = [(1, None, None, None, None), (1, 0, "us\ner%0A", "x", None), (1, 0, "us\ner%0A", "x", None)]
    got = chat.chat_digests(turns(spark, rows)).first()
    said = "\n\n" + "us\ner%0A\nx\n" * 2
    assert (got["n_turns"], got["turns_sha256"]) == (3, hashlib.sha256(said.encode()).hexdigest())
    assert chat.chat_digests(turns(spark, [])).count() == 0


# 5


def test_warc_against_brute_force(spark):
    big = "x" * 2000
    rows = [(1, "http://a/ b\r\nX: y", big, 0), (5, None, big, 0), (3, "u", big, 0), (4, "u", "small", 0), (6, "u", "small", 0), (7, "u", None, 0), (None, "u", big, 0), (8, "u", "é" * 600, 0), (9, "u", "é" * 600, 0), (5, None, big, 0)]
    got = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string, offset int")).collect()
    want = collections.Counter()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first = max(j for j, _, x, _ in rows if j is not None and (x or "").encode() == p)
        later = len(p) >= 1000 and i != first
        want[i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if later else "response", first if later else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.page_records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def reader(data):
    return lambda pos, n: data[pos : pos + n]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    records = [warc.make_record(i, "u", b"payload %d " % i * 50, hashlib.sha1(b"").hexdigest(), None, date="2000-01-01T00:00:00Z") for i in range(5)]
    parts = [warc.gzip_member(r) if packed else r for r in records]
    starts = [0, *itertools.accumulate(map(len, parts))]
    data = bytearray(b"".join(parts))
    for at in (starts[1] + len(parts[1]) // 2, starts[3] + 2):
        data[at] ^= 0xFF
    got = list(warc.salvage(reader(bytes(data)), len(data)))
    good = [f["warc-record-id"] for _, _, f, _ in got if f is not None]
    assert good == [warc.record_id(i) for i in (0, 2, 4)]
    gaps = [(o, n) for o, n, f, _ in got if f is None]
    assert gaps == [(starts[1], len(parts[1])), (starts[3], len(parts[3]))]


@pytest.mark.parametrize("held", [16 << 20, 700])
def test_salvage_within_a_member_of_many_records(monkeypatch, held):
    monkeypatch.setattr(warc, "HELD_BYTES", held)
    records = [warc.make_record(i, "u", b"payload %d " % i * 50, hashlib.sha1(b"").hexdigest(), None, date="d") for i in range(6)]
    whole, next_one = warc.gzip_member(b"".join(records[:5])), warc.gzip_member(records[5])
    got = list(warc.salvage(reader(whole), len(whole)))
    assert [f["warc-record-id"] for _, _, f, _ in got] == [warc.record_id(i) for i in range(5)]
    bad = bytearray(whole)
    bad[len(whole) * 3 // 4] ^= 0xFF
    data = bytes(bad) + next_one
    got = list(warc.salvage(reader(data), len(data)))
    good = [f["warc-record-id"] for _, _, f, _ in got if f is not None]
    assert good[0] == warc.record_id(0) and good[-1] == warc.record_id(5) and 2 <= len(good) < 6
    assert [(o, n) for o, n, f, _ in got if f is None] == [(0, len(whole))]


def test_foreign_headers():
    digest = hashlib.sha1(b"x")
    assert warc.hex_digest("sha1:" + base64.b32encode(digest.digest()).decode()) == warc.hex_digest(f"SHA1:{digest.hexdigest().upper()}") == digest.hexdigest()
    assert warc.hex_digest(None) is warc.hex_digest("md5:00") is warc.hex_digest("sha1:" + "!" * 32) is None


def test_foreign_archives_are_read(spark, tmp_path):
    revisit = b"WARC/1.0\r\nWARC-Type: revisit\r\nX-Payload-Bytes: many\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(revisit + b"garbage" + warc.make_record(3, "u", b"p", "d", None, date="d"))
    files = spark.createDataFrame([("a.warc",)], "file string")
    got = warc.read_warc(spark, f"file://{tmp_path}", files=files).orderBy("offset").collect()
    assert [(r["kind"], r["record_type"], r["payload_bytes"], r["length"]) for r in got][:2] == [("record", "revisit", None, len(revisit)), ("gap", None, None, 7)]
    assert got[2]["record_id"] == warc.record_id(3)


def test_salvage_of_cut_and_empty_files():
    r = warc.gzip_member(warc.make_record(1, None, b"p", "d", None, date="d"))
    cut = r + r[:-3]
    got = list(warc.salvage(reader(cut), len(cut)))
    assert [f is not None for _, _, f, _ in got] == [True, False] and got[1][:2] == (len(r), len(r) - 3)
    assert list(warc.salvage(reader(b""), 0)) == []
    assert [x[:2] for x in warc.salvage(reader(b"nothing here"), 12)] == [(0, 12)]


def test_records_longer_than_is_held(monkeypatch):
    monkeypatch.setattr(warc, "WHOLE_BYTES", 3000)
    monkeypatch.setattr(warc, "HELD_BYTES", 10_000)
    monkeypatch.setattr(warc, "WINDOW", 512)
    bodies = [random.Random(i).randbytes(n) for i, n in enumerate((10, 5_000, 40_000, 2_900, 20))]
    records = [warc.make_record(i, "u", b, hashlib.sha1(b).hexdigest(), None, date="d") for i, b in enumerate(bodies)]
    for data in (b"".join(records), warc.gzip_member(b"".join(records)), b"".join(map(warc.gzip_member, records))):
        got = list(warc.salvage(reader(data), len(data)))
        assert [f["warc-record-id"] for _, _, f, _ in got] == [warc.record_id(i) for i in range(5)]
        assert [(b.payload_bytes, b.payload_sha1) if isinstance(b, warc.Long) else (len(warc.http_payload(b)), hashlib.sha1(warc.http_payload(b)).hexdigest()) for *_, b in got] == [(len(b), hashlib.sha1(b).hexdigest()) for b in bodies]
        assert isinstance(got[2][3], warc.Long)
    # damage inside the long one, and a length that is too large: the others are read, the rest are gaps
    spoiled = records[2].replace(bodies[2][-50:], b"#" * 50)
    endless = records[1].replace(b"Content-Length: 50", b"Content-Length: 99")
    data = warc.gzip_member(b"".join([records[0], spoiled, b"lost " * 3000, endless, *records[3:]]))
    got = list(warc.salvage(reader(data), len(data)))
    assert [f and f["warc-record-id"] for _, _, f, _ in got] == [warc.record_id(0), None, *map(warc.record_id, (3, 4))]


def test_long_gaps_are_not_held(monkeypatch):
    monkeypatch.setattr(warc, "WINDOW", 1 << 12)
    monkeypatch.setattr(warc, "HELD_BYTES", 1 << 15)
    first, last = (warc.make_record(i, "u", b"p", "d", None, date="d") for i in (1, 2))
    data = warc.gzip_member(first + random.Random(1).randbytes(3 << 20) + last)
    stream = warc.Inflated(reader(data), 0)
    most = 0

    def read_at(pos, n):
        nonlocal most
        out = stream.read(pos, n)
        most = max(most, len(stream.buffer))
        return out

    got = list(warc._records(read_at, len(first) + (3 << 20) + len(last)))
    assert [f and f["warc-record-id"] for _, _, f, _ in got] == [warc.record_id(1), None, warc.record_id(2)] and got[1][1] == 3 << 20
    assert most < 1 << 18
    assert stream.read(0, 8) == first[:8]


def test_payload_that_most_pages_share(spark):
    rows = [(i, None, "x" * 2000 if i % 3 else f"page {i} " * 300) for i in range(400)]
    got = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(400))
    assert all(r["refers_to"] == (398 if r["page_id"] % 3 and r["page_id"] != 398 else None) for r in got)


# 6


def test_mix_stays_within_one_block(spark):
    rows = [(i, None, None, None if i % 50 == 0 else f"s{min(i % 7, 3)}", None) for i in range(3000)] + [(1, None, None, "s1", None), (None, None, None, "s1", None)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"": 0.01, "s0": 0.5, "s1": 0.2, "s2": 0.19, "s3": 0.1}
    plan = mixing.mix_plan(docs, weights, block_docs=4).collect()
    assert len(plan) == len(rows)
    blocks = {(r["source"], r["block"]): (r["slot"], r["release"], r["due"]) for r in plan}
    assert all(release <= slot < due for slot, release, due in blocks.values())
    assert len({s for s, _, _ in blocks.values()}) == len(blocks)
    assert max(collections.Counter((r["source"], r["block"]) for r in plan).values()) == 4


HALVES = {"a": 0.5, **{f"s{i}": 0.5 / 49 for i in range(49)}}
NINE_TENTHS = {"a": 0.9, **{f"s{i}": 0.1 / 399 for i in range(399)}}


@pytest.mark.parametrize("weights", [HALVES, NINE_TENTHS, {"a": Fraction(1, 7), "b": Fraction(2, 11), "c": Fraction(52, 77)}, {"a": 3, "b": 0, "c": 1}, {"a": 0.12345, "b": 0.87655}, {"one": 0.2}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}])
def test_schedule_keeps_the_given_weights(spark, weights):
    """Exact ratios, two periods: within one block of the weights as given after every slot, and inside every block's window."""
    counts = spark.createDataFrame([(s, 1) for s in [*weights, "unnamed"]], "source string, n long")
    rows = sorted(mixing.schedule(mixing.source_quotas(counts, weights)).collect(), key=lambda r: r["slot0"])
    given = {s: Fraction(w).limit_denominator(10**6) for s, w in weights.items()}
    target = {s: w / sum(given.values()) for s, w in given.items()}
    length = len(rows)
    assert [r["slot0"] for r in rows] == list(range(length)) and all(r["length"] == length and r["quota"] == target[r["source"]] * length for r in rows)
    took = collections.Counter()
    for t, r in enumerate(rows + rows):
        j = took[r["source"]] = took[r["source"]] + 1
        w = target[r["source"]]
        assert math.floor((j - 1) / w) <= t < math.ceil(j / w)
        if t % 97 == 0 or len(weights) < 9:
            assert all(abs(took[s] - (t + 1) * w) < 1 for s, w in target.items())


def test_weights_without_a_small_common_denominator(spark):
    rng = random.Random(1)
    weights = {f"s{i}": rng.random() for i in range(30)} | {"tiny": 1e-12}
    whole = mixing.whole_weights(weights, 5000)
    total = sum(weights.values())
    assert sum(whole.values()) in (5000, 5001) and all(abs(whole[s] - 5000 * w / total) <= 1 for s, w in weights.items())
    assert mixing.whole_weights({}) == {} and mixing.whole_weights({"a": 0.0}) == {}


def test_rows_of_weight_zero_and_of_one_id_are_placed(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, None, None, "abc"[i % 3], None) for i in range(300)], DOCS)
    plan = mixing.mix_plan(docs, {"a": 1, "b": 2}, block_docs=4).collect()
    assert len(plan) == 300 and {r["source"] for r in plan if r["slot"] is None} == {"c"}
    assert len({(r["source"], r["block"], r["pos"]) for r in plan}) == 300
    out = [r["source"] for r in mixing.mixed(docs, {"a": 1, "b": 2}).collect()]
    assert len(out) == 300 and set(out[200:]) == {"c"}
    assert mixing.mix_plan(docs, {}).where("slot is null").count() == 300


def test_mixed_is_in_the_order_of_the_plan(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", None, "abcd"[i * i % 4], None) for i in range(700)], DOCS)
    plan = sorted(mixing.mix_plan(docs).collect(), key=lambda r: (r["slot"], r["pos"]))
    mixing.mixed(docs).write.parquet(str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*"))
    assert len(parts) > 1 and [r["doc_id"] for f in parts for r in spark.read.parquet(str(f)).collect()] == [r["doc_id"] for r in plan]


def test_mixed_keeps_rows_and_columns(spark):
    docs = odd_rows(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert collections.Counter(map(str, out.collect())) == collections.Counter(map(str, docs.collect()))
    assert mixing.mixed(empty(spark)).count() == 0


# 7


def near_brute(docs, common=0.01):
    """Class of each row of any ids, by plain pairs of row numbers."""
    rows = docs.select("doc_id", "text").collect()
    classes = near_plain([(i, r["text"]) for i, r in enumerate(rows)], common)
    words = [bool(re.search(r"[0-9a-z\x80-\U0010ffff]", (r["text"] or "").lower())) for r in rows]
    least: dict = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[classes[i]] = min(least.get(classes[i], 1 << 60), r["doc_id"])
    return collections.Counter((r["doc_id"], least.get(classes[i]) if words[i] else r["doc_id"]) for i, r in enumerate(rows))


def near_plain(rows, common=0.01):
    """Smallest id of the class of each row (``doc_id``, ``text``) by pairs of plain dictionaries: nothing of the operator is used. Ids are not null."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] * bool(words)
        sets[i] = collections.Counter(grams)
    df = collections.Counter(g for c in sets.values() for g in c)
    most = 1 / common if common else max(2, len(rows))
    idf = {g: 1 + math.log(min(len(rows) / n, most)) / math.log(most) for g, n in df.items()}
    total = {i: sum(n * idf[g] for g, n in c.items()) for i, c in sets.items()}
    at = collections.defaultdict(list)
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in sorted(sets):
        meet = {j for g in sets[i] for j in at[g]}
        for j in meet:
            shared = sum(min(n, sets[j][g]) * idf[g] for g, n in sets[i].items() if g in sets[j])
            if shared >= 0.8 * (total[i] + total[j] - shared):
                a, b = sorted((root(i), root(j)))
                least[b] = a
        for g in sets[i]:
            at[g].append(i)
    return {i: root(i) for i in sets}


def test_near_classes_of_documents_against_plain_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(docs).collect()}
    want = near_plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert got == want and len(set(want.values())) < len(want)


def test_near_classes_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(150):
        text = list(base) if i < 90 else [word() for _ in range(100)]
        for _ in range(rnd.randint(0, 12)):
            text[rnd.randrange(len(text))] = word()
        rows.append((i, " ".join(text), None, None, None))
    docs = spark.createDataFrame(rows, DOCS)
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in near_dup.near_classes(docs).collect())
    assert got == near_brute(docs)


def test_near_classes_by_all_frequencies(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in near_dup.near_classes(docs, common=None).collect())
    assert got == near_brute(docs, None)
    assert near_dup.near_classes(empty(spark), common=None).count() == 0


def test_weights_by_all_frequencies(spark):
    texts = ["a b c d e", "a b c d e", "a b c d e f", "v w x y z v w x y z", "q"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _row long").withColumn("_row", F.col("_row").cast("decimal(38,0)"))
    sets = near_dup.exact_weights(docs, near_dup.signatures(docs, None)).collect()
    keyed = {k: w for r in sets for k, w in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["weights"], np.float32).tolist(), strict=True)}
    first = near_dup.shingles(pa.array(["a b c d e"]))[0][0]
    assert len(sets) == 4 and math.isclose(keyed.pop(int(first)), 1 + math.log(5 / 3) / math.log(5), rel_tol=1e-6) and {round(w, 6) for w in keyed.values()} == {2.0}


def test_blockwise_links_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    test_near_classes_against_brute_force(spark)


def test_near_classes_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in near_dup.near_classes(docs).collect())
    assert got == near_brute(docs)
    assert near_dup.drop_near_copies(docs).columns == docs.columns
    assert near_dup.near_classes(empty(spark)).count() == 0


def test_samples_agree_as_often_as_sets_do():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    w = rng.random(len(h)) * 3 + 0.1
    v = np.where(rng.random(len(h)) < 0.5, w, w * 1.7)
    v[:80], w[-80:] = 1e-6, 1e-6
    s = near_dup.Sampler(6000)
    want = np.minimum(v, w).sum() / np.maximum(v, w).sum()
    assert abs((s(h, np.log(v)) == s(h, np.log(w))).mean() - want) < 0.03


def test_shingles_by_hand():
    h, r = near_dup.shingles(pa.array(["A b, c d e f", "", None, "x y", "a B c d e", "..."]))
    assert r.tolist() == [0, 0, 3, 4] and h[0] == h[3]


# 8


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = odd_rows(spark)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    rows = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(3, "und"), (4, "und"), (8, "und"), (1, "en")} <= rows
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.drop_unidentified(docs).columns == docs.columns


def test_rare_language_is_learned_from_a_bounded_sample(spark):
    rnd = random.Random(12)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(3)) for _ in range(12))
    rows = [(i, text("abcd"), "many") for i in range(4000)] + [(10000 + i, text("wxyz"), "few") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.training_rows(docs), fit_rows=100)
    few = langid.predict(docs.where("lang = 'few'"), model, keep=["doc_id"]).collect()
    assert len(few) == 40 and all(r["lang_pred"] == "few" for r in few)
    none_labelled = docs.limit(5).unionByName(spark.createDataFrame([(1, "1 2 ...", None), (2, None, None)], docs.schema)).withColumn("lang", F.lit(None).cast("string"))
    assert langid.drop_unidentified(none_labelled).count() == 5  # no text can be told from another: those with a letter stay


def test_scores_count_the_grams_of_each_language():
    def of(text):
        b = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in f" {text.lower()} ").encode()
        return [b[i : i + 4] for i in range(len(b) - 3) if b"  " not in b[i : i + 4]]

    rnd = random.Random(13)
    texts = ["".join(rnd.choice("abcdé zŸ1,") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["", "a", "éé"]
    langs = {f"l{i:03d}": {x for t in texts[i::7] for x in of(t)} for i in range(150)}
    model = langid.LangFilter.build({k: [int.from_bytes(x, "little") for x in v] for k, v in langs.items()}, 20)
    s = model.scores(pa.array(texts))
    for i, t in enumerate(texts):
        g = of(t)
        for j, known in enumerate(model.langs):
            want = sum(x in langs[known] for x in g) / max(len(g), 1)
            assert abs(s[i, j] - want) < 0.02


def test_filter_has_every_member_and_few_others():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 1 << 32, 6000, dtype=np.uint64).astype(np.uint32)
    f = langid.LangFilter.build({"a": keys[:3000].tolist(), "b": keys[2000:5000].tolist()}, 15)
    first, second = f.slots(keys, 15)
    mask = f.table[first] & f.table[second]
    assert ((mask[:3000] & 1) == 1).all() and ((mask[2000:5000] & 2) == 2).all()
    assert abs(((mask[5000:] & 1) == 1).mean() - f.false_positive[0]) < 0.02


# 9


def library(p, text):
    return np.array(p.lib.encode(text or ""), "<u4").tobytes()


def test_scan_of_cut_texts_equals_the_library(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("etaoinshrdlu") for _ in range(900)), "word " * 400, " " * 700 + "x", "".join(rnd.choice("ab c\n中é#12  ") for _ in range(900)), ("trans" * 60 + "  ") * 5, None, "", " ", "▁a ▁"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    p = piece_scan._pieces(MODEL)
    for giant, chunk in ((50, 16), (100, 64), (1 << 20, 8192)):
        for r in piece_scan.encode(docs, model=MODEL, giant=giant, chunk=chunk).collect():
            assert r["ids"] == library(p, texts[r["doc_id"]])
            assert r["decoded"] == (texts[r["doc_id"]] or "").replace("▁", " ")


def test_products_can_be_grouped_in_any_way():
    rng = np.random.default_rng(8)
    a, b, c = (np.where(rng.random((3, 3)) < 0.3, -np.inf, rng.normal(size=(3, 3))) for _ in range(3))
    left = piece_scan.combine(piece_scan.combine(a, b), c)
    right = piece_scan.combine(a, piece_scan.combine(b, c))
    assert np.allclose(np.where(np.isinf(left), -1e9, left), np.where(np.isinf(right), -1e9, right))


def test_states_of_long_runs_equal_those_of_one_pass(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for run, n in enumerate((1, 2, 3, 7, 9)):
        sizes = [1, *rng.integers(2, 5, n - 1).tolist(), 1]
        ms = [rng.normal(size=(sizes[i], sizes[i + 1])) for i in range(n)]
        for k, m in enumerate(ms):
            rows.append((1, run, k, bytearray(m.astype("<f8").tobytes()), m.shape[0], m.shape[1]))
        best = max(itertools.product(*(range(s) for s in sizes)), key=lambda path: sum(m[i, j] for m, i, j in zip(ms, path, path[1:], strict=False)))
        want |= {(run, k): (best[k], best[k + 1]) for k in range(n)}
    df = spark.createDataFrame(rows, "doc_row long, segment int, k int, matrix binary, n_left int, n_right int")
    assert {(r["segment"], r["k"]): (r["i"], r["j"]) for r in piece_scan.boundary_states(df).collect()} == want


def test_tokens_of_odd_rows(spark):
    docs = odd_rows(spark)
    p = piece_scan._pieces(MODEL)
    got = collections.Counter((r["doc_id"], tuple(r["tokens"])) for r in piece_scan.tokens(docs, model=MODEL).collect())
    want = collections.Counter((r["doc_id"], tuple(p.lib.encode(r["text"] or ""))) for r in docs.select("doc_id", "text").collect())
    assert got == want
    assert piece_scan.tokens(empty(spark), model=MODEL).count() == 0


# 10


def all_pairs(rows, min_chars=line_dedup.MIN_CHARS):
    lines = {i: [(x.strip(" "), k) for k, x in enumerate((t or "").split("\n")) if x.strip(" ")] for i, t in rows}
    drop = collections.defaultdict(set)
    for i, j in itertools.combinations(sorted(lines), 2):
        a, b = [x for x, _ in lines[i]], [x for x, _ in lines[j]]
        drop[j] |= {lines[j][k][1] for k in line_dedup.common_blocks(a, b, [len(x) for x in b], min_chars)}
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop[i]) for i, t in rows}


def long_crossed(rnd):
    one, two = "first line of the frequent pair " * 2, "second line of the frequent pair " * 2
    return [(1, f"{one}\n{two}"), *((i, f"{two}\n{one}") for i in range(2, 21))]


def short_passage(rnd):
    passage = [f"short line {i}" for i in range(6)]
    singles = [(i, f"only {i}\n{x}") for i, x in enumerate(passage)]
    return singles + [(i, "\n".join([f"own {i}", *passage, f"end {i}"])) for i in range(10, 40)]


def crossed_order(rnd):
    heads = ["the one long line that all have, of more than enough characters", "the other long line that all have, of more than enough characters"]
    return [(i, "\n".join([f"own {i}", *(heads if i % 3 else heads[::-1]), *(rnd.choice(heads) for _ in range(i % 4)), f"end {i}"])) for i in range(90)]


def mixed_pool(rnd):
    pool = [f"line {i} of it" for i in range(25)] + ["short", "", "  ", "a line that is long enough to be a block of its own, surely"]
    return [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for i in range(120)]


def lines_pool(rnd):
    pool = [f"line number {i} with some more words in it" for i in range(60)] + ["short", "", "  "]
    return [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 15)))) for i in range(80)]


@pytest.mark.parametrize("made", [long_crossed, short_passage, crossed_order, mixed_pool, lines_pool])
def test_line_dedup_equals_all_pairs(spark, made):
    rows = made(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()} == all_pairs(rows)


def test_line_dedup_of_odd_rows(spark):
    docs = odd_rows(spark)
    out = line_dedup.drop_repeated_lines(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == set(docs.columns)
    assert [r["text"] for r in rows if r["doc_id"] == 3] == [None]
    assert {r["_dropped"] for r in rows if r["doc_id"] == 5} == {0} and {r["_dropped"] for r in rows if r["doc_id"] == 6} == {1}
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_patience_is_a_common_subsequence():
    rnd = random.Random(10)
    for _ in range(300):
        a, b = ([rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))
    assert line_dedup.patience(list("xabcy"), list("zabcw")) == [(1, 1), (2, 2), (3, 3)]


# the pipeline


def test_pipeline_stages(spark):
    """Each stage keeps the rows that a plain version keeps."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    known = {r["doc_id"] for r in langid.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= 0.05}
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    strip = str.maketrans("", "", " \t\n\x0b\f\r")

    def first_of_equals(kept):
        groups = collections.defaultdict(list)
        for i in kept:
            groups[(rows[i] or "").translate(strip)].append(i)
        return {min(g, key=lambda i: (-len(rows[i] or ""), i)) for g in groups.values()}

    plain = {
        "language_id": lambda kept: kept & known,
        "exact_dedup": first_of_equals,
        "near_dedup": lambda kept: set(near_plain([(i, rows[i]) for i in kept]).values()),
        "mixing": lambda kept: kept,
    }
    want, n = set(rows), [len(rows)]
    for name, stage in c.STAGES[:-1]:
        out, want = stage(spark, docs, SMALL), plain[name](want)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(want), name
        n.append(len(want))
    assert n[0] == n[1] > n[2] > n[3] == n[4]
    last = c.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == n[4]


@pytest.mark.parametrize("rows", [odd_rows, empty])
def test_pipeline_stages_of_odd_rows(spark, rows):
    import corpus_pipeline as c

    docs = rows(spark)
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    c.STAGES[-1][1](spark, docs, SMALL).collect()


def test_pipeline_result_is_in_the_order_of_the_mix(spark):
    import corpus_pipeline as c

    docs = spark.createDataFrame([(i, f"text {i}", None, None if i % 9 == 0 else f"s{i % 4 // 2}", None) for i in range(400)], DOCS)
    out = c.STAGES[-1][1](spark, docs, SMALL).select("doc_id", "slot", "pos").collect()
    plan = mixing.mix_plan(docs).collect()
    order = lambda rows: [r["doc_id"] for r in sorted(rows, key=lambda r: (r["slot"], r["pos"]))]
    assert order(out) == order(plan) != sorted(order(plan))
    odd = c.STAGES[-1][1](spark, odd_rows(spark), SMALL).collect()
    assert len(odd) == len({(r["slot"], r["pos"]) for r in odd}) == odd_rows(spark).count()

"""Merkle manifest, source divergence and exact search against plain Python, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import divergence, exact_search, merkle

from .test_dealt import empty, odd_rows, vectors


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shown(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and each leaf's siblings (left, right) level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k, leaves in enumerate(under[at : at + 16]):
                for leaf in leaves:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            over.append([leaf for leaves in under[at : at + 16] for leaf in leaves])
        nodes, under = above, over
    return nodes[0], paths


def plain_proofs(rows) -> list[tuple]:
    leaf = lambda r, text: sha("".join(map(shown, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))):
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([leaf(r, r["text"]) for r in groups[s]]) for s in names]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for r, path in zip(groups[name], paths, strict=True):
            text, steps = r["text"], path + top
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r, text)
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=repr)


def proofs(docs) -> list[tuple]:
    return sorted(map(tuple, merkle.document_proofs(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_proofs_of_odd_rows_and_repeated_rows(spark):
    docs = odd_rows(spark).unionByName(odd_rows(spark)).withColumn("pos", F.lit(1)).withColumn("tree", F.lit("x")).withColumn("digest", F.lit("y"))
    assert proofs(docs) == plain_proofs(docs.collect())


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 1, "": 16, "b": 17}, {"hot": 4500, "x": 256, "y": 257, None: 3}, {f"s{i:03}": 1 + i % 2 for i in range(300)}])
def test_proofs_of_trees_of_all_heights(spark, sizes):
    rows = [(i, f"Text {i % 7}", None, source, i) for i, source in enumerate(s for s, n in sizes.items() for _ in range(n))]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = proofs(docs)
    assert got == plain_proofs(docs.collect())
    assert proofs(docs.repartition(7)) == got


def test_manifest_without_rows(spark):
    assert merkle.document_proofs(empty(spark)).collect() == []
    none = empty(spark).select("doc_id", "source", F.lit("").alias("digest"))
    assert merkle.manifest(none, group="source", order=["doc_id"]).root is None


# source divergence


def plain_divergence(rows, min_docs):
    fold = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, count, groups = collections.Counter(), collections.Counter(), set()
    for r in rows:
        lang, source, terms = r["lang"] or "", r["source"] or "", fold(r["text"])
        groups.add((lang, source))
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (at, t), n in docs.items() if at == lang and n >= min_docs)
        sources = sorted(s for at, s in groups if at == lang)
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        whole = [sum(count[lang, s, t] for s in sources) for t in kept]
        q = [share(c, sum(whole)) for c in whole]
        p = {s: [share(count[lang, s, t], sum(count[lang, s, t] for t in kept)) for t in kept] for s in sources}
        for s in sources:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [(b - a, t) for a, b, t in zip(p[s], q, kept, strict=True) if a > b and count[lang, s, t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:50])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def divergences(docs, min_docs):
    return sorted(map(tuple, divergence.divergence(docs, min_docs=min_docs).select("lang", "source", "part", "item", "value", "rank").collect()))


def word_rows(spark, seed=4):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Ünï", "straße", "É", "中文", "ABC", "abc", "x\x00y"]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 30)))
    rows = [(i, rng.choice([None, "", text(), text(), text() + "-a.b_c"]), rng.choice([None, "", "en", "en", "fr"]), rng.choice(["hot", "hot", None, "b", "c", "d"]), None) for i in range(150)]
    rows += [(900, "only here", "xx", "p", None), (901, None, "xx", "q", None), (902, "...", "xx", "r", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("min_docs", [1, 6, 30])
def test_divergence_equals_plain_sums(spark, min_docs):
    docs = word_rows(spark)
    assert divergences(docs, min_docs) == plain_divergence(docs.collect(), min_docs)


def test_divergence_of_odd_rows_and_none(spark):
    docs = odd_rows(spark).withColumn("term", F.lit("a")).withColumn("terms", F.lit("a")).withColumn("value", F.lit(1))
    assert divergences(docs, 1) == plain_divergence(docs.collect(), 1)
    assert divergences(empty(spark), 1) == []


def test_divergence_counts_in_parts_of_bounded_size(spark, monkeypatch):
    docs = word_rows(spark, 8)
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    batch = docs.select("lang", "source", "text").fillna("").toArrow().to_batches()
    many = list(divergence._count(iter(batch)))
    total = collections.Counter()
    for part in many:
        for r in part.to_pylist():
            total[r["term"]] += r["n"]
    assert len(many) > 5
    assert total == collections.Counter(t.decode() for r in docs.collect() for t in divergence.terms_of((r["text"] or "").encode()))


def test_joint_histogram_has_every_cell_once(spark):
    docs = word_rows(spark).fillna("")
    cells = divergence.term_counts(docs, 4)
    groups = docs.select("lang", "source").distinct().join(cells.groupBy("lang").agg(F.countDistinct("term").alias("kept")), "lang")
    counts = {(r["lang"], r["source"], r["term"]): r["n"] for r in cells.collect()}
    kept = collections.defaultdict(set)
    for lang, _, term in counts:
        kept[lang].add(term)
    by_lang = collections.defaultdict(set)
    for r in groups.collect():
        by_lang[r["lang"]].add(r["source"])
    want = collections.Counter((lang, a, b, counts.get((lang, a, t), 0), counts.get((lang, b, t), 0)) for lang, ss in by_lang.items() for a in ss for b in ss if a < b for t in kept[lang])
    got = [tuple(r) for r in divergence.joint_histogram(cells, groups).select("lang", "a", "b", "count_a", "count_b", "terms").collect()]
    assert len(got) == len(want) and {r[:5]: r[5] for r in got} == dict(want)


def test_shares_are_exact_beyond_longs(spark):
    cases = [(0, 0, 1), (10**15, 10**17 + 7, 3), (9 * 10**18, 9 * 10**18, 10**6), (3, 17, 5)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"), "c", "n", "v").collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) for r in got)


# exact search


def plain_search(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [float(x) for x in v]
            ok[i] = min(ok[i], v) if i in ok else v
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in ok.items()}
    clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    out = []
    for q in (i for i in ok if i % 100 == 0):
        best = sorted((-clip(sum(a * b for a, b in zip(whole[q], whole[i], strict=False))), i) for i in whole if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def searched(df, **options):
    return sorted(map(tuple, exact_search.search(df, df.where("vec_id % 100 = 0"), **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_exact_search_in_many_tiles_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(1).astype(np.float32).tolist(), None) for i in range(900)] + [(i, [0.5] * 5, 1) for i in range(900, 1400)]
    df = vectors(spark, rows)
    want = plain_search([(i, np.array(v, np.float32).tolist()) for i, v, _ in rows], 10)
    assert searched(df) == want
    assert searched(df, shard_bytes=8 * 5 * 40, tile_bytes=8 * 5 * 3) == want  # 35 shards: merged in two levels


def test_exact_search_of_odd_rows(spark):
    rows = [(0, [1.0, 0.3, -0.7], 1), (100, [0.0, 0.0, 0.0], 1), (200, [], 1), (1, [2.0, 1.0], 1), (1, [2.0, 0.5], 1), (2, None, 1), (3, [None], 1), (4, [float("nan")], 1), (5, [float("-inf")], 1), (None, [1.0], 1), (300, [0.1, 0.2, 0.3], 1), (300, [0.1, 0.2, 0.3], 1), (6, [-1.5, 0.0001, -0.0001], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("query_id", F.lit(3))
    assert searched(df) == plain_search(rows, 10)
    assert searched(df.where("false")) == []
    assert searched(df.where("vec_id = 100")) == []


def test_exact_search_beyond_doubles(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e300, -1e306, 2.0**40 + 1 / 1024, 1e5, -3.0, 2.0**25]) for _ in range(3)]) for i in range(60)] + [(100, [2.0**22 + 1 / 1024, 2.0**22, 1.0]), (200, [2.0**27 + 1 / 1024, 1e9 + 0.3, -(2.0**21)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert searched(df) == plain_search(rows, 10)

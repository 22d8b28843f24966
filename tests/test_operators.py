from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import analytics, blank_nodes, components, curation, events, filters, graphs, matching, paging, resolve, triples
from quire.sources import readers, writers


def test_components_of_chain_and_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (None, 3)], "a int, b int")
    got = {r["node"]: r["component"] for r in components.connected_components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 200, 201: 200}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_cursor():
    assert paging.decode_cursor(paging.encode_cursor("x", "y")) == ("x", "y")
    assert paging.decode_cursor("???") is None and paging.decode_cursor(None) is None


def test_pages_walk_all_rows_once(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "s int, k int")
    seen, after = [], None
    while True:
        page = paging.keyset_page(rows, "s", "k", after=after, limit=6).collect()
        seen += [(r["s"], r["k"]) for r in page[:6]]
        if len(page) <= 6:
            break
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(20))


def test_latest_with_ties(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 3, 0, None)], "k string, t int, i int, v string")
    assert {(r["k"], r["v"]) for r in paging.latest(rows, ["k"], ["t", "i"]).collect()} == {("a", "y"), ("b", None)}


def test_merge_sources(spark):
    none = (None,) * 2
    rows = [("1", "q1", "c1", *none, "x", None), ("2", None, "c1", *none, "y", None), ("3", None, None, *none, "x", None), ("4", None, None, *none, "x", None), ("5", None, None, *none, "", "u"), ("6", None, None, *none, "", "v")]
    e = spark.createDataFrame(rows, "entity_id string, qid string, cn string, viaf string, nli string, label string, raw string")
    got = {r["entity_id"]: (r["cluster"], r["cluster_key"]) for r in resolve.merge_sources(e).collect()}
    assert got == {"1": ("1", "qid:q1"), "2": ("1", "qid:q1"), "3": ("3", "label:x"), "4": ("3", "label:x"), "5": ("5", "raw:u"), "6": ("6", "raw:v")}


def test_homonyms_abstain_on_ties(spark):
    cols = "query_id int, id string, tag string, dates string, record_dates string, year int, role string, fuzzy boolean"
    rows = [(1, "a", "100", "1500-1560", "1510-1570", 1540, "author", False), (1, "b", "150", "1500-1560", "1510-1570", 1540, "author", False), (2, "a", "100", "1200-1260", "1510-1570", None, "", False), (2, "b", "100", "1100-1160", "1510-1570", None, "", False)]
    got = {r["query_id"]: (r["winner"], r["abstain"]) for r in matching.pick_homonym(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("a", False), 2: (None, True)}


def test_trigram_pairs_against_brute_force(spark):
    names = ["Moshe Cohen", "Moses Cohen", "Mosheh Kohen", "David Levi", "Levi David", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, text string")

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in (t or "").lower().split() for i in range(len(w) + 1)}

    want = {(a, b) for a, x in enumerate(names) for b, y in enumerate(names) if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.3}
    assert {(r["left_id"], r["right_id"]) for r in matching.trigram_pairs(df, df, threshold=0.3).collect()} == want


def test_patterns_without_shared_variable_are_refused(spark):
    t = spark.createDataFrame([("a", "p", "b", "uri", None)], "s string, p string, o string, o_kind string, o_lang string")
    with pytest.raises(ValueError):
        triples.basic(t, ("?a", "p", "?b"), ("?c", "p", "?d"))


def test_ntriples_round_trip(spark):
    rows = [("a", "p", 'x "y"\n\\z', "literal", "he"), ("a", "q", "b", "uri", None), ("a", "p", "", "literal", None)]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")
    lines = triples.to_ntriples(t).union(spark.createDataFrame([("no triple",)], "value string"))
    assert sorted(map(tuple, triples.from_ntriples(lines).drop("o_datatype").collect()), key=str) == sorted(rows, key=str)


def test_path_ends_in_cycles(spark):
    t = spark.createDataFrame([(a, "p", b, "uri", None) for a, b in ("ab", "bc", "ca")], "s string, p string, o string, o_kind string, o_lang string")
    assert triples.path_plus(t, "p").count() == 9


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("a", "d", "y"), ("d", "c", "y")], "a string, b string, label string")
    assert [r["node"] for r in graphs.shortest_path(e, "a", "c").orderBy("hop").collect()] == ["a", "b", "c"]
    assert [r["node"] for r in graphs.shortest_path(e, "a", "a").collect()] == ["a"]
    assert graphs.shortest_path(e, "a", "zz").count() == 0 and graphs.shortest_path(e, "zz", "a").count() == 0


def test_replay_and_revert(spark):
    rows = [("e", 1, "create", None, {"a": "1"}), ("e", 2, "patch", {"b": "2"}, None), ("e", 3, "patch", {"a": None}, None)]
    ev = spark.createDataFrame(rows, "entity_id string, rev int, op string, patch map<string,string>, state map<string,string>")
    assert events.states_at(ev).first()["state"] == {"b": "2"}
    assert events.states_at(ev, 2).first()["state"] == {"a": "1", "b": "2"}
    after = ev.unionByName(events.revert(ev, 1))
    last = events.states_at(after).first()
    assert (last["rev"], last["state"]) == (4, {"a": "1"})


def test_calibration_keeps_floor_without_rows(spark):
    rows = spark.createDataFrame([("a", 0.99, True, None), ("a", 0.86, False, None), ("b", 0.1, True, None), ("c", 0.9, True, "boom")], "bucket string, confidence double, full boolean, error string")
    got = {r["bucket"]: (r["threshold"], r["target_reached"]) for r in analytics.calibrate(rows).collect()}
    assert got == {"a": (0.87, True), "b": (0.85, False)}


def test_dataset_filters(spark):
    df = spark.createDataFrame([("x", "1,200"), ("y", "b"), (None, None)], "s string, v string")
    assert filters.dataset_select(df, "missing", "eq", "").count() == 3
    assert filters.dataset_agg(df, "v").first()["sum"] == 1200.0
    with pytest.raises(ValueError):
        filters.dataset_select(df, "s", "like", "x")


def marc(records):
    out = b""
    for fields in records:
        body, directory = b"", ""
        for tag, data in fields:
            raw = data.encode() + b"\x1e"
            directory += f"{tag}{len(raw):04d}{len(body):05d}"
            body += raw
        head = directory.encode() + b"\x1e"
        size = 24 + len(head) + len(body) + 1
        out += f"{size:05d}nam a22{24 + len(head):05d} a 4500".encode().ljust(24) + head + body + b"\x1d"
    return out


def test_marc_and_marcxml_agree(spark, tmp_path):
    (tmp_path / "a.mrc").write_bytes(marc([[("001", "99"), ("245", "10\x1faTitle\x1fbRest"), ("700", "1 \x1faOne"), ("700", "1 \x1faעברית")]]) + b"junk\x1d")
    xml = """<collection><record><leader>00000nam</leader><controlfield tag="001">99</controlfield><datafield tag="245" ind1="1" ind2="0"><subfield code="a">Title</subfield><subfield code="b">Rest</subfield></datafield>
    <datafield tag="700" ind1="1" ind2=" "><subfield code="a">One</subfield></datafield><datafield tag="700" ind1="1" ind2=" "><subfield code="a">עברית</subfield></datafield></record></collection>"""
    (tmp_path / "a.xml").write_text(xml)
    binary = readers.read_marc(spark, str(tmp_path / "a.mrc"))
    assert binary.where("error is not null").count() == 1
    good = binary.where("error is null")
    flat = lambda df: readers.flat_columns(df).first()["columns"]
    want = {"001": "99", "245$a": "Title", "245$b": "Rest", "700$a": "One|עברית"}
    assert flat(good) == want and flat(readers.read_marcxml(spark, str(tmp_path / "a.xml"))) == want
    assert good.select(readers.occurrence_errors(F.col("occurrences")).alias("e")).first()["e"] == []


def test_formats_and_tables(spark, tmp_path):
    assert [readers.sniff(x) for x in (b"<a>", b"[1]", b'{"a":1}', b"01234nam", b"a\tb\n", b"a,b\n")] == ["marcxml", "json", "jsonl", "marc", "tsv", "csv"]
    with pytest.raises(ValueError):
        readers.sniff(b" \n")
    (tmp_path / "t.tsv").write_text("001\tMain Title\t245$a\n1\tx\ty\n")
    assert readers.read_table(spark, str(tmp_path / "t.tsv"), sep="\t").columns == ["control_number", "title", "245$a"]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnope\n\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int")
    assert [r["a"] for r in good.collect()] == [1] and [(r["line"], r["value"]) for r in bad.collect()] == [(2, "nope")]
    writers.write_csv(spark.createDataFrame([(1, ["a", "b"])], "k int, v array<string>"), str(tmp_path / "out"), ["k", "v", "w"])
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape='"').first()["v"] == '["a","b"]'


def test_heads_and_encodings(spark, tmp_path):
    hebrew = "001\tכותר\n1\tשלום\n"
    (tmp_path / "t").write_bytes(hebrew.encode("windows-1255"))
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "part").write_bytes(b"01234nam" + b"x" * 100_000)
    assert readers.format_of(spark, str(tmp_path / "folder")) == "marc" and len(readers.head_of(spark, str(tmp_path / "folder"), 10)) == 10
    assert readers.sniff_encoding(hebrew.encode()[:-5]) == readers.sniff_encoding(b"") == "UTF-8"
    assert readers.sniff_encoding("שלום".encode("windows-1255")) == "windows-1255" and readers.sniff_encoding(b"\xff\xfea\0") == "UTF-16LE" and readers.sniff_encoding(b"\xff\xff") == "ISO-8859-1"
    assert [readers.sniff_delimiter(x, suffix=y) for x, y in ((b"a\tb", "csv"), (b"a,b", "tsv"), (b"a\tb\n", ""), (b"a b", "txt"))] == [",", "\t", "\t", ","]
    assert readers.read_any_table(spark, str(tmp_path / "t")).collect()[0]["כותר"] == "שלום"


def test_json_falls_back_to_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 3}\n{"a": 4}\n')
    assert [sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / f), "a int").collect()) for f in ("a.json", "b.json")] == [[1, 2], [3, 4]]


def test_lines_are_numbered_through_splits(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "n.txt")).select("line", "value").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 5000 and all(r["value"] == f"line {r['line']}" for r in got)


@pytest.mark.parametrize("bad", ['<!DOCTYPE x [<!ENTITY e "v">]>', "<!entity x>", "\0"])
def test_marcxml_refuses(spark, tmp_path, bad):
    (tmp_path / "a.xml").write_text(f"{bad}<collection></collection>")
    with pytest.raises(ValueError):
        readers.read_marcxml(spark, str(tmp_path / "a.xml"))


def test_values_of_a_field_keep_their_order(spark):
    kinds = "control_number string, occurrences array<struct<tag string, occurrence int, indicators array<string>, subfields array<struct<code string, value string>>, data string>>"
    rows = [("1", [("700", 2, None, [("a", "x"), ("e", "r"), ("a", "y")], None), ("700", 1, None, [("a", "first")], None), ("001", 1, None, None, "1")]), ("2", None)]
    assert [(r["control_number"], r["columns"]) for r in readers.flat_columns(spark.createDataFrame(rows, kinds)).collect()] == [("1", {"700$a": "first|x y", "700$e": "r", "001": "1"})]


def test_csv_ends_lines_with_crlf(spark, tmp_path):
    writers.write_csv(spark.createDataFrame([(1,), (2,)], "k int").coalesce(1), str(tmp_path / "out"), ["k"])
    assert next((tmp_path / "out").glob("*.csv")).read_bytes() == b"k\r\n1\r\n2\r\n"


def test_later_events_with_smaller_ids_count(spark, tmp_path):
    from quire.streaming.entities import follow

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("e", 1, 9, "f", "first"), ("e", 2, 3, "f", "second"), ("e", 2, 3, "f", "second")]
    df = spark.createDataFrame(rows, "entity_id string, ts long, event_id long, field string, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("later").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["rev"], r["value"]) for r in spark.table("later").collect()) == [(1, "first"), (2, "second")]


def test_streamed_state_equals_batch(spark, tmp_path):
    from quire.streaming.entities import slot_counts

    rows = [(f"e{i % 3}", f"2024-01-01 {i % 24:02d}:00:00", "click") for i in range(48)]
    df = spark.createDataFrame(rows, "entity_id string, t string, event_type string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = slot_counts(stream).writeStream.format("memory").queryName("slots").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {(r["slot"], r["n"]) for r in df.groupBy(F.window("ts", "8 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot"), "n").collect()}
    assert {(r["slot"], r["n"]) for r in spark.table("slots").collect()} == want


def test_running_state_follows_a_stream(spark, tmp_path):
    from quire.streaming.entities import follow

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(f"e{i % 2}", i // 2, i, "f" if i % 3 else "g", str(i)) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[-1]], "entity_id string, ts long, event_id long, field string, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = follow(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["entity_id"], r["rev"], r["key"], r["value"]) for r in spark.table("states").collect()}
    want = {(e, n + 1, f, v) for x in ("e0", "e1") for n, (e, _, _, f, v) in enumerate(r for r in rows if r[0] == x)}
    assert got == want


def test_pruning_keeps_anchors(spark):
    ops = ["create", *["patch"] * 4, "snapshot", *["patch"] * 4]
    rows = [("a", i, op) for i, op in enumerate(ops)] + [("b", i, "patch") for i in range(3)] + [("c", i, "snapshot") for i in range(6)]
    df = spark.createDataFrame(rows, "entity_id string, rev int, op string")
    gone = lambda keep: {(r["entity_id"], r["rev"]) for r in events.prune_plan(df, "entity_id", ["rev"], keep=keep).collect()}
    assert gone(4) == {("a", i) for i in (1, 2, 3, 4, 6, 7)}
    assert gone(1) == {("a", i) for i in (1, 2, 3, 4, 6, 7, 8, 9)} | {("b", 0), ("b", 1)}


def test_fixed_points_have_no_depth(spark):
    n = 20
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n, 3)], "a int, b int")
    known = spark.createDataFrame([(0, "x")], "item int, value string")
    assert {(r["item"], r["value"]) for r in curation.propagate(known, links).collect()} == {(i, "x") for i in range(n + 1)}
    t = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}", "uri") for i in range(n)], "s string, p string, o string, o_kind string")
    got = [(r["s"], r["o"]) for r in triples.path_plus(t, "p").collect()]
    assert len(got) == len(set(got)) and set(got) == {(f"n{i}", f"n{j}") for i in range(n) for j in range(i + 1, n + 1)}


def test_containment_needs_no_whole_word(spark):
    names = spark.createDataFrame([(1, "mishneh hatorah"), (2, "torahs of old and other long words"), (3, "ab"), (4, "rare"), (5, "long name with xrarey inside of it")], "id int, text string")
    queries = spark.createDataFrame([(1, "torah"), (2, "crab apple tree"), (3, "rar"), (4, "xrarey"), (5, "ishneh hato"), (6, "z"), (7, "name wit")], "id int, text string")
    got = {r["query_id"]: (r["name_id"], r["tier"]) for r in matching.cascade(queries, names).collect()}
    assert got == {1: (1, 1), 2: (3, 1), 3: (4, 1), 4: (4, 1), 5: (1, 1), 7: (5, 1)}


def test_turtle_forms(spark, tmp_path):
    from quire.sources import turtle

    (tmp_path / "a.ttl").write_text(
        """@prefix x: <http://x/> .
@prefix : <http://d/> .
# a comment .
x:a a x:Thing ;
    x:name "One \\"two\\""@en , 'odd' .
:b x:n 12 , true ;
    x:see <http://y#z> , x:a , "7"^^x:int ; .
_:c x:p [ x:q 1 ] .
x:d unknown:p x:e .
"""
    )
    good, bad = turtle.read_turtle(spark, str(tmp_path / "a.ttl"))
    rows = good.collect()
    got = {(r["s"], r["p"], r["o"], r["o_kind"], r["o_datatype"]) for r in rows if r["s"] == "http://d/b"}
    assert got == {
        ("http://d/b", "http://x/n", "12", "literal", triples.XSD + "integer"),
        ("http://d/b", "http://x/n", "true", "literal", triples.XSD + "boolean"),
        ("http://d/b", "http://x/see", "http://y#z", "uri", None),
        ("http://d/b", "http://x/see", "http://x/a", "uri", None),
        ("http://d/b", "http://x/see", "7", "literal", "http://x/int"),
    }
    nested = {r["p"]: r for r in rows if r["s"].startswith("_:")}
    assert len(rows) == 7 and nested["http://x/p"]["o"] == nested["http://x/q"]["s"] and nested["http://x/p"]["o_kind"] == "blank"
    assert len(bad.collect()) == 2


TURTLE = """@prefix x: <http://x/> .
x:a x:p "1" , 1 , "1"^^x:own , 1.5 , 2e3 , "de"@de-1996 , "\\u05D0\\U0001F600\\t" . x:b x:p x:c.x:one , x:d .
[] x:p x:lonely .
[ x:p [ x:q _:n , [ x:r "deep" ] ] ; x:s 1 ] x:after x:e .
_:n x:self _:n .
x:list x:p (1 2) .
x:w x:p 'single' .
[ x:p ] .
x:y x:p x:z ] .
"""


def test_turtle_of_nested_nodes_and_datatypes(spark, tmp_path):
    from quire.sources import turtle

    (tmp_path / "a.ttl").write_text(TURTLE)
    good, bad = turtle.read_turtle(spark, str(tmp_path))
    rows = good.collect()
    assert {(r["o"], r["o_datatype"], r["o_lang"]) for r in rows if r["s"] == "http://x/a"} == {("1", None, None), ("1", triples.XSD + "integer", None), ("1", "http://x/own", None), ("1.5", triples.XSD + "decimal", None), ("2e3", triples.XSD + "double", None), ("de", None, "de-1996"), ("\u05d0\U0001f600\t", None, None)}
    assert {r["o"] for r in rows if r["s"] == "http://x/b"} == {"http://x/c.x:one", "http://x/d"}
    by = {(r["s"], r["p"].removeprefix("http://x/")): r["o"] for r in rows}
    top = next(s for s, p in by if p == "after")
    inner = by[top, "p"]
    deep = [r["o"] for r in rows if r["s"] == inner]
    assert by[top, "s"] == "1" and len(deep) == 2 and sorted(p for s, p in by if s in deep) == ["r", "self"]
    assert len(bad.collect()) == 4
    graph = good.select("s", "p", "o", "o_kind", "o_lang", "o_datatype")
    turtle.to_turtle(graph, most=2).write.text(str(tmp_path / "again"))
    again, unread = turtle.read_turtle(spark, str(tmp_path / "again"))
    assert unread.isEmpty() and again.count() == graph.count() and blank_nodes.difference(graph, again).isEmpty()


def test_files_keep_their_own_blank_nodes(spark, tmp_path):
    from quire.sources import readers, turtle

    for name in ("a", "b"):
        (tmp_path / f"{name}.ttl").write_text(f'_:b1 <http://p> "{name}" .\n')
        (tmp_path / f"{name}.nt").write_text(f'_:b1 <http://p> "{name}"^^<http://t> .\n_:b1 <http://q> _:b2 . # why\n\n# no\nwrong\n<http://s> <http://p> "\\u05D0\\n"@he-x1 .\n')
    good, _ = turtle.read_turtle(spark, str(tmp_path / "*.ttl"))
    assert good.select("s").distinct().count() == 2
    good, bad = readers.read_ntriples(spark, str(tmp_path / "*.nt"))
    assert good.where("o_kind = 'blank'").select("s").distinct().count() == 2 and good.count() == 5 and [r["value"] for r in bad.collect()] == ["wrong", "wrong"]
    assert {r["o"] for r in good.where("o_lang = 'he-x1'").collect()} == {"\u05d0\n"} and {r["o_datatype"] for r in good.where("o in ('a', 'b')").collect()} == {"http://t"}
    again = triples.from_ntriples(triples.to_ntriples(good))
    assert again.exceptAll(good).isEmpty() and again.count() == good.count()


GRAPH = "s string, p string, o string, o_kind string, o_lang string, o_datatype string"


def _renamed(rows, rng):
    names = sorted({x for r in rows for x in (r[0], r[2]) if x.startswith("_:")})
    new = dict(zip(names, (f"_:n{k}" for k in rng.sample(range(1000), len(names))), strict=True))
    out = [(new.get(s, s), p, new.get(o, o), k, lang, t) for s, p, o, k, lang, t in rows]
    rng.shuffle(out)
    return out


def _random_graph(rng, shape):
    link = lambda a, b, p="p": (f"_:{a}", p, f"_:{b}", "blank", None, None)
    ring = lambda n, base=0: [link(base + i, base + (i + 1) % n) for i in range(n)]
    if shape == "rings":  # six in one ring, and twice three
        return ring(6) + ring(3, 10) + ring(3, 20)
    if shape == "twins":
        return [link("hub", i) for i in range(40)] + [(f"_:{i}", "v", "1", "literal", None, None) for i in range(40)]
    if shape == "copies":
        return [x for b in range(0, 60, 3) for x in (link(b, b + 1), link(b + 1, b + 2), (f"_:{b}", "v", str(b % 2), "literal", None, None))]
    return [link(rng.randrange(12), rng.randrange(12), rng.choice("pq")) for _ in range(25)] + [(f"_:{i}", "v", str(i % 3), "literal", None, "t" if i % 2 else None) for i in range(12)]


@pytest.mark.parametrize("shape", ["rings", "twins", "copies", "random"])
def test_equal_graphs_have_no_difference(spark, shape):
    rng = random.Random(shape)
    rows = sorted(set(_random_graph(rng, shape)))
    changed = [*rows[:-1], (*rows[-1][:1], "changed", *rows[-1][2:])]
    a, b, other = ({tuple(r) for r in blank_nodes.canonical(spark.createDataFrame(_renamed(x, rng), GRAPH)).collect()} for x in (rows, rows, changed))
    nodes = lambda g: {x for r in g for x in (r[0], r[2]) if x.startswith("_:")}
    assert a == b != other and len(a) == len(rows) and len(nodes(a)) == len(nodes(rows))


def test_rings_of_another_size_differ(spark):
    link = lambda a, b: (f"_:{a}", "p", f"_:{b}", "blank", None, None)
    six, threes = [link(i, (i + 1) % 6) for i in range(6)], [link(b + i, b + (i + 1) % 3) for b in (0, 3) for i in range(3)]
    a, b = spark.createDataFrame(six, GRAPH), spark.createDataFrame(threes, GRAPH)
    assert blank_nodes.difference(a, b).count() == 12
    assert blank_nodes.union(b, b).count() == 12
    assert blank_nodes.difference(a.where("false"), a.where("false")).isEmpty()


def test_shapes_by_real_datatypes(spark):
    rows = [("a", "type", "T", "uri", None, None), ("a", "n", "5", "literal", None, None), ("a", "n", "6", "literal", None, triples.XSD + "integer"), ("a", "n", "x", "literal", None, triples.XSD + "integer"), ("a", "n", "7", "literal", "en", None), ("a", "m", "_:b", "blank", None, None), ("a", "lo", "3", "literal", None, None), ("a", "hi", "2", "literal", None, None)]
    graph = spark.createDataFrame(rows, GRAPH)
    shapes = [triples.Shape("T", "n", "datatype", "integer"), triples.Shape("T", "n", "datatype", triples.XSD + "string"), triples.Shape("T", "m", "node_kind", "uri"), triples.Shape("T", "lo", "less_than", "hi"), triples.Shape("T", "none", "min_count", 1), triples.Shape("T", "n", "max_count", 3)]
    got = sorted((r["path"], r["kind"], r["value"] or "") for r in triples.violations(graph, shapes).collect())
    assert got == [("lo", "less_than", "3"), ("m", "node_kind", "_:b"), ("n", "datatype", "5"), ("n", "datatype", "6"), ("n", "datatype", "7"), ("n", "datatype", "7"), ("n", "datatype", "x"), ("n", "datatype", "x"), ("n", "max_count", ""), ("none", "min_count", "")]


def test_shared_folder_without_a_setting():
    code = "from pyspark.sql import SparkSession\nfrom quire.sources.shared import shared_dir, written\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert written(s.range(3), 't').count() == 3 and shared_dir(s) == shared_dir(s.newSession())\n"
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent), "SPARK_CONF_DIR": "/nonexistent"}
    assert subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, timeout=120).returncode == 0


def test_turtle_names_and_labels(spark, tmp_path):
    from quire.sources import turtle

    (tmp_path / "a.ttl").write_text('@prefix x: <http://x/> .\nx:a a x:Thing ; x:name "One \\"two\\" \\\\n"@en .\n')
    good, bad = turtle.read_turtle(spark, str(tmp_path / "a.ttl"))
    assert {(r["s"], r["p"], r["o"], r["o_lang"]) for r in good.collect()} == {("http://x/a", turtle.TYPE, "http://x/Thing", None), ("http://x/a", "http://x/name", 'One "two" \\n', "en")}
    assert bad.isEmpty()


def test_equal_names_are_cut_before_queries_meet_them(spark):
    from quire.operators import cascades

    names = spark.range(300).selectExpr("'jacob of fez' AS key", "id", "CASE WHEN id % 2 = 0 THEN '100' ELSE '400' END AS tag", "'990-1000' AS dates")
    asked = spark.createDataFrame([(i, "jacob of fez" if i % 2 else "jacob of fex", "996-1000" if i % 3 else None, None, "author") for i in range(40)], "query_id long, key string, record_dates string, year int, role string")
    exact = matching.exact_candidates(asked, names)
    assert exact.where("query_id = 1").count() == 8
    plan = exact._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the window is below the join: its input grows with the names, not with queries times names
    got = {r["query_id"]: (r["outcome"], r["id"]) for r in cascades.person(asked, names).collect()}
    assert len(got) == 40 and all(got[i] == (("matched", 0) if i % 2 else ("similar", 0)) for i in range(40) if i % 3)
    places = spark.range(300).selectExpr("id AS place_id", "'Q' || id AS qid", "array(CASE WHEN id = 7 THEN 'jacob of fex' ELSE 'x' END) AS main_keys")
    found = cascades.place(asked.select("query_id", "key"), names.select("key", F.col("id").alias("place_id")), places).where("query_id % 2 = 0")
    assert {(r["outcome"], r["id"]) for r in found.collect()} == {("similar", "Q7")}


def test_probe_keeps_every_candidate(spark):
    facts = spark.range(250).selectExpr("id", "'p' AS property", "'v' AS value").unionByName(spark.range(200, 250).selectExpr("id", "'q' AS property", "'w' AS value"))
    anchors = spark.createDataFrame([(1, "p", "v"), (1, "q", "w")], "query_id int, property string, value string")
    got = curation.probe(anchors, facts).collect()
    assert {r["id"] for r in got} == set(range(200, 250)) and not any(r["truncated"] for r in got)
    assert [r["truncated"] for r in curation.probe(anchors, facts, limit=220).collect()] == [True] * 20


def test_labels_leave_only_themselves_in_the_shared_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    chain = [(f"_:n{i}", "next", f"_:n{i + 1}", "blank", None) for i in range(4)] + [("_:n0", "name", "x", "literal", None)]
    rows = spark.createDataFrame(chain, "s string, p string, o string, o_kind string, o_lang string")
    before = {p.name for p in folder.iterdir()}
    found = blank_nodes.labels(rows)
    new = {p.name for p in folder.iterdir()} - before
    assert len(new) == 1 and found.count() == 5 and found.select("label").distinct().count() == 5


def test_what_orders_find_in_an_index_is_not_gathered(spark):
    from quire.plans import catalogue

    from .conftest import SMALL

    plan = catalogue.QUERIES["authority_index"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # before: one aggregate over every pair of an order and a record


def test_pairs_are_dealt_to_as_many_tasks_as_they_ask_for(spark):
    rng = random.Random(7)
    rows = [(b, rng.randrange(30)) for b in range(300) for _ in range(rng.randrange(6))] + [(-1, i) for i in range(60)] + [(b, i) for b in range(400, 600) for i in (1, 2)]
    rows += [(None, 1), (None, 2), (5, None), (700, 1)] + rows[:50]
    boxes = {}
    for b, i in rows:
        if b is not None and i is not None:
            boxes.setdefault(b, set()).add(i)
    counts = {}
    for items in boxes.values():
        for x in items:
            for y in items:
                if x < y:
                    counts[x, y] = counts.get((x, y), 0) + 1
    want = sorted(((x, y, n) for (x, y), n in counts.items()), key=lambda r: (-r[2], r[0], r[1]))
    members = spark.createDataFrame(rows, "box long, item long")
    found = analytics.co_occurrence(members, box="box", item="item", rows_of_a_task=100)
    assert [tuple(r) for r in found.collect()] == want[:1000] and max(counts.values()) > 200
    asked = -(-sum(counts.values()) // 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert asked > 20 and f"{asked}), REPARTITION_BY_NUM" in plan and "Join" not in plan  # not the 4 partitions of the session
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    assert [tuple(r) for r in analytics.co_occurrence(members, box="box", item="item", top=7).collect()] == want[:7]
    assert analytics.co_occurrence(members.limit(0), box="box", item="item").count() == 0

"""Indexes, mentions, spans, releases and single documents against plain versions."""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import mining, releases
from quire.sources import documents, imports, indexes, readers

XML = """<collection xmlns="http://www.loc.gov/MARC21/slim">
<record><controlfield tag="001">1</controlfield><datafield tag="100" ind1="1" ind2=" "><subfield code="a">Maimonides, Moses</subfield><subfield code="d">1138-1204</subfield></datafield>
<datafield tag="400" ind1=" " ind2=" "><subfield code="a">משה בן מיימון</subfield></datafield><datafield tag="035" ind1=" " ind2=" "><subfield code="a">x7</subfield></datafield></record>
<record><controlfield tag="001">2</controlfield><datafield tag="400" ind1=" " ind2=" "><subfield code="a">No heading</subfield></datafield></record>
<record><datafield tag="100" ind1=" " ind2=" "><subfield code="a">No number</subfield></datafield></record>
<record><controlfield tag="001">3</controlfield><datafield tag="151" ind1=" " ind2=" "><subfield code="a">Fès</subfield></datafield><datafield tag="100" ind1=" " ind2=" "><subfield code="a">second</subfield></datafield><datafield tag="451" ind1=" " ind2=" "><subfield code="b">no name</subfield></datafield></record>
</collection>"""


def test_authority_index_is_read_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    full, names = indexes.authority_tables(readers.read_marcxml(spark, str(tmp_path / "a.xml")))
    assert {(r["id"], r["kind"], r["main_tag"], r["name_he"], r["name_lat"], r["dates"], r["system_id"]) for r in full.collect()} == {("1", "person", "100", "משה בן מיימון", "Maimonides, Moses", "1138-1204", "x7"), ("3", "place", "151", None, "Fès", None, None)}
    assert {(r["key"], r["id"], r["script"]) for r in names.collect()} == {("maimonides moses", "1", "lat"), ("משה בן מיימון", "1", "he"), ("fes", "3", "lat"), ("second", "3", "lat")}
    path = f"file://{tmp_path}/index"
    index = indexes.store(names, "names_of_test", path, buckets=4)
    queries = spark.createDataFrame([(1, "fes"), (2, "fes"), (3, "none"), (4, "")], "q int, key string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = indexes.look_up(queries, index)
        assert sorted((r["q"], r["id"]) for r in found.collect()) == [(1, "3"), (2, "3")]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        physical = queries.select("key").distinct().join(index, "key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange in all, that of what is asked: the index is read bucket by bucket
    assert "Join" in plan and "Bucketed: true" in physical and physical.count("Exchange ") == physical.count("Exchange hashpartitioning(key") == 1
    spark.sql("DROP TABLE names_of_test")
    again = indexes.open_index(spark, "names_again", path, "key string, id string, kind string, script string, tag string, dates string", buckets=4)
    assert again.count() == 4
    spark.sql("DROP TABLE names_again")


def plain_mentions(texts, entries):
    out = set()
    for key, text in texts:
        words = mining.words_of(text or "")
        for entry, phrase in entries:
            terms = [w for w, _, _ in mining.words_of(phrase or "")]
            for i in range(len(words) - len(terms) + 1 if terms else 0):
                for n in range(4):
                    first = words[i][0]
                    if first[n:] == terms[0] and len(first[:n]) == n and re.fullmatch(f"[{mining.PREFIXES}]*", first[:n]) and [w for w, _, _ in words[i + 1 : i + len(terms)]] == terms[1:]:
                        out.add((key, entry, words[i][1], words[i + len(terms) - 1][2], first[:n]))
    return out


def test_mentions_equal_plain_search(spark):
    rng = random.Random(2)
    vocabulary = ["משנה", "תורה", "ובמשנה", "שבת", "ושבת", "ה", "A", "b'c", "Über", "מִשְׁנָה", "ו"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(14)))) for i in range(60)] + [(90, None), (91, "  "), (92, 'x "משנה"  תורה, בבמשנה. תורה')]
    entries = [(1, "משנה תורה"), (2, "משנה"), (3, "תורה"), (4, "שבת"), (5, "A b'c Über"), (6, "b'c"), (7, ""), (8, None), (9, "ה"), (10, "משנה"), (11, "שבת שבת")]
    edges, ends = mining.trie(spark.createDataFrame(entries, "entry int, phrase string"))
    got = {tuple(r) for r in mining.mentions(spark.createDataFrame(texts, "id int, text string"), edges, ends).select("id", "entry", "start", "end", "prefix").collect()}
    assert got == plain_mentions(texts, entries) and len(got) > 60
    assert mining.mentions(spark.createDataFrame([], "id int, text string"), edges, ends).count() == 0


def test_words_that_are_in_no_phrase_are_neither_written_nor_shuffled(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    rest = " ".join(f"w{i}" for i in range(3000))
    texts = spark.createDataFrame([(i, f"{rest} big red fox {rest} big red") for i in range(4)], "id int, text string")
    edges, ends = mining.trie(spark.createDataFrame([(1, "red fox"), (2, "big red fox"), (3, "Red  fox"), (4, "big cat")], "entry int, phrase string"))
    found = mining.mentions(texts, edges, ends)
    assert found.groupBy("entry").count().sort("entry").collect() == [(1, 4), (2, 4), (3, 4)]
    assert {p.name.split("-")[1] for p in set(shared.iterdir()) - before} == {"edges", "ends"}
    assert mining.candidates(texts, mining.marks(edges), mining.marks(ends), "id", "text").count() < 400  # of 24,000 words; some hashes fall together
    assert mining.mentions(texts, edges.limit(0), ends.limit(0)).count() == 0


def test_mentions_do_not_depend_on_the_size_of_the_bits(spark, monkeypatch):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=40))) for i in range(20)]
    entries = [(i, " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 5)))) for i in range(400)]
    monkeypatch.setattr(mining, "MOST_BITS", 1 << 7)  # nearly all bits are set
    edges, ends = mining.trie(spark.createDataFrame(entries, "entry int, phrase string"))
    got = [tuple(r) for r in mining.mentions(spark.createDataFrame(texts, "id int, text string"), edges, ends).select("id", "entry", "start", "end", "prefix").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_mentions(texts, entries)


def test_texts_that_share_a_key_are_not_mixed(spark):
    edges, ends = mining.trie(spark.createDataFrame([(1, "a b")], "entry int, phrase string"))
    texts = spark.createDataFrame([(1, "a x"), (1, "c b"), (2, "a b"), (2, "a b")], "id int, text string")
    assert [(r["id"], r["entry"]) for r in mining.mentions(texts, edges, ends).collect()] == [(2, 1), (2, 1)]


def test_settled_spans(spark):
    rows = [(1, i, a, b, p) for i, (a, b, p) in enumerate([(0, 10, 1), (2, 4, 2), (4, 6, 1), (10, 12, 1), (10, 12, 1), (5, 5, 9), (7, 9, 0)])] + [(2, 0, 3, 5, 0)]
    got = {(r["id"], r["span"]) for r in mining.settled(spark.createDataFrame(rows, "id int, span int, start int, end int, priority int")).collect()}
    # the long one loses to what it holds of higher priority, so what it covered is free again
    assert got == {(1, 1), (1, 2), (1, 3), (1, 6), (2, 0)}


def test_release_digests_locate_a_change(spark):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    other = rows.withColumn("v", F.when(F.col("key") == "77", "new").otherwise(F.col("v"))).repartition(3)
    a, b = releases.entity_digests(rows, "key"), releases.entity_digests(other, "key")
    x, y = releases.tree(a), releases.tree(b)
    assert releases.release_digest(x, {}) != releases.release_digest(y, {}) and releases.release_digest(x, {}) == releases.release_digest(releases.tree(a.repartition(9)), {}) != releases.release_digest(x, {"a": "b"})
    assert [tuple(r) for r in releases.changed(a, b, x, y).collect()] == [("77", "changed")]
    apart = {r["level"]: r["n"] for r in x.join(y.withColumnRenamed("digest", "other"), ["level", "node"]).where("digest <> other").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert apart == {level: 1 for level in range(releases.LEVELS + 1)}
    none = releases.tree(a.where("false"))
    assert none.count() == 0 and releases.release_digest(none, {}) and releases.changed(a.where("false"), b, none, y).count() == 4000


def test_bad_rows_do_not_stop_a_load(spark, tmp_path):
    fields = [imports.Field("id", "integer"), imports.Field("name", required=True), imports.Field("day", "date"), imports.Field("ok", "boolean"), imports.Field("absent", "number")]
    rows = [(1, " 1 ", "a", "2020-02-30", "yes"), (2, "x", "", None, "maybe"), (3, "3", "c", "2020-02-29", ""), (4, "3", "d", None, "FALSE"), (5, None, "e", None, None)]
    good, bad = imports.checked(spark.createDataFrame(rows, "line int, id string, name string, day string, ok string"), fields, ["id"])
    assert [tuple(r) for r in good.collect()] == [(3, "d", None, False, None)]
    assert {r["line"]: r["reasons"] for r in bad.collect()} == {1: ["day: no date"], 2: ["id: no integer", "name: missing", "ok: no boolean"], 3: ["repeated"], 5: ["id: missing"]}
    store = imports.Store(spark, f"file://{tmp_path}/s", "id long, name string, day date, ok boolean, absent double")
    assert store.version() == 0 and store.read().count() == 0
    assert store.upsert(good) == {"added": 1, "changed": 0, "same": 0, "version": 1} and store.upsert(good) == {"added": 0, "changed": 0, "same": 1, "version": 1}
    assert store.upsert(good.withColumn("name", F.lit("new")).unionByName(good.withColumn("id", F.lit(9).cast("long")))) == {"added": 1, "changed": 1, "same": 0, "version": 2}
    assert {r["id"]: r["name"] for r in store.read().collect()} == {3: "new", 9: "d"} and store.read(1).first()["name"] == "d"
    (tmp_path / "s" / "half-written").mkdir()
    assert store.read().count() == 2


@pytest.mark.parametrize("n", [0, 1, 300])
def test_documents_are_valid_and_resume(spark, tmp_path, n):
    items = spark.createDataFrame([(i, f'say "{i}"', None) for i in range(n)], "id int, text string, nothing int")
    path = f"file://{tmp_path}/doc"
    whole = lambda: "".join(Path(f.removeprefix("file:")).read_text() for f, _, _ in documents.offsets(spark, path))
    write = lambda **more: documents.write_document(items, path, order=["id"], header={"name": "é", "n": n} | more, parts=5)
    assert write() == [0, 1, 2, 3, 4]
    first = whole()
    assert json.loads(first) == {"name": "é", "n": n, "items": [{"id": i, "text": f'say "{i}"', "nothing": None} for i in range(n)]}
    at = documents.offsets(spark, path)
    assert [a for _, a, _ in at] == [sum(k for *_, k in at[:i]) for i in range(len(at))] and sum(k for *_, k in at) == len(first.encode())
    (tmp_path / "doc" / "parts" / "00003" / "_SUCCESS").unlink()
    assert write() == [3] and whole() == first and write() == []
    with pytest.raises(ValueError):
        write(other=1)


def test_history_of_one_entity(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "x", "create", "2020"), (2, "a", "y", "patch", "2019"), (3, "b", "x", "create", "2018")], "id int, entity_type string, entity_id string, op string, created_at string")
    path = f"file://{tmp_path}/h"
    documents.export_history(events, path, project="p", entity_type="a", entity_id="x")
    text = "".join(Path(f.removeprefix("file:")).read_text() for f, _, _ in documents.offsets(spark, path))
    assert json.loads(text) == {"project_id": "p", "entity_type": "a", "entity_id": "x", "event_count": 1, "events": [{"id": 1, "entity_type": "a", "entity_id": "x", "op": "create", "created_at": "2020"}]}
    with pytest.raises(ValueError):
        documents.export_history(events, path, project="p", entity_type="a")


def test_usual_lines_and_statements_are_read_once(spark, tmp_path):
    """a line's groups come from one search, and statements without brackets are read without the stack, to the same triples."""
    from quire.operators import triples
    from quire.sources import turtle

    lines = ['_:a <p> "x \\" y"@en-GB . # c', '_:a <p> "1"^^<t> .', '<s> <p> <> .', '<s> <p> "" .', '<s> <p> "a b  c" .', "<s> <p> _:b .", '_:a<p>"^^<no>"^^<t>.']
    good, bad = triples.parsed_ntriples(spark.createDataFrame([(x,) for x in lines], "value string"))
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract(" not in plan and bad.isEmpty()
    rows = {tuple(r) for r in good.collect()}
    assert rows == {
        ("_:a", "p", 'x " y', "literal", "en-GB", None), ("_:a", "p", "1", "literal", None, "t"), ("s", "p", "", "uri", None, None), ("s", "p", "", "literal", None, None),
        ("s", "p", "a b  c", "literal", None, None), ("s", "p", "_:b", "blank", None, None), ("_:a", "p", "^^<no>", "literal", None, "t"),
    }

    flat = ['<a> <p> <b>, "x ; y , z"@en ; <q> 1, 1.5 , 2e3, true, _:n', "_:m a <t>", '<a> <p> "v"^^<w>', '<a> <p> "\\u00e9", <http://x/y;z,1>']
    other = ["<a> <p> [ <q> 1 ]", "<a> <p> <b> ;", "<a> <p> <b> ,", "<a> <p>", "<a>", '"a" <p> <b>', "<a> _:p <b>", "<a> <p> <b> <c>", "<a> <p> (1 2)", "<a> <p> x:y", "<a> <p> <b> , , <c>", "<a\n;\n> <p> <b>"]
    names = F.expr("cast(map() as map<string,string>)")
    terms = F.regexp_extract_all("value", F.lit(turtle.TERMS), F.lit(0))
    out = spark.createDataFrame([(x,) for x in flat + other], "value string").repartition(2)
    out = {r[0]: r for r in out.select("value", turtle._flat(terms, names, F.lit("_:f0.")), turtle._triples(F.col("value"), names, F.lit("file"))).collect()}
    assert [len(out[x][1]) for x in flat] == [7, 1, 1, 2] and [len(out[x][2]) for x in flat] == [7, 1, 1, 2]
    assert all(out[x][1] is None for x in other if x != "<a> <p> (1 2)") and out["<a> <p> (1 2)"][2] is None
    assert [x for x in other if out[x][2] is not None] == ["<a> <p> [ <q> 1 ]", "<a> <p> <b> ;", "<a\n;\n> <p> <b>"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_statements_are_one_before_they_are_spelled_out(spark):
    """the graph has each triple once without a shuffle of all triples; two ids of one subject are one item."""
    from quire.operators import item_graph

    address = item_graph.ENTITY + "Q1"
    snaks = "array<struct<property:string,value:string>>"
    block, other = [("P8", "x"), ("P8", "x")], [("P7", "y")]
    rows = [(i, "P1", v, n, r, [("P9", "1"), ("P9", "1")], [block, other, block]) for i in ("Q1", address) for v, n, r in (("Q2", None, "normal"), ("Q2", None, None), ("a", 1.0, "preferred"), ("b", 1.0, "preferred"))]
    statements = spark.createDataFrame(rows, f"id string, property string, value string, number double, rank string, qualifiers {snaks}, references array<{snaks}>")
    items = spark.createDataFrame([("Q1", {"en": "n"}, {}), (address, {"en": "n"}, {})], "id string, labels map<string,string>, descriptions map<string,string>")
    graph, _ = item_graph.item_graph(items, statements)
    found = [tuple(r) for r in graph.collect()]
    assert graph._jdf.queryExecution().optimizedPlan().nodeName() == "Union" and len(found) == len(set(found))
    # a label; three statements of three own triples, a qualifier and two references; two snaks of the references; one direct triple
    assert len(found) == 1 + 3 * 6 + 2 + 1 and [f[2] for f in found if f[1] == "wdt:P1"] == ["1"]


def test_small_tables_have_a_size(spark):
    """F16, F19, F20: the fields of a mapping and the shapes of a check are literals, so that no table is sorted to meet them, and records need no window."""
    from quire.operators import projection, triples
    from quire.plans import records
    from quire.plans.registry import Tables

    from .conftest import SMALL

    assert [tuple(r) for r in projection.mapping(spark).collect()] == list(projection.FIELDS)
    assert "LogicalRDD" not in _plan(projection.mapping(spark)) and "Window" not in _plan(records._records(Tables(spark, SMALL)))
    graph = spark.sql("SELECT * FROM VALUES ('a', 'type', 'T', 'uri'), ('a', 'by', 'b', 'uri'), ('a', 'n', '7', 'literal'), ('a', 'm', '5', 'literal'), ('b', 'type', 'U', 'uri') AS t(s, p, o, o_kind)")
    shape = triples.Shape
    shapes = [shape("T", "by", "class", "U"), shape("T", "by", "class", "V"), shape("T", "n", "less_than", "m"), shape("T", "m", "less_than", "n"), shape("T", "n", "in", ["6", "8"]), shape("T", "n", "max_value", 7)]
    broken = triples.violations(graph, shapes)
    assert "LogicalRDD" not in _plan(broken)
    assert sorted(tuple(r) for r in broken.collect()) == [("a", "by", "class", "b"), ("a", "n", "in", "7"), ("a", "n", "less_than", "7")]
    assert triples.violations(graph, []).isEmpty()

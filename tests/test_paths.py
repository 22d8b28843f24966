"""Regular paths on random graphs against relations of plain sets."""

from __future__ import annotations

import random

import pytest

from quire.operators import paths
from quire.operators.paths import Path, either, inverse, maybe, none_of, plus, sequence, star, step

GRAPH = "s string, p string, o string, o_kind string"


def random_graph(rng):
    rows = {(f"n{rng.randrange(9)}", rng.choice("pqr"), f"n{rng.randrange(9)}", "uri") for _ in range(16)}
    return sorted(rows | {(f"n{rng.randrange(9)}", rng.choice("pq"), f"n{rng.randrange(3)}", "literal") for _ in range(4)})


def relation(x: Path, rows, nodes):
    pairs = {((s, "resource"), p, (o, "literal" if k == "literal" else "resource")) for s, p, o, k in rows}
    join = lambda a, b: {(i, k) for i, j in a for m, k in b if j == m}
    if x.kind in ("step", "none"):
        return {(s, o) for s, p, o in pairs if (p in x.names) != (x.kind == "none")}
    parts = [relation(p, rows, nodes) for p in x.parts]
    if x.kind == "inverse":
        return {(b, a) for a, b in parts[0]}
    if x.kind == "either":
        return set().union(*parts)
    out = {(n, n) for n in nodes}
    if x.kind == "sequence":
        for part in parts:
            out = join(out, part)
        return out
    while True:
        more = out | join(out, parts[0])
        if more == out:
            return out
        out = more


PATHS = [
    star(step("p")), plus(either(step("p"), inverse(step("q")))), sequence(maybe(step("p")), star(sequence(step("q"), step("r")))), inverse(sequence(step("p"), star(step("q")))),
    star(none_of("p")), inverse(none_of("q", "r")), sequence(), star(star(maybe(step("r")))), either(sequence(step("p"), step("p")), star(inverse(step("r")))),
]


@pytest.mark.parametrize("n", range(len(PATHS)))
def test_paths_equal_plain_relations(spark, n):
    rng = random.Random(n)
    rows, path = random_graph(rng), PATHS[n]
    graph = spark.createDataFrame(rows, GRAPH)
    nodes = {(s, "resource") for s, *_ in rows} | {(o, "literal" if k == "literal" else "resource") for *_, o, k in rows}
    want = {(a[0], a[1], *b) for a, b in relation(path, rows, nodes)}
    got = {(r["s"], r["o"], r["o_kind"]) for r in paths.connected(graph, path).collect()}
    assert got == {(s, o, k) for s, _, o, k in want}
    starts, ends = spark.createDataFrame([("n1",), ("n2",)], "s string"), spark.createDataFrame([("n0",), ("n2",)], "o string")
    begun = {(r["s"], r["o"], r["o_kind"]) for r in paths.connected(graph, path, starts=starts).collect()}
    empty = {(x, x, "resource") for x in ("n1", "n2")} if (("x",) * 2) in relation(path, [], {"x": 0} and {("x")}) else set()
    assert begun == {(s, o, k) for s, kind, o, k in want if s in ("n1", "n2") and kind == "resource"} | empty
    assert {(r["s"], r["o"]) for r in paths.connected(graph, path, starts=starts, ends=ends).collect()} == {(s, o) for s, o, _ in begun if o in ("n0", "n2")}
    ended = {(r["s"], r["o"], r["o_kind"]) for r in paths.connected(graph, path, ends=ends).collect()}
    assert ended >= {(s, o, k) for s, _, o, k in want if o in ("n0", "n2")}


def test_bindings_of_a_path(spark):
    graph = spark.createDataFrame([("a", "p", "b", "uri"), ("b", "p", "a", "uri"), ("c", "p", "c", "uri"), ("c", "q", "lit", "literal")], GRAPH)
    bound = lambda s, x, o: sorted(map(tuple, paths.path_pattern(graph, s, x, o).collect()))
    assert bound("?x", plus(step("p")), "?x") == [("a",), ("b",), ("c",)]
    assert bound("a", sequence(step("p"), step("p")), "?y") == [("a",)]
    assert bound("?x", sequence(star(step("p")), step("q")), "lit") == [("c",)]
    assert paths.path_pattern(graph, "a", plus(step("p")), "c").count() == 0 and paths.path_pattern(graph, "a", plus(step("p")), "b").count() == 1
    assert bound("nobody", star(step("p")), "?y") == [("nobody",)]

"""Regular property paths: a path becomes a small automaton whose states walk with the frontier.

Paths are built with functions: ``step("p")``, ``inverse(x)``, ``sequence(x, y)``, ``either(x, y)``, ``star(x)``, ``plus(x)``, ``maybe(x)``, ``none_of("p", "q")``. Each round joins the
newest (origin, node, state) rows with the graph's moves and keeps what was not seen before, so cycles end and a walk starts from the bound side only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import written

COMPACT = 16


@dataclass(frozen=True)
class Path:
    """``kind``: ``step`` and ``none`` (of ``names``), ``sequence``, ``either``, ``star``, or ``inverse`` (of ``parts``)."""

    kind: str
    names: tuple[str, ...] = ()
    parts: tuple[Path, ...] = ()


def step(p: str) -> Path:
    return Path("step", (p,))


def none_of(*names: str) -> Path:
    return Path("none", names)


def inverse(x: Path) -> Path:
    return Path("inverse", parts=(x,))


def sequence(*parts: Path) -> Path:
    return Path("sequence", parts=parts)


def either(*parts: Path) -> Path:
    return Path("either", parts=parts)


def star(x: Path) -> Path:
    return Path("star", parts=(x,))


def plus(x: Path) -> Path:
    return sequence(x, star(x))


def maybe(x: Path) -> Path:
    return either(x, sequence())


@dataclass
class Automaton:
    """Moves (state, names, whether the names are those left out, whether backwards, next state) and states, without empty moves."""

    moves: list[tuple[int, tuple[str, ...], bool, bool, int]]
    first: set[int]
    last: set[int]

    def reversed(self) -> Automaton:
        return Automaton([(n, names, out, not back, s) for s, names, out, back, n in self.moves], self.last, self.first)


def automaton(path: Path) -> Automaton:
    """States of ``path``; empty moves are closed over at the end."""
    moves: list = []
    empty: dict[int, set[int]] = {}
    count = iter(range(1 << 30))

    def build(x: Path, back: bool) -> tuple[int, int]:
        a, b = next(count), next(count)
        if x.kind in ("step", "none"):
            moves.append((a, x.names, x.kind == "none", back, b))
        elif x.kind == "inverse":
            i, j = build(x.parts[0], not back)
            empty.setdefault(a, set()).add(i)
            empty.setdefault(j, set()).add(b)
        elif x.kind == "sequence":
            at = a
            for part in reversed(x.parts) if back else x.parts:
                i, j = build(part, back)
                empty.setdefault(at, set()).add(i)
                at = j
            empty.setdefault(at, set()).add(b)
        elif x.kind == "either":
            for part in x.parts:
                i, j = build(part, back)
                empty.setdefault(a, set()).add(i)
                empty.setdefault(j, set()).add(b)
        else:
            i, j = build(x.parts[0], back)
            empty.setdefault(a, set()).update((i, b))
            empty.setdefault(j, set()).update((i, b))
        return a, b

    first, last = build(path, False)

    def reach(state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for n in empty.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    closed = {(s, names, out, back, m) for s, names, out, back, n in moves for m in reach(n)}
    return Automaton(sorted(closed), reach(first), {last})


def _moves(triples: DataFrame, machine: Automaton) -> DataFrame:
    """``node, kind, state, to, to_kind, next`` for every triple that a move can take."""
    kind = F.when(F.col("o_kind") == "literal", "literal").otherwise("resource")
    graph = triples.select(F.col("s"), F.lit("resource").alias("s_kind"), "p", F.col("o"), kind.alias("o_kind"))
    rows = []
    for state, names, left_out, back, after in machine.moves:
        some = graph.where(~F.col("p").isin(*names) if left_out else F.col("p").isin(*names))
        a, b = ("o", "s") if back else ("s", "o")
        rows.append(some.select(F.col(a).alias("node"), F.col(f"{a}_kind").alias("kind"), F.lit(state).alias("state"), F.col(b).alias("to"), F.col(f"{b}_kind").alias("to_kind"), F.lit(after).alias("next")))
    if not rows:
        return graph.where("false").select(F.col("s").alias("node"), F.col("s_kind").alias("kind"), F.lit(0).alias("state"), F.col("o").alias("to"), F.col("o_kind").alias("to_kind"), F.lit(0).alias("next"))
    return reduce(lambda a, b: a.unionByName(b), rows).distinct()


def _walk(triples: DataFrame, machine: Automaton, starts: DataFrame) -> DataFrame:
    """``origin, origin_kind, node, kind`` of all that a walk from ``starts`` (``node``, ``kind``) comes to in a last state."""
    moves = written(_moves(triples, machine), "moves")
    states = F.explode(F.array(*(F.lit(s) for s in sorted(machine.first))))
    new = starts.distinct().select(F.col("node").alias("origin"), F.col("kind").alias("origin_kind"), "node", "kind", states.alias("state"))
    known = new = written(new, "walk")
    rounds = 0
    while not new.isEmpty():
        stepped = new.join(moves, ["node", "kind", "state"]).select("origin", "origin_kind", F.col("to").alias("node"), F.col("to_kind").alias("kind"), F.col("next").alias("state")).distinct()
        new = written(stepped.join(known, stepped.columns, "left_anti"), "walk")
        known, rounds = known.unionByName(new), rounds + 1
        if rounds % COMPACT == 0:  # a union of few tables, however many rounds
            known = written(known, "walk")
    return known.where(F.col("state").isin(*machine.last)).select("origin", "origin_kind", "node", "kind").distinct()


def _nodes(triples: DataFrame) -> DataFrame:
    kind = F.when(F.col("o_kind") == "literal", "literal").otherwise("resource")
    return triples.select(F.col("s").alias("node"), F.lit("resource").alias("kind")).union(triples.select("o", kind)).distinct()


def connected(triples: DataFrame, path: Path, *, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """``s``, ``o``, ``o_kind`` (``resource`` or ``literal``) of the ends of a path.

    With ``starts`` (a column ``s``) or ``ends`` (a column ``o``) the walk begins there; with both it begins at the starts and keeps those ends. A start or end that the graph does not
    have is still its own end of an empty path. With neither, every node of the graph is a start.
    """
    machine = automaton(path)
    resource = lambda df, c: df.select(F.col(c).alias("node"), F.lit("resource").alias("kind"))
    if starts is None and ends is not None:
        literals = _nodes(triples).where("kind = 'literal'").join(ends.select(F.col("o").alias("node")), "node", "left_semi")
        walked = _walk(triples, machine.reversed(), resource(ends, "o").unionByName(literals))
        return walked.select(F.col("node").alias("s"), F.col("origin").alias("o"), F.col("origin_kind").alias("o_kind"))
    begin = resource(starts, "s") if starts is not None else _nodes(triples)
    found = _walk(triples, machine, begin).select(F.col("origin").alias("s"), F.col("node").alias("o"), F.col("kind").alias("o_kind"))
    return found.join(ends.select("o").distinct(), "o", "left_semi").select("s", "o", "o_kind") if ends is not None else found


def path_pattern(triples: DataFrame, s: str, path: Path, o: str) -> DataFrame:
    """Bindings of a path between two terms, as ``triples.pattern`` has them for one verb: parts that start with ``?`` are variables."""
    spark = triples.sparkSession
    bound = lambda term, c: None if term.startswith("?") else spark.createDataFrame([(term,)], f"{c} string")
    rows = connected(triples, path, starts=bound(s, "s"), ends=bound(o, "o"))
    if s.startswith("?") and s == o:
        rows = rows.where((F.col("s") == F.col("o")) & (F.col("o_kind") == "resource"))
    names = {term[1:]: c for c, term in (("s", s), ("o", o)) if term.startswith("?")}
    return rows.select(*(F.col(c).alias(n) for n, c in names.items())).distinct()

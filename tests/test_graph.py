"""Graphs against plain versions; long chains in few rounds."""

import random

from storylake.operators import graph, html


def edges_of(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src int, dst int")


def plain_levels(nodes, pairs):
    left, level, out = set(nodes), 0, {}
    while ready := {n for n in left if not any(s == n and d in left for s, d in pairs)}:
        out |= dict.fromkeys(ready, level)
        left, level = left - ready, level + 1
    return out


def reach(pairs):
    ahead = {}
    for s, d in pairs:
        ahead.setdefault(s, set()).add(d)
    out = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = set(), [n]
        while todo:
            for d in ahead.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        out[n] = seen
    return out


def graphs():
    rnd = random.Random(9)
    dag = {(max(a, b), min(a, b)) for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(70)) if a != b}
    k3 = {(a, b) for a in (50, 51, 52) for b in (50, 51, 52) if a != b}
    loops = {(60, 61), (61, 62), (62, 60), (63, 60), (61, 64), (65, 65), (66, 65), (70, 71), (71, 72), (72, 71), (62, 70)}
    return [dag, dag | k3 | loops | {(3, 50), (52, 7)}]


def test_levels_redundancy_and_cycles(spark):
    for pairs in graphs():
        edges, nodes = edges_of(spark, pairs), sorted({x for p in pairs for x in p} | {99})
        found = graph.levels(spark.createDataFrame([(n,) for n in nodes], "node int"), edges.union(edges_of(spark, [(1, 500)])))
        assert {r.node: r.level for r in found.collect()} == plain_levels(nodes, pairs)
        far = reach(pairs)
        want = {(s, d, o) for s, d in pairs for s2, o in pairs if s == s2 and o != d and d in far[o]}
        assert {tuple(r) for r in graph.redundant(edges).collect()} == want
        parts = {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}
        assert {r.node: r.component for r in graph.strong_components(edges).collect()} == parts


def test_cycle_paths(spark):
    found = {(r.component, r.n): r.path for r in graph.cycle_paths(edges_of(spark, graphs()[1])).collect()}
    assert found[(60, 0)] == [60, 61, 62, 60] and found[(65, 0)] == [65, 65] and found[(71, 0)] == [71, 72, 71]
    assert [p for (c, _), p in sorted(found.items()) if c == 50] == [[50, 51, 50], [50, 51, 52, 50], [51, 52, 51]]
    assert graph.cycle_paths(edges_of(spark, [(1, 2), (2, 3)])).count() == 0


def test_a_long_chain_and_a_ladder_take_few_rounds(spark, monkeypatch):
    written = []
    real = graph.Rounds.settled
    monkeypatch.setattr(graph.Rounds, "settled", lambda self, df: written.append(1) or real(self, df))
    n = 10_000
    chain = spark.range(1, n).selectExpr("cast(id as int) AS src", "cast(id - 1 as int) AS dst")
    for edges in (chain, chain.union(chain.where("src > 1").selectExpr("src", "dst - 1"))):
        written.clear()
        found = graph.levels(spark.range(n).selectExpr("cast(id as int) AS node"), edges)
        assert found.where("node <> level").count() == 0 and found.count() == n and len(written) <= 20


def test_links_of_a_long_chain(spark, monkeypatch):
    written = []
    real = html.Rounds.settled
    monkeypatch.setattr(html.Rounds, "settled", lambda self, df: written.append(1) or real(self, df))
    links = [(f"p{i}", f"p{i + 1}") for i in range(700)] + [("a", "b"), ("b", "c"), ("c", "b"), ("z", "nowhere"), ("n", None)]
    starts = [("p0",), ("p650",), ("a",), ("z",), ("n",)]
    found = html.link_order(spark.createDataFrame(links, "url string, next_url string"), spark.createDataFrame(starts, "url string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.depth):
        got.setdefault(r.start, []).append(r.url)
    assert got["p0"] == [f"p{i}" for i in range(700)] and got["p650"] == [f"p{i}" for i in range(650, 700)]
    assert got["a"] == ["a", "b", "c"] and got["z"] == ["z"] and got["n"] == ["n"] and len(written) <= 26


def test_rings_are_told_by_their_size_and_small_components_share_a_call(spark, monkeypatch):
    written, rings = [], 400
    real = graph.Rounds.settled
    monkeypatch.setattr(graph.Rounds, "settled", lambda self, df: written.append(1) or real(self, df))
    size = lambda i: 3 + i % 5
    pairs = {(10 * i + j, 10 * i + (j + 1) % size(i)) for i in range(1, rings + 1) for j in range(size(i))}
    edges = edges_of(spark, pairs | {(10 * i + 2, 1) for i in range(1, rings + 1)})
    nodes = spark.createDataFrame(sorted({(n,) for p in pairs for n in p} | {(1,)}), "node int")
    assert [tuple(r) for r in graph.levels(nodes, edges).collect()] == [(1, 0)] and len(written) <= 8
    found = {r.component: r.path for r in graph.cycle_paths(edges).collect()}
    assert found == {10 * i: [*range(10 * i, 10 * i + size(i)), 10 * i] for i in range(1, rings + 1)}


def test_closure_deals_pairs_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "DEALT", 50)
    for pairs in graphs():
        found = graph.closure(edges_of(spark, pairs))
        want = {(s, d) for s, far in reach(pairs).items() for d in far}
        assert {tuple(r) for r in found.collect()} == want and len(found.inputFiles()) >= len(want) / 50

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from factloom.operators import graph


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ids(frame, col="node"):
    return {r[col] for r in frame.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_against_union_find(spark, pairs):
    root = {n: n for p in pairs for n in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    got = {r.node: r.component for r in graph.connected_components(df(spark, pairs, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}


def test_components_of_a_long_chain(spark):
    e = spark.range(200).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in graph.connected_components(e).collect()} == {0}


def test_reverse_closure_and_cycles(spark):
    e = df(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), (None, "a")], "src string, dst string")
    reach = lambda *s: ids(graph.reverse_closure(e, df(spark, [(x,) for x in s], "node string")))
    assert reach("c") == {"a", "b", "c"}
    assert reach("x") == {"x", "y"} and reach("lone") == {"lone"}


def test_bounded_bfs_levels(spark):
    e = df(spark, [(0, 1), (1, 2), (2, 3), (0, 2)], "src long, dst long")
    got = {r.node: r.level for r in graph.bounded_bfs(e, df(spark, [(0,)], "node long"), 2).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2}
    one = {r.node: r.level for r in graph.bounded_bfs(e, df(spark, [(0,)], "node long"), 2, per_level=1).collect()}
    assert one[1] == 1 and one[2] == 2


def test_virtual_families(spark):
    calls = df(spark, [("dispatch", "Add")], "caller string, callee string")
    pairs = df(spark, [("Add", "Base"), ("Mult", "Base")], "ov string, base string")
    keys = df(spark, [("dispatch",), ("Add",), ("Mult",)], "fid string")
    out = graph.spread_families(calls, pairs, keys)
    assert {(r.caller, r.callee) for r in out.collect()} == {("dispatch", "Add"), ("dispatch", "Mult")}
    assert {(r.caller, r.callee) for r in graph.spread_families(out, pairs, keys).collect()} == {("dispatch", "Add"), ("dispatch", "Mult")}
    chain = df(spark, [("Mult", "Add"), ("Add", "Base")], "ov string, base string")
    assert graph.spread_families(calls, chain, keys).count() == 2
    assert graph.spread_families(calls, pairs, df(spark, [("dispatch",), ("Add",)], "fid string")).count() == 1


def test_propagated_access(spark):
    calls = df(spark, [("a", "b"), ("b", "c"), ("c", "c")], "caller string, callee string")
    facts = df(spark, [("c", "g", "w"), ("b", "h", "r")], "fid string, gid string, mode string")
    got = {tuple(r) for r in graph.propagate_facts(calls, facts, ("gid", "mode")).collect()}
    assert got == {("c", "g", "w"), ("b", "g", "w"), ("a", "g", "w"), ("b", "h", "r"), ("a", "h", "r")}


def test_levels_release_a_cycle_at_once(spark):
    n = df(spark, [(x,) for x in "abcd"], "node string")
    e = df(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "src string, dst string")
    assert {r.node: r.level for r in graph.topological_levels(n, e).collect()} == {"d": 0, "a": 1, "b": 1, "c": 1}


def test_flow_graph_validation(spark):
    nodes = df(spark, [(1, "s", "START", ""), (1, "a", "ACTION", " "), (1, "z", "ACTION", "x"), (2, "s", "START", ""), (2, "e", "END", "")], "fkey long, node_id string, type string, label string")
    edges = df(spark, [(1, "s", "a"), (1, "a", "q"), (2, "s", "e")], "fkey long, source string, target string")
    got = {tuple(r) for r in graph.validate_flow_graph(nodes, edges).collect()}
    assert got == {(1, "no end", None), (1, "dangling edge", "q"), (1, "empty label", "a"), (1, "unreachable", "z")}


def test_tree_order(spark):
    n = df(spark, [("r", None, 1), ("b", "r", 2), ("a", "r", 1), ("c", "b", 1)], "id string, parent string, ord int")
    assert [r.id for r in graph.tree_order(n).orderBy("place").collect()] == ["r", "a", "b", "c"]
    odd = df(spark, [("r", None, 1), ("q", None, 0), ("x", "gone", 1), ("y", "x", 1), ("u", "v", 1), ("v", "u", 1), ("s", "s", 1), ("b", "r", None), ("a", "r", 1)], "id string, parent string, ord int")
    assert {(r.id, r.depth, r.root, r.place) for r in graph.tree_order(odd).collect()} == {("r", 0, "r", 0), ("q", 0, "q", 0), ("b", 1, "r", 1), ("a", 1, "r", 2)}
    assert graph.tree_order(n.limit(0)).count() == 0


def test_tree_order_of_random_trees(spark):
    r = random.Random(4)
    parent = {k: None if k < 3 else r.randrange(k) for k in range(400)}
    order = {k: r.randrange(5) for k in parent}
    got = {x.id: (x.depth, x.root, x.place) for x in graph.tree_order(df(spark, [(k, p, order[k]) for k, p in parent.items()], "id long, parent long, ord int")).collect()}
    want = {}
    for root in range(3):
        stack, place = [(root, 0)], 0
        while stack:
            k, d = stack.pop()
            want[k] = (d, root, place)
            place += 1
            stack += [(c, d + 1) for c in sorted((c for c, p in parent.items() if p == k), key=lambda c: (order[c], c), reverse=True)]
    assert got == want


def test_a_tree_that_is_a_chain_of_100_000(spark):
    out = graph.tree_order(spark.range(100_000).selectExpr("id", "nullif(id - 1, -1) AS parent", "0 AS ord"))
    assert out.where("depth <> id or place <> id or root <> 0").count() == 0 and out.count() == 100_000


def test_closures_of_a_long_chain_and_of_a_big_cycle(spark):
    chain = spark.range(100_000).selectExpr("id AS caller", "id + 1 AS callee")
    assert graph.reverse_closure(chain, df(spark, [(99_000,)], "node long"), "caller", "callee").count() == 99_001
    cycle = spark.range(100_000).selectExpr("id AS caller", "(id + 1) % 100000 AS callee").unionByName(df(spark, [(-1, 5), (-2, -1), (-1, -3)], "caller long, callee long"))
    facts = df(spark, [(7, "g"), (50_000, "h"), (-3, "k")], "fid long, gid string")
    got = graph.propagate_facts(cycle, facts, ("gid",)).groupBy("gid").count().collect()
    assert {x[0]: x[1] for x in got} == {"g": 100_002, "h": 100_002, "k": 3}
    levels = graph.topological_levels(spark.range(100_000).withColumnRenamed("id", "node"), chain.where("callee < 100000").withColumnsRenamed({"caller": "src", "callee": "dst"}))
    assert levels.where("level <> 99999 - node").count() == 0 and levels.count() == 100_000


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 200)), min_size=1, max_size=40), st.integers(0, 2))
def test_facts_and_levels_against_plain_loops(spark, pairs, facts, patience):
    was, graph.PATIENCE = graph.PATIENCE, patience
    try:
        e = df(spark, pairs, "caller long, callee long")
        got = {tuple(x) for x in graph.propagate_facts(e, df(spark, facts, "fid long, gid long"), ("gid",), hops=1 + patience).collect()}
        levels = {x.node: x.level for x in graph.topological_levels(spark.range(31).withColumnRenamed("id", "node"), e.withColumnsRenamed({"caller": "src", "callee": "dst"})).collect()}
    finally:
        graph.PATIENCE = was
    want, size = set(facts), -1
    while size != len(want):
        size = len(want)
        want |= {(a, g) for a, b in pairs for f, g in want if f == b}
    assert got == want
    left, out, level = set(range(31)), {}, 0
    while left:
        ready = {n for n in left if not any(a == n and b in left and b != n for a, b in pairs)} or set(left)
        out |= dict.fromkeys(ready, level)
        left -= ready
        level += 1
    assert levels == out


def test_affected_units(spark):
    calls = df(spark, [("a", "b"), ("b", "c")], "caller string, callee string")
    unit = df(spark, [("a", "U1"), ("b", "U2"), ("c", "U3"), ("d", "U4")], "fid string, unit string")
    assert ids(graph.affected_units(df(spark, [("b",)], "fid string"), calls, unit), "unit") == {"U1", "U2", "U3"}


@pytest.mark.parametrize("fn", [graph.connected_components])
def test_empty_edges(spark, fn):
    assert fn(df(spark, [], "src long, dst long")).count() == 0


def test_facts_by_arrays_rows_and_bits_are_the_same(spark, monkeypatch):
    r = random.Random(6)
    pairs = [(k, k // 2) for k in range(1, 60)] + [(r.randrange(60), r.randrange(60)) for _ in range(12)] + [(None, 3), (4, None)]
    facts = [(r.randrange(60), r.randrange(20), r.choice("rw")) for _ in range(90)] + [(5, None, "r"), (None, 1, "w")]
    want, size = {f for f in facts if None not in f}, -1
    while size != len(want):
        size = len(want)
        want |= {(a, *f[1:]) for a, b in pairs for f in want if a is not None and f[0] == b}
    e, f = df(spark, pairs, "caller long, callee long"), df(spark, facts, "fid long, gid long, mode string")
    for worth, wide, columns in ((10_000, 9, ("gid", "mode")), (10_000, 9, ("gid",)), (0, 1 << 17, ("gid", "mode"))):
        monkeypatch.setattr(graph, "WORTH", worth)
        monkeypatch.setattr(graph, "WIDE", wide)
        got = [tuple(x) for x in graph.propagate_facts(e, f, columns).collect()]
        full = {x[: 1 + len(columns)] for x in want | {(5, None, "r"), (None, 1, "w")}}
        assert set(got) == full and len(got) == len(full)


def test_facts_of_a_shallow_graph_are_gathered_once(spark, monkeypatch):
    written, put = [], graph.Scratch.put
    monkeypatch.setattr(graph.Scratch, "put", lambda self, df, label="t", *by: written.append(label) or put(self, df, label, *by))
    tree = spark.range(1, 2000).selectExpr("id AS caller", "id div 2 AS callee")
    facts = spark.range(6000).selectExpr("id % 2000 AS fid", "id AS gid")
    assert graph.propagate_facts(tree, facts, ("gid",)).count() == sum(3 * (k.bit_length() + 1) for k in range(2000))
    assert "state" not in written  # the facts of all functions aren't written again each round

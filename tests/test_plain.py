"""Queries that SQL can't express, held in full against plain loops or exact round trips over the same tables."""

import json

from oracle import SF
from pyspark.sql import functions as F

from factloom.operators import documents as ops
from factloom.plans import registry, text_queries
from factloom.plans.service_queries import _conv

Q = registry.queries()


def graphs(spark):
    out: dict = {}
    for r in text_queries._groups(spark, SF).collect():
        g = out.setdefault(r.grp, {})
        g.setdefault(r.source, set()).add(r.target)
        g.setdefault(r.target, set())
    return out


def test_breadth_first(spark):
    want = []
    for grp, g in graphs(spark).items():
        queue, order = [min(g)], []
        while queue:
            n = queue.pop(0)
            if n not in order:
                order.append(n)
                queue += sorted(g[n])
        order += [n for n in sorted(g) if n not in order]
        want += [(grp, n, k) for k, n in enumerate(order)]
    assert sorted((r.grp, r.node, r.place) for r in Q["g09_breadth_first"](spark, SF).collect()) == sorted(want)


def walk(g):
    """(post-order, back edges) of a recursive depth-first walk."""
    done, open_, post, back = set(), set(), [], set()

    def visit(n):
        open_.add(n)
        for m in sorted(g[n]):
            if m in open_:
                back.add((n, m))
            elif m not in done:
                visit(m)
        open_.discard(n)
        done.add(n)
        post.append(n)

    for n in sorted(g):
        if n not in done:
            visit(n)
    return post, back


def test_post_order_and_forward_in_degree(spark):
    want, degree = [], {}
    for grp, g in graphs(spark).items():
        post, back = walk(g)
        for s in g:
            for d in g[s]:
                want.append((grp, s, d, len(post) - 1 - post.index(s), (s, d) in back))
                if (s, d) not in back:
                    degree[grp, d] = degree.get((grp, d), 0) + 1
    assert sorted((r.grp, r.source, r.target, r.place, r.is_back) for r in Q["g10_post_order"](spark, SF).collect()) == sorted(want)
    assert {(r.grp, r.node): r.n for r in Q["e18_forward_in_degree"](spark, SF).collect()} == degree


def test_merged_ids_keep_both_orders(spark):
    turns: dict = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r.turn)
    rows = {r.conv_id: r.ids for r in Q["i06_merge_ids"](spark, SF).collect()}
    assert set(rows) == set(turns)
    for conv, ids in rows.items():
        a, b = ([str(x) for x in sorted(turns[conv]) if keep(x)] for keep in (lambda x: x % 3 != 0, lambda x: x % 4 != 1))
        assert sorted(ids) == sorted({*a, *b}) and [x for x in ids if x in a] == a and [x for x in ids if x in b] == b


def test_segments_give_both_texts_back(spark):
    old, new = ({(r.conv_id, r.turn): r.text for r in side.select("conv_id", "turn", "text").collect()} for side in _conv(spark, SF))
    from factloom.operators import diff

    rows = diff.render_diff(*_conv(spark, SF), ["conv_id"], "role", ["turn"], "text").select("*", F.to_json("segments").alias("j")).collect()
    assert rows
    olds, news = set(old.values()), set(new.values())
    for r in rows:
        parts = json.loads(r.j) if r.j else []
        if parts:
            before, after = ("".join(p["text"] for p in parts if p["mark"] != skip) for skip in ("added", "removed"))
            assert (before in olds or before == "") and (after in news or after == "")


def test_statement_flow_of_loops_jumps_and_labels(spark):
    rows = [
        (1, 1, None, None, 1, "do", None), (1, 2, 1, "body", 1, "action", None), (1, 3, 1, "body", 2, "if", None), (1, 4, 3, "then", 1, "continue", None), (1, 5, 3, "else", 1, "goto", "out"), (1, 6, None, None, 2, "action", None),
        (1, 7, None, None, 3, "label", "out"), (1, 8, None, None, 4, "switch", None), (1, 9, 8, "body", 1, "case", "A"), (2, 1, None, None, 1, "return", None), (3, 1, None, None, 1, "while", None),
    ]
    s = spark.createDataFrame(rows, "fkey long, id long, parent long, branch string, ord int, kind string, name string")
    got = {(r.fkey, r.source, r.target, r.label) for r in ops.statement_flow(s).collect()}
    assert got == {
        (1, 0, 2, None), (1, 2, 3, None), (1, 3, 4, "Yes"), (1, 3, 5, "No"), (1, 4, 1, None), (1, 5, 7, None), (1, 1, 2, "Yes"), (1, 1, 6, "No"), (1, 6, 7, None), (1, 7, 8, None), (1, 8, 9, "case A"), (1, 8, -1, "default"), (1, 9, -1, None),
        (2, 0, 1, None), (2, 1, -1, None), (3, 0, 1, None), (3, 1, 1, "Yes"), (3, 1, -1, "No"),
    }


def test_every_query_without_sql_is_held_here_or_elsewhere():
    assert {n for n in Q if n not in registry.oracle_sql()} == {"g09_breadth_first", "g10_post_order", "e18_forward_in_degree", "i06_merge_ids", "m01_word_segments"}

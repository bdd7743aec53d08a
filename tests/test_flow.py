"""Flow graphs against a plain walk over each function's statements."""

import random

from factloom.operators import documents as ops

SCHEMA = "fkey long, id long, parent long, branch string, ord int, kind string, name string"


def plain(rows):
    """Edges of one function by recursion. rows: (id, parent, branch, ord, kind, name)."""
    by_id = {r[0]: r for r in rows}
    lists: dict = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        lists.setdefault((r[1] or 0, r[2] or "body"), []).append(r[0])
    labels = {r[5]: r[0] for r in sorted(rows) if r[4] == "label"}
    out = []

    def entry(i):
        inner = lists.get((i, "body"), []) if by_id[i][4] == "do" else []
        return entry(inner[0]) if inner else i

    def enter(i, branch, otherwise):
        inner = lists.get((i, branch), [])
        return entry(inner[0]) if inner else otherwise

    def walk(ids, after, leave, again, alternatives=False):
        for k, i in enumerate(ids):
            _, _, _, _, kind, name = by_id[i]
            nxt = entry(ids[k + 1]) if k + 1 < len(ids) and not alternatives else after
            down = lambda b, a, l=leave, g=again, alt=False: walk(lists.get((i, b), []), a, l, g, alt)  # noqa: B023, E731, E741
            if kind == "if":
                out.extend([(i, enter(i, "then", nxt), "Yes"), (i, enter(i, "else", nxt), "No")])
                down("then", nxt)
                down("else", nxt)
            elif kind in ("while", "for", "do"):
                out.extend([(i, enter(i, "body", i), "Yes"), (i, nxt, "No")])
                down("body", i, nxt, i)
            elif kind == "switch":
                cases = lists.get((i, "body"), [])
                out.extend((i, c, "default" if by_id[c][4] == "default" else f"case {by_id[c][5]}") for c in cases)
                if not any(by_id[c][4] == "default" for c in cases):
                    out.append((i, nxt, "default"))
                down("body", nxt, nxt)
            elif kind == "try":
                out.append((i, enter(i, "body", nxt), None))
                out.extend((i, c, "exception") for c in lists.get((i, "catch"), []))
                down("body", nxt)
                down("catch", nxt, leave, again, True)
            elif kind in ("case", "default", "catch"):
                out.append((i, enter(i, "body", nxt), None))
                down("body", nxt)
            else:
                out.append((i, {"return": -1, "break": leave, "continue": again, "goto": labels.get(name, nxt)}.get(kind, nxt), None))

    top = lists.get((0, "body"), [])
    out.append((0, entry(top[0]) if top else -1, None))
    walk(top, -1, -1, -1)
    return out


def function(r, most):
    """A random function of nested statements."""
    rows, ids = [], iter(range(1, 10_000))

    def fill(parent, branch, depth, n):
        for o in range(n):
            kind = r.choice(["action", "if", "while", "do", "for", "switch", "try", "break", "continue", "return", "goto", "label", "throw"] if depth else ["action", "break", "continue", "throw", "goto"])
            i = next(ids)
            rows.append((i, parent, branch, o, kind, r.choice("ab") if kind in ("goto", "label") else None))
            if kind == "if":
                fill(i, "then", depth - 1, r.randint(0, 3))
                fill(i, "else", depth - 1, r.randint(0, 2))
            elif kind in ("while", "do", "for"):
                fill(i, r.choice(["body", None]), depth - 1, r.randint(0, 3))
            elif kind in ("switch", "try"):
                if kind == "try":
                    fill(i, "body", depth - 1, r.randint(0, 3))
                for k in range(r.randint(0, 3)):
                    c = next(ids)
                    rows.append((c, i, "body" if kind == "switch" else "catch", k, ("default" if k == 2 else "case") if kind == "switch" else "catch", f"v{k}"))
                    fill(c, "body", depth - 1, r.randint(0, 3))

    fill(None, None, 5, r.randint(0, most))
    return rows


def test_random_functions(spark):
    r = random.Random(3)
    functions = {k: f for k in range(60) if (f := function(r, 5))}
    rows = [(k, *x) for k, f in functions.items() for x in f]
    got = sorted(ops.statement_flow(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    want = sorted([(k, *e) for k, f in functions.items() for e in plain(f)], key=str)
    assert [tuple(x) for x in got] == want
    kinds = {x[5] for x in rows}
    assert {"try", "catch", "throw", "do", "default", "goto"} <= kinds


def test_try_and_catch(spark):
    rows = [(1, 1, None, None, 1, "while", None), (1, 2, 1, "body", 1, "try", None), (1, 3, 2, "body", 1, "throw", None), (1, 4, 2, "catch", 1, "catch", "E"), (1, 5, 4, "body", 1, "break", None),
            (1, 6, 2, "catch", 2, "catch", "..."), (1, 7, None, None, 2, "return", None)]
    got = {(x.source, x.target, x.label) for x in ops.statement_flow(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(0, 1, None), (1, 2, "Yes"), (1, 7, "No"), (2, 3, None), (2, 4, "exception"), (2, 6, "exception"), (3, 1, None), (4, 5, None), (5, 7, None), (6, 1, None), (7, -1, None)}


def test_deep_nesting_and_no_statements(spark):
    rows = [(1, k, k - 1 or None, "then", 1, "if", None) for k in range(1, 301)] + [(2, k, k - 1 or None, "body", 1, "do", None) for k in range(1, 40)]
    got = {(x.fkey, x.source, x.target, x.label) for x in ops.statement_flow(spark.createDataFrame([(f, i, p, b if p else None, o, k, n) for f, i, p, b, o, k, n in rows], SCHEMA)).collect()}
    assert (1, 299, 300, "Yes") in got and (1, 300, -1, "Yes") in got and (1, 1, -1, "No") in got and (2, 0, 39, None) in got and (2, 39, 39, "Yes") in got and (2, 39, 38, "No") in got and (2, 1, 39, "Yes") in got
    assert ops.statement_flow(spark.createDataFrame([], SCHEMA)).count() == 0

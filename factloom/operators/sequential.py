"""Order-dependent algorithms without a closed form over windows. A group is one function's graph or one item list, never a whole
table. Groups travel as arrays, many in one Arrow batch, so a small group costs no frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a result that are handed back at a time.
OUT_ROWS = 8192


def by_group(rows: DataFrame, columns: list[str], fn: Callable[[object, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """fn(grp, tuples of the columns, sorted; nulls come first) of every group, as rows of the schema."""
    target = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    arrays = rows.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)
        for batch in batches:
            keys, items, out = batch.column(0).to_pylist(), batch.column(1), []
            ends = items.offsets.to_pylist()
            fields = [f.to_pylist() for f in items.flatten().flatten()]
            tuples = list(zip(*fields, strict=True))
            for key, lo, hi in zip(keys, ends[:-1], ends[1:], strict=True):
                out += fn(key, tuples[lo - ends[0] : hi - ends[0]])
                if len(out) >= OUT_ROWS:
                    yield give(out)
                    out = []
            if out:
                yield give(out)

    return arrays.mapInArrow(run, schema)


def segment_statements(rows: DataFrame, most: int = 5, most_lines: int = 10) -> DataFrame:
    """(grp, segment, first_ord, n): consecutive statements (grp, ord, n_lines) cut where a segment would exceed `most`
    statements or `most_lines` lines; a statement longer than that stands alone."""

    def run(grp, items: list[tuple]) -> list[tuple]:
        out, start, count, lines = [], None, 0, 0
        for o, n in items:
            if count and (count >= most or lines + n > most_lines):
                out.append((grp, len(out), start, count))
                start, count, lines = None, 0, 0
            start = o if start is None else start
            count, lines = count + 1, lines + n
        return [*out, (grp, len(out), start, count)] if count else out

    return by_group(rows, ["ord", "n_lines"], run, "grp long, segment long, first_ord long, n long")


def region_batches(rows: DataFrame, most: int = 8) -> DataFrame:
    """(grp, ord, batch): nodes (grp, ord, in_degree, is_branch) in order; a batch ends before a merge point, after a
    branch, or when full; a batch of one joins the batch before it where that has room."""

    def run(grp, items: list[tuple]) -> list[tuple]:
        batches: list[list[int]] = []
        cur: list[int] = []
        for o, deg, branch in items:
            if cur and (deg > 1 or len(cur) >= most):
                batches.append(cur)
                cur = []
            cur.append(o)
            if branch:
                batches.append(cur)
                cur = []
        if cur:
            batches.append(cur)
        merged: list[list[int]] = []
        for b in batches:
            if merged and len(b) == 1 and len(merged[-1]) < most:
                merged[-1] += b
            else:
                merged.append(b)
        return [(grp, o, k) for k, b in enumerate(merged) for o in b]

    return by_group(rows, ["ord", "in_degree", "is_branch"], run, "grp long, ord long, batch long")


def fit_ladder(items: DataFrame, budget: int, costs: tuple[str, ...] = ("c0", "c1", "c2", "c3", "c4")) -> DataFrame:
    """(grp, id, level): items (grp, id, priority, c0..c4: cost at each level of detail) lowered one level at a time, the
    lowest priority first, until the group fits; what doesn't fit at the last level is dropped (level -1)."""

    def run(grp, rows: list[tuple]) -> list[tuple]:
        level, total = [0] * len(rows), sum(r[2] for r in rows)
        for target in range(1, len(costs)):
            for i, r in enumerate(rows):
                if total <= budget:
                    break
                total += r[2 + target] - r[2 + level[i]]
                level[i] = target
        for i, r in enumerate(rows):
            if total <= budget:
                break
            total -= r[2 + level[i]]
            level[i] = -1
        return [(grp, r[1], v) for r, v in zip(rows, level, strict=True)]

    return by_group(items, ["priority", "id", *costs], run, "grp long, id long, level long")


def snapped_cuts(rows: DataFrame, pieces: int, slack: float = 0.15) -> DataFrame:
    """(grp, cut): evenly spaced cuts over a group's height (grp, y, height), each moved to the nearest candidate y within
    slack of a piece; where there is none the even place stays."""

    def run(grp, items: list[tuple]) -> list[tuple]:
        height, ys, out = int(items[0][1]), [int(y) for y, _ in items if y is not None], []
        for k in range(1, pieces):
            ideal, reach = height * k / pieces, slack * height / pieces
            near = [y for y in ys if abs(y - ideal) <= reach and (not out or y > out[-1])]
            out.append(min(near, key=lambda y: (abs(y - ideal), y)) if near else int(ideal))
        return [(grp, c) for c in out]

    return by_group(rows, ["y", "height"], run, "grp long, cut long")


def _graph(edges: list[tuple]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for s, d in edges:
        out.setdefault(s, [])
        if d is not None:
            out[s].append(d)
            out.setdefault(d, [])
    return out


def breadth_first_order(edges: DataFrame) -> DataFrame:
    """(grp, node, place): nodes of each graph (grp, source, target; target null: a node alone) from its least node breadth
    first, what isn't reached appended in order."""

    def run(grp, items: list[tuple]) -> list[tuple]:
        g = _graph(items)
        todo = [min(g)]
        seen = set(todo)
        for n in todo:
            for m in g[n]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        todo += sorted(set(g) - seen)
        return [(grp, n, k) for k, n in enumerate(todo)]

    return by_group(edges, ["source", "target"], run, "grp long, node long, place long")


def reverse_post_order(edges: DataFrame) -> DataFrame:
    """(grp, source, target, place, is_back): place of source in reverse post-order of a depth-first walk from the least
    node (others after it), and whether the edge closes a cycle."""

    def run(grp, items: list[tuple]) -> list[tuple]:
        g = _graph(items)
        state: dict[int, int] = {}
        post: list[int] = []
        back: set[tuple[int, int]] = set()
        for root in sorted(g):
            if root in state:
                continue
            stack = [(root, iter(g[root]))]
            state[root] = 1
            while stack:
                node, rest = stack[-1]
                for m in rest:
                    if m not in state:
                        state[m] = 1
                        stack.append((m, iter(g[m])))
                        break
                    if state[m] == 1:
                        back.add((node, m))
                else:
                    state[node] = 2
                    post.append(node)
                    stack.pop()
        place = {n: k for k, n in enumerate(reversed(post))}
        return [(grp, s, d, place[s], (s, d) in back) for s in g for d in g[s]]

    return by_group(edges, ["source", "target"], run, "grp long, source long, target long, place long, is_back boolean")

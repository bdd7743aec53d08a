"""Fixed-point operators over edge tables. Each round is a join and an aggregate whose result is written to the
shared scratch folder, so lineage stays one round deep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import IntegralType

from factloom.scratch import Scratch


#: A node with over one in so many of all links is a hub. There are at most 2,000 hubs then, so their labels may be broadcast.
HUB_SHARE = 1000


def _with_label(links: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """links (u, v) with the label m of u. labels: (u, m, d), d being the number of links of u; total: of all links. Links of hubs
    meet a broadcast table of at most 2 * HUB_SHARE rows, so that no task gets all of them."""
    hubs = labels.where(F.col("d") > max(total // HUB_SHARE, 16)).select("u", F.col("m").alias("hub")).limit(2 * HUB_SHARE)
    tagged = links.join(F.broadcast(hubs), "u", "left")
    rest = tagged.where("hub is null").drop("hub").join(labels.select("u", "m"), "u")
    return tagged.where("hub is not null").select("u", "v", F.col("hub").alias("m")).unionByName(rest.select("u", "v", "m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes that have an edge are returned.

    Alternating large-star and small-star rounds; the number of rounds grows with the logarithm of the size.
    Null ends and self links are ignored; repeated links count once; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components", small=True)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    current = scratch.put(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state_of = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = state_of(current)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
        large = _with_label(both, low, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.put(large.distinct(), "large")
        roots = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = (
            _with_label(large, roots, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(roots.select("u", F.col("m").alias("v"))).distinct()
        )
        new = scratch.put(small, "edges")
        last, state = state, state_of(new)
        scratch.drop(current, large)
        current = new
        if state == last:
            break
    else:
        raise RuntimeError("connected_components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


#: Steps that one round of a closure takes before its result is written; rounds after which chains are contracted.
HOPS, PATIENCE = 4, 6


def _counted(scratch: Scratch, df: DataFrame, label: str, what: Column) -> tuple[DataFrame, int]:
    """df written, and the number of its rows for which `what` holds, counted by the write itself."""
    seen = Observation()
    table = scratch.put(df.observe(seen, F.count_if(what).alias("n")), label)
    return table, int(seen.get["n"] or 0)


def _doubled(scratch: Scratch, jumps: DataFrame, n: int, carry) -> DataFrame:
    """Pointer doubling: jumps (node, ptr, ..) until no ptr is itself a node of the table, or all ways are run through (a cycle never
    ends). carry(near, far): the further columns of a jump made of two, by the prefixes of their columns. n: jumps."""
    extra = [c for c in jumps.columns if c not in ("node", "ptr")]
    jumps = scratch.put(jumps, "jumps")
    for _ in range(max(n, 1).bit_length() + 1):
        far = jumps.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), *[F.col(c).alias(f"_{c}") for c in extra])
        both = jumps.join(far, "ptr", "left")
        moved = F.col("_ptr").isNotNull()
        new = both.select("node", F.coalesce("_ptr", "ptr").alias("ptr"), *[F.when(moved, carry(c)).otherwise(F.col(c)).alias(c) for c in extra], moved.alias("_moved"))
        new, left = _counted(scratch, new, "jumps", F.col("_moved"))
        scratch.drop(jumps)
        jumps = new.drop("_moved")
        jumps._scratch_path = new._scratch_path
        if not left:
            break
    return jumps


def _single(hop: DataFrame) -> DataFrame:
    """(node, ptr) of the nodes with one way down, to another node."""
    one = hop.groupBy(F.col("_up").alias("node")).agg(F.count("*").alias("_n"), F.min("_down").alias("ptr"))
    return one.where("_n = 1 and node <> ptr").select("node", "ptr")


def _merged(state: DataFrame, *more: DataFrame) -> DataFrame:
    """(node, block, bits, delta): bits of all; delta are those that state lacks."""
    rows = state.select("node", "block", "bits", F.lit(0).cast("long").alias("new"))
    for m in more:
        rows = rows.unionByName(m.select("node", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("new")))
    both = rows.groupBy("node", "block").agg(F.bit_or("bits").alias("old"), F.bit_or("new").alias("new"))
    return both.select("node", "block", F.col("old").bitwiseOR(F.col("new")).alias("bits"), F.col("new").bitwiseAND(F.bitwise_not("old")).alias("delta"))


def _contract(scratch: Scratch, hop: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with one way down get the bits of all that lies on their way as long as it is single, in rounds of pointer doubling; what
    they can still get comes from the end of that way, to which they are linked instead. A way that runs into a cycle has no end. Taking
    bits twice changes nothing, so cycles do no harm."""
    single = scratch.put(_single(hop), "single")
    n, jumps = single.count(), single
    for _ in range(max(n, 1).bit_length() + 1):
        ahead = jumps.join(state.select(F.col("node").alias("ptr"), "block", "bits"), "ptr").select("node", "block", "bits")
        state = scratch.put(_merged(state, ahead), "state")
        far = jumps.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"))
        new = jumps.join(far, "ptr", "left").select("node", F.coalesce("_ptr", "ptr").alias("ptr"), F.col("_ptr").isNotNull().alias("_moved"))
        new, left = _counted(scratch, new, "jumps", F.col("_moved"))
        jumps = new.drop("_moved")
        if not left:
            break
    ends = jumps.join(single.select(F.col("node").alias("ptr")), "ptr", "left_anti")
    rest = hop.join(single.select(F.col("node").alias("_up")), "_up", "left_anti")
    return scratch.put(rest.unionByName(ends.select(F.col("node").alias("_up"), F.col("ptr").alias("_down"))), "links"), state


def _spread(scratch: Scratch, hop: DataFrame, start: DataFrame, hops: int, max_rounds: int) -> DataFrame:
    """(node, block, bits): every node's bits and those of all nodes below it. hop: _up, _down, distinct; start: node, block, bits.

    Semi-naive: a round passes on only the bits that were new in the round before, `hops` steps far. A graph that is deeper than PATIENCE
    rounds reach is contracted once: chains and cycles of any length cost the logarithm of their length."""
    first = start.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"))
    state = scratch.put(first.withColumn("delta", F.col("bits")), "state")
    for k in range(1, max_rounds + 1):
        if k == PATIENCE + 1:
            hop, state = _contract(scratch, hop, state)
            state = state.withColumn("delta", F.col("bits"))
        layer, layers = state.where("delta <> 0").select("node", "block", F.col("delta").alias("bits")), []
        for _ in range(hops):
            layer = layer.join(hop, layer["node"] == hop["_down"]).groupBy(F.col("_up").alias("node"), "block").agg(F.bit_or("bits").alias("bits"))
            layers.append(layer)
        state, new = _counted(scratch, _merged(state, *layers), "state", F.col("delta") != 0)
        if not new:
            return state.select("node", "block", "bits")
    raise RuntimeError("no fixed point")


def reverse_closure(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", max_rounds: int = 10_000, hops: int = HOPS) -> DataFrame:
    """(node): seeds and everything from which a seed can be reached over src -> dst. Cycles end by themselves: each round
    only carries nodes that are new. Seeds that have no edge stay in the result."""
    scratch = Scratch(edges.sparkSession, "closure", small=True)
    hop = scratch.put(edges.select(F.col(src).alias("_up"), F.col(dst).alias("_down")).where("_up is not null and _down is not null").distinct(), "links")
    one = [F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("bits")]
    return _spread(scratch, hop, seeds.select(F.col(node).alias("node"), *one).where("node is not null"), hops, max_rounds).select("node")


def bounded_bfs(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src", dst: str = "dst", node: str = "node", per_level: int | None = None) -> DataFrame:
    """(node, level): nodes within `depth` steps over src -> dst, at their least level. With per_level, a level keeps only
    its first nodes in order of their keys, and what it leaves out may come again later."""
    scratch = Scratch(edges.sparkSession, "bfs", small=True)
    hop = scratch.put(edges.select(F.col(src).alias("_at"), F.col(dst).alias("_to")).where("_at is not null and _to is not null").distinct(), "links")
    frontier = seeds.select(F.col(node).alias("node")).distinct()
    seen = scratch.put(frontier.withColumn("level", F.lit(0)), "seen")
    frontier = seen.select("node")
    for level in range(1, depth + 1):
        new = frontier.join(hop, frontier["node"] == hop["_at"]).select(F.col("_to").alias("node")).distinct().join(seen, "node", "left_anti")
        if per_level is not None:
            new = new.orderBy("node").limit(per_level)
        new = scratch.put(new, "level")
        if new.isEmpty():
            break
        seen = seen.unionByName(new.withColumn("level", F.lit(level)))
        frontier = new
    return seen


def spread_families(calls: DataFrame, override_pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(caller, callee) with virtual dispatch made explicit: who calls one member of an override family calls every member
    that is present. calls: caller, callee; override_pairs: ov, base; keys: fid."""
    family = connected_components(override_pairs, "ov", "base")
    present = family.join(keys, family["node"] == keys["fid"], "left_semi")
    big = present.groupBy("component").agg(F.count("*").alias("n")).where("n >= 2").select("component")
    member = present.join(big, "component").select("component", "node")
    calling = calls.join(member, calls["callee"] == member["node"]).select("caller", "component").distinct()
    more = calling.join(member, "component").select("caller", F.col("node").alias("callee"))
    return calls.select("caller", "callee").unionByName(more).distinct()


#: Facts are gathered over pairs of functions as long as there are at most so many pairs a link and gathered facts a given one; values that one
#: array of facts may hold.
WORTH, WIDE = 32, 1 << 17


def _reach(scratch: Scratch, hop: DataFrame, counts: DataFrame) -> DataFrame | None:
    """(node, met, n, total): the pairs of a node and itself or one below it that has n facts, total being the sum of n over the node's pairs. None
    if that takes more than WORTH pairs a link or facts a given one. hop: _up, _down, distinct; counts: met, n.

    By squaring: pairs up to k steps apart and pairs exactly k apart give those up to 2 k, so a depth costs its logarithm. Joins are counted
    before they are made."""
    far = hop.select(F.col("_up").alias("node"), F.col("_down").alias("met"))
    given = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen, links = far, far.count()
    n, most = links, WORTH * links
    while n:
        ways = far.groupBy("met").agg(F.count("*").alias("a")).join(seen.groupBy(F.col("node").alias("met")).agg(F.count("*").alias("b")), "met")
        if ways.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0] > most:
            return None
        on = lambda t, f: f.select("node", F.col("met").alias("_via")).join(t.select(F.col("node").alias("_via"), "met"), "_via").select("node", "met")
        new, more = _counted(scratch, seen.unionByName(on(seen, far)).distinct(), "seen", F.lit(True))
        if more == n:
            break
        far = scratch.put(on(far, far).distinct(), "far")
        seen, n = new, more
    pairs = seen.where("node <> met").join(counts, "met").unionByName(counts.select("met", F.col("met").alias("node"), "n"))
    pairs = scratch.put(pairs.select("node", "met", "n"), "pairs")
    totals = scratch.put(pairs.groupBy("node").agg(F.sum("n").alias("total")), "totals")
    if totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] > WORTH * given:
        return None
    return pairs.join(totals, "node")


def _gathered(reach: DataFrame, counts: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, x): the distinct facts x, numbers, of all that a node meets. reach: see _reach; facts: met, x. Where all of a node's facts fit an array, they are
    gathered in one; those of other nodes stay rows."""
    fits = F.col("total") <= WIDE
    own = facts.join(counts.where(F.col("n") <= WIDE).select("met"), "met", "left_semi").groupBy("met").agg(F.collect_list("x").alias("xs"))
    sets = reach.where(fits).select("node", "met").join(own, "met").groupBy("node").agg(F.collect_list("xs").alias("xs"))
    few = sets.select("node", F.explode(F.array_distinct(F.flatten("xs"))).alias("x"))
    many = reach.where(~fits).select("node", "met").join(facts, "met").select("node", "x").distinct()
    return few.unionByName(many)


def propagate_facts(calls: DataFrame, facts: DataFrame, columns: tuple[str, ...], fid: str = "fid", max_rounds: int = 10_000, hops: int = HOPS) -> DataFrame:
    """(fid, *columns): each function's facts and those of everything it calls, to a fixed point. Rows with nulls in `columns` stay but
    don't spread. Cycles, chains and hubs need no care of the caller.

    Where calls reach few functions each, those are found first and their facts are gathered once, in arrays. Otherwise facts are numbered and
    travel as bits, 64 to a row."""
    scratch = Scratch(calls.sparkSession, "propagate", small=True)
    hop = scratch.put(calls.select(F.col("caller").alias("_up"), F.col("callee").alias("_down")).where("_up is not null and _down is not null").distinct(), "links")
    whole = " and ".join(f"`{c}` is not null" for c in (fid, *columns))
    told, rest = facts.where(whole), facts.where(f"not ({whole})").select(fid, *columns).distinct()
    counts = scratch.put(told.groupBy(F.col(fid).alias("met")).agg(F.count("*").alias("n")), "counts")
    reach = _reach(scratch, hop, counts)
    numbered = told.select(*columns).distinct().withColumn("_n", F.monotonically_increasing_id())
    if reach is not None:
        if len(columns) == 1 and isinstance(facts.schema[columns[0]].dataType, IntegralType):  # a number is its own
            met = _gathered(reach, counts, told.select(F.col(fid).alias("met"), F.col(columns[0]).alias("x"))).select(F.col("node").alias(fid), F.col("x").alias(columns[0]))
        else:
            known = scratch.put(numbered, "facts")
            met = _gathered(reach, counts, told.join(known, list(columns)).select(F.col(fid).alias("met"), F.col("_n").alias("x"))).join(known.withColumnRenamed("_n", "x"), "x").select(F.col("node").alias(fid), *columns)
        return met.unionByName(rest)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_n").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    known = scratch.put(numbered.select(*columns, F.shiftright("_n", 6).alias("block"), mask.alias("mask")), "facts")
    start = told.join(known, list(columns)).select(F.col(fid).alias("node"), "block", F.col("mask").alias("bits"))
    state = _spread(scratch, hop, start, hops, max_rounds)
    met = state.join(known, "block").where(F.col("bits").bitwiseAND(F.col("mask")) != 0).select(F.col("node").alias(fid), *columns)
    return met.unionByName(rest)


def topological_levels(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): level 0 calls nothing; a node comes once all it calls has come. When a cycle leaves nothing ready,
    everything that is left is released at once.

    Nodes with one dependency are taken out by pointer doubling: such a node's level is that of the end of its single way and the steps to
    it. The others are levelled in rounds, over links that count those steps; so only branching costs rounds."""
    scratch = Scratch(nodes.sparkSession, "levels", small=True)
    names = scratch.put(nodes.select(F.col(node).alias("node")).where("node is not null").distinct(), "nodes")
    deps = edges.select(F.col(src).alias("_up"), F.col(dst).alias("_down")).where("_up <> _down").distinct()
    deps = deps.join(names.select(F.col("node").alias("_down")), "_down", "left_semi").join(names.select(F.col("node").alias("_up")), "_up", "left_semi")
    deps = scratch.put(deps, "deps")
    single = scratch.put(_single(deps).withColumn("steps", F.lit(1).cast("long")), "single")
    ways = _doubled(scratch, single, single.count(), lambda c: F.col(c) + F.col(f"_{c}"))
    ends = ways.join(single.select(F.col("node").alias("ptr")), "ptr", "left_anti")  # the others run into a cycle
    inner = deps.join(single.select(F.col("node").alias("_up")), "_up", "left_anti")
    links = inner.join(ways.select(F.col("node").alias("_down"), "ptr", "steps"), "_down", "left").select(
        F.col("_up").alias("node"), F.coalesce("ptr", "_down").alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    links = scratch.put(links.groupBy("node", "on").agg(F.max("steps").alias("steps")), "links")
    left = names.join(single, "node", "left_anti")
    done = scratch.put(left.join(links, "node", "left_anti").withColumn("level", F.lit(0).cast("long")), "done")
    while True:
        ready = links.join(done.select(F.col("node").alias("on"), "level"), "on", "left").groupBy("node").agg(F.max(F.col("level") + F.col("steps")).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new, n = _counted(scratch, ready.where("open = 0").select("node", "level"), "done", F.lit(True))
        if not n:
            break
        links = scratch.put(links.join(new, "node", "left_anti"), "links")
        done = scratch.put(done.unionByName(new), "done")
    levels = done.unionByName(ends.join(done.select(F.col("node").alias("ptr"), "level"), "ptr").select("node", (F.col("level") + F.col("steps")).alias("level")))
    levels = scratch.put(levels, "levels")
    last = levels.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("last"))
    rest = names.join(levels.hint("merge"), "node", "left_anti").crossJoin(F.broadcast(last)).select("node", F.col("last").alias("level"))
    return levels.unionByName(rest).withColumn("level", F.col("level").cast("int"))


def affected_units(impact: DataFrame, calls: DataFrame, unit_of: DataFrame) -> DataFrame:
    """(unit): units of impacted functions and of their direct callers and callees. impact: fid; unit_of: fid, unit."""
    callers = calls.join(impact, calls["callee"] == impact["fid"], "left_semi").select(F.col("caller").alias("fid"))
    callees = calls.join(impact, calls["caller"] == impact["fid"], "left_semi").select(F.col("callee").alias("fid"))
    near = impact.select("fid").unionByName(callers).unionByName(callees).distinct()
    return near.join(unit_of, "fid").select("unit").distinct()


def validate_flow_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fkey, issue, node_id): missing or repeated start, missing end, dangling edge, empty label, unreachable node.
    nodes: fkey, node_id, type, label; edges: fkey, source, target. Reachability is one closure over all graphs."""
    start, end = nodes.where("type = 'START'"), nodes.where("type = 'END'")
    graphs = nodes.select("fkey").distinct()
    issue = lambda df, name, col="node_id": df.select("fkey", F.lit(name).alias("issue"), (F.col(col) if col else F.lit(None)).cast("string").alias("node_id"))
    no_start = issue(graphs.join(start.select("fkey").distinct(), "fkey", "left_anti"), "no start", None)
    starts = issue(start.groupBy("fkey").count().where("count > 1"), "several starts", None)
    no_end = issue(graphs.join(end.select("fkey").distinct(), "fkey", "left_anti"), "no end", None)
    ids = nodes.select("fkey", "node_id")
    ends = edges.select("fkey", F.explode(F.array("source", "target")).alias("node_id")).distinct()
    dangling = issue(ends.join(ids.hint("merge"), ["fkey", "node_id"], "left_anti"), "dangling edge")
    empty = issue(nodes.where("type not in ('START', 'END') and trim(coalesce(label, '')) = ''"), "empty label")
    kinds = dict(nodes.dtypes)
    key = lambda n: F.struct(F.col("fkey").cast(kinds["fkey"]).alias("f"), F.col(n).cast(kinds["node_id"]).alias("n"))
    key_of = ids.select("fkey", "node_id", key("node_id").alias("k"))
    reach = reverse_closure(edges.select(key("target").alias("src"), key("source").alias("dst")), start.select(key("node_id").alias("node"))).hint("merge")
    lost = issue(key_of.join(reach, key_of["k"] == reach["node"], "left_anti"), "unreachable")
    return no_start.unionByName(starts).unionByName(no_end).unionByName(dangling).unionByName(empty).unionByName(lost)


def tree_order(nodes: DataFrame, node: str = "id", parent: str = "parent", order: str = "ord") -> DataFrame:
    """Nodes of a forest (adjacency list) with depth, root and place: their place in pre-order in the tree of their root, siblings by order, then
    id. Nodes whose parent is missing, and those below them or in a cycle, are no part of the result.

    Each node is entered and left once on a walk around its tree: a list whose next element follows from siblings and parents. Ranking that
    list by pointer doubling takes rounds in the logarithm of its length, however deep a tree is."""
    scratch = Scratch(nodes.sparkSession, "tree", small=True)
    own = scratch.put(nodes.select(F.col(node).alias("_id"), F.col(parent).alias("_parent"), F.col(order).alias("_ord"), F.monotonically_increasing_id().alias("_n")), "numbered")
    placed = own.join(own.select(F.col("_id").alias("_parent"), F.col("_n").alias("_up")), "_parent", "left")
    inner = placed.where("_up is not null").withColumn("_next", F.lead("_n").over(Window.partitionBy("_up").orderBy("_ord", "_id")))
    tops = placed.where("_up is null").withColumn("_next", F.lit(None).cast("long"))
    first = placed.where("_up is not null").groupBy(F.col("_up").alias("_n")).agg(F.min(F.struct("_ord", "_id", F.col("_n").alias("k")))["k"].alias("_first"))
    walk = inner.unionByName(tops).join(first, "_n", "left")
    enter, leave = F.col("_n") * 2, F.col("_n") * 2 + 1
    # below zero: the end of a tree, naming its root; or of one that hangs on nothing
    end = F.when(F.col("_parent").isNull(), -1 - F.col("_n")).otherwise(F.lit(-(1 << 62)))
    down = F.struct(enter.alias("node"), F.coalesce(F.col("_first") * 2, leave).alias("ptr"), F.lit(1).cast("long").alias("met"), F.lit(1).cast("long").alias("sunk"))
    up = F.struct(leave.alias("node"), F.coalesce(F.col("_next") * 2, F.col("_up") * 2 + 1, end).alias("ptr"), F.lit(0).cast("long").alias("met"), F.lit(-1).cast("long").alias("sunk"))
    steps = scratch.put(walk.select(F.explode(F.array(down, up)).alias("x")).select("x.*"), "steps")
    ranked = _doubled(scratch, steps, steps.count(), lambda c: F.col(c) + F.col(f"_{c}"))
    ranked = ranked.where((F.col("node") % 2 == 0) & F.col("ptr").between(F.lit(-(1 << 62) + 1), F.lit(-1))).select(F.shiftright("node", 1).alias("_n"), (-1 - F.col("ptr")).alias("_root"), "met", "sunk")
    ranked = ranked.hint("merge")
    whole = ranked.where("_n = _root").select("_root", F.col("met").alias("_size"))
    names = own.select(F.col("_n").alias("_root"), F.col("_id").alias("root"))
    found = ranked.join(whole, "_root").join(names, "_root").join(own.select("_n", "_id"), "_n")
    out = found.select(F.col("_id").alias(node), (-F.col("sunk")).cast("int").alias("depth"), "root", (F.col("_size") - F.col("met")).alias("place"))
    return nodes.join(out, node)

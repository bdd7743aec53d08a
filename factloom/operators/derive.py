"""Units, components, interfaces, knowledge tables and dependency views derived from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions import keys
from factloom.scratch import Scratch


def first_wins(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return first_wins(df, key, [F.col(c).desc() for c in order])


def forward_fill(df: DataFrame, value: str, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """value carried forward over missing ones. Without a partition the whole table is one sequence: it is cut into ranges
    of `order`, filled inside each, and only the last value of each range crosses to the next."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("filled", F.last(value, ignorenulls=True).over(w))
    ranged = Scratch(df.sparkSession, "fill").put(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    ends = ranged.where(F.col(value).isNotNull()).groupBy("_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    parts = ranged.select("_part").distinct().join(ends, "_part", "left")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, not per row of data
    carried = parts.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return inside.join(F.broadcast(carried), "_part").withColumn("filled", F.coalesce("_in", "_carry")).drop("_part", "_in", "_carry")


def component_of(paths: DataFrame, config: DataFrame, path: str = "path") -> DataFrame:
    """paths with component: the first config entry (component, folder, ord) whose folder is a prefix, whatever the case;
    `unknown` if none. Prefixes are matched by equality on every leading folder of a path, so it is a hash join."""
    parts = F.split(F.lower(keys.normal_path(F.col(path))), "/")
    prefixes = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    conf = config.select("component", F.lower(keys.normal_path(F.col("folder"))).alias("folder"), "ord")
    best = prefixes.join(conf, "folder").groupBy(path).agg(F.min_by("component", "ord").alias("component"))
    return paths.join(best, path, "left").withColumn("component", F.coalesce("component", F.lit("unknown")))


def flatten_layers(layers: DataFrame) -> DataFrame:
    """(layer, group, component, path): nested maps (layer, path, groups: map<group, map<component, array<path>>>) flattened,
    paths prefixed by the layer's."""
    g = layers.select("layer", "path", F.explode("groups").alias("grp", "components"))
    c = g.select("layer", "path", "grp", F.explode("components").alias("component", "paths"))
    prefix = lambda p: F.when(F.coalesce(F.col("path"), F.lit("")) == "", p).otherwise(F.concat_ws("/", F.col("path"), p))
    return c.select("layer", F.col("grp").alias("group"), "component", F.explode(F.transform("paths", prefix)).alias("path"))


def external_callers(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions (fid, file, ...) with private_by_use: no caller in another file."""
    f = functions.select(F.col("fid").alias("caller"), F.col("file").alias("caller_file"))
    outside = calls.join(f, "caller").join(functions.select(F.col("fid").alias("callee"), F.col("file").alias("callee_file")), "callee").where("caller_file <> callee_file").select(F.col("callee").alias("fid")).distinct().withColumn("_out", F.lit(True))
    return functions.join(outside, "fid", "left").withColumn("private_by_use", F.col("_out").isNull()).drop("_out")


def interface_ordinals(entities: DataFrame) -> DataFrame:
    """entities (file, is_private, kind_rank, line, ord, ...) with number: 1.. per file and visibility, functions before
    globals, by line, ties in input order."""
    w = Window.partitionBy("file", "is_private").orderBy("kind_rank", "line", "ord")
    return entities.withColumn("number", F.row_number().over(w))


def units(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(unit, ids, caller_units, callee_units): members (fid, unit, ord) grouped; calls lifted to units, own unit left out."""
    ids = members.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("ord", "fid"))).alias("m")).select("unit", F.transform("m", lambda x: x["fid"]).alias("ids"))
    lifted = lift_calls(members, calls)
    callers = lifted.groupBy(F.col("to").alias("unit")).agg(F.array_sort(F.collect_set("from")).alias("caller_units"))
    callees = lifted.groupBy(F.col("from").alias("unit")).agg(F.array_sort(F.collect_set("to")).alias("callee_units"))
    none = F.array().cast("array<string>")
    return ids.join(callers, "unit", "left").join(callees, "unit", "left").select("unit", "ids", F.coalesce("caller_units", none).alias("caller_units"), F.coalesce("callee_units", none).alias("callee_units"))


def lift_calls(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(from, to): distinct pairs of different units that call each other."""
    a, b = members.select(F.col("fid").alias("caller"), F.col("unit").alias("from")), members.select(F.col("fid").alias("callee"), F.col("unit").alias("to"))
    return calls.join(a, "caller").join(b, "callee").where("`from` <> `to`").select("from", "to").distinct()


def components(unit_of: DataFrame, headers: DataFrame) -> DataFrame:
    """(component, units, headers) from unit_of (component, unit) and headers (component, header)."""
    u = unit_of.groupBy("component").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    h = headers.groupBy("component").agg(F.array_sort(F.collect_set("header")).alias("headers"))
    return u.join(h, "component", "left").withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))


def diagram_edges(members: DataFrame, calls: DataFrame, interface: DataFrame) -> DataFrame:
    """(from, to, ids): interface ids of the callees by pair of units."""
    a, b = members.select(F.col("fid").alias("caller"), F.col("unit").alias("from")), members.select(F.col("fid").alias("callee"), F.col("unit").alias("to"))
    lifted = calls.join(a, "caller").join(b, "callee").where("`from` <> `to`").join(interface.select(F.col("fid").alias("callee"), "interface_id"), "callee")
    return lifted.groupBy("from", "to").agg(F.array_sort(F.collect_set("interface_id")).alias("ids"))


def interface_rows(functions: DataFrame, members: DataFrame, calls: DataFrame) -> DataFrame:
    """(fid, callers, callees, source_dest): external units of each function's callers and callees; `-` where none."""
    own = members.select("fid", F.col("unit").alias("own"))
    up = calls.join(members.select(F.col("fid").alias("caller"), "unit"), "caller").select(F.col("callee").alias("fid"), "unit")
    down = calls.join(members.select(F.col("fid").alias("callee"), "unit"), "callee").select(F.col("caller").alias("fid"), "unit")
    gather = lambda df, n: df.join(own, "fid").where("unit <> own").groupBy("fid").agg(F.array_sort(F.collect_set("unit")).alias(n))
    none = F.array().cast("array<string>")
    out = functions.select("fid").join(gather(up, "callers"), "fid", "left").join(gather(down, "callees"), "fid", "left").select("fid", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))
    text = F.concat_ws("; ", F.nullif(F.array_join("callers", ", "), F.lit("")), F.nullif(F.array_join("callees", ", "), F.lit("")))
    return out.withColumn("source_dest", keys.or_default(text, "-"))


def readers_writers(access: DataFrame) -> DataFrame:
    """(gid, readers, writers) from access (fid, gid, mode r or w), sorted."""
    pick = lambda m: F.array_sort(F.collect_set(F.when(F.col("mode") == m, F.col("fid"))))
    return access.groupBy("gid").agg(pick("r").alias("readers"), pick("w").alias("writers"))


def resolve_ranges(wanted: DataFrame, dictionary: DataFrame, depth: int = 10) -> DataFrame:
    """wanted (type) with range: exact name, then lower case, then along typedefs (at most `depth`), then the built-in table.
    dictionary: name, range, underlying."""
    own = dictionary.select(F.col("name"), F.nullif("range", F.lit("")).alias("range"), "underlying")
    exact = own.select(F.col("name").alias("type"), F.col("range").alias("r1"), F.col("underlying").alias("u1"))
    low = own.groupBy(F.lower("name").alias("low")).agg(F.min("range").alias("r2"))
    out = wanted.join(exact, "type", "left").withColumn("low", F.lower("type")).join(low, "low", "left").drop("low")
    out = out.withColumn("got", F.coalesce("r1", "r2")).withColumn("at", F.col("u1"))
    for _ in range(depth):
        step = own.select(F.col("name").alias("at"), F.col("range").alias("r"), F.col("underlying").alias("nxt"))
        out = out.join(step, "at", "left").withColumn("got", F.coalesce("got", "r", F.nullif(keys.type_range(F.col("at")), F.lit("NA")))).withColumn("at", F.when(F.col("got").isNull(), F.col("nxt"))).drop("r", "nxt")
    return out.select("type", F.coalesce("got", keys.type_range(F.col("type"))).alias("range"))


#: Levels of the dyadic index: ranges of up to 2 ** LEVELS lines, from 0.
LEVELS = 40


def dyadic_nodes(first: Column, last: Column) -> Column:
    """array<struct<level, node>>: the fewest dyadic intervals [node * 2^level, (node + 1) * 2^level) that make up first..last, two a level
    at most. Empty if last < first; places below 0 are left out."""
    lo, hi = F.greatest(first.cast("long"), F.lit(0)), last.cast("long") + 1
    edge = lambda x, k: F.call_function("shiftright", x, k)

    def at(k: Column) -> Column:
        # what is left after the levels below: both ends rounded inwards to multiples of 2^k
        a = edge(lo + (F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1), k)
        b = edge(hi, k)
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        left = F.when((a < b) & (a % 2 == 1), F.array(node(a))).otherwise(none)
        right = F.when((a < b) & (b % 2 == 1) & ~((a == b - 1) & (a % 2 == 1)), F.array(node(b - 1))).otherwise(none)
        return F.concat(left, right)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def dyadic_probes(place: Column) -> Column:
    """array<struct<level, node>>: the dyadic intervals that hold a place, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place.cast("long"), k).alias("node")))


def held_by(points: DataFrame, ranges: DataFrame, group: str, pos: str = "pos", line: str = "line", end_line: str = "end_line") -> DataFrame:
    """Every pair of a point and a range of its group that holds it: the columns of both. An equality join: a range is a row for each of
    its dyadic intervals (O(log length)), a point one for each level that the group's ranges use (O(log) probes at most)."""
    r = ranges.withColumn("_node", F.explode(dyadic_nodes(F.col(line), F.col(end_line)))).withColumn("_level", F.col("_node.level")).withColumn("_node", F.col("_node.node"))
    used = r.groupBy(group).agg(F.collect_set("_level").alias("_levels"))  # LEVELS + 1 at most
    probes = points.where(F.col(pos) >= 0).join(used, group)
    probes = probes.withColumn("_level", F.explode("_levels")).withColumn("_node", F.expr(f"shiftright(cast(`{pos}` as bigint), _level)")).drop("_levels")
    return probes.join(r, [group, "_level", "_node"]).drop("_level", "_node")


def line_ranges(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (doc, rid, line, end_line) with the text of their lines (doc, pos, text), from the dyadic index."""
    # places are matched without their texts, which would travel once for each level of the index
    at = held_by(lines.select("doc", "pos").distinct(), ranges, "doc").select("doc", "pos", "rid")
    joined = lines.join(at.hint("merge"), ["doc", "pos"]).groupBy("doc", "rid").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("m"))
    return joined.select("doc", "rid", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"))


def in_range_first(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (grp, pos) with label: the first (by ord) of the ranges (grp, line, end_line, label, ord) that hold the point; null if none."""
    best = held_by(points, ranges, "grp").groupBy("grp", "pos").agg(F.min_by("label", "ord").alias("label"))
    return points.join(best, ["grp", "pos"], "left")


def nearest_before(points: DataFrame, marks: DataFrame, reach: int) -> DataFrame:
    """points (grp, pos) with the value of the nearest mark (grp, pos, value) at or up to `reach` before: one ordered pass
    over both, no range join."""
    both = points.select("grp", "pos", F.lit(None).cast(marks.schema["value"].dataType).alias("value"), F.lit(1).alias("side")).unionByName(marks.select("grp", "pos", "value", F.lit(0).alias("side")))
    w = Window.partitionBy("grp").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct("pos", "value")), ignorenulls=True).over(w)
    out = both.withColumn("m", seen).where("side = 1")
    return out.select("grp", "pos", F.when(F.col("pos") - F.col("m.pos") <= reach, F.col("m.value")).alias("value"))


def prefix_match(refs: DataFrame, candidates: DataFrame, width: int = 4) -> DataFrame:
    """refs (ref) with the first candidate (id, sha, tag, ord) whose id, tag or sha equals the ref, or whose sha begins with it.
    Refs shorter than `width` characters meet the first candidate of each beginning. For others the first `width` characters tell which
    lengths of ref can occur, and the first candidate of each beginning of such a length is what the ref meets: no ref meets
    all candidates that begin alike. A whole sha is a beginning, so only an empty one is met as such."""
    exact = candidates.select(F.explode(F.array_distinct(F.array("id", "tag", F.when(F.col("sha") == "", "")))).alias("ref"), "id", "ord").where("ref is not null")
    a = refs.hint("merge").join(exact, "ref").select("ref", "id", "ord")
    first = [F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord")]
    start = lambda k: F.substr(F.col("sha"), F.lit(1), k)
    size = F.char_length("ref")
    short = candidates.select("id", "ord", F.explode(F.transform(F.sequence(F.lit(1), F.lit(width - 1)), start)).alias("ref")) if width > 1 else candidates.select("id", "ord", F.lit("").alias("ref")).limit(0)
    short = short.where(size > 0).groupBy("ref").agg(*first)
    lengths = refs.where(size >= width).groupBy(F.substr(F.col("ref"), F.lit(1), F.lit(width)).alias("head")).agg(F.collect_set(size).alias("sizes"))
    long = candidates.select("id", "sha", "ord", start(F.lit(width)).alias("head")).join(lengths, "head").select("id", "ord", "sha", F.explode("sizes").alias("k"))
    long = long.where(F.char_length("sha") >= F.col("k")).select(start(F.col("k")).alias("ref"), "id", "ord").groupBy("ref").agg(*first)
    b = refs.where((size > 0) & (size < width)).join(short, "ref").unionByName(refs.where(size >= width).hint("merge").join(long, "ref")).select("ref", "id", "ord")
    best = a.unionByName(b).groupBy("ref").agg(F.min_by("id", "ord").alias("id"))
    return refs.join(best.hint("merge"), "ref", "left")


def link_records(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """wanted (wid, name, line, end_line) with the best candidate (cid, name, line, end_line, is_def): 100 for the exact name or
    40 for the same short name, less the distance in lines, less the distance of ends up to 20, plus 20 for a definition. The smallest cid
    on a tie. Records alike in all that counts are compared once: by the smallest cid of such candidates, for all such wanted ones."""
    a = wanted.withColumn("short", keys.short_name(F.col("name")))
    b = candidates.select("cid", F.col("name").alias("cname"), F.col("line").alias("cline"), F.col("end_line").alias("cend"), "is_def").withColumn("short", keys.short_name(F.col("cname")))
    score = (F.when(F.col("name") == F.col("cname"), 100).otherwise(40) - F.abs(F.col("line") - F.col("cline"))
             - F.least(F.abs(F.col("end_line") - F.col("cend")), F.lit(20)) + F.when(F.col("is_def"), 20).otherwise(0))
    b = b.groupBy("short", "cname", "cline", "cend", "is_def").agg(F.min("cid").alias("cid"))
    asked = a.select("short", "name", "line", "end_line").distinct()
    best = asked.join(b.hint("merge"), "short").withColumn("score", score).groupBy("name", "line", "end_line").agg(F.max_by("cid", F.struct("score", -F.col("cid"))).alias("cid"), F.max("score").alias("score"))
    same = F.col("w.name").eqNullSafe(F.col("b.name")) & F.col("w.line").eqNullSafe(F.col("b.line")) & F.col("w.end_line").eqNullSafe(F.col("b.end_line"))
    met = wanted.alias("w").join(best.hint("merge").alias("b"), same).select("wid", "cid", "b.score")
    return met.groupBy("wid").agg(F.max_by("cid", F.struct("score", -F.col("cid"))).alias("cid"), F.max("score").alias("score"))


def fill_budget(items: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Items of each group taken in order until the first that would exceed the budget."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def top_k(df: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def tiered_choice(df: DataFrame, tiers: list[tuple[str, str]], budget: int, other: str) -> DataFrame:
    """choice: the first tier (text column, cost column) whose cost fits the budget, else `other`."""
    return df.withColumn("choice", F.coalesce(*[F.when(F.col(c) <= budget, F.col(t)) for t, c in tiers], F.lit(other)))

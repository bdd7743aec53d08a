"""What is told about a function or unit: diagrams with labelled edges, context packets, neighbourhoods, levels of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The first lines of a unit diagram and the style of its box; the levels of detail, the fullest first; lines of a
#: description that `DETAILED` keeps.
DIAGRAM_HEAD = ("%%{init: {'flowchart': {'splines': 'ortho'}}}%%", "flowchart LR", "  classDef internal fill:#87CEEB,stroke:#333,stroke-width:1px", "  classDef mainUnit fill:#87CEEB,stroke:#4682B4,stroke-width:3px", "")
BOX_STYLE = "    style internal_mod fill:#ffffcc,stroke:#d4d400,stroke-width:2px"
LEVELS, DETAILED_LINES = ("FULL", "DETAILED", "BRIEF", "SIGNATURE", "NAME"), 3


def _node_id(unit: Column) -> Column:
    return F.replace(F.replace(unit, F.lit("|"), F.lit("_")), F.lit(" "), F.lit("-"))


def unit_diagrams(members: DataFrame, calls: DataFrame) -> DataFrame:
    """(unit, mermaid): for each unit the units that call it and that it calls, those of its component in one box with it, and between them edges
    labelled by the interface ids that are called. members: fid, unit, component, iface (null or empty: no interface); calls: caller, callee. A unit
    that both calls and is called stands with the callers."""
    own = members.select("fid", "unit", "component", F.nullif("iface", F.lit("")).alias("iface"))
    a = own.select(F.col("fid").alias("caller"), F.col("unit").alias("f"))
    b = own.where("iface is not null").select(F.col("fid").alias("callee"), F.col("unit").alias("t"), "iface")
    edges = calls.join(a, "caller").join(b, "callee").where("f <> t").groupBy("f", "t").agg(F.array_sort(F.collect_set("iface")).alias("ids"))
    label = F.replace(F.replace(F.array_join("ids", "<br/>"), F.lit('"'), F.lit("'")), F.lit("|"), F.lit("¦"))
    edges = edges.select("f", "t", label.alias("label"))
    place = own.select("unit", "component").distinct()
    seen = edges.select(F.col("t").alias("unit"), F.col("f").alias("other"), F.lit(True).alias("calls_it"), "label").unionByName(edges.select(F.col("f").alias("unit"), F.col("t").alias("other"), F.lit(False).alias("calls_it"), "label"))
    near = seen.join(place, "unit").join(place.select(F.col("unit").alias("other"), F.col("component").alias("home")), "other")
    near = near.withColumn("inside", F.col("home") == F.col("component")).withColumn("any_in", F.max("calls_it").over(Window.partitionBy("unit", "other")))
    this, that = _node_id(F.col("unit")), _node_id(F.col("other"))
    box = lambda i, name: F.concat(i, F.lit('["'), F.replace(F.replace(name, F.lit("]"), F.lit("'")), F.lit("["), F.lit("'")), F.lit('"]'))
    line = lambda rows, section, order, text: rows.select("unit", F.lit(section).alias("section"), order.cast("string").alias("ord"), text.alias("line"))
    others = near.select("unit", "other", "home", "component", "inside", "any_in").distinct()
    shown = box(that, F.replace(F.concat_ws("/", "home", "other"), F.lit("-"), F.lit(" ")))
    arrow = F.when(F.col("calls_it"), F.concat(that, F.lit(" -->|"), F.col("label"), F.lit("| "), this)).otherwise(F.concat(this, F.lit(" -->|"), F.col("label"), F.lit("| "), that))
    ends = F.when(F.col("calls_it"), F.concat_ws(" ", that, this)).otherwise(F.concat_ws(" ", this, that))
    fixed = lambda section, *lines: place.select("unit", F.lit(section).alias("section"), F.posexplode(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])).alias("ord", "line")).select("unit", "section", F.col("ord").cast("string").alias("ord"), "line")
    quoted = F.replace(F.replace(F.replace(F.replace(F.col("component"), F.lit("-"), F.lit(" ")), F.lit('"'), F.lit("'")), F.lit("]"), F.lit("'")), F.lit("["), F.lit("'"))
    inside = others.where("inside").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((~F.col("any_in")).alias("later"), that.alias("id")))).alias("ids"))
    rows = [
        fixed(0, *DIAGRAM_HEAD), line(others.where("any_in and not inside"), 1, that, F.concat(F.lit("  "), shown)),
        fixed(2, F.concat(F.lit('  subgraph internal_mod["'), quoted, F.lit('"]')), "    direction TB", BOX_STYLE, ""),
        line(others.where("any_in and inside"), 3, that, F.concat(F.lit("    "), shown)), fixed(4, F.concat(F.lit("    "), box(this, F.col("unit")))),
        line(others.where("not any_in and inside"), 5, that, F.concat(F.lit("    "), shown)), fixed(6, ""), line(near.where("inside"), 7, ends, F.concat(F.lit("    "), arrow)),
        fixed(8, "", F.concat(F.lit("    class "), this, F.lit(" mainUnit"))),
        line(inside, 9, F.lit(""), F.concat(F.lit("    class "), F.array_join(F.transform("ids", lambda x: x["id"]), ","), F.lit(" internal"))), fixed(10, "  end", ""),
        line(others.where("not any_in and not inside"), 11, that, F.concat(F.lit("  "), shown)), fixed(12, ""),
        line(near.where("not inside and (calls_it or not any_in)"), 13, ends, F.concat(F.lit("  "), arrow)),
    ]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    listed = whole.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("section", "ord", "line"))).alias("x"))
    return listed.select("unit", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("mermaid"))


def context_packets(functions: DataFrame, calls: DataFrame, access: DataFrame, globals_: DataFrame, types: DataFrame, phases: DataFrame, most: int = 5) -> DataFrame:
    """(fid, packet): what is known about each function before its callees: where it lies, who calls it and why, its parameters and what their types mean,
    its purpose, its phases, the globals it reads and writes; parts that have nothing to say are left out. functions: fid, name, project, component,
    file, description, params (array of structs of type, name); access: fid, gid, mode (r, w); globals_: gid, name, said; types: type, said; phases: fid,
    start_line, end_line, said. Callers and globals: the first `most` by name."""
    def gathered(rows: DataFrame, order: list[str], text: Column, head: str, alias: str) -> DataFrame:
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("fid").orderBy(*order))).where(F.col("_k") <= most)
        listed = first.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("_k", text.alias("line")))).alias("x"))
        return listed.select("fid", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: F.concat(F.lit("\n  "), x["line"])), "")).alias(alias))

    said = lambda name, about: F.concat(name, F.when(F.coalesce(about, F.lit("")) != "", F.concat(F.lit(": "), about)).otherwise(""))
    names = functions.select(F.col("fid").alias("caller"), F.col("name").alias("caller_name"), F.col("description").alias("why"))
    callers = gathered(calls.select("caller", F.col("callee").alias("fid")).distinct().join(names, "caller"), ["caller_name", "caller"], said(F.col("caller_name"), F.col("why")), "Called by:", "callers")
    used = access.groupBy("fid", "gid").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("mode") == "w", "writes").otherwise("reads"))), " and ").alias("how")).join(globals_.withColumnRenamed("name", "global"), "gid")
    held = gathered(used, ["global", "gid"], F.concat(F.col("how"), F.lit(" "), said(F.col("global"), F.col("said"))), "Globals:", "globals")
    steps = phases.withColumn("_n", F.row_number().over(Window.partitionBy("fid").orderBy("start_line", "end_line")))
    steps = steps.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("_n", F.concat(F.lit("\n  Phase "), "_n", F.lit(" (lines "), "start_line", F.lit("-"), "end_line", F.lit("): "), F.col("said")).alias("line")))).alias("x"))
    steps = steps.select("fid", F.concat(F.lit("Function execution phases:"), F.array_join(F.transform("x", lambda x: x["line"]), "")).alias("phases"))
    typed = functions.select("fid", F.posexplode("params").alias("_k", "p")).select("fid", "_k", F.col("p.type").alias("type"))
    meant = typed.groupBy("fid", "type").agg(F.min("_k").alias("_k")).join(types, "type")
    meant = meant.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.lit("\n  "), "type", F.lit(": "), "said").alias("line")))).alias("x"))
    meant = meant.select("fid", F.concat(F.lit("Parameter type context:"), F.array_join(F.transform("x", lambda x: x["line"]), "")).alias("meanings"))
    out = functions
    for part in (callers, meant, steps, held):
        out = out.join(part, "fid", "left")
    place = F.concat_ws(" > ", "project", "component", "file")
    params = F.when(F.size("params") > 0, F.concat(F.lit("Parameters: "), F.array_join(F.transform("params", lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"]))), ", ")))
    purpose = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("Purpose: "), F.col("description")))
    return out.select("fid", F.concat_ws("\n", F.concat(F.lit("Location: "), place), "callers", params, "meanings", purpose, "phases", "globals").alias("packet"))


def detail_text(level: Column, name: Column, signature: Column, description: Column, source: Column) -> Column:
    """A function's text at a level of detail (an index into LEVELS): signature, description and source; signature and three lines of the description;
    and its first line; the signature; the name. What isn't known is left out; the name stands for a missing signature."""
    given = lambda c: F.nullif(c, F.lit(""))
    head = F.coalesce(given(signature), name)
    lines = F.split(F.trim(F.regexp_replace(description, r"^\s+|\s+$", "")), "\r?\n")
    some = lambda n: given(F.array_join(F.slice(lines, 1, n), "\n"))
    full = F.concat_ws("\n", given(signature), given(description), given(source))
    return (F.when(level == 0, F.coalesce(given(full), name)).when(level == 1, F.concat_ws("\n", head, some(DETAILED_LINES))).when(level == 2, F.concat_ws("\n", head, some(1))).when(level == 3, head).otherwise(name))


def neighbourhoods(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """(fid, file, members): for every function the functions around it by file: those it calls, those that call it, and all of its own file, each a
    line `name [role]` in order of names, its own first in its file as `target`. functions: fid, name, file; calls: caller, callee. A file's list is made
    once and goes to its functions as an array; what a function does both to counts as callee."""
    named = functions.select("fid", "name", "file")
    role = calls.where("caller <> callee").select(F.col("caller").alias("fid"), F.col("callee").alias("other"), F.lit("callee").alias("role")).unionByName(calls.where("caller <> callee").select(F.col("callee").alias("fid"), F.col("caller").alias("other"), F.lit("caller").alias("role")))
    role = role.groupBy("fid", "other").agg(F.min("role").alias("role"))  # callee before caller
    other = named.select(F.col("fid").alias("other"), F.col("name").alias("other_name"), F.col("file").alias("other_file"))
    linked = role.join(other, "other").groupBy("fid", F.col("other_file").alias("file")).agg(F.collect_list(F.struct(F.col("other_name").alias("name"), F.col("other").alias("id"), "role")).alias("linked"))
    lists = named.groupBy("file").agg(F.collect_list(F.struct("name", F.col("fid").alias("id"))).alias("all"))
    own = named.select("fid", "name", "file").join(lists, "file").join(linked, ["fid", "file"], "left")
    line = lambda m: F.concat(m["name"], F.when(m["role"].isNull(), "").otherwise(F.concat(F.lit(" ["), m["role"], F.lit("]"))))
    text = lambda ms: F.array_join(F.transform(F.array_sort(ms), line), "\n")
    none = F.array().cast(linked.schema["linked"].dataType)
    at = F.coalesce("linked", none)
    ids = F.transform(at, lambda m: m["id"])
    rest = F.filter("all", lambda m: (m["id"] != F.col("fid")) & ~F.array_contains(ids, m["id"]))
    rest = F.transform(rest, lambda m: F.struct(m["name"].alias("name"), m["id"].alias("id"), F.lit(None).cast("string").alias("role")))
    target = F.concat(F.col("name"), F.lit(" [target]"))
    mine = own.select("fid", "file", F.concat_ws("\n", target, F.nullif(text(F.concat(at, rest)), F.lit(""))).alias("members"))
    away = linked.join(named.select("fid", "file"), ["fid", "file"], "left_anti").select("fid", "file", text(F.col("linked")).alias("members"))
    return mine.unionByName(away)

"""Documents and flow graphs as rows: diagrams, roll-ups, section trees, chains, knowledge of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.document import edge_line, node_line
from factloom.functions.text import edge_label
from factloom.operators.sequential import breadth_first_order, reverse_post_order
from factloom.scratch import Scratch


def _listed(rows: DataFrame, key: list[str], order: str, text: str, alias: str) -> DataFrame:
    """(key, alias): an array of texts in order."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]).alias(alias))


def flow_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(grp, mermaid): a graph's text, its nodes breadth first from the least, then its edges in order. nodes: grp, node (long), type,
    label; edges: grp, source, target, label, ord."""
    name = lambda c: F.concat(F.lit("N"), F.col(c))
    alone = nodes.select("grp", F.col("node").alias("source"), F.lit(None).cast("long").alias("target"))
    places = breadth_first_order(edges.select("grp", "source", "target").unionByName(alone))
    # tables of a row a node look small to Spark while they are columns of a small file: the hints keep them off the driver
    drawn = nodes.hint("merge").join(places, ["grp", "node"]).select("grp", "place", node_line(name("node"), F.col("type"), F.col("label")).alias("t"))
    linked = edges.select("grp", "ord", edge_line(name("source"), name("target"), edge_label(F.col("label"))).alias("t"))
    both = _listed(drawn, ["grp"], "place", "t", "n").join(_listed(linked, ["grp"], "ord", "t", "e").hint("merge"), "grp", "left")
    lines = F.concat(F.array(F.lit("flowchart TD")), F.col("n"), F.array(F.lit("")), F.coalesce("e", F.array().cast("array<string>")))
    return both.select("grp", F.array_join(lines, "\n").alias("mermaid"))


def component_diagram(units: DataFrame) -> DataFrame:
    """(component, mermaid): a box for each component with a box and an arrow for each of its units in order of their names. units:
    component, unit."""
    ranked = units.distinct().groupBy("component").agg(F.array_sort(F.collect_list("unit")).alias("u"))
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("'"))
    boxes = F.flatten(F.transform("u", lambda u, i: F.array(F.concat(F.lit("  U"), i, F.lit('["'), quoted(u), F.lit('"]')), F.concat(F.lit("  MOD --> U"), i))))
    kinds = F.array(F.concat(F.lit("  class "), F.array_join(F.transform("u", lambda _, i: F.concat(F.lit("U"), i)), ","), F.lit(" unitNode")))
    return ranked.select("component", F.array_join(F.concat(F.array(F.lit("flowchart TB"), F.concat(F.lit('  MOD["'), quoted(F.col("component")), F.lit('"]'))), boxes, kinds), "\n").alias("mermaid"))


def roll_up(functions: DataFrame) -> DataFrame:
    """(level, name, parent, n): functions counted by file, files by directory, directories by project; a file in no directory is in
    `.`. functions: file, name; a name counts once in its file."""
    path = F.translate("file", "\\", "/")
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    files = functions.where("file is not null and file <> ''").select("file", "name").distinct().groupBy("file").agg(F.count("*").alias("n"))
    files = files.select(F.lit("file").alias("level"), F.col("file").alias("name"), folder.alias("parent"), "n")
    folders = files.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n")).select(F.lit("directory").alias("level"), "name", F.lit("project").alias("parent"), "n")
    project = folders.agg(F.count("*").alias("n")).select(F.lit("project").alias("level"), F.lit("project").alias("name"), F.lit(None).cast("string").alias("parent"), "n")
    return files.unionByName(folders).unionByName(project)


def section_tree(units: DataFrame, introduction: list[tuple[str, str]]) -> DataFrame:
    """(section, parent, ord, title, body): a document as an adjacency list. First the introduction (id, title) with the list of all
    components as the body of its first part, then a section for each component with its table of units, then one for each unit.
    units: component, unit, description."""
    once = units.groupBy("component", "unit").agg(F.array_sort(F.array_distinct(F.collect_list(F.nullif(F.trim("description"), F.lit(""))))).alias("d"))
    described = once.select("component", "unit", F.coalesce(F.nullif(F.array_join("d", "; "), F.lit("")), F.lit("-")).alias("text"))
    names = described.agg(F.array_join(F.array_sort(F.collect_set("component")), ", ").alias("all"))
    spark = units.sparkSession
    intro = spark.createDataFrame([(f"intro-{i}", None if k == 0 else f"intro-{introduction[0][0]}", f"0.{k:04d}", title) for k, (i, title) in enumerate(introduction)], "section string, parent string, ord string, title string")
    intro = intro.crossJoin(F.broadcast(names)).select("section", "parent", "ord", "title", F.when(F.col("parent").isNull(), F.col("all")).otherwise("").alias("body"))
    rows = _listed(described.withColumn("t", F.concat_ws(" | ", "component", "unit", "text")), ["component"], "unit", "t", "rows")
    parts = rows.select(F.concat(F.lit("component-"), "component").alias("section"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit("1."), "component").alias("ord"), F.col("component").alias("title"), F.array_join("rows", "\n").alias("body"))
    leaves = described.select(F.concat_ws("-", F.lit("unit"), "component", "unit").alias("section"), F.concat(F.lit("component-"), "component").alias("parent"), F.concat(F.lit("1."), "component", F.lit("."), "unit").alias("ord"), F.col("unit").alias("title"), F.col("text").alias("body"))
    return intro.unionByName(parts).unionByName(leaves)


# ---- flow graphs ----------------------------------------------------------------------------------------------------
LOOPS, LEAVABLE = ("while", "for", "do"), ("while", "for", "do", "switch")


def _entries(s: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(fkey, id, entry) of the `do` statements: where they are entered, at the first statement of their body, which may be a `do` itself.
    None if there are none. Pointers are doubled each round."""
    dos = s.where("kind = 'do'").select("fkey", "id")
    if dos.isEmpty():
        return None
    body = s.where("branch = 'body'").groupBy("fkey", F.col("parent").alias("id")).agg(F.min(F.struct("ord", F.col("id").alias("first")))["first"].alias("entry"))
    at = scratch.put(dos.join(body, ["fkey", "id"]), "entries")
    while True:
        further = at.select("fkey", F.col("id").alias("entry"), F.col("entry").alias("next"))
        moved = scratch.put(at.join(further.hint("merge"), ["fkey", "entry"], "left").select("fkey", "id", F.coalesce("next", "entry").alias("entry"), F.col("next").isNotNull().alias("moved")), "entries")
        if moved.where("moved").isEmpty():
            return moved.drop("moved")
        at = moved.drop("moved")


def _with_path(s: DataFrame, scratch: Scratch) -> DataFrame:
    """s (fkey, id, parent, kind, lead, ..) with `path`: the statement and all that it lies in, innermost first, as structs of id, kind and
    lead. The length doubles each round, so a function's depth costs its logarithm."""
    at = s.withColumn("path", F.array(F.struct("id", "kind", "lead"))).withColumn("up", F.col("parent"))
    while True:
        at = scratch.put(at, "paths")
        if at.where("up <> 0").isEmpty():
            return at.drop("up")
        above = at.select("fkey", F.col("id").alias("up"), F.col("path").alias("more"), F.col("up").alias("further"))
        at = at.join(above.hint("merge"), ["fkey", "up"], "left").withColumn("path", F.concat("path", F.coalesce("more", F.array().cast(at.schema["path"].dataType))))
        at = at.withColumn("up", F.coalesce("further", F.lit(0).cast("long"))).drop("more", "further")


def _after(path: Column) -> Column:
    """The node that follows the first statement of a path: the next one in its list; else, as its list ends, what follows the list."""
    def known(x: Column, i: Column) -> Column:
        outer = F.get(path, i + 1)
        ends = F.when(outer.isNull(), F.lit(-1).cast("long")).when(outer["kind"].isin(*LOOPS), outer["id"])
        # handlers are alternatives: one is not followed by the next
        return F.coalesce(F.when(x["kind"] != "catch", x["lead"]), ends)

    return F.get(F.filter(F.transform(path, known), lambda v: v.isNotNull()), F.lit(0))


def _around(path: Column, kinds: tuple[str, ...]) -> Column:
    """The rest of a path from the innermost statement around the first that is of one of the kinds; empty if there is none."""
    at = F.array_position(F.transform(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda x: x["kind"].isin(*kinds)), True)
    return F.when(at > 0, F.slice(path, (at + 1).cast("int"), F.size(path)))


def statement_flow(statements: DataFrame) -> DataFrame:
    """(fkey, source, target, label): edges of each function's flow graph. statements: fkey, id (long, from 1), parent (null at the top), branch (which part
    of the parent: `then`, `else`, `body`, `catch`), ord, kind (action, if, while, for, do, switch, case, default, try, catch, return, break, continue,
    goto, label; any other is an action, `throw` too), name (of a label, a goto's target, a case's value). Node 0 is the start, -1 the end.

    A try goes on to its body, and by `exception` to each of its handlers, which are its children in the branch `catch`; body and
    handlers go on after the try. An empty branch is passed. A break or continue outside a loop goes to the end, a goto without a label on. All
    functions are built at once, by joins: no function is a group in a task. Of labels of one name the last id counts."""
    scratch = Scratch(statements.sparkSession, "flow")
    zero = F.lit(0).cast("long")
    s = statements.select("fkey", F.col("id").cast("long").alias("id"), F.coalesce(F.col("parent").cast("long"), zero).alias("parent"), F.coalesce("branch", F.lit("body")).alias("branch"), "ord", F.coalesce("kind", F.lit("action")).alias("kind"), "name")
    entries = _entries(s, scratch)
    s = s.withColumn("entry", F.col("id")) if entries is None else s.join(entries.hint("merge"), ["fkey", "id"], "left").withColumn("entry", F.coalesce("entry", "id"))
    listed = s.withColumn("lead", F.lead("entry").over(Window.partitionBy("fkey", "parent", "branch").orderBy("ord", "id")))
    at = _with_path(listed, scratch)
    first = lambda b: F.min(F.when(F.col("branch") == b, F.struct("ord", "id", "entry")))["entry"].alias(f"first_{b}")
    kids = at.groupBy("fkey", F.col("parent").alias("id")).agg(first("then"), first("else"), first("body"), F.max(F.col("kind") == "default").alias("has_default"))
    labels = at.where("kind = 'label'").groupBy("fkey", "name").agg(F.max("id").alias("label_id")).withColumn("kind", F.lit("goto"))
    top = kids.where("id = 0").select("fkey", zero.alias("source"), F.coalesce("first_body", F.lit(-1).cast("long")).alias("target"), F.lit(None).cast("string").alias("label"))
    whole = at.join(kids.hint("merge"), ["fkey", "id"], "left").join(labels.hint("merge"), ["fkey", "name", "kind"], "left")
    path, kind, end = F.col("path"), F.col("kind"), F.lit(-1).cast("long")
    whole = whole.withColumn("nxt", _after(path)).withColumn("leave", F.when(kind == "break", F.coalesce(_after(_around(path, LEAVABLE)), end))).withColumn("again", F.when(kind == "continue", F.coalesce(F.get(_around(path, LOOPS), F.lit(0))["id"], end)))
    edge = lambda target, label=None, source="id": F.struct(F.col(source).alias("source"), target.alias("target"), (F.lit(label) if label is None or isinstance(label, str) else label).cast("string").alias("label"))
    into = lambda b, empty="nxt": F.coalesce(F.col(f"first_{b}"), F.col(empty))
    outer = F.get(path, F.lit(1))["kind"]
    case = edge(F.col("id"), F.when(kind == "default", "default").otherwise(F.concat(F.lit("case "), F.coalesce("name", F.lit("")))), "parent")
    caught = edge(F.col("id"), "exception", "parent")
    out = (
        F.when(kind == "if", F.array(edge(into("then"), "Yes"), edge(into("else"), "No")))
        .when(kind.isin(*LOOPS), F.array(edge(into("body", "id"), "Yes"), edge(F.col("nxt"), "No")))
        .when(kind == "switch", F.when(F.coalesce("has_default", F.lit(False)), F.array().cast("array<struct<source:bigint,target:bigint,label:string>>")).otherwise(F.array(edge(F.col("nxt"), "default"))))
        .when(kind.isin("case", "default") & (outer == "switch"), F.array(case, edge(into("body"))))
        .when((kind == "catch") & (outer == "try"), F.array(caught, edge(into("body"))))
        .when(kind == "try", F.array(edge(into("body"))))
        .otherwise(F.array(edge(F.when(kind == "return", end).when(kind == "break", F.col("leave")).when(kind == "continue", F.col("again")).when(kind == "goto", F.coalesce("label_id", "nxt")).otherwise(F.col("nxt")))))
    )
    return top.unionByName(whole.select("fkey", F.explode(out).alias("x")).select("fkey", "x.*"))


def forward_in_degree(edges: DataFrame) -> DataFrame:
    """(grp, node, n): edges into a node that close no cycle of a depth-first walk. edges: grp, source, target."""
    walked = reverse_post_order(edges.select("grp", "source", "target").distinct())
    return walked.where("not is_back").groupBy("grp", F.col("target").alias("node")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(grp, node, ins, outs) of the nodes that have an edge."""
    ends = edges.select("grp", F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("grp", F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("grp", "node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def contract(nodes: DataFrame, edges: DataFrame, groups: DataFrame, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with each proposed chain in one node, its head. nodes: grp, node, code; edges: grp, source, target, label; groups: grp,
    chain, pos, node. A chain is taken if every node but the last has one way out, to the next, and every node but the head one way in;
    else it stays as it is. Codes are joined by `; `, `most` characters at most."""
    d = degrees(edges)
    step = groups.select("grp", "chain", F.col("pos"), F.col("node")).join(d, ["grp", "node"], "left")
    nxt = groups.select("grp", "chain", (F.col("pos") - 1).alias("pos"), F.col("node").alias("following"))
    first = groups.groupBy("grp", "chain").agg(F.min_by("node", "pos").alias("head"), F.max_by("node", "pos").alias("tail"), F.min("pos").alias("first"), F.count("*").alias("size"))
    way = edges.select("grp", F.col("source").alias("node"), F.col("target").alias("following"), F.lit(True).alias("linked")).distinct()
    seen = step.join(first, ["grp", "chain"]).join(nxt, ["grp", "chain", "pos"], "left").join(way, ["grp", "node", "following"], "left")
    wrong = ((F.col("following").isNotNull()) & ((F.col("outs") != 1) | F.col("linked").isNull())) | ((F.col("pos") > F.col("first")) & (F.coalesce("ins", F.lit(0)) != 1))
    good = seen.groupBy("grp", "chain").agg(F.max(wrong).alias("wrong")).where("not wrong").join(first.where("size > 1"), ["grp", "chain"])
    into = groups.join(good.select("grp", "chain", "head", "tail"), ["grp", "chain"]).select("grp", "node", "pos", "head", "tail")
    code = into.join(nodes, ["grp", "node"]).withColumn("c", F.trim(F.coalesce("code", F.lit(""))))
    code = _listed(code.where("c <> ''"), ["grp", "head"], "pos", "c", "codes").select("grp", F.col("head").alias("node"), F.substring(F.array_join("codes", "; "), 1, most).alias("joined"))
    inner = into.where("node <> head").select("grp", "node", "head", (F.col("node") == F.col("tail")).alias("is_tail"))
    kept = nodes.join(inner, ["grp", "node"], "left_anti").join(code, ["grp", "node"], "left").select("grp", "node", F.coalesce("joined", "code").alias("code"))
    s = inner.select("grp", F.col("node").alias("source"), F.col("head").alias("new_source"), "is_tail")
    t = inner.select("grp", F.col("node").alias("target"), F.lit(True).alias("inside"))
    links = edges.join(s, ["grp", "source"], "left").join(t, ["grp", "target"], "left").where("inside is null and (new_source is null or is_tail)")
    return kept, links.select("grp", F.coalesce("new_source", "source").alias("source"), "target", "label")


def bypass(edges: DataFrame, dropped: DataFrame) -> DataFrame:
    """edges (grp, source, target, label) without the nodes `dropped` (grp, node), of which no two are neighbours: a node with one way in and
    one way out is replaced by a link between its neighbours, labelled as the way in, else as the way out; others stay."""
    d = dropped.select("grp", "node").join(degrees(edges).where("ins = 1 and outs = 1"), ["grp", "node"], "left_semi")
    before = edges.select("grp", F.col("target").alias("node"), F.col("source").alias("pred"), F.col("label").alias("l1"))
    after = edges.select("grp", F.col("source").alias("node"), F.col("target").alias("succ"), F.col("label").alias("l2"))
    new = d.join(before, ["grp", "node"]).join(after, ["grp", "node"]).select("grp", F.col("pred").alias("source"), F.col("succ").alias("target"), F.coalesce(F.nullif("l1", F.lit("")), "l2").alias("label"))
    rest = edges.join(d.withColumnRenamed("node", "source"), ["grp", "source"], "left_anti").join(d.withColumnRenamed("node", "target"), ["grp", "target"], "left_anti")
    new = new.groupBy("grp", "source", "target").agg(F.min("label").alias("label")).join(rest, ["grp", "source", "target"], "left_anti")
    return rest.select("grp", "source", "target", "label").unionByName(new)


# ---- choices --------------------------------------------------------------------------------------------------------
def choose_baseline(auto: Column, chosen: Column, status: Column, is_ancestor: Column) -> Column:
    """struct(base, decision, warning). auto: the nearest complete ancestor version or null; chosen: the version asked for or null; status: its
    status, null if there is no such version."""
    usable = chosen.isNotNull() & F.coalesce(status == "complete", F.lit(False))
    base = F.when(usable, chosen).otherwise(auto)
    warning = (
        F.when(chosen.isNotNull() & status.isNull(), "not found; using auto baseline").when(chosen.isNotNull() & ~usable, "not complete; using auto baseline")
        .when(usable & ~is_ancestor, "not an ancestor; close to a full run").when(usable & auto.isNotNull() & (auto != chosen), "not the nearest ancestor")
    )
    return F.struct(base.alias("base"), F.when(base.isNull(), "full").otherwise("incremental").alias("decision"), warning.alias("warning"))


def known_tokens(code: DataFrame, enums: DataFrame, macros: DataFrame, typedefs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, kind, name, said): what the words of a code (id, code) are known as. enums: name, value (null: no value), said; macros, typedefs: name,
    said; members: struct_name, ord, member, said. An enum is met by its name or one of its values, once; a macro by a word of three
    capitals or more; a member by an access (`.x`, `->x`), in the first struct that has it. Spark takes the words of a code for no larger than
    the code's file; the hint keeps them from being broadcast."""
    words = lambda pattern: code.select("id", F.explode(F.regexp_extract_all("code", F.lit(pattern), 1)).alias("w")).distinct().hint("merge")
    any_word = words(r"\b([A-Za-z_]\w*)\b")
    names = enums.select(F.col("name").alias("w"), "name", "said").unionByName(enums.where("value is not null").select(F.col("value").alias("w"), "name", "said")).distinct()
    first = members.groupBy(F.col("member").alias("w")).agg(F.min_by("said", F.struct("ord", "struct_name")).alias("said"))
    said = lambda df, kind: df.select("id", F.lit(kind).alias("kind"), F.col("w").alias("name"), "said").distinct()
    return (
        any_word.join(names, "w").select("id", F.lit("enum").alias("kind"), "name", "said").distinct()
        .unionByName(said(words(r"\b([A-Z_][A-Z0-9_]{2,})\b").join(macros.withColumnRenamed("name", "w"), "w"), "macro"))
        .unionByName(said(any_word.join(typedefs.withColumnRenamed("name", "w"), "w"), "typedef"))
        .unionByName(said(words(r"(?:\.|->)\s*([A-Za-z_]\w*)").join(first, "w"), "member"))
    )


# ---- the tree of a whole document -----------------------------------------------------------------------------------
_SECTION = ("section", "parent", "number", "title", "level", "type", "body", "input_name", "output_name", "path")


def _section(rows: DataFrame, section: Column, parent: Column, number: Column, title: Column, level: int, kind: Column | str, body: Column, path: list[Column | int], names: bool = False) -> DataFrame:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    place = F.array(*[(p if isinstance(p, Column) else F.lit(p)).cast("int") for p in path])
    given = [F.col(c).cast("string") if names else F.lit(None).cast("string") for c in ("input_name", "output_name")]
    values = [section, parent, number, title, F.lit(level), text(kind), body, *given, place]
    return rows.select(*[(v if c in ("level", "path") else v.cast("string")).alias(c) for c, v in zip(_SECTION, values, strict=True)])


def render_tree(units: DataFrame, interfaces: DataFrame, headers: DataFrame, flowcharts: DataFrame, behaviours: DataFrame, diagrams: DataFrame,
                purpose: str, scope: str, terms: DataFrame, appendices: list[tuple[str, str]], most: int = 120) -> DataFrame:
    """A whole document as rows: section, parent, number (empty: not numbered), title, level, type, body, input_name, output_name and path, by which
    they are in order. The table of contents are the rows that have a number.

    1 is the introduction (purpose, scope with the components, terms). Then each component has its static design (diagrams, a table of its units,
    and for each unit: diagram, n.1.u.1 header, n.1.u.2 interface, n.1.u.3 .. its functions) and its dynamic behaviour; the appendices (title,
    body) come last. units: component, unit; interfaces: component, unit, ord, fid, name, kind (`Function`, `Global Variable`), description,
    hidden, cells (array of texts), input_name, output_name; headers: component, unit, ord, declaration, information; flowcharts: component, unit, name,
    mermaid; behaviours: component, unit, ord, name, external; diagrams: component, unit (null for a component's), kind (`container`,
    `dependency`, `unit`). What is hidden isn't shown. Numbers are ranks within the parent, so all kinds of section come from one pass over
    their own rows; only the list of components is ranked as a whole."""
    lit, num = F.lit, lambda *p: F.concat_ws(".", *p)
    whole = interfaces.where(~F.coalesce("hidden", lit(False)))
    # ranks
    names = units.select("component").distinct().withColumn("n", F.row_number().over(Window.orderBy("component")) + 1)  # a row a component
    ranked = units.select("component", "unit").distinct().join(names, "component").withColumn("u", F.row_number().over(Window.partitionBy("component").orderBy("unit")))
    at = ["component", "unit"]
    shown = F.replace("component", lit("-"), lit(" "))
    unit_id = F.concat_ws("|", *at)
    static = F.concat(F.col("component"), lit("-static"))
    unit_section = F.concat(F.col("component"), lit("-unit-"), F.col("u"))
    number = num(F.col("n"), lit(1), F.col("u"))
    none = lit(None).cast("string")
    out = []
    # introduction
    one = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list("component")), lambda c: F.concat(lit("• "), F.replace(c, lit("-"), lit(" ")))), "\n").alias("list"), F.count("*").alias("count"))
    listed_terms = terms.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" | ", "term", "meaning"))), "\n").alias("t"))
    out.append(_section(one, lit("intro"), none, lit("1"), lit("Introduction"), 1, "richtext", none, [1]))
    out.append(_section(one, lit("intro-purpose"), lit("intro"), lit("1.1"), lit("Purpose"), 2, "richtext", lit(purpose), [1, 1]))
    out.append(_section(one, lit("intro-scope"), lit("intro"), lit("1.2"), lit("Scope"), 2, "richtext", F.concat_ws("\n", lit(scope), F.nullif("list", lit(""))), [1, 2]))
    empty_terms = F.col("t") == ""
    out.append(_section(listed_terms, lit("intro-terms"), lit("intro"), lit("1.3"), lit("Terms, Abbreviations and Definitions"), 2, F.when(empty_terms, "richtext").otherwise("table"), F.when(empty_terms, "[Terms, abbreviations and definitions.]").otherwise(F.col("t")), [1, 3]))
    # components
    n = F.col("n")
    comp = F.concat(lit("comp-"), F.col("component"))
    out.append(_section(names, comp, none, n, shown, 1, "richtext", none, [n]))
    out.append(_section(names, static, comp, num(n, lit(1)), lit("Static Design"), 2, "richtext", none, [n, 1]))
    out.append(_section(names, F.concat(F.col("component"), lit("-dynamic")), comp, num(n, lit(2)), lit("Dynamic Behaviour"), 2, "richtext", none, [n, 2]))
    for k, (kind, suffix, title, said) in enumerate((("container", "container", "Component Structure", "Component structure for "), ("dependency", "dep", "Include Dependencies", "Include dependencies for "))):
        drawn = diagrams.where((F.col("kind") == kind) & F.col("unit").isNull()).select("component").distinct().join(names, "component")
        out.append(_section(drawn, F.concat(F.col("component"), lit(f"-{suffix}")), static, lit(""), lit(title), 3, "diagram", F.concat(lit(said), shown, lit(".")), [n, 1, 0, k]))
    # what is said about a unit: its functions' descriptions, then its variables', each once
    said = F.trim(F.regexp_replace(F.coalesce("description", lit("")), r"\s+", " "))
    told = whole.withColumn("said", said).where("said not in ('', '-', 'N/A')").withColumn("later", (F.col("kind") == "Global Variable").cast("int"))
    told = told.groupBy(*at).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("later", "ord", "said"))), lambda x: x["said"])), "; ").alias("told"))
    lines = ranked.join(told, at, "left").select("component", "n", F.struct("u", F.concat_ws(" | ", shown, "unit", F.coalesce(F.substring("told", 1, most), lit("N/A")), lit("N/A")).alias("line")).alias("x"))
    table = lines.groupBy("component", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("rows"))
    out.append(_section(table, F.concat(F.col("component"), lit("-unit-table")), static, lit(""), lit("Component/Unit Table"), 3, "table", F.col("rows"), [n, 1, 0, 2]))
    # units
    u = F.col("u")
    out.append(_section(ranked, unit_section, static, number, F.col("unit"), 3, "richtext", none, [n, 1, u]))
    drawn = diagrams.where((F.col("kind") == "unit") & F.col("unit").isNotNull()).select(*at).distinct().join(ranked, at)
    out.append(_section(drawn, F.concat(lit("unit-"), unit_id), unit_section, lit(""), F.concat(lit("Unit — "), F.col("unit")), 4, "diagram", F.concat(lit("Static structure of unit "), F.col("unit"), lit(".")), [n, 1, u, 0]))
    for k, (suffix, title, rows, line) in enumerate((
        ("header", "unit header", headers, F.concat_ws(" | ", F.coalesce("declaration", lit("N/A")), F.coalesce("information", lit("N/A")))),
        ("iface", "unit interface", whole, F.array_join("cells", " | "))), 1):
        own = rows.groupBy(*at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
        given = ranked.join(own, at, "left")
        out.append(_section(given, F.concat(unit_id, lit(f"-{suffix}")), unit_section, num(number, lit(k)), lit(title), 4, F.when(F.col("rows").isNull(), "richtext").otherwise("table"), F.coalesce("rows", lit("NA")), [n, 1, u, k]))
    # functions
    functions = whole.where((F.col("kind") != "Global Variable") & (F.coalesce("name", lit("")) != "")).withColumn("f", F.row_number().over(Window.partitionBy(*at).orderBy("ord", "fid")) + 2)
    charts = flowcharts.where(F.coalesce("mermaid", lit("")) != "").select(*at, "name").distinct().withColumn("chart", lit(True))
    functions = functions.join(ranked, at).join(charts, [*at, "name"], "left")
    f = F.col("f")
    out.append(_section(functions, F.concat(unit_id, lit("-fn-"), F.col("name")), unit_section, num(number, f), F.concat_ws("-", "unit", "name"), 4, F.when(F.col("chart"), "flowchart_table").otherwise("richtext"),
                        F.coalesce(F.nullif("description", lit("")), lit("-")), [n, 1, u, f], names=True))
    # behaviour
    secret = interfaces.where(F.coalesce("hidden", lit(False))).select(*at, "name").distinct()
    acts = behaviours.join(secret, [*at, "name"], "left_anti").withColumn("b", F.row_number().over(Window.partitionBy("component").orderBy("unit", "ord", "name"))).join(names, "component")
    spoken = whole.groupBy(*at, "name").agg(F.min_by("input_name", "ord").alias("input_name"), F.min_by("output_name", "ord").alias("output_name"))
    acts = acts.join(spoken, [*at, "name"], "left")
    b = F.col("b")
    title = F.concat(F.concat_ws(" - ", "unit", "name"), F.when(F.coalesce("external", lit("")) != "", F.concat(lit(" ("), F.col("external"), lit(")"))).otherwise(""))
    out.append(_section(acts, F.concat(F.col("component"), lit("-dyn-"), b), F.concat(F.col("component"), lit("-dynamic")), num(n, lit(2), b), title, 3, "behavior_table", none, [n, 2, b], names=True))
    # what comes last
    for k, (title, body) in enumerate(appendices):
        at_end = F.col("count") + 2 + k
        out.append(_section(one, lit(f"end-{k + 1}"), none, at_end, lit(title), 1, "richtext", lit(body), [at_end]))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows

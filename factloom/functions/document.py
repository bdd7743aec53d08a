"""Rows, labels and blocks of generated documents as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from factloom.functions.keys import or_default
from factloom.functions.text import escape_edge_label, escape_label, wrap_label

#: The header of an interface table.
INTERFACE_HEADER = ("Interface ID", "Interface Name", "Information", "Data Type", "Data Range", "Direction(In/Out)", "Source/Destination", "Interface Type")


def interface_row(x: Column) -> Column:
    """array<string> of eight cells. x: struct of id, name, shown_name, description, variable_type (null for functions), range, parameters
    (array of structs of type, range), direction, source_dest, kind."""
    is_function, empty = x["variable_type"].isNull(), F.coalesce(F.size(x["parameters"]), F.lit(0)) <= 0
    joined = lambda field: F.array_join(F.transform(x["parameters"], lambda p: F.coalesce(p[field], F.lit(""))), "; ")
    return F.array(
        F.coalesce(x["id"], F.lit("")), F.coalesce(F.nullif(x["shown_name"], F.lit("")), x["name"], F.lit("")), or_default(x["description"], "-"),
        F.when(~is_function, or_default(x["variable_type"], "-")).when(empty, "VOID").otherwise(joined("type")),
        F.when(~is_function, or_default(x["range"], "NA")).when(empty, "NA").otherwise(joined("range")),
        or_default(x["direction"], "-"), or_default(x["source_dest"], "-"), or_default(x["kind"], "-"),
    )


def artifact_label(section_id: Column, kind: Column) -> Column:
    """What a section shows, by its kind and the form of its id."""
    sid = F.coalesce(section_id, F.lit(""))
    diagram = F.when(F.contains(sid, F.lit("container")), "Component structure diagram").when(F.contains(sid, F.lit("-dep")), "Header dependency diagram").when(sid.startswith("unit-"), "Unit diagram").otherwise("Diagram")
    table = (F.when(sid.endswith("-iface"), "Unit interface table").when(sid.endswith("-header"), "Unit header (data dictionary)").when(sid.endswith("-unit-table"), "Component/unit table")
             .when(sid == "intro-terms", "Abbreviations").otherwise("Table"))
    return F.when(kind == "diagram", diagram).when(kind == "flowchart_table", "Function flowchart").when(kind == "behavior_table", "Dynamic behaviour").when(kind == "table", table).otherwise("Description")


def section_blocks(s: Column, fields: list[tuple[str, str]]) -> Column:
    """array of blocks (kind, label, text, image_url, mermaid) of one section, in order. s: struct of type, content, headers
    (array), rows (array of arrays), image_url, mermaid, description, items (array), diagrams (array of structs of label,
    image_url, mermaid), cells (map). fields: label and key of the cells that become key-value blocks."""
    def block(kind, text=None, label=None, image=None, mermaid=None):
        value = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("string")
        return F.struct(F.lit(kind).alias("kind"), value(label).alias("label"), value(text).alias("text"), value(image).alias("image_url"), value(mermaid).alias("mermaid"))

    none = F.array().cast("array<struct<kind:string,label:string,text:string,image_url:string,mermaid:string>>")
    given = lambda text, made: F.when(F.coalesce(text, F.lit("")) != "", F.array(made)).otherwise(none)
    pairs = F.array(*[block("keyvalue", F.coalesce(F.try_element_at(s["cells"], F.lit(key)), F.lit("")), label) for label, key in fields]) if fields else none
    diagrams = F.coalesce(F.transform(s["diagrams"], lambda d: block("diagram", None, d["label"], d["image_url"], d["mermaid"])), none)
    points = F.coalesce(F.transform(s["items"], lambda i: block("text", F.concat(F.lit("• "), i))), none)
    kind = s["type"]
    return (
        F.when((kind == "table") & s["headers"].isNotNull(), F.array(block("table", F.to_json(F.struct(s["headers"].alias("headers"), s["rows"].alias("rows"))))))
        .when(kind == "diagram", F.array(block("diagram", None, s["content"], s["image_url"], s["mermaid"])))
        .when((kind == "flowchart_table") & s["cells"].isNotNull(), F.concat(given(s["description"], block("text", s["description"])), diagrams, pairs))
        .when((kind == "behavior_table") & s["cells"].isNotNull(), F.concat(points, given(s["image_url"], block("diagram", None, "Behaviour diagram", s["image_url"])), pairs))
        .otherwise(given(s["content"], block("text", s["content"])))
    )


def fallback_label(kind: Column, code: Column) -> Column:
    """Label of a flow node without a description, by its type; 120 characters of the code at most."""
    raw = F.substring(F.trim(F.coalesce(code, F.lit(""))), 1, 120)
    says = lambda head, tail="": F.concat(F.lit(head), raw, F.lit(tail))
    returned = F.regexp_replace(F.trim(F.regexp_replace(raw, "^return", "")), ";+$", "")
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (
        F.when(kind == "DECISION", F.when(raw.endswith("?"), raw).otherwise(says("Check: ", "?"))).when(kind == "LOOP_HEAD", says("Loop: ", "?")).when(kind == "SWITCH_HEAD", says("Switch on: ", "?"))
        .when(kind == "CASE", says("Case: ")).when(kind == "DEFAULT_CASE", "Default case").when(kind == "RETURN", F.concat(F.lit("Return "), returned)).when(kind == "BREAK", "Exit loop")
        .when(kind == "CONTINUE", "Continue to next iteration").when(kind == "TRY_HEAD", "Execute with exception handling").when(kind == "CATCH", says("Handle exception: "))
        .otherwise(F.substring(F.coalesce(F.get(lines, F.lit(0)), raw), 1, 80))
    )


def node_line(node: Column, kind: Column, label: Column) -> Column:
    """A diagram's line that defines a node; its shape tells its type."""
    text = escape_label(wrap_label(label))
    shape = lambda left, right: F.concat(F.lit("    "), node, F.lit(left), text, F.lit(right))
    return F.when(kind.isin("START", "END"), shape("([", "])")).when(kind.isin("DECISION", "LOOP_HEAD", "SWITCH_HEAD"), shape("{", "}")).when(kind == "CATCH", shape("[[", "]]")).otherwise(shape("[", "]"))


def edge_line(source: Column, target: Column, label: Column) -> Column:
    """A diagram's line that links two nodes."""
    arrow = F.when(F.coalesce(label, F.lit("")) == "", " --> ").otherwise(F.concat(F.lit(" -->|"), escape_edge_label(label), F.lit("| ")))
    return F.concat(F.lit("    "), source, arrow, target)


def diagram_issue(text: Column) -> Column:
    """Why a diagram's text can't be drawn, or null: empty, no diagram keyword first, unbalanced quotes."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(body == "", "empty").when(~body.rlike(r"^(graph|flowchart)\b"), "prefix").when(F.regexp_count(body, F.lit('"')) % 2 == 1, "quotes")

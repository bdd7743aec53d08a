"""Queries over documents, flow graphs and what code is known to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import document as dc
from factloom.operators import documents as ops
from factloom.plans.inputs import CALLS, calls, query, t


@query("""SELECT p_partkey, p_partkey || '~' || CASE WHEN p_size % 2 = 0 THEN 'Shown ' || p_size ELSE p_name END || '~' || CASE WHEN p_size % 3 = 0 THEN p_type ELSE '-' END || '~' ||
  CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 4 = 0 THEN 'VOID' ELSE 'int; ' || p_brand END || '~' || CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN '0-1' WHEN p_size % 5 = 0 THEN 'NA' WHEN p_size % 4 = 0 THEN 'NA' ELSE '0-' || p_size || '; NA' END || '~In~-~'
  || CASE WHEN p_size % 5 = 0 THEN 'Global' ELSE '-' END AS row8 FROM part""")
def c22_interface_row(spark, sf):
    s, name = F.col("p_size"), F.col("p_name")
    is_global = s % 5 == 0
    param = lambda a, b: F.struct(a.alias("type"), b.alias("range"))
    params = F.when(~is_global & (s % 4 != 0), F.array(param(F.lit("int"), F.concat(F.lit("0-"), s.cast("string"))), param(F.col("p_brand"), F.lit("NA"))))
    x = F.struct(
        F.col("p_partkey").cast("string").alias("id"), name.alias("name"), F.when(s % 2 == 0, F.concat(F.lit("Shown "), s.cast("string"))).alias("shown_name"), F.when(s % 3 == 0, F.col("p_type")).otherwise("").alias("description"),
        F.when(is_global, F.col("p_brand")).alias("variable_type"), F.when(s % 2 == 0, "0-1").alias("range"), params.alias("parameters"), F.lit("In").alias("direction"), F.lit(None).cast("string").alias("source_dest"), F.when(is_global, "Global").alias("kind"))
    return t(spark, sf, "part").withColumn("x", x).select("p_partkey", F.array_join(dc.interface_row(F.col("x")), "~").alias("row8"))


FIELDS = [("Risk", "risk"), ("Capacity", "capacity")]


@query("""WITH p AS (SELECT p_partkey, p_size % 5 AS k, p_name, p_brand, p_size FROM part)
SELECT p_partkey, 0 AS pos, CASE k WHEN 0 THEN 'table' WHEN 1 THEN 'diagram' ELSE 'text' END AS kind, CASE k WHEN 1 THEN p_name END AS label, CASE k WHEN 0 THEN '{"headers":["H"],"rows":[["' || p_size || '"]]}' WHEN 1 THEN NULL WHEN 2 THEN p_name WHEN 3 THEN '• ' || p_name ELSE p_name END AS text FROM p
UNION ALL SELECT p_partkey, 1, 'diagram', CASE k WHEN 2 THEN p_brand ELSE 'Behaviour diagram' END, NULL FROM p WHERE k IN (2, 3)
UNION ALL SELECT p_partkey, 2, 'keyvalue', 'Risk', 'low ' || p_size FROM p WHERE k IN (2, 3) UNION ALL SELECT p_partkey, 3, 'keyvalue', 'Capacity', '' FROM p WHERE k IN (2, 3)""")
def c24_section_blocks(spark, sf):
    k, n = F.col("p_size") % 5, F.col("p_size").cast("string")
    kinds = F.when(k == 0, "table").when(k == 1, "diagram").when(k == 2, "flowchart_table").when(k == 3, "behavior_table").otherwise("richtext")
    s = F.struct(
        kinds.alias("type"), F.col("p_name").alias("content"), F.array(F.lit("H")).alias("headers"), F.array(F.array(n)).alias("rows"), F.lit("u").alias("image_url"), F.lit(None).cast("string").alias("mermaid"), F.col("p_name").alias("description"),
        F.array("p_name").alias("items"), F.array(F.struct(F.col("p_brand").alias("label"), F.lit("i").alias("image_url"), F.lit("m").alias("mermaid"))).alias("diagrams"), F.create_map(F.lit("risk"), F.concat(F.lit("low "), n)).alias("cells"))
    return t(spark, sf, "part").withColumn("s", s).select("p_partkey", F.posexplode(dc.section_blocks(F.col("s"), FIELDS)).alias("pos", "b")).select("p_partkey", "pos", "b.kind", "b.label", "b.text")


@query("""WITH p AS (SELECT p_partkey, p_size % 10 AS k, p_size // 10 AS t FROM part)
SELECT p_partkey, CASE t WHEN 0 THEN CASE k WHEN 0 THEN 'Component structure diagram' WHEN 1 THEN 'Header dependency diagram' WHEN 2 THEN 'Unit diagram' ELSE 'Diagram' END WHEN 1 THEN 'Function flowchart' WHEN 2 THEN 'Dynamic behaviour'
  WHEN 3 THEN CASE k WHEN 3 THEN 'Unit interface table' WHEN 4 THEN 'Unit header (data dictionary)' WHEN 5 THEN 'Component/unit table' WHEN 6 THEN 'Abbreviations' ELSE 'Table' END ELSE 'Description' END AS label FROM p""")
def c25_artifact_label(spark, sf):
    k, kind = F.col("p_size") % 10, F.expr("p_size div 10")
    ids = [("container-", True), ("x-dep", True), ("unit-", True), ("-iface", False), ("-header", False), ("-unit-table", False), ("intro-terms", None)]
    sid = F.lit("plain")
    for i, (word, first) in enumerate(ids):
        sid = F.when(k == i, F.lit(word) if first is None else F.concat(F.lit(word), "p_name") if first else F.concat("p_name", F.lit(word))).otherwise(sid)
    kinds = F.when(kind == 0, "diagram").when(kind == 1, "flowchart_table").when(kind == 2, "behavior_table").when(kind == 3, "table").otherwise("richtext")
    return t(spark, sf, "part").select("p_partkey", dc.artifact_label(sid, kinds).alias("label"))


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Check: x > ' || p_size || '?' WHEN 1 THEN 'Loop: x > ' || p_size || '?' WHEN 2 THEN 'Return x > ' || p_size WHEN 3 THEN 'Exit loop' WHEN 4 THEN 'Case: x > ' || p_size WHEN 5 THEN 'Handle exception: x > ' || p_size ELSE 'x > ' || p_size END AS label,
  CASE p_size % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'prefix' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'quotes' END END AS issue FROM part""")
def s18_w16_labels(spark, sf):
    k, n = F.col("p_size") % 7, F.col("p_size").cast("string")
    kinds = F.array(*map(F.lit, ["DECISION", "LOOP_HEAD", "RETURN", "BREAK", "CASE", "CATCH", "ACTION"]))
    code = F.concat(F.when(k == 2, " return ").otherwise(" "), F.lit("x > "), n, F.when(k == 2, ";").when(k == 6, "\nnext").otherwise(""))
    m = F.col("p_size") % 3
    text = F.when(m == 0, "  \n").when(m == 1, F.concat(F.lit("A"), n, F.lit("-->B"))).otherwise(F.concat(F.lit('graph TD\n A["x'), n, F.when(F.col("p_size") % 2 == 0, "]").otherwise('"]')))
    return t(spark, sf, "part").select("p_partkey", dc.fallback_label(F.get(kinds, k), code).alias("label"), dc.diagram_issue(text).alias("issue"))


@query("""SELECT n_name AS component, 'flowchart TB' || chr(10) || '  MOD["' || n_name || '"]' || chr(10) || string_agg('  U' || i || '["' || s_name || '"]' || chr(10) || '  MOD --> U' || i, chr(10) ORDER BY i) || chr(10) || '  class ' || string_agg('U' || i, ',' ORDER BY i) || ' unitNode' AS mermaid
FROM (SELECT n_name, s_name, row_number() OVER (PARTITION BY n_name ORDER BY s_name) - 1 AS i FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY n_name""")
def w13_component_diagram(spark, sf):
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return ops.component_diagram(s.select(F.col("n_name").alias("component"), F.col("s_name").alias("unit")))


FLOW = """s AS (SELECT p_partkey AS fkey, p_size AS k FROM part),
e(fkey, source, target, label) AS (SELECT fkey, 0, 1, NULL FROM s UNION ALL SELECT fkey, 1, 2, NULL FROM s UNION ALL SELECT fkey, 2, 3, 'Yes' FROM s
  UNION ALL SELECT fkey, 2, CASE WHEN k % 2 = 0 THEN 4 ELSE 5 END, 'No' FROM s UNION ALL SELECT fkey, 3, 5, NULL FROM s UNION ALL SELECT fkey, 4, 5, NULL FROM s WHERE k % 2 = 0
  UNION ALL SELECT fkey, 5, 6, 'Yes' FROM s UNION ALL SELECT fkey, 5, 8, 'No' FROM s UNION ALL SELECT fkey, 6, 7, NULL FROM s UNION ALL SELECT fkey, 7, CASE k % 3 WHEN 0 THEN 8 ELSE 5 END, NULL FROM s
  UNION ALL SELECT fkey, 8, 9, 'case 1' FROM s UNION ALL SELECT fkey, 8, 11, 'default' FROM s UNION ALL SELECT fkey, 9, 10, NULL FROM s UNION ALL SELECT fkey, 10, CASE WHEN k % 5 = 0 THEN 12 ELSE 11 END, NULL FROM s
  UNION ALL SELECT fkey, 11, 12, NULL FROM s UNION ALL SELECT fkey, 12, -1, NULL FROM s)"""


def _statements(spark, sf):
    """A function for each part: an action, an if (with an else in some), a loop that breaks or goes on, a switch, a return."""
    row = lambda i, parent, branch, kind, name=None, when=F.lit(True): F.when(when, F.struct(F.lit(i).cast("long").alias("id"), F.lit(parent).cast("long").alias("parent"), F.lit(branch).alias("branch"), F.lit(i).alias("ord"), (kind if not isinstance(kind, str) else F.lit(kind)).alias("kind"), F.lit(name).cast("string").alias("name")))
    k = F.col("p_size")
    rows = F.array(
        row(1, None, None, "action"), row(2, None, None, "if"), row(3, 2, "then", "action"), row(4, 2, "else", "action", when=k % 2 == 0), row(5, None, None, "while"), row(6, 5, "body", "action"),
        row(7, 5, "body", F.when(k % 3 == 0, "break").when(k % 3 == 1, "continue").otherwise("action")), row(8, None, None, "switch"), row(9, 8, None, "case", "1"), row(10, 9, None, F.when(k % 5 == 0, "break").otherwise("action")),
        row(11, 8, None, "default"), row(12, None, None, "return"))
    s = t(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("fkey"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x"))
    return s.select("fkey", "x.*")


@query(f"WITH {FLOW} SELECT fkey, source, target, label FROM e")
def g12_statement_flow(spark, sf):
    return ops.statement_flow(_statements(spark, sf))


@query(f"""WITH {FLOW}, o AS (SELECT p_partkey AS fkey, CASE WHEN p_size % 2 = 0 THEN [0, 1, 2, 3, 4, 5, 6, 8, 7, 9, 11, 10, 12, -1] ELSE [0, 1, 2, 3, 5, 6, 8, 7, 9, 11, 10, 12, -1] END AS places, p_size FROM part),
n AS (SELECT fkey, string_agg('    N' || v || CASE WHEN v IN (0, -1) THEN '([x' || v || '])' WHEN v IN (2, 5) THEN CASE WHEN v = 2 THEN chr(123) || 'x' || v || chr(125) ELSE chr(123) || 'x' || v || chr(125) END ELSE '[x' || v || ']' END, chr(10) ORDER BY pos) AS t FROM (SELECT fkey, unnest(places) AS v, generate_subscripts(places, 1) AS pos FROM o) GROUP BY fkey),
m AS (SELECT fkey, string_agg('    N' || source || CASE WHEN label IS NULL THEN ' --> ' ELSE ' -->|' || label || '| ' END || 'N' || target, chr(10) ORDER BY source, target) AS t FROM e GROUP BY fkey)
SELECT fkey AS grp, 'flowchart TD' || chr(10) || n.t || chr(10) || chr(10) || m.t AS mermaid FROM n JOIN m USING (fkey)""")
def w15_flow_diagram(spark, sf):
    s = _statements(spark, sf)
    # the end has the largest number here, so that the start is the least node
    e = ops.statement_flow(s).select(F.col("fkey").alias("grp"), "source", F.when(F.col("target") == -1, 999).otherwise(F.col("target")).cast("long").alias("target"), "label")
    e = e.withColumn("ord", F.struct("source", "target"))
    n = s.select(F.col("fkey").alias("grp"), F.col("id").alias("node"), F.when(F.col("kind") == "if", "DECISION").when(F.col("kind") == "while", "LOOP_HEAD").otherwise("ACTION").alias("type"))
    ends = s.select(F.col("fkey").alias("grp")).distinct().select("grp", F.explode(F.array(F.lit(0).cast("long"), F.lit(999).cast("long"))).alias("node"))
    n = n.unionByName(ends.select("grp", "node", F.when(F.col("node") == 0, "START").otherwise("END").alias("type"))).withColumn("label", F.concat(F.lit("x"), F.when(F.col("node") == 999, -1).otherwise(F.col("node"))))
    out = ops.flow_diagram(n, e)
    return out.select("grp", F.replace("mermaid", F.lit("N999"), F.lit("N-1")).alias("mermaid"))


@query("""WITH f AS (SELECT DISTINCT 'p' || p_size % 7 || CASE WHEN p_size % 2 = 0 THEN '/f' || p_size ELSE '' END AS file, p_name AS name FROM part), a AS (SELECT file, count(*) AS n, CASE WHEN file LIKE '%/%' THEN regexp_replace(file, '/[^/]*$', '') ELSE '.' END AS dir FROM f GROUP BY file),
d AS (SELECT dir, count(*) AS n FROM a GROUP BY dir) SELECT 'file' AS level, file AS name, dir AS parent, n FROM a UNION ALL SELECT 'directory', dir, 'project', n FROM d UNION ALL SELECT 'project', 'project', NULL, count(*) FROM d""")
def w21_rollup(spark, sf):
    s = F.col("p_size")
    return ops.roll_up(t(spark, sf, "part").select(F.concat(F.lit("p"), s % 7, F.when(s % 2 == 0, F.concat(F.lit("/f"), s)).otherwise("")).alias("file"), F.col("p_name").alias("name")))


@query("""WITH u AS (SELECT r_name AS c, n_name AS u, CASE WHEN n_nationkey % 3 = 0 THEN '-' ELSE 'about ' || n_name END AS d FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'intro-purpose' AS section, NULL AS parent, '0.0000' AS ord, 'Purpose' AS title, (SELECT string_agg(DISTINCT c, ', ' ORDER BY c) FROM u) AS body UNION ALL SELECT 'intro-terms', 'intro-purpose', '0.0001', 'Terms', ''
UNION ALL SELECT 'component-' || c, NULL, '1.' || c, c, string_agg(c || ' | ' || u || ' | ' || d, chr(10) ORDER BY u) FROM u GROUP BY c UNION ALL SELECT 'unit-' || c || '-' || u, 'component-' || c, '1.' || c || '.' || u, u, d FROM u""")
def w11_w12_w14_section_rows(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = n.select(F.col("r_name").alias("component"), F.col("n_name").alias("unit"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit("about "), "n_name")).alias("description"))
    return ops.section_tree(u, [("purpose", "Purpose"), ("terms", "Terms")])


@query()
def e18_forward_in_degree(spark, sf):
    return ops.forward_in_degree(calls(spark, sf).select(F.expr("caller div 100").alias("grp"), F.col("caller").alias("source"), F.col("callee").alias("target")))


@query(f"""WITH {CALLS}, o AS (SELECT caller AS node, count(*) AS outs FROM calls GROUP BY 1), i AS (SELECT callee AS node, count(*) AS ins FROM calls GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(ins, 0) AS ins, coalesce(outs, 0) AS outs FROM o FULL JOIN i ON o.node = i.node""")
def g11_degrees(spark, sf):
    return ops.degrees(calls(spark, sf).select(F.lit(0).alias("grp"), F.col("caller").alias("source"), F.col("callee").alias("target"))).select("node", "ins", "outs")


@query("""WITH n AS (SELECT p_partkey // 8 AS grp, p_partkey AS node, p_name AS code FROM part), x AS (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY node) AS nxt, row_number() OVER (PARTITION BY grp ORDER BY node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM n)
SELECT grp, node, CASE WHEN pos = 2 AND size > 3 AND grp % 3 <> 0 THEN substr(string_agg(code, '; ') OVER w, 1, 60) ELSE code END AS code FROM x WINDOW w AS (PARTITION BY grp ORDER BY node ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) QUALIFY NOT (pos IN (3, 4) AND size > 3 AND grp % 3 <> 0)""")
def g11_contract(spark, sf):
    """Chains of the parts' rows: in every third group a second edge into the chain keeps it from being one node."""
    nodes, edges, groups = _rows(spark, sf)
    return ops.contract(nodes, edges, groups, 60)[0]


@query("""WITH n AS (SELECT p_partkey // 8 AS grp, p_partkey AS node FROM part), x AS (SELECT *, lead(node) OVER (PARTITION BY grp ORDER BY node) AS nxt, lag(node) OVER (PARTITION BY grp ORDER BY node) AS prev, row_number() OVER (PARTITION BY grp ORDER BY node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM n)
SELECT grp, node AS source, nxt AS target, 'l' || pos AS label FROM x WHERE nxt IS NOT NULL AND NOT (pos IN (5, 6) AND size > 7) UNION ALL SELECT grp, node, node + 2, 'l5' FROM x WHERE pos = 5 AND size > 7 UNION ALL SELECT grp, node, node + 3, 'skip' FROM x WHERE pos = 0 AND size > 3 AND grp % 3 = 0""")
def g11_bypass(spark, sf):
    nodes, edges, groups = _rows(spark, sf)
    return ops.bypass(edges, nodes.where("node % 8 = 6"))


def _rows(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("grp").orderBy("node")
    n = t(spark, sf, "part").select(F.expr("p_partkey div 8").alias("grp"), F.col("p_partkey").alias("node"), F.col("p_name").alias("code"))
    x = n.select("*", F.lead("node").over(w).alias("target"), (F.row_number().over(w) - 1).alias("pos"), F.count("*").over(Window.partitionBy("grp")).alias("size"))
    edges = x.where("target is not null").select("grp", F.col("node").alias("source"), "target", F.concat(F.lit("l"), "pos").alias("label"))
    more = x.where("pos = 0 and size > 3 and grp % 3 = 0").select("grp", F.col("node").alias("source"), (F.col("node") + 3).alias("target"), F.lit("skip").alias("label"))
    return n, edges.unionByName(more), x.where("pos between 2 and 4 and size > 3").select("grp", F.lit(1).alias("chain"), "pos", "node")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 'v' || p_size WHEN p_size % 5 = 0 THEN NULL ELSE 'auto' END AS base, CASE WHEN p_size % 4 <> 1 AND p_size % 5 = 0 THEN 'full' ELSE 'incremental' END AS decision,
  CASE p_size % 4 WHEN 2 THEN 'not found; using auto baseline' WHEN 3 THEN 'not complete; using auto baseline' WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 'not an ancestor; close to a full run' WHEN p_size % 5 <> 0 THEN 'not the nearest ancestor' END END AS warning FROM part""")
def g17_choose_baseline(spark, sf):
    s, k = F.col("p_size"), F.col("p_size") % 4
    b = ops.choose_baseline(F.when(s % 5 != 0, "auto"), F.when(k != 0, F.concat(F.lit("v"), s.cast("string"))), F.when(k == 1, "complete").when(k == 3, "running"), s % 3 != 0)
    return t(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.*")


@query("""WITH c AS (SELECT p_partkey AS id, p_size AS k FROM part)
SELECT id, 'enum' AS kind, 'Color' AS name, 'e' AS said FROM c WHERE k % 2 = 0 OR k % 3 = 0 UNION ALL SELECT id, 'macro', 'MAX_' || k, 'm' || k FROM c WHERE k <= 20 UNION ALL SELECT id, 'typedef', 'speed_t', 't' FROM c WHERE k % 5 = 0
UNION ALL SELECT id, 'member', 'len', 'A.len' FROM c WHERE k % 7 = 0 UNION ALL SELECT id, 'member', 'pos', 'B.pos' FROM c WHERE k % 7 = 1""")
def d40_known_tokens(spark, sf):
    s = F.col("p_size")
    code = F.concat(F.when(s % 2 == 0, "Color x = RED; ").otherwise(""), F.when(s % 3 == 0, "f(GREEN, GREEN); ").otherwise(""), F.lit("if (y < MAX_"), s, F.lit(") "), F.when(s % 5 == 0, "speed_t v; ").otherwise("speed_type v; "), F.when(s % 7 == 0, "p->len = 1;").when(s % 7 == 1, "q . pos, q.pos;").otherwise("len;"))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    macros = spark.range(1, 21).select(F.concat(F.lit("MAX_"), "id").alias("name"), F.concat(F.lit("m"), "id").alias("said"))
    return ops.known_tokens(
        t(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.alias("code")), one([("Color", "RED", "e"), ("Color", "GREEN", "e"), ("Other", None, "o")], "name string, value string, said string"), macros,
        one([("speed_t", "t")], "name string, said string"), one([("B", 2, "len", "B.len"), ("A", 1, "len", "A.len"), ("B", 2, "pos", "B.pos")], "struct_name string, ord int, member string, said string"))


def _rendered(spark, sf):
    """Regions are components, nations units, suppliers interfaces; customers' segments are the terms."""
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lower("r_name"), F.lit("-x")).alias("component"), F.col("n_name").alias("unit"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    word = F.concat(F.lit("about "), (k % 11).cast("string"))
    i = s.select("component", "unit", k.alias("ord"), k.alias("fid"), F.col("s_name").alias("name"), F.when(k % 4 == 0, "Global Variable").otherwise("Function").alias("kind"), F.when(k % 5 != 0, word).alias("description"), (k % 17 == 0).alias("hidden"),
                 F.array(F.lit("IF"), "s_name", k.cast("string")).alias("cells"), F.concat("s_name", F.lit(" input")).alias("input_name"), F.concat("s_name", F.lit(" result")).alias("output_name"))
    units = n.select("component", "unit")
    headers = n.where("n_nationkey % 3 <> 0").select("component", "unit", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "n_nationkey").select("component", "unit", "ord", F.concat(F.lit("int g"), F.col("ord")).alias("declaration"), F.when(F.col("ord") == 1, F.col("n_nationkey").cast("string")).alias("information"))
    flows = i.where("fid % 3 = 0").select("component", "unit", "name", F.lit("flowchart TD").alias("mermaid"))
    acts = i.where("fid % 10 = 1").select("component", "unit", "ord", "name", F.when(F.col("fid") % 20 == 1, F.lit("Other")).alias("external"))
    drawn = units.select("component", F.lit(None).cast("string").alias("unit"), F.lit("container").alias("kind")).distinct().unionByName(n.where("n_nationkey % 2 = 0").select("component", "unit", F.lit("unit").alias("kind")))
    terms = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("term"), F.lower("c_mktsegment").alias("meaning")).distinct()
    return ops.render_tree(units, i, headers, flows, acts, drawn, "Why.", "What.", terms, [("Code Metrics", "[Code metrics.]"), ("Design Guideline", "[Design guidelines.]")])


RENDER = """n AS (SELECT n_nationkey, lower(r_name) || '-x' AS c, n_name AS u FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT n_nationkey, c, u, dense_rank() OVER (ORDER BY c) + 1 AS n, dense_rank() OVER (PARTITION BY c ORDER BY u) AS k, replace(c, '-', ' ') AS shown FROM n),
cs AS (SELECT DISTINCT c, n, shown FROM r),
i AS (SELECT r.*, s_suppkey AS s, s_name AS name, s_suppkey % 4 = 0 AS v, CASE WHEN s_suppkey % 5 <> 0 THEN 'about ' || s_suppkey % 11 END AS d FROM supplier JOIN r ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY c, u ORDER BY s) + 2 AS j FROM i WHERE NOT v),
b AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY u, s) AS j FROM i WHERE s % 10 = 1),
told AS (SELECT c, u, string_agg(d, '; ' ORDER BY o) AS told FROM (SELECT c, u, d, min((v, s)) AS o FROM i WHERE d IS NOT NULL GROUP BY c, u, d) GROUP BY c, u),
x AS (
  SELECT 'intro' AS section, NULL AS parent, '1' AS number, 'Introduction' AS title, 1 AS level, 'richtext' AS type, NULL AS body, NULL AS input_name, NULL AS output_name, '1' AS path
  UNION ALL SELECT 'intro-purpose', 'intro', '1.1', 'Purpose', 2, 'richtext', 'Why.', NULL, NULL, '1.1'
  UNION ALL SELECT 'intro-scope', 'intro', '1.2', 'Scope', 2, 'richtext', 'What.' || chr(10) || (SELECT string_agg('• ' || shown, chr(10) ORDER BY c) FROM cs), NULL, NULL, '1.2'
  UNION ALL SELECT 'intro-terms', 'intro', '1.3', 'Terms, Abbreviations and Definitions', 2, 'table', (SELECT string_agg(m || ' | ' || lower(m), chr(10) ORDER BY m) FROM (SELECT DISTINCT c_mktsegment AS m FROM customer)), NULL, NULL, '1.3'
  UNION ALL SELECT 'comp-' || c, NULL, '' || n, shown, 1, 'richtext', NULL, NULL, NULL, '' || n FROM cs
  UNION ALL SELECT c || '-static', 'comp-' || c, n || '.1', 'Static Design', 2, 'richtext', NULL, NULL, NULL, n || '.1' FROM cs
  UNION ALL SELECT c || '-dynamic', 'comp-' || c, n || '.2', 'Dynamic Behaviour', 2, 'richtext', NULL, NULL, NULL, n || '.2' FROM cs
  UNION ALL SELECT c || '-container', c || '-static', '', 'Component Structure', 3, 'diagram', 'Component structure for ' || shown || '.', NULL, NULL, n || '.1.0.0' FROM cs
  UNION ALL SELECT c || '-unit-table', c || '-static', '', 'Component/Unit Table', 3, 'table', string_agg(shown || ' | ' || u || ' | ' || coalesce(substr(told, 1, 120), 'N/A') || ' | N/A', chr(10) ORDER BY u), NULL, NULL, n || '.1.0.2' FROM r LEFT JOIN told USING (c, u) GROUP BY c, n
  UNION ALL SELECT c || '-unit-' || k, c || '-static', n || '.1.' || k, u, 3, 'richtext', NULL, NULL, NULL, n || '.1.' || k FROM r
  UNION ALL SELECT 'unit-' || c || '|' || u, c || '-unit-' || k, '', 'Unit — ' || u, 4, 'diagram', 'Static structure of unit ' || u || '.', NULL, NULL, n || '.1.' || k || '.0' FROM r WHERE n_nationkey % 2 = 0
  UNION ALL SELECT c || '|' || u || '-header', c || '-unit-' || k, n || '.1.' || k || '.1', 'unit header', 4, CASE WHEN n_nationkey % 3 = 0 THEN 'richtext' ELSE 'table' END, CASE WHEN n_nationkey % 3 = 0 THEN 'NA' ELSE 'int g1 | ' || n_nationkey || chr(10) || 'int g2 | N/A' END, NULL, NULL, n || '.1.' || k || '.1' FROM r
  UNION ALL SELECT r.c || '|' || r.u || '-iface', r.c || '-unit-' || r.k, r.n || '.1.' || r.k || '.2', 'unit interface', 4, CASE WHEN count(s) = 0 THEN 'richtext' ELSE 'table' END, coalesce(string_agg('IF | ' || name || ' | ' || s, chr(10) ORDER BY s), 'NA'), NULL, NULL, r.n || '.1.' || r.k || '.2' FROM r LEFT JOIN i USING (c, u) GROUP BY r.c, r.u, r.n, r.k
  UNION ALL SELECT c || '|' || u || '-fn-' || name, c || '-unit-' || k, n || '.1.' || k || '.' || j, u || '-' || name, 4, CASE WHEN s % 3 = 0 THEN 'flowchart_table' ELSE 'richtext' END, coalesce(d, '-'), name || ' input', name || ' result', n || '.1.' || k || '.' || j FROM f
  UNION ALL SELECT c || '-dyn-' || j, c || '-dynamic', n || '.2.' || j, u || ' - ' || name || CASE WHEN s % 20 = 1 THEN ' (Other)' ELSE '' END, 3, 'behavior_table', NULL, name || ' input', name || ' result', n || '.2.' || j FROM b
  UNION ALL SELECT 'end-' || e, NULL, '' || ((SELECT count(*) FROM cs) + 1 + e), CASE e WHEN 1 THEN 'Code Metrics' ELSE 'Design Guideline' END, 1, 'richtext', CASE e WHEN 1 THEN '[Code metrics.]' ELSE '[Design guidelines.]' END, NULL, NULL, '' || ((SELECT count(*) FROM cs) + 1 + e) FROM (VALUES (1), (2)) AS q(e))"""


@query(f"WITH {RENDER} SELECT section, parent, number, title, level, type, body, input_name, output_name, path FROM x")
def w11_w12_render_tree(spark, sf):
    out = _rendered(spark, sf)
    return out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@query(f"WITH {RENDER} SELECT number, title, level FROM x WHERE number <> ''")
def w11_table_of_contents(spark, sf):
    return _rendered(spark, sf).where("number <> ''").select("number", "title", "level")

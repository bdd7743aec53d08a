"""Queries over derived facts: units, components, interfaces, ranges, joins of the views."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from factloom.functions import keys
from factloom.operators import catalog, derive
from factloom.plans.inputs import ACCESS, CALLS, FUNCTIONS, access, calls, functions, query, t

MEMBERS = "members AS (SELECT fid, unit FROM functions)"
LIFTED = "lifted AS (SELECT DISTINCT a.unit AS f, b.unit AS t FROM calls c JOIN members a ON a.fid = c.caller JOIN members b ON b.fid = c.callee WHERE a.unit <> b.unit)"


def _csv(c):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"""WITH {FUNCTIONS}, {CALLS}, {MEMBERS}, {LIFTED}, m AS (SELECT unit, string_agg(fid, ',' ORDER BY fid) AS ids FROM members GROUP BY unit),
u AS (SELECT t AS unit, string_agg(f, ',' ORDER BY f) AS caller_units FROM lifted GROUP BY t), d AS (SELECT f AS unit, string_agg(t, ',' ORDER BY t) AS callee_units FROM lifted GROUP BY f)
SELECT unit, ids, coalesce(caller_units, '') AS caller_units, coalesce(callee_units, '') AS callee_units FROM m LEFT JOIN u USING (unit) LEFT JOIN d USING (unit)""")
def e01_units(spark, sf):
    f = functions(spark, sf).select("fid", "unit", F.col("fid").alias("ord"))
    return derive.units(f, calls(spark, sf)).select("unit", _csv("ids"), _csv("caller_units"), _csv("callee_units"))


@query("""SELECT n_name AS component, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS units,
  coalesce((SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) FROM customer WHERE c_nationkey = n_nationkey), '') AS headers FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def e02_components(spark, sf):
    n = t(spark, sf, "nation")
    u = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("component"), F.col("s_name").alias("unit"))
    h = t(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("component"), F.col("c_mktsegment").alias("header"))
    return derive.components(u, h).select("component", _csv("units"), _csv("headers"))


@query(f"""WITH {FUNCTIONS}, {CALLS} SELECT fid, fid NOT IN (SELECT c.callee FROM calls c JOIN functions a ON a.fid = c.caller JOIN functions b ON b.fid = c.callee WHERE a.file <> b.file) AS private_by_use FROM functions""")
def c09_private_by_use(spark, sf):
    return derive.external_callers(functions(spark, sf).select("fid", "file"), calls(spark, sf)).drop("file")


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY length(c_mktsegment), c_custkey // 10, c_custkey) AS INTEGER) AS number FROM customer""")
def f01_interface_ordinal(spark, sf):
    has = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(True))
    c = t(spark, sf, "customer").join(has, "c_custkey", "left")
    e = c.select("c_custkey", F.col("c_nationkey").alias("file"), F.col("has").isNull().alias("is_private"), F.length("c_mktsegment").alias("kind_rank"), F.expr("c_custkey div 10").alias("line"), F.col("c_custkey").alias("ord"))
    return derive.interface_ordinals(e).select("c_custkey", "number")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'PIF' ELSE 'IF' END || '_' || regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') || CASE WHEN regexp_replace(upper(p_type), '[^A-Z]', '', 'g') = '' THEN '' ELSE '_' || regexp_replace(upper(p_type), '[^A-Z]', '', 'g') END || '_' || regexp_replace(upper(p_name), '[^A-Z]', '', 'g') || '_' || CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END AS interface_id FROM part""")
def s06_s07_interface_id(spark, sf):
    return t(spark, sf, "part").select("p_partkey", keys.interface_id(F.col("p_size") % 2 == 0, F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size")).alias("interface_id"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def f02_forward_fill(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark"))
    return derive.forward_fill(e, "mark", ["ts", "event_id"]).select("event_id", "filled")


@query("SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY o_custkey")
def f04_f05_first_last_wins(spark, sf):
    o = t(spark, sf, "orders")
    a = derive.first_wins(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_key"))
    return a.join(derive.last_wins(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_key")), "o_custkey")


@query("SELECT conv_id, turn, lag(text) OVER w AS previous, lead(text) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def f06_previous_next(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t(spark, sf, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("previous"), F.lead("text").over(w).alias("following"))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 600""")
def f07_budget_fill(spark, sf):
    c = t(spark, sf, "conversations").withColumn("cost", F.char_length("text"))
    return derive.fill_budget(c, "conv_id", ["turn"], "cost", 600).select("conv_id", "turn")


@query("SELECT event_id, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase_so_far FROM events")
def f10_monotone_phase(spark, sf):
    from factloom.operators.service import running_max

    k = F.col("event_type")
    phase = F.when(k == "view", 1).when(k == "click", 2).when(k == "signup", 3).when(k == "purchase", 4).otherwise(0)
    return running_max(t(spark, sf, "events").withColumn("phase", phase), "user_id", ["ts", "event_id"], "phase").select("event_id", "phase_so_far")


CONFIG = [("alpha", "A/", 0), ("beta", "a/b", 1), ("gamma", "C\\d", 2), ("late", "a/b", 3)]


@query("""WITH conf(component, folder, ord) AS (VALUES ('alpha', 'a', 0), ('beta', 'a/b', 1), ('gamma', 'c/d', 2), ('late', 'a/b', 3)),
p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A/x' WHEN 1 THEN 'a/B/y' WHEN 2 THEN 'c/d' WHEN 3 THEN 'c/dx/z' ELSE 'q' END || '/' || p_partkey || '.cpp' AS path FROM part)
SELECT p_partkey, coalesce((SELECT arg_min(component, ord) FROM conf WHERE starts_with(lower(path), folder || '/')), 'unknown') AS component FROM p""")
def c02_component_of_path(spark, sf):
    conf = spark.createDataFrame(CONFIG, "component string, folder string, ord int")
    k = F.col("p_partkey") % 5
    head = F.when(k == 0, "A/x").when(k == 1, "a/B/y").when(k == 2, "c/d").when(k == 3, "c/dx/z").otherwise("q")
    p = t(spark, sf, "part").select("p_partkey", F.concat(head, F.lit("/"), "p_partkey", F.lit(".cpp")).alias("path"))
    return derive.component_of(p, conf).select("p_partkey", "component")


@query("""SELECT r_name AS layer, n_name AS "group", 'c' || k AS component, CASE WHEN r_regionkey = 0 THEN '' ELSE lower(r_name) || '/' END || 'p' || j AS path
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (1), (2)) c(k), (VALUES (1), (2), (3)) x(j)""")
def c04_flatten_layers(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = F.array(*[F.lit(f"p{j}") for j in (1, 2, 3)])
    groups = n.groupBy(F.col("r_name").alias("layer"), F.when(F.col("r_regionkey") == 0, "").otherwise(F.lower("r_name")).alias("path")).agg(
        F.map_from_entries(F.collect_list(F.struct("n_name", F.create_map(F.lit("c1"), paths, F.lit("c2"), paths)))).alias("groups"))
    return derive.flatten_layers(groups)


@query(f"""WITH {FUNCTIONS}, {CALLS}, {MEMBERS}, up AS (SELECT c.callee AS fid, m.unit FROM calls c JOIN members m ON m.fid = c.caller), down AS (SELECT c.caller AS fid, m.unit FROM calls c JOIN members m ON m.fid = c.callee),
a AS (SELECT fid, string_agg(DISTINCT u.unit, ', ' ORDER BY u.unit) AS s FROM up u JOIN members m USING (fid) WHERE u.unit <> m.unit GROUP BY fid), b AS (SELECT fid, string_agg(DISTINCT u.unit, ', ' ORDER BY u.unit) AS s FROM down u JOIN members m USING (fid) WHERE u.unit <> m.unit GROUP BY fid)
SELECT fid, coalesce(CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN a.s || '; ' || b.s ELSE coalesce(a.s, b.s) END, '-') AS source_dest FROM functions LEFT JOIN a USING (fid) LEFT JOIN b USING (fid)""")
def d05_interface_callers(spark, sf):
    f = functions(spark, sf)
    return derive.interface_rows(f, f.select("fid", "unit"), calls(spark, sf)).select("fid", "source_dest")


@query(f"""WITH {FUNCTIONS}, {CALLS}, {MEMBERS} SELECT a.unit AS "from", b.unit AS "to", string_agg(DISTINCT 'IF_' || c.callee, ',' ORDER BY 'IF_' || c.callee) AS ids FROM calls c JOIN members a ON a.fid = c.caller JOIN members b ON b.fid = c.callee WHERE a.unit <> b.unit GROUP BY 1, 2""")
def e15_diagram_edges(spark, sf):
    f = functions(spark, sf)
    return derive.diagram_edges(f.select("fid", "unit"), calls(spark, sf), f.select("fid", F.concat(F.lit("IF_"), "fid").alias("interface_id"))).select("from", "to", _csv("ids"))


@query(f"""WITH {FUNCTIONS}, {CALLS}, {MEMBERS}, {LIFTED}, up AS (SELECT t AS unit, f AS other FROM lifted), dn AS (SELECT f AS unit, t AS other FROM lifted)
SELECT unit, other, 'caller' AS side FROM up UNION ALL SELECT unit, other, 'callee' FROM (SELECT * FROM dn EXCEPT SELECT * FROM up)""")
def i05_diagram_partition(spark, sf):
    f = functions(spark, sf).select("fid", "unit")
    lifted = derive.lift_calls(f, calls(spark, sf))
    up, down = lifted.select(F.col("to").alias("unit"), F.col("from").alias("other")), lifted.select(F.col("from").alias("unit"), F.col("to").alias("other"))
    return up.withColumn("side", F.lit("caller")).unionByName(down.subtract(up).withColumn("side", F.lit("callee")))


@query(f"""WITH {ACCESS} SELECT gid, coalesce(string_agg(DISTINCT CASE WHEN mode = 'r' THEN fid END, ',' ORDER BY CASE WHEN mode = 'r' THEN fid END), '') AS readers, coalesce(string_agg(DISTINCT CASE WHEN mode = 'w' THEN fid END, ',' ORDER BY CASE WHEN mode = 'w' THEN fid END), '') AS writers FROM access GROUP BY gid""")
def d20_readers_writers(spark, sf):
    return derive.readers_writers(access(spark, sf)).select("gid", _csv("readers"), _csv("writers"))


@query(f"""WITH {ACCESS}, a AS (SELECT p_partkey AS fid, count(*) FILTER (WHERE mode = 'w') AS w, count(*) FILTER (WHERE mode = 'r') AS r FROM part LEFT JOIN access ON fid = p_partkey GROUP BY 1) SELECT fid, CASE WHEN w > 0 THEN 'In' ELSE 'Out' END AS direction FROM a""")
def c21_w10_direction(spark, sf):
    a = access(spark, sf).groupBy("fid").agg(F.count_if(F.col("mode") == "w").alias("w"), F.count_if(F.col("mode") == "r").alias("r"))
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("fid")).join(a, "fid", "left")
    return p.select("fid", keys.final_direction(F.lit(True), keys.direction(F.coalesce("w", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("direction"))


@query(f"""WITH {ACCESS} SELECT 'type' AS axis, gid AS key, string_agg(fid, ',' ORDER BY fid) AS users FROM (SELECT DISTINCT gid, fid FROM access WHERE gid % 2 = 0 AND fid % 3 = 0) GROUP BY gid""")
def d02_type_users(spark, sf):
    a = access(spark, sf)
    whitelist = a.where("gid % 2 = 0").select("gid").distinct()
    known = functions(spark, sf).where("fid % 3 = 0").select("fid")
    u = a.join(whitelist, "gid", "left_semi").join(known, "fid").groupBy(F.col("gid").alias("key")).agg(F.array_sort(F.collect_set("fid")).alias("users"))
    return u.select(F.lit("type").alias("axis"), "key", _csv("users"))


@query("""WITH w AS (SELECT DISTINCT p_partkey AS fid, unnest(string_split(p_name, ' ')) AS token FROM part), m AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, 'f' || (p_partkey % 3) AS file FROM part WHERE p_size < 10)
SELECT w.fid, m.name || '@' || m.file AS macro FROM w JOIN m ON m.name = w.token""")
def d03_macro_users(spark, sf):
    p = t(spark, sf, "part")
    tokens = p.select(F.col("p_partkey").alias("fid"), F.explode(F.split("p_name", " ")).alias("token")).distinct()
    macros = p.where("p_size < 10").select(keys.macro_key(F.split_part("p_name", F.lit(" "), F.lit(1)), F.expr("concat('f', p_partkey % 3)")).alias("macro")).distinct()
    return tokens.join(macros.withColumn("token", F.substring_index("macro", "@", 1)), "token").select("fid", "macro")


@query("""SELECT o_orderkey, coalesce(c.c_custkey, (SELECT min(x.c_custkey) FROM customer x WHERE x.c_mktsegment = CASE o_orderkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'none' END)) AS callee FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = o_custkey""")
def d04_callee_fallback(spark, sf):
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    exact = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("hit"))
    first = c.groupBy(F.col("c_mktsegment").alias("short")).agg(F.min_by("c_custkey", "c_custkey").alias("fallback"))
    x = o.withColumn("short", F.when(F.col("o_orderkey") % 2 == 0, "BUILDING").otherwise("none"))
    return x.join(exact, "o_custkey", "left").join(first, "short", "left").select("o_orderkey", F.coalesce("hit", "fallback").alias("callee"))


@query("SELECT l_partkey, min(l_suppkey) AS unit FROM lineitem GROUP BY l_partkey")
def d06_first_unit(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", "l_suppkey").alias("unit"))


@query("""WITH f AS (SELECT p_partkey AS fid, 'f' || p_partkey // 10 AS file, p_name AS name FROM part) SELECT fid, file, count(*) OVER (PARTITION BY file) - count(*) OVER (PARTITION BY file, name) AS n_siblings FROM f""")
def d18_siblings(spark, sf):
    return catalog.siblings(functions(spark, sf))


@query("""SELECT o_custkey AS owner, count(DISTINCT c.c_custkey) AS n, count(*) FILTER (WHERE c.c_custkey IS NULL) AS dangling, coalesce(string_agg(DISTINCT c.c_name, ',' ORDER BY c.c_name), '') AS names FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c.c_custkey = (o_orderkey % 50) + 1 GROUP BY 1""")
def d19_ids_to_names(spark, sf):
    names = t(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    ids = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_list(F.col("o_orderkey") % 50 + 1).alias("ids"))
    return catalog.names_of(ids, names).select("owner", F.size("names").cast("long").alias("n"), "dangling", F.array_join("names", ",").alias("names"))


DICT = """d(name, range, underlying) AS (VALUES ('Speed', '', 'Base'), ('Base', '', 'uint8_t'), ('Flag', '0-1', ''), ('Deep', '', 'Speed'), ('Loop', '', 'Loop'))"""


@query("""WITH w AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Speed' WHEN 1 THEN 'flag' WHEN 2 THEN 'int' WHEN 3 THEN 'const int &' WHEN 4 THEN 'Unknown' WHEN 5 THEN 'Deep' WHEN 6 THEN 'Loop' ELSE 'float' END AS type FROM part)
SELECT DISTINCT type, CASE type WHEN 'Speed' THEN '0-0xFF' WHEN 'flag' THEN '0-1' WHEN 'int' THEN '-0x80000000-0x7FFFFFFF' WHEN 'Deep' THEN '0-0xFF' ELSE 'NA' END AS range FROM w""")
def d22_s11_range_lookup(spark, sf):
    k = F.col("p_partkey") % 8
    kinds = F.when(k == 0, "Speed").when(k == 1, "flag").when(k == 2, "int").when(k == 3, "const int &").when(k == 4, "Unknown").when(k == 5, "Deep").when(k == 6, "Loop").otherwise("float")
    d = spark.createDataFrame([("Speed", "", "Base"), ("Base", "", "uint8_t"), ("Flag", "0-1", ""), ("Deep", "", "Speed"), ("Loop", "", "Loop")], "name string, range string, underlying string")
    return derive.resolve_ranges(t(spark, sf, "part").select(kinds.alias("type")).distinct(), d)


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 24 AND p_size % 2 = 0 THEN 'base' || p_size ELSE '' END AS enum_name FROM part""")
def d23_typedef_target(spark, sf):
    kinds = _part_types(spark, sf)
    return kinds.select("p_partkey", F.coalesce("target", F.lit("")).alias("enum_name"))


@query("""SELECT s_suppkey AS unit, 'g' || p_partkey AS entry FROM supplier JOIN part ON p_partkey % 100 = s_suppkey % 100 UNION SELECT s_suppkey, 'd' || n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def d24_unit_headers(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("unit"), keys.stem(F.concat(F.lit("src/"), F.col("s_suppkey") % 100, F.lit(".h"))).alias("stem"), F.col("s_nationkey").alias("component"))
    own = t(spark, sf, "part").select(F.concat(F.lit("g"), "p_partkey").alias("entry"), keys.stem(F.concat(F.lit("src/"), F.col("p_partkey") % 100, F.lit(".cpp"))).alias("stem"))
    return catalog.unit_entries(s, own, t(spark, sf, "nation").select(F.col("n_nationkey").alias("component"), F.concat(F.lit("d"), "n_nationkey").alias("entry")))


@query("SELECT DISTINCT a.l_orderkey AS header, a.l_partkey AS includes FROM lineitem a JOIN part p ON p.p_partkey = a.l_partkey WHERE p_brand = 'Brand#1'")
def d25_header_dependencies(spark, sf):
    own = t(spark, sf, "part").where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("includes"))
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("header"), F.col("l_partkey").alias("includes")).distinct().join(own, "includes", "left_semi")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), r AS (SELECT doc_id, 0 AS rid, 1 AS a, 3 AS b FROM l UNION ALL SELECT doc_id, 1, 4, 80 FROM l)
SELECT doc_id AS doc, rid, array_to_string(parts[a:b], chr(10)) AS text FROM l JOIN r USING (doc_id) WHERE len(parts) >= a""")
def a19_line_range_slice(spark, sf):
    d = t(spark, sf, "documents")
    lines = d.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)
    r = d.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.lit(0).alias("rid"), F.lit(1).alias("line"), F.lit(3).alias("end_line")), F.struct(F.lit(1).alias("rid"), F.lit(4).alias("line"), F.lit(80).alias("end_line")))).alias("r")).select("doc", "r.*")
    return derive.line_ranges(lines, r)


@query("""WITH p AS (SELECT user_id AS grp, event_id AS pos FROM events), r AS (SELECT user_id AS grp, event_id - event_id % 50 AS a, event_id - event_id % 50 + event_id % 37 AS b, 'r' || event_id AS label, event_id AS ord FROM events WHERE event_type = 'signup')
SELECT p.grp, p.pos, arg_min(label, ord) AS label FROM p LEFT JOIN r ON r.grp = p.grp AND p.pos BETWEEN a AND b GROUP BY p.grp, p.pos""")
def d38_phase_hint(spark, sf):
    e = t(spark, sf, "events")
    r = e.where("event_type = 'signup'").selectExpr("user_id AS grp", "event_id - event_id % 50 AS line", "event_id - event_id % 50 + event_id % 37 AS end_line", "concat('r', event_id) AS label", "event_id AS ord")
    return derive.in_range_first(e.selectExpr("user_id AS grp", "event_id AS pos"), r)


@query("""WITH m AS (SELECT user_id, event_id FROM events WHERE event_type = 'error'), x AS (SELECT e.user_id AS grp, e.event_id AS pos, max(m.event_id) AS v FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.event_id <= e.event_id GROUP BY 1, 2)
SELECT grp, pos, CASE WHEN pos - v <= 400 THEN v END AS value FROM x""")
def d39_nearest_comment(spark, sf):
    e = t(spark, sf, "events")
    return derive.nearest_before(e.selectExpr("user_id AS grp", "event_id AS pos"), e.where("event_type = 'error'").selectExpr("user_id AS grp", "event_id AS pos", "event_id AS value"), 400)


@query("""WITH w AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM conversations), e AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part UNION SELECT 'the' UNION SELECT 'and') SELECT conv_id, token FROM w WHERE token IN (SELECT name FROM e)""")
def d40_d41_tokens_in_code(spark, sf):
    tokens = t(spark, sf, "conversations").select("conv_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("token")).distinct()
    names = t(spark, sf, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("token")).union(spark.sql("VALUES ('the'), ('and')")).distinct()
    return tokens.join(names, "token", "left_semi").select("conv_id", "token")


@query("""SELECT p_partkey, CASE WHEN p_size < 5 THEN 'enum' WHEN p_size <= 24 AND p_size % 2 = 0 THEN 'typedef' ELSE 'plain' END AS kind FROM part""")
def d42_param_types(spark, sf):
    return _part_types(spark, sf).select("p_partkey", "kind")


def _part_types(spark, sf):
    """Types of the parts' sizes: enums under 5, typedefs of even numbers under 25 (one of them hidden by an enum), plain ones."""
    p = t(spark, sf, "part").select("p_partkey", F.concat(F.lit("T"), "p_size").alias("type"))
    enums = spark.range(0, 5).select(F.concat(F.lit("T"), "id").alias("name"))
    typedefs = spark.range(0, 25, 2).select(F.concat(F.lit("T"), "id").alias("name"), F.concat(F.lit("base"), "id").alias("underlying"))
    return catalog.type_kinds(p, enums, typedefs)


@query("SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def d43_documents_of_components(spark, sf):
    n = t(spark, sf, "nation")
    have = t(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"))
    return catalog.having(n, "n_nationkey", have).join(t(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name")


@query("SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 <> 0) AS is_new FROM orders")
def d44_is_new(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    ref = o.where("o_orderkey % 6 <> 0").withColumn("seen", F.lit(True))
    return o.join(ref, "o_orderkey", "left").select("o_orderkey", F.col("seen").isNull().alias("is_new"))


@query("""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text), ' ')) AS word FROM conversations) SELECT conv_id, word, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def d47_shared_identifiers(spark, sf):
    w = t(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), " ")).alias("word")).distinct()
    return w.groupBy("conv_id", "word").agg(F.count("*").alias("n")).where("n >= 2")


REFS = """r AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) WHEN 1 THEN 'v' || o_orderkey WHEN 2 THEN substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) ELSE 'zz' END AS ref FROM orders),
c AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, md5(CAST(o_orderkey AS VARCHAR)) AS sha, 'v' || o_orderkey AS tag, o_orderkey AS ord FROM orders)"""


@query(f"""WITH {REFS}, d AS (SELECT DISTINCT ref FROM r), m AS (SELECT ref, id, ord FROM d JOIN c ON id = ref UNION ALL SELECT ref, id, ord FROM d JOIN c ON tag = ref UNION ALL SELECT ref, id, ord FROM d JOIN c ON substr(sha, 1, 6) = ref UNION ALL SELECT ref, id, ord FROM d JOIN c ON substr(sha, 1, 2) = ref)
SELECT ref, arg_min(id, ord) AS id FROM d LEFT JOIN m USING (ref) GROUP BY ref""")
def d36_resolve_ref(spark, sf):
    o = t(spark, sf, "orders")
    h, k = F.md5(F.col("o_orderkey").cast("string")), F.col("o_orderkey") % 4
    refs = o.select(F.when(k == 0, F.substring(h, 1, 6)).when(k == 1, F.concat(F.lit("v"), "o_orderkey")).when(k == 2, F.substring(h, 1, 2)).otherwise("zz").alias("ref")).distinct()
    c = o.select(F.col("o_orderkey").cast("string").alias("id"), h.alias("sha"), F.concat(F.lit("v"), "o_orderkey").alias("tag"), F.col("o_orderkey").alias("ord"))
    return derive.prefix_match(refs, c)


@query("SELECT kind, count(*) AS n FROM (SELECT p_type AS kind FROM part) GROUP BY kind")
def e11_kind_counts(spark, sf):
    return t(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, CASE WHEN min(v) IS NULL THEN 'NA' ELSE min(v) || '-' || max(v) END AS range FROM (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN p_size END AS v FROM part) GROUP BY p_brand")
def e10_enum_range(spark, sf):
    p = t(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") % 3 == 0, F.col("p_size"))).alias("v"))
    return p.select("p_brand", catalog.value_range(F.col("v")).alias("range"))


@query("SELECT count(DISTINCT p_brand) AS components, count(DISTINCT p_partkey % 97) AS units, count(*) AS functions FROM part")
def e16_unit_component_counts(spark, sf):
    return catalog.counted(functions(spark, sf), [], {"components": "component", "units": "unit"}, "functions")


@query("SELECT p_brand AS component, count(DISTINCT p_partkey // 10) AS files, count(*) AS functions FROM part GROUP BY p_brand")
def e17_files_per_component(spark, sf):
    return catalog.counted(functions(spark, sf), ["component"], {"files": "file"}, "functions")


@query("SELECT CAST(sum(n) AS BIGINT) AS edges, count(*) AS tus FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey)")
def a11_e21_include_edges(spark, sf):
    tu = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("incs"))
    return tu.agg(F.sum(F.size("incs")).cast("long").alias("edges"), F.count("*").alias("tus"))


@query("SELECT name, arg_min(info, (CASE WHEN info LIKE '%=%' THEN 0 ELSE 1000000 END) + ord) AS info FROM (SELECT p_brand AS name, p_type || CASE WHEN p_size % 9 = 0 THEN '=' || p_size ELSE '' END AS info, p_partkey AS ord FROM part) GROUP BY name")
def e25_prefer_definition(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("name"), F.concat("p_type", F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("="), "p_size")).otherwise("")).alias("info"), F.col("p_partkey").alias("ord"))
    return derive.first_wins(p, ["name"], [F.contains("info", F.lit("=")).desc(), F.col("ord")]).select("name", "info")


@query("SELECT lower(c_mktsegment) || c_nationkey AS k, min(c_custkey) AS first FROM customer GROUP BY 1")
def e26_case_insensitive_dedup(spark, sf):
    c = t(spark, sf, "customer").withColumn("k", F.concat(F.lower("c_mktsegment"), "c_nationkey"))
    return derive.first_wins(c, ["k"], ["c_custkey"]).select("k", F.col("c_custkey").alias("first"))


@query("SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def h04_top_k(spark, sf):
    return derive.top_k(t(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("""WITH x AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS tags FROM part), s AS (SELECT p_partkey, len(list_intersect(tags, (SELECT tags FROM x WHERE p_partkey = 0))) AS overlap FROM x) SELECT p_partkey, overlap FROM s ORDER BY overlap DESC, p_partkey LIMIT 20""")
def h05_rank_by_tags(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tags"))
    wanted = x.where("p_partkey = 0").select(F.col("tags").alias("wanted"))
    return x.join(F.broadcast(wanted.limit(1))).select("p_partkey", F.size(F.array_intersect("tags", "wanted")).cast("long").alias("overlap")).orderBy(F.col("overlap").desc(), "p_partkey").limit(20)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) AND EXISTS (SELECT 1 FROM lineitem)")
def i04_orphans(spark, sf):
    p, valid = t(spark, sf, "part").select("p_partkey"), t(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return p.join(valid, "p_partkey", "left_anti").join(F.broadcast(valid.select(F.lit(1).alias("some")).limit(1))).select("p_partkey")


@query("""WITH w AS (SELECT p_partkey AS wid, 'n::' || p_name AS name, p_size AS line, p_size + 5 AS e FROM part), c AS (SELECT p_partkey AS cid, CASE WHEN p_partkey % 2 = 0 THEN 'n::' ELSE 'm::' END || p_name AS name, p_size + p_partkey % 3 AS line, p_size + 9 AS e, p_partkey % 5 = 0 AS d FROM part),
s AS (SELECT wid, cid, CASE WHEN w.name = c.name THEN 100 ELSE 40 END - abs(w.line - c.line) - least(abs(w.e - c.e), 20) + CASE WHEN d THEN 20 ELSE 0 END AS score FROM w JOIN c ON split_part(w.name, '::', 2) = split_part(c.name, '::', 2))
SELECT wid, arg_max(cid, score * 1000000 - cid) AS cid, max(score) AS score FROM s GROUP BY wid""")
def x01_record_linkage(spark, sf):
    p = t(spark, sf, "part")
    w = p.selectExpr("p_partkey AS wid", "concat('n::', p_name) AS name", "p_size AS line", "p_size + 5 AS end_line")
    c = p.selectExpr("p_partkey AS cid", "concat(CASE WHEN p_partkey % 2 = 0 THEN 'n::' ELSE 'm::' END, p_name) AS name", "p_size + p_partkey % 3 AS line", "p_size + 9 AS end_line", "p_partkey % 5 = 0 AS is_def")
    return derive.link_records(w, c).select("wid", "cid", "score")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'file ' || p_size WHEN p_size % 2 = 0 THEN 'dir' WHEN p_size % 5 > 0 THEN 'top ' || p_size % 5 ELSE '' END AS summary,
  CASE WHEN p_size % 3 = 0 THEN 'q' || p_size WHEN p_size % 4 = 1 THEN 'q' || (p_size // 4 * 4 + 4) END AS said FROM (SELECT *, p_size // 4 * 4 + 4 AS nxt FROM part)""")
def x02_x03_hierarchy_lookup(spark, sf):
    s = F.col("p_size")
    file = F.concat(F.lit("top"), s % 5, F.lit("/dir"), s % 2, F.lit("/f"), s)
    p = t(spark, sf, "part").select("p_partkey", "p_size", file.alias("file"))
    known = p.where("p_size % 3 = 0").select(F.col("file").alias("path"), F.concat(F.lit("file "), "p_size").alias("said")).distinct()
    known = known.unionByName(p.where("p_size % 2 = 0").select(F.regexp_replace("file", "/[^/]*$", "").alias("path"), F.lit("dir").alias("said")).distinct())
    known = known.unionByName(p.where("p_size % 5 > 0").select(F.regexp_extract("file", "^[^/]*", 0).alias("path"), F.concat(F.lit("top "), F.col("p_size") % 5).alias("said")).distinct())
    # names: the qualified one is known for every third size, and under another scope the short one of some others
    names = p.select(F.concat(F.lit("a::n"), "p_size").alias("name")).distinct()
    sizes = spark.range(1, 101)
    said = sizes.where("id % 3 = 0").selectExpr("concat('a::n', id) AS name", "concat('q', id) AS said").unionByName(sizes.where("id % 4 = 1").selectExpr("concat('b::n', id) AS name", "concat('q', id div 4 * 4 + 4) AS said"))
    named = catalog.by_name(names, said)
    out = catalog.nearest_summary(p, known).withColumn("name", F.concat(F.lit("a::n"), "p_size")).join(named, "name")
    return out.select("p_partkey", "summary", "said")


@query(f"""WITH {FUNCTIONS}, {CALLS}, n AS (SELECT DISTINCT callee AS fid, 'callee' AS role FROM calls WHERE caller = 40 UNION SELECT caller, 'caller' FROM calls WHERE callee = 40 UNION SELECT fid, 'same file' FROM functions WHERE file = 'f4' AND fid <> 40)
SELECT file, string_agg(fid || ':' || role, ',' ORDER BY fid, role) AS members FROM n JOIN functions USING (fid) GROUP BY file""")
def x09_neighbourhood(spark, sf):
    f, c = functions(spark, sf).select("fid", "file"), calls(spark, sf)
    n = c.where("caller = 40").select(F.col("callee").alias("fid"), F.lit("callee").alias("role")).union(c.where("callee = 40").select("caller", F.lit("caller"))).union(f.where("file = 'f4' and fid <> 40").select("fid", F.lit("same file"))).distinct()
    items = n.join(f, "fid").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("fid", "role"))).alias("m"))
    return items.select("file", F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["fid"], x["role"])), ",").alias("members"))


@query("SELECT doc_id, CASE WHEN n_chars <= 400 THEN 'full' WHEN n_chars // 2 <= 400 THEN 'half' WHEN n_chars // 10 <= 400 THEN 'brief' ELSE 'name' END AS choice FROM documents")
def g15_tiered_map(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.lit("full").alias("a"), F.col("n_chars").alias("ca"), F.lit("half").alias("b"), F.expr("n_chars div 2").alias("cb"), F.lit("brief").alias("c"), F.expr("n_chars div 10").alias("cc"))
    return derive.tiered_choice(d, [("a", "ca"), ("b", "cb"), ("c", "cc")], 400, "name").select("doc_id", "choice")

"""Queries of reports and whole runs: knowledge table, context packets, plans of diagrams, extension points."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom import extensions
from factloom.functions import keys
from factloom.operators import catalog, context, derive, graph, incremental as inc
from factloom.plans.inputs import ACCESS, CALLS, FUNCTIONS, access, calls, functions, query, t, versions
from factloom.scratch import shared_dir
from factloom.sources import readers, sinks


@query(f"""WITH {FUNCTIONS}, {CALLS}, {ACCESS}, c AS (SELECT caller AS fid, string_agg(f.name, ',' ORDER BY f.name) AS calls FROM calls JOIN functions f ON f.fid = callee GROUP BY 1), a AS (SELECT fid, string_agg(DISTINCT s, ',' ORDER BY s) AS globals FROM (SELECT fid, coalesce(s_name, CAST(gid AS VARCHAR)) AS s FROM access LEFT JOIN supplier ON s_suppkey = gid AND s_suppkey % 2 = 0) GROUP BY fid)
SELECT fid, name, coalesce(calls, '') AS calls, coalesce(globals, '') AS globals FROM functions LEFT JOIN c USING (fid) LEFT JOIN a USING (fid)""")
def b14_knowledge_base(spark, sf):
    """Calls by name (dangling ones dropped), globals by name (dangling ones keep their id)."""
    f = functions(spark, sf).select("fid", "name")
    c = calls(spark, sf).join(f.select(F.col("fid").alias("callee"), F.col("name").alias("n")), "callee").groupBy(F.col("caller").alias("fid")).agg(F.array_join(F.array_sort(F.collect_list("n")), ",").alias("calls"))
    s = t(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("gid"), "s_name")
    g = access(spark, sf).join(s, "gid", "left").groupBy("fid").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("s_name", F.col("gid").cast("string")))), ",").alias("globals"))
    return f.join(c, "fid", "left").join(g, "fid", "left").select("fid", "name", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("globals", F.lit("")).alias("globals"))


@query(f"""WITH {FUNCTIONS}, {CALLS}, n AS (SELECT callee AS fid, count(*) AS n FROM calls GROUP BY 1), c AS (SELECT callee AS fid, string_agg(caller, ',' ORDER BY caller) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS k FROM calls) WHERE k <= 5 GROUP BY 1)
SELECT fid, name || chr(10) || component || CASE WHEN callers IS NULL THEN '' ELSE chr(10) || 'called by ' || callers END AS packet FROM functions LEFT JOIN c USING (fid)""")
def x04_context_packet(spark, sf):
    top = derive.top_k(calls(spark, sf), ["callee"], ["caller"], 5).groupBy(F.col("callee").alias("fid")).agg(F.array_join(F.array_sort(F.collect_list("caller")).cast("array<string>"), ",").alias("callers"))
    return functions(spark, sf).join(top, "fid", "left").select("fid", F.concat_ws("\n", "name", "component", F.concat(F.lit("called by "), "callers")).alias("packet"))


@query(f"""WITH {FUNCTIONS}, p AS (SELECT component, file, fid, row_number() OVER (PARTITION BY component, file ORDER BY fid) AS k FROM functions) SELECT component, count(DISTINCT file) AS files, count(*) AS listed FROM p WHERE k <= 2 GROUP BY component""")
def h04b_capped_listing(spark, sf):
    p = derive.top_k(functions(spark, sf), ["component", "file"], ["fid"], 2)
    return p.groupBy("component").agg(F.count_distinct("file").alias("files"), F.count("*").alias("listed"))


@query(f"""WITH {FUNCTIONS}, {CALLS}, i AS (SELECT fid FROM functions WHERE size = 7), n AS (SELECT fid FROM i UNION SELECT caller FROM calls WHERE callee IN (SELECT fid FROM i) UNION SELECT callee FROM calls WHERE caller IN (SELECT fid FROM i)), u AS (SELECT DISTINCT unit FROM functions JOIN n USING (fid))
SELECT unit, CASE WHEN unit IN (SELECT unit FROM u) THEN 'regenerate' WHEN max(fid % 17) > 0 THEN 'carry' ELSE 'skip' END AS action FROM functions GROUP BY unit""")
def w17_w18_diagram_plan(spark, sf):
    """Units to draw anew, and those carried over from the stored version."""
    f = functions(spark, sf)
    hit = graph.affected_units(f.where("size = 7").select("fid"), calls(spark, sf), f.select("fid", "unit")).withColumn("hit", F.lit(True))
    stored = f.where("fid % 17 <> 0").select("unit").distinct().withColumn("stored", F.lit(True))
    all_units = f.select("unit").distinct()
    return all_units.join(hit, "unit", "left").join(stored, "unit", "left").select("unit", F.when(F.col("hit"), "regenerate").when(F.col("stored"), "carry").otherwise("skip").alias("action"))


@query("""SELECT o_custkey AS project, arg_min(o_orderkey, (o_orderkey * 7919) % 1009 * 10000000 + o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS baseline, CASE WHEN count(*) FILTER (WHERE o_orderstatus <> 'P') > 0 THEN 'incremental' ELSE 'full' END AS decision FROM orders GROUP BY 1""")
def w19_baseline_preview(spark, sf):
    """Of each project: the nearest complete version, and what a run from it would be."""
    from factloom.operators.documents import choose_baseline

    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("baseline"), ((F.col("o_orderkey") * 7919) % 1009).alias("distance"), F.col("o_orderkey").alias("ord"), "o_orderstatus")
    near = o.select("project").distinct().join(inc.nearest_ancestor(o.where("o_orderstatus <> 'P'"), "project", "baseline", "distance", "ord"), "project", "left")
    none = F.lit(None)
    return near.withColumn("b", choose_baseline(F.col("baseline"), none.cast("long"), none.cast("string"), none.cast("boolean"))).select("project", F.col("b.base").alias("baseline"), "b.decision")


@query("""SELECT p_brand AS grp, count(*) FILTER (WHERE p_size % 3 = 0) AS actions, count(*) FILTER (WHERE p_size % 3 = 0) >= 6 AS may_simplify FROM part GROUP BY 1""")
def x11_simplify_guard(spark, sf):
    kinds = F.when(F.col("p_size") % 3 == 0, "ACTION").otherwise("DECISION")
    return catalog.may_simplify(t(spark, sf, "part").select(F.col("p_brand").alias("grp"), kinds.alias("type")))


@query("SELECT l_orderkey, string_agg(callee, ',' ORDER BY first) AS calls FROM (SELECT l_orderkey, 'f' || l_partkey AS callee, min(l_linenumber * 1000000 + l_partkey) AS first FROM lineitem WHERE NOT starts_with('f' || l_partkey, 'f1') GROUP BY 1, 2) GROUP BY 1")
def x15_project_calls(spark, sf):
    """Calls in order of first sight without repeats, library prefixes left out."""
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fid"), F.concat(F.lit("f"), "l_partkey").alias("callee"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"))
    return catalog.project_calls(li, ["f1"]).select(F.col("fid").alias("l_orderkey"), F.array_join("callees", ",").alias("calls"))


@query("SELECT p_brand AS component, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n FROM (SELECT DISTINCT p_brand, 'src/' || p_size AS path FROM part) GROUP BY 1")
def c03_x16_x17_component_mapping(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("component"), F.concat(F.lit("src/"), "p_size").alias("path"), "p_partkey")
    under = p.where(keys.is_under(F.col("path"), F.lit("src")))
    once = derive.first_wins(under, ["component", "path"], ["p_partkey"])
    return once.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {CALLS}, l1 AS (SELECT DISTINCT callee AS node FROM calls WHERE caller = 40 AND callee <> 40 ORDER BY 1 LIMIT 1), l2 AS (SELECT DISTINCT callee AS node FROM calls WHERE caller IN (SELECT node FROM l1) AND callee <> 40 AND callee NOT IN (SELECT node FROM l1) ORDER BY 1 LIMIT 1)
SELECT CAST(40 AS BIGINT) AS node, 0 AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def f11_capped_levels(spark, sf):
    return graph.bounded_bfs(calls(spark, sf), spark.range(40, 41).select(F.col("id").alias("node")), 2, "caller", "callee", per_level=1)


@query(f"""WITH {FUNCTIONS}, b AS (SELECT fid, md5(name || '|' || size) AS hash FROM functions WHERE fid % 17 <> 0) SELECT count(*) AS functions, count(DISTINCT hash) AS hashes, 100 * 0 AS percent_reused FROM b""")
def x21_full_generation(spark, sf):
    """A full run: hash and edge snapshots stored for a version, the reuse index seeded, the report made."""
    folder = f"{shared_dir(spark)}/full-{uuid.uuid4().hex}"
    base, _ = versions(spark, sf)
    sinks.write_version(base, f"{folder}/hashes", "v1")
    sinks.write_version(calls(spark, sf), f"{folder}/edges", "v1")
    stored = spark.read.parquet(f"{folder}/hashes")
    index = inc.index_put(spark.createDataFrame([], "fp string, version string, key long"), stored.select(F.col("hash").alias("fp"), F.col("version_id").alias("version"), F.col("fid").alias("key")))
    report = inc.reuse_report(stored.select(F.lit("regenerate").alias("action")))
    sinks.write_lines(report.select(F.to_json(F.struct("*")).alias("value")), f"{folder}/report")
    return stored.agg(F.count("*").alias("functions")).crossJoin(index.agg(F.count("*").alias("hashes"))).crossJoin(report.select(F.col("percent_reused").cast("int").alias("percent_reused")))


@query("SELECT r_regionkey AS id, r_name AS name, 'complete' AS status FROM region")
def x23_import_project(spark, sf):
    """Rows of an existing output folder registered in a catalog table."""
    repo = extensions.Repository(spark, f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}", "id int, name string, status string")
    rows = t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("draft").alias("status"))
    repo.put(rows)
    repo.put(rows.withColumn("status", F.lit("complete")))
    return repo.all()


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS note FROM nation")
def a15_b01_json_model(spark, sf):
    """A model table written as JSON and read back with its stated schema."""
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).alias("note"))
    sinks.write_table(n, path, fmt="json")
    return spark.read.schema("k int, name string, note string").json(path).select("k", "name", keys.or_default(F.col("note"), "").alias("note"))


@extensions.register("interface_tables")
def interface_table_view(model, config):
    return derive.interface_rows(model["functions"], model["members"], model["calls"])


@extensions.register("unit_edges")
def unit_edge_view(model, config):
    return derive.lift_calls(model["members"], model["calls"])


@query(f"""WITH {FUNCTIONS}, {CALLS} SELECT count(*) AS n FROM functions""")
def u01_view_registry(spark, sf):
    f = functions(spark, sf).select("fid", "unit")
    out = extensions.run_views({"functions": f, "members": f, "calls": calls(spark, sf)}, {"views": {"unit_edges": False}})
    return out["interface_tables"].agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND contains(lower(s_name), '1') ORDER BY s_name, s_suppkey LIMIT 10")
def u02_repository(spark, sf):
    repo = extensions.Repository(spark, f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}", "id long, name string")
    rows = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    repo.put(rows)
    repo.delete(rows.where("id % 3 = 0").select("id"))
    return repo.search("1", ["name"], 10)


@query("SELECT p_partkey, p_name, upper(p_name) AS answer FROM part")
def u03_u04_provider(spark, sf):
    return extensions.enrich(t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", lambda prompts: [p.upper() for p in prompts])


@query("SELECT DISTINCT 'f' || l_partkey || '.cpp' AS path FROM lineitem WHERE l_linenumber = 1")
def a01_a03_restricted_scan(spark, sf):
    """Listed source files kept by a list of paths."""
    listing = t(spark, sf, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".cpp")).alias("path"))
    only = t(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("f"), "l_partkey", F.lit(".cpp")).alias("path"))
    return listing.join(only, "path", "left_semi")


@query("SELECT o_orderkey, md5(o_orderstatus) AS sha, 'a' AS author, epoch(o_orderdate)::BIGINT AS at FROM orders")
def a20b_git_log(spark, sf):
    o = t(spark, sf, "orders")
    line = F.concat_ws("\x1f", F.md5("o_orderstatus"), F.lit("a"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey").cast("string"))
    return readers.parse_log(o.select(line.alias("value"))).select(F.col("message").cast("long").alias("o_orderkey"), "sha", "author", F.unix_timestamp("committed_at").alias("at"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'd' || p_size END AS diagram FROM part")
def w18_stored_diagram(spark, sf):
    """A unit's diagram in an earlier version, of several the last."""
    wanted = t(spark, sf, "part").select("p_partkey", F.lit("v1").alias("version"), F.concat(F.lit("u"), "p_size").alias("unit"))
    sizes = spark.range(1, 101)
    stored = sizes.where("id % 3 <> 0").selectExpr("'v1' AS version", "concat('u', id) AS unit", "concat('d', id) AS diagram", "2 AS ord")
    stored = stored.unionByName(sizes.selectExpr("CASE WHEN id % 3 = 0 THEN 'v2' ELSE 'v1' END AS version", "concat('u', id) AS unit", "'old' AS diagram", "1 AS ord"))
    return catalog.stored_diagram(wanted, stored).select("p_partkey", "diagram")


@query("SELECT p_partkey, p_size % 2 = 0 OR (p_size % 3 > 0 AND p_size % 5 = 0) AS changed FROM part")
def m04_group_changed(spark, sf):
    """Whether a group of a document changed: by its tables, else by its render where both documents are there."""
    s = F.col("p_size")
    return t(spark, sf, "part").select("p_partkey", catalog.group_changed(s % 2 == 0, s % 3 > 0, F.when(s % 7 > 0, s % 5 == 0).otherwise(F.when(s % 5 == 0, F.lit(True)))).alias("changed"))


@query("""SELECT n_regionkey || '/v1/' || lower(r_name) AS id, 'nations' AS name, 'n' || n_nationkey AS key, n_nationkey AS number, n_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_regionkey || '/v1/' || lower(r_name), 'suppliers', CAST(s_suppkey AS VARCHAR), s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'bad', 'nowhere.json', 'not a table''s path', NULL, NULL UNION ALL SELECT 'bad', '0/v1/africa/broken.json', 'broken JSON', NULL, NULL""")
def x23_import_folder(spark, sf):
    """A folder of a project a region, with its nations as an object by key and its suppliers as a list, a broken file and a stray one, read back as
    typed tables."""
    from factloom.sources import ingest
    from factloom.sources.tables import Folder

    folder = f"{shared_dir(spark)}/output-{uuid.uuid4().hex}"
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    at = [F.concat_ws("/", "n_regionkey", F.lit("v1"), F.lower("r_name")).alias("at")]
    keyed = n.groupBy(*at).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), "n_nationkey"), F.struct(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title")))))).alias("text"))
    s = t(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    listed = s.groupBy(*at).agg(F.to_json(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("number"), F.col("s_name").alias("title")))).alias("text"))
    files = Folder(spark, folder)
    for name, frame in (("nations", keyed), ("suppliers", listed)):  # a file a region
        for row in frame.toLocalIterator():
            files.put_if_absent(f"{row['at']}/{name}.json", row.text if name == "nations" else f'{{"entries": {row.text}}}')
    files.put_if_absent("0/v1/africa/broken.json", '{"a": {"b": 1}')
    files.put_if_absent("nowhere.json", "{}")
    files.delete("drafts")
    entries, bad = ingest.read_folder(spark, folder)
    fields = ingest.infer_fields(entries)
    tables = [ingest.typed_table(entries, fields, name).select(F.concat_ws("/", "project", "version", "grp").alias("id"), F.lit(name).alias("name"), "key", "number", "title") for name in ("nations", "suppliers")]
    none = [F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("title")]
    return tables[0].unionByName(tables[1]).unionByName(bad.select(F.lit("bad").alias("id"), F.col("path").alias("name"), F.col("reason").alias("key"), *none))


@query(f"""WITH {FUNCTIONS}, {CALLS}, u AS (SELECT component, count(*) AS n FROM functions GROUP BY component), h AS (SELECT count(DISTINCT md5(name || '|' || size)) AS n FROM functions), e AS (SELECT count(*) AS n FROM calls)
SELECT 'components' AS what, count(*) AS n FROM u UNION ALL SELECT 'functions', CAST(sum(n) AS BIGINT) FROM u UNION ALL SELECT 'hashes', n FROM h UNION ALL SELECT 'edges', n FROM e
UNION ALL SELECT 'first run wrote', 5 UNION ALL SELECT 'second run wrote', 0 UNION ALL SELECT 'third run wrote', 3""")
def x21_incremental_generation(spark, sf):
    """Units, hashes, edges, interfaces and a report derived from raw rows by tasks: the second run writes nothing, one with another size of a
    function only what depends on it."""
    from factloom.operators.generation import Task, generate

    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    f, c = functions(spark, sf), calls(spark, sf)
    tasks = [
        Task("edges", ("calls",), lambda c: c.distinct()),
        Task("interfaces", ("edges",), lambda e: e.groupBy(F.col("callee").alias("fid")).agg(F.count("*").alias("callers"))),
        Task("units", ("functions",), lambda f: f.groupBy("component", "file").agg(F.count("*").alias("n"))),
        Task("hashes", ("functions",), lambda f: f.select("fid", F.md5(F.concat_ws("|", "name", "size")).alias("hash"))),
        Task("report", ("units", "hashes", "edges"), lambda u, h, e: u.agg(F.count_distinct("component").alias("components"), F.sum("n").alias("functions")).crossJoin(h.agg(F.count_distinct("hash").alias("hashes"))).crossJoin(e.agg(F.count("*").alias("edges")))),
    ]
    wrote = lambda run: sum(s == "written" for s in run.status.values())
    first = generate(spark, folder, {"functions": f, "calls": c}, tasks)
    second = generate(spark, folder, {"functions": f, "calls": c}, tasks)
    third = generate(spark, folder, {"functions": f.withColumn("size", F.when(F.col("fid") == 7, 99).otherwise(F.col("size"))), "calls": c}, tasks)
    said = second.tables["report"].select(F.explode(F.create_map(*[x for k in ("components", "functions", "hashes", "edges") for x in (F.lit(k), F.col(k))])).alias("what", "n"))
    runs = [(f"{k} run wrote", wrote(r)) for k, r in (("first", first), ("second", second), ("third", third))]
    return said.unionByName(spark.createDataFrame(runs, "what string, n long"))


@query(f"""WITH {FUNCTIONS}, {CALLS}, m AS (SELECT fid, component || '|' || unit AS unit, component, CASE WHEN fid % 5 <> 0 THEN 'IF_' || fid END AS iface FROM functions),
e AS (SELECT a.unit AS f, b.unit AS t, a.component AS fc, b.component AS tc, string_agg(DISTINCT b.iface, '<br/>' ORDER BY b.iface) AS label FROM calls JOIN m a ON a.fid = caller JOIN m b ON b.fid = callee WHERE a.unit <> b.unit AND b.iface IS NOT NULL GROUP BY ALL),
s AS (SELECT t AS unit, tc AS component, f AS other, fc AS home, true AS calls_it, label FROM e UNION ALL SELECT f, fc, t, tc, false, label FROM e),
x AS (SELECT *, home = component AS inside, max(calls_it) OVER (PARTITION BY unit, other) AS any_in, replace(replace(unit, '|', '_'), ' ', '-') AS i, replace(replace(other, '|', '_'), ' ', '-') AS j FROM s),
o AS (SELECT DISTINCT unit, other, home, inside, any_in, i, j, j || '["' || replace(home || '/' || other, '-', ' ') || '"]' AS node FROM x),
p AS (SELECT DISTINCT unit, component, replace(replace(unit, '|', '_'), ' ', '-') AS i FROM m),
a AS (SELECT *, CASE WHEN calls_it THEN j || ' ' || i ELSE i || ' ' || j END AS ends, CASE WHEN calls_it THEN j || ' -->|' || label || '| ' || i ELSE i || ' -->|' || label || '| ' || j END AS arrow FROM x),
l(unit, section, ord, line) AS (
  SELECT unit, 0, '', '%%{{init: {{''flowchart'': {{''splines'': ''ortho''}}}}}}%%' || chr(10) || 'flowchart LR' || chr(10) || '  classDef internal fill:#87CEEB,stroke:#333,stroke-width:1px' || chr(10) || '  classDef mainUnit fill:#87CEEB,stroke:#4682B4,stroke-width:3px' || chr(10) FROM p
  UNION ALL SELECT unit, 1, j, '  ' || node FROM o WHERE any_in AND NOT inside
  UNION ALL SELECT unit, 2, '', '  subgraph internal_mod["' || replace(component, '-', ' ') || '"]' || chr(10) || '    direction TB' || chr(10) || '    style internal_mod fill:#ffffcc,stroke:#d4d400,stroke-width:2px' || chr(10) FROM p
  UNION ALL SELECT unit, 3, j, '    ' || node FROM o WHERE any_in AND inside UNION ALL SELECT unit, 4, '', '    ' || i || '["' || unit || '"]' FROM p UNION ALL SELECT unit, 5, j, '    ' || node FROM o WHERE NOT any_in AND inside
  UNION ALL SELECT unit, 6, '', '' FROM p UNION ALL SELECT unit, 7, ends, '    ' || arrow FROM a WHERE inside UNION ALL SELECT unit, 8, '', chr(10) || '    class ' || i || ' mainUnit' FROM p
  UNION ALL SELECT unit, 9, '', '    class ' || string_agg(j, ',' ORDER BY NOT any_in, j) || ' internal' FROM o WHERE inside GROUP BY unit UNION ALL SELECT unit, 10, '', '  end' || chr(10) FROM p
  UNION ALL SELECT unit, 11, j, '  ' || node FROM o WHERE NOT any_in AND NOT inside UNION ALL SELECT unit, 12, '', '' FROM p UNION ALL SELECT unit, 13, ends, '  ' || arrow FROM a WHERE NOT inside AND (calls_it OR NOT any_in))
SELECT unit, string_agg(line, chr(10) ORDER BY section, ord) AS mermaid FROM l GROUP BY unit""")
def b04_unit_diagrams(spark, sf):
    """Every unit's diagram, its edges labelled by interface ids."""
    m = functions(spark, sf).select("fid", F.concat_ws("|", "component", "unit").alias("unit"), "component", F.when(F.col("fid") % 5 != 0, F.concat(F.lit("IF_"), "fid")).alias("iface"))
    return context.unit_diagrams(m, calls(spark, sf))


@query(f"""WITH {FUNCTIONS}, {CALLS}, {ACCESS}, d AS (SELECT fid, name, component, file, CASE WHEN fid % 3 <> 0 THEN 'does ' || type END AS about, size FROM functions),
c AS (SELECT callee AS fid, string_agg(chr(10) || '  ' || name || CASE WHEN about IS NULL THEN '' ELSE ': ' || about END, '' ORDER BY name, caller) AS t FROM (SELECT callee, caller, name, about, row_number() OVER (PARTITION BY callee ORDER BY name, caller) AS k FROM (SELECT DISTINCT * FROM calls) JOIN d ON d.fid = caller) WHERE k <= 5 GROUP BY callee),
u AS (SELECT fid, gid, string_agg(DISTINCT CASE mode WHEN 'w' THEN 'writes' ELSE 'reads' END, ' and ' ORDER BY CASE mode WHEN 'w' THEN 'writes' ELSE 'reads' END) AS how FROM access GROUP BY fid, gid),
g AS (SELECT fid, string_agg(chr(10) || '  ' || how || ' ' || s_name || CASE WHEN gid % 2 = 0 THEN ': nation ' || s_nationkey ELSE '' END, '' ORDER BY s_name, gid) AS t FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY s_name, gid) AS k FROM u JOIN supplier ON s_suppkey = gid) WHERE k <= 5 GROUP BY fid)
SELECT fid, 'Location: all > ' || component || ' > ' || file || coalesce(chr(10) || 'Called by:' || c.t, '') || CASE WHEN size % 4 > 0 THEN chr(10) || 'Parameters: T' || size % 7 || ' a' || CASE WHEN size % 4 > 1 THEN ', int b' ELSE '' END ELSE '' END
  || CASE WHEN size % 4 > 0 AND size % 7 < 5 THEN chr(10) || 'Parameter type context:' || chr(10) || '  T' || size % 7 || ': type ' || size % 7 ELSE '' END || coalesce(chr(10) || 'Purpose: ' || about, '')
  || CASE WHEN fid % 4 = 0 THEN chr(10) || 'Function execution phases:' || chr(10) || '  Phase 1 (lines 1-' || size || '): begin' || chr(10) || '  Phase 2 (lines ' || (size + 1) || '-' || (size + 9) || '): end' ELSE '' END || coalesce(chr(10) || 'Globals:' || g.t, '') AS packet
FROM d LEFT JOIN c USING (fid) LEFT JOIN g USING (fid)""")
def x04_base_context(spark, sf):
    """The whole context packet of every function."""
    f = functions(spark, sf)
    size = F.col("size")
    param = lambda t_, n: F.struct(t_.alias("type"), F.lit(n).alias("name"))
    params = F.slice(F.array(param(F.concat(F.lit("T"), size % 7), "a"), param(F.lit("int"), "b")), F.lit(1), F.least(size % 4, F.lit(2)).cast("int"))
    fs = f.select("fid", "name", F.lit("all").alias("project"), "component", "file", F.when(F.col("fid") % 3 != 0, F.concat(F.lit("does "), "type")).alias("description"), params.alias("params"))
    g = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("gid"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nation "), "s_nationkey")).alias("said"))
    types = t(spark, sf, "region").select(F.concat(F.lit("T"), "r_regionkey").alias("type"), F.concat(F.lit("type "), "r_regionkey").alias("said"))
    part = lambda a, b, said: F.struct(a.alias("start_line"), b.alias("end_line"), F.lit(said).alias("said"))
    steps = f.where("fid % 4 = 0").select("fid", F.explode(F.array(part(F.lit(1), size, "begin"), part(size + 1, size + 9, "end"))).alias("x")).select("fid", "x.*")
    return context.context_packets(fs, calls(spark, sf), access(spark, sf), g, types, steps)


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN sig || chr(10) || d || chr(10) || p_comment_ WHEN 1 THEN sig || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'three' WHEN 2 THEN sig || chr(10) || p_brand WHEN 3 THEN sig ELSE p_name END AS detail
FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'void ' || p_name || '()' END AS sig, p_brand || chr(10) || p_type || chr(10) || 'three' || chr(10) || 'four' AS d, 'code ' || p_size AS p_comment_ FROM part) WHERE p_partkey % 3 <> 0 OR p_size % 5 <> 0
UNION ALL SELECT p_partkey, p_brand || chr(10) || p_type || chr(10) || 'three' || chr(10) || 'four' || chr(10) || 'code ' || p_size FROM part WHERE p_partkey % 3 = 0 AND p_size % 5 = 0""")
def x08_five_levels(spark, sf):
    p, none = t(spark, sf, "part"), F.lit(None).cast("string")
    signature = F.when(F.col("p_partkey") % 3 == 0, none).otherwise(F.concat(F.lit("void "), "p_name", F.lit("()")))
    said = F.concat_ws("\n", "p_brand", "p_type", F.lit("three"), F.lit("four"))
    return p.select("p_partkey", context.detail_text(F.col("p_size") % 5, F.col("p_name"), signature, said, F.concat(F.lit("code "), "p_size")).alias("detail"))


@query(f"""WITH {FUNCTIONS}, {CALLS}, r AS (SELECT fid, other, min(role) AS role FROM (SELECT caller AS fid, callee AS other, 'callee' AS role FROM calls WHERE caller <> callee UNION ALL SELECT callee, caller, 'caller' FROM calls WHERE caller <> callee) GROUP BY fid, other),
n AS (SELECT r.fid, f.file, f.name, f.fid AS id, role FROM r JOIN functions f ON f.fid = other UNION ALL SELECT a.fid, a.file, b.name, b.fid, NULL FROM functions a JOIN functions b ON a.file = b.file AND a.fid <> b.fid WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.fid = a.fid AND other = b.fid)),
m AS (SELECT fid, file, string_agg(name || coalesce(' [' || role || ']', ''), chr(10) ORDER BY name, id) AS t FROM n GROUP BY fid, file)
SELECT coalesce(m.fid, f.fid) AS fid, coalesce(m.file, f.file) AS file, CASE WHEN f.fid IS NULL THEN t ELSE concat_ws(chr(10), f.name || ' [target]', t) END AS members FROM m FULL JOIN functions f ON f.fid = m.fid AND f.file = m.file""")
def x09_all_neighbourhoods(spark, sf):
    """The neighbourhood of every function, by file."""
    return context.neighbourhoods(functions(spark, sf), calls(spark, sf))

"""Queries over scalar, text, JSON, source and sequential functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.functions import keys, text as tx
from factloom.operators import catalog, sequential
from factloom.plans.inputs import calls, query, t
from factloom.scratch import shared_dir
from factloom.sources import readers, sinks


@query("SELECT p_partkey, trim('a/' || p_name || '/', '/') AS norm, CASE WHEN p_partkey % 2 = 0 THEN p_name || '.cpp' END AS rel, regexp_replace(p_name, ' .*', '') AS stem, substr(md5(p_name), 1, 16) AS version FROM part")
def s01_s02_s03_paths(spark, sf):
    p = t(spark, sf, "part")
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/repo\\").otherwise("/repository/"), "p_name", F.lit(".cpp"))
    return p.select("p_partkey", keys.normal_path(F.concat(F.lit("\\a\\"), "p_name", F.lit("//"))).alias("norm"), keys.repo_relative(path, F.lit("/repo/")).alias("rel"),
                    keys.stem(F.concat(F.lit("x/y."), F.lit("z/"), F.substring_index("p_name", " ", 1), F.lit(".tar"))).alias("stem"), keys.version_id(F.md5("p_name")).alias("version"))


@query("SELECT p_partkey, p_brand || '|f' || p_size AS unit, p_brand || '|f' || p_size || '|g' AS global, p_brand || '|f' || p_size || '|n::f|int,char' AS fn, 'M@f' || p_size AS macro, 'f' AS short FROM part")
def s04_key_builders(spark, sf):
    path = F.concat(F.lit("src/f"), "p_size", F.lit(".cpp"))
    b = F.col("p_brand")
    return t(spark, sf, "part").select(
        "p_partkey", keys.unit_key(b, path).alias("unit"), keys.global_key(b, path, F.lit("g")).alias("global"), keys.function_key(b, path, F.lit("n::f"), F.array(F.lit("int"), F.lit("char"))).alias("fn"),
        keys.macro_key(F.lit("M"), F.concat(F.lit("f"), "p_size")).alias("macro"), keys.short_name(F.lit("a::b::f")).alias("short"))


@query("SELECT p_partkey, regexp_replace(p_name || '#1', '[^A-Za-z0-9._-]', '_', 'g') AS safe, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS label, p_size % 2 = 0 AS poor FROM part")
def s05_s08_s10_labels(spark, sf):
    return t(spark, sf, "part").select(
        "p_partkey", keys.safe_filename(F.concat("p_name", F.lit("#1"))).alias("safe"), keys.readable_label(F.concat(F.lit("g_"), F.replace("p_name", F.lit(" "), F.lit("_")))).alias("label"),
        keys.poor_name(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " input").otherwise(" value"))).alias("poor"))


@query("""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS has_param, p_size % 3 = 0 AS writes, p_size % 5 = 0 AS reads, p_size % 7 = 0 AS returns, split_part(p_name, ' ', 1) AS n, p_size FROM part),
l AS (SELECT *, CASE WHEN length(n) > 2 THEN upper(substr(n, 1, 1)) || substr(n, 2) END AS label FROM p),
g AS (SELECT *, CASE WHEN writes THEN 'Count ' || p_size WHEN reads THEN 'Seen ' || p_size END AS touched FROM l)
SELECT p_partkey, coalesce(CASE WHEN has_param THEN label ELSE touched END, coalesce(label, 'Behaviour') || ' input') AS input_name,
  coalesce(CASE WHEN returns THEN 'Code ' || p_size END, touched, coalesce(label, 'Behaviour') || ' result') AS output_name FROM g""")
def s09_behaviour_name(spark, sf):
    s, word = F.col("p_size"), F.substring_index("p_name", " ", 1)
    names = keys.behaviour_names(
        F.when(s % 2 == 0, word).otherwise(""), F.when(s % 3 == 0, F.concat(F.lit("ns::g_count_"), "p_size")), F.when(s % 5 == 0, F.concat(F.lit("g_seen_"), "p_size")),
        F.lit("static int"), F.when(s % 7 == 0, F.concat(F.lit("(code_"), "p_size", F.lit(" + 1)"))), F.concat(F.lit("A::"), word))
    return t(spark, sf, "part").select("p_partkey", names.alias("b")).select("p_partkey", "b.*")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'x ' || p_size END AS label, 'Brief ' || p_size AS fallback FROM part""")
def s15_s18_edge_labels(spark, sf):
    k = F.col("p_size") % 3
    label = F.when(k == 0, " TRUE").when(k == 1, "0").otherwise(F.concat(F.lit("x "), "p_size"))
    return t(spark, sf, "part").select("p_partkey", tx.edge_label(label).alias("label"), F.concat_ws(" ", F.lit("Brief"), "p_size").alias("fallback"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(length(text) / 3.5) + 1 AS BIGINT) END AS tokens, CAST(floor(length(text) * 0.9 * 0.25) AS BIGINT) AS share, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS lines FROM documents")
def s21_s22_s23_budgets(spark, sf):
    n = F.char_length("text")
    return t(spark, sf, "documents").select("doc_id", tx.token_count(F.col("text")).alias("tokens"), tx.budget_split(n, {"code": 0.25}, 0.1)["code"].alias("share"), tx.line_count(F.col("text")).alias("lines"))


@query("""WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), l AS (SELECT doc_id, length(unnest(parts)) AS n, generate_subscripts(parts, 1) AS pos FROM p),
e AS (SELECT doc_id, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS e FROM l) SELECT doc_id, CAST(coalesce(max(e) FILTER (WHERE e < 350), 0) AS INTEGER) AS kept FROM e GROUP BY doc_id""")
def s21_truncate_to_budget(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.char_length(tx.truncate_to_budget(F.col("text"), 100)).alias("kept"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || p_brand ELSE '<thinking>' || p_name END AS clean,
  CASE p_size % 4 WHEN 3 THEN p_name || ' [x]' ELSE 'started ' || p_name END AS line FROM part""")
def s24_s25_strip(spark, sf):
    k, m = F.col("p_size") % 3, F.col("p_size") % 4
    noisy = F.when(k == 0, F.concat(F.lit("<think>a\nb</think>\n"), "p_name")).when(k == 1, F.concat("p_name", F.lit("\n<think>"), "p_type", F.lit("</think>"), "p_brand", F.lit("<think></think>  "))).otherwise(F.concat(F.lit("<thinking>"), "p_name"))
    line = F.when(m == 3, F.concat("p_name", F.lit(" [x]"))).otherwise(F.concat(F.when(m == 0, "[INFO] [x] ").when(m == 1, "12:30:59 WARN ").otherwise("12:30:59  [p 1]"), F.lit("started "), "p_name"))
    return t(spark, sf, "part").select("p_partkey", tx.strip_sections(noisy).alias("clean"), tx.strip_log_prefix(line).alias("line"))


@query("SELECT p_partkey, 'int f(' || p_brand || ' a, char b)' AS signature FROM part")
def s26_signature(spark, sf):
    p = lambda a, b: F.struct(b.alias("name"), a.alias("type"))
    return t(spark, sf, "part").select("p_partkey", keys.signature(F.lit("int"), F.lit("f"), F.array(p(F.col("p_brand"), F.lit("a")), p(F.lit("char"), F.lit("b")))).alias("signature"))


@query("SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS parsed, epoch(o_orderdate)::BIGINT + 900 AS expires FROM orders")
def s27_s28_times(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    at = readers.parse_time(text)
    return t(spark, sf, "orders").select("o_orderkey", F.unix_timestamp(at).alias("parsed"), F.unix_timestamp(at + F.expr("interval 15 minutes")).alias("expires"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(\\s+|\\S+)')) AS INTEGER) AS words FROM documents")
def s29_word_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.size(tx.word_tokens(F.col("text"))).alias("words"))


@query("SELECT p_partkey, '| Name | Size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || '/x | ' || p_size || ' |' AS md, p_name || '/x' AS cell FROM part")
def s30_x13_markdown_table(spark, sf):
    md = tx.markdown_table(F.array(F.lit("Name"), F.lit("Size")), F.array(F.array(F.concat("p_name", F.lit("|x")), F.col("p_size").cast("string"))))
    return t(spark, sf, "part").withColumn("md", md).select("p_partkey", "md", tx.parse_markdown_table(F.col("md"))[1][0].alias("cell"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey % 50 = 7 OR l_suppkey % 50 = 7")
def j01_array_overlap(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", F.array(F.col("l_partkey") % 50, F.col("l_suppkey") % 50).alias("a"))
    return li.where(F.arrays_overlap("a", F.array(F.lit(7).cast("long")))).select("l_orderkey").distinct()


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'int:-0x80000000-0x7FFFFFFF' WHEN 1 THEN 'const std::uint16_t:0-0xFFFF' WHEN 2 THEN 'void *:NA' ELSE 'volatile long long:-0x8000000000000000-0x7FFFFFFFFFFFFFFF' END || ',' || p_brand || ':NA' AS params FROM part")
def j02_add_field(spark, sf):
    k = F.col("p_size") % 4
    first = F.when(k == 0, "int").when(k == 1, "const std::uint16_t").when(k == 2, "void *").otherwise("volatile long long")
    p = F.transform(F.array(first, F.col("p_brand")), lambda x: F.struct(x.alias("type"), keys.type_range(x).alias("range")))
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["type"], x["range"])), ",").alias("params"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS lacks_k, true AS lacks_z FROM events")
def j05_j06_validate_json(spark, sf):
    e = t(spark, sf, "events").withColumn("lack", tx.missing_keys(F.col("props"), ["k", "z"])).withColumn("m", tx.keep_keys(F.from_json("props", "map<string,bigint>"), ["k"]))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.array_contains("lack", "k").alias("lacks_k"), F.array_contains("lack", "z").alias("lacks_z"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def j03_j04_extract_json(spark, sf):
    noisy = F.concat(F.lit("Sure: "), F.regexp_replace("props", r"\}$", ",}"), F.lit(" done"))
    return t(spark, sf, "events").select("event_id", F.get_json_object(tx.extract_json(noisy), "$.k").alias("k"))


@query("""SELECT r_name AS layer, string_agg(g, ';' ORDER BY g) AS groups FROM (SELECT r_name, 'g' || n_nationkey % 2 || '=' || string_agg(n_name, ',' ORDER BY n_name) AS g FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, n_nationkey % 2) GROUP BY r_name""")
def j09_layers_map(spark, sf):
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    m = catalog.layers_map(n.select(F.col("r_name").alias("layer"), F.concat(F.lit("g"), F.col("n_nationkey") % 2).alias("grp"), F.col("n_name").alias("component")))
    return m.select("layer", F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";").alias("groups"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(regexp_extract_all(p_name || ' FOO_BAR while', '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) > 2 AND x <> 'while' AND NOT regexp_full_match(x, '[A-Z_0-9]+')))) [1] AS first FROM part")
def x07_identifiers(spark, sf):
    code = F.concat("p_name", F.lit(" call(x) FOO_BAR while"))
    return t(spark, sf, "part").select("p_partkey", F.get(tx.identifiers(code), F.lit(0)).alias("first"))


@query("SELECT p_partkey, 'my ' || split_part(p_name, ' ', 1) || CASE WHEN p_size % 2 = 0 THEN ' name' ELSE ' x ' || p_size END AS words, CASE WHEN p_size % 3 > 0 THEN 'FOO_' || p_size END AS macro, p_name AS named FROM part")
def x06_x18_x19_names(spark, sf):
    s, word = F.col("p_size"), F.substring_index("p_name", " ", 1)
    name = F.concat(F.lit("My"), F.initcap(word), F.when(s % 2 == 0, "_name_t").otherwise(F.concat(F.lit("_x_"), "p_size")))
    arg = F.when(s % 3 == 0, F.concat(F.lit("-IFOO_"), "p_size")).when(s % 3 == 1, F.concat(F.lit("-DFOO_"), "p_size")).otherwise(F.concat(F.lit("-DFOO_"), "p_size", F.lit("=1")))
    return t(spark, sf, "part").select("p_partkey", tx.struct_description(name).alias("words"), tx.defined_macro(arg).alias("macro"), keys.named_type(F.concat(F.lit("const "), "p_name", F.lit(" *&"))).alias("named"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name || chr(10) || p_brand || chr(10) || p_type WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN p_name ELSE '' END AS detail FROM part")
def x08_detail_ladder(spark, sf):
    full = F.concat_ws("\n", "p_name", "p_brand", "p_type")
    k = F.col("p_size") % 4
    return t(spark, sf, "part").select("p_partkey", F.array_join(F.slice(F.split(full, "\n"), F.lit(1), 3 - k), "\n").alias("detail"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'p_2.png,p_10.png,p_' || (p_size + 100) || '.png' WHEN 1 THEN 'p.png,p_' || p_size || '.png' ELSE 'p.png' END AS parts FROM part""")
def x14_image_parts(spark, sf):
    k, n = F.col("p_size") % 3, F.col("p_size").cast("string")
    names = F.when(k == 0, F.array(F.concat(F.lit("p_"), (F.col("p_size") + 100).cast("string"), F.lit(".png")), F.lit("p_10.png"), F.lit("p_2.png"))).when(k == 1, F.array(F.concat(F.lit("p_"), n, F.lit(".png")), F.lit("p.png"))).otherwise(F.array(F.lit("p.png")))
    return t(spark, sf, "part").select("p_partkey", F.array_join(catalog.ordered_parts(names), ",").alias("parts"))


@query("""SELECT p_partkey, least(CASE WHEN p_size % 3 = 0 THEN p_size * 1000 ELSE 8192 END, 32000) AS max_tokens, CASE p_size % 4 WHEN 0 THEN '--layer ' || p_brand WHEN 1 THEN '--group ' || p_brand WHEN 2 THEN '--component ' || p_brand ELSE '--all' END AS scope FROM part""")
def x22_x24_resolve_settings(spark, sf):
    s, k = F.col("p_size"), F.col("p_size") % 4
    explicit = F.when(s % 3 == 0, s * 1000).when(s % 3 == 1, -s)
    kind = F.when(k == 0, "layer").when(k == 1, "group").when(k == 2, "component").otherwise("project")
    return t(spark, sf, "part").select("p_partkey", catalog.token_window(explicit, 8192, 32000).alias("max_tokens"), F.array_join(catalog.scope_flags(kind, F.col("p_brand")), " ").alias("scope"))


# ---- sources and sinks ----------------------------------------------------------------------------------------------
@query("SELECT 'p' || p_partkey || '/x' || p_size || '/f.cpp' AS id, 'p' || p_partkey || '/x' || p_size AS parent, false AS is_folder FROM part UNION SELECT 'p' || p_partkey || '/x' || p_size, 'p' || p_partkey, true FROM part UNION SELECT 'p' || p_partkey, NULL, true FROM part")
def a21_g14_path_tree(spark, sf):
    p = t(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/x"), "p_size", F.lit("/f.cpp")).alias("path"))
    return readers.path_tree(p).select("id", "parent", "is_folder")


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'D' ELSE 'M' END AS status, 'f' || o_orderkey AS path FROM orders UNION ALL SELECT 'A', 'g' || o_orderkey FROM orders WHERE o_orderkey % 4 = 0")
def a20_git_status(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("R100\tf"), k, F.lit("\tg"), k)).otherwise(F.concat(F.lit("M\tf"), k))
    return readers.parse_status(t(spark, sf, "orders").select(line.alias("value")))


@query("SELECT p_brand AS abbrev, arg_max(p_name, p_partkey) AS meaning FROM part GROUP BY p_brand")
def a17_abbreviations(spark, sf):
    line = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, ": ").otherwise(" = "), "p_name", F.lit("  # note"))
    return readers.abbreviations(t(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.replace(line, F.lit("Brand#"), F.lit("Brand_")).alias("value"))).select(F.replace("abbrev", F.lit("Brand_"), F.lit("Brand#")).alias("abbrev"), "meaning")


@query("SELECT p_partkey AS ord, 'N' || (p_partkey - p_partkey % 4) AS name, p_brand AS entry FROM part")
def a14_data_dictionary(spark, sf):
    k = F.col("p_partkey")
    rows = t(spark, sf, "part").select(F.when(k % 4 == 0, F.concat(F.lit("N"), k)).otherwise(" ").alias("name"), F.lit("enum").alias("kind"), F.col("p_brand").alias("entry"), F.lit("").alias("range"), F.lit("").alias("comment"), k.alias("ord"))
    return readers.data_dictionary(rows).select("ord", "name", "entry")


@query("SELECT 'd' || p_partkey AS path, CAST(2 AS INTEGER) AS line, 'M' || p_size AS name, '1 + ' || p_size AS value FROM part")
def a04_scan_defines(spark, sf):
    text = F.concat(F.lit("// x\n# define M"), "p_size", F.lit(" 1 + \\\n   "), "p_size", F.lit("\nint a;"))
    return readers.defines(t(spark, sf, "part").select(F.concat(F.lit("d"), "p_partkey").alias("path"), text.alias("text")))


@query("SELECT DISTINCT 't' || l_orderkey AS tu, 'i' || l_partkey AS inc FROM lineitem WHERE l_linenumber < 3")
def a11_include_closure(spark, sf):
    li = t(spark, sf, "lineitem").where("l_linenumber < 3").select(F.concat(F.lit("/repo/t"), "l_orderkey").alias("tu"), F.concat(F.lit("/repo/i"), "l_partkey").alias("path"))
    outside = t(spark, sf, "lineitem").select(F.concat(F.lit("/repo/t"), "l_orderkey").alias("tu"), F.concat(F.lit("/usr/i"), "l_partkey").alias("path"))
    return readers.include_closure(li.unionByName(outside), "/repo")


@query("SELECT 'k' || o_orderkey AS key, 'unknown' AS name, '' AS file_path FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'k' || o_orderkey, 'f', '' FROM orders WHERE o_orderkey % 2 = 1")
def a23_register_functions(spark, sf):
    k = F.concat(F.lit("k"), "o_orderkey")
    f = t(spark, sf, "orders").select(k.alias("key"), F.when(F.col("o_orderkey") % 2 == 1, "ns::f").otherwise("unknown").alias("qualified_name"))
    return readers.register_functions(f)


@query("SELECT o_orderkey, 'complete' AS status FROM orders WHERE o_orderkey % 3 <> 0")
def a27_version_list(spark, sf):
    v = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.md5("o_orderstatus")).otherwise("").alias("commit"), F.col("o_orderkey").alias("ord"))
    return readers.list_versions(v).select("o_orderkey", "status")


@query("SELECT o_orderpriority AS \"group\", count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def b10_a24_versioned_tables(spark, sf):
    """Two versions written side by side; a filter on the version reads one folder."""
    folder = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("group"), "o_orderstatus")
    sinks.write_version(o.where("o_orderstatus = 'O'"), folder, "o")
    sinks.write_version(o.where("o_orderstatus <> 'O'"), folder, "rest")
    return readers.version_tables(spark, folder).where("version_id = 'o'").groupBy("group").agg(F.count("*").alias("n"))


@query("SELECT n_regionkey AS grp, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def b06_grouped_json(spark, sf):
    folder = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    sinks.grouped_json(t(spark, sf, "nation").select(F.col("n_regionkey").alias("grp"), "n_name"), "grp", folder)
    back = spark.read.schema("grp int, rows array<struct<n_name:string>>").json(folder)
    return back.select("grp", F.array_join(F.transform("rows", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT md5(p_name) AS hash, upper(p_name) AS result, count(*) AS n FROM part GROUP BY p_name")
def b13_render_cache(spark, sf):
    store = f"{shared_dir(spark)}/render-{uuid.uuid4().hex}"
    w = t(spark, sf, "part").select(F.md5("p_name").alias("hash"), F.col("p_name").alias("payload"))
    render = lambda df: df.select("hash", F.upper("payload").alias("result"))
    sinks.cached_compute(w.limit(100), store, render)
    return sinks.cached_compute(w, store, render).groupBy("hash", "result").agg(F.count("*").alias("n"))


# ---- sequential -----------------------------------------------------------------------------------------------------
@query("""WITH RECURSIVE r AS (SELECT conv_id AS grp, turn AS ord, len(string_split(text, chr(10))) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT grp, k, ord, 0 AS seg, 1 AS c, n AS lines FROM r WHERE k = 1 UNION ALL SELECT r.grp, r.k, r.ord, w.seg + CASE WHEN w.c >= 5 OR w.lines + r.n > 10 THEN 1 ELSE 0 END, CASE WHEN w.c >= 5 OR w.lines + r.n > 10 THEN 1 ELSE w.c + 1 END,
  CASE WHEN w.c >= 5 OR w.lines + r.n > 10 THEN r.n ELSE w.lines + r.n END FROM w JOIN r ON r.grp = w.grp AND r.k = w.k + 1) SELECT grp, CAST(seg AS BIGINT) AS segment, min(ord) AS first_ord, count(*) AS n FROM w GROUP BY grp, seg""")
def f08_segments(spark, sf):
    rows = t(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), F.size(F.split("text", "\n")).alias("n_lines"))
    return sequential.segment_statements(rows)


@query("""WITH RECURSIVE r AS (SELECT conv_id AS grp, turn AS ord, turn % 3 > 1 AS merge_point, turn % 4 = 0 AS branch, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
w AS (SELECT grp, k, ord, branch, 0 AS b, 1 AS c FROM r WHERE k = 1 UNION ALL SELECT r.grp, r.k, r.ord, r.branch, w.b + CASE WHEN w.branch OR r.merge_point OR w.c >= 8 THEN 1 ELSE 0 END, CASE WHEN w.branch OR r.merge_point OR w.c >= 8 THEN 1 ELSE w.c + 1 END FROM w JOIN r ON r.grp = w.grp AND r.k = w.k + 1),
z AS (SELECT grp, b, count(*) AS c FROM w GROUP BY grp, b),
m AS (SELECT grp, b, c, 0 AS batch FROM z WHERE b = 0 UNION ALL SELECT z.grp, z.b, CASE WHEN z.c = 1 AND m.c < 8 THEN m.c + 1 ELSE z.c END, m.batch + CASE WHEN z.c = 1 AND m.c < 8 THEN 0 ELSE 1 END FROM m JOIN z ON z.grp = m.grp AND z.b = m.b + 1)
SELECT w.grp, w.ord, CAST(m.batch AS BIGINT) AS batch FROM w JOIN m ON m.grp = w.grp AND m.b = w.b""")
def f09_region_batches(spark, sf):
    rows = t(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("ord"), (F.col("turn") % 3).alias("in_degree"), (F.col("turn") % 4 == 0).alias("is_branch"))
    return sequential.region_batches(rows)


@query("""WITH i AS (SELECT conv_id AS grp, turn AS id, turn % 3 AS priority, [length(text), length(text) // 2, length(text) // 4, length(text) // 8, length(text) // 16] AS c FROM conversations),
total AS (SELECT grp, sum(c[1]) AS total FROM i GROUP BY grp),
steps AS (SELECT grp, id, priority, lvl, CASE WHEN lvl < 5 THEN c[lvl] - c[lvl + 1] ELSE c[5] END AS saved FROM i, (VALUES (1), (2), (3), (4), (5)) x(lvl)),
run AS (SELECT *, coalesce(sum(saved) OVER (PARTITION BY grp ORDER BY lvl, priority, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM steps)
SELECT i.grp, i.id, CAST(coalesce((SELECT CASE WHEN max(lvl) = 5 THEN -1 ELSE max(lvl) END FROM run JOIN total USING (grp) WHERE run.grp = i.grp AND run.id = i.id AND total - before > 500), 0) AS BIGINT) AS level FROM i""")
def f12_fit_ladder(spark, sf):
    n = F.char_length("text")
    rows = t(spark, sf, "conversations").select(F.col("conv_id").alias("grp"), F.col("turn").alias("id"), (F.col("turn") % 3).alias("priority"), n.alias("c0"), (n / 2).cast("int").alias("c1"), (n / 4).cast("int").alias("c2"), (n / 8).cast("int").alias("c3"), (n / 16).cast("int").alias("c4"))
    return sequential.fit_ladder(rows, 500)


@query("""WITH y AS (SELECT user_id AS grp, event_id % 1000 AS y FROM events), k AS (SELECT DISTINCT grp, ideal FROM y, (VALUES (250), (500), (750)) x(ideal))
SELECT k.grp, CAST(coalesce(arg_min(y.y, abs(y.y - ideal) * 1000 + y.y), ideal) AS BIGINT) AS cut FROM k LEFT JOIN y ON y.grp = k.grp AND abs(y.y - ideal) <= 37.5 GROUP BY k.grp, ideal""")
def f13_snapped_cuts(spark, sf):
    rows = t(spark, sf, "events").select(F.col("user_id").alias("grp"), (F.col("event_id") % 1000).alias("y"), F.lit(1000).alias("height"))
    return sequential.snapped_cuts(rows, 4)


def _groups(spark, sf):
    return calls(spark, sf).select(F.expr("caller div 100").alias("grp"), F.col("caller").alias("source"), F.col("callee").alias("target"))


@query()
def g09_breadth_first(spark, sf):
    return sequential.breadth_first_order(_groups(spark, sf))


@query()
def g10_post_order(spark, sf):
    return sequential.reverse_post_order(_groups(spark, sf))


@query()
def i06_merge_ids(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("a"))
    s = lambda cond: F.transform(F.filter("a", cond), lambda x: x.cast("string"))
    return c.select("conv_id", tx.merge_ids(s(lambda x: x % 3 != 0), s(lambda x: x % 4 != 1)).alias("ids"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'x is greater than or equal to ' || p_size || ' OR y equals null' WHEN 1 THEN 'link' || p_size || ' is not fully open' WHEN 2 THEN 'hass room' ELSE 'a.b' || p_size || ' does not equal C AND d' END AS words,
  CASE p_size % 4 WHEN 0 THEN 'x #62;= ' || p_size || ' #124;#124; ns::y == nullptr' WHEN 1 THEN '!link' || p_size || '-#62;isFullyOpen#40;#41;' WHEN 2 THEN 'hasRoom#40;' || p_size || '#41;' ELSE 'a.b' || p_size || '!=C #38;#38; d#59;' END AS escaped,
  'word' || p_size || repeat(' abcdefghi', 3) || '<br/>' || repeat('abcdefghi ', 3) || 'abcdefghi<br/>end' AS wrapped FROM part""")
def s14_s16_s17_conditions(spark, sf):
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    c = F.when(k == 0, F.concat(F.lit("x >= "), n, F.lit(" || ns::y == nullptr"))).when(k == 1, F.concat(F.lit("!link"), n, F.lit("->isFullyOpen()"))).when(k == 2, F.concat(F.lit("hasRoom("), n, F.lit(")"))).otherwise(F.concat(F.lit("a.b"), n, F.lit("!=C && d;")))
    long = F.concat(F.lit("word"), n, F.repeat(F.lit(" abcdefghi"), 7), F.lit("<br/>end"))
    return t(spark, sf, "part").select("p_partkey", tx.readable_condition(c).alias("words"), tx.escape_label(c).alias("escaped"), tx.wrap_label(long).alias("wrapped"))


@query("""WITH p AS (SELECT *, p_size % 3 AS k FROM part)
SELECT p_partkey, 'a.h' || CASE WHEN k = 0 THEN ',b.h' WHEN p_size % 2 = 0 THEN ',c.h' ELSE ',d.h' END AS includes, CASE k WHEN 0 THEN 'private' WHEN 1 THEN 'public' ELSE 'default' END AS visibility,
  'does ' || p_name AS comment, CASE WHEN p_size % 2 = 0 THEN '13:3,13:14' ELSE '13:3' END AS asserts, 'int f() {' || chr(10) || '  assert(x);' || CASE WHEN p_size % 2 = 0 THEN ' ASSERT (y);' ELSE '' END || chr(10) || '}' AS snippet,
  'size ' || p_size AS inline FROM p""")
def s12_s13_s19_a12_x05_lexers(spark, sf):
    s = F.col("p_size")
    head = F.lit('#include "a.h"\n#ifdef X\n#include "b.h"\n#elif defined(Y)\n#include "c.h"\n#else\n#include "d.h"\n#endif\n')
    code = F.concat(head, F.when(s % 3 == 0, "PRIVATE unit").when(s % 3 == 1, "PUBLIC").otherwise("int PUBLIC"), F.lit("\n\n// does "), "p_name", F.lit("\nint f() {\n  assert(x);"), F.when(s % 2 == 0, " ASSERT (y);").otherwise(""), F.lit("\n}\nint g();\n"))
    macros = F.filter(F.array(F.when(s % 3 == 0, "X"), F.when(s % 2 == 0, "Y")), lambda m: m.isNotNull())
    before = F.substring_index("code", "\nint f", 1)
    return t(spark, sf, "part").withColumn("code", code).select(
        "p_partkey", F.array_join(tx.active_includes("code", macros), ",").alias("includes"), tx.visibility_before(before).alias("visibility"), tx.preceding_comment(before).alias("comment"),
        F.array_join(F.transform(tx.assert_calls(F.col("code")), lambda x: F.concat_ws(":", x["line"], x["col"])), ",").alias("asserts"), tx.declaration_snippet("code", F.lit(12)).alias("snippet"),
        tx.comment_text(F.concat(F.lit("int a; //< size "), "p_size")).alias("inline"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(['get', 'count'], CASE WHEN length(p_size::VARCHAR) > 2 THEN [p_size::VARCHAR] ELSE [] END, ['const', 'brand_t'],
  CASE WHEN length(split_part(p_name, ' ', 1)) > 2 THEN [split_part(p_name, ' ', 1)] ELSE [] END))), ',') AS words FROM part""")
def s20_keywords(spark, sf):
    first = F.substring_index("p_name", " ", 1)
    return t(spark, sf, "part").select("p_partkey", F.array_join(tx.keywords(F.concat(F.lit("A::getCount_"), "p_size"), F.lit("const Brand_t &"), F.array(F.concat(F.lit("B::"), first))), ",").alias("words"))


@query("""WITH p AS (SELECT 's' || p_size % 7 AS top, CASE WHEN p_partkey % 3 = 0 THEN 'Sub' || p_size || '/' ELSE '' END AS sub, CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'f' END || p_partkey || '.cpp' AS file FROM part),
x AS (SELECT top AS id, NULL AS parent, top AS name, true AS is_folder FROM p UNION SELECT top || '/' || rtrim(sub, '/'), top, rtrim(sub, '/'), true FROM p WHERE sub <> '' UNION SELECT top || '/' || sub || file, rtrim(top || '/' || sub, '/'), file, false FROM p)
SELECT id, parent, is_folder, CAST(row_number() OVER (PARTITION BY parent ORDER BY is_folder DESC, lower(name), name, id) AS INTEGER) AS place FROM x""")
def a21_g14_path_listing(spark, sf):
    """Files and folders of a tree in the order of a listing: folders first."""
    k = F.col("p_partkey")
    path = F.concat(F.lit("s"), F.col("p_size") % 7, F.lit("/"), F.when(k % 3 == 0, F.concat(F.lit("Sub"), "p_size", F.lit("/"))).otherwise(""), F.when(k % 2 == 0, "F").otherwise("f"), k, F.lit(".cpp"))
    return readers.path_listing(readers.path_tree(t(spark, sf, "part").select(path.alias("path")))).select("id", "parent", "is_folder", "place")

"""Queries over sources, sinks and fact ingestion: each writes to the shared folder and reads back, or folds raw sightings."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from factloom.functions.keys import or_default
from factloom.operators import catalog, incremental as inc
from factloom.plans.inputs import query, t
from factloom.scratch import shared_dir
from factloom.sources import facts, readers, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT l_partkey AS key, arg_min(l_orderkey, (CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) * 1000000000000 + l_orderkey * 1000 + l_linenumber) AS l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 AS declaration_only FROM lineitem GROUP BY l_partkey")
def a05_a06_definitions(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_returnflag") == "R").alias("is_definition"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("ord"), "l_orderkey")
    return facts.definitions(s).select("key", "l_orderkey", "declaration_only")


@query("SELECT p_brand AS name, arg_min(p_partkey, (CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END) * 1000000000 + p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def a07_types(spark, sf):
    s = t(spark, sf, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 5 == 0).alias("complete"), F.col("p_partkey").alias("ord"), "p_partkey")
    return facts.types(s).select("name", "p_partkey")


@query("SELECT DISTINCT l_orderkey AS caller, l_partkey AS callee FROM lineitem WHERE l_linenumber <> 3")
def a08_call_edges(spark, sf):
    s = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("caller"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("callee"))
    return facts.call_edges(s)


@query("SELECT l_partkey AS fid, l_suppkey AS gid, bool_or(l_returnflag <> 'R') AS is_read, bool_or(l_returnflag <> 'N') AS is_write FROM lineitem GROUP BY 1, 2")
def a09_global_access(spark, sf):
    op = F.when(F.col("l_returnflag") == "N", "load").when(F.col("l_returnflag") == "R", "store").otherwise("compound")
    return facts.global_access(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("fid"), F.col("l_suppkey").alias("gid"), op.alias("op")))


@query("SELECT DISTINCT p_partkey AS fid, unnest(string_split(p_name, ' ')) AS token FROM part")
def a10_token_use(spark, sf):
    return facts.token_use(t(spark, sf, "part").select(F.col("p_partkey").alias("fid"), F.concat("p_name", F.lit(" 12 + 3;")).alias("text")))


@query("SELECT * FROM (SELECT o_custkey AS fkey, o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target FROM orders) WHERE target IS NOT NULL")
def g12_flow_edges(spark, sf):
    return facts.flow_edges(t(spark, sf, "orders").select(F.col("o_custkey").alias("fkey"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("node_id")))


@query("SELECT 'm' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.hpp' ELSE '.cpp' END AS file, 'M' || n_nationkey AS name, CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def a02_define_scan(spark, sf):
    """Source and header files written to a folder, scanned by suffix, and their macros read."""
    folder = _folder(spark, "tree")
    n = t(spark, sf, "nation").select(F.concat(F.lit("m"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ".hpp").otherwise(".cpp")).alias("file"), F.concat(F.lit("#define M"), "n_nationkey", F.lit(" "), "n_regionkey").alias("value"))
    sinks.write_lines(n.select(F.concat_ws("\x1f", "file", "value").alias("value")), folder)
    files = readers.source_files(spark, folder, "*.{txt,hpp,cpp}").select(F.explode(F.split("text", "\n")).alias("row")).where("row <> ''")
    parts = files.select(F.substring_index("row", "\x1f", 1).alias("path"), F.substring_index("row", "\x1f", -1).alias("text"))
    return readers.defines(parts.where(F.col("path").rlike(r"\.(cpp|cc|cxx|h|hpp)$"))).select(F.col("path").alias("file"), "name", "value")


@query("SELECT '-DM' || n_nationkey || CASE WHEN n_regionkey = 1 THEN '' ELSE '=' || n_regionkey END AS arg FROM nation WHERE n_regionkey <> 0")
def a13_macro_csv(spark, sf):
    folder = _folder(spark, "csv")
    v = F.when(F.col("n_regionkey") == 0, "ne").when(F.col("n_regionkey") == 1, "").otherwise(F.col("n_regionkey").cast("string"))
    t(spark, sf, "nation").select(F.concat(F.lit("M"), "n_nationkey").alias("Name"), v.alias("Value")).coalesce(1).write.option("header", True).csv(folder)
    return readers.macro_args(spark, folder)


@query("SELECT 'layers' AS name, 2 AS n, 'x' AS kept, 'local' AS mode")
def a16_j08_config(spark, sf):
    """A configuration with comments and trailing commas, overridden by top-level values, and a level-by-level merge."""
    shallow = readers.load_config(['{"layers": {"a": 1,}, // first\n "mode": "base", "x": {"y": "x"}}', '{"layers": {"b": 1, "c": 2}, /* second */ "mode": "local"}'])
    deep = facts.deep_merge({"x": {"y": "x"}}, {"x": {"z": 1}})
    return spark.createDataFrame([("layers", len(shallow["layers"]), deep["x"]["y"], shallow["mode"])], "name string, n int, kept string, mode string")


@query("""SELECT n_name AS input, r_name AS output, 2 AS n_tags FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 2""")
def a18_few_shot(spark, sf):
    """Example files written to a folder and read by the reader; one without an output is left out."""
    folder = _folder(spark, "shots")
    n = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = n.select(F.array("r_name", "n_name").alias("tags"), F.col("n_name").alias("input"), F.when(F.col("n_regionkey") != 2, F.col("r_name")).alias("output"))
    rows.repartition(5).write.json(folder)
    return readers.few_shot(spark, folder, multi_line=False).select("input", "output", F.size("tags").alias("n_tags"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 100, 'seed'")
def a22_b02_collection(spark, sf):
    """A collection loaded, or seeded where it is missing, changed and saved."""
    from factloom.extensions import Repository

    repo = Repository(spark, _folder(spark, "collection"), "id int, name string")
    if repo.all().isEmpty():
        repo.put(spark.createDataFrame([(100, "seed")], "id int, name string"))
    repo.put(t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return repo.all()


@query("SELECT 'k' || n_nationkey AS key, n_name AS summary, '' AS note FROM nation")
def a26_knowledge_json(spark, sf):
    """A keyed JSON object {key: record} written as one line and read as rows."""
    folder = _folder(spark, "knowledge")
    n = t(spark, sf, "nation").select(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.struct(F.col("n_name").alias("summary")).alias("record"))
    whole = n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "record")))).alias("value"))
    sinks.write_lines(whole, folder)
    rows = spark.read.text(folder).select(F.explode(F.from_json("value", "map<string,struct<summary:string,note:string>>")).alias("key", "record"))
    return rows.select("key", "record.summary", or_default(F.col("record.note"), "").alias("note"))


@query("SELECT p_brand AS component, count(*) AS n FROM part WHERE p_brand = 'Brand#1' GROUP BY 1")
def b03_partitioned_sink(spark, sf):
    """Rows stored by component; reading one component touches one folder."""
    folder = _folder(spark, "interface")
    sinks.write_table(t(spark, sf, "part").select(F.col("p_brand").alias("component"), "p_partkey"), folder, ["component"])
    return spark.read.parquet(folder).where("component = 'Brand#1'").groupBy("component").agg(F.count("*").alias("n"))


@query("""SELECT p_brand AS component, p_partkey AS fid, CASE WHEN p_size % 2 = 0 THEN 'Count ' || p_size ELSE 'Run me input' END AS input_name, CASE WHEN p_size % 2 = 0 THEN 'Count ' || p_size ELSE 'Run me result' END AS output_name FROM part""")
def b05_behaviour_rows(spark, sf):
    """Behaviour rows written as JSON by component and read back."""
    from factloom.functions.keys import behaviour_names

    folder, s, none = _folder(spark, "behaviour"), F.col("p_size"), F.lit(None).cast("string")
    names = behaviour_names(none, F.when(s % 2 == 0, F.concat(F.lit("g_count_"), s)), none, F.lit("void"), none, F.lit("A::run_me"))
    rows = t(spark, sf, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("fid"), names.alias("b")).select("component", "fid", "b.*")
    sinks.write_table(rows, folder, ["component"], fmt="json")
    return spark.read.schema("fid long, input_name string, output_name string, component string").json(folder)


@query("SELECT 'total ' || count(*) AS value FROM orders UNION ALL SELECT 'open ' || count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def b11_report_lines(spark, sf):
    folder = _folder(spark, "report")
    o = t(spark, sf, "orders").agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    lines = o.select(F.explode(F.array(F.concat(F.lit("total "), "a"), F.concat(F.lit("open "), "b"))).alias("value"))
    sinks.write_lines(lines, folder)
    return spark.read.text(folder)


@query("SELECT v AS version_id, count(*) AS n FROM part, (VALUES ('v1'), ('v2')) x(v) GROUP BY 1")
def b09_b15_version_capture(spark, sf):
    """Artefacts captured under a version, and a snapshot copied to another."""
    folder = _folder(spark, "artefacts")
    sinks.write_version(t(spark, sf, "part").select("p_partkey"), folder, "v1")
    sinks.copy_version(spark, folder, "v1", "v2")
    return spark.read.parquet(folder).groupBy("version_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, upper(p_type) AS result FROM part")
def l06_l07_memo(spark, sf):
    """A result memo by the whole of what determines it: each distinct input is computed once."""
    store = _folder(spark, "memo")
    p = t(spark, sf, "part").select("p_partkey", inc.token_hash(F.split("p_type", " ")).alias("hash"), F.col("p_type").alias("payload"))
    memo = sinks.cached_compute(p.select("hash", "payload"), store, lambda d: d.select("hash", F.upper("payload").alias("result"))).select("hash", "result").distinct()
    return p.join(memo, "hash").select("p_partkey", "result")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'tools/' || p_size || '.py' ELSE 'default.py' END AS script, p_size % 3 = 0 AS overridden FROM part""")
def u05_script_override(spark, sf):
    k = F.col("p_size") % 3
    config = F.when(k == 0, F.concat(F.lit('{"script": "tools/'), "p_size", F.lit('.py"}'))).when(k == 1, '{"script": " "}')
    return t(spark, sf, "part").select("p_partkey", catalog.script_of(config, "default.py").alias("s")).select("p_partkey", "s.*")
"""Stand-in fact tables derived from the benchmark tables with integer arithmetic, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that DuckDB runs for the same rows."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders: key, hash."""
    o = t(spark, sf, "orders")
    h = lambda s: F.md5(F.concat_ws("|", s, "o_orderpriority"))
    base = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("key"), h("o_orderstatus").alias("hash"))
    target = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("key"), h(F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))).alias("hash"))
    return base, target


SNAP = """base AS (SELECT o_orderkey AS key, md5(o_orderstatus || '|' || o_orderpriority) AS hash FROM orders WHERE o_orderkey % 11 <> 0),
target AS (SELECT o_orderkey AS key, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END || '|' || o_orderpriority) AS hash FROM orders WHERE o_orderkey % 13 <> 0),
status AS (SELECT coalesce(b.key, t.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN t.key IS NULL THEN 'deleted' WHEN b.hash = t.hash THEN 'unchanged' ELSE 'changed' END AS status
  FROM base b FULL JOIN target t ON b.key = t.key)"""


def calls(spark, sf) -> DataFrame:
    """A call graph over the parts, with a cycle: caller, callee."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("p"))
    a = p.where("p % 5 <> 0").selectExpr("p AS caller", "p div 2 AS callee")
    b = p.where("p % 10 = 0").selectExpr("p AS caller", "(p div 3) * 3 + (p + 1) % 3 AS callee")
    return a.unionByName(b).distinct()


CALLS = """calls AS (SELECT p_partkey AS caller, p_partkey // 2 AS callee FROM part WHERE p_partkey % 5 <> 0
  UNION SELECT p_partkey, (p_partkey // 3) * 3 + (p_partkey + 1) % 3 FROM part WHERE p_partkey % 10 = 0)"""
ACYCLIC = "calls AS (SELECT p_partkey AS caller, p_partkey // 2 AS callee FROM part WHERE p_partkey % 5 <> 0)"


def functions(spark, sf) -> DataFrame:
    """fid, file (ten parts a file), line, unit, component, private by kind of part."""
    p = t(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("fid"), F.expr("concat('f', p_partkey div 10)").alias("file"), F.expr("p_partkey % 10").alias("line"),
        F.expr("concat('u', p_partkey % 97)").alias("unit"), F.col("p_brand").alias("component"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
    )


FUNCTIONS = "functions AS (SELECT p_partkey AS fid, 'f' || (p_partkey // 10) AS file, p_partkey % 10 AS line, 'u' || (p_partkey % 97) AS unit, p_brand AS component, p_size AS size, p_name AS name, p_type AS type FROM part)"


def access(spark, sf) -> DataFrame:
    """Reads and writes of globals (suppliers) by functions (parts): fid, gid, mode."""
    li = t(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("fid"), F.col("l_suppkey").alias("gid"), F.when(F.col("l_returnflag") == "R", "w").otherwise("r").alias("mode")).distinct()


ACCESS = "access AS (SELECT DISTINCT l_partkey AS fid, l_suppkey AS gid, CASE WHEN l_returnflag = 'R' THEN 'w' ELSE 'r' END AS mode FROM lineitem)"


def pairs(spark, sf) -> DataFrame:
    return t(spark, sf, "part").where("p_partkey % 7 in (1, 2) and p_partkey % 3 <> 0").selectExpr("p_partkey AS ov", "p_partkey - p_partkey % 7 AS base")


PAIRS = "pairs AS (SELECT p_partkey AS ov, p_partkey - p_partkey % 7 AS base FROM part WHERE p_partkey % 7 IN (1, 2) AND p_partkey % 3 <> 0)"


def versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two versions of the functions, by file: fid, file, hash."""
    p = functions(spark, sf)
    base = p.where("fid % 17 <> 0").select("fid", "file", F.md5(F.concat_ws("|", "name", "size")).alias("hash"))
    fresh = p.where("fid % 19 <> 0").select("fid", "file", F.md5(F.concat_ws("|", "name", F.col("size") + F.when(F.col("fid") % 3 == 0, 1).otherwise(0))).alias("hash"))
    return base, fresh


VERSIONS = """vbase AS (SELECT fid, file, md5(name || '|' || size) AS hash FROM functions WHERE fid % 17 <> 0),
vfresh AS (SELECT fid, file, md5(name || '|' || (size + CASE WHEN fid % 3 = 0 THEN 1 ELSE 0 END)) AS hash FROM functions WHERE fid % 19 <> 0),
vdrop AS (SELECT DISTINCT file FROM functions WHERE size = 7)"""


def drop_files(spark, sf) -> DataFrame:
    return functions(spark, sf).where("size = 7").select("file").distinct()

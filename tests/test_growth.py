"""What must not grow faster than the tables: plans without large broadcasts, joins without products of copies."""

import datetime

from oracle import SF, connect
from pyspark.sql import DataFrameWriter, Row, functions as F

from factloom.operators import catalog, derive, documents, graph, incremental, service
from factloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_flow_diagram_broadcasts_no_nodes(spark):
    n = spark.range(40).select((F.col("id") % 4).alias("grp"), F.col("id").alias("node"), F.lit("ACTION").alias("type"), F.lit("x").alias("label"))
    e = n.select("grp", F.col("node").alias("source"), F.col("node").alias("target"), F.lit(None).cast("string").alias("label"), F.col("node").alias("ord"))
    out = documents.flow_diagram(n, e)
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == 4


def test_known_tokens_broadcasts_no_words(spark):
    code = spark.range(9).select("id", F.lit("Color c = MAX_1; p->len").alias("code"))
    one = lambda data, schema: spark.createDataFrame(data, schema)
    out = documents.known_tokens(code, one([("Color", "RED", "e")], "name string, value string, said string"), one([("MAX_1", "m")], "name string, said string"),
                                 one([("speed_t", "t")], "name string, said string"), one([("A", 1, "len", "A.len")], "struct_name string, ord int, member string, said string"))
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == 27


def test_link_records_compares_copies_once(spark):
    same = spark.range(3000)
    wanted = same.select(F.col("id").alias("wid"), F.lit("n::f").alias("name"), F.lit(5).alias("line"), F.lit(9).alias("end_line"))
    cands = same.select((F.col("id") + 7).alias("cid"), F.lit("n::f").alias("name"), F.lit(6).alias("line"), F.lit(9).alias("end_line"), (F.col("id") >= 10).alias("is_def"))
    out = derive.link_records(wanted, cands)
    out.collect()
    assert rows(out.agg(F.count("*"), F.min("cid"), F.max("cid"), F.min("score"), F.max("score"))) == [(3000, 17, 17, 119, 119)]
    assert "min(cid" in plan(out)  # candidates alike are one before they are joined


def test_link_records_nulls_and_ties(spark):
    w = spark.createDataFrame([(1, "f", 5, None), (2, "a::f", 5, 9), (2, "a::f", 8, 9), (3, "g", 1, 1)], "wid int, name string, line int, end_line int")
    c = spark.createDataFrame([(9, "a::f", 6, 9, False), (4, "a::f", 4, 9, None), (5, "b::f", 8, 9, True)], "cid int, name string, line int, end_line int, is_def boolean")
    assert rows(derive.link_records(w, c).where("wid > 1")) == [(2, 4, 99)]


def test_unit_entries_once_without_a_distinct_of_pairs(spark):
    u = spark.createDataFrame([Row(unit=1, stem="a", component="c"), Row(unit=1, stem="b", component="c"), Row(unit=2, stem=None, component="c")])
    own = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "y")], "stem string, entry string")
    shared = spark.createDataFrame([("c", "x"), ("c", "z")], "component string, entry string")
    out = catalog.unit_entries(u, own, shared)
    assert rows(out) == [(1, "x"), (1, "y"), (1, "z"), (2, "x"), (2, "z")]
    assert "Union" in plan(out).split("HashAggregate")[0]  # the pairs of entries on one list go into no aggregate


def test_throttle_counts_parts_of_a_second(spark):
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 900000)
    d = spark.createDataFrame([(1, at, at + datetime.timedelta(seconds=59, microseconds=200000)), (2, at, at + datetime.timedelta(seconds=60)), (3, None, at)], "id int, last timestamp, now timestamp")
    assert rows(d.select("id", service.throttle(F.col("last"), F.col("now"), 60))) == [(1, False), (2, True), (3, True)]


def test_nearest_ancestor_sql_with_large_ids():
    con = connect()
    con.execute("CREATE OR REPLACE VIEW events AS SELECT * FROM (VALUES (1, 50.01, 7000000, 'x'), (1, 50.03, 5, 'x')) AS v(user_id, value, event_id, event_type)")
    assert con.execute(registry.oracle_sql()["d37_g17_nearest_ancestor"]).fetchall() == [(1, 7000000)]


def test_prefix_match_lengths(spark):
    c = spark.createDataFrame([("1", "abcdef", "v1", 1), ("2", "abcxyz", "v2", 2), ("3", "abcdeg", None, 3), ("4", "", "t", 4), ("5", None, "u", 5)], "id string, sha string, tag string, ord int")
    refs = spark.createDataFrame([(r,) for r in ("a", "abc", "abcd", "abcde", "abcdeg", "abcx", "abcdefg", "v2", "3", "", "u", "zz")], "ref string")
    want = {"a": "1", "abc": "1", "abcd": "1", "abcde": "1", "abcdeg": "3", "abcx": "2", "abcdefg": None, "v2": "2", "3": "3", "": "4", "u": "5", "zz": None}
    out = derive.prefix_match(refs, c)
    assert {r.ref: r.id for r in out.collect()} == want
    assert "collect_set(char_length(ref" in plan(out)  # only beginnings of lengths that occur are compared, each once


def test_line_ranges_keep_copies(spark):
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "B"), (1, 9, "z")], "doc int, pos int, text string")
    r = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 2, 9), (2, 0, 1, 1)], "doc int, rid int, line int, end_line int")
    out = derive.line_ranges(lines, r)
    assert rows(out) == [(1, 0, "a\nB\nb"), (1, 1, "B\nb\nz")]
    # the texts are not on the side that is multiplied by levels
    assert not any("text" in line for line in plan(out).split("\n") if "Generate explode(_levels" in line)


def test_loops_broadcast_small_tables_only(spark, monkeypatch):
    seen, write = set(), DataFrameWriter.parquet

    def parquet(self, *a, **k):
        seen.add(tuple(spark.conf.get(name, None) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")))
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    f = spark.range(50).select(F.col("id").alias("fid"))
    calls = spark.range(1, 50).select(F.col("id").alias("caller"), (F.col("id") - 1).alias("callee"))
    status = spark.range(40, 41).select(F.col("id").alias("key"), F.lit("changed").alias("status"))
    out = incremental.plan_incremental(status, f, calls, calls, f.limit(0).select(F.col("fid").alias("key"), "fid"))
    assert seen == {("256k", "1m")} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert "BroadcastHashJoin" not in plan(out)
    assert out.where("action = 'regenerate'").count() == 10


def test_validate_flow_graph_has_no_text_keys(spark):
    nodes = spark.createDataFrame([(1, 1, "START", "x"), (1, 2, "ACTION", "x"), (1, 3, "END", "x"), (2, 1, "START", "x"), (2, 2, "END", "x")], "fkey int, node_id int, type string, label string")
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "fkey long, source long, target long")
    out = graph.validate_flow_graph(nodes, edges)
    assert rows(out) == [(1, "unreachable", "3")]
    assert "to_json" not in plan(out)

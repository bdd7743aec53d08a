from factloom.operators import incremental as inc


def kv(spark, d, schema="key string, hash string"):
    return spark.createDataFrame(list(d.items()), schema)


def status(frame):
    return {r.key: r.status for r in frame.collect()}


def test_classify(spark):
    assert status(inc.classify(kv(spark, {"a": "1", "b": "1", "c": "1"}), kv(spark, {"a": "1", "b": "2", "d": "1"}))) == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    assert status(inc.classify(kv(spark, {}), kv(spark, {"a": "1"}))) == {"a": "new"}


def graph_of(spark):
    f = spark.createDataFrame([(x,) for x in "abcd"], "fid string")
    calls = spark.createDataFrame([("a", "b"), ("b", "c")], "caller string, callee string")
    uses = spark.createDataFrame([("G", "c"), ("T", "b"), ("M@f.h", "d")], "key string, fid string")
    return f, calls, uses


def test_impact_set(spark):
    f, calls, uses = graph_of(spark)
    hit = lambda *keys, extra=None: {r.fid for r in inc.impact_set(spark.createDataFrame([(k,) for k in keys], "key string"), f, calls, uses, extra).collect()}
    assert hit("c") == {"a", "b", "c"} and hit("b") == {"a", "b"} and hit("d") == {"d"}
    assert hit("G") == {"a", "b", "c"} and hit("T") == {"a", "b"} and hit("M@f.h") == {"d"} and hit("nope") == set()
    assert hit("nope", extra=spark.createDataFrame([("b",)], "fid string")) == {"a", "b"}


def test_impact_set_of_a_cycle(spark):
    f = spark.createDataFrame([("a",), ("b",)], "fid string")
    calls = spark.createDataFrame([("a", "b"), ("b", "a")], "caller string, callee string")
    uses = spark.createDataFrame([], "key string, fid string")
    assert {r.fid for r in inc.impact_set(spark.createDataFrame([("a",)], "key string"), f, calls, uses).collect()} == {"a", "b"}


def test_plan_seeds_callers_of_deleted_functions(spark):
    f, calls, uses = graph_of(spark)
    old = calls.unionByName(spark.createDataFrame([("d", "gone")], "caller string, callee string"))
    plan = inc.plan_incremental(kv(spark, {"gone": "deleted", "a": "unchanged"}, "key string, status string"), f, calls, old, uses)
    assert {r.fid: r.action for r in plan.collect()} == {"a": "reuse", "b": "reuse", "c": "reuse", "d": "regenerate"}


def test_fingerprints_follow_dependencies(spark):
    deps = spark.createDataFrame([("f", "g"), ("f", "T"), ("f", "T"), ("f", "missing"), ("x", "g")], "key string, dep string")
    fp = lambda h: {r.key: r.fp for r in inc.fingerprints(kv(spark, h), deps).collect()}
    a, b = fp({"f": "1", "g": "2", "T": "3"}), fp({"f": "1", "g": "9", "T": "3"})
    assert set(a) == {"f", "g", "T"} and all(len(v) == 64 for v in a.values())
    assert a["f"] != b["f"] and a["T"] == b["T"]


def test_merge_by_file(spark):
    s = "fid string, file string, hash string"
    base = spark.createDataFrame([("f1", "A", "1"), ("f2", "B", "1"), ("old", "A", "1")], s)
    fresh = spark.createDataFrame([("f1", "A", "2"), ("new", "A", "2"), ("f2", "B", "9")], s)
    drop = spark.createDataFrame([("A",)], "file string")
    assert {(r.fid, r.hash) for r in inc.merge_by_file(base, fresh, drop, "fid").collect()} == {("f1", "2"), ("f2", "1"), ("new", "2")}


def test_merge_model_equals_a_full_rescan(spark):
    s, c, p = "fid string, file string, hash string", "caller string, callee string", "ov string, base string"
    base = {"functions": spark.createDataFrame([("f1", "A", "1"), ("f2", "B", "1"), ("gone", "A", "1")], s), "calls": spark.createDataFrame([("f2", "f1"), ("f2", "gone"), ("f1", "gone")], c), "override_pairs": spark.createDataFrame([], p)}
    fresh = {"functions": spark.createDataFrame([("f1", "A", "2"), ("f3", "A", "2")], s), "calls": spark.createDataFrame([("f3", "f1")], c), "override_pairs": spark.createDataFrame([], p)}
    out = inc.merge_model(base, fresh, spark.createDataFrame([("A",)], "file string"))
    assert {(r.caller, r.callee) for r in out["calls"].collect()} == {("f2", "f1"), ("f3", "f1")}
    assert inc.diff_models(out["functions"], spark.createDataFrame([("f1", "A", "2"), ("f2", "B", "1"), ("f3", "A", "2")], s), "fid", ["hash", "file"]).count() == 0


def test_splice_priorities(spark):
    s = "name string, payload string, ord long"
    rows = lambda *x: spark.createDataFrame(list(x), s)
    out = inc.splice(rows(("a", "F", 1), ("n", "F", 2)), rows(("b", "C", 1)), rows(("b", "B", 1), ("a", "B", 2), ("c", "B", 3), ("dead", "B", 4)), spark.createDataFrame([("a",), ("b",), ("c",), ("n",)], "name string"))
    assert [(r.name, r.payload) for r in out.orderBy("place").collect()] == [("b", "C"), ("a", "F"), ("c", "B"), ("n", "F")]


def test_reuse_index_first_producer_wins(spark):
    s = "fp string, version string, key string"
    index = inc.index_put(spark.createDataFrame([("x", "v1", "k1")], s), spark.createDataFrame([("x", "v2", "k2"), ("y", "v2", "k3"), ("y", "v2", "k2")], s))
    assert {tuple(r) for r in index.collect()} == {("x", "v1", "k1"), ("y", "v2", "k2")}
    hit = inc.reuse_from_index(spark.createDataFrame([("q", "x"), ("r", "y")], "key string, fp string"), index, spark.createDataFrame([("v1", "k1", "P")], "version string, key string, payload string"), "v2")
    assert [tuple(r) for r in hit.collect()] == [("q", "v1", "k1", "P")]


def test_affected_and_new_units(spark):
    inc_rows = spark.createDataFrame([("a.cpp", "x.h"), ("b.cpp", "y.h")], "tu string, inc string")
    changed = spark.createDataFrame([("x.h",), ("b.cpp",), ("c.cpp",), ("d.h",)], "file string")
    assert {r.tu for r in inc.affected_tus(inc_rows, changed).collect()} == {"a.cpp", "b.cpp"}
    assert {r.file for r in inc.new_tus(changed, inc_rows.select("tu").distinct()).collect()} == {"c.cpp"}


def test_carry_forward_and_report(spark):
    s = "k long, d string, e string"
    out = inc.carry_forward(spark.createDataFrame([(1, "t", "t"), (2, "t", "t")], s), spark.createDataFrame([(1, "", "b")], s), "k", ["d", "e"])
    assert {tuple(r) for r in out.collect()} == {(1, "t", "b"), (2, "t", "t")}
    r = inc.reuse_report(spark.createDataFrame([("reuse",)] * 2 + [("regenerate",)], "action string")).first()
    assert (r.total, r.regenerated, r.reused, r.percent_reused) == (3, 1, 2, 66)
    assert inc.reuse_report(spark.createDataFrame([], "action string")).first().percent_reused == 0


def test_nearest_ancestor_takes_the_first_on_a_tie(spark):
    df = spark.createDataFrame([("g", "x", 3, 1), ("g", "y", 1, 3), ("g", "z", 1, 2), ("g", "w", None, 0)], "g string, v string, d long, o long")
    assert inc.nearest_ancestor(df, "g", "v", "d", "o").first().v == "z"

from pyspark.sql import functions as F

from factloom.functions import keys, text
from factloom.operators import derive, diff, sequential, service
from factloom.sources import readers, sinks


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


def test_keys(spark):
    assert one(spark, "g_read_buffer", keys.readable_label) == "Read buffer" and one(spark, "s_ab", keys.readable_label) == ""
    assert one(spark, "Foo", keys.type_range) == "NA"
    assert one(spark, "/repo/a", lambda c: keys.repo_relative(c, F.lit("/repo/"))) == "a" and one(spark, "/repository/a", lambda c: keys.repo_relative(c, F.lit("/repo"))) is None
    assert one(spark, 7, lambda n: keys.interface_id(F.lit(False), F.lit("L1"), F.lit(""), F.lit("u_x"), n), "int") == "IF_L1_UX_07"
    assert one(spark, 123, lambda n: keys.interface_id(F.lit(True), F.lit("L"), F.lit("g"), F.lit("u"), n), "int") == "PIF_L_G_U_123"


def test_word_diff_and_json(spark):
    assert text.word_diff("a b c", "a x c") == [{"text": "a ", "mark": "same"}, {"text": "b", "mark": "removed"}, {"text": "x", "mark": "added"}, {"text": " c", "mark": "same"}]
    assert text.first_json('note {"a": [1, 2') == '{"a": [1, 2]}' and text.first_json("{'a': 'b',}") == '{"a": "b"}' and text.first_json("none") is None
    assert text.first_json('x {"a": "}"} y {"b": 1}') == '{"a": "}"}'


def test_type_ranges(spark):
    want = {
        "void": "VOID", "bool": "NA", "int": "-0x80000000-0x7FFFFFFF", "unsigned int": "0-0xFFFFFFFF", "uint8_t": "0-0xFF", "uint16_t": "0-0xFFFF", "uint32_t": "0-0xFFFFFFFF", "int8_t": "-0x80-0x7F", "int16_t": "-0x8000-0x7FFF",
        "int32_t": "-0x80000000-0x7FFFFFFF", "float": "NA", "std::uint8_t": "0-0xFF", "size_t": "0-0xFFFFFFFFFFFFFFFF", "SomeStruct*": "NA", "": "NA", "const uint8_t": "0-0xFF", "void*": "NA", "void *": "NA", "void const": "VOID",
        "uint64_t": "0-0xFFFFFFFFFFFFFFFF", "long": "-0x80000000-0x7FFFFFFF", "unsigned": "0-0xFFFFFFFF", "std::uint32_t": "0-0xFFFFFFFF", "long long": "-0x8000000000000000-0x7FFFFFFFFFFFFFFF", "const volatile std::size_t": "0-0xFFFFFFFFFFFFFFFF", "size_t *": "NA",
        "const int &": "NA", "unsigned long long": "0-0xFFFFFFFFFFFFFFFF", " UINT8_T ": "0-0xFF", None: "NA",
    }
    df = spark.createDataFrame([(k,) for k in want], "x string")
    assert {r.x: r.y for r in df.select("x", keys.type_range(F.col("x")).alias("y")).collect()} == want


def test_behaviour_names(spark):
    rows = [
        ("g_request_id", "ns::g_state", "g_in", "int", "result_code + 1", "A::run", "Request id", "Result code"), ("", "ns::g_state", None, "void", "", "A::run_all", "State", "State"), (None, None, "g_input_buf", "my_status_t", None, "run", "Input buf", "My status t"),
        ("i", "ns::g_state", None, "int", "(x)", "A::run_all", "Run all input", "State"), (None, None, None, "bool", "42", "A::go_now", "Go now input", "Go now result"), (None, None, None, "", "", "f", "Behaviour input", "Behaviour result"), ("value", None, "s_cache", "const Foo", "-1", "x::compute", "Value", "Foo"),
    ]
    df = spark.createDataFrame(rows, "p string, w string, r string, t string, e string, q string, i string, o string")
    for x in df.select("*", keys.behaviour_names(*map(F.col, "pwrteq")).alias("b")).collect():
        assert (x.b.input_name, x.b.output_name) == (x.i, x.o), x
    assert one(spark, "State input", keys.poor_name) and one(spark, None, keys.poor_name) and not one(spark, "State", keys.poor_name)


def test_noisy_json():
    f = text.first_json
    assert f('{"a":"x\\\\","b":1}') == '{"a": "x\\\\", "b": 1}' and f('```json\n{"a": "{"}\n```') == '{"a": "{"}' and f('``` {"a": 1} ```') == '{"a": 1}'
    assert f('{"a": "it\'s", "b": \'c\'}') == '{"a": "it\'s", "b": "c"}' and f('{"a": "say \\"hi\\" }"} x') == '{"a": "say \\"hi\\" }"}'
    assert f('{"a": {"b": 1}') == '{"a": {"b": 1}}' and f('{"a": "open') == '{"a": "open"}' and f("{nothing}") is None and f(None) is None and f("no brace") is None
    good = '{"a": "it\'s, \'quoted\'"}'
    assert text.repair(good) == good and text.repair("{'k': ['x', 'y'],}") == '{"k": ["x", "y"]}'


def test_lexers(spark):
    code = '#ifndef G\n#define G\n#include "a.h"\n#ifdef G\n#include "b.h"\n#else\n#include "c.h"\n#endif\n#if 0\n#include "d.h"\n#endif\n#endif'
    includes = lambda *names: lambda c: text.active_includes(c, F.array(*map(F.lit, names)).cast("array<string>"))
    assert one(spark, code, includes()) == ["a.h", "c.h"] and one(spark, code, includes("G")) == []
    chain = '#if defined(A)\n#include "a.h"\n# elif B\n#include "b.h"\n#elif C > 2\n#include "c.h"\n#else\n#include "d.h"\n#endif\n#include "e.h"\n#include "e.h"\n#include <f.h>'
    assert one(spark, chain, includes("A", "B")) == ["a.h", "e.h"] and one(spark, chain, includes("B")) == ["b.h", "e.h"] and one(spark, chain, includes()) == ["c.h", "e.h"]
    assert one(spark, "src/x.CPP", text.companion_headers) == ["src/x.h", "src/x.hpp"] and one(spark, "src/x.h", text.companion_headers) == []
    assert one(spark, "x;\n/* one\n * two */", text.preceding_comment) == "one two" and one(spark, "// c\ncode();", text.preceding_comment) == ""
    assert one(spark, 'a<b & "c";<br/>d\ne<br />%', text.escape_label) == "a#60;b #38; #quot;c#quot;#59;<br/>d<br/>e<br/>#37;" and one(spark, "a|b%", text.escape_edge_label) == "a#124;b%"
    assert one(spark, "one two " + "x" * 50 + " three<br/>four  five", text.wrap_label) == "one two<br/>" + "x" * 50 + "<br/>three<br/>four five"
    want = {
        "retval == STATUS_OK": "retval equals STATUS_OK", "!manager->isConnected()": "manager is not connected", "count > 0 && buf != nullptr": "count is greater than 0 AND buf does not equal null",
        "isLimitExceeded(id, event)": "is limit exceeded", "!hasMore(x)": "does not has more", "p->q->canRun()": "p->q cans run", "a <= ns::B || c;": "a is less than or equal to B OR c", "": "", "compute(x) == 1": "compute(x) equals 1",
    }
    for raw, words in want.items():
        assert one(spark, raw, text.readable_condition) == words, raw
    for lines, shown in {"PRIVATE UNIT x": "private", "PUBLIC\nint\nf()": "public", "// PRIVATE\nint f()": "default", "int PRIVATE f()": "default", "PROTECTED a\n\n* c\nPUBLIC b\nf": "public", "PRIVATE\n1\n2\n3\n4\n5": "default", "private int": "default"}.items():
        assert one(spark, lines, text.visibility_before) == shown, lines
    assert [tuple(x) for x in one(spark, "x\n assert(a); ASSERT (b); my_assert(c)\nstatic_assert(d)", text.assert_calls)] == [(2, 2), (2, 13), (3, 1)]
    assert one(spark, "parseHTTPHeader_line of2021", text.keywords) == ["2021", "header", "line", "parse"]
    assert one(spark, "A::getSpeed", lambda c: text.keywords(c, F.lit("const Status_t &"), F.array(F.lit("B::readADC_now"), F.lit(None)))) == ["const", "get", "now", "read", "speed", "status_t"]
    assert one(spark, "int a;\nstruct S {\n  int b;\n};\nint c;", lambda c: text.declaration_snippet(c, F.lit(2))) == "struct S {\n  int b;\n};"
    assert one(spark, ["a", "b", "c"], lambda c: text.merge_ids(c, F.array(*map(F.lit, "axc"))), "array<string>") == ["a", "b", "x", "c"]
    assert one(spark, "one\ntwo\nthree", lambda c: text.truncate_to_budget(c, 3)) == "one\ntwo"


def test_sources(spark, tmp_path):
    (tmp_path / "src/sub").mkdir(parents=True)
    (tmp_path / "src/a.cpp").write_text("#define A 1\\\n + 2\n# define B\nint x;")
    (tmp_path / "src/sub/b.cc").write_text("int y;")
    (tmp_path / "src/c.txt").write_text("#define NO 1")
    files = readers.source_files(spark, str(tmp_path / "src"))
    assert files.count() == 2
    assert {(r.line, r.name, r.value) for r in readers.defines(files).collect()} == {(1, "A", "1 + 2"), (3, "B", "")}
    assert readers.source_files(spark, str(tmp_path / "src"), only=files.where("path like '%b.cc'").select("path")).count() == 1
    (tmp_path / "m.csv").write_text("Name,Value\nVOID,void\nX,ne\nY,\n")
    assert {r.arg for r in readers.macro_args(spark, str(tmp_path / "m.csv")).collect()} == {"-DVOID=void", "-DY"}
    assert readers.parse_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // d\n}') == {"a": "//x", "b": [1, 2]}
    assert readers.load_config(['{"a": {"x": 1}, "b": 1}', '{"a": {"y": 2}}']) == {"a": {"y": 2}, "b": 1}
    (tmp_path / "k.json").write_text('{"k1": {"n": "x"}, "k2": {"n": null}}')
    assert {tuple(r) for r in readers.keyed_json(spark, str(tmp_path / "k.json"), "n:string").collect()} == {("k1", "x"), ("k2", None)}
    assert readers.json_table(spark, str(tmp_path / "none.json"), "a string", required=False).count() == 0
    rows = spark.createDataFrame([("T", "enum", "a", "", "", 1), ("", "", "b", "", "", 2), (None, "", "c", "", "", 3), ("U", "", "d", "", "", 4)], "name string, kind string, entry string, range string, comment string, ord int")
    assert [(r.name, r.entry) for r in readers.data_dictionary(rows).orderBy("ord").collect()] == [("T", "a"), ("T", "b"), ("T", "c"), ("U", "d")]
    status = spark.createDataFrame([("R100\ta\tb",), ("M\tc",), ("",)], "value string")
    assert {tuple(r) for r in readers.parse_status(status).collect()} == {("D", "a"), ("A", "b"), ("M", "c")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    sinks.write_table(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.write_version(df, str(tmp_path / "v"), "one")
    sinks.copy_version(spark, str(tmp_path / "v"), "one", "two")
    assert spark.read.parquet(str(tmp_path / "v")).groupBy("version_id").count().count() == 2
    made = []

    def compute(x):
        made.append(x.count())
        return x.select("hash", F.upper("payload").alias("result"))

    w = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "hash string, payload string")
    store = str(tmp_path / "store")
    assert {r.result for r in sinks.cached_compute(w, store, compute).collect()} == {"A", "B"}
    sinks.cached_compute(w, store, compute)
    assert made == [2, 0]


def test_derive_and_service(spark):
    conf = spark.createDataFrame([("one", "A/", 1), ("two", "a/b", 0)], "component string, folder string, ord int")
    paths = spark.createDataFrame([("a/b/c.cpp",), ("A/x.cpp",), ("ab/x.cpp",)], "path string")
    assert {r.path: r.component for r in derive.component_of(paths, conf).collect()} == {"a/b/c.cpp": "two", "A/x.cpp": "one", "ab/x.cpp": "unknown"}
    t = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert {tuple(r) for r in service.upsert(t, spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string"), ["k"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert service.matching(t, {"k": None, "v": "x"}).count() == 1
    assert [tuple(r) for r in service.counted_page(t, ["k"], 2, 1).collect()] == [(2, "y", 2)]


def test_table_diff_repeated_keys(spark):
    s = "g int, cells array<string>, o int"
    left = spark.createDataFrame([(1, ["k", "a"], 1), (1, ["k", "b"], 2), (1, ["z", "q"], 3)], s)
    right = spark.createDataFrame([(1, ["k", "b"], 1), (1, ["k", "c"], 2), (1, ["n", "m"], 3)], s)
    got = sorted((r.k, r.ord, r.diff_type, tuple(r.marks)) for r in diff.table_rows(left, right, "g", "cells", "o").where("ord is not null").collect())
    assert got == [("k", 1, "unchanged", ("same", "same")), ("k", 2, "changed", ("same", "changed")), ("n", 3, "added", ("added", "added"))]
    assert diff.table_rows(left, right, "g", "cells", "o").where("diff_type = 'removed'").first().k == "z"


def test_sequential(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([1, 1, 1, 1, 1, 1, 12, 3])], "grp long, ord long, n_lines long")
    assert [r.n for r in sequential.segment_statements(rows).orderBy("segment").collect()] == [5, 1, 1, 1]
    items = spark.createDataFrame([(1, 1, 0, 100, 50, 20, 10, 5), (1, 2, 1, 100, 50, 20, 10, 5)], "grp long, id long, priority int, c0 int, c1 int, c2 int, c3 int, c4 int")
    level = lambda b: {r.id: r.level for r in sequential.fit_ladder(items, b).collect()}
    assert level(200) == {1: 0, 2: 0} and level(150) == {1: 1, 2: 0} and level(10) == {1: 4, 2: 4} and level(7) == {1: -1, 2: 4}
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 5, None)], "grp long, source long, target long")
    assert [r.node for r in sequential.breadth_first_order(edges).orderBy("place").collect()] == [0, 1, 2, 5]
    assert {(r.source, r.target) for r in sequential.reverse_post_order(edges).where("is_back").collect()} == {(2, 0)}
    cuts = spark.createDataFrame([(1, 48, 100), (1, 90, 100)], "grp long, y int, height int")
    assert [r.cut for r in sequential.snapped_cuts(cuts, 2).collect()] == [48]


def test_stream_resumes_from_its_cursor(spark, tmp_path):
    from factloom.streaming import progress

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "job long, line_no long, text string"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], schema).write.parquet(src)
    progress.drain(progress.stream_log(spark, spark.createDataFrame([], schema).schema, src), out, ck)
    spark.createDataFrame([(1, 3, "c")], schema).write.mode("append").parquet(src)
    progress.drain(progress.stream_log(spark, spark.createDataFrame([], schema).schema, src), out, ck)
    assert sorted(r.line_no for r in spark.read.parquet(out).collect()) == [1, 2, 3]

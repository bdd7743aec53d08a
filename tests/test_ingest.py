"""Import of output folders and runs that do only what changed."""

import uuid

import pytest
from pyspark.sql import functions as F

from factloom.operators.generation import Task, generate, in_order
from factloom.scratch import shared_dir
from factloom.sources import ingest
from factloom.sources.tables import Folder


def folder_of(spark, files):
    path = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    f = Folder(spark, path)
    for name, text in files.items():
        assert f.put_if_absent(name, text)
    f.delete("drafts")
    return path


def test_shapes_of_files(spark):
    path = folder_of(spark, {
        "p/v1/g/units.json": '{"a|b": {"n": 1, "x": "one"}, "c": {"n": 2.5}}', "p/v1/g/list.json": '[{"id": 7, "t": true}, {"name": "z", "t": false}, {"t": null, "deep": {"k": [1]}}, 5]',
        "p/v2/g/wrapped.json": ' {"version": 3, "entries": [{"key": "k1"}]}', "p/v2/h/single.json": '{"id": "one", "size": 4}', "p/v1/g/broken.json": '{"a": {"b": 1}', "p/v1/g/text.json": "hello", "p/v1/g/void.json": " ",
        "p/v1/readme.json": "{}", "p/v1/g/notes.txt": "x", "p/v1/g/none.json": "{}",
    })
    entries, bad = ingest.read_folder(spark, path)
    got = {(r.project, r.version, r.grp, r.name, r.key) for r in entries.collect()}
    assert got == {("p", "v1", "g", "units", "a|b"), ("p", "v1", "g", "units", "c"), ("p", "v1", "g", "list", "7"), ("p", "v1", "g", "list", "z"), ("p", "v1", "g", "list", "2"), ("p", "v2", "g", "wrapped", "k1"), ("p", "v2", "h", "single", "one")}
    assert {(r.path, r.reason) for r in bad.collect()} == {
        ("p/v1/g/broken.json", "broken JSON"), ("p/v1/g/text.json", "no object or list"), ("p/v1/g/void.json", "empty"), ("p/v1/readme.json", "not a table's path"), ("p/v1/g/notes.txt", "not a table's path"), ("p/v1/g/list.json", "1 items are no records")}
    fields = ingest.infer_fields(entries)
    assert {(r.name, r.field): (r.kind, r.n) for r in fields.where("name in ('units', 'list')").collect()} == {
        ("units", "n"): ("double", 2), ("units", "x"): ("string", 1), ("list", "id"): ("bigint", 1), ("list", "t"): ("boolean", 2), ("list", "name"): ("string", 1), ("list", "deep"): ("json", 1)}
    units = ingest.typed_table(entries, fields, "units")
    assert dict(units.dtypes)["n"] == "double" and {(r.key, r.n, r.x) for r in units.collect()} == {("a|b", 1.0, "one"), ("c", 2.5, None)}
    assert {(r.id, r.tables, r.records) for r in ingest.projects_of(entries).collect()} == {("p/v1/g", 2, 5), ("p/v2/g", 1, 1), ("p/v2/h", 1, 1)}


def test_only_what_changed_is_done_again(spark):
    folder = f"{shared_dir(spark)}/gen-{uuid.uuid4().hex}"
    a, b = spark.range(10), spark.range(5).withColumn("v", F.lit("x"))
    ran = []

    def task(name, *reads, edition="1"):
        def make(*tables):
            ran.append(name)
            return tables[0].agg(F.count("*").alias("n"))

        return Task(name, reads, make, edition)

    tasks = [task("c", "x", "y"), task("x", "a"), task("y", "b")]
    go = lambda a, b, tasks: generate(spark, folder, {"a": a, "b": b}, tasks).status
    assert set(go(a, b, tasks).values()) == {"written"} and ran[-1] == "c" and len(ran) == 3
    assert set(go(a.orderBy(F.desc("id")), b, tasks).values()) == {"kept"} and len(ran) == 3
    assert go(a, b.limit(4), tasks) == {"x": "kept", "y": "written", "c": "written"}
    assert go(a, b.limit(4), [task("x", "a", edition="2"), *tasks[::2]]) == {"x": "written", "y": "kept", "c": "written"}
    with pytest.raises(ValueError, match="cannot be made"):
        in_order([task("p", "q"), task("q", "p")], set())


def test_a_run_that_died_goes_on(spark):
    folder = f"{shared_dir(spark)}/gen-{uuid.uuid4().hex}"
    good = Task("one", ("a",), lambda a: a.limit(3))
    with pytest.raises(ZeroDivisionError):
        generate(spark, folder, {"a": spark.range(9)}, [good, Task("two", ("one",), lambda t: 1 / 0)])
    run = generate(spark, folder, {"a": spark.range(9)}, [good, Task("two", ("one",), lambda t: t)])
    assert run.status == {"one": "kept", "two": "written"} and run.tables["two"].count() == 3

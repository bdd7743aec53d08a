"""Stored tables: two objects on one folder, lost races, dead writers, versions, upkeep."""

import os
import threading
import uuid

import pytest

from factloom.extensions import Repository
from factloom.scratch import shared_dir
from factloom.sources import tables
from factloom.sources.tables import StoredTable

SCHEMA = "id long, name string"


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def content(df):
    return {r.id: r.name for r in df.collect()}


def test_two_objects_see_each_other(spark, folder):
    a, b = Repository(spark, folder, SCHEMA), Repository(spark, folder, SCHEMA)
    assert a.all().count() == 0 and a.version == 0
    a.put(rows(spark, (1, "x"), (2, "y")))
    b.put(rows(spark, (2, "z"), (3, "w")))
    assert content(a.all()) == content(b.all()) == content(Repository(spark, folder, SCHEMA).all()) == {1: "x", 2: "z", 3: "w"}
    a.delete(rows(spark, (1, None)).select("id"))
    b.create(rows(spark, (1, "again"), (3, "not taken")))
    assert content(b.all()) == {1: "again", 2: "z", 3: "w"} and content(b.all(2)) == {1: "x", 2: "z", 3: "w"} and content(b.all(1)) == {1: "x", 2: "y"}
    assert [(h["version"], h["operation"]) for h in b.table.history()] == [(1, "put"), (2, "put"), (3, "delete"), (4, "insert")]


def test_a_lost_race_is_tried_again_on_what_is_there_now(spark, folder):
    a, b = StoredTable(spark, folder, SCHEMA), StoredTable(spark, folder, SCHEMA)
    a.put(rows(spark, (1, "0")))
    raced = []

    def add(table):
        out = table.selectExpr("id", "cast(cast(name as int) + 1 as string) AS name")
        if not raced:  # another writer commits between the read and the commit
            raced.append(1)
            b.put(rows(spark, (1, "10")))
        return out

    assert a.update(add) == 3 and content(a.read()) == {1: "11"}


def test_writers_at_once_lose_nothing(spark, folder):
    errors = []

    def work(k):
        try:
            t = StoredTable(spark, folder, SCHEMA)
            for j in range(3):
                t.put(rows(spark, (10 * k + j, f"{k}-{j}")))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    assert not errors
    t = StoredTable(spark, folder, SCHEMA)
    assert t.version() == 12 and content(t.read()) == {10 * k + j: f"{k}-{j}" for k in range(4) for j in range(3)}


def test_a_dead_writer_leaves_the_last_version(spark, folder, monkeypatch):
    t = StoredTable(spark, folder, SCHEMA)
    t.put(rows(spark, (1, "x")))
    monkeypatch.setattr(tables.Folder, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.put(rows(spark, (1, "half")))
    monkeypatch.undo()
    again = StoredTable(spark, folder, SCHEMA)
    assert again.version() == 1 and content(again.read()) == {1: "x"}
    assert again.vacuum(min_age_ms=10_000_000) == 0 and again.vacuum(min_age_ms=0) == 1 and content(again.read()) == {1: "x"}


def test_parts_are_made_one_and_old_ones_go(spark, folder, monkeypatch):
    monkeypatch.setattr(tables, "MOST_PARTS", 3)
    t = StoredTable(spark, folder, SCHEMA)
    for k in range(5):
        t.put(rows(spark, (k % 2, f"v{k}")))
    t.delete(rows(spark, (0, None)).select("id"))
    assert content(t.read()) == {1: "v3"} and t.history()[4]["operation"] == "compact"
    before = len(os.listdir(f"{folder}/parts"))
    t.compact()
    assert t.vacuum(min_age_ms=0) == before and content(t.read()) == {1: "v3"} and t.compact() == t.version()


def test_repeated_and_missing_keys(spark, folder):
    t = StoredTable(spark, folder, "a string, b int, v double", ["a", "b"])
    t.put(spark.createDataFrame([("x", 1, 1.0), ("x", 1, 2.0), (None, None, 3.0)], "a string, b int, v double"))
    t.put(spark.createDataFrame([(None, None, 4.0)], "a string, b int, v double"))
    assert sorted((r.a or "", r.b or 0, r.v) for r in t.read().collect()) == [("", 0, 4.0), ("x", 1, 2.0)]
    t.put(spark.createDataFrame([], "a string, b int, v double"))
    assert t.read().count() == 2

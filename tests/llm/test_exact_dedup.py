import hashlib

from helpers import awkward, empty
from pyspark.sql import functions as F

from factloom.llm import exact_dedup as xd
from factloom.scratch import Scratch


def brute(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_brute_force_with_small_buckets_and_collisions(spark):
    rows = [(k, f"text {k % 37} {'long ' * (k % 5)}") for k in range(400)] + [(1000 + k, "hot") for k in range(200)] + [(None, "lonely"), (None, "hot"), (2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for key in (None, F.length("text").cast("long"), F.lit(5).cast("long"), F.lit(-1).cast("long"), F.xxhash64("text") % 7):
        got = xd.exact_dedup(df, bucket_rows=4, key=key)
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()], key=str) == brute(rows)


def test_directory_covers_every_key_once(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"), F.lit(1).cast("long").alias("n"))
    keys = keys.unionByName(spark.range(300).select("id", F.lit(1).cast("long").alias("n")).toDF("key", "n")).unionByName(spark.createDataFrame([(77777, 500)], "key long, n long"))
    keys = keys.groupBy("key").agg(F.sum("n").alias("n")).cache()
    directory = xd.build_directory(keys, Scratch(spark, "t"), 64).cache()
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())
    assert len(depths) > 2
    placed = xd.placed(keys, directory, depths)
    assert placed.where("bucket is not null").count() == keys.count()
    # ranges don't overlap: each key is found at one depth only
    at_all = directory.join(keys.where("n <= 64"), F.expr("case when depth = 0 then 0 when depth = 64 then key else shiftrightunsigned(key, 64 - depth) end = bucket"))
    assert at_all.groupBy("key").count().where("count > 1").count() == 0
    sizes = placed.groupBy("depth", "bucket", "pages").agg(F.sum("n").alias("n"), F.count_distinct("key").alias("k"))
    assert sizes.where("n > 64 and k > 1").count() == 0
    assert [(r.n, r.pages) for r in sizes.where("n > 64").collect()] == [(500, 8)]
    assert sizes.join(directory, ["bucket", "depth"]).where("n <> rows").count() == 0


def test_without_the_index_there_is_no_result(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k % 5}") for k in range(50)], "doc_id long, text string")
    monkeypatch.setattr(xd, "placed", lambda rows, directory, depths: rows.selectExpr("*", "0 AS depth", "id AS bucket", "1 AS pages"))
    assert {r.group_size for r in xd.exact_dedup(docs, bucket_rows=4).collect()} == {1}  # owners that hold no key range find no copies


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = xd.exact_dedup(docs)
    assert out.count() == docs.count()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.collect()], key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert xd.exact_dedup(empty(spark)).count() == 0

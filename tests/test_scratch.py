import os

from factloom import scratch


def test_tables_live_in_the_shared_folder_and_can_be_cleared(spark):
    s = scratch.Scratch(spark, "t")
    a = s.put(spark.range(5).selectExpr("id", "id * 2 AS x"), "a")
    b = s.put(a.where("id > 2"))
    assert b.count() == 2 and a._scratch_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    s.drop(a)
    assert not os.path.exists(a._scratch_path) and b.count() == 2
    scratch.clear(spark)
    assert not os.path.exists(s.root)


def test_only_the_result_of_a_step_stays(spark):
    import os

    from factloom import scratch

    own = scratch.Scratch(spark, "own")
    with scratch.only_result(spark):
        inner = scratch.Scratch(spark, "inner")
        kept = own.put(inner.put(spark.range(5)).where("id > 1"), "kept")
    assert kept.count() == 3 and not os.path.exists(inner.root) and os.path.exists(own.root)

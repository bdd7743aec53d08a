"""The dyadic index of ranges and the order-free hash of groups."""

import random

from pyspark.sql import functions as F

from factloom.operators import derive, diff


def test_nodes_make_up_a_range_and_probes_meet_one(spark):
    r = random.Random(1)
    spans = [(0, 0), (5, 4), (-3, 2), (1, 6), (7, 7), (0, 63), (1, 62)] + [(a, a + r.randrange(200)) for a in (r.randrange(300) for _ in range(60))]
    for a, b, nodes in spark.createDataFrame(spans, "a long, b long").select("a", "b", derive.dyadic_nodes(F.col("a"), F.col("b")).alias("n")).collect():
        places = sorted(x for n in nodes for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert places == list(range(max(a, 0), b + 1)), (a, b)
    big = spark.range(1).select(F.size(derive.dyadic_nodes(F.lit(12_345), F.lit(10_012_344))).alias("n"), F.size(derive.dyadic_nodes(F.lit(0), F.lit((1 << 40) - 1))).alias("whole")).first()
    assert big.n < 60 and big.whole == 1


def test_pairs_of_points_and_ranges(spark):
    r = random.Random(2)
    points = [(r.randrange(3), r.randrange(500)) for _ in range(200)] + [(9, 1)]
    ranges = [(r.randrange(3), k, a := r.randrange(480), a + r.choice([-1, 0, 3, 60, 400])) for k in range(60)]
    got = derive.held_by(spark.createDataFrame(points, "grp long, pos long"), spark.createDataFrame(ranges, "grp long, rid long, line long, end_line long"), "grp")
    assert sorted((x.grp, x.pos, x.rid) for x in got.collect()) == sorted((g, p, k) for g, p in points for h, k, a, b in ranges if g == h and a <= p <= b)


def test_multiset_hash(spark):
    fp = lambda *rows: spark.createDataFrame(rows, "g string, k long, t string").transform(lambda d: diff.group_fingerprints(d, ["g"], ["k", "t"])).first().fp
    one = fp(("a", 1, "x"), ("a", 2, None))
    assert one == fp(("b", 2, None), ("b", 1, "x"))
    assert len({one, fp(("a", 1, "x"), ("a", 2, "")), fp(("a", 1, "x")), fp(("a", 1, "x"), ("a", 1, "x")), fp(("a", 1, "x"), ("a", 2, None), ("a", 2, None)), fp(("a", 2, "x"), ("a", 1, None))}) == 6

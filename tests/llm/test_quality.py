import zlib

import numpy as np
from helpers import awkward, empty

from factloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scorer = quality.train(docs, labels)
    got = {r["id"]: r.score for r in quality.score_quality(docs, scorer).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    rows = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.mean([(got[r.doc_id] >= quality.THRESHOLD) == (r.quality == 1) for r in rows])
    assert right > 0.95


def test_labels_of_held_out_rows_are_never_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(a.w1, b.w1) and a.slope == b.slope


def test_negatives_are_never_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    a, b = quality.train(docs, labels), quality.train(docs, labels.where("quality = 1"))
    assert np.array_equal(a.w1, b.w1) and a.slope == b.slope and a.shift == b.shift


def test_samples_are_bounded_in_rows(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text").withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_id") + 1)
    assert 60 < len(quality._sample(docs, 3000, 100)) < 150
    same = spark.range(3000).selectExpr("1L AS doc_id", "'copy' AS text")
    assert len(quality._sample(same, 3000, 100)) in (0, 200)


def test_prior_and_calibration_come_from_the_mixture():
    rng = np.random.default_rng(1)
    for prior in (0.2, 0.5, 0.8):
        pos, unl = rng.normal(2, 1, (4000, 3)), np.concatenate([rng.normal(2, 1, (int(6000 * prior), 3)), rng.normal(-2, 1, (6000 - int(6000 * prior), 3))])
        s, got = quality.fit(pos, rng.permutation(unl))
        assert abs(got - prior) < 0.05, (prior, got)
        assert abs(s.predict(unl).mean() - got) < 0.03
        y = np.arange(6000) < int(6000 * prior)
        assert ((s.predict(unl) >= 0.5) == y).mean() > 0.97


def test_risk_stays_non_negative_and_learns():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (400, 3)), rng.normal(-1.5, 1, (600, 3))
    unl = np.concatenate([pos[:200], neg[:200]])
    s = quality.fit_nnpu(pos[200:], unl, 0.5)
    assert (s.raw(pos) > 0).mean() > 0.9 and (s.raw(neg) < 0).mean() > 0.9


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 1, 0), (1, 0, 1), (4, 1, None), (6, 0, 0), (8, 1, 0), (10, 0, 1)], "doc_id long, quality int, toxic int")
    scorer = quality.train(docs, labels)
    out = quality.score_quality(docs, scorer)
    assert out.count() == docs.count()
    assert quality.keep_good(docs, scorer, 0.0).columns == docs.columns and quality.keep_good(docs, scorer, 0.0).count() == docs.count()
    assert out.where("score is null").count() == 0
    assert quality.train(docs, labels.limit(0)) is None and quality.train(empty(spark), labels) is None
    assert {r.score for r in quality.score_quality(docs, None).collect()} == {0.5}
    assert quality.score_quality(empty(spark), scorer).count() == 0

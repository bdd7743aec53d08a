import random

import corpus_pipeline
from helpers import awkward, empty
from pyspark.sql import DataFrameWriter

from factloom.llm import line_dedup, packing, pii, quality, simhash
from factloom.scratch import Scratch


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.put(stage(spark, seen[-1], sf), "s")
        if name != "best-fit packing":
            assert out.columns == docs.columns
        seen.append(out)
    rows = [{r.doc_id: r.text for r in s.collect()} for s in seen[:-1]]
    scorer = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import numpy as np

    want = {d for d, t in rows[0].items() if scorer.predict(np.array([quality.text_features(t)]))[0] >= quality.THRESHOLD}
    assert set(rows[1]) == want and len(want) < len(rows[0])
    assert rows[2] == {r.doc_id: r.text for r in line_dedup.dedup_lines(seen[1]).collect()} and rows[2] != rows[1]
    classes = simhash.near_duplicates(seen[2]).collect()
    assert set(rows[3]) <= {r.component_id for r in classes}  # more go by the words that texts share
    model, thresholds = pii.trained()
    assert rows[4] == {d: pii.redact(t, pii.find_spans(t, model, thresholds)[1]) for d, t in rows[3].items()}
    enc = packing.tokenizer().encode
    assert sum(r.length for r in seen[-1].collect()) == sum(len(enc(t)) + 1 for t in rows[4].values())


def test_run_equals_the_stages_and_handles_awkward_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for k, docs in enumerate((awkward(spark), empty(spark))):
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (out.count() == 0) == (k == 1)


def jaccard5(a, b):
    sa, sb = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(sa & sb) / len(sa | sb)


def test_copies_at_a_similarity_of_five_words_go(spark):
    r = random.Random(11)
    rows, far = [], 0
    for k in range(80):
        ws = [f"w{r.randrange(10**6)}" for _ in range(200)]
        other = list(ws)
        for at in range(20, 200, 50):  # 4 x 5 of 196 shingles: 176 / 216
            other[at] = f"x{r.randrange(10**6)}"
        a, b = " ".join(ws), " ".join(other)
        assert jaccard5(a, b) >= 0.8
        far += (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
        for at in range(30, 200, 50):
            other[at] = f"y{r.randrange(10**6)}"
        assert jaccard5(a, " ".join(other)) < 0.8
        rows += [(2 * k, a), (2 * k + 1, b)]
    assert far > 60
    docs = spark.createDataFrame(rows + [(999, "only " + " ".join(other[:100]))], "doc_id long, text string")
    left = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert {2 * k for k in range(80)} | {999} <= left and len(left) <= 81 + 3  # bands miss 1 % at exactly 0.8


def test_one_row_of_a_group_of_copies_stays(spark):
    other = " ".join(f"other{k}" for k in range(50))
    copy = " ".join(f"copy{k}" for k in range(50))
    lone = " ".join(f"lone{k}" for k in range(50))
    rows = [(1, copy, 1), (5, copy, 2), (5, other, 3), (7, lone, 4), (7, lone, 4), (None, copy, 5), (None, "a b c", 6), (None, "a b c", 6), (None, None, 7), (8, "", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(x.place for x in out.collect()) == [1, 3, 4, 6, 8]


def test_near_copies_broadcast_small_tables_only(spark, monkeypatch):
    seen, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *a, **k):
        seen[path.rsplit("/", 1)[1]] = tuple(spark.conf.get(name, None) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"))
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = spark.createDataFrame([(k, "one two three four five six seven eight nine ten" if k % 2 else f"text {k}") for k in range(8)], "doc_id long, text string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert len(seen) > 10 and set(seen.values()) == {("256k", "1m")}
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 4, 6]

import random
import zlib

import numpy as np
from helpers import awkward, empty
from pyspark.sql import functions as F

from factloom.llm import curve_packing as cp
from factloom.llm.packing import tokenizer


def test_the_curve_visits_every_cell_by_single_steps():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        keys = cp.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(1 << axes * bits))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_vectors_count_grams():
    v = cp.document_vector(b"abcdabcd")
    assert np.isclose((v**2).sum(), 1) and sorted((v**2 * 5).round(6))[-4:] == [1, 1, 1, 2]
    assert not cp.document_vector(b"abc").any() and not cp.document_vector(b"").any()
    r = random.Random(1)
    text = bytes(r.randrange(256) for _ in range(3 * cp.STEP + 5))
    grams = np.array([int.from_bytes(text[i : i + 4], "little") for i in range(len(text) - 3)], np.uint32)
    want = np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=cp.DIMENSIONS)
    assert np.allclose(cp.document_vector(text) ** 2 * want.sum(), want)


def test_tail_cuts():
    assert cp.tail_cuts(0, 8) == [0] and cp.tail_cuts(16, 8) == [16] and cp.tail_cuts(23, 8) == [16, 20, 22, 23] and cp.tail_cuts(5, 8) == [0, 4, 5]


def packed(docs, capacity=64):
    rows = [r.asDict() for r in cp.pack_along_curve(docs, capacity).collect()]
    fill: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    last = max(fill, default=0)
    short = [n for s, n in sorted(fill.items()) if n < capacity]
    assert sorted(fill) == list(range(last + 1 if fill else 0)) and all(n & (n - 1) == 0 for n in short) and short == sorted(set(short), reverse=True)
    return rows, fill


def test_every_id_lies_in_one_piece(spark):
    docs = awkward(spark)
    rows, _ = packed(docs)
    want = sorted(np.array([*tokenizer().encode(r.text or ""), cp.END_ID], "<u4").tobytes() for r in docs.collect())
    got: dict = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for (_, n), pieces in got.items():
        covered = sorted((p["start"], p["length"]) for p in pieces)
        copies = sum(s == 0 for s, _ in covered)
        assert sum(k for _, k in covered) == n * copies
    # documents of an id and length of their own are whole again
    whole = [b"".join(bytes(p["ids"]) for p in sorted(v, key=lambda p: p["start"])) for v in got.values() if sum(p["start"] == 0 for p in v) == 1]
    assert all(w in want for w in whole) and len(whole) >= 9
    assert sum(r["length"] for r in rows) * 4 == sum(map(len, want))


def test_no_sequence_is_short_whatever_the_number_of_tasks(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(["red", "green", "blue"]) for _ in range(r.randint(0, 200)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = []
        for tasks in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            rows, fill = packed(docs, 2048)
            seen.append(sorted((x["doc_id"], x["start"], x["length"], x["sequence_id"], x["offset"], zlib.crc32(x["ids"])) for x in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert seen[0] == seen[1]
    assert cp.pack_along_curve(empty(spark)).count() == 0


def test_documents_that_are_alike_are_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.length("text") > 200).select("doc_id", "text", "lang")
    rows = cp.curve_order(docs).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").orderBy("key", "id").collect()
    same = sum(a.lang == b.lang for a, b in zip(rows, rows[1:], strict=False)) / len(rows)
    share = sum((sum(r.lang == g for r in rows) / len(rows)) ** 2 for g in {r.lang for r in rows})
    assert same > share + 0.4 * (1 - share), (same, share)

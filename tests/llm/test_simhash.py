import random
from collections import Counter

import pandas as pd
import xxhash
from helpers import awkward, empty
from pyspark.sql import DataFrameWriter, functions as F

from factloom.llm import simhash
from factloom.scratch import Scratch


def slow_fp(text):
    ws = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_parts(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fl = list(fps)
    for i, a in enumerate(fl):
        for b in fl[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fl}


def test_fingerprint():
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice(["A", "b", "Ñ", " ", "\t", " ", "\x1c", "cd ", "\n"]) for _ in range(r.randint(0, 60)))
        assert simhash.fingerprint(t) == slow_fp(t), repr(t)


def test_links_find_every_component(spark):
    r = random.Random(10)
    fps = {r.getrandbits(64) for _ in range(60)} | {0}
    for base in list(fps)[:6]:
        x = base
        for _ in range(60):  # chains and clouds, dense enough for the long lists
            y = (x if r.random() < 0.5 else base) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            fps.add(y)
            x = y
        fps |= {base ^ v for v in range(200)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    docs = spark.createDataFrame(signed, "fp long")
    want = slow_parts(fps)
    for list_rows, block_rows in ((32, 2048), (4, 16)):
        pairs = simhash.links(docs, Scratch(spark, "t"), list_rows, block_rows).collect()
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for p in pairs:
            a, b = p.a % 2**64, p.b % 2**64
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        assert Counter(Counter(find(f) for f in fps).values()) == Counter(Counter(want.values()).values())
        assert len({(find(f), want[f]) for f in fps}) == len(set(want.values()))


def test_levels_of_the_index_give_the_same_links(spark, monkeypatch):
    r = random.Random(15)
    fps = {r.getrandbits(64) for _ in range(200)}
    fps |= {f ^ sum(1 << b for b in r.sample(range(64), 3)) for f in list(fps)[:100]}
    signed = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = {tuple(sorted(((a - 2**64 if a >= 2**63 else a), (b - 2**64 if b >= 2**63 else b)))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    for load in (1e9, 0.25, 1e-4, 1e-9):  # 1, 2, 3 and 5 positions
        monkeypatch.setattr(simhash, "LOAD", load)
        assert {tuple(x) for x in simhash.links(signed, Scratch(spark, "t"), list_rows=10**6).collect()} == want, load


def test_a_pair_below_the_guaranteed_tally_is_dropped(spark):
    met = spark.createDataFrame([(1, 2, 0b111), (1, 2, 0b1001), (1, 3, 0b111), (1, 3, 0b11000)], "a long, b long, positions int")
    assert [tuple(x) for x in simhash.tallied(met).collect()] == [(1, 3)]


def test_block_links_form_a_forest():
    fps = list(range(300))
    out = simhash.block_links(pd.DataFrame({"side": [0] * 300, "fp": fps}))
    assert len(out) == 299


def test_documents(spark):
    docs = awkward(spark)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    assert by[4].component_id == 1 and by[2].component_id == 2 and by[3].component_id == 2 and by[2].fp == 0
    assert by[None].component_id is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_sf001_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: slow_fp(r.text) for r in docs.collect()}
    parts = slow_parts(set(fps.values()))
    low: dict = {}
    for d, f in fps.items():
        low[parts[f]] = min(d, low.get(parts[f], d))
    assert {d: (r.fp % 2**64, r.component_id) for d, r in out.items()} == {d: (f, low[parts[f]]) for d, f in fps.items()}


def test_postings_are_not_broadcast(spark, monkeypatch):
    """Spark sizes what is exploded as what it was exploded from."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(1000).select(F.xxhash64("id").alias("fp"), F.array(*[F.lit(i) for i in range(56)]).alias("lists"))
    sized = simhash._sized(simhash._posted(rows, 3))
    assert "BroadcastHashJoin" not in plan(sized) and sized.where("n < 2").isEmpty()
    seen, write = set(), DataFrameWriter.parquet

    def parquet(self, *a, **k):
        seen.add(tuple(spark.conf.get(name, None) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")))
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    out = simhash.near_duplicates(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text")))
    assert seen == {("256k", "1m")} and "BroadcastHashJoin" not in plan(out)
    assert {r.component_id for r in out.collect()} == {0}

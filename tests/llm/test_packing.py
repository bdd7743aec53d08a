import random
import zlib

import numpy as np
from helpers import awkward, empty
from hypothesis import given, settings, strategies as st

from factloom.llm import packing


def test_ids_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.tokenizer()
    r = random.Random(3)
    texts = ["", " ", "a<|endoftext|>b", "é😀\u0000", "x" * 9000, " " * 5000, "\n\n\t "] + ["".join(r.choice("ab '\n\té1!|Z<>") for _ in range(r.randint(0, 80))) for _ in range(500)]
    texts += ["<|endoftext|>" * 3 + "x<|endoftext", "word " * 70 + "y" * 65 + " y" * 3, "a  b\u3000c\u00a0 \t d", "it's we'll 12 345"]
    assert [own.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_whole_documents_equal_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.tokenizer()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    r = random.Random(4)
    texts += [c * 100_000 for c in "x -\n7é"] + ["".join(r.choice("abcdefghij") for _ in range(100_000)), "".join(chr(r.choice([r.randrange(32, 0x800), r.randrange(0x4E00, 0x9000), r.randrange(0x1F300, 0x1F600)])) for _ in range(50_000))]
    assert all(own.encode(x) == e.ids for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True))


def test_ids_of_millions_of_blanks_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t, own, n = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.tokenizer(), 2_000_000
    texts = [" " * n, "\n" * n, "a" + "\t" * n + "b", "x" * n, "a" + " \n\t\u3000" * (n // 4) + "<|endoftext|> b" + " " * n + "c\n", " " * n + " \u00e9", " " * n + "\x1c" + " " * n + "."]
    for x in texts:
        assert own.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_a_row_of_ten_million_blanks_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 10_000_000), (2, "\n" * 3_000_000 + "end"), (3, "short")], "doc_id long, text string")
    out = packing.pack_documents(docs).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in out} == {i: len(packing.tokenizer().encode(t)) + 1 for i, t in docs.collect()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text_equal_the_library(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    test_ids_of_any_text_equal_the_library.library = t = getattr(test_ids_of_any_text_equal_the_library, "library", None) or Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.tokenizer().encode(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5))
def test_best_fit_against_brute_force(items, limit):
    bins, open_, made, got, want = packing.BestFit(40, limit), [], 0, [], []
    for n in items:
        got.append(bins.place(n))
        fits = sorted(free for free, _ in open_ if free >= n)
        if fits:
            k = max(i for i, (free, _) in enumerate(open_) if free == fits[0])
            free, b = open_.pop(k)
        else:
            if len(open_) >= limit:
                open_.remove(next(x for x in reversed(open_) if x[0] == min(f for f, _ in open_)))
            free, b, made = 40, made, made + 1
        want.append((b, 40 - free))
        if free > n:
            open_.append((free - n, b))
    fill: dict = {}
    for (b, o), n in zip(got, items):
        assert fill.get(b, 0) == o
        fill[b] = o + n
        assert o + n <= 40
    assert [o for _, o in got] == [o for _, o in want]


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_whole_documents_are_packed_gapless(spark):
    docs = awkward(spark)
    out = packing.pack_documents(docs).collect()
    seqs: dict = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    enc = packing.tokenizer().encode
    for d in docs.where("doc_id in (5, 6, 8)").collect():
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in out if r.doc_id == d.doc_id), key=lambda r: r.piece))
        assert np.frombuffer(ids, "<u4").tolist() == [*enc(d.text), 2]
    assert sum(r.doc_id == 9 for r in out) == 2 and any(r.doc_id is None for r in out)
    assert [zlib.crc32(bytes(r.ids)) for r in out if r.doc_id == 2] == [zlib.crc32(np.array([2], "<u4").tobytes())]
    assert packing.pack_documents(empty(spark)).count() == 0


def test_few_sequences_whatever_the_number_of_tasks(spark):
    r = random.Random(5)
    items = [r.choice([1024, r.randint(1, 1024), r.randint(1, 300)]) for _ in range(20_000)]
    least = -(-sum(items) // 1024)
    for tasks in (1, 200):
        pieces = spark.createDataFrame([(k, 0, 0, n, b"") for k, n in enumerate(items)], packing.PIECE).repartition(tasks)
        out = packing.pack(pieces)
        rows = out.select("doc_id", "length", "sequence_id", "offset").collect()
        assert len(rows) == len({x.doc_id for x in rows}) == 20_000
        fill: dict = {}
        for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
            assert fill.get(x.sequence_id, 0) == x.offset
            fill[x.sequence_id] = x.offset + x.length
        assert max(fill.values()) <= 1024
        assert len(fill) <= 1.01 * least, (tasks, len(fill) / least)


def test_the_open_bins_are_bounded_and_the_fullest_closes():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n)[0] for n in (7, 6, 8)] == [0, 1, 2] and bins.closed == [0] and bins.open == 2
    assert bins.place(2)[0] == 2 and bins.closed == [0, 2]

import random

import public_tokenizers as P
import pytest
import sentencepiece
from helpers import awkward, empty

from factloom.llm import piece_codec

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def both():
    return piece_codec.load(P.path(MODEL)), sentencepiece.SentencePieceProcessor(model_file=P.path(MODEL))


def test_random_texts_equal_the_library(both):
    own, lib = both
    r = random.Random(4)
    alphabet = "ab  ▁<s>é你①\n\t  theing​😀_0"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "  ", "▁", "<s></s><unk>", "a" * 5000, " " * 300, "the" * 3000, "<0x0A>"]
    assert [own.encode(t) for t in texts] == [lib.encode(t, add_eos=True) for t in texts]
    assert [own.decode(own.encode(t)) for t in texts] == [lib.decode(lib.encode(t)) for t in texts]


def test_random_ids_decode_like_the_library(both):
    own, lib = both
    r = random.Random(5)
    ids = [[r.randrange(32000) if r.random() < 0.6 else r.randrange(3, 259) for _ in range(r.randint(0, 12))] for _ in range(4000)]
    assert [own.decode(i) for i in ids] == [lib.decode(i) for i in ids]


def test_prefix_table_equals_merging(both):
    own, _ = both
    r = random.Random(6)
    for _ in range(500):
        w = "".join(r.choice(["the", "ing", "er", "a", "▁", "x", "tion"]) for _ in range(r.randint(1, 8)))
        assert own.encode_run(w) == own.merge(w)


def test_memos_stay_bounded(both, monkeypatch):
    own, lib = both
    monkeypatch.setattr(piece_codec, "MEMO_WORDS", 4)
    monkeypatch.setattr(piece_codec, "MEMO_PAIRS", 3)
    t = "alpha beta gamma delta epsilon alpha"
    own.words, own.older = {}, {}
    assert own.encode(t) == lib.encode(t, add_eos=True) and len(own.words) + len(own.older) <= 4 and len(own.pairs) <= 3


def test_columns(spark, both):
    _, lib = both
    docs = awkward(spark)
    rows = piece_codec.decode_column(piece_codec.encode_column(docs, MODEL), MODEL).collect()
    want = sorted((d.doc_id or -1, lib.encode(d.text or "", add_eos=True)) for d in docs.collect())
    assert sorted((r.id or -1, list(r.ids)) for r in rows) == want
    assert all(r.decoded == lib.decode(list(r.ids)) for r in rows)
    assert piece_codec.encode_column(empty(spark), MODEL).count() == 0
    one = piece_codec.recode_column(docs, MODEL).collect()
    assert sorted((r.id or -1, list(r.ids), r.decoded) for r in one) == sorted((r.id or -1, list(r.ids), r.decoded) for r in rows)

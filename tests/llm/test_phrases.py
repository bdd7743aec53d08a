import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import awkward, empty

from factloom.llm import phrases
from factloom.scratch import Scratch


def brute(rows, least, top):
    """rows: (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for m in range(1, 5):
                counts[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= 80 * f[p[i:j]]}
        scored = []
        for p, a in cand.items():
            if p in gone:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "cc", "the", "THE", "é", "É", "日本", "x" * 40, "a.b", "1,2", "q r"]
    weights = [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 1]
    return [(r.choice(["en", "de", None]), "".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", "! "]) for w in r.choices(words, weights, k=r.randint(0, 60)))) for _ in range(n)]


def rows_of(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def test_against_brute_force(spark):
    rows = texts(1, 120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(phrases.mine_phrases(docs, least=4, top=50)) == brute(rows, 4, 50)
    # ties at the cut, and every prefix split until its projection is small
    assert rows_of(phrases.mine_phrases(docs, least=2, top=7, most=3)) == brute(rows, 2, 7)


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    want = brute([(r.lang, r.text) for r in docs.collect()], 2, 2000)
    assert rows_of(phrases.mine_phrases(docs, least=2)) == want and any(x[2] == "word word word word" for x in want)
    assert phrases.mine_phrases(empty(spark)).count() == 0


def test_hashes_are_of_whole_words_wherever_a_text_is_cut():
    r = random.Random(2)
    folded = b"".join(bytes(r.choices(b"abc", k=r.randint(0, 9))) + r.choice([b" ", b"\n", b"  "]) for _ in range(500))
    whole = phrases.Hasher(phrases.MULTIPLIERS[0]).words(folded)
    for size in (1, 7, 64):
        part = phrases.Hasher(phrases.MULTIPLIERS[0]).words(folded, size)
        assert all((a == b).all() for a, b in zip(whole, part, strict=True))
    h, piece, start = whole
    found = folded.split()
    assert len(h) == len(found) and all(folded[s : s + len(w)] == w for s, w in zip(start, found, strict=True))
    assert len(set(h.tolist())) == len(set(found)) and [piece[k] for k in range(len(h))] == [folded[:s].count(b"\n") for s in start]


def test_a_shared_hash_leads_to_another_multiplier(spark, monkeypatch):
    real, seen = phrases.Hasher.words, []

    def words(self, folded, *size):
        h, piece, start = real(self, folded, *size)
        return (h % 3 + 1 if self.multiplier == 5 else h), piece, start

    monkeypatch.setattr(phrases, "MULTIPLIERS", (5, *phrases.MULTIPLIERS))
    monkeypatch.setattr(phrases.Hasher, "words", words)
    rows = [("en", "one two three four. one two. five six seven") for _ in range(3)]
    texts_ = phrases._texts(spark.createDataFrame(rows, "lang string, text string"), "lang", "text")
    same = phrases.count_words(texts_, 5).groupBy("code", "h").count().where("count > 1").count()
    seen.append(same)
    if same:  # the workers see the patched hasher
        assert rows_of(phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=2)) == brute(rows, 2, 2000)


def test_bitmap_passes_every_frequent_pair(spark):
    r = np.random.default_rng(3)
    pairs = r.integers(-(1 << 63), 1 << 63, 5000)
    bits = phrases.bitmap(spark.createDataFrame([(int(p),) for p in pairs], "pair long"))
    assert phrases.in_bitmap(bits, pairs.view(np.uint64)).all()
    others = r.integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert phrases.in_bitmap(bits, others).mean() < 0.1 and not phrases.in_bitmap(bits, np.zeros(3, np.uint64)).any()


def test_hot_prefixes_are_split(spark):
    rows = spark.createDataFrame([(1, 1, k % 4 + 2, k + 10, 0, 5) for k in range(40)] + [(1, 9, 8, 7, 6, 5)], "code long, w1 long, w2 long, w3 long, w4 long, n long")
    hot = phrases.split_prefixes(rows, Scratch(spark, "test"), 8)
    assert [t.count() for t in hot] == [1, 4, 0]
    got = {tuple(x) for x in phrases.frequent_phrases(rows, Scratch(spark, "test"), 6, 8).collect()}
    assert got == {(1, 1, w, 0, 0, 50) for w in range(2, 6)}

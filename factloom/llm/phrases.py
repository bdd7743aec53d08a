"""Phrase collocation mining by contiguous pattern growth in the manner of PrefixSpan.

A phrase is a run of words within a piece of text. An occurrence of a frequent pair of words becomes a pointer: its first word and
the words that may follow it, at most MAX_WORDS - 1, up to the first pair that can't be frequent. Equal pointers are one row with
their number, so very common passages are small. The pointers of a first word, its projection, go to one task, sorted; the task
grows the prefix to the right depth-first: the next words are runs of the projection, and a run that is frequent is the projection
of the longer prefix. A projection of too many rows is split by its next word, so its longer prefixes are tasks of their own.

Which pairs can be frequent is known from a bitmap of fixed size that is set at the hashes of all pairs counted MIN_COUNT times or more:
it passes every frequent pair, and pairs that it passes wrongly are dropped by the exact counts of the growth. Words are 64-bit
hashes inside; the table of words is checked for two words of one hash, and another multiplier is taken if there are any.

Scores need counts of both sides of a cut: these are phrases themselves, so they are joined from the result. All is written to the
shared folder between steps; nothing but the bitmap and the hot prefixes, both of bounded size, goes through the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import chunks, text_or_empty
from factloom.scratch import Scratch

#: The least count of a phrase; its most words; rows returned for a language; percent of a phrase's count at which a longer one
#: replaces it.
MIN_COUNT, MAX_WORDS, TOP, COVERED = 30, 4, 2000, 80
#: Bytes of text handled at a time; the bits of the bitmap a frequent pair, and at most; rows of a projection that one task may
#: hold, and the most prefixes that may be split.
TEXT_BYTES, BITS_PER_PAIR, MAX_BITS, PROJECTION, MAX_SPLIT = 4 << 20, 32, 1 << 27, 1 << 19, 4096
#: Odd multipliers of the polynomial hash of a word.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)

#: A-Z become a-z, marks that end a piece become line feeds, and the white space inside a piece becomes a blank.
_FOLD = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b in b" \t" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORDS = [f"w{k}" for k in range(1, MAX_WORDS + 1)]


class Hasher:
    """64-bit polynomial hashes of the words of a folded text."""

    def __init__(self, multiplier: int):
        self.multiplier, self.powers = multiplier, np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.powers) < n:
            step = np.uint64(pow(self.multiplier, len(self.powers), 1 << 64))
            self.powers = np.concatenate([self.powers, self.powers * step])

    def words(self, folded: bytes, size: int = TEXT_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, piece, start): of every word its hash, the number of its piece, and its place. Long texts are hashed in parts that end
        at white space."""
        parts, at, pieces = [], 0, 0
        while at < len(folded):
            end = at + size
            if end < len(folded):
                ends = [x for x in (folded.find(b" ", end), folded.find(b"\n", end)) if x >= 0]
                end = min(ends, default=len(folded))
            raw = np.frombuffer(folded, np.uint8, min(end, len(folded)) - at, at)
            blank = (raw == 32) | (raw == 10)
            edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
            starts, ends_ = edges[::2], edges[1::2]
            breaks = np.cumsum(raw == 10)
            if len(starts):
                lengths = ends_ - starts
                self._grow(int(lengths.max()))
                inside = raw[~blank].astype(np.uint64) + np.uint64(1)
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                place = np.arange(len(inside)) - np.repeat(first, lengths)
                h = np.add.reduceat(inside * self.powers[place], first)
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
                h[h == 0] = 1  # 0 stands for no word
                parts.append((h, breaks[starts] + pieces, starts + at))
            pieces += int(breaks[-1]) if len(breaks) else 0
            at = end
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def pair_hash(lang: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (lang ^ (a * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xA0761D6478BD642F) + b
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h ^ (h >> np.uint64(29))


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("code"), text_or_empty(text_col).alias("text"))


def _folded(part: pa.RecordBatch, values: list) -> Iterator[tuple]:
    """(value, folded texts of its rows), so that the rows of one language are handled together."""
    groups = defaultdict(list)
    for v, t in zip(values, part.column(part.schema.get_field_index("text")).to_pylist(), strict=True):
        groups[v].append(t.encode("utf-8", "surrogatepass"))
    for v, texts in groups.items():
        yield v, b"\n".join(texts).translate(_FOLD)


def count_words(texts: DataFrame, multiplier: int) -> DataFrame:
    """(lang, code, word, h, n) of every word; h is its hash."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(multiplier)
        for batch in batches:
            for part in chunks(batch, "text", 4096, TEXT_BYTES):
                for (lang, code), folded in _folded(part, list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))):
                    counts = Counter(folded.split())
                    hashes = hasher.words(b"\n".join(counts))[0].view(np.int64)
                    words = pa.array([w.decode("utf-8", "surrogatepass") for w in counts], pa.string())
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, code)), words, pa.array(hashes), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return texts.mapInArrow(run, "lang string, code long, word string, h long, n long").groupBy("lang", "code", "word", "h").agg(F.sum("n").alias("n"))


def _pairs(part: pa.RecordBatch, hasher: Hasher):
    """Of the texts of one language each: its code, the words' hashes, and the hash of the pair that a word begins (0 if it ends its piece)."""
    for code, folded in _folded(part, part.column(1).to_pylist()):
        h, piece, _ = hasher.words(folded)
        if len(h):
            pairs = np.zeros(len(h), np.uint64)
            pairs[:-1] = np.where(piece[1:] == piece[:-1], pair_hash(np.int64(code).view(np.uint64), h[:-1], h[1:]) | np.uint64(1), np.uint64(0))
            yield code, h, pairs


def count_pairs(texts: DataFrame, multiplier: int) -> DataFrame:
    """(pair, n): hashes of the pairs of neighbouring words. Two pairs may share one."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(multiplier)
        for batch in batches:
            for part in chunks(batch, "text", 4096, TEXT_BYTES):
                found = [p[p != 0] for _, _, p in _pairs(part, hasher)]
                if found:
                    pair, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def bitmap(pairs: DataFrame, limit: int = MAX_BITS) -> np.ndarray:
    """64-bit words with a bit for each of the pairs; as many bits as the pairs need, up to the limit."""
    size = 1 << 16
    wanted = pairs.count() * BITS_PER_PAIR
    while size < min(wanted, limit):
        size <<= 1
    slot = F.shiftrightunsigned("pair", 20).bitwiseAND(F.lit(size - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = pairs.select(F.shiftrightunsigned(slot, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    slot = (pairs >> np.uint64(20)) & np.uint64(len(bits) * 64 - 1)
    return (pairs != 0) & ((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def pointers(texts: DataFrame, multiplier: int, bits: np.ndarray) -> DataFrame:
    """(code, w1.., n): the occurrences of pairs that the bitmap passes, with the words after them as far as it passes their pairs (then
    0), equal ones combined."""
    schema = pa.schema([("code", pa.int64()), *((w, pa.int64()) for w in _WORDS), ("n", pa.int64())])
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = Hasher(multiplier), shared.value
        for batch in batches:
            for part in chunks(batch, "text", 4096, TEXT_BYTES):
                for code, h, pairs in _pairs(part, hasher):
                    on = in_bitmap(known, pairs)
                    at = np.flatnonzero(on)
                    if not len(at):
                        continue
                    on, h = np.concatenate([on, np.zeros(MAX_WORDS, bool)]), np.concatenate([h, np.zeros(MAX_WORDS, np.uint64)])
                    words, going = [h[at]], np.ones(len(at), bool)
                    for k in range(1, MAX_WORDS):
                        going &= on[at + k - 1]
                        words.append(np.where(going, h[at + k], np.uint64(0)))
                    order = np.lexsort(words[::-1])
                    words = [w[order] for w in words]
                    new = np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in words])])
                    first = np.flatnonzero(new)
                    n = np.diff(np.concatenate([first, [len(at)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), code)), *(pa.array(w[first].view(np.int64)) for w in words), pa.array(n.astype(np.int64))], schema=schema)

    fields = ", ".join(f"{c} long" for c in schema.names)
    return texts.mapInArrow(run, fields).groupBy("code", *_WORDS).agg(F.sum("n").alias("n"))


def grow(words: np.ndarray, n: np.ndarray, least: int, depth: int, prefix: tuple, found: list) -> None:
    """Depth-first: `words` (a row a pointer, sorted) holds the words after `prefix`, whose projection it is. Frequent longer prefixes of
    two words or more go to `found` as (prefix, count)."""
    if depth == words.shape[1]:
        return
    column = words[:, depth]
    first = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1])
    counts = np.add.reduceat(n, first)
    ends = np.concatenate([first[1:], [len(column)]])
    for k in np.flatnonzero((counts >= least) & (column[first] != 0)):
        longer = (*prefix, int(column[first[k]]))
        if depth:
            found.append((longer, int(counts[k])))
        grow(words[first[k] : ends[k]], n[first[k] : ends[k]], least, depth + 1, longer, found)


def split_prefixes(rows: DataFrame, scratch: Scratch, most: int = PROJECTION) -> list[DataFrame]:
    """Of 1, 2, .. words: the prefixes (code, w1.., n) whose projection has too many rows for a task; MAX_SPLIT each at most, as
    the bound grows with the table. n is their exact count."""
    bound, out = max(most, rows.count() // MAX_SPLIT), []
    for k in range(1, MAX_WORDS):
        on = ["code", *_WORDS[:k]]
        left = rows if k == 1 else rows.join(F.broadcast(out[-1].select(on[:-1])), on[:-1], "left_semi").where(F.col(on[-1]) != 0)
        hot = left.groupBy(on).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).where(F.col("rows") > bound).drop("rows")
        out.append(scratch.put(hot, f"hot{k}"))
        if out[-1].isEmpty():
            break
    return out


def frequent_phrases(rows: DataFrame, scratch: Scratch, least: int = MIN_COUNT, most: int = PROJECTION) -> DataFrame:
    """(code, w1.., n): phrases of two words or more that occur `least` times or more, from pointers(). A prefix is one task's work."""
    hot = split_prefixes(rows, scratch, most)
    dealt, deal = rows, F.lit(0).cast("long")
    for k, table in enumerate(hot, 1):
        on = ["code", *_WORDS[:k]]
        dealt = dealt.join(F.broadcast(table.select(*on, F.lit(True).alias(f"hot{k}"))), on, "left")
        # a split prefix is dealt out by its next word
        deal = F.when(F.col(f"hot{k}"), F.xxhash64(*_WORDS[: k + 1])).otherwise(deal)
    dealt = dealt.select("code", F.xxhash64("code", "w1", deal).alias("task"), *_WORDS, "n")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "code", *_WORDS)
    schema = pa.schema([("code", pa.int64()), *((w, pa.int64()) for w in _WORDS), ("n", pa.int64())])

    def projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole projections: the last one of a batch may go on in the next."""
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            task = held.column("task").to_numpy()
            last = int(np.searchsorted(task == task[-1], True)) if len(task) else 0
            if last:
                yield held.slice(0, last)
                held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in projections(batches):
            cols = {c: table.column(c).to_numpy() for c in table.column_names}
            words = np.stack([cols[w] for w in _WORDS], axis=1)
            edge = np.flatnonzero((cols["task"][1:] != cols["task"][:-1]) | (cols["code"][1:] != cols["code"][:-1])) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *edge], [*edge, len(words)], strict=True):
                found: list[tuple] = []
                grow(words[lo:hi], cols["n"][lo:hi], least, 0, (), found)
                out += [(int(cols["code"][lo]), *p, *[0] * (MAX_WORDS - len(p)), n) for p, n in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    grown = dealt.mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))
    # the tasks of a split prefix of two words or more see parts of it: it has its count from the split
    for k, table in enumerate(hot[1:], 2):
        on, rest = ["code", *_WORDS[:k]], [F.lit(0).cast("long").alias(w) for w in _WORDS[k:]]
        grown = grown.join(F.broadcast(table.select(*on, *rest)), ["code", *_WORDS], "left_anti")
        grown = grown.unionByName(table.where(F.col("n") >= least).select(*on, *rest, "n"))
    return grown


def _key(words: list[Column]) -> list[Column]:
    none = F.lit(0).cast("long")
    return [(words[k] if k < len(words) else none).alias(w) for k, w in enumerate(_WORDS)]


def _parts(phrases: DataFrame, of: list[tuple[int, int, int]]) -> DataFrame:
    """Explodes phrases into the parts (words of the phrase, first word, end) of `of`: adds part, with fields w1.., lo, hi."""
    length = sum((F.col(w) != 0).cast("int") for w in _WORDS)
    parts = F.array(*[F.when(length == m, F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), *_key([F.col(w) for w in _WORDS[a:b]]))) for m, a, b in of])
    return phrases.withColumn("part", F.explode(F.filter(parts, lambda p: p.isNotNull())))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases (code, w1.., n) with l, r and score of their weakest cut. Every part of a phrase is itself a phrase or a word."""
    counts = phrases.select("code", *_WORDS, "n").unionByName(words.select("code", F.col("h").alias("w1"), *[F.lit(0).cast("long").alias(w) for w in _WORDS[1:]], "n"))
    sides = _parts(phrases, [(m, a, b) for m in range(2, MAX_WORDS + 1) for k in range(1, m) for a, b in ((0, k), (k, m))])
    sides = sides.select("code", *[F.col(w).alias(f"p{w}") for w in _WORDS], F.col("n").alias("a"), F.col("part.lo").alias("lo"), F.col("part.hi").alias("hi"), *[F.col(f"part.{w}").alias(w) for w in _WORDS])
    sides = sides.join(counts, ["code", *_WORDS])
    phrase = [f"p{w}" for w in _WORDS]
    by_phrase = sides.groupBy("code", *phrase, "a").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("sides"))  # six rows at most
    count = lambda of: F.get(F.filter("sides", of), 0)["n"]
    left = lambda k: count(lambda s: (s["lo"] == 0) & (s["hi"] == k))
    right = lambda k: count(lambda s: s["lo"] == k)
    cuts = [F.struct(F.lit(k).alias("k"), left(k).alias("l"), right(k).alias("r")) for k in range(1, MAX_WORDS)]
    exact = lambda c: c.cast("decimal(20,0)")
    cut = by_phrase.withColumn("cut", F.explode(F.filter(F.array(*cuts), lambda c: c["l"].isNotNull() & c["r"].isNotNull())))
    cut = cut.select("code", *phrase, "a", F.col("cut.k").alias("k"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"))
    # a product of 64-bit numbers: integral division of decimals is exact
    cut = cut.withColumn("score", F.call_function("div", exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), exact(F.col("l")) + exact(F.col("r"))))
    best = cut.groupBy("code", *phrase, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("code", *[F.col(p).alias(w) for p, w in zip(phrase, _WORDS, strict=True)], "a", "cut.l", "cut.r", "cut.score")


def covered(phrases: DataFrame, percent: int = COVERED) -> DataFrame:
    """(code, w1..) of the phrases inside a longer one that has at least `percent` of their count."""
    inner = _parts(phrases, [(m, a, b) for m in range(3, MAX_WORDS + 1) for a in range(m) for b in range(a + 2, m + 1) if b - a < m])
    most = inner.select("code", *[F.col(f"part.{w}").alias(w) for w in _WORDS], "n").groupBy("code", *_WORDS).agg(F.max("n").alias("longer"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    return most.join(phrases, ["code", *_WORDS]).where(exact("longer") * F.lit(100) >= exact("n") * F.lit(percent)).select("code", *_WORDS)


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT, top: int = TOP, most: int = PROJECTION) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score; numbers are long.

    Null text counts as empty, null lang as `und`. Texts are counted whole, whatever their length; a row that repeats another
    counts again; ties in score and count are ranked by phrase, in order of bytes. Extra columns are ignored, whatever their
    names; an empty table gives an empty one.
    """
    scratch, texts = Scratch(docs.sparkSession, "phrases"), _texts(docs, lang_col, text_col)
    for multiplier in MULTIPLIERS:
        words = scratch.put(count_words(texts, multiplier), "words")
        if words.groupBy("code", "h").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
            break
        scratch.drop(words)
    else:
        raise RuntimeError("two words share a hash with every multiplier")
    pairs = scratch.put(count_pairs(texts, multiplier).where(F.col("n") >= least).select("pair"), "pairs")
    rows = scratch.put(pointers(texts, multiplier, bitmap(pairs)), "pointers")
    phrases = scratch.put(frequent_phrases(rows, scratch, least, most), "phrases")
    scratch.drop(pairs, rows)
    kept = scored(phrases, words.where(F.col("n") >= least)).join(covered(phrases), ["code", *_WORDS], "left_anti")
    kept = scratch.put(kept, "kept")
    # the last row's score and count first, so that names are looked up for rows that may be returned only
    order = [F.col("score").desc(), F.col("a").desc()]
    first = kept.select("code", "score", "a", F.row_number().over(Window.partitionBy("code").orderBy(*order)).alias("rank")).where(F.col("rank") <= top)
    least_kept = first.groupBy("code").agg(F.min(F.struct("score", "a")).alias("last"))
    named = kept.join(least_kept, "code").where(F.struct("score", "a") >= F.col("last")).drop("last")
    placed = named.select("*", F.posexplode(F.filter(F.array(*_WORDS), lambda w: w != 0)).alias("pos", "h")).join(words.select("code", "h", "word"), ["code", "h"])
    spelled = placed.groupBy("code", *_WORDS, "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("code").agg(F.any_value("lang").alias("lang"), F.sum("n").alias("n"))
    ranked = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(*order, F.col("phrase"))).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "code").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

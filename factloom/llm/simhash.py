"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

A fingerprint is 8 bytes. Two fingerprints that differ in at most 3 bits differ in at most 3 bytes, so they share at
least 5 positional bytes: the guaranteed minimum. The index posts a fingerprint under its bytes at k positions, for every
choice of k of the 8 positions. k is the least number for which a list of unlike fingerprints stays short (1 for a few dozen
fingerprints, 3 for millions): what is counted doesn't depend on it. A pair gets the positions of each list in which it
meets; their tally over all lists is the number of positional bytes that it shares. Pairs whose tally is 5 or more are
retained and verified by bit count.

A list that is long all the same is split by every further position, up to 5, and a pair that shares 5 bytes meets in
some list on each way down; what is still long then is compared in blocks, from which only a spanning forest of the links
comes back. Equal fingerprints are one node, so a group of copies of any size costs one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import map_column, text_or_empty
from factloom.operators.graph import connected_components
from factloom.scratch import Scratch

BITS, REACH, WORDS = 64, 3, 3
#: Guaranteed shared bytes; fingerprints that a posting list may hold before it is split; rows of a compared block; fingerprints
#: for each possible value of a posting at most.
SHARED, LIST_ROWS, BLOCK_ROWS, LOAD = 8 - REACH, 32, 2048, 0.25
_WEIGHTS = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, n: int = WORDS) -> int:
    """Unsigned 64-bit SimHash: A-Z in lower case, words between ASCII white space, n-word shingles with repeats (fewer
    words: the whole sequence; none: zero), XXH64 with seed 42; a bit is 1 if set in over half the hashes."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(b" ".join(words), 42)
    ones, total, step = np.zeros(64, np.int64), len(words) - n + 1, 65_536
    for at in range(0, total, step):
        grams = zip(*(words[at + k : min(at + step, total) + k] for k in range(n)))
        h = np.array([digest(b" ".join(g), 42) for g in grams], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > total].sum(dtype=np.uint64))


def fingerprint_column(rows: DataFrame, text: str, keep: list[str], n: int = WORDS) -> DataFrame:
    """The columns in keep (numbers) and fp (signed 64-bit)."""

    def run(texts: list[str]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t, n) for t in texts], "<u8").view("<i8")}

    return map_column(rows, text, run, "".join(f"{c} long, " for c in keep) + "fp long", keep=keep)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """id, fp (signed 64-bit) for every row; null text: empty."""
    return fingerprint_column(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")), "text", ["id"], n)


def _pack(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(255 << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _choices(k: int) -> list[tuple[int, ...]]:
    return [*combinations(range(8), k)]


def _posted(rows: DataFrame, k: int) -> DataFrame:
    """Postings (list, value, fp) of the rows (fp, lists): lists has the places of the choices of k positions to post under."""
    packed = F.array(*[_pack(F.col("fp"), c) for c in _choices(k)])
    return rows.select("fp", packed.alias("packed"), F.explode("lists").alias("list")).select("list", F.get("packed", F.col("list")).alias("value"), "fp")


def _sized(postings: DataFrame) -> DataFrame:
    """The postings of lists of two or more, with the size n of their list. Spark sizes postings as the fingerprints that they are exploded from, up to 70
    times too low, and would broadcast them: a hint tells it to shuffle both."""
    sizes = postings.groupBy("list", "value").agg(F.count("*").alias("n")).where("n > 1")
    return postings.join(sizes.hint("merge"), ["list", "value"])


def _met(postings: DataFrame, k: int) -> DataFrame:
    """(a, b, positions): pairs that meet in a short list, with its positions as bits; at most LIST_ROWS / 2 a posting."""
    masks = F.array(*[F.lit(sum(1 << p for p in c)) for c in _choices(k)])
    a, b = postings.select("list", "value", F.col("fp").alias("a")), postings.select("list", "value", F.col("fp").alias("b"))
    return a.join(b, ["list", "value"]).where("a < b").select("a", "b", F.get(masks, F.col("list")).alias("positions"))


def _deeper(long: DataFrame, k: int) -> DataFrame:
    """(fp, lists): for each fingerprint of a long list of k positions, the choices that add one position."""
    place = {c: i for i, c in enumerate(_choices(k + 1))}
    more = F.array(*[F.array(*[F.lit(place[tuple(sorted((*c, q)))]) for q in range(8) if q not in c]) for c in _choices(k)])
    return long.select("fp", F.explode(F.get(more, F.col("list"))).alias("x")).distinct().select("fp", F.array("x").alias("lists"))


def tallied(met: DataFrame) -> DataFrame:
    """Pairs (a, b) whose lists have the guaranteed minimum of shared positional bytes."""
    shared = met.groupBy("a", "b").agg(F.bit_or("positions").alias("positions"))
    return shared.where(F.bit_count("positions") >= SHARED).select("a", "b")


def verified(pairs: DataFrame, reach: int = REACH) -> DataFrame:
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= reach)


def block_links(pdf: pd.DataFrame, reach: int = REACH) -> pd.DataFrame:
    """Links of a spanning forest among the fingerprints of one pair of blocks (side 0 against side 1, or one block
    against itself), comparing all of them in strips of bounded memory."""
    left, right = (np.unique(pdf.loc[pdf["side"] == s, "fp"].to_numpy(np.int64)) for s in (0, 1))
    same = not len(right)
    right = left if same else right
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, len(left), 256):
        strip = left[at : at + 256]
        d = np.bitwise_count((strip[:, None] ^ right[None, :]).view(np.uint64))
        for i, j in zip(*np.nonzero(d <= reach), strict=True):
            a, b = int(strip[i]), int(right[j])
            if a != b and (ra := find(a)) != (rb := find(b)):
                root[ra] = rb
                out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"])


def _blocks(postings: DataFrame, block_rows: int) -> DataFrame:
    """Links of long lists: fingerprints are dealt to n / block_rows blocks, every pair of blocks is one group."""
    p = postings.withColumn("m", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("k", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    p = p.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    p = p.select("list", "value", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), F.when(F.col("k") <= F.col("o"), 0).otherwise(1).alias("side"), "fp")
    return p.groupBy("list", "value", "i", "j").applyInPandas(lambda block: block_links(block), "a long, b long")


def links(nodes: DataFrame, scratch: Scratch, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect everything within REACH bits. nodes: distinct fp."""
    total, k = nodes.count(), 1
    while k < SHARED and total > LOAD * 256**k:
        k += 1
    rows, met = nodes.select("fp", F.array(*[F.lit(i) for i in range(len(_choices(k)))]).alias("lists")), None
    while True:
        postings = scratch.put(_sized(_posted(rows, k)), "postings")
        short = _met(postings.where(F.col("n") <= list_rows), k)
        met = short if met is None else met.unionByName(short)
        long = postings.where(F.col("n") > list_rows)
        if k == SHARED or long.isEmpty():
            break
        rows, k = _deeper(long, k), k + 1
    # the lists that are left have the guaranteed positions in common
    return verified(tallied(met).unionByName(_blocks(long, block_rows))).distinct()


def fingerprint_classes(nodes: DataFrame, scratch: Scratch, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, component) of the fingerprints that another one is within reach of. nodes: distinct fp."""
    return connected_components(links(nodes, scratch, list_rows, block_rows), "a", "b").withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, fp (signed), component_id (smallest id reachable, itself included).

    Documents link when their fingerprints differ in at most REACH bits; empty texts have fingerprint zero and link like
    others. Null text counts as empty; very long texts are read whole; a null id never names a component (a component of null
    ids alone has null); repeated rows link like copies; extra columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash", small=True)
    fps = scratch.put(fingerprints(docs, id_col, text_col, n), "fingerprints")
    nodes = scratch.put(fps.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    parts = fingerprint_classes(nodes.select("fp"), scratch, list_rows, block_rows)
    labelled = nodes.join(parts, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    lowest = labelled.groupBy("c").agg(F.min("low").alias("component_id"))
    final = scratch.put(labelled.join(lowest, "c").select("fp", "component_id"), "classes")
    # the caller's settings hold here; a file of fingerprints is several times smaller than its rows
    return fps.join(final.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")

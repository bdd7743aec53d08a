"""Packing in the order of a space-filling curve: documents that are alike become neighbours in a sequence.

A document's vector counts its hashed four-byte grams in DIMENSIONS cells (square roots of the counts, unit length). A fixed random
matrix projects it to AXES numbers, a grid cell; the cell's place on the Hilbert curve is the document's key. Rows are sorted by
range of (key, text, id), so copies are neighbours and a key that many rows share is parted by text and id. The tokens of all documents in
that order are one long line that is cut every `capacity` tokens: a document's place on it is its place in its task plus the tokens of the
tasks before, one number a task. So no sequence but the last is short, whatever the number of tasks, and the last one is cut at
powers of two, at which nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import CHUNK_ROWS, chunks, map_column, text_or_empty
from factloom.llm.packing import tokenizer
from factloom.scratch import Scratch

#: Tokens of a sequence, the id that ends a document; cells of a document's vector, axes and bits an axis of the curve, and the range of a
#: projection that the grid covers; seed of the projection.
CAPACITY, END_ID, DIMENSIONS, AXES, BITS, REACH, SEED = 2048, 1, 4096, 4, 12, 3.0, 20
#: Bytes of a text that are counted at a time.
STEP = 1 << 20


@lru_cache(maxsize=4)
def _matrix(dimensions: int, axes: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, axes))


def document_vector(text: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Square roots of the counts of hashed four-byte grams, of unit length; shorter texts: all zero."""
    counts, shift = np.zeros(dimensions), np.uint32(32 - (dimensions.bit_length() - 1))
    for at in range(0, max(len(text) - 3, 0), STEP):
        part = np.frombuffer(text, np.uint8, min(STEP + 3, len(text) - at), at)
        n = len(part) - 3
        grams = np.empty(n, np.uint32)
        for k in range(4):  # the grams that begin at k, k + 4, ..
            grams[k::4] = part[k : k + (n - k + 3) // 4 * 4].view("<u4")
        counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> shift, minlength=dimensions)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def grid(vectors: np.ndarray, axes: int = AXES, bits: int = BITS) -> np.ndarray:
    """Cells (a row a vector) of the projections."""
    projected = vectors @ _matrix(vectors.shape[1], axes)
    return np.clip((projected / REACH + 1) * (1 << (bits - 1)), 0, (1 << bits) - 1).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of cells (a row a cell, a column an axis), by Skilling's transposition: neighbours on the curve are
    neighbours in the grid."""
    x = [c.copy() for c in cells.T]
    n = len(x)
    # undo the rotations and reflections of the levels, the coarsest first
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in x:
            flip = (axis >> level & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            if axis is x[0]:
                x[0] ^= np.where(flip, low, 0)
            else:
                x[0] ^= np.where(flip, low, swap)
                axis ^= swap
    # Gray code
    for k in range(1, n):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> level & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    return hilbert_key(grid(np.stack([document_vector(t.encode("utf-8", "surrogatepass")) for t in texts])))


def curve_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key) dealt by range of the curve and sorted within tasks, so that the tasks' rows follow each other along it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    keyed = map_column(rows, "text", lambda texts: {"key": curve_keys(texts).tolist()}, "id long, text string, row long, key long", ["id", "text", "row"])
    order = ["key", "tie", "id", "row"]
    return keyed.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", "key")


def token_line(ordered: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, key, task, before, length, ids): of each row its ids and how many the rows before it in its task have."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("task", pa.int32()), ("before", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, before = tokenizer().encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_ROWS):
                ids = [np.array([*encode(t), end_id], "<u4") for t in part.column(1).to_pylist()]
                lengths = np.array([len(x) for x in ids], np.int64)
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([task] * len(ids), pa.int32()), pa.array(starts), pa.array(lengths), pa.array([x.tobytes() for x in ids], pa.binary())], schema=schema)

    return ordered.mapInArrow(run, "doc_id long, key long, task int, before long, length long, ids binary")


def tail_cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """Places at which the sequences after the last full one begin, and the end: their lengths are falling powers of two."""
    left, at, cuts = total % capacity, total - total % capacity, []
    while left:
        cuts.append(at)
        step = 1 << (left.bit_length() - 1)
        at, left = at + step, left - step
    return [*cuts, total]


def cut_line(line: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of token_line()'s rows, read from a written table."""
    tasks = line.groupBy("task").agg(F.sum("length").alias("n"))  # a row a task
    order = Window.orderBy("task")
    tasks = tasks.select("task", (F.sum("n").over(order) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy()).alias("total"))
    total = (tasks.agg(F.max("total")).first() or [None])[0] or 0
    full, cuts = total // capacity, tail_cuts(total, capacity)
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.col("first") + F.col("before")

    def sequence(p: Column) -> Column:
        tail = sum((F.when(p >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(-1))
        return F.when(p < full * capacity, F.floor(p / capacity)).otherwise(full + tail).cast("long")

    def edge(s: Column) -> Column:
        return F.when(s <= full, s * capacity).otherwise(F.get(edges, (s - full).cast("int")))

    placed = line.join(F.broadcast(tasks.select("task", "first")), "task").withColumn("at", at)
    pieces = placed.withColumn("sequence_id", F.explode(F.sequence(sequence(F.col("at")), sequence(F.col("at") + F.col("length") - 1))))
    pieces = pieces.withColumn("from", F.greatest("at", edge(F.col("sequence_id")))).withColumn("to", F.least(F.col("at") + F.col("length"), edge(F.col("sequence_id") + 1)))
    start, n = F.col("from") - F.col("at"), F.col("to") - F.col("from")
    ids = F.substr("ids", (start * 4 + 1).cast("int"), (n * 4).cast("int"))
    return pieces.select("doc_id", start.alias("start"), n.alias("length"), ids.alias("ids"), F.col("length").alias("doc_tokens"), "sequence_id", (F.col("from") - edge(F.col("sequence_id"))).alias("offset"))


def pack_along_curve(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every document is whole, in one sequence or in consecutive ones; no sequence is padded: all have `capacity` tokens but the
    last few, which have falling powers of two. Null text is empty (its end id alone); null ids are carried; repeated rows are packed
    each; long texts run over as many sequences as they need; extra columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "curve-packing")
    return cut_line(scratch.put(token_line(curve_order(docs, id_col, text_col)), "line"), capacity)

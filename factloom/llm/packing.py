"""Best-fit packing of tokenised documents into sequences, bounded in space and online.

A task packs the pieces of its partition in the order in which they come. A fixed number of bins is open at a time. A
bitset has a bit for every free space that some open bin has; the smallest set bit at or above a piece's length
is the best fit. When a new bin would exceed the limit, the fullest open bin closes first. A task holds the pieces of its open bins
only: what is in a bin goes out when the bin closes.

Bins that are open when a partition ends are no sequences yet. Their pieces are packed again, those of FAN_IN tasks by one
task, until one task is left: so the number of badly filled sequences doesn't grow with the number of tasks. That last task gets
the pieces of FAN_IN * OPEN_BINS bins at most and may keep as many open; it takes the longest first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import CHUNK_ROWS, chunks, text_or_empty
from factloom.scratch import Scratch

#: Bins that may be open at once in a task, tasks whose left-over pieces one task packs again, the tokens of a sequence, and the id
#: that ends a document.
OPEN_BINS, FAN_IN, CAPACITY, END_ID = 256, 16, 1024, 2


#: White space as the tokenizer's pattern knows it, in runs that its engine may not be able to hold.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


class Tokenizer:
    """Ids that the tokenizers library gives by the vocabulary file `name`, without special tokens added but with those in a text
    recognised. They are computed by tiktoken from the same vocabulary as ranks, in a fifth of the time whatever the text (the
    tests compare the two)."""

    def __init__(self, name: str, ranks: str):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer as Library

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(ranks), "rb"))}
        special = {t.content: i for i, t in Library.from_file(P.path(name)).get_added_tokens_decoder().items()}
        self.special = tuple(special)
        self.encoding = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens=special)

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode(text, allowed_special="all")
        except ValueError:  # its pattern gives up on very long runs of white space
            return self._in_parts(text)

    def _in_parts(self, text: str) -> list[int]:
        """The same ids, with every long run of white space taken out before the pattern sees the text. The pattern makes one word of a run, but
        leaves its last character to what follows, if anything but a special token does."""
        ids, at = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end()
            alone = end == len(text) or text.startswith(self.special, end)
            stop = end if alone else end - 1
            ids += self.encoding.encode(text[at : run.start()], allowed_special="all")
            ids += self.encoding._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self.encoding.encode(text[at:], allowed_special="all")


@lru_cache(maxsize=2)
def tokenizer(name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> Tokenizer:
    return Tokenizer(name, ranks)


class BestFit:
    """Online best fit with at most `open_bins` open bins. place() returns the bin of an item; closed bins are final. `closed` has
    the bins that have closed, until the caller clears it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.bits = 0  #: bit f is set if some open bin has free space f
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0
        self.closed: list[int] = []

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset)."""
        if not 0 < length <= self.capacity:
            raise ValueError(f"item of {length} in bins of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append(self._take(fullest))
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(b)
        return b, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        b = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b


PIECE = "doc_id long, piece int, start long, length long, ids binary"
PLACED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else pieces of `capacity`, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
                 name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit). Null text: empty, a piece
    with the end id alone."""
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(name, ranks).encode
        for batch in batches:
            for part in chunks(batch, "text"):
                rows: list[tuple] = []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(t), end_id], "<u4")
                    rows += [(i, k, s, n, ids[s : s + n].tobytes()) for k, (s, n) in enumerate(cut(len(ids), capacity))]
                yield _batch(rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, PIECE)


def _packed(pieces: DataFrame, capacity: int, open_bins: int, level: int, last: bool) -> DataFrame:
    """Adds sequence_id, offset, task, and `open`: whether the sequence's bin was still open at the end of the partition. With `last`
    such bins count as closed."""
    schema = pa.schema([*FIELDS, ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("task", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        bins, base, held, out = BestFit(capacity, open_bins), (level << 57) + (task << 33), {}, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, offset = bins.place(row[3])
                held.setdefault(b, []).append((*row, base + b, offset, False, task))
                for c in bins.closed:
                    out += held.pop(c)
                bins.closed.clear()
                if len(out) >= CHUNK_ROWS:
                    yield _batch(out, schema)
                    out = []
        out += [(*row[:7], not last, task) for rows in held.values() for row in rows]
        for at in range(0, len(out), CHUNK_ROWS):
            yield _batch(out[at : at + CHUNK_ROWS], schema)

    return pieces.select("doc_id", "piece", "start", "length", "ids").mapInArrow(run, PLACED + ", open boolean, task int")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to token_pieces()' rows. Each level is written to the shared folder, so sequences are final once
    written, whatever executors are lost later."""
    scratch = Scratch(pieces.sparkSession, "packing")
    # pieces of open and of closed bins are files of their own, so that a level reads what is open only
    placed, level, done = scratch.put(_packed(pieces, capacity, open_bins, 0, False), "placed", "open"), 0, []
    while (tasks := placed.where("open").agg(F.count_distinct("task")).first()[0]) > 0:
        done.append(placed.where("not open"))
        level, n = level + 1, -(-tasks // fan_in)
        first = F.col("length").desc() if n == 1 else F.xxhash64("doc_id", "start", "task")
        left = placed.where("open").coalesce(n).sortWithinPartitions(first, "doc_id", "start", "ids")
        placed = scratch.put(_packed(left, capacity, open_bins * (fan_in if n == 1 else 1), level, last=n == 1), "placed", "open")
    out = placed
    for part in done:
        out = out.unionByName(part)
    return out.drop("open", "task")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_pieces() then pack(): every document whole in one sequence, or cut where longer than a sequence, however long the text
    is. Ties between bins go to the bin that was filled last. Repeated rows are packed each; null ids are carried; null text
    is empty; extra columns are ignored; an empty table gives an empty one."""
    return pack(token_pieces(docs, id_col, text_col, capacity), capacity, open_bins)

"""Encoding and decoding with a merge-type piece model (sentencepiece's BPE kind).

A text is encoded without a merge queue. For every prefix there is exactly one token that can end its encoding; a
table holds it. The candidates for a prefix are the vocabulary entries that end there, found by an automaton; the one
that belongs there is the one that is compatible with the last token of the prefix before it, i.e. whose pair with
that token is the encoding of their joined text. Ids are then read off backwards from the end of the text.
Time is linear in the text, however long a word is.

Pieces never hold a space mark after another character (checked when a model is loaded), so no merge crosses the
place before a space mark: words are independent, and each executor process keeps a bounded memo of encoded words.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import map_column, text_or_empty

SPACE = "▁"
#: Entries of the per-process memos of words and of pair tests; they are emptied when full.
MEMO_WORDS, MEMO_PAIRS = 1_000_000, 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        shift += 7
        if b < 128:
            return out, at


def _fields(data: bytes):
    """(number, value) of a serialised protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    def __init__(self, path: str):
        pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normal: dict[int, object] = {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type model")
        if normal.get(2) or normal.get(4, 1) and normal.get(1, b"identity") != b"identity":
            raise ValueError("the model normalises text; only identity is supported")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.eos = next(i for i, (p, _, k) in enumerate(pieces) if k == CONTROL and p == "</s>")
        self.unk = next(i for i, k in enumerate(self.kinds) if k == UNKNOWN)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(k in (USER, UNUSED) for k in self.kinds) or len(self.bytes) != 256:
            raise ValueError("only models with byte fallback and without user-defined pieces are supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words")
        self.rank = {i: -s for (p, s, k), i in zip(pieces, range(len(pieces)), strict=True) if k == NORMAL}
        self.chars = {c for p in self.ids for c in p}
        if not all(c in self.ids for c in self.chars):
            raise ValueError("a character of a piece is no piece")
        #: Only tokens that are their own encoding can occur in an encoding.
        automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or self.merge(p) == [i]:
                automaton.add_word(p, (len(p), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        #: Text of an id that stands for itself whatever is beside it; None for others.
        self.plain = [p if k == NORMAL else chr(int(p[3:5], 16)) if k == BYTE and p < "<0x80>" else None for p, _, k in pieces]
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[int]:
        """Encoding of a short text by merging the best pair, leftmost of equals, again and again: the definition.
        Used on single tokens and pairs of tokens alone."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            out = self.pairs[key] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return out

    def encode_run(self, run: str) -> list[int]:
        """Encoding of a run of characters that are all pieces: fill the prefix table, then walk it backwards. The automaton
        gives the matches that end at a place longest first; the one that is compatible is the only one."""
        n = len(run)
        last, size = [0] * n, [0] * n
        settled, pairs = -1, self.pairs
        for end, (length, token) in self.automaton.iter(run):
            if end == settled:
                continue
            before = end - length
            if before >= 0:
                left = last[before]
                fits = pairs.get(left << 20 | token)
                if fits is None:
                    fits = self.compatible(left, token)
                if not fits:
                    continue
            last[end], size[end] = token, length
            settled = end
        out, pos = [], n - 1
        while pos >= 0:
            out.append(last[pos])
            pos -= size[pos]
        out.reverse()
        return out

    def encode_word(self, word: str) -> list[int]:
        """Runs of known characters by the prefix table, other characters as bytes."""
        if self.chars.issuperset(word):
            return self.encode_run(word)
        out: list[int] = []
        begin = 0
        for k, c in enumerate(word):
            if c not in self.chars:
                if begin < k:
                    out += self.encode_run(word[begin:k])
                out += [self.bytes[b] for b in c.encode()]
                begin = k + 1
        if begin < len(word):
            out += self.encode_run(word[begin:])
        return out

    def split(self, text: str) -> list[str]:
        """Words, each beginning with all its space marks."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if self.dummy_prefix:
            marked = SPACE + marked
        out: list[str] = []
        lead = ""
        pieces = marked.split(SPACE)
        if pieces[0]:
            out.append(pieces[0])
        for p in pieces[1:]:
            lead += SPACE
            if p:
                out.append(lead + p)
                lead = ""
        if lead:
            out.append(lead)
        return out

    def recall(self, word: str) -> tuple[int, ...]:
        """Encoding of a word, by way of the memo. The memo has two generations: when the younger is full, the older goes, so
        words in use stay."""
        got = self.words.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = tuple(self.encode_word(SPACE + word if self.dummy_prefix else word))
            if len(word) <= 64:
                if len(self.words) >= MEMO_WORDS // 2:
                    self.older, self.words = self.words, {}
                self.words[word] = got
        return got

    def encode(self, text: str, end: bool = True) -> list[int]:
        if self.dummy_prefix and text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            plain = text.split(" ")  # each word has one space mark before it
            found = list(map(self.words.get, plain))
            ids = list(chain.from_iterable([self.recall(w) if g is None else g for w, g in zip(plain, found)]))
        else:
            ids = [i for w in self.split(text) for i in self.encode_word(w)]
        if end:
            ids.append(self.eos)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, space marks as spaces, the dummy prefix taken off; bytes as UTF-8, invalid ones as U+FFFD;
        control ids give nothing."""
        whole = ids[:-1] if ids and ids[-1] == self.eos else ids
        try:
            out = "".join([self.plain[i] for i in whole])  # nothing but pieces and ASCII bytes
        except TypeError:
            return self.decode_any(ids)
        if whole and self.dummy_prefix and self.kinds[whole[0]] == NORMAL and out.startswith(SPACE):
            out = out[1:]
        return out.replace(SPACE, " ")

    def decode_any(self, ids: list[int]) -> str:
        out: list[str] = []
        pending = bytearray()
        first = True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if pending:
                out.append(_utf8(bytes(pending)))
                pending.clear()
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(" ⁇ ")
                first = False
                continue
            p = self.pieces[i]
            if first and self.dummy_prefix and p.startswith(SPACE):
                p = p[1:]
            first = False
            out.append(p)
        if pending:
            out.append(_utf8(bytes(pending)))
        return "".join(out).replace(SPACE, " ")


def _utf8(data: bytes) -> str:
    """UTF-8 to text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def _path(model: str) -> str:
    import public_tokenizers

    return model if "/" in model else public_tokenizers.path(model)


def encode_column(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array<int>): each whole text (null: empty) encoded with an end id only. `model` is a path, or the name
    of a public tokenizer file that every executor has. Row by row: repeated rows give repeated results, an empty
    table an empty one; extra columns are ignored, null ids carried. An empty text has the end id alone."""

    def encode(texts: list[str]) -> dict[str, list]:
        m = load(_path(model))
        return {"ids": [m.encode(t) for t in texts]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return map_column(rows, "text", encode, "id long, ids array<int>", keep=["id"])


def decode_column(encoded: DataFrame, model: str) -> DataFrame:
    """id, ids, decoded of encode_column()'s result. Null ids arrays count as empty."""

    def decode(arrays: list) -> dict[str, list]:
        m = load(_path(model))
        return {"decoded": [m.decode(a or []) for a in arrays]}

    return map_column(encoded.select("id", "ids"), "ids", decode, "id long, ids array<int>, decoded string", keep=["id", "ids"])


def recode_column(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, decoded: encode_column() and decode_column() in one pass, for callers that want both."""

    def recode(texts: list[str]) -> dict[str, list]:
        m = load(_path(model))
        ids = [m.encode(t) for t in texts]
        return {"ids": ids, "decoded": [m.decode(i) for i in ids]}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return map_column(rows, "text", recode, "id long, ids array<int>, decoded string", keep=["id"])

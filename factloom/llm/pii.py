"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of several kinds. Boosted trees score each from features of its
format and its context. A threshold for each kind, calibrated for precision on held-out rows, selects what is
redacted. Spans of the base patterns are always kept. Whole texts are scanned, in time linear in their length.

The trees are trained here on generated sentences (training_rows), never on the data they are applied to.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from factloom.llm.boosting import BoostedTrees
from factloom.llm.common import map_column, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
#: Precision that a kind's threshold must reach on held-out rows, and the number of generated training rows.
PRECISION, TRAINING_ROWS, SEED = 0.99, 12_000, 7
#: Characters before a span that its features see.
CONTEXT_CHARS = 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A possessive repeat gives what the plain one gives here, without its backtracking: digits can't be followed by a
# digit that the match leaves over, and a match never begins inside a run of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _HOST.match(text, at + 1)):
            out.append((begin, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1  # no match holds this sign, and none begins before it
            at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost non-overlapping for each kind, failing matches dropped."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(m[0]) and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


#: High-recall generators: a span may be proposed for several kinds. Repeats are possessive and every match takes a whole run, so that
#: the time is linear however long a run is; what must not follow a match stands in the third place. A group, where there is one, is
#: the span.
GENERATORS = [
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]++ ?(?:@|\[at\]|\(at\)) ?[\w-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[\w-]++)++"), None),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}+\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}+\)?)++"), re.compile(r"[\w-]")),
    ("card", re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]++"), re.compile(r"[\w-]")),
    ("id", re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})++(?: ?[A-Z0-9]{1,3}+)?)"), re.compile(r"[\w-]")),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]++"), re.compile(r"[\w]")),
    ("secret", re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{16,}+"), re.compile(r"[\w/+-]")),
    ("secret", re.compile(r"(?<![\w/+.-])eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2}"), re.compile(r"[\w/+-]")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|bearer)[\"']?(?: is|[ ]?[:=])[ ]?[\"']?([!-~]{6,}+)"), None),
]
#: What a text must hold for a generator to be worth running, in the order of the generators.
GUARDS = [re.compile(x) for x in (r"@|\[at\]|\(at\)", "[0-9]{2}", "[0-9]{4}", "[0-9]{2}", "[0-9A-Fa-f]:[0-9A-Fa-f:]", "[A-Za-z0-9_/+-]{16}", "eyJ", "(?i)passw|passphrase|pwd|secret|token|key|bearer")]
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "@"), "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "ring", "dial"),
    "card": ("card", "visa", "credit", "payment", "debit"), "id": ("ssn", "social", "iban", "account", "passport", "security number"),
    "ip": ("ip", "host", "server", "address", "login"), "secret": ("token", "secret", "password", "passwd", "api", "key", "bearer", "akia", "pwd"),
}
AGAINST = ("version", "order", "invoice", "page", "isbn", "chapter", "ticket", "part", "build", "year", "score", "commit", "checksum", "hash", "http", "file", "sha")
#: Beginnings of well-known access tokens. Fixed values.
TOKEN_PREFIXES = ("AKIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_")


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = set()
    for (kind, pattern, tail), guard in zip(GENERATORS, GUARDS, strict=True):
        if guard.search(text):
            for m in pattern.finditer(text):
                a, b = m.span(pattern.groups)
                if pattern.groups:
                    b -= len(text[a:b]) - len(text[a:b].rstrip("\"'.,;:)]}"))
                elif tail and tail.match(text, b):
                    continue
                if b > a and (kind == "email" or any("0" <= c <= "9" for c in text[a:b])):
                    out.add((a, b, kind))
    return sorted(out)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    # the context that counts: CONTEXT_CHARS before a span, 16 after it
    left, right = text[max(0, start - CONTEXT_CHARS) : start].lower(), text[end : end + 16].lower()
    n, digits = len(s), _digits(s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    near = left[-16:]
    groups = re.split(r"[ ./()-]+", s)
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n,
        sum(not c.isalnum() for c in s), len(groups), max(map(len, groups)), min(map(len, groups)), entropy, float(luhn(digits)) if len(digits) >= 12 else -1.0,
        *(float(any(w in left for w in CONTEXT[k])) for k in KINDS), float(any(w in near for w in CONTEXT[kind])), float(any(w in left for w in AGAINST)),
        float(left[-1:] in "=:\"'" and bool(left)), float(left.rstrip()[-1:] in ("#", "$", "€", "£", "v") if left.strip() else 0), float(right[:1] in "\"'"),
        float(s.startswith(TOKEN_PREFIXES)), float(s.startswith("eyJ") and s.count(".") == 2), float(bool(re.fullmatch("[0-9a-f]+", s))), float(s.count(":") == 7), float(any(w in right for w in CONTEXT[kind])), float(s.count("_") + s.count("-")), float(s[:1] == "("), float("@" in s), float(s.count("-")), float(s.count(".")), float("/" in s),
    ]


def training_rows(n: int = TRAINING_ROWS, seed: int = SEED) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label) of generated sentences: personal data in many formats and contexts, and look-alikes."""
    r = random.Random(seed)
    syll = ["er", "the", "an", "in", "on", "ti", "re", "ha", "de", "la", "que", "ment", "sch", "ung", "do", "ra", "ly", "and", "st", "ou"]
    word = lambda: "".join(r.choice(syll) for _ in range(r.randint(1, 3)))
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    chars = lambda a, k: "".join(r.choice(a) for _ in range(k))

    def card(valid: bool) -> str:
        body = r.choice("3456") + digit(14)
        last = next(str(d) for d in range(10) if luhn(body + str(d)) == valid)
        s = body + last
        return r.choice([s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))])

    def positive(kind: str) -> tuple[str, str]:
        if kind == "email":
            host = [word(), r.choice(["com", "org", "net", "de", "fr"])]
            return r.choice(["mail ", "contact ", "write to ", "reach me: ", "email: "]), word() + r.choice([".", "_", ""]) + word() + r.choice([" [at] ", "(at)", " (at) ", "[at]"]) + r.choice([" [dot] ", "(dot)", "."]).join(host)
        if kind == "phone":
            return r.choice(["phone ", "tel: ", "call ", "mobile: ", "cell ", "fax ", "dial "]), r.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(digit(3), digit(3), digit(4))
        if kind == "card":
            return r.choice(["card ", "visa: ", "credit card number ", "payment ", "debit card "]), card(True)
        if kind == "id":
            return r.choice(["ssn ", "social security number: ", "iban: ", "account ", "passport "]), r.choice([f"{digit(3)}-{digit(2)}-{digit(4)}", r.choice(["DE", "FR", "ES", "GB"]) + digit(2) + " " + " ".join(digit(4) for _ in range(r.randint(3, 5)))])
        if kind == "ip":
            return r.choice(["ip ", "host ", "server ", "address ", "login from "]), ":".join(chars("0123456789abcdef", r.randint(1, 4)) for _ in range(8))
        return r.choice([('token = "', chars("0123456789abcdef", 40)), ("password=", chars("0123456789abcdef", r.randint(16, 24))), ("api key: ", chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 32)), ("", "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)), ("secret: ", chars("abcdefghijklmnopqrstuvwxyz0123456789_-", 24)),
            (r.choice(["password: ", "password=", "passwd: ", "pwd = "]), r.choice([word() + digit(r.randint(1, 4)) + word(), chars("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789!#$%", r.randint(7, 14)) + digit(1)])),
            (r.choice(["", "use ", "token "]), r.choice(["ghp_", "gho_", "glpat-", "sk_live_"]) + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 35) + digit(1)),
            (r.choice(["", "bearer ", "jwt "]), ".".join(x + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", r.randint(18, 60)) + digit(1) for x in ("eyJ", "eyJ", "")))])

    def negative(kind: str) -> tuple[str, str]:
        if kind == "email":
            return r.choice(["", "look ", "was "]), f"{word()} at {word()}{r.choice(['.', '. '])}{word()}"
        if kind == "phone":
            return r.choice(["order ", "", "page ", "version ", "between ", "invoice ", "on "]), r.choice([f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{digit(2)}/{digit(2)}/{digit(4)}", f"{r.randint(1900, 2020)}-{r.randint(1900, 2030)}", f"{digit(3)} {digit(3)}", f"{digit(2)}.{digit(2)}", f"{digit(3)}.{digit(3)}.{digit(3)}", f"({digit(3)}) {digit(3)}-{digit(4)}" if r.random() < 0.1 else f"{digit(4)} {digit(4)}"])
        if kind == "card":
            return r.choice(["order ", "invoice ", "isbn ", "ticket ", "", "part "]), r.choice([card(False), card(r.random() < 0.2)])
        if kind == "id":
            return r.choice(["part ", "order ", "", "ticket ", "build "]), r.choice([f"{digit(3)}-{digit(2)}-{digit(4)}", chars("ABCDEFGH", 2) + digit(14)])
        if kind == "ip":
            return r.choice(["", "at ", "score ", "from "]), r.choice([f"{digit(2)}:{digit(2)}:{digit(2)}", f"{digit(1)}:{digit(2)}:{digit(2)}", ":".join(digit(2) for _ in range(4))])
        return r.choice(["", "commit ", "checksum ", "file ", "http ", "the "]), r.choice([chars("0123456789abcdef", 40), chars("0123456789abcdef", 32), word() * 3 + "_" + word() * 3 + digit(1), word() + "-" * 14 + digit(2), "/".join(word() * 2 for _ in range(4)) + digit(2), digit(20), word().upper() * 5 + digit(2)])

    out = []
    while len(out) < n:
        kind, label = r.choice(KINDS), int(r.random() < 0.5)
        lead, s = (positive if label else negative)(kind)
        if r.random() < 0.15:
            lead = ""
            label = label and int(kind in ("email",) or s.startswith((*TOKEN_PREFIXES, "eyJ")) or s.count(":") == 7 or kind == "card" and luhn(_digits(s)))
        before, after = " ".join(word() for _ in range(r.randint(0, 6))), " ".join(word() for _ in range(r.randint(0, 6)))
        if label and not lead and r.random() < 0.3:
            after = f"{r.choice(CONTEXT[kind][:3])} {after}"
        text = f"{before} {lead}{s}{'\"' if lead.endswith('\"') else ''} {after}".strip()
        start = text.index(s)
        for a, b, k in candidates(text):
            if k == kind and a < start + len(s) and b > start:
                exact = (a, b) == (start, start + len(s))
                if label and not exact and start <= a and b <= start + len(s):
                    continue  # a part of what is personal is no example of what isn't
                out.append((text, a, b, k, int(label and (exact or b - a >= len(s)))))
    return out[:n]


@lru_cache(maxsize=1)
def trained() -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold: the lowest score above which held-out precision stays at PRECISION."""
    rows = training_rows()
    x = np.array([features(t, a, b, k) for t, a, b, k, _ in rows], float)
    y = np.array([r[4] for r in rows], float)
    held = np.arange(len(rows)) % 3 == 0
    model = BoostedTrees().fit(x[~held], y[~held])
    p = model.predict(x[held])
    thresholds = {}
    for j, kind in enumerate(KINDS):
        own = x[held][:, j] == 1
        order = np.argsort(-p[own])
        hits = y[held][own][order].cumsum() / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(hits >= PRECISION)
        thresholds[kind] = max(float(p[own][order][good[-1]]), 0.5) if len(good) else 2.0
    return model, thresholds


def find_spans(text: str, model: BoostedTrees, thresholds: dict[str, float]) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start, then kind. Accepted candidates are taken longest first, then best
    first; one that overlaps a base span or one already taken is left out."""
    base = base_spans(text)
    found = candidates(text)
    extra: list[tuple[int, int, str]] = []
    if found:
        covered = np.zeros(0)
        if base:
            starts, ends = np.array([s[0] for s in base]), np.maximum.accumulate(np.array([s[1] for s in base]))
            a, b = np.array([c[0] for c in found]), np.array([c[1] for c in found])
            k = np.searchsorted(starts, b, side="left") - 1
            covered = (k >= 0) & (ends[np.maximum(k, 0)] > a)
            found = [c for c, skip in zip(found, covered, strict=True) if not skip]
    if found:
        scores = model.predict(np.array([features(text, *c) for c in found], float))
        good = sorted((c[0] - c[1], -p, c) for p, c in zip(scores, found, strict=True) if p >= thresholds[c[2]])
        taken: list[tuple[int, int]] = []
        import bisect

        for _, _, (a, b, kind) in good:
            k = bisect.bisect_left(taken, (b,))
            if (k == 0 or taken[k - 1][1] <= a):
                bisect.insort(taken, (a, b))
                extra.append((a, b, kind))
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by [KIND]; overlapping ones become one, named after the first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Very long texts are scanned whole; of overlapping candidates of one length and score the first is taken.
    One row per input row: id, spans and base_spans (array<struct<start,end,kind>>, code points, end exclusive), and
    with with_text the redacted text. Null texts count as empty and have no spans. Repeated rows give repeated
    results; extra columns are ignored; null ids are carried; an empty table gives an empty one."""
    model, thresholds = trained()

    def run(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {"base_spans": [], "spans": [], "redacted": []}
        for t in texts:
            base, spans = find_spans(t, model, thresholds)
            out["base_spans"].append([{"start": a, "end": b, "kind": k} for a, b, k in base])
            out["spans"].append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            out["redacted"].append(redact(t, spans) if with_text else None)
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    kind = "array<struct<start:long,end:long,kind:string>>"
    return map_column(rows, "text", run, f"id long, base_spans {kind}, spans {kind}, redacted string", keep=["id"])


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input rows, columns and order of columns unchanged, with text_col redacted. Null texts stay null."""
    model, thresholds = trained()

    def run(texts: list) -> dict[str, list]:
        return {"redacted": [None if t is None else redact(t, find_spans(t, model, thresholds)[1]) for t in texts]}

    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select((F.struct(*others) if others else F.lit(0)).alias("rest"), F.col(text_col).alias("text"))
    out = map_column(rows, "text", run, f"rest {rows.schema['rest'].dataType.simpleString()}, redacted string", keep=["rest"])
    return out.select(*[F.col("redacted").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])

"""Text, token and JSON functions. Those that need a state machine are Arrow-batched pandas UDFs; the rest are Columns."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Characters a token where no exact tokenizer is at hand.
RATIO = 3.5


def token_count(text: Column, ratio: float = RATIO) -> Column:
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.floor(n / ratio) + 1).cast("long")


def truncate_to_budget(text: Column, budget: int, ratio: float = RATIO) -> Column:
    """The longest run of whole lines from the start whose token count fits."""
    lines = F.split(text, "\n")
    ends = F.aggregate(F.transform(lines, lambda s: F.char_length(s)), F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("at")),
                       lambda acc, n: F.struct(F.array_append(acc["out"], acc["at"] + 1 + n).alias("out"), (acc["at"] + 1 + n).alias("at")))["out"]
    fits = F.size(F.filter(ends, lambda e: (e == 0) | (F.floor(e / ratio) + 1 <= budget)))
    return F.array_join(F.slice(lines, F.lit(1), fits), "\n")


def budget_split(total: Column, ratios: dict[str, float], margin: float = 0.0) -> dict[str, Column]:
    usable = total * (1 - margin)
    return {k: F.floor(usable * r).cast("long") for k, r in ratios.items()}


def line_count(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")).cast("long")


def needs_review(text: Column, least: int = 20) -> Column:
    return line_count(text) >= least


def strip_sections(text: Column, tag: str = "think") -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", ""), r"^\s+|\s+$", "")


def strip_log_prefix(line: Column) -> Column:
    """A line without a leading `[..]` or `time level` prefix."""
    return F.regexp_replace(line, r"^(?:\[[^\]]*\]\s*|\d{2}:\d{2}:\d{2}\s+(?:[A-Z]+\s+)?)+", "")


def keywords(name: Column, return_type: Column | None = None, callees: Column | None = None) -> Column:
    """Distinct lower-case words of over two characters, sorted: the parts of a camel- or snake-case name and its numbers, the
    identifiers of a return type, the parts of the callees' names (an array)."""
    parts = lambda c, pattern: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 1)
    found = [parts(F.substring_index(name, "::", -1), "([A-Z][a-z]+|[a-z]+|[0-9]+)")]
    if return_type is not None:
        found.append(parts(return_type, "([A-Za-z_][A-Za-z0-9_]*)"))
    if callees is not None:
        found.append(F.flatten(F.transform(F.coalesce(callees, F.array().cast("array<string>")), lambda c: parts(F.substring_index(c, "::", -1), "([A-Z][a-z]+|[a-z]+)"))))
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(*found), lambda s: F.char_length(s) > 2), F.lower)))


def identifiers(code: Column) -> Column:
    """Identifiers that no call follows, over two characters, no keyword and not all capitals; distinct, sorted."""
    words = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_]\w*)\b(?!\s*\()"), 1))
    reserved = ["int", "for", "while", "return", "const", "void", "else", "switch", "case", "break", "auto", "bool", "char", "float", "double", "static", "struct", "class"]
    return F.array_sort(F.filter(words, lambda s: (F.char_length(s) > 2) & ~s.rlike("^[A-Z_0-9]+$") & ~s.isin(reserved)))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)


def edge_label(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.isin("yes", "true", "1", "y"), "Yes").when(low.isin("no", "false", "0", "n"), "No").otherwise(F.trim(label))


def comment_text(line: Column) -> Column:
    """Text of a trailing // comment, empty if none."""
    return F.trim(F.regexp_extract(line, r"//+[/!<]*(.*)$", 1))


def markdown_table(header: Column, rows: Column) -> Column:
    """header: array<string>; rows: array<array<string>>. A bar in a cell becomes a slash."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.translate(F.coalesce(c, F.lit("")), "|", "/")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(header), rule), F.transform(rows, line)), "\n")


def parse_markdown_table(text: Column) -> Column:
    """array<array<string>>: the header and the rows, without the rule line."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"^\s*\|") & ~s.rlike(r"^\s*\|[\s:|-]*-[\s:|-]*$"))
    return F.transform(lines, lambda s: F.transform(F.split(F.regexp_replace(F.trim(s), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def defined_macro(arg: Column) -> Column:
    return F.nullif(F.regexp_extract(arg, r"^-D([A-Za-z_]\w*)", 1), F.lit(""))


def struct_description(name: Column) -> Column:
    """A type's name as words."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"_t$", ""), r"([a-z0-9])([A-Z])", "$1 $2"), "_+", " ")
    return F.lower(F.trim(spaced))


# ---- sequential work ------------------------------------------------------------------------------------------------
SEGMENTS = T.ArrayType(T.StructType().add("text", T.StringType()).add("mark", T.StringType()))


def word_diff(old: str, new: str) -> list[dict[str, str]]:
    """Marked segments (same, removed, added) of two texts, compared word by word."""
    a, b = re.findall(r"\s+|\S+", old or ""), re.findall(r"\s+|\S+", new or "")
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out.append({"text": "".join(a[i:j]), "mark": "same"})
            continue
        if j > i:
            out.append({"text": "".join(a[i:j]), "mark": "removed"})
        if m > k:
            out.append({"text": "".join(b[k:m]), "mark": "added"})
    return out


@F.pandas_udf(SEGMENTS)
def word_segments(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([word_diff(a, b) for a, b in zip(old, new, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def merge_ids(old: pd.Series, new: pd.Series) -> pd.Series:
    """Order-preserving merge of two id sequences: what both have once, removed ones where they stood, added ones where
    they stand."""

    def one(a, b):
        a, b, out = list(a), list(b), []
        for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            out += a[i:j]
            if op != "equal":
                out += [x for x in b[k:m]]
        return list(dict.fromkeys(out))

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])


def first_json(text: str) -> str | None:
    """The first JSON object in a noisy text, in canonical form; code fences go; braces, brackets and a string that are open at the
    end are closed; null if nothing parses. Escaped characters don't end a string."""
    body = re.sub(r"```(?:json)?\s*", "", text or "")
    at = body.find("{")
    if at < 0:
        return None
    closers: list[str] = []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*("|$)|[{}\[\]]', body[at:], re.DOTALL):
        if m[0][0] == '"':
            if m[1] != '"':
                return _sound(body[at:] + '"' + "".join(reversed(closers)))
        elif m[0] in "{[":
            closers.append("}" if m[0] == "{" else "]")
        elif closers:
            closers.pop()
            if not closers:
                return _sound(body[at : at + m.end()])
    return _sound(body[at:].rstrip().rstrip(",") + "".join(reversed(closers)))


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _sound(text: str) -> str | None:
    text = repair(text)
    return json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False) if _parses(text) else None


def repair(text: str) -> str:
    """Smart quotes straightened and trailing commas dropped; where the text still isn't JSON, keys and values in single quotes get
    double ones. Apostrophes inside words and inside double quotes stay."""
    for change in (lambda t: t, lambda t: t.translate(str.maketrans("“”‘’", "\"\"''")), lambda t: re.sub(r",(\s*[}\]])", r"\1", t)):
        text = change(text)
        if _parses(text):
            return text
    pattern = r"""("(?:[^"\\]|\\.)*")|(?<=[{\[,:])(\s*)'([^'\\"]*)'(?=\s*[:,}\]])"""
    return re.sub(pattern, lambda m: m[1] or f'{m[2]}"{m[3]}"', text)


@F.pandas_udf(T.StringType())
def extract_json(text: pd.Series) -> pd.Series:
    return text.map(first_json)


@F.pandas_udf(T.StringType())
def repair_json(text: pd.Series) -> pd.Series:
    return text.map(repair)


def missing_keys(text: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks (all of them where the text is no object)."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.array_except(F.array(*map(F.lit, required)), keys)


def keep_keys(data: Column, wanted: list[str]) -> Column:
    return F.map_filter(data, lambda k, v: k.isin(wanted))


#: Entity codes of diagram labels; edges need fewer of them.
NODE_CODES = {";": "#59;", "&": "#38;", '"': "#quot;", "[": "#91;", "]": "#93;", "(": "#40;", ")": "#41;", "{": "#123;", "}": "#125;", "|": "#124;", "%": "#37;", "^": "#94;", "~": "#126;", "<": "#60;", ">": "#62;"}
EDGE_CODES = {c: code for c, code in NODE_CODES.items() if c not in "%^~"}


def _coded(text: Column, codes: dict[str, str]) -> Column:
    # the semicolon comes first, so that no code is coded again
    for c, code in codes.items():
        text = F.replace(text, F.lit(c), F.lit(code))
    return text


def escape_label(text: Column) -> Column:
    """Label of a diagram's node: unsafe characters as entity codes; <br/> stays and a line feed becomes one."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), r"<br ?/>|\n")
    return F.array_join(F.transform(lines, lambda s: _coded(s, NODE_CODES)), "<br/>")


def escape_edge_label(text: Column) -> Column:
    return _coded(F.coalesce(text, F.lit("")), EDGE_CODES)


def wrap_label(text: Column, width: int = 40) -> Column:
    """Words wrapped so that no line but one of a single longer word has over `width` characters; lines joined by <br/>."""
    words = lambda s: F.filter(F.split(s, r"\s+"), lambda w: w != "")

    def add(acc: Column, w: Column) -> Column:
        longer = F.concat_ws(" ", F.nullif(acc["line"], F.lit("")), w)
        full = (acc["line"] != "") & (F.char_length(longer) > width)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["line"])).otherwise(acc["done"]).alias("done"), F.when(full, w).otherwise(longer).alias("line"))

    def wrapped(segment: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))
        return F.aggregate(words(segment), start, add, lambda acc: F.array_join(F.array_append(acc["done"], acc["line"]), "<br/>"))

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "<br/>"), wrapped), "<br/>")


#: How a condition is read. Beginnings of predicate names; operators in the order in which they are replaced.
PREDICATES = ("is", "has", "can", "should", "will", "was", "are", "have", "did", "does", "check", "needs")
OPERATORS = {
    "==": "equals", "!=": "does not equal", ">=": "is greater than or equal to", "<=": "is less than or equal to", ">": "is greater than", "<": "is less than",
    "&&": "AND", r"\|\|": "OR",
}


def readable_condition(text: Column) -> Column:
    """A condition in words. One that begins with a call of a predicate (`isReady(`, `!p->hasMore(`) becomes that predicate; in any other
    the operators become words, and pointers, scopes and a last semicolon go."""
    s = F.trim(F.coalesce(text, F.lit("")))
    call = rf"(?is)^(!?)\s*(?:([\w\->:.*]+?)\s*->\s*)?({'|'.join(PREDICATES)})(\w+)\s*\(.*$"
    no, owner, verb, rest = (F.regexp_extract(s, call, k) for k in (1, 2, 3, 4))
    what, verb = F.lower(F.trim(F.regexp_replace(rest, "([A-Z])", " $1"))), F.lower(verb)
    being = verb.isin("is", "are")
    said = F.when((no == "!") & being, F.concat(F.lit("is not "), what)).when(no == "!", F.concat_ws(" ", F.lit("does not"), verb, what)).when(being, F.concat(F.lit("is "), what)).otherwise(F.concat(verb, F.lit("s "), what))
    words = s
    for operator, word in OPERATORS.items():
        words = F.regexp_replace(words, rf"\s*{operator}\s*", f" {word} ")
    words = F.regexp_replace(words, r"\b(?:nullptr|NULL)\b", "null")
    words = F.regexp_replace(F.replace(F.replace(words, F.lit("->"), F.lit(".")), F.lit("&"), F.lit(" ")), r"\w+::", "")
    return F.when(verb != "", F.concat_ws(" ", F.nullif(owner, F.lit("")), said)).otherwise(F.trim(F.regexp_replace(words, ";+$", "")))


def assert_calls(code: Column) -> Column:
    """array<struct<line,col>>: 1-based places of assertion calls."""
    call = r"\b(?:assert|ASSERT|static_assert)\s*\("
    def places(line: Column, n: Column) -> Column:
        # what stands before each call, as lengths that add up
        before = F.slice(F.split(line, call), F.lit(1), F.size(F.split(line, call)) - 1)
        calls = F.regexp_extract_all(line, F.lit(f"({call})"), 1)
        ends = F.transform(before, lambda _, i: F.aggregate(F.slice(before, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.char_length(x)) + F.aggregate(F.slice(calls, F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x)))
        return F.transform(ends, lambda at: F.struct((n + 1).alias("line"), (at + 1).alias("col")))

    return F.flatten(F.transform(F.split(F.coalesce(code, F.lit("")), "\n"), places))


#: Words that state a visibility.
VISIBILITIES = ("PRIVATE", "PROTECTED", "PUBLIC")


def visibility_before(lines: Column) -> Column:
    """Visibility that the first word of a declaration's line or one of the four before it states, the nearest first; blank and comment
    lines don't count; `default` where none does."""
    split = F.split(F.coalesce(lines, F.lit("")), "\n")
    last = F.reverse(F.slice(split, F.greatest(F.size(split) - 4, F.lit(1)), F.lit(5)))
    first = F.transform(F.filter(last, lambda s: ~F.trim(s).rlike(r"^(//|/\*|\*)")), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
    return F.coalesce(F.lower(F.get(F.filter(first, lambda w: w.isin(*VISIBILITIES)), F.lit(0))), F.lit("default"))


@F.pandas_udf(T.StringType())
def preceding_comment(block: pd.Series) -> pd.Series:
    """The comment that ends a block of lines, without its marks; empty where code comes last."""

    def one(s):
        out = []
        for line in reversed((s or "").rstrip().split("\n")):
            t = line.strip()
            if not re.match(r"(//|/\*|\*)", t) and not t.endswith("*/"):
                break
            out.append(re.sub(r"^(//+[/!]*|/\*+!?|\*(?!/))|\*/$", "", t).strip().removesuffix("*/").strip())
            if t.startswith("/*"):
                break
        return " ".join(x for x in reversed(out) if x)

    return block.map(one)


@F.pandas_udf(T.StringType())
def declaration_snippet(text: pd.Series, line: pd.Series) -> pd.Series:
    """Lines from a declaration (1-based) to where its braces close, 60 at most."""

    def one(s, at):
        out, depth, opened = [], 0, False
        for row in (s or "").split("\n")[int(at) - 1 : int(at) + 59]:
            out.append(row)
            depth += row.count("{") - row.count("}")
            opened = opened or "{" in row
            if opened and depth <= 0 or not opened and row.rstrip().endswith(";"):
                break
        return "\n".join(out)

    return pd.Series([one(s, n) for s, n in zip(text, line, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def active_includes(text: pd.Series, macros: pd.Series) -> pd.Series:
    """Quoted includes in branches that are live under the given macros (an array of names), in order, once each. A condition is
    `defined(NAME)` or a bare name; any other counts as true, so that no include is hidden. In a chain of branches only the first
    true one is live."""

    def one(s, defined):
        out: dict[str, None] = {}
        defined, chains = set(() if defined is None else defined), []  # per open #if: is its branch live, was one true
        for m in re.finditer(r"^[ \t]*#[ \t]*(ifdef|ifndef|if|elif|else|endif|include)\b[ \t]*(.*)$", s or "", re.MULTILINE):
            word, rest = m[1], m[2].strip()
            name = re.search(r"defined\s*\(\s*(\w+)\s*\)", rest) or re.match(r"(\w+)\s*$", rest)
            holds = name[1] in defined if name else True
            if word in ("ifdef", "ifndef"):
                holds = (rest.split()[0] if rest else "") in defined
                chains.append((holds == (word == "ifdef"),) * 2)
            elif word == "if":
                chains.append((holds, holds))
            elif word == "include":
                if (q := re.match(r'"([^"]+)"', rest)) and all(live for live, _ in chains):
                    out[q[1]] = None
            elif chains:
                _, taken = chains.pop()
                if word != "endif":
                    live = not taken and (word == "else" or holds)
                    chains.append((live, taken or live))
        return list(out)

    return pd.Series([one(s, d) for s, d in zip(text, macros, strict=True)])


def companion_headers(path: Column) -> Column:
    """Headers that a source file depends on though it may not include them: its own name as .h and .hpp (empty for headers)."""
    base = F.regexp_replace(path, r"(?i)\.(cpp|cc|cxx)$", "")
    return F.when(path.rlike(r"(?i)\.(cpp|cc|cxx)$"), F.array(F.concat(base, F.lit(".h")), F.concat(base, F.lit(".hpp")))).otherwise(F.array().cast("array<string>"))

"""Keys, names and paths as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def present(c: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(c, F.lit(""))


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(present(c), F.lit(default))


def normal_path(path: Column) -> Column:
    """Forward slashes, none at either end."""
    return F.trim(F.translate(path, "\\", "/"), F.lit("/"))


def repo_relative(path: Column, base: Column) -> Column:
    """Path below base, null where it lies outside (a sibling that shares the name's beginning is outside)."""
    p, b = F.translate(path, "\\", "/"), F.rtrim(F.translate(base, "\\", "/"), F.lit("/"))
    return F.when(F.startswith(p, F.concat(b, F.lit("/"))), F.substr(p, F.char_length(b) + 2))


def is_under(path: Column, base: Column) -> Column:
    return F.coalesce(path == base, F.lit(False)) | repo_relative(path, base).isNotNull()


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def stem(path: Column) -> Column:
    return without_extension(F.substring_index(path, "/", -1))


def short_name(qualified: Column) -> Column:
    return F.substring_index(qualified, "::", -1)


def unit_key(component: Column, path: Column) -> Column:
    return F.concat_ws("|", component, stem(path))


def global_key(component: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("|", component, stem(path), name)


def function_key(component: Column, path: Column, name: Column, types: Column) -> Column:
    return F.concat_ws("|", component, stem(path), name, F.array_join(types, ","))


def macro_key(name: Column, file: Column) -> Column:
    return F.concat_ws("@", name, file)


def version_id(sha: Column) -> Column:
    return F.substring(sha, 1, 16)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def id_segment(name: Column, digits: bool = False) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]" if digits else "[^A-Z]", "")


def interface_id(private: Column, layer: Column, group: Column, unit: Column, number: Column) -> Column:
    """IF or PIF, layer, group (left out if empty), unit, two-digit number (longer numbers stay whole)."""
    n = number.cast("string")
    padded = F.when(F.char_length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)
    return F.concat_ws("_", F.when(private, "PIF").otherwise("IF"), id_segment(layer, True), present(id_segment(group)), id_segment(unit), padded)


def readable_label(name: Column) -> Column:
    """One storage prefix dropped, underscores as spaces; two characters or fewer give nothing; first letter upper."""
    s = F.trim(F.translate(F.regexp_replace(name, "^[gst]_", ""), "_", " "))
    return F.when(F.char_length(s) <= 2, "").otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))


def poor_name(name: Column) -> Column:
    """A missing name, or one that is only the function's own with `input` or `result`."""
    bare = F.trim(name)
    return F.coalesce(bare.endswith(" input") | bare.endswith(" result") | (bare == ""), F.lit(True))


def direction(writes: Column, reads: Column) -> Column:
    """A writer is In; a reader, or a function without globals, is Out."""
    return F.when(writes > 0, "In").when(reads > 0, "Out").otherwise("Out")


def final_direction(is_function: Column, current: Column) -> Column:
    return F.when(~is_function, "In/Out").when(current == "Out", "Out").otherwise("In")


#: Display ranges and the type names that have them.
RANGES = {
    "0-0xFF": ("uint8_t", "std::uint8_t", "param_uint8_t"),
    "0-0xFFFF": ("unsigned short", "uint16_t", "std::uint16_t", "param_uint16_t"),
    "0-0xFFFFFFFF": ("unsigned", "unsigned int", "unsigned long", "uint32_t", "std::uint32_t", "param_uint32_t"),
    "0-0xFFFFFFFFFFFFFFFF": ("unsigned long long", "uint64_t", "std::uint64_t", "param_uint64_t", "uintptr_t", "std::uintptr_t", "param_uintptr_t", "param_size_t"),
    "-0x80-0x7F": ("int8_t", "std::int8_t", "param_int8_t"),
    "-0x8000-0x7FFF": ("short", "short int", "signed short", "int16_t", "std::int16_t", "param_int16_t"),
    "-0x80000000-0x7FFFFFFF": ("int", "signed int", "long", "long int", "signed long", "int32_t", "std::int32_t", "param_int32_t"),
    "-0x8000000000000000-0x7FFFFFFFFFFFFFFF": ("long long", "long long int", "signed long long", "int64_t", "std::int64_t", "param_int64_t", "intptr_t", "std::intptr_t", "param_intptr_t"),
}


def type_range(type_text: Column) -> Column:
    """Range of a C++ type's text, qualifiers off: VOID for void (not a pointer to it), the table's, that of size_t for any text that
    names it without a pointer; NA else, so for pointers, references and types without a numeric range."""
    text = F.lower(F.trim(F.coalesce(type_text, F.lit(""))))
    bare = F.trim(F.regexp_replace(text, "const |volatile ", ""))
    plain = ~F.contains(text, F.lit("*"))
    table = F.create_map(*[F.lit(x) for shown, names in RANGES.items() for name in names for x in (name, shown)])
    return (F.when((text == "void") | (text.startswith("void ") & plain), "VOID").when(F.try_element_at(table, bare).isNotNull(), F.try_element_at(table, bare))
            .when(F.contains(bare, F.lit("size_t")) & plain, "0-0xFFFFFFFFFFFFFFFF").otherwise("NA"))


#: Return types that name nothing.
PRIMITIVES = ("void", "int", "bool", "float", "double", "char", "short", "long")


def behaviour_names(parameter: Column, written: Column, read: Column, return_type: Column, return_expr: Column, qualified: Column) -> Column:
    """struct(input_name, output_name) of a function, as labels. parameter: its first; written, read: qualified names of the first
    global it writes and reads (null if none).

    Input: the parameter, else what it writes, else what it reads. Output: the identifier that its return expression begins with, else
    its return type if that isn't primitive; where that gives no label, what it writes, else what it reads. Where that gives none
    either, the function's own label and `input` or `result`."""
    label = lambda c: present(readable_label(F.trim(c)))
    first = lambda c, pattern: present(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1))
    touched = F.when(written.isNotNull(), label(short_name(written))).otherwise(label(short_name(read)))
    taken = F.when(present(F.trim(parameter)).isNotNull(), label(parameter)).otherwise(touched)
    named = first(return_expr, r"^[\s();,+\-*/%&|^<>!?:]*([^\s();,+\-*/%&|^<>!?:]+)")
    named = F.when(named.rlike(r"^[\p{L}_]"), named)
    kind = first(return_type, r"(\S+)\s*$")
    given = F.when(named.isNotNull(), label(named)).when(~kind.isin(*PRIMITIVES), label(kind))
    own = label(short_name(F.coalesce(qualified, F.lit(""))))
    fallback = lambda word: F.concat(F.coalesce(own, F.lit("Behaviour")), F.lit(word))
    return F.struct(F.coalesce(taken, fallback(" input")).alias("input_name"), F.coalesce(given, touched, fallback(" result")).alias("output_name"))


def named_type(type_text: Column) -> Column:
    """The named type under pointers, references and arrays (on the text)."""
    return F.trim(F.regexp_replace(type_text, r"\b(const|volatile|struct|class|enum)\b|[*&]|\[[^\]]*\]", ""))


def signature(return_type: Column, name: Column, params: Column) -> Column:
    """`type name(type name, ...)`; params: array<struct<name,type>>."""
    one = lambda p: F.trim(F.concat_ws(" ", p["type"], p["name"]))
    return F.concat(return_type, F.lit(" "), name, F.lit("("), F.array_join(F.transform(params, one), ", "), F.lit(")"))

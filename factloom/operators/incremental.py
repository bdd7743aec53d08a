"""What changed between two versions, what that affects, and what can be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.graph import reverse_closure, spread_families

SEPARATOR = "\x1f"


# ---- hashes -------------------------------------------------------------------------------------------------------
def token_hash(tokens: Column, prefix: Column | None = None) -> Column:
    """sha256 of the tokens joined by the unit separator; an optional comment text goes first."""
    joined = F.array_join(tokens, SEPARATOR)
    return F.sha2(joined if prefix is None else F.concat(prefix, F.lit(SEPARATOR), joined), 256)


def macro_hash(text: Column) -> Column:
    """Hash of a macro's text that ignores continuation marks and the amount of white space."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"\\\r?\n", " "), r"\s+", " "))
    return token_hash(F.split(flat, " "))


def entity_kind(key: Column) -> Column:
    """Kind of an entity by the shape of its key."""
    pipes = F.regexp_count(key, F.lit(r"\|"))
    return F.when(key.contains("@") & (pipes == 0), "macro").when(pipes >= 3, "function").when(pipes == 2, "global").otherwise("type")


def fingerprints(hashes: DataFrame, deps: DataFrame) -> DataFrame:
    """(key, fp): sha256 over an entity's own hash and the sorted hashes of its distinct dependencies. Dependencies without
    a hash don't count; entities without one get no fingerprint. hashes: key, hash; deps: key, dep."""
    found = deps.select("key", "dep").distinct().join(hashes.select(F.col("key").alias("dep"), F.col("hash").alias("dep_hash")), "dep")
    parts = found.groupBy("key").agg(F.array_sort(F.collect_list("dep_hash")).alias("parts"))
    both = hashes.join(parts, "key", "left")
    return both.select("key", F.sha2(F.array_join(F.concat(F.array("hash"), F.coalesce("parts", F.array().cast("array<string>"))), SEPARATOR), 256).alias("fp"))


def parse_fingerprint(parts: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, fp): order-preserving hash of a group's values."""
    items = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("items"))
    return items.select(group, F.sha2(F.array_join(F.transform("items", lambda x: x[value]), SEPARATOR), 256).alias("fp"))


# ---- change classes and impact ------------------------------------------------------------------------------------
def classify(base: DataFrame, target: DataFrame, key: str = "key", value: str = "hash") -> DataFrame:
    """(key, status): new, deleted, changed or unchanged, one row per key of either side."""
    b, t = base.select(key, F.col(value).alias("_b"), F.lit(1).alias("_ib")), target.select(key, F.col(value).alias("_t"), F.lit(1).alias("_it"))
    status = F.when(F.col("_ib").isNull(), "new").when(F.col("_it").isNull(), "deleted").when(F.col("_b").eqNullSafe(F.col("_t")), "unchanged").otherwise("changed")
    return b.join(t, key, "full_outer").select(key, status.alias("status"))


def impact_seeds(changed: DataFrame, functions: DataFrame, uses: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(node): functions that changed or are new, and the users of changed globals, types and macros. changed: key;
    functions: fid; uses: key, fid (users of any other kind of entity)."""
    own = changed.join(functions, changed["key"] == functions["fid"], "left_semi").select(F.col("key").alias("node"))
    users = uses.join(changed, "key", "left_semi").join(functions, "fid", "left_semi").select(F.col("fid").alias("node"))
    out = own.unionByName(users)
    return (out if extra is None else out.unionByName(extra.join(functions, "fid", "left_semi").select(F.col("fid").alias("node")))).distinct()


def impact_set(changed: DataFrame, functions: DataFrame, calls: DataFrame, uses: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(fid): seeds and all their transitive callers."""
    reach = reverse_closure(calls, impact_seeds(changed, functions, uses, extra), "caller", "callee")
    return reach.select(F.col("node").alias("fid"))


def plan_incremental(status: DataFrame, functions: DataFrame, calls: DataFrame, base_calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(fid, action): regenerate or reuse, for every function. Callers, in the old version, of deleted functions are seeds too."""
    changed = status.where("status in ('changed', 'new')").select("key")
    deleted = status.where("status = 'deleted'").select("key")
    widowed = base_calls.join(deleted, base_calls["callee"] == deleted["key"], "left_semi").select(F.col("caller").alias("fid")).distinct()
    impact = impact_set(changed, functions, calls, uses, widowed).withColumn("hit", F.lit(True))
    return functions.join(impact.hint("merge"), "fid", "left").select("fid", F.when(F.col("hit"), "regenerate").otherwise("reuse").alias("action"))


def impacted_globals(status: DataFrame, globals_: DataFrame, access: DataFrame, impact: DataFrame) -> DataFrame:
    """(gid): existing globals that changed or are new, or that an impacted function uses."""
    own = status.where("status in ('changed', 'new')").select(F.col("key").alias("gid"))
    used = access.join(impact.hint("merge"), "fid", "left_semi").select("gid")
    return own.unionByName(used).distinct().join(globals_.hint("merge"), "gid", "left_semi")


def files_of(fids: DataFrame, file_of: DataFrame) -> DataFrame:
    """(file): distinct files of a set of functions; functions without one drop out."""
    return fids.join(file_of.hint("merge"), "fid").where("file is not null").select("file").distinct()


# ---- reuse ----------------------------------------------------------------------------------------------------------
def carry_forward(target: DataFrame, base: DataFrame, key: str, fields: list[str], keep: DataFrame | None = None) -> DataFrame:
    """Target rows with `fields` taken from the base row of the same key, a field at a time and only where the base row has
    it (null and empty count as missing). `keep` restricts this to the keys it holds."""
    b = base.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    if keep is not None:
        b = b.join(keep, key, "left_semi")
    out = target.join(b, key, "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")) if dict(base.dtypes)[f] == "string" else F.col(f"_{f}"), F.col(f)))
    return out.select(*target.columns)


def index_put(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(fp, version, key): the index with rows added; for a fingerprint that is there the first producer stays, and of
    several new ones the least (version, key)."""
    first = rows.groupBy("fp").agg(F.min(F.struct("version", "key")).alias("m")).select("fp", "m.version", "m.key")
    return index.select("fp", "version", "key").unionByName(first.join(index, "fp", "left_anti"))


def reuse_from_index(wanted: DataFrame, index: DataFrame, rows: DataFrame, current: str) -> DataFrame:
    """(key, version, source_key, payload): for wanted (key, fp), the row that another version made for the same
    fingerprint. rows: version, key, payload."""
    hit = wanted.join(index.select("fp", "version", F.col("key").alias("source_key")), "fp").where(F.col("version") != current)
    src = rows.select("version", F.col("key").alias("source_key"), "payload")
    return hit.join(src, ["version", "source_key"]).select("key", "version", "source_key", "payload")


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (key, hash, version) with hit (boolean) and value from a cache (key, hash, version, value)."""
    return wanted.join(cache, ["key", "hash", "version"], "left").select("key", "hash", "version", F.col("value").isNotNull().alias("hit"), "value")


# ---- narrowed re-scan -----------------------------------------------------------------------------------------------
def affected_tus(tu_includes: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(tu): translation units that are changed themselves or include a changed file. tu_includes: tu, inc."""
    every = tu_includes.select("tu", F.col("inc").alias("file")).unionByName(tu_includes.select("tu", F.col("tu").alias("file")))
    return every.join(changed_files, "file", "left_semi").select("tu").distinct()


def new_tus(changed_files: DataFrame, known: DataFrame, suffixes: str = r"\.(cpp|cc|cxx)$") -> DataFrame:
    """(file): changed source files that no stored unit knows."""
    return changed_files.where(F.col("file").rlike(suffixes)).join(known, changed_files["file"] == known["tu"], "left_anti")


def merge_by_file(base: DataFrame, fresh: DataFrame, drop: DataFrame, key: str = "key", file: str = "file") -> DataFrame:
    """Base rows of files outside the drop set, and fresh rows of files inside it; fresh rows of other files are discarded;
    where both give a key, the base row stays."""
    files = drop.select(F.col("file").alias(file))
    kept = base.join(files, file, "left_anti")
    new = fresh.join(files, file, "left_semi").join(kept.select(key), key, "left_anti")
    return kept.unionByName(new.select(*kept.columns))


def merge_edges(base: DataFrame, fresh: DataFrame, file_of: DataFrame, drop: DataFrame, valid: DataFrame) -> DataFrame:
    """(axis, key, fid): long edges merged by the user's file, restricted to valid functions, without repeats."""
    dropped = file_of.join(drop, "file", "left_semi").select("fid")
    both = base.join(dropped, "fid", "left_anti").unionByName(fresh.join(dropped, "fid", "left_semi"))
    return both.join(valid, "fid", "left_semi").select("axis", "key", "fid").distinct()


def merge_override_pairs(base: DataFrame, fresh: DataFrame, file_of: DataFrame, drop: DataFrame) -> DataFrame:
    """(ov, base) merged by the file of the overriding function, distinct."""
    dropped = file_of.join(drop, "file", "left_semi").select(F.col("fid").alias("ov"))
    return base.join(dropped, "ov", "left_anti").unionByName(fresh.join(dropped, "ov", "left_semi")).distinct()


def recompute_calls(calls: DataFrame, override_pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(caller, callee): edges between present functions, virtual families spread."""
    k = keys.select("fid")
    sound = calls.join(k, calls["caller"] == k["fid"], "left_semi").join(k, F.col("callee") == k["fid"], "left_semi").select("caller", "callee").distinct()
    return spread_families(sound, override_pairs, k)


def adjacency(calls: DataFrame, keys: DataFrame) -> DataFrame:
    """(fid, calls_ids, called_by_ids): both directions as sorted arrays, empty where there is no edge."""
    out = calls.groupBy(F.col("caller").alias("fid")).agg(F.array_sort(F.collect_set("callee")).alias("calls_ids"))
    into = calls.groupBy(F.col("callee").alias("fid")).agg(F.array_sort(F.collect_set("caller")).alias("called_by_ids"))
    none = F.array().cast(out.schema["calls_ids"].dataType)
    return keys.select("fid").join(out, "fid", "left").join(into, "fid", "left").select("fid", F.coalesce("calls_ids", none).alias("calls_ids"), F.coalesce("called_by_ids", none).alias("called_by_ids"))


def merge_model(base: dict[str, DataFrame], fresh: dict[str, DataFrame], drop: DataFrame) -> dict[str, DataFrame]:
    """A stored model with the tables of a partial re-scan merged in. Tables: functions (fid, file, hash), calls (caller,
    callee), override_pairs (ov, base)."""
    functions = merge_by_file(base["functions"], fresh["functions"], drop, "fid")
    file_of = base["functions"].select("fid", "file").unionByName(fresh["functions"].select("fid", "file")).distinct()
    gone = file_of.join(drop, "file", "left_semi").select("fid")
    calls = base["calls"].join(gone, F.col("caller") == F.col("fid"), "left_anti").unionByName(fresh["calls"].join(gone, F.col("caller") == F.col("fid"), "left_semi"))
    pairs = merge_override_pairs(base["override_pairs"], fresh["override_pairs"], file_of, drop)
    return {"functions": functions, "calls": recompute_calls(calls, pairs, functions.select("fid")), "override_pairs": pairs}


def diff_models(a: DataFrame, b: DataFrame, key: str, fields: list[str], limit: int = 50) -> DataFrame:
    """(key, what): differing rows of two tables, arrays compared as sets; the first `limit` in order of the key."""
    norm = lambda df, f: F.array_sort(F.array_distinct(f)) if dict(df.dtypes)[f].startswith("array") else F.col(f)
    left = a.select(key, F.struct(*[norm(a, f).alias(f) for f in fields]).alias("_a"))
    right = b.select(key, F.struct(*[norm(b, f).alias(f) for f in fields]).alias("_b"))
    what = F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return left.join(right, key, "full_outer").select(key, what.alias("what")).where("what is not null").orderBy(key).limit(limit)


def splice(fresh: DataFrame, cross: DataFrame, base: DataFrame, current: DataFrame) -> DataFrame:
    """(name, source, payload, place): three-way merge, fresh over cross-version over base; names that no longer exist drop;
    base order first, then new names in order. Inputs: name, payload, ord; current: name."""
    side = lambda df, n: df.select("name", F.col("payload").alias(f"p_{n}"), F.col("ord").alias(f"o_{n}"))
    both = side(fresh, "f").join(side(cross, "c"), "name", "full_outer").join(side(base, "b"), "name", "full_outer").join(current, "name", "left_semi")
    source = F.when(F.col("p_f").isNotNull(), "fresh").when(F.col("p_c").isNotNull(), "cross").otherwise("base")
    return both.select("name", source.alias("source"), F.coalesce("p_f", "p_c", "p_b").alias("payload"), F.struct(F.col("o_b").isNull(), F.coalesce("o_b", "o_f", "o_c")).alias("place"))


# ---- decisions and reports ------------------------------------------------------------------------------------------
def full_reparse_reason(has_includes: Column, header_added: Column, header_deleted: Column, stored_fp: Column, current_fp: Column) -> Column:
    """Why a narrowed scan isn't safe, or null."""
    return (
        F.when(~has_includes, "no include closure").when(header_added, "header added").when(header_deleted, "header deleted")
        .when(~stored_fp.eqNullSafe(current_fp), "parse settings differ")
    )


def nearest_ancestor(candidates: DataFrame, group: str, value: str, distance: str, order: str) -> DataFrame:
    """(group, value): the candidate at the least distance, the first in order on a tie."""
    return candidates.where(F.col(distance).isNotNull()).groupBy(group).agg(F.min_by(value, F.struct(distance, order)).alias(value))


def bucket_counts(status: DataFrame) -> DataFrame:
    """(status, kind, n): counts by change class and kind of entity."""
    return status.groupBy("status", entity_kind(F.col("key")).alias("kind")).agg(F.count("*").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """Integer percentage rounded down; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(100 * part / whole).cast("long"))


def reuse_report(plan: DataFrame, group: str | None = None) -> DataFrame:
    """total, regenerated, reused, percent_reused of a plan (action), over all rows or by a column."""
    g = plan.groupBy(group) if group else plan.groupBy()
    out = g.agg(F.count("*").alias("total"), F.count_if(F.col("action") == "regenerate").alias("regenerated"))
    out = out.withColumn("reused", F.col("total") - F.col("regenerated"))
    return out.withColumn("percent_reused", F.call_function("div", 100 * F.col("reused"), F.greatest("total", F.lit(1))).cast("long"))

"""Small filters, look-ups and counts of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.keys import short_name


def normal_name(name: Column) -> Column:
    """Lower case, spaces as hyphens: how components are compared."""
    return F.lower(F.replace(F.trim(name), F.lit(" "), F.lit("-")))


def of_components(rows: DataFrame, component: str, allowed: DataFrame) -> DataFrame:
    """rows whose component is among `allowed` (name), whatever the case and the spaces."""
    names = allowed.select(normal_name(F.col("name")).alias("_c")).distinct()
    return rows.withColumn("_c", normal_name(F.col(component))).join(names, "_c", "left_semi").drop("_c")


def components_in(layers: DataFrame, layer: str) -> DataFrame:
    """(name): components of a layer. layers: layer, grp, component (flat)."""
    return layers.where(normal_name(F.col("layer")) == normal_name(F.lit(layer))).select(F.col("component").alias("name")).distinct()


def layer_of(names: DataFrame, layers: DataFrame, kind: str = "component") -> DataFrame:
    """names (name) with the layer of that component, or with kind `grp` of that group; null where unknown."""
    known = layers.groupBy(normal_name(F.col(kind)).alias("_n")).agg(F.min("layer").alias("layer"))
    return names.withColumn("_n", normal_name(F.col("name"))).join(known, "_n", "left").drop("_n")


def is_external(component: Column, own: Column, allowed: list[str]) -> Column:
    """A unit of no allowed component, or of another than one's own."""
    return ~component.isin(*allowed) | (component != own)


def without_guards(defines: DataFrame, name: str = "name", value: str = "value", pattern: str = r"(?i)(^|_)(H|HPP|HXX|INCLUDED)_*$") -> DataFrame:
    """defines without include guards: those without a value whose name has a guard's form."""
    return defines.where(~((F.trim(F.coalesce(F.col(value), F.lit(""))) == "") & F.col(name).rlike(pattern)))


def chosen_documents(docs: DataFrame, equal: dict[str, object], statuses: tuple[str, ...] = (), contains: dict[str, str] | None = None) -> DataFrame:
    """docs that equal every given value (null: any), have one of the statuses (none given: any) and hold the texts, whatever the case."""
    for column, value in equal.items():
        if value is not None:
            docs = docs.where(F.col(column) == value)
    if statuses:
        docs = docs.where(F.col("status").isin(*statuses))
    for column, text in (contains or {}).items():
        docs = docs.where(F.contains(F.lower(F.col(column).cast("string")), F.lit(text.lower())))
    return docs


def commits_with(commits: DataFrame, text: str, columns: tuple[str, ...] = ("sha", "message", "author")) -> DataFrame:
    """commits that hold a text in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return commits.where(hit)


def unread(notifications: DataFrame, user: Column) -> DataFrame:
    return notifications.where(user & F.col("read_at").isNull())


def without_secrets(data: Column, secrets: tuple[str, ...]) -> Column:
    """A map without some of its keys."""
    return F.map_filter(data, lambda k, _: ~k.isin(*secrets))


def is_header(path: Column) -> Column:
    return path.rlike(r"(?i)\.(h|hh|hpp|hxx)$")


def is_unit(path: Column) -> Column:
    return path.rlike(r"(?i)\.(c|cpp|cc|cxx)$")


def value_range(values: Column) -> Column:
    """`least-greatest` of an array's values, NA where it has none."""
    return F.coalesce(F.concat(F.array_min(values).cast("string"), F.lit("-"), F.array_max(values).cast("string")), F.lit("NA"))


def counted(rows: DataFrame, by: list[str], distinct: dict[str, str], total: str) -> DataFrame:
    """by, the distinct values of columns (name: column), and the number of rows as `total`."""
    return rows.groupBy(*by).agg(*[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.count("*").alias(total))


def in_order(rows: DataFrame, group: str, order: list[str], default: str) -> DataFrame:
    """(group, place, n): rows counted by a group, the groups of `order` first and in that order, others after them by name, missing ones
    as `default`; empty groups don't appear."""
    n = rows.groupBy(F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit(default)).alias(group)).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return n.select(group, F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("place"), "n")


def percentage(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing is 0."""
    return F.when(whole == 0, 0).otherwise(F.floor(100.0 * part / whole + 0.5)).cast("long")


def by_name(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (name) with `said`: of the known (name, said) of that qualified name, else of that short name, the first by name."""
    exact = known.groupBy("name").agg(F.min("said").alias("exact"))
    short = known.groupBy(short_name(F.col("name")).alias("_s")).agg(F.min_by("said", F.struct("name", "said")).alias("short"))
    out = wanted.distinct().withColumn("_s", short_name(F.col("name"))).join(exact, "name", "left").join(short, "_s", "left")
    return out.select("name", F.coalesce("exact", "short").alias("said"))


def nearest_summary(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """files (file) with the summary of the file, else of its directory, else of the directory above; empty where none. summaries:
    path, said."""
    known = summaries.groupBy("path").agg(F.min("said").alias("said"))
    up = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", ""))
    out = files.withColumn("_0", F.col("file")).withColumn("_1", up(F.col("_0"))).withColumn("_2", up(F.col("_1")))
    for k in range(3):
        out = out.join(known.select(F.col("path").alias(f"_{k}"), F.col("said").alias(f"_s{k}")), f"_{k}", "left")
    return out.select(*files.columns, F.coalesce("_s0", "_s1", "_s2", F.lit("")).alias("summary"))


def ordered_parts(names: Column) -> Column:
    """Files of one image in order of the number at their ends; one without a number comes first."""
    number = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"_(\d+)\.[A-Za-z]+$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.transform(F.array_sort(F.transform(names, lambda x: F.struct(number(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def project_calls(calls: DataFrame, prefixes: list[str]) -> DataFrame:
    """(fid, callees): an array of each function's callees, library ones (by prefix) left out, in order of first sight. calls: fid, callee,
    ord."""
    own = calls
    for p in prefixes:
        own = own.where(~F.col("callee").startswith(p))
    first = own.groupBy("fid", "callee").agg(F.min("ord").alias("first"))
    listed = first.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("first", "callee"))).alias("m"))
    return listed.select("fid", F.transform("m", lambda x: x["callee"]).alias("callees"))


def scope_flags(kind: Column, name: Column) -> Column:
    """array<string>: the options that select a scope (layer, group, component, or everything)."""
    option = F.when(kind == "layer", "--layer").when(kind == "group", "--group").when(kind == "component", "--component")
    return F.when(option.isNotNull() & (F.coalesce(name, F.lit("")) != ""), F.array(option, name)).otherwise(F.array(F.lit("--all")))


def token_window(explicit: Column, default: int, most: int) -> Column:
    """A positive explicit window, else the default; `most` at most."""
    return F.least(F.when(explicit > 0, explicit).otherwise(F.lit(default)), F.lit(most))


def may_simplify(nodes: DataFrame, least: int = 6) -> DataFrame:
    """(grp, actions, may_simplify): graphs with enough ACTION nodes. nodes: grp, type."""
    n = nodes.groupBy("grp").agg(F.count_if(F.col("type") == "ACTION").alias("actions"))
    return n.withColumn("may_simplify", F.col("actions") >= least)


def stored_diagram(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted (version, unit) with the diagram stored for both, null where there is none. stored: version, unit, diagram, ord (last wins)."""
    last = stored.groupBy("version", "unit").agg(F.max_by("diagram", "ord").alias("diagram"))
    return wanted.join(last, ["version", "unit"], "left")


def siblings(functions: DataFrame) -> DataFrame:
    """(fid, file, n_siblings): each function with its class, the file, and how many functions of another name the file has. The siblings
    themselves are the members of the class; they aren't written out, which would be the square of a file's size. functions: fid, file,
    name."""
    files = functions.groupBy("file").agg(F.count("*").alias("members"))
    same = functions.groupBy("file", "name").agg(F.count("*").alias("same"))
    return functions.join(files, "file").join(same, ["file", "name"]).select("fid", "file", (F.col("members") - F.col("same")).alias("n_siblings"))


def names_of(ids: DataFrame, names: DataFrame) -> DataFrame:
    """(owner, names, dangling): an array of the sorted names of each owner's ids, and how many of them nothing has. ids: owner, ids (array);
    names: id, name."""
    each = ids.select("owner", F.explode_outer("ids").alias("id")).join(names.select("id", "name"), "id", "left")
    return each.groupBy("owner").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count_if(F.col("id").isNotNull() & F.col("name").isNull()).alias("dangling"))


def type_kinds(types: DataFrame, enums: DataFrame, typedefs: DataFrame) -> DataFrame:
    """types (type) with kind and target: `enum`, `typedef` (target: the type it stands for), or `plain`. enums: name; typedefs: name, underlying.
    An enum wins over a typedef of the same name."""
    e = enums.select(F.col("name").alias("type"), F.lit(True).alias("_e")).distinct()
    d = typedefs.groupBy(F.col("name").alias("type")).agg(F.min("underlying").alias("target"))
    kind = F.when(F.col("_e"), "enum").when(F.col("target").isNotNull(), "typedef").otherwise("plain")
    return types.join(e, "type", "left").join(d, "type", "left").select(*types.columns, kind.alias("kind"), F.when(kind == "typedef", F.col("target")).alias("target"))


def unit_entries(units: DataFrame, own: DataFrame, shared: DataFrame) -> DataFrame:
    """(unit, entry): what a unit's header lists: the entries defined under its stem and those of its component, once. units: unit, stem,
    component; own: stem, entry; shared: component, entry.

    A list is what is defined under one stem or in one component. An entry on one list meets a unit once, so only the pairs of entries on
    several lists are compared with each other."""
    place = lambda of, col: F.struct(F.lit(of).alias("of"), F.col(col).cast("string").alias("at"))
    lists = own.where("stem is not null").select(place("stem", "stem").alias("list"), "entry").unionByName(shared.where("component is not null").select(place("component", "component").alias("list"), "entry")).distinct()
    holders = units.select("unit", F.explode(F.array(place("stem", "stem"), place("component", "component"))).alias("list")).where("list.at is not null").distinct()
    counted = lists.withColumn("n", F.count("*").over(Window.partitionBy("entry")))
    met = lambda which: counted.where(which).join(holders.hint("merge"), "list").select("unit", "entry")
    return met("n = 1").unionByName(met("n > 1").distinct())


def having(rows: DataFrame, key: str, holders: DataFrame) -> DataFrame:
    """rows whose key occurs in `holders` (key)."""
    return rows.join(holders.select(key).distinct(), key, "left_semi")


def layers_map(flat: DataFrame) -> DataFrame:
    """(layer, groups): a map of each layer's groups to their sorted components. flat: layer, grp, component."""
    g = flat.groupBy("layer", "grp").agg(F.array_sort(F.collect_set("component")).alias("components"))
    return g.groupBy("layer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "components")))).alias("groups"))


def group_changed(tables_differ: Column, complete: Column, renders_differ: Column) -> Column:
    """A group changed if its tables differ, or else if the rest of its render does; where a project or a document is missing, the render
    can't tell."""
    return tables_differ | (complete & F.coalesce(renders_differ, F.lit(False)))


def script_of(config: Column, default: str) -> Column:
    """struct(script, overridden): the script that a JSON configuration names, else the default."""
    named = F.nullif(F.trim(F.coalesce(F.get_json_object(config, "$.script"), F.lit(""))), F.lit(""))
    return F.struct(F.coalesce(named, F.lit(default)).alias("script"), named.isNotNull().alias("overridden"))

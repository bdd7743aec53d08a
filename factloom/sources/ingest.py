"""Import of an existing output folder: what its files are follows from their names, what is in them from their text.

A file `<project>/<version>/<group>/<table>.json` holds a table in one of several shapes: an object of records by key, a list of records, an object
with such a list under one name, or a single record. All become rows by key; what can't be read is a row of its own with the reason, never an
error of the whole import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Fields that may name a record of a list, the first that is there; fields under which a list may lie.
KEYS, LISTS = ("id", "key", "name"), ("entries", "items", "rows")
#: Kinds of a JSON value by its first character, from the narrowest; a field that has several gets the last of them.
KINDS = ("boolean", "bigint", "double", "string", "json")
_NAME = r"([^/]+)/([^/]+)/([^/]+)/([^/]+)\.json$"


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, project, version, grp, name, content): path is relative to the folder; names are null where a path doesn't say them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace(F.replace("path", F.lit(folder.rstrip("/").rpartition("://")[2].split(":")[-1]), F.lit("\x00")), "^.*\x00/?", "")
    part = lambda k: F.nullif(F.regexp_extract(path, f"^{_NAME}", k), F.lit(""))
    return files.select(path.alias("path"), part(1).alias("project"), part(2).alias("version"), part(3).alias("grp"), part(4).alias("name"), F.expr("try_validate_utf8(cast(content as string))").alias("content"))


def _start(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, bad). entries: project, version, grp, name, key, pos, record (JSON text); bad: path, reason. Of a list, the key is the first
    of KEYS that a record has, else its position."""
    files = folder_files(spark, folder).withColumn("start", _start(F.col("content")))
    as_map, as_list = F.from_json("content", "map<string,string>"), F.from_json("content", "array<string>")
    whole = F.get_json_object("content", "$").isNotNull()
    reason = (
        F.when(F.col("name").isNull(), "not a table's path").when(F.col("content").isNull(), "not UTF-8").when(F.trim("content") == "", "empty")
        .when(~F.col("start").isin("{", "["), "no object or list").when(~whole | ((F.col("start") == "{") & as_map.isNull()) | ((F.col("start") == "[") & as_list.isNull()), "broken JSON")
    )
    files = files.withColumn("reason", reason).withColumn("fields", F.when(F.col("start") == "{", as_map)).withColumn("items", F.when(F.col("start") == "[", as_list))
    good = files.where("reason is null")
    inner = F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in LISTS])
    is_record = lambda v: _start(v) == "{"
    listed = F.coalesce("items", F.when(_start(inner) == "[", F.from_json(inner, "array<string>")))
    keyed = F.map_entries("fields")
    keyed_records = F.forall(keyed, lambda e: is_record(e["value"])) & (F.size(keyed) > 0)
    entry = lambda key, pos, record: F.struct(key.cast("string").alias("key"), pos.cast("int").alias("pos"), record.alias("record"))
    own_key = lambda record, pos: F.coalesce(*[F.get_json_object(record, f"$.{k}") for k in KEYS], pos.cast("string"))
    of_list = F.filter(F.transform(listed, lambda r, k: entry(own_key(r, k), k, r)), lambda e: is_record(e["record"]))
    of_map = F.transform(keyed, lambda e, k: entry(e["key"], k, e["value"]))
    single = F.array(entry(own_key(F.col("content"), F.lit(0)), F.lit(0), F.col("content")))
    rows = F.when(listed.isNotNull(), of_list).when(keyed_records, of_map).when(F.size("fields") > 0, single)
    entries = good.select("project", "version", "grp", "name", F.explode(rows).alias("e")).select("project", "version", "grp", "name", "e.*")
    # records of a list that are none are told of, too
    odd = good.where(listed.isNotNull()).withColumn("n", F.size(F.filter(listed, lambda r: ~F.coalesce(is_record(r), F.lit(False))))).where("n > 0")
    bad = files.where("reason is not null").select("path", "reason").unionByName(odd.select("path", F.concat("n", F.lit(" items are no records")).alias("reason")))
    return entries, bad


def infer_fields(entries: DataFrame) -> DataFrame:
    """(name, field, kind, n): the fields of each table's records, the narrowest kind that holds all their values, and how many have a value."""
    values = entries.select("name", F.explode(F.from_json("record", "map<string,string>")).alias("field", "value")).where("value is not null")
    text = F.col("value")
    # from_json drops the quotes of texts: a text that looks like a number is one here
    kind = F.when(text.isin("true", "false"), 0).when(text.rlike(r"^-?(0|[1-9]\d{0,17})$"), 1).when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), 2).when(text.rlike(r"(?s)^[\[{].*[\]}]$"), 4).otherwise(3)
    by = values.groupBy("name", "field").agg(F.array_sort(F.collect_set(kind)).alias("kinds"), F.count("*").alias("n"))
    only = lambda *k: F.size(F.array_except("kinds", F.array(*map(F.lit, k)))) == 0
    best = F.when(only(0), 0).when(only(1), 1).when(only(1, 2), 2).when(only(4), 4).otherwise(3)
    return by.select("name", "field", F.get(F.array(*map(F.lit, KINDS)), best).alias("kind"), "n")


def typed_table(entries: DataFrame, fields: DataFrame, name: str) -> DataFrame:
    """project, version, grp, key and the typed fields of one table. The table's field names go to the driver, its rows don't."""
    known = {r.field: r.kind for r in fields.where(F.col("name") == name).collect()}
    own = ("project", "version", "grp", "key")
    schema = T.StructType([T.StructField(f, T.StringType()) for f in sorted(known)])
    rows = entries.where(F.col("name") == name).select(*own, F.from_json("record", schema).alias("r"))
    typed = {"boolean": "boolean", "bigint": "bigint", "double": "double"}
    return rows.select(*own, *[F.col(f"r.`{f}`").cast(typed.get(known[f], "string")).alias(f if f not in own else f"field_{f}") for f in sorted(known)])


def projects_of(entries: DataFrame) -> DataFrame:
    """(id, project, version, grp, tables, records): a row for each group of documents that a folder brings."""
    by = entries.groupBy("project", "version", "grp").agg(F.count_distinct("name").alias("tables"), F.count("*").alias("records"))
    return by.select(F.concat_ws("/", "project", "version", "grp").alias("id"), *by.columns)

"""Sources: source trees, text and table files, JSON models, configuration, git output."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.functions import keys
from factloom.operators.derive import forward_fill


def source_files(spark: SparkSession, root: str, pattern: str = "*.{cpp,cc,cxx}", only: DataFrame | None = None, content: bool = True) -> DataFrame:
    """(path, length, text): files below a folder by name pattern; `only` (path) narrows the scan. Empty files, which hold no
    facts, aren't listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    cols = [F.col("path"), F.col("length"), *([F.decode("content", "UTF-8").alias("text")] if content else [])]
    df = df.select(*cols)
    return df if only is None else df.join(only, "path", "left_semi")


def defines(files: DataFrame) -> DataFrame:
    """(path, line, name, value): #define lines of files (path, text), continuation lines joined; function-like macros keep
    their parameters in the value."""
    joined = files.select("path", F.split("text", "\r?\n").alias("rows"))
    rows = joined.select("path", F.posexplode("rows").alias("pos", "row"), "rows")
    head = rows.where(F.col("row").rlike(r"^\s*#\s*define\s+\w"))
    rest = F.slice("rows", F.col("pos") + 2, F.size("rows"))
    more = F.aggregate(rest, F.struct(F.col("row").alias("text"), F.col("row").rlike(r"\\\s*$").alias("open")), lambda acc, x: F.when(
        acc["open"], F.struct(F.concat(F.regexp_replace(acc["text"], r"\\\s*$", " "), x).alias("text"), x.rlike(r"\\\s*$").alias("open"))).otherwise(acc))["text"]
    text = F.regexp_replace(more, r"\\\s*$", "")
    name = F.regexp_extract(text, r"^\s*#\s*define\s+(\w+)", 1)
    value = F.trim(F.regexp_replace(F.regexp_extract(text, r"(?s)^\s*#\s*define\s+\w+(.*)$", 1), r"\s+", " "))
    return head.select("path", (F.col("pos") + 1).alias("line"), name.alias("name"), value.alias("value"))


def include_closure(includes: DataFrame, base: str) -> DataFrame:
    """(tu, inc): distinct included files inside the repository, relative to it; from (tu, path)."""
    rel = lambda c: keys.repo_relative(F.col(c), F.lit(base))
    return includes.select(rel("tu").alias("tu"), rel("path").alias("inc")).where("tu is not null and inc is not null and tu <> inc").distinct()


def macro_args(spark: SparkSession, path: str) -> DataFrame:
    """(arg): -D arguments from a CSV of Name,Value; rows with value `ne` are left out, an empty value gives a bare name."""
    df = spark.read.option("header", True).schema("Name string, Value string").csv(path)
    value = F.coalesce(F.trim("Value"), F.lit(""))
    arg = F.when(value == "", F.concat(F.lit("-D"), F.trim("Name"))).otherwise(F.concat(F.lit("-D"), F.trim("Name"), F.lit("="), value))
    return df.where((F.lower(value) != "ne") & F.col("Name").isNotNull()).select(arg.alias("arg"))


def data_dictionary(rows: DataFrame) -> DataFrame:
    """(name, kind, entry, range, comment, ord) of rows whose blank names belong to the entry above."""
    return forward_fill(rows.withColumn("_name", keys.present(F.trim("name"))), "_name", ["ord"]).select(F.col("filled").alias("name"), "kind", "entry", "range", "comment", "ord")


def merge_dictionaries(parsed: DataFrame, external: DataFrame) -> DataFrame:
    """Entries (name, ...) of both; the external one wins."""
    return external.unionByName(parsed.join(external, "name", "left_anti"))


def json_table(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A JSON document table with a stated schema; an optional table that is missing is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value.*) of a file that holds one object {key: record}."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", f"map<string,struct<{value_schema}>>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "record")).select("key", "record.*")


def parse_jsonc(text: str) -> dict:
    """JSON with comments and trailing commas. Strings that hold comment marks are left alone."""
    out, at = [], 0
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
    for m in token.finditer(text):
        out.append(text[at : m.start()])
        out.append(m[0] if m[0].startswith('"') else " ")
        at = m.end()
    out.append(text[at:])
    pieces = re.split(r'("(?:\\.|[^"\\])*")', "".join(out))
    return json.loads("".join(p if p.startswith('"') else re.sub(r",(\s*[}\]])", r"\1", p) for p in pieces))


def load_config(texts: list[str]) -> dict:
    """Later texts replace top-level values of earlier ones."""
    out: dict = {}
    for t in texts:
        out |= parse_jsonc(t)
    return out


def abbreviations(lines: DataFrame) -> DataFrame:
    """(abbrev, meaning) of `abbrev: meaning` or `abbrev=meaning` lines (ord, value); # begins a comment; the last key wins."""
    clean = lines.select("ord", F.trim(F.regexp_replace("value", r"#.*$", "")).alias("value")).where(F.col("value").rlike("^[^:=]+[:=]"))
    parts = clean.select("ord", F.trim(F.regexp_extract("value", "^([^:=]+)[:=]", 1)).alias("abbrev"), F.trim(F.regexp_extract("value", "^[^:=]+[:=](.*)$", 1)).alias("meaning"))
    return parts.groupBy("abbrev").agg(F.max_by("meaning", "ord").alias("meaning"))


def few_shot(spark: SparkSession, folder: str, multi_line: bool = True) -> DataFrame:
    """(file, tags, input, output): examples, a file (or, without multi_line, a line) each; those without input or output drop."""
    df = spark.read.schema("tags array<string>, input string, output string").option("multiLine", multi_line).json(folder)
    return df.select(keys.stem(F.input_file_name()).alias("file"), "tags", "input", "output").where("input is not null and output is not null")


def parse_status(lines: DataFrame) -> DataFrame:
    """(status, path): `git diff --name-status` lines; renames and copies become a deletion and an addition."""
    f = F.split("value", "\t")
    code = F.substring(f[0], 1, 1)
    both = F.array(F.struct(F.lit("D").alias("status"), F.get(f, F.lit(1)).alias("path")), F.struct(F.lit("A").alias("status"), F.get(f, F.lit(2)).alias("path")))
    one = F.array(F.struct(code.alias("status"), F.get(f, F.lit(1)).alias("path")))
    return lines.where("value <> ''").select(F.explode(F.when(code.isin("R", "C"), both).otherwise(one)).alias("x")).select("x.*")


def parse_log(lines: DataFrame, sep: str = "\x1f") -> DataFrame:
    """(sha, author, committed_at, message) of separated log lines."""
    f = F.split("value", sep)
    return lines.where("value <> ''").select(f[0].alias("sha"), f[1].alias("author"), parse_time(f[2]).alias("committed_at"), f[3].alias("message"))


def parse_time(text: Column) -> Column:
    """ISO date and time; without a zone it is UTC (the session's zone); null if it can't be read."""
    return F.try_to_timestamp(text)


def path_tree(paths: DataFrame) -> DataFrame:
    """(id, parent, name, is_folder, depth): a listing of paths as a tree, one row per folder and file."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(
        F.array_join(F.slice(parts, F.lit(1), n), "/").alias("id"), F.nullif(F.array_join(F.slice(parts, F.lit(1), n - 1), "/"), F.lit("")).alias("parent"),
        F.element_at(parts, n).alias("name"), (n < F.size(parts)).alias("is_folder"), (n - 1).alias("depth")))
    return paths.select(F.explode(steps).alias("x")).select("x.*").distinct()


def path_listing(tree: DataFrame) -> DataFrame:
    """path_tree()'s rows with `place`, from 1, among the entries of their folder: folders first, each kind by name whatever the case, then by
    name. A folder's entries are ranked by themselves; those of the top are one folder."""
    order = Window.partitionBy("parent").orderBy(F.col("is_folder").desc(), F.lower("name"), "name", "id")
    return tree.withColumn("place", F.row_number().over(order))


def version_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables stored as version=.../group=... with both as columns."""
    return spark.read.option("basePath", folder).parquet(folder)


def list_versions(rows: DataFrame) -> DataFrame:
    """Records with a commit, status complete, in store order (ord is carried)."""
    return rows.where("commit is not null and commit <> ''").withColumn("status", F.lit("complete"))


def register_functions(functions: DataFrame) -> DataFrame:
    """Registered name and file of pipeline functions (key, qualified_name): the name falls back to what follows the last
    `::` of the key; there is no file field in the facts, so file_path is empty."""
    name = F.coalesce(keys.present(keys.short_name(F.col("qualified_name"))), keys.short_name(F.col("key")))
    return functions.select("key", name.alias("name"), F.lit("").alias("file_path"))


"""Sinks: committed table writes, partitioned and versioned outputs, text, and content-addressed stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Replace a table; files appear with the job's commit only."""
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def write_version(df: DataFrame, folder: str, version: str) -> None:
    """Store a version beside the others (hash and edge snapshots, artefacts)."""
    df.write.mode("overwrite").parquet(f"{folder}/version_id={version}")


def copy_version(spark: SparkSession, folder: str, source: str, target: str) -> None:
    write_version(spark.read.parquet(f"{folder}/version_id={source}"), folder, target)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def grouped_json(df: DataFrame, group: str, path: str) -> DataFrame:
    """One JSON line per group with its rows in order, written and returned: (group, rows)."""
    cols = [c for c in df.columns if c != group]
    out = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))
    out.write.mode("overwrite").json(path)
    return out


def cached_compute(wanted: DataFrame, store: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """wanted (hash, payload) looked up in a content-addressed store (hash, result); what is missing is computed once a hash
    and appended. compute: (hash, payload) -> (hash, result)."""
    spark = wanted.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    have = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    missing = wanted.dropDuplicates(["hash"])
    if have:
        missing = missing.join(spark.read.parquet(store).select("hash"), "hash", "left_anti")
    compute(missing).select("hash", "result").write.mode("append").parquet(store)
    return wanted.join(spark.read.schema("hash string, result string").parquet(store), "hash", "left")

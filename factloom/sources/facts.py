"""Fact tables from the raw rows of an extractor. Parsing itself is outside: an extractor appends one row per sighting
(definition, call, access, token), in the order in which it walks a file; here the rows become keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.operators.derive import first_wins

#: How an access operator touches its target.
READS, WRITES = ("load", "compound", "increment"), ("store", "compound", "increment")


def definitions(sightings: DataFrame) -> DataFrame:
    """One row per key: the first definition, or the first declaration where there is none (declaration_only). sightings: key,
    is_definition, ord, ..."""
    once = first_wins(sightings, ["key"], [F.col("is_definition").desc(), F.col("ord")])
    return once.withColumn("declaration_only", ~F.col("is_definition")).drop("is_definition")


def types(sightings: DataFrame) -> DataFrame:
    """One row per qualified type name: a complete type before a forward declaration, then the first seen."""
    return first_wins(sightings, ["name"], [F.col("complete").desc(), F.col("ord")])


def call_edges(sightings: DataFrame) -> DataFrame:
    """(caller, callee), once each; unresolved callees drop."""
    return sightings.where("caller is not null and callee is not null").select("caller", "callee").distinct()


def global_access(sightings: DataFrame) -> DataFrame:
    """(fid, gid, is_read, is_write) over all sightings of a pair; a compound operator is both."""
    return sightings.groupBy("fid", "gid").agg(F.max(F.col("op").isin(*READS)).alias("is_read"), F.max(F.col("op").isin(*WRITES)).alias("is_write"))


def token_use(sightings: DataFrame) -> DataFrame:
    """(fid, token): distinct identifiers of each function's text."""
    return sightings.select("fid", F.explode(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\b"), 1)).alias("token")).distinct()


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Edges of straight-line code from ordered nodes (fkey, ord, node_id): each node to the next one."""
    from pyspark.sql import Window

    nxt = F.lead("node_id").over(Window.partitionBy("fkey").orderBy("ord"))
    return nodes.select("fkey", F.col("node_id").alias("source"), nxt.alias("target")).where("target is not null")


def deep_merge(base: dict, over: dict) -> dict:
    """Dictionaries merged level by level; other values of `over` win."""
    return {k: deep_merge(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}

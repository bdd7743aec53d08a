"""Comparison of documents: sections, blocks, tables, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.text import word_segments


def json_fingerprint(*cols: str | Column) -> Column:
    """Digest of named values in a fixed order of fields; nulls count."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def sections(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, diff_type): added, removed, changed or unchanged."""
    a, b = left.select(key, F.struct(value).alias("_a")), right.select(key, F.struct(value).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, kind.alias("diff_type"))


def sections_flat(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Like sections(), but what one side lacks counts as changed."""
    return sections(left, right, key, value).withColumn("diff_type", F.when(F.col("diff_type") == "unchanged", "unchanged").otherwise("changed"))


def ordinals(blocks: DataFrame, group: list[str], kind: str, order: list[str]) -> DataFrame:
    return blocks.withColumn("ordinal", F.row_number().over(Window.partitionBy(*group, kind).orderBy(*order)))


def align_blocks(left: DataFrame, right: DataFrame, group: list[str], kind: str, order: list[str], text: str) -> DataFrame:
    """Blocks paired by kind and place within their kind; diff_type by text."""
    a = ordinals(left, group, kind, order).select(*group, kind, "ordinal", F.col(text).alias("old"))
    b = ordinals(right, group, kind, order).select(*group, kind, "ordinal", F.col(text).alias("new"))
    t = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, [*group, kind, "ordinal"], "full_outer").withColumn("diff_type", t)


def table_rows(left: DataFrame, right: DataFrame, group: str, cells: str, order: str) -> DataFrame:
    """Rows of tables (group, order, cells array) compared by their first cell: of repeated keys the last left row is looked
    up, and every right row is given; removed left keys follow. marks: per cell same, changed, added or removed."""
    a = left.select(group, F.col(cells)[0].alias("k"), F.col(cells).alias("old"), F.col(order).alias("o"))
    last = a.groupBy(group, "k").agg(F.max_by("old", "o").alias("old"))
    b = right.select(group, F.col(cells)[0].alias("k"), F.col(cells).alias("new"), F.col(order).alias("ord"))
    both = b.join(last, [group, "k"], "left")
    gone = last.join(b.select(group, "k").distinct(), [group, "k"], "left_anti").select(group, "k", F.lit(None).cast(b.schema["new"].dataType).alias("new"), F.lit(None).cast(b.schema["ord"].dataType).alias("ord"), "old")
    out = both.unionByName(gone)
    pair = F.arrays_zip(F.coalesce("old", F.array().cast("array<string>")).alias("a"), F.coalesce("new", F.array().cast("array<string>")).alias("b"))
    mark = lambda p: F.when(p["a"].eqNullSafe(p["b"]), "same").when(p["a"].isNull(), "added").when(p["b"].isNull(), "removed").otherwise("changed")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return out.withColumn("marks", F.transform(pair, mark)).withColumn("diff_type", kind)


def render_diff(left: DataFrame, right: DataFrame, group: list[str], kind: str, order: list[str], text: str) -> DataFrame:
    """align_blocks() with the changed blocks' words in marked segments."""
    out = align_blocks(left, right, group, kind, order, text)
    same = F.array(F.struct(F.coalesce("new", "old").alias("text"), F.when(F.col("diff_type") == "unchanged", "same").otherwise(F.col("diff_type")).alias("mark")))
    changed = out.where("diff_type = 'changed'").withColumn("segments", word_segments("old", "new"))
    return changed.unionByName(out.where("diff_type <> 'changed'").withColumn("segments", same))


def summary(diff: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda t: F.count_if(F.col("diff_type") == t).alias(t)
    return (diff.groupBy(*by) if by else diff.groupBy()).agg(*map(n, ("added", "changed", "removed", "unchanged")))


def document_fingerprint(blocks: DataFrame, group: str, order: str, text: str, ignore: str = r"(/assets/|https?://)\S+") -> DataFrame:
    """(group, fp): digest of a document's block texts in order; asset addresses don't count."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ignore, "")
    items = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), clean.alias("t")))).alias("m"))
    return items.select(group, F.sha2(F.array_join(F.transform("m", lambda x: x["t"]), "\n"), 256).alias("fp"))


def multiset_hash(*columns: str) -> list[Column]:
    """Aggregates (size, sum_a, sum_b) that tell a multiset of rows by sums of 128 bits of each row's hash: the order of rows makes no
    difference, repeated rows count, and parts of a group add up, so a group of any size is a few numbers. Nulls differ from empty texts."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.conv(F.substring(row, k, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("size"), F.sum(part(1)).alias("sum_a"), F.sum(part(16)).alias("sum_b")]


def group_fingerprints(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group.., fp): a text that is the same for two groups if they hold the same rows."""
    return rows.groupBy(*group).agg(*multiset_hash(*columns)).select(*group, F.concat_ws(":", "size", "sum_a", "sum_b").alias("fp"))

"""Exact deduplication through an extendible-hash index kept in shared files.

Rows hash to 64-bit keys. The directory starts as one bucket; a bucket with more rows than it may hold is split by one more
bit of the keys, and the directory doubles when a bucket as deep as it is must split. A bucket owns the range of keys with its
prefix. Rows are dealt to owner tasks by bucket, each task holding whole buckets; in a bucket the rows of one key form a
chain, and a chain's links are told apart by comparing the bytes of the texts. Each link goes to the index: key range, key, digest,
largest id and number of rows. Every row then looks up its link.

A key with more rows than a bucket may hold (copies of one text, or a collision), which no bit can split, gets a bucket of its own with
overflow pages: its rows are dealt over pages by id, the chains of each page are combined first, then those of the bucket. So
copies that make up a third of all rows are spread over as many tasks as their number needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import text_or_empty
from factloom.scratch import Scratch

#: Rows that a bucket or page may hold, and the buckets that a directory is made for: of large tables a bucket holds more rows, so
#: that the directory has some 2 * DIRECTORY buckets at most (about 50 MB), whatever the input, and can be sent to every task.
BUCKET_ROWS, DIRECTORY = 2048, 1 << 20
#: Bits of a key.
KEY_BITS = 64


def prefix(key: Column | str, depth: Column | int) -> Column:
    """The top `depth` bits of a key as a non-negative number."""
    key = F.col(key) if isinstance(key, str) else key
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("long")).when(depth == KEY_BITS, key).otherwise(F.call_function("shiftrightunsigned", key, (F.lit(KEY_BITS) - depth).cast("int")))


def build_directory(keys: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """bucket (prefix), depth, rows, pages: buckets whose key ranges cover all keys and don't overlap, but for buckets of a single key
    with overflow pages (depth KEY_BITS), which come before others. keys: (key, n), a row per distinct key with its number of rows.

    A round splits every overfull bucket. Where all keys of a bucket are alike in their next bits, it goes down to the first bit in
    which they differ at once.
    """
    whole = F.col("n") <= bucket_rows
    pages = F.ceil(F.col("n") / bucket_rows).cast("int").alias("pages")
    done = keys.where(~whole).select(F.col("key").alias("bucket"), F.lit(KEY_BITS).alias("depth"), F.col("n").alias("rows"), pages)
    rest = keys.where(whole).select("key", "n")
    total, depth = rest.agg(F.sum("n")).first()[0] or 0, 0
    while depth < KEY_BITS and (total >> depth) > bucket_rows:
        depth += 1  # no bucket of evenly spread keys fits before that depth
    while True:
        at = rest.withColumn("bucket", prefix("key", depth)).groupBy("bucket").agg(F.sum("n").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        at = scratch.put(at.withColumn("depth", F.lit(depth)), "buckets")
        fits = F.col("rows") <= bucket_rows
        done = done.unionByName(at.where(fits).select("bucket", "depth", "rows", F.lit(1).alias("pages")))
        over = at.where(~fits).select("bucket", "low", "high")
        # the length of the longest prefix that all keys of some overfull bucket share
        shared = over.select(F.min(KEY_BITS - F.length(F.regexp_replace(F.bin(F.col("low").bitwiseXOR(F.col("high"))), "^0+", "")))).first()[0]
        if shared is None:
            return done
        rest = scratch.put(rest.withColumn("bucket", prefix("key", depth)).join(over.select("bucket"), "bucket", "left_semi").select("key", "n"), "overfull")
        depth = max(depth, shared) + 1


def placed(rows: DataFrame, directory: DataFrame, depths: list[int]) -> DataFrame:
    """rows (key, ...) with the depth, bucket and pages of the bucket that owns the key: a look-up for each depth that occurs."""
    found = []
    for d in sorted(depths, reverse=True):
        at = directory.where(F.col("depth") == d).select(F.col("bucket").alias(f"b{d}"), F.col("pages").alias(f"p{d}"))
        rows = rows.withColumn(f"b{d}", prefix("key", d)).join(F.broadcast(at), f"b{d}", "left")
        found.append(F.when(F.col(f"p{d}").isNotNull(), F.struct(F.lit(d).alias("depth"), F.col(f"b{d}").alias("bucket"), F.col(f"p{d}").alias("pages"))))
    own = F.coalesce(*found).alias("own")
    return rows.select("*", own).select("*", "own.*").drop("own", *[f"{x}{d}" for d in depths for x in "bp"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, key: Column | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; very long texts are compared whole; of equal texts the row with the
    largest id stays. Where that id occurs in several rows of a group, all of them carry kept = true. A null id never wins over
    another id; a group of null ids alone has keep_id null and kept = true. Extra columns are ignored; an empty table gives an
    empty one. `key` replaces the 64-bit hash of `text` (tests force splits and collisions with it).
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    key = F.xxhash64("text") if key is None else key
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", key)
    keys = scratch.put(rows.groupBy("key").agg(F.count("*").alias("n")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    directory = scratch.put(build_directory(keys, scratch, max(bucket_rows, -(-total // DIRECTORY))), "directory")
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # at most KEY_BITS + 1
    if not depths:
        index = rows.select("key", F.sha2("text", 256).alias("sha"), F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"))
    else:
        own = placed(rows, directory, depths).withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int"))
        # owner tasks hold whole buckets or pages; an equal key leads to a chain, equal bytes to a link of it
        owned = own.repartition("depth", "bucket", "page")
        chains = owned.groupBy("depth", "bucket", "page", "key", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("rows"), F.max("pages").alias("pages"))
        linked = scratch.put(chains.select("depth", "bucket", "pages", "key", F.sha2("text", 256).alias("sha"), "keep_id", "rows"), "chains")
        # pages of a bucket are put together: a row for each link and page
        index = linked.groupBy("depth", "bucket", "key", "sha").agg(F.max("keep_id").alias("keep_id"), F.sum("rows").alias("group_size")).select("key", "sha", "keep_id", "group_size")
    index = scratch.put(index, "index")
    found = rows.select("id", "key", F.sha2("text", 256).alias("sha")).join(index, ["key", "sha"])
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

"""A training-data pipeline of five stages over `documents`: quality classifier, line deduplication, near-duplicate
removal, personal-data redaction, packing. Each stage takes what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import line_dedup, packing, pii, quality, simhash
from factloom.llm.common import text_or_empty
from factloom.llm.queries import packed_digest
from factloom.operators.graph import connected_components
from factloom.scratch import Scratch, only_result

#: Near copies: words of a shingle.
COPY_WORDS = 5


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has that column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold go. Without labels to learn from, all stay."""
    scorer = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, scorer)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with a similar earlier line go; every document stays, if only with what is left of it."""
    return _with_length(line_dedup.dedup_lines(docs).select(*docs.columns))


def near_copies(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(n1, n2, component) of the texts that have a near copy. texts: (n1, n2, text), repeats welcome. Texts link when their
    SimHash fingerprints are within reach, and when the exact Jaccard similarity of their five-word shingles is 0.8 or more:
    such texts mostly differ in more bits than an index of fingerprints can guarantee."""
    prints = simhash.fingerprint_column(texts, "text", keep=["n1", "n2"]).groupBy("n1", "n2").agg(F.min("fp").alias("fp"))
    nodes = scratch.put(prints.withColumn("node", F.monotonically_increasing_id()), "nodes")
    alike = line_dedup.similar_texts(texts.withColumnRenamed("text", "line"), scratch, line_dedup.words(COPY_WORDS))
    classes = simhash.fingerprint_classes(nodes.select("fp").distinct(), scratch)
    placed = nodes.join(classes, "fp", "left").select("n1", "n2", "node", F.coalesce("component", "fp").alias("close"))
    placed = scratch.put(placed.join(alike.withColumnRenamed("component", "alike"), ["n1", "n2"], "left"), "placed")
    links = [placed.join(placed.where(f"{c} is not null").groupBy(c).agg(F.min("node").alias("first")), c).select(F.col("first").alias("a"), F.col("node").alias("b")) for c in ("close", "alike")]
    parts = connected_components(links[0].unionByName(links[1]), "a", "b")
    return parts.join(placed, "node").select("n1", "n2", "component")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, equal texts included, one row stays: the smallest id, then the smallest text hash; a row
    without an id only where no other has one. Of whole repeated rows one stays; a row is never dropped for another's id.
    Columns may have any names; an empty table gives an empty one."""
    scratch = Scratch(spark, "near-copies", small=True)
    id_ = F.col("doc_id").cast("long")
    text = text_or_empty()
    n1, n2 = line_dedup.identity(text)
    place = F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"), n1, n2).alias("place")
    rows = docs.select(place, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest"))
    parts = near_copies(docs.select(n1, n2, text.alias("text")), scratch)
    seen = rows.groupBy("place").agg(F.count("*").alias("n")).select("place", "n", F.col("place.n1").alias("n1"), F.col("place.n2").alias("n2")).join(parts, ["n1", "n2"], "left")
    # a text without a near copy is a group of its own
    alone = F.col("component").isNull()
    seen = scratch.put(seen.select("place", "n", F.coalesce("component", "n1").alias("g1"), F.when(alone, F.col("n2")).otherwise(0).alias("g2"), alone.alias("alone")), "seen")
    first = seen.groupBy("g1", "g2", "alone").agg(F.min("place").alias("first"))
    rule = seen.join(first, ["g1", "g2", "alone"]).select("place", (F.col("place") == F.col("first")).alias("stays"), "n").where("n > 1 or not stays")
    rule = scratch.put(rule, "rule")
    # rows that repeat the one that stays are combined before the shuffle
    once = rows.join(rule.where("stays").select("place"), "place", "left_semi").groupBy("place").agg(F.any_value("rest").alias("rest"))
    return rows.join(rule.select("place"), "place", "left_anti").select("rest.*").unionByName(once.select("rest.*"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.redact_column(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(packing.pack_documents(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("pii", redact_pii),
    ("best-fit packing", pack),
]
#: SQL can't express the trained stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's result is written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline", small=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with only_result(spark):  # what a stage has written besides its result goes, and then the result before
            last, docs = docs, scratch.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(last)
    return docs

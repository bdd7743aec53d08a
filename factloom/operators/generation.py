"""A whole run as tables that depend on each other, done again only where something has changed.

A task makes one table from others. Its fingerprint covers its own name and edition and the fingerprints of what it reads; a source's fingerprint is an
order-free hash of its rows. A manifest, a stored table, says under which fingerprint each task's table was written and where; a task whose
fingerprint is there is not run, and its table is read. A run that dies has done what the manifest says, and goes on from there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators.diff import multiset_hash
from factloom.sources.tables import StoredTable

MANIFEST = "task string, fingerprint string, path string, rows long"


@dataclass(frozen=True)
class Task:
    """make(*tables) -> the task's table; reads: names of sources and tasks; edition: changed when make changes."""

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]
    edition: str = "1"


@dataclass
class Run:
    tables: dict[str, DataFrame]
    status: dict[str, str] = field(default_factory=dict)  #: written or kept, by task


def in_order(tasks: list[Task], sources: set[str]) -> list[Task]:
    """Tasks after all that they read. Unknown names and cycles are errors."""
    left, known, out = list(tasks), set(sources), []
    while left:
        ready = [t for t in left if set(t.reads) <= known]
        if not ready:
            raise ValueError(f"cannot be made: {sorted(t.name for t in left)}")
        out += ready
        known |= {t.name for t in ready}
        left = [t for t in left if t.name not in known]
    return out


def source_fingerprint(table: DataFrame) -> str:
    row = table.agg(*multiset_hash(*sorted(table.columns))).first()
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(table.schema.fields, key=lambda f: f.name))
    return hashlib.sha256(f"{names}|{row['size']}|{row.sum_a}|{row.sum_b}".encode()).hexdigest()


def generate(spark: SparkSession, folder: str, sources: dict[str, DataFrame], tasks: list[Task]) -> Run:
    """Makes what isn't made yet in the folder, and returns all tables."""
    manifest = StoredTable(spark, f"{folder}/manifest", MANIFEST, "task")
    known = {r.task: r for r in manifest.read().collect()}  # a row a task
    prints = {n: source_fingerprint(s) for n, s in sources.items()}
    run = Run(dict(sources))
    for task in in_order(tasks, set(sources)):
        mark = hashlib.sha256("|".join([task.name, task.edition, *(prints[r] for r in task.reads)]).encode()).hexdigest()
        if task.name not in known or known[task.name].fingerprint != mark:
            path = f"{folder}/tables/{task.name}-{uuid.uuid4().hex}"
            task.make(*(run.tables[r] for r in task.reads)).write.parquet(path)
            rows = spark.read.parquet(path).count()
            manifest.put(spark.createDataFrame([(task.name, mark, path, rows)], MANIFEST))
            run.tables[task.name], run.status[task.name] = spark.read.parquet(path), "written"
        else:
            run.tables[task.name], run.status[task.name] = spark.read.parquet(known[task.name].path), "kept"
        prints[task.name] = mark
    return run


def report(spark: SparkSession, run: Run) -> DataFrame:
    """(task, status) of a run."""
    return spark.createDataFrame(sorted(run.status.items()), "task string, status string").orderBy(F.col("task"))

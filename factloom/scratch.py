"""Tables written to the folder that all executors share, to cut lineage and to survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Spark's switch for deleting the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What the loops broadcast at most: files of this size as planned, rows of this size once they are counted.
SMALL = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may do without that setting: a temporary folder is used then."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "_own", None)
        if base is None:
            base = shared_dir._own = tempfile.mkdtemp(prefix="factloom-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables of this session. Frames that still read them can't be used afterwards, so it is the caller
    who knows when."""
    while _roots:
        _delete(spark, _roots.pop())


@contextlib.contextmanager
def only_result(spark: SparkSession) -> Iterator[None]:
    """Around a step whose result is written elsewhere: the scratch tables that it has made are deleted when it is done."""
    before = len(_roots)
    try:
        yield
    finally:
        for path in _roots[before:]:
            _delete(spark, path)
        del _roots[before:]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A private subfolder of the shared folder. put() materialises a frame as Parquet and reads it back.

    Every broadcast passes through the driver. A loop makes one or more a round, and Spark judges a table by its files, which are many times
    smaller than its rows: `small` broadcasts keeps a loop to tables of SMALL size, so that its sum does not grow with the input."""

    def __init__(self, spark: SparkSession, label: str = "job", small: bool = False):
        self.spark = spark
        self.settings = {CLEANUP: "true"} | (SMALL if small else {})
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.append(self.root)

    def put(self, df: DataFrame, label: str = "t", *by: str) -> DataFrame:
        """Write df once; later reads come from files, so a lost executor costs no recomputation. What the write has shuffled
        is of no use after it, so Spark is told to delete those files when it ends. Rows that differ in the columns `by` go to folders of
        their own, so a filter on them reads no others."""
        self._n += 1
        path = f"{self.root}/{label}-{self._n}"
        before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)
        try:
            df.write.mode("overwrite").partitionBy(*by).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                _delete(self.spark, path)

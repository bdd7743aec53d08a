"""Job logs as streams: an append-only log read on from a cursor, and the state of each job kept from its lines."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.scratch import shared_dir
from factloom.sources.tables import StoredTable

#: The phase that a kind of line announces, the number of phases, seconds a phase is expected to take.
PHASES, LAST_PHASE, PHASE_SECONDS = {"view": 1, "click": 2, "signup": 3, "purchase": 4}, 4, 120


def phase_of(kind):
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PHASES.items()], F.lit(0))


def job_state(lines: DataFrame, job: str, kind: str = "event_type", at: str = "ts") -> DataFrame:
    """(job, n_lines, phase, duration, eta): the phase only advances; duration is whole seconds, at least 1. The same
    aggregate runs over a batch or a stream (update mode)."""
    out = lines.groupBy(job).agg(F.count("*").alias("n_lines"), F.max(phase_of(F.col(kind))).alias("phase"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    seconds = F.floor((F.unix_micros(F.col("_b").cast("timestamp")) - F.unix_micros(F.col("_a").cast("timestamp"))) / 1_000_000).cast("long")
    return out.select(job, "n_lines", "phase", F.greatest(F.lit(1), seconds).alias("duration"), ((LAST_PHASE - F.col("phase")) * PHASE_SECONDS).alias("eta"))


def stream_log(spark: SparkSession, schema, folder: str, name: str = "*") -> DataFrame:
    """A folder of Parquet files as a stream of log lines."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, once, with offsets kept in `checkpoint`: calling it again goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _job_folder(spark: SparkSession, job: str) -> str:
    """Where a job's offsets and results stay between calls: under the shared folder, by the job's name."""
    return f"{shared_dir(spark)}/jobs/{job}"


def follow(spark: SparkSession, stream: DataFrame, job: str) -> DataFrame:
    """The lines that have come since the last call with this job's name; all that are there at the first call. The offsets are the stream's
    checkpoint, so a call that dies half-way is made up by the next: a batch's lines are a folder named by its number, written anew
    if the batch is. Calls before keep their lines."""
    base = _job_folder(spark, job)
    seen: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/lines/batch={number}")
        seen.append(number)

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{base}/lines/batch={n}" for n in seen])


def read_log(spark: SparkSession, like: DataFrame, path: str, cursor: int, order: str = "event_id", job: str | None = None) -> DataFrame:
    """Lines of a log (a folder of Parquet files, or one) after a cursor. With a job's name, a later call returns only what has come since."""
    folder, name = path.rsplit("/", 1)
    source = spark.read.parquet(path)
    stream = stream_log(spark, source.schema, folder, name).select(*like.columns).where(F.col(order) > cursor)
    return follow(spark, stream, job or f"log-{uuid.uuid4().hex}")


#: What is kept of a job between lines: lines, lines that came late, its phase, first and last time, the time at which each phase began (-1: it
#: was passed over or not reached), and the text of its latest line. Times are microseconds.
STATE = "n_lines long, n_late long, phase int, first long, last long, began array<long>, activity string"


def job_phases(lines: DataFrame, job: str, kind: str = "event_type", at: str = "ts", text: str = "activity", order: str = "event_id") -> DataFrame:
    """A stream of (job, columns of STATE): a row for each job whenever it has new lines. A phase only advances, by the lines in order of time; a line
    earlier than one that an earlier batch brought is late: it is counted, and may move the first time, but changes neither phase nor activity."""
    typed = lines.select(job, phase_of(F.col(kind)).cast("int").alias("_phase"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(text).cast("string").alias("_text"), F.col(order).cast("long").alias("_order"))
    key_type = lines.schema[job].dataType.simpleString()

    def step(key, frames, state):
        n, late, phase, first, last, began, activity = state.get if state.exists else (0, 0, 0, None, None, [-1] * LAST_PHASE, None)
        rows = sorted((r for f in frames for r in f[["_at", "_order", "_phase", "_text"]].itertuples(index=False, name=None)), key=lambda r: r[:2])
        before, began = last, list(began)
        for when, _, p, said in rows:
            n, first = n + 1, when if first is None else min(first, when)
            if before is not None and when < before:
                late += 1
                continue
            last, activity = when if last is None else max(last, when), said
            if p > phase:
                phase, began[p - 1] = p, when
        new = (int(n), int(late), int(phase), int(first), int(last), [int(b) for b in began], activity)
        state.update(new)
        yield pd.DataFrame([(*key, *new)], columns=[job, *STATE_NAMES])

    return typed.groupBy(job).applyInPandasWithState(step, f"`{job}` {key_type}, {STATE}", STATE, "update", "NoTimeout")


STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def track_jobs(spark: SparkSession, lines: DataFrame, name: str, table: StoredTable, **columns: str) -> DataFrame:
    """Reads what has come to a log since the last call under this name, brings the jobs' rows in the table up to date, and returns it. State,
    offsets and table stay in shared folders: a later call, or another session, goes on from there. A batch that is done again puts the
    same rows."""
    states = job_phases(lines, **columns)
    states.writeStream.outputMode("update").foreachBatch(lambda batch, _: table.put(batch) and None).option("checkpointLocation", f"{_job_folder(spark, name)}/offsets").trigger(availableNow=True).start().awaitTermination()
    return table.read()

"""Logs that are followed and jobs that are tracked over several calls; providers that fail."""

import datetime as dt
import uuid

import pytest

from factloom.extensions import enrich_halving
from factloom.scratch import shared_dir
from factloom.sources.tables import StoredTable
from factloom.streaming import progress

LINES = "user_id long, event_id long, ts timestamp, event_type string, activity string"


@pytest.fixture
def job(spark):
    return f"job-{uuid.uuid4().hex}"


def add(spark, folder, *rows):
    start = dt.datetime(2024, 1, 1)
    data = [(u, i, start + dt.timedelta(seconds=s), kind, f"{kind} {i}") for u, i, s, kind in rows]
    spark.createDataFrame(data, LINES).coalesce(1).write.mode("append").parquet(folder)


def test_a_second_call_reads_only_new_lines(spark, job):
    folder = f"{shared_dir(spark)}/{job}/log"
    add(spark, folder, (1, 1, 0, "view"), (1, 2, 1, "click"))
    stream = progress.stream_log(spark, spark.read.parquet(folder).schema, folder)
    ids = lambda: sorted(r.event_id for r in progress.follow(spark, stream, job).collect())
    assert ids() == [1, 2] and ids() == []
    add(spark, folder, (1, 3, 2, "view"))
    assert ids() == [3]


def test_a_call_that_died_is_made_up(spark, job, monkeypatch):
    folder = f"{shared_dir(spark)}/{job}/log"
    add(spark, folder, (1, 1, 0, "view"))
    table = StoredTable(spark, f"{shared_dir(spark)}/{job}/t", f"user_id long, {progress.STATE}", "user_id")
    track = lambda: progress.track_jobs(spark, progress.stream_log(spark, spark.read.parquet(folder).schema, folder), job, table, job="user_id").collect()
    with monkeypatch.context() as m:
        m.setattr(table, "put", lambda rows: 1 / 0)
        with pytest.raises(Exception, match="division"):
            track()
    assert [(r.user_id, r.n_lines, r.phase) for r in track()] == [(1, 1, 1)]


def test_phases_only_advance_and_late_lines_are_counted(spark, job):
    folder = f"{shared_dir(spark)}/{job}/log"
    table = StoredTable(spark, f"{shared_dir(spark)}/{job}/t", f"user_id long, {progress.STATE}", "user_id")
    add(spark, folder, (1, 1, 10, "view"), (1, 2, 20, "signup"), (1, 3, 30, "click"), (2, 4, 5, "error"))
    stream = progress.stream_log(spark, spark.read.parquet(folder).schema, folder)
    track = lambda: {r.user_id: r for r in progress.track_jobs(spark, stream, job, table, job="user_id").collect()}
    one = track()
    zero = one[2].first - 5_000_000
    assert (one[1].n_lines, one[1].phase, one[1].activity, one[1].n_late) == (3, 3, "click 3", 0)
    assert list(one[1].began) == [zero + 10_000_000, -1, zero + 20_000_000, -1] and (one[2].phase, list(one[2].began)) == (0, [-1] * 4)
    add(spark, folder, (1, 5, 2, "purchase"), (1, 6, 40, "view"))
    two = track()
    assert (two[1].n_lines, two[1].n_late, two[1].phase, two[1].activity, two[1].first, two[1].last) == (5, 1, 3, "view 6", zero + 2_000_000, zero + 40_000_000)
    assert two[2].n_lines == 1 and track() == two


def test_halving_loses_only_the_rows_that_fail(spark):
    asked = [(k, f"p{k}") for k in range(100)] + [(100, None)]
    rows = spark.createDataFrame(asked, "k long, p string").coalesce(1)

    def provider(prompts):
        if {"p13", "p14"} & set(prompts):
            raise RuntimeError("bad row")
        return prompts[:-1] if "p50" in prompts and len(prompts) > 1 else ["" if p == "p60" else p + "!" for p in prompts]

    out = {r.k: r for r in enrich_halving(rows, "p", provider, batch=16).collect()}
    assert {k for k, r in out.items() if r.reason} == {13, 14, 60, 100}
    assert out[13].reason == "RuntimeError: bad row" and out[13].settled_by == 1 and out[60].reason == "no answer" and out[100].reason == "no prompt"
    assert all(out[k].answer == f"p{k}!" for k in range(100) if k not in (13, 14, 60)) and out[50].settled_by == 1 and out[90].settled_by == 16
    bounded = {r.k: r for r in enrich_halving(rows, "p", provider, batch=16, cuts=1).collect()}
    assert {k for k, r in bounded.items() if r.reason} == {*range(8, 16), *range(48, 56), 60, 100}

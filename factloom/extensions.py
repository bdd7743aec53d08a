"""Extension points: views, table repositories, and providers of per-row results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from factloom.operators import service
from factloom.sources.tables import StoredTable

View = Callable[[dict[str, DataFrame], dict], DataFrame]
VIEWS: dict[str, View] = {}
#: Views that run unless a configuration turns them off.
DEFAULT_ON = {"interface_tables"}


def register(name: str) -> Callable[[View], View]:
    def put(fn: View) -> View:
        VIEWS[name] = fn
        return fn

    return put


def run_views(model: dict[str, DataFrame], config: dict) -> dict[str, DataFrame]:
    """Result of every registered view that the configuration's `views` turn on."""
    on = config.get("views", {})
    return {n: f(model, config) for n, f in VIEWS.items() if on.get(n, n in DEFAULT_ON)}


class Repository:
    """One catalog table behind create, get, list, update and delete. The backend is a stored table with a transaction log: all
    repositories on a folder see each other's changes, and a reader never sees half of one."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id"):
        self.table, self.key = StoredTable(spark, folder, schema, key), key

    @property
    def version(self) -> int:
        return self.table.version()

    def all(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def put(self, rows: DataFrame) -> None:
        self.table.put(rows)

    def create(self, rows: DataFrame) -> None:
        """Rows whose keys are new; others stay as they are."""
        self.table.insert_missing(rows)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Puts what `change` makes of the rows as they are."""
        self.table.update(change)

    def delete(self, keys: DataFrame) -> None:
        self.table.delete(keys)

    def get(self, value) -> DataFrame:
        return self.all().where(F.col(self.key) == F.lit(value))

    def search(self, query: str, fields: list[str], limit: int) -> DataFrame:
        return service.matching(self.all(), None, query, fields).orderBy(fields[0], self.key).limit(limit)


Provider = Callable[[list[str]], list[str | None]]


def null_provider(prompts: list[str]) -> list[str | None]:
    """Answers nothing; the deterministic parts around it still run."""
    return [None] * len(prompts)


def enrich(rows: DataFrame, prompt: str, provider: Provider = null_provider, out: str = "answer") -> DataFrame:
    """rows with a provider's answer to each row's prompt, batch by batch on the executors."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: pd.Series(provider(b[prompt].tolist()), index=b.index, dtype=object)})

    return rows.mapInPandas(run, schema)


#: Times a failed batch may be cut in two.
MOST_CUTS = 12


def _asked(prompts: list[str], provider: Provider, cuts: int) -> list[tuple[str | None, str | None, int]]:
    """(answer, reason, size of the batch that settled it) for each prompt. A batch fails as a whole by an error or by an answer of another
    length; it is cut in two then, until a batch of one or of the last cut fails. An answer that is missing or blank fails alone."""
    out: list[tuple[str | None, str | None, int]] = []
    todo = [(0, len(prompts), cuts)]
    while todo:
        lo, hi, left = todo.pop()
        if lo == hi:
            continue
        try:
            answers = provider(prompts[lo:hi])
            if len(answers) != hi - lo:
                raise ValueError(f"{len(answers)} answers to {hi - lo} prompts")
        except Exception as error:  # whatever a provider raises
            if hi - lo > 1 and left:
                mid = (lo + hi) // 2
                todo += [(mid, hi, left - 1), (lo, mid, left - 1)]  # the first half is next
            else:
                out += [(None, f"{type(error).__name__}: {error}", hi - lo)] * (hi - lo)
            continue
        out += [(a, None if a is not None and a.strip() else "no answer", hi - lo) for a in answers]
    return out


def enrich_halving(rows: DataFrame, prompt: str, provider: Provider = null_provider, batch: int = 32, cuts: int = MOST_CUTS, out: str = "answer") -> DataFrame:
    """rows with `out`, `reason` (null if there is an answer) and `settled_by` (the size of the batch that gave either). Prompts go to the
    provider `batch` at a time; a batch that fails is halved, so rows that make a provider fail lose only themselves. A null prompt
    isn't asked."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType()), T.StructField("reason", T.StringType()), T.StructField("settled_by", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, found = b[prompt].tolist(), [(None, "no prompt", 0)] * len(b)
            asked = [k for k, t in enumerate(texts) if isinstance(t, str)]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for k, result in zip(part, _asked([texts[j] for j in part], provider, cuts), strict=True):
                    found[k] = result
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield b.assign(**{c: pd.Series(list(v), index=b.index, dtype=t) for c, v, t in zip((out, "reason", "settled_by"), columns, (object, object, "int32"), strict=True)})

    return rows.mapInPandas(run, schema)

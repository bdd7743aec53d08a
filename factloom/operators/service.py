"""Queries and changes over catalog tables: filtered, paged and aggregated reads; inserts, updates and deletes as new
versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def matching(df: DataFrame, equal: dict[str, object] | None = None, query: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows that meet every given equality (None: not asked for) and hold the query in one of the fields, whatever the case."""
    for c, v in (equal or {}).items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    if query:
        cond: Column | None = None
        for f in fields or []:
            one = F.contains(F.lower(F.col(f)), F.lit(query.lower()))
            cond = one if cond is None else cond | one
        df = df.where(cond)
    return df


def page(df: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """A page (1-based) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counted_page(df: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """page() with the total of all matching rows on each row; the total is one aggregate, not a window over all rows."""
    return page(df, order, number, size).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def status_counts(df: DataFrame, group: list[str], status: str, known: list[str]) -> DataFrame:
    """total and a column for each known status (0 where it doesn't occur); statuses that aren't known add to the total."""
    return df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in known])


def totals_row(df: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """Sums and calls by group, and a TOTAL row if there is more than one group."""
    by = df.groupBy(*group).agg(F.count("*").alias("calls"), *[F.sum(s).alias(s) for s in sums])
    total = by.agg(F.count("*").alias("_n"), F.sum("calls").alias("calls"), *[F.sum(s).alias(s) for s in sums]).where("_n > 1")
    return by.unionByName(total.select(*[F.lit("TOTAL").alias(g) for g in group], "calls", *sums))


def latest(df: DataFrame, group: str, by: list[str]) -> DataFrame:
    """The row of each group that is greatest by the given columns."""
    cols = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.max_by(F.struct(*cols), F.struct(*by)).alias("m")).select(group, "m.*")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table, key, "left_anti"))


def delete(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.join(rows, key, "left_anti")


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Columns set where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


#: Users that documents may be assigned to at once.
MOST_USERS = 1000


def all_pairs_assign(assignments: DataFrame, docs: DataFrame, users: DataFrame) -> DataFrame:
    """Plain append of every document with every user of a stated list; repeats are kept. The list may have MOST_USERS rows: it is
    sent to every task, and a longer one is an error rather than a flood of rows."""
    if users.limit(MOST_USERS + 1).count() > MOST_USERS:
        raise ValueError(f"more than {MOST_USERS} users")
    return assignments.unionByName(docs.select("doc_id").crossJoin(F.broadcast(users.select("user_id").limit(MOST_USERS))))


def replace_partition(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in `rows` replaced, others kept."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def throttle(last: Column, now: Column, seconds: int) -> Column:
    """True where the last time is missing or at least `seconds` ago."""
    return last.isNull() | (now - last >= F.make_dt_interval(secs=F.lit(seconds)))


def dashboard(projects: DataFrame, versions: DataFrame, documents: DataFrame, jobs: DataFrame, key: str = "project") -> DataFrame:
    """projects with their latest version, that version's status counts, and the current job (cancelled ones don't count)."""
    v = versions.groupBy(key).agg(F.max_by("version", F.struct("created_at", "version")).alias("version"), F.count("*").alias("n_versions"))
    s = documents.groupBy("version").agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "approved").alias("n_approved"))
    j = jobs.where("state <> 'cancelled'").groupBy(key).agg(F.max_by("job", F.struct("started_at", "job")).alias("job"))
    return projects.join(v, key, "left").join(s, "version", "left").join(j, key, "left")


def running_max(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"{value}_so_far", F.max(value).over(w))


# ---- small reads that reports are made of ---------------------------------------------------------------------------
def members(rows: DataFrame, allowed: DataFrame, key: str | list[str]) -> DataFrame:
    """The rows whose key is among the allowed ones; repeated keys there don't repeat rows."""
    return rows.join(allowed, key, "left_semi")


def visible(rows: DataFrame, file: str, hidden: str, suffixes: tuple[str, ...], components: DataFrame | None = None, component: str = "component") -> DataFrame:
    """The rows of files with one of the suffixes that aren't hidden (null: not hidden) and lie in one of the components, if any are named."""
    kept = rows.where(~F.coalesce(F.col(hidden), F.lit(False)))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.endswith(F.col(file), F.lit(s))
    kept = kept.where(ends)
    return kept if components is None else members(kept, components, component)


def assignees(items: DataFrame, ids: str, users: DataFrame, item: str, user: str) -> DataFrame:
    """(item, columns of users, place): the known users among an item's array of ids, in the order of the array, places from 1."""
    each = items.select(item, F.posexplode(ids).alias("_at", user)).join(users, user)
    return each.select(item, *users.columns, F.row_number().over(Window.partitionBy(item).orderBy("_at", user)).alias("place"))


def commits_with_tags(commits: DataFrame, tags: DataFrame, head: DataFrame, commit: str, order: str) -> DataFrame:
    """commits with their last tag by `order` (null: none), and whether each is the head. head: a frame of one row with the commit."""
    last = tags.groupBy(commit).agg(F.max_by("tag", order).alias("tag"))
    at = head.select(F.col(commit), F.lit(True).alias("_head"))
    return commits.join(last, commit, "left").join(F.broadcast(at), commit, "left").select(*commits.columns, "tag", F.coalesce("_head", F.lit(False)).alias("is_current"))


def review_progress(rows: DataFrame, group: list[str], done: Column, hidden: Column) -> DataFrame:
    """(group.., total, done, hidden): how many rows there are, are done, and are hidden; null counts as neither."""
    return rows.groupBy(*group).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(hidden).alias("hidden"))


def in_order(rows: DataFrame, group: list[str], order: str, text: str, separator: str, out: str) -> DataFrame:
    """(group.., out): the texts of each group in order, joined."""
    held = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_m"))
    return held.select(*group, F.array_join(F.transform("_m", lambda x: x["t"]), separator).alias(out))

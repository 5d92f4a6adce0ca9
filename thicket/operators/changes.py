"""Table changes as new versions of a frame.

Nothing is changed in place: each function returns the next version (or the split of accepted
and refused rows), to be written to a new folder. Changes come as frames, so a bulk change is
one join on the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, id_from: Sequence[str], defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """Append rows with an id derived from their natural key and defaults for missing columns."""
    for name, value in (defaults or {}).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0002"))  # noqa: E731  a null is a value of its own
    key = F.md5(F.concat_ws("\u0001", *[part(c) for c in id_from]))
    return table.unionByName(rows.withColumn("id", key), allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, id: str = "id", order: Sequence[str] = ()) -> DataFrame:
    """Partial update: ``changes`` has the id, new values and ``fields``, the names that were set.

    A field that was set to null becomes null; one that was not set keeps its value. Of several
    changes to a field of one row the last by ``order`` counts; without an order, or where it ties,
    the one with the greatest value. The table keeps its rows.
    """
    fields = [c for c in changes.columns if c not in (id, "fields", *order) and c in table.columns]
    was_set = lambda c: F.array_contains("fields", c)
    entry = lambda c: F.when(was_set(c), F.struct(*[F.col(o).alias(f"o_{o}") for o in order], F.col(c).alias("value")))
    new = changes.groupBy(id).agg(*[F.max(entry(c)).alias(f"_{c}") for c in fields]) if fields else changes.select(id).distinct()
    joined = table.join(new, id, "left")
    value = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["value"]).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in fields else F.col(c) for c in table.columns])


def delete(table: DataFrame, ids: DataFrame, hard: bool = False, id: str = "id", flag: str = "is_deleted") -> DataFrame:
    """Remove or flag the rows whose id is listed."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id)).distinct()
    if hard:
        return table.join(wanted, id, "left_anti")
    marked = table.join(wanted.withColumn("_hit", F.lit(True)), id, "left")
    new = F.col("_hit").isNotNull()
    return marked.withColumn(flag, F.col(flag) | new if flag in table.columns else new).select(
        *table.columns, *([] if flag in table.columns else [flag])
    )


def hit_counts(table: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """How many of the listed ids exist and how many do not."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id)).distinct()
    found = table.select(id, F.lit(True).alias("_hit")).distinct()
    return wanted.join(found, id, "left").agg(
        F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses")
    )


def duplicates(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys used more than once."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > 1)


def taken(table: DataFrame, wanted: DataFrame, key: str, id: str = "id") -> DataFrame:
    """Which wanted values are used by a row other than the one that asks (null id: a new row)."""
    holders = table.select(F.col(key), F.col(id).alias("_holder"))
    other = F.col(id).isNull() | (F.col("_holder") != F.col(id))
    joined = wanted.join(holders, key, "left")
    return joined.groupBy(key, id).agg(F.coalesce(F.bool_or(F.col("_holder").isNotNull() & other), F.lit(False)).alias("taken"))


def exists(table: DataFrame, test: Column) -> DataFrame:
    """One boolean; the limit lets the scan stop at the first hit."""
    return table.where(test).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def set_where(table: DataFrame, test: Column, values: Mapping[str, Any]) -> DataFrame:
    """Set columns on rows that satisfy the test; a null test changes nothing."""
    hit = F.coalesce(test, F.lit(False))
    out = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    return table.withColumns(out)


def delete_where(table: DataFrame, test: Column) -> DataFrame:
    return table.where(~F.coalesce(test, F.lit(False)))


def set_status(table: DataFrame, ids: DataFrame, column: str, value: Any, id: str = "id") -> DataFrame:
    """Set one column on all listed rows."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id), F.lit(True).alias("_hit")).distinct()
    return table.join(wanted, id, "left").withColumn(
        column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))
    ).select(*table.columns)


def retain(table: DataFrame, ts: str, cutoff: Column, only: Column | None = None) -> DataFrame:
    """Rows that survive retention: newer than the cut-off, or outside ``only``."""
    old = F.col(ts) < cutoff
    return delete_where(table, old if only is None else old & only)


def retention_counts(table: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows retention would remove and keep; a row without a time is kept."""
    old = F.col(ts) < cutoff
    return table.agg(F.count_if(old).alias("removed"), F.count_if(~F.coalesce(old, F.lit(False))).alias("kept"))


def expire_jobs(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Soft-delete one-time jobs whose run date has passed."""
    done = (F.col("trigger_type") == "date") & (F.col("run_date") < cutoff) & ~F.col("is_deleted")
    return set_where(jobs, done, {"is_deleted": True})


def mark_all_read(messages: DataFrame, user, msg_type: str | None, now: Column) -> DataFrame:
    """Mark a user's unread messages as read, optionally of one type."""
    test = (F.col("recipient_id") == user) & (F.col("status") == "unread")
    if msg_type is not None:
        test = test & (F.col("msg_type") == msg_type)
    if "read_at" not in messages.columns:
        messages = messages.withColumn("read_at", F.lit(None).cast("timestamp_ntz"))
    return set_where(messages, test, {"read_at": now, "status": "read"})


def delete_read(messages: DataFrame, user) -> DataFrame:
    return delete_where(messages, (F.col("recipient_id") == user) & (F.col("status") == "read"))


def add_receipts(receipts: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append receipts that are not there yet; asking twice changes nothing."""
    rest = [c for c in new.columns if c not in key]
    if rest:  # the smallest receipt as a whole, so that its columns stay together
        first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])
    else:
        first = new.distinct()
    return receipts.unionByName(first.join(receipts, list(key), "left_anti"), allowMissingColumns=True)


def add_counts(table: DataFrame, events: DataFrame, key: str, column: str, id: str = "id") -> DataFrame:
    """Add the number of events per key to a counter column; events are counted before the join."""
    counts = events.groupBy(F.col(key).alias(id)).agg(F.count(F.lit(1)).alias("_n"))
    return table.join(counts, id, "left").withColumn(
        column, F.coalesce(F.col(column), F.lit(0)) + F.coalesce("_n", F.lit(0))
    ).select(*table.columns)


def replace_links(links: DataFrame, owner: str, new: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Replace all links of the listed owners by ``new``; an owner without new links loses all.

    Without ``owners``, the owners are those that ``new`` names.
    """
    named = new.select(owner) if owners is None else owners.select(F.col(owners.columns[0]).alias(owner))
    return links.join(named.distinct(), owner, "left_anti").unionByName(new)


def set_member(users: DataFrame, ids: DataFrame, column: str, value: Any) -> DataFrame:
    """Put the listed users into a department, role or post (None takes them out)."""
    dtype = dict(users.dtypes)[column]
    return set_status(users, ids, column, F.lit(value).cast(dtype))


def changed_members(users: DataFrame, ids: DataFrame, column: str, value: Any) -> DataFrame:
    """How many of the listed users really change."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    return users.join(wanted, "id", "left_semi").agg(
        F.count_if(~F.col(column).eqNullSafe(F.lit(value))).alias("changed")
    )


def copy_with_links(table: DataFrame, link: DataFrame, owner: str, source: Any, changes: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Copy a row under new values, and its links under the new id."""
    row = table.where(F.col("id") == source)
    for name, value in changes.items():
        row = row.withColumn(name, F.lit(value))
    links = link.where(F.col(owner) == source).withColumn(owner, F.lit(changes["id"]))
    return table.unionByName(row), link.unionByName(links)


def append(log: DataFrame, new: DataFrame) -> DataFrame:
    return log.unionByName(new, allowMissingColumns=True)


def cascade(parents: DataFrame, doomed: DataFrame, levels: Sequence[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Delete ids and everything that refers to them, level by level.

    ``levels`` lists (table, foreign key) from the outermost child inward; each has an ``id``.
    """
    gone = doomed.select(F.col(doomed.columns[0]).alias("id"))
    out = [parents.join(gone, "id", "left_anti")]
    for table, key in levels:
        hit = gone.select(F.col("id").alias(key))
        out.append(table.join(hit, key, "left_anti").select(*table.columns))
        gone = table.join(hit, key, "left_semi").select("id")
    return out


def guarded(table: DataFrame, ids: DataFrame, allowed: Column, values: Mapping[str, Any]) -> DataFrame:
    """State change with a guard: one row per listed id with the outcome.

    ``outcome`` is 'changed', 'refused' or 'missing'; changed rows carry the new values.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    joined = wanted.join(table.withColumn("_here", F.lit(True)), "id", "left")
    ok = F.col("_here") & F.coalesce(allowed, F.lit(False))
    outcome = F.when(F.col("_here").isNull(), "missing").when(ok, "changed").otherwise("refused")
    return set_where(joined.withColumn("outcome", outcome), F.col("outcome") == "changed", values).drop("_here")


def guarded_delete(ids: DataFrame, deletable: DataFrame) -> DataFrame:
    """Which of the listed ids are deleted and which are returned as failed."""
    wanted = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
    free = deletable.select("id", F.lit(True).alias("_free")).distinct()
    return wanted.join(free, "id", "left").select("id", F.col("_free").isNotNull().alias("deleted"))


def set_flag(table: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """True for rows whose id is in ``done``, else unchanged."""
    return set_status(table, done, column, True)

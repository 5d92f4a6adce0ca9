"""Optional filters, keyword search, id lookups and soft delete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_by(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    icontains: Mapping[str, str | None] | None = None,
    contains: Mapping[str, str | None] | None = None,
    between: Mapping[str, tuple[Any, Any]] | None = None,
) -> DataFrame:
    """AND of the filters that were given; ``None`` means the filter is not set."""
    tests: list[Column] = []
    tests += [F.col(c) == v for c, v in (equals or {}).items() if v is not None]
    tests += [F.col(c).ilike(f"%{v}%") for c, v in (icontains or {}).items() if v]
    tests += [F.col(c).contains(v) for c, v in (contains or {}).items() if v]
    for c, (low, high) in (between or {}).items():
        if low is not None:
            tests.append(F.col(c) >= F.lit(low))
        if high is not None:
            tests.append(F.col(c) <= F.lit(high))
    return reduce(DataFrame.where, tests, df)


def in_folder(df: DataFrame, parent: str | None, column: str = "parent_id") -> DataFrame:
    """Rows of a folder; no folder means the top level."""
    return df.where(F.col(column).isNull() if parent is None else F.col(column) == parent)


def keyword_any(df: DataFrame, keyword: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any of the columns contains the keyword, ignoring case."""
    return df.where(reduce(Column.__or__, [F.col(c).ilike(f"%{keyword}%") for c in columns]))


def by_ids(df: DataFrame, ids: Sequence[Any] | DataFrame, column: str = "id") -> DataFrame:
    """Rows with one of the ids: a short list, or a frame whose first column holds them."""
    if isinstance(ids, DataFrame):
        wanted = ids.select(F.col(ids.columns[0]).alias("_id"))
        return df.join(wanted, F.col(column) == F.col("_id"), "left_semi")
    return df.where(F.col(column).isin(list(ids)))


def alive(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(~F.col(flag))


def enabled(df: DataFrame, flag: str, order: Sequence[Any], deleted: str | None = None) -> DataFrame:
    """Enabled, not deleted rows in their fixed order."""
    out = df.where(F.col(flag))
    if deleted:
        out = alive(out, deleted)
    return out.orderBy(*order)


def cutoff(df: DataFrame, ts: str, as_of: Any | None, **back: float) -> Column:
    """``as_of`` minus a span; without ``as_of`` the newest time in the data is used."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else df.agg(F.max(ts)).scalar()
    return now - F.make_dt_interval(**{k: F.lit(v) for k, v in back.items()})


def since(df: DataFrame, ts: str, as_of: Any | None = None, **back: float) -> DataFrame:
    """Rows in a look-back window, for example ``since(log, 'ts', days=30)``."""
    return df.where(F.col(ts) >= cutoff(df, ts, as_of, **back))


def labelled(column: Column | str, labels: Mapping[Any, str], default: str | None = None) -> Column:
    """Code to label by a map literal; unknown codes get ``default``, null stays null."""
    column = F.col(column) if isinstance(column, str) else column
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), column)
    return F.when(column.isNotNull(), F.coalesce(found, F.lit(default)))

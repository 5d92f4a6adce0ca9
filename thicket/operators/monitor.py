"""Operators over counter samples, table statistics and slow logs.

Histories of one host can be as long as the table, so look-back windows run on slices of long
hosts (see :func:`thicket.ordering.blocked`) and never on a whole one at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import decimals
from thicket.ordering import blocked, dense_index, unblocked
from thicket.operators.logstats import percent


def moving_averages(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, spans: Sequence[int] = (5, 10)
) -> DataFrame:
    """Mean of the last ``n`` values for each span, null until ``n`` values exist, 2 decimals."""
    rows, w, real = blocked(df, keys, order, halo=max(spans) - 1)
    for n in spans:
        frame = w.rowsBetween(-(n - 1), 0)
        mean = F.round(F.sum(F.coalesce(F.col(value), F.lit(0))).over(frame) / n, 2)
        rows = rows.withColumn(f"ma{n}", F.when(F.count(F.lit(1)).over(frame) == n, mean))
    return unblocked(rows, real)


def counter_rates(df: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """Change per second since the previous sample of the host; 0 first, never negative."""
    rows, w, real = blocked(df, [key], [ts, tie], halo=1)
    seconds = F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / 1e6
    change = F.col(value) - F.lag(value).over(w)
    rate = F.when(seconds > 0, F.greatest(F.lit(0.0), change / seconds)).otherwise(F.lit(0.0))
    return unblocked(rows.withColumn("rate", F.coalesce(rate, F.lit(0.0))), real)


def rolling_history(df: DataFrame, key: str, order: Sequence[str], value: str, points: int = 60) -> DataFrame:
    """Current value with mean and maximum of the last ``points`` samples of the host."""
    rows, w, real = blocked(df, [key], order, halo=points - 1)
    frame = w.rowsBetween(-(points - 1), 0)
    rows = rows.withColumn("mean_value", F.avg(value).over(frame)).withColumn(
        "max_value", F.max(value).over(frame)
    )
    return unblocked(rows, real)


def ranking(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rank 1, 2, … by value with a compact text from ten thousand up."""
    ranked = dense_index(
        df.select(F.col(name).alias("name"), F.col(value).alias("value")), [], [F.desc("value"), "name"], "rank"
    )
    compact = F.concat(decimals(F.col("value") / 10000, "0.0"), F.lit("万"))
    return ranked.withColumn(
        "display", F.when(F.col("value") >= 10000, compact).otherwise(decimals(F.col("value"), "#,##0.###"))
    )


def process_summary(df: DataFrame, cpu: str, mem: str, state: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_processes"),
        F.count_if(F.col(state) == "running").alias("running_processes"),
        F.count_if(F.col(state) == "sleeping").alias("sleeping_processes"),
        F.count_if((F.coalesce(cpu, F.lit(0.0)) > 1) | (F.coalesce(mem, F.lit(0.0)) > 1)).alias("busy"),
    )


def top_processes(df: DataFrame, pid: str, cpu: str, mem: str, k: int = 20) -> DataFrame:
    """The busiest processes above one percent of cpu or memory."""
    cpu_, mem_ = F.coalesce(F.col(cpu), F.lit(0.0)), F.coalesce(F.col(mem), F.lit(0.0))
    return (
        df.where((cpu_ > 1.0) | (mem_ > 1.0))
        .select(F.col(pid).alias("pid"), F.round(cpu_, 2).alias("cpu"), F.round(mem_, 2).alias("mem"))
        .orderBy(F.desc("cpu"), "pid")
        .limit(k)
    )


def hit_ratio(df: DataFrame, hit: Column, read: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Summed hits and reads with the share of hits in percent."""
    sums = df.groupBy(*keys).agg(F.sum(hit).cast("long").alias("hits"), F.sum(read).cast("long").alias("reads"))
    return sums.withColumn("hit_ratio", percent(F.col("hits"), F.col("hits") + F.col("reads")))


def largest(df: DataFrame, size: str, name: str, k: int = 20) -> DataFrame:
    return df.orderBy(F.desc(size), name).limit(k)


def table_totals(df: DataFrame, rows: str, size: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("tables"),
        F.sum(rows).cast("long").alias("total_rows"),
        F.sum(size).cast("long").alias("total_bytes"),
    )


def percent_rings(df: DataFrame, value: str, ceiling: str) -> DataFrame:
    """Value as percent of its maximum; a missing or zero maximum counts as 100."""
    full = F.coalesce(F.nullif(F.col(ceiling), F.lit(0)), F.lit(100))
    return df.withColumn("percent", F.round(F.col(value) / full * 100, 4))


def keyspace_summary(df: DataFrame, keys: str, expires: str, ttl: str) -> DataFrame:
    """Totals over key spaces, rounded mean time to live, expiry rate and its colour bucket."""
    out = df.agg(
        F.sum(keys).cast("long").alias("total_keys"),
        F.sum(expires).cast("long").alias("total_expires"),
        F.coalesce(F.round(F.avg(ttl)), F.lit(0)).cast("long").alias("avg_ttl"),
    )
    rate = F.col("total_expires") / F.col("total_keys") * 100
    bucket = (
        F.when(F.col("total_keys") == 0, "info")
        .when(rate >= 80, "success")
        .when(rate >= 50, "warning")
        .when(rate >= 20, "info")
        .otherwise("danger")
    )
    return out.withColumn("bucket", bucket)


def slow_log_summary(df: DataFrame, duration: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.round(F.avg(duration), 4), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.max(duration), F.lit(0.0)).alias("max_duration"),
    )


def slow_log_severity(df: DataFrame, duration: str) -> DataFrame:
    """Share of the longest entry and severity bucket (10 ms, 100 ms, 1 s in microseconds)."""
    longest = df.agg(F.max(duration)).scalar()
    share = F.when(longest == 0, F.lit(0.0)).otherwise(F.round(F.col(duration) / longest * 100, 4))
    us = F.col(duration)
    level = (
        F.when(us >= 1_000_000, "danger").when(us >= 100_000, "warning").when(us >= 10_000, "info").otherwise("success")
    )
    return df.withColumn("share", share).withColumn("severity", level)


def key_search(df: DataFrame, pattern: str, column: str, kind: str | None = None, kind_column: str = "type") -> DataFrame:
    """Keys that match a glob (``*``, ``?``), optionally of one type."""
    special = set("\\.[]{}()+-^$|")
    regex = "".join(".*" if ch == "*" else "." if ch == "?" else ("\\" + ch if ch in special else ch) for ch in pattern)
    out = df.where(F.col(column).rlike(f"^{regex}$"))
    return out if kind is None else out.where(F.col(kind_column) == kind)

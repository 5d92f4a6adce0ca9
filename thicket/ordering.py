"""Order, position, first-per-key and top-per-key without putting one group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import stage

Order = Sequence["str | Column"]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Order, last: bool = False) -> DataFrame:
    """The first (or last) row of every key.

    Written as ``min_by`` over a row struct: the aggregate combines on the map side, so a hot
    key sends one row per map task through the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Order, k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key.

    The rank filter lets Spark place a group limit before the shuffle, so a hot key sends at
    most ``k`` rows per map task.
    """
    name = rank or "_rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out.withColumn(name, F.col(name).cast("long")) if rank else out.drop(name)


def top(df: DataFrame, order: Order, k: int) -> DataFrame:
    """A top-k report over the whole input."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, order: Order, number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered result."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def dense_index(df: DataFrame, keys: Sequence[str], order: Order, name: str = "idx") -> DataFrame:
    """Position 1, 2, … of every row inside its key, for keys of any size.

    Rows are range-partitioned by key and order, so a hot key spreads over many slices. Each
    slice numbers its own rows; the start of a slice is the running count of earlier slices of
    that key, a table with one row per slice and key. ``order`` must be unique inside a key.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sliced = stage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
    )
    counts = sliced.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_slice", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.select(
        F.col("_slice").alias("_s"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_start"
    )
    numbered = sliced.withColumn(
        "_pos", F.row_number().over(Window.partitionBy("_slice", *keys).orderBy(*order))
    )
    on = F.col("_slice") == F.col("_s")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = numbered.join(starts, on, "inner")
    return joined.select(*df.columns, (F.col("_pos") + F.col("_start")).cast("long").alias(name))


def running_total(df: DataFrame, order: str, value: str, name: str = "total") -> DataFrame:
    """Sum of ``value`` up to and with every row in ``order`` (unique), without one task for all rows.

    Slices add up their own rows; the start of a slice is the sum of earlier slices, one row each.
    """
    sliced = stage(df.repartitionByRange(order).withColumn("_slice", F.spark_partition_id()))
    sums = sliced.groupBy("_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = F.sum(value).over(Window.partitionBy("_slice").orderBy(order))
    return sliced.withColumn("_own", own).join(starts, "_slice").select(*df.columns, (F.col("_own") + F.col("_start")).alias(name))


#: Rows sampled for each cut of a long key.
SAMPLED = 20


def cuts_of_long_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: int) -> DataFrame:
    """Per key of more than ``block`` rows, ``_cuts``: places in its order about ``block`` rows apart.

    Places come from a sample by hash, about ``SAMPLED`` rows for each cut, so a key of any length
    gathers few rows. They are rows of the key and differ, so that no slice but the first is empty.
    Cuts are kept in groups (``first`` and ``rest``), so that a row finds its slice in two short searches.
    """
    place = F.struct(*order)
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    chance = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 20)) < max(1, (SAMPLED << 20) // block)
    rows = df.where(chance).select(*keys, place.alias("_p"))
    sample = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_s"))
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    both = long.alias("_l").join(sample.alias("_r"), on, "inner" if keys else "cross")
    step = F.greatest(F.floor(F.size("_s") * block / F.col("_n")).cast("int"), F.lit(1))
    some = F.array_distinct(F.filter("_s", lambda _, i: (i + 1) % step == 0))
    width = F.ceil(F.sqrt(F.size("_c"))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.size("_c") - 1, F.col("_w")), lambda i: F.slice("_c", i + 1, F.col("_w")))
    cut = both.select(*[F.col(f"_l.{k}").alias(k) for k in keys], some.alias("_c")).where(F.size("_c") > 0)
    return cut.withColumn("_w", width).select(*keys, F.col("_w"), groups.alias("_cuts"))


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int, block: int = 100_000) -> tuple[DataFrame, Window, Column]:
    """Cut every long key into slices that a short look-back window can use on their own.

    The last ``halo`` rows before a slice are repeated in front of it. Returns the frame, the window
    (ordered, per key and slice) and the predicate that keeps the real rows. A window function that
    looks back at most ``halo`` rows gives the same result as over the whole key, whose rows meet in
    slices of about ``block``. Keys up to ``block`` rows are one slice; without longer keys nothing is
    cut, and the window's own exchange is the only one. ``order`` is ascending and unique inside a key.
    """
    block = max(block, halo, 1)
    place = F.struct(*order)
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    cuts = stage(cuts_of_long_keys(df, keys, order, block))
    if cuts.isEmpty():
        return df.withColumns({"_slice": F.lit(0), "_copy": F.lit(False)}), w, ~F.col("_copy")
    named = cuts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_w", "_cuts")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    group = F.size(F.filter("_cuts", lambda g: F.get(g, F.lit(0)) <= F.col("_p")))  # groups that begin at or before the row
    inside = F.size(F.filter(F.get("_cuts", F.col("_g") - 1), lambda c: c <= F.col("_p")))
    number = F.when(F.col("_g") > 0, (F.col("_g") - 1) * F.col("_w") + inside).otherwise(0)
    last = F.aggregate("_cuts", F.lit(0), lambda n, g: n + F.size(g))
    placed = df.withColumn("_p", place).join(named, on, "left" if keys else "cross").withColumn("_g", group)
    placed = placed.withColumns({"_slice": F.coalesce(number, F.lit(0)), "_last": last}).select(*df.columns, "_slice", "_last")
    newest = [F.col(c).desc() for c in order]
    # The rows that later slices look back to: the last of each slice, and of those before a slice the last.
    ends = top_per_key(placed.where(F.col("_slice") < F.col("_last")), [*keys, "_slice"], newest, max(halo, 1))
    into = F.explode(F.sequence(F.col("_slice") + 1, F.least(F.col("_slice") + max(halo, 1), F.col("_last"))))
    copies = top_per_key(ends.withColumn("_into", into), [*keys, "_into"], newest, max(halo, 1))
    copies = copies.select(*df.columns, F.col("_into").alias("_slice"), F.lit(True).alias("_copy"))
    rows = placed.select(*df.columns, "_slice", F.lit(False).alias("_copy"))
    return (rows.unionByName(copies) if halo else rows), w, ~F.col("_copy")


def unblocked(df: DataFrame, real: Column) -> DataFrame:
    """Drop the repeated rows and the helper columns of :func:`blocked`."""
    return df.where(real).drop("_slice", "_copy")


def number_pages(df: DataFrame, order: Order, size: int = 20) -> DataFrame:
    """Page number and position for every row, for walking many pages with one sort."""
    out = dense_index(df, [], order, "position")
    return out.withColumn("page", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))

"""Set operations: merged triple lists, consistency of key sets, differences of records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from thicket.ordering import first_per_key


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def deduplicate(triples: DataFrame, key: Sequence[str] = ("h", "r", "t"), seq: str = "seq") -> DataFrame:
    """First occurrence of every triple."""
    return first_per_key(triples, list(key), [seq])


def merge_scored(parts: Sequence[DataFrame], key: Sequence[str], raw: bool = False) -> DataFrame:
    """Scored lists of several paths as one; the best score per key, or all rows if ``raw``."""
    merged = reduce(DataFrame.unionByName, parts)
    return merged if raw else merged.groupBy(*key).agg(F.max("score").alias("score"))


def consistency(current: DataFrame, cached: DataFrame, key: str, tolerance: float = 0.1) -> DataFrame:
    """Whether a stored index fits the data: nothing missing, few extras.

    Both sets go through one aggregate on the key instead of two anti-joins.
    """
    both = current.select(key, F.lit(1).alias("now"), F.lit(0).alias("old")).unionByName(
        cached.select(key, F.lit(0).alias("now"), F.lit(1).alias("old"))
    )
    per_key = both.groupBy(key).agg(F.max("now").alias("now"), F.max("old").alias("old"))
    counts = per_key.agg(
        F.count_if(F.col("now") == 1).alias("current"),
        F.count_if((F.col("now") == 1) & (F.col("old") == 0)).alias("missing"),
        F.count_if((F.col("now") == 0) & (F.col("old") == 1)).alias("extra"),
    )
    fits = (F.col("missing") == 0) & (F.col("extra") <= F.col("current") * tolerance)
    return counts.withColumn("consistent", fits)


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Changed fields of every record: (key, field, new_value), arrays compared as multisets."""
    fields = [c for c in old.columns if c != key]
    arrays = {f.name for f in old.schema.fields if isinstance(f.dataType, ArrayType)}
    a = old.select(F.col(key).alias("_k1"), *[F.col(c).alias(f"o_{c}") for c in fields])
    b = new.select(F.col(key).alias("_k2"), *[F.col(c).alias(f"n_{c}") for c in fields])
    both = a.join(b, F.col("_k1") == F.col("_k2"), "full")

    def changed(c: str):
        x, y = F.col(f"o_{c}"), F.col(f"n_{c}")
        same = F.array_sort(x).eqNullSafe(F.array_sort(y)) if c in arrays else x.eqNullSafe(y)
        text = F.to_json(y) if c in arrays else y.cast("string")
        return F.when(~same, F.struct(F.lit(c).alias("field"), text.alias("new_value")))

    changes = F.filter(F.array(*[changed(c) for c in fields]), lambda s: s.isNotNull())
    return both.select(F.coalesce("_k1", "_k2").alias(key), F.inline(changes))

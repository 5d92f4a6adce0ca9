"""Arithmetic on vectors kept as arrays; all in double, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations that raise a triple's score, and by how much.
BONUS_RELATIONS = ["is", "was", "has", "had", "contains", "located", "born", "died"]
BONUS = 0.1


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """Vector of length 1; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        F.transform(a, lambda x: x.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine clipped at 0."""
    return F.greatest(F.lit(0.0), cosine(a, b))


def triple_score(cos: Column, relation: Column) -> Column:
    """Cosine plus a bonus for listed relations, never negative."""
    return F.greatest(F.lit(0.0), cos + F.when(F.lower(relation).isin(BONUS_RELATIONS), BONUS).otherwise(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))

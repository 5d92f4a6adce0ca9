"""Values at paths inside JSON text, and values placed at paths inside structs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_path(path: str) -> str:
    """``a.b.0.c`` or ``a.b[0].c`` as ``$.a.b[0].c``; an empty path is the whole value."""
    steps = [s for s in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if s]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def value_at(json: Column, path: str) -> Column:
    """Text at a dotted path, null when any step is missing."""
    return F.get_json_object(json, json_path(path))


def required_value_at(json: Column, path: str) -> Column:
    """Like :func:`value_at`, but an empty path is an error."""
    if not path.strip("."):
        raise ValueError("the path is empty")
    return value_at(json, path)


def set_at(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set a field at a dotted path; structs on the way that do not exist are made."""
    column, *rest = path.split(".")
    if not rest:
        return df.withColumn(column, value)
    field = df.schema[column] if column in df.columns else None

    def place(current: Column | None, dtype: Any, steps: Sequence[str]) -> Column:
        head, tail = steps[0], steps[1:]
        has = isinstance(dtype, StructType) and head in dtype.fieldNames()
        inner = value if not tail else place(
            current[head] if has else None, dtype[head].dataType if has else None, tail
        )
        if current is None or not isinstance(dtype, StructType):
            return F.struct(inner.alias(head))
        return current.withField(head, inner)

    return df.withColumn(column, place(F.col(column) if field else None, field.dataType if field else None, rest))


def map_fields(json: Column, mappings: Mapping[str, str], defaults: Mapping[str, Column]) -> list[Column]:
    """Target columns from source paths; a missing source keeps the target's default."""
    out = []
    for target, default in defaults.items():
        source = next((s for s, t in mappings.items() if t == target), None)
        out.append((default if source is None else F.coalesce(value_at(json, source), default)).alias(target))
    out += [value_at(json, s).alias(t) for s, t in mappings.items() if t not in defaults]
    return out


def rows_at_path(responses: DataFrame, column: str, path: str, schema: str) -> DataFrame:
    """Rows of the JSON array at ``path`` in each landed response."""
    items = F.from_json(value_at(F.col(column), path), f"array<struct<{schema}>>")
    rest = [c for c in responses.columns if c != column]
    return responses.select(*rest, F.inline(items))

"""A stored, read-only query: parameters, field mapping, result shape and row cap."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.jsonpath import rows_at_path
from thicket.operators import charts, trees

# Words a stored query may not contain.
FORBIDDEN = ["INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE"]
# Usual caps of a run and of a preview, and the usual lifetime of a kept result in seconds.
MAX_ROWS, MAX_PREVIEW_ROWS, CACHE_SECONDS = 1000, 100, 300

_READS = re.compile(r"\s*(?:SELECT|WITH)", re.IGNORECASE)
_WRITES = re.compile("|".join(rf"\b{word}\b" for word in FORBIDDEN), re.IGNORECASE)


@dataclass
class DataSource:
    code: str
    source_type: str = "static"  # sql, api or static
    sql: str = ""
    static_rows: Sequence[Mapping[str, Any]] = ()
    data_path: str = ""
    row_schema: str = ""
    params: Sequence[Mapping[str, Any]] = ()
    field_mapping: Mapping[str, str] = field(default_factory=dict)
    result_type: str = "list"  # list, tree, object, value, chart-axis/pie/gauge/radar/scatter/heatmap
    order: Sequence[str] = ()
    tree: Mapping[str, Any] = field(default_factory=dict)
    chart: Mapping[str, Any] = field(default_factory=dict)
    cached: bool = False
    cache_seconds: float = CACHE_SECONDS


@dataclass
class _Kept:
    """A kept result with what it was made from."""

    source: str
    tables: Mapping[str, DataFrame]
    result: DataFrame
    until: float

    def made_from(self, source: str, tables: Mapping[str, DataFrame]) -> bool:
        same = self.source == source and self.tables.keys() == tables.keys()
        return same and all(self.tables[n].sameSemantics(df) for n, df in tables.items())


class Cache:
    """Kept results of one process, by session, source text, parameters and the plans of the tables.

    A result is dropped, and its storage freed, when its time is over; the frames it was made from
    are compared by plan, so another table under the same name is another entry.
    """

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock, self.kept = clock, []

    def get(self, source: str, tables: Mapping[str, DataFrame]) -> DataFrame | None:
        now = self.clock()
        for old in [k for k in self.kept if k.until <= now]:
            old.result.unpersist()
        self.kept = [k for k in self.kept if k.until > now]
        return next((k.result for k in self.kept if k.made_from(source, tables)), None)

    def put(self, source: str, tables: Mapping[str, DataFrame], result: DataFrame, seconds: float) -> DataFrame:
        self.kept.append(_Kept(source, dict(tables), result.persist(), self.clock() + seconds))
        return result


CACHE = Cache()


def check_sql(sql: str) -> str:
    """The query itself, if it reads; a forbidden word counts also inside a literal."""
    if not _READS.match(sql):
        raise ValueError("only SELECT or WITH queries are allowed")
    if found := _WRITES.search(sql):
        raise ValueError(f"{found[0].upper()} is not allowed in a query")
    return sql


def _truth(value: Any) -> bool:
    return value is True or str(value).lower() in {"true", "1", "yes"}


_READERS = {"integer": int, "float": float, "boolean": _truth}


@dataclass(frozen=True)
class Param:
    """A declared parameter, which knows how to read its own value."""

    name: str
    kind: str = "string"
    required: bool = False
    default: Any = None

    @classmethod
    def declared(cls, specs: Sequence[Mapping[str, Any]]) -> dict[str, Param]:
        named = (s for s in specs if s.get("name"))
        return {s["name"]: cls(s["name"], s.get("type", "string"), bool(s.get("required")), s.get("default")) for s in named}

    def read(self, value: Any) -> Any:
        """The typed value; null and what does not convert stay as they are."""
        with contextlib.suppress(TypeError, ValueError):
            return value if value is None else _READERS.get(self.kind, str)(value)
        return value

    def absent(self) -> Any:
        if self.required and self.default is None:
            raise ValueError(f"parameter {self.name} is required")
        return self.default


def convert_param(value: Any, kind: str) -> Any:
    return Param("", kind).read(value)


def merge_params(declared: Sequence[Mapping[str, Any]], given: Mapping[str, Any]) -> dict[str, Any]:
    """One value for every name that is declared or given; what is only given stays untyped."""
    known = Param.declared(declared)
    names = [*known, *(n for n in given if n not in known)]
    typed = {n: p.read(given[n]) if n in given else p.absent() for n, p in known.items()}
    return {n: typed[n] if n in known else given[n] for n in names}


_FIELD = re.compile(r'("(?:[^"\\]|\\.)*"\s*:\s*)("(?:[^"\\]|\\.)*")')


def fill_placeholders(body: Any, params: Mapping[str, Any]) -> Any:
    """Put parameters for ``{name}`` into a text, or into the text fields of nested objects.

    The body is treated as the JSON it will be sent as: one pass over its ``"field": "text"`` pairs.
    Texts that stand directly in a list are not fields and stay; a value is not expanded again.
    """
    if not params:
        return body
    names = re.compile(r"\{(" + "|".join(map(re.escape, params)) + r")\}")
    filled = lambda text: names.sub(lambda m: "" if params[m[1]] is None else str(params[m[1]]), text)
    if isinstance(body, str):
        return filled(body)
    return json.loads(_FIELD.sub(lambda m: m[1] + json.dumps(filled(json.loads(m[2]))), json.dumps(body)))


def cache_key(code: str, params: Mapping[str, Any]) -> str:
    digest = hashlib.md5(str(sorted(params.items())).encode()).hexdigest()
    return f"datasource:{code}:{digest[:8]}"


# ---- the same for columns, where every row brings its own values


def soft_column(value: Column, kind: str) -> Column:
    """The typed value as text; what does not convert stays as it is."""
    types = {"integer": "bigint", "float": "double", "boolean": "boolean"}
    return F.coalesce(value.try_cast(types[kind]).cast("string"), value) if kind in types else value.cast("string")


def filled_column(template: str, values: Mapping[str, Column]) -> Column:
    """A text with columns for its ``{name}`` places, null as nothing; values are not expanded again."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template) if values else [template]
    text = [F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*text)


def cache_key_column(code: Column, params: Mapping[str, Column], texts: Sequence[str] = ()) -> Column:
    """:func:`cache_key` of every row; ``texts`` names the parameters that are texts, of printable characters."""

    def quoted(text: Column) -> Column:
        escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)

    shown = [
        F.concat(F.lit(f"({name!r}, "), F.coalesce(quoted(value) if name in texts else value.cast("string"), F.lit("None")), F.lit(")"))
        for name, value in sorted(params.items())
    ]
    listed = F.concat(F.lit("["), F.concat_ws(", ", *shown), F.lit("]"))
    return F.concat(F.lit("datasource:"), code, F.lit(":"), F.substring(F.md5(listed), 1, 8))


def run_sql(spark: SparkSession, sql: str, params: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Run a checked query with bound ``:name`` parameters over the given tables.

    The tables stand in front of the query as common table expressions over views of names that no
    one else has; the views go as soon as the query is analysed, so sources cannot see each other's.
    """
    body = check_sql(sql).strip()
    views = {name: f"source_{uuid.uuid4().hex}" for name in tables}
    head = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    if head:
        own = re.match(r"WITH\s+(?:RECURSIVE\s+)?", body, re.IGNORECASE)
        body = f"WITH {head}, {body[own.end():]}" if own else f"WITH {head} {body}"
    wanted = set(re.findall(r":([A-Za-z_]\w*)", sql))
    try:
        for name, view in views.items():
            tables[name].createOrReplaceTempView(view)
        return spark.sql(body, args={k: v for k, v in params.items() if k in wanted})
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Renamed columns first, in mapping order, then the untouched ones."""
    if not mapping:
        return df
    renamed = [df[old].alias(new) for old, new in mapping.items() if old in df.columns]
    return df.select(*renamed, *[c for c in df.columns if c not in mapping])


def fetch(spark: SparkSession, source: DataSource, params: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    if source.source_type == "sql":
        return run_sql(spark, source.sql, params, tables)
    if source.source_type == "api":
        responses = tables["responses"]
        return rows_at_path(responses, responses.columns[-1], source.data_path, source.row_schema)
    return spark.createDataFrame([dict(r) for r in source.static_rows])


def shape(df: DataFrame, source: DataSource) -> DataFrame:
    """Result shape by type. Charts and trees are rows, complete and uncapped."""
    order = list(source.order) or df.columns[:1]
    kind = source.result_type
    if kind == "tree":
        cfg = source.tree
        id_field, parent = cfg.get("id_field", "id"), cfg.get("parent_field", "parent_id")
        placed = trees.forest(df, id_field, parent, root_value=cfg.get("root_value"))
        # a node keeps all its fields
        payload = [c for c in df.columns if c not in placed.columns and c not in (id_field, parent)]
        if not payload:
            return placed
        fields = df.select(F.col(id_field).alias("_node"), *payload)
        return placed.join(fields, placed[placed.columns[0]].eqNullSafe(fields["_node"]), "left").drop("_node")
    if kind == "object":
        return df.orderBy(*order).limit(1)
    if kind == "value":
        return df.orderBy(*order).limit(1).select(df.columns[0])
    if kind.startswith("chart-"):
        return charts.SHAPES[kind.removeprefix("chart-")](df, order, **source.chart)
    return df


def run_source(
    spark: SparkSession,
    source: DataSource,
    params: Mapping[str, Any] | None = None,
    tables: Mapping[str, DataFrame] | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Parameters, query, field mapping, shape.

    Lists are complete unless ``cap`` is given; the rows kept then are the first in the source's
    order, or in the order of all columns if it has none.
    """
    merged, tables = merge_params(source.params, params or {}), tables or {}
    made_of = repr((spark.sparkContext.applicationId, id(spark), source, sorted(merged.items(), key=repr), cap))
    if source.cached and (kept := CACHE.get(made_of, tables)) is not None:
        return kept
    out = shape(map_fields(fetch(spark, source, merged, tables), source.field_mapping), source)
    if source.result_type == "list" and cap is not None:
        out = out.orderBy(*(source.order or out.columns)).limit(cap)
    return CACHE.put(made_of, tables, out, source.cache_seconds) if source.cached else out


def preview_source(spark, source, params=None, tables=None, cap: int = MAX_PREVIEW_ROWS) -> DataFrame:
    """Run an unsaved source; the cap is the feature."""
    return run_source(spark, source, params, tables, cap=cap)

"""Chart shapes as rows.

A chart's arrays are given in long form, one row per point with its position, so a chart over
any number of points is never one value in one task. The caller that draws it collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.ordering import dense_index


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _positioned(df: DataFrame, order: Sequence) -> DataFrame:
    return dense_index(df, [], order, "position")


def _series(df: DataFrame, fields: Sequence[str], names: Sequence[str]) -> Column:
    """Array of (series, value) in field order."""
    labels = [names[i] if i < len(names) else f for i, f in enumerate(fields)]
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("series_no"), F.lit(n).alias("series"), _column(df, f, 0).cast("double").alias("value")
            )
            for i, (f, n) in enumerate(zip(fields, labels))
        ]
    )


def axis(df, order, x_field="", series_fields=(), series_names=()) -> DataFrame:
    """(position, x, series_no, series, value); by default the first column is x, the rest series."""
    x = x_field or df.columns[0]
    fields = list(series_fields) or df.columns[1:]
    rows = _positioned(df, order)
    return rows.select(
        "position", _column(df, x, "").alias("x"), F.inline(_series(df, fields, list(series_names)))
    )


def pie(df, order, name_field="", value_field="") -> DataFrame:
    name = name_field or df.columns[0]
    value = value_field or (df.columns[1] if len(df.columns) > 1 else "")
    return _positioned(df, order).select("position", _column(df, name, "").alias("name"), _column(df, value, 0).alias("value"))


def gauge(df, order, value_field="value", name_field="name", max_field="max") -> DataFrame:
    """Value, name and maximum of the first row."""
    return df.orderBy(*order).limit(1).select(
        _column(df, value_field, 0).alias("value"),
        _column(df, name_field, "").alias("name"),
        _column(df, max_field, 100).alias("max"),
    )


def radar(df, order, indicator_field="name", max_field="max", value_fields=(), series_names=()) -> DataFrame:
    """(position, indicator, max, series_no, series, value)."""
    fields = list(value_fields) or [c for c in df.columns if c not in (indicator_field, max_field)]
    return _positioned(df, order).select(
        "position",
        _column(df, indicator_field, "").alias("indicator"),
        _column(df, max_field, 100).alias("max"),
        F.inline(_series(df, fields, list(series_names))),
    )


def scatter(df, order, x_field="x", y_field="y", size_field="", name_field="") -> DataFrame:
    cols = [_column(df, x_field, 0).alias("x"), _column(df, y_field, 0).alias("y")]
    if size_field:
        cols.append(_column(df, size_field, 0).alias("size"))
    if name_field:
        cols.append(_column(df, name_field, "").alias("name"))
    return _positioned(df, order).select("position", *cols)


def first_appearance_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """Dense codes 0, 1, … of the values of a column by first appearance."""
    first = df.groupBy(column).agg(F.min("position").alias("_first"))
    coded = dense_index(first, [], ["_first"], code)
    return coded.select(column, (F.col(code) - 1).alias(code))


def heatmap(df, order, x_field="x", y_field="y", value_field="value") -> DataFrame:
    """(position, xi, yi, x, y, value) with codes by first appearance."""
    rows = _positioned(df, order).select(
        "position",
        _column(df, x_field, "").alias("x"),
        _column(df, y_field, "").alias("y"),
        _column(df, value_field, 0).alias("value"),
    )
    xs, ys = first_appearance_codes(rows, "x", "xi"), first_appearance_codes(rows, "y", "yi")
    return rows.join(xs, "x").join(ys, "y").select("position", "xi", "yi", "x", "y", "value")


SHAPES = {"axis": axis, "pie": pie, "gauge": gauge, "radar": radar, "scatter": scatter, "heatmap": heatmap}


def _stripped(part: Column) -> Column:
    return F.regexp_replace(F.trim(part), r"^['\[\]]+|['\[\]]+$", "")


def triple_parts(text: Column) -> Column:
    """Parts of a written triple, without blanks, quotes and brackets."""
    return F.transform(F.split(text, ","), _stripped)


def _short(text: Column, shown: int | None) -> Column:
    return text if shown is None else F.substring(text, 1, shown)


def retrieved_links(triples: DataFrame, text: str, keep: Sequence[str] = (), shown: int | None = None) -> DataFrame:
    """Links (source, target, name, relation) of written triples; a text without commas is a lone source.

    ``name`` is the relation cut to ``shown`` characters, where a limit is given.
    """
    parts = F.when(F.col(text).contains(","), triple_parts(F.col(text))).otherwise(
        F.array(F.col(text), F.lit(""), F.lit(""))
    )
    rows = triples.select(*keep, parts.alias("p")).where(F.size("p") >= 3)
    return rows.select(
        *keep,
        F.col("p")[0].alias("source"),
        F.col("p")[2].alias("target"),
        _short(F.col("p")[1], shown).alias("name"),
        F.col("p")[1].alias("relation"),
    )


def retrieved_nodes(links: DataFrame, shown: int | None = None) -> DataFrame:
    """Distinct non-empty ends; ``name`` is cut to ``shown`` characters, where a limit is given."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id")).where(F.col("id") != "").distinct()
    return ends.select("id", _short(F.col("id"), shown).alias("name"))


def question_triples(
    triples: DataFrame, question: str, position: str, text: str, k: int | None = None, link_shown: int | None = None, node_shown: int | None = None
) -> DataFrame:
    """Links from a question to its triples, the first ``k`` if given; ``position`` counts from 0 per question.

    ``link_name`` and ``node_name`` may be cut for display; ``head`` and ``relation`` are whole.
    """
    parts = triple_parts(F.col(text))
    ids = F.concat_ws("_", F.lit("triple"), F.col(question), F.col(position))
    return (
        (triples if k is None else triples.where(F.col(position) < k))
        .select(question, position, ids.alias("triple_id"), parts.alias("p"))
        .where(F.size("p") >= 3)
        .select(
            F.concat(F.lit("sq_"), F.col(question)).alias("source"),
            F.col("triple_id").alias("target"),
            _short(F.col("p")[0], link_shown).alias("link_name"),
            _short(F.col("p")[1], node_shown).alias("node_name"),
            F.col("p")[0].alias("head"),
            F.col("p")[1].alias("relation"),
        )
    )


def reasoning_chain(steps: DataFrame, chain: str, position: str, label: str, shown: int | None = None) -> DataFrame:
    """Steps as a linked list; the source is the step before, or the question for the first. ``text`` is whole."""
    at = F.col(position)
    source = F.when(at == 0, "question").otherwise(F.concat(F.lit("step_"), (at - 1).cast("string")))
    return steps.select(
        chain, source.alias("source"), F.concat(F.lit("step_"), at.cast("string")).alias("target"),
        _short(F.col(label), shown).alias("name"), F.col(label).alias("text"),
    )

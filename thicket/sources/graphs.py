"""Graphs as JSON relationships and GraphML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.graphbuild import key_of
from thicket.ordering import dense_index, first_per_key

END = "struct<label: string, properties: map<string, string>>"
RELATIONSHIP = f"seq bigint, start_node {END}, relation string, end_node {END}"
# Level by label; any other label is level 2.
LEVELS = {"attribute": 1, "entity": 2, "keyword": 3, "community": 4}


def level_of(label: Column) -> Column:
    out = F.lit(2)
    for name, level in LEVELS.items():
        out = F.when(label == name, level).otherwise(out)
    return out


def to_relationships(rels: DataFrame) -> DataFrame:
    """Relationship rows of the view form (s_label, s_name, …) as nested start and end nodes."""

    def end(p: str) -> Column:
        props = F.create_map(F.lit("name"), F.col(f"{p}_name"), F.lit("schema_type"), F.col(f"{p}_type"))
        kept = F.map_filter(props, lambda k, v: v.isNotNull())
        return F.struct(F.col(f"{p}_label").alias("label"), kept.alias("properties"))

    return rels.select("seq", end("s").alias("start_node"), "relation", end("t").alias("end_node"))


def save_graph_json(relationships: DataFrame, path: str) -> None:
    """Write relationships as JSON lines, in parallel."""
    relationships.write.json(path)


def read_relationships(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Relationships from JSON lines, or from JSON array files with ``multiline``.

    Array files carry no sequence; relationships are then ordered by file name, then position.
    """
    if not multiline:
        return spark.read.schema(RELATIONSHIP).json(path)
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    place = dense_index(text.select("file").distinct(), [], ["file"], "place")
    items = F.from_json("value", f"array<struct<start_node: {END}, relation: string, end_node: {END}>>")
    rows = text.select("file", F.posexplode(items).alias("at", "r")).join(place, "file")
    return rows.select(((F.col("place") - 1) * (1 << 32) + F.col("at")).cast("long").alias("seq"), "r.*")


def graph_from_relationships(relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes are unique by (label, name), the first occurrence gives properties."""
    name = lambda e: F.coalesce(F.try_element_at(e["properties"], F.lit("name")), F.lit(""))
    ident = lambda e: key_of(F.coalesce(e["label"], F.lit("")), name(e))
    ends = F.array(
        *[
            F.struct(
                F.lit(i).alias("end"), ident(F.col(c)).alias("node_id"), F.col(c)["label"].alias("label"),
                name(F.col(c)).alias("name"), F.col(c)["properties"].alias("props"),
            )
            for i, c in enumerate(("start_node", "end_node"))
        ]
    )
    rows = relationships.select("seq", F.inline(ends))
    first = first_per_key(rows, ["node_id"], ["seq", "end"])
    prop = lambda k: F.try_element_at("props", F.lit(k))
    nodes = first.select(
        "node_id", "label", level_of(F.col("label")).alias("level"), "name",
        prop("description").alias("description"), prop("schema_type").alias("schema_type"),
        prop("chunk id").alias("chunk_id"), "props",
    )
    edges = relationships.select(
        "seq", ident(F.col("start_node")).alias("src"), "relation", ident(F.col("end_node")).alias("dst")
    )
    return nodes, edges


def load_graph_json(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    return graph_from_relationships(read_relationships(spark, path, multiline))


def load_graph_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML with d0 label, d1 properties, d2 level, d3 relation.

    Properties that are no JSON object become a name; a level that is no number becomes 2.
    """
    data = "data array<struct<_key: string, _VALUE: string>>"
    value = lambda key: F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
    read = lambda tag, fields: spark.read.option("rowTag", tag).schema(f"{fields}, {data}").xml(path)
    raw = read("node", "_id string").select(
        F.col("_id").alias("node_id"), value("d0").alias("label"), value("d1").alias("d1"), value("d2").alias("d2")
    )
    parsed = F.from_json("d1", "map<string, string>")
    props = F.when(F.col("d1").isNotNull(), F.coalesce(parsed, F.create_map(F.lit("name"), F.col("d1"))))
    nodes = raw.withColumn("props", props).select(
        "node_id", "label",
        F.when(F.col("d2").isNotNull(), F.coalesce(F.col("d2").try_cast("int"), F.lit(2))).alias("level"),
        F.try_element_at("props", F.lit("name")).alias("name"), "props",
    )
    edges = read("edge", "_source string, _target string").select(
        F.col("_source").alias("src"), F.regexp_replace(value("d3"), '^"+|"+$', "").alias("relation"), F.col("_target").alias("dst")
    )
    return nodes, edges


def load_graph(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Reader by extension: .json or .graphml."""
    if path.endswith(".json"):
        return load_graph_json(spark, path, multiline)
    if path.endswith(".graphml"):
        return load_graph_graphml(spark, path)
    raise ValueError(f"no graph reader for {path}")

"""Vector tables: what is embedded, how it is stored, when it is reused."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.text import index_text
from thicket.functions.vector import unit
from thicket.operators.setops import consistency


def node_texts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").alias("id"), index_text(F.col("name"), F.col("description")).alias("text"))


def relation_texts(edges: DataFrame) -> DataFrame:
    relations = edges.where(F.col("relation").isNotNull()).select("relation").distinct()
    return relations.select(F.col("relation").alias("id"), F.col("relation").alias("text"))


def triple_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``head,relation,tail`` with each end as its index text, one row per edge."""
    texts = node_texts(nodes)
    h = texts.select(F.col("id").alias("src"), F.col("text").alias("h"))
    t = texts.select(F.col("id").alias("dst"), F.col("text").alias("t"))
    joined = edges.join(h, "src").join(t, "dst")
    return joined.select(F.col("seq").alias("id"), F.concat_ws(",", "h", "relation", "t").alias("text"))


def community_texts(nodes: DataFrame) -> DataFrame:
    """``name,description`` of communities that have either."""
    named = (F.coalesce("name", F.lit("")) != "") | (F.coalesce("description", F.lit("")) != "")
    text = F.trim(F.concat(F.coalesce("name", F.lit("")), F.lit(","), F.coalesce("description", F.lit(""))))
    return nodes.where((F.col("label") == "community") & named).select(F.col("node_id").alias("id"), text.alias("text"))


def embed(texts: DataFrame, load_model: Callable[[], Callable[[list[str]], list]], text: str = "text") -> DataFrame:
    """Add ``emb`` by a user's model, loaded once per Python worker and called per Arrow batch."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())), index=batch.index)

    return texts.withColumn("emb", encode(text))


def index(kind: str, items: DataFrame, vectors: DataFrame, normalize: bool = True) -> DataFrame:
    """(kind, id, emb) for the items that have a vector; chunks are stored as they come."""
    emb = unit(F.col("emb")) if normalize else F.transform("emb", lambda x: x.cast("double"))
    return items.select("id").join(vectors, "id").select(F.lit(kind).alias("kind"), "id", emb.alias("emb"))


def build_or_reuse(
    spark: SparkSession, path: str, items: DataFrame, build: Callable[[DataFrame], DataFrame], tolerance: float = 0.1
) -> tuple[DataFrame, bool]:
    """The stored table if it fits the items, else a new one in a new version folder.

    Returns the table and whether it was reused. A version is written whole before the next
    read sees it, so a failed build leaves the last good version in place.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = []
    if fs.exists(hadoop):
        for status in fs.listStatus(hadoop):
            name = status.getPath().getName()
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
            if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
                versions.append(int(name[1:]))
    if versions:
        stored = spark.read.parquet(f"{path}/v{max(versions)}")
        if consistency(items.select("id"), stored.select("id"), "id", tolerance).first()["consistent"]:
            return stored, True
    new = f"{path}/v{max(versions, default=0) + 1}"
    build(items).write.mode("overwrite").parquet(new)
    return spark.read.parquet(new), False

"""Views and edits of a graph kept as relationship rows.

A relationship row is (seq, s_label, s_name, s_type, relation, t_label, t_name, t_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.ordering import first_per_key, top
from thicket.session import stage


def _ends(rels: DataFrame) -> DataFrame:
    ends = F.array(
        *[
            F.struct(
                F.lit(i).alias("end"),
                F.col(f"{p}_name").alias("id"),
                F.coalesce(f"{p}_type", f"{p}_label").alias("category"),
            )
            for i, p in enumerate("st")
        ]
    )
    return rels.select("seq", F.inline(ends)).where(F.coalesce("id", F.lit("")) != "")


def view_nodes(rels: DataFrame, shown: int | None = None) -> DataFrame:
    """Nodes by name; the first occurrence gives the category. ``name`` may be cut for display, ``id`` is whole.

    The first ``seq`` of each name, category and end is a number per group, which is kept by hash; only
    these few rows are sorted by name for the rest.
    """
    least = _ends(rels).groupBy("id", "category", "end").agg(F.min("seq").alias("seq"))
    first = first_per_key(least, ["id"], ["seq", "end"])
    name = F.col("id") if shown is None else F.substring("id", 1, shown)
    return first.select("id", name.alias("name"), "category", F.lit(25).alias("size"))


def view_links(rels: DataFrame) -> DataFrame:
    named = (F.coalesce("s_name", F.lit("")) != "") & (F.coalesce("t_name", F.lit("")) != "")
    return rels.where(named).select(
        "seq", F.col("s_name").alias("source"), F.col("t_name").alias("target"),
        F.coalesce("relation", F.lit("related_to")).alias("name"), F.lit(1).alias("value"),
    )


def view_categories(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce("category", F.lit("")) != "").select("category").distinct()


def view_stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Node, link and category counts in one pass over each side."""
    a = nodes.select(F.lit(1).alias("node"), F.lit(0).alias("link"), "category")
    b = links.select(F.lit(0).alias("node"), F.lit(1).alias("link"), F.lit(None).cast("string").alias("category"))
    return a.unionByName(b).agg(
        F.coalesce(F.sum("node"), F.lit(0)).cast("long").alias("total_nodes"),
        F.coalesce(F.sum("link"), F.lit(0)).cast("long").alias("total_edges"),
        F.countDistinct("category").alias("categories"),
    )


def standard_view(df: DataFrame, column: str, default: int) -> DataFrame:
    """Fill the display size of nodes (25) or the value of edges (1) where it is not set."""
    if column not in df.columns:
        return df.withColumn(column, F.lit(default))
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def category_subgraph(nodes: DataFrame, links: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of one category and the links with both ends among them.

    The nodes are written once: the optimizer moves the joins below into every table that links are made
    from, and one task would find the nodes anew for each of them.
    """
    kept = stage(nodes.where(F.col("category") == category))
    inside = links.join(kept.select(F.col("id").alias("source")), "source", "left_semi").join(
        kept.select(F.col("id").alias("target")), "target", "left_semi"
    )
    return kept, inside


def search_nodes(nodes: DataFrame, text: str, k: int = 10) -> DataFrame:
    hit = F.col("name").ilike(f"%{text}%") | F.col("category").ilike(f"%{text}%")
    return top(nodes.where(hit), ["id"], k)


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, degree) for all nodes; a loop counts twice."""
    ends = links.select(F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("n"))
    return nodes.select("id", F.lit(0).alias("n")).unionByName(ends).groupBy("id").agg(F.sum("n").cast("long").alias("degree"))


def node_sizes(nodes: DataFrame, links: DataFrame, smallest: int = 5, largest: int = 20) -> DataFrame:
    """Symbol size by the square root of the normalized degree, the middle when all are equal."""
    deg = degrees(nodes, links)
    low, high = deg.agg(F.min("degree")).scalar(), deg.agg(F.max("degree")).scalar()
    scaled = F.floor(smallest + (largest - smallest) * F.sqrt((F.col("degree") - low) / (high - low)) + 0.5)
    size = F.when(high > low, scaled).otherwise(F.floor(F.lit((smallest + largest) / 2 + 0.5)))
    return deg.withColumn("size", size.cast("long"))


# ---- edits: each returns the next version of the relationship rows


def _label(category: Column) -> Column:
    return F.when(category == "attribute", "attribute").otherwise("entity")


def _type(category: Column) -> Column:
    return F.when(category != "entity", category)


def set_category(rels: DataFrame, name: str, category: str) -> DataFrame:
    """Set the type of a node wherever it occurs; 'entity' clears it."""
    new = F.lit(None if category == "entity" else category).cast("string")
    return rels.withColumns(
        {f"{p}_type": F.when(F.col(f"{p}_name") == name, new).otherwise(F.col(f"{p}_type")) for p in "st"}
    )


def add_edges(rels: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """Append (source, source_category, relation, target, target_category) rows.

    New rows continue the sequence: the last ``seq`` plus their own ``order``, counted from 1.
    """
    last = F.coalesce(rels.agg(F.max("seq")).scalar(), F.lit(0))
    s, t = F.coalesce("source_category", F.lit("entity")), F.coalesce("target_category", F.lit("entity"))
    new = edges.select(
        (last + F.col(order)).alias("seq"),
        _label(s).alias("s_label"), F.col("source").alias("s_name"), _type(s).alias("s_type"),
        "relation",
        _label(t).alias("t_label"), F.col("target").alias("t_name"), _type(t).alias("t_type"),
    )
    return rels.unionByName(new)


def add_nodes(rels: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Append nodes as triples from themselves to themselves."""
    edges = nodes.select(
        F.col("name").alias("source"), F.col("category").alias("source_category"), F.lit("self").alias("relation"),
        F.col("name").alias("target"), F.col("category").alias("target_category"), order,
    )
    return add_edges(rels, edges, order)


def delete_node(rels: DataFrame, name: str) -> DataFrame:
    """Drop every row that touches the node; rows with unnamed ends stay."""
    return rels.where(~F.col("s_name").eqNullSafe(F.lit(name)) & ~F.col("t_name").eqNullSafe(F.lit(name)))


def _first_match(rels: DataFrame, source: str, relation: str, target: str) -> Column:
    test = (F.col("s_name") == source) & (F.col("relation") == relation) & (F.col("t_name") == target)
    return F.col("seq").eqNullSafe(F.coalesce(rels.where(test).agg(F.min("seq")).scalar(), F.lit(-1)))


def delete_edge(rels: DataFrame, source: str, relation: str, target: str) -> DataFrame:
    """Drop the first matching row only."""
    return rels.where(~_first_match(rels, source, relation, target))


def update_edge(
    rels: DataFrame, source: str, relation: str, target: str,
    new_source: str | None = None, new_relation: str | None = None, new_target: str | None = None,
    new_source_category: str | None = None, new_target_category: str | None = None,
) -> DataFrame:
    """Edit the first matching row; a new category also sets the label."""
    values: dict[str, Column] = {}
    for column, value in (("s_name", new_source), ("relation", new_relation), ("t_name", new_target)):
        if value is not None:
            values[column] = F.lit(value)
    for p, category in (("s", new_source_category), ("t", new_target_category)):
        if category is not None:
            values[f"{p}_type"] = F.lit(None if category == "entity" else category).cast("string")
            values[f"{p}_label"] = _label(F.lit(category))
    hit = _first_match(rels, source, relation, target)
    return rels.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})

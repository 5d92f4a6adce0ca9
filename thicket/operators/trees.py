"""Hierarchies given by parent ids or by materialized paths.

A tree is a frame of (id, parent, root, depth, path) rows, never a nested value, so it can be as
large as the table. Ways to the root are put together by doubling: every node knows the way to the
node 1, 2, 4, … above it, so a tree of any shape takes as many rounds as the logarithm of its depth.
Each round is one equi-join and is staged, so that neither the plan nor a lost executor makes
earlier ones run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.ordering import dense_index
from thicket.session import stage


def forest(
    nodes: DataFrame,
    id: str = "id",
    parent: str = "parent_id",
    orphans: str = "root",
    root_value: Any = None,
    order: Sequence[Column] = (),
) -> DataFrame:
    """(id, parent_id, root_id, depth, path, order_path) of every node that hangs on a root.

    A root has no parent, an empty one or ``root_value``. A node with an unknown parent is a root
    (``orphans='root'``) or left out (``'drop'``). Cycles have no root and drop out (see
    :func:`unrooted`). ``path`` runs
    from the root to the node; ordering by ``order_path`` gives pre-order with siblings in
    ``order``. Ids must be unique.
    """
    if orphans not in ("root", "drop"):
        raise ValueError("orphans is 'root' or 'drop'")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col(id).alias("id"))
    base = nodes.select(F.col(id).alias("id"), F.col(parent).alias("parent_id"), key.alias("_key"))
    base = base.where(F.col("id").isNotNull())
    rootless = F.col("parent_id").isNull() | (F.col("parent_id").cast("string") == "")
    if root_value is not None:
        rootless = rootless | (F.col("parent_id") == root_value)
    linked = base.where(~rootless)
    roots = base.where(rootless)
    if orphans == "root":
        known = base.select(F.col("id").alias("_p"))
        roots = roots.unionByName(linked.join(known, F.col("parent_id") == F.col("_p"), "left_anti"))
        linked = linked.join(known, F.col("parent_id") == F.col("_p"), "left_semi")
    kind = base.schema["id"].dataType
    above = lambda c: c.cast(kind).alias("up")
    alone = [F.array("id").alias("path"), F.array("_key").alias("order_path")]
    done = [stage(roots.select("id", "parent_id", above(F.lit(None)), *alone))]
    hanging = stage(linked.select("id", "parent_id", above(F.col("parent_id")), *alone))
    while not hanging.isEmpty():
        every = reduce(DataFrame.unionByName, [*done, hanging]).select(F.col("id").alias("_p"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("order_path").alias("_op"))
        # who meets an id of its own way again hangs on a cycle
        joined = stage(
            hanging.where(~F.array_contains("path", F.col("up"))).join(every, F.col("up") == F.col("_p")).select(
                "id", "parent_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.concat("_op", "order_path").alias("order_path")
            )
        )
        done.append(joined.where(F.col("up").isNull()))
        hanging = joined.where(F.col("up").isNotNull())
    rooted = reduce(DataFrame.unionByName, done)
    return rooted.select("id", "parent_id", F.get("path", F.lit(0)).alias("root_id"), (F.size("path") - 1).alias("depth"), "path", "order_path")


def unrooted(nodes: DataFrame, tree: DataFrame, id: str = "id") -> DataFrame:
    """Nodes that :func:`forest` left out: those on a cycle, below one, or below an unknown parent."""
    return nodes.where(F.col(id).isNotNull()).join(tree.select(F.col("id").alias("_t")), F.col(id) == F.col("_t"), "left_anti")


def intervals(tree: DataFrame) -> DataFrame:
    """(id, first, last): the node's place in pre-order, and the last place of its subtree.

    ``d`` lies in the subtree of ``a`` if and only if ``a.first <= d.first <= a.last``: a subtree is one range.
    """
    sizes = tree.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    placed = pre_order(tree).select("id", F.col("position").alias("first"))
    return placed.join(sizes, "id").select("id", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def closure(tree: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every node and each of its ancestors, from the path arrays."""
    up = F.reverse("path")
    return tree.select("id", F.posexplode(up).alias("distance", "ancestor")).where(F.col("distance") > 0)


def pre_order(tree: DataFrame) -> DataFrame:
    """Nodes numbered in pre-order."""
    return dense_index(tree.select("id", "depth", "order_path"), [], ["order_path"], "position").drop("order_path")


def filter_tree(nodes: DataFrame, keep: Column, id: str = "id", parent: str = "parent_id") -> DataFrame:
    """Nodes that match together with all their ancestors: the forest of matching nodes whose
    chain of matching parents reaches a true root."""
    return forest(nodes.where(keep), id, parent, orphans="drop")


def find_by_path(nodes: DataFrame, tree: DataFrame, path: str, level: int = 0) -> DataFrame:
    """The node with a path, with the id of its ancestor at ``level`` (null if it is not below one)."""
    found = nodes.where(F.col("path") == path).select("id", F.col("path").alias("node_path"))
    parents = F.slice("path", 1, F.size("path") - 1)
    return found.join(tree.select("id", "path"), "id").select(
        "id", "node_path", F.get(parents, F.lit(level)).alias("root_menu")
    )


# ---- materialized paths such as '/R1/N5/'


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def descendants(nodes: DataFrame, node_id: str, node_path: str) -> DataFrame:
    """Nodes below one node, by path prefix (a range the scan can use)."""
    return nodes.where(F.col("path").startswith(f"{node_path}{node_id}/"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance), nearest ancestor first, for all nodes, from their paths."""
    up = F.reverse(path_parts(F.col("path")))
    return nodes.select("id", F.posexplode(up).alias("d", "ancestor")).select(
        "id", "ancestor", (F.col("d") + 1).alias("distance")
    )


def with_counts(nodes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Nodes with the number of children and, if given, of users."""
    children = nodes.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))
    out = nodes.join(children, "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    if users is not None:
        people = users.groupBy(F.col("dept_id").alias("id")).agg(F.count(F.lit(1)).alias("user_count"))
        out = out.join(people, "id", "left").withColumn("user_count", F.coalesce("user_count", F.lit(0)))
    return out


def search_with_ancestors(nodes: DataFrame, match: Column, users: DataFrame) -> DataFrame:
    """Matching nodes and all their ancestors, with child and user counts and the match flag."""
    hits = nodes.where(match)
    above = hits.select(F.explode(path_parts(F.col("path"))).alias("id"), F.lit(False).alias("hit"))
    wanted = (
        hits.select("id", F.lit(True).alias("hit")).unionByName(above).groupBy("id").agg(F.max("hit").alias("matched"))
    )
    return with_counts(nodes, users).join(wanted, "id")


def children_of(nodes: DataFrame, parent: str | None, users: DataFrame | None = None) -> DataFrame:
    test = F.col("parent_id").isNull() if parent is None else F.col("parent_id") == parent
    return with_counts(nodes, users).where(test)


def users_below(nodes: DataFrame, users: DataFrame, node_id: str, include_children: bool = True) -> DataFrame:
    """Active users of a department and, if asked, of everything below it."""
    inside = F.col("id") == node_id
    if include_children:
        inside = inside | F.array_contains(path_parts(F.col("path")), node_id)
    wanted = nodes.where(inside).select(F.col("id").alias("dept_id"))
    return users.where(F.col("user_status") == 1).join(wanted, "dept_id", "left_semi")


def subtree_users(nodes: DataFrame, users: DataFrame) -> DataFrame:
    """Active users in the subtree of every node; users are counted per department first."""
    counts = users.where(F.col("user_status") == 1).groupBy("dept_id").agg(F.count(F.lit(1)).alias("n"))
    holders = nodes.select(
        F.col("id").alias("dept_id"), F.explode(F.array_append(path_parts(F.col("path")), F.col("id"))).alias("id")
    )
    return holders.join(counts, "dept_id").groupBy("id").agg(F.sum("n").cast("long").alias("users"))


def move(nodes: DataFrame, node_id: str, new_parent: str | None) -> DataFrame:
    """Hang a node under another parent and rewrite path and level of its whole subtree.

    Refuses a missing node or parent, the node itself and any of its descendants. The two rows
    are looked up by key; the rewrite is one projection without a shuffle.
    """
    node = nodes.where(F.col("id") == node_id).select("path", "level").first()
    if node is None:
        raise ValueError(f"no node {node_id}")
    path, level = "/", 0
    if new_parent is not None:
        target = nodes.where(F.col("id") == new_parent).select("path", "level").first()
        if new_parent == node_id:
            raise ValueError("a node cannot be its own parent")
        if target is None:
            raise ValueError(f"no node {new_parent}")
        if f"{target.path}{new_parent}/".startswith(f"{node.path}{node_id}/"):
            raise ValueError("a node cannot move below itself")
        path, level = f"{target.path}{new_parent}/", target.level + 1
    old, new = f"{node.path}{node_id}/", f"{path}{node_id}/"
    itself, below = F.col("id") == node_id, F.col("path").startswith(old)
    return (
        nodes.withColumn("parent_id", F.when(itself, F.lit(new_parent)).otherwise(F.col("parent_id")))
        .withColumn("level", F.when(itself | below, F.col("level") + (level - node.level)).otherwise(F.col("level")))
        .withColumn("path", F.when(itself, F.lit(path)).otherwise(F.when(below, _swap(old, new)).otherwise(F.col("path"))))
    )


def _swap(old: str, new: str) -> Column:
    return F.concat(F.lit(new), F.col("path").substr(F.lit(len(old) + 1), F.length("path")))


def rewrite_prefix(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """Replace the path prefix of a folder and of everything in it."""
    return nodes.withColumn(
        "path",
        F.when(F.col("path") == old, F.lit(new))
        .when(F.col("path").startswith(old + "/"), _swap(old, new))
        .otherwise(F.col("path")),
    )


def delete_subtree(nodes: DataFrame, path: str, hard: bool = True, flag: str = "is_deleted") -> DataFrame:
    """Remove, or flag, a folder and everything in it."""
    inside = (F.col("path") == path) | F.col("path").startswith(path + "/")
    return nodes.where(~inside) if hard else nodes.withColumn(flag, inside)


def deletable(nodes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Nodes without children and, if users are given, without users."""
    parents = nodes.select(F.col("parent_id").alias("id"))
    out = nodes.join(parents, "id", "left_anti")
    return out if users is None else out.join(users.select(F.col("dept_id").alias("id")), "id", "left_anti")


def is_below(nodes: DataFrame, node_id: str, possible_ancestor: str) -> DataFrame:
    """One boolean: whether a node lies below another."""
    hit = F.array_contains(path_parts(F.col("path")), possible_ancestor)
    return nodes.where(F.col("id") == node_id).select("id", hit.alias("below"))


def count_by_value(nodes: DataFrame, column: str, values: Sequence[Any], prefix: str) -> list[Column]:
    """One conditional count per listed value, so absent values are 0."""
    return [F.count_if(F.col(column) == v).alias(f"{prefix}_{v}") for v in values]


def department_stats(nodes: DataFrame, types: Sequence[str]) -> DataFrame:
    live = nodes.where(~F.col("is_deleted"))
    return live.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("status")).alias("active_count"),
        F.count_if(~F.col("status")).alias("inactive_count"),
        F.count_if(F.col("parent_id").isNull()).alias("root_count"),
        *count_by_value(live, "dept_type", types, "type"),
        F.max("level").alias("max_level"),
    )


def post_stats(posts: DataFrame, types: Sequence[str], levels: Sequence[int]) -> DataFrame:
    live = posts.where(~F.col("is_deleted"))
    return live.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("status")).alias("active_count"),
        *count_by_value(live, "post_type", types, "type"),
        *count_by_value(live, "post_level", levels, "level"),
    )


def menu_stats(menus: DataFrame, tree: DataFrame, types: Sequence[str]) -> DataFrame:
    """Counts per type and the depth of the deepest menu."""
    depths = tree.select("id", "depth")
    joined = menus.join(depths, "id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_count"),
        *count_by_value(joined, "type", types, "type"),
        F.max("depth").alias("max_depth"),
    )


def routes(menus: DataFrame, tree: DataFrame) -> DataFrame:
    """Route rows: JSON of the non-null settings, with parent and depth, for the kept forest."""
    meta = F.to_json(F.struct(*[F.col(c) for c in ("name", "path", "parent_id")]), {"ignoreNullFields": "true"})
    parents = menus.select(F.col("parent_id").alias("id"), F.lit(True).alias("_has")).where(F.col("id").isNotNull()).distinct()
    return (
        menus.select("id", meta.alias("meta"))
        .join(tree.select("id", "depth"), "id")
        .join(parents, "id", "left")
        .select("id", "depth", "meta", F.col("_has").isNotNull().alias("has_children"))
    )

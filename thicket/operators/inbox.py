"""Announcements, read receipts, messages and knowledge-base listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import fill_template
from thicket.ordering import top_per_key


def current(announcements: DataFrame, as_of: Column) -> DataFrame:
    """Published and not expired at ``as_of``; no expiry time means never."""
    live = F.col("expire_time").isNull() | (F.col("expire_time") > as_of)
    return announcements.where((F.col("status") == "published") & live)


def targets(announcements: DataFrame, as_of: Column) -> DataFrame:
    """(announcement_id, kind, key) of current announcements, except those for everyone."""
    live = current(announcements, as_of).where(F.col("target_type") != "all")
    return live.select(
        F.col("id").alias("announcement_id"),
        F.col("target_type").alias("kind"),
        F.explode(F.array_distinct("target_ids")).alias("key"),
    )


def memberships(users: DataFrame) -> DataFrame:
    """(user_id, kind, key): a user's one department, one role and own id."""
    keys = F.array(
        F.struct(F.lit("dept").alias("kind"), F.col("dept_id").alias("key")),
        F.struct(F.lit("role").alias("kind"), F.col("role_id").alias("key")),
        F.struct(F.lit("user").alias("kind"), F.col("id").cast("string").alias("key")),
    )
    return users.select(F.col("id").alias("user_id"), F.inline(keys))


def _count_all(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def audience_sizes(announcements: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Number of users each current announcement reaches.

    Users are counted per (kind, key) first; announcements then join those counts. A role with
    a third of all users is one number, no (announcement, user) pairs are made.
    """
    sizes = memberships(users).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    targeted = targets(announcements, as_of).join(sizes, ["kind", "key"], "left").select("announcement_id", "n")
    everyone = (
        current(announcements, as_of)
        .where(F.col("target_type") == "all")
        .select(F.col("id").alias("announcement_id"), _count_all(users).alias("n"))
    )
    return (
        targeted.unionByName(everyone)
        .groupBy("announcement_id")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("reached"))
    )


def visible_counts(announcements: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Number of announcements each user sees, by counting announcements per (kind, key)."""
    per_key = targets(announcements, as_of).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    targeted = memberships(users).join(per_key, ["kind", "key"]).select("user_id", "n")
    everyone = current(announcements, as_of).where(F.col("target_type") == "all")
    base = users.select(F.col("id").alias("user_id"), _count_all(everyone).alias("n"))
    return base.unionByName(targeted).groupBy("user_id").agg(F.sum("n").cast("long").alias("visible"))


def visible_to(
    announcements: DataFrame, user_id, dept_ids: list[str], role_ids: list[str], as_of: Column
) -> DataFrame:
    """What one user sees: audience by array containment, no join."""
    ids = F.col("target_ids")
    kind = F.col("target_type")
    audience = (
        (kind == "all")
        | ((kind == "dept") & F.arrays_overlap(ids, F.lit(dept_ids)))
        | ((kind == "role") & F.arrays_overlap(ids, F.lit(role_ids)))
        | ((kind == "user") & F.array_contains(ids, str(user_id)))
    )
    return current(announcements, as_of).where(audience)


def visible_receipts(reads: DataFrame, announcements: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Receipts on announcements that their reader sees: two equi-joins and a predicate."""
    live = current(announcements, as_of).select(F.col("id").alias("announcement_id"), "target_type", "target_ids")
    who = users.select(F.col("id").alias("user_id"), "dept_id", "role_id")
    kind, ids = F.col("target_type"), F.col("target_ids")
    sees = (
        (kind == "all")
        | ((kind == "dept") & F.array_contains(ids, F.col("dept_id")))
        | ((kind == "role") & F.array_contains(ids, F.col("role_id")))
        | ((kind == "user") & F.array_contains(ids, F.col("user_id").cast("string")))
    )
    pairs = reads.select("announcement_id", "user_id").distinct()
    return pairs.join(live, "announcement_id").join(who, "user_id").where(sees).select("announcement_id", "user_id")


def unread_per_user(announcements: DataFrame, users: DataFrame, reads: DataFrame, as_of: Column) -> DataFrame:
    """Visible minus read, per user; the work grows with users, announcements and receipts only."""
    seen = visible_counts(announcements, users, as_of)
    read = visible_receipts(reads, announcements, users, as_of).groupBy("user_id").agg(F.count(F.lit(1)).alias("read"))
    left = F.col("visible") - F.coalesce("read", F.lit(0))
    return seen.join(read, "user_id", "left").select("user_id", left.alias("unread"))


def with_read_flag(seen: DataFrame, reads: DataFrame, user_id) -> DataFrame:
    """The announcements one user sees, with whether the user has read them."""
    flags = reads.where(F.col("user_id") == user_id).select(F.col("announcement_id").alias("id"), F.lit(True).alias("_read"))
    return seen.join(flags.distinct(), "id", "left").select(*seen.columns, F.col("_read").isNotNull().alias("is_read"))


def readers(reads: DataFrame, users: DataFrame, latest: int = 100) -> DataFrame:
    """The latest readers of every announcement with their names.

    ``listed`` is the length of that list, ``total_read`` the true number of receipts.
    """
    totals = reads.groupBy("announcement_id").agg(F.count(F.lit(1)).alias("total_read"))
    shown = top_per_key(reads, ["announcement_id"], [F.desc("read_at"), "user_id"], latest)
    names = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return (
        shown.join(names, "user_id", "left")
        .join(totals, "announcement_id")
        .select(
            "announcement_id",
            "user_id",
            F.coalesce("user_name", F.lit("")).alias("user_name"),
            "read_at",
            "total_read",
            F.least("total_read", F.lit(latest)).cast("long").alias("listed"),
        )
    )


def fan_out(recipients: DataFrame, title: str, content: str, values: dict[str, Column]) -> DataFrame:
    """One message per recipient with the templates filled from the recipient's own columns."""
    return recipients.select(
        F.col("id").alias("recipient_id"),
        fill_template(F.lit(title), values).alias("title"),
        fill_template(F.lit(content), values).alias("content"),
        F.lit("unread").alias("status"),
    )


def bases_with_counts(bases: DataFrame, files: DataFrame, granted: DataFrame | None = None) -> DataFrame:
    """Knowledge bases with their number of files, 0 when empty, optionally only granted ones."""
    if granted is not None:
        bases = bases.join(granted.select(F.col("kb_id").alias("id")), "id", "left_semi")
    counts = files.groupBy(F.col("kb_id").alias("id")).agg(F.count(F.lit(1)).alias("file_count"))
    return bases.join(counts, "id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def visible_bases(bases: DataFrame, grants: DataFrame, role: str | None, superuser: bool = False) -> DataFrame:
    """Superusers see every base, users without a role none."""
    if superuser:
        return bases
    if role is None:
        return bases.where(F.lit(False))
    mine = grants.where(F.col("role_id") == role).select(F.col("kb_id").alias("id"))
    return bases.join(mine, "id", "left_semi")

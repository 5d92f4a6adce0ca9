"""Roles, permissions, request matching and row-level data scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.ordering import running_total

ALL_METHODS = 5
#: Parts of the departments below one ancestor.
SCOPE_PARTS = 32
# Labels of permission types, and the type of a permission without one.
PERMISSION_TYPES = {0: "按钮权限", 1: "API权限", 2: "数据权限", 3: "其他权限"}
OTHER_TYPE = 3
PLACEHOLDER = r"\{[^}]+\}"


def path_matches(path: Column, template: Column) -> Column:
    """Whether a path fits a template; ``{name}`` stands for one segment."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(template, PLACEHOLDER, "[^/]+"), F.lit("$"))
    return F.rlike(path, pattern)


def match_requests(requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permission of each distinct (path, method): exact, else any-method, else template.

    Templates are found by an equi-join: segments that hold a placeholder are blanked in the
    template, and a request joins under each blanking that some template uses; only those pairs
    are tested in full. No request is compared with every template. Requests are reduced to
    distinct (path, method) first, so a hot path costs one row. Among several matches, exact
    wins, then any-method, then the smallest permission id. Of permissions with one path and method only
    the smallest id can win, so only that one meets requests.
    """
    usable = permissions.where(F.col("is_active") & ~F.col("is_deleted"))
    usable = usable.groupBy("api_path", "http_method").agg(F.min("id").alias("id"))
    has_slot = F.col("api_path").contains("{")
    slots = F.transform(F.split("api_path", "/"), lambda p: F.when(p.contains("{"), "*").otherwise(p))
    exact = usable.select(
        F.col("api_path").alias("k"), F.col("http_method").alias("m"), F.col("id").alias("permission_id")
    )
    templates = usable.where(has_slot).select(
        F.array_join(slots, "/").alias("k"),
        F.transform(slots, lambda p: p == "*").alias("mask"),
        F.col("http_method").alias("m"),
        "api_path",
        F.col("id").alias("permission_id"),
    )
    asked = requests.select("path", "method").distinct()
    tried = asked.select("path", "method", F.explode(F.array(F.col("method"), F.lit(ALL_METHODS))).alias("m"))
    direct = tried.join(exact, (F.col("path") == F.col("k")) & (tried["m"] == exact["m"])).select(
        "path", "method", F.when(tried["m"] == F.col("method"), 1).otherwise(2).alias("priority"), "permission_id"
    )
    # the blankings in use: a handful of shapes, whatever the number of templates or requests
    masks = templates.select("mask").distinct().withColumn("n", F.size("mask"))
    shaped = tried.withColumn("n", F.size(F.split("path", "/"))).join(masks, "n")
    blanked = F.zip_with(F.split("path", "/"), "mask", lambda p, hidden: F.when(hidden, "*").otherwise(p))
    shaped = shaped.withColumn("k", F.array_join(blanked, "/"))
    by_template = (
        shaped.join(templates.drop("mask"), ["k", "m"])
        .where(path_matches(F.col("path"), F.col("api_path")))
        .select("path", "method", F.lit(3).alias("priority"), "permission_id")
    )
    return (
        direct.unionByName(by_template)
        .groupBy("path", "method")
        .agg(F.min(F.struct("priority", "permission_id")).alias("best"))
        .select("path", "method", "best.priority", "best.permission_id")
    )


def decide(requests: DataFrame, users: DataFrame, permissions: DataFrame, grants: DataFrame) -> DataFrame:
    """Allowed or not per request; paths without a permission are open, superusers pass."""
    matched = match_requests(requests, permissions).drop("priority")
    who = users.select(F.col("id").alias("user_id"), "role_id", "is_superuser")
    granted = grants.select("role_id", "permission_id", F.lit(True).alias("granted"))
    out = (
        requests.join(matched, ["path", "method"], "left")
        .join(who, "user_id", "left")
        .join(granted, ["role_id", "permission_id"], "left")
    )
    allowed = (
        F.coalesce("is_superuser", F.lit(False))
        | F.col("permission_id").isNull()
        | F.coalesce("granted", F.lit(False))
    )
    return out.select(*requests.columns, "permission_id", allowed.alias("allowed"))


def role_permissions(grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """Active permission codes and API paths of every role."""
    usable = permissions.where(F.col("is_active") & ~F.col("is_deleted")).select(
        F.col("id").alias("permission_id"), "code", "api_path", "http_method"
    )
    return grants.join(usable, "permission_id").select("role_id", "code", "api_path", "http_method").distinct()


def menu_permissions(menus: DataFrame, permissions: DataFrame, role_menu: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """One row per menu and permission with the role's ``checked`` flags; leaf menus carry permissions.

    Permissions come with name, code, type and the type's label; a missing type counts as the last one.
    """
    labels = F.create_map(*[F.lit(x) for pair in PERMISSION_TYPES.items() for x in pair])
    kind = F.coalesce("permission_type", F.lit(OTHER_TYPE))
    my_menus = role_menu.where(F.col("role_id") == role).select("menu_id", F.lit(True).alias("_m")).distinct()
    my_perms = grants.where(F.col("role_id") == role).select("permission_id", F.lit(True).alias("_p")).distinct()
    parents = menus.select(F.col("parent_id").alias("menu_id")).where(F.col("parent_id").isNotNull()).distinct()
    perms = (
        permissions.where(F.col("is_active") & ~F.col("is_deleted"))
        .select(
            "menu_id", F.col("id").alias("permission_id"), F.col("name").alias("permission_name"), F.col("code").alias("permission_code"),
            kind.alias("permission_type"), F.coalesce(F.try_element_at(labels, kind), F.lit(PERMISSION_TYPES[OTHER_TYPE])).alias("permission_type_label"),
        )
        .join(parents, "menu_id", "left_anti")
        .join(my_perms, "permission_id", "left")
    )
    return (
        menus.select(F.col("id").alias("menu_id"), "parent_id", "name")
        .join(my_menus, "menu_id", "left")
        .join(perms, "menu_id", "left")
        .select(
            "menu_id",
            "parent_id",
            "name",
            F.col("_m").isNotNull().alias("menu_checked"),
            "permission_id",
            "permission_name",
            "permission_code",
            "permission_type",
            "permission_type_label",
            F.col("_p").isNotNull().alias("permission_checked"),
        )
    )


def permissions_of_menu(permissions: DataFrame, grants: DataFrame, role: str, menu: str) -> DataFrame:
    mine = grants.where(F.col("role_id") == role).select(F.col("permission_id").alias("id"), F.lit(True).alias("_g")).distinct()
    return (
        permissions.where((F.col("menu_id") == menu) & F.col("is_active") & ~F.col("is_deleted"))
        .join(mine, "id", "left")
        .select("id", "name", "code", F.col("_g").isNotNull().alias("checked"))
    )


def menus_with_counts(menus: DataFrame, permissions: DataFrame, role_menu: DataFrame, role: str) -> DataFrame:
    """Menus with the number of active permissions and whether the role has the menu."""
    counts = (
        permissions.where(F.col("is_active") & ~F.col("is_deleted"))
        .groupBy(F.col("menu_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("permission_count"))
    )
    mine = role_menu.where(F.col("role_id") == role).select(F.col("menu_id").alias("id"), F.lit(True).alias("_m")).distinct()
    return (
        menus.join(counts, "id", "left")
        .join(mine, "id", "left")
        .select(
            "id",
            "parent_id",
            "name",
            F.coalesce("permission_count", F.lit(0)).alias("permission_count"),
            F.col("_m").isNotNull().alias("selected"),
        )
    )


def granted_menus(menus: DataFrame, role_menu: DataFrame, role: str | None, superuser: bool = False) -> DataFrame:
    if superuser:
        return menus
    mine = role_menu.where(F.col("role_id") == role).select(F.col("menu_id").alias("id"))
    return menus.join(mine, "id", "left_semi")


def role_with_relations(roles: DataFrame, role_menu: DataFrame, grants: DataFrame, role_dept: DataFrame) -> DataFrame:
    """Role with everything attached to it, in long form: (role_id, name, kind, target_id).

    A role may hold any number of grants, so they stay rows; nothing is collected per role.
    """
    part = lambda df, kind, col: df.select(
        "role_id", F.lit(kind).alias("kind"), F.col(col).cast("string").alias("target_id")
    ).distinct()
    links = (
        part(role_menu, "menu", "menu_id")
        .unionByName(part(grants, "permission", "permission_id"))
        .unionByName(part(role_dept, "dept", "dept_id"))
    )
    return roles.select(F.col("id").alias("role_id"), "name").join(links, "role_id", "left")


def direct_reports(users: DataFrame) -> DataFrame:
    """(manager, report) pairs of active users."""
    bosses = users.select(F.col("id").alias("manager_id"), F.col("name").alias("manager_name"))
    reports = users.where(F.col("user_status") == 1).select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), "manager_id"
    )
    return reports.join(bosses, "manager_id").select("manager_id", "manager_name", "user_id", "user_name")


def members(users: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Active users of each role, post or department that exists."""
    wanted = groups.select(F.col("id").alias(key)).distinct()
    return users.where(F.col("user_status") == 1).join(wanted, key, "left_semi")


def allowed_departments(users: DataFrame, scope: DataFrame, departments: DataFrame, role_dept: DataFrame) -> DataFrame:
    """(user_id, dept_id) that each user may read; scopes 0 and 1 need no departments.

    ``scope`` has (user_id, scope): 2 own department, 3 own department and below, 4 the
    departments attached to the role. The subtree comes from the materialized path: each
    department is exploded to its ancestors, so it is an equi-join. The pairs grow with users times
    departments below, so they are not shuffled: both sides of the joins are made distinct, and only
    pairs of users with several departments, roles or scopes are compared with each other.
    """
    who = users.select(F.col("id").alias("user_id"), "dept_id", "role_id").join(scope, "user_id").where(F.col("scope").isin(2, 3, 4))
    who = who.select("user_id", "dept_id", "role_id", "scope").distinct()
    who = who.join(who.groupBy("user_id").agg((F.count(F.lit(1)) > 1).alias("_several")), "user_id")
    above = departments.select(
        F.col("id").alias("below"),
        F.explode(F.filter(F.split("path", "/"), lambda x: x != "")).alias("dept_id"),
    )
    # the departments of one ancestor are dealt over parts, so that a few large subtrees run in many tasks
    dealt = above.distinct().where(~F.col("below").eqNullSafe(F.col("dept_id"))).withColumn("_part", F.pmod(F.xxhash64("below"), F.lit(SCOPE_PARTS)))
    attached = role_dept.select("role_id", "dept_id").distinct()

    def pairs(some: DataFrame) -> DataFrame:
        own = some.where(F.col("scope").isin(2, 3)).select("user_id", "dept_id")
        heads = some.where(F.col("scope") == 3).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SCOPE_PARTS - 1).cast("long"))))
        deeper = heads.join(dealt, ["dept_id", "_part"]).select("user_id", F.col("below").alias("dept_id"))
        custom = some.where(F.col("scope") == 4).drop("dept_id").join(attached, "role_id").select("user_id", "dept_id")
        return own.unionByName(deeper).unionByName(custom)

    return pairs(who.where(~F.col("_several"))).unionByName(pairs(who.where("_several")).distinct())


def scope_ranges(users: DataFrame, scope: DataFrame, places: DataFrame, role_dept: DataFrame) -> DataFrame:
    """(user_id, first, last): the departments that each user may read, as ranges of places.

    ``places`` is ``(id, first, last)`` as ``trees.intervals`` gives it, so a department with everything
    below it is one row per user, whatever the size of the subtree. Departments attached to a role
    are joined to ranges where their places follow one another, once per role.
    """
    who = users.select(F.col("id").alias("user_id"), "dept_id", "role_id").join(scope, "user_id")
    at = places.withColumnRenamed("id", "dept_id")
    last = F.when(F.col("scope") == 3, F.col("last")).otherwise(F.col("first"))
    own = who.where(F.col("scope").isin(2, 3)).join(at, "dept_id").select("user_id", "first", last.alias("last"))
    attached = role_dept.select("role_id", "dept_id").distinct().join(at, "dept_id")
    run = F.col("first") - F.row_number().over(Window.partitionBy("role_id").orderBy("first"))
    joined = attached.withColumn("_run", run).groupBy("role_id", "_run").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    custom = who.where(F.col("scope") == 4).join(joined, "role_id").select("user_id", "first", "last")
    return own.unionByName(custom)


def readable_counts(ranges: DataFrame, facts: DataFrame, dept: str, places: DataFrame) -> DataFrame:
    """(user_id, n): rows of a fact table in a user's ranges, from running counts over the places.

    Facts are counted per department first; a range takes the difference of two running counts, so
    neither facts nor departments are paired with users.
    """
    counts = facts.groupBy(F.col(dept).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    placed = places.join(counts, "id", "left").select("first", F.coalesce("n", F.lit(0)).alias("n"))
    upto = running_total(placed, "first", "n")
    end = upto.select(F.col("first").alias("last"), F.col("total").alias("_end"))
    begin = upto.select("first", (F.col("total") - F.col("n")).alias("_begin"))
    return ranges.join(end, "last").join(begin, "first").groupBy("user_id").agg(F.sum(F.col("_end") - F.col("_begin")).alias("n"))


def in_ranges(facts: DataFrame, dept: str, ranges: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of a fact table whose department lies in one of the given ranges (of one user)."""
    mine = ranges.agg(F.collect_set(F.struct("first", "last")).alias("_mine"))
    at = places.select(F.col("id").alias(dept), F.col("first").alias("_place"))
    inside = F.exists("_mine", lambda r: (F.col("_place") >= r["first"]) & (F.col("_place") <= r["last"]))
    return facts.join(at, dept).crossJoin(F.broadcast(mine)).where(inside).select(*facts.columns)  # one row


def scoped_rows(facts: DataFrame, owner: str, dept: str, scope: int, user_id, dept_ids: DataFrame | None) -> DataFrame:
    """Rows of a fact table that one user may read."""
    if scope == 0:
        return facts
    if scope == 1:
        return facts.where(F.col(owner) == user_id)
    return facts.join(dept_ids.select(F.col("dept_id").alias(dept)).distinct(), dept, "left_semi")


def client_info(df: DataFrame, agent: str, forwarded: str, host: str | None = None) -> DataFrame:
    """Browser, system and device from a user agent, and the first forwarded address.

    The order of the tests is part of the result: an Android agent that names Linux is Linux on
    a desktop, an iPhone agent that says "like Mac OS X" is macOS on a desktop.
    """
    ua = F.lower(F.coalesce(F.col(agent), F.lit("")))
    has = ua.contains
    browser = (
        F.when(has("chrome") & ~has("edg"), "Chrome")
        .when(has("firefox"), "Firefox")
        .when(has("safari") & ~has("chrome"), "Safari")
        .when(has("edg"), "Edge")
        .when(has("msie") | has("trident"), "IE")
    )
    desktop = has("windows") | has("mac os") | has("macos") | has("linux")
    system = (
        F.when(has("windows"), "Windows")
        .when(has("mac os") | has("macos"), "macOS")
        .when(has("linux"), "Linux")
        .when(has("android"), "Android")
        .when(has("iphone") | has("ipad"), "iOS")
    )
    device = (
        F.when(desktop, "desktop")
        .when(has("android") | has("iphone"), "mobile")
        .when(has("ipad"), "tablet")
        .otherwise("desktop")
    )
    first_hop = F.trim(F.split(F.col(forwarded), ",")[0])
    fallback = F.coalesce(F.col(host), F.lit("0.0.0.0")) if host else F.lit("0.0.0.0")
    address = F.when(F.coalesce(F.col(forwarded), F.lit("")) == "", fallback).otherwise(first_hop)
    return df.select(
        *df.columns,
        address.alias("client_ip"),
        browser.alias("browser"),
        system.alias("os"),
        device.alias("device"),
    )

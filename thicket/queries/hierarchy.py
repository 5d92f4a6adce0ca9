"""Hierarchies over departments, menus and folders."""

from pyspark.sql import functions as F

from thicket.operators import filters, trees
from thicket.queries.registry import query

# children of regions, nations, customers by parent id alone
_TREE = """
WITH RECURSIVE tree AS (
  SELECT id, parent_id, id AS root_id, 0 AS depth, [id] AS path, [{key}] AS op FROM {table} WHERE parent_id IS NULL {orphans}
  UNION ALL SELECT c.id, c.parent_id, t.root_id, t.depth + 1, list_append(t.path, c.id), list_append(t.op, {ckey})
  FROM {table} c JOIN tree t ON c.parent_id = t.id)"""
ORPHANS = "OR parent_id NOT IN (SELECT id FROM menu)"


def tree_sql(table, key="id", orphans=""):
    return _TREE.format(table=table, key=key, ckey="c." + key, orphans=orphans)


def flat(tree):
    return tree.select("id", "parent_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


@query("h01_forest", tree_sql("menu", orphans=ORPHANS) + " SELECT id, parent_id, root_id, depth, array_to_string(path, '/') AS path FROM tree")
def _(t):
    return flat(trees.forest(t.menu))


@query("h02_department_tree", """
WITH RECURSIVE tree AS (
  SELECT id, 0 AS depth, [printf('%09d', 1000000 - sort) || id] AS op FROM dept WHERE parent_id IS NULL
  UNION ALL SELECT c.id, t.depth + 1, list_append(t.op, printf('%09d', 1000000 - c.sort) || c.id) FROM dept c JOIN tree t ON c.parent_id = t.id)
SELECT id, depth, row_number() OVER (ORDER BY op) AS position FROM tree""")
def _(t):
    return trees.pre_order(trees.forest(t.dept, order=[-F.col("sort")]))


@query("h03_descendants", "SELECT id, name, level FROM dept WHERE path LIKE '/R2/%'")
def _(t):
    return trees.descendants(t.dept, "R2", "/").select("id", "name", "level")


@query("h03_closure", tree_sql("dept") + """
SELECT id, unnest(list_slice(path, 1, len(path) - 1)) AS ancestor, len(path) - unnest(range(1, len(path))) AS distance FROM tree WHERE len(path) > 1""")
def _(t):
    return trees.closure(trees.forest(t.dept)).select("id", "ancestor", F.col("distance").cast("long"))


@query("h04_ancestors", """
WITH RECURSIVE up AS (
  SELECT id, parent_id AS ancestor, 1 AS distance FROM dept WHERE parent_id IS NOT NULL
  UNION ALL SELECT u.id, d.parent_id, u.distance + 1 FROM up u JOIN dept d ON d.id = u.ancestor WHERE d.parent_id IS NOT NULL)
SELECT * FROM up""")
def _(t):
    return trees.ancestors(t.dept)


@query("h05_depth", tree_sql("menu") + " SELECT id, depth FROM tree")
def _(t):
    return trees.forest(t.menu, orphans="drop").select("id", "depth")


@query("h06_descendants_by_parent", tree_sql("menu") + " SELECT id, depth FROM tree WHERE list_contains(path, 'PROMO') AND id <> 'PROMO'")
def _(t):
    below = trees.closure(trees.forest(t.menu, orphans="drop")).where(F.col("ancestor") == "PROMO")
    return below.select("id", F.col("distance").alias("depth"))


@query("h07_search_with_ancestors", """
WITH hits AS (SELECT * FROM dept WHERE name ILIKE '%77%' OR code ILIKE '%77%'),
     wanted AS (SELECT id, max(hit) AS matched FROM (SELECT id, true AS hit FROM hits UNION ALL SELECT unnest(string_split(trim(path, '/'), '/')), false FROM hits) GROUP BY 1)
SELECT d.id, d.name, d.parent_id, w.matched, (SELECT count(*) FROM dept c WHERE c.parent_id = d.id) AS child_count,
       (SELECT count(*) FROM users u WHERE u.dept_id = d.id) AS user_count
FROM dept d JOIN wanted w ON w.id = d.id""")
def _(t):
    match = F.col("name").ilike("%77%") | F.col("code").ilike("%77%")
    found = trees.search_with_ancestors(t.dept, match, t.users)
    return found.select("id", "name", "parent_id", "matched", "child_count", "user_count")


@query("h08_children_with_counts", """
SELECT d.id, d.name, (SELECT count(*) FROM dept c WHERE c.parent_id = d.id) AS child_count,
       (SELECT count(*) FROM users u WHERE u.dept_id = d.id) AS user_count FROM dept d WHERE parent_id = 'R3'""")
def _(t):
    return trees.children_of(t.dept, "R3", t.users).select("id", "name", "child_count", "user_count")


@query("h09_users_below", """
SELECT id, name, dept_id FROM users WHERE user_status = 1 AND dept_id IN (SELECT id FROM dept WHERE id = 'R1' OR path LIKE '%/R1/%')""")
def _(t):
    return trees.users_below(t.dept, t.users, "R1").select("id", "name", "dept_id")


@query("h09_subtree_user_counts", tree_sql("dept") + """
SELECT p.id, count(*) AS users FROM (SELECT id AS dept_id, unnest(path) AS id FROM tree) p JOIN users u ON u.dept_id = p.dept_id WHERE user_status = 1 GROUP BY 1""")
def _(t):
    return trees.subtree_users(t.dept, t.users)


@query("h10_move", """
SELECT id, CASE WHEN id = 'N5' THEN 'N6' ELSE parent_id END AS parent_id,
  CASE WHEN id = 'N5' OR path LIKE '%/N5/%' THEN level + 1 ELSE level END AS level,
  CASE WHEN id = 'N5' THEN (SELECT path || 'N6/' FROM dept WHERE id = 'N6')
       WHEN path LIKE '%/N5/%' THEN (SELECT path || 'N6/N5/' FROM dept WHERE id = 'N6') ELSE path END AS path FROM dept""")
def _(t):
    return trees.move(t.dept, "N5", "N6").select("id", "parent_id", "level", "path")


@query("h11_is_below", "SELECT id, path LIKE '%/R0/%' AS below FROM dept WHERE id = 'N0'")
def _(t):
    return trees.is_below(t.dept, "N0", "R0")


@query("h12_rewrite_prefix", """
SELECT id, CASE WHEN path = '/en/src3' THEN '/archive/s3' WHEN path LIKE '/en/src3/%' THEN '/archive/s3' || substr(path, 9) ELSE path END AS path FROM file_item""")
def _(t):
    return trees.rewrite_prefix(t.file_item, "/en/src3", "/archive/s3").select("id", "path")


@query("h13_delete_subtree_hard", "SELECT id, path FROM file_item WHERE NOT (path = '/fr' OR path LIKE '/fr/%')")
def _(t):
    return trees.delete_subtree(t.file_item, "/fr").select("id", "path")


@query("h13_delete_subtree_soft", "SELECT id, path = '/de' OR path LIKE '/de/%' AS is_deleted FROM file_item")
def _(t):
    return trees.delete_subtree(t.file_item, "/de", hard=False).select("id", "is_deleted")


@query("h14_deletable", """
SELECT id FROM dept d WHERE NOT EXISTS (SELECT 1 FROM dept c WHERE c.parent_id = d.id) AND NOT EXISTS (SELECT 1 FROM users u WHERE u.dept_id = d.id)""")
def _(t):
    return trees.deletable(t.dept, t.users).select("id")


@query("h15_menu_forest", """
WITH RECURSIVE tree AS (
  SELECT id, 0 AS depth, [printf('%09d', ord) || id] AS op FROM menu WHERE parent_id IS NULL
  UNION ALL SELECT c.id, t.depth + 1, list_append(t.op, printf('%09d', c.ord) || c.id) FROM menu c JOIN tree t ON c.parent_id = t.id)
SELECT id, depth, row_number() OVER (ORDER BY op) AS position FROM tree""")
def _(t):
    return trees.pre_order(trees.forest(t.menu, orphans="drop", order=[F.col("ord")]))


@query("h16_route_forest", tree_sql("menu") + """
SELECT m.id, t.depth, '{"name":"' || m.name || '","path":"' || m.path || '"' || CASE WHEN m.parent_id IS NULL THEN '' ELSE ',"parent_id":"' || m.parent_id || '"' END || '}' AS meta,
       EXISTS (SELECT 1 FROM menu c WHERE c.parent_id = m.id) AS has_children
FROM menu m JOIN tree t ON t.id = m.id""")
def _(t):
    return trees.routes(t.menu, trees.forest(t.menu, orphans="drop"))


@query("h17_folders", "SELECT id, name, path FROM file_item WHERE type = 'folder'")
def _(t):
    return t.file_item.where(F.col("type") == "folder").select("id", "name", "path").orderBy("path")


@query("h18_filter_tree", """
WITH RECURSIVE tree AS (
  SELECT id, 0 AS depth FROM menu WHERE parent_id IS NULL AND ord >= 3
  UNION ALL SELECT c.id, t.depth + 1 FROM menu c JOIN tree t ON c.parent_id = t.id WHERE c.ord >= 3) SELECT id, depth FROM tree""")
def _(t):
    return trees.filter_tree(t.menu, F.col("ord") >= 3).select("id", "depth")


@query("h19_pre_order", tree_sql("menu", orphans=ORPHANS) + " SELECT id, depth, row_number() OVER (ORDER BY op) AS position FROM tree")
def _(t):
    return trees.pre_order(trees.forest(t.menu))


@query("h20_map_tree", "SELECT id, parent_id, upper(name) AS name, ord * 2 AS weight FROM menu")
def _(t):
    return t.menu.select("id", "parent_id", F.upper("name").alias("name"), (F.col("ord") * 2).alias("weight"))


@query("h21_find_by_path", tree_sql("menu") + """
SELECT m.id, m.path AS node_path, t.path[1] AS root_menu FROM menu m JOIN tree t USING (id) WHERE m.path = '/promo/brand#9' AND len(t.path) > 1""")
def _(t):
    return trees.find_by_path(t.menu, trees.forest(t.menu, orphans="drop"), "/promo/brand#9")


@query("h22_lookup_by_name", "SELECT id, name, path FROM menu WHERE name = 'Brand#7'")
def _(t):
    return filters.filter_by(t.menu, equals={"name": "Brand#7"}).select("id", "name", "path")


@query("a12_department_stats", """
SELECT count(*) AS total_count, count(*) FILTER (status) AS active_count, count(*) FILTER (NOT status) AS inactive_count,
  count(*) FILTER (parent_id IS NULL) AS root_count, count(*) FILTER (dept_type = 'company') AS type_company, count(*) FILTER (dept_type = 'department') AS type_department,
  count(*) FILTER (dept_type = 'team') AS type_team, count(*) FILTER (dept_type = 'other') AS type_other, max(level) AS max_level FROM dept WHERE NOT is_deleted""")
def _(t):
    return trees.department_stats(t.dept, ["company", "department", "team", "other"])


@query("a13_post_stats", """
SELECT count(*) AS total_count, count(*) FILTER (status) AS active_count, count(*) FILTER (post_type = 'management') AS type_management,
  count(*) FILTER (post_type = 'technical') AS type_technical, count(*) FILTER (post_type = 'service') AS type_service, count(*) FILTER (post_type = 'none') AS type_none,
  count(*) FILTER (post_level = 0) AS level_0, count(*) FILTER (post_level = 1) AS level_1, count(*) FILTER (post_level = 2) AS level_2, count(*) FILTER (post_level = 9) AS level_9
FROM post WHERE NOT is_deleted""")
def _(t):
    return trees.post_stats(t.post, ["management", "technical", "service", "none"], [0, 1, 2, 9])


@query("a14_menu_stats", tree_sql("menu", orphans=ORPHANS) + """
SELECT count(*) AS total_count, count(*) FILTER (type = 'catalog') AS type_catalog, count(*) FILTER (type = 'menu') AS type_menu,
  count(*) FILTER (type = 'button') AS type_button, max(depth) AS max_depth FROM menu LEFT JOIN tree USING (id)""")
def _(t):
    return trees.menu_stats(t.menu, trees.forest(t.menu), ["catalog", "menu", "button"])


@query("a16_department_counts", """
SELECT d.id, (SELECT count(*) FROM dept c WHERE c.parent_id = d.id) AS child_count, (SELECT count(*) FROM users u WHERE u.dept_id = d.id) AS user_count FROM dept d""")
def _(t):
    return trees.with_counts(t.dept, t.users).select("id", "child_count", "user_count")

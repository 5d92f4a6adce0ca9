"""Filters, searches, access control, announcements and listings."""

from pyspark.sql import functions as F

from thicket.operators import access, filters, inbox, logstats, trees
from thicket.ordering import first_per_key
from thicket.queries.registry import query
from thicket.session import stage

AS_OF = "1999-06-01 00:00:00"
LIVE = f"status = 'published' AND (expire_time IS NULL OR expire_time > TIMESTAMP '{AS_OF}')"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("p08_login_filter", """
SELECT id, ts, username, login_ip, status FROM login_log
WHERE username ILIKE '%USER1%' AND status = 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def _(t):
    out = filters.filter_by(
        t.login_log,
        equals={"status": 0, "failure_reason": None},
        icontains={"username": "USER1", "login_ip": None},
        between={"ts": ("2024-01-05 00:00:00", "2024-01-20 00:00:00")},
    )
    return out.select("id", "ts", "username", "login_ip", "status")


@query("p09_user_filter", """
SELECT id, name, dept_id FROM users WHERE name ILIKE '%customer#%1%' AND user_status = 1 AND dept_id = 'N5'""")
def _(t):
    out = filters.filter_by(
        t.users, equals={"user_status": 1, "dept_id": "N5", "post_id": None}, icontains={"name": "customer#%1"}
    )
    return out.select("id", "name", "dept_id")


@query("p10_job_filter", """
SELECT id, code, job_group, status FROM scheduler_job
WHERE code ILIKE '%JOB2%' AND trigger_type = 'cron' AND status = 1 AND NOT is_deleted""")
def _(t):
    out = filters.filter_by(
        filters.alive(t.scheduler_job), equals={"trigger_type": "cron", "status": 1}, icontains={"code": "JOB2"}
    )
    return out.select("id", "code", "job_group", "status")


@query("p11_run_filter", """
SELECT id, job_code, start_time FROM scheduler_log
WHERE status = 'failed' AND start_time >= TIMESTAMP '1997-01-01 00:00:00' AND start_time <= TIMESTAMP '1998-12-31 00:00:00'""")
def _(t):
    out = filters.filter_by(
        t.scheduler_log,
        equals={"status": "failed", "job_id": None},
        between={"start_time": ("1997-01-01 00:00:00", "1998-12-31 00:00:00")},
    )
    return out.select("id", "job_code", "start_time")


@query("p12_source_filter", "SELECT id, code, status FROM page_def WHERE contains(code, 'example.com') AND status = 'published'")
def _(t):
    out = filters.filter_by(t.page_def, equals={"status": "published"}, contains={"code": "example.com"})
    return out.select("id", "code", "status")


@query("p13_root_files", "SELECT id, name, type FROM file_item WHERE parent_id IS NULL")
def _(t):
    return filters.in_folder(t.file_item, None).select("id", "name", "type")


@query("p13_folder_files", "SELECT id, name, size FROM file_item WHERE parent_id = 'Len/src3' AND name ILIKE '%doc%' AND type = 'file'")
def _(t):
    inside = filters.in_folder(t.file_item, "Len/src3")
    return filters.filter_by(inside, equals={"type": "file"}, icontains={"name": "doc"}).select("id", "name", "size")


@query("p14_page_filter", "SELECT id, name, category FROM page_def WHERE name ILIKE '%EXAMPLE%' AND category = 'en' AND status = 'draft'")
def _(t):
    out = filters.filter_by(t.page_def, equals={"category": "en", "status": "draft"}, icontains={"name": "EXAMPLE"})
    return out.select("id", "name", "category")


@query("p15_job_search", """
SELECT id, name, code, job_group FROM scheduler_job WHERE name ILIKE '%77%' OR code ILIKE '%77%' OR job_group ILIKE '%77%'""")
def _(t):
    return filters.keyword_any(t.scheduler_job, "77", ["name", "code", "job_group"]).select("id", "name", "code", "job_group")


@query("p16_announcement_search", """
SELECT id, title, content FROM announcement WHERE status = 'published' AND (title ILIKE '%RING%' OR content ILIKE '%RING%')""")
def _(t):
    found = filters.keyword_any(filters.filter_by(t.announcement, equals={"status": "published"}), "RING", ["title", "content"])
    return found.select("id", "title", "content")


@query("p17_role_search", "SELECT id, name, code FROM role WHERE name ILIKE '%ur%' OR code ILIKE '%ur%'")
def _(t):
    return filters.keyword_any(t.role, "ur", ["name", "code"]).select("id", "name", "code")


@query("p17_permission_search", """
SELECT id, name, code, api_path FROM permission WHERE NOT is_deleted AND (name ILIKE '%red%' OR code ILIKE '%red%' OR api_path ILIKE '%red%')""")
def _(t):
    return filters.keyword_any(filters.alive(t.permission), "red", ["name", "code", "api_path"]).select("id", "name", "code", "api_path")


@query("p17_dict_search", "SELECT id, label, value FROM dict_item WHERE label ILIKE '%small%' OR value ILIKE '%small%'")
def _(t):
    return filters.keyword_any(t.dict_item, "small", ["label", "value"]).select("id", "label", "value")


@query("p18_by_ids", "SELECT id, code FROM role WHERE id IN ('BUILDING', 'FURNITURE', 'NONE')")
def _(t):
    return filters.by_ids(t.role, ["BUILDING", "FURNITURE", "NONE"]).select("id", "code")


@query("p18_by_id_table", "SELECT id, code FROM permission WHERE id IN (SELECT permission_id FROM role_permission)")
def _(t):
    return filters.by_ids(t.permission, t.role_permission.select("permission_id")).select("id", "code")


@query("p19_permissions_of_type", "SELECT id, code, menu_id FROM permission WHERE permission_type = 2 AND NOT is_deleted")
def _(t):
    return filters.alive(t.permission).where(F.col("permission_type") == 2).select("id", "code", "menu_id").orderBy("id")


@query("p19_posts_of_level", "SELECT id, name, post_level FROM post WHERE post_level = 1 AND NOT is_deleted")
def _(t):
    return filters.alive(t.post).where(F.col("post_level") == 1).select("id", "name", "post_level").orderBy("id")


@query("p20_alive", "SELECT id, code FROM scheduler_job WHERE NOT is_deleted")
def _(t):
    return filters.alive(t.scheduler_job).select("id", "code")


_SEEN = f"""
WITH seen AS (
  SELECT DISTINCT a.id AS announcement_id, u.id AS user_id
  FROM (SELECT id, target_type, unnest(target_ids) AS k FROM announcement WHERE {LIVE}) a JOIN users u
  ON target_type = 'all' OR (target_type = 'dept' AND k = dept_id) OR (target_type = 'role' AND k = role_id) OR (target_type = 'user' AND k = CAST(u.id AS VARCHAR)))"""


@query("p21_audience_sizes", _SEEN + f"""
SELECT a.id AS announcement_id, count(s.user_id) AS reached FROM announcement a LEFT JOIN seen s ON s.announcement_id = a.id WHERE {LIVE} GROUP BY 1""")
def _(t):
    return inbox.audience_sizes(t.announcement, t.users, now())


@query("p21_visible_counts", _SEEN + """
SELECT u.id AS user_id, count(s.announcement_id) AS visible FROM users u LEFT JOIN seen s ON s.user_id = u.id GROUP BY 1""")
def _(t):
    return inbox.visible_counts(t.announcement, t.users, now())


@query("p21_visible_to_one", f"""
SELECT id, title, target_type, priority FROM announcement
WHERE {LIVE} AND (target_type = 'all' OR (target_type = 'dept' AND list_has_any(target_ids, ['N4', 'N9']))
  OR (target_type = 'role' AND list_contains(target_ids, 'FURNITURE')) OR (target_type = 'user' AND list_contains(target_ids, '42')))""")
def _(t):
    return inbox.visible_to(t.announcement, 42, ["N4", "N9"], ["FURNITURE"], now()).select("id", "title", "target_type", "priority")


_FAIL_CASE = " ".join(f"WHEN {k} THEN '{v}'" for k, v in logstats.FAILURE_LABELS.items())


@query("p22_code_labels", f"""
SELECT id, CASE status WHEN 0 THEN '失败' WHEN 1 THEN '成功' ELSE '未知' END AS status_text,
       CASE WHEN failure_reason IS NULL THEN NULL ELSE CASE failure_reason {_FAIL_CASE} ELSE '未知' END END AS reason_text
FROM login_log""")
def _(t):
    return t.login_log.select(
        "id",
        filters.labelled("status", logstats.STATUS_LABELS, logstats.UNKNOWN_LABEL).alias("status_text"),
        filters.labelled("failure_reason", logstats.FAILURE_LABELS, logstats.UNKNOWN_LABEL).alias("reason_text"),
    )


@query("p23_client_info", """
SELECT id, trim(string_split(forwarded_for, ',')[1]) AS client_ip,
  CASE WHEN u LIKE '%chrome%' AND u NOT LIKE '%edg%' THEN 'Chrome' WHEN u LIKE '%firefox%' THEN 'Firefox'
       WHEN u LIKE '%safari%' AND u NOT LIKE '%chrome%' THEN 'Safari' WHEN u LIKE '%edg%' THEN 'Edge'
       WHEN u LIKE '%msie%' OR u LIKE '%trident%' THEN 'IE' END AS browser,
  CASE WHEN u LIKE '%windows%' THEN 'Windows' WHEN u LIKE '%mac os%' OR u LIKE '%macos%' THEN 'macOS' WHEN u LIKE '%linux%' THEN 'Linux'
       WHEN u LIKE '%android%' THEN 'Android' WHEN u LIKE '%iphone%' OR u LIKE '%ipad%' THEN 'iOS' END AS os,
  CASE WHEN u LIKE '%windows%' OR u LIKE '%mac os%' OR u LIKE '%macos%' OR u LIKE '%linux%' THEN 'desktop'
       WHEN u LIKE '%android%' OR u LIKE '%iphone%' THEN 'mobile' WHEN u LIKE '%ipad%' THEN 'tablet' ELSE 'desktop' END AS device
FROM (SELECT *, lower(user_agent) AS u FROM login_log)""")
def _(t):
    return access.client_info(t.login_log, "user_agent", "forwarded_for").select("id", "client_ip", "browser", "os", "device")


@query("p24_path_match", r"""
SELECT id, api_path, regexp_matches('/api/21/PROMO', '^' || regexp_replace(api_path, '\{[^}]+\}', '[^/]+', 'g') || '$') AS matches
FROM permission""")
def _(t):
    return t.permission.select("id", "api_path", access.path_matches(F.lit("/api/21/PROMO"), F.col("api_path")).alias("matches"))


@query("p29_scope_departments", """
WITH s AS (SELECT id AS user_id, dept_id, role_id, CASE WHEN balance < 2000 THEN 0 WHEN balance < 4000 THEN 1 WHEN balance < 6000 THEN 2 WHEN balance < 8000 THEN 3 ELSE 4 END AS scope FROM users)
SELECT user_id, dept_id FROM s WHERE scope IN (2, 3)
UNION SELECT user_id, d.id FROM s JOIN dept d ON scope = 3 AND d.path LIKE '%/' || s.dept_id || '/%'
UNION SELECT user_id, r.dept_id FROM s JOIN role_dept r USING (role_id) WHERE scope = 4""")
def _(t):
    return access.allowed_departments(t.users, scopes(t), t.dept, t.role_dept)


def scopes(t):
    b = F.col("balance")
    level = F.when(b < 2000, 0).when(b < 4000, 1).when(b < 6000, 2).when(b < 8000, 3).otherwise(4)
    return t.users.select(F.col("id").alias("user_id"), level.alias("scope"))


PLACED = """WITH RECURSIVE tree AS (
  SELECT id, [id] AS path FROM dept WHERE parent_id IS NULL UNION ALL SELECT c.id, list_append(t.path, c.id) FROM dept c JOIN tree t ON c.parent_id = t.id),
pl AS (SELECT id, path, row_number() OVER (ORDER BY path) AS first FROM tree),
pi AS (SELECT a.id, a.first, max(d.first) AS last FROM pl a JOIN pl d ON list_contains(d.path, a.id) GROUP BY 1, 2),
s AS (SELECT id AS user_id, dept_id, role_id, CASE WHEN balance < 2000 THEN 0 WHEN balance < 4000 THEN 1 WHEN balance < 6000 THEN 2 WHEN balance < 8000 THEN 3 ELSE 4 END AS scope FROM users)"""


@query("p29_scope_ranges", PLACED + """,
rr AS (SELECT role_id, first, first - row_number() OVER (PARTITION BY role_id ORDER BY first) AS run FROM (SELECT DISTINCT role_id, dept_id FROM role_dept) JOIN pi ON id = dept_id)
SELECT user_id, first, CASE WHEN scope = 3 THEN last ELSE first END AS last FROM s JOIN pi ON id = dept_id WHERE scope IN (2, 3)
UNION ALL SELECT user_id, min(first), max(first) FROM s JOIN rr USING (role_id) WHERE scope = 4 GROUP BY user_id, run""")
def _(t):
    return access.scope_ranges(t.users, scopes(t), trees.intervals(trees.forest(t.dept)), t.role_dept)


@query("p29_readable_counts", PLACED + """
SELECT user_id, count(u.id) AS n FROM (SELECT user_id, dept_id FROM s WHERE scope IN (2, 3)
  UNION SELECT user_id, d.id FROM s JOIN dept d ON scope = 3 AND d.path LIKE '%/' || s.dept_id || '/%'
  UNION SELECT user_id, r.dept_id FROM s JOIN role_dept r USING (role_id) WHERE scope = 4) a JOIN dept d ON d.id = a.dept_id LEFT JOIN users u ON u.dept_id = a.dept_id GROUP BY 1""")
def _(t):
    places = stage(trees.intervals(trees.forest(t.dept)))
    ranges = access.scope_ranges(t.users, scopes(t), places, t.role_dept)
    return access.readable_counts(ranges, t.users, "dept_id", places)


@query("p29_rows_in_ranges", "SELECT id, dept_id FROM users WHERE dept_id = 'R2' OR dept_id IN (SELECT id FROM dept WHERE path LIKE '%/R2/%')")
def _(t):
    places = stage(trees.intervals(trees.forest(t.dept)))
    return access.in_ranges(t.users.select("id", "dept_id"), "dept_id", places.where(F.col("id") == "R2"), places)


@query("p29_scoped_rows", """
SELECT id, name FROM dept WHERE id IN (SELECT 'N4' UNION SELECT id FROM dept WHERE path LIKE '%/N4/%')""")
def _(t):
    below = t.dept.where(F.col("path").contains("/N4/") | (F.col("id") == "N4")).select(F.col("id").alias("dept_id"))
    return access.scoped_rows(t.dept.select("id", "name"), "id", "id", 3, None, below)


@query("p30_visible_bases", "SELECT id, name FROM kb WHERE id IN (SELECT kb_id FROM role_kb WHERE role_id = 'BUILDING')")
def _(t):
    return inbox.visible_bases(t.kb, t.role_kb, "BUILDING").select("id", "name")


@query("p31_role_permissions", """
SELECT DISTINCT role_id, code, api_path, http_method FROM role_permission JOIN permission ON permission_id = id WHERE is_active AND NOT is_deleted""")
def _(t):
    return access.role_permissions(t.role_permission, t.permission)


@query("p32_duplicate_files", """
SELECT digest, size, min(CAST(substr(id, 2) AS BIGINT)) AS first_id, count(*) AS copies FROM file_item WHERE type = 'file'
GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    files = t.file_item.where(F.col("type") == "file")
    return (
        files.groupBy("digest", "size")
        .agg(F.min(F.substring("id", 2, 20).cast("long")).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


@query("p32_first_copy", """
SELECT doc_id, md5(text) AS digest, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text), n_chars ORDER BY doc_id) = 1""")
def _(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("digest"), "n_chars")
    return first_per_key(docs, ["digest", "n_chars"], ["doc_id"])


@query("p33_enabled_permissions", "SELECT id, code FROM permission WHERE is_active AND NOT is_deleted")
def _(t):
    return filters.enabled(t.permission, "is_active", ["id"], "is_deleted").select("id", "code")


@query("p33_enabled_items", "SELECT id, dict_id, value FROM dict_item WHERE status")
def _(t):
    return filters.enabled(t.dict_item, "status", [F.desc("sort"), "id"]).select("id", "dict_id", "value")


@query("p34_files_of_base", "SELECT id, filename, file_size FROM kb_file WHERE kb_id = 'src7'")
def _(t):
    return t.kb_file.where(F.col("kb_id") == "src7").select("id", "filename", "file_size").orderBy("id")


@query("p35_table_search", "SELECT kb_id, count(*) AS files FROM kb_file WHERE kb_id ILIKE '%SRC1%' GROUP BY 1")
def _(t):
    return filters.filter_by(t.kb_file, icontains={"kb_id": "SRC1"}).groupBy("kb_id").agg(F.count(F.lit(1)).alias("files"))


# ---- joins

@query("j01_bases_with_counts", """
SELECT kb.id, kb.name, kb_type, count(f.id) AS file_count FROM kb LEFT JOIN kb_file f ON f.kb_id = kb.id GROUP BY ALL""")
def _(t):
    return inbox.bases_with_counts(t.kb, t.kb_file)


@query("j02_granted_bases", """
SELECT kb.id, kb.name, kb_type, count(f.id) AS file_count FROM kb LEFT JOIN kb_file f ON f.kb_id = kb.id
WHERE kb.id IN (SELECT kb_id FROM role_kb WHERE role_id = 'MACHINERY') GROUP BY ALL""")
def _(t):
    return inbox.bases_with_counts(t.kb, t.kb_file, t.role_kb.where(F.col("role_id") == "MACHINERY"))


@query("j03_readers", """
SELECT announcement_id, user_id, coalesce(u.name, '') AS user_name, read_at, total_read, least(total_read, 20) AS listed
FROM (SELECT *, count(*) OVER (PARTITION BY announcement_id) AS total_read,
             row_number() OVER (PARTITION BY announcement_id ORDER BY read_at DESC, user_id) AS rn FROM announcement_read) r
LEFT JOIN users u ON u.id = user_id WHERE rn <= 20""")
def _(t):
    return inbox.readers(t.announcement_read, t.users, latest=20)


@query("j04_unread_per_user", _SEEN + """
SELECT u.id AS user_id, count(s.announcement_id) AS unread FROM users u
LEFT JOIN (SELECT * FROM seen ANTI JOIN announcement_read USING (announcement_id, user_id)) s ON s.user_id = u.id GROUP BY 1""")
def _(t):
    return inbox.unread_per_user(t.announcement, t.users, t.announcement_read, now())


@query("j04_visible_receipts", _SEEN + " SELECT announcement_id, user_id FROM seen SEMI JOIN announcement_read USING (announcement_id, user_id)")
def _(t):
    return inbox.visible_receipts(t.announcement_read, t.announcement, t.users, now())


@query("j05_read_flag", f"""
SELECT id, title, id IN (SELECT announcement_id FROM announcement_read WHERE user_id = 42) AS is_read FROM announcement
WHERE {LIVE} AND (target_type = 'all' OR (target_type = 'dept' AND list_has_any(target_ids, ['N4', 'N9']))
  OR (target_type = 'role' AND list_contains(target_ids, 'FURNITURE')) OR (target_type = 'user' AND list_contains(target_ids, '42')))""")
def _(t):
    seen = inbox.visible_to(t.announcement, 42, ["N4", "N9"], ["FURNITURE"], now()).select("id", "title")
    return inbox.with_read_flag(seen, t.announcement_read, 42)


@query("j06_dict_items", """
SELECT i.id, i.value, d.code FROM dict_item i JOIN dict d ON i.dict_id = d.id WHERE d.code = 'brand#7' AND d.status AND i.status""")
def _(t):
    dictionary = t.dict.where((F.col("code") == "brand#7") & F.col("status")).select(F.col("id").alias("dict_id"), "code")
    items = t.dict_item.where(F.col("status"))
    return items.join(dictionary, "dict_id").orderBy(F.desc("sort"), "id").select("id", "value", "code")


_MATCH = r"""
WITH asked AS (SELECT DISTINCT path, method FROM request),
     usable AS (SELECT * FROM permission WHERE is_active AND NOT is_deleted),
     matched AS (
  SELECT path, method, CASE WHEN path = api_path AND http_method = method THEN 1 WHEN path = api_path THEN 2 ELSE 3 END AS priority, id AS permission_id
  FROM asked JOIN usable ON http_method IN (method, 5)
   AND (path = api_path OR (contains(api_path, '{') AND regexp_matches(path, '^' || regexp_replace(api_path, '\{[^}]+\}', '[^/]+', 'g') || '$')))),
     best AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY path, method ORDER BY priority, permission_id) = 1)"""


@query("j11_match_requests", _MATCH + " SELECT path, method, priority, permission_id FROM best")
def _(t):
    return access.match_requests(t.request, t.permission)


@query("j12_decisions", _MATCH + """
SELECT r.id, r.user_id, r.path, r.method, b.permission_id,
       coalesce(u.is_superuser, false) OR b.permission_id IS NULL OR g.role_id IS NOT NULL AS allowed
FROM request r LEFT JOIN best b ON r.path = b.path AND r.method = b.method LEFT JOIN users u ON u.id = r.user_id
LEFT JOIN role_permission g ON g.role_id = u.role_id AND g.permission_id = b.permission_id""")
def _(t):
    return access.decide(t.request, t.users, t.permission, t.role_permission)


@query("j17_menu_permissions", """
WITH parents AS (SELECT DISTINCT parent_id AS id FROM menu WHERE parent_id IS NOT NULL),
mine AS (SELECT DISTINCT permission_id AS id FROM role_permission WHERE role_id = 'BUILDING'), menus AS (SELECT DISTINCT menu_id AS id FROM role_menu WHERE role_id = 'BUILDING'),
perms AS (SELECT p.* FROM leaf_permission p LEFT JOIN parents ON parents.id = p.menu_id WHERE parents.id IS NULL AND is_active AND NOT is_deleted)
SELECT m.id AS menu_id, m.parent_id, m.name, menus.id IS NOT NULL AS menu_checked, p.id AS permission_id, p.name AS permission_name, p.code AS permission_code,
  p.permission_type, CASE p.permission_type WHEN 0 THEN '按钮权限' WHEN 1 THEN 'API权限' WHEN 2 THEN '数据权限' WHEN 3 THEN '其他权限' END AS permission_type_label,
  mine.id IS NOT NULL AS permission_checked
FROM menu m LEFT JOIN menus ON menus.id = m.id LEFT JOIN perms p ON p.menu_id = m.id LEFT JOIN mine ON mine.id = p.id""")
def _(t):
    return access.menu_permissions(t.menu, t.leaf_permission, t.role_menu, t.role_permission, "BUILDING")


@query("j18_permissions_of_menu", """
SELECT id, name, code, id IN (SELECT permission_id FROM role_permission WHERE role_id = 'FURNITURE') AS checked
FROM permission WHERE menu_id = 'PROMO:Brand#9' AND is_active AND NOT is_deleted""")
def _(t):
    return access.permissions_of_menu(t.permission, t.role_permission, "FURNITURE", "PROMO:Brand#9")


@query("j19_granted_menus", "SELECT id, parent_id, name FROM menu WHERE id IN (SELECT menu_id FROM role_menu WHERE role_id = 'HOUSEHOLD')")
def _(t):
    return access.granted_menus(t.menu, t.role_menu, "HOUSEHOLD").select("id", "parent_id", "name")


@query("j20_direct_reports", """
SELECT m.id AS manager_id, m.name AS manager_name, u.id AS user_id, u.name AS user_name
FROM users u JOIN users m ON u.manager_id = m.id WHERE u.user_status = 1""")
def _(t):
    return access.direct_reports(t.users)


@query("j21_role_members", "SELECT u.id, u.name, u.role_id FROM users u JOIN role r ON r.id = u.role_id WHERE u.user_status = 1")
def _(t):
    return access.members(t.users, t.role, "role_id").select("id", "name", "role_id")


@query("j22_role_relations", """
SELECT r.id AS role_id, r.name, kind, target_id FROM role r LEFT JOIN (
  SELECT DISTINCT role_id, 'menu' AS kind, menu_id AS target_id FROM role_menu
  UNION ALL SELECT DISTINCT role_id, 'permission', CAST(permission_id AS VARCHAR) FROM role_permission
  UNION ALL SELECT DISTINCT role_id, 'dept', dept_id FROM role_dept) l ON l.role_id = r.id""")
def _(t):
    return access.role_with_relations(t.role, t.role_menu, t.role_permission, t.role_dept)


@query("a15_files_per_base", "SELECT kb_id, count(*) AS files FROM kb_file GROUP BY 1")
def _(t):
    return t.kb_file.groupBy("kb_id").agg(F.count(F.lit(1)).alias("files"))


@query("a17_menu_permission_counts", """
SELECT m.id, m.parent_id, m.name, count(p.id) AS permission_count, m.id IN (SELECT menu_id FROM role_menu WHERE role_id = 'BUILDING') AS selected
FROM menu m LEFT JOIN permission p ON p.menu_id = m.id AND p.is_active AND NOT p.is_deleted GROUP BY m.id, m.parent_id, m.name""")
def _(t):
    return access.menus_with_counts(t.menu, t.permission, t.role_menu, "BUILDING")

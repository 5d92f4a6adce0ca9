"""Changes to tables, as the next version of the table."""

from pyspark.sql import functions as F

from thicket.operators import access, changes, inbox, trees
from thicket.queries.registry import query

NOW_SQL = "TIMESTAMP '1999-06-01 00:00:00'"


def now():
    return F.lit("1999-06-01 00:00:00").cast("timestamp_ntz")


@query("m01_insert", """
SELECT CAST(id AS VARCHAR) AS id, name, code, status FROM post
UNION ALL SELECT md5('new-' || r_name), r_name, 'new-' || r_name, true FROM region""")
def _(t):
    posts = t.post.select(F.col("id").cast("string").alias("id"), "name", "code", "status")
    new = t.region.select(F.col("r_name").alias("name"), F.concat(F.lit("new-"), "r_name").alias("code"))
    return changes.insert(posts, new, ["code"], {"status": True})


@query("m02_update", """
SELECT u.id, CASE WHEN r.c_custkey IS NOT NULL THEN upper(u.name) ELSE u.name END AS name,
       CASE WHEN r.c_custkey IS NOT NULL AND r.c_acctbal < 0 THEN NULL ELSE u.post_id END AS post_id
FROM users u LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < 1000) r ON r.c_custkey = u.id""")
def _(t):
    poor = t.customer.where(F.col("c_acctbal") < 1000).select(
        F.col("c_custkey").alias("id"),
        F.upper("c_name").alias("name"),
        F.lit(None).cast("string").alias("post_id"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("name"), F.lit("post_id"))).otherwise(F.array(F.lit("name"))).alias("fields"),
    )
    return changes.update(t.users.select("id", "name", "post_id"), poor)


@query("m03_soft_delete", """
SELECT id, code, is_deleted OR id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000) AS is_deleted FROM scheduler_job""")
def _(t):
    doomed = t.orders.where(F.col("o_totalprice") > 480000).select("o_custkey")
    return changes.delete(t.scheduler_job.select("id", "code", "is_deleted"), doomed)


@query("m03_hard_delete", "SELECT id, code FROM scheduler_job WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
def _(t):
    doomed = t.orders.where(F.col("o_totalprice") > 480000).select("o_custkey")
    return changes.delete(t.scheduler_job.select("id", "code"), doomed, hard=True)


@query("m03_hit_counts", """
SELECT count(*) FILTER (id IN (SELECT s_suppkey FROM supplier)) AS hits, count(*) FILTER (id NOT IN (SELECT s_suppkey FROM supplier)) AS misses
FROM (SELECT DISTINCT c_custkey AS id FROM customer)""")
def _(t):
    return changes.hit_counts(t.supplier.select(F.col("s_suppkey").alias("id")), t.customer.select("c_custkey"))


@query("m04_duplicates", "SELECT p_name, p_brand, count(*) AS uses FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return changes.duplicates(t.part, ["p_name", "p_brand"])


@query("m04_taken", """
SELECT w.name, w.id, coalesce(bool_or(u.id IS NOT NULL AND (w.id IS NULL OR u.id <> w.id)), false) AS taken
FROM (SELECT DISTINCT CASE WHEN s_acctbal > 5000 THEN 'Customer#' || printf('%09d', s_suppkey) ELSE s_name END AS name, CASE WHEN s_nationkey < 12 THEN s_suppkey END AS id FROM supplier) w
LEFT JOIN users u ON u.name = w.name GROUP BY 1, 2""")
def _(t):
    wanted = t.supplier.select(
        F.when(F.col("s_acctbal") > 5000, F.format_string("Customer#%09d", "s_suppkey")).otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") < 12, F.col("s_suppkey")).alias("id"),
    ).distinct()
    return changes.taken(t.users.select("id", "name"), wanted, "name")


@query("m05_exists", "SELECT count(*) > 0 AS found FROM orders WHERE o_totalprice > 499000 AND o_orderstatus = 'F'")
def _(t):
    return changes.exists(t.orders, (F.col("o_totalprice") > 499000) & (F.col("o_orderstatus") == "F"))


@query("m06_batch_status", """
SELECT id, name, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 0 ELSE user_status END AS user_status FROM users""")
def _(t):
    urgent = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_custkey")
    return changes.set_status(t.users.select("id", "name", "user_status"), urgent, "user_status", 0)


@query("m07_retain_logs", "SELECT id, ts, status FROM login_log WHERE ts >= (SELECT max(ts) FROM login_log) - INTERVAL 7 DAY OR status = 1")
def _(t):
    from thicket.operators.filters import cutoff

    log = t.login_log.select("id", "ts", "status")
    return changes.retain(log, "ts", cutoff(log, "ts", None, days=7), F.col("status") == 0)


@query("m07_retention_counts", """
SELECT count(*) FILTER (ts < c) AS removed, count(*) FILTER (ts >= c) AS kept
FROM login_log, (SELECT max(ts) - INTERVAL 7 DAY AS c FROM login_log)""")
def _(t):
    from thicket.operators.filters import cutoff

    return changes.retention_counts(t.login_log, "ts", cutoff(t.login_log, "ts", None, days=7))


@query("m08_expire_jobs", f"""
SELECT id, code, is_deleted OR coalesce(trigger_type = 'date' AND run_date < {NOW_SQL}, false) AS is_deleted FROM scheduler_job""")
def _(t):
    return changes.expire_jobs(t.scheduler_job, now()).select("id", "code", "is_deleted")


@query("m09_mark_all_read", f"""
WITH busy AS (SELECT recipient_id AS u FROM message WHERE status = 'unread' AND msg_type = '2-HIGH' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT id, recipient_id, CASE WHEN u IS NOT NULL AND msg_type = '2-HIGH' THEN 'read' ELSE status END AS status,
       CASE WHEN u IS NOT NULL AND msg_type = '2-HIGH' AND status = 'unread' THEN {NOW_SQL} END AS read_at FROM message LEFT JOIN busy ON recipient_id = u""")
def _(t):
    unread = t.message.where("status = 'unread' AND msg_type = '2-HIGH'").groupBy("recipient_id").agg(F.count(F.lit(1)).alias("n"))
    busiest = unread.orderBy(F.desc("n"), "recipient_id").first()["recipient_id"]
    return changes.mark_all_read(t.message, busiest, "2-HIGH", now()).select("id", "recipient_id", "status", "read_at")


@query("m09_delete_read", "SELECT id, recipient_id, status FROM message WHERE NOT (recipient_id = 77 AND status = 'read')")
def _(t):
    return changes.delete_read(t.message, 77).select("id", "recipient_id", "status")


@query("m10_fan_out", """
SELECT id AS recipient_id, 'Hello ' || name AS title, name || ' of ' || dept_id || ' has ' || post_id || ' ' AS content, 'unread' AS status FROM users""")
def _(t):
    values = {"user.name": F.col("name"), "dept": F.col("dept_id"), "post": F.col("post_id")}
    return inbox.fan_out(t.users, "Hello ${user.name}", "${user.name} of ${dept} has ${post} ${unknown}", values)


@query("m11_add_receipts", """
SELECT announcement_id, user_id, read_at FROM announcement_read
UNION ALL SELECT p_partkey, p_size, NULL FROM (SELECT DISTINCT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part) p
WHERE NOT EXISTS (SELECT 1 FROM announcement_read r WHERE r.announcement_id = p_partkey AND r.user_id = p_size)""")
def _(t):
    new = t.part.select(F.col("p_partkey").alias("announcement_id"), F.col("p_size").cast("long").alias("user_id"))
    return changes.add_receipts(t.announcement_read, new.unionByName(new), ["announcement_id", "user_id"])


@query("m12_replace_grants", """
SELECT role_id, kb_id FROM role_kb WHERE role_id <> 'BUILDING' UNION ALL SELECT DISTINCT 'BUILDING', source FROM documents WHERE lang = 'fr'""")
def _(t):
    new = t.documents.where(F.col("lang") == "fr").select(F.lit("BUILDING").alias("role_id"), F.col("source").alias("kb_id")).distinct()
    return changes.replace_links(t.role_kb, "role_id", new)


@query("m13_add_members", """
SELECT id, CASE WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'N3' ELSE dept_id END AS dept_id FROM users""")
def _(t):
    return changes.set_member(t.users.select("id", "dept_id"), t.supplier.select("s_suppkey"), "dept_id", "N3")


@query("m13_changed_members", "SELECT count(*) FILTER (dept_id <> 'N3') AS changed FROM users WHERE id IN (SELECT s_suppkey FROM supplier)")
def _(t):
    return changes.changed_members(t.users, t.supplier.select("s_suppkey"), "dept_id", "N3")


@query("m14_copy_role", """
SELECT id, name, code FROM role UNION ALL SELECT 'COPY', 'copy', 'role-copy' FROM role WHERE id = 'FURNITURE'""")
def _(t):
    new = {"id": "COPY", "name": "copy", "code": "role-copy"}
    return changes.copy_with_links(t.role, t.role_menu, "role_id", "FURNITURE", new)[0].select("id", "name", "code")


@query("m14_copy_role_links", """
SELECT role_id, menu_id FROM role_menu UNION ALL SELECT 'COPY', menu_id FROM role_menu WHERE role_id = 'FURNITURE'""")
def _(t):
    new = {"id": "COPY", "name": "copy", "code": "role-copy"}
    return changes.copy_with_links(t.role, t.role_menu, "role_id", "FURNITURE", new)[1]


@query("m15_append_login", """
SELECT id, username, login_ip, status, browser_type FROM login_log
UNION ALL SELECT 1000000000 + event_id, 'user' || user_id, '10.9.9.9', 1, 'Edge' FROM events WHERE event_type = 'signup'""")
def _(t):
    agent = "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Edg/120.0"
    new = t.events.where(F.col("event_type") == "signup").select(
        (F.col("event_id") + 1000000000).alias("id"),
        F.concat(F.lit("user"), "user_id").alias("username"),
        F.lit(1).alias("status"),
        F.lit(agent).alias("ua"),
        F.lit("10.9.9.9, 10.0.0.1").alias("fwd"),
    )
    parsed = access.client_info(new, "ua", "fwd").select(
        "id", "username", F.col("client_ip").alias("login_ip"), "status", F.col("browser").alias("browser_type")
    )
    return changes.append(t.login_log.select("id", "username", "login_ip", "status", "browser_type"), parsed)


@query("m16_cascade", "SELECT id, kb_id, filename FROM kb_file WHERE kb_id NOT IN ('src1', 'src2')")
def _(t):
    doomed = t.kb.where(F.col("id").isin("src1", "src2")).select("id")
    return changes.cascade(t.kb, doomed, [(t.kb_file.select("id", "kb_id", "filename"), "kb_id")])[1]


@query("m17_update_where", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(t):
    test = F.expr("o_orderstatus = 'P' AND o_totalprice > 100000")
    return changes.set_where(t.orders, test, {"o_orderstatus": "X"}).select("o_orderkey", "o_orderstatus")


@query("m17_delete_where", "SELECT node_id AS id, schema_type FROM kg_nodes WHERE schema_type IS NULL OR schema_type <> 'part'")
def _(t):
    return changes.delete_where(t.kg_nodes, F.expr("schema_type = 'part'")).select(F.col("node_id").alias("id"), "schema_type")


@query("m17_insert_row", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(max(r_regionkey) + 1 AS INTEGER), 'NEW' FROM region")
def _(t):
    new = t.region.agg((F.max("r_regionkey") + 1).alias("r_regionkey")).withColumn("r_name", F.lit("NEW"))
    return changes.append(t.region, new)


@query("m18_publish", f"""
SELECT id, CASE WHEN title IS NULL THEN 'missing' WHEN status = 'draft' THEN 'changed' ELSE 'refused' END AS outcome,
       CASE WHEN status = 'draft' THEN 'published' ELSE status END AS status, CASE WHEN status = 'draft' THEN {NOW_SQL} ELSE publish_time END AS publish_time
FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_discount > 0.05) w LEFT JOIN announcement a USING (id)""")
def _(t):
    ids = t.lineitem.where(F.col("l_discount") > 0.05).select("l_partkey")
    out = changes.guarded(t.announcement, ids, F.col("status") == "draft", {"publish_time": now(), "status": "published"})
    return out.select("id", "outcome", "status", "publish_time")


@query("m19_guarded_delete", """
SELECT id, NOT EXISTS (SELECT 1 FROM dept c WHERE c.parent_id = d.id) AND NOT EXISTS (SELECT 1 FROM users u WHERE u.dept_id = d.id) AS deleted FROM dept d""")
def _(t):
    return changes.guarded_delete(t.dept.select("id"), trees.deletable(t.dept, t.users))


@query("m20_add_counts", """
SELECT p_partkey AS id, CAST(p_size AS BIGINT) + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS downloads FROM part""")
def _(t):
    files = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("downloads"))
    return changes.add_counts(files, t.lineitem, "l_partkey", "downloads")


@query("m21_set_graph_flag", """
SELECT id, filename, has_graph OR id IN (SELECT doc_id FROM documents WHERE lang = 'de') AS has_graph FROM kb_file""")
def _(t):
    built = t.documents.where(F.col("lang") == "de").select("doc_id")
    return changes.set_flag(t.kb_file.select("id", "filename", "has_graph"), built, "has_graph")


@query("m22_create_role_with_links", """
SELECT role_id, menu_id FROM role_menu WHERE role_id <> 'BUILDING' UNION ALL SELECT 'BUILDING', id FROM menu WHERE type = 'catalog'""")
def _(t):
    new = t.menu.where(F.col("type") == "catalog").select(F.lit("BUILDING").alias("role_id"), F.col("id").alias("menu_id"))
    return changes.replace_links(t.role_menu, "role_id", new)

"""Operational and graph tables derived from the test tables.

The operators work on login logs, departments, roles, announcements, graphs and so on. These are
not among the test tables, so each one is defined here as a plain SELECT over them, in SQL that
Spark and the oracle engine both accept. ``{name}`` refers to a test table or another stand-in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

STANDINS: dict[str, str] = {}

# ---- event log: one login attempt per event; an error event is a failed attempt
STANDINS["login_log"] = """
SELECT event_id AS id, ts, user_id, concat('user', user_id) AS username,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status,
       CASE WHEN event_type = 'error' THEN k % 9 END AS failure_reason,
       concat('10.0.0.', k % 16) AS login_ip, concat('zone', k % 4) AS ip_location,
       CASE k % 7
         WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36'
         WHEN 1 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0'
         WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_1) AppleWebKit/605.1.15 Version/17.1 Safari/605.1.15'
         WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:120.0) Gecko/20100101 Firefox/120.0'
         WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36'
         WHEN 5 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 Version/17.1 Mobile Safari/604.1'
         ELSE 'okhttp/4.12 (Android)' END AS user_agent,
       concat('10.0.0.', k % 16, ', 172.16.0.', k % 5) AS forwarded_for,
       CASE WHEN k % 7 IN (4, 5) THEN 'mobile' ELSE 'desktop' END AS device_type,
       CASE WHEN k % 7 IN (0, 4) THEN 'Chrome' WHEN k % 7 = 1 THEN 'Edge' WHEN k % 7 = 3 THEN 'Firefox'
            WHEN k % 7 IN (2, 5) THEN 'Safari' END AS browser_type,
       CASE WHEN k % 7 IN (0, 1) THEN 'Windows' WHEN k % 7 IN (2, 5) THEN 'macOS' WHEN k % 7 IN (3, 4) THEN 'Linux' END AS os_type,
       value, event_type
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""

# ---- counter samples: every event type is a host that reports a counter
STANDINS["samples"] = """
SELECT event_id AS id, event_type AS host, ts, value AS counter,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS cpu, user_id AS pid FROM {events}
"""

# ---- scheduler: customers are jobs, orders are executions
STANDINS["scheduler_job"] = """
SELECT c_custkey AS id, c_name AS name, concat('job', c_custkey) AS code, c_mktsegment AS job_group,
       CASE WHEN c_nationkey < 8 THEN 'cron' WHEN c_nationkey < 16 THEN 'interval' ELSE 'date' END AS trigger_type,
       CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 2 ELSE 1 END AS status,
       c_nationkey AS priority, first_run AS run_date, c_acctbal < 0 AS is_deleted
FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_run FROM {orders} GROUP BY o_custkey) f
  ON c.c_custkey = f.o_custkey
"""
STANDINS["scheduler_log"] = """
SELECT o_orderkey AS id, o_custkey AS job_id, concat('job', o_custkey) AS job_code,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
       o_orderdate AS start_time, o_totalprice / 100 AS duration, o_orderpriority AS result
FROM {orders}
"""

# ---- departments: region -> nation -> customer
STANDINS["dept"] = """
SELECT concat('R', r_regionkey) AS id, r_name AS name, concat('reg-', r_regionkey) AS code, 'company' AS dept_type,
       true AS status, CAST(NULL AS STRING) AS parent_id, 0 AS level, '/' AS path, r_regionkey AS sort, false AS is_deleted
FROM {region}
UNION ALL
SELECT concat('N', n_nationkey), n_name, concat('nat-', n_nationkey), 'department', true,
       concat('R', n_regionkey), 1, concat('/R', n_regionkey, '/'), n_nationkey, false
FROM {nation}
UNION ALL
SELECT concat('C', c_custkey), c_name, concat('cus-', c_custkey),
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 'other' ELSE 'team' END, c_acctbal >= 0,
       concat('N', c_nationkey), 2, concat('/R', n_regionkey, '/N', n_nationkey, '/'),
       CAST(c_custkey AS INT), false
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# ---- people: customers again, as users of a nation department with their segment as role
STANDINS["users"] = """
SELECT c_custkey AS id, concat('user', c_custkey) AS username, c_name AS name, c_acctbal > 9900 AS is_superuser,
       CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS user_status, concat('N', c_nationkey) AS dept_id,
       c_mktsegment AS role_id, CASE WHEN c_acctbal > 9900 THEN 'lead' WHEN c_acctbal > 5000 THEN 'senior' WHEN c_acctbal > 0 THEN 'junior' ELSE 'trainee' END AS post_id,
       CASE WHEN c_custkey > 0 THEN CAST(floor(c_custkey / 10) AS BIGINT) END AS manager_id, c_acctbal AS balance
FROM {customer}
"""
STANDINS["post"] = """
SELECT s_suppkey AS id, s_name AS name, concat('post', s_suppkey) AS code,
       CASE WHEN s_acctbal < 0 THEN 'service' WHEN s_acctbal < 3000 THEN 'technical' WHEN s_acctbal < 7000 THEN 'management' ELSE 'function' END AS post_type,
       CASE WHEN s_nationkey < 8 THEN 0 WHEN s_nationkey < 16 THEN 1 ELSE 2 END AS post_level,
       concat('N', s_nationkey) AS dept_id, s_acctbal >= 1000 AS status, s_acctbal < -500 AS is_deleted
FROM {supplier}
"""

# ---- roles and grants: segments; what their customers bought decides the grants
STANDINS["role"] = """
SELECT c_mktsegment AS id, lower(c_mktsegment) AS name, concat('role-', lower(c_mktsegment)) AS code,
       max(c_acctbal) > 0 AS status, count(*) AS priority FROM {customer} GROUP BY c_mktsegment
"""
STANDINS["menu"] = """
SELECT p_type AS id, CAST(NULL AS STRING) AS parent_id, lower(p_type) AS name, concat('/', lower(p_type)) AS path,
       'catalog' AS type, CAST(count(*) AS BIGINT) AS ord FROM {part} GROUP BY p_type
UNION ALL
SELECT concat(p_type, ':', p_brand), p_type, p_brand, concat('/', lower(p_type), '/', lower(p_brand)), 'menu', CAST(count(*) AS BIGINT)
FROM {part} GROUP BY p_type, p_brand
UNION ALL
SELECT concat(p_type, ':', p_brand, ':', p_size), concat(p_type, ':', p_brand), concat('size', p_size),
       concat('/', lower(p_type), '/', lower(p_brand), '/', p_size), 'button', CAST(count(*) AS BIGINT)
FROM {part} WHERE p_size < 40 GROUP BY p_type, p_brand, p_size
UNION ALL
SELECT concat('orphan:', p_size), concat('gone:', p_size), concat('orphan', p_size), concat('/orphan/', p_size), 'menu', CAST(count(*) AS BIGINT)
FROM {part} WHERE p_size >= 40 GROUP BY p_size
"""
STANDINS["permission"] = """
SELECT p_partkey AS id, concat(p_type, ':', p_brand) AS menu_id, p_name AS name, concat('perm', p_partkey) AS code,
       CASE WHEN p_size < 12 THEN 0 WHEN p_size < 25 THEN 1 WHEN p_size < 38 THEN 2 ELSE 3 END AS permission_type,
       CASE WHEN p_size < 20 THEN concat('/api/', p_size, '/', p_type) WHEN p_size < 35 THEN concat('/api/', p_size, '/{{kind}}')
            ELSE concat('/api/{{n}}/', p_type) END AS api_path,
       CASE WHEN p_retailprice < 950 THEN 5 WHEN p_retailprice < 1000 THEN 0 WHEN p_retailprice < 1050 THEN 1 ELSE 2 END AS http_method,
       p_size % 5 AS data_scope, p_brand <> 'Brand#1' AS is_active, p_size = 50 AS is_deleted
FROM {part}
"""
# the same permissions on the menus that have no menus below
STANDINS["leaf_permission"] = """
SELECT id, CASE WHEN p_size < 40 THEN concat(menu_id, ':', p_size) WHEN p_size % 2 = 0 THEN menu_id ELSE concat('orphan:', p_size) END AS menu_id,
       name, code, permission_type, is_active, is_deleted
FROM {permission} JOIN {part} ON id = p_partkey
"""
STANDINS["role_permission"] = """
SELECT DISTINCT c_mktsegment AS role_id, l_partkey AS permission_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
WHERE l_returnflag = 'R' AND l_quantity >= 45
"""
STANDINS["role_menu"] = """
SELECT DISTINCT role_id, menu_id FROM {role_permission} JOIN {permission} ON permission_id = id WHERE permission_type = 0
"""
STANDINS["role_dept"] = """
SELECT DISTINCT c_mktsegment AS role_id, concat('N', c_nationkey) AS dept_id FROM {customer} WHERE c_acctbal > 9000
"""
STANDINS["request"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user_id, concat('/api/', p_size, '/', p_type) AS path,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS method
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

# ---- messages, announcements and read receipts
STANDINS["message"] = """
SELECT o_orderkey AS id, o_custkey AS recipient_id, o_orderpriority AS msg_type,
       CASE o_orderstatus WHEN 'F' THEN 'read' ELSE 'unread' END AS status, o_orderdate AS created, o_totalprice AS amount
FROM {orders}
"""
STANDINS["announcement"] = """
SELECT p_partkey AS id, p_name AS title, concat(p_brand, ' ', p_type) AS content,
       CASE WHEN p_type = 'MEDIUM' THEN 'draft' ELSE 'published' END AS status, p_size AS priority,
       p_retailprice >= 1000 AS is_top,
       CASE WHEN p_size < 3 THEN 'all' WHEN p_size < 25 THEN 'dept' WHEN p_size < 40 THEN 'role' ELSE 'user' END AS target_type,
       split(CASE WHEN p_size < 3 THEN '' WHEN p_size < 25 THEN concat('N', p_size, ',N', p_size - 2)
                  WHEN p_size < 40 THEN CASE WHEN p_size < 30 THEN 'BUILDING,MACHINERY' ELSE 'FURNITURE' END
                  ELSE concat(p_partkey, ',', p_size) END, ',') AS target_ids,
       publish_time, CASE WHEN p_size % 10 <> 0 THEN expire_time END AS expire_time
FROM {part} LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS publish_time, max(l_shipdate) AS expire_time FROM {lineitem} GROUP BY l_partkey) s
  ON p_partkey = l_partkey
"""
STANDINS["announcement_read"] = """
SELECT l_partkey AS announcement_id, o_custkey AS user_id, min(o_orderdate) AS read_at
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_partkey, o_custkey
"""

# ---- knowledge bases: a source is a base, a document is a file
STANDINS["kb"] = """
SELECT source AS id, concat('base ', source) AS name, max(lang) AS kb_type FROM {documents} GROUP BY source
UNION ALL SELECT concat('empty', r_regionkey), concat('base empty', r_regionkey), 'none' FROM {region}
"""
STANDINS["kb_file"] = """
SELECT d.doc_id AS id, source AS kb_id, concat('Doc', d.doc_id, CASE WHEN lang = 'en' THEN '.TXT' ELSE '.md' END) AS filename,
       text AS content, lang, n_chars AS file_size, quality IS NOT NULL AS has_graph
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
STANDINS["role_kb"] = """
SELECT DISTINCT c_mktsegment AS role_id, concat('src', c_nationkey) AS kb_id FROM {customer} WHERE c_acctbal > 9000
"""
STANDINS["file_item"] = """
SELECT concat('L', lang) AS id, lang AS name, 'folder' AS type, CAST(NULL AS STRING) AS parent_id, concat('/', lang) AS path,
       CAST(0 AS BIGINT) AS size, CAST(NULL AS STRING) AS file_ext, CAST(NULL AS STRING) AS digest FROM {documents} GROUP BY lang
UNION ALL
SELECT concat('L', lang, '/', source), source, 'folder', concat('L', lang), concat('/', lang, '/', source), CAST(0 AS BIGINT), CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {documents} GROUP BY lang, source
UNION ALL
SELECT concat('D', doc_id), concat('doc', doc_id, '.txt'), 'file', concat('L', lang, '/', source), concat('/', lang, '/', source, '/doc', doc_id, '.txt'),
       n_chars, 'txt', md5(text)
FROM {documents}
"""

# ---- dictionaries: a brand is a dictionary, its parts are the items
STANDINS["dict"] = """
SELECT p_brand AS id, lower(p_brand) AS code, min(p_name) AS name, max(p_size) > 45 AS status FROM {part} GROUP BY p_brand
"""
STANDINS["dict_item"] = """
SELECT p_partkey AS id, p_brand AS dict_id, p_name AS label, concat(p_type, '-', p_partkey) AS value, p_size AS sort, p_size < 45 AS status FROM {part}
"""

# ---- data-source specifications and page definitions: pages
STANDINS["page_def"] = """
SELECT page_id AS id, url AS code, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS name,
       CASE WHEN url LIKE 'https%' THEN 'published' ELSE 'draft' END AS status,
       regexp_extract(url, '^[a-z]+://[^/]+/([a-z]*)', 1) AS category, CAST(length(html) AS BIGINT) AS size
FROM {pages}
"""

# ---- property graph: customers, suppliers, nations, regions, parts; segments and brands are attributes
STANDINS["kg_nodes"] = """
SELECT concat('C', c_custkey) AS node_id, 'entity' AS label, 2 AS level, c_name AS name, concat('customer of ', lower(c_mktsegment)) AS description,
       CASE WHEN c_acctbal >= 0 THEN 'customer' END AS schema_type, concat('D', c_custkey) AS chunk_id, c_custkey AS vec_id FROM {customer}
UNION ALL
SELECT concat('S', s_suppkey), 'entity', 2, s_name, 'supplier of parts', 'supplier', concat('D', s_suppkey + 30), s_suppkey + 30 FROM {supplier}
UNION ALL
SELECT concat('N', n_nationkey), 'entity', 2, n_name, '', 'nation', CAST(NULL AS STRING), CAST(n_nationkey + 5 AS BIGINT) FROM {nation}
UNION ALL
SELECT concat('R', r_regionkey), 'entity', 2, r_name, CAST(NULL AS STRING), 'region', CAST(NULL AS STRING), CAST(r_regionkey AS BIGINT) FROM {region}
UNION ALL
SELECT concat('P', p_partkey), 'entity', 2, p_name, concat(p_brand, ' ', p_type), 'part', concat('D', p_partkey), p_partkey + 60 FROM {part}
UNION ALL
SELECT concat('A', c_mktsegment), 'attribute', 1, concat('segment: ', c_mktsegment), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(min(c_custkey) + 100 AS BIGINT) FROM {customer} GROUP BY c_mktsegment
UNION ALL
SELECT concat('B', p_brand), 'attribute', 1, concat('brand: ', p_brand), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(min(p_partkey) + 150 AS BIGINT) FROM {part} GROUP BY p_brand
"""
STANDINS["kg_edges"] = """
SELECT CAST(n_nationkey AS BIGINT) AS seq, concat('N', n_nationkey) AS src, 'located' AS relation, concat('R', n_regionkey) AS dst FROM {nation}
UNION ALL SELECT 1000000000 + c_custkey, concat('C', c_custkey), 'in_nation', concat('N', c_nationkey) FROM {customer}
UNION ALL SELECT 2000000000 + s_suppkey, concat('S', s_suppkey), 'in_nation', concat('N', s_nationkey) FROM {supplier}
UNION ALL SELECT 3000000000 + c_custkey, concat('C', c_custkey), 'has_attribute', concat('A', c_mktsegment) FROM {customer}
UNION ALL SELECT 4000000000 + p_partkey, concat('P', p_partkey), 'has_attribute', concat('B', p_brand) FROM {part}
UNION ALL SELECT 10000000000 + l_orderkey * 10 + l_linenumber, concat('P', l_partkey), CASE l_returnflag WHEN 'R' THEN 'contains' ELSE 'supplied_by' END, concat('S', l_suppkey)
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag
      FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_linenumber) l
"""
# the same graph as written relationships, both ends with label, name and type
STANDINS["kg_triples"] = """
SELECT e.seq, s.label AS s_label, s.name AS s_name, s.schema_type AS s_type, e.relation, t.label AS t_label, t.name AS t_name, t.schema_type AS t_type
FROM {kg_edges} e JOIN {kg_nodes} s ON e.src = s.node_id JOIN {kg_nodes} t ON e.dst = t.node_id
"""
# unit vectors of the graph's nodes; edge vectors are the normalized sum of the ends
STANDINS["node_vec"] = """
SELECT node_id AS id, embedding AS emb FROM {kg_nodes} JOIN {embeddings} USING (vec_id)
"""
# edges without duplicates, and communities: the customers of a nation
STANDINS["kg_unique"] = """
SELECT src, relation, dst, min(seq) AS seq FROM {kg_edges} GROUP BY src, relation, dst
"""
STANDINS["comm_member"] = """
SELECT concat('M', c_nationkey) AS comm_id, c_name AS member FROM {customer}
"""
# a fixed community per customer that has a vector: its nation
STANDINS["assigned"] = """
SELECT CAST(c_nationkey AS BIGINT) AS comm_id, concat('C', c_custkey) AS node_id FROM {customer} JOIN {embeddings} ON c_custkey = vec_id
"""
STANDINS["comm_vec"] = """
SELECT concat('M', n_nationkey) AS id, embedding AS emb FROM (SELECT n_nationkey, n_nationkey + 200 AS vec_id FROM {nation}) n JOIN {embeddings} USING (vec_id)
"""
STANDINS["relation_vec"] = """
SELECT relation AS id, embedding AS emb
FROM (SELECT relation, row_number() OVER (ORDER BY relation) * 7 AS vec_id FROM (SELECT DISTINCT relation FROM {kg_edges}) r) n JOIN {embeddings} USING (vec_id)
"""
# one question per label: its words and its vector
STANDINS["question"] = """
SELECT CAST(label AS BIGINT) AS query_id, embedding AS emb,
       concat('Where was the ', CASE WHEN label < 3 THEN 'customer' WHEN label < 6 THEN 'supplier' ELSE 'small widget' END, ' located, and what is Brand#', label + 1, '?') AS text,
       CASE WHEN label < 4 THEN 'nation,region' WHEN label < 7 THEN 'customer' ELSE '' END AS types
FROM (SELECT label, min(vec_id) AS vec_id FROM {embeddings} GROUP BY label) f JOIN (SELECT vec_id, embedding FROM {embeddings}) e USING (vec_id)
"""
STANDINS["chunk"] = """
SELECT concat('D', doc_id) AS chunk_id, doc_id, text FROM {documents}
"""
STANDINS["chunk_vec"] = """
SELECT concat('D', vec_id) AS id, embedding AS emb FROM {embeddings}
"""
# triples proposed by a reader of conversations: speaker, role, first word
STANDINS["turn_triple"] = """
SELECT conv_id * 1000 + turn AS seq, concat('talk', conv_id) AS h, role AS r, regexp_extract(text, '([A-Za-z]+)', 1) AS t FROM {conversations}
"""


def _names(sql: str) -> list[str]:
    return [m for m in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)]


class Tables:
    """The test tables and the stand-ins on them, as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in STANDINS):
            raise AttributeError(name)
        if name not in self._seen:
            if name in STANDINS:
                sql = STANDINS[name]
                self._seen[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in set(_names(sql))})
            else:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._seen[name]


def oracle_ctes(names: set[str]) -> list[tuple[str, str]]:
    """The named stand-ins and what they need, as (name, SQL) in order of dependency."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        for dep in _names(STANDINS[name]):
            if dep in STANDINS:
                visit(dep)
        needed.add(name)

    for n in names:
        visit(n)
    every = {n: n for n in [*BASE, *STANDINS]}
    return [(n, STANDINS[n].format(**every).strip()) for n in STANDINS if n in needed]
